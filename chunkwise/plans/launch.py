"""Launch artifacts for schedulers: templates with {{ names }}, filled in and checked."""

from __future__ import annotations

import json
import re

#: The script that the templates run, and the mode it runs in.
DEFAULTS = {"script": "chunkwise_job.py", "mode": "compress", "executors": 2, "memory": "8g", "master": "local[*]", "job_name": "chunkwise"}
PLACE = re.compile(r"\{\{\s*(\w+)\s*\}\}")
SUBMIT = "spark-submit --master {{ master }} --name {{ job_name }} --conf spark.executor.instances={{ executors }} --conf spark.executor.memory={{ memory }} --conf spark.checkpoint.dir={{ shared_dir }} {{ script }} {{ mode }} {{ input_url }} {{ output_url }}"
ARGUMENTS = re.split(r" (?![^{]*\}\})", SUBMIT)

TEMPLATES: dict[str, tuple[str, str]] = {
    "local": ("sh", f"#!/bin/sh\nset -eu\n{SUBMIT}\n"),
    "slurm": ("sbatch", f"#!/bin/bash\n#SBATCH --job-name={{{{ job_name }}}}\n#SBATCH --nodes={{{{ executors }}}}\nset -eu\n{SUBMIT}\n"),
    "k8s": ("yaml", 'apiVersion: batch/v1\nkind: Job\nmetadata:\n  name: {{ job_name }}\nspec:\n  backoffLimit: 2\n  template:\n    spec:\n      restartPolicy: Never\n      containers:\n        - name: driver\n          image: {{ image }}\n          command: ["/bin/sh", "-c", "' + SUBMIT + '"]\n'),
    "aws-batch": ("json", json.dumps({"jobName": "{{ job_name }}", "jobQueue": "{{ queue }}", "jobDefinition": "{{ image }}", "retryStrategy": {"attempts": 2}, "containerOverrides": {"command": ARGUMENTS}}, indent=2)),
    "gcp-batch": ("json", json.dumps({"taskGroups": [{"taskCount": 1, "taskSpec": {"maxRetryCount": 2, "runnables": [{"container": {"imageUri": "{{ image }}", "commands": ARGUMENTS}}]}}], "labels": {"job": "{{ job_name }}"}}, indent=2)),
    "modal": ("py", 'import subprocess\n\nimport modal\n\napp = modal.App("{{ job_name }}")\n\n\n@app.function(image=modal.Image.from_registry("{{ image }}"))\ndef main():\n    subprocess.run("""' + SUBMIT + '""".split(), check=True)\n'),
    "ray": ("py", 'import subprocess\n\nimport ray\n\nray.init()\n\n\n@ray.remote\ndef main():\n    subprocess.run("""' + SUBMIT + '""".split(), check=True)\n\n\nray.get(main.remote())\n'),
}


def fill(template: str, values: dict) -> str:
    """Every name replaced; ValueError names those that have no value."""
    missing = sorted({n for n in PLACE.findall(template) if n not in values})
    if missing:
        raise ValueError(f"no value for {', '.join(missing)}")
    return PLACE.sub(lambda m: str(values[m[1]]), template)


def check(kind: str, text: str) -> None:
    """ValueError or SyntaxError if an artifact can't be what its kind says."""
    if not text.strip():
        raise ValueError("the artifact is empty")
    if kind == "json":
        json.loads(text)
    elif kind == "py":
        compile(text, "artifact", "exec")
    elif kind == "yaml":
        _check_yaml(text)


def _check_yaml(text: str) -> None:
    """The keys that a job needs, each at its own depth, and nothing that isn't a key, an item or a quoted flow."""
    path, seen = [], set()
    for number, line in enumerate(text.splitlines(), 1):
        bare = line.lstrip(" ")
        if not bare or bare.startswith("#"):
            continue
        depth = len(line) - len(bare)
        if bare.startswith("- "):
            depth, bare = depth + 2, bare[2:]
        m = re.fullmatch(r"([A-Za-z][\w.-]*):(?: (\S.*))?", bare)
        if not m or depth % 2 or "\t" in line or (m[2] or "").count('"') % 2:
            raise ValueError(f"line {number} isn't a key with a value")
        while path and path[-1][0] >= depth:
            path.pop()
        path.append((depth, m[1]))
        seen.add(".".join(k for _, k in path))
    missing = {"apiVersion", "kind", "metadata.name", "spec.template.spec.containers.image"} - seen
    if missing:
        raise ValueError(f"no {', '.join(sorted(missing))}")


def render(target: str, values: dict) -> str:
    if target not in TEMPLATES:
        raise ValueError(f"unknown target {target}; there are {', '.join(sorted(TEMPLATES))}")
    kind, template = TEMPLATES[target]
    text = fill(template, values)
    check(kind, text)
    return text
