"""Command line: compress, decompress, verify, finalize, info, plan for launch artifacts, and run for what the environment says."""

from __future__ import annotations

import argparse
import json
import os
import sys

from . import job
from .functions.framing import Damaged
from .plans import launch


def _session():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("chunkwise").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="chunkwise")
    modes = parser.add_subparsers(dest="mode", required=True)
    for name in ("compress", "decompress", "verify"):
        mode = modes.add_parser(name)
        mode.add_argument("source")
        mode.add_argument("out")
        if name != "decompress":
            mode.add_argument("--order", type=int, default=job.codec.ORDER, choices=(0, 1, 2))
            mode.add_argument("--chunk", type=int, default=None, help="bytes of a chunk")
    modes.add_parser("info").add_argument("source")
    modes.add_parser("finalize").add_argument("out")
    modes.add_parser("run")
    plan = modes.add_parser("plan")
    plan.add_argument("target", choices=sorted(launch.TEMPLATES))
    plan.add_argument("values", nargs="*", metavar="NAME=VALUE")
    a = parser.parse_args(arguments)
    try:
        if a.mode == "plan":
            print(launch.render(a.target, launch.DEFAULTS | dict(v.partition("=")[::2] for v in a.values)))
            return 0
        if a.mode == "info":
            said = job.info(a.source)
        elif a.mode == "finalize":
            job.finalize(a.out)
            said = job.info(a.out)
        elif a.mode == "run":
            said = job.from_environment(_session(), os.environ)
        elif a.mode == "decompress":
            said = job.decompress(_session(), a.source, a.out)
        else:
            run = job.compress if a.mode == "compress" else job.verify
            said = run(_session(), a.source, a.out, order=a.order, pin=a.chunk)
    except (ValueError, FileNotFoundError, Damaged, job.Failed) as e:
        print(f"chunkwise: {e}", file=sys.stderr)
        return 1
    print(json.dumps(said))
    return 0 if a.mode != "verify" or said["exact"] else 1


if __name__ == "__main__":
    sys.exit(main())
