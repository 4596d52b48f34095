import json
import random
import zlib

import pytest

from chunkwise import job
from chunkwise.__main__ import main
from chunkwise.functions import framing
from chunkwise.functions.checksum import crc32_joined
from chunkwise.plans import launch, registry

from . import oracle


def test_checksums_of_joined_pieces():
    rng = random.Random(1)
    for n, m in ((0, 0), (0, 5), (5, 0), (1, 1), (1000, 77), (3, 100_000)):
        a, b = rng.randbytes(n), rng.randbytes(m)
        assert crc32_joined(zlib.crc32(a), zlib.crc32(b), m) == zlib.crc32(a + b)


@pytest.fixture(params=["text", "bytes", "empty"])
def source(request, tmp_path):
    rng = random.Random(2)
    data = {"text": "".join(rng.choice(["über ", "some ", "words €", "\n"]) for _ in range(60_000)).encode(), "bytes": rng.randbytes(50_000), "empty": b""}[request.param]
    path = tmp_path / "in"
    path.write_bytes(data)
    return path


def test_a_file_comes_back_as_it_was(spark, source, tmp_path, monkeypatch):
    monkeypatch.setattr(job, "PART", 40_000)
    monkeypatch.setattr(job, "PORTION", 30_000)
    said = job.compress(spark, str(source), f"{tmp_path}/out", order=1, pin=1000)
    assert said["orig"] == source.stat().st_size and said["comp"] == (tmp_path / "out").stat().st_size and said["crc32"] == zlib.crc32(source.read_bytes())
    assert job.info(f"{tmp_path}/out")["n_chunks"] == said["n_chunks"] and not (tmp_path / "out.parts").exists()
    job.decompress(spark, f"{tmp_path}/out", f"{tmp_path}/back")
    assert (tmp_path / "back").read_bytes() == source.read_bytes()
    (tmp_path / "out.index").unlink()
    job.decompress(spark, f"{tmp_path}/out", f"{tmp_path}/again")
    assert (tmp_path / "again").read_bytes() == source.read_bytes()


def test_damage_is_refused(spark, tmp_path):
    (tmp_path / "in").write_text("a sentence, and another one. " * 500)
    job.compress(spark, f"{tmp_path}/in", f"{tmp_path}/out", pin=700)
    whole = bytearray((tmp_path / "out").read_bytes())
    head = framing.unpack_header(bytes(whole))
    assert head.crc32 == zlib.crc32((tmp_path / "in").read_bytes()) and not head.flags
    whole[framing.LAYOUT.size + 20] ^= 64
    (tmp_path / "out").write_bytes(whole)
    with pytest.raises(job.Failed):
        job.decompress(spark, f"{tmp_path}/out", f"{tmp_path}/back")
    assert not (tmp_path / "back").exists()
    (tmp_path / "out").write_bytes(whole[:-3])
    with pytest.raises(Exception, match="container|Damaged"):
        job.decompress(spark, f"{tmp_path}/out", f"{tmp_path}/back")


def test_parts_are_joined_again_after_a_lost_driver(spark, tmp_path, monkeypatch):
    (tmp_path / "in").write_text("some words " * 4000)
    join = job.finalize
    monkeypatch.setattr(job, "finalize", lambda out: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        job.compress(spark, f"{tmp_path}/in", f"{tmp_path}/out", order=1)
    monkeypatch.setattr(job, "finalize", join)
    assert main(["finalize", f"{tmp_path}/out"]) == 0 and not (tmp_path / "out.parts").exists()
    said = job.decompress(spark, f"{tmp_path}/out", f"{tmp_path}/back")
    assert (tmp_path / "back").read_text() == "some words " * 4000 and set(said["phases"]) == {"decode", "finalize"}


def test_what_the_environment_says(spark, tmp_path):
    (tmp_path / "in").write_text("words " * 500)
    said = job.from_environment(spark, {"CHUNKWISE_MODE": "compress", "CHUNKWISE_INPUT": f"{tmp_path}/in", "CHUNKWISE_OUTPUT": f"{tmp_path}/out", "CHUNKWISE_CHUNK": "700", "CHUNKWISE_ORDER": "0"})
    assert said["orig"] == 3000 and said["n_chunks"] == 5 and set(said["phases"]) == {"fit", "encode", "finalize"}
    assert job.from_environment(spark, {"CHUNKWISE_MODE": "decompress", "CHUNKWISE_INPUT": f"{tmp_path}/out", "CHUNKWISE_OUTPUT": f"{tmp_path}/back"})["orig"] == 3000
    for wrong in ({}, {"CHUNKWISE_MODE": "compress", "CHUNKWISE_INPUT": "x"}, {"CHUNKWISE_MODE": "other", "CHUNKWISE_INPUT": "x", "CHUNKWISE_OUTPUT": "y"}):
        with pytest.raises(ValueError):
            job.from_environment(spark, wrong)


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in").write_text("words " * 3000)
    assert main(["compress", f"{tmp_path}/in", f"{tmp_path}/out", "--order", "1", "--chunk", "500"]) == 0
    assert json.loads(capsys.readouterr().out)["orig"] == 18_000
    assert main(["info", f"{tmp_path}/out"]) == 0 and json.loads(capsys.readouterr().out)["has_crc"]
    assert main(["decompress", f"{tmp_path}/out", f"{tmp_path}/back"]) == 0
    assert (tmp_path / "back").read_text() == "words " * 3000
    capsys.readouterr()
    assert main(["verify", f"{tmp_path}/in", f"{tmp_path}/work", "--order", "1"]) == 0
    run = json.loads(capsys.readouterr().out)
    assert run["exact"] and run["orig"] == 18_000 and 0 < run["ratio"] < 1 and run["passed"] == (run["ratio_ok"] and run["encode_ok"] and run["decode_ok"])
    assert main(["info", f"{tmp_path}/in"]) == 1 and main(["info", f"{tmp_path}/none"]) == 1


@pytest.mark.parametrize("target", sorted(launch.TEMPLATES))
def test_launch_artifacts_run_the_script(target, capsys):
    values = ["shared_dir=/shared", "input_url=a", "output_url=b", "image=img", "queue=q"]
    assert main(["plan", target, *values]) == 0
    assert "chunkwise_job.py" in capsys.readouterr().out
    assert main(["plan", target]) == 1
    with pytest.raises(ValueError):
        launch.check("yaml", "apiVersion: batch/v1\nkind Job\n")


def test_sorted_rows_become_one_file_without_passing_the_driver(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    rows = [(k, rng.randbytes(rng.randrange(0, 400))) for k in range(3000)]
    df = spark.createDataFrame(rng.sample(rows, len(rows)) + [(-1, None)], "k long, raw binary").repartition(5)
    monkeypatch.setattr(type(df), "toLocalIterator", None)
    job.write_rows(df.orderBy("k"), "raw", f"{tmp_path}/all")
    assert (tmp_path / "all").read_bytes() == b"".join(r[1] for r in rows)
    job.write_rows(df.limit(0).orderBy("k"), "raw", f"{tmp_path}/none")
    assert (tmp_path / "none").read_bytes() == b"" and not (tmp_path / "all.parts").exists()
    got = registry.QUERIES["job_roundtrip"](spark, oracle.SF)
    assert oracle.from_spark(got) == oracle.from_sql(registry.SQL["job_roundtrip"])
