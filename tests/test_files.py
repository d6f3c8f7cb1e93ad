"""Tables in the shared folder are written without starting a shell for each file."""

import os
import shutil
import stat
import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
from pyspark.sql import SparkSession
from maxentnet.plans import scratch

spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", f"file://{sys.argv[1]}").getOrCreate()
for session in (spark, spark.newSession()):
    out = scratch.written(session.range(0, 100, 1, 4), "rows")
    assert sorted(r["id"] for r in out.collect()) == list(range(100))
    scratch._LEFT.clear()  # the tables stay
spark.range(3).write.parquet(f"file://{sys.argv[1]}/plain")
"""


def test_no_command_is_started_for_a_written_file(tmp_path):
    bin_, log, tables = tmp_path / "bin", tmp_path / "log", tmp_path / "tables"
    bin_.mkdir()
    (bin_ / "chmod").write_text(f'#!/bin/sh\necho "$@" >> {log}\nexec {shutil.which("chmod")} "$@"\n')
    (bin_ / "chmod").chmod(0o755)
    env = os.environ | {"PATH": f"{bin_}:{os.environ['PATH']}", "PYTHONPATH": str(Path(__file__).resolve().parents[1])}
    subprocess.run([sys.executable, "-c", SCRIPT, str(tables)], env=env, cwd=tmp_path, check=True, timeout=240)
    asked = log.read_text().splitlines()
    assert not [x for x in asked if f"{tables}/rows-" in x]
    assert [x for x in asked if f"{tables}/plain" in x]  # other writers are left alone, and the log sees them
    modes = {kind: {stat.S_IMODE(f.stat().st_mode) for f in tables.glob(f"{kind}*/*") if f.is_file()} for kind in ("rows", "plain")}
    assert modes["rows"] == modes["plain"] and len(list(tables.glob("rows-*/part-*"))) == 8


MEDIA = """
import sys
from pyspark.sql import SparkSession
from maxentnet.llm import media

spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", f"file://{sys.argv[1]}").config("spark.sql.shuffle.partitions", "5").getOrCreate()
docs = spark.createDataFrame([(i, "a" * (i % 7)) for i in range(40)], "doc_id long, text string").repartition(4)
rows = media.media_columns(docs).collect()
assert sorted(r["doc_id"] for r in rows) == list(range(40)) and all(r["payload_bytes"] == 64 for r in rows)
spark.range(3).write.parquet(f"file://{sys.argv[1]}/plain")
"""


def test_media_start_no_command(tmp_path):
    bin_, log, tables = tmp_path / "bin", tmp_path / "log", tmp_path / "tables"
    bin_.mkdir()
    (bin_ / "chmod").write_text(f'#!/bin/sh\necho "$@" >> {log}\nexec {shutil.which("chmod")} "$@"\n')
    (bin_ / "chmod").chmod(0o755)
    env = os.environ | {"PATH": f"{bin_}:{os.environ['PATH']}", "PYTHONPATH": str(Path(__file__).resolve().parents[1])}
    subprocess.run([sys.executable, "-c", MEDIA, str(tables)], env=env, cwd=tmp_path, check=True, timeout=240)
    asked = log.read_text().splitlines()
    assert not [x for x in asked if f"{tables}/media-" in x]
    assert [x for x in asked if f"{tables}/plain" in x]
