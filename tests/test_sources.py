"""Files, workloads, the cache, the command line and streams."""

import os
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cardinia import cli
from cardinia.catalogue import FAMILY, TWO_WAY, key
from cardinia.operators import sketches
from cardinia.plans.dataset import Column, Table
from cardinia.sources import scratch
from cardinia.sources import tables as sources
from cardinia.streaming.sketch_stream import streaming_sketch
from tests.oracle import SMALL

SPEC = Table("t", {"k": Column("int"), "at": Column("timestamp"), "s": Column("string")}, ("k",))


def test_csv_with_header(spark, tmp_path):
    (tmp_path / "t.csv").write_text('s,other,k,at\n"a\\"b",1,1,2010-01-01 10:00:00\nü,2,,broken\nx,3,notanumber,2010-01-01 10:00:00\n', encoding="utf-8")
    rows = sorted(sources.read_csv(spark, str(tmp_path / "t.csv"), SPEC).collect(), key=str)
    assert [c for c in rows[0].asDict()] == ["k", "at", "s"]
    assert [(r.k, str(r.at), r.s) for r in rows] == [(1, "2010-01-01 10:00:00", 'a"b'), (None, "None", "ü")]


def test_csv_without_header(spark, tmp_path):
    (tmp_path / "t.csv").write_text("9,q,1,2010-01-01\n")
    spec = Table("t", SPEC.columns, ("k",), fields=("other", "s", "k", "at"))
    (r,) = sources.read_csv(spark, str(tmp_path / "t.csv"), spec).collect()
    assert (r.k, r.s) == (1, "q")


def test_workload(spark, tmp_path):
    (tmp_path / "w.csv").write_text(f"{TWO_WAY}||3||12.5\nSELECT COUNT(*) FROM a x WHERE x.c = 'y';||4||7\n")
    rows = sources.read_workload(spark, str(tmp_path / "w.csv")).collect()
    assert [(r.parent, r.cardinality) for r in rows] == [(3, 12.5), (4, 7.0)] and rows[0].query == TWO_WAY


def test_cache(spark, tmp_path):
    path, built = str(tmp_path / "c"), []

    def build():
        built.append(1)
        return spark.range(5)

    assert sources.cached(spark, path, build).count() == 5
    assert sources.cached(spark, path, build, 5).count() == 5 and len(built) == 1
    sources.cached(spark, path, build, 6)
    assert len(built) == 2


def test_write_csv(spark, tmp_path):
    sources.write_csv(spark.range(3), str(tmp_path / "o"))
    assert spark.read.option("header", True).csv(str(tmp_path / "o")).count() == 3


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "w.csv").write_text(f"{TWO_WAY}||0||\n")
    arguments = ["--workload", str(tmp_path / "w.csv"), "--experiment", "retail", "--data", SMALL, "--format", "parquet", "--width", "512", "--exact_sketch"]
    cli.run(spark, [*arguments, "--writefile", str(tmp_path / "out")])
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 1
    for _ in range(2):  # learns, then finds what it kept
        cli.run(spark, [*arguments[:-1], "--pickle", str(tmp_path / "kept"), "--pessimistic"])
    (kept,) = (tmp_path / "kept").glob("orders-*")
    assert spark.read.parquet(str(kept)).count() == spark.read.parquet(f"{SMALL}/orders.parquet").count()
    cli.run(spark, [*arguments, "--find_keys"])
    assert "l_orderkey" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.run(spark, ["--method", "nothing", "--workload", "x"])


def test_filters_and_columns_reach_the_scan(spark):
    df = sources.read_parquet(spark, f"{SMALL}/lineitem.parquet", ["l_orderkey", "l_quantity"])
    s = sketches.sketch(df, (key("l_orderkey"),), FAMILY, "count-sketch", 2, 64, "l_quantity > 30")
    plan = s._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,30" in plan and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_stream_and_batch_agree(spark, tmp_path):
    orders = spark.read.parquet(f"{SMALL}/orders.parquet")
    orders.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(orders.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = streaming_sketch(stream, (key("o_custkey"),), FAMILY, 2, 32)
    query = out.writeStream.outputMode("complete").format("memory").queryName("sketched").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    batch = sketches.sketch(orders, (key("o_custkey"),), FAMILY, "count-sketch", 2, 32)
    assert sorted(spark.table("sketched").collect()) == sorted(batch.collect())


def test_windowed_stream(spark, tmp_path):
    events = spark.read.parquet(f"{SMALL}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    out = streaming_sketch(stream, (key("user_id"),), FAMILY, 1, 8, False, "ts", "30 days")
    query = out.writeStream.outputMode("update").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("windows").agg(F.sum("v")).first()[0] == events.count()


def _held(pid):
    """MB that a process has, without mapped files."""
    return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path(f"/proc/{pid}/smaps_rollup").read_text()))) / 1024


def test_writing_gives_back_what_the_driver_has_freed(spark, monkeypatch):
    own, jvm, given, real = os.getpid(), int(spark._jvm.java.lang.ProcessHandle.current().pid()), [], scratch.give_back

    def measured(session):  # around it alone: the heap may grow while a table is written
        before = _held(own), _held(jvm)
        real(session)
        given.append((before[0] - _held(own), before[1] - _held(jvm)))

    monkeypatch.setattr(scratch, "_PAUSE", 0.0)
    monkeypatch.setattr(scratch, "give_back", measured)
    scratch.discard(scratch.materialised(spark.range(1), "before"))
    # Blocks that stay in between keep the C library from giving back the others.
    blocks = [bytes(4000) for _ in range(50_000)]
    blocks = blocks[::50]
    deflaters = [spark._jvm.java.util.zip.Deflater() for _ in range(2000)]
    for q, x in enumerate(deflaters):
        if q % 20:
            x.end()
    scratch.discard(scratch.materialised(spark.range(1), "after"))
    assert min(given[1]) > 30
