"""Reading by a text key, ingest that is taken up again, attributes as JSON."""

import random

import pytest
from pyspark.sql import functions as F

from clipcurate.operators import signals
from clipcurate.sources import bind, ingest, resume

DRIVER = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


def test_a_database_is_read_by_ranges_of_a_text_key(spark, tmp_path):
    """Eight ranges of about as many rows, none lost or doubled: keys with quotes, umlauts, one starting text, NULL."""
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    draw = random.Random(0)
    keys = [f"{draw.choice(['ab', 'ac', 'b', 'zz', 'é', 'o', ''])}{chr(39) if i % 7 == 0 else ''}{i}" for i in range(2000)]
    df = spark.createDataFrame([(k, i) for i, k in enumerate([*keys, "x", "x", "x"])], "episode_hash string, n int")
    df.write.option("createTableColumnTypes", "episode_hash VARCHAR(64)").jdbc(url, "EPISODES", properties={"driver": DRIVER})
    connection = spark._jvm.java.sql.DriverManager.getConnection(url)
    connection.createStatement().execute('UPDATE EPISODES SET "episode_hash" = NULL WHERE "n" >= 2000')
    connection.close()
    options = {"url": url, "driver": DRIVER}
    ranges = ingest.key_ranges(spark, "EPISODES", options, '"episode_hash"', 8, 3)
    read = ingest.read_catalog(spark, "EPISODES", options, '"episode_hash"', 8, 3)
    assert len(ranges) == read.rdd.getNumPartitions() == 8
    assert sorted(r["n"] for r in read.collect()) == list(range(2003))
    assert max(r["count"] for r in read.groupBy(F.spark_partition_id()).count().collect()) < 2 * 2003 / 8
    assert ingest.read_catalog(spark, "EPISODES", options).count() == 2003


class Stop(Exception):
    pass


def test_ingest_goes_on_where_it_stopped(spark, tmp_path):
    path = f"{tmp_path}/episodes"
    pulled = []

    def pull(batch, broken=("e3",)):
        own = [r["episode_hash"] for r in batch.collect()]
        pulled.append(own)
        log = [(e, "error" if e in broken else "ok", 3, 4, 3, 0, "gone" if e in broken else None) for e in own]
        frames = [(e, t) for e in own if e not in broken for t in range(3)]
        return spark.createDataFrame(frames, "episode_hash string, frame_idx int"), spark.createDataFrame(log, f"episode_hash string, {resume.LEDGER}")

    def stop(number):
        if number == 2:
            raise Stop

    catalog = spark.createDataFrame([(f"e{i}",) for i in range(12)], "episode_hash string")
    with pytest.raises(Stop):
        resume.ingest(spark, catalog, pull, path, batches=3, before_commit=stop)
    first = resume.ledger(spark, path)
    assert first.select("batch").distinct().count() == 1 and spark.read.parquet(f"{path}/frames").select("batch").distinct().count() == 2
    assert {r["episode_hash"] for r in resume.committed(spark, path).collect()} <= set(pulled[0])
    again = resume.ingest(spark, catalog, pull, path, batches=3)
    retried = {e for own in pulled[2:] for e in own}
    assert not retried & (set(pulled[0]) - {"e3"}) and retried >= set(pulled[1])
    frames = [(r["episode_hash"], r["frame_idx"]) for r in resume.committed(spark, path).collect()]
    assert sorted(frames) == sorted((f"e{i}", t) for i in range(12) if i != 3 for t in range(3))
    log = {r["episode_hash"]: r["status"] for r in resume.run_log(catalog, first, again).collect()}
    assert log["e3"] == "error" and all(log[e] == "cached" for e in pulled[0] if e != "e3") and set(log.values()) == {"ok", "cached", "error"}
    mended = resume.ingest(spark, catalog, lambda b: pull(b, ()), path, batches=3)
    assert pulled[-1] == ["e3"] and resume.committed(spark, path).count() == 36
    assert resume.ingest(spark, catalog, pull, path, batches=3).count() == mended.count()


def test_attributes_are_compared_as_json(spark):
    matrix = "[[133.0,0,320,9],[0,133.00,240,9],[0,0,1,9]]"
    rows = ['{"cam1":%s,"b":{"y":1,"x":2}}' % matrix, '{ "b": {"x":2, "y":1.0}, "cam1": %s }' % matrix, '{"cam1":[[133.01,0,320],[0,133,240],[0,0,1]]}', '{"cam1":[["133",0,320],[0,133,240],[0,0,1]]}', "broken", None, "null"]
    df = spark.createDataFrame([(r,) for r in rows], "j string")
    out = {r["value"]: r for r in ingest.attr_constancy(df, "j", n=9, expected=[[133, 0, 320], [0, 133, 240], [0, 0, 1]], leaf="$.cam1").collect()}
    assert sorted((r["episodes"], r["matches"]) for r in out.values()) == [(1, False), (1, False), (1, False), (2, True)] and not any(r["is_constant"] for r in out.values())
    leaf = ingest.attr_constancy(df.limit(2), "j", "$.b.x", expected=2.0).collect()
    assert [(r["value"], r["episodes"], r["is_constant"], r["matches"]) for r in leaf] == [("2", 2, True, True)]
    assert ingest.attr_constancy(df.limit(0), "j", expected=[1.0]).count() == 0


def _plan(df):
    return df._jdf.queryExecution().toString()


def test_frames_laid_out_by_episode_are_not_exchanged(spark, tmp_path):
    frames = bind.frames(spark, "/root/testdata/sf0.001")
    ingest.lay_out_frames(frames, "frames_laid_out", f"{tmp_path}/frames", buckets=4)
    try:
        own = ingest.read_frames(spark, spark.table("frames_laid_out"), frames.columns, "lab1")
        steps = signals.steps(signals.frame_scalars(own, bind.POINTS))
        assert "Exchange" not in _plan(steps) and "PartitionFilters: [isnotnull(lab" in _plan(steps) and "SelectedBucketsCount: 4 out of 4" in _plan(steps)
        assert "Exchange" in _plan(signals.steps(signals.frame_scalars(frames.where("lab = 'lab1'"), bind.POINTS)))
        assert own.count() == frames.where("lab = 'lab1'").count() > 0
        assert spark.table("frames_laid_out").exceptAll(frames.select(spark.table("frames_laid_out").columns)).count() == 0
    finally:
        spark.sql("DROP TABLE frames_laid_out")


def test_frames_are_made_after_they_are_dealt(spark, tmp_path):
    rows = [(e, t, float(e + t), f"lab{e % 2}") for e in range(20) for t in range(30)]
    lines = spark.createDataFrame(rows, "episode_hash long, frame_idx int, x double, lab string").orderBy("x")
    seen = {}

    def then(df):
        seen["dealt"] = "Exchange hashpartitioning(episode_hash" in _plan(df)
        return df.select("episode_hash", F.array("x", F.col("x") + 1).alias("left_ee"), "frame_idx", "lab")

    ingest.lay_out_frames(lines, "made_late", str(tmp_path / "late"), buckets=4, then=then)
    assert seen["dealt"]
    out = spark.table("made_late")
    assert {(r["episode_hash"], r["frame_idx"], *r["left_ee"], r["lab"]) for r in out.collect()} == {(e, t, x, x + 1, lab) for e, t, x, lab in rows} and out.count() == len(rows)
    for f in (tmp_path / "late").rglob("*.parquet"):
        own = [(r["episode_hash"], r["frame_idx"]) for r in spark.read.parquet(str(f)).collect()]
        assert own == sorted(own)
