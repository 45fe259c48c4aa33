import datetime as dt
import os
import tempfile
import uuid

import pytest

from pyspark.sql import functions as F

from threadlake.operators import crawlstate as C
from threadlake.streaming import streams as ST
from tests.test_crawlstate import REPORT, T0, state


def _tmp():
    return f"{tempfile.gettempdir()}/threadlake-test-{uuid.uuid4().hex}"


def _reports(spark):
    rows = [("g1", 0, T0 + dt.timedelta(minutes=i * 7), i, (i * 3) % 5, "AdultPage" if i == 4 else None, i)
            for i in range(1, 9)]
    rows += [("g2", 1, T0 + dt.timedelta(minutes=i * 11), 100 + i, i % 2, None, 50 + i) for i in range(1, 6)]
    rows += [("unknown", 1, T0, 1, 1, None, 90), ("g3", 1, None, 1, 1, None, 91)]
    return spark.createDataFrame(rows, REPORT)


def _state_rows(df):
    return {r.id: {k: round(v, 9) if isinstance(v, float) else v for k, v in r.asDict().items()} for r in df.collect()}


def _arrivals(spark, src, *parts):
    """Each part, and a run of the stream after it."""
    for i, part in enumerate(parts):
        part.write.parquet(f"{src}/a{i}")
        yield spark.readStream.schema(part.schema).option("recursiveFileLookup", "true").parquet(src)


def test_stream_state_equals_batch_fold(spark):
    s = state(spark, [{"id": "g1"}, {"id": "g2", "publish_duration_in_seconds": 30.0}, {"id": "g3"}, {"id": "g4", "visible": False}])
    reports = _reports(spark)
    src, root, ck = _tmp(), _tmp(), _tmp()
    late = F.col("at") >= F.lit(T0 + dt.timedelta(minutes=30)).cast("timestamp_ntz")
    for stream in _arrivals(spark, src, reports.where(~F.coalesce(late, F.lit(False))), reports.where(late)):
        ST.stream_state(stream, s, root, ck, available_now=True).awaitTermination()
    table = ST.StateTable(spark, root)
    assert sorted(table.versions()) == [0, 1, 2]
    assert _state_rows(table.read()) == _state_rows(C.fold_reports(s, reports)) and table.read().count() == 4
    assert _state_rows(table.read(0)) == _state_rows(s)


def test_stream_state_under_replay_and_broken_batches(spark):
    s = state(spark, [{"id": "g1"}, {"id": "g2"}, {"id": "g3"}])
    reports = _reports(spark)
    src, root, ck = _tmp(), _tmp(), _tmp()
    reports.write.parquet(f"{src}/a")
    stream = spark.readStream.schema(reports.schema).option("recursiveFileLookup", "true").parquet(src)
    calls = []

    def breaks(prev, batch):
        calls.append(1)
        if len(calls) == 1:
            raise RuntimeError("lost")
        return C.fold_reports(prev, batch)

    with pytest.raises(Exception):
        ST.stream_state(stream, s, root, ck, available_now=True, fold=breaks).awaitTermination()
    # half a version is left behind without its mark
    reports.limit(1).write.mode("overwrite").parquet(f"{root}/v=000000000001")
    ST.stream_state(stream, s, root, ck, available_now=True, fold=breaks).awaitTermination()
    want = _state_rows(C.fold_reports(s, reports))
    assert _state_rows(ST.StateTable(spark, root).read()) == want
    # the batch is run again although its version is committed (its offset was not)
    commit = f"{ck}/commits/0"
    assert os.path.exists(commit)
    os.rename(commit, f"{ck}/gone-0")
    if os.path.exists(f"{ck}/commits/.0.crc"):
        os.rename(f"{ck}/commits/.0.crc", f"{ck}/gone-0.crc")
    ST.stream_state(stream, s, root, ck, available_now=True, fold=breaks).awaitTermination()
    assert len(calls) == 2 and sorted(ST.StateTable(spark, root).versions()) == [0, 1]
    assert _state_rows(ST.StateTable(spark, root).read()) == want


def test_state_fold_has_no_python(spark):
    s = state(spark, [{"id": "g1"}])
    plan = C.fold_reports(s, _reports(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_old_versions_go(spark):
    table = ST.StateTable(spark, _tmp(), keep=2)
    for v in range(5):
        table.commit(v, spark.range(v), f"b{v}")
    assert table.versions() == {3: "b3", 4: "b4"} and table.read().count() == 4
    assert not os.path.exists(table._path(2))


NESTED = ("gallery_id string, id long, title string, subject string, gallery struct<id:string,name:string,kind:string>, author struct<nickname:string,id:string,ip:string>, "
          "comment_count long, like_count long, view_count long, kind string, is_recommend boolean, created_at timestamp_ntz, "
          "comments array<struct<id:long,author:struct<nickname:string,id:string,ip:string>,contents:string,created_at:timestamp_ntz>>")


def _nested(g, i, title, n, minutes=0):
    at = T0 + dt.timedelta(minutes=minutes)
    return (g, i, title, None, (g, f"{g} {title}", "major"), ("nick", "", "1.2"), n, 0, 0, "text", False, at,
            [(i * 100 + k, ("c", "u", ""), f"{title}-{k}", at) for k in range(n)] if n else None)


def _store(spark, root):
    read = lambda name, *cols: sorted(tuple(r) for r in spark.read.parquet(f"{root}/{name}").select(*cols).collect())
    return read("gallery", "id", "name"), read("document", "gallery_id", "id", "title", "author_id", "author_ip"), read("comment", "gallery_id", "document_id", "id", "contents", "author_id")


def test_store_stream_fills_three_tables_once(spark, monkeypatch):
    first = spark.createDataFrame([_nested("a", 1, "one", 2), _nested("a", 2, "two", 0), _nested("a", 1, "again", 2, 5)], NESTED)
    second = spark.createDataFrame([_nested("a", 1, "later", 3, 9), _nested("b", 1, "other", 1), _nested("a", 3, None, 1)], NESTED)
    src, root, ck = _tmp(), _tmp(), _tmp()
    arrivals = _arrivals(spark, src, first, second)
    ST.stream_store(next(arrivals), root, ck, available_now=True).awaitTermination()
    # a batch that breaks off after its first table, and is run again
    real, calls = ST.new_rows, []

    def breaks(target, batch, keys, order):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return real(target, batch, keys, order)

    monkeypatch.setattr(ST, "new_rows", breaks)
    stream = next(arrivals)
    with pytest.raises(Exception):
        ST.stream_store(stream, root, ck, available_now=True).awaitTermination()
    ST.stream_store(stream, root, ck, available_now=True).awaitTermination()
    assert len(calls) == 4  # the gallery table isn't written again
    gal, doc, com = _store(spark, root)
    assert [g for g, _ in gal] == ["a", "b"]
    assert doc == [("a", 1, "one", None, "1.2"), ("a", 2, "two", None, "1.2"), ("a", 3, "", None, "1.2"), ("b", 1, "other", None, "1.2")]
    assert com == [("a", 1, 100, "one-0", "u"), ("a", 1, 101, "one-1", "u"), ("a", 1, 102, "later-2", "u"), ("a", 3, 300, "None-0", "u"), ("b", 1, 100, "other-0", "u")]
    # a store that is there already, and a query that starts anew: every row is delivered again
    ST.stream_store(spark.readStream.schema(first.schema).option("recursiveFileLookup", "true").parquet(src), root, _tmp(), available_now=True).awaitTermination()
    assert _store(spark, root) == (gal, doc, com)


def test_upsert_replay_adds_nothing(spark):
    rows = [("g", 1, "first", 1), ("g", 1, "second", 2), ("g", 2, "x", 1)]
    df = spark.createDataFrame(rows, "gallery_id string, id long, title string, delivery int")
    src, target = _tmp(), _tmp()
    df.write.parquet(src)
    for _ in range(2):  # the second run uses a fresh checkpoint: every row is replayed
        stream = spark.readStream.schema(df.schema).parquet(src)
        q = ST.stream_upsert(stream, target, ["gallery_id", "id"], ["delivery"], _tmp(), available_now=True)
        q.awaitTermination()
        got = sorted((r.id, r.title) for r in spark.read.parquet(target).collect())
        assert got == [(1, "first"), (2, "x")]


def test_dedupe_stream(spark):
    df = spark.createDataFrame([(1, T0), (2, T0), (1, T0)], "event_id long, ts timestamp_ntz")
    src, out, ck = _tmp(), _tmp(), _tmp()
    df.write.parquet(src)
    def run():
        stream = spark.readStream.schema(df.schema).parquet(src)
        ST.dedupe(stream, ["event_id"], "ts", out, ck, available_now=True).awaitTermination()

    run()
    # after a restart: a first delivery that is days late, and a redelivery
    df.limit(0).unionByName(spark.createDataFrame([(3, T0 - dt.timedelta(days=9)), (1, T0)], df.schema)).write.mode("append").parquet(src)
    run()
    assert sorted(r.event_id for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_dedupe_writes_few_small_files(spark):
    df = spark.range(400).repartition(8).select(F.col("id").alias("event_id"), (F.lit(T0) + F.make_dt_interval((F.col("id") % 10).cast("int"))).cast("timestamp_ntz").alias("ts"))
    src, out, ck = _tmp(), _tmp(), _tmp()
    for stream in _arrivals(spark, src, df):
        ST.dedupe(stream, ["event_id"], "ts", out, ck, available_now=True).awaitTermination()
    for path in (out, f"{out}-keys"):
        sizes = [os.path.getsize(f"{d}/{f}") for d, _, files in os.walk(path) for f in files if f.endswith(".parquet")]
        assert len(sizes) <= 20 and max(sizes) < 100_000  # a file for each of 10 dates, its filter as large as its keys need
    assert spark.read.parquet(out).count() == 400


def test_store_stream_keeps_no_batch_in_memory(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    kept = []
    keep = DataFrame.persist
    monkeypatch.setattr(DataFrame, "persist", lambda self, *a: kept.append(1) or keep(self, *a))
    docs = spark.sql("SELECT named_struct('id', 'g', 'name', 'n', 'kind', 'major') AS gallery, 'g' AS gallery_id, id, 't' AS title, 's' AS subject, 'nick' AS author_nickname, 'u' AS author_id, '' AS author_ip, "
                     "1L AS comment_count, 1L AS like_count, 1L AS view_count, 'text' AS kind, false AS is_recommend, TIMESTAMP_NTZ '2024-01-01 00:00:00' AS created_at, "
                     "array(named_struct('id', id, 'contents', 'c', 'author', named_struct('nickname', 'n', 'id', 'u', 'ip', ''), 'created_at', TIMESTAMP_NTZ '2024-01-01 00:00:00')) AS comments FROM range(3)")
    src, root, ck = _tmp(), _tmp(), _tmp()
    for stream in _arrivals(spark, src, docs, docs):
        ST.stream_store(stream, root, ck, available_now=True).awaitTermination()
    assert not kept and [spark.read.parquet(f"{root}/{name}").count() for name in ("gallery", "document", "comment")] == [1, 3, 3]


def test_dedupe_without_times_and_keys(spark):
    rows = [(1, T0, "a"), (2, None, "b"), (None, T0, "c"), (None, None, "d"), (2, None, "b")]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, x string")
    src, out, ck = _tmp(), _tmp(), _tmp()
    for stream in _arrivals(spark, src, df, df, df.where("ts is null").unionByName(spark.createDataFrame([(3, None, "e")], df.schema))):
        ST.dedupe(stream, ["event_id"], "ts", out, ck, available_now=True).awaitTermination()
    read = lambda: sorted((tuple(r) for r in spark.read.schema(df.schema).parquet(out).select(*df.columns).collect()), key=repr)
    want = sorted([(1, T0, "a"), (2, None, "b"), (None, T0, "c"), (None, None, "d"), (3, None, "e")], key=repr)
    assert read() == want
    # the last batch is run again after its events were written and before its keys were
    os.rename(f"{ck}/commits/2", f"{ck}/gone-2")
    if os.path.exists(f"{ck}/commits/.2.crc"):
        os.rename(f"{ck}/commits/.2.crc", f"{ck}/gone-2.crc")
    stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").parquet(src)
    ST.dedupe(stream, ["event_id"], "ts", out, ck, available_now=True).awaitTermination()
    assert read() == want
    assert "x" not in spark.read.parquet(f"{out}-keys").columns


def test_partitioned_upsert_reads_only_touched_partitions(spark):
    rows = [(f"g{i % 5}", i, "t", 1) for i in range(50)]
    df = spark.createDataFrame(rows, "gallery_id string, id long, title string, delivery int")
    src, target = _tmp(), _tmp()
    df.write.parquet(src)
    for _ in range(2):  # the second run replays every row from a fresh checkpoint
        stream = spark.readStream.schema(df.schema).parquet(src)
        ST.stream_upsert(stream, target, ["gallery_id", "id"], ["delivery"], _tmp(), available_now=True,
                         partition_by=["gallery_id"]).awaitTermination()
        assert spark.read.parquet(target).count() == 50
    batch = spark.createDataFrame([("g1", 7, "t", 2)], df.schema)
    keys = ST.present_keys(batch, target, ["gallery_id", "id"], ["gallery_id"])
    assert sorted(r.id for r in keys.collect()) == list(range(1, 50, 5))
    # an unreadable table fails the batch instead of passing for an empty one
    bad = _tmp()
    with open(bad, "w") as f:
        f.write("not a table")
    with pytest.raises(Exception):
        ST.present_keys(batch, bad, ["gallery_id", "id"], ["gallery_id"]).collect()


def test_present_keys_reads_touched_partitions(spark):
    rows = [(f"g{i % 6}", i, "t", 1) for i in range(60)]
    df = spark.createDataFrame(rows, "gallery_id string, id long, title string, delivery int")
    target = _tmp()
    df.write.partitionBy("gallery_id").parquet(target)
    batch = spark.createDataFrame([("g1", 1, "t", 2), ("g2", 2, "t", 2), ("g3", 99, "t", 2)], df.schema)
    keys = ST.present_keys(batch, target, ["gallery_id", "id"], ["gallery_id"])
    assert {r.gallery_id for r in keys.collect()} == {"g1", "g2", "g3"} and keys.count() == 30
    new = ST.new_rows(keys, batch, ["gallery_id", "id"], ["delivery"]).collect()
    assert [(r.gallery_id, r.id) for r in new] == [("g3", 99)]


def test_numeric_looking_partitions_keep_their_type(spark):
    """A table that holds only gallery 123 doesn't turn the key into a number."""
    df = spark.createDataFrame([("123", 1, "t", 1)], "gallery_id string, id long, title string, delivery int")
    target = _tmp()
    df.write.partitionBy("gallery_id").parquet(target)
    batch = spark.createDataFrame([("abc", 1, "t", 2), ("123", 1, "t", 2)], df.schema)
    keys = ST.present_keys(batch, target, ["gallery_id", "id"], ["gallery_id"])
    assert [(r.gallery_id, r.id) for r in ST.new_rows(keys, batch, ["gallery_id", "id"], ["delivery"]).collect()] == [("abc", 1)]
