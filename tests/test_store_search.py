import datetime as dt

import pytest
from pyspark.sql import functions as F

from threadlake.operators import search as S
from threadlake.operators import store as ST
from threadlake.operators import textindex as X

GAL = "id string, name string, kind string"
DOC = ("gallery_id string, id long, title string, author_nickname string, author_id string, author_ip string, "
       "created_at timestamp_ntz")
T = dt.datetime(2021, 1, 1)


def test_insert_absent_first_write_wins(spark):
    target = spark.createDataFrame([("g1", "old", "major")], GAL)
    batch = spark.createDataFrame([("g1", "new", "major", 1), ("g2", "b", "minor", 2), ("g2", "a", "minor", 1)],
                                  GAL + ", o int")
    out = sorted(tuple(r) for r in ST.insert_absent(target, batch, ["id"], ["o"]).collect())
    assert out == [("g1", "old", "major"), ("g2", "a", "minor")]


def _store(spark):
    g = spark.createDataFrame([("g1", "name1", "major"), ("g2", "name2", "minor")], GAL)
    d = spark.createDataFrame([
        ("g1", 1, "title one", "nick", None, "1.1", T),
        ("g1", 2, "title two", "nick", None, "1.1", T),
        ("g2", 3, "other", "nick", "id3", None, T + dt.timedelta(days=1)),
        ("g9", 4, "lost", "nick", None, None, T + dt.timedelta(days=2)),
    ], DOC)
    return d, g


def test_dispatch_rules(spark):
    d, g = _store(spark)
    with pytest.raises(ValueError):
        S.galleries(g)
    with pytest.raises(ValueError):
        S.galleries(g, id="g1", name_part="x")
    with pytest.raises(ValueError):
        S.documents(d, g, author_nickname="nick", author_ip="1.1")
    with pytest.raises(ValueError):
        S.documents(d, g)
    assert [r.id for r in S.galleries(g, name_part="ME2").collect()] == ["g2"]
    assert [r.id for r in S.galleries(g, name_part="%").collect()] == []


def test_keyset_pages(spark):
    d, g = _store(spark)
    page = S.documents(d, g, author_nickname="nick", last_created_at=T + dt.timedelta(days=5)).collect()
    assert [r.id for r in page] == [3, 2, 1]                 # g9 has no gallery: dropped by the join
    again = S.documents(d, g, author_nickname="nick", last_created_at=T).collect()
    assert [r.id for r in again] == [2, 1]                   # inclusive cursor repeats the boundary time
    nxt = S.documents(d, g, author_nickname="nick", last_created_at=T, exclusive_after_id=2).collect()
    assert [r.id for r in nxt] == [1]
    assert [r.gallery_name for r in page] == ["name2", "name1", "name1"]


def test_title_search_needs_every_gram(spark):
    d, g = _store(spark)
    p = X.build_postings(d)
    hits = S.documents(d, g, title="TWO", postings=p, last_created_at=T + dt.timedelta(days=5)).collect()
    assert [r.id for r in hits] == [2]
    assert S.documents(d, g, title="tw o", postings=p, last_created_at=T).count() == 0
    assert [r.id for r in X.search_title(p, d, g, "title", gallery_id="g1", last_created_at=T).collect()] == [2, 1]


def test_title_search_on_written_index_pushes_gram_filter(spark):
    import tempfile
    import uuid
    d, g = _store(spark)
    path = f"{tempfile.gettempdir()}/threadlake-index-{uuid.uuid4().hex}"
    X.write_postings(X.build_postings(d), path)
    idx = spark.read.parquet(path)
    hits = X.search_title(idx, d, g, "title", gallery_id="g1", last_created_at=T)
    assert [r.id for r in hits.collect()] == [2, 1]
    scans = [ln for ln in hits._jdf.queryExecution().executedPlan().toString().split("\n")
             if "FileScan parquet" in ln and "gram" in ln]
    assert scans and "PushedFilters: [" in scans[0] and "EqualTo(gram,title)" in scans[0]  # the longest gram holds all others


def test_store_table_has_bloom_filters_and_clustered_row_groups(spark):
    import glob
    import tempfile
    import uuid

    from threadlake.sources import lake as L

    n = 4000
    docs = spark.range(n).select(
        F.concat(F.lit("g"), (F.col("id") % 7).cast("string")).alias("gallery_id"), F.col("id"),
        F.concat(F.lit("10.0."), (F.col("id") % 500).cast("string")).alias("author_ip"),
        F.concat(F.lit("u"), (F.col("id") % 300).cast("string")).alias("author_id"),
        F.concat(F.lit("n"), (F.col("id") % 200).cast("string")).alias("author_nickname"),
        F.timestamp_seconds(F.lit(1_600_000_000) + F.col("id") * 60).cast("timestamp_ntz").alias("created_at"))
    path = f"{tempfile.gettempdir()}/threadlake-store-{uuid.uuid4().hex}"
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    old = spark.conf.get(key)
    spark.conf.set(key, "false")   # 4000 rows would coalesce into one file
    try:
        L.write_store_table(docs, path)
    finally:
        spark.conf.set(key, old)
    back = spark.read.parquet(path)
    assert back.count() == n
    assert sorted(r.id for r in back.filter("author_ip = '10.0.7'").collect()) == list(range(7, n, 500))
    # footer check: every file has a bloom filter on each lookup column and narrow gallery ranges
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    for f in glob.glob(f"{path}/*.parquet"):
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(
            jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(f), conf))
        try:
            for block in reader.getFooter().getBlocks():
                cols = {c.getPath().toDotString(): c for c in block.getColumns()}
                for c in L.STORE_LOOKUPS:
                    # a bloom filter, or a chunk whose pages are all dictionary-encoded
                    # (the reader then prunes the row group by its dictionary)
                    chunk = cols[c]
                    assert chunk.getBloomFilterOffset() > 0 or \
                        not chunk.getEncodingStats().hasNonDictionaryEncodedPages(), c
        finally:
            reader.close()
    # range partitioned on (gallery, time): files hold consecutive, non-overlapping gallery ranges
    spans = sorted((r.lo, r.hi) for r in back.groupBy(F.input_file_name()).agg(
        F.min("gallery_id").alias("lo"), F.max("gallery_id").alias("hi")).collect())
    assert len(spans) > 1 and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def _grams_of(spark, title, lower=True):
    from threadlake.functions.grams import ngrams
    return set(spark.range(1).select(ngrams(F.lit(title), lower=lower).alias("g")).first().g or [])


def test_gram_cover_stands_for_all_grams(spark, tmp_path):
    import random

    from threadlake.operators import textindex as X
    rng = random.Random(2)
    alphabet = "aab가나B @é.1"
    titles = [(f"g{i % 3}", i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 30)))) for i in range(300)]
    t = spark.createDataFrame(titles, "gallery_id string, id long, title string")
    X.write_postings(X.build_postings(t), str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    held = {(g, i): _h for (g, i, _), _h in zip(titles, [set(r.g) for r in t.select(X_ngrams("title").alias("g"), "id").orderBy("id").collect()])}
    queries = ["a", "가나", "@", "aab", titles[7][2], titles[8][2][:14], titles[10][2] + titles[11][2], "a@b", "zz"]
    for q in queries:
        own = _grams_of(spark, q)
        want = {k for k, grams in held.items() if own and own <= grams}
        assert {(r.gallery_id, r.doc_id) for r in X.match_all_grams(index, X.gram_cover(spark, q)).collect()} == want, q


def X_ngrams(c):
    from threadlake.functions.grams import ngrams
    return F.coalesce(ngrams(c), F.array().cast("array<string>"))


def test_title_search_looks_up_the_longest_grams_only(spark):
    from threadlake.operators import textindex as X
    from threadlake.plans import q_search as Q
    assert X.gram_cover(spark, "tion") == ["tion"] and X.gram_cover(spark, "ti@on") == ["tion"]
    assert X.gram_cover(spark, "Abcdefghijkl") == ["abcdefghij", "bcdefghijk", "cdefghijkl"]
    assert X.gram_cover(spark, "aaaaaaaaaaaa") == ["aaaaaaaaaa"] and X.gram_cover(spark, "@@") == [] and X.gram_cover(spark, "") == []
    import __spark_entry__ as E
    plan = E.queries()["search_title"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "EqualTo(gram,tion)" in plan
    assert Q.title_index(spark, "/root/testdata/sf0.001").inputFiles() == Q.title_index(spark, "/root/testdata/sf0.001").inputFiles()


def test_postings_of_a_document_are_made_without_a_grouping_of_tokens(spark):
    from threadlake.operators import textindex as X
    rows = [("g1", 1, "aAa b@c"), ("g1", 1, "a"), ("g2", 1, "@@"), ("g2", 2, None), (None, 3, "가 B"), ("g3", None, ""), ("g3", 4, "abcdefghijklmn\U0001f600a\0c")]
    t = spark.createDataFrame(rows, "gallery_id string, id long, title string")
    for lower in (True, False):
        want: dict = {}
        for g, d, title in rows:
            for i in range(len(title or "")):
                for j in range(i + 1, min(i + 10, len(title)) + 1):
                    gram = "".join(c for c in title[i:j] if c not in "@\0\U0001f600")
                    if gram:
                        want.setdefault((gram.lower() if lower else gram, g, d), []).append(i + 1)
        p = X.build_postings(t, lower=lower)
        assert {(r.gram, r.gallery_id, r.doc_id): (r.tf, r.positions) for r in p.collect()} == {k: (len(v), sorted(v)) for k, v in want.items()}
        plan = p._jdf.queryExecution().executedPlan().toString()
        groupings = [ln for ln in plan.split("\n") if "Aggregate(" in ln]
        assert groupings and all("gram" not in ln for ln in groupings)
