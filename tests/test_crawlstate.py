import datetime as dt

import pytest
from pyspark.sql import functions as F

from threadlake.operators import crawlstate as C

STATE = ("id string, name string, kind string, rank int, last_ranked timestamp_ntz, last_crawled_at timestamp_ntz, "
         "last_crawled_document_id long, visible boolean, last_error string, publish_duration_in_seconds double, "
         "last_published_at timestamp_ntz, registered_at timestamp_ntz")
REPORT = "id string, worker_part long, at timestamp_ntz, last_doc_id long, count long, error string, seq long"
T0 = dt.datetime(2021, 1, 1)


def state(spark, rows):
    base = dict(name="n", kind="major", rank=1, last_ranked=T0, last_crawled_at=None, last_crawled_document_id=None,
                visible=True, last_error=None, publish_duration_in_seconds=0.0, last_published_at=None,
                registered_at=T0)
    out = []
    for r in rows:
        d = dict(base, **r)
        out.append(tuple(d[k] for k in ["id", "name", "kind", "rank", "last_ranked", "last_crawled_at",
                                        "last_crawled_document_id", "visible", "last_error",
                                        "publish_duration_in_seconds", "last_published_at", "registered_at"]))
    return spark.createDataFrame(out, STATE)


def test_success_report_estimate(spark):
    s = state(spark, [{"id": "g1"}])
    r = spark.createDataFrame([("g1", 0, T0 + dt.timedelta(seconds=6000), 55, 10, None, 1)], REPORT)
    out = C.fold_reports(s, r).first()
    assert out.publish_duration_in_seconds == pytest.approx(60.0)
    assert out.last_published_at == T0 + dt.timedelta(seconds=6000)
    assert out.last_crawled_document_id == 55


def test_error_report_takes_caps_and_hides(spark):
    s = state(spark, [{"id": "g1", "publish_duration_in_seconds": 60.0}])
    r = spark.createDataFrame([("g1", 0, T0 + dt.timedelta(seconds=10), None, 0, "PageNotFound", 1)], REPORT)
    out = C.fold_reports(s, r).first()
    assert out.publish_duration_in_seconds == pytest.approx(0.9 * 60 + 0.0999 * 3600 + 0.0001 * 86400)
    assert out.visible is False and out.last_error == "PageNotFound"
    assert out.last_published_at is None


def test_unknown_reports_split(spark):
    s = state(spark, [{"id": "g1"}])
    r = spark.createDataFrame([("g1", 0, T0, 1, 1, None, 1), ("g9", 0, T0, 1, 1, None, 2)], REPORT)
    known, unknown = C.split_reports(r, s)
    assert [x.id for x in known.collect()] == ["g1"] and [x.id for x in unknown.collect()] == ["g9"]


def test_parts_are_disjoint_and_complete(spark):
    ids = spark.range(500).select(F.concat(F.lit("g"), F.col("id").cast("string")).alias("id"))
    parts = [set(r.id for r in ids.filter(C.part_of("id", 7) == p).collect()) for p in range(7)]
    assert sum(len(p) for p in parts) == 500 and len(set().union(*parts)) == 500


def test_due_list(spark):
    now = T0 + dt.timedelta(hours=1)
    s = state(spark, [
        {"id": "a", "publish_duration_in_seconds": 100.0, "last_published_at": T0},   # wait 1000 s <= 3600: due
        {"id": "b", "publish_duration_in_seconds": 1000.0, "last_published_at": T0},  # wait 10000 s: not due
        {"id": "c", "registered_at": None},                                          # no time: due
        {"id": "d", "visible": False},                                               # hidden
    ])
    assert sorted(r.id for r in C.due_galleries(s, now).collect()) == ["a", "c"]


def test_refresh_directory(spark):
    s = state(spark, [{"id": "g1", "publish_duration_in_seconds": 5.0, "last_published_at": T0,
                       "last_crawled_document_id": 9, "visible": False}])
    feed = "id string, name string, kind string, rank int, pos int"
    rt = spark.createDataFrame([("g1", "new", "major", 3, 0), ("g2", "two", "minor", 1, 1)], feed)
    wk = spark.createDataFrame([("g1", "x", "major", 9, 0), ("g3", "three", "major", 2, 1),
                                ("g2", "weekly two", "major", 5, 2)], feed)
    now = T0 + dt.timedelta(days=1)
    rows = C.refresh_directory(s, rt, wk, now).collect()
    out = {r.id: r for r in rows}
    assert len(rows) == 3 and sorted(out) == ["g1", "g2", "g3"]   # weekly never re-inserts a known id
    assert out["g2"].name == "two"
    g1 = out["g1"]
    assert (g1.name, g1.rank, g1.visible, g1.last_published_at, g1.publish_duration_in_seconds,
            g1.last_crawled_document_id, g1.last_ranked) == ("new", 3, True, None, None, 9, now)
    assert out["g2"].registered_at == now and out["g2"].publish_duration_in_seconds == 0.0
    assert out["g3"].name == "three"


def test_high_water(spark):
    docs = spark.createDataFrame([("g1", 3), ("g1", 9)], "gallery_id string, id long")
    marks = spark.createDataFrame([("g1", 5), ("g2", None)], "gallery_id string, mark long")
    out = {r.gallery_id: (r.high_water, r.n_rows) for r in C.high_water(docs, marks).collect()}
    assert out == {"g1": (9, 2), "g2": (None, 0)}


def test_histogram_is_cumulative(spark):
    df = spark.createDataFrame([(v,) for v in [0, 3, 7, 50, 20000]], "v long")
    h = {r.le: r.value for r in C.histogram(df, "v", C.DOC_COUNT_BUCKETS).collect()}
    assert h["0.0"] == 1 and h["5.0"] == 2 and h["10.0"] == 3 and h["100.0"] == 4 and h["10000.0"] == 4
    assert h["+Inf"] == 5 and h["_count"] == 5 and h["_sum"] == 20060
    vals = [h[str(float(e))] for e in C.DOC_COUNT_BUCKETS]
    assert vals == sorted(vals)


def test_parse_ranking(spark):
    bodies = spark.createDataFrame([
        (1, 'cb([{"id":"a","ko_name":"A","rank":"7"},{"id":"b","name":"B","rank":2,"kind":"Minor"}]);')],
        "feed int, body string")
    rows = sorted((r.id, r.name, r.kind, r.rank) for r in C.parse_ranking(bodies).collect())
    assert rows == [("a", "A", "major", 7), ("b", "B", "minor", 2)]


def _sequential_fold(d0, lp0, reg, reports):
    """Brute force: apply reports one by one in (at, seq) order."""
    k = 1.0 - C.W1 - C.W2
    d, lp = d0, lp0
    for at, seq, count, err in sorted(reports, key=lambda r: (r[0] is not None, r[0] or T0, r[1])):
        o = lp if lp is not None else reg
        c = 0 if err else count
        if at is None or o is None:
            term = 0.0
        elif c == 0:
            term = C.W1 * C.CAP1 + C.W2 * C.CAP2
        else:
            x = max(int((at - o).total_seconds()), 0) / c
            term = C.W1 * min(x, C.CAP1) + C.W2 * min(x, C.CAP2)
        d = k * d + term
        if not err and count > 0:
            lp = at
    return d, lp


def test_hot_gallery_fold_is_chunked_and_exact(spark):
    """One gallery holds most reports, over many day buckets: same result as a sequential fold."""
    import random
    rnd = random.Random(7)
    rows, seq = [], 0
    for g, n in (("hot", 600), ("g2", 5), ("g3", 1)):
        for _ in range(n):
            seq += 1
            at = None if rnd.random() < 0.02 else T0 + dt.timedelta(seconds=rnd.randrange(0, 10 * 86400))
            err = "Unknown" if rnd.random() < 0.1 else None
            rows.append((g, 0, at, seq, rnd.choice([0, 1, 3, 10]), err, seq))
    s = state(spark, [{"id": "hot", "publish_duration_in_seconds": 50.0},
                      {"id": "g2", "last_published_at": T0 - dt.timedelta(hours=2)}, {"id": "g3"}])
    r = spark.createDataFrame(rows, REPORT)
    got = {x.id: x for x in C.fold_reports(s, r).collect()}
    seed = {"hot": (50.0, None), "g2": (0.0, T0 - dt.timedelta(hours=2)), "g3": (0.0, None)}
    for g, (d0, lp0) in seed.items():
        want_d, want_lp = _sequential_fold(d0, lp0, T0, [(x[2], x[3], x[4], x[5]) for x in rows if x[0] == g])
        assert got[g].publish_duration_in_seconds == pytest.approx(want_d, rel=1e-12), g
        assert got[g].last_published_at == want_lp, g
    # the hot gallery's reports are ordered in (gallery, day) chunks, not as one window partition
    terms = C.report_terms(r, s)
    assert terms.filter("id = 'hot'").select("_age").distinct().count() == 600
    p = terms._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(id#" in p and "_b#" in p
