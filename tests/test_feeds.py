import datetime as dt
import json

from pyspark.sql import functions as F

from threadlake.operators import feeds as FD

AS_OF = dt.datetime(2021, 1, 21)

# Our own feed with the shape of a real comment page (ids, depths, users,
# both time forms and one ad row); the texts are invented.
ROWS = [
    dict(no="4649463", user_id="writer01", ip="", name="w", depth=0, memo="first!", reg_date="2020.12.31 16:44:47"),
    dict(no=4670004, user_id="", ip="1.2", name="a", depth=0, memo="hello there", reg_date="01.02 00:44:58"),
    dict(no="4670423", user_id="", ip="3.4", name="b", depth=0, memo="<img src='x'>", reg_date="01.02 01:45:52"),
    dict(no="4670742", user_id="", ip="5.6", name="c", depth=1, memo="vr/clip", reg_date="01.02 02:41:36"),
    dict(no="5038076", user_id="", ip="7.8", name="d", depth=0, memo="root two", reg_date="01.20 15:21:16"),
    dict(no="5038081", user_id="", ip="9.1", name="e", depth=1, memo="reply", reg_date="01.20 15:21:35"),
    dict(no=0, user_id="", ip="", name="", depth=0, memo="<div class='ad'>ad</div>", reg_date=""),
    dict(no="5038094", user_id="", ip="2.3", name="f", depth=0, memo="root three", reg_date="01.20 15:22:08"),
    dict(no="5038096", user_id="", ip="4.5", name="g", depth=1, memo="reply two", reg_date="01.20 15:22:15"),
]


def test_golden_feed(spark):
    body = json.dumps({"comments": ROWS, "pagination": "<em>1</em><a href='#'>next</a>"})
    feeds = spark.createDataFrame([("mg", 7, 1, body)], "gallery_id string, document_id long, page int, body string")
    out = FD.comment_rows(feeds, AS_OF).orderBy("pos").collect()
    first = out[0]
    assert (first.id, first.author_id, first.author_ip, first.user_kind, first.depth, first.kind, first.parent_id,
            first.created_at) == (4649463, "writer01", None, "static", 0, "text", None, dt.datetime(2020, 12, 31, 7, 44, 47))
    assert out[1].created_at == dt.datetime(2021, 1, 1, 15, 44, 58) and out[1].user_kind == "dynamic"
    assert [r.parent_id for r in out] == [None, None, None, 4670423, None, 5038076, 5038076, None, 5038094]
    assert [r.kind for r in out][2:4] == ["con", "voice"]
    assert out[6].user_kind == "unknown" and out[6].created_at is None
    assert {r.max_page for r in out} == {1}


def test_page_head_reply_is_orphan_and_pages_reverse(spark):
    p1 = json.dumps({"comments": [dict(no=1, user_id="u", ip="", name="n", depth=0, memo="r", reg_date="")],
                     "pagination": "<a>1</a><em>2</em>"})
    p2 = json.dumps({"comments": [dict(no=2, user_id="u", ip="", name="n", depth=1, memo="x", reg_date="")],
                     "pagination": "<em>2</em>"})
    nothing = json.dumps({"comments": [dict(no=3, user_id="u", ip="", name="n", depth=0, memo="y", reg_date="")]})
    feeds = spark.createDataFrame([("g", 1, 1, p1), ("g", 1, 2, p2), ("g", 2, 1, nothing)],
                                  "gallery_id string, document_id long, page int, body string")
    out = {r.id: r for r in FD.comment_rows(feeds, AS_OF).collect()}
    assert sorted(out) == [1, 2]             # a page without pagination has no comments
    assert out[2].parent_id is None           # parents restart on every page
    assert out[2].feed_order == 1 and out[1].feed_order == 2
    assert out[1].max_page == 2


def test_hot_document_feed_order_matches_row_number(spark):
    """One document with many pages holds most rows: the page-wise order equals a plain row_number."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    rows = [("g", 1, p, i) for p in range(1, 41) for i in range(0, 25 + p % 7)]
    rows += [("g", 2, p, i) for p in (1, 2) for i in range(3)]
    df = spark.createDataFrame(rows, "gallery_id string, document_id long, page int, pos int")
    got = FD.feed_order(df)
    want = df.withColumn("want", F.row_number().over(
        Window.partitionBy("gallery_id", "document_id").orderBy(F.col("page").desc(), "pos")))
    bad = got.join(want, ["gallery_id", "document_id", "page", "pos"]).filter("feed_order <> want")
    assert got.count() == len(rows) and bad.count() == 0
    # the rows are ranked per page; only the page counts cross pages
    p = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(gallery_id#" in p and "page#" in p


def body(*rows, **more):
    return json.dumps({"comments": list(rows)} | more)


def first(**change):
    return {k: v for k, v in (ROWS[0] | change).items() if v is not ...}


BODIES = [  # body, max_page, number of comments, error
    (json.dumps({"comments": ROWS, "pagination": "<em>1</em><a>4</a>"}), 4, len(ROWS), None),
    (body(pagination="<em>3</em>"), 3, 0, None),
    (json.dumps({"comments": None, "pagination": "<a>2</a>"}), 2, 0, None),
    (json.dumps({"pagination": "<a>5</a>"}), 5, 0, None),
    (json.dumps({"comments": ROWS, "pagination": None}), 0, 0, None),
    (json.dumps({"comments": ROWS}), 0, 0, None),
    (body(first(extra=[1], user_id=..., ip=..., reg_date=...), pagination=""), 0, 1, None),
    ("{}", 0, 0, None),
    ("<html>", None, 0, "body"), (None, None, 0, "body"), ("", None, 0, "body"), ("[]", None, 0, "body"), ("7", None, 0, "body"), ('{"comments":[', None, 0, "body"),
    (json.dumps({"comments": {"no": 1}, "pagination": ""}), None, 0, "comments"),
    (json.dumps({"comments": "x"}), None, 0, "comments"),
    (body(first(), 3, pagination=""), None, 0, "comments[1]"),
    (body(first(depth="deep"), pagination="<a>1</a>"), None, 0, "comments[0].depth"),
    (body(first(), first(), first(depth=-1), first(no="x")), None, 0, "comments[2].depth"),
    (body(first(depth=1.5)), None, 0, "comments[0].depth"),
    (body(first(no="12x")), None, 0, "comments[0].no"), (body(first(no=-3)), None, 0, "comments[0].no"), (body(first(no=None)), None, 0, "comments[0].no"),
    (body(first(no="9223372036854775808")), None, 0, "comments[0].no"), (body(first(no=2**70)), None, 0, "comments[0].no"),
    (body(first(no=..., name=...)), None, 0, "comments[0].no"),
    (body(first(name=...)), None, 0, "comments[0].name"), (body(first(name=None)), None, 0, "comments[0].name"),
    (body(first(memo=5)), None, 0, "comments[0].memo"), (body(first(user_id=None)), None, 0, "comments[0].user_id"),
    (body(first(ip=1)), None, 0, "comments[0].ip"), (body(first(reg_date=None)), None, 0, "comments[0].reg_date"), (body(first(comment_date=1)), None, 0, "comments[0].comment_date"),
    (body(first(), pagination=3), None, 0, "pagination"), (body(pagination=["<a>1</a>"]), None, 0, "pagination"),
]


def test_every_page_is_read_or_has_its_first_failing_field(spark):
    feeds = spark.createDataFrame([("mg", 1, i, b[0]) for i, b in enumerate(BODIES)], "gallery_id string, document_id long, page int, body string")
    got = {r.page: (r.max_page, r.error) for r in FD.page_limits(feeds).collect()}
    assert got == {i: (m, e) for i, (_, m, _, e) in enumerate(BODIES)}
    rows = FD.comment_rows(feeds, AS_OF).collect()
    for i, (_, m, n, e) in enumerate(BODIES):
        mine = [r for r in rows if r.page == i]
        if e:
            assert [(r.error, r.pos, r.id, r.user_kind, r.kind, r.feed_order, r.max_page) for r in mine] == [(e, None, None, None, None, None, None)]
        else:
            assert len(mine) == n and all(r.error is None and r.max_page == m for r in mine)
    assert {r.page: r.error for r in FD.feed_errors(feeds).collect()} == {i: e for i, (_, _, _, e) in enumerate(BODIES) if e}
    # broken and empty pages don't disturb the order of the others
    order = sorted((r for r in rows if not r.error), key=lambda r: r.feed_order)
    assert [r.feed_order for r in order] == list(range(1, len(order) + 1)) and [r.page for r in order] == sorted((r.page for r in order), reverse=True)
    assert FD.comment_rows(feeds.limit(0), AS_OF).collect() == []


def test_feed_is_scanned_and_parsed_once(spark, tmp_path):
    spark.createDataFrame([("mg", 1, i, b[0]) for i, b in enumerate(BODIES)], "gallery_id string, document_id long, page int, body string").write.parquet(f"{tmp_path}/feeds")
    df = FD.comment_rows(spark.read.parquet(f"{tmp_path}/feeds"), AS_OF)
    df.write.format("noop").mode("overwrite").save()
    p = df._jdf.queryExecution().executedPlan().toString()
    assert p.count("Scan parquet") == 1 and p.count("Exchange hashpartitioning") == 1 and "Join" not in p


def test_max_page_query_keeps_broken_pages(spark, monkeypatch):
    from threadlake.plans import q_feeds

    feeds = spark.createDataFrame([("mg", 1, i, b[0]) for i, b in enumerate(BODIES)], "gallery_id string, document_id long, page int, body string")
    monkeypatch.setattr(q_feeds, "v_feed", lambda *_: feeds)
    assert {r.page: r.max_page for r in q_feeds.agg_max_page(spark, "").collect()} == {i: b[1] for i, b in enumerate(BODIES)}


def test_usual_comments_are_seen_to_be_good(spark):
    odd = [dict(ROWS[0], more=1, other="x"), {k: v for k, v in ROWS[1].items() if k not in ("ip", "reg_date")}, dict(ROWS[1], comment_date="01.02 00:44:58")]
    bad = [dict(ROWS[0], no="12x"), dict(ROWS[0], no=-1), dict(ROWS[0], depth=-1), dict(ROWS[0], depth="0"), dict(ROWS[0], user_id=None), dict(ROWS[0], memo=3), dict(ROWS[0], no=1.5), {"no": 1}]
    rows = [(json.dumps(c), good) for x, good in ((ROWS + odd, True), (bad, False)) for c in x]
    df = spark.createDataFrame(rows, "body string, good boolean").select("good", F.parse_json("body").alias("c"))
    df = df.select("good", FD._comment_error(F.col("c")).isNull().alias("slow"), F.coalesce(FD._good_comment(F.col("c"), F.try_variant_get("c", "$", FD.COMMENT_TYPE)), F.lit(False)).alias("seen"))
    assert all(r.good == r.slow == r.seen for r in df.collect())
