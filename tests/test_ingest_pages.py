import datetime as dt
import tempfile
import uuid

from pyspark.sql import functions as F

from threadlake.functions import html as H
from threadlake.functions.parse import parse_comment_time
from threadlake.operators import ingest as I
from threadlake.operators import pages as PG
from threadlake.sources import lake as L


def _tmp():
    return f"{tempfile.gettempdir()}/threadlake-test-{uuid.uuid4().hex}"


ROW = ('<tr class="ub-content us-post" data-no="{id}"><td class="gall_num">{num}</td>'
       '<td class="gall_tit ub-word"><a href="/v?no={id}"><em class="icon_img icon_pic"></em>{title}</a>'
       '<a class="reply_numbox"><span class="reply_num">[{reply}]</span></a></td>'
       '<td class="gall_writer ub-writer" data-nick="{nick}" data-uid="{uid}" data-ip="{ip}"></td>'
       '<td class="gall_date" title="{date}">01.02</td><td class="gall_count">{views}</td>'
       '<td class="gall_recommend">{likes}</td></tr>')


def test_list_page_rows_and_errors(spark):
    rows = [
        ROW.format(id=12, num="12", title="Tom &amp; Jerry", reply="3", nick="n1", uid="", ip="1.2",
                   date="2021-01-02 09:00:00", views="40", likes="5"),
        ROW.format(id=13, num="13", title="t", reply="3/1", nick="n2", uid="id2", ip="", date="2021-01-02 09:00:00",
                   views="4", likes="many"),
        ROW.format(id=14, num="14", title="t", reply="1", nick="n3", uid="", ip="", date="yesterday",
                   views="4", likes="1"),
    ]
    html = "<html><table><tbody>" + "".join(rows) + "</tbody></table></html>"
    adult = '<script type="text/javascript">location.replace("/error/adult/x");</script>'
    pages = spark.createDataFrame([("g", 1, html), ("g", 2, adult)], "gallery_id string, page_no long, html string")
    out = {(r.page_no, r.row_pos): r for r in PG.parse_list_pages(pages).collect()}
    first = out[(1, 0)]
    assert (first.id, first.title, first.author_ip, first.author_id, first.author_kind, first.comment_count,
            first.like_count, first.view_count, first.kind, first.is_recommend, first.created_at, first.error) == (
        12, "Tom & Jerry", "1.2", None, "dynamic", 3, 5, 40, "picture", False, dt.datetime(2021, 1, 2, 0, 0), None)
    assert out[(1, 1)].error == "NumberParse .us-post .gall_recommend" and out[(1, 1)].id is None
    assert out[(1, 2)].error == "DatetimeParse .us-post .gall_date@title"
    assert out[(2, None)].error == "AdultPage"


def test_list_rows_by_exact_class_quoting_and_references(spark):
    odd = ("<TR data-x=' class=\"us-post\" > ' Class = 'ub-content\tus-post'><td class=gall_num>5</td>"
           "<td class='gall_tit'><b>no link here</b><a href='?a=1&amp;b'>x &#60;&#x62;&gt; &eacute;&hellip; &copy 5 &nosuch; <!-- <a>no</a> --><i>in</i></a><table><tr><td>deep</td></tr></table></td>"
           "<td class='gall_subject'>s<br>t</td><td data-nick='a&quot;b' class='gall_writer' data-ip=1.2 data-uid></td>"
           "<td class='gall_date' title = '2021-01-02 09:00:00'></td><td class='gall_count'>7</td><td class='gall_recommend'>+8</td></TR>")
    decoys = ("<tr class='us-post-x'><td class='gall_num'>1</td></tr><!-- <tr class='us-post'></tr> --><script>var t=\"<tr class='us-post'>\";</script>"
              "<tr class='xus-post'></tr><tr title='class=us-post'></tr>")
    short = "<div class='us-post'><span class='gall_num'>6</span></div><p class='gall_tit'><a>outside of the row</a></p>"
    pages = spark.createDataFrame([("g", 1, decoys + odd + decoys + short), ("g", 2, decoys), ("g", 3, ""), ("g", 4, None)], "gallery_id string, page_no long, html string")
    out = {(r.page_no, r.row_pos): r for r in PG.parse_list_pages(pages).collect()}
    assert set(out) == {(1, 0), (1, 1)}
    r = out[1, 0]
    assert (r.id, r.title, r.subject, r.author_nickname, r.author_ip, r.author_id, r.author_kind, r.comment_count, r.like_count, r.view_count, r.created_at, r.error) == (
        5, "x <b> é… © 5 &nosuch; in", "st", 'a"b', "1.2", None, "dynamic", 0, 8, 7, dt.datetime(2021, 1, 2), None)
    assert out[1, 1].error == "Select .us-post .gall_tit"


def test_body_of_class_with_nested_void_and_open_elements(spark):
    cases = [
        ('t<div class="a  write_div b">1<div>2<br><img src=\'>\'>3</div><p>4<!-- </div> --><script>if(a<b)\'</div>\'</script></div>5',
         "1<div>2<br><img src='>'>3</div><p>4<!-- </div> --><script>if(a<b)'</div>'</script>"),
        ("<p class=write_div>x<b>y</p>z", "x<b>y"), ("<br class='write_div'>q", ""), ("<div class='write_div'>open<i>", "open<i>"),
        ("<DIV data-x=' class=\"write_div\" ' CLASS='no'>n</DIV><div\nclass = 'q\twrite_div'\n>ok</div>", "ok"), ("a < b <div class='write_div'>c < d</div>", "c < d"),
        ("<div class='write_div'>1</div><div class='write_div'>2</div>", "1"), ("<div class=write_div></div >x</div>", ""),
        ("<div class='write_div-x'>a</div>", None), ("<div title='write_div'>a</div>", None), ("<!-- <div class='write_div'> -->", None), ("", None), (None, None),
        ("<div class='write_div'>" + "<div>x</div>" * 20_000 + "</div>", "<div>x</div>" * 20_000),
    ]
    pages = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(cases)], "page_id long, html string")
    got = {r.page_id: (r.body, r.error) for r in PG.extract_body(pages).collect()}
    assert got == {i: (b, None if b is not None else "Select .write_div") for i, (_, b) in enumerate(cases)}


def test_references_as_the_standard_library_decodes_them(spark):
    import html

    cases = ["a &amp; b", "&lt;&#39;&#x41;&#65;&copy;&notit;&nosuch;&", "&amp", "&ampx", "&#0;&#xD800;&#x110000;&#99999999999;&#128;&#x9f;", "plain", "&NotEqualTilde;&hellip;",
             "&#x1F600;&#128512", "AT&T", "&#xZ;", "&;", "&eacute;&eacute é", "&#00000065;", ""]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, s string")
    assert {r.i: r.d for r in df.select("i", H.decode_entities("s").alias("d")).collect()} == {i: html.unescape(c) for i, c in enumerate(cases)}


def test_year_rollback(spark):
    df = spark.createDataFrame([("12.31 23:00:00",)], "s string")
    as_of = dt.datetime(2021, 1, 1, 3, 0)   # 12:00 KST on New Year's day
    plain = df.select(parse_comment_time("s", as_of)).first()[0]
    rolled = df.select(parse_comment_time("s", as_of, roll_back=True)).first()[0]
    assert plain == dt.datetime(2021, 12, 31, 14, 0) and rolled == dt.datetime(2020, 12, 31, 14, 0)


def test_bulk_cast_nested(spark):
    df = spark.createDataFrame(
        [("2021-01-01 00:00:00", [("2021-01-02 00:00:00", 1), ("bad", 2)])],
        "created_at string, comments array<struct<created_at:string, id:long>>")
    out = I.bulk_cast(df, "created_at", "timestamp_ntz").first()
    assert out.created_at == dt.datetime(2021, 1, 1)
    assert [c.created_at for c in out.comments] == [dt.datetime(2021, 1, 2), None]
    assert [c.id for c in out.comments] == [1, 2]


def test_nominal_times(spark):
    row = spark.range(1).select(*[c.alias(k) for k, c in I.nominal_time(dt.datetime(2021, 3, 1, 0, 30), "daily").items()]).first()
    assert tuple(row) == ("2021-02-28", "2021-02-27", "2021-02-28T00:00:00Z", "2021-02-27T00:00:00Z")
    row = spark.range(1).select(*[c.alias(k) for k, c in I.nominal_time(dt.datetime(2021, 3, 1, 0, 30), "hourly").items()]).first()
    assert tuple(row) == ("23", "2021-02-28", "2021-02-28T23:00:00Z", "2021-02-28T22:00:00Z")


def test_partition_read_prunes_and_backfill_replaces_only_its_dates(spark):
    ev = spark.createDataFrame([(i, dt.datetime(2021, 1, 1 + i % 3, i % 24), float(i)) for i in range(30)],
                               "event_id long, ts timestamp_ntz, value double")
    root = _tmp()
    L.write_lake_json(ev, root)
    # another day's files have no say in the schema that is inferred
    spark.createDataFrame([("x", 1)], "value string, later int").write.json(f"{root}/date=2021-01-09/hour=1")
    assert "later" not in L.read_partition(spark, root, "2021-01-02", hour=1).columns
    day = L.read_partition(spark, root, "2021-01-02", hour=1)
    assert "PartitionFilters: [isnotnull(date" in day._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.event_id for r in day.collect()) == sorted(i for i in range(30) if i % 3 == 1 and i % 24 == 1)
    daily = _tmp()
    L.write_lake_json(ev, daily, mode="overwrite", hourly=False)
    I.backfill(lambda d: d.withColumn("value", F.col("value") + 1000), ev, ["2021-01-02"], daily)
    back = spark.read.schema("event_id long, value double, date date").json(daily).collect()
    assert len(back) == 30
    assert all((r.value >= 1000) == (str(r.date) == "2021-01-02") for r in back)


def test_expired_directories_are_dropped_without_reading(spark):
    import os

    root = _tmp()
    for d in range(1, 11):
        os.makedirs(f"{root}/date=2021-01-{d:02d}/hour=3")
        with open(f"{root}/date=2021-01-{d:02d}/hour=3/part.json", "w") as f:
            f.write("not read")
    for other in ("date=2021-13-xx", "date=__HIVE_DEFAULT_PARTITION__", "_checkpoint", "hour=1"):
        os.makedirs(f"{root}/{other}")
    assert I.drop_expired(spark, root, dt.datetime(2021, 1, 11, 5), 7) == ["2021-01-01", "2021-01-02", "2021-01-03"]
    left = set(os.listdir(root))
    assert {f"date=2021-01-{d:02d}" for d in range(4, 11)} < left and len(left) == 11
    assert I.drop_expired(spark, root, dt.datetime(2021, 1, 11, 5), 7) == []


def test_list_pages_are_parsed_in_a_fixed_count_of_tasks(spark):
    import __spark_entry__ as E
    df = E.queries()["job_extract_list_pages"](spark, "/root/testdata/sf0.001")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert df.rdd.getNumPartitions() == n  # AQE would make one task of these few bytes


def test_classes_are_read_from_opening_tags_in_any_case(spark):
    from pyspark.sql import functions as F

    from threadlake.functions import html as H
    page = '<td CLASS="a b">x</td class="c"><p>class="d"<i id=1>'
    got = spark.range(1).select(H.class_lines(H.elements(F.lit(page))).alias("c")).first().c
    assert [x.split() for x in got.split("\n")] == [["a", "b"], [], [], []]


def test_list_pages_are_dealt_out_before_their_markup_is_made(spark):
    from threadlake.plans import adapters as A
    for pages in (A.v_list_page(spark, "/root/testdata/sf0.001"), A.v_walk_page(spark, "/root/testdata/sf0.001")):
        plan = pages._jdf.queryExecution().optimizedPlan().toString()
        dealt = plan.index("RepartitionByExpression [gallery_id")
        assert "us-post" in plan[:dealt] and "us-post" not in plan[dealt:]


def test_rows_begin_at_their_tags_and_classes_are_found_whole(spark):
    from pyspark.sql import functions as F

    from threadlake.functions import html as H
    page = 'a <p class="us-post x">1</p> us-post <i title="a < b>" CLASS=us-post>2</i><p class="us-posts">3'
    df = spark.createDataFrame([(page,), ("no row <",), ("",), (None,)], "page string").select(H.split_at_class("page", "us-post").alias("p"))
    assert [r.p for r in df.collect()] == [['<p class="us-post x">1</p> us-post ', '<i title="a < b>" CLASS=us-post>2</i><p class="us-posts">3'], [], [], None]
    lines = spark.createDataFrame([("  \n é a \n b a \n  ",), ("  ",), (None,)], "c string")
    assert [tuple(r) for r in lines.select(*(H.first_of_class("c", k) for k in ("a", "b", "é", "x"))).collect()] == [(2, 3, 2, 0), (0, 0, 0, 0), (0, 0, 0, 0)]
    assert spark.range(1).select(H.first_of_class(F.lit(" a "), "a")).first()[0] == 1
