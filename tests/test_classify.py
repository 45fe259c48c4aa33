import pytest
from pyspark.sql import functions as F

from threadlake.functions import classify as K
from threadlake.functions import parse as P


def col(spark, expr, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_user_kind(spark):
    rows = [("a", ""), ("", "1.2"), ("", ""), ("a", "1.2"), (None, "1.2")]
    assert col(spark, K.user_kind("i", "p"), rows, "i string, p string") == [
        "static", "dynamic", "unknown", "unknown", "dynamic"]


def test_doc_kind(spark):
    rows = [(True, False), (False, True), (True, True), (False, False)]
    assert col(spark, K.doc_kind("v", "p"), rows, "v boolean, p boolean") == ["video", "picture", "text", "text"]


def test_comment_kind(spark):
    rows = [("<img a>",), ("vr/1",), ("<video x>",), ("hi",)]
    assert col(spark, K.comment_kind("c"), rows, "c string") == ["con", "voice", "text", "text"]


def test_bracket_and_strict_ints(spark):
    rows = [("[12]",), ("[3/1]",), (None,), (" 7 ",), ("-1",), ("99999999999",)]
    assert col(spark, P.bracket_int("s"), rows, "s string") == [12, 0, 0, 7, 0, 0]
    assert col(spark, P.strict_int("s"), [("12",), (" 12",), ("x",), ("+3",)], "s string") == [12, None, None, 3]


def test_gallery_kind(spark):
    rows = [("major",), ("mini",), (None,), ("Minor",)]
    assert col(spark, K.gallery_kind("k", strict=False), rows, "k string") == ["major", "mini", "major", None]
    with pytest.raises(Exception):
        spark.createDataFrame([("weird",)], "k string").select(K.gallery_kind("k")).collect()


def test_page_states(spark):
    tail = '");</script><html></html>'
    pages = [
        K.PAGE_ADULT_PREFIX + tail,
        K.PAGE_CLOSED_PREFIX + tail,
        K.PAGE_VIOLATION_PREFIX + "으로 폐쇄" + tail,
        K.PAGE_VIOLATION_PREFIX + "로 접근 제한" + tail,
        K.PAGE_PROMOTED_PREFIX + "id=a" + tail,
        '<html><div class="migall_state restriction">x</div></html>',
        '<html><div class="migall_state">x</div></html>',
    ]
    assert col(spark, K.page_state("h"), [(p,) for p in pages], "h string") == [
        "adult", "closed", "closed", "access_not_allowed", "promoted", "access_not_allowed", "ok"]


def test_error_class_and_visibility(spark):
    rows = [("adult",), ("not_found",), ("timeout",), ("MinorGalleryPromoted",), ("MinorGalleryAccessNotAllowed",)]
    df = spark.createDataFrame(rows, "e string").select(K.error_class("e").alias("c"))
    out = df.select("c", K.visible_after("c").alias("v")).collect()
    assert [(r.c, r.v) for r in out] == [("AdultPage", False), ("PageNotFound", False), ("Unknown", True),
                                        ("MinorGalleryPromoted", False), ("MinorGalleryAccessNotAllowed", True)]


def test_times(spark):
    import datetime as dt
    rows = [("2020.12.31 16:44:47",), ("01.02 00:44:58",), ("",), ("garbage",)]
    got = col(spark, P.parse_comment_time("s", dt.datetime(2021, 1, 21)), rows, "s string")
    assert got == [dt.datetime(2020, 12, 31, 7, 44, 47), dt.datetime(2021, 1, 1, 15, 44, 58), None, None]
    assert col(spark, P.parse_kst("s"), [("2021-01-02 09:00:00",), ("x",)], "s string") == [
        dt.datetime(2021, 1, 2, 0, 0), None]


def test_flex_id(spark):
    assert col(spark, P.flex_id("s"), [("12",), ("+5",), ("x1",), (None,)], "s string") == [12, 5, None, None]
