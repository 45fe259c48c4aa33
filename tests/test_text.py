from pyspark.sql import functions as F

from threadlake.functions.text import gallery_tag, is_text, media_token, squash_ws


def _one(spark, col, values, schema="s string"):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in df.select(col).collect()]


def test_media_tokens(spark):
    vals = [
        '<img class="x" src="https://e.example/d.php?no=62b5" title="hi">',
        '<video data-src="https://e.example/d.php?no=77&x=1" title="yo">',
        '<img src="https://e.example/noquery.png">',
        "plain",
        None,
    ]
    assert _one(spark, media_token("s"), vals) == ["<dccon 62b5 hi>", "<dccon 77&x=1 yo>", "<dccon  >", "plain", None]


def test_media_tokens_legacy(spark):
    vals = ['<img src="https://e.example/d.php?no=62b5" title="hi">', "plain"]
    assert _one(spark, media_token("s", legacy=True), vals) == ["<dccon> 62b5 hi", "plain"]


def test_squash_keeps_edges(spark):
    assert _one(spark, squash_ws("s"), [" a \n\t b  ", "x"]) == [" a b ", "x"]


def test_gallery_tag_null_propagates(spark):
    df = spark.createDataFrame([("g1", "t"), ("g2", None)], "g string, t string")
    assert [r[0] for r in df.select(gallery_tag("g", "t")).collect()] == ["<gallery g1> t", None]


def test_non_text_filter_drops_null(spark):
    df = spark.createDataFrame([("<img>",), ("ok",), (None,)], "s string")
    assert [r[0] for r in df.filter(is_text("s")).collect()] == ["ok"]
