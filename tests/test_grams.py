import datetime as dt

from pyspark.sql import functions as F

from threadlake.functions import grams as G


def one(spark, expr, value, schema="s string"):
    return spark.createDataFrame([(value,)], schema).select(expr).first()[0]


def test_vgram(spark):
    assert one(spark, G.vgram("s"), "ab^c d") == ["ab", "abc", "bc"]
    assert one(spark, G.vgram("s"), "a b") is None
    # only the first disallowed character removed
    assert one(spark, G.vgram("s", first_only=True), "a^b^") == ["ab", "ab^", "b^"]


def test_ngrams(spark):
    assert one(spark, G.ngrams("s"), "Ab") == ["a", "ab", "b"]
    assert one(spark, G.ngrams("s", lower=False), "Ab") == ["A", "Ab", "b"]
    # the character filter applies per token: '%' vanishes, tokens left empty are dropped
    assert one(spark, G.ngrams("s", max_gram=2), "a%") == ["a"]
    toks = one(spark, G.ngram_tokens("s", max_gram=2), "abc")
    assert [(t.pos, t.gram) for t in toks] == [(1, "a"), (1, "ab"), (2, "b"), (2, "bc"), (3, "c")]


def test_words(spark):
    assert one(spark, G.words("s"), "Hello, World-2 ") == ["hello", "world", "2"]


def test_cat_and_time(spark):
    df = spark.createDataFrame([("programming", dt.datetime(2021, 1, 1))], "c string, t timestamp_ntz")
    assert df.select(G.cat_and_time("c", "t")).first()[0] == 9111855613510313472
