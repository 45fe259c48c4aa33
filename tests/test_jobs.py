import tempfile
import uuid

from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from threadlake.operators import dialogs as D
from threadlake.plans import jobs as J
from threadlake.plans.adapters import conv_documents


def _tmp():
    return f"{tempfile.gettempdir()}/threadlake-test-{uuid.uuid4().hex}"


def test_conversation_and_parlai_jobs(spark):
    src = _tmp()
    docs = conv_documents(spark, SF_SMALL)
    docs.write.orc(src)
    for job, style in ((J.conversation_dataset, "tsv"), (J.parlai_dataset, "parlai")):
        out = _tmp()
        job(spark, src, "orc", out, "TRUE")
        got = sorted(r.value for r in spark.read.text(out).collect())
        want = sorted(r.line for r in D.conversation_corpus(docs, True, style=style).collect())
        assert got == want and len(got) > 0
    out = _tmp()
    J.parlai_dataset(spark, src, "orc", out, "false", legacy=True)
    assert all(r.value.endswith("episode:done") for r in spark.read.text(out).collect())


def test_tokenizer_job_keeps_every_line(spark):
    src, out = _tmp(), _tmp()
    docs = conv_documents(spark, SF_SMALL)
    docs.write.orc(src)
    J.tokenizer_dataset(spark, src, "orc", out, "false")
    lines = spark.read.text(out).count()
    texts = D.tokenizer_corpus(docs).select(F.size(F.split("text", "\n")).alias("n")).agg(F.sum("n")).first()[0]
    assert lines == texts


def test_json_to_orc_and_backfill(spark):
    docs = conv_documents(spark, SF_SMALL).withColumn("created_at", F.lit("2024-01-01 00:00:00"))
    ref, js, orc = _tmp(), _tmp(), _tmp()
    conv_documents(spark, SF_SMALL).withColumn("created_at", F.lit("2024-01-01").cast("timestamp")).write.orc(ref)
    docs.write.json(js)
    J.json_to_orc(spark, js, orc, "created_at", ref)
    out = spark.read.orc(orc)
    assert dict(out.dtypes)["created_at"] == "timestamp"
    assert out.select(F.explode("comments.created_at")).schema[0].dataType.typeName() == "timestamp"
    root, oroot = _tmp(), _tmp()
    docs.withColumn("date", F.when(F.col("id") % 2 == 0, "2024-01-01").otherwise("2024-01-02")) \
        .write.partitionBy("date").json(root)
    J.backfill_json_to_orc(spark, root, oroot, ["2024-01-02"])
    back = spark.read.orc(oroot)
    assert [str(r.date) for r in back.select("date").distinct().collect()] == ["2024-01-02"]
    assert back.count() == docs.filter(F.col("id") % 2 == 1).count()
