"""The registered queries and the pipeline on a test table."""

import pytest

from tests.conftest import SF_SMALL
from threadlake.llm import queries


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_has_a_row_per_row(spark, name):
    df = queries.queries()[name](spark, SF_SMALL)
    source, key = {"op5": ("pages", "page_id"), "op11": ("embeddings", "vec_id"), "op12": ("documents", "phrase")}.get(name.split("_")[0], ("documents", "doc_id"))
    n = spark.read.parquet(f"{SF_SMALL}/{source}.parquet").count()
    assert df.count() == n or name.startswith(("op9_", "op12_"))
    assert key in df.columns


def test_pipeline_stages(spark):
    import corpus_pipeline as C
    from tests.llm import brute
    from threadlake.llm import mixing, toxicity
    from threadlake.llm.registry import table

    docs = table(spark, SF_SMALL, "documents")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    stages = dict(C.STAGES)
    assert [n for n, _ in C.STAGES] == ["toxicity", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights", "token-ID output"]

    def ids(df):
        assert df.columns == docs.columns
        return {r["doc_id"] for r in df.select("doc_id").collect()}

    toxic = {r["doc_id"] for r in toxicity.toxicity(docs, table(spark, SF_SMALL, "labels")).where("toxic").collect()}
    assert ids(stages["toxicity"](spark, docs, SF_SMALL)) == set(text) - toxic
    groups = brute.groups(sorted(text.items()))
    assert ids(stages["n-gram Jaccard join"](spark, docs, SF_SMALL)) == {c for _, _, c in groups}
    items = [(r["item_id"], r["text"]) for r in table(spark, SF_SMALL, "benchmark").collect()]
    bad = {r[0] for r in brute.contamination(sorted(text.items()), items) if r[-1]}
    assert ids(stages["benchmark decontamination"](spark, docs, SF_SMALL)) == set(text) - bad
    chosen = {r["doc_id"] for r in mixing.mix(docs).where("selected").collect()}
    assert ids(stages["mixing sources to target weights"](spark, docs, SF_SMALL)) == chosen
    out = C.run(spark, SF_SMALL)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and 0 < out.count() < len(text)
