"""Registered queries: dialog and corpus jobs (C1-C7) and their parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadlake.functions.text import media_token, squash_ws
from threadlake.operators import dialogs as D
from threadlake.plans.adapters import conv_documents
from threadlake.plans.catalog import register
from threadlake.plans.oracle import media, squash, with_views

TAB = "chr(9)"

_PAIR_BASE = """
FROM conv_comment
WHERE document_author <> author AND NOT starts_with(contents, '<div') AND contents IS NOT NULL
"""


def _pairs_sql(style: str, skip: bool = False) -> str:
    title = squash("title")
    comment = squash("contents")
    tok = media(comment, legacy=(style == "legacy"))
    line = {
        "tsv": f"'<gallery ' || gallery_id || '> ' || {title} || {TAB} || {{c}}",
        "parlai": f"'text:<gallery ' || gallery_id || '> ' || {title} || {TAB} || 'labels:' || {{c}} || {TAB} || 'episode_done:True'",
        "legacy": f"'text:' || gallery_id || '¶' || {title} || {TAB} || 'labels:' || {{c}} || {TAB} || 'episode:done'",
    }[style]
    if skip:
        return with_views(["conv_comment"], f"SELECT DISTINCT {line.format(c=comment)} AS line {_PAIR_BASE} AND NOT starts_with({comment}, '<')")
    return with_views(["conv_comment"], f"SELECT DISTINCT {line.format(c=tok)} AS line {_PAIR_BASE}")


def _dialog_rows_sql(style: str = "tsv", skip: bool = False, first_run: str = "merged") -> str:
    """CTE chain ending in ``t5`` (rows with is_root / dialog_id)."""
    w = "PARTITION BY gallery_id, document_id, root_id"
    order = "ORDER BY created_at NULLS FIRST, comment_id NULLS FIRST"
    contents = squash("contents")
    if skip:
        t2 = f"SELECT * FROM (SELECT gallery_id, document_id, document_author, root_id, comment_id, author, created_at, {contents} AS contents FROM t1 WHERE n > 1) WHERE NOT starts_with(contents, '<')"
    else:
        t2 = f"SELECT gallery_id, document_id, document_author, root_id, comment_id, author, created_at, {media(contents, legacy=(style == 'legacy'))} AS contents FROM t1 WHERE n > 1"
    run = "sum(chg) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    if first_run == "merged":
        run = f"COALESCE({run}, 0)"
    return f""",
t0 AS (SELECT * FROM conv_comment WHERE NOT starts_with(contents, '<div') AND contents IS NOT NULL),
t1 AS (SELECT *, count(*) OVER ({w}) AS n FROM t0),
t2 AS ({t2}),
t3 AS (SELECT *, (first_value(author) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) = author AS is_root
       FROM t2 WINDOW w AS ({w} {order})),
t4 AS (SELECT *, CAST(is_root <> lag(is_root) OVER (w) AS INTEGER) AS chg FROM t3 WINDOW w AS ({w} {order})),
t5 AS (SELECT *, CAST({run} AS BIGINT) AS dialog_id FROM t4 WINDOW w AS ({w} {order}))
"""


def _dialogs_sql(style: str = "tsv", skip: bool = False, first_run: str = "merged") -> str:
    prefix = {
        "tsv": "CASE WHEN is_root THEN '<gallery ' || gallery_id || '> ' ELSE '' END",
        "parlai": "CASE WHEN is_root THEN 'text:<gallery ' || gallery_id || '> ' ELSE 'labels:' END",
        "legacy": "CASE WHEN is_root THEN 'text:' ELSE 'labels:' END",
    }[style]
    suffix = {"tsv": "", "parlai": f" || {TAB} || 'episode_done:True'", "legacy": f" || {TAB} || 'episode:done'"}[style]
    body = f"""
SELECT DISTINCT line FROM (
  SELECT max(dialog_id) AS m, string_agg(contents, {TAB} ORDER BY dialog_id NULLS FIRST, contents){suffix} AS line
  FROM (
    SELECT gallery_id, document_id, root_id, dialog_id, is_root,
           {prefix} || string_agg(contents, '. ' ORDER BY created_at NULLS FIRST, comment_id NULLS FIRST) AS contents
    FROM t5 GROUP BY gallery_id, document_id, root_id, dialog_id, is_root) r
  GROUP BY gallery_id, document_id, root_id) th
WHERE m > 1
"""
    views = with_views(["conv_comment"], "")
    return views.rstrip() + _dialog_rows_sql(style, skip, first_run) + body


def _docs(spark, sf_dir):
    return conv_documents(spark, sf_dir, media=True)


@register("job_d2c_tsv", _pairs_sql("tsv"))
def job_d2c_tsv(spark, sf_dir):
    return D.pairs(_docs(spark, sf_dir), style="tsv")


@register("job_d2c_tsv_skip", _pairs_sql("tsv", skip=True))
def job_d2c_tsv_skip(spark, sf_dir):
    return D.pairs(_docs(spark, sf_dir), skip_non_text=True, style="tsv")


@register("job_c2c_tsv", _dialogs_sql("tsv"))
def job_c2c_tsv(spark, sf_dir):
    return D.dialogs(_docs(spark, sf_dir), style="tsv")


@register("job_c2c_tsv_skip", _dialogs_sql("tsv", skip=True))
def job_c2c_tsv_skip(spark, sf_dir):
    return D.dialogs(_docs(spark, sf_dir), skip_non_text=True, style="tsv")


@register("job_c2c_tsv_reference_runs", _dialogs_sql("tsv", first_run="reference"))
def job_c2c_tsv_reference_runs(spark, sf_dir):
    return D.dialogs(_docs(spark, sf_dir), first_run="reference", style="tsv")


@register("job_d2c_parlai", _pairs_sql("parlai"))
def job_d2c_parlai(spark, sf_dir):
    return D.pairs(_docs(spark, sf_dir), style="parlai")


@register("job_c2c_parlai", _dialogs_sql("parlai"))
def job_c2c_parlai(spark, sf_dir):
    return D.dialogs(_docs(spark, sf_dir), style="parlai")


def _union(a: str, b: str) -> str:
    return f"SELECT line FROM ({a}) x UNION ALL SELECT line FROM ({b}) y"


@register("job_conversation", _union(_pairs_sql("tsv"), _dialogs_sql("tsv")))
def job_conversation(spark, sf_dir):
    return D.conversation_corpus(_docs(spark, sf_dir), style="tsv")


@register("set_union_lines", _union(_pairs_sql("tsv"), _dialogs_sql("tsv")))
def set_union_lines(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return D.pairs(docs).union(D.dialogs(docs))


@register("job_parlai_legacy", _union(_pairs_sql("legacy"), _dialogs_sql("legacy")))
def job_parlai_legacy(spark, sf_dir):
    return D.conversation_corpus(_docs(spark, sf_dir), style="legacy")


# --------------------------------------------------------------------------
# building blocks of the jobs, each checked on its own
# --------------------------------------------------------------------------

def _comments(spark, sf_dir):
    return D.thread_comments(_docs(spark, sf_dir))


_CC = "SELECT {cols} FROM conv_comment {where}"


def _cc(cols: str, where: str = "") -> str:
    return with_views(["conv_comment"], _CC.format(cols=cols, where=where))


@register("prj_explode_comments", _cc("gallery_id, document_id, comment_id, contents"))
def prj_explode_comments(spark, sf_dir):
    e = D.explode_comments(_docs(spark, sf_dir))
    return e.select("gallery_id", "document_id", F.col("comment.id").alias("comment_id"),
                    F.col("comment.contents").alias("contents"))


@register("prj_nested_fields", _cc(
    "document_id, comment_id, author AS author_nickname, CAST(CASE WHEN comment_id = 1 THEN 0 ELSE 1 END AS BIGINT) AS depth, "
    "CASE WHEN starts_with(contents, '<img') THEN 'con' WHEN starts_with(contents, 'vr/') THEN 'voice' ELSE 'text' END AS kind, "
    "created_at"))
def prj_nested_fields(spark, sf_dir):
    e = D.explode_comments(_docs(spark, sf_dir))
    return e.select("document_id", F.col("comment.id").alias("comment_id"),
                    F.col("comment.author.nickname").alias("author_nickname"),
                    F.col("comment.depth").alias("depth"), F.col("comment.kind").alias("kind"),
                    F.col("comment.created_at").alias("created_at"))


@register("prj_root_id", _cc("document_id, comment_id, CAST(parent_id AS BIGINT) AS parent_id, CAST(root_id AS BIGINT) AS root_id"))
def prj_root_id(spark, sf_dir):
    e = D.explode_comments(_docs(spark, sf_dir))
    return e.select("document_id", F.col("comment.id").alias("comment_id"),
                    F.col("comment.parent_id").alias("parent_id"), D.root_id().alias("root_id"))


@register("flt_other_author", _cc("document_id, comment_id", "WHERE document_author <> author"))
def flt_other_author(spark, sf_dir):
    c = _comments(spark, sf_dir).withColumnRenamed("author", "comm_author")
    return D.other_authors(c).select("document_id", "comment_id")


@register("flt_ads", _cc("document_id, comment_id", "WHERE NOT starts_with(contents, '<div') AND contents IS NOT NULL"))
def flt_ads(spark, sf_dir):
    return D.drop_ads(_comments(spark, sf_dir), "contents").select("document_id", "comment_id")


@register("flt_non_text", _cc("document_id, comment_id", "WHERE NOT starts_with(contents, '<')"))
def flt_non_text(spark, sf_dir):
    return D.filter_non_text(_comments(spark, sf_dir), "contents").select("document_id", "comment_id")


@register("prj_media_token", _cc(f"document_id, comment_id, {media('contents')} AS token"))
def prj_media_token(spark, sf_dir):
    return _comments(spark, sf_dir).select("document_id", "comment_id", media_token("contents").alias("token"))


@register("prj_media_token_legacy", _cc(f"document_id, comment_id, {media('contents', legacy=True)} AS token"))
def prj_media_token_legacy(spark, sf_dir):
    return _comments(spark, sf_dir).select("document_id", "comment_id",
                                           media_token("contents", legacy=True).alias("token"))


@register("prj_squash_ws", _cc(f"document_id, comment_id, {squash('contents')} AS contents"))
def prj_squash_ws(spark, sf_dir):
    return _comments(spark, sf_dir).select("document_id", "comment_id", squash_ws("contents").alias("contents"))


@register("prj_gallery_tag", with_views(["conv_doc"],
          "SELECT document_id, '<gallery ' || gallery_id || '> ' || title AS line FROM conv_doc"))
def prj_gallery_tag(spark, sf_dir):
    from threadlake.functions.text import gallery_tag
    d = _docs(spark, sf_dir)
    return d.select(F.col("id").alias("document_id"), gallery_tag("gallery_id", "title").alias("line"))


@register("agg_distinct_lines", _cc(f"DISTINCT {media(squash('contents'))} AS line",
                                    "WHERE NOT starts_with(contents, '<div') AND contents IS NOT NULL"))
def agg_distinct_lines(spark, sf_dir):
    c = D.drop_ads(_comments(spark, sf_dir), "contents")
    return c.select(media_token(squash_ws("contents")).alias("line")).distinct()


def _rows_sql(cols: str, first_run: str = "merged", where: str = "") -> str:
    return (with_views(["conv_comment"], "").rstrip() + _dialog_rows_sql(first_run=first_run)
            + f"SELECT {cols} FROM t5 {where}")


def _runs(spark, sf_dir, first_run="merged"):
    return D.speaker_runs(_comments(spark, sf_dir), first_run=first_run)


@register("win_thread_size", with_views(["conv_comment"], """
SELECT document_id, root_id, comment_id, count(*) OVER (PARTITION BY gallery_id, document_id, root_id) AS dialog_size
FROM conv_comment WHERE NOT starts_with(contents, '<div') AND contents IS NOT NULL"""))
def win_thread_size(spark, sf_dir):
    from pyspark.sql import Window
    c = D.drop_ads(_comments(spark, sf_dir), "contents")
    w = Window.partitionBy(*D.THREAD_KEYS)
    return c.select("document_id", "root_id", "comment_id", F.count(F.lit(1)).over(w).alias("dialog_size"))


@register("win_root_author", _rows_sql("document_id, root_id, comment_id, is_root AS is_root_author"))
def win_root_author(spark, sf_dir):
    return _runs(spark, sf_dir).select("document_id", "root_id", "comment_id", "is_root_author")


@register("win_doc_author", _rows_sql("document_id, root_id, comment_id, author = document_author AS is_document_author"))
def win_doc_author(spark, sf_dir):
    return _runs(spark, sf_dir).select("document_id", "root_id", "comment_id", D.by_document_author().alias("is_document_author"))


@register("win_change_flag", _rows_sql("document_id, root_id, comment_id, chg AS change_flag"))
def win_change_flag(spark, sf_dir):
    return _runs(spark, sf_dir).select("document_id", "root_id", "comment_id", "change_flag")


@register("win_run_id", _rows_sql("document_id, root_id, comment_id, dialog_id", first_run="reference"))
def win_run_id(spark, sf_dir):
    return _runs(spark, sf_dir, "reference").select("document_id", "root_id", "comment_id", "dialog_id")


@register("dlg_runs", (with_views(["conv_comment"], "").rstrip() + _dialog_rows_sql() + """
SELECT document_id, root_id, dialog_id, is_root AS is_root_author,
       CASE WHEN is_root THEN '<gallery ' || gallery_id || '> ' ELSE '' END
       || string_agg(contents, '. ' ORDER BY created_at NULLS FIRST, comment_id NULLS FIRST) AS contents,
       min(created_at) AS created_at
FROM t5 GROUP BY gallery_id, document_id, root_id, dialog_id, is_root"""))
def dlg_runs(spark, sf_dir):
    return D.merge_runs(_runs(spark, sf_dir)).select("document_id", "root_id", "dialog_id", "is_root_author",
                                                      "contents", "created_at")


@register("dlg_threads", (with_views(["conv_comment"], "").rstrip() + _dialog_rows_sql() + f"""
SELECT * FROM (
  SELECT document_id, root_id, max(dialog_id) AS dialog_real_size,
         string_agg(contents, {TAB} ORDER BY dialog_id NULLS FIRST, contents) AS line
  FROM (SELECT gallery_id, document_id, root_id, dialog_id, is_root,
               CASE WHEN is_root THEN '<gallery ' || gallery_id || '> ' ELSE '' END
               || string_agg(contents, '. ' ORDER BY created_at NULLS FIRST, comment_id NULLS FIRST) AS contents
        FROM t5 GROUP BY gallery_id, document_id, root_id, dialog_id, is_root) r
  GROUP BY gallery_id, document_id, root_id) th WHERE dialog_real_size > 1"""))
def dlg_threads(spark, sf_dir):
    th = D.merge_threads(D.merge_runs(_runs(spark, sf_dir)))
    return th.select("document_id", "root_id", "dialog_real_size", "line")


@register("job_tokenizer", with_views(["conv_comment", "conv_doc"], f"""
SELECT '<gallery ' || gallery_id || '> ' || title AS text FROM conv_doc
UNION ALL
SELECT {media('contents')} AS text FROM conv_comment"""))
def job_tokenizer(spark, sf_dir):
    return D.tokenizer_corpus(_docs(spark, sf_dir))


@register("job_tokenizer_skip", with_views(["conv_comment", "conv_doc"], """
SELECT '<gallery ' || gallery_id || '> ' || title AS text FROM conv_doc
UNION ALL
SELECT contents AS text FROM conv_comment WHERE NOT starts_with(contents, '<') AND contents IS NOT NULL"""))
def job_tokenizer_skip(spark, sf_dir):
    return D.tokenizer_corpus(_docs(spark, sf_dir), skip_non_text=True)
