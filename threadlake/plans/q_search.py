"""Registered queries: search store, tokenizers and the title index."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from threadlake.functions import grams as G
from threadlake.functions.classify import author_label, doc_url
from threadlake.operators import search as S
from threadlake.operators import textindex as X
from threadlake.plans.adapters import v_document, v_gallery, v_title
from threadlake.plans.catalog import register
from threadlake.plans.oracle import with_views

# Search parameters of the registered queries (inputs, like a user's request).
NICK = "Customer#000000310"
IP = "10.0.7"
UID = "u12"
CURSOR = dt.datetime(1997, 6, 1)
CURSOR_SQL = "TIMESTAMP '1997-06-01 00:00:00'"
TITLE_Q = "tion"
LONG_Q = "and attion to thanedble"
TITLE_CURSOR = dt.datetime(2024, 1, 30)
TITLE_CURSOR_SQL = "TIMESTAMP '2024-01-30 00:00:00'"
TITLE_GALLERY = "blog.tionsh.example.net"

DOC_COLS = ("gallery_id, id, title, subject, author_nickname, author_id, author_ip, comment_count, "
            "like_count, view_count, kind, is_recommend, created_at")


def _store(spark, sf_dir):
    return v_document(spark, sf_dir), v_gallery(spark, sf_dir)


@register("gallery_by_id", with_views(["v_gallery"], "SELECT * FROM v_gallery WHERE id = 'g7'"))
def gallery_by_id(spark, sf_dir):
    return S.galleries(v_gallery(spark, sf_dir), id="g7")


@register("gallery_by_name_part", with_views(["v_gallery"],
          "SELECT * FROM v_gallery WHERE name ILIKE '%ion\\_1%' ESCAPE '\\' ORDER BY id LIMIT 30"))
def gallery_by_name_part(spark, sf_dir):
    return S.galleries(v_gallery(spark, sf_dir), name_part="ion_1")


@register("gallery_list", with_views(["v_gallery"], "SELECT * FROM v_gallery ORDER BY id LIMIT 30"))
def gallery_list(spark, sf_dir):
    return S.gallery_list(v_gallery(spark, sf_dir))


@register("join_doc_gallery", with_views(["v_document", "v_gallery"],
          f"SELECT d.*, g.name AS gallery_name FROM v_document d JOIN v_gallery g ON g.id = d.gallery_id"))
def join_doc_gallery(spark, sf_dir):
    d, g = _store(spark, sf_dir)
    return S.with_gallery(d, g)


def _author_sql(field: str, value: str, gallery: str | None = None) -> str:
    g = f" AND d.gallery_id = '{gallery}'" if gallery else ""
    return with_views(["v_document", "v_gallery"], f"""
SELECT d.*, g.name AS gallery_name FROM v_document d JOIN v_gallery g ON g.id = d.gallery_id
WHERE d.{field} = '{value}' AND d.created_at <= {CURSOR_SQL}{g}
ORDER BY d.created_at DESC, d.id DESC LIMIT 30""")


def _author_query(field: str, value: str, gallery: str | None = None):
    def q(spark, sf_dir):
        d, g = _store(spark, sf_dir)
        return S.documents(d, g, gallery_id=gallery, last_created_at=CURSOR, **{field: value})
    return q


for _name, _field, _value, _gal in [
    ("search_by_nickname", "author_nickname", NICK, None),
    ("search_by_ip", "author_ip", IP, None),
    ("search_by_id", "author_id", UID, None),
    ("search_gallery_nickname", "author_nickname", "Customer#000000087", "g7"),
    ("search_gallery_ip", "author_ip", IP, "g16"),
    ("search_gallery_id", "author_id", UID, "g13"),
]:
    register(_name, _author_sql(_field, _value, _gal))(_author_query(_field, _value, _gal))


@register("search_store_table", _author_sql("author_ip", IP))
def search_store_table(spark, sf_dir):
    """Author lookup on a store table written with bloom filters and (gallery, time) clustering."""
    from threadlake.plans.q_sources import scratch
    from threadlake.sources import lake as L
    d, g = _store(spark, sf_dir)
    path = scratch(spark, "store-document")
    L.write_store_table(d, path)
    return S.documents(spark.read.parquet(path), g, last_created_at=CURSOR, author_ip=IP)


@register("search_fast_fields", with_views(["v_document"], """
SELECT * FROM v_document WHERE comment_count >= 3 AND comment_count <= 5 AND like_count >= 40
  AND created_at >= TIMESTAMP '1995-01-01 00:00:00'"""))
def search_fast_fields(spark, sf_dir):
    return S.filter_fast(v_document(spark, sf_dir), min_comments=3, max_comments=5, min_likes=40,
                         since=dt.datetime(1995, 1, 1))


@register("prj_author_label", with_views(["v_document"], """
SELECT id, author_nickname || '(' || COALESCE(author_ip, '고') || ')' AS label,
  'https://gall.dcinside.com/' || gallery_id || '/' || CAST(id AS VARCHAR) AS url
FROM v_document"""))
def prj_author_label(spark, sf_dir):
    d = v_document(spark, sf_dir)
    return d.select("id", author_label("author_nickname", "author_ip").alias("label"),
                    doc_url("gallery_id", "id").alias("url"))


@register("fn_cat_and_time", with_views(["v_document"], """
SELECT id, CAST(CAST(h AS HUGEINT) * 4294967296 + e
            - CASE WHEN h >= 2147483648 THEN CAST('18446744073709551616' AS HUGEINT) ELSE 0 END AS BIGINT) AS cat_time
FROM (SELECT id, CAST(('0x' || substr(md5(gallery_id), 1, 8)) AS BIGINT) AS h,
             CAST(round_even(epoch(created_at), 0) AS BIGINT) AS e FROM v_document) x"""))
def fn_cat_and_time(spark, sf_dir):
    d = v_document(spark, sf_dir)
    return d.select("id", G.cat_and_time("gallery_id", "created_at").alias("cat_time"))


# ---------------------------------------------------------------- tokenizers

CLEAN = G.NGRAM_CLEAN_RE
VCLEAN = G.VGRAM_CLEAN_RE


def _tok_sql(src: str, lower: bool = True) -> str:
    g = f"regexp_replace(substr(title, pos, l), '{CLEAN}', '', 'g')"
    if lower:
        g = f"lower({g})"
    return f"""
SELECT gallery_id, doc_id, pos, gram FROM (
  SELECT gallery_id, doc_id, pos, {g} AS gram FROM (
    SELECT gallery_id, doc_id, title, pos, unnest(generate_series(1, least(10, length(title) - pos + 1))) AS l
    FROM (SELECT gallery_id, id AS doc_id, title, unnest(generate_series(1, length(title))) AS pos FROM {src}) a) b) c
WHERE length(gram) > 0"""


@register("tok_clean", with_views(["v_title"], f"SELECT id, regexp_replace(title, '{CLEAN}', '', 'g') AS cleaned FROM v_title"))
def tok_clean(spark, sf_dir):
    return v_title(spark, sf_dir).select("id", G.clean_chars("title").alias("cleaned"))


def _ngram_sql(lower: bool) -> str:
    return with_views(["v_title"], f"""
SELECT t.id, array_to_string(g.terms, ' ') AS terms, COALESCE(g.n, 0) AS n_terms
FROM v_title t LEFT JOIN (
  SELECT doc_id, list_sort(list(DISTINCT gram)) AS terms, count(DISTINCT gram) AS n FROM ({_tok_sql('v_title', lower)}) k GROUP BY doc_id
) g ON g.doc_id = t.id""")


def _ngram_query(lower: bool):
    def q(spark, sf_dir):
        t = v_title(spark, sf_dir).select("id", G.ngrams("title", lower=lower).alias("g"))
        return t.select("id", F.when(F.size("g") > 0, F.array_join("g", " ")).alias("terms"),
                        F.size("g").cast("long").alias("n_terms"))
    return q


register("tok_ngram", _ngram_sql(True))(_ngram_query(True))
register("tok_ngram_cased", _ngram_sql(False))(_ngram_query(False))


@register("tok_raw", with_views(["v_document"], "SELECT id, gallery_id AS term_gallery, author_nickname AS term_nickname, author_ip AS term_ip, author_id AS term_id FROM v_document"))
def tok_raw(spark, sf_dir):
    d = v_document(spark, sf_dir)
    return d.select("id", G.raw_token("gallery_id").alias("term_gallery"), G.raw_token("author_nickname").alias("term_nickname"),
                    G.raw_token("author_ip").alias("term_ip"), G.raw_token("author_id").alias("term_id"))


@register("tok_words", with_views(["v_title"], r"""
SELECT id, array_to_string(list_filter(regexp_split_to_array(lower(title), '[^\p{L}\p{N}]+'), lambda w: length(w) > 0), ' ') AS words
FROM v_title"""))
def tok_words(spark, sf_dir):
    return v_title(spark, sf_dir).select("id", F.array_join(G.words("title"), " ").alias("words"))


@register("fn_vgram", with_views(["v_title"], f"""
SELECT t.id, array_to_string(g.grams, ' ') AS grams FROM v_title t LEFT JOIN (
  SELECT id, list_sort(list(DISTINCT gram)) AS grams FROM (
    SELECT id, substr(w, pos, l) AS gram FROM (
      SELECT id, w, pos, unnest(generate_series(2, least(20, length(w) - pos + 1))) AS l FROM (
        SELECT id, w, unnest(generate_series(1, length(w))) AS pos FROM (
          SELECT id, unnest(string_split(regexp_replace(title, '{VCLEAN}', '', 'g'), ' ')) AS w FROM v_title) a) b) c) d
  GROUP BY id) g ON g.id = t.id"""))
def fn_vgram(spark, sf_dir):
    return v_title(spark, sf_dir).select("id", F.array_join(G.vgram("title"), " ").alias("grams"))


# ---------------------------------------------------------------- title index

@register("idx_postings", with_views(["v_title"], f"""
SELECT gram, gallery_id, doc_id, count(*) AS tf, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions
FROM ({_tok_sql('v_title')}) k GROUP BY gram, gallery_id, doc_id"""))
def idx_postings(spark, sf_dir):
    p = X.build_postings(v_title(spark, sf_dir))
    return p.select("gram", "gallery_id", "doc_id", "tf", F.array_join("positions", ",").alias("positions"))


def _title_search_sql(gallery: str | None, title: str = TITLE_Q) -> str:
    gf = f" AND t.gallery_id = '{gallery}'" if gallery else ""
    q_src = f"(SELECT '' AS gallery_id, 0 AS id, '{title}' AS title)"
    return with_views(["v_title"], f""",
q AS (SELECT DISTINCT gram FROM ({_tok_sql(q_src)}) z),
hits AS (SELECT gallery_id, doc_id FROM ({_tok_sql('v_title')}) k JOIN q USING (gram)
         GROUP BY gallery_id, doc_id HAVING count(DISTINCT gram) = (SELECT count(*) FROM q))
SELECT t.*, t.gallery_id AS gallery_name FROM v_title t JOIN hits h ON t.gallery_id = h.gallery_id AND t.id = h.doc_id
WHERE t.created_at <= {TITLE_CURSOR_SQL}{gf}
ORDER BY t.created_at DESC, t.id DESC LIMIT 100""").replace("\n,\nq AS", ",\nq AS").replace("WITH ", "WITH ", 1)


def _title_gallery(t):
    return t.select(F.col("gallery_id").alias("id"), F.col("gallery_id").alias("name"),
                    F.lit("major").alias("kind")).distinct()


_INDEXES: dict[tuple[str, str], str] = {}


def title_index(spark, sf_dir):
    """The persisted title index of a table folder: written at its first search in a session, read by all."""
    from threadlake.plans.q_sources import scratch
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INDEXES:
        path = scratch(spark, "title-index")
        X.write_postings(X.build_postings(v_title(spark, sf_dir)), path)
        _INDEXES[key] = path
    return spark.read.parquet(_INDEXES[key])


def _title_query(title: str, gallery: str | None):
    def q(spark, sf_dir):
        t = v_title(spark, sf_dir)
        return X.search_title(title_index(spark, sf_dir), t, _title_gallery(t), title, gallery_id=gallery, last_created_at=TITLE_CURSOR)
    return q


register("search_title", _title_search_sql(None))(_title_query(TITLE_Q, None))
register("search_gallery_title", _title_search_sql(TITLE_GALLERY))(_title_query(TITLE_Q, TITLE_GALLERY))
#: A query longer than the longest gram, so of several lists.
register("search_title_long", _title_search_sql(None, LONG_Q))(_title_query(LONG_Q, None))


@register("search_title_index", _title_search_sql(None))
def search_title_index(spark, sf_dir):
    """Index and search in one: the index is written anew and read with a pushed filter on its gram."""
    from threadlake.plans.q_sources import scratch
    t = v_title(spark, sf_dir)
    path = scratch(spark, "title-index")
    X.write_postings(X.build_postings(t), path)
    return X.search_title(spark.read.parquet(path), t, _title_gallery(t), TITLE_Q, last_created_at=TITLE_CURSOR)


@register("job_title_index", with_views(["v_title"], f"""
SELECT t.gallery_id, t.id AS doc_id, t.created_at, COALESCE(p.n_terms, 0) AS n_terms, COALESCE(p.n_tokens, 0) AS n_tokens
FROM v_title t LEFT JOIN (
  SELECT gallery_id, doc_id, count(DISTINCT gram) AS n_terms, count(*) AS n_tokens FROM ({_tok_sql('v_title')}) k
  GROUP BY gallery_id, doc_id) p ON p.gallery_id = t.gallery_id AND p.doc_id = t.id"""))
def job_title_index(spark, sf_dir):
    t = v_title(spark, sf_dir)
    return X.index_rows(t, X.build_postings(t))


@register("fn_sql_functions", with_views(["v_title"], f"""
SELECT t.id,
  CAST(CAST(CAST(('0x' || substr(md5(t.gallery_id), 1, 8)) AS BIGINT) AS HUGEINT) * 4294967296
       + CAST(round_even(epoch(t.created_at), 0) AS BIGINT)
       - CASE WHEN CAST(('0x' || substr(md5(t.gallery_id), 1, 8)) AS BIGINT) >= 2147483648
              THEN CAST('18446744073709551616' AS HUGEINT) ELSE 0 END AS BIGINT) AS cat_time,
  array_to_string(g.grams, ' ') AS grams
FROM v_title t LEFT JOIN (
  SELECT id, list_sort(list(DISTINCT gram)) AS grams FROM (
    SELECT id, substr(w, pos, l) AS gram FROM (
      SELECT id, w, pos, unnest(generate_series(2, least(20, length(w) - pos + 1))) AS l FROM (
        SELECT id, w, unnest(generate_series(1, length(w))) AS pos FROM (
          SELECT id, unnest(string_split(regexp_replace(title, '{VCLEAN}', '', 'g'), ' ')) AS w FROM v_title) a) b) c) d
  GROUP BY id) g ON g.id = t.id"""))
def fn_sql_functions(spark, sf_dir):
    """The store's SQL functions used from Spark SQL on a temporary view."""
    import uuid

    from threadlake.functions import sqlfuncs

    sqlfuncs.register(spark)
    view = f"v_title_{uuid.uuid4().hex[:8]}"
    v_title(spark, sf_dir).createOrReplaceTempView(view)
    return spark.sql(f"SELECT id, cat_and_time(gallery_id, CAST(created_at AS TIMESTAMP)) AS cat_time, "
                     f"array_join(vgram(title), ' ') AS grams FROM {view}")
