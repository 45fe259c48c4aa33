"""Column functions for comment / title text (all JVM-side built-ins)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadlake.functions._util import as_col

# Fixed values that must equal the reference's behaviour.
# Media id / title extraction patterns and the whitespace class.
VIDEO_ID_RE = r'data-src="[^?]*\?no=([^"]+)"'
IMAGE_ID_RE = r'src="[^?]*\?no=([^"]+)"'
TITLE_RE = r'title="([^"]*)"'
WS_RE = r"[\s\n\t]+"
AD_PREFIX = "<div"


def media_token(c, legacy: bool = False) -> Column:
    """Replace an emoticon/media tag by a short token, other text unchanged.

    ``<video ... data-src="...?no=ID" title="T">`` -> ``<dccon ID T>`` and
    ``<img ... src="...?no=ID" title="T">`` -> ``<dccon ID T>``.  The legacy
    form closes the bracket first: ``<dccon> ID T``.
    """
    c = as_col(c)

    def tok(id_re: str) -> Column:
        ident = F.regexp_extract(c, id_re, 1)
        title = F.regexp_extract(c, TITLE_RE, 1)
        if legacy:
            return F.concat(F.lit("<dccon> "), ident, F.lit(" "), title)
        return F.concat(F.lit("<dccon "), ident, F.lit(" "), title, F.lit(">"))

    return (
        F.when(c.startswith("<video"), tok(VIDEO_ID_RE))
        .when(c.startswith("<img"), tok(IMAGE_ID_RE))
        .otherwise(c)
    )


def squash_ws(c) -> Column:
    """Collapse every whitespace run to one space (no trim)."""
    return F.regexp_replace(as_col(c), WS_RE, " ")


def gallery_tag(gallery_id, text=None) -> Column:
    """``<gallery {id}> `` prefix, followed by ``text`` when given (NULL propagates)."""
    parts = [F.lit("<gallery "), as_col(gallery_id), F.lit("> ")]
    if text is not None:
        parts.append(as_col(text))
    return F.concat(*parts)


def is_text(c) -> Column:
    """Predicate of the non-text filter: keep rows not starting with ``<``.

    NULL stays NULL, so a ``filter`` drops it (three-valued logic).
    """
    return ~as_col(c).startswith("<")


def is_not_ad(c) -> Column:
    """Keep non-null contents that are not an ad block (``<div...``)."""
    c = as_col(c)
    return (~c.startswith(AD_PREFIX)) & c.isNotNull()


def tsv_pair(left, right) -> Column:
    return F.concat(as_col(left), F.lit("\t"), as_col(right))
