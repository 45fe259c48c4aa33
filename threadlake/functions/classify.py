"""Classification and normalisation columns (kinds, states, error classes)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadlake.functions._util import as_col

# Fixed values that must equal the reference's behaviour.
# Enum spellings (lower-case, as stored in the search tables).
USER_KINDS = ("static", "dynamic", "unknown")
COMMENT_KINDS = ("text", "con", "voice")
DOCUMENT_KINDS = ("text", "picture", "video")
GALLERY_KINDS = ("major", "minor", "mini")
# Crawl error report classes, in declaration order.
ERROR_CLASSES = (
    "Unknown",
    "AdultPage",
    "MinorGalleryAccessNotAllowed",
    "MinorGalleryClosed",
    "MinorGalleryPromoted",
    "PageNotFound",
)
# Errors after which a gallery is hidden from the due list.
HIDING_ERRORS = ("PageNotFound", "MinorGalleryClosed", "MinorGalleryPromoted", "AdultPage")
# Page-state markers: page prefixes and substrings, tested in this order.
PAGE_ADULT_PREFIX = '<script type="text/javascript">location.replace("/error/adult'
PAGE_CLOSED_PREFIX = '<script type="text/javascript">alert("해당 마이너 갤러리는 매니저의 요청으로 폐쇄되었습니다.'
PAGE_VIOLATION_PREFIX = '<script type="text/javascript">alert("해당 마이너 갤러리는 운영원칙 위반'
PAGE_CLOSED_WORD = "폐쇄"
PAGE_PROMOTED_PREFIX = '<script type="text/javascript">location.replace("https://gall.dcinside.com/board/lists?'
PAGE_RESTRICTION_RE = r"""class\s*=\s*["'][^"']*\bmigall_state\b[^"']*restriction[^"']*["']|class\s*=\s*["'][^"']*restriction[^"']*\bmigall_state\b[^"']*["']"""
# Page states produced by ``page_state``; error pages map onto report classes.
PAGE_STATE_TO_ERROR = {
    "adult": "AdultPage",
    "closed": "MinorGalleryClosed",
    "access_not_allowed": "MinorGalleryAccessNotAllowed",
    "promoted": "MinorGalleryPromoted",
}


def blank_to_null(c) -> Column:
    """Empty string -> NULL (ids and ips)."""
    return F.nullif(as_col(c), F.lit(""))


def user_kind(user_id, ip) -> Column:
    """static when only an id is present, dynamic when only an ip, else unknown.

    Empty strings count as absent.
    """
    has_id = F.coalesce(as_col(user_id) != "", F.lit(False))
    has_ip = F.coalesce(as_col(ip) != "", F.lit(False))
    return (
        F.when(has_id & ~has_ip, "static")
        .when(~has_id & has_ip, "dynamic")
        .otherwise("unknown")
    )


def comment_kind(contents) -> Column:
    """con for ``<img``, voice for ``vr/``, else text (``<video`` counts as text here)."""
    c = as_col(contents)
    return F.when(c.startswith("<img"), "con").when(c.startswith("vr/"), "voice").otherwise("text")


def doc_kind(has_video, has_picture) -> Column:
    """Exactly one flag set -> that kind; both or none -> text."""
    v = F.coalesce(as_col(has_video).cast("boolean"), F.lit(False))
    p = F.coalesce(as_col(has_picture).cast("boolean"), F.lit(False))
    return F.when(v & ~p, "video").when(~v & p, "picture").otherwise("text")


def gallery_kind(c, strict: bool = True) -> Column:
    """major / minor / mini; missing -> major; anything else -> error (or NULL if not strict)."""
    c = as_col(c)
    bad = F.raise_error(F.concat(F.lit("unsupported gallery kind: "), c)) if strict else F.lit(None)
    return F.when(c.isNull(), "major").when(c.isin(*GALLERY_KINDS), c).otherwise(bad)


def page_state(html) -> Column:
    """Classify a crawled list page; the tests are ordered, the first match wins."""
    h = as_col(html)
    return (
        F.when(h.startswith(PAGE_ADULT_PREFIX), "adult")
        .when(h.startswith(PAGE_CLOSED_PREFIX), "closed")
        .when(h.startswith(PAGE_VIOLATION_PREFIX) & h.contains(PAGE_CLOSED_WORD), "closed")
        .when(h.startswith(PAGE_VIOLATION_PREFIX), "access_not_allowed")
        .when(h.startswith(PAGE_PROMOTED_PREFIX), "promoted")
        .when(h.contains("migall_state") & h.rlike(PAGE_RESTRICTION_RE), "access_not_allowed")
        .otherwise("ok")
    )


def error_class(err) -> Column:
    """Map a crawl failure name onto one of the six report classes."""
    e = as_col(err)
    named = F.when(e.isin(*ERROR_CLASSES), e)
    for state, cls in PAGE_STATE_TO_ERROR.items():
        named = named.when(e == state, cls)
    return named.when(e == "not_found", "PageNotFound").otherwise("Unknown")


def visible_after(err) -> Column:
    """A gallery stays visible unless the error hides it."""
    return ~as_col(err).isin(*HIDING_ERRORS)


def author_label(nickname, ip) -> Column:
    """``nick(ip)`` for ip users, ``nick(고)`` (fixed account) otherwise."""
    return F.concat(
        as_col(nickname), F.lit("("), F.coalesce(as_col(ip), F.lit("고")), F.lit(")")
    )


# Fixed value: the board host used for document links.
DOC_HOST = "https://gall.dcinside.com"


def doc_url(gallery_id, doc_id) -> Column:
    return F.concat(F.lit(DOC_HOST + "/"), as_col(gallery_id), F.lit("/"), as_col(doc_id).cast("string"))
