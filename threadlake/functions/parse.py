"""Tolerant parsing of crawled text fields (times, counts, ids).

Under ANSI mode a bad cast raises; every parser here uses the ``try_``
forms or a pattern check so that one bad row never fails a job.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadlake.functions._util import as_col

# Fixed values that must equal the reference's behaviour.
KST = "Asia/Seoul"
LIST_TIME_FMT = "yyyy-MM-dd HH:mm:ss"      # list-page time (KST)
COMMENT_TIME_FMT = "yyyy.MM.dd HH:mm:ss"   # comment time (KST); may lack the year
U32_MAX = 4294967295
UINT_RE = r"^\+?[0-9]+$"


def _kst_to_utc(ts: Column) -> Column:
    return F.to_utc_timestamp(ts, KST).cast("timestamp_ntz")


def parse_kst(c, fmt: str = LIST_TIME_FMT) -> Column:
    """KST wall-clock text -> UTC timestamp (NULL when it does not parse)."""
    return _kst_to_utc(F.try_to_timestamp(F.trim(as_col(c)), F.lit(fmt)))


def parse_comment_time(c, as_of, roll_back: bool = False) -> Column:
    """Comment time; a year-less ``MM.dd HH:mm:ss`` takes the KST year of ``as_of``.

    ``as_of`` is a parameter (the crawl time) so results are repeatable.
    With ``roll_back`` a year-less time later than ``as_of`` moves back one
    year (a New Year crawl).  Unparseable or empty -> NULL.
    """
    s = as_col(c)
    as_of_c = as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp_ntz")
    year = F.year(F.from_utc_timestamp(as_of_c.cast("timestamp"), KST))
    # a text without four characters before its first dot has no year: parsing it would cost an exception
    full = F.when(F.instr(s, ".") > 4, F.try_to_timestamp(s, F.lit(COMMENT_TIME_FMT)))
    short = F.try_to_timestamp(F.concat(year.cast("string"), F.lit("."), s), F.lit(COMMENT_TIME_FMT))
    short_utc = _kst_to_utc(short)
    if roll_back:
        short_utc = F.when(short_utc > as_of_c, short_utc - F.expr("INTERVAL 1 YEAR")).otherwise(short_utc)
    return F.coalesce(_kst_to_utc(full), short_utc)


def _u32(s: Column) -> Column:
    v = F.when(s.rlike(UINT_RE), s.try_cast("decimal(20,0)"))
    return F.when(v <= F.lit(U32_MAX), v.cast("long"))


def bracket_int(c) -> Column:
    """Reply count text like ``[12]`` -> 12; missing or malformed -> 0."""
    s = F.regexp_replace(F.trim(as_col(c)), r"^[\[\]]+|[\[\]]+$", "")
    return F.coalesce(_u32(s), F.lit(0).cast("long"))


def strict_int(c) -> Column:
    """Unsigned 32-bit count; NULL marks a row error (see ``int_error``)."""
    return _u32(as_col(c))


def int_error(c, path: str) -> Column:
    """Error text for a value ``strict_int`` rejects, else NULL."""
    return F.when(strict_int(c).isNull(), F.lit(f"NumberParse {path}"))


def flex_id(c) -> Column:
    """An id given as a number or a numeric string -> BIGINT (NULL if neither)."""
    s = as_col(c).cast("string")
    return F.when(s.rlike(UINT_RE), s.try_cast("long"))
