"""HTML elements as columns: one tokenising pass, class selectors, balanced ends, text.

``elements`` cuts a page (or a part of one) into an array with one entry per
tag, each with the text that follows it.  An element's end is found by the
depth of its own name: opening tags count up, closing ones down, and it ends
where the sum is back at zero.  So nested elements, void elements and missing
closing tags of other names do no harm.  All of it are Spark's own array and
string functions; the arrays are only sliced, never built up item by item.
"""

from __future__ import annotations

import html.entities
import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadlake.functions._util import as_col

# Fixed values of the HTML standard: elements without an end, and elements whose contents are no markup.
VOID_ELEMENTS = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
RAW_ELEMENTS = ("script", "style")
# Fixed values of the HTML standard: characters that the numeric references 128 to 159 stand for (windows-1252).
NUMERIC_128 = "€\x81‚ƒ„…†‡ˆ‰Š‹Œ\x8dŽ\x8f\x90‘’“”•–—˜™š›œ\x9džŸ"

_IN_TAG = r"""(?:[^"'>]++|"[^"]*+"|'[^']*+')*+"""
_RAW = rf"(?i:{'|'.join(RAW_ELEMENTS)})"
_TAG = rf"(?:<!--(?:[^-]++|-(?!->))*+(?:-->|\z)|<{_RAW}(?=[\s/>]){_IN_TAG}>(?:[^<]++|<(?!/{_RAW}\b))*+(?:</{_RAW}[^>]*+>|\z)|</?[a-zA-Z]{_IN_TAG}>|<[!?][^>]*+>)"
_TOKEN = rf"(?:{_TAG}|<)[^<]*+|\A[^<]++"
_QUOTED_ANGLE = r"""<[a-zA-Z][^<>"']*+(?:"[^"<>]*+"[^<>"']*+|'[^'<>]*+'[^<>"']*+)*+(?:"[^"<>]*+[<>]|'[^'<>]*+[<>])"""
_NAME = r"^</?([a-zA-Z][^\s/>]*)"
# attributes before the one that is looked for: bare words, or quoted values as a whole
_BEFORE = r"""^<[a-zA-Z][^\s"'>/]*+(?:[^"'>\s]++|\s|"[^"]*+"|'[^']*+')*?[\s"'/]"""
# a value in either quoting or none; the look back tells which it is
_VALUE = r"""["']?+((?<=")[^"]*+|(?<=')[^']*+|(?<=[\s=])[^\s"'>]++)"""


def attribute(tag, name: str) -> Column:
    """Value of a tag's attribute as it stands there (either quoting or none); NULL without it, '' without a value.

    :func:`decode_entities` decodes its character references.
    """
    t = as_col(tag)
    value = F.nullif(F.regexp_extract(t, rf"{_BEFORE}(?i:{name})\s*+=\s*+{_VALUE}", 1), F.lit(""))
    empty = F.when(t.rlike(rf"{_BEFORE}(?i:{name})(?=[\s/>=])"), F.lit(""))
    # a text is lower-cased only if it doesn't show the name as it is mostly written
    return F.when(t.contains(name.lower()) | F.lower(t).contains(name.lower()), F.coalesce(value, empty))


def split_at_class(page, cls: str) -> Column:
    """The parts of a page that begin with an opening tag of the class, as an array; what stands before the first is left out."""
    value = rf"""(?:"(?:[^"]*\s)?{cls}(?=[\s"])|'(?:[^']*\s)?{cls}(?=[\s'])|{cls}(?=[\s>]))"""
    exact = rf"(?={_BEFORE[2:]}(?i:class)\s*+=\s*+{value})"
    # comments and scripts hold no elements
    p = F.regexp_replace(as_col(page), rf"<(?:!--(?:[^-]++|-(?!->))*+(?:-->|\z)|{_RAW}(?=[\s/>]){_IN_TAG}>(?:[^<]++|<(?!/{_RAW}\b))*+(?:</{_RAW}[^>]*+>|\z))", "")
    p = F.concat(F.lit(" "), p)
    # a tag without angle brackets in its quotes shows the class before its end: few tags need the exact look
    parts = F.when(p.rlike(_QUOTED_ANGLE), F.split(p, rf"<{exact}")).otherwise(F.split(p, rf"<(?=[a-zA-Z][^<>]*{cls}){exact}"))
    return F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: F.concat(F.lit("<"), x))


def elements(page) -> Column:
    """array<struct<raw, name, sign, classes>>: a page's tags in order, each with the text after it (``raw``).

    ``sign`` is 1 for an opening tag, -1 for a closing one, 0 for void
    elements, comments, scripts and text.  ``classes`` is an opening tag's class
    attribute.  The ``raw`` parts joined are the page.
    """
    def named(t: Column) -> Column:
        # closing tags have none; a text is lower-cased only if it doesn't show the word as it is mostly written
        has = ~t.startswith("</") & (t.contains("class") | F.lower(t).contains("class"))
        classes = F.when(has, F.regexp_extract(t, rf"{_BEFORE}(?i:class)\s*+=\s*+{_VALUE}", 1))
        return F.struct(t.alias("raw"), F.lower(F.regexp_extract(t, _NAME, 1)).alias("name"), classes.alias("classes"))

    def entry(e: Column) -> Column:
        sign = F.when(e["name"].isin("", *VOID_ELEMENTS, *RAW_ELEMENTS), 0).when(e["raw"].startswith("</"), -1).otherwise(1)
        return F.struct(e["raw"].alias("raw"), e["name"].alias("name"), sign.alias("sign"), e["classes"].alias("classes"))

    return F.transform(F.transform(F.regexp_extract_all(as_col(page), F.lit(_TOKEN), F.lit(0)), named), entry)


# Rows with few tags are read faster from texts with one line per element than from slices of the array: searching
# and cutting texts is generated code, while every slice copies the array's entries one by one.

def _lines(els, one) -> Column:
    return F.concat(F.lit(" "), F.array_join(F.transform(as_col(els), one), " \n "), F.lit(" "))


def class_lines(els) -> Column:
    """The classes of each element as a line of its own, each class between blanks."""
    return _lines(els, lambda e: F.coalesce(F.translate(e["classes"], "\t\n\f\r", "    "), F.lit("")))


def name_lines(els) -> Column:
    """A line per element: its name between blanks, a slash before it if it closes, none for void elements and the like."""
    return _lines(els, lambda e: F.when(e["sign"] == 1, e["name"]).when(e["sign"] == -1, F.concat(F.lit("/"), e["name"])).otherwise(""))


def text_lines(els) -> Column:
    """The text after each element's tag, between NUL characters (which HTML texts can't hold)."""
    return F.array_join(F.transform(as_col(els), lambda e: F.translate(trailing(e["raw"]), "\0", "�")), "\0")


def _line_at(lines: Column, at: Column) -> Column:
    """The line (from 1) of a place in lines."""
    return at - F.length(F.replace(F.substring(lines, F.lit(1), at - 1), F.lit("\n"), F.lit("")))


def first_of_class(lines, cls: str) -> Column:
    """Position (from 1) of the first element of the class, by the :func:`class_lines`; 0 without one."""
    lines = as_col(lines)
    before = F.substring_index(lines, f" {cls} ", 1)  # all of the lines without one; looked for once, as every use of it is unconditional
    line = F.octet_length(before) - F.octet_length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
    return F.coalesce((F.octet_length(before) < F.octet_length(lines)).cast("int") * line, F.lit(0))


def first_lines(lines, n: Column, sep: str = "\n") -> Column:
    """The first n lines."""
    return F.substring_index(as_col(lines), sep, n) if isinstance(n, int) else F.call_function("substring_index", as_col(lines), F.lit(sep), n)


def line_range(lines, after: Column, end: Column, sep: str = "\n") -> Column:
    """The lines from ``after`` + 1 up to ``end``."""
    return F.when(end > after, F.call_function("substring_index", first_lines(lines, end, sep), F.lit(sep), after - end)).otherwise("")


def first_of_name(names, name: str, after: Column, before: Column) -> Column:
    """Position of the first opening tag of a name between two positions (both left out), by the :func:`name_lines`; 0 without one."""
    inside = line_range(names, after, before - 1)
    at = F.instr(inside, f" {name} ")
    return F.when((after > 0) & (at > 0), after + _line_at(inside, at)).otherwise(0)


def line_name(names, at: Column) -> Column:
    """Name of the element at a position, by the :func:`name_lines`; '' for void elements."""
    return F.trim(line_range(names, at - 1, at))


def line_end(name, rest, els, n: Column, at: Column) -> Column:
    """:func:`end_of` the element at a position among the first n.

    ``name``: its :func:`line_name`; ``rest``: the :func:`name_lines` after it, up to n (columns of
    their own, as both are looked at more than once).  The array is gone
    through only if elements of one name are nested.
    """
    name, rest = as_col(name), as_col(rest)
    close, again = F.instr(rest, F.concat(F.lit(" /"), name, F.lit(" "))), F.instr(rest, F.concat(F.lit(" "), name, F.lit(" ")))
    return (F.when(name == "", at).when(F.startswith(rest, F.concat(F.lit(" /"), name, F.lit(" "))), at + 1).when(close == 0, n + 1).when((again == 0) | (again > close), at + _line_at(rest, close))
            .otherwise(F.least(end_of(els, at), n + 1)))


def line_text(texts, at: Column, end: Column) -> Column:
    """Text within an element as it stands there (see :func:`decode_entities`), by the :func:`text_lines`; NULL at position 0."""
    return F.when(at > 0, F.replace(line_range(texts, at - 1, end - 1, "\0"), F.lit("\0"), F.lit("")))


def end_of(els, at: Column) -> Column:
    """Position of the closing tag of the element at a position (the array's end plus one if there is none)."""
    els = as_col(els)
    name = F.try_element_at(els, at)["name"]
    own = F.slice(els, F.greatest(at, F.lit(1)), F.size(els))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("seen"), F.lit(0).alias("end"), name.alias("name"))

    def step(acc: Column, e: Column) -> Column:
        depth = acc["depth"] + F.when(e["name"] == acc["name"], e["sign"]).otherwise(0)
        done = (acc["end"] == 0) & (depth == 0)
        return F.struct(depth.alias("depth"), (acc["seen"] + 1).alias("seen"), F.when(done, acc["seen"]).otherwise(acc["end"]).alias("end"), acc["name"].alias("name"))

    # a void element ends where it begins; position 0 of the fold is the element's own tag
    found = F.aggregate(own, start, step, lambda acc: F.nullif(acc["end"], F.lit(0)))
    return F.when(F.try_element_at(els, at)["sign"] == 0, at).otherwise(F.coalesce(at + found, F.size(els) + 1))


def trailing(raw: Column) -> Column:
    """The text after a token's tag."""
    plain = (F.length(raw) - F.length(F.replace(raw, F.lit(">"), F.lit(""))) == 1) & ~raw.startswith("<!")
    return F.when(plain & raw.startswith("<"), F.substring_index(raw, ">", -1)).otherwise(F.regexp_replace(raw, rf"\A{_TAG}", ""))


def inner_html(els, at: Column, end: Column) -> Column:
    """Markup between the tags of an element."""
    els = as_col(els)
    rest = F.array_join(F.transform(F.slice(els, at + 1, F.greatest(end - at - 1, F.lit(0))), lambda e: e["raw"]), "")
    return F.when(end > at, F.concat(trailing(F.try_element_at(els, at)["raw"]), rest)).otherwise(F.lit(""))


# ------------------------------------------------------------------------------------------- character references

#: Named references, from the standard library's table of the HTML standard; those of old may lack the semicolon.
_NAMED = json.dumps(html.entities.html5)
_OLD = "|".join(sorted((re.escape(n) for n in html.entities.html5 if not n.endswith(";")), key=len, reverse=True))
_REFERENCE = rf"&#[xX][0-9a-fA-F]++;?|&#[0-9]++;?|&[A-Za-z][A-Za-z0-9]*+;|&(?:{_OLD})|[^&]++|&"


def _numeric(ref: Column) -> Column:
    """The character of a numeric reference; U+FFFD for those that are none."""
    digits = F.regexp_extract(ref, "^&#[xX]?([0-9a-fA-F]+)", 1)
    hexed = ref.rlike("^&#[xX]")
    short = F.length(F.regexp_replace(digits, "^0+", "")) <= 8
    code = F.when(short, F.when(hexed, F.conv(digits, 16, 10)).otherwise(F.regexp_extract(digits, "^[0-9]+$", 0)).try_cast("long"))
    good = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return F.when(code.between(128, 159), F.substring(F.lit(NUMERIC_128), code.cast("int") - 127, F.lit(1))).when(good, char).otherwise(F.lit("�"))


def decode_entities(text) -> Column:
    """Character references decoded: named ones (those of old without their semicolon too), decimal and hexadecimal ones.

    The table of names is part of the expression: decode several texts of a
    row as one array (``F.transform(F.array(...), decode_entities)``).
    """
    t = as_col(text)
    named = F.from_json(F.lit(_NAMED), "map<string,string>")

    def one(p: Column) -> Column:
        name = F.substring(p, F.lit(2), F.length(p))
        old = F.regexp_extract(name, rf"^(?:{_OLD})", 0)
        known = F.coalesce(F.try_element_at(named, name), F.concat(F.try_element_at(named, old), F.substring(name, F.length(old) + 1, F.length(name))))
        return F.when(p.rlike("^&#[xX]?[0-9a-fA-F]"), _numeric(p)).when(p.rlike("^&[A-Za-z]"), F.coalesce(known, p)).otherwise(p)

    return F.when(F.instr(t, "&") > 0, F.array_join(F.transform(F.regexp_extract_all(t, F.lit(_REFERENCE), F.lit(0)), one), "")).otherwise(t)
