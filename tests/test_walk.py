"""The walk over list pages against a loop, and the tallies of what it met."""

import random
from collections import Counter

import pytest

from threadlake.operators import walk as W
from threadlake.operators.pages import parse_list_pages

ROWS = "gallery_id string, page_no long, row_pos int, id long, error string, title string"


def plain_walk(pages, mark, start=1, top=999):
    """pages: page_no -> rows (id or None for an unreadable one), or an error text for the page."""
    out, i = [], start
    while i <= top:
        page = pages.get(i, [])
        if isinstance(page, str):
            return [(i, None, None, page)]
        if not page:
            break
        if not mark:
            return [(i, k, x, None if x else "bad") for k, x in enumerate(page)]
        good = [x for x in page if x]
        if not good:
            break
        out += [(i, k, x, None if x else "bad") for k, x in enumerate(page) if not x or x > mark]
        if good[-1] <= mark:
            break
        i += 1
    return out


def tables(spark, galleries):
    rows = [(g, p, None, None, page, "t") if isinstance(page, str) else (g, p, k, x, None if x else "bad", "t")
            for g, (pages, _) in galleries.items() for p, page in pages.items() for k, x in ([(0, 0)] if isinstance(page, str) else enumerate(page))]
    return spark.createDataFrame(rows, ROWS).repartition(4), spark.createDataFrame([(g, m) for g, (_, m) in galleries.items() if m != "none"], "gallery_id string, mark long")


def walked(spark, galleries, **how):
    rows, marks = tables(spark, galleries)
    got = sorted(((r.gallery_id, r.page_no, r.row_pos, r.id, r.error) for r in W.page_walk(rows, marks, **how).collect()), key=repr)
    want = [(g, *r) for g, (pages, m) in galleries.items() for r in plain_walk(pages, 0 if m == "none" else m, how.get("start_page", 1), how.get("max_page", 999))]
    assert got == sorted(want, key=repr)
    return got


def test_each_stop(spark):
    full = {1: [90, 80], 2: [70, None, 60], 3: [50, 40], 4: [30, 20]}
    walked(spark, {
        "mark in page 3": (full, 45), "mark below all": (full, 1), "mark above all": (full, 99), "mark is a row": (full, 60),
        "no mark": (full, "none"), "null mark": (full, None), "mark 0": (full, 0), "first page unreadable rows": ({1: [None, None]}, 0),
        "gap": ({1: [90], 3: [50]}, 1), "begins later": ({2: [70]}, 1), "first crawl, begins later": ({2: [70]}, 0),
        "no readable row": ({1: [90], 2: [None, None], 3: [50]}, 1), "last row unreadable": ({1: [90, None], 2: [20, None], 3: [10]}, 20),
        "pinned row at the end": ({1: [80, 70, 500], 2: [60, 50, 10]}, 65), "page error": ({1: [90], 2: "AdultPage", 3: [50]}, 1),
        "page error behind the mark": ({1: [90, 10], 2: "AdultPage"}, 15), "page error at once": ({1: "MinorGalleryClosed"}, "none"),
        "page error after no readable row": ({1: [None], 2: "AdultPage"}, 1),
    })


@pytest.mark.parametrize("seed", range(3))
def test_random_walks(spark, seed):
    rng = random.Random(seed)

    def page(p):
        if rng.random() < 0.05:
            return "AdultPage"
        return [None if rng.random() < 0.3 else 10_000 - p * 100 + rng.randrange(100) for _ in range(rng.randrange(6))]

    galleries = {f"g{i}": ({p: page(p) for p in range(1, rng.randrange(2, 14)) if rng.random() < 0.95}, rng.choice(["none", None, 0, *range(8_800, 10_000, 90)])) for i in range(60)}
    got = walked(spark, galleries)
    walked(spark, galleries, start_page=2, max_page=5)
    rows, marks = tables(spark, galleries)
    feeds = [(r[0], r[3], "body") for r in got if r[3] and r[3] % 3 == 0]
    bad = spark.createDataFrame(feeds + feeds[:2], "gallery_id string, document_id long, error string")
    crawled = spark.createDataFrame([(g, i % 3) for i, g in enumerate(galleries)], "gallery_id string, worker_part int")
    want = {part: Counter() for part in (0, 1, 2, None)}
    failed = {r[0] for r in got if r[2] is None}
    for i, g in enumerate(galleries):
        for part in (i % 3, None):
            want[part]["gallery_error" if g in failed else "gallery_success"] += 1
            for r in got:
                if r[0] == g and r[2] is not None:
                    if r[4]:
                        want[part]["document_error"] += 1
                    elif r[3] % 3 == 0:
                        want[part]["comment_error"] += 1
                    else:
                        want[part]["document_success"] += 1
                        want[part]["comment_success"] += 1
    out = W.level_tallies(W.outcomes(W.page_walk(rows, marks), bad), crawled).collect()
    assert {r.worker_part: {k: v for k, v in r.asDict().items() if k != "worker_part" and v} for r in out} == {p: dict(c) for p, c in want.items()}


def test_nothing_to_walk(spark):
    rows, marks = spark.createDataFrame([], ROWS), spark.createDataFrame([], "gallery_id string, mark long")
    assert W.page_walk(rows, marks).collect() == []
    crawled = spark.createDataFrame([("g", 1)], "gallery_id string, worker_part int")
    assert [tuple(r) for r in W.level_tallies(W.outcomes(W.page_walk(rows, marks)), crawled).orderBy("worker_part").collect()] == [(None, 1, 0, 0, 0, 0, 0), (1, 1, 0, 0, 0, 0, 0)]


def test_walk_has_one_exchange_of_rows(spark):
    rows, marks = tables(spark, {"g": ({1: [5, 4]}, 3)})
    p = W.page_walk(rows, marks)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in p and p.count("Exchange hashpartitioning(gallery_id") <= 2  # the rows' and the marks'


def test_tallies_of_parsed_pages_have_a_small_plan(spark):
    # ids that were read from a page by many steps: joining on them used to grow the plan until the driver's memory ended
    def row(n):
        return (f'<tr class="us-post"><td class="gall_num">{n}</td><td class="gall_tit"><a href="x">t</a></td><td class="gall_writer" data-nick="n"></td>'
                f'<td class="gall_date" title="2024-01-01 00:00:00"></td><td class="gall_count">1</td><td class="gall_recommend">1</td></tr>')

    pages = spark.createDataFrame([("g", 1, f"<table>{row(9)}{row(8)}{row('x')}</table>")], "gallery_id string, page_no long, html string")
    marks = spark.createDataFrame([("g", 5)], "gallery_id string, mark long")
    bad = spark.createDataFrame([("g", 8, "body")], "gallery_id string, document_id long, error string")
    crawled = spark.createDataFrame([("g", 1)], "gallery_id string, worker_part int")
    found = W.outcomes(W.page_walk(parse_list_pages(pages).select("gallery_id", "page_no", "row_pos", "id", "error"), marks), bad)
    assert len(found._jdf.queryExecution().optimizedPlan().toString()) < 20_000
    assert {tuple(r) for r in W.level_tallies(found, crawled).collect()} == {(1, 1, 0, 1, 1, 1, 1), (None, 1, 0, 1, 1, 1, 1)}
