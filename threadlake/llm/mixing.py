"""Mixing sources to target weights by iterative proportional fitting.

Token counts per cell (source x language x topic) are raked until they meet the
target share of every marginal.  A cell's factor, scaled so that the largest is
1, is the probability with which its documents are sampled: the expected tokens
of the sample then stand in the target shares.  Up to MAX_CELLS cells are raked
on the driver, one number each; more are raked as a table, by the same rounds.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlake.llm.scratch import Scratch

#: Cells that the driver rakes; more stay in a table.
MAX_CELLS = 200_000
#: Cells that are attached by broadcast; more are joined by shuffle.
BROADCAST_CELLS = 20_000
MARGINALS = ["source", "lang", "topic"]
#: Target shares of the query: tokens to this power, per marginal (1 keeps the shares, 0 makes them equal).
TEMPER = {"source": 0.7, "lang": 0.7, "topic": 0.9}


def n_tokens(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def topic(text: Column) -> Column:
    """A coarse topic from what a text contains: marked-up lists, licence lines, contact data or prose."""
    t = F.coalesce(text, F.lit(""))
    return (F.when(t.contains("|") | t.contains("###") | t.contains("%%%"), "markup")
            .when(t.contains("icense") | t.contains("ights reserved"), "legal")
            .when(t.contains("@") | t.contains("http"), "contact").otherwise("prose"))


def rake(tokens: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray], tol: float = 1e-10, steps: int = 2000) -> np.ndarray:
    """Factors per cell for which sum(tokens * factor) has the target share in every category of every marginal.

    Categories without tokens are left out and the shares scaled up to one.
    Where targets contradict each other (cells that could bridge them are
    empty) the last fit after ``steps`` rounds is returned, with a warning.
    """
    f = np.ones(len(tokens))
    if not len(tokens) or not tokens.sum():
        return f
    want = []
    for code, t in zip(codes, targets, strict=True):
        t = np.where(np.bincount(code, tokens, len(t)) > 0, t, 0.0)
        want.append(t / t.sum() if t.sum() else t)
    w = tokens / tokens.sum()
    for _ in range(steps):
        worst = 0.0
        for code, t in zip(codes, want, strict=True):
            have = np.bincount(code, w * f, len(t))
            r = np.divide(t, have, out=np.zeros_like(t), where=have > 0)
            worst = max(worst, float(np.abs(have - t).max()))
            f = f * r[code]
        if worst < tol:
            break
    else:
        _not_met(worst, steps)
    return f


def _not_met(worst: float, steps: int) -> None:
    warnings.warn(f"raking: a share is still {worst:.2g} off its target after {steps} rounds", RuntimeWarning, stacklevel=3)


def rake_table(cells: DataFrame, temper: dict[str, float], targets: dict[str, dict[str, float]], scratch: Scratch, tol: float = 1e-10, steps: int = 200) -> DataFrame:
    """:func:`rake` for cells (source, lang, topic, tokens) that stay a table, with a column ``f``; each round is written."""
    total = float(cells.agg(F.sum("tokens").alias("n")).first()["n"] or 0)
    x = cells.withColumn("f", F.lit(1.0))
    if not total:
        return x
    want = {}
    for c in MARGINALS:
        share = cells.groupBy(c).agg(F.sum("tokens").cast("double").alias("share"))
        if given := targets.get(c):
            names = cells.sparkSession.createDataFrame(list(given.items()), f"{c} string, given double")
            share = share.join(names, c, "left").withColumn("t", F.coalesce("given", F.lit(0.0)))
        else:
            share = share.withColumn("t", F.pow("share", F.lit(float(temper.get(c, 1.0)))))
        share = scratch.keep(share.select(c, F.when(F.col("share") > 0, F.col("t")).otherwise(0.0).alias("t")), f"want-{c}")
        whole = float(share.agg(F.sum("t").alias("t")).first()["t"])
        want[c] = share.select(c, (F.col("t") / whole if whole else F.col("t")).alias("t"))
    for k in range(steps):
        for c in MARGINALS:
            have = x.groupBy(c).agg(F.sum(F.col("tokens") / total * F.col("f")).alias("have")).join(want[c], c)
            x = x.join(have, c).withColumn("f", F.col("f") * F.when(F.col("have") > 0, F.col("t") / F.col("have")).otherwise(0.0))
            x = x.withColumn(f"off_{c}", F.abs(F.col("have") - F.col("t"))).drop("have", "t")
        x = scratch.keep(x, f"round-{k}")
        worst = float(x.agg(F.max(F.greatest(*(f"off_{c}" for c in MARGINALS))).alias("off")).first()["off"])
        x = x.select(*cells.columns, "f")
        if k:
            scratch.drop(f"round-{k - 1}")
        if worst < tol:
            break
    else:
        _not_met(worst, steps)
    return x


def uniform(seed: int, *cols: Column) -> Column:
    """A number in [0, 1) that depends only on the columns and the seed."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11).cast("double") / F.lit(float(1 << 53))


def mix(docs: DataFrame, temper: dict[str, float] | None = None, targets: dict[str, dict[str, float]] | None = None, seed: int = 17) -> DataFrame:
    """Sampling probability and decision for each document of ``docs`` (doc_id, text, source, lang).

    Target shares of a marginal come from ``targets`` (category -> share;
    categories not named get 0), or else are the corpus shares to the power in
    ``temper``, scaled to one.  Returns doc_id, source, lang, topic, n_tokens,
    probability and selected.  The decision depends on doc_id, text and seed
    only, so copies of a row fall together and a run can be repeated.

    A null source or language is the category "(none)"; a null or blank text
    has no tokens, weighs nothing, and shares its cell's probability (a cell
    without any token gets 0).  Other columns are ignored.
    """
    x = docs.select("doc_id", F.col("text").cast("string").alias("text"), *(F.coalesce(F.col(c).cast("string"), F.lit("(none)")).alias(c) for c in MARGINALS[:2]))
    x = x.select("doc_id", *MARGINALS[:2], topic(F.col("text")).alias("topic"), n_tokens(F.col("text")).alias("n_tokens"), uniform(seed, F.col("doc_id"), F.col("text")).alias("draw"))
    p = cell_probabilities(x, temper or TEMPER, targets or {})
    out = x.join(p, MARGINALS).withColumn("selected", F.col("draw") < F.col("probability"))
    return out.select("doc_id", *MARGINALS, "n_tokens", "probability", "selected")


def cell_probabilities(x: DataFrame, temper: dict[str, float], targets: dict[str, dict[str, float]]) -> DataFrame:
    """(source, lang, topic, probability) of every cell."""
    spark, scratch = x.sparkSession, Scratch(x.sparkSession, "cells")
    table = scratch.keep(x.groupBy(*MARGINALS).agg(F.sum("n_tokens").alias("tokens")), "cells")
    cells = table.limit(MAX_CELLS + 1).toArrow().to_pylist()
    if len(cells) > MAX_CELLS:
        f = rake_table(table, temper, targets, scratch).withColumn("f", F.when(F.col("tokens") > 0, F.col("f")).otherwise(0.0))
        top = float(f.agg(F.max("f").alias("f")).first()["f"])
        return f.select(*MARGINALS, (F.col("f") / top if top > 0 else F.col("f")).alias("probability"))
    scratch.drop()
    cells.sort(key=lambda r: tuple(r[c] for c in MARGINALS))
    tokens = np.array([r["tokens"] for r in cells], float)
    codes, want = [], []
    for c in MARGINALS:
        names, code = np.unique([r[c] for r in cells], return_inverse=True) if cells else (np.zeros(0, str), np.zeros(0, int))
        share = np.bincount(code, tokens, len(names))
        codes.append(code)
        given = targets.get(c)
        want.append(np.array([given.get(n, 0.0) for n in names.tolist()]) if given else np.power(share, temper.get(c, 1.0), where=share > 0, out=np.zeros(len(names))))
    f = rake(tokens, codes, want) * (tokens > 0)
    p = f / f.max() if len(f) and f.max() > 0 else f
    out = spark.createDataFrame([(*(r[c] for c in MARGINALS), float(v)) for r, v in zip(cells, p, strict=True)], ", ".join(f"{c} string" for c in MARGINALS) + ", probability double")
    return F.broadcast(out) if len(cells) <= BROADCAST_CELLS else out


def sample(docs: DataFrame, temper: dict[str, float] | None = None, targets: dict[str, dict[str, float]] | None = None, seed: int = 17) -> DataFrame:
    """The selected documents of ``docs``, with all their columns."""
    names = ["_mix_" + c for c in MARGINALS]
    keys = [*(F.coalesce(F.col(c).cast("string"), F.lit("(none)")) for c in MARGINALS[:2]), topic(F.col("text"))]
    x = docs.select(*(k.alias(c) for k, c in zip(keys, MARGINALS, strict=True)), n_tokens(F.col("text")).alias("n_tokens"))
    p = cell_probabilities(x, temper or TEMPER, targets or {})
    p = p.select(*(F.col(c).alias(n) for c, n in zip(MARGINALS, names, strict=True)), F.col("probability").alias("_mix_p"))
    cond = None
    for k, n in zip(keys, names, strict=True):
        cond = (k == p[n]) if cond is None else cond & (k == p[n])
    return docs.join(p, cond & (uniform(seed, F.col("doc_id"), F.col("text").cast("string")) < p["_mix_p"]), "left_semi")
