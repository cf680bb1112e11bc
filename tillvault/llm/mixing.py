"""Mixing sources to target weights by iterative proportional fitting (operator 8).

Tokens are summed per cell (source, language, topic). A cell's weight starts at 1;
each round scales the cells of every source, then of every language, then of every
topic so that their weighted tokens have the target share, until all three hold.
A document is due rate * weight of its cell times: that many whole ``copies``, and one
more with the fraction as probability, so the tokens of all copies are expected to have
the target shares. It is ``kept`` if it has a copy, with probability
min(1, rate * weight); rate is such that the given share of all tokens is expected to
be kept. Both are a fixed function of its id and the seed.

The kept documents taken once each do not reach the targets: where a cell is due more
than one copy, its share is short. ``copies`` is the mix.

Up to ``CELLS`` cells are raked on the driver; beyond that by DataFrame joins,
with a written table every round. Both take the same steps to the same tolerance.
``gap`` is the largest share by which the last round still moved a source, language or
topic: above ``CLOSE`` the targets cannot be met together (or not in ``ROUNDS`` rounds),
and the weights are the last round's.

Targets that are not given are the tokens' own shares to the power ``temperature``.
Values without a target share the ``(other)`` target, or keep their own share.

Defined results: a null source, language or topic is the value ``(none)``; null and
empty texts have no tokens, so they weigh nothing and are kept or not by their cell
alone; rows that repeat a doc_id in one cell stay or go together; an empty table
gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillvault.llm.common import same_hash, written

CELLS = 100_000
ROUNDS = 50
CLOSE = 1e-6
HALVINGS = 60
DIMENSIONS = ("source", "lang", "topic")
NONE = "(none)"
OTHER = "(other)"


@dataclass
class Targets:
    """Shares by value for each dimension; they are scaled to 1. None: tempered shares."""

    source: dict[str, float] | None = None
    lang: dict[str, float] | None = None
    topic: dict[str, float] | None = None
    temperature: dict[str, float] = field(default_factory=lambda: {"source": 0.5, "lang": 0.7, "topic": 0.8})


def token_count(text: Column) -> Column:
    """One for every eight characters begun of each run without blanks: words, and scripts that put no blanks between them."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]{1,8}")), F.lit(0)).cast("long")


def form(text: Column) -> Column:
    """The topic where the table has none: what kind of text it is."""
    return (
        F.when(F.coalesce(F.length(text), F.lit(0)) == 0, NONE)
        .when(F.contains(text, F.lit(" | ")), "table")
        .when(F.contains(text, F.lit("!!")), "shouting")
        .when(F.contains(text, F.lit("###")), "noise")
        .when(F.contains(text, F.lit("icense")), "licensed")
        .otherwise("prose")
    )


def shares(tokens: dict[str, float], given: dict[str, float] | None, temperature: float) -> dict[str, float]:
    """The target share of each value that occurs."""
    total = sum(tokens.values()) or 1
    if given is None:
        raw = {k: (v / total) ** temperature if v else 0.0 for k, v in tokens.items()}
    else:
        rest = {k: v for k, v in tokens.items() if k not in given}
        part = given.get(OTHER, sum(rest.values()) / total)
        raw = {k: given[k] for k in tokens if k in given} | {
            k: part * v / (sum(rest.values()) or 1) for k, v in rest.items()
        }
    scale = sum(raw.values()) or 1
    return {k: v / scale for k, v in raw.items()}


def rake(keys: list[tuple], tokens: np.ndarray, targets: Targets) -> tuple[np.ndarray, float]:
    """The weight of each cell, and how far the last round still moved one: the gap that is left to the targets."""
    total, places, wanted = tokens.sum(), [], []
    for d, name in enumerate(DIMENSIONS):
        values, place = np.unique([k[d] for k in keys], return_inverse=True)
        sums = dict(zip(values.tolist(), np.bincount(place, tokens, len(values)).tolist()))
        goal = shares(sums, getattr(targets, name), targets.temperature[name])
        places.append(place)
        wanted.append(np.array([goal[v] for v in values.tolist()]) * total)
    weights, moved = np.ones(len(keys)), 0.0
    for _ in range(ROUNDS):
        moved = 0.0
        for place, goal in zip(places, wanted):
            now = np.bincount(place, tokens * weights, len(goal))
            factor = np.divide(goal, now, out=np.ones_like(goal), where=now > 0)
            moved = max(moved, np.abs(factor - 1).max(initial=0))
            weights *= factor[place]
        if moved < CLOSE:
            break
    return weights, float(moved)


def rate_for(tokens: np.ndarray, weights: np.ndarray, keep: float) -> float:
    """The rate at which ``keep`` of all tokens is expected to stay."""
    low, high = 0.0, 1 / max(1e-12, weights[weights > 0].min(initial=1.0))
    for _ in range(HALVINGS):
        middle = (low + high) / 2
        if (tokens * np.minimum(1, middle * weights)).sum() < keep * tokens.sum():
            low = middle
        else:
            high = middle
    return high


def rake_widely(cells: DataFrame, targets: Targets, rounds: int = ROUNDS) -> tuple[DataFrame, float]:
    """``rake`` for more cells than a driver should hold: the same steps as joins on sums."""
    total = F.col("tokens").cast("double")
    now = cells.withColumn("weight", F.lit(1.0))
    goals = {}
    for name in DIMENSIONS:
        sums = cells.groupBy(name).agg(F.sum("tokens").alias("own"))
        given = getattr(targets, name)
        all_tokens = sums.agg(F.sum("own").alias("all"))
        if given is None:
            raw = sums.crossJoin(all_tokens).withColumn("raw", F.pow(F.col("own") / F.col("all"), targets.temperature[name]))
        else:
            table = F.create_map(*(F.lit(x) for pair in given.items() for x in pair))
            known = F.element_at(table, F.col(name)) if given else F.lit(None).cast("double")
            rest = sums.filter(~F.col(name).isin(list(given))).agg(F.coalesce(F.sum("own"), F.lit(0)).alias("rest"))
            part = F.lit(given[OTHER]) * F.col("own") / F.col("rest") if OTHER in given else F.col("own") / F.col("all")
            raw = sums.crossJoin(all_tokens).crossJoin(rest).withColumn("raw", F.coalesce(known, part))
        scale = raw.agg(F.sum("raw").alias("scale"))
        goals[name] = written(
            raw.crossJoin(scale).select(name, (F.col("raw") / F.col("scale") * F.col("all")).alias("goal")), "goals"
        )
    gap = 0.0
    for _ in range(rounds):
        moved = F.lit(0.0)
        for name in DIMENSIONS:
            sums = now.groupBy(name).agg(F.sum(total * F.col("weight")).alias("sum"))
            factor = sums.join(goals[name], name).select(
                name, F.when(F.col("sum") > 0, F.col("goal") / F.col("sum")).otherwise(1.0).alias("factor")
            )
            now = now.join(factor, name)
            moved = F.greatest(moved, F.abs(F.col("factor") - 1))
            now = now.withColumn("moved", moved).withColumn("weight", F.col("weight") * F.col("factor")).drop("factor")
            moved = F.col("moved")
        now = written(now, "cells")
        gap = now.agg(F.max("moved")).first()[0] or 0.0
        if gap < CLOSE:
            break
        now = now.drop("moved")
    return now.select(*DIMENSIONS, "tokens", "weight"), gap


def cells_of(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens"))


def probabilities(rows: DataFrame, targets: Targets, keep: float, most_cells: int = CELLS) -> DataFrame:
    """(source, lang, topic, weight, probability, due, gap) of each cell of (source, lang, topic, tokens) rows."""
    spark = rows.sparkSession
    cells = written(cells_of(rows), "cells")
    if cells.count() > most_cells:
        raked, gap = rake_widely(cells, targets)
        raked = written(raked, "cells")
        wanted = raked.agg(F.sum("tokens")).first()[0] * keep
        lowest = raked.filter("weight > 0").agg(F.min("weight")).first()[0] or 1.0
        low, high = 0.0, 1 / lowest
        for _ in range(HALVINGS):
            middle = (low + high) / 2
            stays = raked.agg(F.sum(F.col("tokens") * F.least(F.lit(1.0), F.col("weight") * middle))).first()[0]
            low, high = (middle, high) if stays < wanted else (low, middle)
        due = F.col("weight") * high
        return raked.select(*DIMENSIONS, "weight", F.least(F.lit(1.0), due).alias("probability"), due.alias("due"), F.lit(gap).alias("gap"))
    found = sorted((tuple(r[:3]), r.tokens) for r in cells.collect())
    keys, tokens = [k for k, _ in found], np.array([n for _, n in found], float)
    weights, gap = rake(keys, tokens, targets) if keys else (tokens, 0.0)
    rate = rate_for(tokens, weights, keep) if keys else 0.0
    table = [(*k, float(w), float(min(1.0, rate * w)), float(rate * w), gap) for k, w in zip(keys, weights)]
    # At most ``most_cells`` rows.
    return F.broadcast(
        spark.createDataFrame(
            table, "source string, lang string, topic string, weight double, probability double, due double, gap double"
        )
    )


def mixed(
    docs: DataFrame,
    targets: Targets | None = None,
    keep: float = 0.9,
    seed: int = 8,
    most_cells: int = CELLS,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
    topic: Column | None = None,
) -> DataFrame:
    """``row`` (the whole row as a struct) with doc_id, source, lang, topic, tokens, weight, probability, kept, copies, gap."""
    text = docs[text_col]
    value = lambda column: F.coalesce(column.cast("string"), F.lit(NONE))
    columns = [
        docs[id_col].cast("long").alias("doc_id"),
        value(docs[source_col]).alias("source"),
        value(docs[lang_col]).alias("lang"),
        value(form(text) if topic is None else topic).alias("topic"),
        token_count(text).alias("tokens"),
    ]
    cells = probabilities(docs.select(*columns[1:]), targets or Targets(), keep, most_cells)
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), *columns)
    number, whole = same_hash(F.col("doc_id"), seed), F.floor("due")
    copies = whole + (number < F.col("due") - whole).cast("long")
    return rows.join(cells, list(DIMENSIONS)).select(
        "row",
        "doc_id",
        *DIMENSIONS,
        "tokens",
        "weight",
        "probability",
        (number < F.col("probability")).alias("kept"),
        copies.alias("copies"),
        "gap",
    )
