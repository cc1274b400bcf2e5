"""Filter interaction audit: what each filter removes in every order of
application, what it removes in vain, and what only it would remove.

*Masks.*  A row's mask says which filters it fails.  Rows are counted by
(part, mask) first, with the number of marked rows, so that all later work is
on at most ``parts * 2**filters`` weighted masks.

*Removal ranks.*  With a mask matrix M (masks x filters, 0 where the filter
fails, infinite where it passes) and a position matrix P (filters x orders, the
inverse permutations), the min-plus product ``min_f M[m, f] + P[f, o]`` is the
step at which order o removes mask m (infinite: kept).  Scattering the weights
of the masks by that step gives what a step removes; the masks that fail a
step's filter but left earlier are its redundant ones.

Defined results: a null part is the empty string; a part with any row has a
line per order and step, zeros included; no rows: no lines.  Flags that are
null count as passed.
"""
from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepared, stored

#: maximal runs of anything but space, tab, LF, VT, FF and CR
WORD = r"[^\x20\x09-\x0D]+"
MIN_WORDS, MIN_DISTINCT, MAX_UPPER = 200, 50, 3     # words; percent; percent


def removal_steps(masks: np.ndarray, orders: list[tuple[int, ...]]) -> np.ndarray:
    """Step (from 0) at which each order removes each mask; infinite: kept."""
    m = len(orders[0])
    fails = (masks[:, None] >> np.arange(m)) & 1
    cost = np.where(fails == 1, 0.0, np.inf)                    # masks x filters
    place = np.argsort(np.array(orders), axis=1).T              # filters x orders
    step = np.full((len(masks), len(orders)), np.inf)
    for f in range(m):                                          # min-plus product
        np.minimum(step, cost[:, f, None] + place[f], out=step)
    return step


def interactions(masks: np.ndarray, weights: np.ndarray, orders: list[tuple[int, ...]]) -> dict[str, np.ndarray]:
    """Arrays (orders x steps) of one part: ``weights`` (masks x kinds) are
    summed as int64; kind 0 counts rows."""
    m, n = len(orders[0]), len(orders)
    step = removal_steps(masks, orders)
    gone = np.zeros((n, m + 1, weights.shape[1]), dtype=np.int64)
    at = np.where(np.isinf(step), m, step).astype(np.int64)
    np.add.at(gone, (np.broadcast_to(np.arange(n), at.shape), at), weights[:, None, :])
    filters = np.array(orders)                                  # filter of each step
    failing = np.array([weights[(masks >> f) & 1 == 1, 0].sum() for f in range(m)], dtype=np.int64)
    alone = np.array([weights[masks == 1 << f, 0].sum() for f in range(m)], dtype=np.int64)
    removed = gone[:, :m, :]
    # what a filter fails is removed by it or was removed before it
    here = removed[:, :, 0]
    share = np.zeros(m, dtype=np.int64)
    np.add.at(share, filters, here)
    total = weights[:, 0].sum()
    return {"kept": total - np.cumsum(here, axis=1), "removed": here, "redundant": failing[filters] - here,
            "unique_fails": alone[filters], "lost": removed[:, :, 1:], "shapley": share[filters]}


def audit(rows: DataFrame, filters: dict[str, Column], part: Column, marks: dict[str, Column], weight: Column | None = None,
          orders: list[str] | None = None) -> DataFrame:
    """A line per part, order (all permutations of the filters' one-letter
    names, unless ``orders`` gives some) and step.  ``filters``: true where a
    row fails; ``marks``: rows whose loss is counted, as ``<mark>_lost``."""
    names = list(filters)
    if orders is None:
        orders = ["".join(p) for p in permutations(names)]
    by_number = [tuple(names.index(c) for c in o) for o in orders]
    n = F.lit(1) if weight is None else weight
    mask = sum((F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(filters.values())), F.lit(0))
    counts = rows.select(F.coalesce(part.cast("string"), F.lit("")).alias("part"), mask.alias("mask"), n.cast("long").alias("n"),
                         *[F.when(c, n).otherwise(F.lit(0)).cast("long").alias(f"m{i}") for i, c in enumerate(marks.values())])
    held = ["n", *[f"m{i}" for i in range(len(marks))]]
    counts = counts.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in held])
    lost = [f"{m}_lost" for m in marks]
    columns = ["kept", "removed", "redundant", "unique_fails", *lost, "shapley"]

    def lines(pdf: pd.DataFrame) -> pd.DataFrame:
        got = interactions(pdf["mask"].to_numpy(), pdf[held].to_numpy(dtype=np.int64), by_number)
        for i, c in enumerate(lost):
            got[c] = got["lost"][:, :, i]
        steps = len(names)
        out = {"part": pdf["part"].iloc[0], "filter_order": np.repeat(orders, steps), "step": np.tile(np.arange(1, steps + 1), len(orders))}
        return pd.DataFrame(out | {c: got[c].ravel() for c in columns})

    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in columns)
    return counts.groupBy("part").applyInPandas(lines, schema)


def text_faults(text: Column, words: Column) -> dict[str, Column]:
    """The four filters on a text and its words alone: true where it fails."""
    upper = F.char_length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {"A": F.size(words) < MIN_WORDS,
            "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * MIN_DISTINCT,
            "C": upper * 100 > F.char_length(text) * MAX_UPPER,
            "D": F.regexp_like(text, F.lit(r"[#$%&*|]"))}


def audit_documents(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """The audit of five filters: few words (A), few distinct words (B), many
    capitals (C), symbols (D), and a text equal to that of any smaller id in
    the whole table (E), removed or not.

    Nulls: a null text is empty; a null id is not smaller than any and has
    none smaller, so it never fails E, and has no labels.  Rows that share an
    id don't fail E by each other.  An id labelled several times is good
    (toxic) if any of its labels says so.

    The texts are read once and reduced to masks and SHA-256 digests.  Rows of
    one digest are counted by (digest, part, labels, id) and then without the
    id, keeping the number of rows of the least id, so that a text that a third
    of all rows have never meets in one task."""
    prepared(docs.sparkSession)
    whole = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
                        F.coalesce(F.col(text), F.lit("")).alias("t"))
    whole = whole.withColumn("words", F.regexp_extract_all("t", F.lit(WORD), 0))
    flags = text_faults(F.col("t"), F.col("words"))
    rows = stored(whole.select("id", "part", F.unhex(F.sha2("t", 256)).alias("digest"),
                               sum((F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(flags.values())), F.lit(0)).alias("faults")),
                  "audit-rows")
    marks = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    known = rows.filter("id is not null").join(marks, "id", "left") \
        .select("id", "part", "digest", "faults", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    nameless = rows.filter("id is null").select("id", "part", "digest", "faults", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    kind = ["digest", "part", "faults", "good", "toxic"]
    ids = known.unionByName(nameless).groupBy(*kind, "id").agg(F.count(F.lit(1)).alias("n"))
    least = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n")))
    kinds = ids.groupBy(*kind).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("nameless"),
                                   least.alias("least"))
    first = kinds.groupBy("digest").agg(F.min("least.id").alias("first"))
    kinds = kinds.join(first, "digest")
    firsts = F.col("nameless") + F.when(F.col("least.id") == F.col("first"), F.col("least.n")).otherwise(0)
    both = kinds.select("part", "faults", "good", "toxic", F.explode(F.array(
        F.struct(F.lit(False).alias("copy"), firsts.alias("n")), F.struct(F.lit(True).alias("copy"), (F.col("n") - firsts).alias("n")))).alias("x"))
    both = both.select("part", "faults", "good", "toxic", "x.copy", "x.n").filter("n > 0")
    fails = {c: F.col("faults").bitwiseAND(1 << i) > 0 for i, c in enumerate("ABCD")} | {"E": F.col("copy")}
    return audit(both, fails, F.col("part"), {"good": F.col("good") == 1, "toxic": F.col("toxic") == 1}, F.col("n"))
