"""Mixing sources to target weights: temperature mixing realised as budgeted
block permutations.

*Weights.*  A source's share of the tokens, raised to an exponent alpha in
[0, 1] and normalised: 1 keeps the shares, 0 makes all sources equal.  The
exponent is bisected: the largest one whose weights reach the target entropy
(a fraction of the logarithm of the number of sources), but no smaller than
the smallest one under which no source is repeated more than
``max_repeats`` times.

*Budget.*  By default the smallest one at which every source is read once in
full, so no document is lost; a source of weight w gets budget * w tokens.

*Realisation.*  A source is read in passes over a permutation of its
documents (a keyed hash): full passes first, the last pass stops at the first
document that begins at or after the source's tokens.  The mixture is cut into
blocks: a document stands in the block that its token position in its source,
as a fraction of the source's tokens, falls into, so every block holds the
weights; inside a block the order is a keyed hash of document and pass.

Positions are running sums in hash order over (source, hash, tokens) alone,
taken inside ranges of the hash (so a source that holds most rows is many
windows) whose totals are summed up first.  What comes out is, per source, the
hash at which each block and the last pass end: a table of sources x passes x
blocks, by which the documents are placed where they are read.  No text is
shuffled.

Tokens are runs of non-space characters.  Defined results: a null source is a
source of its own; null, empty and space-only texts have 0 tokens, take part
in every full pass and not in the partial one; repeated rows are documents of
their own and share their place; a source without tokens appears once.
"""
from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, prepared, stored

ENTROPY = 0.97
MAX_REPEATS = 4.0
RANGE_ROWS = 2_000      # documents aimed at in a hash range
BLOCKS = 64


def n_tokens(text: Column) -> Column:
    """Number of runs of non-space characters; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit("\\S+")), F.lit(0)).cast("long")


def tempered(tokens: dict, alpha: float) -> dict:
    """Normalised weights of the sources that have tokens."""
    top = max(tokens.values())
    raw = {s: (t / top) ** alpha for s, t in tokens.items()}
    total = math.fsum(raw.values())
    return {s: x / total for s, x in raw.items()}


def entropy(weights: dict) -> float:
    return -math.fsum(w * math.log(w) for w in weights.values() if w > 0)


def needed(tokens: dict, weights: dict) -> float:
    """Tokens at which every source is read once in full."""
    return max(t / weights[s] for s, t in tokens.items())


def repeats(tokens: dict, weights: dict, budget: float | None) -> float:
    b = needed(tokens, weights) if budget is None else budget
    return max(b * weights[s] / t for s, t in tokens.items())


def exponent(tokens: dict, target: float = ENTROPY, max_repeats: float = MAX_REPEATS, budget: float | None = None) -> float:
    """Bisection: the entropy falls and, from alpha 0 to 1, so do the repeats
    of the rarest source."""
    if len(tokens) < 2:
        return 1.0

    def largest(ok) -> float:
        """The largest alpha that is ok, if all smaller ones are too."""
        if ok(1.0):
            return 1.0
        lo, hi = 0.0, 1.0
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if ok(mid) else (lo, mid)
        return lo

    a = largest(lambda x: entropy(tempered(tokens, x)) >= target * math.log(len(tokens)))
    if repeats(tokens, tempered(tokens, a), budget) <= max_repeats:
        return a
    lo, hi = a, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if repeats(tokens, tempered(tokens, mid), budget) <= max_repeats else (mid, hi)
    return hi


def plan(sources: dict, target: float, max_repeats: float, budget: float | None) -> list[dict]:
    """A row per source: weight, tokens to read, full passes, tokens of the
    last pass.  ``sources``: tokens by source, null as None."""
    tokens = {s: t for s, t in sources.items() if t > 0}
    out = []
    if tokens:
        alpha = exponent(tokens, target, max_repeats, budget)
        weights = tempered(tokens, alpha)
        total = needed(tokens, weights) if budget is None else budget
    for s, t in sources.items():
        quota = round(total * weights[s]) if t > 0 else 0
        quota = max(quota, t) if budget is None else quota
        passes = quota // t if t > 0 else 1
        out.append({"source": s, "tokens": t, "weight": weights[s] if t > 0 else 0.0, "quota": max(quota, 1),
                    "passes": passes, "rest": quota - passes * t})
    return out


def row_hash(docs: DataFrame, seed: int) -> Column:
    """Keyed hash of the whole row; maps, which have no hash, as JSON."""
    return F.xxhash64(F.lit(seed), *[F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`")
                                     for f in docs.schema.fields])


def placements(slim: DataFrame, planned: list[dict], n_docs: dict, blocks: int) -> DataFrame:
    """A row per source: ``none`` and ``name`` (its key), quota, weight,
    passes, ``stop`` (the hash at which the last, partial pass ends; null:
    there is none) and ``starts``, the (pass, hash, block) at which a new block
    begins.  ``slim`` has none, name, h, n."""
    kinds = pa.schema([("none", pa.bool_()), ("name", pa.string()), ("weight", pa.float64()),
                       *((c, pa.int64()) for c in ("tokens", "quota", "passes", "rest", "n_ranges"))])
    # an Arrow table: one of Python rows starts workers on the executors that keep their memory
    todo = F.broadcast(slim.sparkSession.createDataFrame(pa.Table.from_pylist(
        [{"none": p["source"] is None, "name": p["source"] or "", **{c: p[c] for c in ("weight", "tokens", "quota", "passes", "rest")},
          "n_ranges": max(1, -(-n_docs[p["source"]] // RANGE_ROWS))} for p in planned], kinds)))
    key = ["none", "name"]
    rows = slim.groupBy(*key, "h").agg(F.sum("n").alias("n")).join(todo, key)
    # the place of the hash among 2**32 values: ranges of equal width, in order
    place = F.shiftright("h", 32) + F.lit(1 << 31)
    rows = rows.withColumn("part", F.floor(place * F.col("n_ranges") / F.lit(2.0 ** 32)).cast("long"))
    earlier = Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*key, "part").agg(F.sum("n").alias("size")) \
        .select(*key, "part", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy(*key, "part").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("own", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(sums, [*key, "part"])
    rows = rows.withColumn("before", F.col("base") + F.col("own"))
    stops = rows.groupBy(*key).agg(F.min(F.when(F.col("before") >= F.col("rest"), F.col("h"))).alias("stop"))
    rows = rows.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes"))))
    at = F.col("pass") * F.col("tokens") + F.col("before")
    block = F.least(F.floor(at * blocks / F.col("quota")), F.lit(blocks - 1)).cast("int")
    starts = rows.groupBy(*key, "pass", block.alias("block")).agg(F.min("h").alias("h")) \
        .groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("pass", "h", "block"))).alias("starts"))
    return todo.join(stops, key).join(starts, key).select(*key, "weight", "passes", "rest", "stop", "starts")


def mix(docs: DataFrame, source: str = "source", text: str = "text", target: float = ENTROPY,
        max_repeats: float = MAX_REPEATS, budget: int | None = None, blocks: int = BLOCKS, seed: int = 0) -> DataFrame:
    """``docs``, a row per reading, with ``mix_block``, ``mix_order`` (ascending
    in a block), ``mix_pass`` (from 0), ``mix_tokens`` and ``mix_weight`` (of
    the source); columns of those names are replaced."""
    prepared(docs.sparkSession)
    none, name, n, h, plan_ = fresh(docs, "none", "name", "n", "h", "plan")
    rows = docs.withColumns({none: F.col(source).isNull(), name: F.coalesce(F.col(source).cast("string"), F.lit("")),
                             n: n_tokens(F.col(text)), h: row_hash(docs, seed)})
    slim = stored(rows.select(F.col(none).alias("none"), F.col(name).alias("name"), F.col(h).alias("h"), F.col(n).alias("n")), "mix-rows")
    # a row per source, of which a mixture has few
    totals = {None if r["none"] else r["name"]: r for r in
              slim.groupBy("none", "name").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs")).collect()}
    planned = plan({s: int(totals[s]["n"]) for s in sorted(totals, key=lambda s: (s is None, s or ""))}, target, max_repeats, budget)
    at = stored(placements(slim, planned, {s: r["docs"] for s, r in totals.items()}, blocks), "mix-places")
    at = at.select(F.col("none").alias(none), F.col("name").alias(name), F.struct("weight", "passes", "rest", "stop", "starts").alias(plan_))
    rows = rows.join(F.broadcast(at), [none, name])
    full = F.sequence(F.lit(0).cast("long"), F.col(plan_)["passes"] - 1)
    full = F.when(F.col(plan_)["passes"] > 0, full).otherwise(F.array().cast("array<bigint>"))
    partial = (F.col(plan_)["rest"] > 0) & (F.col(n) > 0) & (F.col(plan_)["stop"].isNull() | (F.col(h) < F.col(plan_)["stop"]))
    readings = F.when(partial, F.concat(full, F.array(F.col(plan_)["passes"]))).otherwise(full)
    rows = rows.withColumn("mix_pass", F.explode(readings))

    def reached(s: Column) -> Column:
        return (s["pass"] < F.col("mix_pass")) | ((s["pass"] == F.col("mix_pass")) & (s["h"] <= F.col(h)))

    block = F.element_at(F.filter(F.col(plan_)["starts"], reached), -1)["block"]
    return rows.withColumns({"mix_block": block, "mix_order": F.xxhash64(F.lit(seed + 1), "mix_pass", F.col(h)),
                             "mix_tokens": F.col(n), "mix_weight": F.col(plan_)["weight"]}).drop(none, name, n, h, plan_)
