"""License scan: MinHash bands over overlapping text windows retrieve licence
templates, exact shingle containment verifies them.

Words are runs of letters and digits in lower case, shingles five words.  A
template of m shingles has the scale s = the least power of two of at least
1.25 m; a text's windows of that scale are 2 s shingles long and begin at every
multiple of s, so every stretch of s shingles lies whole in one of them.

A shingle that is in no template can support no match, so a window's set is
what it shares with the templates of its scale: texts without any such shingle
drop out first (one hash set per text), and windows exist only where shingles
were found.  Each band is one minimum over a seeded hash of the set.  A window
that contains 0.8 of a template has a Jaccard similarity with it of at least
``LEAST_JACCARD`` (a window holds under 5 m shingles, all of which may be of
templates); the number of bands follows from it and ``MISS``, the chance of a
miss.

Retrieved (window, template) pairs are kept if the window holds at least 0.8 of
the template's shingles.  A (document, template) pair is reported with its best
window.

The templates are a parameter and few: their shingles and bands are broadcast,
their number is checked.  Only DataFrame functions are used.  Defined results:
null, empty and short texts match nothing; templates of under five words are
refused; repeated rows are one document if id and text are equal.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let
from .common import prepared, stored
from .license_texts import NOTICES

WORDS = 5
CONTAINMENT = 0.8
LEAST_JACCARD, MISS = 0.15, 1e-5    # scale < 2.5 m, window < 5 m: 0.8 / 5.2
BANDS = math.ceil(math.log(MISS) / math.log(1 - LEAST_JACCARD))
MAX_TEMPLATE_SHINGLES = 1_000_000


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))


def shingles_of(words: Column) -> Column:
    """Hash of every window of five words."""
    n = F.size(words) - (WORDS - 1)

    def over(hashed: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*[F.get(hashed, i + j) for j in range(WORDS)]))

    return F.when(n > 0, let(F.transform(words, lambda w: F.xxhash64(w)), over))


def template_table(spark, notices: list[tuple[str, str]]) -> DataFrame:
    """template (number), license, shingles (distinct), m, scale."""
    rows = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(notices)], "template int, license string, text string")
    rows = rows.withColumn("shingles", F.array_distinct(shingles_of(words_of(F.col("text"))))).withColumn("m", F.size("shingles"))
    scale = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("m") * 1.25))).cast("int")
    return rows.withColumn("scale", F.greatest(scale, F.lit(1))).drop("text")


def bands_of(shingles: Column) -> Column:
    """(band, least seeded hash) of a set."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.struct(
        b.alias("band"), F.array_min(F.transform(shingles, lambda h: F.xxhash64(b, h))).alias("low")))


def scan(docs: DataFrame, notices: list[tuple[str, str]] = NOTICES, doc_id: str = "doc_id", text: str = "text",
         containment: float = CONTAINMENT) -> DataFrame:
    """A row per (document, template) found: doc_id, template, license,
    containment, first_word and last_word (of the shingles found in the best
    window, the earliest of equals)."""
    spark = prepared(docs.sparkSession)
    known = template_table(spark, notices).collect()
    if any(r["shingles"] is None for r in known):
        raise ValueError(f"a template has fewer than {WORDS} words")
    vocabulary = sorted({h for r in known for h in r["shingles"]})
    if len(vocabulary) > MAX_TEMPLATE_SHINGLES:
        raise ValueError("too many templates to broadcast")
    templates = spark.createDataFrame([(r["template"], r["license"], r["shingles"], r["m"], r["scale"]) for r in known],
                                      "template int, license string, shingles array<long>, m int, scale int")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(doc_id), F.col(text)).alias("rk"),
                       shingles_of(words_of(F.col(text))).alias("shingles"))
    # the texts that share a shingle with a template
    some = rows.filter(F.arrays_overlap("shingles", F.array(*[F.lit(h) for h in vocabulary]).cast("array<long>")))
    found = some.select("doc_id", "rk", F.posexplode("shingles").alias("at", "h"))
    places = F.broadcast(templates.select("scale", F.explode("shingles").alias("h")).distinct())
    hits = stored(found.join(places, "h"), "license-hits")
    window = F.floor(F.col("at") / F.col("scale")).cast("int")
    windows = hits.withColumn("window", F.explode(F.array(window, window - 1))) \
        .groupBy("doc_id", "rk", "scale", "window").agg(F.collect_set("h").alias("have"))
    keys = F.broadcast(templates.select("template", "scale", F.explode(bands_of(F.col("shingles"))).alias("k"))
                       .select("template", "scale", F.col("k.band").alias("band"), F.col("k.low").alias("low")))
    met = windows.withColumn("k", F.explode(bands_of(F.col("have")))) \
        .select("doc_id", "rk", "scale", "window", "have", F.col("k.band").alias("band"), F.col("k.low").alias("low")) \
        .join(keys, ["scale", "band", "low"]) \
        .groupBy("doc_id", "rk", "scale", "window", "template").agg(F.first("have").alias("have"))
    share = F.size(F.array_intersect("have", "shingles")) / F.col("m")
    held = met.join(F.broadcast(templates.drop("scale")), "template").withColumn("containment", share) \
        .filter(F.col("containment") >= containment)
    best = held.groupBy("doc_id", "rk", "template").agg(
        F.max(F.struct(F.col("containment"), (-F.col("window")).alias("w"), F.col("scale"))).alias("b")) \
        .select("doc_id", "rk", "template", "b.containment", (-F.col("b.w")).alias("window"), "b.scale")
    # where the shingles of the template stand in that window
    of = F.broadcast(templates.select("template", "license", F.explode("shingles").alias("h")))
    inside = (F.col("at") >= F.col("window") * F.col("scale")) & (F.col("at") < (F.col("window") + 2) * F.col("scale"))
    spots = hits.select("rk", "at", "h", F.col("scale").alias("s")).join(best, ["rk"]).filter((F.col("s") == F.col("scale")) & inside)
    return spots.join(of, ["template", "h"]).groupBy("doc_id", "rk", "template", "license", "containment") \
        .agg(F.min("at").alias("first_word"), (F.max("at") + WORDS - 1).alias("last_word")) \
        .select("doc_id", "template", "license", "containment", "first_word", "last_word")
