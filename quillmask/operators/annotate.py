"""Annotators (A1-A9): document -> one 0/1 label per token.

* rare n-gram baseline (A1-A3): a window not in the n-gram list marks all its
  words;
* span baseline (A4-A6): rule spans on the raw sentence, projected to the
  tokens they overlap;
* model and batch scorers (A7, A9) live next to the models.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as TX
from ..functions.arrays import let, match_bounds, overlap_flags
from ..session import ship_package, stored
from ..sources.tables import SENT_KEYS
from . import text as T


def ngram_windows(sent: DataFrame, n: int, keys=SENT_KEYS, case_sensitive: bool = False,
                  words: str = "words") -> DataFrame:
    """A1: all length-n windows of a sentence as ``(keys, pos, g)``; a sentence
    shorter than n has none.  Built with ``slice`` per sentence, no self-join."""
    w = F.col(words) if case_sensitive else F.transform(words, F.lower)

    def windows(lw):
        seq = F.sequence(F.lit(0), F.size(lw) - n)
        # n is known when the plan is built: join n element reads, no slice array per window
        g = F.transform(seq, lambda i: F.concat_ws(" ", *[lw[i + k] for k in range(n)]))
        return F.when(F.size(lw) >= n, g).otherwise(F.array().cast("array<string>"))
    return sent.select(*keys, F.posexplode(let(w, windows)).alias("pos", "g"))


def ngram_counts(sent: DataFrame, n: int, min_count: int = 1, case_sensitive: bool = False) -> DataFrame:
    """A2: the n-gram frequency list of a corpus, ``(g, n)`` with at least
    ``min_count`` occurrences (partial counts are combined map-side)."""
    return ngram_windows(sent, n, case_sensitive=case_sensitive).groupBy("g") \
        .agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)


def ngram_counts_by(sent: DataFrame, n: int, values, by: str = "corpus", case_sensitive: bool = False) -> DataFrame:
    """A2 by corpus: ``(g, n, of)`` of every n-gram, ``of`` the occurrences in
    each corpus of ``values``."""
    each = [F.count_if(F.col(by) == v).alias(f"_n{i}") for i, v in enumerate(values)]
    w = ngram_windows(sent, n, (by,), case_sensitive).groupBy("g").agg(F.count(F.lit(1)).alias("n"), *each)
    return w.select("g", "n", F.array(*[f"_n{i}" for i in range(len(values))]).alias("of"))


def known_ngrams(windows: DataFrame, ngram: DataFrame, known: bool = True) -> DataFrame:
    """Windows whose n-gram is (``left_semi``) or is not (``left_anti``) in
    the list.  Anti join, never ``NOT IN`` (null-aware, nested loop)."""
    lst = ngram.select("g").distinct()
    return windows.join(lst, "g", "left_semi" if known else "left_anti")


def known_totals(counts: DataFrame, min_count: int, width: int) -> DataFrame:
    """J4 on ``ngram_counts_by`` with the list of the windows themselves: one
    row, the occurrences in each corpus of the n-grams that are and that are
    not in it (``known``, ``unknown``).  The semi and anti join with the list
    are two conditions on the counted rows."""
    def total(held):
        return F.array(*[F.coalesce(F.sum(F.when(held, F.col("of")[i])), F.lit(0)) for i in range(width)])
    held = F.col("n") >= min_count
    return counts.agg(total(held).alias("known"), total(~held).alias("unknown"))


def annotate_rare_ngrams(sent: DataFrame, ngram: DataFrame | int, n: int, keys=SENT_KEYS,
                         case_sensitive: bool = False, out: str = "pred") -> DataFrame:
    """A3: flat ``(keys, pos, word, label, pred)`` where ``pred`` = 1 when the
    word lies in some window that is not in the n-gram list.

    ``ngram`` is a list or, for the list of ``sent`` itself, the count from
    which a window is in it (``own_ngram_flags``).  Plan for a given list:
    windows -> anti join on ``g`` (AQE splits a hot n-gram) -> the rare
    positions folded per sentence (bounded by it) -> one join to the sentence
    row, whose flags are array functions of it."""
    if isinstance(ngram, int):
        s = own_ngram_flags(sent.select(*keys, "words", "labels"), (n,), ngram, keys, case_sensitive)
        return T.explode_tokens(s, keys, ("words", "labels", f"preds{n}"), ("word", "label", out))
    rare = known_ngrams(ngram_windows(sent, n, keys, case_sensitive), ngram, known=False)
    folded = rare.groupBy(*keys).agg(F.collect_list("pos").alias("_rare"))
    return flagged_tokens(sent.select(*keys, "words", "labels"), folded, n, keys, out)


def own_ngram_flags(sent: DataFrame, sizes, min_count: int, keys=SENT_KEYS, case_sensitive: bool = False) -> DataFrame:
    """A2 + A3 with the n-gram lists of ``sent`` itself: its columns and, for
    each size n, ``preds<n>``: 1 for the words in some window of n that occurs
    less than ``min_count`` times.  Sentences with a null key get zeros.

    Plan: a window that occurs once is its own only place, so one count by
    n-gram (combined map-side) with the least place gives the rare windows: no
    list is joined.  They are folded per sentence and joined to it, by a number
    of the sentence; the flags are running sums per Arrow batch.  The sizes
    follow each other through written tables, so the shuffles of one are gone
    before the next."""
    ship_package(sent.sparkSession)
    s = stored(sent.withColumns({"_sid": F.monotonically_increasing_id(), "_n": F.size("words")}), "ngram-sentences")
    keyed = F.lit(True)
    for k in keys:
        keyed = keyed & F.col(k).isNotNull()
    for i, n in enumerate(sizes):
        if min_count <= 2:
            rare = _single_windows(s, n, min_count, case_sensitive)
        else:
            rare = known_ngrams(ngram_windows(s, n, ("_sid",), case_sensitive), ngram_counts(s, n, min_count, case_sensitive), known=False)
        folded = rare.groupBy("_sid").agg(F.collect_list("pos").alias("_rare"))
        s = s.join(folded, "_sid", "left").withColumn(f"preds{n}", covered(F.col("_n"), F.when(keyed, F.col("_rare")), n)).drop("_rare")
        if i + 1 < len(sizes):
            s = stored(s, "ngram-sentences")
    return s.select(*sent.columns, *[f"preds{n}" for n in sizes])


def _single_windows(s: DataFrame, n: int, min_count: int, case_sensitive: bool = False) -> DataFrame:
    """``(_sid, pos)`` of the windows that occur less than ``min_count`` (up to
    2) times, written.  They are counted by a 64-bit hash with the least and
    greatest of a second one, so numbers are shuffled instead of text; where
    those differ, n-grams share the first hash and are counted as written."""
    w = ngram_windows(s, n, ("_sid",), case_sensitive)
    one = w.groupBy(window_hash(F.col("g")).alias("_h")).agg(
        F.count(F.lit(1)).alias("_c"), F.min("_sid").alias("_sid"), F.min("pos").alias("pos"), F.min(F.hash("g")).alias("_lo"), F.max(F.hash("g")).alias("_hi"))
    mixed = F.col("_lo") != F.col("_hi")
    rare = stored(one.filter((F.col("_c") < min_count) | mixed).select("_sid", "pos", F.when(mixed, F.col("_h")).alias("_h")), "rare-windows", "zstd")
    shared = rare.filter("_h is not null").select("_h")
    rare = rare.filter("_h is null").select("_sid", "pos")
    if not shared.head(1):
        return rare
    again = w.withColumn("_h", window_hash(F.col("g"))).join(shared, "_h", "left_semi").groupBy("g").agg(
        F.count(F.lit(1)).alias("_c"), F.min("_sid").alias("_sid"), F.min("pos").alias("pos"))
    return rare.unionByName(again.filter(F.col("_c") < min_count).select("_sid", "pos"))


def window_hash(g: Column) -> Column:
    return F.xxhash64(g)


def covered(size: Column, begins: Column, n: int) -> Column:
    """0/1 per word of a sentence of ``size`` words: is it in a window of ``n``
    that begins at a position of ``begins``?"""
    @F.arrow_udf("array<int>")
    def run(size: pa.Array, begins: pa.Array) -> pa.Array:
        end = np.cumsum(size.to_numpy(zero_copy_only=False), dtype=np.int64)
        start = np.concatenate([[0], end])
        at = start[pc.list_parent_indices(begins).to_numpy(zero_copy_only=False)] + pc.list_flatten(begins).to_numpy(zero_copy_only=False)
        turns = np.bincount(at, minlength=start[-1] + 1) - np.bincount(at + n, minlength=start[-1] + 1)
        hit = (np.cumsum(turns)[:-1] > 0).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(start.astype(np.int32)), pa.array(hit))
    return run(size, begins)


def flagged_tokens(sent: DataFrame, folded: DataFrame, n: int, keys=SENT_KEYS, out: str = "pred") -> DataFrame:
    """The tokens of ``sent`` with 1 for those in a window of ``n`` that starts
    at a position in ``folded``'s ``_rare``, else 0."""
    j = sent.join(folded, list(keys), "left")
    t = j.select(*keys, "words", "labels", F.explode(_flag_rows(n)).alias("_t"))
    pos = F.col("_t.pos")
    return t.select(*keys, pos.alias("pos"), F.get("words", pos).alias("word"), F.get("labels", pos).alias("label"),
                    F.col("_t.f").alias(out))


def rare_ngram_flags(sent: DataFrame, ngram: DataFrame | int, n: int, keys=SENT_KEYS, case_sensitive: bool = False,
                     out: str = "preds") -> DataFrame:
    """A3 by sentence: ``(keys, words, preds)``, for the renderers."""
    if isinstance(ngram, int):
        s = own_ngram_flags(sent.select(*keys, "words"), (n,), ngram, keys, case_sensitive)
        return s.withColumnRenamed(f"preds{n}", out)
    rare = known_ngrams(ngram_windows(sent, n, keys, case_sensitive), ngram, known=False)
    folded = rare.groupBy(*keys).agg(F.collect_list("pos").alias("_rare"))
    return sent.select(*keys, "words").join(folded, list(keys), "left") \
        .select(*keys, "words", F.transform(F.sort_array(_flag_rows(n)), lambda x: x["f"]).alias(out))


def _flag_rows(n: int):
    """(position, flag) of every word: the covered positions and, as a set
    difference, the others; linear in the sentence."""
    covered = F.array_distinct(F.flatten(F.transform("_rare", lambda p: F.sequence(p, p + (n - 1)))))
    every = F.sequence(F.lit(0), F.size("words") - 1)

    def marked(hit):
        return F.concat(F.transform(hit, lambda p: F.struct(p.alias("pos"), F.lit(1).alias("f"))),
                        F.transform(F.array_except(every, hit), lambda p: F.struct(p.alias("pos"), F.lit(0).alias("f"))))
    return let(F.coalesce(covered, F.array().cast("array<int>")), marked)


def detect_spans(sent: DataFrame, pattern: str = P.GOLD, keys=SENT_KEYS, text: str = "sent") -> DataFrame:
    """A4 (re-aimed from a remote tagger): character spans of the rule matches
    on the raw sentence, ``(keys, span_id, span, s_begin, s_end)``."""
    m = F.when(F.regexp_like(F.col(text), F.lit(pattern)), match_bounds(F.col(text), pattern))
    return sent.select(*keys, F.posexplode(m).alias("span_id", "s")) \
        .select(*keys, "span_id", F.col("s.m").alias("span"), F.col("s.b").alias("s_begin"),
                F.col("s.e").alias("s_end"))


def project_spans(sent: DataFrame, spans: DataFrame, keys=SENT_KEYS, text: str = "sent",
                  out: str = "preds") -> DataFrame:
    """A5: ``(keys, preds)``: every token overlapping a span gets 1.  The
    interval join keeps its equi keys: spans are folded per sentence (bounded
    by the sentence) and joined one-to-one to the sentence's token offsets (the
    text itself isn't moved), then a sorted sweep inside the row finds the
    overlaps — no token x span pairs are formed."""
    empty = F.array().cast("array<struct<b:int,e:int>>")

    def offsets(bounds):
        return F.transform(bounds, lambda t: F.struct(t["b"].alias("b"), t["e"].alias("e")))
    folded = spans.groupBy(*keys).agg(F.collect_list(F.struct(F.col("s_begin").alias("b"),
                                                             F.col("s_end").alias("e"))).alias("_sp"))
    j = sent.select(*keys, offsets(TX.raw_token_bounds(F.col(text))).alias("_b")).join(folded, list(keys), "left")
    flags = overlap_flags(F.col("_b"), F.coalesce("_sp", empty))
    return j.select(*keys, F.transform(flags, lambda f: f.cast("int")).alias(out))


def annotate_spans(sent: DataFrame, pattern: str, out: str = "preds", text: str = "sent") -> DataFrame:
    """A4+A5 without the span table: the row-local form of the same rule.
    Matches and tokens are found by Spark, as lengths without white space; their
    overlaps are a search in running sums per Arrow batch."""
    ship_package(sent.sparkSession)
    t = F.col(text)

    def lengths(pieces):
        return F.transform(pieces, lambda x: F.length(F.regexp_replace(x, r"\s+", "")))
    tokens = F.transform(F.regexp_extract_all(t, F.lit(P.TOKEN), 0), F.length)
    found = F.when(TX.can_match(t, pattern), F.regexp_extract_all(t, F.lit(pattern), 0)).otherwise(F.array().cast("array<string>"))
    gaps = F.when(TX.can_match(t, pattern), F.split(t, pattern, -1)).otherwise(F.array().cast("array<string>"))
    return sent.withColumn(out, overlapping(tokens, lengths(gaps), lengths(found)))


def overlapping(tokens: Column, gaps: Column, spans: Column) -> Column:
    """0/1 per token: does it share a place with a span?  ``tokens``: the token
    lengths of a text without its white space; ``spans``: those of its spans in
    order, ``gaps``: of what lies before each (and after the last)."""
    @F.arrow_udf("array<int>")
    def run(tokens: pa.Array, gaps: pa.Array, spans: pa.Array) -> pa.Array:
        def flat(lists):
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            return size, pc.list_flatten(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        size, width = flat(tokens)
        end = np.cumsum(width)
        row = np.concatenate([[0], np.cumsum(size)])
        base = np.concatenate([[0], end])[row[:-1]]          # where each text starts
        n, length = flat(spans)
        n_gaps, gap = flat(gaps)
        first = np.repeat(np.cumsum(n_gaps) - n_gaps, n) + np.arange(len(length)) - np.repeat(np.cumsum(n) - n, n)
        step = np.cumsum(gap[first] + length)
        before = np.concatenate([[0], step])[np.cumsum(n) - n]
        stop = step - np.repeat(before - base, n)
        begin = stop - length
        at = np.searchsorted(begin, end, side="left") - 1       # the last span that begins before the token's end
        hit = np.zeros(len(width), dtype=np.int32)
        some = at >= 0
        hit[some] = stop[at[some]] > (end - width)[some]
        mask = pc.is_null(tokens).to_numpy(zero_copy_only=False)
        offsets = pa.array(row.astype(np.int32), mask=np.append(mask, False)) if mask.any() else pa.array(row.astype(np.int32))
        return pa.ListArray.from_arrays(offsets, pa.array(hit))
    return run(tokens, gaps, spans)


def score_batches(sent: DataFrame, predict_fn, keys=SENT_KEYS, words: str = "words", out: str = "ptrs",
                  max_pointers: int | None = None) -> DataFrame:
    """Score the sentences of an Arrow batch with a user sequence annotator
    ``predict_fn(list[list[str]]) -> list[iterable[int]]`` (positions to mask,
    per sentence).  All positions are kept, de-duplicated and sorted, unless a
    decoder's limit is given as ``max_pointers``; the result feeds
    ``pointers_to_mask`` (T12).  Anything ``predict_fn`` needs (model weights)
    is captured once per task."""
    from pyspark.sql import types as ST
    schema = sent.select(*keys, words).schema.add(out, ST.ArrayType(ST.IntegerType()))

    def run(batches):
        for pdf in batches:
            found = predict_fn([list(ws) for ws in pdf[words]])
            pdf[out] = [sorted(set(list(p)[:max_pointers])) for p in found]
            yield pdf
    # the sentence rows pass through the Python worker unchanged, so no join back
    return sent.select(*keys, words).mapInPandas(run, schema)


def digit_or_mail_positions(sentences):
    """A small position annotator for tests and the registered query: words
    holding an ASCII digit or an ``@``, in order."""
    return [[i for i, w in enumerate(words) if any(c in "0123456789@" for c in w)] for words in sentences]
