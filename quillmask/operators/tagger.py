"""Annotators learned from labelled sentences (A4, A5, A7, A9):

* a hidden Markov tagger: counts by aggregation, Viterbi decoding as scans over
  the sentences of an Arrow batch;
* a phrase list: the gold phrases of the training sentences, found again by an
  Aho-Corasick automaton over words.
"""
from __future__ import annotations

import math
import re
from collections import deque
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from ..functions.arrays import let
from ..session import ship_package, stored
from ..sources.tables import SENT_KEYS
from .features import flat_words

KNOWN = 2                       # occurrences from which a word stands for itself
ALPHA = 0.1                     # added to every count
SYMBOLS = 1_500_000             # of a tagger, up to which they are sent to every executor
HASHED = 8_000_000              # words of a larger one, up to which their hashes are sent (12 bytes each)
DECODED = 500_000               # words that are decoded at once


# --- hidden Markov tagger -----------------------------------------------------------

def shape(word: Column) -> Column:
    """Runs of ASCII digits, small and capital letters and of other characters
    beyond ASCII as one sign each; all else as written."""
    out = F.regexp_replace(word, "[0-9]+", "9")
    for signs, sign in (("[a-z]+", "a"), ("[A-Z]+", "A"), ("[^\\x00-\\x7f]+", "x")):
        out = F.regexp_replace(out, signs, sign)
    return out


def known_symbol(word: Column) -> Column:
    return F.concat(F.lit("w:"), F.lower(word))


def shape_symbol(word: Column) -> Column:
    return F.concat(F.lit("s:"), shape(word))


def emission_counts(sent: DataFrame, known: int = KNOWN) -> DataFrame:
    """``(symbol, n0, n1)``: how often each symbol stands for a plain and for a
    sensitive word.  Words seen ``known`` times are their own symbol, rarer ones
    count for their shape.  Only types are joined, never tokens."""
    tok = sent.select(F.explode(F.arrays_zip(F.col("words").alias("w"), F.col("labels").alias("l"))).alias("t"))
    types = stored(tok.groupBy(F.col("t.w").alias("word"), (F.col("t.l") > 0).alias("hit")).agg(F.count(F.lit(1)).alias("n")), "word-types")
    types = types.select(known_symbol(F.col("word")).alias("own"), shape_symbol(F.col("word")).alias("shape"), "hit", "n") \
        .groupBy("own", "shape", "hit").agg(F.sum("n").alias("n"))
    often = types.groupBy("own").agg(F.sum("n").alias("total")).filter(F.col("total") >= known)
    symbol = F.when(F.col("total").isNotNull(), F.col("own")).otherwise(F.col("shape"))
    return types.join(often, "own", "left").groupBy(symbol.alias("symbol")).agg(
        F.sum(F.when(F.col("hit"), 0).otherwise(F.col("n"))).alias("n0"), F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0)).alias("n1"))


def transition_counts(sent: DataFrame) -> DataFrame:
    """``(before, after, n)`` of neighbouring labels; ``before`` is -1 at the
    start of a sentence.  Added up by Arrow batch, then by pair."""
    ship_package(sent.sparkSession)

    def run(batches):
        for batch in batches:
            size, hit = _sized(batch.column(0))
            before = np.append(-1, hit[:-1])[:len(hit)]
            before[(np.cumsum(size) - size)[size > 0]] = -1
            pair, n = np.unique(before * 2 + hit, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pair // 2, pa.int32()), pa.array(pair % 2, pa.int32()), pa.array(n, pa.int64())],
                                             names=["before", "after", "n"])
    hits = F.transform("labels", lambda x: F.when(x > 0, 1).otherwise(0))
    return sent.select(hits.alias("h")).mapInArrow(run, "before int, after int, n long").groupBy("before", "after").agg(F.sum("n").alias("n"))


def _sized(lists) -> tuple[np.ndarray, np.ndarray]:
    """Of an Arrow list column: length of each row, and all values."""
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return size, pc.list_flatten(lists).to_numpy(zero_copy_only=False)


@dataclass(frozen=True)
class Tagger:
    """Log probabilities: a table of symbols, and the two-state chain."""
    emissions: DataFrame            # symbol, e0, e1
    unseen: tuple[float, float]
    start: tuple[float, float]
    chain: tuple[tuple[float, float], tuple[float, float]]


def train(sent: DataFrame, known: int = KNOWN, alpha: float = ALPHA) -> Tagger:
    """Fits the tagger to ``sent`` (words, labels); six numbers and the totals
    reach the driver."""
    counts = emission_counts(sent, known).checkpoint(eager=True)
    t = counts.agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.count(F.lit(1)).alias("v")).first()
    size = [(t[f"n{s}"] or 0) + alpha * (t["v"] + 1) for s in (0, 1)]
    moves = {(r["before"], r["after"]): r["n"] for r in transition_counts(sent).collect()}

    def row(b: int) -> tuple[float, float]:
        total = sum(moves.get((b, s), 0) for s in (0, 1)) + 2 * alpha
        return tuple(math.log((moves.get((b, s), 0) + alpha) / total) for s in (0, 1))
    table = counts.select("symbol", *[F.log((F.col(f"n{s}") + alpha) / size[s]).alias(f"e{s}") for s in (0, 1)])
    return Tagger(table, tuple(math.log(alpha / size[s]) for s in (0, 1)), row(-1), (row(0), row(1)))


def _product(l, r):
    """Max-plus product of 2 x 2 matrices (a b / c d), each a row of four."""
    (a, b, c, d), (e, f, g, h) = l, r
    return np.stack([np.maximum(a + e, b + g), np.maximum(a + f, b + h), np.maximum(c + e, d + g), np.maximum(c + f, d + h)])


def best_labels(e0: np.ndarray, e1: np.ndarray, size: np.ndarray, start, chain) -> np.ndarray:
    """The most probable 0/1 labels of sentences of ``size`` words that follow
    each other in ``e0``, ``e1``.  The steps are max-plus matrices, so the best
    scores up to each word and from each word on are two log-step scans over
    all sentences at once; a word's label is the state of the better sum (0 on
    ties)."""
    (s0, s1), ((t00, t01), (t10, t11)) = start, chain
    done = np.arange(len(e0)) - np.repeat(np.cumsum(size) - size, size)
    left = np.repeat(size, size) - 1 - done
    first = done == 0
    up = np.stack([e0 + np.where(first, s0, t00), e1 + np.where(first, s1, t01), e0 + np.where(first, s0, t10), e1 + np.where(first, s1, t11)])
    down = up.copy()
    step, longest = 1, int(size.max()) if len(size) else 0
    while step < longest:
        i = np.flatnonzero(done >= step)
        up[:, i] = _product(up[:, i - step], up[:, i])
        i = np.flatnonzero(left >= step)
        down[:, i] = _product(down[:, i], down[:, i + step])
        step *= 2
    rest = np.zeros((2, len(e0)))
    i = np.flatnonzero(left > 0)
    rest[0, i], rest[1, i] = np.maximum(down[0, i + 1], down[1, i + 1]), np.maximum(down[2, i + 1], down[3, i + 1])
    return (up[1] + rest[1] > up[0] + rest[0]).astype(np.int32)


def _decoded(lists, e0: np.ndarray, e1: np.ndarray, start, chain):
    """``best_labels`` of an Arrow list column's rows, some words at a time."""
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.concatenate([[0], np.cumsum(size)])
    out, at = np.zeros(len(e0), dtype=np.int32), 0
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(row, row[at] + DECODED, side="right")) - 1)
        out[row[at]:row[to]] = best_labels(e0[row[at]:row[to]], e1[row[at]:row[to]], size[at:to], start, chain)
        at = to
    mask = np.append(pc.is_null(lists).to_numpy(zero_copy_only=False), False)
    return pa.ListArray.from_arrays(pa.array(row.astype(np.int32), mask=mask if mask.any() else None), pa.array(out))


def viterbi(emissions: Column, start, chain) -> Column:
    """The most probable 0/1 labels of ``array<struct<e0, e1>>``, by Arrow
    batch."""

    @F.arrow_udf("array<int>")
    def run(e: pa.Array) -> pa.Array:
        flat = pc.list_flatten(e)
        e0, e1 = (pc.struct_field(flat, i).to_numpy(zero_copy_only=False).astype(np.float64) for i in ("e0", "e1"))
        return _decoded(e, e0, e1, start, chain)
    return run(emissions)


SIGNS = [(re.compile("[0-9]+"), "9"), (re.compile("[a-z]+"), "a"), (re.compile("[A-Z]+"), "A"), (re.compile("[^\\x00-\\x7f]+"), "x")]


def _shape(word: str) -> str:
    """``shape`` of one word."""
    for signs, sign in SIGNS:
        word = signs.sub(sign, word)
    return word


def tag(sent: DataFrame, tagger: Tagger, keys=SENT_KEYS, carried=(), out: str = "preds", limit: int = SYMBOLS,
        hashed: int = HASHED) -> DataFrame:
    """``(keys, words, carried, preds)`` of every sentence without a
    null key.  A table of up to ``limit`` symbols is sent to the executors: the
    distinct words of an Arrow batch are looked up once and its sentences are
    decoded where they were read, nothing is shuffled but the keys, to find
    those that occur twice.  Of a larger table the words go as 64-bit hashes, up
    to ``hashed`` of them, and the shapes as written.  Sentences of one key are
    read as one, and a table larger than that is joined (``_joined_tags``)."""
    keys = list(keys)
    ship_package(sent.sparkSession)
    sent = sent.select(*keys, "words", *carried).dropna(subset=keys)
    table, words = tagger.emissions.select("symbol", "e0", "e1").limit(limit + 1).toArrow(), None
    if table.num_rows > limit:
        own = F.col("symbol").startswith("w:")
        table = tagger.emissions.filter(~own).select("symbol", "e0", "e1").limit(limit + 1).toArrow()
        words = hashed_words(tagger.emissions.filter(own), hashed)
        if table.num_rows > limit or words is None:
            return _joined_tags(sent, tagger, keys, carried, out)
    symbols = table.column("symbol").to_pylist()
    if len(set(symbols)) < len(symbols):
        return _joined_tags(sent, tagger, keys, carried, out)
    twice = stored(sent.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1").select(*keys), "repeated-keys")
    if not twice.head(1):
        return _held_tags(sent, tagger, symbols, table, out, words)
    return _held_tags(sent.join(twice, keys, "left_anti"), tagger, symbols, table, out, words) \
        .unionByName(_joined_tags(sent.join(twice, keys, "left_semi"), tagger, keys, carried, out))


def hashed_words(emissions: DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Of up to ``limit`` symbols: their sorted hashes, which of the distinct
    pairs (e0, e1) each has, and those as complex numbers.  They arrive in
    slices.  None of more symbols, or if two have one hash."""
    n = emissions.count()
    if n > limit:
        return None
    rows = emissions.select(F.xxhash64("symbol").alias("h"), "e0", "e1")
    parts = max(1, -(-n // 500_000))
    hashes, pairs = [], []
    for part in range(parts):
        got = rows.filter(F.pmod("h", F.lit(parts)) == part).toArrow()
        hashes.append(got.column("h").to_numpy())
        pairs.append(np.unique(got.column("e0").to_numpy() + 1j * got.column("e1").to_numpy(), return_inverse=True))
    kinds = np.unique(np.concatenate([p[0] for p in pairs]))
    which = np.concatenate([np.searchsorted(kinds, p[0]).astype(np.int32)[p[1]] for p in pairs])
    h = np.concatenate(hashes)
    order = np.argsort(h)
    h, which = h[order], which[order]
    return None if (h[1:] == h[:-1]).any() else (h, which, kinds)


def _held_tags(sent: DataFrame, tagger: Tagger, symbols: list[str], table, out: str, words: tuple | None = None) -> DataFrame:
    """The labels of sentences, each on its own, by a table that is sent; with
    ``words`` (``hashed_words``), that of the shapes."""
    start, chain, unseen = tagger.start, tagger.chain, tagger.unseen
    e = np.stack([np.append(table.column(f"e{s}").to_numpy(), unseen[s]) for s in (0, 1)])     # the last: neither listed
    if words is not None:
        e = np.concatenate([e, np.stack([words[2].real, words[2].imag])], axis=1)
    held = sent.sparkSession.sparkContext.broadcast((dict(zip(symbols, range(len(symbols)))), e, words and words[:2]))
    last = len(symbols)

    @F.arrow_udf("array<int>")
    def run(words: pa.Array, low: pa.Array) -> pa.Array:
        index, e, known = held.value
        which, distinct, _ = flat_words(words)
        if known is None:
            folded, names, _ = flat_words(low)
            at = np.array([index.get("w:" + w, -1) for w in names] or [-1], dtype=np.int64)[folded]
        else:
            h = pc.list_flatten(low).to_numpy(zero_copy_only=False)
            i = np.minimum(np.searchsorted(known[0], h), max(len(known[0]) - 1, 0))
            at = np.where(known[0][i] == h, last + 1 + known[1][i], -1) if len(known[0]) else np.full(len(h), -1)
        rare = np.flatnonzero(at < 0)
        if len(rare):
            kind, back = np.unique(which[rare], return_inverse=True)
            at[rare] = np.array([index.get("s:" + _shape(distinct[k]), last) for k in kind.tolist()], dtype=np.int64)[back]
        return _decoded(words, e[0][at], e[1][at], start, chain)
    second = F.lower if words is None else lambda w: F.xxhash64(known_symbol(w))
    return sent.withColumn(out, run("words", F.transform("words", second)))


def _joined_tags(sent: DataFrame, tagger: Tagger, keys, carried=(), out: str = "preds") -> DataFrame:
    """Words meet their log probabilities by joins on the symbol, sentences are
    folded once."""
    tok = sent.select(*keys, F.posexplode("words").alias("pos", "word"))
    own = tagger.emissions.select(F.col("symbol").alias("_own"), F.col("e0").alias("_w0"), F.col("e1").alias("_w1"))
    shapes = tagger.emissions.filter(F.col("symbol").startswith("s:")).select(F.col("symbol").alias("_shape"), F.col("e0").alias("_s0"), F.col("e1").alias("_s1"))
    j = tok.withColumns({"_own": known_symbol(F.col("word")), "_shape": shape_symbol(F.col("word"))}) \
        .join(own, "_own", "left").join(shapes, "_shape", "left")
    e = [F.coalesce(f"_w{s}", f"_s{s}", F.lit(tagger.unseen[s])).alias(f"e{s}") for s in (0, 1)]
    folded = j.select(*keys, "pos", *e).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "e0", "e1"))).alias("_e"))
    pred = folded.select(*keys, viterbi(F.col("_e"), tagger.start, tagger.chain).alias(out))
    return sent.select(*keys, "words", *carried).join(pred, list(keys))


# --- phrase list ----------------------------------------------------------------------

LIST_WORDS = 2_000_000          # words of a phrase list that is sent to every executor


def learned_phrases(sent: DataFrame, min_count: int = 1) -> DataFrame:
    """``(phrase, n_words, n)``: the runs of sensitive words of ``sent``, folded
    to lower case, with how often each occurs.  A label of 1 begins a new
    phrase, as does the first word after plain ones."""
    first = F.transform("labels", lambda x, i: (x > 0) & ((x == 1) | (i == 0) | (F.get("labels", F.greatest(i - 1, F.lit(0))) == 0)))
    runs = let(F.struct(first.alias("f"), F.transform("labels", lambda x: x > 0).alias("h"), F.transform("words", F.lower).alias("w")), _runs)
    return sent.select(F.explode(runs).alias("p")).groupBy(F.array_join("p", " ").alias("phrase"), F.size("p").alias("n_words")) \
        .agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)


def _runs(v):
    starts = F.filter(F.sequence(F.lit(0), F.size(v["w"]) - 1), lambda i: F.get(v["f"], i))
    stops = F.filter(F.sequence(F.lit(0), F.size(v["w"]) - 1), lambda i: F.get(v["f"], i) | ~F.get(v["h"], i))
    return let(F.struct(starts.alias("s"), stops.alias("e")), lambda b: F.transform(b["s"], lambda s: F.slice(
        v["w"], s + 1, F.coalesce(F.get(F.filter(b["e"], lambda e: e > s), F.lit(0)), F.size(v["w"])) - s)))


class Automaton:
    """Aho-Corasick over words, as flat arrays: ``keys`` (state * words + word,
    sorted) and ``to``, failure links, and for each state the length of the
    longest phrase that ends there (0: none)."""

    def __init__(self, phrases: list[list[str]]):
        self.words = sorted({w for p in phrases for w in p})
        number = {w: i for i, w in enumerate(self.words)}
        children: list[dict[int, int]] = [{}]
        longest = [0]
        for p in phrases:
            state = 0
            for w in p:
                nxt = children[state].get(number[w])
                if nxt is None:
                    nxt = len(children)
                    children[state][number[w]] = nxt
                    children.append({})
                    longest.append(0)
                state = nxt
            longest[state] = len(p)
        fail, queue = [0] * len(children), deque(children[0].values())
        while queue:
            state = queue.popleft()
            longest[state] = longest[state] or longest[fail[state]]
            for w, child in children[state].items():
                f = fail[state]
                while f and w not in children[f]:
                    f = fail[f]
                fail[child] = children[f].get(w, 0)
                queue.append(child)
        n = len(self.words)
        pairs = sorted((s * n + w, c) for s, ws in enumerate(children) for w, c in ws.items())
        self.keys, self.to = (np.array([p[i] for p in pairs], dtype=np.int64) for i in (0, 1))
        self.fail, self.longest = np.array(fail, dtype=np.int64), np.array(longest, dtype=np.int64)


def longest_matches(ids: list[int], n: int, goto: dict[int, int], fail: list[int], longest: list[int]) -> list[tuple[int, int]]:
    """The occurrences of phrases that lie in no longer one, as (begin, end)
    word positions; ``ids``: word numbers, -1 for words of no phrase."""
    state, found = 0, []
    for i, w in enumerate(ids):
        if w < 0:
            state = 0
            continue
        to = goto.get(state * n + w)
        while to is None and state:
            state = fail[state]
            to = goto.get(state * n + w)
        state = to or 0
        if longest[state]:
            found.append((i + 1 - longest[state], i + 1))
    out, least = [], 1 << 60
    for b, e in reversed(found):
        if b < least:
            out.append((b, e))
            least = b
    return out[::-1]


def phrase_spans(sent: DataFrame, phrases: DataFrame, keys=SENT_KEYS, limit: int = LIST_WORDS) -> DataFrame:
    """A4 by a learned list: ``(keys, w_begin, w_end)``, the occurrences
    (lower-cased words) of ``phrases`` (phrase, n_words) that lie in no longer
    one, each once; ``w_end`` is exclusive.  A list of up to ``limit`` words is
    sent as an automaton; a larger one is joined with the windows of its
    lengths, partitioned by the window."""
    spark = sent.sparkSession
    ship_package(spark)
    rows = phrases.select("phrase", "n_words").distinct()
    total = rows.agg(F.sum("n_words")).first()[0] or 0
    if total > limit:
        return _window_spans(sent, rows, keys)
    machine = Automaton([r["phrase"].split(" ") for r in rows.collect()])
    held = spark.sparkContext.broadcast(machine)
    schema = ST.StructType([*[sent.schema[k] for k in keys], ST.StructField("w_begin", ST.IntegerType()), ST.StructField("w_end", ST.IntegerType())])
    at = len(keys)

    def run(batches):
        m = held.value
        number, goto = {w: i for i, w in enumerate(m.words)}, dict(zip(m.keys.tolist(), m.to.tolist()))
        fail, longest, n = m.fail.tolist(), m.longest.tolist(), len(m.words)
        for batch in batches:
            which, distinct, size = flat_words(batch.column(at))
            ids = np.array([number.get(w, -1) for w in distinct] or [-1], dtype=np.int64)[which]
            end = np.cumsum(size)
            begin = end - size
            seen = np.concatenate([[0], np.cumsum(ids >= 0)])
            row, spans = [], []
            for i in np.flatnonzero(seen[end] > seen[begin]).tolist():      # sentences with a word of some phrase
                for span in longest_matches(ids[begin[i]:end[i]].tolist(), n, goto, fail, longest):
                    row.append(i)
                    spans.append(span)
            taken = batch.take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([*[taken.column(i) for i in range(at)], pa.array([b for b, _ in spans], pa.int32()),
                                              pa.array([e for _, e in spans], pa.int32())], names=[f.name for f in schema.fields])
    return sent.select(*keys, F.transform("words", F.lower).alias("words")).mapInArrow(run, schema)


def _window_spans(sent: DataFrame, phrases: DataFrame, keys) -> DataFrame:
    lengths = [r["n_words"] for r in phrases.select("n_words").distinct().collect()]
    low = sent.select(*keys, F.transform("words", F.lower).alias("words"))
    found = None
    for n in sorted(lengths):
        at = F.when(F.size("words") >= n, F.sequence(F.lit(0), F.size("words") - n)).otherwise(F.array().cast("array<int>"))
        windows = F.transform(at, lambda i: F.struct(i.alias("b"), F.array_join(F.slice("words", i + 1, n), " ").alias("g")))
        w = low.select(*keys, F.explode(windows).alias("x")).select(*keys, "x.b", "x.g")
        hit = w.join(phrases.filter(F.col("n_words") == n).select(F.col("phrase").alias("g")), "g", "left_semi") \
            .select(*keys, F.col("b").alias("b"), (F.col("b") + n).alias("e"))
        found = hit if found is None else found.unionByName(hit)
    folded = found.groupBy(*keys).agg(F.collect_set(F.struct("b", "e")).alias("_s"))
    free = F.filter("_s", lambda x: ~F.exists("_s", lambda y: (y["b"] <= x["b"]) & (y["e"] >= x["e"]) & (y != x)))
    return folded.select(*keys, F.explode(free).alias("x")).select(*keys, F.col("x.b").alias("w_begin"), F.col("x.e").alias("w_end"))


def mark_spans(sent: DataFrame, spans: DataFrame, keys=SENT_KEYS, carried=(), out: str = "preds") -> DataFrame:
    """A5 for word spans: ``(keys, words, carried, preds)``.  The spans of a
    sentence are folded and joined to it once; the flags are a set difference,
    linear in the sentence."""
    folded = spans.groupBy(*keys).agg(F.flatten(F.collect_list(F.sequence(F.col("w_begin"), F.col("w_end") - 1))).alias("_in"))
    j = sent.select(*keys, "words", *carried).join(folded, list(keys), "left")
    inside = F.coalesce(F.array_distinct("_in"), F.array().cast("array<int>"))
    every = F.sequence(F.lit(0), F.size("words") - 1)
    rows = let(inside, lambda hit: F.array_sort(F.concat(F.transform(hit, lambda p: F.struct(p.alias("p"), F.lit(1).alias("f"))),
                                                         F.transform(F.array_except(every, hit), lambda p: F.struct(p.alias("p"), F.lit(0).alias("f"))))))
    return j.select(*keys, "words", *carried, F.transform(rows, lambda x: x["f"]).alias(out))
