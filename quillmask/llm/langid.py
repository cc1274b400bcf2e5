"""Language identification by cross-parsing entropy.

A bounded sample of labelled text per language is indexed by a suffix
automaton.  A text is parsed greedily against each automaton: every phrase is
the longest match found in that language's sample (a byte that never occurs
there is a phrase of its own).  The language whose parse needs the fewest
phrases, normalised to bits per byte (``phrases * log2(sample bytes) / text
bytes``), wins.

The automata are flat transition tables, so a batch of texts is parsed with
one vectorised table lookup per byte position: all texts (cut into segments,
where the parse starts anew) times all languages advance together.

Defined results: a null text, and a text without a letter, is ``und`` with
score 0 and null rate; with no labelled text at all everything is ``und``;
ties between languages go to the smaller name; rows are judged one by one, so
repeated rows get equal results.
"""
from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, give_back, prepared

UND = "und"
SEGMENT = 1024          # bytes of a segment; the parse starts anew at each
CHUNK = 2_000_000       # normalised bytes parsed together
NOT_LETTERS = re.compile(r"[\W\d_]+")


def normalised(text: str | None) -> bytes:
    """Lower-case letters, every other run one space, as UTF-8; empty if the
    text has no letter."""
    if not text:
        return b""
    s = NOT_LETTERS.sub(" ", text.lower())
    if not any(c.isalpha() for c in s):
        return b""
    return s.encode("utf-8", "replace")


def suffix_automaton(data: bytes) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of ``data`` (state 0 is the root)."""
    step: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in data:
        cur = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = cur
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return step


@dataclass
class LanguageModel:
    """``table[state + class]``: the next state, or the complement (negative)
    of the state after a phrase has begun anew.  States are premultiplied by
    the number of byte classes; ``start`` holds each language's dead state."""

    langs: list[str]
    byte_class: np.ndarray
    table: np.ndarray
    start: np.ndarray
    bits: np.ndarray

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """Number of phrases per (language, text)."""
        out = np.zeros((len(self.langs), len(texts)), dtype=np.int64)
        lens = np.array([len(t) for t in texts], dtype=np.int64)
        n_segments = -(-lens // SEGMENT)
        total = int(n_segments.sum())
        if not total or not self.langs:
            return out
        codes = self.byte_class[np.frombuffer(b"".join(texts), dtype=np.uint8)]
        of = np.repeat(np.arange(len(texts)), n_segments)
        nth = np.arange(total) - np.repeat(np.cumsum(n_segments) - n_segments, n_segments)
        begin = np.repeat(np.cumsum(lens) - lens, n_segments) + nth * SEGMENT
        size = np.minimum(lens[of] - nth * SEGMENT, SEGMENT)
        order = np.argsort(-size, kind="stable")
        of, pos, size = of[order], begin[order], size[order]
        state = np.repeat(self.start[:, None], total, axis=1).astype(np.int32)
        count = np.zeros(state.shape, dtype=np.int32)
        # how many segments are longer than i
        active = np.searchsorted(-size, -np.arange(int(size[0])), side="left")
        for i, a in enumerate(active):
            s = state[:, :a] + codes[pos[:a] + i]
            e = self.table.take(s)
            anew = e >> 31
            count[:, :a] -= anew
            state[:, :a] = e ^ anew
        for k in range(len(self.langs)):
            out[k] = np.bincount(of, weights=count[k], minlength=len(texts)).astype(np.int64)
        return out

    def predict(self, texts: Iterable[str | None]) -> pd.DataFrame:
        """Texts are taken as they are needed, so at most ``CHUNK`` normalised
        bytes (or one text) are held beside the results."""
        found = [self.judged(parts) for parts in grouped(map(normalised, texts))]
        return pd.DataFrame({name: np.concatenate([f[k] for f in found]) if found else np.zeros(0, kind)
                             for k, (name, kind) in enumerate((("lang_pred", object), ("score", float), ("rate", float)))})

    def judged(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lang = np.full(len(parts), UND, dtype=object)
        score = np.zeros(len(parts))
        rate = np.full(len(parts), np.nan)
        if not self.langs:
            return lang, score, rate
        n = np.array([len(p) for p in parts])
        bits = self.phrases(parts) * self.bits[:, None] / np.maximum(n, 1)
        best = bits.argmin(axis=0)
        cols = np.arange(len(parts))
        low = bits[best, cols]
        if len(self.langs) > 1:
            bits[best, cols] = np.inf
            second = bits.min(axis=0)
            gap = 1 - low / np.where(second > 0, second, 1)
        else:
            gap = np.maximum(0.0, 1 - low / 8)
        has = n > 0
        lang[has] = np.array(self.langs, dtype=object)[best[has]]
        score[has] = gap[has]
        rate[has] = low[has]
        return lang, score, rate


def grouped(parts: Iterable[bytes]) -> Iterator[list[bytes]]:
    """Groups of about ``CHUNK`` bytes."""
    held, size = [], 0
    for p in parts:
        if held and size + len(p) > CHUNK:
            yield held
            held, size = [], 0
        held.append(p)
        size += len(p)
    if held:
        yield held


def build_model(samples: dict[str, bytes]) -> LanguageModel:
    langs = sorted(k for k, v in samples.items() if v)
    seen = sorted(set(b"".join(samples[k] for k in langs)))
    width = len(seen) + 1                       # the last class: bytes never seen
    byte_class = np.full(256, width - 1, dtype=np.int32)
    byte_class[seen] = np.arange(len(seen))
    tables, start, base = [], [], 0
    for lang in langs:
        step = suffix_automaton(samples[lang])
        dead = len(step)
        anew = np.full(width, ~(base + dead * width), dtype=np.int64)
        for c, t in step[0].items():
            anew[byte_class[c]] = ~(base + t * width)
        rows = np.tile(anew, (dead + 1, 1))
        s = np.repeat(np.arange(dead), [len(d) for d in step])
        c = byte_class[np.fromiter((c for d in step for c in d), dtype=np.int64, count=len(s))]
        rows[s, c] = base + np.fromiter((t for d in step for t in d.values()), dtype=np.int64, count=len(s)) * width
        tables.append(rows.ravel().astype(np.int32))
        start.append(base + dead * width)
        base += rows.size
    return LanguageModel(langs, byte_class, np.concatenate(tables) if tables else np.zeros(0, np.int32),
                         np.array(start, dtype=np.int64), np.array([math.log2(len(samples[k]) + 1) for k in langs]))


def labelled_sample(docs: DataFrame, texts_per_lang: int = 64, chars_per_text: int = 2048,
                    bytes_per_lang: int = 32_768) -> dict[str, bytes]:
    """The bounded training sample: of each language, the distinct texts with
    the smallest hash in each of ``texts_per_lang`` hash buckets, at most
    ``chars_per_text`` characters of each, ``bytes_per_lang`` bytes in all.
    The hash minima are aggregated map-side, so a language that holds most
    rows costs no more than another."""
    labelled = docs.select(F.col("lang").alias("lang"), F.col("text").alias("text")) \
        .filter(F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}")) \
        .withColumn("h", F.xxhash64("text"))
    picked = labelled.groupBy("lang", F.pmod("h", F.lit(texts_per_lang)).alias("b")).agg(F.min("h").alias("h"))
    rows = labelled.join(F.broadcast(picked.select("lang", "h")), ["lang", "h"], "left_semi") \
        .groupBy("lang", "h").agg(F.min(F.substring("text", 1, chars_per_text)).alias("text")).collect()
    out: dict[str, bytes] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.h)):
        have = out.get(r.lang, b"")
        out[r.lang] = (have + b" " + normalised(r.text))[:bytes_per_lang]
    return out


def train(docs: DataFrame, **bounds: int) -> LanguageModel:
    """Fit on the columns ``text`` and ``lang`` of ``docs``."""
    return build_model(labelled_sample(docs, **bounds))


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (how much better than the second
    language, 0 to 1) and ``rate`` (bits per byte of the winner); columns of
    those names are replaced."""
    spark = prepared(docs.sparkSession)
    held = spark.sparkContext.broadcast(model)

    # Arrow's texts one by one: a batch of 10,000 is not copied whole
    @F.arrow_udf("lang_pred string, score double, rate double")
    def judged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            out = held.value.predict(x.as_py() for x in column)
            give_back()
            yield pa.StructArray.from_arrays(
                [pa.array(out["lang_pred"], pa.string()), pa.array(out["score"], pa.float64(), from_pandas=False),
                 pa.array(out["rate"].to_numpy(), pa.float64(), from_pandas=False)], names=list(out.columns))

    tmp, = fresh(docs, "lid")
    out = docs.withColumn(tmp, judged(F.col(text)))
    for c in ("lang_pred", "score", "rate"):
        out = out.withColumn(c, F.col(tmp)[c])
    return out.withColumn("rate", F.when(~F.isnan("rate"), F.col("rate"))).drop(tmp)


def fold(doc_id: Column | str) -> Column:
    """The contract's fold of a document: crc32 of its id as text, mod 5."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 if isinstance(doc_id, str) \
        else F.crc32(doc_id.cast("string").cast("binary")) % 5
