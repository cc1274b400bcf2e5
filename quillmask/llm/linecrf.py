"""Line sequence labelling: a linear-chain conditional random field (CRF)
marks every line content or boilerplate; the content share of a document's
words decides whether it is kept.

A line is described by binary features of its characters and words (shares of
letters, capitals, digits, symbols; repeats; first and last character; number
and length of words).  The CRF has a weight for each feature, for each pair of
neighbouring labels and for the first label, fitted by maximum conditional
likelihood (forward-backward gradients) on a bounded sample of documents with
a quality label, whose lines take the document's label; documents are joined
into sequences, so that changes of label occur.  Viterbi decoding gives the
most probable labels of a text's lines; all texts of a batch are decoded
together.

Before that, plain counts (``base``) reject texts that are too short or mostly
repeat themselves.

Defined results: a null or empty text has no words and fails the base; a line
without a word has no features, is neutral and has no share; with no labelled
document every line is content.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, prepared
from .hashing import NON_SPACE, Words, chunks, encoded, mixed

WINDOW = 5
MIN_WORDS, MAX_REPEATED = 10, 20
CONTENT_SHARE = 0.5
SYMBOLS = b"#*$%&|<>"

_is = lambda chars: np.isin(np.arange(256), list(chars))
ASCII = np.arange(256) < 128
UPPER, LOWER, DIGIT = _is(range(65, 91)), _is(range(97, 123)), _is(range(48, 58))
CODE_POINT = (np.arange(256) & 0xC0) != 0x80
CLASSES = {"char": CODE_POINT & NON_SPACE, "letter": (UPPER | LOWER | ~ASCII) & CODE_POINT, "upper": UPPER, "digit": DIGIT,
           "symbol": _is(SYMBOLS), "mark": NON_SPACE & ASCII & ~UPPER & ~LOWER & ~DIGIT, "code": _is(b"{}[]()=;\\/_~^@+")}
END_MARK = _is(b".!?\"')") | ~ASCII

#: (quantity, thresholds): a feature says that the quantity is over a threshold
THRESHOLDS = {"letter": (0.5, 0.7, 0.85), "upper": (0.1, 0.3, 0.6, 0.9), "digit": (0.02, 0.1, 0.3), "symbol": (0.0, 0.02, 0.05, 0.15),
              "mark": (0.05, 0.1, 0.2, 0.4), "code": (0.0, 0.05), "words": (1, 3, 8, 20), "length": (3, 5, 8, 12),
              "repeat": (0.05, 0.2, 0.5), "stutter": (0.05, 0.3)}
FLAGS = ("word", "ends", "capital", "again")
FEATURES = [*FLAGS, *(f"{k}>{t}" for k, ts in THRESHOLDS.items() for t in ts)]


@dataclass
class Lines:
    """A batch of texts: counts per text, features per line, and the lines'
    text index and words."""

    base: pd.DataFrame
    features: np.ndarray
    text: np.ndarray
    words: np.ndarray


def repeated_words(w: Words) -> np.ndarray:
    """Which words stand in a window that occurs twice or more in the text."""
    n = len(w.hash)
    at, h = w.windows(WINDOW)
    cover = np.zeros(n + 1, dtype=np.int64)
    if len(at):
        key = mixed(h + mixed(w.doc[at].astype(np.uint64)))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        np.add.at(cover, at[twice], 1)
        np.add.at(cover, at[twice] + WINDOW, -1)
    return np.cumsum(cover[:-1]) > 0


def described(texts: list[str | None]) -> Lines:
    raw = [encoded(t, lower=False) for t in texts]
    w = Words(raw, NON_SPACE)
    n = len(raw)
    # line starts: each text's, and after every newline inside it
    breaks = np.flatnonzero(w.data == 10)
    start = np.concatenate([[0], breaks[:-1] + 1]) if len(breaks) else np.zeros(0, dtype=np.int64)
    text = np.searchsorted(w.offset, start, side="right") - 1
    count = {k: np.add.reduceat(v[w.data].astype(np.int32), start) if len(start) else np.zeros(0, np.int32) for k, v in CLASSES.items()}
    first = np.searchsorted(w.start, start)
    words = np.diff(np.append(first, len(w.start)))
    again = np.zeros(len(start), dtype=bool)
    at = 0
    for t in texts:
        seen: set[str] = set()
        for line in (t or "").split("\n"):
            again[at] = line in seen
            seen.add(line)
            at += 1
    again &= words > 0
    repeat = repeated_words(w)
    per_text = lambda v, of: np.bincount(of, weights=v, minlength=n).astype(np.int64)
    base = pd.DataFrame({"n_words": np.diff(w.first).astype(np.int64), "word_chars": per_text(count["char"], text),
                         "n_symbols": per_text(count["symbol"], text), "n_dup_lines": per_text(again, text),
                         "n_repeat_words": per_text(repeat, w.doc)})
    line_of = np.repeat(np.arange(len(start)), words)
    per_line = lambda v: np.bincount(line_of, weights=v, minlength=len(start))
    stutter = np.zeros(len(w.hash))
    stutter[1:] = (w.hash[1:] == w.hash[:-1]) & (line_of[1:] == line_of[:-1])
    some, has = np.maximum(words, 1), words > 0
    chars = np.maximum(count["char"], 1)
    value = {k: count[k] / chars for k in ("letter", "digit", "symbol", "mark", "code")}
    value |= {"upper": count["upper"] / np.maximum(count["letter"], 1), "words": words, "length": count["char"] / some,
              "repeat": per_line(repeat) / some, "stutter": per_line(stutter) / some}
    head, tail = np.zeros(len(start), np.uint8), np.zeros(len(start), np.uint8)
    head[has] = w.data[w.start[first[has]]]
    tail[has] = w.data[w.end[first[has] + words[has] - 1] - 1]
    columns = [np.ones(len(start)), END_MARK[tail], UPPER[head] | ~ASCII[head], again]
    columns += [value[k] > t for k, ts in THRESHOLDS.items() for t in ts]
    features = np.stack(columns, axis=1).astype(np.float32) if len(start) else np.zeros((0, len(FEATURES)), np.float32)
    features[~has] = 0
    return Lines(base, features, text, words)


@dataclass
class Crf:
    """``weight``: score of content against boilerplate per feature; ``step``
    [from, to] and ``start`` of the labels 0 (boilerplate) and 1 (content)."""

    weight: np.ndarray
    step: np.ndarray
    start: np.ndarray

    def decode(self, features: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Viterbi labels of lines; ``text`` ascending, a sequence each.  All
        sequences advance together, longest first."""
        emit = features @ self.weight
        n = np.bincount(text) if len(text) else np.zeros(0, np.int64)
        n = n[n > 0]
        if not len(n):
            return np.zeros(0, dtype=np.int8)
        order = np.argsort(-n, kind="stable")
        begin, size = (np.cumsum(n) - n)[order], n[order]
        back = np.zeros((len(text), 2), dtype=np.int8)
        label = np.zeros(len(text), dtype=np.int8)
        score = np.repeat(self.start[None, :], len(n), axis=0).astype(float)
        score[:, 1] += emit[begin]
        active = np.searchsorted(-size, -np.arange(int(size[0])), side="left")
        for i in range(1, int(size[0])):
            a = active[i]
            options = score[:a, :, None] + self.step[None]
            pick = options.argmax(axis=1)
            score[:a] = options.max(axis=1)
            score[:a, 1] += emit[begin[:a] + i]
            back[begin[:a] + i] = pick
        now = score.argmax(axis=1)
        for i in range(int(size[0]) - 1, -1, -1):
            a = active[i]
            label[begin[:a] + i] = now[:a]
            now[:a] = back[begin[:a] + i, now[:a]]
        return label


def fit(sequences: list[tuple[np.ndarray, np.ndarray]], turns: int = 300, rate: float = 0.1, penalty: float = 1e-3) -> Crf:
    """Maximum conditional likelihood by Adam; the expected counts come from
    forward and backward passes over all sequences at once."""
    d = len(FEATURES)
    theta = np.zeros(d + 6)
    if not sequences:
        theta[d + 5] = 1.0                      # no evidence: content
        return Crf(theta[:d], theta[d:d + 4].reshape(2, 2), theta[d + 4:])
    width, longest = len(sequences), max(len(y) for _, y in sequences)
    x = np.zeros((longest, width, d), dtype=np.float32)
    y, mask = np.zeros((longest, width), dtype=np.int64), np.zeros((longest, width), dtype=bool)
    for k, (f, labels) in enumerate(sequences):
        x[:len(labels), k], y[:len(labels), k], mask[:len(labels), k] = f, labels, True
    total = mask.sum()
    m = v = np.zeros_like(theta)
    both = mask[1:] & mask[:-1]
    truth = np.concatenate([np.einsum("ls,lsd->d", (y * mask).astype(float), x),
                            np.array([(both & (y[:-1] == a) & (y[1:] == b)).sum() for a in (0, 1) for b in (0, 1)], dtype=float),
                            np.bincount(y[0], minlength=2).astype(float)])
    lse = lambda z, axis: (t := z.max(axis=axis)) + np.log(np.exp(z - np.expand_dims(t, axis)).sum(axis=axis))
    for turn in range(1, turns + 1):
        step, start = theta[d:d + 4].reshape(2, 2), theta[d + 4:]
        emit = np.zeros((longest, width, 2))
        emit[:, :, 1] = x @ theta[:d]
        alpha, beta = np.zeros((longest, width, 2)), np.zeros((longest, width, 2))
        alpha[0] = start + emit[0]
        for i in range(1, longest):
            nxt = lse(alpha[i - 1][:, :, None] + step, 1) + emit[i]
            alpha[i] = np.where(mask[i][:, None], nxt, alpha[i - 1])
        for i in range(longest - 2, -1, -1):
            prev = lse(step[None] + (emit[i + 1] + beta[i + 1])[:, None, :], 2)
            beta[i] = np.where(mask[i + 1][:, None], prev, 0)
        z = lse(alpha[-1], 1)
        one = np.exp(alpha + beta - z[None, :, None]) * mask[:, :, None]
        pair = np.exp(alpha[:-1, :, :, None] + step + (emit[1:] + beta[1:])[:, :, None, :] - z[None, :, None, None]) * both[:, :, None, None]
        expected = np.concatenate([np.einsum("ls,lsd->d", one[:, :, 1], x), pair.sum(axis=(0, 1)).ravel(), one[0].sum(axis=0)])
        grad = (truth - expected) / total - penalty * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad ** 2
        theta = theta + rate * (m / (1 - 0.9 ** turn)) / (np.sqrt(v / (1 - 0.999 ** turn)) + 1e-8)
    return Crf(theta[:d], theta[d:d + 4].reshape(2, 2), theta[d + 4:])


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", quality: str = "quality", per_class: int = 256,
          lines_per_text: int = 40, chars_per_text: int = 8000, per_sequence: int = 8) -> Crf:
    """Fit on a bounded sample: per quality (0 or 1), of each of ``per_class``
    hash buckets the labelled id of least hash, at most ``lines_per_text``
    lines in ``chars_per_text`` characters of its text.  The sample is drawn
    from the labels alone; no text is shuffled for it."""
    rows = labels.select(F.col(doc_id).alias("id"), F.col(quality).cast("int").alias("q")).filter("q in (0, 1) and id is not null") \
        .withColumn("h", F.xxhash64("id"))
    least = rows.groupBy("q", F.pmod("h", F.lit(per_class)).alias("b")).agg(F.min("h").alias("h"))
    ids = least.join(rows, ["q", "h"]).select("id", "q", "h").distinct()    # a few per class and bucket at most
    picked = docs.select(F.col(doc_id).alias("id"), F.substring(F.col(text), 1, chars_per_text).alias("t")).filter("t is not null") \
        .join(F.broadcast(ids), "id").groupBy("q", "h").agg(F.min("t").alias("t")).collect()
    sequences, part = [], []
    for r in sorted(picked, key=lambda r: (r.h, r.q)):
        lines = described(["\n".join(r.t.split("\n")[:lines_per_text])])
        part.append((lines.features, np.full(len(lines.features), r.q)))
        if len(part) == per_sequence:
            sequences.append(part)
            part = []
    sequences += [part] if part else []
    return fit([(np.concatenate([f for f, _ in s]), np.concatenate([y for _, y in s])) for s in sequences])


def judged(texts: list[str | None], model: Crf, share: float = CONTENT_SHARE) -> pd.DataFrame:
    out = []
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    for a, b in chunks(raw):
        lines = described(texts[a:b])
        label = model.decode(lines.features, lines.text)
        content = np.bincount(lines.text, weights=lines.words * label, minlength=b - a)
        base = lines.base
        base["base_failed"] = (base["n_words"] < MIN_WORDS) | (100 * base["n_repeat_words"] > MAX_REPEATED * base["n_words"])
        base["content_share"] = content / np.maximum(base["n_words"], 1)
        base["kept"] = ~base["base_failed"] & (base["content_share"] >= share)
        out.append(base)
    return pd.concat(out, ignore_index=True) if out else described([]).base.assign(base_failed=False, content_share=0.0, kept=False)


OUT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean"


def label_lines(docs: DataFrame, model: Crf, text: str = "text", share: float = CONTENT_SHARE) -> DataFrame:
    """``docs`` with the base counts, ``base_failed``, ``content_share`` and
    ``kept``; columns of those names are replaced."""
    spark = prepared(docs.sparkSession)
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf(OUT)
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for column in batches:
            yield judged(column.tolist(), held.value, share)

    tmp, = fresh(docs, "judged")
    out = docs.withColumn(tmp, judge(F.col(text)))
    for c in OUT.split(", "):
        out = out.withColumn(c.split()[0], F.col(tmp)[c.split()[0]])
    return out.drop(tmp)
