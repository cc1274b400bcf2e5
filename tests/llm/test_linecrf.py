import random
import re
from collections import Counter
from itertools import product

import numpy as np

from quillmask.llm import linecrf as C

DOCS = "doc_id long, text string"


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if grams[tuple(words[i:i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered))


def corpus():
    rng = random.Random(0)
    w = ["the", "é", "日本", "a#b", "$$", "of ", "\t", "\x0b", "\x1c", "\xa0", "x\ry", "\n", "\n\n", "Oneaea"]
    out = [None, "", " ", "\n\n\n", "a b c d e a b c d e", "a a a a a a", "a b c d\ne a b c d e f", "x\nx\nx \nx", "one two three four five"]
    out += [" ".join(rng.choice(w) for _ in range(rng.randint(1, 120))) for _ in range(200)]
    return out


def test_base_counts():
    texts = corpus() + ["w%d " % 3 * 30000]
    base = C.described(texts).base
    assert [tuple(r) for r in base.itertuples(index=False)] == [plain(t) for t in texts]


def test_viterbi_is_the_best_labelling():
    rng = np.random.default_rng(0)
    model = C.Crf(rng.normal(size=len(C.FEATURES)), rng.normal(size=(2, 2)), rng.normal(size=2))
    text = np.repeat([0, 1, 3, 4], [1, 7, 4, 9])
    f = rng.random((len(text), len(C.FEATURES))).astype(np.float32)
    got = model.decode(f, text)
    emit = f @ model.weight
    for t in np.unique(text):
        own = emit[text == t]

        def score(y):
            return model.start[y[0]] + sum(model.step[a, b] for a, b in zip(y, y[1:])) + sum(e for e, a in zip(own, y) if a)
        best = max(product((0, 1), repeat=len(own)), key=score)
        assert tuple(got[text == t]) == best


def test_fit_learns_sticky_labels():
    rng = np.random.default_rng(1)
    seqs = []
    for _ in range(20):
        y = np.repeat(rng.integers(0, 2, 6), 8)
        f = np.zeros((len(y), len(C.FEATURES)), np.float32)
        f[:, 3] = rng.random(len(y)) < np.where(y == 1, 0.8, 0.2)
        f[:, 0] = 1
        seqs.append((f, y))
    model = C.fit(seqs)
    right = np.mean(np.concatenate([model.decode(f, np.zeros(len(y), int)) == y for f, y in seqs]))
    alone = np.mean(np.concatenate([(f[:, 3] > 0) == y for f, y in seqs]))
    assert right > alone + 0.08


def test_held_out_documents(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    held = "pmod(xxhash64(text), 4) = 0"
    model = C.train(docs.filter(f"not {held}"), labels)
    out = C.label_lines(docs.join(labels, "doc_id").filter(held), model).select("quality", "kept", "base_failed").collect()
    good, bad = [r for r in out if r.quality == 1 and not r.base_failed], [r for r in out if r.quality == 0]
    assert len(good) > 300 and len(bad) > 50
    assert sum(r.kept for r in good) / len(good) > 0.99
    assert sum(not r.kept for r in bad) / len(bad) > 0.9


def test_mixed_document_and_edge_cases(frame, spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = C.train(docs, labels)
    rows = [(i, t) for i, t in enumerate(corpus())] + [(None, None)]
    got = C.label_lines(frame([(*r, "x") for r in rows], DOCS + ", kept string"), model).collect()
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got} == {i: plain(t) for i, t in rows}
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept)
    assert C.label_lines(frame([], DOCS), model).count() == 0
    nothing = C.train(docs, labels.filter("false"))
    assert C.judged(["a plain line of ten words is kept as it is here"], nothing)["kept"].tolist() == [True]
