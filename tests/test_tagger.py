"""The learned annotators against brute force."""
import itertools
import random

import pytest
from pyspark.sql import functions as F

from quillmask.operators import tagger as TG

SENT = "corpus string, doc_id long, sent_id int, words array<string>, labels array<int>"


def test_viterbi_equals_all_label_sequences(spark):
    rng = random.Random(1)
    start, chain = (-0.3, -1.4), ((-0.2, -1.7), (-0.9, -0.5))
    rows = [(i, [(rng.uniform(-4, 0), rng.uniform(-4, 0)) for _ in range(rng.randint(1, 9))]) for i in range(80)]
    df = spark.createDataFrame(rows, "i int, e array<struct<e0: double, e1: double>>")
    got = {r.i: r.p for r in df.select("i", TG.viterbi(F.col("e"), start, chain).alias("p")).collect()}
    for i, e in rows:
        def score(path):
            return start[path[0]] + e[0][path[0]] + sum(chain[a][b] + e[k + 1][b] for k, (a, b) in enumerate(zip(path, path[1:])))
        assert tuple(got[i]) == max(itertools.product((0, 1), repeat=len(e)), key=score)


def test_tagger_learns_shapes_and_neighbours(spark):
    rows = [("c", d, 0, ["Call", str(1000 + 7 * d), "now", "or", "see", "Ann" + "abcdefgh"[d % 8], "Lee"], [0, 1, 0, 0, 0, 1, 1]) for d in range(40)]
    sent = spark.createDataFrame(rows, SENT)
    t = TG.train(sent)
    fresh = spark.createDataFrame([("c", 1, 0, ["now", "99", "see", "Annz", "Lee"], [0] * 5), ("c", 1, 1, ["Lee"], [0])], SENT)
    got = {r.sent_id: r.preds for r in TG.tag(fresh, t, carried=("labels",)).collect()}
    assert got[0] == [0, 1, 0, 1, 1] and got[1] == [1]


def plain_spans(words, phrases):
    low = [w.lower() for w in words]
    hits = {(i, i + len(p)) for p in phrases for i in range(len(low) - len(p) + 1) if low[i:i + len(p)] == p}
    return {x for x in hits if not any(y != x and y[0] <= x[0] and y[1] >= x[1] for y in hits)}


@pytest.mark.parametrize("limit", [TG.LIST_WORDS, 0])
def test_phrase_spans_equal_all_windows(spark, limit):
    rng = random.Random(limit)
    phrases = [list(p) for p in {tuple(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(14)}]
    rows = [("c", i, 0, [rng.choice("abcdABC") for _ in range(rng.randint(1, 25))], [0]) for i in range(120)]
    sent = spark.createDataFrame(rows, SENT)
    df = spark.createDataFrame([(" ".join(p), len(p)) for p in phrases], "phrase string, n_words int")
    spans = TG.phrase_spans(sent, df, limit=limit)
    found = [(r.doc_id, r.w_begin, r.w_end) for r in spans.collect()]
    want = {(i, b, e) for _, i, _, ws, _ in rows for b, e in plain_spans(ws, phrases)}
    assert len(found) == len(set(found)) and set(found) == want
    marks = {r.doc_id: r.preds for r in TG.mark_spans(sent, spans).collect()}
    assert all(marks[i] == [int(any(d == i and b <= k < e for d, b, e in want)) for k in range(len(ws))] for _, i, _, ws, _ in rows)


def test_learned_phrases_are_the_labelled_runs(spark):
    sent = spark.createDataFrame([("c", 1, 0, ["A", "b", "C", "d", "e"], [1, 2, 0, 1, 1]), ("c", 2, 0, ["a", "B"], [1, 2]),
                                  ("c", 3, 0, ["x", "y"], [0, 0]), ("c", 4, 0, ["q", "r", "s"], [2, 2, 0])], SENT)
    got = {(r.phrase, r.n_words, r.n) for r in TG.learned_phrases(sent).collect()}
    assert got == {("a b", 2, 2), ("d", 1, 1), ("e", 1, 1), ("q r", 2, 1)}


def test_empty_list_and_no_sentences(spark):
    none = spark.createDataFrame([], "phrase string, n_words int")
    sent = spark.createDataFrame([("c", 1, 0, ["a"], [0])], SENT)
    assert TG.phrase_spans(sent, none).count() == 0
    assert TG.mark_spans(sent, TG.phrase_spans(sent, none)).first().preds == [0]
    assert TG.learned_phrases(sent.limit(0)).count() == 0


@pytest.mark.parametrize("limit", [TG.SYMBOLS, 0])
def test_sent_and_joined_symbols_give_the_same_labels(spark, limit):
    rng = random.Random(3)
    words = ["Call", "now", "see", "Ann", "Lee", "7", "2024", "né", "ÉTÉ", "x1"]
    rows = [("c", d, 0, [rng.choice(words) for _ in range(rng.randint(1, 30))]) for d in range(60)]
    sent = spark.createDataFrame([(*r, [int(w[0].isdigit() or w in ("Ann", "Lee")) for w in r[3]]) for r in rows], SENT)
    t = TG.train(sent.limit(40))
    # a sentence key that occurs twice, one that is null, an empty sentence
    odd = spark.createDataFrame([("c", 1, 0, ["Ann", "7"], [0, 0]), (None, 2, 0, ["7"], [0]), ("c", 99, 0, ["Zoë", "77", "unseen"], [0, 0, 0])], SENT)
    got = sorted((r.doc_id, r.words, r.preds) for r in TG.tag(sent.union(odd), t, limit=limit).collect())
    want = sorted((r.doc_id, r.words, r.preds) for r in TG._joined_tags(sent.union(odd), t, ["corpus", "doc_id", "sent_id"]).collect())
    assert got == want and len(got) == 62


def test_sentences_are_tagged_without_moving_them(spark):
    """Only keys are shuffled: the plan from the sentences to their labels has
    no exchange."""
    sent = spark.createDataFrame([("c", d, 0, ["Call", str(d)], [0, 1]) for d in range(9)], SENT)
    plan = TG.tag(sent, TG.train(sent))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_hashed_symbols_give_the_same_labels(spark):
    """A table too large to be sent as text: nothing but keys is shuffled."""
    rng = random.Random(5)
    words = ["Call", "now", "see", "Ann", "Lee", "7", "2024", "né", "ÉTÉ", "x1"]
    rows = [("c", d, 0, [rng.choice(words) for _ in range(rng.randint(0, 30))] + ["Zoë%d" % d] * (d % 7 == 0)) for d in range(60)]
    sent = spark.createDataFrame([(*r, [int(w[-1].isdigit() or w in ("Ann", "Lee")) for w in r[3]]) for r in rows], SENT)
    t = TG.train(sent.limit(40))
    shapes = t.emissions.filter("symbol like 's:%'").count()
    assert 0 < shapes < t.emissions.count()
    odd = spark.createDataFrame([("c", 99, 0, ["Zoë", "77", "unseen"], [0, 0, 0])], SENT)
    out = TG.tag(sent.union(odd), t, limit=shapes)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    got = sorted((r.doc_id, r.words, r.preds) for r in out.collect())
    assert got == sorted((r.doc_id, r.words, r.preds) for r in TG.tag(sent.union(odd), t).collect()) and len(got) == 61
    again = sorted((r.doc_id, r.words, r.preds) for r in TG.tag(sent.union(odd).union(odd), t, limit=shapes).collect())
    assert again == sorted((r.doc_id, r.words, r.preds) for r in TG.tag(sent.union(odd).union(odd), t).collect())
    assert TG.hashed_words(t.emissions, 1) is None
