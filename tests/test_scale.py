"""The shuffle-lean forms of operators equal the plain ones."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmask.operators import annotate as A
from quillmask.operators import features as FEAT
from quillmask.operators import lookup as L
from quillmask.operators import models as M

SENT = "corpus string, doc_id long, sent_id int, words array<string>, labels array<int>"


def sentences(spark, n=60, seed=3):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        words = [r.choice("aAbBcdefgh") for _ in range(r.randint(1, 12))]
        rows.append((r.choice(["x", "y"]), i // 5, i % 5, words, [r.randint(0, 1) for _ in words]))
    return spark.createDataFrame(rows, SENT).repartition(5)


def plans(df):
    return df._jdf.queryExecution().toString()


def test_own_list_equals_a_given_one(spark):
    s = sentences(spark)
    for n in (1, 2, 3):
        for least in (1, 2, 3):
            want = A.annotate_rare_ngrams(s, A.ngram_counts(s, n, least), n)
            got = A.annotate_rare_ngrams(s, least, n)
            assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect())
    want = A.rare_ngram_flags(s, A.ngram_counts(s, 2, 2), 2)
    assert sorted(A.rare_ngram_flags(s, 2, 2).collect()) == sorted(want.collect())


def test_own_list_joins_no_windows(spark):
    s = sentences(spark)
    got = A.own_ngram_flags(s, (2, 3), 2)
    assert plans(got).split("== Physical Plan ==")[1].count("Join") == 1


def test_known_totals_equal_the_joins(spark):
    s = sentences(spark)
    w, lst = A.ngram_windows(s, 3), A.ngram_counts(s, 3, 2)
    row = A.known_totals(A.ngram_counts_by(s, 3, ("x", "y")), 2, 2).first()
    for known, got in ((True, row.known), (False, row.unknown)):
        per = {r.corpus: r.n for r in A.known_ngrams(w, lst, known).groupBy("corpus").agg(F.count(F.lit(1)).alias("n")).collect()}
        assert got == [per.get("x", 0), per.get("y", 0)]


def test_directions_are_removed_in_place(spark):
    """Documents over several batches, repeated keys, null keys."""
    r = np.random.default_rng(0)
    rows = [("x" if i % 2 else None if i % 40 == 0 else "y", int(i // 9) if i % 31 else None, int(i % 9), r.normal(size=5).tolist()) for i in range(400)]
    rows += rows[:30]
    df = spark.createDataFrame(rows, "corpus string, doc_id long, sent_id int, sv array<double>")
    want = FEAT.remove_first_direction(df).collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        for held in (0, 64_000_000):
            FEAT.HELD_BYTES = held
            got = FEAT.remove_first_direction(FEAT.by_document(df), together=True)
            assert "Join" not in plans(got)
            got = got.collect()
            assert len(got) == len(want) and got[0].__fields__ == want[0].__fields__
            key = lambda x: (*x[:3], [round(v, 6) + 0.0 for v in x.sv])
            assert np.allclose([key(x)[3] for x in sorted(got, key=key)], [key(x)[3] for x in sorted(want, key=key)], atol=1e-5)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        FEAT.HELD_BYTES = 64_000_000


def test_copies_of_a_key_are_joined_to_each_other(spark):
    s = sentences(spark, 20)
    s = s.unionByName(s.limit(3))
    j = s.select("corpus", "doc_id", "sent_id", "words").join(s.select("corpus", "doc_id", "sent_id"), ["corpus", "doc_id", "sent_id"])
    got = FEAT.times_copies(FEAT.by_document(s)).select(*j.columns)
    assert sorted(got.collect()) == sorted(j.collect())


def test_vectors_meet_tokens_without_a_shuffle(spark):
    tok = spark.createDataFrame([("c", 1, 0, i, w) for i, w in enumerate("aBcab")], "corpus string, doc_id long, sent_id int, pos int, word string")
    vec = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 4.0])], "word string, v array<float>")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = L.lookup_vectors(tok, vec)
        assert "SortMergeJoin" not in plans(got)
        assert [r.v for r in sorted(got.collect(), key=lambda r: r.pos)] == [[1.0, 2.0], [3.0, 4.0], [0.0, 0.0], [1.0, 2.0], [3.0, 4.0]]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_pieces_are_summed_without_a_join(spark):
    wp = spark.createDataFrame([("abc", "abc"), ("abcd", "abc"), ("abcd", "bcd"), ("zz", "zz"), ("aaaa", "aaa"), ("aaaa", "aaa")], "word string, piece string")
    pv = spark.createDataFrame([("abc", [1.0, 2.0]), ("bcd", [0.5, 4.0]), ("aaa", [0.25, 8.0])], "word string, v array<float>")
    got = L.subword_vectors(wp, pv)
    assert "Join" not in plans(got)
    assert sorted(got.collect()) == sorted(L._joined_subwords(wp, pv).collect())


def test_null_vectors_and_null_numbers(spark):
    wp = spark.createDataFrame([("abc", "abc"), ("abcd", "abc"), ("abcd", "bcd"), ("zz", "zz")], "word string, piece string")
    for rows in ([("abc", [1.0, 2.0]), ("bcd", None)], [("abc", [1.0, 2.0]), ("abc", [1.0, 2.0])], [("abc", [1.0, None]), ("bcd", [0.5, 4.0])]):
        pv = spark.createDataFrame(rows, "word string, v array<float>")
        assert sorted(L.subword_vectors(wp, pv).collect(), key=str) == sorted(L._joined_subwords(wp, pv).collect(), key=str)
    assert FEAT.held_types(pv) is None


def typed(spark):
    """Tokens of two corpora, the same counted, and vectors of words and pieces (some missing, one null)."""
    words = ["abc", "Abc", "abcd", "zz", "bcda", "abc", "q", "zz", "abcd", "none"]
    tok = spark.createDataFrame([("x" if i % 3 else "y", w, int(i % 4 == 0)) for i, w in enumerate(words * 3)], "corpus string, word string, label int")
    counted = tok.groupBy("corpus", F.lower("word").alias("word"), "label").agg(F.count(F.lit(1)).alias("n"))
    wv = spark.createDataFrame([("abc", [1.0, 2.0]), ("zz", [3.0, 0.5]), ("q", None)], "word string, v array<float>")
    pv = spark.createDataFrame([("abc", [1.0, 0.25, 4.0]), ("bcd", [0.5, 1.0, 2.0]), ("q", [8.0, 1.0, 1.0])], "word string, v array<float>")
    return tok, counted, wv, pv


def test_type_vectors_meet_counted_words_without_a_shuffle(spark):
    tok, counted, wv, pv = typed(spark)
    wp = tok.select(F.lower("word").alias("word")).distinct().select("word", F.explode(L.char_trigrams(F.col("word"))).alias("piece"))
    joined, sent = L.combine_vectors([wv, L.subword_vectors(wp, pv)]), L.type_vectors(wv, L.sent_pieces(pv))
    for table, vectors in ((joined, sent), (wv, L.type_vectors(wv))):
        assert sorted(M.type_features(counted, vectors).collect()) == sorted(M.type_features(tok, table).collect())
        want = sorted(M.type_training_rows(tok, table).collect())
        assert sorted(M.type_training_rows(counted, vectors).collect()) == want
        written = M.type_training_rows(counted, vectors, written=True)
        assert sorted(written.drop("x").collect()) == want and all(list(r.features) == r.x for r in written.collect())
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" not in plans(M.type_training_rows(counted, sent))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_tables_that_cannot_be_sent(spark):
    _, _, wv, pv = typed(spark)
    assert L.type_vectors(wv.unionByName(wv.limit(1))) is None and L.type_vectors(wv.filter("false")) is None
    assert L.type_vectors(wv.filter("v is null")) is None
    assert L.sent_pieces(pv.unionByName(pv.limit(1))) is None


def test_counted_tokens_are_scored_as_tokens(spark):
    tok, counted, wv, _ = typed(spark)
    model = M.train_annotator(M.clf_gaussian_nb(), M.type_training_rows(tok, wv))
    feats = M.type_features(tok, wv)
    want = sorted(M.test_annotator(model, tok, feats).collect())
    assert sum(r.tp + r.fp + r.fn + r.tn for r in want) == 30 and sorted(M.test_annotator(model, counted, feats).collect()) == want


def test_trees_read_no_more_partitions_than_cores(spark, monkeypatch):
    tok, _, wv, _ = typed(spark)
    rows, seen = M.type_training_rows(tok, wv).repartition(64), []

    class Fitted:
        def __init__(self, stages):
            pass

        def fit(self, df):
            seen.append((df.rdd.getNumPartitions(), df.count()))
    monkeypatch.setattr(M, "Pipeline", Fitted)
    for est in (M.clf_random_forest(), M.clf_gbt(), M.clf_logreg()):
        M.train_annotator(est, rows)
    cores = spark.sparkContext.defaultParallelism
    assert [s[0] for s in seen] == [cores, cores, 64] and len({s[1] for s in seen}) == 1


def test_descent_reads_written_rows_and_writes_none(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame as Classic
    _, counted, wv, _ = typed(spark)
    rows = M.type_training_rows(counted, L.type_vectors(wv), written=True)
    monkeypatch.setattr(Classic, "checkpoint", lambda *a, **k: pytest.fail("rows written again"))
    assert len(M.train_annotator(M.clf_sgd(), rows).weights) == 2
    assert "UDF" not in plans(M.PS._arrays(rows)).split("== Physical Plan ==")[1]


def test_windows_that_share_a_hash_are_told_apart(spark, monkeypatch):
    """Rare windows are the same when the first hash is of no use, and what a
    size shuffles is text no more."""
    from quillmask.operators import annotate as A
    import random
    rng = random.Random(6)
    rows = [("c", d, i, [f"w{rng.randrange(14)}" for _ in range(2 + (d + i) % 9)]) for d in range(12) for i in range(5)]
    s = spark.createDataFrame(rows, "corpus string, doc_id long, sent_id int, words array<string>")
    plans, kept = [], A.stored
    monkeypatch.setattr(A, "stored", lambda df, *a: plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df, *a))

    def flags():
        return sorted((r.doc_id, r.sent_id, r.preds2, r.preds3) for r in A.own_ngram_flags(s, (2, 3), 2).collect())
    want = flags()
    assert any(1 in r[2] for r in want) and any(0 in r[2] for r in want)
    counted = [p for p in plans if "HashAggregate" in p and "Exchange" in p]
    assert counted and not any("keys=[g#" in p for p in counted)
    monkeypatch.setattr(A, "window_hash", lambda g: A.F.length(g).cast("long"))
    assert flags() == want


def test_written_tables_leave_no_shuffle_files(spark):
    from quillmask import session as SE
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        found = disk.getAllFiles()
        return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}
    before, own = files(), spark.conf.get(SE.CLEANUP, "false")
    df = SE.stored(spark.range(2000).repartition(5, "id"), "t")
    assert not files() - before
    assert df.count() == 2000 and spark.conf.get(SE.CLEANUP, "false") == own
