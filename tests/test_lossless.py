"""No caps, no lost characters, no clashing keys, Unicode spaces, held-out
sets that hold positives."""
import pytest
from pyspark.sql import functions as F

from quillmask.functions import text as TX
from quillmask.operators import annotate as A
from quillmask.operators import evaluate as E
from quillmask.operators import models as M
from quillmask.operators import text as T
from quillmask.plans import catalog as C
from quillmask.plans import fixtures as FX
from quillmask.session import scratch_path
from quillmask.sources import formats as FMT
from quillmask.sources.tables import corpora

SF = "/root/testdata/sf0.001"
TRICKY = ["€ und 日本", "left\u0001right 12", "tab\tand nbsp end", "plain"]


def test_every_sensitive_word_is_masked(spark):
    s = spark.createDataFrame([("c", 1, 0, [str(i) for i in range(30)] + ["x²"])], "corpus string, doc_id long, sent_id int, words array<string>")
    p = T.pointers_to_mask(A.score_batches(s, A.digit_or_mail_positions), "ptrs", "words", "preds").first()
    assert p.preds == [1] * 30 + [0]
    assert sum(T.pointers_to_mask(A.score_batches(s, A.digit_or_mail_positions, max_pointers=21), "ptrs").first().preds) == 21


@pytest.mark.parametrize("encoding", ["UTF-8", "ISO-8859-1"])
def test_lines_round_trip_or_fail(spark, encoding):
    docs = spark.createDataFrame([("c", i, t) for i, t in enumerate(TRICKY)], "corpus string, doc_id long, text string")
    path = scratch_path(spark, "lines")
    if encoding == "UTF-8":
        FMT.write_lines(docs, path, encoding=encoding)
        got = sorted(FMT.read_lines_corpus(spark, path, encoding).collect())
        assert [r.text for r in got] == TRICKY and [r.doc_index for r in got] == [0, 1, 2, 3]
    else:
        with pytest.raises(Exception):
            FMT.write_lines(docs, path, encoding=encoding)
        FMT.write_lines(docs.filter("doc_id > 0").withColumn("text", F.concat("text", F.lit(" é"))), path + "2", encoding=encoding)
        assert [r.text for r in sorted(FMT.read_lines_corpus(spark, path + "2", encoding).collect())] == [t + " é" for t in TRICKY[1:]]


def test_ngrams_round_trip(spark):
    rows = [("€ 日本", 3), ("a\u0001b c", 2)]
    path = scratch_path(spark, "ngrams")
    FMT.write_ngrams(spark.createDataFrame(rows, "g string, n long"), path, "UTF-8")
    assert {r.g for r in FMT.load_ngrams(spark, path, "UTF-8").collect()} == {g for g, _ in rows}


def test_named_texts(spark):
    path = scratch_path(spark, "named")
    FMT.write_named_texts(spark.createDataFrame([("raw", "a b"), ("masked", "<ANON> b")], "name string, text string"), path)
    assert {(r.name, r.value) for r in FMT.read_named_texts(spark, path).collect()} == {("raw", "a b"), ("masked", "<ANON> b")}


def test_turns_never_share_a_key(spark):
    path = scratch_path(spark, "turns")
    spark.createDataFrame([(1, 1000, "u", "a"), (2, 0, "u", "b"), (1, 0, "u", "c")], "conv_id long, turn long, role string, text string") \
        .write.parquet(path + "/conversations.parquet")
    got = corpora(spark, path, ("conversations",)).collect()
    assert len({r.doc_id for r in got}) == 3


def test_unicode_spaces_and_the_separator(spark):
    df = spark.createDataFrame([("nbsp word x　y \u0085z",), ("one. Two",), ("a\u0001b",)], "t string")
    words = [r.w for r in df.select(TX.words_of(F.array_join(TX.sentence_pieces(F.col("t")), " ")).alias("w")).collect()]
    assert words == [["nbsp", "word", "x", "y", "z"], ["one", ".", "Two"], ["a", "b"]]
    pieces = [r.p for r in df.select(TX.sentence_pieces(F.col("t")).alias("p")).collect()]
    assert pieces[1] == ["one.", "Two"] and pieces[2] == ["a b"]


def test_records_keep_file_order_without_a_sort(spark):
    path = scratch_path(spark, "order")
    lines = [f"line {i}" for i in range(500)]
    spark.createDataFrame(list(enumerate(lines)), "i long, value string").repartitionByRange(5, "i").sortWithinPartitions("i") \
        .select("value").write.text(path)
    got = FMT.read_lines_corpus(spark, path, "UTF-8").orderBy("doc_index").collect()
    assert [r.text for r in got] == lines and [r.doc_index for r in got] == list(range(500))


def test_held_out_sets_hold_positives_and_the_model_beats_all_positive(spark):
    tok = FX.by_language(spark, "/root/testdata/sf0.01")
    held = tok.filter(C._held_out())
    per = {r.corpus: r.n for r in held.groupBy("corpus").agg(F.sum("label").alias("n")).collect()}
    assert sum(per.values()) > 20 and len([v for v in per.values() if v]) >= 3


@pytest.mark.parametrize("name", ["GaussianNB", "GradientBoosting", "GaussianMixture", "LinearSVC"])
def test_estimators_use_the_row_weights(spark, name):
    """A word seen often outweighs its rare contrary label."""
    from pyspark.ml.linalg import Vectors
    rows = [("a", Vectors.dense([1.0, 0.2]), 1.0, 500.0, 500.0), ("b", Vectors.dense([1.1, 0.1]), 0.0, 1.0, 1.0),
            ("c", Vectors.dense([-1.0, 0.3]), 0.0, 500.0, 500.0), ("d", Vectors.dense([-1.1, 0.2]), 1.0, 1.0, 1.0),
            ("e", Vectors.dense([0.9, 0.25]), 1.0, 300.0, 300.0), ("f", Vectors.dense([-0.9, 0.15]), 0.0, 300.0, 300.0)]
    df = spark.createDataFrame(rows, ["word", "features", "label", "n", "weight"])
    params = {"max_iter": 5} if name == "GradientBoosting" else {}
    model = M.train_annotator(M.CLASSIFIERS[name](**params), df)
    got = {r.word: r.prediction for r in model.transform(df).select("word", "prediction").collect()}
    assert got["a"] == got["e"] == 1.0 and got["c"] == got["f"] == 0.0


def test_stream_goes_on_where_it_ended(spark):
    from quillmask.streaming.anonymize import anonymize_stream, run_to_sink
    src, sink = scratch_path(spark, "src"), scratch_path(spark, "sink")
    schema = "corpus string, doc_id long, text string"

    def stream():
        return anonymize_stream(spark.readStream.schema(schema).parquet(src))
    spark.createDataFrame([("c", 1, "call 12 now")], schema).write.parquet(src)
    run_to_sink(spark, stream(), sink)
    spark.createDataFrame([("c", 2, "or 34")], schema).write.mode("append").parquet(src)
    run_to_sink(spark, stream(), sink)
    assert sorted((r.doc_id, r.masked) for r in spark.read.parquet(sink).collect()) == [(1, "call <ANON> now"), (2, "or <ANON>")]


def test_confusion_of_the_ngram_annotator_over_all_words(spark):
    s = T.collapse_labels(FX.sentences(spark, SF), "labels")
    r = A.annotate_rare_ngrams(s, A.ngram_counts(s, 2, 2), 2)
    c = E.confusion(r).first()
    assert c.tp + c.fp + c.fn + c.tn == s.agg(F.sum(F.size("words"))).first()[0]


def test_the_model_annotates_and_masks_every_document(spark):
    tok = FX.by_language(spark, SF).unionByName(T.collapse_labels(FX.tokens(spark, SF, ("conversations", "benchmark")), "label"))
    want = {(r.corpus, r.doc_id): r.n for r in tok.groupBy("corpus", "doc_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    got = C.QUERIES["annotate_model"](spark, SF)
    assert {(r.corpus, r.doc_id): r.n for r in got.groupBy("corpus", "doc_id").agg(F.count(F.lit(1)).alias("n")).collect()} == want
    assert got.filter("not held_out and corpus in ('conversations', 'benchmark')").isEmpty() and not got.filter("not held_out").isEmpty()
    masked = C.QUERIES["anonymize_model"](spark, SF)
    assert sorted((r.corpus, r.doc_id) for r in masked.collect()) == sorted(want)
