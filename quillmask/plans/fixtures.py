"""Tables derived from the driver parquet (FIXTURES.md §C), built by Spark so
that every query's work grows with the input tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..operators import text as T
from ..session import stored
from ..sources.tables import SENT_KEYS, corpora, read_table, spread_documents


def sentences(spark: SparkSession, sf_dir: str, which=("documents", "conversations", "benchmark"),
              pattern: str = P.GOLD) -> DataFrame:
    """``sent``: ``(corpus, doc_id, sent_id, sent, words, labels)`` with gold
    0/1/2 labels; one row per non-empty sentence.  Map-only."""
    return labelled(corpora(spark, sf_dir, which), pattern)


def labelled(docs: DataFrame, pattern: str = P.GOLD) -> DataFrame:
    """``sent`` of any ``(corpus, doc_id, text)``."""
    s = T.split_sentences(docs).filter(T.TX.has_words(F.col("sent")))
    s = s.withColumn("words", T.TX.words_of(F.col("sent")))
    return T.label_with_rules(s, "sent", pattern)


def word_sentences(spark: SparkSession, sf_dir: str, which=("documents", "conversations", "benchmark")) -> DataFrame:
    """``sentences`` without labels: ``(corpus, doc_id, sent_id, words)``."""
    return T.tokenize(T.split_sentences(corpora(spark, sf_dir, which))).select(*SENT_KEYS, "words")


def language_sentences(spark: SparkSession, sf_dir: str, collapse: bool = True) -> DataFrame:
    """``sent`` of ``documents`` with (collapsed) labels and the language as
    corpus, ``train`` for four fifths of the documents."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text", "lang") \
        .select(F.coalesce("lang", F.lit("none")).alias("corpus"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    s = labelled(spread_documents(docs))
    s = T.collapse_labels(s, "labels") if collapse else s
    return s.select(*SENT_KEYS, "words", "labels", F.coalesce(F.pmod("doc_id", F.lit(5)) != 0, F.lit(False)).alias("train"))


def by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``tok`` of ``documents`` with collapsed labels, the language as corpus
    (null: ``none``): data sets that hold sensitive words."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text", "lang") \
        .select(F.coalesce("lang", F.lit("none")).alias("corpus"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return T.collapse_labels(T.explode_tokens(labelled(spread_documents(docs))), "label")


def language_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``by_language`` counted and written: ``(corpus, held_out, word, label, n)``
    by lower-cased word; ``held_out`` is null without a document id."""
    tok = by_language(spark, sf_dir).withColumn("held_out", F.pmod("doc_id", F.lit(5)) == 0)
    n = tok.groupBy("corpus", "held_out", F.lower("word").alias("word"), "label").agg(F.count(F.lit(1)).alias("n"))
    return stored(n, "token-counts")


def all_types(spark: SparkSession, sf_dir: str, documents: DataFrame) -> DataFrame:
    """``(word, n)`` over all corpora, written; ``documents``: their (counted)
    tokens, so that their text is not split again."""
    from ..operators import lookup as L
    rest = L.type_counts(words(spark, sf_dir, ("conversations", "benchmark")))
    return stored(L.type_counts(L.type_counts(documents).unionByName(rest)), "types")


def tokens(spark: SparkSession, sf_dir: str, which=("documents", "conversations", "benchmark")) -> DataFrame:
    """``tok``: ``(corpus, doc_id, sent_id, pos, word, label)``, gold labels."""
    return T.explode_tokens(sentences(spark, sf_dir, which))


def words(spark: SparkSession, sf_dir: str, which=("documents", "conversations", "benchmark")) -> DataFrame:
    """``(corpus, doc_id, sent_id, pos, word)`` without labels: the span rules
    are not evaluated at all (a zipped label array could not be pruned)."""
    return T.explode_tokens(sentences(spark, sf_dir, which), arrays=("words",), names=("word",))


def placeholder_tokens(tok: DataFrame) -> DataFrame:
    """Inject the four placeholders: every token at ``pos % 97 = 3`` becomes
    ``&YEAR/&EMAIL/&DATE/&TIME`` by ``sent_id % 4`` (FIXTURES.md §C)."""
    kinds = F.array(*[F.lit(x) for x in P.PLACEHOLDER_TOKENS])
    hit = F.pmod(F.col("pos"), F.lit(97)) == 3
    return tok.withColumn("word", F.when(hit, F.element_at(kinds, (F.pmod(F.col("sent_id"), F.lit(4)) + 1).cast("int")))
                          .otherwise(F.col("word")))


def collapsed_sentences(spark, sf_dir, which=("documents", "conversations", "benchmark")) -> DataFrame:
    return T.collapse_labels(sentences(spark, sf_dir, which), "labels")


SENT_COLS = SENT_KEYS + ["words", "labels"]


def embeddings(spark, sf_dir) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings", "vec_id", "embedding")


def word_vectors(spark, sf_dir, tok: DataFrame | None = None, fold_case: bool = True) -> DataFrame:
    """``vec(word, v, line_no)``: types ranked by (count desc, word asc); rank
    r gets the embedding ``vec_id = r`` (FIXTURES.md §C)."""
    from ..operators import lookup as L
    tok = words(spark, sf_dir) if tok is None else tok
    ranked = L.rank_types(L.type_counts(tok, fold_case=fold_case))
    return L.vectors_by_rank(ranked, embeddings(spark, sf_dir))


def word_tables(spark, sf_dir, fold_case: bool = True) -> tuple[DataFrame, DataFrame]:
    """``vec`` and ``freq`` of all corpora from one count of their types, which
    is written (a row per type); without ``fold_case`` the vectors are of the
    words as written."""
    from ..operators import lookup as L
    types = stored(L.type_counts(words(spark, sf_dir), fold_case=fold_case), "types")
    vec = stored(L.vectors_by_rank(L.rank_types(types), embeddings(spark, sf_dir)), "vectors")
    folded = types if fold_case else types.groupBy(F.lower("word").alias("word")).agg(F.sum("n").alias("n"))
    return vec, folded


def word_freq(spark, sf_dir) -> DataFrame:
    """``freq(word, n)``: lower-cased type counts over all corpora (words written
    with a capital are missing from it as they are)."""
    from ..operators import lookup as L
    return L.type_counts(words(spark, sf_dir), fold_case=True)


def word_pieces(tok: DataFrame) -> DataFrame:
    """``(word, piece)``: character trigrams of every lower-cased type (the
    types are written once)."""
    return pieces_of(stored(tok.select(F.lower("word").alias("word")).distinct(), "types"))


def pieces_of(types: DataFrame) -> DataFrame:
    """``(word, piece)`` of a list of types."""
    from ..operators import lookup as L
    return types.select("word", F.explode(L.char_trigrams(F.col("word"))).alias("piece"))


def piece_vectors(spark, sf_dir, wp: DataFrame) -> DataFrame:
    """Piece vectors by the same ranking, over piece occurrences in the type list."""
    from ..operators import lookup as L
    counts = wp.groupBy(F.col("piece").alias("word")).agg(F.count(F.lit(1)).alias("n"))
    return L.vectors_by_rank(L.rank_types(counts), embeddings(spark, sf_dir))


def lexicon(tok: DataFrame) -> DataFrame:
    """``(word, polarity, subjectivity)`` from the md5 of each lower-cased type:
    first 8 hex digits mod 201 - 100, /100; next 8 mod 101, /100; listed only
    when the third 8 digits mod 10 = 0.  Kept in integer hundredths
    (``polarity_c``, ``subjectivity_c``) so means round exactly."""
    types = tok.select(F.lower("word").alias("word")).distinct()
    h = F.md5("word")

    def part(i):
        return F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("long")
    return types.filter(F.pmod(part(2), F.lit(10)) == 0).select(
        "word", (F.pmod(part(0), F.lit(201)) - 100).alias("polarity_c"),
        F.pmod(part(1), F.lit(101)).alias("subjectivity_c"))


def key_phrases(sent: DataFrame, flags: str) -> DataFrame:
    """``(doc, phrase)``: the two-word windows with a flagged word, of every
    sentence (FIXTURES.md §C); duplicates kept."""
    n = F.size("words")
    at = F.when(n > 1, F.filter(F.sequence(F.lit(0), n - 2), lambda i: (F.get(flags, i) > 0) | (F.get(flags, i + 1) > 0)))
    phrase = F.transform(at, lambda i: F.concat_ws(" ", F.get("words", i), F.get("words", i + 1)))
    return sent.select(F.concat_ws(":", "corpus", F.col("doc_id").cast("string")).alias("doc"), F.explode(phrase).alias("phrase"))


def phrase_counts(sent: DataFrame) -> DataFrame:
    """``(doc, phrase, t, p)``: of the two-word windows of every sentence, how
    often each touches a gold span (``labels``) and a predicted one (``preds``);
    one pass over the sentences."""
    n = F.size("words")

    def touched(flags, i):
        return (F.get(flags, i) > 0) | (F.get(flags, i + 1) > 0)
    at = F.when(n > 1, F.filter(F.sequence(F.lit(0), n - 2), lambda i: touched("labels", i) | touched("preds", i)))
    rows = F.transform(at, lambda i: F.struct(F.concat_ws(" ", F.get("words", i), F.get("words", i + 1)).alias("phrase"),
                                              touched("labels", i).cast("int").alias("t"), touched("preds", i).cast("int").alias("p")))
    doc = F.concat_ws(":", "corpus", F.col("doc_id").cast("string")).alias("doc")
    return sent.select(doc, F.explode(rows).alias("x")).groupBy("doc", "x.phrase").agg(F.sum("x.t").alias("t"), F.sum("x.p").alias("p"))


def keyphrase_responses(pred: DataFrame) -> DataFrame:
    """Service-style key-phrase responses built from the predictions: one JSON
    response per document (its phrases in order of appearance are not needed,
    the parser matches by id)."""
    g = pred.groupBy("doc").agg(F.collect_list("phrase").alias("p"))
    body = F.struct(F.array(F.struct(F.col("doc").alias("id"), F.col("p").alias("keyPhrases"))).alias("documents"),
                    F.array().cast("array<struct<id:string,message:string>>").alias("errors"))
    return g.select(F.to_json(body).alias("response"))
