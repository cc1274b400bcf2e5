"""Evaluation operators (E1-E12): confusion counts, precision/recall/F1,
per-dataset result rows, misclassified sentences, corpus statistics,
key-phrase scores, lexicon sentiment and utility reports."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as TX
from ..functions.arrays import ratio_round6
from ..session import stored

LEXICON_ROWS = 2_000_000        # words of a lexicon that is sent to every executor


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def confusion(pairs: DataFrame, by=(), label: str = "label", pred: str = "pred", n: str | None = None) -> DataFrame:
    """2x2 counts (true, pred) as ``tp, fp, fn, tn`` — one aggregate with
    map-side partial sums, so only one small row per group crosses the
    shuffle.  ``n``: how many tokens a row stands for (none: one)."""
    t, p = F.col(label), F.col(pred)

    def cnt(c):
        return F.sum(F.when(c, F.col(n) if n else 1).otherwise(0)).cast("long")
    return pairs.groupBy(*by).agg(cnt((t == 1) & (p == 1)).alias("tp"), cnt((t == 0) & (p == 1)).alias("fp"),
                                  cnt((t == 1) & (p == 0)).alias("fn"), cnt((t == 0) & (p == 0)).alias("tn"))


def prf_columns(tp: Column, fp: Column, fn: Column, digits: int | None = None):
    """E2 expressions; every zero denominator yields 0."""
    precision = _ratio(tp.cast("double"), (tp + fp).cast("double"))
    recall = _ratio(tp.cast("double"), (tp + fn).cast("double"))
    f1 = _ratio(2 * precision * recall, precision + recall)
    cols = [precision, recall, f1]
    if digits is not None:
        cols = [F.round(c, digits) for c in cols]
    return [c.alias(n) for c, n in zip(cols, ("precision", "recall", "f1"))]


def prf(conf: DataFrame, by=(), digits: int | None = None) -> DataFrame:
    """E2 on a confusion table."""
    return conf.select(*by, "tp", "fp", "fn", "tn", *prf_columns(F.col("tp"), F.col("fp"), F.col("fn"), digits))


def prf_by_dataset(pairs: DataFrame, config: list[str], dataset: str, datasets: list[str],
                   label: str = "label", pred: str = "pred", digits: int | None = 6) -> DataFrame:
    """One wide row per configuration with ``precision_<ds>, recall_<ds>,
    f1_<ds>`` for each test set (pivot over a known value list, so no extra
    pass to discover the values)."""
    long = prf(confusion(pairs, [*config, dataset], label, pred), [*config, dataset], digits)
    wide = long.groupBy(*config).pivot(dataset, datasets).agg(
        F.first("precision").alias("precision"), F.first("recall").alias("recall"), F.first("f1").alias("f1"))
    out = [F.col(c) for c in config]
    for ds in datasets:
        for m in ("precision", "recall", "f1"):
            out.append(F.col(f"{ds}_{m}").alias(f"{m}_{ds}"))
    return wide.select(*out)


def misclassified(sent: DataFrame, keys=("corpus", "doc_id", "sent_id"), labels: str = "labels",
                  preds: str = "preds") -> DataFrame:
    """Sentences whose prediction differs from the target, rendered raw,
    target-masked and prediction-masked.  Row-local."""
    diff = sent.filter(F.col(labels) != F.col(preds))
    return diff.select(*keys, TX.render_sentence(F.col("words")).alias("raw_text"),
                       TX.render_sentence(F.col("words"), F.col(labels)).alias("target_anon"),
                       TX.render_sentence(F.col("words"), F.col(preds)).alias("predicted_anon"))


def corpus_stats(sent: DataFrame, corpus: str = "corpus", labels: str = "labels") -> DataFrame:
    """E5: words, annotation sum (label values, so inner words count 2 when not
    collapsed), annotated tokens, sentences and documents per corpus, plus a
    total row (``corpus`` null) from the rollup."""
    lab = F.col(labels)
    return sent.rollup(corpus).agg(
        F.sum(F.size("words")).cast("long").alias("words"),
        F.sum(F.aggregate(lab, F.lit(0), lambda a, x: a + x)).cast("long").alias("annotation_sum"),
        F.sum(F.size(F.filter(lab, lambda x: x > 0))).cast("long").alias("annotated_tokens"),
        F.count(F.lit(1)).alias("sentences"),
        F.count_distinct(corpus, "doc_id").alias("documents"))


def annotation_rate(tok: DataFrame, pred: str = "pred", by=("corpus",), digits: int = 6) -> DataFrame:
    """Number and share of words an annotator marks."""
    return tok.groupBy(*by).agg(F.sum(pred).cast("long").alias("annotated"),
                                F.count(F.lit(1)).alias("tokens"),
                                F.round(F.avg(F.col(pred).cast("double")), digits).alias("rate"))


def class_balance(tok: DataFrame, label: str = "label", digits: int | None = 6) -> DataFrame:
    """Balanced class weights ``n / (k * n_class)``."""
    return balance_of_counts(tok.groupBy(label).agg(F.count(F.lit(1)).alias("n")), label, digits)


def balance_of_counts(counts: DataFrame, label: str = "label", digits: int | None = 6) -> DataFrame:
    """E11 on ``(label, n)``: one row per class; the totals are two aggregates
    over it."""
    per = counts.select(label, F.col("n").alias("n_class"))
    n = per.select(F.sum("n_class")).scalar()
    k = per.select(F.count(F.lit(1))).scalar()
    w = n / (k * F.col("n_class"))
    if digits is not None:
        w = F.round(w, digits)
    return per.select(label, "n_class", w.alias("weight"))


def phrase_counts(target: DataFrame, pred: DataFrame, doc: str = "doc", phrase: str = "phrase") -> DataFrame:
    """``(doc, phrase, t, p)``: how often each phrase is a target and a
    prediction of its document; one shuffle of both sides together."""
    both = target.select(doc, phrase, F.lit(1).alias("t"), F.lit(0).alias("p")) \
        .unionByName(pred.select(doc, phrase, F.lit(0).alias("t"), F.lit(1).alias("p")))
    return both.groupBy(doc, phrase).agg(F.sum("t").alias("t"), F.sum("p").alias("p"))


def keyphrase_exact(target: DataFrame, pred: DataFrame, doc: str = "doc", phrase: str = "phrase") -> DataFrame:
    """Over documents present on both sides (J7), tp = target phrases found
    among the predictions, fn = not found, fp = predicted phrases not among the
    targets; duplicates count each time (existence test, not multiset)."""
    return exact_of_counts(phrase_counts(target, pred, doc, phrase), doc)


def exact_of_counts(counts: DataFrame, doc: str = "doc") -> DataFrame:
    """E6 on ``(doc, phrase, t, p)``: a second grouping by document keeps those
    on both sides."""
    def total(value, when):
        return F.sum(F.when(when, F.col(value)).otherwise(0))
    per = counts.groupBy(doc).agg(F.sum("t").alias("_t"), F.sum("p").alias("_p"), total("t", F.col("p") > 0).alias("tp"),
                                  total("t", F.col("p") == 0).alias("fn"), total("p", F.col("t") == 0).alias("fp"))
    return _sums(per.filter("_t > 0 and _p > 0"))


def _sums(per: DataFrame) -> DataFrame:
    return per.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("tp", "fn", "fp")])


def keyphrase_words(target: DataFrame, pred: DataFrame, doc: str = "doc", phrase: str = "phrase") -> DataFrame:
    """Word-level multiset overlap per document: tp = min of the two word
    counts, fn / fp = the positive differences; summed over documents on both
    sides."""
    return words_of_counts(phrase_counts(target, pred, doc, phrase), doc, phrase)


def words_of_counts(counts: DataFrame, doc: str = "doc", phrase: str = "phrase") -> DataFrame:
    """E7 on ``(doc, phrase, t, p)``.  A document without a phrase on one side
    is known before its phrases are split into words (an empty phrase counts as
    a phrase)."""
    w = counts.select(doc, "t", "p", F.explode_outer(F.filter(F.split(F.trim(phrase), r"\s+"), lambda x: x != "")).alias("w"))
    words = w.groupBy(doc, "w").agg(F.sum("t").alias("t"), F.sum("p").alias("p"))
    real = F.col("w").isNotNull()
    per = words.groupBy(doc).agg(F.sum("t").alias("_t"), F.sum("p").alias("_p"), F.sum(F.when(real, F.least("t", "p")).otherwise(0)).alias("tp"),
                                 F.sum(F.when(real, F.greatest(F.col("t") - F.col("p"), F.lit(0))).otherwise(0)).alias("fn"),
                                 F.sum(F.when(real, F.greatest(F.col("p") - F.col("t"), F.lit(0))).otherwise(0)).alias("fp"))
    return _sums(per.filter("_t > 0 and _p > 0"))


def lexicon_sentiment(tok: DataFrame, lexicon: DataFrame, by=("corpus", "doc_id"), word: str = "word",
                      exact: bool = True) -> DataFrame:
    """E8 (re-aimed): polarity and subjectivity of a text = mean over the words
    found in the lexicon, 0 when none.  ``lexicon(word, polarity_c,
    subjectivity_c)`` in integer hundredths is joined on the lower-cased word;
    texts without any lexicon word keep a row with zeros.  Also returns the
    integer sums and the match count, from which every derived score is exact.
    A lexicon of up to ``LEXICON_ROWS`` words is sent to the executors, so tokens
    are added up by text where they are read; a larger one is joined as Spark
    sees fit."""
    lx = stored(lexicon.select(F.col("word").alias("_w"), "polarity_c", "subjectivity_c"), "lexicon")
    lx = F.broadcast(lx) if lx.count() <= LEXICON_ROWS else lx
    t = tok.select(*by, F.lower(word).alias("_w"))
    g = t.join(lx, "_w", "left").groupBy(*by).agg(
        F.coalesce(F.sum("polarity_c"), F.lit(0)).cast("long").alias("pol_c"),
        F.coalesce(F.sum("subjectivity_c"), F.lit(0)).cast("long").alias("sub_c"),
        F.count("polarity_c").alias("matched"))
    den = F.col("matched") * 100
    return g.select(*by, "pol_c", "sub_c", "matched", ratio_round6(F.col("pol_c"), den).alias("polarity"),
                    ratio_round6(F.col("sub_c"), den).alias("subjectivity"))


def utility_report(pure: DataFrame, anon: DataFrame, target: DataFrame, key: str = "doc_id",
                   metric: str = "polarity", target_col: str = "target") -> DataFrame:
    """Pure vs masked score side by side with the class target, one row
    per document (inner joins on the document key)."""
    p = pure.select(key, F.col(metric).alias(f"pure_{metric}"))
    a = anon.select(key, F.col(metric).alias(f"anon_{metric}"))
    t = target.select(key, F.col(target_col).cast("double").alias(f"target_{metric}"))
    return p.join(a, key).join(t, key)


def score_table(scores: DataFrame, targets: DataFrame, key: str = "doc_id", score: str = "score",
                target: str = "target") -> DataFrame:
    """Service score next to the 0/1 class target, joined by id."""
    return scores.select(key, F.col(score).alias("sent_pred")).join(
        targets.select(key, F.col(target).cast("double").alias("targets")), key)
