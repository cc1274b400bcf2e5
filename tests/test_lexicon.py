"""Lexicon scores at scale: tokens are added up where they are read."""
from quillmask.operators import evaluate as E


def test_lexicon_is_sent_and_tokens_stay(spark, monkeypatch):
    tok = spark.createDataFrame([("c", 1, "Good"), ("c", 1, "bad"), ("c", 1, "x"), ("c", 2, "x"), (None, 3, "good"), (None, 3, None)],
                                "corpus string, doc_id long, word string")
    lx = spark.createDataFrame([("good", 100, 50), ("bad", -25, 0)], "word string, polarity_c long, subjectivity_c long")
    monkeypatch.setattr("quillmask.operators.evaluate.LEXICON_ROWS", 0)
    joined = {tuple(r) for r in E.lexicon_sentiment(tok, lx).collect()}
    monkeypatch.undo()
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sent = E.lexicon_sentiment(tok, lx)
        plan = sent._jdf.queryExecution().executedPlan().toString()
        assert {tuple(r) for r in sent.collect()} == joined == {("c", 1, 75, 50, 2, 0.375, 0.25), ("c", 2, 0, 0, 0, 0.0, 0.0),
                                                                (None, 3, 100, 50, 1, 1.0, 0.5)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == 1      # one, of sums by text
