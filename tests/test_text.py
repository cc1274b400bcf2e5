"""Text shaping: tokeniser, gold labels, scans, folds (golden strings and
brute-force references)."""
import random
import re

from pyspark.sql import functions as F

from quillmask.functions import patterns as P
from quillmask.functions import text as TX
from quillmask.functions.arrays import overlap_flags, prefix_sum, running_max
from quillmask.operators import text as T


def _pad_split(s):
    return [w for w in re.sub("(" + P.PUNCT_CLASS + ")", r" \1 ", s).split() if w]


def _brute_labels(s, pattern=P.GOLD):
    toks = [(m.start(), m.end()) for m in re.finditer(P.TOKEN, s)]
    spans = [(m.start(), m.end()) for m in re.finditer(pattern, s)]
    flags = [any(sb < te and tb < se for sb, se in spans) for tb, te in toks]
    return [0 if not f else (2 if i > 0 and flags[i - 1] else 1) for i, f in enumerate(flags)]


SENTS = [
    "Dear Ann Lee, meet me at 10.0.0.1 or mail ann.lee@mail.example.com (today).",
    "key deadbeefdeadbeef0011 then 12-34 and x9 [ok] \"quoted\" it's fine!",
    "no personal data here",
    "",
    "....",
    "a1b2c3 1 2 3 , 4",
    "token abcdefabcdefabcd has no digit, abcdefabcdefabc is too short",
]


def test_words_and_labels_match_brute_force(spark):
    df = spark.createDataFrame([(s,) for s in SENTS], "sent string")
    rows = df.select("sent", TX.words_of(F.col("sent")).alias("w"), TX.gold_labels(F.col("sent")).alias("g")).collect()
    for r in rows:
        assert r.w == _pad_split(r.sent)
        assert r.g == _brute_labels(r.sent)


def test_hex_secret_without_digits_is_flagged(spark):
    df = spark.createDataFrame([(SENTS[-1],)], "sent string")
    g = df.select(TX.gold_labels(F.col("sent")).alias("g")).first().g
    assert g[1] == 1 and sum(g) == 1


def test_gold_labels_random_text(spark):
    rnd = random.Random(7)
    alphabet = "ab9 .,@x-f0"
    sents = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(300)]
    df = spark.createDataFrame([(s,) for s in sents], "sent string")
    for r in df.select("sent", TX.gold_labels(F.col("sent")).alias("g"), TX.words_of(F.col("sent")).alias("w")).collect():
        assert r.g == _brute_labels(r.sent), r.sent
        assert r.w == _pad_split(r.sent), r.sent


def test_scans(spark):
    rnd = random.Random(1)
    arrs = [[rnd.randint(-5, 9) for _ in range(n)] for n in (0, 1, 2, 3, 7, 64, 1000)]
    df = spark.createDataFrame([(a,) for a in arrs], "a array<int>")
    for r in df.select("a", prefix_sum(F.col("a")).alias("s"), running_max(F.col("a")).alias("m")).collect():
        acc, best, s, m = 0, None, [], []
        for x in r.a:
            acc += x
            best = x if best is None else max(best, x)
            s.append(acc)
            m.append(best)
        assert r.s == s and r.m == m


def test_overlap_sweep_matches_pairs(spark):
    rnd = random.Random(3)
    rows = []
    for _ in range(200):
        pos, toks = 0, []
        for _ in range(rnd.randint(0, 12)):
            pos += rnd.randint(0, 2)
            ln = rnd.randint(1, 4)
            toks.append((pos, pos + ln))
            pos += ln
        spans = []
        for _ in range(rnd.randint(0, 4)):
            b = rnd.randint(0, pos + 2)
            spans.append((b, b + rnd.randint(1, 5)))
        rows.append(([{"b": b, "e": e} for b, e in toks], [{"b": b, "e": e} for b, e in spans]))
    df = spark.createDataFrame(rows, "t array<struct<b:int,e:int>>, s array<struct<b:int,e:int>>")
    for r in df.select("t", "s", overlap_flags(F.col("t"), F.col("s")).alias("f")).collect():
        want = [any(s.b < t.e and t.b < s.e for s in r.s) for t in r.t]
        assert r.f == want


def test_fold_explode_round_trip(spark):
    from quillmask.plans import fixtures as FX
    s = FX.sentences(spark, "/root/testdata/sf0.001")
    back = T.fold_tokens(T.explode_tokens(s))
    a = s.select("corpus", "doc_id", "sent_id", "words", "labels")
    assert a.exceptAll(back).count() == 0 and back.exceptAll(a).count() == 0


def test_flagship_equals_fold_path(spark):
    from quillmask.plans.catalog import QUERIES
    a = QUERIES["anonymize_text"](spark, "/root/testdata/sf0.001")
    b = QUERIES["mask_text"](spark, "/root/testdata/sf0.001")
    assert a.exceptAll(b).count() == 0
    assert a.filter(F.col("masked").contains(P.ANON_TOKEN)).count() > 0


def test_mask_keeps_token_count(spark):
    from quillmask.plans.catalog import QUERIES
    m = QUERIES["mask_text"](spark, "/root/testdata/sf0.001")
    r = QUERIES["raw_text"](spark, "/root/testdata/sf0.001")
    j = m.join(r, ["corpus", "doc_id"]).select(
        F.size(F.split("masked", r"\s+")).alias("a"), F.size(F.split("raw_text", r"\s+")).alias("b"))
    assert j.filter("a != b").count() == 0


def test_pointer_round_trip(spark):
    from quillmask.plans import fixtures as FX
    s = T.collapse_labels(FX.sentences(spark, "/root/testdata/sf0.001"), "labels")
    p = T.pointers_to_mask(T.pointer_targets(s), "targets", "words", "preds")
    assert p.filter(F.col("labels") != F.col("preds")).count() == 0


def test_annotated_spans_equal_the_interval_sweep(spark):
    """Both forms of the same rule, on sentences with odd spaces, matches over
    several tokens, none, and null."""
    import random
    from quillmask.functions import patterns as P
    from quillmask.operators import annotate as A
    rng = random.Random(5)
    signs = ["Ann", "b", "a.b@c.de", "1.22.3.4", "é", "日本", "9", ".", "'", "(", " ", "  ", "\t", "\x0b", "deadbeefdeadbeef", "xY1z", "😀Ab"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(1, 25))) for _ in range(300)] + ["", " ", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, sent string").repartition(3)
    for pattern in (P.BASELINE_SPANS, P.GOLD, r"\d+", r"[a-z]+ [A-Z]|\s", r"b@c"):
        want = {r.i: r.p for r in df.select("i", F.transform(TX.span_flags(F.col("sent"), pattern), lambda f: f.cast("int")).alias("p")).collect()}
        got = A.annotate_spans(df, pattern)
        assert {r.i: r.preds for r in got.collect()} == want
        assert "aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()      # no scan over the tokens


def test_sent_and_joined_vocabularies_give_the_same_ids(spark):
    rng = random.Random(7)
    words = ["Ann", "ann", "é", "É", "9", ".", "İx", "new"]
    rows = [("c", i, 0, [rng.choice(words) for _ in range(rng.randint(0, 12))]) for i in range(80)]
    rows += [("c", 1, 0, ["9", "again"]), (None, 1, 0, ["ann"]), (None, 1, 0, ["9"]), (None, 2, 0, ["é", "?"])]
    sent = spark.createDataFrame(rows, "corpus string, doc_id long, sent_id int, words array<string>")
    vocab = spark.createDataFrame([(w, i) for i, w in enumerate(["ann", "é", "9", ".", P.EOS_TOKEN, P.UNK_TOKEN, P.SOS_TOKEN])], "word string, id long")
    key = lambda r: (r[0] or "", *r[1:])
    for cased in (False, True):
        want = sorted(map(tuple, T._joined_ids(sent, vocab, ["corpus", "doc_id", "sent_id"], cased).collect()), key=key)
        for limit in (T.VOCABULARY, 2, 0):
            got = T.encode_ids(sent, vocab, case_sensitive=cased, limit=limit)
            assert sorted(map(tuple, got.collect()), key=key) == want
    alone = T.encode_ids(sent.filter("corpus is not null and doc_id > 1"), vocab)
    assert "Exchange" not in alone._jdf.queryExecution().executedPlan().toString()      # no token is moved
    ids = alone.select("doc_id", F.posexplode("ids").alias("pos", "id"))
    want = sorted(map(tuple, ids.join(vocab, "id").select("doc_id", "pos", "id", "word").collect()))
    for limit in (T.VOCABULARY, 2, 0):
        assert sorted(map(tuple, T.decode_ids(ids, vocab, limit=limit).select("doc_id", "pos", "id", "word").collect())) == want
    assert "SortMergeJoin" not in T.decode_ids(ids, vocab)._jdf.queryExecution().executedPlan().toString()
