import pytest

import corpus_pipeline as C
from quillmask.llm import langid, minhash, mixing
from quillmask.llm.common import stored

from . import test_linededup, test_minhash, test_packing

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def staged(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(9001, "00 123 !!", "en", "src0", 9), (9002, None, "en", "src1", 0)], docs.schema)
    out = [docs.union(extra)]
    for name, stage in C.STAGES:
        out.append(stored(stage(spark, out[-1], SF), f"test-{name}"))
    return out


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_stages(spark):
    assert [n for n, _ in C.STAGES] == ["language_id", "line_dedup", "near_dedup", "mix_sources", "pack_sequences"]
    assert C.ORACLE_SQL is None


def test_columns(staged):
    for df in staged[:-1]:
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_language_id(staged):
    docs, kept = staged[0], staged[1]
    model = langid.train(docs)
    judged = model.predict([r.text for r in docs.collect()])
    want = {r.doc_id for r, p, b in zip(docs.collect(), judged["lang_pred"], judged["rate"])
            if p != "und" and (b <= C.MAX_RATE or len(r.text) < C.MIN_CHARS)}
    assert {r.doc_id for r in kept.collect()} == want
    assert not {9001, 9002} & want and len(want) > 190


def test_line_dedup(staged):
    brute = test_linededup.brute([(r.doc_id, r.text) for r in staged[1].collect()])
    want = {i: t for i, (t, _, eq, near) in brute.items() if not (eq + near and not t.strip())}
    assert {r.doc_id: r.text for r in staged[2].collect()} == want
    assert all(r.n_chars == len(r.text) for r in staged[2].collect())


def test_near_dedup(staged):
    docs = [(r.doc_id, r.text) for r in staged[2].collect()]
    classes = test_minhash.classes(docs)
    assert sorted(r.doc_id for r in staged[3].collect()) == sorted(set(classes.values()))


def test_mix_and_pack(staged, spark):
    import public_tokenizers
    from tokenizers import Tokenizer
    before, mixed = rows(staged[3]), rows(staged[4])
    assert set(mixed) == set(before) and len(mixed) >= len(before)
    tokens = {}
    for _, t, _, s, _ in before:
        tokens[s] = tokens.get(s, 0) + len(t.split())
    planned = {p["source"]: p for p in mixing.plan(tokens, mixing.ENTROPY, mixing.MAX_REPEATS, None)}
    for s, p in planned.items():
        own = [t for _, t, _, x, _ in mixed if x == s]
        assert p["quota"] <= sum(len(t.split()) for t in own) < p["quota"] + max(len(t.split()) for t in own)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    n = test_packing.check([(i, t) for i, t, *_ in mixed], staged[5].collect(), tokenizer, 2048)
    assert n * 2048 < 1.1 * sum(r.length for r in staged[5].collect()) + 2048


def test_run_is_the_stages(spark, staged):
    out = C.run(spark, SF)
    assert out.columns == staged[5].columns and out.count() > 200


def test_clashing_columns_and_empty_tables(spark, frame):
    """Columns of the caller come through every stage as they were."""
    import corpus_pipeline as P
    from pyspark.sql import functions as F
    names = ["score", "lang_pred", "rate", "__t", "n_lines", "n_equal", "n_near", "rk", "mix_block", "mix_order", "mix_pass", "mix_tokens", "row", "whole"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    odd = docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in names})
    empty = odd.limit(0)
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, odd, "")
        assert out.columns == odd.columns, name
        rows = out.collect()
        assert rows and all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in names), name
        assert sorted({r["doc_id"] for r in rows}) == sorted({r["doc_id"] for r in stage(spark, docs, "").collect()}), name
        assert stage(spark, empty, "").count() == 0, name
    assert P.STAGES[-1][1](spark, empty, "").count() == 0
