import random

from quillmask.llm import langid as L

DOCS = "doc_id long, text string, lang string"


def phrases(data, text):
    """Greedy longest-match parse by substring search."""
    n = 0
    for at in range(0, len(text), L.SEGMENT):
        seg, i = text[at:at + L.SEGMENT], 0
        while i < len(seg):
            j = i + 1
            while j <= len(seg) and seg[i:j] in data:
                j += 1
            i = max(i + 1, j - 1)
            n += 1
    return n


def test_phrases_equal_a_plain_parse():
    rng = random.Random(3)
    word = lambda a: "".join(rng.choice(a) for _ in range(rng.randint(1, 6)))
    samples = {k: L.normalised(" ".join(word(a) for _ in range(300))) for k, a in (("aa", "abcé"), ("bb", "abxyz"), ("cc", "ßabq"))}
    model = L.build_model(samples)
    texts = [L.normalised(" ".join(word("abcxyzéqß日") for _ in range(n))) for n in (1, 2, 30, 400, 1500)] + [b""]
    got = model.phrases(texts)
    for k, lang in enumerate(model.langs):
        assert list(got[k]) == [phrases(samples[lang], t) for t in texts]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs = docs.withColumn("held_out", L.fold("doc_id") == 0)
    out = L.identify(docs, L.train(docs.filter("not held_out"))).filter("held_out").collect()
    assert len(out) > 100
    assert sum(r.lang == r.lang_pred for r in out) / len(out) > 0.97
    assert all(0 <= r.score <= 1 for r in out)


def test_edge_cases(frame):
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 34 !", None), (4, "the of and the of", "en"), (5, "der die das der", "de"),
            (5, "der die das der", "de"), (6, "the of " * 20000, None), (7, "²", "en")]
    docs = frame([(*r, "x") for r in rows], DOCS + ", score string")
    model = L.train(docs)
    out = {r.doc_id: r for r in L.identify(docs, model).collect()}
    assert [out[i].lang_pred for i in (1, 2, 3, 7)] == ["und"] * 4 and out[1].score == 0 and out[1].rate is None
    assert out[4].lang_pred == out[6].lang_pred == "en" and out[5].lang_pred == "de"
    empty = L.train(docs.filter("false"))
    assert {r.lang_pred for r in L.identify(docs, empty).collect()} == {"und"}
    assert L.identify(docs.filter("false"), model).count() == 0


def test_texts_are_held_a_chunk_at_a_time(monkeypatch):
    model = L.build_model({"en": b"the of and", "de": b"der die das"})
    texts = [None, "the of", "der die das " * 30, "12", "and " * 200, "die", "of the and"] * 5
    want = model.predict(texts)
    monkeypatch.setattr(L, "CHUNK", 400)
    read, most = [], []
    judged = L.LanguageModel.judged

    def seen(self, parts):
        most.append(len(parts))         # at most one text is read that is not yet judged
        assert len(read) <= sum(most) + 1 and (len(parts) == 1 or sum(map(len, parts)) <= 400)
        return judged(self, parts)

    monkeypatch.setattr(L.LanguageModel, "judged", seen)
    got = model.predict(read.append(t) or t for t in texts)
    assert len(most) > 5 and got.equals(want)
