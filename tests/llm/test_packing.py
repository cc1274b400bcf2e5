import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillmask.llm import packing as P
from quillmask.llm import tokens as K

DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


TRICKY = [None, "", " \t\n", "It's IT'S we'll 'TWAS don''t o'clock", "a_b __c-d... !!?? <|startoftext|> x", "É é É naïve ﬁ Σίσυφος ΟΔΟΣ İstanbul ŉ",
          "x² ½ 3rd ١٢ Ⅷ 日本語テスト 한국 नमस्ते", "tab\tnbsp x\u0085y z\x1cq\x7f", "soft­hyphen “quoted” – dash… €5 ª º µ ß ẞ ǆ ǅ",
          "'s't're 're've'm'll'd'x", "A" * 3000, "😀 emoji 👩‍👩‍👧 ẹ́", "<|endoftext|>", "a<|b", "1234567890 12.5e-7", "Å Ω ſ ẞ"]


def test_ids_are_the_tokenizers(tokenizer):
    rng = random.Random(0)
    letters = "abcdeéßÀñ'’_-.,:;!? \n\t0123²·<|>ΣİÁ"
    texts = TRICKY + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 200))) for _ in range(400)]
    got = K.encoder().encode(texts)
    for t, ids in zip(texts, got):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids, t


def test_ids_of_given_documents_and_long_texts(spark, tokenizer, monkeypatch):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    monkeypatch.setattr(K, "SLICE", 700)
    texts += ["é" + "日本 x" * 500, "word " * 1000]
    want = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    for t, ids, w in zip(texts, K.encoder().encode(texts), want):
        assert np.frombuffer(ids, "<u4").tolist() == w.ids


def check(rows, got, tokenizer, capacity):
    ids = [(i, tokenizer.encode(t or "", add_special_tokens=False).ids + [0]) for i, t in rows]
    want = Counter((i, k, b, len(x[b:b + capacity]), zlib.crc32(np.array(x[b:b + capacity], "<u4").tobytes()))
                   for i, x in ids for k, b in enumerate(range(0, len(x), capacity)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    for own in seqs.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(seqs)


def best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [r for r in rooms if r >= n]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - n)
        else:
            rooms.append(capacity - n)
    return len(rooms)


@pytest.mark.parametrize("capacity", [64, 2048])
def test_against_best_fit(frame, tokenizer, capacity):
    rng = random.Random(capacity)
    rows = [(i, " ".join(rng.choice(["cat", "dog", "bird", "é"]) for _ in range(int(capacity * rng.betavariate(1, 2.2) * rng.choice([1, 1, 1, 2.5])))))
            for i in range(700)]
    got = P.pack(frame(rows, DOCS), capacity=capacity).collect()
    n = check(rows, got, tokenizer, capacity)
    lengths = [r.length for r in got]
    assert n <= 1.02 * best_fit(lengths, capacity) + 1


def test_configurations_cover_the_demand():
    size, demand = np.array([1000, 700, 400, 300]), np.array([40, 61, 77, 13])
    used = P.configurations(size, demand, 2048)
    assert (sum(c * n for c, n in used) >= demand).all() and all(c @ size <= 2048 for c, _ in used)
    assert sum(n for _, n in used) <= best_fit(np.repeat(size, demand).tolist(), 2048)


def test_edge_cases(frame, tokenizer):
    rows = [(1, None), (2, ""), (3, "x"), (3, "x"), (None, "y z"), (5, "cat " * 9000), (6, "cat " * 2047), (7, "cat " * 2048), (8, "")]
    docs = frame([(*r, "x", 9) for r in rows], DOCS + ", length string, sequence_id int")
    check(rows, P.pack(docs).collect(), tokenizer, 2048)
    check([(1, None)], P.pack(frame([(1, None)], DOCS)).collect(), tokenizer, 2048)
    check([(6, "cat " * 2047)], P.pack(frame([(6, "cat " * 2047)], DOCS)).collect(), tokenizer, 2048)
    assert P.pack(frame([], DOCS)).count() == 0
