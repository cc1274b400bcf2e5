"""The filter audit against a plain application of every order."""
import random
import re
from itertools import permutations

import pyspark.sql.functions as F

from quillmask.llm import audit

DOCS, LABELS = "doc_id long, text string, lang string", "doc_id long, quality int, toxic int"


def plain(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    rows = []
    for i, text, lang in docs:
        t = text or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
                 "D": bool(re.search(r"[#$%&*|]", t)),
                 "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs)}
        rows.append((lang or "", fails, i in good, i in toxic))
    out = set()
    for part in {r[0] for r in rows}:
        mine, lines, share = [r for r in rows if r[0] == part], [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order):
                gone = [r for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                share[f] += len(gone)
                lines.append((part, "".join(order), step + 1, f, len(left), len(gone), sum(r[1][f] for r in mine) - len(gone),
                              sum(r[1][f] and sum(r[1].values()) == 1 for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)))
        out |= {(*x[:3], *x[4:], share[x[3]]) for x in lines}
    return out


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def got(docs, labels):
    rows = [tuple(r) for r in audit.audit_documents(docs, labels).select(*COLUMNS).collect()]
    assert len(set(rows)) == len(rows)
    return set(rows)


def test_every_order_equals_plain_application(frame):
    rng = random.Random(2)
    texts = [None, "", "  \t", "a b", "A B C", "x # y", " ".join(f"w{i}" for i in range(200)), " ".join(["same"] * 250),
             "é " * 199 + "é", "\x1c " * 200, " ".join(f"W{i}" for i in range(300)), "| " + " ".join(f"w{i}" for i in range(400)), "long " * 30_000]
    docs = [(rng.choice([None, *range(60)]), rng.choice(texts), rng.choice([None, "", "en", "fr"])) for _ in range(120)]
    labels = [(rng.choice([None, *range(60)]), rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for _ in range(70)]
    df = frame(docs, DOCS)
    want = plain(docs, labels)
    assert got(df, frame(labels, LABELS)) == want
    clash = df.withColumns({c: F.lit("z") for c in ("id", "part", "digest", "mask", "n", "words", "t", "good")})
    assert got(clash, frame(labels, LABELS)) == want


def test_empty_tables(frame):
    assert got(frame([], DOCS), frame([], LABELS)) == set()
    assert len(got(frame([(1, None, None)], DOCS), frame([], LABELS))) == 600


def test_removal_steps_are_a_min_plus_product():
    orders = list(permutations(range(4)))
    import numpy as np
    step = audit.removal_steps(np.arange(16), orders)
    for m in range(16):
        for o, order in enumerate(orders):
            first = [i for i, f in enumerate(order) if m >> f & 1]
            assert step[m, o] == (first[0] if first else np.inf)
