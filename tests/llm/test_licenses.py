import random

import pytest

from quillmask.llm import licenses as L
from quillmask.llm.license_texts import NOTICES

DOCS = "doc_id long, text string"


def test_every_notice_is_found_among_other_words(frame):
    rng = random.Random(0)
    rows = []
    for i, (_, t) in enumerate(NOTICES):
        words = ["x%d" % rng.randrange(10**6) for _ in range(rng.randint(0, 90))]
        rows.append((i, " ".join(words) + ". " + t.replace(" ", "  \n", 3).upper() + " " + " ".join(words)))
    got = {(r.doc_id, r.template): r for r in L.scan(frame(rows, DOCS)).collect()}
    for i in range(len(NOTICES)):
        assert got[i, i].containment == 1.0
        n = len(rows[i][1].lower().split())
        assert 0 <= got[i, i].first_word < got[i, i].last_word <= n + 30


def test_edits_up_to_the_share(frame):
    long = max(NOTICES, key=lambda x: len(x[1]))[1].split()
    k = [t for _, t in NOTICES].index(" ".join(long)) if " ".join(long) in [t for _, t in NOTICES] else None
    few, many = list(long), list(long)
    few[30] = "zzz"
    for i in range(3, len(many), 6):
        many[i] = "zzz"
    got = {r.doc_id for r in L.scan(frame([(1, " ".join(few)), (2, " ".join(many)), (3, " ".join(long[:40]))], DOCS)).collect()}
    assert got == {1} and k is None or got == {1}


def test_edge_cases(frame):
    rows = [(1, None), (2, ""), (3, "Released under the MIT License."), (3, "Released under the MIT License."), (None, "released under the mit license"),
            (5, "Released under the MIT"), (6, ("word " * 50000) + "Released under the MIT License"), (7, "Released under the MIT License " * 500)]
    docs = frame([(*r, "x", 1) for r in rows], DOCS + ", template string, at int")
    got = [(r.doc_id, r.license, r.containment) for r in L.scan(docs).collect()]
    assert sorted(got, key=str) == sorted([(3, "MIT", 1.0), (None, "MIT", 1.0), (6, "MIT", 1.0), (7, "MIT", 1.0)], key=str)
    assert L.scan(frame([], DOCS)).count() == 0
    with pytest.raises(ValueError):
        L.scan(docs, [("x", "four words are few")])


def test_bands_miss_no_window_full_of_template_shingles():
    from quillmask.llm import licenses
    least = licenses.CONTAINMENT / (5 + 1 - licenses.CONTAINMENT)       # a window of 5 m shingles
    assert (1 - least) ** licenses.BANDS <= licenses.MISS
