import random

from quillmask.llm import linededup as LD

DOCS = "doc_id long, text string"


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    if len(a) > len(b):
        a, b = b, a
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows, min_chars=LD.MIN_CHARS):
    out, seen = {}, []
    for doc, text in sorted(rows, key=lambda r: r[0]):
        if text is None:
            out[doc] = (None, 0, 0, 0)
            continue
        kept, equal, near = [], 0, 0
        for line in text.split("\n"):
            f = line.strip(" ").lower()
            if f == "":
                kept.append(line)
            elif f in seen:
                equal += 1
            else:
                if len(f) >= min_chars and any(len(s) >= min_chars and within_one(f, s) for s in seen):
                    near += 1
                else:
                    kept.append(line)
                seen.append(f)
        out[doc] = ("\n".join(kept), len(text.split("\n")), equal, near)
    return out


def run(df):
    return {r.doc_id: (r.text, r.n_lines, r.n_equal, r.n_near) for r in LD.dedup_lines(df).collect()}


def edited(rng, s):
    i = rng.randrange(len(s))
    return rng.choice([s[:i] + s[i + 1:], s[:i] + rng.choice("xyzé") + s[i:], s[:i] + rng.choice("xyzé") + s[i + 1:]])


def test_against_brute_force(frame):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcde é") for _ in range(rng.choice([5, 19, 20, 21, 40, 64, 65, 127, 128, 129, 300]))).strip()
            for _ in range(25)]
    lines = base + [edited(rng, s) for s in base for _ in range(3) if s] + [edited(rng, edited(rng, s)) for s in base if len(s) > 2]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 6)))) for i in range(80)]
    got, want = run(frame(rows, DOCS)), brute(rows)
    assert got == want
    assert sum(w[3] for w in want.values()) > 10


def test_long_line_and_every_edit_place(frame):
    rng = random.Random(1)
    long = "".join(rng.choice("abcdefgh ") for _ in range(9000)).strip()
    short = "the quick brown fox jumps over it"
    rows = [(0, long), (1, long[:4500] + long[4501:]), (2, long[:8999] + "Q"), (3, "Q" + long), (4, long[:10] + "QQ" + long[12:]), (5, short)]
    rows += [(10 + i, short[:i] + short[i + 1:]) for i in range(len(short))] + [(100 + i, short[:i] + "Q" + short[i:]) for i in range(len(short) + 1)]
    assert run(frame(rows, DOCS)) == brute(rows)


def test_edge_cases(frame):
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, " "), (5, "a\na\n\na"), (None, "a"), (7, "x" * 30), (8, "x" * 30), (8, "x" * 30), (9, "A ")]
    got = LD.dedup_lines(frame([(*r, "z", 1) for r in rows], DOCS + ", n_lines string, __rk long"))
    assert set(got.columns) == {"doc_id", "text", "n_lines", "__rk", "n_equal", "n_near"}
    by = sorted(((r.doc_id, r.text, r.n_equal) for r in got.collect()), key=str)
    assert by == sorted([(1, None, 0), (2, "", 0), (3, "\n\n", 0), (4, " ", 0), (5, "", 3), (None, "a", 0), (7, "x" * 30, 0),
                         (8, "", 1), (8, "", 1), (9, "", 1)], key=str)
    assert LD.dedup_lines(frame([], DOCS)).count() == 0
