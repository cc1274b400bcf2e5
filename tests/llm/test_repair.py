"""Conversation repair against brute force over all edit lists."""
import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from quillmask.llm import repair as R

SCHEMA = "conv_id long, turn long, role string, text string"
ROLES = {"u": "user", "a": "assistant"}


def damage(rows):
    out = []
    for c, t, r, x in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        if kind == 0:
            continue
        x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
        r = "user" if kind == 4 else r
        out += [(c, t, r, x)] * (2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))


def plain(rows):
    """Forward search over (state of the pattern, rows used), by cost and audit."""
    faults, seen = [], set()
    for _, _, r, x in rows:
        t = x.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not t else "duplicate" if (r, x) in seen else "" if t[-1] in ".!?" else "truncated")
        seen.add((r, x))
    best = {("", 0): (0, "", ())}                  # initials so far are reduced to their last one
    legal = {"": "su", "s": "u", "u": "a", "a": "u"}
    for i in range(len(rows) + 1):
        for _ in range(4):                         # insertions
            for (last, n), (c, au, out) in list(best.items()):
                if n == i:
                    for k in legal[last]:
                        if k in ROLES:
                            new = (c + 5, au + "I", (*out, (ROLES[k], "")))
                            if new < best.get((k, i), (1 << 30,)):
                                best[k, i] = new
        if i == len(rows):
            break
        _, _, r, x = rows[i]
        extra = 5 if faults[i] == "truncated" else 0
        for (last, n), (c, au, out) in list(best.items()):
            if n != i:
                continue
            options = [(last, c + 2, au + "D", out)]
            if faults[i] not in ("blank", "duplicate"):
                if r[:1] and r[:1] in legal[last]:
                    options.append((r[:1], c + extra, au + "K", (*out, (r, x))))
                options += [(k, c + 1 + extra, au + "R", (*out, (ROLES[k], x))) for k in legal[last] if k in ROLES]
            for k, *new in options:
                if tuple(new) < best.get((k, i + 1), (1 << 30,)):
                    best[k, i + 1] = tuple(new)
    cost, audit, out = min(best[k, len(rows)] for k in ("", "a") if (k, len(rows)) in best)
    turns = [t for _, t, _, _ in rows if t is not None]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
            sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:])), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{x}" for r, x in out).encode()).hexdigest())


def expected(rows):
    return {c: plain([r for r in damage(rows) if r[0] == c]) for c in {r[0] for r in rows}}


def got(df, chunk=R.CHUNK):
    rows = R.summaries(R.repair(R.damaged(df), chunk=chunk)).collect()
    assert len({r["conv"] for r in rows}) == len(rows)
    return {r["conv"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in rows}


def talk(rng, conv, n):
    texts = ["Yes.", "No!", "", " \t", "why", "so it is ", "Well?  ", None, "a.b", "ok.\n", "é."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "sys", "User"]
    return [(conv, rng.choice([i, i, i, None, 2 * i, 0]), rng.choice(roles), rng.choice(texts)) for i in range(n)]


def test_brute_force_over_all_edit_lists():
    """The state search of this file against every edit list of short talks."""
    rng = random.Random(1)
    for _ in range(60):
        rows = damage(talk(rng, 5, rng.randint(0, 3)))[:3]
        seen, best = set(), None
        per = []
        for _, _, r, x in rows:
            t = x.strip(" \t\n\x0b\x0c\r")
            dead = not t or (r, x) in seen
            seen.add((r, x))
            extra = 0 if dead or t[-1] in ".!?" else 5
            per.append([(2, "D", None)] + ([] if dead else [(extra, "K", (r, x)), (1 + extra, "R", ("user", x)), (1 + extra, "R", ("assistant", x))]))
        inserts = [()] + [p for n in (1, 2) for p in itertools.product(("user", "assistant"), repeat=n)]
        for gaps in itertools.product(inserts, repeat=len(rows) + 1):
            if sum(map(len, gaps)) > 2:
                continue
            for choice in itertools.product(*per):
                cost, audit, out = 5 * sum(map(len, gaps)), "", []
                for g, c in itertools.zip_longest(gaps, choice):
                    audit += "I" * len(g)
                    out += [(r, "") for r in g]
                    if c:
                        cost, audit = cost + c[0], audit + c[1]
                        out += [c[2]] if c[2] else []
                if any(not r for r, _ in out):
                    continue
                if re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in out)):
                    best = min(best or (1 << 30,), (cost, audit, tuple(out)))
        digest = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in best[2]).encode()).hexdigest()
        assert plain(rows)[5:] == (best[0], best[1], digest)


@pytest.mark.parametrize("chunk", [2, 5, 8192])
def test_repair_equals_plain_search(frame, chunk):
    rng = random.Random(chunk)
    rows = [r for c in range(40) for r in talk(rng, c, rng.randint(1, 14))] + talk(rng, None, 9)
    rows += [r for r in talk(rng, 99, 160)] + [(98, 3, "user", "Same.")] * 30
    assert got(frame(rows, SCHEMA), chunk) == expected(rows)


def test_vectors_converge_in_chunks():
    """Fix-up passes end with the vectors of a run over the whole."""
    rng = random.Random(3)
    rows = [(rng.choice("suat"), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(300)]
    whole = R.backward(rows, R.END)
    cut = [rows[i:i + 20] for i in range(0, 300, 20)]
    costs = [R.backward(c, R.END if i == 14 else R.SPECULATIVE) for i, c in enumerate(cut)]
    passes = 0
    while any(costs[i][-1] != costs[i + 1][0] for i in range(14)):
        starts = [c[0] for c in costs]
        costs = [R.backward(cut[i], starts[i + 1], costs[i]) if i < 14 else costs[i] for i in range(15)]
        passes += 1
    assert [v for c in costs for v in c[:-1]] + [costs[-1][-1]] == whole and passes < 14


def test_pieces_hold_the_repaired_rows(frame):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"Turn {i}.") for i in range(50)]
    pieces = R.repair(frame(rows, SCHEMA).select(F.col("conv_id").alias("conv"), "turn", "role", "text", F.lit(1).cast("long").alias("copies")), chunk=7)
    found = sorted(pieces.collect(), key=lambda r: r["piece"])
    assert len(found) > 3 and [m["text"] for p in found for m in p["messages"]] == [r[3] for r in rows]
    assert "".join(p["audit"] for p in found) == "K" * 50


def test_empty_and_odd_tables(frame):
    assert got(frame([], SCHEMA)) == {}
    df = frame([(1, 0, "user", "x" * 300_000 + "."), (1, 1, "assistant", None), (None, None, None, None)], SCHEMA)
    clash = df.withColumns({"conv": F.lit("z"), "n": F.lit(1), "part": F.lit(2), "copies": F.lit(9), "ck": F.lit(0)})
    assert got(clash) == got(df) == expected([tuple(r) for r in df.collect()])
