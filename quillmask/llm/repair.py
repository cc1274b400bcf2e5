"""Conversation structure repair: the cheapest edits that turn the rows of a
conversation into ``(s?(ua)+)?`` (an optional system row, then pairs of user and
assistant, or nothing).

*Edits.*  Keep (K) costs 0, Rerole (R) to user or assistant 1, Delete (D) 2,
Insert (I) of an empty user or assistant row 5.  Blank rows and duplicates must
be deleted; a truncated row that is not deleted adds 5.  Of the cheapest edit
lists the one whose letters come first in ASCII order counts (D < I < K < R).
Four states (nothing yet, after s, after u, after a) and a letter give the next
state, so the letters fix the repaired rows.

*Parallel Viterbi by rank convergence.*  Rows are range-partitioned by
(conversation, turn, role, text), so a conversation of any size is spread over
tasks, and cut into chunks.  Each chunk's backward cost vectors (cost to go by
state) are computed from a speculative vector at its end.  Fix-up passes give
each chunk the vector found at the start of the next one and rerun it from its
end until its vectors differ from those it had only by a constant; passes are
repeated until no chunk's start vector changes but by a constant.  Edits
depend on differences of costs only, so the stitched vectors drive the tracing:
in each state the least letter that stays on a cheapest path.  Every chunk is
traced from all four states; a walk over the chunks of a conversation picks
which holds.  A conversation that lies whole in one chunk needs none of these
exchanges and is repaired by the task that reads it, with the same functions.

*Result.*  A row per piece (chunk) of a conversation, with the repaired rows
themselves; a piece holds at most ``CHUNK`` distinct rows or about
``CHUNK_CHARS`` characters.  ``summaries`` folds pieces into a row per conversation.
A SHA-256 over a whole conversation is sequential by its definition: the pieces
of a conversation of several pieces stream through one task, one at a time.

Defined results: null role and text are one space, nulls of the key likewise.
Rows of one turn are ordered by role, then text; equal rows count as often as
they stand, all but the first as duplicates.  A null conversation id is a
conversation of its own.  Roles count by their first character, case-sensitive;
a role without one cannot be kept.  A conversation without rows gives zeros and
empty strings; an empty table no rows.  Other columns are not read.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepared, stored

CHUNK, CHUNK_CHARS = 8192, 2_000_000

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
# states: nothing yet, after s, after u, after a
START, S, U, A = range(4)
KEPT = {"s": {START: S}, "u": {START: U, S: U, A: U}, "a": {U: A}}
TURNED = {START: U, S: U, A: U, U: A}
ROLE = {U: "user", A: "assistant"}
LEGAL = {"su", "ua", "au"}
COST = {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}
# faults
FINE, TRUNC, BLANK, DUPLICATE = range(4)
PLAIN_SPACE = " \t\n\x0b\x0c\r"

Vector = tuple[int, ...]
SPECULATIVE: Vector = (0, 0, 0, 0)
FAR = 1 << 30


# --- the four-state field -----------------------------------------------------

def closed(v) -> Vector:
    """Costs to go with insertions: they lead from any state to u, from u to a."""
    u, a = min(v[U], v[A] + INSERT), min(v[A], v[U] + INSERT)
    return min(v[START], u + INSERT), min(v[S], u + INSERT), u, a


END = closed((0, FAR, FAR, 0))


def before(v: Vector, initial: str, fault: int) -> Vector:
    """Costs to go before a row, from those after it."""
    if fault >= BLANK:
        return tuple(c + DELETE for c in v)
    extra = TRUNCATED if fault == TRUNC else 0
    kept = KEPT.get(initial, {})
    out = [min(v[q] + DELETE, v[TURNED[q]] + REROLE + extra) for q in range(4)]
    for q, to in kept.items():
        out[q] = min(out[q], v[to] + KEEP + extra)
    return closed(out)


def normal(v: Vector) -> Vector:
    low = min(v)
    return tuple(c - low for c in v)


def backward(rows: list[tuple[str, int]], end: Vector, known: list[Vector] | None = None) -> list[Vector]:
    """Cost vectors before each row and at the end, least cost 0.  With the
    vectors ``known`` of an earlier pass, the rows are run again from the end
    only up to where a vector equals the known one."""
    out = [()] * len(rows) + [normal(end)] if known is None else [*known[:-1], normal(end)]
    for i in range(len(rows) - 1, -1, -1):
        v = normal(before(out[i + 1], *rows[i]))
        if known is not None and v == known[i]:
            break
        out[i] = v
    return out


def edits(rows: list[tuple[str, int]], costs: list[Vector], q: int, last: bool) -> tuple[list[str], int]:
    """The letters at each row (insertions before it, then its own; after the
    ``last`` chunk's rows an entry for insertions there), least in ASCII order
    of the cheapest from state ``q``; and the state at the end."""
    out = []
    for i, (initial, fault) in enumerate(rows):
        after, here, letters = costs[i + 1], before(costs[i + 1], initial, fault), ""
        extra = TRUNCATED if fault == TRUNC else 0
        while True:
            if after[q] + DELETE == here[q]:
                letters += "D"
            elif here[TURNED[q]] + INSERT == here[q]:
                letters, q = letters + "I", TURNED[q]
                continue
            elif q in KEPT.get(initial, {}) and after[KEPT[initial][q]] + KEEP + extra == here[q]:
                letters, q = letters + "K", KEPT[initial][q]
            else:
                letters, q = letters + "R", TURNED[q]
            break
        out.append(letters)
    if last:
        letters = ""
        while q not in (START, A):
            letters, q = letters + "I", TURNED[q]
        out.append(letters)
    return out, q


def applied(letters: list[str], messages: list[tuple[str, str]], faults: list[int], copies: list[int], q: int) -> tuple[str, int, list]:
    """Audit, cost and repaired (role, text) rows; further copies of a row are
    deleted behind it."""
    audit, cost, out = [], 0, []
    for i, ls in enumerate(letters):
        for c in ls:
            cost += COST[c]
            if c == "I":
                q = TURNED[q]
                out.append((ROLE[q], ""))
            elif c != "D":
                role, text = messages[i]
                q = KEPT[role[:1]][q] if c == "K" else TURNED[q]
                out.append((role if c == "K" else ROLE[q], text))
                cost += TRUNCATED if faults[i] == TRUNC else 0
        audit.append(ls)
        if i < len(copies) and copies[i] > 1:
            audit.append("D" * (copies[i] - 1))
            cost += DELETE * (copies[i] - 1)
    return "".join(audit), cost, out


def fault_of(text: str) -> int:
    """Fault of a row that repeats no earlier one."""
    t = text.rstrip(PLAIN_SPACE)
    return BLANK if not t else FINE if t[-1] in ".!?" else TRUNC


# --- damage ---------------------------------------------------------------------

def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, copies): the rows with the damage that the CRC of
    ``conv:turn`` picks; dropped rows stand as empty ones with no copy, so that
    their conversation is known."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col(conv).cast("string"), blank), F.lit(":"), F.coalesce(F.col(turn).cast("string"), blank))
    kind = F.pmod(F.crc32(key.cast("binary")), F.lit(20))
    r, t = F.coalesce(F.col(role), blank), F.coalesce(F.col(text), blank)
    d = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), r.alias("role"), t.alias("text"), kind.alias("kind"))
    gone = F.col("kind") == 0
    return d.select("conv", F.when(~gone, F.col("turn")).alias("turn"),
                    F.when(gone, "").when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
                    F.when(gone | (F.col("kind") == 1), "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]+", ""))
                    .otherwise(F.col("text")).alias("text"),
                    F.when(gone, 0).when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("copies"))


# --- chunks -----------------------------------------------------------------------

MESSAGES = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))
NUMBERS = ["blank", "duplicate", "truncated", "illegal"]


def chunk_schema(conv: T.DataType) -> T.StructType:
    f = T.StructField
    return T.StructType([
        f("conv", conv), f("seq", T.LongType()), f("open", T.BooleanType()), f("messages", MESSAGES), f("copies", T.ArrayType(T.LongType())),
        f("firsts", T.ArrayType(T.StructType([f("pos", T.IntegerType()), f("digest", T.BinaryType())]))),
        f("low", T.LongType()), f("high", T.LongType()), f("turns", T.LongType()), f("head", T.StringType()), f("tail", T.StringType()),
        f("rows", T.LongType()), f("audit", T.StringType()), f("cost", T.LongType()), *[f(c, T.LongType()) for c in NUMBERS]])


def described(messages: list[tuple[str, str]], turns: list, copies: list[int]) -> dict:
    """What a chunk contributes whatever its neighbours are."""
    at = [t for t in turns if t is not None]
    initials = [r[:1] for r, _ in messages]
    illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])) + sum(c - 1 for c in copies)
    return {"low": min(at, default=None), "high": max(at, default=None), "turns": len(set(at)), "rows": sum(copies), "illegal": illegal,
            "head": initials[0] if initials else None, "tail": initials[-1] if initials else None}


def counted(faults: list[int], copies: list[int]) -> dict:
    """Rows by fault; further copies of a row that isn't blank are duplicates."""
    n = {c: 0 for c in NUMBERS[:3]}
    for f, c in zip(faults, copies):
        if f == BLANK:
            n["blank"] += c
        else:
            n["duplicate"] += c - (f != DUPLICATE)
            n["truncated"] += f == TRUNC
    return n


def local_faults(messages: list[tuple[str, str]]) -> tuple[list[int], list[int]]:
    """Faults as far as the chunk shows, and the places of the rows that are
    no duplicates within it and not blank."""
    seen: set = set()
    faults, firsts = [], []
    for i, m in enumerate(messages):
        f = fault_of(m[1])
        if f != BLANK:
            if m in seen:
                f = DUPLICATE
            else:
                seen.add(m)
                firsts.append(i)
        faults.append(f)
    return faults, firsts


def fields(messages: list[tuple[str, str]], faults: list[int]) -> list[tuple[str, int]]:
    return [(m[0][:1], f) for m, f in zip(messages, faults)]


def cut_up(batches: Iterator, schema: T.StructType, chunk: int, chars: int) -> Iterator:
    """Sorted rows (conv, turn, role, text, n, part) -> chunks.  A conversation
    within one chunk, neither first nor last of its partition, is repaired."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow, out, size = to_arrow_schema(schema), [], 0
    held: dict | None = None
    part, number = 0, 0

    def emitted(h: dict, is_open: bool) -> dict:
        nonlocal number
        row = {"conv": h["conv"], "seq": (part << 32) + number, "open": is_open, "audit": None, "cost": None,
               **{c: None for c in NUMBERS}, **described(h["messages"], h["turns"], h["copies"])}
        number += 1
        faults, firsts = local_faults(h["messages"])
        if is_open:
            digests = [hashlib.sha256(f"{len(r)}:{r}{t}".encode("utf-8", "surrogatepass")).digest() for r, t in (h["messages"][i] for i in firsts)]
            row |= {"copies": h["copies"], "firsts": [{"pos": i, "digest": d} for i, d in zip(firsts, digests)]}
            messages = h["messages"]
        else:
            rows = fields(h["messages"], faults)
            letters, _ = edits(rows, backward(rows, END), START, True)
            row["audit"], row["cost"], messages = applied(letters, h["messages"], faults, h["copies"], START)
            row |= {"copies": None, "firsts": None} | counted(faults, h["copies"])
        return row | {"messages": [{"role": r, "text": t} for r, t in messages]}

    def flushed() -> "pa.RecordBatch":
        nonlocal out, size
        done = pa.RecordBatch.from_pylist(out, schema=arrow)
        out, size = [], 0
        return done

    first, missing = True, object()
    conv: object = missing
    for batch in batches:
        cols = [batch.column(i).to_pylist() for i in range(6)]
        for c, turn, role, text, n, part in zip(*cols):
            if held is None or c != conv:
                if held is not None:
                    out.append(emitted(held, first or held["cut"]))
                    first = False
                conv, held = c, {"conv": c, "messages": [], "turns": [], "copies": [], "chars": 0, "cut": False}
            elif len(held["messages"]) >= chunk or held["chars"] + len(text) > chars and held["messages"]:
                out.append(emitted(held, True))
                size += held["chars"]
                held = {"conv": c, "messages": [], "turns": [], "copies": [], "chars": 0, "cut": True}
            if n:
                held["messages"].append((role, text))
                held["turns"].append(turn)
                held["copies"].append(n)
                held["chars"] += len(text)
                size += len(text)
            if size > 2 * chars or len(out) >= 4096:
                yield flushed()
    if held is not None:
        out.append(emitted(held, True))
    if out:
        yield flushed()


def chunks_of(rows: DataFrame, chunk: int, chars: int) -> DataFrame:
    order = ["conv", "turn", "role", "text"]
    whole = rows.groupBy(*order).agg(F.sum("copies").alias("n"))
    whole = whole.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id().cast("long"))
    schema = chunk_schema(rows.schema["conv"].dataType)
    return stored(whole.mapInArrow(lambda b: cut_up(b, schema, chunk, chars), schema), "repair-chunks")


# --- rank convergence over chunks ----------------------------------------------------

def as_bytes(costs: list[Vector]) -> bytes:
    """The vectors of a chunk; their spread is under 20, so a byte holds a cost."""
    return np.array(costs, dtype=np.uint8).tobytes()


def as_vectors(raw: bytes) -> list[Vector]:
    return [tuple(v) for v in np.frombuffer(raw, dtype=np.uint8).reshape(-1, 4).tolist()]


def known_rows(initials: list[str], faults: bytes) -> list[tuple[str, int]]:
    return list(zip(initials, faults))


VECTORS = "ck string, seq long, next long, initials array<string>, faults binary, costs binary, start binary, used binary"


def first_pass(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every chunk from its speculative (the last: its true) end vector."""
    for pdf in batches:
        out = []
        for r in pdf.itertuples(index=False):
            mine = set(r.mine) if r.mine is not None else set()
            faults = bytes(DUPLICATE if f in (FINE, TRUNC) and i not in mine else f for i, f in enumerate(r.faults))
            end = END if r.next is None or r.next != r.next else SPECULATIVE
            costs = backward(known_rows(list(r.initials), faults), end)
            out.append((faults, as_bytes(costs), as_bytes(costs[:1]), as_bytes(costs[-1:])))
        pdf = pdf.drop(columns=["mine", "faults"])
        for i, c in enumerate(("faults", "costs", "start", "used")):
            pdf[c] = [o[i] for o in out]
        yield pdf[[c.split()[0] for c in VECTORS.split(", ")]]


def fix_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Chunks with the vector ``wanted`` found at the start of the next one."""
    for pdf in batches:
        out = []
        for r in pdf.itertuples(index=False):
            if r.wanted is None or r.wanted == r.used:
                out.append((r.costs, r.start, r.used))
                continue
            costs = backward(known_rows(list(r.initials), r.faults), as_vectors(r.wanted)[0], as_vectors(r.costs))
            out.append((as_bytes(costs), as_bytes(costs[:1]), as_bytes(costs[-1:])))
        for i, c in enumerate(("costs", "start", "used")):
            pdf[c] = [o[i] for o in out]
        yield pdf[[c.split()[0] for c in VECTORS.split(", ")]]


def converged(chunks: DataFrame) -> DataFrame:
    """(ck, seq, next, initials, faults, costs, ...) with the true cost vectors."""
    first = chunks.select("ck", "seq", F.explode("firsts").alias("x")).groupBy("ck", "x.digest").agg(F.min(F.struct("seq", "x.pos")).alias("m"))
    mine = first.groupBy("ck", F.col("m.seq").alias("seq")).agg(F.collect_list("m.pos").alias("mine"))
    from pyspark.sql import Window
    after = chunks.select("ck", "seq").withColumn("next", F.lead("seq").over(Window.partitionBy("ck").orderBy("seq")))
    last_char = F.transform("messages", lambda m: F.regexp_extract(m["text"], r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1))
    faults = F.transform(last_char, lambda c: F.when(c == "", BLANK).when(c.isin(".", "!", "?"), FINE).otherwise(TRUNC))
    codes = chunks.select("ck", "seq", F.transform("messages", lambda m: F.substring(m["role"], 1, 1)).alias("initials"), faults.alias("faults"))
    codes = codes.join(after, ["ck", "seq"]).join(mine, ["ck", "seq"], "left").select("ck", "seq", "next", "initials", "faults", "mine")
    at = stored(codes.mapInPandas(first_pass, VECTORS), "repair-pass")
    while True:
        ahead = at.select("ck", F.col("seq").alias("next"), F.col("start").alias("wanted"))
        if at.join(ahead, ["ck", "next"]).filter("wanted <> used").isEmpty():
            return at
        at = stored(at.join(ahead, ["ck", "next"], "left").mapInPandas(fix_up, VECTORS), "repair-pass")


def entered(vectors: DataFrame) -> DataFrame:
    """(ck, seq, state, piece, pieces): the state in which each chunk begins."""

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                rows, costs = known_rows(list(r.initials), r.faults), as_vectors(r.costs)
                out.append([edits(rows, costs, q, False)[1] for q in range(4)])
            yield pd.DataFrame({"ck": pdf["ck"], "seq": pdf["seq"], "ends": out})

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        state, q = [], START
        for e in pdf["ends"]:
            state.append(q)
            q = int(e[q])
        return pd.DataFrame({"ck": pdf["ck"], "seq": pdf["seq"], "state": state, "piece": range(len(pdf)), "pieces": len(pdf)})

    maps = vectors.select("ck", "seq", "initials", "faults", "costs").mapInPandas(ends, "ck string, seq long, ends array<int>")
    return maps.groupBy("ck").applyInPandas(walk, "ck string, seq long, state int, piece int, pieces int")


def stitched(batches: Iterator, schema: T.StructType) -> Iterator:
    """Chunks with their state, costs and faults -> pieces."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(schema)
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            messages, faults = [(m["role"], m["text"]) for m in r["messages"]], list(r["faults"])
            letters, _ = edits(fields(messages, faults), as_vectors(r["costs"]), r["state"], r["next"] is None)
            audit, cost, rows = applied(letters, messages, faults, r["copies"], r["state"])
            row = {c: r[c] for c in schema.names if c in r} | counted(faults, r["copies"])
            out.append(row | {"audit": audit, "cost": cost, "messages": [{"role": a, "text": b} for a, b in rows]})
        yield pa.RecordBatch.from_pylist(out, schema=arrow)


PIECE = ["conv", "piece", "pieces", "messages", "audit", "cost", *NUMBERS, "low", "high", "turns", "head", "tail", "rows"]


def repair(rows: DataFrame, chunk: int = CHUNK, chars: int = CHUNK_CHARS) -> DataFrame:
    """Pieces of the repaired conversations of ``rows`` (conv, turn, role, text,
    copies): conv, piece (from 0), pieces, messages (the repaired rows), audit,
    cost, counts by fault, and what joins pieces (turns, first and last role)."""
    spark = prepared(rows.sparkSession)
    parts = chunks_of(rows, chunk, chars)
    ck = F.when(F.col("conv").isNull(), "n").otherwise(F.concat(F.lit("c"), F.col("conv").cast("string")))
    whole = parts.filter("not open").withColumns({"piece": F.lit(0), "pieces": F.lit(1)}).select(*PIECE)
    opened = parts.filter("open").withColumn("ck", ck)
    vectors = converged(opened)
    states = entered(vectors)
    ready = opened.drop("audit", "cost", *NUMBERS[:3], "open", "firsts").join(states, ["ck", "seq"]) \
        .join(vectors.select("ck", "seq", "next", "faults", "costs"), ["ck", "seq"])
    schema = T.StructType([whole.schema[c] for c in PIECE])
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "32")       # each row is a chunk
    try:
        rest = stored(ready.mapInArrow(lambda b: stitched(b, schema), schema), "repair-pieces")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    return whole.unionByName(rest)


def rendered(messages: Column) -> Column:
    return F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(":"), m["text"])), "\n")


def gaps(low, high, turns) -> Column:
    return F.coalesce(F.col(high) - F.col(low) + 1 - F.col(turns), F.lit(0)).cast("long")


SUMMARY = ["gaps", *NUMBERS, "cost", "audit", "repaired_sha256"]


def summaries(pieces: DataFrame) -> DataFrame:
    """A row per conversation: gaps, counts, cost, audit, and the SHA-256 of its
    repaired rows (``role:text``, joined by newlines)."""
    one = pieces.filter("pieces = 1").select(
        "conv", gaps("low", "high", "turns").alias("gaps"), *NUMBERS, "cost", "audit", F.sha2(rendered(F.col("messages")), 256).alias("repaired_sha256"))
    many = pieces.filter("pieces > 1").withColumn("text", F.when(F.size("messages") > 0, rendered(F.col("messages")))).drop("messages")
    many = many.repartition("conv").sortWithinPartitions("conv", "piece")
    schema = T.StructType([one.schema[c] for c in one.columns])

    def fold(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema
        arrow, held = to_arrow_schema(schema), None

        def done(h: dict) -> "pa.RecordBatch":
            h["gaps"] = h["high"] - h["low"] + 1 - h["turns"] if h["high"] is not None else 0
            h["audit"], h["repaired_sha256"] = "".join(h["audits"]), h["sha"].hexdigest()
            return pa.RecordBatch.from_pylist([{c: h[c] for c in schema.names}], schema=arrow)

        for batch in batches:
            for r in batch.to_pylist():
                if r["piece"] == 0:
                    if held is not None:
                        yield done(held)
                    held = {"conv": r["conv"], "audits": [], "sha": hashlib.sha256(), "begun": False, "low": None, "high": None,
                            "turns": 0, "cost": 0, "tail": None, **{c: 0 for c in NUMBERS}}
                h = held
                if r["text"] is not None:
                    h["sha"].update((("\n" if h["begun"] else "") + r["text"]).encode("utf-8", "surrogatepass"))
                    h["begun"] = True
                h["audits"].append(r["audit"])
                for c in (*NUMBERS, "cost", "turns"):
                    h[c] += r[c]
                if r["head"] is not None:
                    h["illegal"] += h["tail"] is not None and h["tail"] + r["head"] not in LEGAL
                    h["tail"] = r["tail"]
                if r["low"] is not None:
                    h["turns"] -= h["high"] == r["low"]
                    h["low"], h["high"] = r["low"] if h["low"] is None else h["low"], r["high"]
        if held is not None:
            yield done(held)

    # a batch holds few pieces
    return one.unionByName(many.select("conv", "piece", "text", "audit", *NUMBERS, "cost", "low", "high", "turns", "head", "tail").mapInArrow(fold, schema))
