"""Near-duplicate line removal by a deletion-neighbourhood join.

Lines are compared in a folded form (outer spaces cut, lower case).  A line
goes if it equals an earlier line, or is within one edit (insertion, deletion,
substitution of a character) of one; *earlier* is by (doc_id, line number).

Two strings are within one edit exactly if they agree on a one-character
deletion at the same place (substitution), or one of them equals the other
with a character deleted.  So every line emits all of its one-character
deletions, and itself, as hashed keys; lines that meet in a key are linked.
A line of n characters has n deletions, each n long.  Two lossless steps keep
that linear in practice:

1. With one edit, one half of a line stays as it is.  Lines share a key
   (length of the shorter, half) or have no neighbour; only lines that meet
   another distinct line in such a key go on.
2. The same with blocks of about 64 characters: only blocks around which
   everything agrees with another distinct line emit their deletions, keyed
   together with the hashes of what stands before and after the block.

All members of a (key, place) group are within one edit of each other, and all
members of a key are within one edit of the line that *is* that key.  So each
needs only the group's earliest line as a witness, found by a plain minimum;
no pairs within a group are formed.  The witness's edit distance is verified.

Only DataFrame functions are used.  Defined results: null text stays null with
no lines; lines without a non-space character are never dropped; lines shorter
than ``min_chars`` are only dropped when equal; rows equal in doc_id and text
are one document and get equal results; a null doc_id sorts first.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let
from .common import fresh, prepared, stored

MIN_CHARS = 20
BLOCK = 64
SALTS = 8               # copies of a repeated line's entry, so that a hot line is spread
BROADCAST_KEYS = 1_000_000


def folded(line: Column) -> Column:
    return F.lower(F.trim(line))


def sized_broadcast(df: DataFrame, limit: int) -> DataFrame:
    """Broadcast a stored table of a checked size; beyond it, an ordinary
    (shuffled) join."""
    return F.broadcast(df) if df.count() <= limit else df


def document_key(doc_id: str, text: str) -> Column:
    """Rows with the same id and text are one document."""
    return F.xxhash64(F.col(doc_id), F.col(text))


def exploded(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row per line that has a word: rk, doc, line_no, folded, h1, h2."""
    rows = docs.select(document_key(doc_id, text).alias("rk"), F.col(doc_id).alias("doc"),
                       F.posexplode(F.split(F.col(text), "\n", -1)).alias("line_no", "line"))
    rows = rows.select("rk", "doc", "line_no", folded(F.col("line")).alias("line")).filter(F.col("line") != "")
    return rows.select("*", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), F.col("line")).alias("h2"))


def around(line: Column, shorter: Column, start: Column, end: Column) -> Column:
    """Hash of what stays if the one edit is in [start, end) of the shorter
    line: the characters before, and as many from the end as stand after."""
    return F.xxhash64(shorter, start, F.substring(line, F.lit(1), start),
                      F.right(line, shorter - end))


def halves(lines: DataFrame) -> DataFrame:
    n = F.char_length("line")
    keys = []
    for m in (n, n - 1):
        h = F.floor(m / 2).cast("int")
        keys += [around(F.col("line"), m, F.lit(0), h), around(F.col("line"), m, h, m)]
    return lines.withColumn("key", F.explode(F.array(*keys)))


def met(keyed: DataFrame, name: str) -> DataFrame:
    """Keys in which two distinct lines meet."""
    return stored(keyed.groupBy("key").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi"))
                  .filter("lo <> hi").select("key"), name)


def neighbours(lines: DataFrame, min_chars: int) -> DataFrame:
    """Distinct lines (h1, h2, line) that may have a neighbour."""
    long = lines.filter(F.char_length("line") >= min_chars).select("line", "h1", "h2")
    keyed = halves(long)
    keys = met(keyed.select("key", "h1"), "line-halves")
    hits = keyed.join(sized_broadcast(keys, BROADCAST_KEYS), "key", "left_semi")
    return stored(hits.groupBy("h1", "h2").agg(F.min("line").alias("line")), "line-candidates")


def blocks(cands: DataFrame) -> DataFrame:
    """A row per candidate line, length of the shorter, and block."""
    n = F.char_length("line")
    both = cands.withColumn("m", F.explode(F.array(n, n - 1)))
    # longer lines have longer blocks: their number grows with the root
    size = F.greatest(F.lit(BLOCK), F.ceil(F.sqrt(F.col("m")))).cast("int")
    both = both.withColumn("start", F.explode(F.sequence(F.lit(0), F.greatest(F.col("m") - 1, F.lit(0)), size)))
    both = both.withColumn("end", F.least(F.col("start") + size, F.col("m")))
    return both.withColumn("key", around(F.col("line"), F.col("m"), F.col("start"), F.col("end")))


def variants(cands: DataFrame) -> DataFrame:
    """(key, place, h1, h2): the block's deletions at each place, and at place
    -1 the block itself if the line is the shorter one."""
    parts = stored(blocks(cands), "line-blocks")
    parts = parts.join(sized_broadcast(met(parts.select("key", "h1"), "line-met"), BROADCAST_KEYS), "key", "left_semi")
    width = F.char_length("line") - F.col("m") + F.col("end") - F.col("start")
    parts = parts.withColumn("part", F.substring(F.col("line"), F.col("start") + 1, width))
    size = F.char_length("part")

    def without(i: Column) -> Column:
        left = F.substring(F.col("part"), F.lit(1), i)
        return F.struct(F.xxhash64(F.col("key"), F.concat(left, F.right(F.col("part"), size - i - 1))).alias("v"),
                        i.cast("int").alias("place"))

    whole = F.struct(F.xxhash64(F.col("key"), F.col("part")).alias("v"), F.lit(-1).alias("place"))
    deleted = F.when(size > 0, F.transform(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0))), without)) \
        .otherwise(F.array().cast("array<struct<v:bigint,place:int>>"))
    out = parts.select("h1", "h2", "line", F.explode(F.concat(F.array(whole), deleted)).alias("x"))
    return out.select("h1", "h2", "line", F.col("x.v").alias("v"), F.col("x.place").alias("place"))


def near_lines(lines: DataFrame, firsts: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Distinct lines with an earlier line within one edit: h1, h2, and the
    witness's w1, w2."""
    cands = neighbours(lines, min_chars)
    made = variants(cands).join(firsts.select("h1", "h2", "first"), ["h1", "h2"])
    made = stored(made.select("h1", "h2", "v", "place", F.struct("first", "h1", "h2").alias("me")), "line-variants")
    # the same place deleted: all within one edit of each other.  The key that
    # is a line itself: all others are within one edit of that line.
    place = made.filter("place >= 0").groupBy("v", "place").agg(F.min("me").alias("w"))
    other = made.filter("place >= 0").groupBy("v").agg(F.min("me").alias("w"))
    itself = made.filter("place < 0").groupBy("v").agg(F.min("me").alias("w"))
    links = made.filter("place >= 0").join(place, ["v", "place"]).select("h1", "h2", "me", "w") \
        .union(made.filter("place >= 0").join(itself, "v").select("h1", "h2", "me", "w")) \
        .union(made.filter("place < 0").join(other, "v").select("h1", "h2", "me", "w"))
    links = links.filter(F.col("w.first") < F.col("me.first")) \
        .groupBy("h1", "h2").agg(F.min("w").alias("w")).select("h1", "h2", F.col("w.h1").alias("w1"), F.col("w.h2").alias("w2"))
    texts = cands.select("h1", "h2", "line")
    pairs = links.join(texts, ["h1", "h2"]) \
        .join(texts.select(F.col("h1").alias("w1"), F.col("h2").alias("w2"), F.col("line").alias("earlier")), ["w1", "w2"])
    return pairs.filter(F.levenshtein("line", "earlier", 1).between(0, 1)).select("h1", "h2", "w1", "w2")


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with the repeated lines cut out of ``text``, and the counts
    ``n_lines``, ``n_equal`` and ``n_near`` (lines of the text, dropped as
    equal, dropped as within one edit); columns of those names are replaced."""
    prepared(docs.sparkSession)
    lines = exploded(docs, doc_id, text)
    seen = stored(lines.select("rk", "doc", "line_no", "h1", "h2"), "lines")
    firsts = stored(seen.groupBy("h1", "h2").agg(F.min(F.struct("doc", "rk", "line_no")).alias("first"),
                                                 F.count(F.lit(1)).alias("n")), "line-firsts")
    near = near_lines(lines, firsts, min_chars).select("h1", "h2", F.lit(True).alias("near"))
    gone = firsts.join(near, ["h1", "h2"], "left").filter("n > 1 or near") \
        .select("h1", "h2", "first", F.coalesce("near", F.lit(False)).alias("near"),
                F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    dropped = seen.withColumn("salt", F.pmod(F.xxhash64("rk", "line_no"), F.lit(SALTS)).cast("int")) \
        .join(gone, ["h1", "h2", "salt"]) \
        .filter(F.col("near") | (F.col("first.rk") != F.col("rk")) | (F.col("first.line_no") != F.col("line_no")))
    # the first line of its kind is dropped only for an earlier one within an edit
    is_first = (F.col("first.rk") == F.col("rk")) & (F.col("first.line_no") == F.col("line_no"))
    per_doc = dropped.groupBy("rk").agg(F.collect_set("line_no").alias("cut"),
                                        F.collect_set(F.when(is_first, F.col("line_no"))).alias("cut_near"))
    key, cut, cut_near = fresh(docs, "rk", "cut", "cut_near")
    out = docs.withColumn(key, document_key(doc_id, text)) \
        .join(per_doc.select(F.col("rk").alias(key), F.col("cut").alias(cut), F.col("cut_near").alias(cut_near)), key, "left")
    split = F.split(F.col(text), "\n", -1)

    def without_cut(lines: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(cut))
        return F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")

    n_near = F.coalesce(F.size(cut_near), F.lit(0))
    n_cut = F.coalesce(F.size(cut), F.lit(0))
    return out.withColumns({
        text: F.when(F.col(cut).isNull(), F.col(text))
               .otherwise(let(split, without_cut)),
        "n_lines": F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size(split)),
        "n_equal": n_cut - n_near, "n_near": n_near}).drop(key, cut, cut_near)
