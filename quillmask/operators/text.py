"""Text shaping operators.

Two physical forms: ``sent`` (one row per sentence, ``words``/``labels``
arrays) for everything row-local, and ``tok`` (one row per token) for joins
and aggregates.  Sentence-level work is array functions only, so it needs no
shuffle and runs in a stream as well as in a batch.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as TX
from ..functions.arrays import let, prefix_sum
from ..session import ship_package, stored
from ..sources.tables import SENT_KEYS

VOCABULARY = 1_000_000          # words of a vocabulary that are sent to every executor


def split_sentences(docs: DataFrame, text: str = "text", keys=("corpus", "doc_id")) -> DataFrame:
    """``(keys, sent_id, sent)``; ``sent_id`` is the piece index, so the
    order of sentences survives any later shuffle."""
    return docs.select(*keys, F.posexplode(TX.sentence_pieces(F.col(text))).alias("sent_id", "sent"))


def tokenize(sents: DataFrame, sent: str = "sent", keep_empty: bool = False) -> DataFrame:
    """Add ``words`` and all-zero ``labels``; sentences without a token
    are dropped (the rule splitter never yields them)."""
    out = sents if keep_empty else sents.filter(TX.has_words(F.col(sent)))
    out = out.withColumn("words", TX.words_of(F.col(sent)))
    return out.withColumn("labels", F.array_repeat(F.lit(0), F.size("words")))


def label_with_rules(sents: DataFrame, sent: str = "sent", pattern: str = P.GOLD, out: str = "labels",
                     words: str | None = "words") -> DataFrame:
    """Gold 0/1/2 labels from rule spans on the raw sentence (row-local)."""
    n = F.size(words) if words and words in sents.columns else None
    return sents.withColumn(out, TX.gold_labels(F.col(sent), pattern, n))


def explode_tokens(sent: DataFrame, keys=SENT_KEYS, arrays=("words", "labels"),
                   names=("word", "label")) -> DataFrame:
    """Nested -> flat.  Only the key columns travel with each token."""
    z = F.arrays_zip(*[F.col(a).alias(n) for a, n in zip(arrays, names)])
    return (sent.select(*keys, F.posexplode(z).alias("pos", "t"))
                .select(*keys, "pos", *[F.col(f"t.{n}").alias(n) for n in names]))


def fold_tokens(tok: DataFrame, keys=SENT_KEYS, values=("word", "label"),
                names=("words", "labels")) -> DataFrame:
    """T4: flat -> nested; always sorted by ``pos``, never by arrival order.
    A group is one sentence, which already fitted in one input row."""
    s = F.array_sort(F.collect_list(F.struct("pos", *values)))
    g = tok.groupBy(*keys).agg(s.alias("_t"))
    def field(v):
        return F.transform("_t", lambda x: x[v])
    return g.select(*keys, *[field(v).alias(n) for v, n in zip(values, names)])


def collapse_labels(df: DataFrame, col: str = "labels") -> DataFrame:
    """T5: label > 0 -> 1 for an array column or a scalar column."""
    dt = df.schema[col].dataType.typeName()
    if dt == "array":
        return df.withColumn(col, TX.collapse(F.col(col)))
    return df.withColumn(col, F.when(F.col(col) > 0, F.lit(1)).otherwise(F.col(col)))


def lowercase_tokens(df: DataFrame, col: str = "word", on: bool = True, out: str | None = None) -> DataFrame:
    """Case folding before lookups (``on=False`` keeps the case)."""
    out = out or col
    if df.schema[col].dataType.typeName() == "array":
        expr = F.transform(col, F.lower) if on else F.col(col)
    else:
        expr = F.lower(col) if on else F.col(col)
    return df.withColumn(out, expr)


def token_offsets(sent: DataFrame, keys=SENT_KEYS, words: str = "words") -> DataFrame:
    """Character begin/end of every token in the space-joined sentence,
    by one O(n log n) prefix sum per sentence (no window shuffle)."""
    ends = prefix_sum(F.transform(words, lambda w: F.length(w) + 1))
    z = F.arrays_zip(F.col(words).alias("word"), ends.alias("c_next"))
    return (sent.select(*keys, F.posexplode(z).alias("pos", "t"))
                .select(*keys, "pos", F.col("t.word").alias("word"),
                        (F.col("t.c_next") - F.length("t.word") - 1).alias("c_begin"),
                        (F.col("t.c_next") - 1).alias("c_end")))


def render_sentences(sent: DataFrame, labels: str | None = "labels", out: str = "text",
                     token: str = P.ANON_TOKEN) -> DataFrame:
    """Per-sentence masked (or raw, ``labels=None``) rendering."""
    lab = None if labels is None else F.col(labels)
    return sent.withColumn(out, TX.render_sentence(F.col("words"), lab, token))


def mask_text(sent: DataFrame, labels: str | None = "labels", keys=("corpus", "doc_id"),
              token: str = P.ANON_TOKEN, sep: str = "\n", out: str = "masked") -> DataFrame:
    """One text per document, one mask token per sensitive word, sentences
    joined by ``sep`` in ``sent_id`` order.  The fold groups one document,
    which was one input row."""
    r = render_sentences(sent, labels, "_s", token)
    g = r.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("sent_id", "_s"))).alias("_p"))
    return g.select(*keys, F.array_join(F.transform("_p", lambda x: x["_s"]), sep).alias(out))


def raw_text(sent: DataFrame, keys=("corpus", "doc_id"), sep: str = "\n", out: str = "raw_text") -> DataFrame:
    """Unmasked rendering; ``sep=""`` reproduces the glued form of the
    original tool (last and first words of adjacent sentences touch)."""
    return mask_text(sent, labels=None, keys=keys, sep=sep, out=out)


def raw_texts(sent: DataFrame, seps: dict[str, str], keys=("corpus", "doc_id")) -> DataFrame:
    """T9 with several separators (column -> separator) from one fold."""
    r = render_sentences(sent, None, "_s")
    g = r.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("sent_id", "_s"))).alias("_p"))
    return g.select(*keys, *[F.array_join(F.transform("_p", lambda x: x["_s"]), sep).alias(out) for out, sep in seps.items()])


def anonymize_documents(docs: DataFrame, text: str = "text", keys=("corpus", "doc_id"),
                        pattern: str = P.GOLD, token: str = P.ANON_TOKEN, out: str = "masked") -> DataFrame:
    """A8 in one map stage: text -> sentences -> tokens -> rule labels ->
    masked text, all inside the document row.  No shuffle at any size; a
    document is split, labelled and rendered by the task that read it."""
    pieces = F.transform(TX.sentence_pieces(F.col(text)), lambda s: F.struct(s.alias("s"), TX.words_of(s).alias("w")))
    staged = docs.select(*keys, F.filter(pieces, lambda x: F.size(x["w"]) > 0).alias("_s"))
    labelled = F.transform("_s", lambda x: F.struct(
        x["w"].alias("w"), TX.gold_labels(x["s"], pattern, F.size(x["w"])).alias("l")))
    staged = staged.select(*keys, labelled.alias("_s"))
    return staged.select(*keys, F.array_join(F.transform("_s", lambda x: TX.render_sentence(x["w"], x["l"], token)),
                                             "\n").alias(out))


def _held_part(vocab: DataFrame, limit: int) -> DataFrame:
    """The specials and about ``limit`` entries of a stored vocabulary with the
    least ids: words met first, so the frequent ones are among them."""
    n = vocab.count()
    if n <= limit:
        return vocab
    cut = vocab.approxQuantile("id", [limit / n], 0.01)[0] if limit else -1
    return vocab.filter((F.col("id") < cut) | F.col("word").isin(P.UNK_TOKEN, P.EOS_TOKEN, P.SOS_TOKEN))


def encode_ids(sent: DataFrame, vocab: DataFrame, keys=SENT_KEYS, case_sensitive: bool = False, limit: int = VOCABULARY) -> DataFrame:
    """Words -> vocabulary ids, ``<UNK>`` id for unknown words, ``<EOS>``
    id appended.  ``vocab(word, id)`` must hold the specials; sentences without
    a word are dropped.  About ``limit`` words are sent to the executors, where
    the distinct words of an Arrow batch are looked up once.  Only words not
    among them are joined, and only their sentences put together again.
    Besides, keys are shuffled to find those that occur twice: sentences of one
    key are folded into one (``_joined_ids``)."""
    keys = list(keys)
    vocab = stored(vocab.select("word", "id"), "vocabulary")
    sent = sent.select(*keys, "words").filter(F.size("words") > 0)
    rows = _held_part(vocab.filter("word is not null"), limit).select("word", F.col("id").cast("long").alias("id")).toArrow()
    index = dict(zip(rows.column("word").to_pylist(), rows.column("id").to_pylist()))
    if len(index) < rows.num_rows or any(index.get(w) is None for w in (P.UNK_TOKEN, P.EOS_TOKEN)):
        return _joined_ids(sent, vocab, keys, case_sensitive)
    whole = vocab.count() <= limit
    twice = stored(sent.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1").select(*keys), "repeated-keys")
    if not twice.head(1):
        return _held_ids(sent, vocab, index, whole, keys, case_sensitive)
    again = twice.select(*[F.col(k).alias(f"_again_{k}") for k in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_again_{k}"))
    return _held_ids(sent.join(again, same, "left_anti"), vocab, index, whole, keys, case_sensitive) \
        .unionByName(_joined_ids(sent.join(again, same, "left_semi"), vocab, keys, case_sensitive))


def _held_ids(sent: DataFrame, vocab: DataFrame, index: dict[str, int], whole: bool, keys, case_sensitive: bool) -> DataFrame:
    """The ids of sentences, each on its own, by the words that are sent; unless
    those are the ``whole`` vocabulary, the others are joined."""
    ship_package(sent.sparkSession)
    held = sent.sparkSession.sparkContext.broadcast(index)

    @F.arrow_udf("array<long>")
    def run(words: pa.Array) -> pa.Array:
        index = held.value
        eos, other = index[P.EOS_TOKEN], index[P.UNK_TOKEN] if whole else None
        d = pc.list_flatten(words).dictionary_encode()
        found = [index.get(w, other) for w in d.dictionary.to_pylist()]
        open_ = np.array([x is None for x in found] or [False])
        ids = np.array([0 if x is None else x for x in found] or [0], dtype=np.int64)
        which = d.indices.to_numpy(zero_copy_only=False)
        end = np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False), dtype=np.int64)
        offsets = np.concatenate([[0], end + np.arange(1, len(end) + 1)])
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)),
                                        pa.array(np.insert(ids[which], end, eos), mask=np.insert(open_[which], end, False)))
    key = F.col("words") if case_sensitive else F.transform("words", F.lower)
    out = sent.select(*keys, run(key).alias("ids"), key.alias("_w"))
    if whole:
        return out.select(*keys, "ids")

    at = F.filter(F.sequence(F.lit(0), F.size("_w") - 1), lambda i: F.get("ids", i).isNull())
    rest = F.when(F.exists("ids", lambda x: x.isNull()), F.transform(at, lambda i: F.struct(i.alias("pos"), F.get("_w", i).alias("word"))))
    out = stored(out.select(*keys, "ids", F.monotonically_increasing_id().alias("_sid"), rest.alias("_rest")), "encoded")
    tok = out.filter("_rest is not null").select("_sid", F.explode("_rest").alias("t")).select("_sid", "t.pos", "t.word")
    j = tok.join(vocab, "word", "left").select("_sid", "pos", F.coalesce(F.col("id").cast("long"), F.lit(index[P.UNK_TOKEN])).alias("id"))
    folded = j.groupBy("_sid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("_found"))

    @F.arrow_udf("array<long>")
    def filled(ids: pa.Array, found: pa.Array) -> pa.Array:
        flat = pc.list_flatten(ids)
        values = pc.fill_null(flat, 0).to_numpy(zero_copy_only=False).copy()
        values[pc.is_null(flat).to_numpy(zero_copy_only=False)] = pc.list_flatten(found).to_numpy(zero_copy_only=False)
        end = np.cumsum(pc.list_value_length(ids).to_numpy(zero_copy_only=False), dtype=np.int64)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], end]).astype(np.int32)), pa.array(values))
    done = out.filter("_rest is null").select(*keys, "ids")
    return done.unionByName(out.filter("_rest is not null").join(folded, "_sid").select(*keys, filled("ids", "_found").alias("ids")))


def _joined_ids(sent: DataFrame, vocab: DataFrame, keys, case_sensitive: bool) -> DataFrame:
    """Tokens are exploded once, joined on the word, folded back per sentence."""
    unk = vocab.filter(F.col("word") == P.UNK_TOKEN).select(F.max("id")).scalar()
    eos = vocab.filter(F.col("word") == P.EOS_TOKEN).select(F.max("id")).scalar()
    tok = explode_tokens(sent, keys, arrays=("words",), names=("word",))
    key = F.col("word") if case_sensitive else F.lower("word")
    tok = tok.withColumn("_k", key)
    v = vocab.select(F.col("word").alias("_k"), F.col("id"))
    j = tok.join(v, "_k", "left").withColumn("id", F.coalesce("id", unk))
    folded = j.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("_t"))
    return folded.select(*keys, F.concat(F.transform("_t", lambda x: x["id"]), F.array(eos)).alias("ids"))


def pointer_targets(sent: DataFrame, labels: str = "labels", out: str = "targets") -> DataFrame:
    """Positions whose (collapsed) label is 1, then the sentence length
    as end marker."""
    pos = let(TX.collapse(F.col(labels)),
              lambda lab: F.filter(F.sequence(F.lit(0), F.size(lab) - 1), lambda i: lab[i] == 1))
    pos = F.when(F.size(labels) > 0, pos).otherwise(F.array().cast("array<int>"))
    return sent.withColumn(out, F.concat(pos, F.array(F.size(labels))))


def pointers_to_mask(sent: DataFrame, ptrs: str = "targets", n_col: str = "words", out: str = "preds") -> DataFrame:
    """A set of positions -> 0/1 per word; the end index is ignored."""
    seq = F.sequence(F.lit(0), F.size(n_col) - 1)
    m = F.transform(seq, lambda i: F.array_contains(ptrs, i).cast("int"))
    return sent.withColumn(out, F.when(F.size(n_col) > 0, m).otherwise(F.array().cast("array<int>")))


def decode_ids(tok_ids: DataFrame, vocab: DataFrame, id_col: str = "id", out: str = "word", limit: int = VOCABULARY) -> DataFrame:
    """Id -> word; unknown ids are an error (checked with a left anti
    join count, which is a distributed count, not a collect).  About ``limit``
    entries of the vocabulary are sent; only ids not among them are shuffled."""
    vocab = stored(vocab.select("word", "id"), "vocabulary")
    v = vocab.select(F.col("id").alias(id_col), F.col("word").alias(out))
    missing = tok_ids.select(id_col).distinct().join(v, id_col, "left_anti")
    if missing.limit(1).count() > 0:
        raise KeyError("word ids missing from the vocabulary")
    if vocab.count() <= limit:
        return tok_ids.join(F.broadcast(v), id_col, "inner")
    ids = _held_part(vocab, limit).select(F.col("id").alias(id_col)).distinct()
    held = v.join(F.broadcast(ids), id_col, "left_semi")
    return tok_ids.join(F.broadcast(held), id_col, "inner") \
        .unionByName(tok_ids.join(F.broadcast(ids), id_col, "left_anti").join(v, id_col, "inner"))


def find_placeholders(tok: DataFrame, word: str = "word") -> DataFrame:
    """The placeholder tokens of an inline-tag corpus, counted per kind."""
    return tok.filter(F.col(word).isin(P.PLACEHOLDER_TOKENS)).groupBy(word).agg(F.count(F.lit(1)).alias("n"))


def _hash_int(*cols: Column) -> Column:
    """Non-negative 32-bit integer from the first 8 hex digits of md5 over the
    key; identical in any engine that has md5."""
    k = F.concat_ws("|", *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(k), 1, 8), 16, 10).cast("long")


def pseudonymize(tok: DataFrame, seed: int = 0, word: str = "word", label: str = "label",
                 keys=("corpus", "doc_id", "sent_id", "pos"), today: str = "2020-01-01") -> DataFrame:
    """Replace placeholder tokens by deterministic surrogate values and
    mark them sensitive.  The surrogate is chosen by a hash of the token key
    and ``seed`` (reproducible, unlike a random generator): a year, a safe or
    free mail address, an ISO date within 30 years before ``today``, a time."""
    h = _hash_int(*[F.col(k) for k in keys], F.lit(seed))
    year = (F.lit(1970) + F.pmod(h, F.lit(51))).cast("string")
    user = F.concat(F.lit("user"), F.pmod(h, F.lit(10000)).cast("string"))
    mail = F.when(F.pmod(F.floor(h / 7), F.lit(2)) == 0, F.concat(user, F.lit("@example.org"))) \
        .otherwise(F.concat(user, F.lit("@mail.example.com")))
    date = F.date_format(F.date_sub(F.to_date(F.lit(today)), F.pmod(h, F.lit(10958)).cast("int")), "yyyy-MM-dd")
    secs = F.pmod(h, F.lit(86400))
    time = F.format_string("%02d:%02d:%02d", (secs / 3600).cast("int"), (F.pmod(secs, F.lit(3600)) / 60).cast("int"),
                           F.pmod(secs, F.lit(60)).cast("int"))
    w = F.col(word)
    new = (F.when(w == "&YEAR", year).when(w == "&EMAIL", mail).when(w == "&DATE", date)
            .when(w == "&TIME", time).otherwise(w))
    hit = w.isin(P.PLACEHOLDER_TOKENS)
    return tok.withColumn(label, F.when(hit, F.lit(1)).otherwise(F.col(label))).withColumn(word, new)


def in_document_order(df: DataFrame, keys=("corpus", "doc_id", "sent_id", "pos")) -> DataFrame:
    """The stored document order for any renderer or writer — a global
    sort on the keys present (range-partitioned, not one task)."""
    return df.orderBy(*[k for k in keys if k in df.columns])
