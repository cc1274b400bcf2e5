"""The registered queries of the operators in this subpackage, and their
DuckDB SQL where SQL can express them over whole tables."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, hnsw, langid, licenses, linecrf, linededup, minhash, mixing, packing, passages, repair, topk, warc
from ..session import scratch_path
from .common import table

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLE: dict[str, str] = {}


def query(fn):
    LLM_QUERIES[fn.__name__] = fn
    return fn


@query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; trained on the documents outside fold 0."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(langid.fold("doc_id") == 0, F.lit(False)))
    model = langid.train(docs.filter(~F.col("held_out")))
    return langid.identify(docs, model).select("doc_id", "held_out", "lang_pred", "score", "rate")


@query
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with lines cut that repeat an earlier line, equal or within
    one edit."""
    docs = table(spark, sf_dir, "documents")
    return linededup.dedup_lines(docs).select("doc_id", "text", "n_lines", "n_equal", "n_near")


LLM_ORACLE["op4_line_dedup"] = """
WITH lines AS (
  SELECT doc_id, line_no, line, lower(trim(line)) AS norm
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY norm ORDER BY doc_id, line_no) AS nth FROM lines WHERE norm <> ''),
firsts AS (
  SELECT norm, length(norm) AS n, doc_id, line_no, row_number() OVER (ORDER BY doc_id, line_no) AS at
  FROM ranked WHERE nth = 1 AND length(norm) >= 20),
sized AS (SELECT *, unnest([n, n - 1]) AS m FROM firsts),
met AS (
  SELECT DISTINCT a.norm, b.norm AS earlier, a.n, b.n AS nb
  FROM sized a JOIN sized b ON a.m = b.m AND left(a.norm, a.m // 2) = left(b.norm, b.m // 2) AND b.at < a.at
  UNION
  SELECT DISTINCT a.norm, b.norm, a.n, b.n
  FROM sized a JOIN sized b ON a.m = b.m AND right(a.norm, a.m - a.m // 2) = right(b.norm, b.m - b.m // 2) AND b.at < a.at),
spelled AS (
  SELECT norm, greatest(n, nb) AS most, string_split(norm, '') AS x, string_split(earlier, '') AS y FROM met),
agreeing AS (
  SELECT norm, most,
         list_position(list_transform(list_zip(x, y), lambda p: coalesce(p[1] = p[2], false)), false) - 1 AS head,
         list_position(list_transform(list_zip(list_reverse(x), list_reverse(y)), lambda p: coalesce(p[1] = p[2], false)), false) - 1 AS tail
  FROM spelled),
near AS (SELECT DISTINCT norm FROM agreeing WHERE head + tail >= most - 1),
judged AS (
  SELECT l.doc_id, l.line_no, l.line,
         coalesce(r.nth > 1, false) AS eq, r.nth = 1 AND near.norm IS NOT NULL AS nr
  FROM lines l LEFT JOIN ranked r USING (doc_id, line_no) LEFT JOIN near ON near.norm = l.norm)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(j.text, '') END AS text,
       CAST(coalesce(j.n_lines, 0) AS INTEGER) AS n_lines,
       CAST(coalesce(j.n_equal, 0) AS INTEGER) AS n_equal, CAST(coalesce(j.n_near, 0) AS INTEGER) AS n_near
FROM documents d LEFT JOIN (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE NOT coalesce(eq, false) AND NOT coalesce(nr, false)) AS text,
         count(*) AS n_lines, count(*) FILTER (WHERE eq) AS n_equal, count(*) FILTER (WHERE nr) AS n_near
  FROM judged GROUP BY doc_id) j USING (doc_id)
"""


@query
def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    out = minhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(F.col("doc").alias("doc_id"), "class_id", "class_size", (F.col("rk") == F.col("lead")).alias("kept"))


@query
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mixture of all sources at tempered weights: a row per reading of a
    document."""
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "mix_pass", "mix_block", "mix_order", "mix_tokens", "mix_weight")


@query
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens from all documents."""
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a record, and what reading the archives gives."""
    manifest = warc.write_archives(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    return warc.read_archives(manifest).select(
        F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast("long").alias("refers_to"))


LLM_ORACLE["op1_warc"] = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to
FROM q
"""


@query
def op6_line_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document; the field is trained on a
    bounded sample of the documents with a quality label."""
    docs = table(spark, sf_dir, "documents")
    model = linecrf.train(docs, table(spark, sf_dir, "labels"))
    return linecrf.label_lines(docs, model).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share")


@query
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices found in the documents."""
    out = licenses.scan(table(spark, sf_dir, "documents"))
    return out.withColumns({c: F.col(c).cast("long") for c in ("template", "first_word", "last_word")})


def _license_sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    notices = ", ".join(f"({i}, {quoted(n)}, {quoted(t)})" for i, (n, t) in enumerate(licenses.NOTICES))
    grams = "array_to_string(w[i:i + 4], ' ')"
    return f"""
WITH notices(template, license, text) AS (VALUES {notices}),
tw AS (SELECT template, license, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM notices),
tg AS (SELECT DISTINCT template, license, {grams} AS g FROM (SELECT *, unnest(range(1, len(w) - 3)) AS i FROM tw)),
tm AS (SELECT template, count(*) AS m, greatest(1, CAST(pow(2, ceil(log2(count(*) * 1.25))) AS BIGINT)) AS scale FROM tg GROUP BY template),
dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents),
dg AS (SELECT doc_id, i - 1 AS place, {grams} AS g FROM (SELECT *, unnest(range(1, len(w) - 3)) AS i FROM dw WHERE len(w) >= 5)),
hits AS (SELECT doc_id, template, license, m, scale, place, g FROM dg JOIN tg USING (g) JOIN tm USING (template)),
placed AS (SELECT *, place // scale AS win FROM hits UNION ALL SELECT *, place // scale - 1 FROM hits),
held AS (
  SELECT doc_id, template, license, win, count(DISTINCT g) / any_value(m) AS containment, min(place) AS first_word, max(place) + 4 AS last_word
  FROM placed GROUP BY doc_id, template, license, win, scale HAVING count(DISTINCT g) / any_value(m) >= 0.8),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, template ORDER BY containment DESC, win) AS nth FROM held)
SELECT doc_id, CAST(template AS BIGINT) AS template, license, containment, first_word, last_word FROM best WHERE nth = 1
"""


LLM_ORACLE["op3_license_scan"] = _license_sql()


@query
def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows, by inner product, of every row whose id is
    divisible by 20."""
    rows = table(spark, sf_dir, "embeddings")
    return hnsw.search(hnsw.index(rows), rows.filter(F.col("vec_id") % 20 == 0), 20)


@query
def op2_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of at least 50 words that repeat across documents."""
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


@query
def op11_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 highest integer inner products of every row whose id is divisible
    by 50, against all rows."""
    rows = table(spark, sf_dir, "embeddings")
    return topk.search(rows, rows.filter(F.col("vec_id") % 50 == 0), 5)


LLM_ORACLE["op11_topk_search"] = """
WITH rows AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND NOT coalesce(list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x))), false)),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(max(coalesce(list_inner_product(q.v, c.v), 0)) AS BIGINT) AS score
  FROM (SELECT * FROM rows WHERE vec_id % 50 = 0) q JOIN rows c ON q.vec_id <> c.vec_id GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters in all 120 orders, by language."""
    return audit.audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


LLM_ORACLE["op12_filter_audit"] = r"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
marks AS (
  SELECT doc_id, max(CAST(coalesce(quality = 1, false) AS INT)) AS good, max(CAST(coalesce(toxic = 1, false) AS INT)) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
least AS (SELECT t, min(doc_id) AS first FROM w GROUP BY t),
faults AS MATERIALIZED (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         [CAST(len(words) < 200 AS INT), CAST(100 * len(list_distinct(words)) < 50 * len(words) AS INT),
          CAST(100 * length(regexp_replace(w.t, '[^A-Z]+', '', 'g')) > 3 * length(w.t) AS INT),
          CAST(regexp_matches(w.t, '[#$%&*|]') AS INT), CAST(coalesce(w.doc_id > first, false) AS INT)] AS fails
  FROM w JOIN least USING (t) LEFT JOIN marks ON marks.doc_id = w.doc_id),
masks AS MATERIALIZED (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM faults GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c, unnest([1, 2, 3, 4, 5]) AS f),
orders AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.f, b.f, c.f, d.f, e.f] AS fs
  FROM letters a JOIN letters b ON b.f <> a.f JOIN letters c ON c.f NOT IN (a.f, b.f)
  JOIN letters d ON d.f NOT IN (a.f, b.f, c.f) JOIN letters e ON e.f NOT IN (a.f, b.f, c.f, d.f)),
gone AS (
  SELECT *, list_position(list_transform(fs, lambda f: fails[f]), 1) AS gone_at FROM masks, orders),
steps AS (
  SELECT part, filter_order, step, fs[step] AS f,
         sum(CASE WHEN gone_at IS NULL OR gone_at = 0 OR gone_at > step THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN gone_at = step THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN fails[fs[step]] = 1 AND gone_at < step THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN fails[fs[step]] = 1 AND list_sum(fails) = 1 THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN gone_at = step THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN gone_at = step THEN toxic ELSE 0 END) AS toxic_lost
  FROM gone, (SELECT unnest([1, 2, 3, 4, 5]) AS step) GROUP BY part, filter_order, step, fs[step])
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM steps
"""


@query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged conversations and their cheapest repair, a row each."""
    pieces = repair.repair(repair.damaged(table(spark, sf_dir, "conversations")))
    return repair.summaries(pieces).withColumnRenamed("conv", "conv_id")


LLM_ORACLE["op13_conversation_repair"] = r"""
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)),
         lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(key, ''), lambda c: CAST(ascii(c) AS BIGINT))),
             lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), 4294967295) % 20 AS kind
  FROM (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations), crc_table),
damaged AS (
  SELECT coalesce(CAST(conv_id AS VARCHAR), 'null') AS conv, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]+', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM raw WHERE kind <> 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
judged AS MATERIALIZED (
  SELECT conv, turn, role, text, i, left(role, 1) AS initial, left(lag(role) OVER (PARTITION BY conv ORDER BY i), 1) || left(role, 1) AS pair,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
              WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE 'fine' END AS fault,
         count(*) OVER (PARTITION BY conv) AS n
  FROM numbered),
moves(q, initial, letter, cost, q2, role2) AS (VALUES
  ('', 's', 'K', 0, 's', NULL), ('', 'u', 'K', 0, 'u', NULL), ('s', 'u', 'K', 0, 'u', NULL), ('a', 'u', 'K', 0, 'u', NULL), ('u', 'a', 'K', 0, 'a', NULL),
  ('', NULL, 'R', 1, 'u', 'user'), ('s', NULL, 'R', 1, 'u', 'user'), ('a', NULL, 'R', 1, 'u', 'user'), ('u', NULL, 'R', 1, 'a', 'assistant'),
  ('', NULL, 'D', 2, '', NULL), ('s', NULL, 'D', 2, 's', NULL), ('u', NULL, 'D', 2, 'u', NULL), ('a', NULL, 'D', 2, 'a', NULL)),
inserts(p, letters, icost, q, rows) AS (VALUES
  ('', '', 0, '', ''), ('s', '', 0, 's', ''), ('u', '', 0, 'u', ''), ('a', '', 0, 'a', ''),
  ('', 'I', 5, 'u', 'user:' || chr(10)), ('s', 'I', 5, 'u', 'user:' || chr(10)), ('a', 'I', 5, 'u', 'user:' || chr(10)), ('u', 'I', 5, 'a', 'assistant:' || chr(10)),
  ('', 'II', 10, 'a', 'user:' || chr(10) || 'assistant:' || chr(10)), ('s', 'II', 10, 'a', 'user:' || chr(10) || 'assistant:' || chr(10)),
  ('a', 'II', 10, 'a', 'user:' || chr(10) || 'assistant:' || chr(10)), ('u', 'II', 10, 'u', 'assistant:' || chr(10) || 'user:' || chr(10))),
walk AS (
  SELECT DISTINCT conv, CAST(0 AS BIGINT) AS i, '' AS state, CAST(0 AS BIGINT) AS cost, '' AS audit, '' AS out FROM judged
  UNION ALL
  SELECT w.conv, j.i, m.q2,
         w.cost + s.icost + m.cost + CASE WHEN m.letter <> 'D' AND j.fault = 'truncated' THEN 5 ELSE 0 END AS cost2,
         w.audit || s.letters || m.letter AS audit2,
         w.out || s.rows || CASE m.letter WHEN 'D' THEN '' WHEN 'K' THEN j.role || ':' || j.text || chr(10) ELSE m.role2 || ':' || j.text || chr(10) END
  FROM walk w JOIN judged j ON j.conv = w.conv AND j.i = w.i + 1 JOIN inserts s ON s.p = w.state
  JOIN moves m ON m.q = s.q AND (m.initial IS NULL OR m.initial = j.initial) AND (m.letter = 'D' OR j.fault NOT IN ('blank', 'duplicate'))
  QUALIFY row_number() OVER (PARTITION BY w.conv, m.q2 ORDER BY cost2, audit2) = 1),
ended AS (
  SELECT w.conv, w.cost + s.icost AS cost, w.audit || s.letters AS audit, w.out || s.rows AS out
  FROM walk w JOIN (SELECT conv, max(i) AS n FROM judged GROUP BY conv) e ON e.conv = w.conv AND w.i = e.n
  JOIN inserts s ON s.p = w.state AND s.q IN ('', 'a')),
best AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY cost, audit) AS nth FROM ended),
counts AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
         count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
         count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit,
       sha256(coalesce(left(out, length(out) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON c.conv = coalesce(CAST(o.conv_id AS VARCHAR), 'null')
LEFT JOIN best b ON b.conv = c.conv AND nth = 1
"""
