"""Shared DuckDB CTEs for the oracle SQL: the same derived tables as
``plans/fixtures.py``, written independently in SQL.

DuckDB notes: lambdas are ``lambda x: ...``; regex replacement groups are
``\\1``; ``unnest`` and ``generate_subscripts`` in one select list line up.
"""
from __future__ import annotations

from ..functions import patterns as P


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


TOKEN = lit(P.TOKEN)
GOLD = lit(P.GOLD)
SENT_END = lit(P.SENT_END)
SPACES = "'\\s+'"
ODD = lit(P.ODD_SPACES)
PUNCT = lit("(" + P.PUNCT_CLASS + ")")

BASE = f"""
corpora AS (
  SELECT 'documents' AS corpus, CAST(doc_id AS BIGINT) AS doc_id, text FROM documents
  UNION ALL SELECT 'conversations', CAST(conv_id * 4294967296 + turn AS BIGINT), text FROM conversations
  UNION ALL SELECT 'benchmark', CAST(item_id AS BIGINT), text FROM benchmark),
pieces AS (
  SELECT corpus, doc_id,
         string_split(regexp_replace(regexp_replace(text, {ODD}, ' ', 'g'), {SENT_END}, '\\1' || chr(1), 'g'), chr(1)) AS ss
  FROM corpora),
sent_all AS (
  SELECT corpus, doc_id, CAST(generate_subscripts(ss, 1) - 1 AS BIGINT) AS sent_id, unnest(ss) AS sent
  FROM pieces),
sent AS (
  SELECT corpus, doc_id, sent_id, sent, words FROM (
    SELECT *, list_filter(string_split_regex(regexp_replace(sent, {PUNCT}, ' \\1 ', 'g'), {SPACES}),
                          lambda x: x <> '') AS words
    FROM sent_all) WHERE len(words) > 0),
rawspan AS (
  SELECT corpus, doc_id, sent_id, regexp_extract_all(sent, {GOLD}) AS m,
         string_split_regex(sent, {GOLD}) AS g
  FROM sent WHERE regexp_matches(sent, {GOLD})),
spanpos AS (
  SELECT corpus, doc_id, sent_id, CAST(generate_subscripts(m, 1) - 1 AS BIGINT) AS span_id,
         unnest(m) AS span, unnest(g[1:len(m)]) AS gap
  FROM rawspan),
spans AS (
  SELECT corpus, doc_id, sent_id, span_id, span, se - length(span) AS s_begin, se AS s_end FROM (
    SELECT *, CAST(sum(length(gap) + length(span)) OVER (PARTITION BY corpus, doc_id, sent_id ORDER BY span_id
                   ROWS UNBOUNDED PRECEDING) AS BIGINT) AS se
    FROM spanpos)),
goldtok AS (
  SELECT corpus, doc_id, sent_id, pos, word,
         CAST(sum(length(gap) + length(word)) OVER (PARTITION BY corpus, doc_id, sent_id ORDER BY pos
              ROWS UNBOUNDED PRECEDING) AS BIGINT) AS te
  FROM (SELECT corpus, doc_id, sent_id, CAST(generate_subscripts(m, 1) - 1 AS BIGINT) AS pos,
               unnest(m) AS word, unnest(g[1:len(m)]) AS gap
        FROM (SELECT corpus, doc_id, sent_id, regexp_extract_all(sent, {TOKEN}) AS m, string_split_regex(sent, {TOKEN}) AS g
              FROM sent WHERE regexp_matches(sent, {GOLD})))),
hits AS MATERIALIZED (
  SELECT DISTINCT t.corpus, t.doc_id, t.sent_id, t.pos
  FROM goldtok t JOIN spans s
    ON t.corpus = s.corpus AND t.doc_id = s.doc_id AND t.sent_id = s.sent_id
   AND s.s_begin < t.te AND t.te - length(t.word) < s.s_end),
plain AS (
  SELECT corpus, doc_id, sent_id, CAST(generate_subscripts(words, 1) - 1 AS BIGINT) AS pos, unnest(words) AS word FROM sent),
tok AS (
  SELECT p.corpus, p.doc_id, p.sent_id, p.pos, p.word,
         CASE WHEN h.pos IS NULL THEN 0 WHEN b.pos IS NULL THEN 1 ELSE 2 END AS label
  FROM plain p LEFT JOIN hits h ON h.corpus = p.corpus AND h.doc_id = p.doc_id AND h.sent_id = p.sent_id AND h.pos = p.pos
  LEFT JOIN hits b ON b.corpus = p.corpus AND b.doc_id = p.doc_id AND b.sent_id = p.sent_id AND b.pos = p.pos - 1),
tokc AS (
  SELECT corpus, doc_id, sent_id, pos, word, CASE WHEN label > 0 THEN 1 ELSE 0 END AS label FROM tok)
"""


OFFSETS = f"""
rawtok AS (
  SELECT corpus, doc_id, sent_id, regexp_extract_all(sent, {TOKEN}) AS m,
         string_split_regex(sent, {TOKEN}) AS g
  FROM sent),
tokpos AS (
  SELECT corpus, doc_id, sent_id, CAST(generate_subscripts(m, 1) - 1 AS BIGINT) AS pos,
         unnest(m) AS word, unnest(g[1:len(m)]) AS gap
  FROM rawtok),
tokoff AS (
  SELECT corpus, doc_id, sent_id, pos, word,
         CAST(sum(length(gap) + length(word)) OVER (PARTITION BY corpus, doc_id, sent_id ORDER BY pos
              ROWS UNBOUNDED PRECEDING) AS BIGINT) AS te
  FROM tokpos)
"""


def with_base(*extra: str) -> str:
    """``WITH <base>, <extra...>`` — pass further CTEs as ``name AS (...)``."""
    parts = [BASE.strip()] + [e.strip() for e in extra if e.strip()]
    return "WITH " + ",\n".join(parts) + "\n"


def span_ctes(prefix: str, pattern: str) -> str:
    """CTEs ``{prefix}_spans`` and ``{prefix}_flag(corpus, doc_id, sent_id, pos,
    hit)`` for any rule pattern, projected onto the raw tokens of ``tokoff``."""
    p = lit(pattern)
    return OFFSETS + f""",
{prefix}_raw AS (
  SELECT corpus, doc_id, sent_id, regexp_extract_all(sent, {p}) AS m, string_split_regex(sent, {p}) AS g
  FROM sent WHERE regexp_matches(sent, {p})),
{prefix}_pos AS (
  SELECT corpus, doc_id, sent_id, CAST(generate_subscripts(m, 1) - 1 AS BIGINT) AS span_id,
         unnest(m) AS span, unnest(g[1:len(m)]) AS gap
  FROM {prefix}_raw),
{prefix}_spans AS (
  SELECT corpus, doc_id, sent_id, span_id, span, se - length(span) AS s_begin, se AS s_end FROM (
    SELECT *, CAST(sum(length(gap) + length(span)) OVER (PARTITION BY corpus, doc_id, sent_id ORDER BY span_id
                   ROWS UNBOUNDED PRECEDING) AS BIGINT) AS se
    FROM {prefix}_pos)),
{prefix}_hits AS (
  SELECT DISTINCT t.corpus, t.doc_id, t.sent_id, t.pos
  FROM tokoff t JOIN {prefix}_spans s
    ON t.corpus = s.corpus AND t.doc_id = s.doc_id AND t.sent_id = s.sent_id
   AND s.s_begin < t.te AND t.te - length(t.word) < s.s_end),
{prefix}_flag AS (
  SELECT t.corpus, t.doc_id, t.sent_id, t.pos, CAST(h.pos IS NOT NULL AS INTEGER) AS hit
  FROM tokoff t LEFT JOIN {prefix}_hits h USING (corpus, doc_id, sent_id, pos))
"""


def ngram_ctes(n: int, min_count: int) -> str:
    """``win{n}(corpus, doc_id, sent_id, pos, g)`` lower-cased windows,
    ``common{n}(g)`` the list (count >= min_count), ``rare{n}_pred`` per token."""
    leads = " || ' ' || ".join(["w"] + [f"lead(w, {k}) OVER ws" for k in range(1, n)])
    return f"""
win{n} AS (
  SELECT * FROM (
    SELECT corpus, doc_id, sent_id, pos, {leads} AS g
    FROM (SELECT corpus, doc_id, sent_id, pos, lower(word) AS w FROM tok)
    WINDOW ws AS (PARTITION BY corpus, doc_id, sent_id ORDER BY pos)) WHERE g IS NOT NULL),
common{n} AS (SELECT g FROM win{n} GROUP BY g HAVING count(*) >= {min_count}),
rare{n} AS (SELECT * FROM win{n} w WHERE NOT EXISTS (SELECT 1 FROM common{n} c WHERE c.g = w.g)),
cover{n} AS (SELECT DISTINCT corpus, doc_id, sent_id, unnest(range(pos, pos + {n})) AS pos FROM rare{n}),
rare{n}_pred AS (
  SELECT t.corpus, t.doc_id, t.sent_id, t.pos, t.word, t.label, CAST(c.pos IS NOT NULL AS INTEGER) AS pred
  FROM tokc t LEFT JOIN cover{n} c USING (corpus, doc_id, sent_id, pos))
"""


def ratio_round6(num: str, den: str) -> str:
    """SQL twin of ``functions.arrays.ratio_round6``."""
    return (f"CASE WHEN ({den}) > 0 THEN CAST(sign({num}) * ((abs({num}) * 2000000 + ({den})) // (2 * ({den}))) AS DOUBLE)"
            f" / CAST(1000000 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END")
