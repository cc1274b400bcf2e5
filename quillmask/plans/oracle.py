"""DuckDB SQL for each query of ``plans/catalog.py`` (same names, same
column aliases).  Queries with no SQL equivalent are absent."""
from __future__ import annotations

from ..functions import patterns as P
from .oracle_base import ngram_ctes, ratio_round6, span_ctes, with_base

ORACLE: dict[str, str] = {}

ORACLE["anonymize_text"] = with_base("""
sent_text AS (
  SELECT corpus, doc_id, sent_id,
         string_agg(CASE WHEN label <> 0 THEN '<ANON>' ELSE word END, ' ' ORDER BY pos) AS s
  FROM tok GROUP BY corpus, doc_id, sent_id)
""") + """
SELECT c.corpus, c.doc_id, coalesce(d.masked, '') AS masked
FROM corpora c LEFT JOIN (
  SELECT corpus, doc_id, string_agg(s, chr(10) ORDER BY sent_id) AS masked
  FROM sent_text GROUP BY corpus, doc_id) d USING (corpus, doc_id)
"""

ORACLE["split_sentences"] = with_base() + """
SELECT corpus, doc_id, sent_id, sent FROM sent
"""

ORACLE["tokenize"] = with_base() + """
SELECT corpus, doc_id, sent_id, CAST(len(words) AS BIGINT) AS n_tokens, array_to_string(words, ' ') AS tokens
FROM sent
"""

ORACLE["explode_tokens"] = with_base() + """
SELECT corpus, doc_id, sent_id, pos, word, label FROM tok
"""

ORACLE["mask_text"] = with_base("""
sent_text AS (
  SELECT corpus, doc_id, sent_id,
         string_agg(CASE WHEN label <> 0 THEN '<ANON>' ELSE word END, ' ' ORDER BY pos) AS s
  FROM tok GROUP BY corpus, doc_id, sent_id)
""") + """
SELECT corpus, doc_id, string_agg(s, chr(10) ORDER BY sent_id) AS masked
FROM sent_text GROUP BY corpus, doc_id
"""

ORACLE["raw_text"] = with_base("""
sent_text AS (
  SELECT corpus, doc_id, sent_id, string_agg(word, ' ' ORDER BY pos) AS s
  FROM tok GROUP BY corpus, doc_id, sent_id)
""") + """
SELECT corpus, doc_id, string_agg(s, chr(10) ORDER BY sent_id) AS raw_text,
       string_agg(s, '' ORDER BY sent_id) AS raw_text_glued
FROM sent_text GROUP BY corpus, doc_id
"""

ORACLE["collapse_labels"] = with_base() + """
SELECT corpus, doc_id, sent_id, string_agg(CAST(label AS VARCHAR), '' ORDER BY pos) AS labels
FROM tokc GROUP BY corpus, doc_id, sent_id
"""

ORACLE["lowercase_tokens"] = with_base() + """
SELECT lower(word) AS word, count(*) AS n FROM tok GROUP BY lower(word)
"""

ORACLE["token_offsets"] = with_base() + """
SELECT corpus, doc_id, sent_id, pos, word,
       CAST(sum(length(word) + 1) OVER w - length(word) - 1 AS BIGINT) AS c_begin,
       CAST(sum(length(word) + 1) OVER w - 1 AS BIGINT) AS c_end
FROM tok WINDOW w AS (PARTITION BY corpus, doc_id, sent_id ORDER BY pos ROWS UNBOUNDED PRECEDING)
"""

ORACLE["pointer_targets"] = with_base() + """
SELECT corpus, doc_id, sent_id,
       CASE WHEN count(*) FILTER (WHERE label = 1) > 0
            THEN string_agg(CAST(pos AS VARCHAR), ' ' ORDER BY pos) FILTER (WHERE label = 1) || ' ' || CAST(count(*) AS VARCHAR)
            ELSE CAST(count(*) AS VARCHAR) END AS targets
FROM tokc GROUP BY corpus, doc_id, sent_id
"""

ORACLE["pointers_to_mask"] = with_base() + """
SELECT corpus, doc_id, sent_id, string_agg(CAST(label AS VARCHAR), '' ORDER BY pos) AS preds
FROM tokc GROUP BY corpus, doc_id, sent_id
"""

ORACLE["ngram_windows"] = with_base(ngram_ctes(2, 2)) + """
SELECT corpus, doc_id, sent_id, pos, g FROM win2
"""

ORACLE["ngram_counts"] = with_base(ngram_ctes(2, 2)) + """
SELECT g, count(*) AS n FROM win2 GROUP BY g HAVING count(*) >= 2
"""

ORACLE["annotate_rare_ngrams"] = with_base(ngram_ctes(2, 2)) + """
SELECT corpus, doc_id, sent_id, pos, label, pred FROM rare2_pred
"""

ORACLE["known_ngrams"] = with_base(ngram_ctes(3, 2)) + """
SELECT w.corpus,
       CAST(count(*) FILTER (WHERE c.g IS NOT NULL) AS BIGINT) AS known,
       CAST(count(*) FILTER (WHERE c.g IS NULL) AS BIGINT) AS unknown
FROM win3 w LEFT JOIN common3 c USING (g) GROUP BY w.corpus
"""

ORACLE["detect_spans"] = with_base() + """
SELECT corpus, doc_id, sent_id, span_id, span, s_begin, s_end FROM spans
"""

ORACLE["project_spans"] = with_base(span_ctes("bl", P.BASELINE_SPANS)) + """
SELECT corpus, doc_id, sent_id, pos, hit AS pred FROM bl_flag
"""

_PRF = """
  CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p_,
  CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS r_
"""


def _prf_select(keys: str, src: str) -> str:
    k = (keys + ", ") if keys else ""
    return f"""
SELECT {k}tp, fp, fn, tn, round(p_, 6) AS precision, round(r_, 6) AS recall,
       round(CASE WHEN p_ + r_ > 0 THEN 2 * p_ * r_ / (p_ + r_) ELSE 0.0 END, 6) AS f1
FROM (SELECT *, {_PRF} FROM ({src}))
"""


def _conf(keys: str, src: str) -> str:
    k = (keys + ", ") if keys else ""
    g = f"GROUP BY {keys}" if keys else ""
    return f"""
SELECT {k}CAST(count(*) FILTER (WHERE label = 1 AND pred = 1) AS BIGINT) AS tp,
       CAST(count(*) FILTER (WHERE label = 0 AND pred = 1) AS BIGINT) AS fp,
       CAST(count(*) FILTER (WHERE label = 1 AND pred = 0) AS BIGINT) AS fn,
       CAST(count(*) FILTER (WHERE label = 0 AND pred = 0) AS BIGINT) AS tn
FROM {src} {g}
"""


ORACLE["annotate_ner_baseline"] = with_base(span_ctes("bl", P.BASELINE_SPANS), """
bl_pairs AS (SELECT t.corpus, t.label, f.hit AS pred FROM tokc t JOIN bl_flag f USING (corpus, doc_id, sent_id, pos))
""") + _prf_select("corpus", _conf("corpus", "bl_pairs"))

ORACLE["confusion"] = with_base(ngram_ctes(2, 2)) + _conf("corpus", "rare2_pred")

ORACLE["prf"] = with_base(ngram_ctes(2, 2)) + _prf_select("", _conf("", "rare2_pred"))

_pbd = []
for _n in (2, 3, 4):
    _pbd.append(f"SELECT {_n} AS n, corpus, * EXCLUDE (corpus) FROM ({_prf_select('corpus', _conf('corpus', f'rare{_n}_pred'))})")
ORACLE["prf_by_dataset"] = with_base(ngram_ctes(2, 2), ngram_ctes(3, 2), ngram_ctes(4, 2),
                                     "long_prf AS (" + " UNION ALL ".join(_pbd) + ")") + """
SELECT n,
  max(precision) FILTER (WHERE corpus = 'documents') AS precision_documents,
  max(recall) FILTER (WHERE corpus = 'documents') AS recall_documents,
  max(f1) FILTER (WHERE corpus = 'documents') AS f1_documents,
  max(precision) FILTER (WHERE corpus = 'conversations') AS precision_conversations,
  max(recall) FILTER (WHERE corpus = 'conversations') AS recall_conversations,
  max(f1) FILTER (WHERE corpus = 'conversations') AS f1_conversations,
  max(precision) FILTER (WHERE corpus = 'benchmark') AS precision_benchmark,
  max(recall) FILTER (WHERE corpus = 'benchmark') AS recall_benchmark,
  max(f1) FILTER (WHERE corpus = 'benchmark') AS f1_benchmark
FROM long_prf GROUP BY n
"""

ORACLE["misclassified"] = with_base(span_ctes("dg", r"\d+"), """
mc AS (
  SELECT t.corpus, t.doc_id, t.sent_id,
         string_agg(t.word, ' ' ORDER BY t.pos) AS raw_text,
         string_agg(CASE WHEN t.label <> 0 THEN '<ANON>' ELSE t.word END, ' ' ORDER BY t.pos) AS target_anon,
         string_agg(CASE WHEN f.hit <> 0 THEN '<ANON>' ELSE t.word END, ' ' ORDER BY t.pos) AS predicted_anon,
         bool_or(t.label <> f.hit) AS differs
  FROM tokc t JOIN dg_flag f USING (corpus, doc_id, sent_id, pos)
  GROUP BY t.corpus, t.doc_id, t.sent_id)
""") + """
SELECT corpus, doc_id, sent_id, raw_text, target_anon, predicted_anon FROM mc WHERE differs
"""

ORACLE["corpus_stats"] = with_base() + """
SELECT corpus, CAST(count(*) AS BIGINT) AS words, CAST(sum(label) AS BIGINT) AS annotation_sum,
       CAST(count(*) FILTER (WHERE label > 0) AS BIGINT) AS annotated_tokens,
       CAST(count(DISTINCT (corpus, doc_id, sent_id)) AS BIGINT) AS sentences,
       CAST(count(DISTINCT (corpus, doc_id)) AS BIGINT) AS documents
FROM tok GROUP BY ROLLUP (corpus)
"""

ORACLE["annotation_rate"] = with_base(ngram_ctes(2, 2)) + """
SELECT corpus, CAST(sum(pred) AS BIGINT) AS annotated, CAST(count(*) AS BIGINT) AS tokens,
       round(avg(pred), 6) AS rate
FROM rare2_pred GROUP BY corpus
"""

ORACLE["class_balance"] = with_base() + """
SELECT label, n_class, round(total / (k * n_class), 6) AS weight FROM (
  SELECT label, CAST(count(*) AS BIGINT) AS n_class, sum(count(*)) OVER () AS total, count(*) OVER () AS k
  FROM tokc GROUP BY label)
"""

ORACLE["pair_predictions"] = with_base(span_ctes("bl", P.BASELINE_SPANS)) + """
SELECT t.corpus, CAST(count(*) AS BIGINT) AS pairs, CAST(sum(CAST(t.label = f.hit AS INTEGER)) AS BIGINT) AS agree
FROM tokc t JOIN bl_flag f USING (corpus, doc_id, sent_id, pos) GROUP BY t.corpus
"""

# --- lookups, vocabulary, vectors ---------------------------------------------------------

VEC = """
types AS (SELECT lower(word) AS word, count(*) AS n FROM plain GROUP BY 1),
ranked AS (SELECT word, row_number() OVER (ORDER BY n DESC, word) - 1 AS r FROM types),
vec AS (SELECT r.word, e.embedding AS v, r.r AS line_no FROM ranked r JOIN embeddings e ON e.vec_id = r.r),
vdim AS (SELECT max(len(embedding)) AS dim FROM embeddings),
freq AS (SELECT word, n FROM types)
"""

PIECES = """
wp AS (
  SELECT word, unnest(CASE WHEN length(word) >= 3
                           THEN list_transform(range(1, length(word) - 1), lambda i: substr(word, i, 3))
                           ELSE [word] END) AS piece
  FROM (SELECT DISTINCT lower(word) AS word FROM tok)),
pcount AS (SELECT piece AS word, count(*) AS n FROM wp GROUP BY 1),
pranked AS (SELECT word, row_number() OVER (ORDER BY n DESC, word) - 1 AS r FROM pcount),
pvec AS (SELECT p.word AS piece, e.embedding AS v FROM pranked p JOIN embeddings e ON e.vec_id = p.r),
sub AS (
  SELECT wp.word, CAST(count(*) AS BIGINT) AS n_pieces,
         sum(coalesce(list_sum(list_transform(pvec.v, lambda x, i: CAST(x AS DOUBLE) * i)), 0.0)) AS s,
         sum(coalesce(list_sum(list_transform(pvec.v, lambda x: CAST(x AS DOUBLE))), 0.0)) AS plain
  FROM wp LEFT JOIN pvec USING (piece) GROUP BY wp.word)
"""

VOCAB = """
firsts AS (
  SELECT word, corpus, doc_id, sent_id, pos FROM (
    SELECT lower(word) AS word, corpus, doc_id, sent_id, pos,
           row_number() OVER (PARTITION BY lower(word) ORDER BY corpus, doc_id, sent_id, pos) AS k
    FROM tok) WHERE k = 1),
vocab AS (
  SELECT word, row_number() OVER (ORDER BY corpus, doc_id, sent_id, pos) - 1 AS id FROM firsts
  UNION ALL SELECT '<EOS>', (SELECT count(*) FROM firsts)
  UNION ALL SELECT '<UNK>', (SELECT count(*) FROM firsts) + 1
  UNION ALL SELECT '<SOS>', (SELECT count(*) FROM firsts) + 2)
"""


def vsum(v: str) -> str:
    """Checksum that weighs each component by its place (from 1)."""
    return f"list_sum(list_transform({v}, lambda x, i: CAST(x AS DOUBLE) * i))"


ORACLE["lookup_vectors"] = with_base(VEC) + f"""
SELECT t.corpus, t.doc_id, t.sent_id, t.pos, round(coalesce({vsum('vec.v')}, 0.0), 6) AS v_sum
FROM tok t LEFT JOIN vec ON vec.word = lower(t.word)
"""

ORACLE["lookup_freq"] = with_base(VEC) + """
SELECT t.corpus, t.doc_id, t.sent_id, t.pos, CAST(coalesce(f.n, 1) AS BIGINT) AS f
FROM tok t LEFT JOIN freq f ON f.word = t.word
"""

ORACLE["oov_tokens"] = with_base(VEC) + """
SELECT word, n FROM types ANTI JOIN vec USING (word)
"""

ORACLE["subword_vectors"] = with_base(PIECES) + """
SELECT word, n_pieces, round(s, 6) AS v_sum FROM sub
"""

ORACLE["combine_vectors"] = with_base(VEC, PIECES) + f"""
SELECT coalesce(vec.word, sub.word) AS word, CAST(2 * (SELECT dim FROM vdim) AS BIGINT) AS dim,
       round(coalesce({vsum('vec.v')}, 0.0) + coalesce(sub.s + (SELECT dim FROM vdim) * sub.plain, 0.0), 6) AS v_sum
FROM vec FULL OUTER JOIN sub ON vec.word = sub.word
"""

ORACLE["dedupe_vectors"] = with_base("""
ctypes AS (SELECT word, count(*) AS n FROM tok GROUP BY 1),
cranked AS (SELECT word, row_number() OVER (ORDER BY n DESC, word) - 1 AS r FROM ctypes),
cvec AS (SELECT c.word, e.embedding AS v, c.r AS line_no FROM cranked c JOIN embeddings e ON e.vec_id = c.r)
""") + f"""
SELECT lower(word) AS word, max(line_no) AS line_no, round({vsum('arg_max(v, line_no)')}, 6) AS v_sum
FROM cvec GROUP BY lower(word)
"""

ORACLE["build_vocabulary"] = with_base(VOCAB) + """
SELECT word, CAST(id AS BIGINT) AS id FROM vocab
"""

ORACLE["vocabulary_vectors"] = with_base(VEC, VOCAB) + f"""
SELECT vocab.word, CAST(vocab.id AS BIGINT) AS id,
       round(CASE vocab.word WHEN '<EOS>' THEN (SELECT dim * (dim + 1) / 2 FROM vdim) WHEN '<SOS>' THEN -(SELECT dim * (dim + 1) / 2 FROM vdim)
                            ELSE coalesce({vsum('vec.v')}, 0.0) END, 6) AS v_sum
FROM vocab LEFT JOIN vec USING (word)
"""

ORACLE["encode_ids"] = with_base(VOCAB) + """
SELECT t.corpus, t.doc_id, t.sent_id,
       string_agg(CAST(v.id AS VARCHAR), ' ' ORDER BY t.pos) || ' ' || CAST((SELECT id FROM vocab WHERE word = '<EOS>') AS VARCHAR) AS ids
FROM tok t JOIN vocab v ON v.word = lower(t.word)
GROUP BY t.corpus, t.doc_id, t.sent_id
"""

ORACLE["decode_ids"] = with_base(VOCAB) + """
SELECT corpus, doc_id, sent_id, pos, lower(word) AS word FROM tok
UNION ALL
SELECT corpus, doc_id, sent_id, CAST(count(*) AS BIGINT) AS pos, '<EOS>' AS word FROM tok
GROUP BY corpus, doc_id, sent_id
"""

ORACLE["weighted_sentence_vec"] = with_base(VEC, """
ftotal AS (SELECT CAST(sum(n) AS DOUBLE) AS total FROM freq),
sc AS (SELECT corpus, doc_id, sent_id, word, count(*) AS c FROM tok GROUP BY ALL),
wt AS (
  SELECT sc.corpus, sc.doc_id, sc.sent_id, sc.c,
         100.0 * 0.001 / (0.001 + CAST(coalesce(f.n, 1) AS DOUBLE) / (SELECT total FROM ftotal)) * sc.c AS w,
         vec.v
  FROM sc LEFT JOIN freq f ON f.word = sc.word LEFT JOIN vec ON vec.word = lower(sc.word))
""") + f"""
SELECT corpus, doc_id, sent_id, CAST(sum(c) AS BIGINT) AS n_tokens,
       round(sum(w * coalesce({vsum('v')}, 0.0)) / sum(c), 6) AS v_sum,
       round(sum(w * coalesce(CAST(v[1] AS DOUBLE), 0.0)) / sum(c), 6) AS v0
FROM wt GROUP BY corpus, doc_id, sent_id
"""

SENT_WEIGHTS = """
ftotal AS (SELECT CAST(sum(n) AS DOUBLE) AS total FROM freq),
sc AS (SELECT corpus, doc_id, sent_id, word, count(*) AS c FROM tok GROUP BY ALL),
wt AS (
  SELECT sc.corpus, sc.doc_id, sc.sent_id, sc.c,
         100.0 * 0.001 / (0.001 + CAST(coalesce(f.n, 1) AS DOUBLE) / (SELECT total FROM ftotal)) * sc.c AS w,
         vec.v
  FROM sc LEFT JOIN freq f ON f.word = sc.word LEFT JOIN vec ON vec.word = lower(sc.word))
"""

ORACLE["token_features"] = with_base(VEC, SENT_WEIGHTS, f"""
sent_sums AS (
  SELECT corpus, doc_id, sent_id,
         sum(w * coalesce({vsum('v')} + (SELECT dim FROM vdim) * list_sum(CAST(v AS DOUBLE[])), 0.0)) / sum(c) AS s
  FROM wt GROUP BY corpus, doc_id, sent_id)
""") + f"""
SELECT t.corpus, t.doc_id, t.sent_id, t.pos, t.label, CAST(2 * (SELECT dim FROM vdim) AS BIGINT) AS n_features,
       round(coalesce({vsum('vec.v')}, 0.0) + s.s, 6) AS f_sum
FROM tok t JOIN sent_sums s USING (corpus, doc_id, sent_id) LEFT JOIN vec ON vec.word = lower(t.word)
"""

ORACLE["first_direction_report"] = with_base(VEC, SENT_WEIGHTS, """
lens AS (SELECT corpus, doc_id, sent_id, sum(c) AS len FROM wt GROUP BY ALL),
cells AS (
  SELECT corpus, doc_id, sent_id, unnest(v) AS x, generate_subscripts(v, 1) AS i, w FROM wt WHERE v IS NOT NULL),
summed AS (SELECT corpus, doc_id, sent_id, i, sum(w * CAST(x AS DOUBLE)) AS x FROM cells GROUP BY ALL),
norms AS (
  SELECT corpus, doc_id, sent_id, sum((x / len) * (x / len)) AS a
  FROM summed JOIN lens USING (corpus, doc_id, sent_id) GROUP BY ALL)
""") + """
SELECT corpus, doc_id, count(*) AS sentences, round(coalesce(sum(a), 0.0), 4) AS energy, CAST(0 AS BIGINT) AS grown, true AS lone_is_zero
FROM lens LEFT JOIN norms USING (corpus, doc_id, sent_id) GROUP BY corpus, doc_id
"""

# --- learned annotators -------------------------------------------------------------------------

TRAIN = """
train AS (SELECT * FROM tok WHERE corpus = 'documents' AND doc_id % 5 <> 0)
"""

ORACLE["hmm_emissions"] = with_base(TRAIN, r"""
symbols AS (
  SELECT 'w:' || lower(word) AS own, label,
         's:' || regexp_replace(regexp_replace(regexp_replace(regexp_replace(word, '[0-9]+', '9', 'g'), '[a-z]+', 'a', 'g'),
                                               '[A-Z]+', 'A', 'g'), '[^\x00-\x7f]+', 'x', 'g') AS shape FROM train),
often AS (SELECT own FROM symbols GROUP BY own HAVING count(*) >= 2)
""") + """
SELECT CASE WHEN o.own IS NOT NULL THEN s.own ELSE s.shape END AS symbol,
       count(*) FILTER (WHERE label = 0) AS n0, count(*) FILTER (WHERE label > 0) AS n1
FROM symbols s LEFT JOIN often o USING (own) GROUP BY 1
"""

ORACLE["hmm_transitions"] = with_base(TRAIN, """
pairs AS (
  SELECT coalesce(lag(CAST(label > 0 AS INTEGER)) OVER (PARTITION BY doc_id, sent_id ORDER BY pos), -1) AS before,
         CAST(label > 0 AS INTEGER) AS after FROM train)
""") + """
SELECT before, after, count(*) AS n FROM pairs GROUP BY before, after
"""

PHRASES = """
begun AS (
  SELECT *, sum(CAST(label = 1 AS INTEGER)) OVER (PARTITION BY doc_id, sent_id ORDER BY pos) AS run FROM train),
runs AS (
  SELECT string_agg(lower(word), ' ' ORDER BY pos) AS phrase, CAST(count(*) AS INTEGER) AS n_words
  FROM begun WHERE label > 0 GROUP BY doc_id, sent_id, run),
phrases AS (SELECT phrase, n_words, count(*) AS n FROM runs GROUP BY phrase, n_words)
"""

ORACLE["learned_phrases"] = with_base(TRAIN, PHRASES) + "SELECT phrase, n_words, n FROM phrases"

PHRASE_SPANS = """
lows AS (SELECT corpus, doc_id, sent_id, list_transform(words, lambda x: lower(x)) AS ws FROM sent),
lens AS (SELECT DISTINCT n_words AS k FROM phrases),
windows AS (
  SELECT corpus, doc_id, sent_id, k, unnest(range(0, len(ws) - k + 1)) AS b, ws FROM lows, lens WHERE len(ws) >= k),
met AS (
  SELECT DISTINCT corpus, doc_id, sent_id, b, b + k AS e
  FROM windows JOIN phrases ON phrases.n_words = k AND phrase = array_to_string(ws[b + 1:b + k], ' ')),
phrase_hits AS (
  SELECT * FROM met m WHERE NOT EXISTS (
    SELECT 1 FROM met o WHERE o.corpus = m.corpus AND o.doc_id = m.doc_id AND o.sent_id = m.sent_id
      AND o.b <= m.b AND o.e >= m.e AND (o.b <> m.b OR o.e <> m.e)))
"""

ORACLE["phrase_spans"] = with_base(TRAIN, PHRASES, PHRASE_SPANS, """
langs AS (SELECT doc_id, coalesce(lang, 'none') AS lang FROM documents)
""") + """
SELECT coalesce(l.lang, h.corpus) AS corpus, h.doc_id, h.sent_id, CAST(b AS BIGINT) AS w_begin, CAST(e AS BIGINT) AS w_end
FROM phrase_hits h LEFT JOIN langs l ON h.corpus = 'documents' AND l.doc_id = h.doc_id
"""

ORACLE["annotate_phrases"] = with_base(TRAIN, PHRASES, PHRASE_SPANS, """
covered AS (SELECT DISTINCT doc_id, sent_id, unnest(range(b, e)) AS pos FROM phrase_hits WHERE corpus = 'documents'),
judged AS (
  SELECT coalesce(d.lang, 'none') AS corpus, t.label > 0 AS y, c.pos IS NOT NULL AS p
  FROM tok t JOIN documents d ON d.doc_id = t.doc_id LEFT JOIN covered c ON c.doc_id = t.doc_id AND c.sent_id = t.sent_id AND c.pos = t.pos
  WHERE t.corpus = 'documents' AND t.doc_id % 5 = 0),
cm AS (
  SELECT corpus, count(*) FILTER (WHERE y AND p) AS tp, count(*) FILTER (WHERE NOT y AND p) AS fp,
         count(*) FILTER (WHERE y AND NOT p) AS fn, count(*) FILTER (WHERE NOT y AND NOT p) AS tn FROM judged GROUP BY corpus)
""") + """
SELECT corpus, tp, fp, fn, tn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END, 6) AS precision,
       round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END, 6) AS recall,
       round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END, 6) AS f1
FROM cm
"""

# --- closed-form models over word features --------------------------------------------------------

CLASSES = """
seen AS (
  SELECT lower(word) AS word, CAST(label > 0 AS INTEGER) AS label, count(*) AS n
  FROM tok WHERE corpus = 'documents' AND doc_id % 5 <> 0 GROUP BY ALL),
totals AS (SELECT label, CAST(sum(n) AS DOUBLE) AS total FROM seen GROUP BY label),
cells AS (
  SELECT s.word, s.label, CAST(s.n AS DOUBLE) AS n, unnest(range(0, len(v))) AS i, CAST(unnest(v) AS DOUBLE) AS x
  FROM seen s JOIN vec USING (word)),
sums AS (SELECT label, i, sum(n * x) AS s1, sum(n * x * x) AS s2 FROM cells GROUP BY label, i),
eps AS (
  SELECT 1e-9 * max(v) AS e FROM (
    SELECT sum(s2) / (SELECT sum(total) FROM totals) - pow(sum(s1) / (SELECT sum(total) FROM totals), 2) AS v FROM sums GROUP BY i)),
dims AS (SELECT unnest(range(0, (SELECT max(len(embedding)) FROM embeddings))) AS i),
bayes AS (
  SELECT t.label, d.i, t.total, coalesce(s1, 0.0) / total AS mean,
         coalesce(s2, 0.0) / total - pow(coalesce(s1, 0.0) / total, 2) + (SELECT e FROM eps) AS var
  FROM totals t CROSS JOIN dims d LEFT JOIN sums s ON s.label = t.label AND s.i = d.i)
"""

ORACLE["bayes_statistics"] = with_base(VEC, CLASSES) + """
SELECT label, i AS feature, CAST(total AS BIGINT) AS n, round(mean, 6) AS mean, round(var, 6) AS variance FROM bayes
"""

ORACLE["clf_bayes_words"] = with_base(VEC, CLASSES, """
flat AS (
  SELECT label, ln(any_value(total) / (SELECT sum(total) FROM totals)) - 0.5 * sum(ln(2 * pi() * var)) AS base,
         -0.5 * sum(mean * mean / var) AS none FROM bayes GROUP BY label),
near AS (
  SELECT c.word, b.label, -0.5 * sum(pow(c.x - b.mean, 2) / b.var) AS d
  FROM (SELECT word, unnest(range(0, len(v))) AS i, CAST(unnest(v) AS DOUBLE) AS x FROM vec) c JOIN bayes b USING (i)
  GROUP BY c.word, b.label),
scores AS (SELECT word, max(CASE WHEN label = 1 THEN d + base END) - max(CASE WHEN label = 0 THEN d + base END) AS s
           FROM near JOIN flat USING (label) GROUP BY word),
nothing AS (SELECT max(CASE WHEN label = 1 THEN none + base END) - max(CASE WHEN label = 0 THEN none + base END) AS s FROM flat),
judged AS (
  SELECT coalesce(d.lang, 'none') AS corpus, t.label > 0 AS y, coalesce(s.s, (SELECT s FROM nothing)) > 0 AS p
  FROM tok t JOIN documents d ON d.doc_id = t.doc_id LEFT JOIN scores s ON s.word = lower(t.word)
  WHERE t.corpus = 'documents' AND t.doc_id % 5 = 0),
cm AS (
  SELECT corpus, count(*) FILTER (WHERE y AND p) AS tp, count(*) FILTER (WHERE NOT y AND p) AS fp,
         count(*) FILTER (WHERE y AND NOT p) AS fn, count(*) FILTER (WHERE NOT y AND NOT p) AS tn FROM judged GROUP BY corpus)
""") + """
SELECT corpus, tp, fp, fn, tn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END, 6) AS precision,
       round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END, 6) AS recall,
       round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END, 6) AS f1
FROM cm
"""

ORACLE["boost_first_stump"] = with_base(VEC, """
seen AS (
  SELECT lower(word) AS word, CAST(label > 0 AS INTEGER) AS label, CAST(count(*) AS DOUBLE) AS n
  FROM tok WHERE corpus = 'documents' AND doc_id % 5 <> 0 GROUP BY ALL),
dims AS (SELECT unnest(range(0, (SELECT dim FROM vdim))) AS i),
cells AS (
  SELECT d.i, s.label, s.n, coalesce(CAST(v[d.i + 1] AS DOUBLE), 0.0) AS x FROM seen s CROSS JOIN dims d LEFT JOIN vec USING (word)),
ranges AS (SELECT i, min(x) AS low, max(x) AS high FROM cells GROUP BY i),
uppers AS (SELECT i, list_transform(range(1, 65), lambda k: low + (high - low) * k / 64) AS u FROM ranges),
binned AS (
  SELECT c.i, label, n, least(len(list_filter(u, lambda e: e <= x)), 63) AS b FROM cells c JOIN uppers USING (i)),
hist AS (SELECT i, b, sum(CASE WHEN label = 0 THEN n ELSE 0 END) AS n0, sum(CASE WHEN label = 1 THEN n ELSE 0 END) AS n1 FROM binned GROUP BY i, b),
grid AS (SELECT i, unnest(range(0, 63)) AS b FROM dims),
lefts AS (
  SELECT g.i, g.b, sum(CASE WHEN h.b <= g.b THEN n0 ELSE 0 END) AS l0, sum(CASE WHEN h.b <= g.b THEN n1 ELSE 0 END) AS l1,
         sum(n0) AS t0, sum(n1) AS t1
  FROM grid g JOIN hist h USING (i) GROUP BY g.i, g.b),
judged AS (
  SELECT i, b, l0, l1, t0 - l0 AS r0, t1 - l1 AS r1, l0 * l1 / (l0 + l1) + (t0 - l0) * (t1 - l1) / (t0 - l0 + t1 - l1) AS impurity
  FROM lefts WHERE l0 + l1 > 0 AND t0 - l0 + t1 - l1 > 0)
""") + """
SELECT i AS feature, b AS bin, CAST(l1 > l0 AS INTEGER) AS left_class, CAST(r1 > r0 AS INTEGER) AS right_class,
       round((least(l0, l1) + least(r0, r1)) / (l0 + l1 + r0 + r1), 9) AS error
FROM judged ORDER BY impurity, i, b LIMIT 1
"""

# --- placeholders, key phrases, utility, selection, service ---------------------------------

PH = """
ph AS (
  SELECT corpus, doc_id, sent_id, pos,
         CASE WHEN pos % 97 = 3 THEN ['&YEAR', '&EMAIL', '&DATE', '&TIME'][sent_id % 4 + 1] ELSE word END AS word
  FROM plain)
"""

ORACLE["find_placeholders"] = with_base(PH) + """
SELECT word, count(*) AS n FROM ph WHERE word IN ('&YEAR', '&EMAIL', '&DATE', '&TIME') GROUP BY word
"""

ORACLE["pseudonymize"] = with_base(PH, """
ps AS (
  SELECT corpus, doc_id, sent_id, pos, word, CAST(('0x' || substr(md5(concat_ws('|', corpus, doc_id, sent_id, pos, 0)), 1, 8)) AS BIGINT) AS h
  FROM ph WHERE word IN ('&YEAR', '&EMAIL', '&DATE', '&TIME'))
""") + """
SELECT corpus, doc_id, sent_id, pos, word AS placeholder,
  CASE word
    WHEN '&YEAR' THEN CAST(1970 + h % 51 AS VARCHAR)
    WHEN '&EMAIL' THEN 'user' || CAST(h % 10000 AS VARCHAR)
                       || CASE WHEN (h // 7) % 2 = 0 THEN '@example.org' ELSE '@mail.example.com' END
    WHEN '&DATE' THEN strftime(DATE '2020-01-01' - CAST(h % 10958 AS INTEGER), '%Y-%m-%d')
    ELSE printf('%02d:%02d:%02d', (h % 86400) // 3600, (h % 3600) // 60, h % 60) END AS word,
  1 AS label
FROM ps
"""

KP = span_ctes("bl", P.BASELINE_SPANS) + """,
kp AS (
  SELECT corpus || ':' || CAST(doc_id AS VARCHAR) AS doc, word || ' ' || lead(word) OVER s AS phrase,
         greatest(label, lead(label) OVER s) AS gold, greatest(hit, lead(hit) OVER s) AS rule
  FROM tokc JOIN bl_flag USING (corpus, doc_id, sent_id, pos)
  WINDOW s AS (PARTITION BY corpus, doc_id, sent_id ORDER BY pos)),
tgt AS MATERIALIZED (SELECT doc, phrase FROM kp WHERE phrase IS NOT NULL AND gold > 0),
prd AS MATERIALIZED (SELECT doc, phrase FROM kp WHERE phrase IS NOT NULL AND rule > 0),
bothd AS (SELECT DISTINCT doc FROM tgt WHERE doc IN (SELECT doc FROM prd)),
kt AS (SELECT * FROM tgt WHERE doc IN (SELECT doc FROM bothd)),
kpp AS (SELECT * FROM prd WHERE doc IN (SELECT doc FROM bothd))
"""


def _exact_prf_sql(src: str) -> str:
    return f"""
SELECT tp, fp, fn, {ratio_round6('tp', 'tp + fp')} AS precision, {ratio_round6('tp', 'tp + fn')} AS recall,
       {ratio_round6('2 * tp', '2 * tp + fp + fn')} AS f1
FROM ({src})
"""


ORACLE["keyphrase_exact"] = with_base(KP) + _exact_prf_sql("""
SELECT CAST((SELECT count(*) FROM kt WHERE EXISTS (SELECT 1 FROM kpp WHERE kpp.doc = kt.doc AND kpp.phrase = kt.phrase)) AS BIGINT) AS tp,
       CAST((SELECT count(*) FROM kt WHERE NOT EXISTS (SELECT 1 FROM kpp WHERE kpp.doc = kt.doc AND kpp.phrase = kt.phrase)) AS BIGINT) AS fn,
       CAST((SELECT count(*) FROM kpp WHERE NOT EXISTS (SELECT 1 FROM kt WHERE kpp.doc = kt.doc AND kpp.phrase = kt.phrase)) AS BIGINT) AS fp
""")

ORACLE["keyphrase_words"] = with_base(KP, """
tw AS (SELECT doc, w, count(*) AS nt FROM (SELECT doc, unnest(string_split(phrase, ' ')) AS w FROM kt) GROUP BY ALL),
pw AS (SELECT doc, w, count(*) AS np FROM (SELECT doc, unnest(string_split(phrase, ' ')) AS w FROM kpp) GROUP BY ALL)
""") + _exact_prf_sql("""
SELECT CAST(sum(least(coalesce(nt, 0), coalesce(np, 0))) AS BIGINT) AS tp,
       CAST(sum(greatest(coalesce(nt, 0) - coalesce(np, 0), 0)) AS BIGINT) AS fn,
       CAST(sum(greatest(coalesce(np, 0) - coalesce(nt, 0), 0)) AS BIGINT) AS fp
FROM tw FULL OUTER JOIN pw USING (doc, w)
""")

ORACLE["pair_docs"] = with_base(KP) + """
SELECT split_part(doc, ':', 1) AS corpus, count(*) AS phrases, count(DISTINCT doc) AS docs
FROM tgt WHERE doc IN (SELECT doc FROM prd) GROUP BY 1
"""

LEX = """
lex AS (
  SELECT word, p0 % 201 - 100 AS polarity_c, p1 % 101 AS subjectivity_c FROM (
    SELECT word, CAST(('0x' || substr(md5(word), 1, 8)) AS BIGINT) AS p0,
           CAST(('0x' || substr(md5(word), 9, 8)) AS BIGINT) AS p1,
           CAST(('0x' || substr(md5(word), 17, 8)) AS BIGINT) AS p2
    FROM (SELECT DISTINCT lower(word) AS word FROM tok)) WHERE p2 % 10 = 0)
"""


def _senti(src: str, keys: str) -> str:
    return f"""
SELECT {keys}, CAST(coalesce(sum(l.polarity_c), 0) AS BIGINT) AS pol_c,
       CAST(coalesce(sum(l.subjectivity_c), 0) AS BIGINT) AS sub_c, count(l.polarity_c) AS matched
FROM {src} s LEFT JOIN lex l ON l.word = s.w GROUP BY {keys}
"""


ORACLE["lexicon_sentiment"] = with_base(LEX, "tw0 AS (SELECT corpus, doc_id, lower(word) AS w FROM tok)") + f"""
SELECT corpus, doc_id, matched, {ratio_round6('pol_c', 'matched * 100')} AS polarity,
       {ratio_round6('sub_c', 'matched * 100')} AS subjectivity
FROM ({_senti('tw0', 'corpus, doc_id')})
"""

DOCSCORES = LEX + f""",
dt AS (SELECT doc_id, lower(word) AS w, label FROM tok WHERE corpus = 'documents'),
da AS (SELECT doc_id, CASE WHEN label > 0 THEN NULL ELSE w END AS w FROM dt),
pure AS ({_senti('dt', 'doc_id')}),
anon AS ({_senti('da', 'doc_id')})
"""

ORACLE["utility_report"] = with_base(DOCSCORES) + f"""
SELECT p.doc_id,
       {ratio_round6('p.pol_c', 'p.matched * 100')} AS pure_polarity,
       {ratio_round6('a.pol_c', 'a.matched * 100')} AS anon_polarity,
       CASE WHEN l.quality = 1 THEN 1.0 ELSE -1.0 END::DOUBLE AS target_polarity,
       {ratio_round6('p.sub_c', 'p.matched * 100')} AS pure_subjectivity,
       {ratio_round6('a.sub_c', 'a.matched * 100')} AS anon_subjectivity,
       CAST(l.toxic AS DOUBLE) AS target_subjectivity
FROM pure p JOIN anon a USING (doc_id) JOIN labels l USING (doc_id)
"""

ORACLE["score_table"] = with_base(DOCSCORES) + f"""
SELECT p.doc_id,
       CASE WHEN p.matched > 0 THEN {ratio_round6('p.pol_c + p.matched * 100', 'p.matched * 200')}
            ELSE CAST(0.5 AS DOUBLE) END AS sent_pred,
       CAST(l.quality AS DOUBLE) AS targets
FROM pure p JOIN labels l USING (doc_id)
"""

ORACLE["best_epoch"] = with_base(ngram_ctes(2, 2), """
acc AS (
  SELECT corpus, doc_id, sent_id, sum(CAST(label = pred AS INTEGER)) / count(*) AS f1
  FROM rare2_pred GROUP BY ALL),
hist AS (SELECT *, row_number() OVER (PARTITION BY corpus, doc_id ORDER BY sent_id) AS epoch FROM acc),
h1 AS (
  SELECT *, f1 >= greatest(coalesce(max(f1) OVER (PARTITION BY corpus, doc_id ORDER BY epoch
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0), 0.0) AS hit
  FROM hist),
h2 AS (
  SELECT *, epoch - coalesce(max(CASE WHEN hit THEN epoch END) OVER (PARTITION BY corpus, doc_id ORDER BY epoch
                                 ROWS UNBOUNDED PRECEDING), 0) AS miss
  FROM h1),
runs AS (
  SELECT corpus, doc_id, least(coalesce(min(epoch) FILTER (WHERE miss >= 6), max(epoch)), 20) AS stop_epoch,
         count(*) AS epochs
  FROM h2 GROUP BY ALL)
""") + """
SELECT r.corpus, r.doc_id, CAST(max(h.epoch) AS BIGINT) AS best_epoch, CAST(r.stop_epoch AS BIGINT) AS stop_epoch,
       CAST(r.epochs AS BIGINT) AS epochs
FROM runs r JOIN h2 h USING (corpus, doc_id)
WHERE h.hit AND h.epoch <= r.stop_epoch
GROUP BY r.corpus, r.doc_id, r.stop_epoch, r.epochs
"""

_rk = []
for _n in (2, 3, 4):
    _rk.append(f"SELECT {_n} AS n, corpus, f1 FROM ({_prf_select('corpus', _conf('corpus', f'rare{_n}_pred'))})")
ORACLE["rank_configs"] = with_base(ngram_ctes(2, 2), ngram_ctes(3, 2), ngram_ctes(4, 2),
                                   "res AS (" + " UNION ALL ".join(_rk) + ")") + """
SELECT corpus, rank, n, f1 FROM (
  SELECT corpus, CAST(row_number() OVER (PARTITION BY corpus ORDER BY f1 DESC, n) AS BIGINT) AS rank, n, f1 FROM res)
WHERE rank <= 2
"""

ORACLE["request_batches"] = with_base("""
num AS (SELECT row_number() OVER (ORDER BY corpus, doc_id) - 1 AS rn FROM corpora),
tot AS (SELECT count(*) AS n, count(*) // 10 AS k FROM corpora),
b AS (SELECT CAST(CASE WHEN k > 0 THEN least(rn // k, 9) ELSE 9 END AS INTEGER) AS batch, rn FROM num, tot)
""") + """
SELECT g.batch, coalesce(c.n_docs, 0) AS n_docs, c.first_id, c.last_id FROM
  (SELECT CAST(range AS INTEGER) AS batch FROM range(10)) g
  LEFT JOIN (SELECT batch, count(*) AS n_docs, min(rn) AS first_id, max(rn) AS last_id FROM b GROUP BY batch) c USING (batch)
"""

ORACLE["parse_responses"] = with_base(KP) + """
SELECT doc AS id, phrase FROM prd
"""

# --- file formats -------------------------------------------------------------------------------

DOCSUM = """
sent_rows AS (
  SELECT corpus, doc_id, sent_id, string_agg(word, ' ' ORDER BY pos) AS w,
         string_agg(CAST(LBL AS VARCHAR), '' ORDER BY pos) AS l,
         string_agg(word || ' ' || CAST(label AS VARCHAR), chr(10) ORDER BY pos) AS std
  FROM SRC GROUP BY corpus, doc_id, sent_id),
doc_rows AS (
  SELECT row_number() OVER (ORDER BY corpus, doc_id) - 1 AS doc_index, * FROM (
    SELECT corpus, doc_id, count(*) AS sentences, string_agg(w, chr(10) ORDER BY sent_id) AS text,
           string_agg(l, '|' ORDER BY sent_id) AS labels,
           string_agg(std, chr(10) || chr(10) ORDER BY sent_id) AS std
    FROM sent_rows GROUP BY corpus, doc_id))
"""


def _docsum(src: str, lbl: str) -> str:
    return DOCSUM.replace("SRC", src).replace("LBL", lbl)


ORACLE["write_standard"] = with_base(_docsum("tok", "label")) + """
SELECT CAST(doc_index AS BIGINT) AS doc_index, chr(10) || std || chr(10) || chr(10) AS record FROM doc_rows
"""

ORACLE["read_standard"] = with_base(_docsum("tok", "CASE WHEN label > 0 THEN 1 ELSE 0 END")) + """
SELECT CAST(doc_index AS BIGINT) AS doc_index, CAST(sentences AS BIGINT) AS sentences, text, labels FROM doc_rows
"""

ORACLE["ingest_conll"] = with_base(_docsum("tok", "label")) + """
SELECT CAST(doc_index AS BIGINT) AS doc_index, CAST(sentences AS BIGINT) AS sentences, text, labels FROM doc_rows
"""

ORACLE["ingest_inline_tags"] = with_base(_docsum("tokc", "label")) + """
SELECT CAST(doc_index AS BIGINT) AS doc_index, CAST(sentences AS BIGINT) AS sentences, text, labels FROM doc_rows
"""

ORACLE["load_word_vectors"] = with_base("""
ctypes AS (SELECT word, count(*) AS n FROM tok GROUP BY 1),
cranked AS (SELECT word, row_number() OVER (ORDER BY n DESC, word) - 1 AS r FROM ctypes),
cvec AS (SELECT c.word, e.embedding AS v, c.r AS line_no FROM cranked c JOIN embeddings e ON e.vec_id = c.r),
vdim AS (SELECT max(len(embedding)) AS dim FROM embeddings)
""") + f"""
SELECT lower(word) AS word, max(line_no) AS line_no, round({vsum('arg_max(v, line_no)')}, 6) AS v_sum
FROM cvec GROUP BY lower(word)
UNION ALL SELECT '<EOS>', NULL, CAST((SELECT dim * (dim + 1) / 2 FROM vdim) AS DOUBLE)
UNION ALL SELECT '<UNK>', NULL, 0.0
UNION ALL SELECT '<SOS>', NULL, -CAST((SELECT dim * (dim + 1) / 2 FROM vdim) AS DOUBLE)
"""

ORACLE["load_word_freq"] = with_base(VEC) + """
SELECT word, n, CAST((SELECT sum(n) FROM freq) AS BIGINT) AS total FROM freq
"""

ORACLE["load_ngrams"] = with_base(ngram_ctes(3, 2)) + """
SELECT g FROM common3
"""

ORACLE["read_lines_corpus"] = with_base("""
sent_text AS (
  SELECT corpus, doc_id, sent_id,
         string_agg(CASE WHEN label <> 0 THEN '<ANON>' ELSE word END, ' ' ORDER BY pos) AS s
  FROM tok GROUP BY corpus, doc_id, sent_id)
""") + """
SELECT CAST(row_number() OVER (ORDER BY c.corpus, c.doc_id) - 1 AS BIGINT) AS doc_index, coalesce(d.masked, '') AS masked
FROM corpora c LEFT JOIN (
  SELECT corpus, doc_id, string_agg(s, chr(10) ORDER BY sent_id) AS masked
  FROM sent_text GROUP BY corpus, doc_id) d USING (corpus, doc_id)
"""

ORACLE["write_results"] = ORACLE["prf_by_dataset"]

ORACLE["split_corpus"] = with_base("""
num AS (SELECT row_number() OVER (ORDER BY corpus, doc_id) - 1 AS rn FROM corpora),
tot AS (SELECT count(*) // 3 AS k FROM corpora)
""") + """
SELECT CAST(CASE WHEN k > 0 THEN least(rn // k, 2) ELSE 2 END AS INTEGER) AS part, count(*) AS n_docs,
       min(rn) AS first_id, max(rn) AS last_id
FROM num, tot GROUP BY 1
"""

ORACLE["stream_anonymize"] = ORACLE["anonymize_text"]

ORACLE["score_batches"] = with_base() + """
SELECT corpus, doc_id, sent_id, pos, CAST(regexp_matches(word, '[0-9@]') AS INTEGER) AS pred FROM plain
"""

ORACLE["union_corpora"] = with_base() + """
SELECT corpus, count(*) AS documents, CAST(sum(length(text)) AS BIGINT) AS chars FROM corpora GROUP BY corpus
"""

ORACLE["span_token_join"] = with_base() + """
SELECT t.corpus, t.doc_id, t.sent_id, t.pos, CAST(h.pos IS NOT NULL AS INTEGER) AS pred
FROM plain t LEFT JOIN hits h USING (corpus, doc_id, sent_id, pos)
"""

ORACLE["anonymize_ngram"] = with_base(ngram_ctes(2, 2), """
sent_text AS (
  SELECT corpus, doc_id, sent_id, string_agg(CASE WHEN pred <> 0 THEN '<ANON>' ELSE word END, ' ' ORDER BY pos) AS s
  FROM rare2_pred GROUP BY corpus, doc_id, sent_id)
""") + """
SELECT corpus, doc_id, string_agg(s, chr(10) ORDER BY sent_id) AS masked FROM sent_text GROUP BY corpus, doc_id
"""

ORACLE["anonymize_held_ngrams"] = with_base("""
dwin AS (
  SELECT * FROM (
    SELECT doc_id, sent_id, pos, lower(word) || ' ' || lead(lower(word)) OVER (PARTITION BY doc_id, sent_id ORDER BY pos) AS g
    FROM tokc WHERE corpus = 'documents') WHERE g IS NOT NULL),
listed AS (SELECT DISTINCT g FROM dwin WHERE doc_id % 2 = 0),
hit AS (SELECT DISTINCT doc_id, sent_id, unnest([pos, pos + 1]) AS pos FROM dwin ANTI JOIN listed USING (g) WHERE doc_id % 2 = 1),
pairs AS (
  SELECT t.label, CAST(h.pos IS NOT NULL AS INTEGER) AS pred
  FROM tokc t LEFT JOIN hit h USING (doc_id, sent_id, pos) WHERE t.corpus = 'documents' AND t.doc_id % 2 = 1)
""") + _prf_select("", _conf("", "pairs"))

ORACLE["fold_tokens"] = with_base() + """
SELECT corpus, doc_id, sent_id, string_agg(word, ' ' ORDER BY pos) AS tokens,
       string_agg(CAST(label AS VARCHAR), '' ORDER BY pos) AS labels
FROM tok GROUP BY corpus, doc_id, sent_id
"""

ORACLE["mismatched_tokens"] = with_base(span_ctes("bl", P.BASELINE_SPANS)) + """
SELECT corpus, CAST(count(*) FILTER (WHERE label > 0 AND hit = 0) AS BIGINT) AS gold_only,
       CAST(count(*) FILTER (WHERE label = 0 AND hit > 0) AS BIGINT) AS pred_only
FROM tokc JOIN bl_flag USING (corpus, doc_id, sent_id, pos) WHERE label > 0 OR hit > 0 GROUP BY corpus
"""

_HELD = """
held AS (
  SELECT lower(t.word) AS word, t.label, count(*) AS n FROM tokc t
  WHERE t.corpus = 'documents' AND t.doc_id % 5 <> 0 GROUP BY ALL)
"""

ORACLE["training_matrix"] = with_base(_HELD) + """
SELECT word, CAST(label AS INTEGER) AS label, CAST(n AS BIGINT) AS n,
       round(n * (sum(n) OVER () / (2 * sum(n) OVER (PARTITION BY label))), 6) AS weight,
       CAST(2 * (SELECT max(len(embedding)) FROM embeddings) AS BIGINT) AS n_features
FROM held
"""
