"""Column expressions for text shaping.

Every helper takes and returns a ``Column`` so it can be used on a flat
column or inside a higher-order-function lambda (per sentence of a document
row) alike.  Nothing here leaves the JVM.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .arrays import bio_from_flags, match_bounds, overlap_flags


def sentence_pieces(text: Column) -> Column:
    """The rule sentence split -> ``array<string>`` (may hold empty pieces).
    Unicode spaces and the separator character become plain spaces first, once
    per text, so that all later patterns can use the cheap ``\\s``."""
    return F.split(F.regexp_replace(F.regexp_replace(text, P.ODD_SPACES, " "), P.SENT_END, "$1" + P.SENT_SEP), P.SENT_SEP, -1)


def has_words(sent: Column) -> Column:
    """Whether ``words_of`` is not empty, without splitting."""
    return F.regexp_like(sent, F.lit(r"\S"))


def words_of(sent: Column) -> Column:
    """Pad every punctuation character with spaces, split on whitespace,
    drop empty strings."""
    padded = F.regexp_replace(sent, "(" + P.PUNCT_CLASS + ")", " $1 ")
    return F.filter(F.split(padded, r"\s+", -1), lambda w: w != "")


def raw_token_bounds(sent: Column) -> Column:
    """Tokens of the raw sentence with their character offsets.  The matcher
    yields exactly the tokens of ``words_of`` (punctuation or a run of other
    non-space characters)."""
    return match_bounds(sent, P.TOKEN)


def can_match(sent: Column, pattern: str = P.GOLD) -> Column:
    """Whether ``pattern`` matches anywhere in the raw sentence."""
    found = F.regexp_like(sent, F.lit(pattern))
    if pattern == P.GOLD:  # exact necessary condition, far cheaper than the e-mail branch
        found = F.regexp_like(sent, F.lit(P.GOLD_PRETEST)) & found
    return found


def _n_tokens(sent: Column, n_tokens: Column | None) -> Column:
    return n_tokens if n_tokens is not None else F.size(F.regexp_extract_all(sent, F.lit(P.TOKEN), 0))


def _overlaps(sent: Column, pattern: str) -> Column:
    return overlap_flags(raw_token_bounds(sent), match_bounds(sent, pattern))


def span_flags(sent: Column, pattern: str = P.GOLD, n_tokens: Column | None = None) -> Column:
    """A boolean per token: does it overlap a match of ``pattern`` on the raw
    sentence?  Sentences without any match skip the offset work entirely (and
    reuse the token count when the caller has it)."""
    return (F.when(~can_match(sent, pattern), F.array_repeat(F.lit(False), _n_tokens(sent, n_tokens)))
             .otherwise(_overlaps(sent, pattern)))


def gold_labels(sent: Column, pattern: str = P.GOLD, n_tokens: Column | None = None) -> Column:
    """Gold 0/1/2 labels of FIXTURES.md: rule spans projected to tokens, a run
    of flagged tokens is 1 (first) then 2 (inner)."""
    return (F.when(~can_match(sent, pattern), F.array_repeat(F.lit(0), _n_tokens(sent, n_tokens)))
             .otherwise(bio_from_flags(_overlaps(sent, pattern))))


def collapse(labels: Column) -> Column:
    """T5: label > 0 -> 1 on an array of labels."""
    return F.transform(labels, lambda x: F.when(x > 0, F.lit(1)).otherwise(x))


def masked_words(words: Column, labels: Column, token: str = P.ANON_TOKEN) -> Column:
    """One mask token per sensitive word (runs are not merged)."""
    return F.zip_with(words, labels, lambda w, a: F.when(a != 0, F.lit(token)).otherwise(w))


def render_sentence(words: Column, labels: Column | None = None, token: str = P.ANON_TOKEN) -> Column:
    shown = words if labels is None else masked_words(words, labels, token)
    return F.array_join(shown, " ")
