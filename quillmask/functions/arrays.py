"""Array helpers that stay inside the JVM.

Spark has no scan (running fold) over an array, and the obvious
``transform(seq, i -> aggregate(slice(a, 1, i), ...))`` is quadratic in the
array length.  ``inclusive_scan`` instead does the log-step (Hillis-Steele)
doubling scan: ceil(log2 n)+1 passes of ``transform``, each O(n), so a
sentence of 20,000 tokens costs ~16 passes, not 2*10^8 additions.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it many times in ``body(v)``.

    A column expression referenced inside a lambda is re-evaluated per array
    element; wrapping it as the single element of an array and transforming
    that array evaluates it exactly once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _passes(n: Column) -> Column:
    return F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(n, F.lit(1)))).cast("int"))


def inclusive_scan(arr: Column, op) -> Column:
    """Inclusive scan of ``arr`` under the associative ``op(left, right)``."""
    def one_pass(acc, k):
        d = F.pow(F.lit(2), k).cast("int")
        return F.transform(acc, lambda x, i: F.when(i >= d, op(acc[i - d], x)).otherwise(x))
    return F.aggregate(_passes(F.size(arr)), arr, one_pass)


def prefix_sum(arr: Column) -> Column:
    """Inclusive running sum of an integer array."""
    return inclusive_scan(arr, lambda a, b: a + b)


def running_max(arr: Column) -> Column:
    return inclusive_scan(arr, lambda a, b: F.greatest(a, b))


def match_bounds(text: Column, pattern: str) -> Column:
    """All non-overlapping matches of ``pattern`` in ``text`` as
    ``array<struct<b:int, e:int, m:string>>`` with half-open character offsets.

    ``split`` on the same pattern yields the gaps; match i starts after
    gaps[0..i] and matches[0..i-1], which one prefix sum gives.
    """
    def with_matches(m):
        gaps = F.split(text, pattern, -1)
        step = F.zip_with(F.slice(gaps, 1, F.size(m)), m, lambda g, x: F.length(g) + F.length(x))
        return let(prefix_sum(step), lambda ends: F.transform(m, lambda x, i: F.struct(
            (ends[i] - F.length(x)).alias("b"), ends[i].alias("e"), x.alias("m"))))
    return let(F.regexp_extract_all(text, F.lit(pattern), 0), with_matches)


def overlap_flags(tokens: Column, spans: Column) -> Column:
    """For sorted, non-overlapping token intervals ``array<struct<b,e,...>>`` and
    any span intervals ``array<struct<b,e,...>>``: a boolean per token, true when
    the token overlaps at least one span (``sb < te and tb < se``).

    Sweep instead of all token x span pairs: sort span starts together with
    token ends (token first on ties, so a span starting where a token ends does
    not count), carry the running maximum span end, and a token overlaps iff
    that maximum exceeds its begin.  Cost O((T+S) log(T+S)) per row.
    """
    ev = F.array_sort(F.concat(
        F.transform(tokens, lambda t: F.struct(t["e"].alias("k"), F.lit(0).alias("kind"),
                                               F.lit(-1).alias("e"), t["b"].alias("b"))),
        F.transform(spans, lambda s: F.struct(s["b"].alias("k"), F.lit(1).alias("kind"),
                                              s["e"].alias("e"), F.lit(0).alias("b")))))

    def sweep(ev):
        return let(running_max(F.transform(ev, lambda x: x["e"])), lambda reach: F.transform(
            F.filter(F.transform(ev, lambda x, i: F.struct(x["kind"].alias("kind"),
                                                             (reach[i] > x["b"]).alias("hit"))),
                     lambda x: x["kind"] == 0),
            lambda x: x["hit"]))
    return let(ev, sweep)


def bio_from_flags(flags: Column) -> Column:
    """0 outside, 1 on the first flagged token of a run, 2 inside a run."""
    return let(flags, lambda fl: F.transform(fl, lambda f, i: F.when(~f, F.lit(0))
                                             .when((i > 0) & fl[F.greatest(i - 1, F.lit(0))], F.lit(2))
                                             .otherwise(F.lit(1))))


def ratio_round6(num: Column, den: Column) -> Column:
    """``num / den`` (integers) rounded half away from zero to 6 decimals in
    exact integer arithmetic, so every engine produces the same double: a
    float ``round`` of an exact tie (e.g. 1/3200 = 0.0003125) may go either way
    once the tie is stored inexactly.  0 when ``den`` is 0."""
    num, den = num.cast("long"), den.cast("long")
    q = (F.abs(num) * 2000000 + den).cast("long")
    r = F.expr("0L").cast("long")
    mag = F.when(den > 0, (q - F.pmod(q, 2 * den)) / (2 * den)).otherwise(r)
    return (F.signum(num) * mag / 1000000.0).cast("double")
