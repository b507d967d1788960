"""Quality rules: counts, base rules, and robust multivariate outliers by language and source.

A document's counts are transformed to a short vector. For each language and source the minimum-covariance-determinant
estimate of location and scatter is found by concentration steps: from several starts, each step keeps the share H of
documents at the least Mahalanobis distance and estimates again from them; the start with the least determinant goes on
until a step no longer lowers it, and is then left alone while others go on. Documents far from their group by that estimate are rejected, where far is read from the
group's own distances.

All of it is DataFrame code. Counts are made inside a row from arrays of its words, the vectors are written to the
shared folder once, and every step is one grouped sum over narrow bins of distance that each task begins before the
shuffle, so a group with a third of all rows is no single task's work.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.runtime import materialise

#: Share of a group that an estimate rests on, rows that it needs, and what keeps constant counts from being singular.
H, LEAST_GROUP, RIDGE = 0.75, 50, 0.05
#: Steps from every start, what a step must lower the logarithm of the determinant by to be followed by another, bins of
#: distance an octave, and values that percentiles keep.
FIRST_STEPS, LOWER, OCTAVE, ACCURACY = 2, 1e-6, 16, 10_000
#: Of documents like the others of their group, one in 1 / TAIL is rejected.
TAIL = 1e-4
#: Groups whose estimates are broadcast; beyond so many the join is shuffled.
BROADCAST_ROWS = 100_000
_normal_quantile = NormalDist().inv_cdf
_SPACE = r"[ \t\n\x0B\f\r]"
VECTOR = ("v_size", "v_length", "v_symbols", "v_lines", "v_repeats")


def _let(value: str, name: str, body: str) -> str:
    """body with name bound to value, which is made once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def counts(docs: DataFrame, window: int = 5) -> DataFrame:
    """All columns of docs in `row`, and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines of each text
    (null: no words, all 0). Words are runs other than space and characters 9 to 13; a line counts if it has a word."""
    t = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col("text"), F.lit("")).alias("t"))
    words = F.array_remove(F.split("t", _SPACE + "+"), "")
    solid = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]"))
    t = t.select("row", words.alias("w"), solid.alias("lines"), F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"))
    hashes = f"transform(if(size(w) >= {window}, sequence(1, size(w) - {window - 1}), array()), i -> xxhash64(slice(w, i, {window})))"
    t = t.select("row", "n_symbols", "lines", F.size("w").cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"), F.expr(hashes).alias("h"))
    # places of windows that are found twice or more: neighbours of equal hash in the sorted order; then each place
    # covers up to the next one, `window` words at most
    pairs = "array_sort(transform(h, (x, i) -> struct(x as x, i as i)))"
    twice = "filter(s, (p, k) -> (k > 0 and s[k - 1].x = p.x) or (k + 1 < size(s) and s[k + 1].x = p.x))"
    places = _let(pairs, "s", f"array_sort(transform({twice}, p -> p.i))")
    covered = _let(places, "q", f"aggregate(transform(q, (p, k) -> if(k + 1 < size(q), least({window}, q[k + 1] - p), {window})), 0, (a, x) -> a + x)")
    repeated = F.expr(f"if(size(array_distinct(h)) = size(h), 0L, cast({covered} as bigint))")
    return t.select(
        "row", "n_words", "word_chars", "n_symbols", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated.alias("n_repeat_words"), F.size("lines").cast("long").alias("n_lines"),
    )


def vector() -> list[Column]:
    """VECTOR from the counts: sizes as logarithms, shares by the inverse hyperbolic sine, which is linear near 0."""
    n, c = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return [
        F.log1p(F.col("n_words").cast("double")).alias("v_size"), F.log(c / n).alias("v_length"), F.asinh(20 * F.col("n_symbols") / c).alias("v_symbols"),
        F.asinh(2 * F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))).alias("v_lines"), F.asinh(2 * F.col("n_repeat_words") / n).alias("v_repeats"),
    ]


def _chi2_share(x: float, df: int) -> float:
    """Share of the chi-squared distribution below x, by the series of the incomplete gamma function."""
    a, x = df / 2, x / 2
    term = total = 1 / a
    for k in range(1, 400):
        term *= x / (a + k)
        total += term
    return total * math.exp(a * math.log(x) - x - math.lgamma(a))


def _chi2_quantile(p: float, df: int) -> float:
    lo, hi = 1e-6, 200.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _chi2_share(mid, df) < p else (lo, mid)
    return (lo + hi) / 2


def _precision(entry: Callable[[int, int], str]) -> Column:
    """The inverse of the covariances entry(i, j), j <= i, row by row in one array, and the logarithm of their determinant
    behind it: Gauss-Jordan steps on the matrix with the unit matrix beside it. Positive definite matrices need no pivots."""
    d = len(VECTOR)
    both = [entry(max(i, j), min(i, j)) if j < d else f"{float(i == j - d)}D" for i in range(d) for j in range(2 * d)] + ["0.0D"]
    cell = lambda i, j: f"m[int({i}) * {2 * d} + int({j})]"
    row, col = f"(t div {2 * d})", f"(t % {2 * d})"
    step = f"if(t = {2 * d * d}, m[t] + ln({cell('k', 'k')}), if({row} = k, m[t] / {cell('k', 'k')}, m[t] - {cell(row, 'k')} * {cell('k', col)} / {cell('k', 'k')}))"
    done = f"aggregate(sequence(0, {d - 1}), array({', '.join(both)}), (m, k) -> transform(sequence(0, {2 * d * d}), t -> {step}))"
    return F.expr(f"aggregate(array(0), {done}, (m, k) -> m, m -> transform(sequence(0, {d * d}), t -> if(t = {d * d}, m[{2 * d * d}], m[int(t div {d}) * {2 * d} + {d} + t % {d}])))")


def distance(rows: DataFrame, name: str = "d2", columns: Sequence[str] = VECTOR) -> DataFrame:
    """rows with the squared Mahalanobis distance of columns from m_i under the inverse covariances."""
    d = len(VECTOR)
    away = [f"(`{v}` - m_{i})" for i, v in enumerate(columns)]
    terms = [f"precision[{i * d + j}] * {away[i]} * {away[j]}" for i in range(d) for j in range(d)]
    return rows.withColumn(name, F.expr(" + ".join(terms)))


def _near(c: Column, p: float) -> Column:
    return F.percentile_approx(c, F.lit(p), F.lit(ACCURACY))


@functools.cache
def _factors() -> str:
    """What scatter is scaled by so that it is consistent for normal data, for shares of 0.5 to 1 in steps of 1/256."""
    d = len(VECTOR)
    return f"array({', '.join(f'{k / 256 / _chi2_share(_chi2_quantile(k / 256, d), d + 2) if k < 256 else 1.0!r}D' for k in range(128, 257))})"


def _starts(rows: DataFrame, centre: DataFrame) -> DataFrame:
    """Three estimates a group, all about its medians: scatter without correlation, with that of the vectors' hyperbolic
    tangents, and with that of their directions, so that far rows have little or no more weight than others."""
    d = len(VECTOR)
    z = rows.join(centre, "g").select("g", *[F.col(f"s_{i}") for i in range(d)], *[(F.col(f"y_{i}") / F.col(f"s_{i}")).alias(f"z_{i}") for i in range(d)])
    z = z.withColumn("r", F.greatest(F.sqrt(sum(F.col(f"z_{i}") ** 2 for i in range(d))), F.lit(1e-9)))
    ab = [(i, j) for i in range(d) for j in range(i + 1)]
    tan = lambda i: F.tanh(f"z_{i}")
    sums = z.groupBy("g").agg(
        *[F.first(f"s_{i}").alias(f"s_{i}") for i in range(d)], *[F.covar_pop(tan(i), tan(j)).alias(f"c1_{i}_{j}") for i, j in ab],
        *[F.avg(F.col(f"z_{i}") * F.col(f"z_{j}") / F.col("r") ** 2).alias(f"c2_{i}_{j}") for i, j in ab],
    )

    def entry(start: int) -> Callable[[int, int], str]:
        def value(i: int, j: int) -> str:
            if i == j or not start:
                return f"s_{i} * s_{j}" if i == j else "0.0D"
            size = f"sqrt(c{start}_{i}_{i} * c{start}_{j}_{j})"
            return f"0.99D * s_{i} * s_{j} * if({size} > 1e-12D, c{start}_{i}_{j} / {size}, 0.0D)"

        return value

    starts = F.explode(F.array(*[F.struct(F.lit(k).alias("start"), _precision(entry(k)).alias("precision")) for k in range(3)]))
    return sums.select("g", starts.alias("e")).select("g", "e.start", *[F.lit(0.0).alias(f"m_{i}") for i in range(d)], "e.precision")


def _step(rows: DataFrame, now: DataFrame, h: float) -> DataFrame:
    """One concentration step of every estimate (g, start, m_i, precision): sums by bin of distance, of which the nearest
    that hold the share h are taken. before: the logarithm of the determinant that the step began with."""
    d = len(VECTOR)
    ab = [(i, j) for i in range(d) for j in range(i + 1)]
    bin_ = F.floor(F.log2(F.greatest("d2", F.lit(1e-9))) * OCTAVE).cast("int")
    now = now.select("g", "start", *[f"m_{i}" for i in range(d)], "precision")
    far = distance(rows.join(now, "g"), columns=[f"y_{i}" for i in range(d)]).withColumn("bin", bin_)
    far = far.groupBy("g", "start", "bin").agg(F.first(F.element_at("precision", d * d + 1)).alias("before"), F.count(F.lit(1)).alias("n"), *[F.expr(f"sum(y_{i}) AS a_{i}") for i in range(d)], *[F.expr(f"sum(y_{i} * y_{j}) AS b_{i}_{j}") for i, j in ab])
    one = Window.partitionBy("g", "start")
    nearer = F.coalesce(F.sum("n").over(one.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    near = far.select("*", F.sum("n").over(one).alias("all"), nearer.alias("nearer"))
    near = near.filter(F.col("nearer") < h * F.col("all"))
    sums = near.groupBy("g", "start").agg(F.sum("n").alias("n"), F.first("all").alias("all"), F.first("before").alias("before"), *[F.sum(f"a_{i}").alias(f"a_{i}") for i in range(d)], *[F.sum(f"b_{i}_{j}").alias(f"b_{i}_{j}") for i, j in ab])
    factor = F.element_at(F.expr(_factors()), F.greatest(F.round((F.col("n") / F.col("all") - 0.5) * 256), F.lit(0.0)).cast("int") + 1)
    sums = sums.withColumn("f", factor)
    entry = lambda i, j: f"((b_{i}_{j} - a_{i} * a_{j} / n) / n * f + {RIDGE**2 if i == j else 0.0}D)"
    return sums.select("g", "start", *[(F.col(f"a_{i}") / F.col("n")).alias(f"m_{i}") for i in range(d)], _precision(entry).alias("precision"), "before")


def mcd(rows: DataFrame, h: float = H) -> DataFrame:
    """g, m_i, precision and cutoff: the estimate of each group g of rows (g, VECTOR), and the squared distance beyond which
    a row is no longer like its group.

    The share h is at least that: all rows of the bin in which it is reached count, and scatter is scaled by the share
    that was taken. The cutoff lies so far above the median distance that a share of TAIL is beyond it, if logarithms of
    distances spread there as they do from the median to the upper quartile, and not below that of normal data.

    A group's steps end with the first that doesn't lower its determinant, whose result is left out: as whole bins count, a
    step may raise it. Determinants are bounded from below by RIDGE and each step but the last lowers one by LOWER at least,
    so steps end, and only groups that still go on are read for them. A step's estimates are written, a row a group.
    """
    d = len(VECTOR)
    log_det = F.element_at("precision", d * d + 1)
    medians = materialise(rows.groupBy("g").agg(*[_near(F.col(v), 0.5).alias(f"med_{i}") for i, v in enumerate(VECTOR)]), "mcd-medians")
    few = F.broadcast if medians.count() <= BROADCAST_ROWS else (lambda df: df)
    # about the medians, so that sums of squares lose no digits
    rows = materialise(rows.join(few(medians), "g").select("g", *[(F.col(v) - F.col(f"med_{i}")).alias(f"y_{i}") for i, v in enumerate(VECTOR)]), "mcd-rows")
    spread = [F.sqrt((1.4826 * _near(F.abs(F.col(f"y_{i}")), 0.5)) ** 2 + RIDGE**2).alias(f"s_{i}") for i in range(d)]
    centre = materialise(rows.groupBy("g").agg(*spread), "mcd-spread")
    now = materialise(_starts(rows, few(centre)), "mcd-starts")
    for _ in range(FIRST_STEPS):
        now = _step(rows, few(now), h)
    estimate = ["start", *[f"m_{i}" for i in range(d)], "precision"]
    best = lambda df: df.groupBy("g").agg(F.min_by(F.struct(*estimate), F.struct(log_det, F.col("start"))).alias("e")).select("g", "e.*")
    now = going = materialise(best(now), "mcd-best")
    while not going.isEmpty():
        going = materialise(_step(rows, few(going), h).filter(log_det < F.col("before") - LOWER).drop("before"), "mcd-step")
        now = now.unionByName(going)
    now = materialise(best(now), "mcd-estimates")
    far = F.log(F.greatest("d2", F.lit(1e-9)))
    spread = distance(rows.join(few(now), "g"), columns=[f"y_{i}" for i in range(d)]).groupBy("g").agg(_near(far, 0.5).alias("q50"), _near(far, 0.75).alias("q75"))
    beyond = F.exp(F.col("q50") + _normal_quantile(1 - TAIL) / _normal_quantile(0.75) * (F.col("q75") - F.col("q50")))
    cutoffs = materialise(spread.select("g", F.greatest(beyond, F.lit(_chi2_quantile(1 - TAIL, d))).alias("cutoff")), "mcd-cutoffs")
    at = [(F.col(f"m_{i}") + F.col(f"med_{i}")).alias(f"m_{i}") for i in range(d)]
    return now.join(few(medians), "g").join(few(cutoffs), "g").select("g", *at, F.slice("precision", 1, d * d).alias("precision"), "cutoff")


def _pools(stats: DataFrame, least: int = LEAST_GROUP) -> DataFrame:
    """g, pool: what each group of stats (g, language, base_failed) is judged by. That is the group, else its language over
    all sources, else all rows: the first that has at least `least` rows that pass the base rules (all rows: any)."""
    sizes = materialise(stats.groupBy("g", "language").agg(F.count(F.when(~F.col("base_failed"), 1)).alias("n")), "rule-groups")
    by_language = sizes.groupBy("language").agg(F.sum("n").alias("n_language"))
    pool = F.when(F.col("n") >= least, F.col("g")).when(F.col("n_language") >= least, F.col("language")).otherwise(F.lit(""))
    return materialise(sizes.join(by_language, "language").select("g", pool.alias("pool")), "rule-pools")


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance2, cutoff and kept of each row.

    base_failed: fewer than 10 words, or more than 20 % of the words in repeated 5-word windows. kept is false if
    base_failed or if the squared distance is over the cutoff. Estimates come from rows that pass the base rules; a group
    of fewer than LEAST_GROUP of those is judged by the estimate of its language over all sources, and if that has too few
    by that of all rows. distance2 is null only if no row at all passes the base rules. Null texts are empty; null
    languages or sources are groups of their own; rows that repeat count as often as they stand there.
    """
    stats = counts(docs.select("doc_id", "text", "lang", "source"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    group, language = F.to_json(F.struct("row.lang", "row.source")), F.concat(F.lit("language "), F.to_json(F.struct("row.lang")))
    stats = stats.select("row.doc_id", group.alias("g"), language.alias("language"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), *vector())
    stats = materialise(stats, "rule-counts")
    pools = _pools(stats)
    used = pools.select("pool").distinct()
    rows = stats.filter("not base_failed").select(F.explode(F.array("g", "language", F.lit(""))).alias("pool"), *VECTOR)
    found = mcd(rows.join(used, "pool").withColumnRenamed("pool", "g")).withColumnRenamed("g", "pool")
    far = distance(stats.join(pools, "g").join(found, "pool", "left"), "distance2")
    verdict = ~F.col("base_failed") & F.coalesce(F.col("distance2") <= F.col("cutoff"), F.lit(True))
    return far.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance2", "cutoff", verdict.alias("kept"))
