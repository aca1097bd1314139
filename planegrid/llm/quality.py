"""Quality rules: base counts, then robust multivariate outliers per language and source.

The estimate is the minimum covariance determinant: of all subsets of ``SHARE`` of a group's documents, the
one whose covariance has the least determinant. Four deterministic starts (see _starts) take
concentration steps: a step measures every document's squared Mahalanobis distance from the estimate and
takes mean and covariance of the ``SHARE`` that lie nearest, which lowers the determinant but for what the bins'
borders and least deviations add. After ``TRIALS`` steps each group goes on with its start of least determinant until that stops falling. The
nearest are found on a histogram of the distances' logarithms whose bins hold the sums that the next
estimate needs; the bin at the border counts for the part that is still wanted. So a step is one aggregation
and no task sees a whole group. The covariance is made consistent with the normal distribution and
reweighted once by the documents within its ``INNER`` quantile; beyond the ``OUTER`` quantile of chi square
a document is rejected.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, checked_join, cut, documents, few, narrowed

SHARE = 0.75
#: Steps of every start, and of the best one at most.
TRIALS, STEPS = 2, 30
#: A group of fewer documents is judged with the other small groups of its language.
LEAST = 50
#: Quantiles of chi square: of the documents that reweight the estimate, and of those that are kept.
INNER, OUTER = 0.975, 1 - 1e-8

#: Name, expression and least standard deviation of each transformed statistic. The least deviation stands
#: in where nearly all documents are alike (most have no symbol and no repeated line); with it, a text
#: whose lines nearly all repeat lies beyond OUTER by itself, as do extreme values of the others but for repeated words,
#: which the base rules reject.
STATISTICS = (
    ("s_length", "ln(1.0D + word_chars / n_words)", 0.15),
    ("s_symbols", "ln(1.0D + 1000.0D * n_symbols / word_chars)", 0.5),
    ("s_capitals", "ln(1.0D + 100.0D * n_capitals / word_chars)", 0.4),
    ("s_repeats", "ln(1.0D + 100.0D * n_repeat_words / n_words)", 0.8),
    ("s_lines", "ln(1.0D + 100.0D * n_dup_lines / n_lines)", 0.65),
)


def chi2_cdf(x: float, dof: int) -> float:
    """P(chi square with ``dof`` degrees of freedom <= x), by the series of the incomplete gamma function."""
    a, h = dof / 2, x / 2
    if h <= 0:
        return 0.0
    term = total = 1 / a
    n = 0
    while term > total * 1e-17:
        n += 1
        term *= h / (a + n)
        total += term
    return min(1.0, total * math.exp(a * math.log(h) - h - math.lgamma(a)))


def chi2_quantile(q: float, dof: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, dof) < q else (lo, mid)
    return (lo + hi) / 2


def consistency(share: float, dof: int) -> float:
    """What the covariance of the nearest ``share`` of normal points must be multiplied by."""
    return share / chi2_cdf(chi2_quantile(share, dof), dof + 2)


#: Bins of the distances' logarithms, 32 a factor of e from 1e-6 on: so many reach to 1e6.
BINS = 884

_P = len(STATISTICS)
_PAIRS = [(i, j) for i in range(_P) for j in range(i + 1)]
CUT = chi2_quantile(OUTER, _P)


def _bound(value: Column, f) -> Column:  # noqa: ANN001
    """f(value), value being computed once: an array of one binds it to a name."""
    return F.element_at(F.transform(F.array(value), f), 1)


def window_names(words: Column, width: int) -> Column:
    """A 64-bit hash of each run of ``width`` (a power of 2) words, in order, by doubling."""
    def doubled(hashes: Column, span: int) -> Column:
        return _bound(hashes, lambda h: F.zip_with(h, F.slice(h, span + 1, F.size(h)), lambda a, b: F.xxhash64(a, b)))

    hashes = F.transform(words, lambda x: F.xxhash64(x))
    for i in range(width.bit_length() - 1):
        hashes = doubled(hashes, 1 << i)
    return F.slice(hashes, 1, F.greatest(F.lit(0), F.size(words) - width + 1))


def repeat_words(words: Column, width: int) -> Column:
    """Of each word array: words that lie in a window of ``width`` found twice or more in it.

    Windows are sorted by hash and place, so that equal ones are neighbours; the places of these,
    in order, cover the words that count.
    """

    def covered(hashes: Column) -> Column:
        def of_sorted(own: Column) -> Column:
            same = F.filter(own, lambda x, k: (F.coalesce(F.get(own, k - 1)["h"] == x["h"], F.lit(False))) | F.coalesce(F.get(own, k + 1)["h"] == x["h"], F.lit(False)))
            return F.aggregate(
                F.array_sort(F.transform(same, lambda x: x["i"])),
                F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
                lambda s, i: F.struct((i + width).alias("end"), (s["n"] + width - F.greatest(F.lit(0), s["end"] - i)).alias("n")),
                lambda s: s["n"],
            )

        return _bound(F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), of_sorted)

    some = F.when(F.size(words) > width, window_names(words, width)).otherwise(F.array().cast("array<bigint>"))
    return _bound(some, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0)).cast("long")


def base_counts(docs: DataFrame) -> DataFrame:
    """``docs`` with the base counts of each text; columns of these names are replaced. A null text has no words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.withColumn("__words", F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
    found = found.withColumn("__lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)))
    found = found.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.char_length(F.array_join("__words", "")).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "n_repeat_words": repeat_words(F.col("__words"), 8),
            "n_capitals": F.regexp_count(text, F.lit("[A-Z]")).cast("long"),
            "n_lines": F.size("__lines").cast("long"),
        }
    )
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return found.withColumn("base_failed", failed).drop("__words", "__lines")


_VALUES = [f"m_{i}" for i in range(_P)] + [f"r_{i}{j}" for i, j in _PAIRS]


def _inverse_root(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, m_i and c_ij to keys, m_i, r_ij and log_det.

    r is the inverse of the Cholesky factor of the covariance c, log_det the logarithm of its determinant. No
    deviation, given the statistics before it, counts as less than a tenth of its least one.
    """
    root: dict[tuple[int, int], Column] = {}
    for i in range(_P):
        for j in range(i + 1):
            s = F.col(f"c_{i}{j}")
            for k in range(j):
                s = s - F.col(f"l_{i}{k}") * F.col(f"l_{j}{k}")
            rows = rows.withColumn(f"l_{i}{j}", F.sqrt(F.greatest(s, F.lit(STATISTICS[i][2] ** 2 / 100))) if i == j else s / F.col(f"l_{j}{j}"))
    for i in range(_P):
        rows = rows.withColumn(f"r_{i}{i}", 1 / F.col(f"l_{i}{i}"))
        for j in range(i - 1, -1, -1):
            total = F.lit(0.0)
            for k in range(j, i):
                total = total - F.col(f"l_{i}{k}") * F.col(f"r_{k}{j}")
            rows = rows.withColumn(f"r_{i}{j}", total / F.col(f"l_{i}{i}"))
    log_det = reduce(lambda a, b: a + b, [2 * F.ln(F.col(f"l_{i}{i}")) for i in range(_P)])
    return rows.select(*keys, *_VALUES, log_det.alias("log_det"))


def _with_distance(points: DataFrame, estimate: DataFrame, small: bool | None = None) -> DataFrame:
    """``points`` with d2, the squared distance, a row for each estimate of the group; groups without one are left out."""
    joined = checked_join(points, estimate, "__g", small=small)
    d2 = F.lit(0.0)
    for i in range(_P):
        y = F.lit(0.0)
        for j in range(i + 1):
            y = y + F.col(f"r_{i}{j}") * (F.col(STATISTICS[j][0]) - F.col(f"m_{j}"))
        d2 = d2 + y * y
    return joined.select(*points.columns, *[c for c in estimate.columns if c not in ("__g", "log_det", *_VALUES)], d2.alias("d2"))


def _floored(i: int, j: int, c: Column) -> Column:
    return F.greatest(c, F.lit(STATISTICS[i][2] ** 2)) if i == j else c


def _sums(values: list[Column]) -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), *[F.sum(v).alias(f"s_{i}") for i, v in enumerate(values)], *[F.sum(values[i] * values[j]).alias(f"s_{i}{j}") for i, j in _PAIRS]]


def _moments(grow: Column, scale: list[Column] | None = None) -> dict[str, Column]:
    """m_i and c_ij of the sums; c is multiplied by ``grow``, and by the scales of both statistics."""
    mean = {f"m_{i}": F.col(f"s_{i}") / F.col("n") for i in range(_P)}
    of = lambda i, j: grow * (F.col(f"s_{i}{j}") / F.col("n") - mean[f"m_{i}"] * mean[f"m_{j}"]) * (scale[i] * scale[j] if scale else F.lit(1.0))
    return mean | {f"c_{i}{j}": _floored(i, j, of(i, j)) for i, j in _PAIRS}


def _starts(points: DataFrame) -> DataFrame:
    """Four estimates of each group (__k): medians with

    0: quartile ranges; 1: the covariance of the hyperbolic tangents of the standardized statistics; 2: that
    of their spatial signs; 3: mean and covariance of the half that lies nearest to the medians.
    """
    quartiles = points.groupBy("__g").agg(*[F.percentile_approx(s[0], [0.25, 0.5, 0.75]).alias(f"q_{i}") for i, s in enumerate(STATISTICS)])
    scale = [F.greatest((F.col(f"q_{i}")[2] - F.col(f"q_{i}")[0]) / 1.349, F.lit(s[2])) for i, s in enumerate(STATISTICS)]
    middle = cut(quartiles.select("__g", *[F.col(f"q_{i}")[1].alias(f"med_{i}") for i in range(_P)], *[c.alias(f"sd_{i}") for i, c in enumerate(scale)]))
    groups = few(middle)
    middle = middle if groups is None else narrowed(middle, groups)
    small = groups is not None
    z = checked_join(points, middle, "__g", small=small).select("__g", *[((F.col(s[0]) - F.col(f"med_{i}")) / F.col(f"sd_{i}")).alias(f"z_{i}") for i, s in enumerate(STATISTICS)])
    z = z.withColumn("norm2", reduce(lambda a, b: a + b, [F.col(f"z_{i}") * F.col(f"z_{i}") for i in range(_P)]))
    half = z.groupBy("__g").agg(F.percentile_approx("norm2", 0.5).alias("half"))
    half = cut(narrowed(half, groups) if small else half)
    z = checked_join(z, half, "__g", small=small)
    own = lambda k, when, f: F.when(when, F.struct(F.lit(k).alias("k"), *[f(F.col(f"z_{i}")).alias(f"y_{i}") for i in range(_P)]))
    length = F.greatest(F.sqrt("norm2"), F.lit(1e-9))
    views = F.array(own(1, F.lit(True), F.tanh), own(2, F.lit(True), lambda c: c / length), own(3, F.col("norm2") <= F.col("half"), lambda c: c))
    seen = z.select("__g", F.explode(F.array_compact(views)).alias("v")).select("__g", F.col("v.k").alias("__k"), *[f"v.y_{i}" for i in range(_P)])
    sums = checked_join(seen.groupBy("__g", "__k").agg(*_sums([F.col(f"y_{i}") for i in range(_P)])), middle, "__g", small=small)
    sd = [F.col(f"sd_{i}") for i in range(_P)]
    moments = _moments(F.lit(1.0), sd)
    centre = {f"m_{i}": F.when(F.col("__k") == 3, F.col(f"med_{i}") + sd[i] * F.col(f"s_{i}") / F.col("n")).otherwise(F.col(f"med_{i}")) for i in range(_P)}
    shaped = sums.select("__g", "__k", *[c.alias(n) for n, c in (moments | centre).items()])
    plain = middle.select("__g", F.lit(0).alias("__k"), *[F.col(f"med_{i}").alias(f"m_{i}") for i in range(_P)], *[(sd[i] * sd[i] if i == j else F.lit(0.0)).alias(f"c_{i}{j}") for i, j in _PAIRS])
    found = _inverse_root(shaped.unionByName(plain), "__g", "__k")
    return narrowed(found, 4 * groups) if small else found


def _step(points: DataFrame, estimate: DataFrame, rows: int | None = None) -> DataFrame:
    """The next estimate, of each group's start: the moments of the nearest ``SHARE`` of its documents.

    ``rows`` tells how many estimates there are, if they are few.
    """
    keys = ["__g", "__k"]
    near = _with_distance(points, estimate, rows is not None).withColumn("bin", F.floor(32 * F.ln(F.col("d2") + 1e-6)))
    bins = near.groupBy(*keys, "bin").agg(*_sums([F.col(s[0]) for s in STATISTICS]))
    # cut before the windows, which would have a group's rows meet unsummed
    bins = cut(bins if rows is None else narrowed(bins, rows * BINS))
    group = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("n").over(group.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wanted = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.ceil(F.col("all") * SHARE) - F.col("before")) / F.col("n")))
    bins = bins.withColumn("before", before).withColumn("all", F.sum("n").over(group)).withColumn("part", wanted)
    names = ["n", *[f"s_{i}" for i in range(_P)], *[f"s_{i}{j}" for i, j in _PAIRS]]
    total = bins.where("part > 0").groupBy(*keys).agg(*[F.sum(F.col(c) * F.col("part")).alias(c) for c in names])
    found = _inverse_root(total.select(*keys, *[c.alias(n) for n, c in _moments(F.lit(1.0)).items()]), *keys)
    return found if rows is None else narrowed(found, rows)


def _scaled(estimate: DataFrame, factor: float) -> DataFrame:
    """The estimate with its covariance multiplied by ``factor``."""
    return estimate.select(*[(F.col(c) / math.sqrt(factor)).alias(c) if c.startswith("r_") else F.col(c) for c in estimate.columns])


def least_determinant(points: DataFrame) -> DataFrame:
    """(__g, statistics) to each group's estimate: (__g, m_i, r_ij, log_det), consistent and reweighted."""
    tried = cut(_starts(points))
    rows = few(tried)  # no step adds a row
    small = rows is not None
    for _ in range(TRIALS):
        tried = cut(_step(points, tried, rows))
    best = cut(tried.withColumn("rank", F.row_number().over(Window.partitionBy("__g").orderBy("log_det", "__k"))).where("rank = 1").drop("rank"))
    for _ in range(STEPS):
        # of the two, each group keeps the one of less determinant
        ahead = _step(points, best, rows).select("__g", F.struct(*best.columns).alias("new"))
        both = best.select("__g", F.struct(*best.columns).alias("old")).join(ahead, "__g", "left")
        kept = F.when(F.col("new.log_det") < F.col("old.log_det"), F.col("new")).otherwise(F.col("old"))
        both = cut(both.select(kept.alias("kept"), (F.col("old.log_det") - F.col("new.log_det")).alias("fallen")))
        best = both.select("kept.*")
        fallen = both.agg(F.max("fallen")).first()[0]
        if fallen is None or fallen < 1e-6:
            break
    raw = cut(_scaled(best.drop("__k"), consistency(SHARE, _P)))
    inner = _with_distance(points, raw, small).where(F.col("d2") <= chi2_quantile(INNER, _P))
    sums = inner.groupBy("__g").agg(*_sums([F.col(s[0]) for s in STATISTICS]))
    return _inverse_root(sums.select("__g", *[c.alias(n) for n, c in _moments(F.lit(consistency(INNER, _P))).items()]), "__g")


def judged(docs: DataFrame) -> DataFrame:
    """``docs`` (with text, lang and source) with the base counts, distance d2 and kept.

    Null languages and sources are groups of their own. Documents that fail the base rules are rejected and
    take no part in an estimate. A group of fewer than ``LEAST`` others joins the small groups of
    its language; where these are too few as well, the base rules decide alone (d2 is null). Repeated
    rows are judged alike. Columns with the names of the counts are replaced; an empty table stays empty.
    """
    counted = base_counts(docs.drop("d2", "kept")).withColumns({name: F.when(~F.col("base_failed"), F.expr(expression)) for name, expression, _ in STATISTICS})
    counted = cut(counted.drop("text"))
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    points = counted.withColumn("__l", name("lang")).withColumn("__s", name("source"))
    sizes = points.where("NOT base_failed").groupBy("__l", "__s").agg(F.count(F.lit(1)).alias("__n"))
    small = F.sum(F.when(F.col("__n") < LEAST, F.col("__n"))).over(Window.partitionBy("__l"))
    own = F.when(F.col("__n") >= LEAST, F.concat_ws("\u0001", "__l", "__s")).when(small >= LEAST, F.col("__l"))
    points = points.join(sizes.withColumn("__g", own).drop("__n"), ["__l", "__s"], "left").drop("__l", "__s")
    sample = points.where("NOT base_failed AND __g IS NOT NULL").select("__g", *[s[0] for s in STATISTICS])
    sample = cut(sample)
    estimate = cut(least_determinant(sample))
    apart = points.where("base_failed OR __g IS NULL").withColumn("d2", F.lit(None).cast("double"))
    found = _with_distance(points.where("NOT base_failed AND __g IS NOT NULL"), estimate).unionByName(apart)
    return found.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("d2") <= CUT, F.lit(True))).drop("__g")


def op4_mcd_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base counts and the verdict on all documents."""
    found = judged(documents(spark, sf_dir).select("doc_id", "text", "lang", "source"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("d2", 6).alias("d2"))
