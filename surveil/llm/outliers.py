"""Quality rules and robust multivariate outliers, in DataFrame expressions only.

Base rules come from word, symbol, line and repetition counts of the whole text. Documents that pass
them are judged against their (lang, source) group: four transformed statistics, a minimum-
covariance-determinant estimate of location and scatter, and rejection by Mahalanobis distance.

The estimate is found by concentration steps: from a start (fixed scales), take the half of the group
with the smallest distances, recompute mean and covariance from it, repeat. Each group has STARTS
starts, the coordinate-wise median and rows drawn by hash; after two steps the FOLLOWED starts with the
smallest determinants go on until the determinant stops falling, and the smallest one found is kept.
Each step is one aggregate of sums and products per group (pre-aggregated before the shuffle) and
one histogram of distances per group, from which the half's cut is read; no group is ever gathered.
Statistics are kept on an integer grid, so all sums are exact and do not depend on task order.
The estimate is then reweighted: mean and covariance of all rows within the 0.975 quantile of it, and
rows beyond the 0.999 quantile of that are rejected. ``FLOOR`` is added to the variances, so a statistic that does not vary in the half (most documents have
no symbols, repeated lines or repeated phrases at all) does not make the scatter singular. It is at most
a fifth of each statistic's variance over all documents of sf0.1 (0.011, 0.105, 0.0058, 0.0053). From a
centre of zero, one statistic alone rejects beyond 0.07 symbols a word, 1.9 % repeated lines or 1.9 %
words in repeated phrases.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveil.session import stored

STATS = ("z_length", "z_symbols", "z_lines", "z_repeats")
SCALE = (0.25, 0.25, 0.25, 0.25)      # scales of the first distances
FLOOR = 0.001                          # variance added to each statistic (0.032 squared)
CONSISTENCY = 1.0 / 0.4                # half of a 4-variate normal understates its variance by about this
STARTS = 6
FOLLOWED = 2
FALL = 1e-4                            # a smaller fall of the log determinant ends a start
GRID = 1 << 16                         # steps of the statistics per unit
NEAR = 11.143                          # chi-square, 4 degrees of freedom, 0.975: rows of the reweighted estimate
REWEIGHTED = 1.065                     # rows below NEAR understate a 4-variate normal's variance by about this
LIMIT = 18.467                         # chi-square, 4 degrees of freedom, 0.999
LEAST = 10                             # groups with a smaller half borrow the estimate of their language, then of all
BINS = 64                              # distance bins per factor of e
WORD = "[^\\x20\\x09-\\x0D]+"
SYMBOL = "[#*$%&|<>]"


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words) per row.

    Null text has no words and no lines. n_lines counts lines with a word."""
    text = F.coalesce(F.col("text"), F.lit(""))
    x = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"),
                    F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("w"),
                    F.filter(F.split(text, "\n", -1), lambda s: s.rlike(WORD)).alias("lines"),
                    F.regexp_count(text, F.lit(SYMBOL)).cast("long").alias("n_symbols"))
    less = F.greatest(F.size("w") - 2, F.lit(0))
    windows = F.transform(
        F.arrays_zip(F.slice("w", 1, less).alias("a"), F.slice("w", 2, less).alias("b"), F.slice("w", 3, less).alias("c")),
        lambda t: F.xxhash64(t["a"], t["b"], t["c"]))
    x = x.select("*", windows.alias("h"))
    # 3-word windows as (hash, position), sorted: equal hashes stand side by side. Only texts in which a hash comes twice
    # are sorted, by sort_array: array_sort would evaluate a comparison function for every pair it compares
    placed = F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    x = x.select("*", F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array(placed)).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")).alias("s"))
    none = F.array(F.lit(None).cast("struct<h:bigint,i:int>"))
    less = F.greatest(F.size("s") - 1, F.lit(0))
    # neighbours by zipped slices: a filter pushed down to the scan would evaluate "s" anew for every element of a lambda that names it
    found = F.filter(
        F.arrays_zip(F.col("s").alias("here"), F.concat(none, F.slice("s", 1, less)).alias("prev"),
                     F.concat(F.slice("s", 2, less), none).alias("next")),
        lambda t: F.coalesce(t["here"]["h"] == t["prev"]["h"], F.lit(False)) | F.coalesce(t["here"]["h"] == t["next"]["h"], F.lit(False)))
    x = x.select("*", F.sort_array(F.transform(found, lambda t: t["here"]["i"])).alias("d"))
    # words covered by windows starting at the sorted positions d: each adds min(3, gap to the next)
    gaps = F.zip_with(F.slice("d", 2, F.greatest(F.size("d") - 1, F.lit(0))), F.slice("d", 1, F.greatest(F.size("d") - 1, F.lit(0))),
                      lambda b, a: F.least(b - a, F.lit(3)))
    covered = F.when(F.size("d") > 0, F.aggregate(gaps, F.lit(3).cast("long"), lambda s, g: s + g)).otherwise(F.lit(0).cast("long"))
    return x.select("doc_id", "lang", "source", F.size("w").cast("long").alias("n_words"),
                    F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"), "n_symbols",
                    F.size("lines").cast("long").alias("n_lines"),
                    (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
                    covered.alias("n_repeat_words"))


def _grid(z: Column) -> Column:
    return F.round(z * GRID).cast("long")


def transformed(stats: DataFrame) -> DataFrame:
    """``stats`` plus base_failed and the four statistics (0 for texts without words)."""
    words = F.greatest("n_words", F.lit(1)).cast("double")
    return stats.withColumns({
        "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        "z_length": _grid(F.when(F.col("n_words") > 0, F.log(F.col("word_chars") / words)).otherwise(0.0)),
        "z_symbols": _grid(F.asinh(4 * F.col("n_symbols") / words) / 2),
        "z_lines": _grid(F.sqrt(F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)))),
        "z_repeats": _grid(F.sqrt(F.col("n_repeat_words") / words)),
    })


def _cov(i: int, j: int) -> str:
    return f"c_{min(i, j)}_{max(i, j)}"


def _distance(center: list[Column], factor: dict) -> Column:
    """Squared Mahalanobis distance by forward substitution with the Cholesky factor."""
    y: list[Column] = []
    for i, s in enumerate(STATS):
        r = F.col(s) / F.lit(float(GRID)) - center[i]
        for j in range(i):
            r = r - factor[i, j] * y[j]
        y.append(r / factor[i, i])
    return reduce(lambda a, b: a + b, [v * v for v in y])


def _cholesky(est: DataFrame) -> DataFrame:
    """Columns l_i_j of the Cholesky factor of the covariance columns."""
    for i in range(len(STATS)):
        for j in range(i + 1):
            s = F.col(_cov(i, j))
            for k in range(j):
                s = s - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            # FLOOR on the diagonal keeps every pivot positive
            est = est.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(s, F.lit(FLOOR / 4))) if i == j else s / F.col(f"l_{j}_{j}"))
    est = est.withColumn("det", reduce(lambda a, b: a + b, [2 * F.log(F.col(f"l_{i}_{i}")) for i in range(len(STATS))]))
    return est.drop(*[_cov(i, j) for i in range(len(STATS)) for j in range(i + 1)])


def _estimate(members: DataFrame, keys: list[str], scale: float) -> DataFrame:
    """Mean, Cholesky factor, log determinant and size per group."""
    p = range(len(STATS))
    sums = members.groupBy(*keys).agg(
        F.count("*").alias("n"), *[F.sum(F.col(s).cast("decimal(38,0)")).alias(f"m_{i}") for i, s in enumerate(STATS)],
        *[F.sum((F.col(STATS[i]) * F.col(STATS[j])).cast("decimal(38,0)")).alias(_cov(i, j)) for i in p for j in range(i + 1)])
    sums = sums.withColumns({f"m_{i}": F.col(f"m_{i}").cast("double") / F.col("n") / GRID for i in p})
    for i in p:
        for j in range(i + 1):
            c = (F.col(_cov(i, j)).cast("double") / F.col("n") / float(GRID) ** 2 - F.col(f"m_{i}") * F.col(f"m_{j}")) * F.lit(scale)
            sums = sums.withColumn(_cov(i, j), c + F.lit(FLOOR) if i == j else c)
    return _cholesky(sums)


def _with_distance(docs: DataFrame, est: DataFrame, keys: list[str]) -> DataFrame:
    p = range(len(STATS))
    d = _distance([F.col(f"m_{i}") for i in p], {(i, j): F.col(f"l_{i}_{j}") for i in p for j in range(i + 1)})
    cols = [c for c in est.columns if c not in keys]
    return docs.join(est, keys).withColumn("d2", d).drop(*[c for c in cols if c not in ("n", "start")])


def _half(docs: DataFrame, keys: list[str]) -> DataFrame:
    """The rows up to the distance bin in which the group's half is reached."""
    bin_ = F.floor(F.log(F.col("d2") + F.lit(1e-6)) * BINS)
    hist = docs.withColumn("bin", bin_).groupBy(*keys, "bin").agg(F.count("*").alias("k"))
    upto = F.sum("k").over(Window.partitionBy(*keys).orderBy("bin"))
    total = F.sum("k").over(Window.partitionBy(*keys))
    cut = hist.select(*keys, "bin", upto.alias("upto"), total.alias("total")).filter("2 * upto >= total").groupBy(*keys).agg(F.min("bin").alias("cut"))
    return docs.withColumn("bin", bin_).join(cut, keys).filter("bin <= cut").drop("bin", "cut", "d2", "n")


def _starts(good: DataFrame, keys: list[str]) -> DataFrame:
    """Centres with fixed scales, STARTS per group: the median and the rows with the smallest hashes. The
    median is taken on a grid of 1/64, so its buffer holds a bounded number of distinct values."""
    p = range(len(STATS))
    row = F.struct(*[(F.col(s) / float(GRID)).alias(f"m_{i}") for i, s in enumerate(STATS)])
    middle = F.struct(*[(F.median(F.floor(F.col(s) / (GRID / 64))) / 64).alias(f"m_{i}") for i, s in enumerate(STATS)])
    centres = F.array(middle, *[F.min(F.struct(F.xxhash64(*STATS, F.lit(k)).alias("h"), row.alias("r")))["r"] for k in range(1, STARTS)])
    start = good.groupBy(*keys).agg(F.count("*").alias("n"), centres.alias("c"))
    start = start.select(*keys, "n", F.posexplode("c").alias("start", "c")).select(*keys, "start", "n", "c.*")
    return start.withColumns({f"l_{i}_{j}": F.lit(SCALE[i] if i == j else 0.0) for i in p for j in range(i + 1)} | {"det": F.lit(float("inf"))})


def _mcd(good: DataFrame, keys: list[str]) -> DataFrame:
    """The estimate with the smallest determinant per group that concentration steps from all starts find."""
    each = [*keys, "start"]
    now, steps = stored(_starts(good, keys), "mcd"), []
    while True:
        # a start goes on only while its determinant falls, and FLOOR bounds it from below: this ends
        step = _estimate(_half(_with_distance(good, now, keys), each), each, CONSISTENCY)
        steps.append(stored(step.join(now.select(*each, F.col("det").alias("was")), each), "mcd"))
        now = steps[-1].filter(F.col("det") < F.col("was") - FALL).drop("was")
        if len(steps) == 2:
            by_det = Window.partitionBy(*keys).orderBy("det", "start")         # at most STARTS rows
            best = steps[-1].select("*", F.row_number().over(by_det).alias("place")).filter(F.col("place") <= FOLLOWED)
            now = best.filter(F.col("det") < F.col("was") - FALL).drop("was", "place")
        if now.isEmpty():
            break
    rest = [c for c in steps[0].columns if c not in (*each, "det", "was")]
    found = reduce(DataFrame.union, [x.select(*each, "det", *rest) for x in steps])
    return found.groupBy(*keys).agg(F.min(F.struct("det", "start", *rest)).alias("e")).select(*keys, *[f"e.{c}" for c in rest], "e.det")


def _reweighted(good: DataFrame, est: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and Cholesky factor from all rows within NEAR of the estimate; n stays the size of the half."""
    near = _with_distance(good, est, keys).filter(F.col("d2") <= NEAR)
    return _estimate(near, keys, REWEIGHTED).drop("n").join(est.select(*keys, "n"), keys)


def judge(docs: DataFrame) -> DataFrame:
    """Statistics, base_failed, distance (squared, null if base_failed) and kept per row of ``docs``.

    Reads doc_id, text, lang and source only. Null lang or source is a group of its own; a group
    whose half has fewer than LEAST documents uses its language's estimate, a language with
    fewer that of all; without any, nothing is rejected by distance. Null text fails the base
    rules (no words). Repeated rows count as often as they stand; an empty table gives no rows."""
    stats = stored(transformed(statistics(docs)).withColumns({
        "g_lang": F.coalesce("lang", F.lit("(none)")), "g_source": F.coalesce("source", F.lit("(none)")), "g_all": F.lit(0)}), "statistics")
    good = stats.filter("not base_failed")
    levels = (["g_lang", "g_source"], ["g_lang"], ["g_all"])
    names = ["g_lang", "g_source", "g_all"]
    # one search for the groups of all levels; what a level does not use is empty
    member = [F.struct(F.lit(k).alias("level"), *[F.col(c).cast("string").alias(c) if c in keys else F.lit("").alias(c) for c in names]) for k, keys in enumerate(levels)]
    members = good.select(F.explode(F.array(*member)).alias("g"), *STATS).select("g.*", *STATS)
    keys = ["level", *names]
    found = stored(_reweighted(members, stored(_mcd(members, keys), "mcd"), keys).drop("det"), "mcd")
    est = [found.filter(F.col("level") == k).drop("level", *[c for c in names if c not in keys]) for k, keys in enumerate(levels)]
    out = stats
    p = range(len(STATS))
    for k, (keys, e) in enumerate(zip(levels, est)):
        names = [c for c in e.columns if c not in keys]
        out = out.join(e.toDF(*[c if c in keys else f"{c}_{k}" for c in e.columns]), keys, "left")
        d2 = _distance([F.col(f"m_{i}_{k}") for i in p], {(i, j): F.col(f"l_{i}_{j}_{k}") for i in p for j in range(i + 1)})
        out = out.withColumn(f"d2_{k}", d2 if k == 2 else F.when(F.col(f"n_{k}") >= LEAST, d2)).drop(*[f"{c}_{k}" for c in names])
    best = F.coalesce("d2_0", "d2_1", "d2_2")
    distance = F.when(~F.col("base_failed"), best)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      distance.alias("distance"),
                      (~F.col("base_failed") & F.coalesce(distance <= LIMIT, F.lit(True))).alias("kept"))
