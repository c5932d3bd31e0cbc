"""Tests, effect sizes and verdicts, for all hypotheses of a table at once.

Moments per hypothesis come from one map-side combined aggregate. The rank test
is run only for hypotheses that need it, on distinct values inside
order-preserving buckets, so no task ever holds a whole hypothesis.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiftlens.functions.numeric import ratio
from shiftlens.functions.ordering import BUCKET, in_buckets, mid_rank, rank_columns, rank_totals, split_points
from shiftlens.functions.pvalues import chi_square_p, normal_p, student_t_p
from shiftlens.operators.cohorts import ANOMALY, BASELINE, PERIOD, in_anomaly, in_baseline

SMALL = "Insufficient Sample Size"
WELCH = "Welch's Two-Sample t-test"
RANK_SUM = "Mann-Whitney U Rank-Sum Test"
CHI_SQUARE = "Chi-Square Test of Independence"
CHI_SQUARE_SHORT = "Chi-Square Independence"
SKEW_LIMIT = 1.5
RANK_MIN = 30
SMALL_LIMIT = 5
Z_95 = 1.96


def _se2() -> Column:
    """Squared standard error; a missing variance leaves the test undefined."""
    base = ratio(F.col("var_base"), F.col("n_base"), None)
    return base + ratio(F.col("var_anom"), F.col("n_anom"), None)


def moments(long: DataFrame, by: list[str], volume: str | None = None) -> DataFrame:
    """Non-null n, mean, sample variance and population skewness per cohort; rows as ``volume`` if named.

    Cohorts are grouped, so that a row is added to its own alone, and then laid side by side.
    """
    parts = {"n": F.count("x"), "mean": F.avg("x"), "var": F.var_samp("x"), "skew": F.skewness("x")}
    if volume:
        parts = {volume: F.count(F.lit(1)), **parts}
    per_cohort = long.groupBy(*by, PERIOD).agg(*[column.alias(name) for name, column in parts.items()])
    sides = []
    for name in parts:
        for side, cohort in (("base", BASELINE), ("anom", ANOMALY)):
            value = F.max(F.when(F.col(PERIOD) == cohort, F.col(name)))
            sides.append((F.coalesce(value, F.lit(0)) if name in ("n", volume) else value).alias(f"{name}_{side}"))
    return per_cohort.groupBy(*by).agg(*sides)


def cohens_d() -> Column:
    """Anomaly minus baseline in pooled standard deviations; zero when undefined."""
    n1, n2 = F.col("n_base"), F.col("n_anom")
    pooled = F.sqrt(ratio((n1 - 1) * F.col("var_base") + (n2 - 1) * F.col("var_anom"), n1 + n2 - 2, None))
    value = F.when(pooled > 0, ratio(F.col("mean_anom") - F.col("mean_base"), pooled))
    return F.when((n1 >= 2) & (n2 >= 2), F.coalesce(value, F.lit(0.0))).otherwise(0.0)


def effect_size(m: DataFrame) -> DataFrame:
    return m.withColumn("cohens_d", cohens_d())


def welch(m: DataFrame) -> DataFrame:
    """Unequal-variance t, its degrees of freedom and two-sided p."""
    diff = F.col("mean_anom") - F.col("mean_base")
    a = ratio(F.col("var_base"), F.col("n_base"), None)
    b = ratio(F.col("var_anom"), F.col("n_anom"), None)
    spread = ratio(a * a, F.col("n_base") - 1, None) + ratio(b * b, F.col("n_anom") - 1, None)
    flat = F.when(diff == 0, 0.0).otherwise(F.signum(diff) * F.lit(float("inf")))
    flat_p = F.when(diff == 0, 1.0).otherwise(0.0)
    out = m.withColumns({
        "welch_t": F.when(_se2() > 0, diff / F.sqrt(_se2())).when(_se2() == 0, flat),
        "welch_df": ratio((a + b) * (a + b), spread, None),
    })
    p = F.when(_se2() > 0, student_t_p("welch_t", "welch_df")).when(_se2() == 0, flat_p)
    return out.withColumns({
        "welch_p": F.coalesce(p, F.lit(1.0)), "welch_t": F.coalesce("welch_t", F.lit(0.0)),
    })


def mean_difference_ci(m: DataFrame) -> DataFrame:
    """Normal 95 % interval of the difference in means."""
    diff = F.col("mean_anom") - F.col("mean_base")
    margin = F.lit(Z_95) * F.sqrt(F.coalesce(_se2(), F.lit(0.0)))
    return m.withColumns({"mean_diff": diff, "ci_low": diff - margin, "ci_high": diff + margin})


def rank_sum(long: DataFrame, by: list[str], split_by: str | None = None) -> DataFrame:
    """Mann-Whitney U of the anomaly cohort with tie-corrected normal p.

    ``split_by`` names a column of ``by`` whose keys have their own value range;
    buckets that ``long`` already has are used. Frequent values are counted before
    the shuffle. All others are shuffled once, by bucket, and summed there.
    """
    placed = long.filter(F.col("x").isNotNull() & F.col(PERIOD).isNotNull())
    if BUCKET not in long.columns:
        cuts = split_points(placed, "x", split_by)
        placed = in_buckets(placed, "x", cuts, split_by, own_bucket=True)
    placed = placed.select(*by, PERIOD, "x", BUCKET)
    own = F.col(BUCKET) % 2 == 0
    sides = [F.count_if(in_baseline()).alias("c_base"), F.count_if(in_anomaly()).alias("c_anom")]
    frequent = placed.filter(own).groupBy(*by, BUCKET).agg(*sides).withColumn("_below", F.lit(0).cast("long"))
    others = placed.filter(~own).repartition(*by, BUCKET).groupBy(*by, BUCKET, "x").agg(*sides)
    inside = Window.partitionBy(*by, BUCKET).orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    others = others.withColumn("_below", F.coalesce(F.sum("c_base").over(inside), F.lit(0)))
    copies = (F.col("c_base") + F.col("c_anom")).cast("double")
    wins = F.col("c_anom").cast("double") * (F.col("_below") + F.col("c_base") / 2)
    per_bucket = frequent.unionByName(others.drop("x")).groupBy(*by, BUCKET).agg(
        F.sum("c_base").cast("double").alias("b"),
        F.sum("c_anom").cast("double").alias("a"),
        F.sum(wins).alias("u"),
        F.sum(copies * copies * copies - copies).alias("tie"),
        F.count(F.lit(1)).alias("values"),
    )
    before = Window.partitionBy(*by).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.coalesce(F.sum("b").over(before), F.lit(0.0))
    table = per_bucket.withColumn("u", F.col("u") + earlier * F.col("a")).groupBy(*by).agg(
        F.sum("b").cast("double").alias("nb"),
        F.sum("a").cast("double").alias("na"),
        F.sum("u").alias("u_stat"),
        F.sum("tie").alias("tie_term"),
        F.sum("values").alias("distinct_values"),
    )
    pairs = F.col("na") * F.col("nb")
    total = F.col("na") + F.col("nb")
    correction = ratio(F.col("tie_term"), total * (total - 1))
    sigma = F.sqrt(pairs / 12.0 * (total + 1 - correction))
    larger = F.greatest(F.col("u_stat"), pairs - F.col("u_stat"))
    return (
        table.withColumn("u_z", ratio(larger - pairs / 2 - 0.5, sigma, None))
        .withColumn("u_p", F.when(F.col("u_z") > 0, normal_p("u_z")).otherwise(1.0))
        .select(*by, "u_stat", "u_z", "u_p", "distinct_values")
    )


def needs_ranks() -> Column:
    """Enough rows on both sides and a skewed cohort; decided from moments alone."""
    return (
        (F.col("n_base") > RANK_MIN)
        & (F.col("n_anom") > RANK_MIN)
        & (F.greatest(F.abs("skew_base"), F.abs("skew_anom")) > SKEW_LIMIT)
    )


def select_test(m: DataFrame, ranks: DataFrame, by: list[str]) -> DataFrame:
    """Choose Welch or rank-sum per hypothesis and fill statistic and p-value.

    ``ranks`` holds the skewed hypotheses; those with two distinct values are
    binary metrics and keep Welch.
    """
    tested = mean_difference_ci(welch(effect_size(m))).join(ranks, by, "left")
    small = (F.col("n_base") < SMALL_LIMIT) | (F.col("n_anom") < SMALL_LIMIT)
    ranked = needs_ranks() & (F.coalesce("distinct_values", F.lit(0)) > 2)

    def pick(if_small, if_ranked, if_welch) -> Column:
        return F.when(small, if_small).when(F.coalesce(ranked, F.lit(False)), if_ranked).otherwise(if_welch)

    empty = F.lit(None).cast("double")
    return tested.withColumns({
        "test_name": pick(F.lit(SMALL), F.lit(RANK_SUM), F.lit(WELCH)),
        "statistic": pick(F.lit(0.0), F.col("u_stat"), F.col("welch_t")),
        "p_value": pick(F.lit(1.0), F.col("u_p"), F.col("welch_p")),
        "effect_name": F.lit("Cohen's d"),
        "effect": F.when(small, 0.0).otherwise(F.col("cohens_d")),
        "df": F.when(~small, F.col("n_base") + F.col("n_anom") - 2),
        "ci_low": F.when(small, empty).otherwise(F.col("ci_low")),
        "ci_high": F.when(small, empty).otherwise(F.col("ci_high")),
    })


def two_sample(m: DataFrame, long: DataFrame, by: list[str], split_by: str | None = None) -> DataFrame:
    """Full two-sample evidence for hypotheses with moments ``m``.

    ``m`` should come from a written table. The rank test reads only rows of
    skewed hypotheses, by a semi-join whose strategy Spark picks from the known
    file size, and is left out when no hypothesis is skewed.
    """
    skewed = m.filter(needs_ranks()).select(*by)
    if skewed.isEmpty():
        unranked = [F.lit(None).cast("double").alias(c) for c in ("u_stat", "u_z", "u_p")]
        ranks = m.limit(0).select(*by, *unranked, F.lit(None).cast("long").alias("distinct_values"))
    else:
        needed = long.join(skewed, by, "left_semi")
        ranks = rank_sum(needed, by, split_by)
    return select_test(m, ranks, by)


def effect_word(size: Column) -> Column:
    return (
        F.when(size < 0.2, "negligible").when(size < 0.5, "small").when(size < 0.8, "moderate").otherwise("large")
    )


def association_word(size: Column) -> Column:
    return F.when(size < 0.1, "negligible").when(size < 0.3, "moderate").otherwise("strong")


def significance_word(p: Column) -> Column:
    return F.when(p < 0.05, "statistically significant").otherwise("not statistically significant")


def two_sample_text(subject: Column) -> Column:
    """One sentence for a two-sample row."""
    shift = F.when(F.col("mean_diff") < 0, "decrease").otherwise("increase")
    sentence = F.format_string(
        "%s: %s %s of %s, mean difference %+.4f (95%% CI %+.4f to %+.4f), p = %.4f, d = %+.2f (%s)",
        F.col("test_name"), significance_word(F.col("p_value")), shift, subject,
        F.col("mean_diff"), F.col("ci_low"), F.col("ci_high"),
        F.col("p_value"), F.col("effect"), effect_word(F.abs("effect")),
    )
    few = F.lit("Too few observations (fewer than 5 in a cohort) for a valid test.")
    return F.when(F.col("test_name") == SMALL, few).otherwise(sentence)


def with_words(tests: DataFrame, subject: Column) -> DataFrame:
    return tests.withColumns({
        "effect_word": effect_word(F.abs("effect")),
        "significance": significance_word(F.col("p_value")),
        "shift": F.when(F.col("mean_diff") < 0, "decrease").otherwise("increase"),
        "interpretation": two_sample_text(subject),
    })


def chi_square(segments: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Independence of period and category, per dimension (and run), from segment volumes.

    Two categories take the continuity correction: each gap shrinks by at most 1/2.
    The dimension totals are one row per dimension column, so they are broadcast.
    """
    by = [*keys, "dimension"]
    present = segments.filter((F.col("volume_base") + F.col("volume_anom")) > 0).select(
        *by, "volume_base", "volume_anom"
    )
    totals = present.groupBy(*by).agg(
        F.sum("volume_base").alias("total_base"),
        F.sum("volume_anom").alias("total_anom"),
        F.count(F.lit(1)).alias("categories"),
        F.count_if(F.col("volume_base") > 0).alias("categories_base"),
    )
    both = F.col("volume_base") + F.col("volume_anom")
    n = F.col("total_base") + F.col("total_anom")
    gap, parts = F.col("categories") == 2, []
    for side in ("base", "anom"):
        expected = ratio(both.cast("double") * F.col(f"total_{side}"), n)
        distance = F.abs(F.col(f"volume_{side}") - expected)
        corrected = distance - F.when(gap, F.least(F.lit(0.5), distance)).otherwise(0.0)
        parts.append(ratio(corrected * corrected, expected))
    table = (
        present.join(F.broadcast(totals), by)
        .groupBy(*by, "total_base", "total_anom", "categories", "categories_base")
        .agg(F.sum(parts[0] + parts[1]).alias("_chi2"))
    )
    enough = F.col("categories") >= 2
    table = table.withColumns({
        "chi2": F.when(enough, F.col("_chi2")).otherwise(0.0),
        "df": F.when(enough, (F.col("categories") - 1).cast("long")),
        "cramers_v": F.when(enough, F.sqrt(ratio(F.col("_chi2"), n))).otherwise(0.0),
    })
    return table.withColumns({
        "p_value": F.when(enough, chi_square_p("chi2", F.col("df").cast("double"))).otherwise(1.0),
        "association": association_word(F.col("cramers_v")),
    }).drop("_chi2")


def pair_columns() -> list[Column]:
    """Count, covariance and deviations of complete (x, y) pairs."""
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    x, y = F.when(both, F.col("x")), F.when(both, F.col("y"))
    return [
        F.count_if(both).alias("n_pairs"),
        F.covar_pop(x, y).alias("_cov"),
        F.stddev_pop(x).alias("_sx"),
        F.stddev_pop(y).alias("_sy"),
    ]


def pearson(table: DataFrame) -> DataFrame:
    """Pearson r and p from ``pair_columns``; r is NULL when a side is constant."""
    r = ratio(F.col("_cov"), F.col("_sx") * F.col("_sy"), None)
    return correlation_p(table.withColumn("r", r), "r").drop("_cov", "_sx", "_sy")


def correlation_p(table: DataFrame, r: str) -> DataFrame:
    """Add ``{r}_p`` from the t distribution with n - 2 degrees of freedom."""
    bounded = F.when(F.col(r).isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col(r))))
    df = F.col("n_pairs") - 2
    t = F.when(F.abs(F.col(r)) >= 1, F.lit(float("inf"))).otherwise(
        F.col(r) * F.sqrt(ratio(df, 1 - F.col(r) * F.col(r)))
    )
    return (
        table.withColumn(r, bounded)
        .withColumn("_t", t)
        .withColumn(f"{r}_p", F.coalesce(student_t_p("_t", df.cast("double")), F.lit(1.0)))
        .drop("_t")
    )


def spearman(placed: DataFrame, by: str) -> DataFrame:
    """Pearson r of mid-ranks over complete pairs, per key of ``by``.

    ``placed`` has x and y with their buckets bx and by. Pairs of frequent values
    (both are split points) are counted before the shuffle and ranked from bucket
    totals. The other pairs are sorted in buckets.
    """
    placed = placed.filter(F.col("x").isNotNull() & F.col("y").isNotNull()).select(by, "x", "y", "bx", "by")
    totals = rank_totals(placed, by, {"x": "bx", "y": "by"})
    own_x, own_y = F.col("bx") % 2 == 0, F.col("by") % 2 == 0
    counted = placed.filter(own_x & own_y).groupBy(by, "bx", "by").agg(F.count(F.lit(1)).alias("weight"))
    single = placed.withColumn("weight", F.lit(1).cast("long"))
    counted = mid_rank(mid_rank(counted, by, "x", "bx", totals, sort=False), by, "y", "by", totals, sort=False)
    own = mid_rank(single.filter(own_x & ~own_y), by, "x", "bx", totals, sort=False)
    between = mid_rank(single.filter(~own_x), by, "x", "bx", totals)
    sorted_pairs = mid_rank(own.unionByName(between), by, "y", "by", totals)
    columns = [by, "weight", "rank_x", "rank_y", "_all"]
    centre = (F.col("_all") + 1) / 2
    weight, dx, dy = F.col("weight"), F.col("rank_x") - centre, F.col("rank_y") - centre
    sums = counted.select(*columns).unionByName(sorted_pairs.select(*columns)).groupBy(by).agg(
        F.sum(weight).alias("n_pairs"),
        F.sum(weight * dx * dy).alias("_xy"),
        F.sum(weight * dx * dx).alias("_xx"),
        F.sum(weight * dy * dy).alias("_yy"),
    )
    rho = ratio(F.col("_xy"), F.sqrt(F.col("_xx")) * F.sqrt(F.col("_yy")), None)
    return correlation_p(sums.withColumn("rho", rho), "rho").select(by, "n_pairs", "rho", "rho_p")


def spearman_columns(
    wide: DataFrame, pairs: dict[str, tuple[str, str]], columns: dict[str, tuple[str, str]]
) -> DataFrame:
    """``spearman`` for pairs of columns of one table, keyed by their label in ``covariate``.

    ``columns`` maps a name to its value and bucket column. Columns that are NULL in the same
    rows have the same ranks in every pair, so each is ranked once for all its pairs. Other pairs
    are ranked pair by pair. One number per column and pair reaches the driver.
    """
    def both(label: str) -> Column:
        (x, _), (y, _) = (columns[name] for name in pairs[label])
        return F.col(x).isNotNull() & F.col(y).isNotNull()

    counts = [F.count(v).alias(v) for v, _ in columns.values()]
    known = wide.agg(*counts, *[F.count_if(both(label)).alias(f"_{k}") for k, label in enumerate(pairs)]).first()
    n = {label: known[f"_{k}"] for k, label in enumerate(pairs)}
    once = [k for k, names in pairs.items() if n[k] and all(known[columns[name][0]] == n[k] for name in names)]
    rest = [label for label in pairs if label not in once]
    found = []
    if rest:
        entries = []
        for label in rest:
            (x, bx), (y, by) = (columns[name] for name in pairs[label])
            parts = {"covariate": F.lit(label), "x": F.col(x), "bx": F.col(bx), "y": F.col(y), "by": F.col(by)}
            entries.append(F.struct(*[c.alias(name) for name, c in parts.items()]))
        found.append(spearman(wide.select(F.inline(F.array(*entries))), "covariate"))
    if once:
        used = {name: columns[name] for label in once for name in pairs[label]}
        gap = {name: F.col(f"rank_{v}") - F.lit((known[v] + 1) / 2) for name, (v, _) in used.items()}
        sums = [F.sum(gap[name] * gap[name]).alias(f"_s{v}") for name, (v, _) in used.items()]
        sums += [F.sum(gap[pairs[label][0]] * gap[pairs[label][1]]).alias(f"_p{k}") for k, label in enumerate(once)]
        entries = []
        for k, label in enumerate(once):
            x, y = (F.sqrt(F.col(f"_s{columns[name][0]}")) for name in pairs[label])
            rho = ratio(F.col(f"_p{k}"), x * y, None)
            entries.append(F.struct(F.lit(label).alias("covariate"), F.lit(n[label]).cast("long").alias("n_pairs"), rho.alias("rho")))
        table = rank_columns(wide, used).agg(*sums).select(F.inline(F.array(*entries)))
        found.append(correlation_p(table, "rho").select("covariate", "n_pairs", "rho", "rho_p"))
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def verdict(tests: DataFrame, expected: Column | None = None) -> DataFrame:
    """Status and score of the first piece of evidence.

    Needs p_value, effect, effect_name, n_base, n_anom; ``expected`` is the sign
    the effect should have, or NULL.
    """
    p, size = F.col("p_value"), F.abs(F.coalesce("effect", F.lit(0.0)))
    few = (F.col("n_base") < 10) | ((F.col("n_anom") > 0) & (F.col("n_anom") < 10))
    sign = expected if expected is not None else F.lit(None).cast("double")
    contrary = F.coalesce(F.col("effect") * sign < 0, F.lit(False))
    limit = F.when(F.col("effect_name") == "Cramer's V", 0.10).otherwise(0.20)
    meaningful = size >= limit
    capped = F.least(size, F.lit(2.0))
    strong = F.least(F.lit(95.0), 70.0 + capped * 12.5)
    medium = F.least(F.lit(85.0), 60.0 + capped * 10.0)
    status = (
        F.when(p.isNull() | few, "inconclusive")
        .when(contrary, "rejected")
        .when((p < 0.05) & meaningful, "supported")
        .when(p < 0.10, "weak")
        .otherwise("rejected")
    )
    score = (
        F.when(p.isNull(), 0.0)
        .when(few, 15.0)
        .when(contrary, 5.0)
        .when((p < 0.01) & meaningful, strong)
        .when((p < 0.05) & meaningful, medium)
        .when(p < 0.05, 45.0 + size * 10.0)
        .when(p < 0.10, 35.0)
        .otherwise(F.greatest(F.lit(5.0), 20.0 - (p - 0.10) * 20.0))
    )
    return tests.withColumns({"status": status, "score": score})


def p_text(p: Column) -> Column:
    return F.when(p < 0.0001, "< 0.0001").otherwise(F.format_string("%.4f", p))
