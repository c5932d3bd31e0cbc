"""Four families of hypotheses, tested and ranked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiftlens.functions.numeric import named, number
from shiftlens.functions.ordering import BUCKET, bucket_of, column_split_points
from shiftlens.operators import statistics as st
from shiftlens.operators.cohorts import PERIOD
from shiftlens.operators.decomposition import JOINT, leading, top_per_dimension
from shiftlens.session import materialize

TOP_SEGMENTS = 5
TOP_JOINT = 3
SEGMENT = ["dimension", "segment_value"]
RUN_KEYS = ("run_id", "metric")
Name = str | Column

CAVEATS = [
    "An association seen in this data is no proof of a cause.",
    "Factors outside this table may explain the pattern.",
    "Many hypotheses were tested; confirm with new data or an experiment.",
]
MEDIATION_CAVEAT = "A third factor may drive both the covariate and the metric."
SMALL_COHORT_CAVEAT = "Crossed cohorts are small, so their intervals are wide."


def _evidence(interpretation: Column, **columns: Column) -> Column:
    fields = {
        "test_name": None, "statistic": "double", "p_value": "double", "effect_name": None,
        "effect": "double", "n_base": "long", "n_anom": "long", "df": "long",
        "ci_low": "double", "ci_high": "double",
    }
    parts = []
    for name, kind in fields.items():
        column = columns.get(name, F.col(name))
        parts.append((column.cast(kind) if kind else column).alias(name))
    shown_p = st.p_text(columns.get("p_value", F.col("p_value"))).alias("p_text")
    return F.struct(*parts, shown_p, interpretation.alias("interpretation"))


def _hypothesis_id(prefix: str, run_id: Name, metric: Name) -> Column:
    text = F.concat_ws("|", F.lit(run_id), F.lit(metric), "dimension", "dimension_value")
    return F.concat(F.lit(f"HYP-{prefix}-"), F.upper(F.substring(F.md5(text), 1, 8)))


def _listed(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _position(column: str, names: list[str]) -> Column:
    where = F.lit(len(names))
    for i, name in enumerate(names):
        where = F.when(F.col(column) == name, i).otherwise(where)
    return where


def _shaped(table: DataFrame, prefix: str, family: str, run_id: Name, metric: Name, order: list[Column]) -> DataFrame:
    """Common hypothesis columns; ``order`` breaks score ties in listing order."""
    while len(order) < 4:
        order.append(F.lit(0))
    return table.select(
        F.lit(run_id).alias("run_id"),
        F.lit(metric).alias("metric"),
        _hypothesis_id(prefix, run_id, metric).alias("hypothesis_id"),
        F.lit(family).alias("family"),
        "dimension", "dimension_value", "title", "description", "test_plan",
        "evidence", "status", "score", "caveats",
        F.struct(*[c.cast("int").alias(f"o{i}") for i, c in enumerate(order)]).alias("listing"),
    )


def _split_by(keys: tuple[str, ...]) -> str | None:
    """Runs of one metric share the range of its values."""
    return "metric" if keys else None


def segment_tests(contribs: DataFrame, long: DataFrame, k: int = TOP_SEGMENTS, keys: tuple[str, ...] = ()) -> DataFrame:
    """Two-sample test of each leading contributor, with verdict and boosted score."""
    first = top_per_dimension(contribs, k, keys).filter((F.col("volume_base") >= 5) & (F.col("volume_anom") >= 5))
    tested = st.two_sample(first, long, [*keys, *SEGMENT], _split_by(keys))
    sign = F.when(F.col("total_delta") < 0, -1.0).otherwise(1.0)
    judged = st.verdict(tested, sign)
    boosted = F.least(
        F.lit(100.0), F.col("score") * 0.7 + F.least(F.abs("pct_of_total"), F.lit(100.0)) * 0.3
    )
    return judged.withColumn("score", boosted)


def segment_hypotheses(
    contribs: DataFrame, long: DataFrame, dimensions: list[str], run_id: Name, metric: Name, k: int = TOP_SEGMENTS,
    keys: tuple[str, ...] = (),
) -> DataFrame:
    subject = F.concat(F.lit(metric), F.lit(" in "), "dimension", F.lit("="), "segment_value")
    tested = segment_tests(contribs, long, k, keys).withColumn("dimension_value", F.col("segment_value"))
    table = (
        tested.withColumn("title", F.format_string("Segment %s = '%s' drives the change", "dimension", "segment_value"))
        .withColumn(
            "description",
            F.format_string(
                "Mean %s in '%s' moved from %.4f to %.4f, which is %.1f%% of the total change.",
                F.lit(metric), F.col("segment_value"), F.col("rate_base"), F.col("rate_anom"), F.col("pct_of_total"),
            ),
        )
        .withColumn("test_plan", F.lit("Two-sample test of the segment's metric between the cohorts."))
        .withColumn("evidence", F.array(_evidence(st.two_sample_text(subject))))
        .withColumn("caveats", _listed(CAVEATS))
    )
    order = [F.lit(0), _position("dimension", dimensions), F.lit(0), F.col("impact_rank")]
    return _shaped(table, "SEG", "segment_performance", run_id, metric, order)


def mix_tests(segments: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Chi-square of each dimension that has enough rows and two baseline categories."""
    tested = st.chi_square(segments, keys).filter(
        (F.col("total_base") >= 10) & (F.col("total_anom") >= 10) & (F.col("categories_base") >= 2)
    )
    named = tested.select(
        *keys, "dimension",
        F.lit(st.CHI_SQUARE).alias("test_name"),
        F.col("chi2").alias("statistic"),
        "p_value",
        F.lit("Cramer's V").alias("effect_name"),
        F.col("cramers_v").alias("effect"),
        F.col("total_base").alias("n_base"),
        F.col("total_anom").alias("n_anom"),
        "df",
        "association",
    )
    return st.verdict(named)


def mix_hypotheses(
    segments: DataFrame, dimensions: list[str], run_id: Name, metric: Name, keys: tuple[str, ...] = ()
) -> DataFrame:
    text = F.format_string(
        "%s: %s change of composition, chi2 = %.2f, df = %d, p = %.4f, V = %.3f (%s)",
        F.col("test_name"), st.significance_word(F.col("p_value")), F.col("statistic"),
        F.col("df"), F.col("p_value"), F.col("effect"), F.col("association"),
    )
    none = F.lit(None).cast("double")
    table = (
        mix_tests(segments, keys).withColumn("dimension_value", F.lit(None).cast("string"))
        .withColumn("title", F.format_string("The mix of '%s' shifted", "dimension"))
        .withColumn(
            "description",
            F.format_string("The share of rows per value of '%s' changed, which can move the overall mean.", "dimension"),
        )
        .withColumn("test_plan", F.lit("Chi-square test of period against category."))
        .withColumn("evidence", F.array(_evidence(text, ci_low=none, ci_high=none)))
        .withColumn("caveats", _listed(CAVEATS))
    )
    order = [F.lit(0), _position("dimension", dimensions), F.lit(1)]
    return _shaped(table, "MIX", "mix_shift", run_id, metric, order)


def long_covariates(tagged: DataFrame, metric: str, covariates: list[str]) -> DataFrame:
    """(period, y, covariate, x) over the whole table, rows outside both cohorts included."""
    columns = [number(c).alias(c) for c in covariates]
    wide = tagged.select(F.col(PERIOD).alias("_period"), number(metric).alias("_y"), *columns)
    long = wide.unpivot(["_period", "_y"], [named(c) for c in covariates], "covariate", "x")
    return long.withColumnsRenamed({"_period": PERIOD, "_y": "y"})


def places(names: list[str]) -> dict[str, tuple[str, str]]:
    """Value and bucket column of each name in ``placed_columns``."""
    return {name: (f"v{i}", f"b{i}") for i, name in enumerate(names)}


def placed_columns(tagged: DataFrame, periods: dict[str, Column], names: list[str]) -> DataFrame:
    """The columns ``periods``, and each named column as a number with its bucket; see ``places``.

    The bucket search is the dearest step and five passes use its outcome, so the
    numbers and their buckets are written down once, one row per fact.
    """
    cuts = column_split_points(tagged, {c: number(c) for c in names})
    wide = dict(periods)
    for name, (value, bucket) in places(names).items():
        wide[value] = number(name)
        wide[bucket] = bucket_of(number(name), cuts[name], own_bucket=True)
    return materialize(tagged.select(*[c.alias(n) for n, c in wide.items()]), "placed")


def shifted_values(placed: DataFrame, keys: dict[str, tuple[str, str]], names: list[str]) -> DataFrame:
    """(period, covariate, x, bucket) per key in ``covariate``: a period column and a name."""
    at = places(names)
    return placed.select(F.inline(F.array(*[
        F.struct(
            F.col(period).alias(PERIOD), F.lit(key).alias("covariate"),
            F.col(at[name][0]).alias("x"), F.col(at[name][1]).alias(BUCKET),
        )
        for key, (period, name) in keys.items()
    ])))


def paired_sums(placed: DataFrame, pairs: dict[str, tuple[str, str]], names: list[str]) -> DataFrame:
    """Sums for the linear correlation per key in ``covariate``, over rows outside both cohorts as well."""
    at = places(names)
    entries = [
        F.struct(F.lit(key).alias("covariate"), F.col(at[x][0]).alias("x"), F.col(at[y][0]).alias("y"))
        for key, (x, y) in pairs.items()
    ]
    return placed.select(F.inline(F.array(*entries))).groupBy("covariate").agg(*st.pair_columns())


def covariate_shift(long: DataFrame, moments: DataFrame) -> DataFrame:
    """Two-sample test of each covariate with five values on both sides."""
    enough = moments.filter((F.col("n_base") >= 5) & (F.col("n_anom") >= 5))
    tested = st.two_sample(enough, long, ["covariate"], split_by="covariate")
    return tested.withColumn("test_name", F.concat(F.lit("Covariate Shift ("), "test_name", F.lit(")")))


def covariate_tests(tagged: DataFrame, metric: str, covariates: list[str]) -> DataFrame:
    """Correlations, shift and verdict per covariate."""
    names = [metric, *covariates]
    placed = placed_columns(tagged.select(PERIOD, *(named(c) for c in names)), {PERIOD: F.col(PERIOD)}, names)
    pairs = {c: (c, metric) for c in covariates}
    long = shifted_values(placed, {c: (PERIOD, c) for c in covariates}, names)
    shift = covariate_shift(long, materialize(st.moments(long, ["covariate"]), "moments"))
    return judged_covariates(paired_sums(placed, pairs, names), st.spearman_columns(placed, pairs, places(names)), shift)


def judged_covariates(sums: DataFrame, ranked: DataFrame, shift: DataFrame) -> DataFrame:
    """Tests and verdict per key in the column ``covariate``, from its correlations and its shift."""
    joined = st.pearson(sums).join(ranked.drop("n_pairs"), "covariate", "left").join(shift, "covariate", "left")
    correlated = F.col("n_pairs") >= 10
    shifted = F.col("test_name").isNotNull()
    joined = joined.filter(correlated | shifted).withColumn("has_shift_test", shifted)
    judged_by = {
        "p_value": F.col("r_p"), "effect": F.col("r"), "effect_name": F.lit("Pearson r"),
        "n_base": F.col("n_pairs"), "n_anom": F.lit(0).cast("long"),
    }
    kept = {f"_{name}": F.col(name) for name in judged_by}
    first = {name: F.when(shifted, F.col(name)).otherwise(other) for name, other in judged_by.items()}
    judged = st.verdict(joined.withColumns({**kept, **first})).drop(*judged_by)
    judged = judged.withColumnsRenamed({f"_{name}": name for name in judged_by})
    strong_r = correlated & (F.abs("r") > 0.25) & (F.col("r_p") < 0.05)
    strong_rho = correlated & (F.abs("rho") > 0.25) & (F.col("rho_p") < 0.05)
    moved = F.coalesce(F.col("p_value") < 0.05, F.lit(False))
    both = (F.coalesce(strong_r, F.lit(False)) | F.coalesce(strong_rho, F.lit(False))) & moved
    return judged.withColumns({
        "score": F.when(both, F.least(F.lit(92.0), F.col("score") + 20.0)).otherwise(F.col("score")),
        "status": F.when(both, "supported").otherwise(F.col("status")),
    })


def covariate_hypotheses(
    tagged: DataFrame, covariates: list[str], run_id: str, metric: str
) -> DataFrame:
    return covariate_family(covariate_tests(tagged, metric, covariates), covariates, run_id, metric)


def covariate_family(tested: DataFrame, covariates: list[str], run_id: Name, metric: Name) -> DataFrame:
    none = F.lit(None).cast("double")
    whole = {"n_base": F.col("n_pairs"), "n_anom": F.lit(0), "df": none, "ci_low": none, "ci_high": none}

    def correlation(name: str, effect: str, word: str) -> Column:
        p = F.col(f"{effect}_p")
        text = F.format_string(
            "%s correlation with %s: %+.3f (p = %.4f)", F.lit(word), F.lit(metric), F.coalesce(F.col(effect), F.lit(0.0)), p
        )
        return F.when(
            F.col("n_pairs") >= 10,
            _evidence(
                text, test_name=F.lit(f"{name} Correlation"), statistic=F.col(effect), p_value=p,
                effect_name=F.lit("Pearson r" if effect == "r" else "Spearman rho"), effect=F.col(effect), **whole,
            ),
        )

    shift = F.when(F.col("has_shift_test"), _evidence(st.two_sample_text(F.col("covariate"))))
    table = (
        tested.withColumn("dimension", F.col("covariate"))
        .withColumn("dimension_value", F.lit(None).cast("string"))
        .withColumn("title", F.format_string("Covariate '%s' drifted together with %s", F.col("covariate"), F.lit(metric)))
        .withColumn(
            "description",
            F.format_string("Whether '%s' moved between the cohorts and runs along with %s.", F.col("covariate"), F.lit(metric)),
        )
        .withColumn("test_plan", F.lit("Linear and rank correlation, and a two-sample test of the covariate."))
        .withColumn(
            "evidence",
            F.array_compact(
                F.array(correlation("Pearson", "r", "Linear"), correlation("Spearman Rank", "rho", "Rank"), shift)
            ),
        )
        .withColumn("caveats", _listed([*CAVEATS, MEDIATION_CAVEAT]))
    )
    return _shaped(table, "COV", "covariate_drift", run_id, metric, [F.lit(1), _position("covariate", covariates)])


def joint_tests(
    segments: DataFrame, long: DataFrame, joint: str, k: int = TOP_JOINT, keys: tuple[str, ...] = ()
) -> DataFrame:
    """Two-sample test of the crossed cohorts with the most anomaly rows."""
    crossed = segments.filter((F.col("dimension") == joint) & (F.col("volume_anom") > 0))
    first = leading(crossed, [F.desc("volume_anom"), F.asc("segment_value")], k, "volume_rank", keys)
    enough = first.filter((F.col("volume_base") >= 8) & (F.col("volume_anom") >= 8))
    judged = st.verdict(st.two_sample(enough, long, [*keys, *SEGMENT], _split_by(keys)))
    return judged.filter(F.col("status").isin("supported", "weak")).withColumn("score", F.col("score") + 5.0)


def joint_hypotheses(
    segments: DataFrame, long: DataFrame, dimensions: list[str], run_id: Name, metric: Name, k: int = TOP_JOINT,
    keys: tuple[str, ...] = (),
) -> DataFrame:
    joint = JOINT.join(dimensions[:2])
    tested = joint_tests(segments, long, joint, k, keys).withColumn("dimension_value", F.col("segment_value"))
    subject = F.concat(F.lit(metric), F.lit(" in "), "segment_value")
    table = (
        tested.withColumn("title", F.format_string("Crossed cohort '%s' changed", "segment_value"))
        .withColumn(
            "description",
            F.format_string("Rows in '%s' changed on their own, pointing at the crossing of two dimensions.", "segment_value"),
        )
        .withColumn("test_plan", F.lit("Two-sample test of the crossed cohort's metric."))
        .withColumn("evidence", F.array(_evidence(st.two_sample_text(subject))))
        .withColumn("caveats", _listed([*CAVEATS, SMALL_COHORT_CAVEAT]))
    )
    return _shaped(table, "INT", "multivariate_anomaly", run_id, metric, [F.lit(2), F.lit(0), F.lit(0), F.col("volume_rank")])


def rank_hypotheses(families: list[DataFrame]) -> DataFrame:
    """Union of the families, supported first, then by score; rank starts at 1.

    Each run has a handful of hypotheses per dimension and covariate column.
    """
    table = families[0]
    for other in families[1:]:
        table = table.unionByName(other)
    status = (
        F.when(F.col("status") == "supported", 0)
        .when(F.col("status") == "weak", 1)
        .when(F.col("status") == "inconclusive", 2)
        .otherwise(3)
    )
    order = Window.partitionBy("run_id", "metric").orderBy(status, F.desc("score"), "listing")
    return table.withColumn("rank", F.row_number().over(order)).drop("listing")


def by_status(hypotheses: DataFrame, status: str) -> DataFrame:
    return hypotheses.filter(F.col("status") == status)
