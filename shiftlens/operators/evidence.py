"""Evidence graph as two tables: nodes and edges of the best-ranked hypotheses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRAPH_HYPOTHESES = 10


def _factor() -> Column:
    return F.when(
        F.col("dimension_value").isNotNull(), F.concat("dimension", F.lit("="), "dimension_value")
    ).otherwise(F.concat("dimension", F.lit("_drift")))


def _kept(hypotheses: DataFrame) -> DataFrame:
    return (
        hypotheses.filter(F.col("rank") <= GRAPH_HYPOTHESES)
        .withColumn("factor", _factor())
        .withColumn("ev", F.get("evidence", F.lit(0)))
        .withColumn("ev_id", F.concat(F.lit("EV_"), "hypothesis_id"))
    )


def _node(node_id: Column, kind: str, place: int, label: Column, size: int, color: Column, info: Column) -> Column:
    return F.struct(
        node_id.alias("node_id"), F.lit(kind).alias("node_type"), F.lit(place).alias("place"),
        label.alias("label"), F.lit(size).alias("size"), color.alias("color"), info.alias("info"),
    )


def graph_nodes(hypotheses: DataFrame) -> DataFrame:
    """Metric, dimension, segment, hypothesis and evidence nodes; the first definition wins."""
    dim = F.col("dimension")
    status_color = (
        F.when(F.col("status") == "supported", "red").when(F.col("status") == "weak", "amber").otherwise("gray")
    )
    effect = F.format_string(
        "%s=%+.2f (p=%.3f)", F.col("ev.effect_name"), F.coalesce("ev.effect", F.lit(0.0)), F.col("ev.p_value")
    )
    nodes = F.array(
        _node(F.col("metric"), "metric", 0, F.concat(F.lit("Target: "), "metric"), 35, F.lit("blue"),
              F.lit("Metric under investigation")),
        _node(dim, "dimension", 1, F.concat(F.lit("Dim: "), dim), 25, F.lit("purple"),
              F.concat(F.lit("Dimension "), dim)),
        _node(F.col("factor"), "segment", 2, F.coalesce("dimension_value", dim), 22, F.lit("cyan"), F.col("description")),
        _node(F.col("hypothesis_id"), "hypothesis", 3,
              F.format_string("Rank #%d: %s", F.col("rank"), F.upper("status")), 18, status_color,
              F.format_string("%s | plausibility %.1f%%", F.col("title"), F.col("score"))),
        F.when(F.col("ev").isNotNull(),
               _node(F.col("ev_id"), "evidence", 4, effect, 14, F.lit("green"), F.col("ev.interpretation"))),
    )
    listed = _kept(hypotheses).select("run_id", "rank", F.explode(F.array_compact(nodes)).alias("node"))
    first = Window.partitionBy("run_id", "node.node_id").orderBy("node.place", "rank")
    return (
        listed.withColumn("_first", F.row_number().over(first))
        .filter(F.col("_first") == 1)
        .select("run_id", "node.node_id", "node.node_type", "node.label", "node.size", "node.color", "node.info")
    )


def graph_edges(hypotheses: DataFrame) -> DataFrame:
    """metric -> dimension -> segment -> hypothesis -> evidence."""

    def edge(source: Column, target: Column, relation: str, weight: Column) -> Column:
        return F.struct(
            source.alias("source"), target.alias("target"),
            F.lit(relation).alias("relation"), weight.alias("weight"),
        )

    edges = F.array(
        edge(F.col("metric"), F.col("dimension"), "decomposed_by", F.lit(1.0)),
        edge(F.col("dimension"), F.col("factor"), "contains", F.lit(1.5)),
        edge(F.col("factor"), F.col("hypothesis_id"), "tested_by", F.col("score") / 20.0),
        F.when(
            F.col("ev").isNotNull(),
            edge(F.col("hypothesis_id"), F.col("ev_id"), "verified_by", F.lit(2.0)),
        ),
    )
    listed = _kept(hypotheses).select("run_id", F.explode(F.array_compact(edges)).alias("e"))
    return listed.select("run_id", "e.*").distinct()
