"""Run history: versioned rows, newest version per run wins.

Saving and deleting only append. Reading keeps the newest version of each id by
one aggregate, which combines map-side and so does not mind an id that was
saved very often. Writers that read the same last version at the same time are told
apart by their commit, so all readers agree on one of them.

What a run found can be as large as its segments are many. ``RunStore`` keeps it in
detail tables beside the rows: they are written first, below a folder named by the
commit, and the run row is appended last. A commit without a row, as a crash between
the two leaves it, is never read.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

META = [
    "id", "title", "created_at", "dataset_name", "row_count",
    "metric_col", "pct_change", "direction", "detection_method",
]


def versioned(runs: DataFrame, saved_at: Column, deleted: bool = False) -> DataFrame:
    return runs.withColumn("saved_at", saved_at).withColumn("deleted", F.lit(deleted))


def tombstones(ids: DataFrame, like: DataFrame, saved_at: Column) -> DataFrame:
    """Deletion rows for ``ids`` in the layout of the history table ``like``."""
    fields = [
        F.col("id") if f.name == "id" else F.lit(None).cast(f.dataType).alias(f.name)
        for f in like.schema.fields
        if f.name not in ("saved_at", "deleted", "version")
    ]
    return versioned(ids.select(*fields), saved_at, deleted=True)


def current(history: DataFrame) -> DataFrame:
    """Newest version per id; deleted runs are absent."""
    payload = [c for c in history.columns if c != "id"]
    order = F.struct("saved_at", *(c for c in ("version", "deleted", "commit") if c in payload))
    newest = history.groupBy("id").agg(F.max_by(F.struct(*payload), order).alias("run"))
    return newest.select("id", "run.*").filter(~F.col("deleted")).select(*history.columns)


def list_runs(history: DataFrame) -> DataFrame:
    return current(history).select(*META).orderBy(F.desc("created_at"), "id")


def load_run(history: DataFrame, run_id: str) -> DataFrame:
    """The stored run, or an empty frame. The id filter reaches the file scan."""
    return current(history.filter(F.col("id") == run_id))


def count_deleted(history: DataFrame, ids: DataFrame) -> DataFrame:
    """How many of ``ids`` a deletion would remove."""
    return current(history).join(ids.distinct(), "id", "left_semi").agg(
        F.count(F.lit(1)).alias("n_deleted")
    )


EMPTY = "id string, " + ", ".join(
    f"{c} {'long' if c == 'row_count' else 'double' if c == 'pct_change' else 'string'}" for c in META[1:]
) + ", saved_at timestamp, version long, deleted boolean"


class HistoryTable:
    """The history as an append-only Parquet folder, partitioned by save date.

    Each write has a version, which decides between rows saved at the same time.
    Before the first save the history is empty; rows with new columns can be added
    later, older rows then have NULL there.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path

    def _append(self, rows: DataFrame) -> None:
        last = self.rows().agg(F.max("version").alias("v")).first()["v"]
        dated = rows.withColumn("version", F.lit((last or 0) + 1).cast("long")).withColumn("save_date", F.to_date("saved_at"))
        dated.write.mode("append").partitionBy("save_date").parquet(self.path)

    def rows(self) -> DataFrame:
        try:
            return self.spark.read.option("mergeSchema", True).parquet(self.path).drop("save_date")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], EMPTY)

    def save(self, runs: DataFrame, saved_at: Column) -> None:
        self._append(versioned(runs, saved_at))

    def list(self) -> DataFrame:
        return list_runs(self.rows())

    def load(self, run_id: str) -> DataFrame:
        return load_run(self.rows(), run_id)

    def delete(self, ids: DataFrame, saved_at: Column) -> int:
        """Append tombstones; returns how many stored runs went."""
        found = count_deleted(self.rows(), ids).first()["n_deleted"]
        if found:
            self._append(tombstones(ids, self.rows(), saved_at))
        return found


class RunStore:
    """Run rows and their detail tables below one folder; ``rows`` has one row per run saved."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.runs = HistoryTable(spark, f"{path}/runs")
        self.path = path

    def _folder(self, name: str) -> str:
        return f"{self.path}/details/{name}"

    def write_details(self, details: dict[str, DataFrame]) -> str:
        """First half of a save: the tables below a commit that no row names yet."""
        commit = f"c-{uuid.uuid4().hex}"
        for name, rows in details.items():
            rows.write.parquet(f"{self._folder(name)}/commit={commit}")
        return commit

    def save(self, row: DataFrame, details: dict[str, DataFrame], saved_at: Column) -> None:
        commit = self.write_details(details)
        self.runs.save(row.withColumn("commit", F.lit(commit)), saved_at)

    def commit_of(self, run_id: str) -> str | None:
        """Commit of the newest saved version; None for unknown and deleted runs."""
        row = self.runs.load(run_id).first()
        return row and row["commit"]

    def table(self, commit: str, name: str) -> DataFrame:
        """One table of one saved run; no other folder is listed or read."""
        return self.spark.read.parquet(f"{self._folder(name)}/commit={commit}")

    def all_details(self, name: str) -> DataFrame:
        """(id, ...) over all runs that are listed; folders of other commits are pruned."""
        current_runs = current(self.runs.rows()).select("id", "commit")
        rows = self.spark.read.option("mergeSchema", True).parquet(self._folder(name))
        return rows.join(current_runs, "commit").drop("commit")

    def orphans(self, name: str) -> DataFrame:
        """(commit) of folders that no row names: left by crashes, or by a save still under way."""
        named = self.runs.rows().select("commit").distinct()
        return self.spark.read.parquet(self._folder(name)).select("commit").distinct().join(named, "commit", "left_anti")
