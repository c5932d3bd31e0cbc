"""Column-name keyword lists that decide roles and priorities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# They must equal the keyword lists users rely on today.
DATE_WORDS = ["date", "time", "timestamp", "day", "created", "updated", "ts", "dt", "period", "month"]
ID_WORDS = [
    "id", "uuid", "guid", "key", "token", "hash",
    "session_id", "user_id", "order_id", "transaction_id",
]
FIRST_METRIC_WORDS = ["conversion", "churn", "revenue", "sales", "gmv", "rate", "latency", "error"]
SECOND_METRIC_WORDS = ["amount", "count", "score", "price", "duration"]
FIRST_SEGMENT_WORDS = ["device", "os", "platform", "country", "region", "channel", "category", "plan"]
BOOLEAN_TEXTS = ["0", "1", "true", "false", "True", "False"]


def has_word(name: str, words: list[str]) -> bool:
    lowered = name.lower()
    return any(word in lowered for word in words)


def name_has(column: Column, words: list[str]) -> Column:
    lowered = F.lower(column)
    hit = F.lit(False)
    for word in words:
        hit = hit | lowered.contains(word)
    return hit
