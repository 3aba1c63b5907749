"""A fixed-window rate limiter over requests, as state per key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Requests allowed, and the window in seconds.
POLICIES = {"public": (100, 900), "strict": (20, 900), "admin": (10, 900), "billing": (5, 3600), "export": (10, 3600)}
_OUT = "key string, at long, n long, allowed boolean"


def decide(at: list[int], most: int, window: int, start: int | None = None, n: int = 0) -> tuple[list[tuple[int, bool]], int | None, int]:
    """For requests in order: the count in their window and whether they pass. A window begins with the first
    request after the last one ended; times in microseconds."""
    out = []
    for t in at:
        if start is None or start + window * 1_000_000 < t:
            start, n = t, 0
        n += 1
        out.append((n, n <= most))
    return out, start, n


def limited(requests: DataFrame, policy: str, slots: int = 1) -> DataFrame:
    """Batch form: requests (key, at) in microseconds; each key's requests pass through one state in time order.

    Rows stream through ``mapInPandas`` sorted by key and time, so a key of any size needs memory for one batch.
    """
    most, window = POLICIES[policy]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, start, n = object(), None, 0
        for part in parts:
            rows = []
            for k, t in zip(part["key"], part["at"], strict=True):
                if k != key:
                    key, start, n = k, None, 0
                [(count, allowed)], start, n = decide([int(t)], most, window, start, n)
                rows.append((k, t, count, allowed))
            yield pd.DataFrame(rows, columns=["key", "at", "n", "allowed"])

    return requests.select("key", "at").repartition("key").sortWithinPartitions("key", "at").mapInPandas(run, _OUT)


def alive(decided: DataFrame, policy: str) -> DataFrame:
    """(key, start, n): the windows that haven't ended at the time of the last request; all others are expired."""
    window = POLICIES[policy][1]
    last = decided.groupBy("key").agg(F.max(F.when(F.col("n") == 1, F.col("at"))).alias("start"), F.max_by("n", F.struct("at", "n")).alias("n"))
    now = F.broadcast(decided.agg(F.max("at").alias("now")))
    return last.join(now).filter(F.col("start") + window * 1_000_000 >= F.col("now")).select("key", "start", "n")
