"""Streaming forms of the log operators: ordered delivery, expiry, incremental indexes, windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltmark.operators import search


def delivered(packets: DataFrame, patience: str = "10 minutes") -> DataFrame:
    """Packets (src, seq, payload) of each source in order, each held until the one before it has come.

    State of a source: the next seq, and what waits. A repeated packet is dropped. Waiting packets of a source that
    stays silent for ``patience`` are given up, as status 'lost'.
    """
    millis = int(pd.Timedelta(patience).total_seconds() * 1000)

    def step(key, batches: Iterator[pd.DataFrame], state):
        next_seq, waiting = state.get if state.exists else (0, "[]")
        held = {int(r["seq"]): r["payload"] for r in pd.read_json(pd.io.common.StringIO(waiting), orient="records", dtype={"payload": str}).to_dict("records")} if waiting != "[]" else {}
        if state.hasTimedOut:
            state.remove()
            rows = [(key[0], s, p, "lost") for s, p in sorted(held.items())]
            yield pd.DataFrame(rows, columns=["src", "seq", "payload", "status"])
            return
        for batch in batches:
            for seq, payload in zip(batch["seq"], batch["payload"], strict=True):
                if seq >= next_seq:
                    held.setdefault(int(seq), payload)
        rows = []
        while next_seq in held:
            rows.append((key[0], next_seq, held.pop(next_seq), "delivered"))
            next_seq += 1
        state.update((next_seq, pd.DataFrame(sorted(held.items()), columns=["seq", "payload"]).to_json(orient="records")))
        state.setTimeoutDuration(millis)
        yield pd.DataFrame(rows, columns=["src", "seq", "payload", "status"])

    return packets.groupBy("src").applyInPandasWithState(
        step, "src bigint, seq bigint, payload string, status string", "next_seq bigint, waiting string", "append", "ProcessingTimeTimeout"
    )


def live_keys(commands: DataFrame, lateness: str = "1 hour", window: str = "1 hour") -> DataFrame:
    """Latest value of each key in each window of event time, late rows dropped after ``lateness``."""
    stamped = commands.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    return stamped.groupBy(F.window("ts", window).alias("w"), "key").agg(F.max_by("value", F.struct("ts", "seq")).alias("value"), F.count("*").alias("n"))


def windowed_counts(events: DataFrame, width: str, slide: str, lateness: str) -> DataFrame:
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    return stamped.groupBy(F.window("ts", width, slide).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def index_increment(logs: DataFrame) -> DataFrame:
    """Postings of a log stream: stateless, so they can be appended to a table as they come."""
    return search.postings(logs)


def committed_prefix(log: DataFrame, marker: str) -> DataFrame:
    """Rows of a log stream with the last marker seen, for readers that keep only what is before it."""
    return log.withColumn("is_marker", F.col("kind") == marker)
