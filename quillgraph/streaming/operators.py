"""Stateful and streaming operators."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, SECONDS = 10, 60


def admitted(times: list[float], limit: int = LIMIT, seconds: float = SECONDS, window: list[float] | None = None) -> tuple[list[bool], list[float]]:
    """Which requests pass, in order, and the window that stays: entries older than ``seconds`` leave, rejected requests never enter."""
    window, out = list(window or []), []
    for t in times:
        window = [x for x in window if x >= t - seconds]
        out.append(len(window) < limit)
        if out[-1]:
            window.append(t)
    return out, window


def rate_limit(requests: DataFrame, limit: int = LIMIT, seconds: float = SECONDS) -> DataFrame:
    """requests(key, ts in seconds, id) with ``allowed``; each key is a sequence of its own.

    Rows of a key stream through one task in order, a batch at a time; only the
    window is carried on, so a key may have any number of rows.
    """

    def run(batches):
        key, window = None, []
        for pdf in batches:
            allowed = np.zeros(len(pdf), bool)
            keys, times = pdf["key"].to_numpy(object), pdf["ts"].to_numpy(float)
            cuts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(pdf) else np.zeros(0, int)
            for i, j in zip(cuts, [*cuts[1:], len(pdf)], strict=True):
                if keys[i] != key:
                    key, window = keys[i], []
                allowed[i:j], window = admitted(times[i:j].tolist(), limit, seconds, window)
            yield pdf.assign(allowed=allowed)

    kinds = dict(requests.dtypes)
    rows = requests.select("key", F.col("ts").cast("double").alias("ts"), "id").repartition("key").sortWithinPartitions("key", "ts", "id")
    return rows.mapInPandas(run, f"key {kinds['key']}, ts double, id {kinds['id']}, allowed boolean")


def rate_limit_stream(requests: DataFrame, limit: int = LIMIT, seconds: float = SECONDS, late: str = "1 minute") -> DataFrame:
    """The same over a stream: the window of a key is its state, dropped once the watermark has passed its last entry by ``seconds``.

    Requests that come later than ``late`` behind the newest one are dropped.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    def run(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        window = list(state.get[0]) if state.exists else []
        pdf = pd.concat(list(batches)).sort_values(["ts", "id"])
        ok, window = admitted(pdf["ts"].tolist(), limit, seconds, window)
        state.update((window,))
        state.setTimeoutTimestamp(max(int((pdf["ts"].iloc[-1] + 1 + seconds) * 1000), state.getCurrentWatermarkMs()) + 1)
        yield pdf.assign(allowed=ok)[["key", "ts", "id", "allowed"]]

    kinds = dict(requests.dtypes)
    # a second later, since the first watermark, 0, holds a request at 0 for late
    rows = requests.select("key", F.col("ts").cast("double").alias("ts"), "id", F.timestamp_millis(((F.col("ts") + 1) * 1000).cast("long")).alias("_at")).withWatermark("_at", late)
    return rows.groupBy("key").applyInPandasWithState(run, f"key {kinds['key']}, ts double, id {kinds['id']}, allowed boolean", "window array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def ingest_stream(texts: DataFrame, store, name: str, checkpoint: str):
    """Documents of a stream into a store, each content once however often it comes."""
    from quillgraph.operators.ingest import documents

    def batch(df: DataFrame, _: int) -> None:
        store.upsert(name, documents(df), "doc_id", "absent")

    return texts.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def metric_windows(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """Counts, sums and extremes of events(ts, event_type, value) by tumbling window; the same plan serves batch and stream."""
    by = events.groupBy(F.window(F.col("ts").cast("timestamp"), width), "event_type")
    return by.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.min("value").alias("least"), F.max("value").alias("most")).select(F.col("window.start").alias("start"), "event_type", "n", "total", "least", "most")
