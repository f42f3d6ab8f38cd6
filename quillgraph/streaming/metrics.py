"""Runtime metrics: counters, histograms and a gauge, filled by what Spark observes while plans run."""

from __future__ import annotations

import threading
import time
from collections import defaultdict
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

# Names of the metrics with the label each has, and upper ends of the buckets in seconds.
COUNTERS = {
    "aquery_total": "",
    "aquery_errors_total": "",
    "llm_calls_total": "provider",
    "llm_errors_total": "provider",
    "embedding_calls_total": "provider",
    "embedding_errors_total": "provider",
    "graph_operations_total": "operation",
    "graph_errors_total": "operation",
    "cache_hits_total": "mode",
    "cache_misses_total": "mode",
    "retry_total": "component",
    "keyword_fallback_total": "",
}
HISTOGRAMS = {"aquery_duration_seconds": "", "llm_call_duration_seconds": "provider", "embedding_duration_seconds": "provider", "graph_operation_duration_seconds": "operation"}
GAUGES = {"active_queries": ""}
BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0)


def bucket_counts(seconds: Column) -> list[Column]:
    """Aggregates of a histogram: values up to each end, all of them, and their sum."""
    return [*(F.count_if(seconds <= b).alias(f"le_{i}") for i, b in enumerate(BUCKETS)), F.count(seconds).alias("n"), F.sum(seconds).alias("total")]


def histogram(rows: DataFrame, label: str, seconds: str) -> DataFrame:
    """(label, le, n, total): cumulative counts of rows by bucket, the last one (le null) with all; one pass, a row a label before it is unfolded."""
    by = rows.groupBy(F.col(label).alias("label")).agg(*bucket_counts(F.col(seconds)))
    ends = F.array(*(F.struct(F.lit(b).alias("le"), F.col(f"le_{i}").alias("n")) for i, b in enumerate(BUCKETS)), F.struct(F.lit(None).cast("double").alias("le"), F.col("n").alias("n")))
    return by.select("label", F.explode(ends).alias("_b"), "total").select("label", "_b.le", "_b.n", "total")


def timed_udf(call, kind: str):
    """A column function that gives struct(value, seconds): what call(series) gives for a batch, and each row's share of the time."""

    def run(texts: pd.Series) -> pd.DataFrame:
        began = time.perf_counter()
        found = list(call(texts))
        return pd.DataFrame({"value": found, "seconds": (time.perf_counter() - began) / max(1, len(texts))})

    return F.pandas_udf(run, f"struct<value: {kind}, seconds: double>")


class Metrics:
    """All metrics of a process; a metric that nothing has touched yet stands at 0."""

    def __init__(self):
        self._lock, self.counters, self.gauges = threading.Lock(), defaultdict(float), defaultdict(float)
        self.histograms = defaultdict(lambda: [0.0] * (len(BUCKETS) + 2))

    def count(self, name: str, n: float = 1, label: str = "") -> None:
        if name not in COUNTERS:
            raise KeyError(name)
        with self._lock:
            self.counters[name, label] += n

    def _add(self, name: str, label: str, values: list[float]) -> None:
        with self._lock:
            self.histograms[name, label] = [a + b for a, b in zip(self.histograms[name, label], values, strict=True)]

    def observe(self, name: str, seconds: float, label: str = "") -> None:
        if name not in HISTOGRAMS:
            raise KeyError(name)
        self._add(name, label, [*(float(seconds <= b) for b in BUCKETS), 1.0, seconds])

    @contextmanager
    def timed(self, what: str, label: str = ""):
        """A query or store operation: counted, timed, and its error counted if it has one."""
        duration = {"aquery": "aquery_duration_seconds", "graph": "graph_operation_duration_seconds"}[what]
        total, errors = {"aquery": ("aquery_total", "aquery_errors_total"), "graph": ("graph_operations_total", "graph_errors_total")}[what]
        began = time.perf_counter()
        self.count(total, 1, label)
        if what == "aquery":
            with self._lock:
                self.gauges["active_queries"] += 1
        try:
            yield
        except Exception:
            self.count(errors, 1, label)
            raise
        finally:
            self.observe(duration, time.perf_counter() - began, label)
            if what == "aquery":
                with self._lock:
                    self.gauges["active_queries"] -= 1

    def called(self, df: DataFrame, column: str, udf, text: Column, what: str, run, provider: str = "default") -> DataFrame:
        """df with what a timed_udf gives as column; run(df) executes the plan once, its Observation fills the calls and times of ``what``."""
        seen = Observation()
        rows = df.withColumn("_called", udf(text)).observe(seen, *bucket_counts(F.col("_called.seconds")))
        try:
            out = run(rows.withColumn(column, F.col("_called.value")).drop("_called"))
        except Exception:
            self.count(f"{what}_errors_total", 1, provider)
            raise
        found = seen.get
        self.count(f"{what}_calls_total", found["n"], provider)
        self._add({"llm": "llm_call_duration_seconds", "embedding": "embedding_duration_seconds"}[what], provider, [*(found[f"le_{i}"] for i in range(len(BUCKETS))), found["n"], found["total"] or 0.0])
        return out

    def cached(self, lookups: DataFrame, run, mode: str = "default") -> DataFrame:
        """Cache lookups (with a column hit, null for none), executed once by run; hits and misses are counted."""
        seen = Observation()
        out = run(lookups.observe(seen, F.count("hit").alias("hits"), F.count("*").alias("all")))
        found = seen.get
        self.count("cache_hits_total", found["hits"], mode)
        self.count("cache_misses_total", found["all"] - found["hits"], mode)
        return out

    def listener(self) -> StreamingQueryListener:
        """Counts the batches of streams as queries, with their durations and failures; add it by spark.streams.addListener."""
        metrics = self

        class Listener(StreamingQueryListener):
            def onQueryStarted(self, event):
                with metrics._lock:
                    metrics.gauges["active_queries"] += 1

            def onQueryProgress(self, event):
                metrics.count("aquery_total")
                metrics.observe("aquery_duration_seconds", event.progress.batchDuration / 1000)

            def onQueryIdle(self, event):
                pass

            def onQueryTerminated(self, event):
                with metrics._lock:
                    metrics.gauges["active_queries"] -= 1
                if event.exception:
                    metrics.count("aquery_errors_total")

        return Listener()

    def rows(self, spark: SparkSession) -> DataFrame:
        """(name, kind, label, le, value): a row a counter or gauge, a row a bucket (le null: all) and the sum of each histogram."""
        with self._lock:
            flat = []
            for n in COUNTERS:
                found = {label: v for (m, label), v in self.counters.items() if m == n} or {"": 0.0}
                flat += [(n, "counter", label, None, float(v)) for label, v in found.items()]
            flat += [(n, "gauge", "", None, self.gauges[n]) for n in GAUGES]
            for n in HISTOGRAMS:
                found = {label: v for (m, label), v in self.histograms.items() if m == n} or {"": [0.0] * (len(BUCKETS) + 2)}
                for label, v in found.items():
                    flat += [(n, "bucket", label, b, float(x)) for b, x in zip((*BUCKETS, None), v[:-1], strict=True)] + [(n, "sum", label, None, float(v[-1]))]
        return spark.createDataFrame(flat, "name string, kind string, label string, le double, value double")
