"""Evidence as a stream: imports are recognised by digest, spans are united as they arrive.

The union of ranges doesn't depend on order, so late and repeated walks need no watermark for
coverage; first dates are taken as minima, not by arrival.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.intervals import merged

STATE = "los array<double>, his array<double>, date string"
OUT = "coverage_id string, intervals array<struct<lo:double,hi:double>>, frac double, date string, gained double"


def _united(spans: list[tuple[float, float]]) -> list[tuple[float, float]]:
    out: list[list[float]] = []
    for lo, hi in sorted((max(0.0, min(s)), min(1.0, max(s))) for s in spans):
        if out and lo <= out[-1][1] + 1e-9:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def new_imports(spans: DataFrame, delay: str = "365 days") -> DataFrame:
    """spans (digest, event_time, ...) without those of a digest seen before, within the delay."""
    return spans.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["digest", "coverage_id", "lo", "hi"])


def progress(spans: DataFrame) -> DataFrame:
    """A stream of OUT from a stream of spans (coverage_id, lo, hi, date): a passage's state is its disjoint ranges."""

    def update(key: tuple, parts, state: GroupState):
        los, his, date = state.get if state.exists else ([], [], None)
        held = list(zip(los, his, strict=True))
        before = sum(b - a for a, b in held)
        for pdf in parts:
            held += list(zip(pdf["lo"], pdf["hi"], strict=True))
            seen = pdf["date"].dropna()
            if len(seen):
                date = min([seen.min(), *([date] if date else [])])
            held = _united(held)
        frac = min(1.0, sum(b - a for a, b in held))
        state.update(([a for a, _ in held], [b for _, b in held], date))
        yield pd.DataFrame({"coverage_id": [key[0]], "intervals": [[{"lo": a, "hi": b} for a, b in held]], "frac": [frac], "date": [date], "gained": [frac - before]})

    return spans.groupBy("coverage_id").applyInPandasWithState(update, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def upsert(spans: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Keep a table of WALKED (coverage_id, intervals, date) in folder: each micro-batch writes a new version of it."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.groupBy("coverage_id").agg(F.collect_list(F.struct("lo", "hi")).alias("intervals"), F.min("date").alias("date"))
        if number:
            new = new.unionByName(spark.read.parquet(f"{folder}/version={number - 1}"))
        whole = new.groupBy("coverage_id").agg(merged(F.flatten(F.collect_list("intervals"))).alias("intervals"), F.min("date").alias("date"))
        whole.write.mode("overwrite").parquet(f"{folder}/version={number}")

    return spans.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
