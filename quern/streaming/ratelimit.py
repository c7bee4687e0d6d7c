"""Rate limits in windows that open at a key's first event.

A window closes when an event comes ``window`` or later after its start; an event beyond
``most`` in an open window is refused and does not count. A blank key is always allowed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def decide(times: np.ndarray, most: int, window: int, count: int = 0, start: int | None = None) -> tuple[list[bool], int, int | None]:
    """Verdicts for sorted times, and the state after them."""
    out = []
    for t in times.tolist():
        if start is None or t - start >= window:
            count, start = 1, t
            out.append(True)
        elif count >= most:
            out.append(False)
        else:
            count += 1
            out.append(True)
    return out, count, start


def rate_limit(events: DataFrame, key: str, ts: str, tie: str, most: int, window_seconds: int) -> DataFrame:
    """``events`` with a column allowed: rows sorted by key and time stream through one carried state a task.

    A hot key is read in batches and never held whole. Rows with a blank key are allowed
    where they are, without being dealt.
    """
    schema = T.StructType([*events.schema.fields, T.StructField("allowed", T.BooleanType())])
    names = schema.names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, count, start = None, 0, None
        for pdf in batches:
            micros = pdf["__us"].to_numpy()
            ok = np.ones(len(pdf), bool)
            keys = pdf[key].to_numpy()
            edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True]))) if len(keys) else []
            for a, b in zip(edge, edge[1:]):
                k = keys[a]
                if k is None or k != k or k == "":
                    continue
                if k != now:
                    now, count, start = k, 0, None
                ok[a:b], count, start = decide(micros[a:b], most, window_seconds * 1_000_000, count, start)
            yield pdf.assign(allowed=ok)[names]

    blank = F.coalesce(F.col(key).cast("string") == "", F.lit(True))
    src = events.where(~blank).withColumn("__us", F.unix_micros(F.col(ts).cast("timestamp"))).repartition(key).sortWithinPartitions(key, "__us", tie)
    return src.mapInPandas(run, schema).unionByName(events.where(blank).withColumn("allowed", F.lit(True)))


def rate_limit_stream(events: DataFrame, key: str, ts: str, tie: str, most: int, window_seconds: int) -> DataFrame:
    """The same over a stream, count and start kept as state; rows of one micro-batch in order of time."""
    schema = T.StructType([*events.schema.fields, T.StructField("allowed", T.BooleanType())])

    def step(_, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(frames), ignore_index=True)
        pdf = pdf.sort_values([ts, tie], ignore_index=True)
        count, start = state.get if state.exists else (0, None)
        micros = (pd.to_datetime(pdf[ts]).astype("datetime64[us]")).astype("int64").to_numpy()
        ok, count, start = decide(micros, most, window_seconds * 1_000_000, count, start)
        state.update((count, start))
        yield pdf.assign(allowed=ok)[schema.names]

    return events.groupBy(key).applyInPandasWithState(step, schema, "count long, start long", "append", GroupStateTimeout.NoTimeout)


def running_counts(events: DataFrame, key: str, threshold: int) -> DataFrame:
    """(key, n, over): a running count, batch or stream (update mode)."""
    return events.groupBy(key).agg(F.count("*").alias("n")).withColumn("over", F.col("n") >= threshold)
