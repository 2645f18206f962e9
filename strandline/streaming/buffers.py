"""Streams of series: the last values of each key, and event-time windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strandline.operators.motif import find_pattern


def last_values(stream: DataFrame, n: int, key: str = "series", order: str = "t", value: str = "x") -> DataFrame:
    """key, size, buffer: the last ``n`` values of each key after each batch. State holds these values alone."""

    def update(k, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        new = pd.concat(list(parts)).sort_values(order)
        held = (held + new[value].astype(float).tolist())[-n:]
        state.update((held,))
        yield pd.DataFrame({key: [k[0]], "size": [len(held)], "buffer": [held]})

    kind = dict(stream.dtypes)[key]
    return stream.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, size int, buffer array<double>", "held array<double>", "update", GroupStateTimeout.NoTimeout)


def online_patterns(stream: DataFrame, history: int, shortest: int, longest: int, sink, checkpoint: str):
    """Keep the last values of each key; after each batch, ``sink`` gets the pattern learned anew from each full buffer."""

    def learn(batch: DataFrame, number: int) -> None:
        def run(parts):
            for pdf in parts:
                rows = [(k, *found) for k, x in zip(pdf["series"], pdf["buffer"], strict=True) if len(x) >= 2 * longest for found in find_pattern([x], shortest, longest)[1]]
                yield pd.DataFrame(rows, columns=["series", "start", "end"])

        kind = dict(batch.dtypes)["series"]
        sink(batch.mapInPandas(run, f"series {kind}, start long, end long"), number)

    return last_values(stream, history).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(learn).start()


def windowed_totals(stream: DataFrame, time: str, width: str, late: str, *keys: str) -> DataFrame:
    """Counts and means of x in tumbling windows; rows later than ``late`` behind the newest are dropped by the watermark."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"), F.avg("x").alias("mean"))
