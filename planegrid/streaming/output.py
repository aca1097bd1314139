"""Streaming twins: histograms by event time, and the output of a picture buffer as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from planegrid.plans.registry import query
from planegrid.sources.scratch import shared_folder
from planegrid.sources.tables import table


def events_stream(spark: SparkSession, path: str) -> DataFrame:
    """The events under a path as a stream, a file or directory of Parquet."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(path)


def finished(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over all that is there and return its rows, which its tasks write to a table in the shared folder.

    In the mode complete a batch's rows replace those before.
    """
    spark, folder = stream.sparkSession, shared_folder(stream.sparkSession, "stream")
    schema, batches = stream.schema, []

    def keep(rows: DataFrame, number: int) -> None:
        path = f"{folder}/{number}"
        rows.write.mode("overwrite").parquet(path)
        batches[:] = [path] if mode == "complete" else [b for b in batches if b != path] + [path]

    running = stream.writeStream.foreachBatch(keep).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{folder}-state").start()
    running.awaitTermination()
    return spark.read.schema(schema).parquet(*batches) if batches else spark.createDataFrame([], schema)


def windowed_histogram(events: DataFrame) -> DataFrame:
    """Samples of each hour by level, for events up to a day late."""
    own = events.select(F.to_timestamp("ts").alias("ts"), F.least(F.lit(255), F.floor(F.col("value") / 2).cast("int")).alias("v"))
    return own.withWatermark("ts", "1 day").groupBy(F.window("ts", "1 hour"), F.shiftright("v", 2).alias("bin")).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("hour"), "bin", "n")


@query("stream_histogram", "SELECT date_trunc('hour', ts) AS hour, least(255, floor(value / 2)::INT) >> 2 AS bin, count(*) AS n FROM events GROUP BY ALL")
def stream_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finished(windowed_histogram(_whole(spark, sf_dir)), "complete")


def _whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream: its folder holds other tables, so the file is named."""
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*events*").option("recursiveFileLookup", "true").parquet(sf_dir)


REORDER = 3


def bump_state(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Pictures of one stream as they come: over ``REORDER`` waiting, the smallest goes out; at the end mark all do.

    State is the pictures that wait, never more than that number, and the count of those out.
    """
    waiting, n = (list(state.get[0]), state.get[1]) if state.exists else ([], 0)
    out = []
    rows = pd.concat(batches)
    for poc in rows.sort_values("seq")["poc"]:
        if poc < 0:  # the end mark
            out += sorted(waiting)
            waiting = []
        else:
            waiting.append(int(poc))
            if len(waiting) > REORDER:
                waiting.sort()
                out.append(waiting.pop(0))
    state.update((waiting, n + len(out)))
    yield pd.DataFrame({"user_id": key[0], "output": range(n, n + len(out)), "poc": out})


def bumped(pictures: DataFrame) -> DataFrame:
    """(user_id, seq, poc) in coding order to (user_id, output, poc), as a stateful stream."""
    return pictures.groupBy("user_id").applyInPandasWithState(
        bump_state, "user_id long, output long, poc long", "waiting array<long>, n long", "append", GroupStateTimeout.NoTimeout
    )
