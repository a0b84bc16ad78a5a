"""The change log as a stream: the same rules as operators.sync.replay(), with state by key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_of(spark, path: str, schema: str, *, files_per_trigger: int = 1) -> DataFrame:  # noqa: ANN001
    """Parquet files of a folder as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def latest_state(log: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """After each batch the state of the keys that it touched: key, values, updated_at, deleted, n_applied, n_conflicts.

    log: key, values, arrival, updated_at, op. Writes of one batch are applied in order of arrival; a later batch counts as later.
    """
    kinds = {f.name: f.dataType.simpleString() for f in log.schema}
    state = ", ".join([*[f"{v} {kinds[v]}" for v in values], "updated_at long, deleted boolean, n_applied long, n_conflicts long"])
    output = ", ".join([f"{k} {kinds[k]}" for k in key]) + ", " + state
    names = [*key, *values, "updated_at", "deleted", "n_applied", "n_conflicts"]

    def fold(group: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        now = list(held.get) if held.exists else [*[None] * len(values), None, False, 0, 0]
        for write in pd.concat(list(frames)).sort_values("arrival").to_dict("records"):
            at, deleted = now[len(values)], now[len(values) + 1]
            applies = (at is None or write["updated_at"] >= at) and write["op"] in ("upsert", "delete", "undelete") and not (deleted and write["op"] == "upsert")
            if applies:
                now[: len(values) + 2] = [*[write[v] for v in values], int(write["updated_at"]), write["op"] == "delete"]
            now[-2 if applies else -1] += 1
        held.update(tuple(now))
        yield pd.DataFrame([(*group, *now)], columns=names)

    return log.groupBy(*key).applyInPandasWithState(fold, output, state, "update", GroupStateTimeout.NoTimeout)


def deduplicated(log: DataFrame, key: list[str], *, at: str, delay: str = "1 hour") -> DataFrame:
    """Without repeated deliveries of one write that come within the delay; state is dropped after it."""
    return log.withWatermark(at, delay).dropDuplicatesWithinWatermark(key)


def request_rates(log: DataFrame, user: str, *, at: str, delay: str = "2 minutes", limit: int = 60) -> DataFrame:
    """Requests by user and minute, with what passes the limit; late ones count within the delay."""
    counts = log.withWatermark(at, delay).groupBy(user, F.window(at, "1 minute").alias("minute")).agg(F.count("*").alias("n"))
    return counts.withColumn("limited", F.col("n") > limit)


def drain(stream: DataFrame, name: str, checkpoint: str, *, mode: str = "update"):  # noqa: ANN201
    """All that is there, as a table in memory (for tests and small sinks); the checkpoint goes on from there next time."""
    return stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_batches(stream: DataFrame, apply, checkpoint: str):  # noqa: ANN001, ANN201
    """Each micro-batch once by its number: apply(batch, batch_id) must be idempotent, as store.insert_or_ignore() makes it."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
