"""Keyed memory state in Structured Streaming: a bounded buffer per user over an event stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "user_id long, event_id long, evicted long, consolidate boolean"
STATE = "buffer array<long>, turns long"


def buffer_stream(events: DataFrame, capacity: int = 4, every: int = 10) -> DataFrame:
    """What each arrival pushes out of its user's buffer, and every tenth arrival's signal to consolidate. Rows of a
    user are taken in (ts, event_id) order within a batch; the state is the buffer's ids and a counter."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, turns = (list(state.get[0]), state.get[1]) if state.exists else ([], 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out = []
        for i in rows["event_id"]:
            held.append(int(i))
            turns += 1
            out.append((key[0], int(i), held.pop(0) if len(held) > capacity else None, turns % every == 0))
        state.update((held, turns))
        frame = pd.DataFrame(out, columns=["user_id", "event_id", "evicted", "consolidate"])
        frame["evicted"] = frame["evicted"].astype("Int64")
        yield frame

    return events.groupBy("user_id").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Events by type in tumbling windows; rows later than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("v")).select("window.start", "window.end", "event_type", "n", "v")


def read_events(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A directory of event files as a stream."""
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def drain(df: DataFrame, path: str, checkpoint: str) -> None:
    """Run a stream over what there is and write it to Parquet, exactly once across restarts."""
    df.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def boundary_stream(turns: DataFrame, gamma: float = 1.0, history: int = 20) -> DataFrame:
    """Whether each value of a stream (stream, seq, value) begins an episode: it exceeds mean + gamma * sample deviation
    of the last ``history`` values before it, of which two are needed. The state is those values; what is older is
    dropped once its boundaries are out. Rows of a stream are taken in seq order within a batch."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values("seq")
        flags = []
        for x in rows["value"].astype(float):
            recent = pd.Series(held[-history:], dtype=float)
            flags.append(bool(len(recent) >= 2 and x > recent.mean() + gamma * recent.std()))
            held = [*held[-history:], x][-history:]
        state.update((held,))
        yield pd.DataFrame({"stream": key[0], "seq": rows["seq"], "boundary": flags})

    return turns.groupBy("stream").applyInPandasWithState(step, "stream long, seq long, boundary boolean", "held array<double>", "append", GroupStateTimeout.NoTimeout)


def topic_stream(episodes: DataFrame, least: float = 0.5) -> DataFrame:
    """Topic of each arriving episode (stream, seq, vec): the first topic of its stream whose centre is at least this
    similar, else a new one. The state is the topics' centres and sizes, so a restart goes on where it was."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        centres, sizes = (np.array(state.get[0]).reshape(len(state.get[1]), -1), list(state.get[1])) if state.exists else (np.zeros((0, 0)), [])
        rows, topics = pd.concat(list(batches)).sort_values("seq"), []
        for v in map(np.asarray, rows["vec"]):
            centres = centres if len(sizes) else np.zeros((0, len(v)))
            norms = np.linalg.norm(centres, axis=1) * np.linalg.norm(v)
            alike = (centres @ v) / np.where(norms < 1e-9, np.inf, norms) >= least
            topic = int(alike.argmax()) if alike.any() else len(sizes)
            if topic == len(sizes):
                centres, sizes = np.vstack([centres, np.zeros(len(v))]), [*sizes, 0]
            sizes[topic] += 1
            centres[topic] += (v - centres[topic]) / sizes[topic]
            topics.append(topic)
        state.update((centres.ravel().tolist(), sizes))
        yield pd.DataFrame({"stream": key[0], "seq": rows["seq"], "topic": topics})

    return episodes.groupBy("stream").applyInPandasWithState(step, "stream long, seq long, topic int", "centres array<double>, sizes array<long>", "append", GroupStateTimeout.NoTimeout)
