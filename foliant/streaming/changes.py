"""Structured Streaming over change feeds: ordered logs, stale observations, repeated observations, debounce.

Every operator is a keyed state machine; rows of one key are put in order inside a micro-batch before they are applied,
since their order is not guaranteed. State is a few numbers for each key; late data is told by (epoch, generation),
not by a watermark.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from foliant.session import ensure_checkpoint_dir

#: Seconds between two equal observations from which a file counts as stable.
STABLE_SECONDS = 10.0
#: Seconds that a lease lasts, receipts that a log keeps, seconds without rows after which the state of a path is forgotten.
LEASE_SECONDS, RECEIPTS, FORGET_SECONDS = 300.0, 1_000, 90 * 86_400


def next_in_log(state: tuple | None, row: dict[str, Any]) -> tuple[tuple, str]:
    """(state, outcome) of one request of an ordered log; the state is (epoch, last sequence, receipts).

    A new epoch starts at 1 again, an older one is STALE. A request id that was applied is REPLAY if it comes with the same sequence and
    digest, else CONFLICT; of others, the next number is OK, one up to the last REPLAY, a later one GAP, and neither is applied. Receipts of the last
    RECEIPTS requests are kept; what is older can't be applied again, as its number is not the next.
    """
    epoch, last, receipts = state or (-1, 0, "{}")
    if row["epoch"] < epoch:
        return (epoch, last, receipts), "STALE"
    if row["epoch"] > epoch:
        epoch, last, receipts = row["epoch"], 0, "{}"
    n, request = row["sequence"], str(row.get("request_id") or row["sequence"])
    known = json.loads(receipts)
    if request in known:
        return (epoch, last, receipts), "REPLAY" if known[request] == [n, row["digest"]] else "CONFLICT"
    if n != last + 1:
        return (epoch, last, receipts), "REPLAY" if n <= last else "GAP"
    known[request] = [n, row["digest"]]
    if len(known) > RECEIPTS:
        del known[next(iter(known))]
    return (epoch, n, json.dumps(known)), "OK"


def next_lease(state: tuple | None, row: dict[str, Any]) -> tuple[tuple, str]:
    """(state, outcome) of a worker that asks for a source; the state is (worker, epoch, end in seconds). While a lease lasts, its owner is
    told HELD and others BUSY; after it the asker is GRANTED a new epoch for LEASE_SECONDS."""
    worker, epoch, end = state or ("", 0, float("-inf"))
    if row["seconds"] < end:
        return (worker, epoch, end), "HELD" if row["worker_id"] == worker else "BUSY"
    return (row["worker_id"], epoch + 1, row["seconds"] + LEASE_SECONDS), "GRANTED"


def next_pointer(state: tuple | None, row: dict[str, Any]) -> tuple[tuple, str]:
    """(state, outcome) of a compare-and-set; the state is (version,), 0 at first: APPLIED, and one more, if the version is the expected one."""
    version = state[0] if state else 0
    return ((version + 1,), "APPLIED") if row["expected"] == version else ((version,), "REJECTED")


def next_observation(state: tuple | None, row: dict[str, Any]) -> tuple[tuple, str]:
    """(state, outcome): an observation older than the newest by (epoch, generation) is IGNORED_STALE, the same REPLAY."""
    at, newest = (row["epoch"], row["generation"]), state or (-1, -1)
    if at > newest:
        return at, "APPLIED"
    return newest, "REPLAY" if at == newest else "IGNORED_STALE"


def next_fingerprint(state: tuple | None, row: dict[str, Any]) -> tuple[tuple, str]:
    """(state, outcome): STABLE from the second equal fingerprint STABLE_SECONDS after the first, a change starts anew."""
    mark, since = state or ("", 0.0)
    if row["fingerprint"] != mark:
        return (row["fingerprint"], row["seconds"]), "WAITING"
    return (mark, since), "STABLE" if row["seconds"] - since >= STABLE_SECONDS else "WAITING"


def _state(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_LOG_STATE = _state(epoch=T.LongType(), last=T.LongType(), receipts=T.StringType())
_OBSERVATION_STATE = _state(epoch=T.LongType(), generation=T.LongType())
_FINGERPRINT_STATE = _state(mark=T.StringType(), since=T.DoubleType())
_LEASE_STATE = _state(worker=T.StringType(), epoch=T.LongType(), end=T.DoubleType())
_POINTER_STATE = _state(version=T.LongType())


def _machine(step: Callable, order: list[str], needs: list[str], ttl: int | None) -> Callable:
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        parts = list(frames)
        rows = parts[0] if len(parts) == 1 else pd.concat(parts)
        if len(rows) > 1:
            rows = rows.sort_values(order, kind="stable")
        now = tuple(state.get) if state.exists else None
        outcomes = []
        used = [c for c in needs if c in rows]
        for values in zip(*(rows[c].tolist() for c in used), strict=True):
            now, outcome = step(now, dict(zip(used, values, strict=True)))
            outcomes.append(outcome)
        state.update(now)
        if ttl is not None:
            state.setTimeoutDuration(ttl * 1000)
        yield rows.assign(outcome=outcomes)

    return run


def _stateful(stream: DataFrame, keys: list[str], step: Callable, order: list[str], state: T.StructType, needs: list[str], ttl: int | None) -> DataFrame:
    """ttl: seconds without a row after which the state of a key is forgotten (FORGET_SECONDS for streams without end); None keeps it for
    good, and must be used with availableNow, which would wait for every timeout to pass."""
    out = T.StructType([*stream.schema.fields, T.StructField("outcome", T.StringType())])
    timeout = GroupStateTimeout.NoTimeout if ttl is None else GroupStateTimeout.ProcessingTimeTimeout
    return stream.groupBy(*keys).applyInPandasWithState(_machine(step, order, needs, ttl), out, state, "append", timeout)


def ordered_log(stream: DataFrame, source: str = "source_id", arrival: str = "arrival", ttl: int | None = None) -> DataFrame:
    """Rows (source, epoch, sequence, request_id, digest, arrival) with their outcome; without request_id the sequence stands for it."""
    return _stateful(stream, [source], next_in_log, [arrival], _LOG_STATE, ["epoch", "sequence", "request_id", "digest"], ttl)


def observations(stream: DataFrame, keys: list[str], arrival: str, ttl: int | None = None) -> DataFrame:
    """Rows with epoch and generation, with their outcome for each key. Of a key without rows for ttl seconds nothing is known any more."""
    return _stateful(stream, keys, next_observation, [arrival], _OBSERVATION_STATE, ["epoch", "generation"], ttl)


def debounced(stream: DataFrame, keys: list[str], arrival: str, ttl: int | None = None) -> DataFrame:
    """Rows with fingerprint and seconds, with their outcome for each key."""
    return _stateful(stream, keys, next_fingerprint, [arrival], _FINGERPRINT_STATE, ["fingerprint", "seconds"], ttl)


def leases(stream: DataFrame, source: str, arrival: str) -> DataFrame:
    """Rows with worker_id and seconds, with their outcome for each source."""
    return _stateful(stream, [source], next_lease, ["seconds", arrival], _LEASE_STATE, ["worker_id", "seconds"], None)


def pointers(stream: DataFrame, key: str, arrival: str) -> DataFrame:
    """Compare-and-set requests (key, expected, arrival) with their outcome."""
    return _stateful(stream, [key], next_pointer, [arrival], _POINTER_STATE, ["expected"], None)


def as_stream(rows: DataFrame) -> DataFrame:
    """A table written to the checkpoint folder and read as a stream."""
    ensure_checkpoint_dir(rows.sparkSession)
    path = f"{rows.sparkSession.sparkContext.getCheckpointDir()}/feed-{uuid.uuid4()}"
    rows.write.parquet(path)
    return rows.sparkSession.readStream.schema(rows.schema).parquet(path)


def run_available(stream: DataFrame) -> DataFrame:
    """What a stream yields from the data that is there, written to the checkpoint folder and read back."""
    spark: SparkSession = stream.sparkSession
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4()}"
    query = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def windowed(stream: DataFrame, time: str, late: str, width: str, *keys: str) -> DataFrame:
    """Counts by event-time window and key, windows closed by the watermark."""
    from pyspark.sql import functions as F

    return stream.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n"))
