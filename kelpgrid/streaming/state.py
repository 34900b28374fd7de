"""Event streams whose answer depends on what was answered before: rate limits and leases, as state of a key."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ADMITTED = "event_id long, at long, admitted boolean, retry_us long"


def _admit(at: int, hits: deque, most: int, window: int) -> tuple[bool, int]:
    """Whether a hit is let in and, if not, how long until a place is free; ``hits`` are the admitted times of the window."""
    while hits and hits[0] <= at - window:
        hits.popleft()
    if len(hits) >= most:
        return False, max(0, window - (at - hits[0])) if hits else window
    hits.append(at)
    return True, 0


def admitted(events: DataFrame, key: str, seconds: int, most: int, id_col: str = "event_id") -> DataFrame:
    """``key, event_id, at, admitted, retry_us``: hits of a sliding window that counts admitted ones only.

    A hit is refused if ``most`` hits of its key were admitted less than ``seconds`` before; ``retry_us`` is how long until
    the oldest of them leaves. Hits of one time count in the order of their id; hits without a time or key are refused.
    A batch is sorted by key and time and read once, with at most ``most`` times in memory; a stream keeps these times as
    state of the key, which goes when the watermark has passed them.
    """
    window = seconds * 1_000_000
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    if events.isStreaming:
        return _admitted_stream(events.withColumn("at", micros), key, window, most, id_col)
    kind = events.schema[key].dataType.simpleString()
    rows = events.select(F.col(key).alias("key"), F.col(id_col).cast("long").alias("event_id"), micros.alias("at"))
    usable = F.col("at").isNotNull() & F.col("key").isNotNull()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, hits = None, deque()
        for part in batches:
            out = []
            for k, at in zip(part["key"], part["at"]):
                if k != last:
                    last, hits = k, deque()
                out.append(_admit(at, hits, most, window))
            yield part.assign(admitted=[a for a, _ in out], retry_us=[r for _, r in out])

    schema = f"key {kind}, {ADMITTED}"
    decided = rows.where(usable).repartition("key").sortWithinPartitions("key", "at", "event_id").mapInPandas(run, schema)
    refused = rows.where(~usable).select("key", "event_id", "at", F.lit(False).alias("admitted"), F.lit(None).cast("long").alias("retry_us"))
    return decided.unionByName(refused).withColumnRenamed("key", key)


def _admitted_stream(events: DataFrame, key: str, window: int, most: int, id_col: str) -> DataFrame:
    kind = events.schema[key].dataType.simpleString()

    def run(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        hits = deque(state.get[0] if state.exists else [])
        # What came since the last trigger, in the order of time; bounded by the trigger's share of one key.
        rows = pd.concat(list(parts)).sort_values(["at", id_col])
        out = [_admit(int(at), hits, most, window) for at in rows["at"]]
        state.update((list(hits),))
        end = (int(rows["at"].max()) + window) // 1000 + 1
        if end > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(end)
        yield pd.DataFrame({key: group[0], "event_id": rows[id_col], "at": rows["at"], "admitted": [a for a, _ in out], "retry_us": [r for _, r in out]})

    usable = events.where(F.col("at").isNotNull() & F.col(key).isNotNull()).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", f"{window // 1_000_000} seconds")
    schema = f"{key} {kind}, {ADMITTED}"
    return usable.select(key, id_col, "ts", "at").groupBy(key).applyInPandasWithState(run, schema, "hits array<long>", "append", GroupStateTimeout.EventTimeTimeout)


LEASED = "job long, at long, worker string, outcome string"


def _lease(kind: str, worker: str | None, at: int, held: list, lease: int, tries: int) -> tuple[list, str]:
    """The state ``[status, worker, until, claims]`` after one event, and what came of the event."""
    status, owner, until, claims = held
    if status == "processing" and at >= until:  # the lease ran out before this event
        status, owner = ("failed" if claims >= tries else "queued"), None
    if kind == "enqueue":
        return ([status, owner, until, claims], "known") if status else (["queued", None, 0, 0], "queued")
    if kind == "claim":
        return (["processing", worker, at + lease, claims + 1], "claimed") if status == "queued" else ([status, owner, until, claims], "refused")
    mine = status == "processing" and owner == worker
    if kind == "renew" and mine:
        return [status, owner, at + lease, claims], "renewed"
    if kind == "complete" and mine:
        return ["done", None, 0, claims], "done"
    return [status, owner, until, claims], "refused"


def leases(events: DataFrame, minutes: int = 10, tries: int = 3) -> DataFrame:
    """``job, at, worker, outcome`` of a queue's events ``job, ts, worker, kind`` (enqueue, claim, renew, complete), as a stream or a batch.

    A job is one key with its state: queued, processing by one worker until its lease runs out, done, or failed once it was
    claimed ``tries`` times without an end. A claim is granted only on a queued job, so no two workers hold one job; renew and
    complete count for the holder only. A lease that runs out puts the job back, which a stream reports by a row of
    outcome ``expired`` or ``failed`` when the watermark passes it, and a batch finds at the job's next event.
    Events of one time count in the order of kind (enqueue, renew, complete, claim) and worker.
    """
    lease = minutes * 60_000_000
    order = F.expr("CASE kind WHEN 'enqueue' THEN 0 WHEN 'renew' THEN 1 WHEN 'complete' THEN 2 ELSE 3 END")
    known = events.where(F.col("job").isNotNull() & F.col("ts").isNotNull() & F.col("kind").isin("enqueue", "claim", "renew", "complete"))
    rows = known.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("at", F.unix_micros("ts")).select(F.col("job").cast("long").alias("job"), "ts", "at", "worker", "kind", order.alias("nth"))
    if not events.isStreaming:

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            last, held = None, [None, None, 0, 0]
            for part in batches:
                out = []
                for job, at, worker, kind in zip(part["job"], part["at"], part["worker"], part["kind"]):
                    if job != last:
                        last, held = job, [None, None, 0, 0]
                    held, outcome = _lease(kind, worker, int(at), held, lease, tries)
                    out.append(outcome)
                yield part[["job", "at", "worker"]].assign(outcome=out)

        return rows.drop("ts").repartition("job").sortWithinPartitions("job", "at", "nth", "worker").mapInPandas(run, LEASED)

    def step(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get) if state.exists else [None, None, 0, 0]
        out = []
        if state.hasTimedOut:
            out.append((group[0], held[2], held[1], "failed" if held[3] >= tries else "expired"))
            held = ["failed" if held[3] >= tries else "queued", None, 0, held[3]]
        else:
            rows = pd.concat(list(parts)).sort_values(["at", "nth", "worker"])
            for at, worker, kind in zip(rows["at"], rows["worker"], rows["kind"]):
                held, outcome = _lease(kind, worker, int(at), held, lease, tries)
                out.append((group[0], int(at), worker, outcome))
        state.update(tuple(held))
        if held[0] == "processing" and held[2] // 1000 > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(held[2] // 1000)
        yield pd.DataFrame(out, columns=["job", "at", "worker", "outcome"])

    timed = rows.withWatermark("ts", "1 minute")
    return timed.groupBy("job").applyInPandasWithState(step, LEASED, "status string, worker string, until long, claims int", "append", GroupStateTimeout.EventTimeTimeout)
