"""Streaming twins of the batch operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from rollframe.distributed import with_row
from rollframe.operators.trajectories import KEY, TRAJECTORY
from rollframe.sources.readers import parse_rollout_lines

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def rollout_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Arriving rollout files as parsed rows; the file time serves as event time."""
    reader = spark.readStream.option("recursiveFileLookup", True)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    lines = reader.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("arrived"))
    return parse_rollout_lines(lines)


def ingest(rows: DataFrame, good: str, bad: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Good rows to one table, bad lines to another. A batch writes its own folder, so a
    batch that is run again replaces what it wrote before."""
    def save(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        batch.filter("_bad IS NULL").drop("_bad").write.mode("overwrite").parquet(f"{good}/batch={batch_id}")
        batch.filter("_bad IS NOT NULL").select("path", "_bad").write.mode("overwrite").parquet(f"{bad}/batch={batch_id}")
        batch.unpersist()
    return rows.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def drop_copies(rows: DataFrame, time: str, delay: str, key: list[str] = KEY) -> DataFrame:
    """The first copy of each key; copies later than ``delay`` count as new rows."""
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark(key)


class TrajectoryAssembler(StatefulProcessor):
    """Emits a trajectory when its last turn is there and no turn is missing, and by a timer
    what has come of one that stays incomplete.

    A state key is a bucket of trajectories, so a call handles many of them at once. Counters per
    trajectory tell whether it is whole; turns wait in pieces: a batch adds its own, and reads
    the others back only when a trajectory of the bucket is to be given out. Rows that come too
    late, behind the watermark or after their trajectory is complete, are given out on the side
    as they are.
    """

    def __init__(self, patience_ms: int):
        self.patience_ms = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counters = handle.getValueState("counters", "known binary, timer long, pieces int")
        self.turns = handle.getMapState("turns", "piece int", "held binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        known, timer, pieces = self._known()
        new = pd.concat(list(rows), ignore_index=True).fillna({"score": 0.0, "event_ms": passed})
        for flag in ("last_turn", "traj_success"):
            new[flag] = new[flag].eq(True)
        done = new[TRAJECTORY].merge(known[[*TRAJECTORY, "done"]], "left", TRAJECTORY)["done"].eq(True)
        late = new["event_ms"] < passed
        aside = new[done | late]
        if len(aside):
            yield pd.DataFrame({"kind": late[aside.index].map({True: "late", False: "stray"}), "group_idx": aside["group_idx"], "traj_idx": aside["traj_idx"], "turns": 1,
                                "turn_list": [[t] for t in aside["turn_idx"]], "reward": aside["score"], "success": aside["traj_success"], "complete": False})
        fresh = new[~(done | late)]
        if not len(fresh):
            return
        own = fresh.assign(n=1, low=fresh["turn_idx"], high=fresh["turn_idx"], last=fresh["turn_idx"].where(fresh["last_turn"], -1),
                           terminals=fresh["last_turn"].astype("int64"), latest=fresh["event_ms"], done=False)
        known = pd.concat([known, own[known.columns]]).groupby(TRAJECTORY, dropna=False, sort=False, as_index=False).agg(
            {"n": "sum", "low": "min", "high": "max", "last": "max", "terminals": "sum", "latest": "max", "done": "any"})
        whole = ~known["done"] & (known["low"] == 1) & (known["high"] == known["n"]) & (known["last"] == known["high"]) & (known["terminals"] == 1)
        # A finished trajectory stays marked until the timer, so stray rows are known as such.
        known["done"] |= whole
        self.turns.updateValue((pieces,), (_packed(fresh[HELD]),))
        self._keep(known, timer, pieces + 1)
        if whole.any():
            yield self._taken(known[whole], "complete")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known, timer, pieces = self._known()
        due = known["latest"] + self.patience_ms <= timerValues.getCurrentWatermarkInMs()
        self._keep(known[~due], 0, pieces)
        late = known[due & ~known["done"]]
        if len(late):
            yield self._taken(late, "incomplete")

    def _known(self) -> tuple[pd.DataFrame, int, int]:
        if self.counters.exists():
            known, timer, pieces = self.counters.get()
            return _unpacked(known), timer, pieces
        return pd.DataFrame({c: pd.Series(dtype=t) for c, t in COUNTERS.items()}), 0, 0

    def _keep(self, known: pd.DataFrame, timer: int, pieces: int) -> None:
        """Counters of the bucket, and one timer for the trajectory that is due first."""
        if not len(known):
            self.counters.clear()
            return
        first = int(known["latest"].min()) + self.patience_ms
        if first != timer:
            if timer:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(first)
        self.counters.update((_packed(known), first, pieces))

    def _taken(self, chosen: pd.DataFrame, kind: str) -> pd.DataFrame:
        """The records of the chosen trajectories, whose turns leave the state."""
        held = pd.concat([_unpacked(piece) for (piece,) in self.turns.values()], ignore_index=True)
        mine = held[TRAJECTORY].merge(chosen[TRAJECTORY].assign(mine=True), "left", TRAJECTORY)["mine"].eq(True)
        rest = held[~mine]
        self.turns.clear()
        if len(rest):
            self.turns.updateValue((0,), (_packed(rest),))
        if self.counters.exists():
            known, timer, _ = self.counters.get()
            self.counters.update((bytes(known), timer, 1 if len(rest) else 0))
        by = held[mine].sort_values(["turn_idx", "score", "traj_success"]).groupby(TRAJECTORY, dropna=False, sort=False, as_index=False)
        out = by.agg(turns=("turn_idx", "size"), turn_list=("turn_idx", list), reward=("score", "sum"), success=("traj_success", "any"))
        return out.assign(kind=kind, complete=kind == "complete")[["kind", *TRAJECTORY, "turns", "turn_list", "reward", "success", "complete"]]

    def close(self) -> None:
        pass


HELD = [*TRAJECTORY, "turn_idx", "score", "traj_success"]
COUNTERS = {"group_idx": "object", "traj_idx": "int64", "n": "int64", "low": "int64", "high": "int64", "last": "int64", "terminals": "int64", "latest": "int64", "done": "bool"}


def _packed(rows: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.Table.from_pandas(rows, preserve_index=False)
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(bytes(data)).read_all().to_pandas()


ASSEMBLED = "kind string, group_idx string, traj_idx int, turns long, turn_list array<int>, reward double, success boolean, complete boolean"


def assemble(rows: DataFrame, time: str, delay: str = "10 minutes", patience_ms: int = 600_000, buckets: int = 1024) -> DataFrame:
    """Trajectory records by ``kind``: ``complete`` as soon as they are whole, ``incomplete`` with the
    turns they have after ``patience_ms``; and on the side every row that is ``late`` (behind the
    watermark) or ``stray`` (of a trajectory that is already complete).

    Expects deduplicated rows (see :func:`drop_copies`) and the RocksDB state store. The event
    time goes on as a number, so that no operator drops late rows before they are told.
    State is kept by ``buckets`` of trajectories; the number must stay for a checkpoint.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    timed = rows.select(*KEY, "last_turn", "traj_success", "score", F.col(time).cast("timestamp").alias("event_time")).withWatermark("event_time", delay)
    slim = timed.select(*KEY, "last_turn", "traj_success", "score", F.unix_millis("event_time").alias("event_ms"), F.pmod(F.xxhash64(*TRAJECTORY), F.lit(buckets)).alias("bucket"))
    return slim.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=TrajectoryAssembler(patience_ms), outputStructType=StructType.fromDDL(ASSEMBLED),
        outputMode="append", timeMode="EventTime")


def live_summary(episodes: DataFrame, tag: str) -> DataFrame:
    """Running totals per tag, for update mode; means follow from sums and counts."""
    return episodes.groupBy(tag).agg(
        F.count("*").alias("n_episodes"), F.avg(F.col("success").cast("double")).alias("success_rate"),
        F.avg("cumulative_reward").alias("avg_cumulative_reward"), F.avg("num_turns").alias("avg_turns"),
        F.count_if(~F.col("finish_reason").isin("done", "max_turns", "skipped_resume")).alias("error_rollouts"))


def device_windows(samples: DataFrame, time: str = "ts", delay: str = "10 minutes", width: str = "1 minute", slide: str | None = None) -> DataFrame:
    """Peak memory and means per device and time window, tumbling or sliding."""
    span = F.window(time, width, slide) if slide else F.window(time, width)
    return samples.withWatermark(time, delay).groupBy("run", "gpu_index", span).agg(
        F.max("memory_used_mib").alias("peak_memory_mib"), F.avg("utilization_percent").alias("mean_utilization"),
        F.avg("power_watts").alias("mean_power"), F.count("*").alias("samples"))


class EnergyPieces(StatefulProcessor):
    """Trapezoid between consecutive samples of a device, in the order of their time whatever
    the order of their arrival.

    Samples wait in a map by time slot until the watermark has passed the slot, so none can
    still come in between; then the slot's pairs are given out and the slot is evicted. What
    a device holds is what lies inside the watermark's delay. A device that is silent for
    ``patience_ms`` of event time is forgotten; its next sample starts anew.
    """

    def __init__(self, slot_ms: int, patience_ms: int):
        self.slot_ms, self.patience_ms = slot_ms, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "t double, p double, ms long")
        self.waiting = handle.getMapState("waiting", "slot long", "t array<double>, s array<long>, p array<double>, ms array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            for slot, own in pdf.groupby(pdf["event_ms"] // self.slot_ms):
                known = self.waiting.containsKey((int(slot),))
                held = [list(c) for c in self.waiting.getValue((int(slot),))] if known else [[], [], [], []]
                held[0] += own["elapsed_seconds"].astype(float).tolist()
                held[1] += own["sample"].astype(int).tolist()
                held[2] += [None if pd.isna(x) else float(x) for x in own["power_watts"]]
                held[3] += own["event_ms"].astype(int).tolist()
                self.waiting.updateValue((int(slot),), tuple(held))
                if not known:  # one timer per slot, when nothing of it can come any more
                    self.handle.registerTimer((int(slot) + 1) * self.slot_ms)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = expiredTimerInfo.getExpiryTimeInMs()
        last = self.last.get() if self.last.exists() else None
        slots = sorted(int(k[0]) for k in self.waiting.keys())
        due = [s for s in slots if (s + 1) * self.slot_ms <= passed]
        if not due and last is not None and last[2] + self.patience_ms <= passed:
            self.last.clear()
            return
        for slot in due:
            held = self.waiting.getValue((slot,))
            out = []
            for t, _, p, ms in sorted(zip(*held), key=lambda r: (r[0], r[1])):
                if last is not None and ms - last[2] <= self.patience_ms and p is not None and last[1] is not None:
                    out.append((key[0], int(key[1]), pd.Timestamp(ms, unit="ms"), (p + last[1]) / 2 * (t - last[0]) / 3600 / 1000))
                last = (t, p, ms)
            self.waiting.removeKey((slot,))
            if out:
                yield pd.DataFrame(out, columns=["run", "gpu_index", "ts", "kwh"])
        if due:
            self.last.update(last)
            self.handle.registerTimer(last[2] + self.patience_ms)

    def close(self) -> None:
        pass


def energy_pieces(samples: DataFrame, time: str = "ts", delay: str = "10 minutes", patience_ms: int = 86_400_000, slot_ms: int = 600_000) -> DataFrame:
    """Energy between consecutive samples, stamped with the later one; sum it per window or run.

    Samples may arrive in any order within ``delay``; pieces are given out once the watermark has
    passed their time slot. Later samples are dropped.
    """
    samples.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    slim = samples.select("run", "gpu_index", "sample", "elapsed_seconds", "power_watts", F.col(time).cast("timestamp").alias("ts"))
    timed = slim.withWatermark("ts", delay).withColumn("event_ms", F.unix_millis("ts"))
    return timed.groupBy("run", "gpu_index").transformWithStateInPandas(
        statefulProcessor=EnergyPieces(slot_ms, patience_ms), outputStructType=StructType.fromDDL("run string, gpu_index int, ts timestamp, kwh double"),
        outputMode="append", timeMode="EventTime")


def device_sessions(samples: DataFrame, time: str = "ts", delay: str = "10 minutes", gap: str = "30 minutes") -> DataFrame:
    """Sessions of a device split at idle gaps, with their active time."""
    return samples.withWatermark(time, delay).groupBy("run", "gpu_index", F.session_window(time, gap)).agg(
        F.count("*").alias("samples"), (F.max("elapsed_seconds") - F.min("elapsed_seconds")).alias("active_seconds"))


def run_once(stream: DataFrame, out: str, checkpoint: str, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """Drain a stream into ``out`` and return the table: all rows in append mode, the last
    batch in complete mode, the newest row of each of ``keys`` in update mode."""
    spark = stream.sparkSession
    save: Callable[[DataFrame, int], None] = lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}")
    stream.writeStream.foreachBatch(save).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(StructType([*stream.schema.fields, *StructType.fromDDL("batch long").fields])).parquet(out)
    if mode == "append":
        return rows.drop("batch")
    if mode == "complete":
        top = rows.agg(F.max("batch").alias("_top"))
        return with_row(rows, top).filter("batch = _top").drop("batch", "_top")
    rest = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, "_r.*")
