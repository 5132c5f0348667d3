"""Structured Streaming jobs; every one writes to the shared folder and can be restarted from its checkpoint."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from clauselake.functions import calc, params
from clauselake.functions import lexicons as lx
from clauselake.operators.engage import MARK_MICROS
from clauselake.runtime import broadcast_if_small, path_exists, scratch_path, ship_by_value
from clauselake.sources import records

ship_by_value(__name__)

STATE_SCHEMA = (
    "last_sec long, epoch long, principal double, rate double, days int, calc_type string, clause_ids array<string>"
)
OUTPUT_SCHEMA = (
    "session_id string, question_id long, epoch long, principal double, rate double, days int, calc_type string, "
    "previous_ids string"
)


#: how far event time trails the newest row of a live stream
DELAY = "1 hour"
#: rows of a key's output that leave together, and reads of a facet that share a block
ROWS_PER_PIECE, READS_PER_BLOCK = 10_000, 4096
#: micro-batches after which the memories of all keys are written, not only of those seen
WHOLE_EVERY = 16
#: a line of the chat log
CHAT_LOG_LINE = r"^([0-9]+)\t([0-9]+)\t([0-9]+)\t(.*)$"
#: seconds after which a message without a line has ended, and a time beyond all of a stream
CHAT_PAUSE_SEC, NEVER_SEC = 3600, 253_402_300_799


def drain(
    stream: DataFrame | Steps, name: str, path: str | None = None, checkpoint: str | None = None, timeout_sec: float | None = None
) -> DataFrame:
    """Run everything available through an append sink and return the written table.

    A job that goes on later names its own ``path`` and ``checkpoint``; without
    them a run starts afresh.  It waits as long as the input takes, unless the
    caller sets ``timeout_sec``.
    """
    if isinstance(stream, Steps):
        return stream.drain(name, path, checkpoint, timeout_sec)
    path = path or scratch_path(stream.sparkSession, name)
    query = (
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint or f"{path}-state")
        .outputMode("append").trigger(availableNow=True).start()
    )
    _finish(query, timeout_sec)
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def _finish(query, timeout_sec: float | None = None) -> None:
    if timeout_sec is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout_sec):
        query.stop()
        raise TimeoutError("stream did not finish")


def count_views(events: DataFrame, path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Running views per post.

    Each micro-batch appends the counts it changed, tagged with its number; the
    newest tag per post is the current count.  A batch that is replayed after a
    failure overwrites its own folder.
    """
    spark = events.sparkSession
    path = path or scratch_path(spark, "views")
    counts = events.filter("action = 'view'").groupBy("post_id").agg(F.count(F.lit(1)).alias("views"))

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = (
        counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint or f"{path}-state")
        .trigger(availableNow=True).foreachBatch(save).start()
    )
    _finish(query)
    written = spark.read.schema("post_id long, views long, batch long").parquet(path)
    return written.groupBy("post_id").agg(F.max_by("views", "batch").alias("views"))


def append_rounds(rounds: DataFrame, path: str, checkpoint: str | None = None) -> None:
    """Append question and answer rounds to ``path``; one folder per micro-batch makes replays idempotent.

    The checkpoint stands beside the output, so a later run goes on with the
    next batch number and what is new, and a restart repeats only its own batch.
    """

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = (
        rounds.writeStream.option("checkpointLocation", checkpoint or f"{path.rstrip('/')}-state")
        .trigger(availableNow=True).foreachBatch(save).start()
    )
    _finish(query)


def _keyed(
    stream: DataFrame, keys: list[str], processor: _OneState, schema: str, live: bool, at: Column, delay: str
) -> DataFrame | Steps:
    """Rows of each key through ``processor``.

    Rows of a key are ordered inside a micro-batch; across batches they must arrive in order.  ``live`` is for streams
    that run on: state expires by the event time ``at`` of the whole stream, which trails its newest row by ``delay``;
    a timer then frees it, whether or not its key is seen again.  A run that ends with its input has no use for timers:
    it goes in steps, without a call of Spark for each key.
    """
    if not live:
        return Steps(stream, keys, processor, schema)
    stream.sparkSession.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    processor.live, processor.out = live, {f.name: f.dataType.simpleString() for f in T.StructType.fromDDL(schema)}
    stream = stream.withColumn("event_time", at).withWatermark("event_time", delay)
    return stream.groupBy(*keys).transformWithStateInPandas(processor, outputStructType=schema, outputMode="Append", timeMode="EventTime")


@dataclass(frozen=True)
class Steps:
    """A keyed job that ends with its input; ``drain`` runs it.

    Each micro-batch is one pass over rows sorted by key, the key's memory before its rows.  It writes to a folder of its
    own (``batch=N``) the output and the memories of the keys it saw; the next one reads the memories that were written
    since the last whole set.  A batch that is replayed after a failure overwrites its own folder.
    """

    stream: DataFrame
    keys: list[str]
    processor: _OneState
    schema: str

    def drain(self, name: str, path: str | None, checkpoint: str | None, timeout_sec: float | None) -> DataFrame:
        spark = self.stream.sparkSession
        path = path or scratch_path(spark, name)
        query = (
            self.stream.writeStream.option("checkpointLocation", checkpoint or f"{path}-state").trigger(availableNow=True)
            .foreachBatch(lambda batch, number: self._step(batch, number, path)).start()
        )
        _finish(query, timeout_sec)
        if not path_exists(spark, path):
            return spark.createDataFrame([], self.schema)
        return self._written(spark, path).filter("NOT kept").select("out.*")

    def _row(self) -> T.StructType:
        keys = T.StructType([self.stream.schema[k] for k in self.keys])
        parts = {"key": keys, "memory": T.StructType.fromDDL(self.processor.step_schema()), "out": T.StructType.fromDDL(self.schema)}
        return T.StructType([T.StructField("kept", T.BooleanType()), *[T.StructField(n, t) for n, t in parts.items()]])

    def _written(self, spark: SparkSession, path: str) -> DataFrame:
        return spark.read.schema(self._row().add("batch", T.LongType())).parquet(path)

    def _step(self, batch: DataFrame, number: int, path: str) -> None:
        spark, kind, columns = batch.sparkSession, self._row(), self.processor.columns
        rows = batch.select(*self.keys, F.lit(number).cast("long").alias("batch"), F.lit(None).cast(kind["memory"].dataType).alias("memory"), *[F.col(c).alias(f"_{c}") for c in columns])
        if number:
            whole = (number - 1) // WHOLE_EVERY * WHOLE_EVERY
            old = self._written(spark, path).filter(F.col("kept") & (F.col("batch") >= whole) & (F.col("batch") < number))
            rows = rows.unionByName(old.select(*[F.col(f"key.{k}") for k in self.keys], "batch", "memory"), allowMissingColumns=True)
        # a fixed number: the rows are few bytes and much work, so they are not to be coalesced
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        order = [*self.keys, "batch", *[F.asc_nulls_last(f"_{c}") for c in self.processor.order]]
        done = rows.repartition(tasks, *self.keys).sortWithinPartitions(*order).mapInArrow(self._pass(number), kind)
        done.write.mode("overwrite").partitionBy("kept").parquet(f"{path}/batch={number}")

    def _pass(self, number: int):
        keys, processor, columns, every = self.keys, self.processor, self.processor.columns, number % WHOLE_EVERY == 0
        schema = to_arrow_schema(self._row())

        def go(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, memory, held, made = None, None, [], _Made(schema)

            def close() -> None:
                if held:
                    out, after = processor.step(key, {c: np.concatenate([h[c] for h in held]) if len(held) > 1 else held[0][c] for c in columns}, memory)
                    made.out.extend(out)
                    if all(k == k for k in key):
                        made.kept.append((key, after))
                elif every and memory is not None:
                    made.kept.append((key, memory))

            for batch in batches:
                # as in Spark's keyed state for Python, rows whose key lacks a number have nothing in common: NaN is no other NaN
                ids = list(zip(*[[float("nan") if v is None and pa.types.is_integer(batch.column(k).type) else v for v in batch.column(k).to_pylist()] for k in keys], strict=True))
                times, memories = batch.column("batch").to_pylist(), batch.column("memory")
                known = {c: _plain(batch.column(f"_{c}")) for c in columns}
                at = 0
                while at < len(ids):
                    if ids[at] != key:
                        close()
                        key, memory, held = ids[at], None, []
                        if made.rows() >= ROWS_PER_PIECE:
                            yield from made.batches()
                    if times[at] < number:
                        row = memories[at].as_py()
                        memory, at = None if row is None else tuple(row.values()), at + 1
                        continue
                    end = at + 1
                    while end < len(ids) and ids[end] == key:
                        end += 1
                    held.append({c: v[at:end] for c, v in known.items()})
                    at = end
            close()
            yield from made.batches()

        return go


def _plain(column: pa.Array) -> np.ndarray:
    """Values of a column; a missing number is NaN, and the others keep their kind beside it."""
    if column.null_count and not pa.types.is_floating(column.type):
        none = float("nan") if pa.types.is_integer(column.type) else None
        values = np.empty(len(column), object)
        values[:] = [none if v is None else v for v in column.to_pylist()]
        return values
    return column.to_pandas().to_numpy()


class _Made:
    """Output and memories that leave a task together."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.out, self.kept = schema, [], []

    def rows(self) -> int:
        return len(self.out) + len(self.kept)

    def batches(self) -> Iterator[pa.RecordBatch]:
        key, memory, out = (self.schema.field(n).type for n in ("key", "memory", "out"))
        if self.out:
            yield self._batch(False, len(self.out), out=_structs(self.out, out))
        if self.kept:
            yield self._batch(True, len(self.kept), key=_structs([k for k, _ in self.kept], key), memory=_structs([m for _, m in self.kept], memory))
        self.out, self.kept = [], []

    def _batch(self, kept: bool, n: int, **known: pa.Array) -> pa.RecordBatch:
        parts = [pa.array([kept] * n), *[known.get(f.name, pa.nulls(n, f.type)) for f in list(self.schema)[1:]]]
        return pa.RecordBatch.from_arrays(parts, schema=self.schema)


def _structs(rows: list[tuple | None], kind: pa.StructType) -> pa.Array:
    fields = [kind.field(i) for i in range(kind.num_fields)]
    gone = [r is None for r in rows]
    none = (None,) * len(fields)
    values = [none if r is None else r for r in rows]
    arrays = [pa.array([v[i] for v in values], f.type, from_pandas=True) for i, f in enumerate(fields)]
    return pa.StructArray.from_arrays(arrays, fields=fields, mask=pa.array(gone))


class _OneState(StatefulProcessor):
    """A processor with one remembered row.

    ``follow`` maps a key's ordered rows (arrays of ``columns``) and the state to output rows and new state; ``step`` does
    so where the whole state lies in one row, of ``step_schema``.  Of a key's share
    of a micro-batch only these columns are held, and output leaves in pieces.  ``expires_ms`` is when a state ends,
    ``leave`` what is put out then.
    """

    schema: str
    columns: list[str]
    order: list[str]
    live = False
    out: dict[str, str]

    def step_schema(self) -> str:
        return self.schema

    def step(self, key, rows, before) -> tuple[list[tuple], tuple | None]:
        return self.follow(key, rows, before)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pieces = [[piece[c].to_numpy() for c in self.columns] for piece in rows]
        held = {c: np.concatenate([p[i] for p in pieces]) for i, c in enumerate(self.columns)}
        del pieces
        order = np.lexsort([held[c] for c in reversed(self.order)])
        before = tuple(self.state.get()) if self.state.exists() else None
        out, after = self.follow(key, {c: v[order] for c, v in held.items()}, before)
        self._remember(after)
        for i in range(0, len(out), ROWS_PER_PIECE):
            yield self._frame(out[i : i + ROWS_PER_PIECE])

    def _frame(self, out: list[tuple]) -> pd.DataFrame:
        """Output rows for Spark, in columns that have room for nulls."""
        room = {"bigint": "Int64", "int": "Int32", "double": "Float64"}
        frame = pd.DataFrame(out, columns=list(self.out))
        return frame.astype({n: room[t] for n, t in self.out.items() if t in room})

    def _remember(self, after: tuple | None) -> None:
        if after is None:
            self.state.clear()
        else:
            self.state.update(after)
        if self.live:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if after is not None:
                self.handle.registerTimer(self.expires_ms(after))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            before = tuple(self.state.get())
            if self.expires_ms(before) <= expiredTimerInfo.getExpiryTimeInMs():
                out = self.leave(key, before)
                self.state.clear()
                if out:
                    yield self._frame(out)

    def expires_ms(self, after: tuple) -> int:
        raise NotImplementedError

    def leave(self, key, before: tuple) -> list[tuple]:
        return []

    def close(self) -> None:
        pass


class _Sightings(_OneState):
    schema, columns, order = "seen long", ["ts_us"], ["ts_us"]

    def __init__(self, ttl_us: int):
        self.ttl_us = ttl_us

    def follow(self, key, rows, before):
        seen, first = (before[0] if before else None), []
        for ts in rows["ts_us"].tolist():
            if seen is None or ts - seen >= self.ttl_us:
                seen = ts
                first.append(ts)
        return [(key[0], ts) for ts in first], (seen,)

    def expires_ms(self, after):
        return -(-(after[0] + self.ttl_us) // 1000)


def first_sightings(texts: DataFrame, ttl_days: float = lx.VERDICT_TTL_DAYS, live: bool = False, delay: str = DELAY) -> DataFrame | Steps:
    """First sighting of each text within the lifetime of its verdict: ``text_hash, ts_us`` of the sightings that need one."""
    columns = texts.select("text_hash", "ts_us")
    processor = _Sightings(int(ttl_days * 86400e6))
    return _keyed(columns, ["text_hash"], processor, "text_hash string, ts_us long", live, F.timestamp_micros("ts_us"), delay)


class _Marks(_OneState):
    schema, columns, order = "marked long", ["event_id", "action", "at"], ["at", "event_id"]

    def __init__(self, mark: str, ttl_us: int):
        self.mark, self.ttl_us = mark, ttl_us

    def follow(self, key, rows, before):
        marked, accepted = (before[0] if before else None), []
        for action, at in zip(rows["action"].tolist(), rows["at"].tolist(), strict=True):
            alive = marked is not None and at - marked < self.ttl_us
            accepted.append(alive != (action == self.mark))
            if action != self.mark:
                marked = None
            elif not alive:
                marked = at
        user, post = key
        out = [(event, user, post, action, a) for event, action, a in zip(rows["event_id"].tolist(), rows["action"].tolist(), accepted, strict=True)]
        return out, None if marked is None else (marked,)

    def expires_ms(self, after):
        return -(-(after[0] + self.ttl_us) // 1000)


def guarded_marks(
    events: DataFrame, mark: str, unmark: str, ttl_us: int = MARK_MICROS, live: bool = False, delay: str = DELAY
) -> DataFrame | Steps:
    """The stream of ``engage.guarded_marks``: a mark counts while none is alive, an un-mark while one is."""
    rows = events.filter(F.col("action").isin(mark, unmark)).select("event_id", "user_id", "post_id", "action", "at")
    out = "event_id long, user_id long, post_id long, action string, accepted boolean"
    return _keyed(rows, ["user_id", "post_id"], _Marks(mark, ttl_us), out, live, F.timestamp_micros("at"), delay)


class _Rounds(_OneState):
    schema, columns, order = "rounds long, last long", ["question_id", "turn", "ts_sec"], ["turn"]

    def __init__(self, n: int, ttl_sec: int):
        self.n, self.ttl_sec = n, ttl_sec

    def follow(self, key, rows, before):
        count, last = before or (0, None)
        numbers = []
        for at in rows["ts_sec"].tolist():
            count = 1 if last is not None and at - last >= self.ttl_sec else count + 1
            last = at
            numbers.append(count)
        out = [(question, key[0], number) for question, number in zip(rows["question_id"].tolist(), numbers, strict=True) if number % self.n == 0]
        return out, (count, last)

    def expires_ms(self, after):
        return (after[1] + self.ttl_sec) * 1000


def every_nth_round(
    rounds: DataFrame, n: int = lx.EXTRACT_EVERY, ttl_days: int = lx.PROFILE_TTL_DAYS, live: bool = False, delay: str = DELAY
) -> DataFrame | Steps:
    """Rounds at which the profile is extracted; a pause beyond the counter's lifetime starts its count again."""
    columns = rounds.select("question_id", "session_id", "turn", "ts_sec")
    out = "question_id long, session_id string, round_no long"
    return _keyed(columns, ["session_id"], _Rounds(n, ttl_days * 86400), out, live, F.timestamp_seconds("ts_sec"), delay)


def memory_metrics(reads: DataFrame, path: str | None = None, checkpoint: str | None = None, block: int = READS_PER_BLOCK) -> DataFrame:
    """Current hits and misses per facet since its last reset: ``facet, epoch, hits, misses``.

    ``reads``: ``facet, seq`` and ``kind``, which is hit, miss or reset.  There are few facets and many reads, so a facet
    is cut into blocks of its sequence: each micro-batch appends one row a block (resets, and what was counted after the
    last of them), which aggregates find without gathering a facet.  The counters are the sums of the block rows from the
    newest one with a reset on.  A batch that is replayed after a failure overwrites its own folder.
    """
    spark = reads.sparkSession
    path = path or scratch_path(spark, "metrics")
    rows = reads.select("facet", F.floor(F.col("seq") / block).alias("block"), "seq", "kind")

    def save(batch: DataFrame, number: int) -> None:
        resets = batch.filter("kind = 'reset'").groupBy("facet", "block").agg(F.max("seq").alias("last"), F.count(F.lit(1)).alias("resets"))
        counted = batch.join(broadcast_if_small(resets), ["facet", "block"], "left")
        after = F.col("last").isNull() | (F.col("seq") > F.col("last"))
        counted = counted.groupBy("facet", "block").agg(
            F.coalesce(F.max("resets"), F.lit(0)).alias("resets"),
            F.count_if(after & (F.col("kind") == "hit")).alias("hits"),
            F.count_if(after & ~F.col("kind").isin("hit", "reset")).alias("misses"),
        )
        counted.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = (
        rows.writeStream.option("checkpointLocation", checkpoint or f"{path.rstrip('/')}-state")
        .trigger(availableNow=True).foreachBatch(save).start()
    )
    _finish(query)
    blocks = spark.read.schema("facet string, block long, resets long, hits long, misses long, batch long").parquet(path)
    place = F.struct("block", "batch")
    newest = blocks.groupBy("facet").agg(F.max(F.when(F.col("resets") > 0, place)).alias("from"), F.sum("resets").alias("epoch"))
    counts = blocks.join(F.broadcast(newest), "facet").filter(F.col("from").isNull() | (place >= F.col("from")))
    return counts.groupBy("facet", "epoch").agg(F.sum("hits").alias("hits"), F.sum("misses").alias("misses"))


def windowed_views(
    views: DataFrame, window_sec: int = 3600, delay_sec: int = 7200, path: str | None = None, late_path: str | None = None
) -> DataFrame:
    """Views per post and tumbling window of event time: ``post_id, window_start, views, late, closed``.

    ``views``: ``post_id, at`` (a timestamp).  A window is counted while the stream's event time, which trails its newest
    row by ``delay_sec``, has not passed the window's end; then it is put out once, closed, and its state is freed.  Rows
    that come later are not in ``views``; a second pass of the same source tallies all rows, and what it has beyond the
    closed count is ``late``.  Windows still open have the views so far.
    """
    spark = views.sparkSession
    path, late_path = path or scratch_path(spark, "view-windows"), late_path or scratch_path(spark, "view-tally")
    rows = views.select("post_id", "at").filter("at IS NOT NULL")
    window = F.window("at", f"{window_sec} seconds").getField("start").alias("window_start")
    counts = (
        rows.withWatermark("at", f"{delay_sec} seconds").groupBy(F.window("at", f"{window_sec} seconds").alias("w"), "post_id")
        .agg(F.count(F.lit(1)).alias("views")).select("post_id", F.col("w.start").alias("window_start"), "views")
    )
    closed = drain(counts, "view-windows", path)

    def tally(batch: DataFrame, number: int) -> None:
        seen = batch.groupBy("post_id", window).agg(F.count(F.lit(1)).alias("seen"), F.max("at").alias("newest"))
        seen.write.mode("overwrite").parquet(f"{late_path}/batch={number}")

    query = (
        rows.writeStream.option("checkpointLocation", f"{late_path.rstrip('/')}-state")
        .trigger(availableNow=True).foreachBatch(tally).start()
    )
    _finish(query)
    tallied = spark.read.schema("post_id long, window_start timestamp, seen long, newest timestamp, batch long").parquet(late_path)
    passed = tallied.agg((F.max("newest") - F.make_dt_interval(secs=F.lit(delay_sec))).alias("passed"))  # one row
    every = tallied.groupBy("post_id", "window_start").agg(F.sum("seen").alias("seen")).crossJoin(F.broadcast(passed))
    every = every.join(closed, ["post_id", "window_start"], "left")
    done = F.col("window_start") + F.make_dt_interval(secs=F.lit(window_sec)) <= F.date_trunc("second", "passed")
    counted = F.coalesce("views", F.when(done, F.lit(0)).otherwise(F.col("seen")))
    return every.select("post_id", "window_start", counted.alias("views"), (F.col("seen") - counted).alias("late"), done.alias("closed"))


class SessionMemory(_OneState):
    """Carried parameters, calculation type and rolled citations of one session."""

    schema = STATE_SCHEMA
    columns = [
        "question_id", "turn", "ts_sec", "clause_ids", "model_principal", "model_rate", "model_days",
        "rule_principal", "rule_rate", "rule_days", "explicit_type",
    ]
    order = ["turn"]

    def __init__(self, ttl_seconds: int = lx.SESSION_TTL_DAYS * 86400):
        self.ttl_seconds = ttl_seconds

    def follow(self, key, rows, before):
        last, epoch, *kept = before or (None, 0, None, None, None, None, None)
        out = []

        def settle(*values):
            return next((v for v in values if v is not None and not pd.isna(v)), None)

        for i, at in enumerate(rows["ts_sec"].tolist()):
            if last is not None and at - last >= self.ttl_seconds:
                if self.live:
                    out.append(self._row(key, None, epoch, kept))
                epoch, kept = epoch + 1, [None] * 5
            carried, clause_ids = dict(zip(("principal", "rate", "days"), kept[:3], strict=True)), kept[4]
            principal, rate, days = (settle(rows[f"rule_{f}"][i], carried[f], rows[f"model_{f}"][i]) for f in carried)
            calc_type = settle(rows["explicit_type"][i], kept[3]) or "PENALTY"
            kept = [principal, rate, None if days is None else int(days), calc_type, clause_ids]
            out.append(self._row(key, int(rows["question_id"][i]), epoch, kept))
            kept = [*kept[:4], list(rows["clause_ids"][i])]
            last = at
        return out, (last, epoch, *kept)

    @staticmethod
    def _row(key, question_id: int | None, epoch: int, kept: list) -> tuple:
        return (key[0], question_id, epoch, *kept[:4], None if kept[4] is None else "、".join(kept[4]))

    def expires_ms(self, after):
        return (after[0] + self.ttl_seconds) * 1000

    def leave(self, key, before):
        return [self._row(key, None, before[1], list(before[2:]))]


def session_memory(turns: DataFrame, live: bool = False, delay: str = DELAY) -> DataFrame | Steps:
    """Session state as a stream; gives per turn what the batch windows give.

    Values are extracted by Spark expressions first, so the Python processor
    only merges a few scalars.  ``turns``: ``session_id, question_id, turn,
    ts_sec, text, clause_ids, model_principal, model_rate, model_days``.  A
    ``live`` stream also puts out each memory when it ends, as a row without a
    question, and frees its state.
    """
    t = F.col("text")
    ruled = turns.select(
        "session_id", "question_id", "turn", "ts_sec", "clause_ids", "model_principal", "model_rate", "model_days",
        params.principal(t).alias("rule_principal"), params.daily_rate(t).alias("rule_rate"),
        params.overdue_days(t).alias("rule_days"), calc.explicit_calc_type(t).alias("explicit_type"),
    )
    return _keyed(ruled, ["session_id"], SessionMemory(), OUTPUT_SCHEMA, live, F.timestamp_seconds("ts_sec"), delay)


# ---- chat log ----------------------------------------------------------------
def read_chat_log(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """Lines of a growing chat log as a stream: ``message_id, seq, at_sec, line`` and ``raw``.

    A line is message number, sequence number, time in seconds and what the model sent, parted by tabs; of another line
    all but ``raw`` is null.
    """
    raw = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path).withColumnRenamed("value", "raw")
    part = lambda i: F.regexp_extract("raw", CHAT_LOG_LINE, i)
    number = lambda i: F.expr(f"try_cast(nullif(regexp_extract(raw, '{CHAT_LOG_LINE}', {i}), '') AS BIGINT)")
    known = number(1).isNotNull() & number(2).isNotNull() & number(3).isNotNull()
    return raw.select(
        *[F.when(known, number(i)).alias(n) for i, n in ((1, "message_id"), (2, "seq"), (3, "at_sec"))],
        F.when(known, part(4)).alias("line"), "raw",
    )


def malformed_lines(log: DataFrame) -> DataFrame:
    """Lines without the log's form, and data lines that are neither JSON nor the end mark: ``raw, reason``."""
    bad_form = F.col("line").isNull()
    bad_json = records.is_data_line(F.col("line")) & (records.data_of(F.col("line")) != records.END_MARK) & records.parsed_chunk(F.col("line")).isNull()
    reason = F.when(bad_form, "form").when(bad_json, "json")
    return log.select("raw", reason.alias("reason")).filter("reason IS NOT NULL")


class _Held:
    """Chunks of one message, as the list state of a live stream has them."""

    def __init__(self, chunks: list[tuple]):
        self.chunks = chunks

    def exists(self) -> bool:
        return bool(self.chunks)

    def get(self) -> list[tuple]:
        return self.chunks

    def clear(self) -> None:
        self.chunks = []

    def appendList(self, fresh: list[tuple]) -> None:
        self.chunks = [*self.chunks, *fresh]


class _Messages(_OneState):
    """Collects the chunks of a message in a list until its end mark; a message that pauses too long ends incomplete."""

    schema = "part long, last long"
    columns, order = ["seq", "at_sec", "kind", "text"], ["seq"]

    def __init__(self, pause_sec: int):
        self.pause_sec = pause_sec

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.held = handle.getListState("chunks", "kind string, text string")

    def step_schema(self) -> str:
        return f"{self.schema}, chunks array<struct<kind: string, text: string>>"

    def step(self, key, rows, before):
        self.held = _Held([tuple(c.values()) for c in before[2]] if before else [])
        out, after = self.follow(key, rows, before and before[:2])
        return out, (*after, [{"kind": k, "text": t} for k, t in self.held.get()])

    def follow(self, key, rows, before):
        part, last = before or (0, None)
        out, fresh = [], []
        for kind, text, at in zip(rows["kind"].tolist(), rows["text"].tolist(), rows["at_sec"].tolist(), strict=True):
            if last is not None and at - last >= self.pause_sec:
                out += self._end(key, part, fresh, False)
                part, fresh = part + 1, []
            last = at
            if kind == "end":
                out += self._end(key, part, fresh, True)
                part, fresh, last = part + 1, [], None
            else:
                fresh.append((kind, text))
        if fresh:
            self.held.appendList(fresh)
        return out, (part, last)

    def _end(self, key, part: int, fresh: list[tuple], complete: bool) -> list[tuple]:
        chunks = [*map(tuple, self.held.get()), *fresh] if self.held.exists() else fresh
        self.held.clear()
        said = [t for k, t in chunks if k == "chunk"]
        return [(key[0], part, len(said), sum(k == "suggestion" for k, _ in chunks), "".join(said), complete)] if chunks or complete else []

    def expires_ms(self, after):
        return (NEVER_SEC if after[1] is None else after[1] + self.pause_sec) * 1000

    def leave(self, key, before):
        # the number of the part is lost with the state; a message that goes on after its pause starts again from 0
        return self._end(key, before[0], [], False)


def chat_messages(log: DataFrame, pause_sec: int = CHAT_PAUSE_SEC, live: bool = False, delay: str = DELAY) -> DataFrame | Steps:
    """Whole answers of a chat log: ``message_id, part, chunks, suggestions, text, complete``.

    Chunks of a message that come in several files wait in its list state.  The end mark closes a message; what follows
    it is the next part.  A pause of ``pause_sec`` between two lines of a message ends it incomplete; a ``live`` stream
    sees to that by a timer, also when no further line of it comes.
    """
    line = F.col("line")
    typed = log.filter(line.isNotNull()).select(
        "message_id", "seq", "at_sec",
        F.when(records.is_data_line(line) & (records.data_of(line) == records.END_MARK), "end").otherwise(records.chunk_kind(line)).alias("kind"),
        F.coalesce(records.parsed_chunk(line).getField("content"), F.lit("")).alias("text"),
    ).filter("kind = 'end' OR (kind IS NOT NULL AND text <> '')")
    out = "message_id long, part long, chunks long, suggestions long, text string, complete boolean"
    return _keyed(typed, ["message_id"], _Messages(pause_sec), out, live, F.timestamp_seconds("at_sec"), delay)
