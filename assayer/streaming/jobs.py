"""Streaming forms of the screening and session jobs.

Sinks are files in the shared folder; checkpoints live beside them, so a restarted query continues
where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer import constants as K
from assayer.operators import formulation
from assayer.session import scratch, tidy


def stream_screening(
    ingredients: DataFrame, views: dict[str, DataFrame], catalogue: DataFrame | None, path: str, checkpoint: str
):
    """Screen submissions as they arrive; the snapshot's views are the static side.

    Every micro-batch is a batch screening of its rows. Its result goes to a folder named by the
    batch id, so a repeated batch replaces itself; the stages on the way are removed with the batch.
    """

    def screen_batch(batch: DataFrame, batch_id: int) -> None:
        with scratch(batch.sparkSession), tidy(batch.sparkSession):
            evaluated = formulation.evaluated_requests(batch, views, catalogue)
            screened = formulation.screen.screen_ingredients(batch, evaluated)
            screened.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}", compression="zstd")

    return ingredients.writeStream.foreachBatch(screen_batch).option("checkpointLocation", checkpoint)


def stream_sessions(events: DataFrame, gap_seconds: int = K.SESSION_GAP_SECONDS, delay: str = "10 minutes") -> DataFrame:
    """Sessions per key over event time; later rows than the watermark are dropped.

    A session window ends exactly at its gap, while a session lives until it was idle for longer, so
    the window's gap is one microsecond more.
    """
    return (
        events.withWatermark("ts", delay)
        .groupBy("session_key", F.session_window("ts", f"{gap_seconds} seconds 1 microseconds"))
        .agg(F.count("*").alias("events"), F.min("ts").alias("started_at"), F.max("ts").alias("touched_at"))
        .select("session_key", "started_at", "touched_at", "events")
    )


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
REVISION_OUTPUT = "session_key bigint, update_id bigint, revision bigint, accepted boolean"


#: Keys share their state in so many pieces: a piece's rows cross between Spark and Python together, not one by one.
PIECES = 1024


def _in_event_order(key_type: str, row_columns: tuple[str, str], state_columns: tuple[str, ...], start, step, lifetime: int):
    """A stateful processor that walks over each key's rows in the order of event time.

    Keys are dealt over pieces. The rows of a piece wait in list state, one Arrow batch per delivery, until the watermark
    has passed them, so what a row meets does not depend on how the stream was cut into batches. ``step(state, at, value)``
    gives a key's new state and the row's verdict; rows of one key, time and id are one row, the last one given. A key's state ends
    with the time of its row that counts, and goes away once event time has passed that by ``lifetime`` microseconds. A call
    for a piece reads and writes its state once, however many keys and rows it has. All names are local: executors need
    no copy of the package.
    """
    from pyspark.sql.streaming import StatefulProcessor

    ident, number = row_columns

    class InEventOrder(StatefulProcessor):
        def init(self, handle):
            import pyarrow as pa

            kind = pa.string() if key_type == "string" else pa.int64()
            self.row = pa.schema([("key", kind), ("at", pa.int64()), (ident, pa.int64()), (number, pa.int64())])
            self.kept = pa.schema([("key", kind), *((c, pa.int64()) for c in state_columns)])
            self.handle = handle
            self.waiting = handle.getListState("waiting", "rows binary")
            self.state = handle.getValueState("state", "keys binary")

        def packed(self, batch):
            import pyarrow as pa

            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as writer:
                writer.write_table(batch)
            return (sink.getvalue().to_pybytes(),)

        def unpacked(self, value):
            import pyarrow as pa

            return pa.ipc.open_stream(value[0]).read_all()

        def handleInputRows(self, key, rows, timerValues):
            import pyarrow as pa
            import pyarrow.compute as pc

            first = None
            for part in rows:
                batch = pa.Table.from_arrays([pa.Array.from_pandas(part[f.name], type=f.type) for f in self.row], schema=self.row)
                if batch.column("at").null_count:
                    raise ValueError("a row has no event time")
                if batch.num_rows:
                    self.waiting.appendValue(self.packed(batch))
                    least = pc.min(batch.column("at")).as_py()
                    first = least if first is None else min(first, least)
            if first is not None:
                self.handle.registerTimer(max(-(-first // 1000), timerValues.getCurrentWatermarkInMs() + 1))
            return iter(())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            import pandas as pd
            import pyarrow as pa
            import pyarrow.compute as pc

            passed = timerValues.getCurrentWatermarkInMs() * 1000
            held = [self.unpacked(v) for v in self.waiting.get()] if self.waiting.exists() else []
            rows = pa.concat_tables(held) if held else self.row.empty_table()
            due = rows.filter(pc.less_equal(rows.column("at"), passed))
            if due.num_rows:
                rest = rows.filter(pc.greater(rows.column("at"), passed))
                if rest.num_rows:
                    self.waiting.put([self.packed(rest)])
                    self.handle.registerTimer(-(-pc.min(rest.column("at")).as_py() // 1000))
                else:
                    self.waiting.clear()
            states = {}
            if self.state.exists():
                columns = [c.to_pylist() for c in self.unpacked(self.state.get()).columns]
                states = {owner: tuple(state) for owner, *state in zip(*columns)}
            before = len(states)
            # A stable sort: of one key, time and id, the row given last is the last one.
            order = due.sort_by([(c, "ascending") for c in ("key", "at", ident)])
            given = [*zip(*(c.to_pylist() for c in order.columns))]
            out = []
            for i, (owner, at, row, value) in enumerate(given):
                if i + 1 < len(given) and given[i + 1][:3] == (owner, at, row):
                    continue
                states[owner], verdict = step(states.get(owner, start), at, value)
                out.append((owner, row, value, verdict))
            live = {owner: state for owner, state in states.items() if state[-1] + lifetime >= passed}
            if out or len(live) < before:
                if live:
                    columns = [*zip(*((owner, *state) for owner, state in live.items()))]
                    self.state.update(self.packed(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.kept)], schema=self.kept)))
                    # When the last of them is over, the piece is looked at again.
                    self.handle.registerTimer((max(state[-1] for state in live.values()) + lifetime) // 1000 + 1)
                elif self.state.exists():
                    self.state.clear()
            if out:
                yield pd.DataFrame(out, dtype=object)

        def close(self):
            pass

    return InEventOrder()


def _walk(rows: DataFrame, key: str, processor, schema: str) -> DataFrame:
    """Rows through a processor with timers in event time, the keys dealt over PIECES; the state is kept in RocksDB."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    dealt = rows.withColumns({"key": F.col(key), "piece": F.pmod(F.xxhash64(key), F.lit(PIECES)).cast("int")})
    return dealt.groupBy("piece").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime"
    )


def stream_revisions(updates: DataFrame, ttl_seconds: int = K.SESSION_GAP_SECONDS, delay: str = "10 minutes") -> DataFrame:
    """Accept updates that name the session's current revision: the streaming form of ``revision_conflicts``.

    Decisions come once the watermark has passed an update; state is the session's revision and last time, and the
    updates of the delay. After ``ttl_seconds`` without an update the next one starts a new session.
    """
    ttl = ttl_seconds * 1_000_000

    def step(state, at, revision):
        current, touched = state
        if touched is None or at - touched > ttl:
            current = 0
        accepted = revision == current
        return (current + int(accepted), at), accepted

    processor = _in_event_order("bigint", ("update_id", "revision"), ("current", "touched"), (0, None), step, ttl)
    timed = updates.withWatermark("ts", delay).withColumn("at", F.unix_micros("ts"))
    return _walk(timed, "session_key", processor, REVISION_OUTPUT)


def stream_duplicates(rows: DataFrame, delay_seconds: int = 600, watermark: str = "10 minutes") -> DataFrame:
    """Rows that repeat a signature kept at most ``delay_seconds`` before: the streaming form of ``repeats_within``.

    rows: those of ``formulation.signature_rows`` with ts. Signatures are told apart within a formulation.
    """
    delay = delay_seconds * 1_000_000

    def step(state, at, formulation_id):
        (kept,) = state
        fresh = kept is None or at - kept > delay
        return (at if fresh else kept,), not fresh

    processor = _in_event_order("string", ("row_number", "formulation_id"), ("kept",), (None,), step, delay)
    key = F.to_json(F.struct("formulation_id", *formulation.SIGNATURE), {"ignoreNullFields": "false"})
    timed = rows.withWatermark("ts", watermark).withColumns({"at": F.unix_micros("ts"), "signature": F.sha2(key, 256)})
    walked = _walk(timed, "signature", processor, "signature string, row_number bigint, formulation_id bigint, repeated boolean")
    return walked.select("formulation_id", "row_number", "repeated")


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything that is available now into Parquet files, then stop."""
    query = (
        stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).option("path", path)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def run_batches(writer) -> None:
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
