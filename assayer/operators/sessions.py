"""Jobs over a log of interpretation sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer import constants as K


def session_expiry(events: DataFrame, gap_seconds: int = K.SESSION_GAP_SECONDS) -> DataFrame:
    """Activity sessions per key: an idle time of more than ``gap_seconds`` ends one.

    events: session_key, ts. Events within one gap-wide time bucket always belong together, so they
    are first counted per bucket (map-side). The windows then see one row per bucket, however many
    events a key has.
    """
    kind = events.schema["ts"].dataType
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = gap_seconds * 1_000_000
    buckets = (
        events.select("session_key", micros.alias("_t"))
        .groupBy("session_key", F.floor(F.col("_t") / gap).cast("bigint").alias("_bucket"))
        .agg(F.min("_t").alias("_first"), F.max("_t").alias("_last"), F.count("*").alias("_n"))
    )
    order = Window.partitionBy("session_key").orderBy("_bucket")
    opens = F.col("_first") - F.lag("_last").over(order) > gap
    numbered = buckets.withColumn("_new", F.coalesce(opens, F.lit(True)).cast("int")).withColumn(
        "session_number", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
    return numbered.groupBy("session_key", "session_number").agg(
        F.timestamp_micros(F.min("_first")).cast(kind).alias("started_at"),
        F.timestamp_micros(F.max("_last")).cast(kind).alias("touched_at"),
        F.sum("_n").alias("events"),
    )


def recent_sessions(sessions: DataFrame, n: int = K.MAX_SESSIONS) -> DataFrame:
    """The n most recently touched sessions; Spark keeps n rows per task before merging."""
    return sessions.orderBy(F.desc("touched_at"), "session_key", "session_number").limit(n)


def revision_conflicts(updates: DataFrame, ttl_seconds: int = K.SESSION_GAP_SECONDS) -> DataFrame:
    """Which updates were accepted: those that name the session's current revision.

    updates: session_key, update_id, ts, revision. A session starts at revision 0 and an accepted update raises it by one;
    every update, accepted or not, keeps the session alive. After more than ``ttl_seconds`` without one the session is
    gone: the next update of its key belongs to a new one. Updates of equal time are ordered by id.

    One sorted pass: sessions are dealt over tasks, and a task walks over its rows with two numbers of state.
    """
    key = updates.schema["session_key"].dataType.simpleString()
    ident = updates.schema["update_id"].dataType.simpleString()
    ttl = ttl_seconds * 1_000_000

    def follow(batches):
        import pyarrow as pa

        session, current, touched, begun = None, 0, 0, False
        for batch in batches:
            accepted = []
            columns = (batch.column(c).to_pylist() for c in ("session_key", "_t", "revision"))
            for owner, at, revision in zip(*columns):
                if not begun or owner != session or at - touched > ttl:
                    session, current, begun = owner, 0, True
                touched = at
                accepted.append(revision == current)
                current += accepted[-1]
            arrays = [batch.column(c) for c in ("session_key", "update_id", "_t", "revision")]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(accepted, pa.bool_())], ["session_key", "update_id", "_t", "revision", "accepted"])

    kind = updates.schema["ts"].dataType
    rows = updates.select(
        "session_key", "update_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("_t"), F.col("revision").cast("bigint").alias("revision")
    )
    decided = (
        rows.repartition("session_key")
        .sortWithinPartitions("session_key", "_t", "update_id")
        .mapInArrow(follow, f"session_key {key}, update_id {ident}, _t bigint, revision bigint, accepted boolean")
    )
    return decided.select("session_key", "update_id", F.timestamp_micros("_t").cast(kind).alias("ts"), "revision", "accepted")


def attempt_outcomes(attempts: DataFrame) -> DataFrame:
    """Outcome per session from its attempts (session_id, attempt_number, status, transient).

    A success ends a cycle; so does a failure that is not transient, or the third transient one.
    """
    last = F.max_by(F.struct("status", "transient"), "attempt_number")
    grouped = attempts.groupBy("session_id").agg(
        F.count("*").alias("attempts"),
        F.count_if(F.col("status") == "failure").alias("failures"),
        F.max(F.when(F.col("status") == "success", F.col("attempt_number"))).alias("successful_attempt"),
        last.alias("_last"),
    )
    state = (
        F.when(F.col("_last.status") == "success", "interpreted")
        .when(~F.col("_last.transient"), "stopped")
        .when(F.col("attempts") - F.coalesce("successful_attempt", F.lit(0)) >= K.MAX_ATTEMPTS, "failed")
        .otherwise("retrying")
    )
    return grouped.select("session_id", "attempts", "failures", "successful_attempt", state.alias("state"))


def failure_categories(attempts: DataFrame) -> DataFrame:
    return attempts.filter("status = 'failure'").groupBy("session_id", "failure_category").agg(F.count("*").alias("failures"))
