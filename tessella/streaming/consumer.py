"""Structured Streaming: an idempotent receipt consumer, checkpointed ingest and event-time windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tessella.operators.segments import Segments
from tessella.session import durable
from tessella.sources.keyed import BUCKETS, KeyedTable


EVENTS = "event_id string, digest string, status string, batch long"
LETTERS = "event_id string, digest string, reason string, occurrences long, first_batch long, last_batch long"


class Consumer:
    """Consumes receipts (event_id, digest, payload columns) by micro-batch with an exactly-once effect.

    Known events and dead letters are tables in hash buckets by event; a batch
    reads and rewrites the buckets of its own events, so its cost goes with the
    batch.  A known event with the same digest is skipped; with another digest it
    is a dead letter; a new one is handed to `apply` once.  The marker, one row,
    says which batch began to apply and which has ended; between the two it blocks
    reconciliation.  A batch that runs again decides as it did, since it does not
    see its own events, and what it has written it does not write again.
    """

    def __init__(self, spark: SparkSession, state: str, apply: Callable[[DataFrame, int], None], current: DataFrame | None = None, buckets: int = BUCKETS):
        self.spark, self.state, self.apply, self.current = spark, state.rstrip("/"), apply, current
        self.known = KeyedTable(spark, f"{self.state}/events", "event_id", EVENTS, buckets)
        self.dead = KeyedTable(spark, f"{self.state}/dead", "event_id", LETTERS, buckets)
        self.marks = KeyedTable(spark, f"{self.state}/marker", "name", "name string, intent long, done long", 1)

    def events(self, upto: int | None = None) -> DataFrame:
        """Known events; of batches up to one, if given."""
        rows = self.known.rows()
        return rows if upto is None else rows.where(F.col("batch") <= upto)

    def dead_letters(self, upto: int | None = None) -> DataFrame:
        """Dead letters as they are now; those first seen in batches up to one, if given."""
        rows = self.dead.rows()
        return rows if upto is None else rows.where(F.col("first_batch") <= upto)

    def marker(self) -> DataFrame:
        """One row: the batch that last began to apply and the one that last ended, -1 for none; blocked if they differ."""
        none = self.spark.range(1).select(F.lit(-1).cast("long").alias("intent"), F.lit(-1).cast("long").alias("done"))
        both = self.marks.rows().select("intent", "done").unionByName(none)
        return both.agg(F.max("intent").alias("intent"), F.max("done").alias("done")).withColumn("blocked", F.col("intent") > F.col("done"))

    def blocked(self) -> bool:
        """Whether a batch began to apply and has not ended."""
        return self.marker().first().blocked

    def _mark(self, intent: int, done: int) -> None:
        row = self.spark.range(1).select(F.lit("batch").alias("name"), F.lit(intent).cast("long").alias("intent"), F.lit(done).cast("long").alias("done"))
        self.marks.replace(row, intent)

    def batch(self, receipts: DataFrame, version: int) -> None:
        marker = self.marker().first()
        touched = self.known.touched(receipts)
        known = self.known.stored(touched).where(F.col("batch") < version)
        # Of receipts of one event in a batch, the first by digest counts; others are conflicts.
        first = receipts.groupBy("event_id").agg(F.min("digest").alias("digest"))
        conflicts = receipts.select("event_id", "digest").join(first, ["event_id", "digest"], "left_anti")
        seen = first.join(known.select("event_id", F.col("digest").alias("known")), "event_id", "left")
        changed = seen.where("known is not null and known <> digest").select("event_id", "digest").unionByName(conflicts).distinct()
        fresh = seen.where("known is null").select("event_id", "digest")
        if self.current is not None:
            now = self.current.select("event_id", F.col("digest").alias("__now"))
            fresh = fresh.join(now, "event_id", "left").select("event_id", "digest", F.when(F.col("__now").isNotNull() & (F.col("__now") != F.col("digest")), "stale").otherwise("completed").alias("status"))
        else:
            fresh = fresh.withColumn("status", F.lit("completed"))
        fresh, changed = durable(fresh, "fresh"), durable(changed, "changed")
        if marker.done < version:
            self._mark(version, marker.done)
            todo = receipts.join(fresh.where("status = 'completed'").select("event_id", "digest"), ["event_id", "digest"], "left_semi").dropDuplicates(["event_id"])
            self.apply(todo, version)
        letters = changed.select("event_id", "digest", F.lit("changed-content").alias("reason"), F.lit(1).cast("long").alias("occurrences"), F.lit(version).cast("long").alias("first_batch"), F.lit(version).cast("long").alias("last_batch"))
        merged = self._letters(letters).unionByName(letters).groupBy("event_id", "digest", "reason").agg(F.sum("occurrences").alias("occurrences"), F.min("first_batch").alias("first_batch"), F.max("last_batch").alias("last_batch"))
        self.dead.upsert(merged, version)
        self.known.upsert(fresh.withColumn("batch", F.lit(version).cast("long")), version)
        self._mark(version, version)

    def _letters(self, letters: DataFrame) -> DataFrame:
        """The dead letters so far of these events, from their buckets."""
        old = self.dead.stored(self.dead.touched(letters)).select(*self.dead.columns)
        return old.join(letters.select("event_id").distinct(), "event_id", "left_semi")

    def start(self, receipts: DataFrame, checkpoint: str) -> StreamingQuery:
        return receipts.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def receipt_stream(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantined) receipts of a directory of shards: a file's name is its event's hash."""
    raw = spark.readStream.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(path, wholetext=True)
    named = raw.select("value", F.regexp_extract(F.col("_metadata.file_path"), r"/([0-9a-f]{2})/([0-9a-f]{64})\.json$", 2).alias("named"))
    parsed = named.withColumn("r", F.from_json("value", schema)).withColumn("digest", F.sha2("value", 256))
    valid = (F.col("named") != "") & F.col("r").isNotNull() & (F.col("r.event_id") == F.col("named"))
    return parsed.where(valid).select("digest", "r.*"), parsed.where(~F.coalesce(valid, F.lit(False))).select("named", "digest")


def windowed_counts(events: DataFrame, at: str, by: str, *, size: str = "1 day", slide: str | None = None, late: str = "1 hour", value: str | None = None) -> DataFrame:
    """Tumbling, or sliding, event-time windows with a watermark."""
    w = F.window(at, size, slide) if slide else F.window(at, size)
    more = [F.round(F.sum(value), 4).alias("total")] if value else []
    return events.withWatermark(at, late).groupBy(w, by).agg(F.count(F.lit(1)).alias("n"), *more).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), by, "n", *(["total"] if value else []))


def session_counts(events: DataFrame, at: str, by: str, gap: str, *, late: str = "1 hour") -> DataFrame:
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def rolling_digest_calls(log: DataFrame, session: str, *order: str, every: int = 100) -> DataFrame:
    """The batch form of a digest every so many calls: session, digest number, calls."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(session).orderBy(*order))
    return log.withColumn("digest_no", F.floor((n - 1) / every).cast("long")).groupBy(session, "digest_no").agg(F.count(F.lit(1)).alias("calls"))


def notify(states: DataFrame, forced: Column) -> DataFrame:
    """Rows to notify of: unhealthy, and either changed or forced; states: name, at, status."""
    from pyspark.sql import Window

    before = F.lag("status").over(Window.partitionBy("name").orderBy("at"))
    return states.withColumn("previous", before).where((F.col("status") != "healthy") & (~F.col("status").eqNullSafe(F.col("previous")) | forced))


#: Calls and seconds after which a session's digest is due.
DIGEST_CALLS, DIGEST_SECONDS = 100, 300


def digest_triggers(log: DataFrame, session: str, at: str, *ties: str, every: int = DIGEST_CALLS, seconds: float = DIGEST_SECONDS) -> DataFrame:
    """session, digest_no, at_call and at of every call that triggers a digest: `every` calls, or `seconds`, after the last one.

    Whatever came before, a digest at one call leaves the same next one: the call
    `every` later, or the first that is `seconds` away, as told by one running
    count of calls and of times that far after them.  From the start of each
    session, whose clock starts at its first call, pointers to the 1st, 2nd, 4th,
    ... next digest reach all of them.  Sessions are never walked, and hot ones are
    cut into segments.  Calls without a time are left out.
    """
    rows = log.where(F.col(at).isNotNull()).select(F.struct(F.col(session).alias("session")).alias("s"), F.col(at).alias("t"), *(F.col(c).alias(f"tie_{i}") for i, c in enumerate(ties)))
    cut = Segments(rows, "s", "t", *(f"tie_{i}" for i in range(len(ties))))
    calls = durable(cut.done(cut.running_sum(cut.rows, F.lit(1), "call")).select("s", "t", F.col("call").cast("long").alias("call")), "calls")
    # A time stands before the calls at it: they are that far away.
    late = calls.select("s", (F.col("t") + F.make_dt_interval(secs=F.lit(seconds))).alias("t"), F.lit(0).alias("kind"), "call")
    both = Segments(calls.select("s", "t", F.lit(1).alias("kind"), "call").unionByName(late), "s", "t", "kind", "call")
    counted = both.done(both.running_sum(both.rows, F.col("kind"), "before")).where("kind = 0")
    after = F.least(F.col("call") + every, F.col("before") + 1)
    first = counted.where("call = 1").select("s", F.lit(0).cast("long").alias("call"), F.greatest(F.lit(2), F.least(F.lit(every), F.col("before") + 1)).cast("long").alias("to"))
    steps = counted.select("s", "call", after.cast("long").alias("to")).unionByName(first)
    there = calls.select("s", F.col("call").alias("to"))
    jump = durable(steps.join(there, ["s", "to"], "left_semi").select("s", "call", "to"), "jump")
    reached, span = durable(first.select("s", "call", F.lit(0).cast("long").alias("digest_no")), "reached"), 1
    while not jump.isEmpty():
        further = reached.join(jump, ["s", "call"]).select("s", F.col("to").alias("call"), (F.col("digest_no") + span).alias("digest_no"))
        reached = durable(reached.unionByName(further), "reached")
        jump = durable(jump.join(jump.select("s", F.col("call").alias("to"), F.col("to").alias("far")), ["s", "to"]).select("s", "call", F.col("far").alias("to")), "jump")
        span *= 2
    found = reached.where("digest_no > 0").join(calls, ["s", "call"])
    return found.select(F.col("s.session").alias(session), "digest_no", F.col("call").alias("at_call"), F.col("t").alias("at"))
