"""Jobs on Spark's keyed state: values per key in the engine's state store, event-time timers that clear them, and rows that come too
late put out on the side.

The clock of these jobs is the time at which a row arrives (``arrived``), so the engine never drops a row; the business time of a row
(``ts``, a period's end) is data. A key is closed by its own rule, a time worked out from the key alone, so nothing has to be remembered
of it once its timer has cleared it: a row that comes after that is late, is put out as such and changes no state. Keys without an end
are cleared when nothing has come for ``idle``. Rows of one bucket of keys and micro-batch are held in memory; a micro-batch's size is bounded by
the source's options (``maxFilesPerTrigger``)."""

import datetime as dt
import operator
import pickle
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from lodestat.session import input_bytes, shared_dir

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000


@contextmanager
def state_store(spark: SparkSession):
    """Keyed state needs this store; the session's own setting comes back afterwards."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before is not None else spark.conf.unset(PROVIDER)


def end_ms(day: str, days: int) -> int:
    """The time ``days`` days after the end of a day, in milliseconds."""
    at = dt.datetime.fromisoformat(day).replace(tzinfo=dt.timezone.utc)
    return int(at.timestamp()) * 1000 + (days + 1) * DAY_MS


class Processor(StatefulProcessor):
    """Keyed logic over buckets of keys. State is held by bucket, not by key, as each access is a round trip between the
    worker and the store: one value holds a bucket's keys with what is known of them, and one timer stands for the key that goes next.
    ``take`` and ``leave`` see single keys; ``run`` tells the names of the keys and of the columns that come in and go out."""

    keys, columns, names = [], [], []

    def init(self, handle):
        self.handle = handle
        self.held = handle.getValueState("held", "timer long, keys binary")
        self.out = Row(*self.names)
        self.at = [self.columns.index(c) for c in self.keys]

    def load(self):
        """(time of the timer or None, {key: (time at which it goes, what is known)})"""
        if not self.held.exists():
            return None, {}
        timer, keys = self.held.get()
        return timer, pickle.loads(keys)

    def save(self, timer, known: dict):
        if not known:
            self.held.clear()
            return
        goes = min(x[0] for x in known.values())
        if timer is None or goes < timer:
            self.handle.registerTimer(goes)
            timer = goes
        self.held.update((timer, pickle.dumps(known, pickle.HIGHEST_PROTOCOL)))

    def handleInputRows(self, key, rows, timerValues):
        clock, at = timerValues.getCurrentWatermarkInMs(), self.at
        of_key = {}
        for r in rows:
            r = tuple(r)
            of_key.setdefault(tuple([r[i] for i in at]), []).append(r)
        timer, known = self.load()
        for k, own in of_key.items():
            for values in self.take(k, own, known, clock):
                yield self.out(*k, *values)
        self.save(timer, known)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        clock, (timer, known) = timerValues.getCurrentWatermarkInMs(), self.load()
        for k in [k for k, x in known.items() if x[0] <= clock]:
            for values in self.leave(known.pop(k)):
                yield self.out(*k, *values)
        fired = timer is None or timer <= expiredTimerInfo.getExpiryTimeInMs()
        self.save(None if fired else timer, known)

    def take(self, key: tuple, rows: list, known: dict, clock: int):
        """What a key's rows of a micro-batch put out; ``known[key]`` may change."""
        raise NotImplementedError

    def leave(self, gone: tuple):
        """What a key puts out when its time is over."""
        return ()

    def pick(self, *names):
        return operator.itemgetter(*[self.columns.index(n) for n in names])

    def close(self):
        pass


class Latest(Processor):
    """The newest row of each (…, day) by (at, seq), until the day has been over for ``days``: put out at every change, or once at the
    end. Rows that come later are put out as late."""

    def __init__(self, days: int, at_end: bool):
        self.days, self.at_end = days, at_end

    def init(self, handle):
        super().init(handle)
        self.fields, self.closing = self.pick("at", "seq", "value"), {}

    def take(self, key, rows, known, clock):
        closes = self.closing.get(key[-1])
        if closes is None:
            closes = self.closing[key[-1]] = end_ms(key[-1], self.days)
        found = [self.fields(r) for r in rows]
        if closes <= clock:
            for x in found:
                yield *x, True
            return
        held = known[key][1] if key in known else None
        best = max(found + ([held] if held else []), key=lambda x: x[:2])
        if best != held:
            known[key] = (closes, best)
            if not self.at_end:
                yield *best, False

    def leave(self, gone):
        if self.at_end:
            yield *gone[1], False


class _Idle(Processor):
    """State of a key that goes when nothing has come for ``idle`` days of arrivals."""

    def __init__(self, idle: int):
        self.idle = idle

    def put(self, known: dict, key: tuple, value: tuple, arrived: int):
        known[key] = (arrived + self.idle * DAY_MS, value)


class Changes(_Idle):
    """Rows whose fingerprint differs from the one before of their key; the first is the baseline. Rows older than the last one seen
    change nothing."""

    def init(self, handle):
        super().init(handle)
        self.fields = self.pick("at", "seq", "fingerprint", "arrived_ms")

    def take(self, key, rows, known, clock):
        last, arrived = known[key][1] if key in known else None, clock
        for at, seq, fingerprint, came in sorted((self.fields(r) for r in rows), key=lambda x: x[:2]):
            arrived = max(arrived, came)
            if last is not None and (at, seq) <= last[:2]:
                continue
            if last is not None and last[2] is not None and fingerprint is not None and last[2] != fingerprint:
                yield seq, last[2], fingerprint
            last = (at, seq, fingerprint)
        self.put(known, key, last, arrived)


class Streaks(_Idle):
    """Consecutive hits per key over days. A day counts once, by its last row of the micro-batch; a miss resets, a tripped key stays
    broken, and days already seen change nothing."""

    def __init__(self, idle: int, needed: int):
        super().__init__(idle)
        self.needed = needed

    def init(self, handle):
        super().init(handle)
        self.fields = self.pick("day", "seq", "hit", "arrived_ms")

    def take(self, key, rows, known, clock):
        day, streak, broken = known[key][1] if key in known else ("", 0, False)
        hits, arrived = {}, clock
        for on, seq, hit, came in map(self.fields, rows):
            arrived = max(arrived, came)
            if on > day and (on not in hits or seq > hits[on][0]):
                hits[on] = (seq, hit)
        for day in sorted(hits):
            streak = streak + 1 if hits[day][1] else 0
            broken = broken or streak >= self.needed
            yield day, streak, "broken" if broken else "intact"
        if hits:
            self.put(known, key, (day, streak, broken), arrived)


#: Bytes of input for a bucket of keys, by the optimizer's estimate.
BUCKET_BYTES = 32 << 10


def buckets_for(slices: list) -> int:
    """Number of buckets of keys, fixed for a stream's life: more for a larger table, so that a bucket stays small."""
    size = max(input_bytes(s) for s in slices)
    return max(int(slices[0].sparkSession.conf.get("spark.sql.shuffle.partitions")), min(size // BUCKET_BYTES, 1 << 20))


def run(slices: list, keys: list, processor: Callable[[], Processor], schema: str, delay: str = "0 seconds", progress: list | None = None, buckets: int | None = None) -> DataFrame:
    """Run a keyed job once per arrival and return all it has put out. Every slice has the columns ``ts`` (processors read it as
    ``at``, in microseconds) and ``arrived``; ``progress`` takes the
    number of buckets in state after each arrival."""
    spark = slices[0].sparkSession
    src, out, ckpt = (shared_dir(spark, f"keyed-{p}") for p in ("in", "out", "ckpt"))
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets or buckets_for(slices))).alias("bucket")
    with state_store(spark):
        for rows in slices:
            rows.write.mode("append").parquet(src)
            stream = spark.readStream.schema(rows.schema).parquet(src).withColumns({"at": F.unix_micros("ts"), "arrived_ms": F.unix_millis("arrived")})
            stream = stream.withWatermark("arrived", delay).select("*", bucket)
            step = processor()
            step.keys, step.columns, step.names = list(keys), stream.columns, [c.split()[0] for c in schema.split(", ")]
            result = stream.groupBy("bucket").transformWithState(step, outputStructType=schema, outputMode="Append", timeMode="EventTime")
            query = result.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt).outputMode("append").trigger(availableNow=True).start()
            query.awaitTermination()
            if progress is not None:
                progress.append(sum(s["numRowsTotal"] for s in query.lastProgress["stateOperators"]))
    return spark.read.schema(schema).parquet(out)


def by_arrival(rows: DataFrame, cuts: list, beat: str) -> list:
    """A table as arrivals before, between and after the cuts, then one heartbeat row that moves the clock to ``beat``; its keys are
    those of no company (-1, or the heartbeat's day)."""
    bounds = [None, *[F.lit(c).cast("timestamp") for c in cuts], None]
    parts = []
    for low, high in zip(bounds[:-1], bounds[1:], strict=True):
        keep = F.lit(True)
        if low is not None:
            keep = keep & (F.col("arrived") >= low)
        if high is not None:
            keep = keep & (F.col("arrived") < high)
        parts.append(rows.where(keep))
    at = {"arrived": F.lit(beat).cast("timestamp"), "ts": F.lit(beat).cast("timestamp"), "ticker": F.lit(-1), "entity": F.lit(-1), "day": F.lit(beat[:10]), "end_day": F.lit(beat[:10]), "tag": F.lit("heartbeat")}
    last = rows.sparkSession.range(1).select(*[at.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) if f.name != "seq" else F.lit(-1).cast(f.dataType).alias("seq") for f in rows.schema])
    return [*parts, last]
