"""Incremental jobs: each run picks up the files that arrived since the last one
(``availableNow``), with checkpoint and output in the shared folder, so a job
lost with its executors resumes where it stood. Nothing goes through the driver."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.session import shared_dir

HEARTBEAT = "heartbeat"


def arrivals(events: DataFrame, cut: str, beat: str) -> list:
    """A batch table as three arrivals: before and after a cut, then one heartbeat
    row, which moves the watermark past the last window (its kind is dropped from
    results when they are read)."""
    at = F.lit(cut).cast("timestamp")
    last = events.limit(1).select(*[F.lit(beat).cast("timestamp").alias(c) if c == "ts" else F.lit(HEARTBEAT).alias(c) if c == "kind" else
                                    F.lit(None).cast(events.schema[c].dataType).alias(c) if c not in ("ticker", "seq") else F.lit(-1).cast("bigint").alias(c) for c in events.columns])
    return [events.where(F.col("ts") < at), events.where(F.col("ts") >= at), last]


def run(slices: list, build, output: str = "files") -> DataFrame:
    """Run a streaming job once per arrival and return its output as a table.
    ``build`` maps the source stream to a result stream; "files" appends results to
    Parquet, "updates" keeps each micro-batch's updates apart (column ``batch``)."""
    spark = slices[0].sparkSession
    src, out, ckpt = (shared_dir(spark, f"stream-{p}") for p in ("in", "out", "ckpt"))
    schema = None
    for rows in slices:
        rows.write.mode("append").parquet(src)
        result = build(spark.readStream.schema(rows.schema).parquet(src))
        schema = result.schema
        writer = result.writeStream.option("checkpointLocation", ckpt).trigger(availableNow=True)
        if output == "files":
            query = writer.format("parquet").option("path", out).outputMode("append").start()
        else:
            def keep(df, n):
                df.write.mode("overwrite").parquet(f"{out}/batch={n}")      # a replayed batch replaces itself
            query = writer.outputMode("update").foreachBatch(keep).start()
        query.awaitTermination()
    return spark.read.schema(schema.add("batch", "long") if output != "files" else schema).parquet(out)


def deduplicated(stream: DataFrame, keys: list, delay: str) -> DataFrame:
    """Append-only ingest: repeats of a key within the delay are ignored."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def windowed(stream: DataFrame, keys: list, width: str, delay: str, aggs: list, slide: str | None = None) -> DataFrame:
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    g = stream.withWatermark("ts", delay).groupBy(w.alias("w"), *keys).agg(*aggs)
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, *g.columns[1 + len(keys):])


def sessions(stream: DataFrame, keys: list, gap: str, delay: str) -> DataFrame:
    return (stream.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), *keys).agg(F.count("*").alias("n"))
            .select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n"))


def unanswered(stream: DataFrame, asks: str, answers: str, within: str, delay: str) -> DataFrame:
    """Asks with no answer of the same name within the limit: a stream-stream outer
    interval join, emitted once the watermark has passed the deadline."""
    w = stream.withWatermark("ts", delay)
    a = w.where(F.col("kind").isin(asks, HEARTBEAT)).select(F.col("ticker"), F.col("seq"), F.col("ts").alias("asked"))
    b = w.where(F.col("kind").isin(answers, HEARTBEAT)).select(F.col("ticker").alias("t2"), F.col("ts").alias("answered"))
    cond = (F.col("ticker") == F.col("t2")) & (F.col("answered") >= F.col("asked")) & (F.col("answered") <= F.col("asked") + F.expr(f"INTERVAL {within}"))
    return a.join(b, cond, "leftOuter").select("ticker", "seq", "asked", "answered")
