"""Text files with the number of every line, read in as many splits as Spark makes of them."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestat.session import stage


def numbered(spark: SparkSession, path) -> DataFrame:
    """(file, line, first, value): lines that are not empty, numbered from 0 in their file, beside the file's first line.

    Lines of one split are consecutive, so a split's lines count on from the sum of the splits before it. Only those sums, one row
    per split, are ordered; the lines themselves keep to their splits."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    kept = stage(raw.where(F.length("value") > 0).withColumn("at", F.monotonically_increasing_id()), "lines")
    splits = kept.groupBy("file", "block").agg(F.min("at").alias("start"), F.count(F.lit(1)).alias("n"), F.min_by("value", "at").alias("head"))
    whole = W.partitionBy("file").orderBy("block")
    splits = splits.select("file", "block", "start", F.first("head").over(whole).alias("first"),
                           F.coalesce(F.sum("n").over(whole.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return kept.join(splits, ["file", "block"]).select("file", (F.col("before") + F.col("at") - F.col("start")).alias("line"), "first", "value")


def csv_rows(spark: SparkSession, path) -> tuple[DataFrame, list]:
    """(rows, columns) of CSV files with a header line: (file, line, fault, a text column per header name). ``line`` counts rows from 1,
    as a record holds no line break. ``fault`` tells why a row can't be read: another number of columns, or a file whose header is
    not that of the first file by name. No file: no columns."""
    lines = numbered(spark, path)
    head = lines.where("line = 0").agg(F.min_by("value", "file").alias("h")).first().h          # one line
    if head is None:
        return lines.where("false").select("file", "line", F.lit(None).cast("string").alias("fault")), []
    plain = head.removeprefix("\ufeff")
    width = spark.range(1).select(F.size(F.split(F.regexp_replace(F.lit(plain), '"[^"]*"', "q"), ",", -1))).first()[0]
    cells = ", ".join(f"c{i} string" for i in range(width))
    one = spark.range(1).select(F.from_csv(F.lit(plain), cells).alias("r")).select("r.*").first()
    columns = [(c or f"_c{i}").strip() for i, c in enumerate(one)]
    parsed = F.from_csv("value", f"{cells}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = lines.where("line > 0").withColumn("r", parsed)
    fault = F.when(F.col("first") != head, "other header").when(F.col("r._corrupt").isNotNull(), "column count")
    return rows.select("file", "line", fault.alias("fault"), *[F.col(f"r.c{i}").alias(c) for i, c in enumerate(columns)]), columns
