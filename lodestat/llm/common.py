"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestat.session import shared_dir, stage

__all__ = ["in_small_batches", "likely", "replaced", "rows_of", "run_ids", "shared_dir", "slices", "stage", "text_of", "texts", "working_parts"]


#: Bytes of rows that reach a Python worker at once. Texts are large: Spark's own bound, 64 MB and 10,000 rows, holds hundreds of MB in each task.
BATCH_BYTES = 4 << 20


def in_small_batches(df: DataFrame) -> DataFrame:
    """``df``; from here on its session hands rows to Python by ``BATCH_BYTES`` at most, or less if it is set so."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(re.sub("[^0-9-]", "", conf.get(name)) or 0) > BATCH_BYTES or not conf.get(name).rstrip("b").isdigit():
        conf.set(name, str(BATCH_BYTES))
    return df


def text_of(docs: DataFrame, *columns: str, text: str = "text") -> DataFrame:
    """The named columns and the text; a null text counts as an empty one. Other columns never reach the workers."""
    return in_small_batches(docs).select(*columns, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def texts(batch: pa.RecordBatch, column: str = "text", most: int = 4 << 20) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of slices of about ``most`` bytes, so that a batch of long texts is not held as Python strings at once."""
    values = batch.column(column)
    if not len(values):
        return
    sizes = np.cumsum(np.asarray(pc.binary_length(values)).astype(np.int64))
    first = 0
    while first < len(sizes):
        done = sizes[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(sizes, done + most, side="right")))
        yield first, values.slice(first, last - first).to_pylist()
        first = last


def slices(batch: pa.RecordBatch, column: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` bytes of the column, a row at least."""
    if not batch.num_rows:
        return
    sizes = np.cumsum(np.nan_to_num(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(float)))
    first = 0
    while first < len(sizes):
        last = max(first + 1, int(np.searchsorted(sizes, (sizes[first - 1] if first else 0) + most, side="right")))
        yield batch.slice(first, last - first)
        first = last


def rows_of(batch: pa.RecordBatch, column: str = "text") -> Iterator[np.ndarray]:
    """The bytes of each value of a string or binary column, without a copy."""
    values = batch.column(column)
    kind = np.int64 if pa.types.is_large_string(values.type) or pa.types.is_large_binary(values.type) else np.int32
    _, offsets, data = values.buffers()
    if not len(values):
        return
    at = np.frombuffer(offsets, kind)[values.offset: values.offset + len(values) + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield flat[a:b]


def run_ids(lengths: np.ndarray) -> np.ndarray:
    """0..n-1 within each run of the given lengths."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def replaced(batch: pa.RecordBatch, name: str, new: dict[int, object]) -> pa.RecordBatch:
    """The batch with new values in some rows of a column."""
    column = batch.column(name)
    mask = np.zeros(len(column), bool)
    mask[list(new)] = True
    values = pa.array([new[i] for i in sorted(new)], column.type)
    return batch.set_column(batch.schema.get_field_index(name), batch.schema.field(name), pc.replace_with_mask(column, pa.array(mask), values))


def likely(rows: DataFrame, wanted: DataFrame, by: str, bits: int = 25) -> DataFrame:
    """The rows whose whole number ``by`` is in ``wanted``, and a few more where the last ``bits`` bits agree: a bitmap of 2^bits bits, 4 MB
    whatever the tables, is sent to all tasks, so that texts nobody asks for are not exchanged."""
    place = F.pmod(F.xxhash64(by), F.lit(1 << bits)) + 1
    held = wanted.select(place.alias("_p")).groupBy(F.bitmap_bucket_number("_p").alias("_b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_p")).alias("_bits"))
    found = rows.withColumn("_p", place).withColumn("_b", F.bitmap_bucket_number("_p")).join(F.broadcast(held), "_b")
    byte = "cast(conv(hex(substring(_bits, cast(bitmap_bit_position(_p) div 8 as int) + 1, 1)), 16, 10) as int)"
    return found.where(f"getbit({byte}, cast(bitmap_bit_position(_p) % 8 as int)) = 1").select(rows.columns)


def working_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
