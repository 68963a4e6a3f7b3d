"""Small helpers shared by the text operators."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerlift.session import stage_path

#: The byte classes of words made of letters, digits and everything beyond ASCII; upper case A-Z becomes lower case.
_WORD = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256))
WORD_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c in _WORD else 32 for c in range(256))


#: Rows and bytes in one Arrow batch: with documents of a few kilobytes some megabytes, and few of very long ones.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20
_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, after asking its session for Arrow batches that suit long texts.

    Spark reads these settings when a job runs, which may be long after an operator has returned, so they
    stay; a session that asks for smaller batches keeps them.
    """
    for name, most in _BATCHES.items():
        value = re.fullmatch(r"(-?\d+)b?", df.sparkSession.conf.get(name).lower())
        if value is None or not 0 < int(value[1]) <= most:
            df.sparkSession.conf.set(name, str(most))
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def aside(df: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns that bear one of ``names`` (in any case) renamed, and the renaming that undoes it."""
    own = {c: f"__aside_{k}_{c}" for k, c in enumerate(df.columns) if c.lower() in names}
    return df.withColumnsRenamed(own), {v: k for k, v in own.items()}


def add_columns(df: DataFrame, schema: str, rows: Callable[[pa.RecordBatch], list[pa.Array]], drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with computed columns; ``rows`` turns one Arrow batch into the arrays of the new columns.

    Columns of ``df`` that bear a new column's name (in any case) are replaced; those in ``drop`` are
    read but not handed back.
    """
    new = StructType.fromDDL(schema)
    df = df.drop(*[c for c in df.columns if c.lower() in {n.lower() for n in new.names}])
    out = StructType([*(f for f in df.schema.fields if f.name not in drop), *new.fields])
    names = out.names

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                kept = [c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n not in drop]
                yield pa.RecordBatch.from_arrays([*kept, *rows(batch)], names=names)

    return small_batches(df).mapInArrow(apply, out)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str | None]:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def raw_texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    """The column's UTF-8 bytes."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def slices(raws: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of a binary array with at most ``most`` bytes each, or one longer value."""
    first = held = 0
    for k, size in enumerate(pc.fill_null(pc.binary_length(raws), 0).to_pylist()):
        if k > first and held + size > most:
            yield first, k
            first, held = k, 0
        held += size
    if len(raws):
        yield first, len(raws)


def stage_packed(df: DataFrame, label: str) -> DataFrame:
    """As :func:`ledgerlift.session.stage`, for long texts: packed more tightly."""
    path = stage_path(df.sparkSession, label)
    df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bits of the filter of :func:`maybe`: a megabyte at least, 64 at most.
_FILTER_BITS, _FILTER_MOST = 1 << 23, 1 << 29


def maybe(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """``df`` with ``__maybe``: false where ``column`` is surely not among ``ids``.

    A bitmap of eight bits for each id, in rows of 4 KB and 64 MB at most, is broadcast, so long texts that a join
    would do nothing with needn't be shuffled for it.  Beyond some sixty million ids the filter lets more rows
    pass; the join after it decides.  ``ids`` is counted first, so it should be a written table.
    """
    bits = _FILTER_BITS
    wanted = 8 * ids.count()
    while bits < min(wanted, _FILTER_MOST):
        bits *= 2
    bit = F.pmod(F.xxhash64(F.col(column).cast("bigint")), F.lit(bits))
    maps = ids.select(bit.alias("__bit")).groupBy(F.bitmap_bucket_number("__bit").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("__bit")).alias("__map"))
    marked = df.withColumns({"__bucket": F.bitmap_bucket_number(bit), "__at": F.bitmap_bit_position(bit)}).join(F.broadcast(maps), "__bucket", "left")
    byte = F.conv(F.hex(F.expr("substring(__map, cast(__at div 8 as int) + 1, 1)")), 16, 10).cast("int")
    return marked.withColumn("__byte", byte).withColumn("__maybe", F.expr("coalesce(shiftright(__byte, cast(__at % 8 as int)) & 1, 0) = 1")).drop("__bucket", "__map", "__at", "__byte")


def likely(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """The rows of ``df`` whose ``column`` may be among ``ids``."""
    return maybe(df, ids, column).where("__maybe").drop("__maybe")
