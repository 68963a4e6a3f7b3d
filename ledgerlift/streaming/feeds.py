"""Incremental feeds: change upserts, versioned history, daily sums and duplicate suppression."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlift.operators.ranking import Order, first_per_key, grouped_row_number, join_on

#: Rows that a bucket of a feed's table should hold; beyond that the table is dealt out anew.
BUCKET_ROWS = 1_000_000


def file_stream(spark: SparkSession, folder: str, schema: T.StructType, *, pattern: str = "*.parquet", files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def run_available(writer, checkpoint: str) -> None:
    """Process everything there is, then stop; the checkpoint keeps the cursor for the next run."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def merge_changes(current: DataFrame | None, changes: DataFrame, key: str, order: Order) -> DataFrame:
    """Newest change per key over the stored rows and the new changes.

    Deleted keys stay as marked rows, so merging the same batch again, or batches in another
    order, gives the same table.
    """
    both = changes if current is None else current.unionByName(changes, allowMissingColumns=True)
    return first_per_key(both, [key], [(c, "desc") for c, _ in order])


def upsert_sink(target: str, key: str, order: Sequence[str], status: str = "change_type") -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function that keeps the newest state per key in a bucketed table.

    A batch reads the buckets its keys fall in, writes their merged rows once into a folder of its own, and then
    switches to them by one new manifest: the number of buckets, the folder and rows of each, the last batch.
    Until the manifest is there the table is the old one, whatever a lost job leaves behind; a repeated batch
    is known by its number and changes nothing.  The number of buckets is kept with the table and grows with its
    rows (:data:`BUCKET_ROWS`), which deals all rows out anew each time they have doubled.  Folders that no manifest
    needs any more go with :func:`vacuum`.
    """
    ways = [(c, "desc") for c in order]

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        state = manifest(spark, target)
        if state and state["batch"] >= batch_id:
            return
        changes = first_per_key(batch, [key], ways).withColumn("is_deleted", F.col(status) == "DELETED")
        if state is None:
            state = {"version": 0, "batch": -1, "buckets": _buckets(changes.count()), "folders": {}, "rows": {}}
        bucket = lambda n: F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(n)).cast("int")
        changes = changes.withColumn("bucket", bucket(state["buckets"]))
        touched = [str(r["bucket"]) for r in changes.select("bucket").distinct().collect()]  # at most as many as there are buckets
        if touched:
            stored = _read(spark, state, [b for b in touched if b in state["folders"]])
            _replace(spark, target, state, merge_changes(stored, changes, key, ways), batch_id)
            if (wanted := _buckets(sum(state["rows"].values()))) > state["buckets"]:
                whole = _read(spark, state, state["folders"])
                state |= {"buckets": wanted, "folders": {}, "rows": {}}
                _replace(spark, target, state, whole.withColumn("bucket", bucket(wanted)), batch_id)
        _publish(spark, target, state | {"version": state["version"] + 1, "batch": batch_id})

    return write


def _buckets(rows: int) -> int:
    """A power of two with which buckets hold no more than they should, on average."""
    return 1 << max(0, (-(-rows // BUCKET_ROWS) - 1).bit_length())


def _replace(spark: SparkSession, target: str, state: dict, rows: DataFrame, batch_id: int) -> None:
    """Write ``rows`` as the new content of their buckets."""
    folder = f"{target}/data/{batch_id:012d}-{uuid.uuid4().hex}"
    rows.repartition("bucket").write.partitionBy("bucket").parquet(folder)
    for r in spark.read.parquet(folder).groupBy("bucket").agg(F.count("*").alias("n")).collect():  # a row a bucket
        state["folders"][str(r["bucket"])], state["rows"][str(r["bucket"])] = folder, r["n"]


def _read(spark: SparkSession, state: dict, buckets: Iterable[str]) -> DataFrame | None:
    """The stored rows of these buckets."""
    folders: dict[str, list[int]] = {}
    for b in buckets:
        folders.setdefault(state["folders"][b], []).append(int(b))
    parts = None
    for folder, own in folders.items():
        part = spark.read.parquet(folder).filter(F.col("bucket").isin(own))
        parts = part if parts is None else parts.unionByName(part, allowMissingColumns=True)
    return parts


def _files(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, folder: str) -> list[str]:
    path, files = _files(spark, folder)
    return sorted(f.getPath().getName() for f in files.listStatus(path)) if files.exists(path) else []


def manifest(spark: SparkSession, target: str) -> dict | None:
    """The table's state: the manifest with the highest number, or None."""
    names = [n for n in _names(spark, f"{target}/manifests") if n.endswith(".json")]
    if not names:
        return None
    path, files = _files(spark, f"{target}/manifests/{names[-1]}")
    stream = files.open(path)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _publish(spark: SparkSession, target: str, state: dict) -> None:
    """Put the manifest in place under its number; who comes second fails."""
    final, files = _files(spark, f"{target}/manifests/{state['version']:012d}.json")
    draft, _ = _files(spark, f"{target}/manifests/{uuid.uuid4().hex}.draft")
    stream = files.create(draft, True)
    stream.write(bytearray(json.dumps(state).encode()))
    stream.close()
    if files.exists(final) or not files.rename(draft, final):
        files.delete(draft, False)
        raise RuntimeError(f"another writer has published version {state['version']} of {target}")


def vacuum(spark: SparkSession, target: str, keep: int = 2) -> list[str]:
    """Delete all but the newest ``keep`` manifests and the folders that none of these needs; readers of older ones must be done."""
    names = [n for n in _names(spark, f"{target}/manifests") if n.endswith(".json")]
    needed: set[str] = set()
    for name in names[-keep:]:
        path, files = _files(spark, f"{target}/manifests/{name}")
        stream = files.open(path)
        needed |= {f.rsplit("/", 1)[1] for f in json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["folders"].values()}
        stream.close()
    gone = [f"{target}/manifests/{n}" for n in names[:-keep]] + [f"{target}/data/{n}" for n in _names(spark, f"{target}/data") if n not in needed]
    for name in gone:
        path, files = _files(spark, name)
        files.delete(path, True)
    return gone


def current_rows(spark: SparkSession, target: str) -> DataFrame:
    """State of the feed: the newest row of each key that is not deleted."""
    state = manifest(spark, target)
    if state is None or not state["folders"]:
        raise ValueError(f"{target} has no rows yet")
    return _read(spark, state, state["folders"]).filter(~F.col("is_deleted")).drop("bucket", "is_deleted")


def version_history(changes: DataFrame, key: str, at: str, tie: str, *, deleted: Column | None = None) -> DataFrame:
    """Versioned rows: valid from a change to the next one of the same key, the last one current.

    Changes are numbered per key and joined with their successor's number, so a key with most of
    the changes does not end up in one task.
    """
    numbered = grouped_row_number(changes, [key], [(at, "asc"), (tie, "asc")], "_version")
    following = numbered.select(key, (F.col("_version") - 1).alias("_version"), F.col(at).alias("valid_to"))
    out = join_on(numbered, following, [key, "_version"], "left")
    gone = deleted if deleted is not None else F.lit(False)
    return out.withColumns({"valid_from": F.col(at), "version": F.col("_version"), "is_current": F.col("valid_to").isNull() & ~gone}).drop("_version")


def daily_sums(stream: DataFrame, at: str, keys: Sequence[str], value: str, *, lateness: str = "1 day") -> DataFrame:
    """Sums per key and day; rows later than the allowed lateness are dropped."""
    return (
        stream.withWatermark(at, lateness).groupBy(F.window(at, "1 day"), *keys)
        .agg(F.count("*").alias("row_count"), F.sum(value).alias("total_value"))
        .select(F.col("window.start").cast("date").alias("day"), *keys, "row_count", "total_value")
    )


def months_from_days(days: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Days rolled up to months (months have no fixed length, windows need one)."""
    return days.groupBy(*keys, F.trunc("day", "month").alias("month")).agg(F.sum("row_count").alias("row_count"), F.sum("total_value").alias("total_value"))


def without_repeats(stream: DataFrame, at: str, keys: Sequence[str], *, lateness: str = "1 day") -> DataFrame:
    """Repeated lines dropped while the first one is still within the allowed lateness."""
    return stream.withWatermark(at, lateness).dropDuplicatesWithinWatermark(list(keys))
