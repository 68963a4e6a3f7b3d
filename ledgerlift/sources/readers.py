"""Readers: files, tables and nested product or account documents as DataFrames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CONTAINER_KEYS = ("products", "items", "data", "results", "records")
SEPARATORS = (",", ";", "\t", "|")


class SourceError(ValueError):
    """A source that cannot be read as asked."""


def _without_bom(df: DataFrame) -> DataFrame:
    first = df.columns[0]
    clean = first.lstrip("﻿").strip('"')
    return df.withColumnRenamed(first, clean) if clean != first else df


def read_csv(spark: SparkSession, path: str, *, schema: T.StructType | str | None = None, sep: str = ",", keep_empty: bool = False) -> DataFrame:
    """CSV with a header, all text unless a schema is given, byte-order mark removed."""
    reader = spark.read.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').option("multiLine", False)
    if keep_empty:
        reader = reader.option("nullValue", "\u0000").option("emptyValue", "")
    if schema is not None:
        reader = reader.schema(schema)
    return _without_bom(reader.csv(path))


def sniff_separator(spark: SparkSession, path: str) -> str:
    """Separator of a file: the one most frequent in the header line (one line is read)."""
    line = spark.read.text(path).limit(1).collect()
    if not line:
        raise SourceError(f"{path} is empty")
    return max(SEPARATORS, key=lambda s: (line[0][0].count(s), -SEPARATORS.index(s)))


def read_csv_sniffed(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, sep=sniff_separator(spark, path))


def read_json(spark: SparkSession, path: str, *, schema: T.StructType | str | None = None, multi_line: bool = False) -> DataFrame:
    reader = spark.read.option("multiLine", multi_line)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def read_records(spark: SparkSession, path: str, *, lines: bool = False) -> DataFrame:
    """Records from (gzip) JSON: lines, an array, or an object holding the array under a known key.

    ``lines`` says that every line is a document of its own: such files stay splittable, while one
    large document can only be read by one task.
    """
    df = spark.read.option("multiLine", not lines).json(path)
    for key in CONTAINER_KEYS:
        if key in df.columns and isinstance(df.schema[key].dataType, T.ArrayType) and isinstance(df.schema[key].dataType.elementType, T.StructType):
            return df.select(F.explode(key).alias("_r")).select("_r.*")
    if not lines and "_corrupt_record" in df.columns:
        return read_records(spark, path, lines=True)
    return df


def read_account_documents(spark: SparkSession, path: str, *, lines: bool = False) -> DataFrame:
    """One document per account ``{account_id, data: [...]}`` as one row per item, with the file name."""
    df = spark.read.option("multiLine", not lines).json(path).withColumn("source_file", F.col("_metadata.file_name"))
    return df.select("source_file", "account_id", F.explode("data").alias("_d")).select("source_file", "account_id", "_d.*")


def read_source(spark: SparkSession, source: Mapping[str, str] | None) -> DataFrame | None:
    """One source by description: type csv, parquet, json, table or query.  No description, no source."""
    if not source:
        return None
    kind = source.get("type")
    if kind == "csv":
        return read_csv(spark, source["path"], sep=source.get("sep", ","))
    if kind == "parquet":
        return spark.read.parquet(source["path"])
    if kind == "json":
        return read_json(spark, source["path"], multi_line=source.get("multi_line", "false") == "true")
    if kind == "table":
        return spark.table(source["name"])
    if kind == "query":
        return spark.sql(source["sql"])
    raise SourceError(f"unknown source type {kind!r}")


def fold_account_columns(accounts: DataFrame) -> DataFrame:
    """Array columns of accounts as text: salespersons ``name <email>``, potentials ``type:state:prob:value:comment``."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    people = F.transform("salespersons", lambda p: F.concat_ws(" ", p["name"], F.when(p["email"].isNotNull(), F.concat(F.lit("<"), p["email"], F.lit(">")))))
    chances = F.transform(
        "potentials", lambda p: F.concat_ws(":", text(p["type"]), text(p["state"]), text(p["probability"]), text(p["value"]), text(p["comment"]))
    )
    return accounts.withColumns({"salespersons": F.array_join(people, "; "), "potentials": F.array_join(chances, "; ")})


def flatten_products(products: DataFrame, *, record_id: Column, text_columns: Sequence[str]) -> DataFrame:
    """``info.*`` as columns, list columns as counts, texts as ``<code>_<lang>`` columns.

    ``text_columns`` names the wanted texts, so that no pass over the data is needed to find them.
    Repeated texts are joined by a line break, in their order.
    """
    lists = [f.name for f in products.schema if isinstance(f.dataType, T.ArrayType) and f.name != "texts"]
    key = lambda t: F.concat_ws("_", F.lower(F.trim(t["code"])), F.lower(F.trim(t["lang"])))

    def joined(column: str) -> Column:
        mine = F.filter("texts", lambda t: key(t) == column)
        return F.nullif(F.array_join(F.transform(mine, lambda t: t["content"]), "\n"), F.lit(""))

    texts = {c: joined(c) for c in text_columns}
    return products.select(
        record_id.alias("record_id"), "info.*", *[F.coalesce(F.size(c), F.lit(0)).alias(f"{c}_count") for c in lists], *[e.alias(c) for c, e in texts.items()]
    )


def count_values(df: DataFrame, column: str) -> DataFrame:
    """Counts over a full scan; each partition counts on its own first."""
    return df.groupBy(column).agg(F.count("*").alias("row_count"))


SUPPLIER_COLUMNS = (
    "source_file", "match_keys", "product_name", "brand", "gross_weight_kg", "net_weight_kg", "width_cm", "length_cm", "depth_cm", "notes",
)


def supplier_records(lists: Sequence[DataFrame]) -> DataFrame:
    """Supplier lists, each already mapped to the common names, as one table; rows without key or measure go."""
    out = None
    for df in lists:
        part = df.select(*[c for c in SUPPLIER_COLUMNS if c in df.columns])
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    keys = F.filter("match_keys", lambda k: F.coalesce(F.trim(k), F.lit("")) != "")
    measures = F.coalesce(*[F.col(c) for c in ("gross_weight_kg", "net_weight_kg", "width_cm", "length_cm", "depth_cm") if c in out.columns])
    return out.withColumn("match_keys", keys).filter((F.size("match_keys") > 0) & measures.isNotNull())


def promote_first_row(df: DataFrame, order: str, *, share: float = 0.7) -> DataFrame:
    """If most columns are unnamed (``_c0`` style), the first row by ``order`` holds the names."""
    data = [c for c in df.columns if c != order]
    unnamed = [c for c in data if c.startswith("_c") or c.lower().startswith("unnamed") or not c.strip()]
    if len(unnamed) < share * len(data):
        return df
    head = df.orderBy(order).limit(1).collect()
    if not head:
        return df
    names = {c: (str(head[0][c]).strip() if head[0][c] is not None else c) for c in data}
    return df.filter(F.col(order) != head[0][order]).withColumnsRenamed(names)
