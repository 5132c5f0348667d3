"""Declared schemas and readers for the given tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "pages": "page_id long, url string, html string",
    "benchmark": "item_id long, text string",
    "labels": "doc_id long, quality int, toxic int",
    "conversations": "conv_id long, turn long, role string, text string",
}


def schema_of(name: str) -> T.StructType:
    return T._parse_datatype_string(_SCHEMAS[name])


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Batch reader with a declared schema; no inference, so columns prune at the scan."""
    return spark.read.schema(_SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def stream_table(spark: SparkSession, folder: str, name: str, files_per_batch: int = 64) -> DataFrame:
    """Streaming reader over the same files; a file source needs a folder, so a lone file is picked by name."""
    reader = spark.readStream.schema(_SCHEMAS[name]).option("maxFilesPerTrigger", files_per_batch)
    path = f"{folder}/{name}.parquet"
    if os.path.isfile(path):
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return reader.parquet(path)


def with_timestamp(df: DataFrame, column: str) -> DataFrame:
    """Event times arrive without a zone; the session zone (UTC) is attached here."""
    return df.withColumn(column, F.col(column).cast("timestamp"))
