"""The catalogue: parcels collapsed to addresses, and lookups by exact key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C


def collapse(parcels: DataFrame) -> DataFrame:
    """A row per address: values of its first parcel (by objectid), median place, numbers of parcels and blocks.

    Blank addresses and addresses without any centroid are left out; doc_id is dense, in the order of
    first parcels. One shuffle by address; the numbering is a window over one row per address, dealt by
    ranges: ranks within ranges plus the ranges' offsets, so no task sees all addresses.
    """
    p = parcels.withColumn("direccion", C.collapsed("direccion")).where("direccion <> ''")
    lon, lat = C.clean_double(F.col("centroid_lon")), C.clean_double(F.col("centroid_lat"))
    docs = p.groupBy("direccion").agg(
        F.min_by("numero_predial_nacional", "objectid").alias("numero_predial_nacional"),
        F.min_by("manzana", "objectid").alias("manzana"),
        F.median(lon).alias("centroid_lon"),
        F.median(lat).alias("centroid_lat"),
        F.count("*").alias("n_predios"),
        F.countDistinct("manzana").alias("manzana_nunique"),
        F.min("objectid").alias("objectid"),
    )
    docs = docs.where("centroid_lon is not null and centroid_lat is not null")
    code = F.col("numero_predial_nacional")
    docs = docs.withColumns({"comuna": F.substring(code, 10, 2), "barrio": F.substring(code, 12, 2), "barrio_code": F.substring(code, 10, 4)})
    return numbered(docs, "objectid", "doc_id")


def running(df: DataFrame, order: Sequence[str], value: Column, name: str) -> DataFrame:
    """The sum of value over all rows before, in the order of columns of distinct values: sums within ranges plus the ranges' offsets, so no task sees all rows."""
    ahead = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    ranged = df.repartitionByRange(*order).withColumn("part_", F.spark_partition_id())
    local = ranged.withColumn("within_", F.coalesce(F.sum(value).over(ahead(Window.partitionBy("part_").orderBy(*order))), F.lit(0)))
    before = ranged.groupBy("part_").agg(F.sum(value).alias("s_")).select("part_", F.coalesce(F.sum("s_").over(ahead(Window.orderBy("part_"))), F.lit(0)).alias("before_"))
    return local.join(F.broadcast(before), "part_").withColumn(name, F.col("before_") + F.col("within_")).drop("part_", "within_", "before_")  # a row per partition


def numbered(df: DataFrame, order: str | Sequence[str], name: str) -> DataFrame:
    """Dense numbers from 0 in the order of columns of distinct values."""
    return running(df, [order] if isinstance(order, str) else order, F.lit(1), name)


def first_by_key(docs: DataFrame, key: str = "key", order: str = "doc_id") -> DataFrame:
    """Of rows with the same key the first one."""
    rest = [c for c in docs.columns if c != key]
    return docs.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("v")).select(key, "v.*")


def exact_match(queries: DataFrame, docs: DataFrame, key: str = "key") -> DataFrame:
    """queries with the first document of the same key, null where none has it."""
    return queries.join(first_by_key(docs, key), key, "left")
