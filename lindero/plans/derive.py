"""Addresses derived from the supplied tables, by integer arithmetic that every engine evaluates alike.

The test tables hold no addresses, so parcels come from orders, address texts from line items and
polygons from nations. The expressions are plain SQL for Spark and DuckDB both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores: a table of fewer files than cores may be one task otherwise, whatever is computed from its rows."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


_KIND = "CASE {0} % 5 WHEN 0 THEN 'CL' WHEN 1 THEN 'KR' WHEN 2 THEN 'AV' WHEN 3 THEN 'DG' ELSE 'TV' END"
_SPELLED = "CASE {0} % 5 WHEN 0 THEN 'Calle' WHEN 1 THEN 'Cra' WHEN 2 THEN 'AVENIDA' WHEN 3 THEN 'Diag.' ELSE 'Transv' END"

#: Parts of a parcel's address, over orders.
PARTS = {
    "via_type": _KIND.format("o_orderkey"),
    "via_number": "CAST(o_custkey % 10 + 1 AS STRING)",
    "via_letters": "CASE WHEN o_orderkey % 3 = 0 THEN 'A' END",
    "cross_number": "CAST(o_orderkey * 7 % 9 + 1 AS STRING)",
    "plate": "lpad(CAST(o_orderkey * 13 % 20 AS STRING), 2, '0')",
}
_CODE = "concat('7600101', '00', lpad(CAST(o_custkey % 22 + 1 AS STRING), 2, '0'), lpad(CAST(o_custkey % 7 AS STRING), 2, '0'), lpad(CAST(o_orderkey % 50 AS STRING), 4, '0'), lpad(CAST(o_orderkey % 10000 AS STRING), 4, '0'), '000000000')"

PARCELS = {
    "objectid": "o_orderkey",
    "direccion": f"concat({PARTS['via_type']}, ' ', {PARTS['via_number']}, CASE WHEN o_orderkey % 3 = 0 THEN ' A' ELSE '' END, ' #  ', {PARTS['cross_number']}, ' - ', {PARTS['plate']})",
    "numero_predial_nacional": _CODE,
    "manzana": f"substring({_CODE}, 1, 17)",
    "centroid_lon": "CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(o_orderkey % 1000 AS DOUBLE) / 10000 - 76.6 END",
    "centroid_lat": "CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(o_custkey % 1000 AS DOUBLE) / 10000 + 3.3 END",
}

#: An address text of each line item: its order's address in a spelling that the line number chooses.
_RAW = f"""CASE l_linenumber % 5
 WHEN 0 THEN concat({PARTS['via_type']}, ' ', {PARTS['via_number']}, CASE WHEN o_orderkey % 3 = 0 THEN ' A' ELSE '' END, ' # ', {PARTS['cross_number']}, ' - ', {PARTS['plate']})
 WHEN 1 THEN concat({_SPELLED.format('o_orderkey')}, ' ', {PARTS['via_number']}, CASE WHEN o_orderkey % 3 = 0 THEN 'a' ELSE '' END, ' No. ', {PARTS['cross_number']}, '-', {PARTS['plate']})
 WHEN 2 THEN concat({PARTS['via_type']}, {PARTS['via_number']}, CASE WHEN o_orderkey % 3 = 0 THEN 'A' ELSE '' END, '#', {PARTS['cross_number']}, '-', {PARTS['plate']}, ', Cali')
 WHEN 3 THEN concat({PARTS['via_type']}, ' ', {PARTS['via_number']}, ' B # ', {PARTS['cross_number']}, ' - ', CAST(l_partkey % 90 AS STRING))
 ELSE CASE l_suppkey % 4 WHEN 0 THEN '  sin  dirección ' WHEN 1 THEN 'N/A' WHEN 2 THEN '12' ELSE 'casa azul' END END"""

TEXTS = {"row_id": "((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey", "raw": _RAW, "objectid": "o_orderkey", "variant": "l_linenumber % 5", "dataset": "CASE l_suppkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END"}

#: Rectangles and triangles, a comuna and a barrio of each nation: a cell of a five by five grid.
_X, _Y = "(CAST(n_nationkey % 5 AS DOUBLE) / 50 - 76.6)", "(CAST((n_nationkey - n_nationkey % 5) / 5 AS DOUBLE) / 50 + 3.3)"


def _sql(columns: dict[str, str], source: str) -> str:
    return "SELECT " + ", ".join(f"{e} AS {n}" for n, e in columns.items()) + f" FROM {source}"


PARCELS_SQL = _sql(PARCELS, "orders")
TEXTS_SQL = _sql(TEXTS, "lineitem JOIN orders ON l_orderkey = o_orderkey")
BOXES_SQL = f"SELECT n_nationkey AS poly_id, n_name AS name, {_X} AS x0, {_Y} AS y0, {_X} + CAST(1 AS DOUBLE) / 50 AS x1, {_Y} + CAST(1 AS DOUBLE) / 50 AS y1, n_nationkey % 3 AS shape FROM nation"


def parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "orders").selectExpr(*[f"{e} AS {n}" for n, e in PARCELS.items()])


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "orders").selectExpr("o_orderkey AS objectid", *[f"{e} AS {n}" for n, e in PARTS.items()])


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order has at most seven line items, and each line item one order."""
    joined = spread(view(spark, sf_dir, "lineitem")).join(view(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.selectExpr(*[f"{e} AS {n}" for n, e in TEXTS.items()])


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """poly_id, name, rings: rectangles, and for every third nation a triangle."""
    b = view(spark, sf_dir, "nation").selectExpr("n_nationkey AS poly_id", "n_name AS name", f"{_X} AS x0", f"{_Y} AS y0", f"{_X} + CAST(1 AS DOUBLE) / 50 AS x1", f"{_Y} + CAST(1 AS DOUBLE) / 50 AS y1", "n_nationkey % 3 AS shape")
    p = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    box = F.array(p("x0", "y0"), p("x1", "y0"), p("x1", "y1"), p("x0", "y1"))
    tri = F.array(p("x0", "y0"), p("x1", "y0"), p("x0", "y1"))
    return b.select("poly_id", "name", F.array(F.when(F.col("shape") == 0, tri).otherwise(box)).alias("rings"))
