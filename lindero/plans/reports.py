"""Queries of calibration, evaluation and truth, with their SQL. They add themselves to the catalogue's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import augment, decision, evaluation, geo, reliability, splits
from . import derive
from .catalogue import _CANON, _FLAGS, _LADDER, _PAIRS, _POINTS, _SCORES, _TOPK, BOXES, DOCS, KEY, PARCELS, TEXTS, _decided, _flagged, _pairs, _plain, _points, _scores, _vectors, dec, docs, query
from .derive import view

# ---- calibration ---------------------------------------------------------------------------------

_MATCHES = "matches AS (SELECT l_orderkey * 10 + l_linenumber AS row_id, l_discount * 10 AS confidence, (l_quantity % 10) / 10 AS struct, l_suppkey % 9 = 0 AS relaxed_letter, l_suppkey % 11 = 0 AS relaxed_plate, l_linenumber AS n_predios, CASE l_partkey % 5 WHEN 0 THEN 'predio' WHEN 1 THEN 'esquina' WHEN 2 THEN 'via' WHEN 3 THEN 'manzana' ELSE 'direccion' END AS nivel_precision, l_suppkey % 4 = 0 AS gate_applied, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_tax * 5 END AS margen_manzana, CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE l_tax END AS margen_predio, CAST(l_quantity AS INT) % 8 AS n_competidores, l_returnflag AS flag FROM lineitem)"
_KIND = "CASE WHEN relaxed_letter OR relaxed_plate THEN 'relajada' WHEN nivel_precision IN ('esquina', 'via') THEN 'parcial' WHEN nivel_precision IN ('manzana', 'direccion') THEN 'compartida' ELSE 'exacto' END"
_CLIPPED = "coalesce(greatest(0, least(0.3::DOUBLE, margen_manzana)), 0.3::DOUBLE)"
_BAND = f"CASE WHEN {_CLIPPED} >= 0.1 THEN 'holgado' WHEN {_CLIPPED} >= 0.05 THEN '0.05-0.10' WHEN {_CLIPPED} >= 0.02 THEN '0.02-0.05' ELSE '<0.02' END"


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = _MATCHES.removeprefix("matches AS (SELECT ").removesuffix(" FROM lineitem)")
    parts, depth, at = [], 0, 0
    for k, ch in enumerate(sql):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth:
            parts.append(sql[at:k])
            at = k + 1
    return view(spark, sf_dir, "lineitem").selectExpr(*parts, sql[at:])


@query(f"WITH {_MATCHES} SELECT row_id, CAST(confidence AS DECIMAL(18,6)) AS confidence, CAST(struct AS DECIMAL(18,6)) AS struct, relaxed_letter::INT::DECIMAL(18,6) AS relaxed_letter, relaxed_plate::INT::DECIMAL(18,6) AS relaxed_plate, CAST(ln(greatest(1, n_predios)) AS DECIMAL(18,6)) AS log_n_predios, " + ", ".join(f"(nivel_precision = '{x}')::INT::DECIMAL(18,6) AS nivel_{x}" for x in reliability.LEVELS) + f", gate_applied::INT::DECIMAL(18,6) AS gate_applied, CAST({_CLIPPED} AS DECIMAL(18,6)) AS margen_manzana, CAST(coalesce(greatest(0, least(0.3::DOUBLE, margen_predio)), 0.3::DOUBLE) AS DECIMAL(18,6)) AS margen_predio, CAST(least(5, n_competidores) AS DECIMAL(18,6)) AS n_competidores, {_KIND} AS kind, {_BAND} AS band FROM matches")
def calibration_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = reliability.features(_matches(spark, sf_dir))
    return f.select("row_id", *[dec(F.col("features")[n], n) for n in reliability.FEATURES], reliability.kind(F.col("features")).alias("kind"), reliability.band(F.col("features.margen_manzana")).alias("band"))


_CELLS, _KINDS, _ALL = [("exacto", "holgado", 0.9, 0.95), ("exacto", "<0.02", 0.2, 0.6), ("relajada", "0.05-0.10", 0.5, 0.4), ("parcial", "holgado", 0.0, 0.9995)], [("exacto", 0.7, 0.8), ("compartida", 0.3, 0.7)], (0.45, 0.66)


@query(f"WITH {_MATCHES}, m AS (SELECT row_id, {_KIND} AS kind, {_BAND} AS band FROM matches), c(kind, band, p, b) AS (VALUES {', '.join(map(str, _CELLS))}), k(kind, p, b) AS (VALUES {', '.join(map(str, _KINDS))}), r AS (SELECT row_id, m.kind, m.band, least(0.999, greatest(0.001, coalesce(c.p, k.p, {_ALL[0]}))) AS p, least(0.999, greatest(0.001, coalesce(c.b, k.b, {_ALL[1]}))) AS b FROM m LEFT JOIN c ON m.kind = c.kind AND m.band = c.band LEFT JOIN k ON m.kind = k.kind) SELECT row_id, kind, band, CAST(p AS DECIMAL(18,6)) AS p_predio, CAST(greatest(p, b) AS DECIMAL(18,6)) AS p_manzana FROM r")
def reliability_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = reliability.features(_matches(spark, sf_dir))
    rows = f.select("row_id", reliability.kind(F.col("features")).alias("kind"), reliability.band(F.col("features.margen_manzana")).alias("band"))
    cells = spark.createDataFrame(_CELLS, "kind string, band string, predio double, manzana double")
    found = reliability.cell_rates(rows, cells, spark.createDataFrame(_KINDS, "kind string, predio double, manzana double"), _ALL)
    return found.select("row_id", "kind", "band", dec("p_predio"), dec("p_manzana"))


@query(f"WITH {_MATCHES}, m AS (SELECT {_KIND} AS kind, row_id % 3 <> 0 AS cm, row_id % 2 = 0 AS cp FROM matches), g AS (SELECT avg(cp::INT) AS q FROM m WHERE cm), k(kind) AS (VALUES ('exacto'), ('relajada'), ('compartida'), ('parcial')), p AS (SELECT kind, count(*) AS n, count(*) FILTER (WHERE cp) AS h FROM m WHERE cm GROUP BY 1) SELECT k.kind, coalesce(n, 0) AS n, coalesce(h, 0) AS hits, CAST((coalesce(h, 0) + 20 * q) / (coalesce(n, 0) + 20) AS DECIMAL(18,6)) AS q, CAST(q AS DECIMAL(18,6)) AS q_global FROM k LEFT JOIN p USING (kind), g")
def parcel_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = reliability.features(_matches(spark, sf_dir)).select(reliability.kind(F.col("features")).alias("kind"), (F.col("row_id") % 3 != 0).alias("correct_manzana"), (F.col("row_id") % 2 == 0).alias("correct_predial"))
    return reliability.parcel_rates(f, 20.0).select("kind", "n", "hits", dec("q"), dec("q_global"))


@query(f"WITH {_SCORES}, b AS (SELECT *, ntile(5) OVER (ORDER BY p, id) AS bin FROM sc) SELECT CAST(bin AS INT) AS bin, count(*) AS n, CAST(avg(p) AS DECIMAL(18,6)) AS mean_pred, CAST(avg(correct::INT) AS DECIMAL(18,6)) AS observed, CAST(min(p) AS DECIMAL(18,6)) AS least, CAST(max(p) AS DECIMAL(18,6)) AS most FROM b GROUP BY 1")
def reliability_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reliability.bin_table(_scores(spark, sf_dir)).select("bin", "n", *[dec(c) for c in ("mean_pred", "observed", "least", "most")])


@query(f"WITH {_MATCHES} SELECT count(*) AS n, count(*) FILTER (WHERE flag <> 'N') AS n_truth FROM matches WHERE row_id % 5 <> 0 AND flag <> 'N'")
def calibration_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = reliability.features(_matches(spark, sf_dir)).withColumns({"estado": F.when(F.col("row_id") % 5 == 0, "SIN_MATCH").otherwise("OK"), "has_gt": F.col("flag") != "N"})
    return reliability.usable(f).agg(F.count("*").alias("n"), F.count_if("has_gt").alias("n_truth"))


# ---- evaluation ----------------------------------------------------------------------------------


@query(f"WITH {_TOPK}, i AS (SELECT row_id, CASE WHEN row_id % 30 = 0 THEN NULL ELSE row_id + 1 END AS gt, list(doc_id ORDER BY slot) AS ids FROM r WHERE slot <= 10 GROUP BY row_id) SELECT count(*) AS n, " + ", ".join(f"CAST(avg(list_contains(list_slice(ids, 1, {k}), gt)::INT) AS DECIMAL(18,6)) AS recall_{k}" for k in (1, 5, 10)) + " FROM i WHERE gt IS NOT NULL")
def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.transform(F.array_sort(F.collect_list(F.struct("slot", "doc_id"))), lambda x: x["doc_id"])
    top = _vectors(spark, sf_dir, 10).groupBy("row_id").agg(ids.alias("ids")).withColumn("gt", F.when(F.col("row_id") % 30 != 0, F.col("row_id") + 1))
    return evaluation.recall_at(top, (1, 5, 10)).select("n", *[dec(f"recall_{k}") for k in (1, 5, 10)])


@query(f"WITH {_LADDER}, f AS (SELECT row_id, CASE WHEN row_id % 23 = 0 THEN 'ERROR' ELSE estado END AS estado, CASE WHEN estado = 'OK' AND row_id % 23 <> 0 THEN CASE WHEN row_id % 2 = 0 THEN 'predio' ELSE 'esquina' END END AS level FROM e), bad AS (SELECT string_agg('fallo ' || row_id, ',' ORDER BY row_id) AS errors FROM (SELECT row_id FROM f WHERE estado = 'ERROR' ORDER BY row_id LIMIT 5)) SELECT estado, coalesce(level, '(vacio)') AS nivel_precision, count(*) AS n, CASE WHEN estado = 'ERROR' THEN any_value(errors) ELSE '' END AS errors FROM f, bad GROUP BY 1, 2")
def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.col("row_id") % 23 == 0
    rows = _decided(spark, sf_dir).withColumns({"estado": F.when(bad, "ERROR").otherwise(F.col("estado")), "nivel_precision": F.when(~bad, F.col("nivel_precision")), "motivo": F.when(bad, F.concat(F.lit("fallo "), "row_id")).otherwise(F.col("motivo"))})
    return evaluation.run_totals(rows).withColumn("errors", F.array_join("errors", ","))


_GEO = "geo AS (SELECT c_custkey AS id, c_mktsegment AS dataset, CASE WHEN c_custkey % 6 = 0 THEN '' ELSE 'CL ' || (c_custkey % 9) || ' # 1 - 0' || (c_custkey % 3) END AS canonical, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN 'CL' || (c_custkey % 9) || '#1-0' || (c_custkey % 3) ELSE 'CL ' || (c_custkey % 9) || ' # 1 - 0' || (c_custkey % 2) END AS other, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 3.4::DOUBLE + c_custkey % 50 / 10000.0::DOUBLE END AS lat, -76.5::DOUBLE AS lon, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 3.4::DOUBLE + c_custkey % 47 / 10000.0::DOUBLE END AS other_lat, -76.5::DOUBLE AS other_lon, c_acctbal > 0 AS matched, c_nationkey % 3 <> 0 AS has_gt, CASE c_nationkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'A' ELSE 'B' END AS other_class FROM customer)"
_APART = "2 * 6371008.8::DOUBLE * asin(sqrt(pow(sin(radians(lat - other_lat) / 2), 2)))"


def _geocoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    text = lambda m: F.concat(F.lit("CL "), k % 9, F.lit(" # 1 - 0"), k % m)
    place = lambda m: F.lit(3.4) + (k % m) / F.lit(10000.0)
    return view(spark, sf_dir, "customer").select(
        k.alias("id"), F.col("c_mktsegment").alias("dataset"), F.when(k % 6 == 0, "").otherwise(text(3)).alias("canonical"),
        F.when(k % 5 == 0, None).when(k % 7 == 0, F.regexp_replace(text(3), " ", "")).otherwise(text(2)).alias("other"),
        F.when(k % 4 != 0, place(50)).alias("lat"), F.lit(-76.5).alias("lon"), F.when(k % 5 != 0, place(47)).alias("other_lat"), F.lit(-76.5).alias("other_lon"),
        (F.col("c_acctbal") > 0).alias("matched"), (n % 3 != 0).alias("has_gt"), F.when(n % 4 == 1, "A").when(n % 4 != 0, "B").alias("other_class"),
    )


@query(f"WITH {_GEO}, d AS (SELECT *, CASE WHEN lat IS NOT NULL AND other_lat IS NOT NULL THEN {_APART} END AS d, {KEY.format('canonical')} AS ka, {KEY.format('other')} AS kb FROM geo), t AS (SELECT dataset, count(*) AS n, avg((other IS NOT NULL)::INT) AS answered, avg((coalesce(other, '') <> '')::INT) AS normalized, avg((other_lat IS NOT NULL)::INT) AS located, avg(matched::INT) AS matched, avg((canonical <> '' AND canonical IS NOT DISTINCT FROM other)::INT) AS exact, avg((canonical <> '' AND ka IS NOT DISTINCT FROM kb)::INT) AS same_key, count(d) AS both_located, median(d) AS median_m, avg((d <= 50)::INT) AS within_50, avg((d <= 100)::INT) AS within_100 FROM d GROUP BY 1) SELECT dataset, n, both_located, " + ", ".join(f"CAST({c} AS DECIMAL(18,4)) AS {c}" for c in ("answered", "normalized", "located", "matched", "exact", "same_key", "median_m", "within_50", "within_100")) + " FROM t")
def external_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluation.external_agreement(_geocoded(spark, sf_dir))
    return found.select("dataset", "n", "both_located", *[F.col(c).cast("decimal(18,4)").alias(c) for c in ("answered", "normalized", "located", "matched", "exact", "same_key", "median_m", "within_50", "within_100")])


@query(f"WITH {_GEO} SELECT coalesce(other_class, '(no answer)') AS other_class, count(*) AS n, CAST(avg((id % 2)::INT) AS DECIMAL(18,6)) AS top1, CAST(avg((id % 3 <> 0)::INT) AS DECIMAL(18,6)) AS top5, CAST(avg((id % 5 <> 0)::INT) AS DECIMAL(18,6)) AS manzana, CAST(median(id % 97) AS DECIMAL(18,6)) AS median_m, CAST(avg(id % 11 / 10.0::DOUBLE) AS DECIMAL(18,6)) AS confidence FROM geo WHERE has_gt GROUP BY 1")
def accuracy_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("id")
    rows = _geocoded(spark, sf_dir).withColumns({"top1": k % 2 == 1, "top5": k % 3 != 0, "correct_manzana": k % 5 != 0, "dist_m": (k % 97).cast("double"), "confidence": (k % 11) / F.lit(10.0)})
    return evaluation.accuracy_by_class(rows).select("other_class", "n", *[dec(c) for c in ("top1", "top5", "manzana", "median_m", "confidence")])


@query(f"WITH {_GEO}, d AS (SELECT *, CASE WHEN lat IS NOT NULL AND other_lat IS NOT NULL THEN {_APART} END AS d FROM geo WHERE has_gt) SELECT coalesce(other_class, '(no answer)') AS other_class, count(*) AS n, CAST(avg(({KEY.format('canonical')} = {KEY.format(chr(99) + 'oalesce(other, ' + chr(39) * 2 + ')')})::INT) AS DECIMAL(18,6)) AS same_address, count(d) AS n_points, CAST(median(d) AS DECIMAL(18,4)) AS median_m, CAST(quantile_cont(d, 0.9) AS DECIMAL(18,4)) AS p90_m, CAST(avg((d <= 25)::INT) AS DECIMAL(18,6)) AS within_25 FROM d GROUP BY 1")
def reference_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _geocoded(spark, sf_dir).withColumns({"gt_address": F.col("canonical"), "gt_lat": F.col("lat"), "gt_lon": F.col("lon")})
    found = evaluation.reference_quality(rows)
    return found.select("other_class", "n", dec("same_address"), "n_points", *[F.col(c).cast("decimal(18,4)").alias(c) for c in ("median_m", "p90_m")], dec("within_25"))


_AGREE = ("via_type", "via_number", "via_letters", "cross_number", "plate")


@query(f"WITH {_PAIRS} SELECT CAST(row_id % 3 AS INT) AS dataset, count(*) AS n, CAST(1 AS DECIMAL(18,6)) AS both_parse_ok, " + ", ".join(f"CAST(avg(({c} IS NOT DISTINCT FROM o_{c})::INT) AS DECIMAL(18,6)) AS {c}" for c in _AGREE) + " FROM pairs GROUP BY 1")
def field_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pairs(spark, sf_dir).withColumn("dataset", (F.col("row_id") % 3).cast("int"))
    return evaluation.field_agreement(rows, F.col("q"), F.col("c")).select("dataset", "n", dec("both_parse_ok"), *[dec(c) for c in _AGREE])


_EDGES = [0, 25, 50, 100, 250]


@query(f"WITH {_SCORES}, x AS (SELECT p * 300 AS d FROM sc) SELECT CAST(CASE {' '.join(f'WHEN d <= {e} THEN {i}' for i, e in enumerate(_EDGES))} ELSE {len(_EDGES)} END AS INT) AS bucket, count(*) AS n, CAST(min(d) AS DECIMAL(18,6)) AS least, CAST(max(d) AS DECIMAL(18,6)) AS most FROM x GROUP BY 1")
def distance_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scores(spark, sf_dir).withColumn("dist_m", F.col("p") * 300)
    return evaluation.distance_buckets(rows, _EDGES).select("bucket", "n", dec("least"), dec("most"))


_FAMILY = "x AS (SELECT row_id, raw, variant, CASE row_id % 7 WHEN 0 THEN 'CL 5' WHEN 1 THEN 'CL 5 # 1 - 02 AP 3' ELSE 'CL 5 # 1 - 02' END AS canonical, CAST(row_id % 4 AS VARCHAR) AS comuna, CASE WHEN row_id % 9 = 0 THEN NULL ELSE CAST(row_id % 5 AS VARCHAR) END AS gt, CASE WHEN row_id % 3 <> 0 THEN row_id % 400 END AS d FROM texts)"


@query(f"WITH {TEXTS}, {_FAMILY} SELECT row_id, CASE WHEN variant = 4 THEN CASE WHEN raw LIKE '%12%' THEN 'unparseable: no address content' ELSE 'unparseable: free text / non-address' END WHEN row_id % 7 = 1 THEN 'condominium / lote complement' WHEN row_id % 7 = 0 THEN 'missing cross number' WHEN gt IS NOT NULL AND gt <> comuna THEN 'wrong comuna (geographic confusion)' WHEN d <= 150 THEN 'near miss: neighbouring parcel' ELSE 'other: letter/number mismatch' END AS family FROM x")
def failure_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, raw = F.col("row_id"), F.col("raw")
    canonical = F.when(r % 7 == 0, "CL 5").when(r % 7 == 1, "CL 5 # 1 - 02 AP 3").otherwise("CL 5 # 1 - 02")
    notes = F.when(raw.contains("12"), "no_alphabetic_content").otherwise("implicit_hash")
    family = evaluation.failure_family(raw, F.col("variant") != 4, notes, canonical, (r % 4).cast("string"), F.when(r % 9 != 0, (r % 5).cast("string")), F.when(r % 3 != 0, r % 400))
    return derive.texts(spark, sf_dir).select("row_id", family.alias("family"))


@query(f"WITH {_LADDER}, {_FLAGS}, o AS (SELECT * FROM f WHERE estado = 'OK') SELECT row_id, mm IS NOT NULL AND mm < 0.05 AS abstains FROM o")
def ambiguity_abstain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A smaller margin than delta abstains; a missing one never does."""
    rows = _flagged(spark, sf_dir).where("estado = 'OK'").drop("estado", "motivo", "nivel_precision")
    return decision.decided(rows, 0.0, delta=0.05).select("row_id", F.coalesce(F.col("motivo").startswith("ambiguo"), F.lit(False)).alias("abstains"))


# ---- truth, space and splits ---------------------------------------------------------------------


@query(f"WITH {_PAIRS}, x AS (SELECT *, objectid % 10 = 0 AS none FROM pairs) SELECT row_id, CASE WHEN none THEN 'no_gt' WHEN via_type = o_via_type AND via_letters IS NOT DISTINCT FROM o_via_letters AND cross_number = o_cross_number AND ltrim(plate, '0') = ltrim(o_plate, '0') THEN 'gold' ELSE 'noisy' END AS gt_quality FROM x")
def label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = lambda c: c.withField("via_suffix", F.lit(None).cast("string")).withField("cross_suffix", F.lit(None).cast("string"))
    rows = _pairs(spark, sf_dir).select("row_id", whole(F.col("q")).alias("q"), F.when(F.expr("row_id div 10 % 10 <> 0"), whole(F.col("c"))).alias("c"))
    return splits.label_quality(rows, F.col("q"), F.col("c")).select("row_id", "gt_quality")


@query(f"WITH {TEXTS}, p AS (SELECT row_id, raw, variant, {_plain('raw')} AS t FROM texts), q AS (SELECT *, {_CANON} AS c FROM p) SELECT row_id, {KEY.format('c')} AS key FROM q WHERE variant IN (0, 3)")
def address_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the derived texts in a form that the fast path reads, which SQL can follow."""
    return derive.texts(spark, sf_dir).where("variant in (0, 3)").select("row_id", C.address_key("raw").alias("key"))


@query("WITH t AS (SELECT DISTINCT md5(text) AS k, source AS s FROM documents WHERE text IS NOT NULL) SELECT count(DISTINCT a.k) AS n FROM t a JOIN t b ON a.k = b.k AND a.s < b.s WHERE a.s = 'src0' AND b.s = 'src1'")
def split_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = view(spark, sf_dir, "documents").where("text is not null").select(F.md5("text").alias("k"), "source")
    m = splits.overlap_matrix({"train": d.where("source = 'src0'"), "dev": d.where("source = 'src1'")}, "k")
    return m.where("a = 'train' and b = 'dev'").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


@query(f"WITH {PARCELS}, p AS (SELECT objectid AS doc_id, manzana FROM parcels), o AS (SELECT *, row_number() OVER (PARTITION BY manzana ORDER BY md5(doc_id || '|3'), doc_id) AS at, count(*) OVER (PARTITION BY manzana) AS size FROM p), s(slot) AS (VALUES (0), (1)) SELECT a.doc_id, slot, b.doc_id AS neg_doc_id FROM o a, s JOIN o b ON a.manzana = b.manzana AND b.at = (a.at - 1 + slot % (a.size - 1) + 1) % a.size + 1 WHERE a.size > 1")
def same_block_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.same_block_pairs(derive.parcels(spark, sf_dir).select(F.col("objectid").alias("doc_id"), "manzana"), 3)


_SPOTS = "spots AS (SELECT s_suppkey AS id, (s_suppkey * 37 % 1009)::DOUBLE AS x, (s_suppkey * 91 % 997)::DOUBLE AS y FROM supplier)"


@query(f"WITH {_SPOTS}, d AS (SELECT a.id, min(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) AS d FROM spots a JOIN spots b ON a.id <> b.id GROUP BY 1) SELECT count(*) AS n, CAST(quantile_cont(d, 0.25) AS DECIMAL(18,6)) AS p25, CAST(median(d) AS DECIMAL(18,6)) AS median, CAST(quantile_cont(d, 0.75) AS DECIMAL(18,6)) AS p75 FROM d")
def nn_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    spots = view(spark, sf_dir, "supplier").select(k.alias("id"), (k * 37 % 1009).cast("double").alias("x"), (k * 91 % 997).cast("double").alias("y"))
    return geo.spacing(spots, 50.0).select("n", dec("p25"), dec("median"), dec("p75"))


_NEAR = "greatest(x0 - lon, 0, lon - x1) AS dx, greatest(y0 - lat, 0, lat - y1) AS dy"


@query(f"WITH {_POINTS}, {BOXES}, b AS (SELECT * FROM boxes WHERE shape <> 0), n AS (SELECT point_id, poly_id, {_NEAR} FROM pts, b) SELECT point_id, poly_id FROM n WHERE sqrt(dx * dx + dy * dy) <= 123.4::DOUBLE / 111000")
def buffered_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = derive.polygons(spark, sf_dir).where("poly_id % 3 <> 0")
    return geo.within_buffer(_points(spark, sf_dir), boxes, 0.01, 123.4).select("point_id", "poly_id")


@query(f"WITH {DOCS}, pts AS (SELECT objectid AS row_id, centroid_lon AS lon, centroid_lat + 0.00003::DOUBLE AS lat FROM parcels WHERE centroid_lon IS NOT NULL), {BOXES}, hit AS (SELECT row_id, min(poly_id) AS gt_parcel FROM pts, boxes WHERE lon > x0 AND lat > y0 AND lat < y1 AND lon < x1 AND (shape <> 0 OR lon < (x0 - x1) * (lat - y0) / (y1 - y0) + x1) GROUP BY 1), a AS (SELECT doc_id % 25 AS poly_id, min_by(direccion, doc_id) AS gt_address FROM numbered GROUP BY 1), f AS (SELECT direccion, min(doc_id) AS gt_doc_id FROM numbered GROUP BY 1) SELECT pts.row_id, gt_parcel, gt_address, gt_doc_id FROM pts LEFT JOIN hit USING (row_id) LEFT JOIN a ON gt_parcel = poly_id LEFT JOIN f ON gt_address = direccion")
def truth_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir)
    samples = _points(spark, sf_dir).select(F.col("point_id").alias("row_id"), "lon", (F.col("lat") + F.lit(0.00003)).alias("lat"))
    parcels = d.groupBy((F.col("doc_id") % 25).alias("poly_id")).agg(F.concat(F.lit("  "), F.replace(F.min_by("direccion", "doc_id"), F.lit(" "), F.lit("   "))).alias("direccion"))
    return geo.with_truth(samples, parcels, d.select("doc_id", "direccion"), derive.polygons(spark, sf_dir), 0.01).select("row_id", "gt_parcel", "gt_address", "gt_doc_id")


@query("SELECT n_nationkey, coalesce(CASE WHEN n_nationkey % 3 = 0 THEN n_name END, CASE WHEN n_nationkey % 4 = 0 THEN 'told' END, 'Comuna ' || n_regionkey) AS zone FROM nation")
def zone_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    return view(spark, sf_dir, "nation").select("n_nationkey", C.zone_of(F.when(k % 3 == 0, F.col("n_name")), F.when(k % 4 == 0, "told").otherwise(" "), F.concat(F.lit("Comuna "), "n_regionkey")).alias("zone"))


@query(f"WITH {TEXTS}, p AS (SELECT row_id, {_plain('raw')} AS t FROM texts), q AS (SELECT *, {_CANON} AS c FROM p) SELECT row_id, left(coalesce(nullif(c, ''), t), 12) AS sought FROM q")
def query_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = C.once(derive.texts(spark, sf_dir), "c", C.canonical_fast(F.col("raw")))
    return t.select("row_id", C.query_text(F.col("c"), F.col("raw"), 12).alias("sought"))


_RATIO = lambda p: f"(SELECT avg(regexp_matches(coalesce(text, ''), '{p}')::INT) FROM documents WHERE lang = 'en') AS a, (SELECT avg(regexp_matches(coalesce(text, ''), '{p}')::INT) FROM documents WHERE lang <> 'en') AS b"


@query("SELECT name, CAST(greatest(0.25, least(4.0, (a + 0.01) / (b + 0.01))) AS DECIMAL(18,6)) AS ratio FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS name, {_RATIO(p)}" for n, p in (("has_dash", "-"), ("has_hash", "#"), ("has_lowercase", "[a-z]"))) + ")")
def op_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, names = view(spark, sf_dir, "documents"), ("has_dash", "has_hash", "has_lowercase")
    made = augment.frequencies(d.where("lang <> 'en'"), "text").select(*[F.col(n).alias("m_" + n) for n in names])
    both = augment.frequencies(d.where("lang = 'en'"), "text").select(*names).join(F.broadcast(made), F.lit(True))  # one row each
    return both.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), augment.scale(F.col(n), F.col("m_" + n)).alias("r")) for n in names])).alias("x")).select("x.name", dec("x.r", "ratio"))


_SYMBOLS = C.SYMBOLS.replace("'", "''")


@query(f"WITH {TEXTS}, u AS (SELECT row_id, left(upper(strip_accents(raw)), 48) AS t FROM texts WHERE raw IS NOT NULL) SELECT row_id, array_to_string(list_transform(range(1, 49), lambda i: CASE WHEN i > length(t) THEN 0 WHEN position(substr(t, CAST(i AS INT), 1) IN '{_SYMBOLS}') > 0 THEN position(substr(t, CAST(i AS INT), 1) IN '{_SYMBOLS}') + 1 ELSE 1 END), ',') AS codes FROM u")
def char_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.texts(spark, sf_dir).where("raw is not null").select("row_id", F.array_join(C.char_codes(F.upper(C.fold(F.col("raw")))).cast("array<string>"), ",").alias("codes"))


@query("SELECT CAST(l_quantity AS DOUBLE) AS x, count(*) AS n, CAST(sum(count(*)) OVER (ORDER BY CAST(l_quantity AS DOUBLE)) / sum(count(*)) OVER () AS DECIMAL(18,6)) AS share FROM lineitem WHERE l_quantity IS NOT NULL GROUP BY 1")
def empirical_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.empirical_cdf(view(spark, sf_dir, "lineitem"), "l_quantity").select("x", "n", dec("share"))


_PLACES = "c AS (SELECT l_orderkey AS row_id, l_discount::DOUBLE AS score, CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE -76.5::DOUBLE + l_partkey % 100 / 1000.0::DOUBLE END AS lon, 3.4::DOUBLE + l_suppkey % 100 / 1000.0::DOUBLE AS lat FROM lineitem)"


@query(f"WITH {_PLACES}, s AS (SELECT row_id, sum(score) FILTER (WHERE score > 0 AND lon IS NOT NULL) AS w, sum(score * lon) FILTER (WHERE score > 0 AND lon IS NOT NULL) AS x, sum(score * lat) FILTER (WHERE score > 0 AND lon IS NOT NULL) AS y FROM c GROUP BY 1) SELECT row_id, CAST(x / w AS DECIMAL(18,9)) AS lon, CAST(y / w AS DECIMAL(18,9)) AS lat FROM s")
def predicted_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query's place from its candidates, in place of a trained head. Each order has at most seven line items."""
    score, lon, lat = F.col("l_discount").cast("double"), F.when(F.col("l_linenumber") % 5 != 0, F.lit(-76.5) + (F.col("l_partkey") % 100) / F.lit(1000.0)), F.lit(3.4) + (F.col("l_suppkey") % 100) / F.lit(1000.0)
    found = view(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("row_id")).agg(F.collect_list(F.struct(score.alias("score"), lon.alias("lon"), lat.alias("lat"))).alias("c"))
    place = found.select("row_id", C.weighted_place(F.col("c")).alias("p"))
    return place.select("row_id", *[F.col("p")[n].cast("decimal(18,9)").alias(n) for n in ("lon", "lat")])


@query(r"SELECT doc_id, left(trim(regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]+', ' ', 'g'), ' '), 200) || CASE WHEN length(trim(regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ')) > 200 THEN '...' ELSE '' END AS message FROM documents")
def short_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "documents").select("doc_id", C.short_message(F.col("text")).alias("message"))
