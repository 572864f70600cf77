"""All queries of the address engine by name, with their SQL for DuckDB.

Each query reads its whole tables and applies the library's operators; the SQL is written on its own,
from the same derived inputs. Computed fractions are compared as decimals of six places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import places
from ..operators import augment, catalogue, decision, evaluation, geo, retrieval, splits
from . import derive
from .derive import view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query by its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def dec(c: str | Column, name: str | None = None):
    col = F.col(c) if isinstance(c, str) else c
    return col.cast("decimal(18,6)").alias(name or c)


# ---- shared SQL ---------------------------------------------------------------------------------

PARCELS, TEXTS, BOXES = f"parcels AS ({derive.PARCELS_SQL})", f"texts AS ({derive.TEXTS_SQL})", f"boxes AS ({derive.BOXES_SQL})"
_DOCS = r"""c AS (SELECT *, trim(regexp_replace(direccion, '\s+', ' ', 'g')) AS d FROM parcels),
docs AS (SELECT d AS direccion, min_by(numero_predial_nacional, objectid) AS numero_predial_nacional, min_by(manzana, objectid) AS manzana,
 median(centroid_lon) AS centroid_lon, median(centroid_lat) AS centroid_lat, count(*) AS n_predios, count(DISTINCT manzana) AS manzana_nunique, min(objectid) AS objectid
 FROM c WHERE d <> '' GROUP BY d HAVING median(centroid_lon) IS NOT NULL AND median(centroid_lat) IS NOT NULL)"""
DOCS = f"{PARCELS}, {_DOCS}, numbered AS (SELECT *, row_number() OVER (ORDER BY objectid) - 1 AS doc_id FROM docs)"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.collapse(derive.parcels(spark, sf_dir))


def _plain(x: str) -> str:
    """SQL of clean() for the derived texts: RE2 has no look-around, so captures stand in."""
    steps = [("[_]", "-"), (r"\bNRO?S?\.?\s*(\d|#)", r" # \1"), (r"\bNUMERO?S?\.?\s*(\d|#)", r" # \1"), (r"\bNUM\.?\s*(\d|#)", r" # \1"), (r"\bNO?\s*\.\s*(\d)", r" # \1"), (r"\bNO\s+(\d)", r" # \1"),
             (r"(\d)(RA|RO|TA|TO|DA|DO|MA|MO|NA|ER|ERA|VA|VO)\b", r"\1 "), ("#+", " # "), ("-{2,}", "-"), ("/", " "), (r"[^A-Z0-9_#\-;,. ]+", " "), (r"\s*-\s*", " - "), (r"\s+", " ")]
    out = f"upper(strip_accents({x}))"
    for p, to in steps:
        out = f"regexp_replace({out}, '{p}', '{to}', 'g')"
    return f"trim({out})"


KEY = "regexp_replace(upper(strip_accents({0})), '[^A-Z0-9]', '', 'g')"


# ---- text ---------------------------------------------------------------------------------------


@query(f"WITH {DOCS} SELECT direccion, numero_predial_nacional, manzana, substring(numero_predial_nacional, 10, 2) AS comuna, substring(numero_predial_nacional, 12, 2) AS barrio, substring(numero_predial_nacional, 10, 4) AS barrio_code, CAST(centroid_lon AS DECIMAL(18,6)) AS centroid_lon, CAST(centroid_lat AS DECIMAL(18,6)) AS centroid_lat, n_predios, manzana_nunique, objectid, doc_id FROM numbered")
def catalog_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir)
    return d.select("direccion", "numero_predial_nacional", "manzana", "comuna", "barrio", "barrio_code", dec("centroid_lon"), dec("centroid_lat"), "n_predios", "manzana_nunique", "objectid", "doc_id")


@query(f"WITH {TEXTS} SELECT row_id, {_plain('raw')} AS cleaned FROM texts")
def prenormalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.texts(spark, sf_dir).select("row_id", C.clean(F.col("raw")).alias("cleaned"))


@query(f"WITH {TEXTS} SELECT row_id, {KEY.format('raw')} AS match_key FROM texts")
def match_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.texts(spark, sf_dir).select("row_id", C.match_key(F.col("raw")).alias("match_key"))


_FAST = r"^(CL|KR|AV|AC|AK|DG|TV|PJ|PS|CV|AU|CT) 0*(\d{1,4})( ([A-Z]))? # 0*(\d{1,4})( ([A-Z]))? - (\d{1,6})$"
_PART = lambda k: f"regexp_extract(t, '{_FAST}', {k})"
_CANON = f"CASE WHEN regexp_matches(t, '{_FAST}') THEN concat_ws(' ', {_PART(1)}, {_PART(2)}, nullif({_PART(4)}, ''), '#', {_PART(5)}, nullif({_PART(7)}, ''), '-', CASE WHEN length({_PART(8)}) < 2 THEN lpad({_PART(8)}, 2, '0') ELSE {_PART(8)} END) END"


@query(f"WITH {TEXTS}, p AS (SELECT row_id, {_plain('raw')} AS t FROM texts) SELECT row_id, {_CANON} AS canonical FROM p")
def canonical_fast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.texts(spark, sf_dir).select("row_id", C.canonical_fast(F.col("raw")).alias("canonical"))


_MARKERS = ", ".join("'" + m + "'" for m in C.PLACEHOLDERS)
_FOLDED = r"upper(trim(regexp_replace(regexp_replace(strip_accents(coalesce({0}, '')), '[^\x00-\x7F]', '', 'g'), '\s+', ' ', 'g')))"
_EMPTY = f"({_FOLDED} IN ({_MARKERS}) OR (NOT regexp_matches({_FOLDED}, '[A-Z]') AND length(regexp_replace({_FOLDED}, '[^0-9]', '', 'g')) < 3))"


@query(f"WITH {TEXTS} SELECT row_id, {_EMPTY.format('raw')} AS placeholder FROM texts UNION ALL SELECT doc_id, {_EMPTY.format('text')} FROM documents")
def placeholder_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = derive.texts(spark, sf_dir).select("row_id", C.is_placeholder(F.col("raw")).alias("placeholder"))
    return a.unionAll(view(spark, sf_dir, "documents").select("doc_id", C.is_placeholder(F.col("text"))))


_TOWN = "CASE event_id % 8 WHEN 0 THEN 'Cali' WHEN 1 THEN 'Santiago de Cali' WHEN 2 THEN '76001' WHEN 3 THEN 'Calima' WHEN 4 THEN '76.520' WHEN 5 THEN 'Valle del Cauca' WHEN 6 THEN '760042' ELSE event_type END"


@query(f"SELECT event_id, CASE event_id % 8 WHEN 3 THEN true WHEN 4 THEN true WHEN 7 THEN lower(event_type) NOT IN ('x', 'xx', 'xxx', 'na', 'sd') ELSE false END AS outside FROM events")
def municipality_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "events").select("event_id", C.is_outside(F.expr(_TOWN)).alias("outside"))


_TOKEN = "CASE p_partkey % 6 WHEN 0 THEN 'CATRERA' WHEN 1 THEN 'CLLLE' WHEN 2 THEN 'AVENIDDA' WHEN 3 THEN 'DIAGNAL' WHEN 4 THEN 'OEATE' ELSE upper(regexp_replace(p_brand, '[^A-Za-z]', '', 'g')) END"
_WORDS = ", ".join(f"({k}, '{w}', '{C.STREET_OF[w]}')" for k, w in enumerate(C.LONG_STREETS))


@query(f"WITH t AS (SELECT p_partkey, {_TOKEN} AS word FROM part), w(k, alias, canon) AS (VALUES {_WORDS}), m AS (SELECT p_partkey, word, min_by(alias, levenshtein(word, alias) * 1000 + k) AS best, min_by(canon, levenshtein(word, alias) * 1000 + k) AS canon FROM t, w GROUP BY ALL) SELECT p_partkey, word, CASE WHEN length(word) >= 4 AND levenshtein(word, best) <= greatest(1, length(best) // 4) THEN canon END AS street FROM m")
def typo_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.expr(_TOKEN.replace(", 'g')", ")"))
    return view(spark, sf_dir, "part").select("p_partkey", word.alias("word")).withColumn("street", C.nearest_street(F.col("word")))


@query("SELECT c_custkey, concat_ws(' ', nullif(trim(c_name), ''), nullif(trim(c_mktsegment), ''), CAST(c_nationkey AS VARCHAR)) AS joined, regexp_replace(CAST(CAST(c_nationkey AS DOUBLE) AS VARCHAR), '\\.0$', '') AS coerced FROM customer")
def concat_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = view(spark, sf_dir, "customer")
    return c.select("c_custkey", C.concat_parts(F.col("c_name"), F.col("c_mktsegment"), F.col("c_nationkey")).alias("joined"), C.part_text(F.col("c_nationkey").cast("double")).alias("coerced"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN n_name ELSE 'Comuna ' || CAST(n_nationkey AS VARCHAR) END AS zone, CASE WHEN n_regionkey = 0 THEN NULL ELSE n_nationkey = n_regionkey END AS same_code FROM nation")
def zone_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    code = F.when(F.col("n_regionkey") != 0, F.lpad(F.col("n_regionkey").cast("string"), 3, "0"))
    return view(spark, sf_dir, "nation").select("n_nationkey", C.zone_label(F.when(k % 4 == 0, F.col("n_name")).otherwise(F.lpad(k.cast("string"), 3, "0"))).alias("zone"), C.codes_equal(k, code).alias("same_code"))


@query(r"SELECT doc_id, regexp_matches(t, '#') AS has_hash, regexp_matches(t, '-') AS has_dash, regexp_matches(t, '\d[A-Za-z]') AS attached, regexp_matches(t, '[a-z]') AS has_lowercase, regexp_matches(upper(t), '\bCALI\b') AS city FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)")
def pattern_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "documents").select("doc_id", *[c.alias(n) for n, c in augment.patterns(F.coalesce("text", F.lit(""))).items() if n in ("has_hash", "has_dash", "attached", "has_lowercase", "city")])


@query(r"SELECT CAST(avg(CASE WHEN regexp_matches(t, '#') THEN 1 ELSE 0 END) AS DECIMAL(18,6)) AS has_hash, CAST(avg(CASE WHEN regexp_matches(t, '-') THEN 1 ELSE 0 END) AS DECIMAL(18,6)) AS has_dash, CAST(avg(CASE WHEN regexp_matches(t, '\d[A-Za-z]') THEN 1 ELSE 0 END) AS DECIMAL(18,6)) AS attached, CAST(avg(CASE WHEN regexp_matches(t, '[a-z]') THEN 1 ELSE 0 END) AS DECIMAL(18,6)) AS has_lowercase FROM (SELECT coalesce(text, '') AS t FROM documents)")
def pattern_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return augment.frequencies(view(spark, sf_dir, "documents"), "text").select(*[dec(c) for c in ("has_hash", "has_dash", "attached", "has_lowercase")])


# ---- joins --------------------------------------------------------------------------------------


@query(f"WITH {DOCS}, {TEXTS}, k AS (SELECT {KEY.format('direccion')} AS key, min(doc_id) AS doc_id FROM numbered GROUP BY 1) SELECT row_id, doc_id FROM texts LEFT JOIN k ON {KEY.format('raw')} = key")
def exact_match_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir).select(C.match_key(F.col("direccion")).alias("key"), "doc_id")
    q = derive.texts(spark, sf_dir).select("row_id", C.match_key(F.col("raw")).alias("key"))
    return catalogue.exact_match(q, d).select("row_id", "doc_id")


_BLOCK = r"split_part({0}, ' ', 1) AS t, split_part({0}, ' ', 2) AS n"


@query(f"WITH {DOCS}, {TEXTS}, p AS (SELECT row_id, {_plain('raw')} AS t FROM texts), q AS (SELECT row_id, {_CANON} AS c FROM p), qb AS (SELECT row_id, c, {_BLOCK.format('c')} FROM q WHERE c IS NOT NULL), db AS (SELECT doc_id, direccion, {_BLOCK.format('direccion')} FROM numbered), s AS (SELECT row_id, doc_id, 100 - CAST(levenshtein(c, direccion) AS BIGINT) AS score FROM qb JOIN db USING (t, n)), r AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, doc_id) AS slot FROM s) SELECT row_id, doc_id, score, slot FROM r WHERE slot <= 3")
def blocking_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    block = lambda c: [F.split_part(F.col(c), F.lit(" "), F.lit(k)).alias(n) for k, n in ((1, "t"), (2, "n"))]
    texts = derive.texts(spark, sf_dir).select("row_id", "raw")
    forms = C.once(texts.select("raw").distinct(), "c", C.canonical_fast(F.col("raw"))).where("c is not null")
    q = forms.select("c").distinct().select("c", *block("c"))
    d = docs(spark, sf_dir).select("doc_id", "direccion", *block("direccion"))
    score = (100 - F.levenshtein("c", "direccion")).cast("long")
    # Equal forms have equal candidates: these are sought once and brought to the texts then.
    found = retrieval.blocked_top_k(q, d, ["t", "n"], score, 3, by="c").select("c", "doc_id", "score", F.col("slot").cast("long").alias("slot"))
    return texts.join(forms, "raw").join(found, "c").select("row_id", "doc_id", "score", "slot")


_TOPK = "q AS (SELECT vec_id AS row_id, embedding FROM embeddings WHERE vec_id % 10 = 0), s AS (SELECT q.row_id, e.vec_id AS doc_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS sim FROM q, embeddings e), r AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY sim DESC, doc_id) AS slot FROM s)"


def _vectors(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    e = view(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 10 = 0").select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("vec"))
    return retrieval.top_k_vectors(q, e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec")), k, 6)


@query(f"WITH {_TOPK} SELECT row_id, doc_id, CAST(sim AS DECIMAL(18,6)) AS sim, slot FROM r WHERE slot <= 5")
def embedding_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queries of the search are a stated set: every tenth vector against all."""
    return _vectors(spark, sf_dir, 5).select("row_id", "doc_id", dec("sim"), F.col("slot").cast("long").alias("slot"))


@query(f"WITH {_TOPK}, a AS (SELECT row_id, doc_id, sim, 0 AS v, slot FROM r WHERE slot <= 5), b AS (SELECT row_id, doc_id + (CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 1 END) AS doc_id, sim - 0.25 AS sim, 1 AS v, slot FROM r WHERE slot <= 5), u AS (SELECT * FROM a UNION ALL SELECT * FROM b), g AS (SELECT row_id, doc_id, max(sim) AS sim, min(v * 100 + slot) AS seen FROM u GROUP BY 1, 2) SELECT row_id, doc_id, CAST(sim AS DECIMAL(18,6)) AS sim, row_number() OVER (PARTITION BY row_id ORDER BY seen) AS slot FROM g")
def two_view_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _vectors(spark, sf_dir, 5)
    b = a.withColumn("doc_id", F.col("doc_id") + F.when(F.col("doc_id") % 2 == 0, 0).otherwise(1)).withColumn("sim", F.col("sim") - 0.25)
    return retrieval.two_views(a, b).select("row_id", "doc_id", dec("sim"), F.col("slot").cast("long").alias("slot"))


# ---- structure, ranking and decision -------------------------------------------------------------

_OTHER = {"via_type": "CASE WHEN l_linenumber = 2 THEN 'TV' ELSE via_type END", "via_number": "via_number", "via_letters": "CASE WHEN l_linenumber = 3 THEN 'B' ELSE via_letters END", "cross_number": "CASE WHEN l_linenumber = 4 THEN '99' ELSE cross_number END", "plate": "lpad(CAST(CAST(plate AS INT) + l_linenumber - 1 AS STRING), 2, '0')"}
_PAIRS = "parts AS (SELECT o_orderkey AS objectid, " + ", ".join(f"{e} AS {n}" for n, e in derive.PARTS.items()) + " FROM orders), pairs AS (SELECT l_orderkey * 10 + l_linenumber AS row_id, p.*, " + ", ".join(f"{e} AS o_{n}" for n, e in _OTHER.items()) + " FROM lineitem JOIN parts p ON l_orderkey = objectid)"
_NONE = {"via_quadrant": "string", "cross_quadrant": "string", "cross_letters": "string", "cross_type": "string", "via_suffix_letters": "string", "cross_suffix_letters": "string", "complement": "string"}


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = derive.parts(spark, sf_dir)
    j = view(spark, sf_dir, "lineitem").join(p, F.col("l_orderkey") == F.col("objectid"))
    side = lambda names: F.struct(*[F.expr(e).alias(n) for n, e in names.items()], *[F.lit(None).cast(t).alias(n) for n, t in _NONE.items()], F.lit(False).alias("via_bis"), F.lit(False).alias("cross_bis"), F.lit(True).alias("parse_ok"))
    return j.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"), side({n: n for n in derive.PARTS}).alias("q"), side(_OTHER).alias("c"))


_SAME = lambda n, w: f"CASE WHEN {n} IS NOT DISTINCT FROM o_{n} THEN {w} ELSE 0.0 END"
_STRUCT = (
    f"({_SAME('via_type', '1.0')} + {_SAME('via_number', '2.0')} + {_SAME('cross_number', '2.0')} + CASE WHEN via_letters IS NULL AND o_via_letters IS NULL THEN 0.0 ELSE {_SAME('via_letters', '1.0')} END"
    " + CASE WHEN ltrim(plate, '0') = ltrim(o_plate, '0') THEN 1.5 WHEN abs(CAST(plate AS INT) - CAST(o_plate AS INT)) <= 2 THEN 0.6 ELSE 0.0 END)::DOUBLE / (6.5 + CASE WHEN via_letters IS NULL AND o_via_letters IS NULL THEN 0.0 ELSE 1.0 END)::DOUBLE"
)


@query(f"WITH {_PAIRS} SELECT row_id, CAST({_STRUCT} AS DECIMAL(18,6)) AS struct FROM pairs")
def struct_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("row_id", dec(C.struct_agreement(F.col("q"), F.col("c")), "struct"))


_W = {"sim": 0.7, "fuzz": 0.1, "struct": 0.1, "geo": 0.1}
_CAND = "cand AS (SELECT l_orderkey AS row_id, ((l_linenumber * CAST(100000 AS BIGINT) + l_partkey) * 10000 + l_suppkey) * 100 + CAST(l_quantity AS BIGINT) AS slot, l_partkey AS doc_id, l_suppkey % 7 AS block, l_discount * 10 AS sim, l_tax * 10 AS fuzz, (l_quantity % 10) / 10 AS struct, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE 1 - l_discount * 5 END AS geo FROM lineitem), scored AS (SELECT *, CASE WHEN geo IS NULL THEN (0.7::DOUBLE + 0.1::DOUBLE / 3) * sim + (0.1::DOUBLE + 0.1::DOUBLE / 3) * fuzz + (0.1::DOUBLE + 0.1::DOUBLE / 3) * struct ELSE 0.7::DOUBLE * sim + 0.1::DOUBLE * fuzz + 0.1::DOUBLE * struct + 0.1::DOUBLE * geo END AS raw FROM cand), fused AS (SELECT *, raw AS score FROM scored)"


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = view(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS row_id", "((l_linenumber * CAST(100000 AS BIGINT) + l_partkey) * 10000 + l_suppkey) * 100 + CAST(l_quantity AS BIGINT) AS slot", "l_partkey AS doc_id", "l_suppkey % 7 AS block", "l_discount * 10 AS sim", "l_tax * 10 AS fuzz", "(l_quantity % 10) / 10 AS struct", "CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE 1 - l_discount * 5 END AS geo")
    return li.withColumn("score", C.fused(F.col("sim"), F.col("fuzz"), F.col("struct"), F.col("geo"), _W))


@query(f"WITH {_CAND} SELECT row_id, slot, doc_id, CAST(score AS DECIMAL(18,6)) AS score, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, slot) AS rank FROM fused")
def fused_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.ranked(_fused(spark, sf_dir)).select("row_id", "slot", "doc_id", dec("score"), F.col("rank").cast("long").alias("rank"))


_MARGIN = f"{_CAND}, best AS (SELECT row_id, first(doc_id ORDER BY score DESC, slot) AS bd, first(block ORDER BY score DESC, slot) AS bb, first(score ORDER BY score DESC, slot) AS bs FROM fused GROUP BY 1), gaps AS (SELECT f.row_id, bd, bb, bs, bs - score AS gap, block <> bb AS other, doc_id <> bd AND score >= 0.3 AS rival FROM fused f JOIN best USING (row_id)), m AS (SELECT row_id, any_value(bd) AS doc_id, any_value(bs) AS score, min(CASE WHEN rival AND other THEN gap END) AS mm, min(CASE WHEN rival THEN gap END) AS mp, count(*) FILTER (WHERE rival AND other AND gap <= 0.05 + 0.000000001) AS nc FROM gaps GROUP BY 1)"


def _margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decision.competed(_fused(spark, sf_dir).select("row_id", "slot", "doc_id", F.col("block").alias("manzana"), "score", F.lit(True).alias("ok")), 0.3)


@query(f"WITH {_MARGIN} SELECT row_id, doc_id, CAST(score AS DECIMAL(18,6)) AS score, CAST(mm AS DECIMAL(18,6)) AS margen_manzana, CAST(mp AS DECIMAL(18,6)) AS margen_predio, nc AS n_competidores FROM m")
def margin_competition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _margins(spark, sf_dir).select("row_id", "doc_id", dec("score"), dec("margen_manzana"), dec("margen_predio"), "n_competidores")


_RULES = "CASE WHEN via_type <> o_via_type THEN 'tipo de via ' || via_type || ' != ' || o_via_type END AS r1, CASE WHEN cross_number <> o_cross_number THEN 'numero de cruce ' || cross_number || ' != ' || o_cross_number END AS r2, CASE WHEN ltrim(plate, '0') <> ltrim(o_plate, '0') THEN 'placa ' || plate || ' != ' || o_plate END AS r3, CASE WHEN coalesce(via_letters, '') <> coalesce(o_via_letters, '') THEN 'letra de via ' || coalesce(via_letters, '-') || ' != ' || coalesce(o_via_letters, '-') END AS r4"


@query(f"WITH {_PAIRS}, r AS (SELECT row_id, {_RULES} FROM pairs) SELECT row_id, concat_ws('; ', r1, r2, r3, r4) AS messages FROM r")
def rule_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = decision.violations(F.col("q"), F.col("c"), F.lit(1.0))
    return _pairs(spark, sf_dir).select("row_id", F.array_join(F.transform(v, lambda x: x["msg"]), "; ").alias("messages"))


_LADDER = f"{_MARGIN}, s AS (SELECT row_id, doc_id, least(1, greatest(0, score)) AS c, mm, nc, doc_id % 5 = 0 AS hard FROM m), e AS (SELECT *, CASE WHEN row_id % 19 = 0 THEN 'FUERA_DE_AREA' WHEN row_id % 17 = 0 THEN 'SIN_MATCH' WHEN row_id % 13 = 0 THEN 'NO_PARSEABLE' WHEN c < 0.45 OR hard OR coalesce(mm < 0.02, false) THEN 'SIN_MATCH' ELSE 'OK' END AS estado FROM s)"


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("row_id")
    none = F.array().cast("array<string>")
    rows = _margins(spark, sf_dir).withColumns({
        "outside": r % 19 == 0, "municipality": F.lit("Calima"), "placeholder": r % 17 == 0, "parse_ok": r % 13 != 0, "notes": none, "gated": F.lit(None).cast("string"),
        "hard": F.when(F.col("doc_id") % 5 == 0, F.array(F.lit("tipo de via CL != KR"))).otherwise(none), "soft": none, "n_predios": F.lit(1), "manzana_nunique": F.lit(1), "level": F.when(r % 2 == 0, "predio").otherwise("esquina"),
    })
    return decision.decided(rows, 0.45, delta=0.02)


@query(f"WITH {_LADDER} SELECT row_id, estado, CASE WHEN row_id % 19 = 0 THEN 'municipio distinto de Cali: ''Calima''' WHEN row_id % 17 = 0 THEN 'dato vacio o marcador sin informacion' WHEN row_id % 13 = 0 THEN 'gramatica de direccion no reconocida' WHEN c < 0.45 THEN 'confianza' WHEN hard THEN 'tipo de via CL != KR' WHEN coalesce(mm < 0.02, false) THEN 'ambiguo: ' || greatest(nc, 1) || ' candidatos cercanos en otras manzanas' END AS motivo, CASE WHEN estado = 'OK' THEN CASE WHEN row_id % 2 = 0 THEN 'predio' ELSE 'esquina' END END AS nivel_precision FROM e")
def decision_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidences in messages are compared by their first word, since engines format numbers in their own ways."""
    return _decided(spark, sf_dir).select("row_id", "estado", F.when(F.col("motivo").startswith("confianza"), "confianza").otherwise(F.col("motivo")).alias("motivo"), "nivel_precision")


@query(f"WITH {_LADDER} SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE estado = '{s}') AS n_{s.lower()}" for s in decision.STATUSES) + " FROM e")
def status_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.status_counts(_decided(spark, sf_dir))


_FLAGS = "f AS (SELECT row_id, estado, CASE row_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS dataset, row_id % 4 <> 0 AS has_gt, CASE WHEN row_id % 4 = 0 THEN NULL ELSE doc_id % 3 <> 0 END AS cm, CASE WHEN row_id % 4 = 0 THEN NULL ELSE doc_id % 2 = 0 END AS cp, mm FROM e)"


def _flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, d = F.col("row_id"), F.col("doc_id")
    return _decided(spark, sf_dir).withColumns({"dataset": F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (r % 3 + 1).cast("int")), "has_gt": r % 4 != 0, "correct_manzana": F.when(r % 4 != 0, d % 3 != 0), "correct_predial": F.when(r % 4 != 0, d % 2 == 0), "margen": F.col("margen_manzana")})


@query(f"WITH {_LADDER}, {_FLAGS} SELECT CASE WHEN grouping(dataset) = 1 THEN 'ALL' ELSE dataset END AS dataset, estado, count(*) AS n, count(*) FILTER (WHERE has_gt) AS n_gt, CAST(avg(cm::INT) AS DECIMAL(18,6)) AS manzana, CAST(avg(cp::INT) AS DECIMAL(18,6)) AS predial, count(*) FILTER (WHERE cm IS NULL) AS n_unknown FROM f GROUP BY GROUPING SETS ((dataset, estado), (estado))")
def strict_summary_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.strict_summary(_flagged(spark, sf_dir)).select("dataset", "estado", "n", "n_gt", dec("manzana"), dec("predial"), "n_unknown")


@query(f"WITH {_LADDER}, {_FLAGS}, r AS (SELECT f.*, CASE WHEN f.estado = 'OK' THEN '(vacio)' WHEN f.row_id % 19 = 0 THEN 'municipio distinto de' WHEN f.row_id % 17 = 0 THEN 'dato vacio o marcador sin informacion' WHEN f.row_id % 13 = 0 THEN 'gramatica de direccion no reconocida' WHEN c < 0.45 THEN 'confianza' WHEN hard THEN 'tipo de via' ELSE '(vacio)' END AS motivo FROM f JOIN e USING (row_id)) SELECT motivo, count(*) AS n, count(*) FILTER (WHERE cm) AS n_true, count(*) FILTER (WHERE NOT cm) AS n_false, count(*) FILTER (WHERE cm IS NULL) AS n_null FROM r GROUP BY 1")
def reason_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.reason_breakdown(_flagged(spark, sf_dir))


@query(f"WITH {_LADDER} SELECT coalesce(CASE WHEN estado = 'OK' THEN CASE WHEN row_id % 2 = 0 THEN 'predio' ELSE 'esquina' END END, '(vacio)') AS nivel_precision, count(*) AS n FROM e GROUP BY 1")
def level_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.level_breakdown(_decided(spark, sf_dir))


@query(f"WITH {_LADDER}, {_FLAGS}, o AS (SELECT * FROM f WHERE estado = 'OK' AND has_gt), d(delta) AS (VALUES (0.0::DOUBLE), (0.05::DOUBLE), (0.1::DOUBLE), (0.2::DOUBLE)) SELECT delta, count(*) FILTER (WHERE mm IS NULL OR mm >= delta) AS kept, count(*) FILTER (WHERE mm < delta) AS abstained, count(*) FILTER (WHERE (mm IS NULL OR mm >= delta) AND cm) AS kept_right, count(*) FILTER (WHERE mm < delta AND NOT cm) AS dropped_wrong FROM o, d GROUP BY 1")
def margin_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.margin_sweep(_flagged(spark, sf_dir), [0.0, 0.05, 0.1, 0.2])


# ---- space --------------------------------------------------------------------------------------

_PLACES = "places AS (SELECT s_suppkey AS id, s_suppkey % 97 / 100.0::DOUBLE + 3.2::DOUBLE AS lat, s_suppkey % 89 / 100.0::DOUBLE - 76.9::DOUBLE AS lon FROM supplier)"


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return view(spark, sf_dir, "supplier").select(k.alias("id"), ((k % 97) / F.lit(100.0) + F.lit(3.2)).alias("lat"), ((k % 89) / F.lit(100.0) - F.lit(76.9)).alias("lon"))


@query(f"WITH {_PLACES} SELECT id, CAST(2 * 6371008.8::DOUBLE * asin(sqrt(least(1.0, pow(sin(radians(lat - 3.45::DOUBLE) / 2), 2) + cos(radians(3.45::DOUBLE)) * cos(radians(lat)) * pow(sin(radians(lon + 76.53::DOUBLE) / 2), 2)))) AS DECIMAL(18,3)) AS m FROM places")
def haversine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _places(spark, sf_dir).select("id", C.haversine_m(F.lit(3.45), F.lit(-76.53), F.col("lat"), F.col("lon")).cast("decimal(18,3)").alias("m"))


@query(f"WITH {_PLACES} SELECT id, CASE WHEN ok THEN CAST(lat AS DECIMAL(18,6)) END AS lat, CASE WHEN ok THEN CAST(lon AS DECIMAL(18,6)) END AS lon FROM (SELECT *, lat BETWEEN 3.2 AND 3.65 AND lon BETWEEN -76.75 AND -76.4 AS ok FROM places)")
def bbox_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = F.col("lat").between(3.2, 3.65) & F.col("lon").between(-76.75, -76.4)
    return _places(spark, sf_dir).select("id", F.when(ok, F.col("lat")).cast("decimal(18,6)").alias("lat"), F.when(ok, F.col("lon")).cast("decimal(18,6)").alias("lon"))


_POINTS = f"{PARCELS}, pts AS (SELECT objectid AS point_id, centroid_lon AS lon, centroid_lat AS lat FROM parcels WHERE centroid_lon IS NOT NULL)"
_INSIDE = "lon > x0 AND lat > y0 AND lat < y1 AND lon < x1 AND (shape <> 0 OR lon < (x0 - x1) * (lat - y0) / (y1 - y0) + x1)"


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.parcels(spark, sf_dir).where("centroid_lon is not null").select(F.col("objectid").alias("point_id"), F.col("centroid_lon").alias("lon"), F.col("centroid_lat").alias("lat"))


@query(f"WITH {_POINTS}, {BOXES}, hit AS (SELECT point_id, min(poly_id) AS poly_id FROM pts, boxes WHERE {_INSIDE} GROUP BY 1) SELECT point_id, poly_id FROM pts LEFT JOIN hit USING (point_id)")
def point_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.point_in_polygon(_points(spark, sf_dir), derive.polygons(spark, sf_dir), 0.01).select("point_id", "poly_id")


_COVERED = "lon >= x0 AND lat >= y0 AND lat <= y1 AND lon <= x1 AND (shape <> 0 OR lon <= (x0 - x1) * (lat - y0) / (y1 - y0) + x1)"


@query(f"WITH {_POINTS}, {BOXES}, kinds AS (SELECT *, CASE poly_id % 2 WHEN 0 THEN 'barrio' ELSE 'comuna' END AS kind FROM boxes UNION ALL SELECT *, 'corregimiento' FROM boxes WHERE poly_id % 4 = 0), off AS (SELECT point_id, lon, lat + 0.00003::DOUBLE AS lat FROM pts), hit AS (SELECT point_id, min(CASE kind WHEN 'barrio' THEN 1 WHEN 'vereda' THEN 2 WHEN 'comuna' THEN 3 ELSE 4 END || name) AS z FROM off, kinds WHERE {_COVERED} GROUP BY 1) SELECT point_id, CASE left(z, 1) WHEN '1' THEN 'barrio' WHEN '3' THEN 'comuna' WHEN '4' THEN 'corregimiento' END AS kind, substring(z, 2) AS name FROM pts LEFT JOIN hit USING (point_id)")
def locate_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points on a side belong to what covers them, unlike in point_in_polygon. Points are moved off the slanting sides, on which engines round in their own ways."""
    p = derive.polygons(spark, sf_dir)
    kinds = p.withColumn("kind", F.when(F.col("poly_id") % 2 == 0, "barrio").otherwise("comuna")).unionByName(p.where("poly_id % 4 = 0").withColumn("kind", F.lit("corregimiento")))
    return geo.located(_points(spark, sf_dir).withColumn("lat", F.col("lat") + F.lit(0.00003)), kinds, 0.01, ("barrio", "vereda", "comuna", "corregimiento")).select("point_id", "kind", "name")


@query(f"WITH {_CAND}, t AS (SELECT row_id, slot, doc_id, doc_id % 11 <> 0 AS has_point, CASE WHEN row_id % 3 = 0 THEN block = 1 END AS b, CASE WHEN row_id % 2 = 0 THEN block < 4 END AS c FROM cand), w AS (SELECT *, max(b IS NOT NULL) OVER p AS ab, max(coalesce(b, false) OR NOT has_point) OVER p AS kb, max(c IS NOT NULL) OVER p AS ac FROM t WINDOW p AS (PARTITION BY row_id)) SELECT row_id, slot, doc_id FROM w WHERE CASE WHEN ab AND kb THEN coalesce(b, false) OR NOT has_point WHEN ac THEN coalesce(c, false) OR NOT has_point WHEN ab THEN false ELSE true END")
def geo_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("row_id")
    c = _fused(spark, sf_dir).select("row_id", "slot", "doc_id", (F.col("doc_id") % 11 != 0).alias("has_point"), F.when(r % 3 == 0, F.col("block") == 1).alias("barrio"), F.when(r % 2 == 0, F.col("block") < 4).alias("comuna"))
    return geo.gated(c, ["barrio", "comuna"], escalate=True).select("row_id", "slot", "doc_id")


_XY = "xy AS (SELECT p_partkey AS id, (p_partkey * 37 % 1009)::DOUBLE AS x, (p_partkey * 53 % 997)::DOUBLE AS y FROM part), s AS (SELECT s_suppkey AS sid, (s_suppkey * 41 % 1009)::DOUBLE AS sx, (s_suppkey * 59 % 997)::DOUBLE AS sy FROM supplier)"


@query(f"WITH {_XY}, d AS (SELECT sid, id, sqrt((x - sx) * (x - sx) + (y - sy) * (y - sy)) AS d FROM s, xy), r AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY d, id) AS slot FROM d) SELECT sid AS id, id AS other, CAST(d AS DECIMAL(18,6)) AS d, slot FROM r WHERE slot <= 3")
def knn_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = view(spark, sf_dir, "part").selectExpr("p_partkey AS id", "CAST(p_partkey * 37 % 1009 AS DOUBLE) AS x", "CAST(p_partkey * 53 % 997 AS DOUBLE) AS y")
    p = view(spark, sf_dir, "supplier").selectExpr("s_suppkey AS id", "CAST(s_suppkey * 41 % 1009 AS DOUBLE) AS x", "CAST(s_suppkey * 59 % 997 AS DOUBLE) AS y")
    return geo.nearest(p, o, 3, 32.0, same=False).select("id", "other", dec("d"), F.col("slot").cast("long").alias("slot"))


_FACE = "face AS (SELECT o_orderkey AS doc_id, o_custkey AS via, o_orderkey % 4 AS side, CAST(o_orderkey * 13 % 97 AS BIGINT) AS plate_no FROM orders)"


@query(f"WITH {_FACE}, n AS (SELECT a.doc_id, b.doc_id AS neg_doc_id, abs(a.plate_no - b.plate_no) AS delta, row_number() OVER (PARTITION BY a.doc_id ORDER BY abs(a.plate_no - b.plate_no), b.plate_no, b.doc_id) AS slot FROM face a JOIN face b USING (via, side) WHERE abs(a.plate_no - b.plate_no) BETWEEN 1 AND 40) SELECT doc_id, neg_doc_id, delta, slot FROM n WHERE slot <= 2")
def plate_band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = view(spark, sf_dir, "orders").selectExpr("o_orderkey AS doc_id", "o_custkey AS via", "o_orderkey % 4 AS side", "CAST(o_orderkey * 13 % 97 AS BIGINT) AS plate_no")
    return splits.band_neighbours(d, ["via", "side"], 40, 2).select("doc_id", "neg_doc_id", "delta", F.col("slot").cast("long").alias("slot"))


@query("WITH c AS (SELECT o_orderkey AS doc_id, o_custkey % 30 AS via, o_orderkey % 30 AS x, o_orderkey * 7 % 50 AS plate FROM orders), n AS (SELECT a.doc_id, b.doc_id AS neg_doc_id, row_number() OVER (PARTITION BY a.doc_id ORDER BY md5(a.doc_id || '|' || b.doc_id || '|7')) AS slot FROM c a JOIN c b ON a.via = b.x AND a.x = b.via AND a.plate = b.plate WHERE a.via <> a.x) SELECT * FROM n WHERE slot <= 2")
def corner_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = view(spark, sf_dir, "orders").selectExpr("o_orderkey AS doc_id", "o_custkey % 30 AS via", "o_orderkey % 30 AS cross", "o_orderkey * 7 % 50 AS plate")
    return splits.corner_neighbours(d, 7).select("doc_id", "neg_doc_id", F.col("slot").cast("long").alias("slot"))


# ---- splits and samples --------------------------------------------------------------------------


@query("SELECT doc_id, md5(text) AS k FROM documents WHERE text NOT IN (SELECT text FROM documents GROUP BY text HAVING min(source) <> max(source)) AND text IS NOT NULL")
def split_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = view(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.md5("text").alias("k"), "source")
    return splits.without_conflicts(d, "k", "source").select("doc_id", "k")


@query("SELECT md5(text) AS k, min(doc_id) AS doc_id, min_by(source, doc_id) AS source FROM documents GROUP BY text")
def split_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.keep_first(view(spark, sf_dir, "documents").select(F.md5("text").alias("k"), "doc_id", "source"), "k", "doc_id")


@query("WITH t AS (SELECT DISTINCT md5(text) AS k, CASE source WHEN 'src0' THEN 'train' WHEN 'src1' THEN 'dev' ELSE 'rest' END AS s FROM documents WHERE text IS NOT NULL) SELECT a.s AS a, b.s AS b, count(*) AS n FROM t a JOIN t b USING (k) GROUP BY 1, 2")
def overlap_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = view(spark, sf_dir, "documents").select(F.md5("text").alias("k"), "source")
    return splits.overlap_matrix({"train": d.where("source = 'src0'"), "dev": d.where("source = 'src1'"), "rest": d.where("source is null or source not in ('src0', 'src1')")}, "k")


@query("SELECT doc_id, lang FROM documents ORDER BY md5(doc_id || '|11'), doc_id LIMIT 100")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampling operator: a hundred rows in a seeded order."""
    return splits.seeded_sample(view(spark, sf_dir, "documents"), "doc_id", 100, 11).select("doc_id", "lang")


@query("WITH k AS (SELECT conv_id, row_number() OVER (ORDER BY md5(conv_id || '|5')) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT conv_id FROM conversations)) SELECT c.conv_id, turn, r <= greatest(1, least(n - 1, round_even(0.2 * n, 0))) AS is_val FROM conversations c JOIN k USING (conv_id)")
def grouped_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.grouped_split(view(spark, sf_dir, "conversations"), "conv_id", 0.2, 5).select("conv_id", "turn", "is_val")


# ---- evaluation ----------------------------------------------------------------------------------

_SCORES = "sc AS (SELECT l.doc_id AS id, (l.doc_id * 37 % 101) / 100.0::DOUBLE AS p, quality = 1 AS correct, toxic = 1 AS is_junk, CASE WHEN toxic = 1 THEN 0.2::DOUBLE ELSE 0.8::DOUBLE END AS w, d.source AS kind, CASE l.doc_id % 4 WHEN 0 THEN 'holgado' WHEN 1 THEN '>=.05' WHEN 2 THEN '>=.02' ELSE '<0.02' END AS band FROM labels l JOIN documents d USING (doc_id))"


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    band = F.element_at(F.array(*map(F.lit, ("holgado", ">=.05", ">=.02", "<0.02"))), (F.col("doc_id") % 4 + 1).cast("int"))
    j = view(spark, sf_dir, "labels").join(view(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return j.select(F.col("doc_id").alias("id"), ((F.col("doc_id") * 37 % 101) / F.lit(100.0)).alias("p"), (F.col("quality") == 1).alias("correct"), (F.col("toxic") == 1).alias("is_junk"), F.when(F.col("toxic") == 1, 0.2).otherwise(0.8).alias("w"), F.col("source").alias("kind"), band.alias("band"))


@query(f"WITH {_TOPK} SELECT row_id, list_contains(list_slice(ids, 1, 1), gt) AS top1, list_contains(list_slice(ids, 1, 5), gt) AS top5, list_contains(ids, gt) AS topk FROM (SELECT row_id, row_id + 1 AS gt, list(doc_id ORDER BY slot) AS ids FROM r WHERE slot <= 10 GROUP BY row_id)")
def topk_correctness(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = _vectors(spark, sf_dir, 10)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("slot", "doc_id"))), lambda x: x["doc_id"])
    return evaluation.correctness(top.groupBy("row_id").agg(ids.alias("ids")).withColumn("gt", F.col("row_id") + 1)).select("row_id", "top1", "top5", "topk")


@query(f"WITH {_SCORES}, x AS (SELECT *, p * 300 AS dist_m FROM sc) SELECT kind, count(*) AS n, CAST(avg((NOT is_junk)::INT) AS DECIMAL(18,6)) AS match_rate, CAST(median(dist_m) AS DECIMAL(18,6)) AS median_m, CAST(avg(dist_m) AS DECIMAL(18,6)) AS mean_m, CAST(quantile_cont(dist_m, 0.9) AS DECIMAL(18,6)) AS p90_m, CAST(avg((dist_m <= 25)::INT) AS DECIMAL(18,6)) AS within_25, CAST(avg((dist_m <= 250)::INT) AS DECIMAL(18,6)) AS within_250 FROM x GROUP BY 1")
def metric_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _scores(spark, sf_dir).withColumns({"dist_m": F.col("p") * 300, "matched": ~F.col("is_junk"), "top1": F.col("correct"), "top5": F.col("correct")})
    return evaluation.metric_table(x, "kind").select("kind", "n", *[dec(c) for c in ("match_rate", "median_m", "mean_m", "p90_m", "within_25", "within_250")])


@query(f"WITH {_SCORES} SELECT CASE WHEN p < 0.25 THEN 0 WHEN p < 0.5 THEN 1 WHEN p < 0.75 THEN 2 ELSE 3 END AS bin, count(*) AS n, CAST(avg(p) AS DECIMAL(18,6)) AS mean_p, CAST(avg(correct::INT) AS DECIMAL(18,6)) AS accuracy, CAST(median(p) AS DECIMAL(18,6)) AS median_p FROM sc GROUP BY 1")
def calibration_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.calibration_bins(_scores(spark, sf_dir), [0, 0.25, 0.5, 0.75, 1]).select("bin", "n", dec("mean_p"), dec("accuracy"), dec("median_p"))


@query("SELECT quality, count(*) FILTER (WHERE toxic = 0) AS \"0\", count(*) FILTER (WHERE toxic = 1) AS \"1\" FROM labels GROUP BY 1")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.confusion(view(spark, sf_dir, "labels"), "quality", "toxic", ["0", "1"])


@query(f"WITH {_SCORES}, b AS (SELECT *, ntile(5) OVER (ORDER BY p, id) AS bin FROM sc), g AS (SELECT bin, count(*) AS n, sum(pow(p - correct::INT, 2)) AS b, sum(-(correct::INT * ln(greatest(1e-15, least(1 - 1e-15, p))) + (1 - correct::INT) * ln(1 - greatest(1e-15, least(1 - 1e-15, p))))) AS l, abs(avg(p) - avg(correct::INT)) * count(*) AS e FROM b GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS n, CAST(sum(b) / sum(n) AS DECIMAL(18,6)) AS brier, CAST(sum(l) / sum(n) AS DECIMAL(18,4)) AS log_loss, CAST(sum(e) / sum(n) AS DECIMAL(18,6)) AS ece FROM g")
def ece_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.brier_and_ece(_scores(spark, sf_dir)).select("n", dec("brier"), F.col("log_loss").cast("decimal(18,4)").alias("log_loss"), dec("ece"))


@query(f"WITH {_SCORES}, g AS (SELECT p, count(*) FILTER (WHERE correct) AS pos, count(*) FILTER (WHERE NOT correct) AS neg FROM sc GROUP BY 1), c AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g) SELECT CAST(sum(pos * (below + neg / 2.0::DOUBLE)) / (sum(pos) * sum(neg)) AS DECIMAL(18,6)) AS auc FROM c")
def auc_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.auc(_scores(spark, sf_dir)).select(dec("auc"))


_T = [round(0.5 + k / 100, 2) for k in range(46)]


@query(f"WITH {_SCORES}, t(threshold) AS (VALUES {', '.join(f'({t}::DOUBLE)' for t in _T)}), g AS (SELECT threshold, sum(CASE WHEN p >= threshold AND correct AND NOT is_junk THEN w ELSE 0 END) AS tp, sum(CASE WHEN p >= threshold THEN w ELSE 0 END) AS m, sum(CASE WHEN NOT is_junk THEN w ELSE 0 END) AS r FROM sc, t GROUP BY 1), q AS (SELECT threshold, coalesce(tp / nullif(m, 0), 0) AS p, coalesce(tp / nullif(r, 0), 0) AS r FROM g) SELECT CAST(threshold AS DECIMAL(18,6)) AS threshold, CAST(p AS DECIMAL(18,6)) AS \"precision\", CAST(r AS DECIMAL(18,6)) AS recall, CAST(coalesce(2 * p * r / nullif(p + r, 0), 0) AS DECIMAL(18,6)) AS f1 FROM q")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _scores(spark, sf_dir).withColumnRenamed("p", "score")
    return evaluation.threshold_sweep(x, _T).select(dec("threshold"), dec("precision"), dec("recall"), dec("f1"))


@query("WITH g AS (SELECT row_number() OVER (ORDER BY a, b, c) - 1 AS combo, a, b, c, 20 - a - b - c AS d FROM range(1, 21) x(a), range(0, 21) y(b), range(0, 21) z(c) WHERE a + b + c <= 20), c AS (SELECT l_orderkey AS row_id, ((l_linenumber * CAST(100000 AS BIGINT) + l_partkey) * 10000 + l_suppkey) * 100 + CAST(l_quantity AS BIGINT) AS slot, l_suppkey % 3 = 0 AS t, CAST(round(l_discount * 100) AS BIGINT) AS s1, CAST(round(l_tax * 100) AS BIGINT) AS s2, CAST(l_quantity AS BIGINT) AS s3, l_partkey % 50 AS s4 FROM lineitem), b AS (SELECT combo, row_id, max(((a * s1 + b * s2 + c * s3 + d * s4) * CAST(1099511627776 AS BIGINT) - slot) * 2 + t::INT) & 1 AS hit FROM c, g GROUP BY 1, 2) SELECT CAST(combo AS INT) AS combo, count(*) AS n, CAST(avg(hit::INT) AS DECIMAL(18,6)) AS top1 FROM b GROUP BY 1")
def weight_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = view(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS row_id", "((l_linenumber * CAST(100000 AS BIGINT) + l_partkey) * 10000 + l_suppkey) * 100 + CAST(l_quantity AS BIGINT) AS slot", "l_suppkey % 3 = 0 AS is_truth", "round(l_discount * 100) AS sim", "round(l_tax * 100) AS fuzz", "l_quantity AS struct", "CAST(l_partkey % 50 AS DOUBLE) AS geo")
    return evaluation.weight_sweep(c, evaluation.weight_grid(spark)).select("combo", "n", dec("top1"))


@query(f"WITH {_SCORES}, t AS (SELECT avg(correct::INT) AS g FROM sc), k AS (SELECT kind, (sum(correct::INT) + 10 * g) / (count(*) + 10) AS kr FROM sc, t GROUP BY kind, g) SELECT sc.kind, band, count(*) AS n, CAST((sum(correct::INT) + 10 * kr) / (count(*) + 10) AS DECIMAL(18,6)) AS rate, CAST(kr AS DECIMAL(18,6)) AS kind_rate FROM sc JOIN k ON sc.kind = k.kind GROUP BY sc.kind, band, kr")
def eb_shrinkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.shrunk_cells(_scores(spark, sf_dir), 10).select("kind", "band", "n", dec("rate"), dec("kind_rate"))


@query(f"WITH {_SCORES}, g AS (SELECT p AS x, count(*) AS n, sum(correct::INT) AS s FROM sc GROUP BY 1), c AS (SELECT *, row_number() OVER (ORDER BY x) AS i, sum(n) OVER (ORDER BY x) AS cn, sum(s) OVER (ORDER BY x) AS cs FROM g), m AS (SELECT a.i AS j, b.i AS k, (b.cs - a.cs + a.s)::DOUBLE / (b.cn - a.cn + a.n)::DOUBLE AS m FROM c a JOIN c b ON a.i <= b.i), l AS (SELECT j, k, min(m) OVER (PARTITION BY j ORDER BY k DESC) AS low FROM m) SELECT CAST(x AS DECIMAL(18,6)) AS x, n, CAST(s AS BIGINT) AS s, CAST(fit AS DECIMAL(18,6)) AS fit FROM c JOIN (SELECT k, max(low) AS fit FROM l GROUP BY 1) ON i = k")
def isotonic_knots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.isotonic(_scores(spark, sf_dir)).select(dec("x"), "n", "s", dec("fit"))


@query(f"WITH {_SCORES}, b AS (SELECT id, greatest(0.02, least(0.98, CASE WHEN p <= 0.2 THEN 0.1 WHEN p <= 0.5 THEN 0.1 + (0.5 - 0.1) * (p - 0.2) / (0.5 - 0.2) WHEN p <= 0.9 THEN 0.5 + (0.99 - 0.5) * (p - 0.5) / (0.9 - 0.5) ELSE 0.99 END)) AS block, CASE kind WHEN 'src0' THEN 0.9 ELSE 0.6 END AS q FROM sc) SELECT id, CAST(block AS DECIMAL(18,6)) AS block, CAST(least(block, greatest(0.001, block * q)) AS DECIMAL(18,6)) AS parcel FROM b")
def hybrid_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    block, parcel = evaluation.hybrid(F.col("p"), F.col("kind"), ([0.2, 0.5, 0.9], [0.1, 0.5, 0.99]), {"src0": 0.9}, 0.6)
    return _scores(spark, sf_dir).select("id", dec(block, "block"), dec(parcel, "parcel"))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{c}', (SELECT count({c}) FROM orders), (SELECT count(*) - count({c}) FROM orders), (SELECT count(DISTINCT {c}) FROM orders))" for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")) + ") t(\"column\", non_null, nulls, n_unique)")
def profile_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.profile(view(spark, sf_dir, "orders"))


# ---- shapes of data ------------------------------------------------------------------------------


@query("SELECT event_id, json_extract_string(props, '$.' || k) AS v, k FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
def json_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = view(spark, sf_dir, "events")
    return e.select("event_id", F.explode(F.json_object_keys("props")).alias("k"), "props").select("event_id", F.expr("get_json_object(props, concat('$.', k))").alias("v"), "k")


@query("SELECT n_nationkey, '{\"type\":\"Feature\",\"properties\":{\"name\":\"' || n_name || '\"},\"geometry\":' || CASE WHEN n_regionkey = 0 THEN 'null' ELSE '{\"type\":\"Point\",\"coordinates\":[' || n_nationkey || ',' || n_regionkey || ']}' END || '}' AS feature FROM nation")
def geojson_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources import sinks

    n = view(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("name"), F.when(F.col("n_regionkey") != 0, F.col("n_nationkey")).alias("lon"), F.when(F.col("n_regionkey") != 0, F.col("n_regionkey")).alias("lat"))
    return n.select("n_nationkey", sinks.feature(["name"]).alias("feature"))


# ---- beyond SQL ----------------------------------------------------------------------------------


@query()
def parse_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.texts(spark, sf_dir).select("row_id", C.parse_address("raw").alias("a")).select("row_id", "a.*")


@query()
def detect_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as barrios with their regions as comunas, mentioned behind the address of each line item."""
    n = view(spark, sf_dir, "nation")
    features = n.select(F.lit("barrio").alias("kind"), F.col("n_name").alias("name"), (F.col("n_regionkey") + 1).cast("string").alias("parent"))
    t = derive.texts(spark, sf_dir).withColumn("k", F.pmod("row_id", F.lit(25)).cast("int")).join(n.select(F.col("n_nationkey").alias("k"), "n_name"), "k")
    raw = F.when(F.col("variant") % 2 == 0, F.concat("raw", F.lit(", barrio "), "n_name")).otherwise(F.concat("raw", F.lit(", "), F.lower("n_name")))
    return places.detected(t.select("row_id", raw.alias("text")), "text", features).select("row_id", "d.*")


@query()
def corrupt_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return augment.variants(docs(spark, sf_dir).select("doc_id", "direccion"), 3, 17)


@query()
def logistic_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _scores(spark, sf_dir).withColumn("band_n", F.col("id") % 4)
    m = evaluation.logistic(x, ["p", "band_n"], "correct")
    return spark.createDataFrame([(k, float(v), float(m["means"][k])) for k, v in m["coef"].items()], "feature string, coef double, mean double")


@query()
def normalize_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pipeline

    return pipeline.normalize(derive.texts(spark, sf_dir), docs(spark, sf_dir))


# ---- flagship ------------------------------------------------------------------------------------


@query(f"WITH {DOCS}, {TEXTS}, k AS (SELECT {KEY.format('direccion')} AS key, min(doc_id) AS doc_id FROM numbered GROUP BY 1), p AS (SELECT row_id, raw, {_plain('raw')} AS t FROM texts), q AS (SELECT row_id, raw, {_CANON} AS c FROM p) SELECT CASE WHEN {_EMPTY.format('raw')} THEN 'SIN_MATCH' WHEN c IS NULL THEN 'NO_PARSEABLE' WHEN doc_id IS NULL THEN 'SIN_MATCH' ELSE 'OK' END AS estado, count(*) AS n FROM q LEFT JOIN k ON {KEY.format('c')} = key GROUP BY 1")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The minimum slice: the catalogue, the texts' canonical forms, the lookup by key, and rows by status."""
    d = docs(spark, sf_dir).select(C.match_key(F.col("direccion")).alias("key"), "doc_id")
    q = derive.texts(spark, sf_dir).withColumn("c", C.canonical_fast(F.col("raw"))).withColumn("key", C.match_key(F.col("c")))
    status = F.when(C.is_placeholder(F.col("raw")), "SIN_MATCH").when(F.col("c").isNull(), "NO_PARSEABLE").when(F.col("doc_id").isNull(), "SIN_MATCH").otherwise("OK")
    return catalogue.exact_match(q, d).groupBy(status.alias("estado")).agg(F.count("*").alias("n"))


