"""The matching pipeline: texts in, statuses, documents and reasons out. README lists what is left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import places
from ..operators import decision, geo, retrieval
from ..sources.tables import kept

THRESHOLD, TOP = 0.73, 20
WEIGHTS = {"sim": 0.7, "fuzz": 0.1, "struct": 0.1, "geo": 0.1}


#: Documents of a street block that are compared, in their order, at most.
BLOCK_CAP = 4000
_DOC = ["doc_id", "direccion", "manzana", "numero_predial_nacional", "n_predios", "manzana_nunique"]


def grams(c: Column) -> Column:
    """The distinct character trigrams of a text."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - 2)), lambda i: F.substr(c, i, F.lit(3))))


def parsed_catalogue(docs: DataFrame) -> DataFrame:
    """docs (doc_id, direccion, manzana, ...) with the parse, the block keys, the lookup key and the trigrams, in a written table."""
    d = C.once(docs, "dp", C.parse_address("direccion"))
    return kept(d.withColumns({"bt": F.col("dp.via_type"), "bn": F.col("dp.via_number"), "key": C.match_key(F.col("direccion")), "dg": grams(F.col("direccion"))}), "catalogue")


def _zoned(docs: DataFrame, features: DataFrame, size: float) -> DataFrame:
    """docs with the barrio (or vereda), comuna and corregimiento that cover their centroids."""
    points = docs.where("centroid_lon is not null and centroid_lat is not null").select("doc_id", F.col("centroid_lon").alias("lon"), F.col("centroid_lat").alias("lat"))
    out = docs
    for name, kinds in (("barrio", ("barrio", "vereda")), ("comuna", ("comuna",)), ("corregimiento", ("corregimiento",))):
        found = geo.located(points, features.where(F.col("kind").isin(*kinds)), size, kinds, key="doc_id")
        out = out.join(found.select(F.col("doc_id").alias("z_"), F.col("name").alias("in_" + name)), F.col("doc_id") == F.col("z_"), "left").drop("z_")
    return out


def parsed_texts(texts: DataFrame, features: DataFrame | None) -> DataFrame:
    """Distinct raw texts with what is found in them: placeholder, d (places), p (the parse of the text without them, or of the whole text if that does not parse), in a written table."""
    # Distinct texts are few bytes, which would be put into few tasks; parsing them is what takes long.
    cores = texts.sparkSession.sparkContext.defaultParallelism
    marked = texts.select("raw").distinct().repartition(max(cores, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))).withColumn("placeholder", C.is_placeholder(F.col("raw")))
    asked = F.when(~F.col("placeholder"), F.col("raw"))
    if features is None:
        none = F.lit(None).cast(places.DETECTION)
        return kept(C.once(marked.withColumn("d", none), "p", C.parse_address(asked)), "texts")
    found = C.once(marked, "d", places.detector(texts.sparkSession, features)(asked))
    both = C.once(C.once(found, "p1", C.parse_address(F.col("d.cleaned_text"))), "p2", C.parse_address(asked))
    return kept(both.withColumn("p", F.when(F.col("p1.parse_ok"), F.col("p1")).otherwise(F.col("p2"))).drop("p1", "p2"), "texts")


def normalize(
    texts: DataFrame, docs: DataFrame, k: int = TOP, threshold: float = THRESHOLD, delta: float = 0.0, min_struct: float = 0.6, max_soft: int = 1,
    features: DataFrame | None = None, cell: float = 0.01,
) -> DataFrame:
    """A row per text (row_id, raw): estado, motivo, document, block, scores and precision.

    Distinct texts are read once: placeholders leave, places that features (kind, name, parent, rings)
    names are cut out, what is left is parsed, and the whole text where that does not parse. Candidates
    are the k most similar documents of the street (kind and number; the first BLOCK_CAP documents of
    a street), by character trigrams in place of a trained encoder, and the document with the very
    address. Those outside the places that a text names do not pass the gate. The best by fused score
    stands if no rule speaks against it and its margin is wide enough.
    """
    parsed = parsed_texts(texts, features)
    d = parsed_catalogue(_zoned(docs, features, cell) if features is not None else docs)
    zones = [c for c in d.columns if c.startswith("in_")]
    carried = [*_DOC, "dp", *zones]
    q = parsed.where("p.parse_ok").select(F.col("raw").alias("row_id"), "p", "d", F.col("p.via_type").alias("bt"), F.col("p.via_number").alias("bn"), F.col("p.canonical_base").alias("base"), F.col("p.canonical").alias("canon"), grams(F.col("p.canonical")).alias("qg"))
    sim = F.size(F.array_intersect("qg", "dg")) / F.sqrt(F.size("qg") * F.size("dg"))
    # Only ids, trigrams and scores are ranked; what the rules need is joined to the k best.
    found = retrieval.blocked_top_k(q.select("row_id", "bt", "bn", "qg"), d.select("bt", "bn", "doc_id", "dg"), ["bt", "bn"], sim, k, cap=BLOCK_CAP).select("row_id", "doc_id", "score", "slot")
    # The address itself is a candidate wherever it stands in its block.
    first = d.groupBy("key").agg(F.min_by(F.struct("doc_id", "dg"), "doc_id").alias("v"))
    same = q.select("row_id", "qg", C.match_key(F.col("canon")).alias("key")).join(first, "key").select("row_id", "v.*", "qg").select("row_id", "doc_id", sim.alias("score"), F.lit(0).alias("slot"))
    found = found.unionByName(same).groupBy("row_id", "doc_id").agg(F.max("score").alias("score"), F.min("slot").alias("slot"))
    found = found.join(q.select("row_id", "p", "d", "base"), "row_id").join(d.select(*carried), "doc_id")
    total = found
    if features is not None:
        tier = lambda name, said: F.when(said.isNotNull(), F.coalesce(F.col("in_" + name) == said, F.lit(False)))
        barrio = F.coalesce("d.barrio", "d.vereda")
        flagged = found.withColumns({"has_point": F.greatest(*[F.col(z).isNotNull() for z in zones]), "t_barrio": tier("barrio", barrio), "t_comuna": tier("comuna", F.concat(F.lit("Comuna "), F.col("d.comuna").cast("string"))), "t_corregimiento": tier("corregimiento", F.col("d.corregimiento"))})
        found = geo.gated(flagged, ["t_barrio", "t_comuna", "t_corregimiento"]).drop("has_point", "t_barrio", "t_comuna", "t_corregimiento")
    struct = C.struct_agreement(F.col("p"), F.col("dp"))
    scored = found.withColumn("struct", struct).withColumn("fuzz", C.token_set_ratio("base", "direccion") / 100)
    scored = scored.withColumn("score", C.fused(F.col("score"), F.col("fuzz"), F.col("struct"), F.lit(None).cast("double"), WEIGHTS)).withColumn("v", decision.violations(F.col("p"), F.col("dp"), F.col("struct"), min_struct))
    hard = F.transform(F.filter("v", lambda x: ~x["soft"]), lambda x: x["msg"])
    soft = F.transform(F.filter("v", lambda x: x["soft"]), lambda x: x["msg"])
    scored = kept(scored.withColumns({"hard": hard, "soft": soft}).withColumn("ok", (F.size("hard") == 0) & (F.size("soft") <= max_soft)).select("row_id", "slot", "score", "ok", "hard", "soft", *_DOC), "scored")
    best = decision.competed(scored.select("row_id", "slot", "doc_id", "manzana", "score", "ok"), threshold)
    detail = scored.select(F.col("row_id").alias("r"), F.col("doc_id").alias("c"), "direccion", "numero_predial_nacional", "hard", "soft", "n_predios", "manzana_nunique")
    best = best.join(detail, (F.col("row_id") == F.col("r")) & (F.col("doc_id") == F.col("c"))).drop("r", "c")
    rows = parsed.join(best, F.col("raw") == F.col("row_id"), "left").drop("row_id")
    gate = F.lit(None).cast("string")
    if features is not None:
        rows = rows.join(total.select(F.col("row_id").alias("r")).distinct(), F.col("raw") == F.col("r"), "left")
        named = F.coalesce(F.concat(F.lit("barrio "), F.coalesce("d.barrio", "d.vereda")), F.concat(F.lit("comuna "), F.col("d.comuna").cast("string")), F.concat(F.lit("corregimiento "), F.col("d.corregimiento")))
        gate = F.when(F.col("r").isNotNull() & F.col("score").isNull(), named)
    none = F.array().cast("array<string>")
    rows = rows.withColumns({
        "outside": F.lit(False), "municipality": F.lit(""), "gated": gate, "parse_ok": F.coalesce("p.parse_ok", F.lit(False)), "notes": F.coalesce("p.notes", none),
        "hard": F.coalesce("hard", none), "soft": F.coalesce("soft", none), "n_predios": F.coalesce("n_predios", F.lit(1)), "manzana_nunique": F.coalesce("manzana_nunique", F.lit(1)), "n_competidores": F.coalesce("n_competidores", F.lit(0)), "level": decision.level(F.col("p")),
    })
    done = decision.decided(rows, threshold, max_soft, delta)
    ok = F.col("estado") == "OK"
    out = done.select(
        F.col("raw").alias("raw_"), "estado", "motivo", F.when(ok, F.col("direccion")).otherwise(F.nullif("p.canonical", F.lit(""))).alias("direccion_normalizada"),
        F.when(ok, "catastro").when(F.coalesce("p.canonical", F.lit("")) != "", "reglas").alias("fuente_normalizacion"),
        *[F.when(ok, F.col(c)).alias(c) for c in ("numero_predial_nacional", "manzana", "doc_id")],
        F.when(ok, F.bround("score", 4)).alias("confianza"), F.when(ok, F.bround("margen_manzana", 4)).alias("margen"), "nivel_precision",
        F.coalesce("d.barrio", "d.vereda").alias("barrio_vereda"), F.coalesce(F.concat(F.lit("Comuna "), F.col("d.comuna").cast("string")), F.col("d.corregimiento")).alias("comuna_corregimiento"),
    )
    return texts.select("row_id", "raw").join(out, F.col("raw").eqNullSafe(F.col("raw_")), "left").drop("raw_").withColumnRenamed("raw", "direccion_entrada")
