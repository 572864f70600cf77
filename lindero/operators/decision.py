"""The decision layer: what a match violates, whether it stands, and how sure it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C

# Statuses, the window within which rivals compete, and its tolerance.
STATUSES = ("OK", "SIN_MATCH", "NO_PARSEABLE", "FUERA_DE_AREA", "ERROR")
RIVAL_WINDOW, EPS, SOFT_PLATE = 0.05, 1e-9, 2


def _differs(a: Column, b: Column) -> Column:
    return a.isNotNull() & b.isNotNull() & (F.ltrim(a, F.lit("0")) != F.ltrim(b, F.lit("0")))


def violations(q: Column, c: Column, struct: Column, min_struct: float = 0.6, plate_tolerance: int = 0, soft: frozenset[str] = frozenset()) -> Column:
    """Messages in order, as array<struct<msg, soft>>, of what a parsed text q and a catalogue address c disagree in."""
    both = lambda n: q[n].isNotNull() & c[n].isNotNull() & (q[n] != c[n])
    said = lambda label, a, b: F.concat(F.lit(label + " "), a, F.lit(" != "), b)
    rule = lambda when, msg, is_soft: F.when(when, F.struct(msg.alias("msg"), (is_soft if isinstance(is_soft, Column) else F.lit(is_soft)).alias("soft")))
    delta = F.abs(F.coalesce(q["plate"].try_cast("int"), F.lit(0)) - F.coalesce(c["plate"].try_cast("int"), F.lit(0)))
    numeric = q["plate"].rlike("^\\d+$") & c["plate"].rlike("^\\d+$")
    found = [
        rule(both("via_type"), said("tipo de via", q["via_type"], c["via_type"]), False),
        rule(_differs(q["via_number"], c["via_number"]), said("numero de via", q["via_number"], c["via_number"]), False),
        rule(_differs(q["cross_number"], c["cross_number"]), said("numero de cruce", q["cross_number"], c["cross_number"]), False),
        rule(_differs(q["plate"], c["plate"]) & ~(numeric & (delta <= plate_tolerance)), said("placa", q["plate"], c["plate"]), numeric & (delta <= SOFT_PLATE)),
        rule(both("cross_type"), said("tipo de cruce", q["cross_type"], c["cross_type"]), False),
    ]
    none = lambda x: F.when(x == "", F.lit("-")).otherwise(x)
    for name, label in (("via_letters", "letra de via"), ("cross_letters", "letra de cruce"), ("via_suffix_letters", "letra de sufijo de via"), ("cross_suffix_letters", "letra de sufijo de cruce")):
        x, y = F.upper(F.coalesce(q[name], F.lit(""))), F.upper(F.coalesce(c[name], F.lit("")))
        side = name.split("_")[0]
        if "suffix" not in name:
            point = F.when(F.right(x, F.lit(1)) == "N", "NORTE").when(F.right(x, F.lit(1)).isin("O", "W"), "OESTE")
            x = F.when(q[side + "_quadrant"].isNull() & (point == c[side + "_quadrant"]), F.trim(F.left(x, F.length(x) - 1))).otherwise(x)
        one_sided = (x == "") | (y == "")
        if name == "via_letters":
            is_soft = one_sided | F.lit("letra_via" in soft)
        elif name == "cross_letters":
            is_soft = F.lit("letra_cruce" in soft) | (one_sided & F.lit("letra_cruce_una_cara" in soft))
        else:
            is_soft = F.lit(False)
        found.append(rule(x != y, said(label, none(x), none(y)), is_soft))
    for name, label, key in (("via_bis", "BIS de via", "bis_via"), ("cross_bis", "BIS de cruce", "bis_cruce")):
        yes = lambda b: F.when(b, "si").otherwise("no")
        found.append(rule(q[name] != c[name], said(label, yes(q[name]), yes(c[name])), key in soft))
    for name, label in (("via_quadrant", "cuadrante de via"), ("cross_quadrant", "cuadrante de cruce")):
        found.append(rule(both(name), said(label, q[name], c[name]), False))
    points = F.filter(F.split(F.coalesce(q["complement"], F.lit("")), " "), lambda w: w.isin("NORTE", "SUR", "ESTE", "OESTE", "OE", "NTE"))
    points = F.transform(points, lambda w: F.when(w == "OE", "OESTE").when(w == "NTE", "NORTE").otherwise(w))
    known = F.array_union(F.split(F.coalesce(c["complement"], F.lit("")), " "), F.array(F.coalesce(c["via_quadrant"], F.lit("")), F.coalesce(c["cross_quadrant"], F.lit(""))))
    missing = F.get(F.filter(points, lambda w: ~F.array_contains(known, w)), F.lit(0))
    found.append(rule(missing.isNotNull(), F.concat(F.lit("cuadrante de complemento "), missing), "cuadrante_compl" in soft))
    found.append(rule(struct < min_struct, F.concat(F.lit("coincidencia estructural "), F.format_string("%.2f", struct), F.lit(f" < {min_struct:.2f}")), False))
    listed = F.filter(F.array(*found), lambda v: v.isNotNull())
    return F.when(~c["parse_ok"], F.array(F.struct(F.lit("candidato catastral no parseable").alias("msg"), F.lit(False).alias("soft")))).otherwise(listed)


def level(parse: Column) -> Column:
    return F.when(parse["plate"].isNull(), "esquina").when(parse["cross_number"].isNull(), "via").otherwise("predio")


def competed(candidates: DataFrame, threshold: float, by: str = "row_id") -> DataFrame:
    """The best candidate of each row with its margins over the rivals.

    candidates: row_id, slot, doc_id, manzana, score, ok (passes the rules). margen_manzana: over the
    best rival in another block; margen_predio: over the best other document; n_competidores: rivals
    in other blocks within the window. Null where there is no rival. The best of equals is the first slot.
    """
    w = Window.partitionBy(by)
    best = F.first(F.struct("doc_id", "manzana", "score")).over(w.orderBy(F.desc_nulls_last("score"), "slot").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    c = candidates.withColumn("score", C.clean_double(F.col("score"))).withColumn("best", best)
    rival = F.col("ok") & (F.col("doc_id") != F.col("best.doc_id")) & (F.col("score") >= threshold)
    elsewhere = rival & (F.col("manzana") != F.col("best.manzana"))
    gap = F.greatest(F.col("best.score") - F.col("score"), F.lit(0.0))
    return c.groupBy(by).agg(
        F.first("best.doc_id").alias("doc_id"),
        F.first("best.manzana").alias("manzana"),
        F.first("best.score").alias("score"),
        F.min(F.when(elsewhere, gap)).alias("margen_manzana"),
        F.min(F.when(rival, gap)).alias("margen_predio"),
        F.count_if(elsewhere & (gap <= RIVAL_WINDOW + EPS)).alias("n_competidores"),
    )


def decided(rows: DataFrame, threshold: float, max_soft: int = 1, delta: float = 0.0) -> DataFrame:
    """rows with estado, motivo and nivel_precision.

    rows: outside, municipality, placeholder, parse_ok, notes, score (null without a candidate), gated
    (label of the gate that left none, or null), hard and soft (messages), margen_manzana,
    n_competidores, n_predios, manzana_nunique, level.
    """
    shown = lambda x: F.format_string("%.2f", x)
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("score", F.lit(0.0))))
    messages = F.concat_ws("; ", F.concat("hard", "soft"))
    low = F.concat(F.lit("confianza "), shown(clipped), F.lit(" < umbral "), F.lit(f"{threshold:g}"))
    shared = F.col("n_predios") > 1
    approx = F.when(F.size("soft") > 0, F.concat(F.lit("aproximado: "), F.concat_ws("; ", "soft")))
    notes = F.concat_ws("; ", approx, F.when(shared, F.concat(F.lit("direccion compartida por "), F.col("n_predios"), F.lit(" predios"))))
    ladder = [
        (F.col("outside"), "FUERA_DE_AREA", F.concat(F.lit("municipio distinto de Cali: '"), "municipality", F.lit("'"))),
        (F.col("placeholder"), "SIN_MATCH", F.lit("dato vacio o marcador sin informacion")),
        (F.startswith(F.get("notes", F.lit(0)), F.lit(C.FAILED)), "ERROR", C.short_message(F.substr(F.get("notes", F.lit(0)), F.lit(len(C.FAILED) + 1)))),
        (~F.col("parse_ok"), "NO_PARSEABLE", F.coalesce(F.nullif(F.concat_ws("; ", "notes"), F.lit("")), F.lit("gramatica de direccion no reconocida"))),
        (F.col("gated").isNotNull(), "SIN_MATCH", F.concat(F.lit("candidatos fuera de "), "gated")),
        (F.col("score").isNull() | (clipped < threshold), "SIN_MATCH", low),
        ((F.size("hard") > 0) | (F.size("soft") > max_soft), "SIN_MATCH", messages),
        (F.lit(delta > 0) & (F.col("margen_manzana") < delta), "SIN_MATCH", F.concat(F.lit("ambiguo: "), F.greatest("n_competidores", F.lit(1)), F.lit(" candidatos cercanos en otras manzanas"))),
    ]
    status, reason = F.lit("OK"), F.nullif(notes, F.lit(""))
    for when, name, why in reversed(ladder):
        status, reason = F.when(F.coalesce(when, F.lit(False)), name).otherwise(status), F.when(F.coalesce(when, F.lit(False)), why).otherwise(reason)
    precision = C.least_precise(F.col("level"), F.when(F.size("soft") > 0, "manzana").otherwise("predio"), F.when(shared & (F.col("manzana_nunique") > 1), "direccion").when(shared, "manzana").otherwise("predio"))
    return rows.withColumn("estado", status).withColumn("motivo", reason).withColumn("nivel_precision", F.when(F.col("estado") == "OK", precision))
