"""What a calibrated probability rests on: features of a match, its cell, rates per kind, and their tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from .evaluation import equal_bins, share

# Kinds of matches; bands of margins with their lower bounds; clips of margins, competitors and probabilities; names of the features.
KINDS = ("exacto", "relajada", "compartida", "parcial")
BANDS = {"holgado": 0.10, "0.05-0.10": 0.05, "0.02-0.05": 0.02, "<0.02": None}
MARGIN_CLIP, COMPETITOR_CLIP, P_MIN, P_MAX = 0.3, 5, 0.001, 0.999
LEVELS = ("esquina", "via", "manzana", "direccion")
FEATURES = (
    "confidence", "struct", "relaxed_letter", "relaxed_plate", "log_n_predios", "nivel_esquina", "nivel_via", "nivel_manzana", "nivel_direccion",
    "gate_applied", "margen_manzana", "margen_predio", "n_competidores",
)


def _clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def features(rows: DataFrame, name: str = "features") -> DataFrame:
    """rows with a struct of the features (doubles): levels as flags against predio, shared lots as a logarithm, margins clipped, a missing one as no competition.

    rows: confidence, struct, relaxed_letter, relaxed_plate, n_predios, nivel_precision, gate_applied, margen_manzana, margen_predio, n_competidores.
    """
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    margin = lambda c: F.coalesce(_clip(C.clean_double(F.col(c)), 0.0, MARGIN_CLIP), F.lit(MARGIN_CLIP))
    found = {"confidence": F.col("confidence").cast("double"), "struct": F.col("struct").cast("double"), "relaxed_letter": flag(F.col("relaxed_letter")), "relaxed_plate": flag(F.col("relaxed_plate")), "log_n_predios": F.log(F.greatest(F.col("n_predios"), F.lit(1)))}
    found |= {f"nivel_{level}": flag(F.col("nivel_precision") == level) for level in LEVELS}
    found |= {"gate_applied": flag(F.col("gate_applied")), "margen_manzana": margin("margen_manzana"), "margen_predio": margin("margen_predio"), "n_competidores": _clip(F.coalesce("n_competidores", F.lit(0)), 0, COMPETITOR_CLIP).cast("double")}
    return rows.withColumn(name, F.struct(*[found[f].alias(f) for f in FEATURES]))


def kind(f: Column) -> Column:
    """Of a struct of features: relaxed before partial before shared."""
    on = lambda *names: F.greatest(*[f[n] for n in names]) > 0.5
    return F.when(on("relaxed_letter", "relaxed_plate"), "relajada").when(on("nivel_esquina", "nivel_via"), "parcial").when(on("nivel_manzana", "nivel_direccion"), "compartida").otherwise("exacto")


def band(margin: Column) -> Column:
    """The band of a margin; a missing one has no competitor."""
    out, m = F.when(margin.isNull() | F.isnan(margin), "holgado"), margin
    for name, least in BANDS.items():
        out = out.otherwise(name) if least is None else out.when(m >= least, name)
    return out


def cell_rates(rows: DataFrame, cells: DataFrame, kinds: DataFrame, overall: tuple[float, float]) -> DataFrame:
    """rows (kind, band) with p_predio and p_manzana: of the cell, else of the kind, else overall; the block's is never the smaller.

    cells (kind, band, predio, manzana) and kinds (kind, predio, manzana) have a row per cell and kind at most, sixteen and four.
    """
    c = cells.select(F.col("kind").alias("ck"), F.col("band").alias("cb"), F.struct("predio", "manzana").alias("c_"))
    k = kinds.select(F.col("kind").alias("kk"), F.struct("predio", "manzana").alias("k_"))
    joined = rows.join(F.broadcast(c), (F.col("kind") == F.col("ck")) & (F.col("band") == F.col("cb")), "left").join(F.broadcast(k), F.col("kind") == F.col("kk"), "left")
    rate = lambda n, at: _clip(F.coalesce(F.col("c_")[n], F.col("k_")[n], F.lit(float(overall[at]))), P_MIN, P_MAX)
    return joined.select(*rows.columns, rate("predio", 0).alias("p_predio"), F.greatest(rate("manzana", 1), rate("predio", 0)).alias("p_manzana"))


def parcel_rates(rows: DataFrame, m: float) -> DataFrame:
    """Per kind, of rows whose block is right, the share whose parcel is, shrunk towards the share of all: kind, n, hits, q, q_global. rows: kind, correct_manzana, correct_predial."""
    right = rows.where("correct_manzana")
    every = right.agg(F.coalesce(F.avg(F.coalesce("correct_predial", F.lit(False)).cast("double")), F.lit(0.5)).alias("q_global"))
    per = right.groupBy("kind").agg(F.count("*").alias("n"), F.count_if("correct_predial").alias("hits"))
    named = rows.sparkSession.createDataFrame([(k,) for k in KINDS], "kind string").join(F.broadcast(per), "kind", "left").join(F.broadcast(every), F.lit(True))  # four rows, and one
    n, hits = F.coalesce("n", F.lit(0)), F.coalesce("hits", F.lit(0))
    return named.select("kind", n.alias("n"), hits.alias("hits"), ((hits + m * F.col("q_global")) / (n + m)).alias("q"), "q_global")


def bin_table(rows: DataFrame, bins: int = 5) -> DataFrame:
    """Per equal-count bin of p: bin (from 1), n, mean_pred, observed, least and most p. rows: id, p, correct."""
    return equal_bins(rows, bins, ("p", "id")).groupBy("bin").agg(F.count("*").alias("n"), F.avg("p").alias("mean_pred"), share("correct").alias("observed"), F.min("p").alias("least"), F.max("p").alias("most"))


def usable(rows: DataFrame, name: str = "features") -> DataFrame:
    """Rows to calibrate on: decided, with a truth, and with every feature."""
    whole = F.lit(True)
    for f in FEATURES:
        whole = whole & F.col(name)[f].isNotNull()
    return rows.where((F.col("estado") == "OK") & F.col("has_gt") & whole)
