"""Evaluation roll-ups, threshold and weight sweeps, and calibration fits."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from .catalogue import numbered, running
from .decision import STATUSES


def share(flag: str) -> Column:
    """Share of true among those that are not null."""
    return F.avg(F.col(flag).cast("int"))


def status_counts(rows: DataFrame, statuses: Sequence[str] = STATUSES) -> DataFrame:
    """One row: total, and a column per status."""
    return rows.agg(F.count("*").alias("total"), *[F.count_if(F.col("estado") == s).alias("n_" + s.lower()) for s in statuses])


def strict_summary(rows: DataFrame) -> DataFrame:
    """Per dataset and status, and per status over all (dataset ALL): rows, rows with truth, shares of correct ones."""
    keys = rows.groupingSets([[F.col("dataset"), F.col("estado")], [F.col("estado")]], "dataset", "estado")
    out = keys.agg(
        F.grouping("dataset").alias("g"), F.count("*").alias("n"), F.count_if("has_gt").alias("n_gt"), share("correct_manzana").alias("manzana"), share("correct_predial").alias("predial"),
        F.count_if(F.col("correct_manzana").isNull()).alias("n_unknown"),
    )
    return out.select(F.when(F.col("g") == 1, "ALL").otherwise(F.col("dataset")).alias("dataset"), "estado", "n", "n_gt", "manzana", "predial", "n_unknown")


def level_breakdown(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.coalesce(F.nullif(F.trim("nivel_precision"), F.lit("")), F.lit("(vacio)")).alias("nivel_precision")).agg(F.count("*").alias("n"))


def reason_breakdown(rows: DataFrame, flag: str = "correct_manzana") -> DataFrame:
    return rows.groupBy(C.reason_stem(F.col("motivo")).alias("motivo")).agg(
        F.count("*").alias("n"), F.count_if(F.col(flag)).alias("n_true"), F.count_if(~F.col(flag)).alias("n_false"), F.count_if(F.col(flag).isNull()).alias("n_null")
    )


def metric_table(rows: DataFrame, by: str, within: Sequence[int] = (25, 50, 100, 250)) -> DataFrame:
    """Per group: rows, matched and top-k shares, median and mean distance, shares within distances."""
    d = C.clean_double(F.col("dist_m"))
    return rows.groupBy(by).agg(
        F.count("*").alias("n"), share("matched").alias("match_rate"), share("top1").alias("top1"), share("top5").alias("top5"),
        F.median(d).alias("median_m"), F.avg(d).alias("mean_m"), F.percentile(d, F.lit(0.9)).alias("p90_m"), *[F.avg((d <= m).cast("int")).alias(f"within_{m}") for m in within],
    )


def correctness(rows: DataFrame) -> DataFrame:
    """rows (gt, ids: ranked document ids) with top1, top5 and topk; null without truth."""
    has = F.col("gt").isNotNull()
    hit = lambda k: F.when(has, F.coalesce(F.array_contains(F.slice("ids", 1, k) if k else F.col("ids"), F.col("gt")), F.lit(False)))
    return rows.withColumns({"top1": hit(1), "top5": hit(5), "topk": hit(0)})


def calibration_bins(rows: DataFrame, edges: Sequence[float]) -> DataFrame:
    """Left-closed bins of p: rows, mean p, share correct, median p."""
    b = F.lit(None).cast("int")
    for k in range(len(edges) - 1):
        top = (F.col("p") <= edges[k + 1]) if k == len(edges) - 2 else (F.col("p") < edges[k + 1])
        b = F.when((F.col("p") >= edges[k]) & top, k).otherwise(b)
    return rows.withColumn("bin", b).where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), share("correct").alias("accuracy"), F.median("p").alias("median_p"))


def confusion(rows: DataFrame, truth: str, predicted: str, values: Sequence[str]) -> DataFrame:
    return rows.groupBy(truth).pivot(predicted, list(values)).count().na.fill(0)


def equal_bins(rows: DataFrame, bins: int, order: Sequence[str]) -> DataFrame:
    """rows with bin, from 1: equal-count bins in the order of columns of distinct values, the remainder in the first ones."""
    n, k = F.col("n_"), F.col("k_")
    size, rest = F.floor(n / bins), n % bins
    long = rest * (size + 1)  # rows in the bins that hold one more
    at = F.when(k < long, F.floor(k / (size + 1))).otherwise(rest + F.floor((k - long) / F.greatest(size, F.lit(1))))
    counted = numbered(rows, order, "k_").join(F.broadcast(rows.agg(F.count("*").alias("n_"))), F.lit(True))  # one row
    return counted.withColumn("bin", (at + 1).cast("int")).drop("n_", "k_")


def empirical_cdf(rows: DataFrame, value: str) -> DataFrame:
    """Per distinct value x: n, and the share of rows at most x. Missing values do not count."""
    x = C.clean_double(F.col(value))
    per = rows.where(x.isNotNull()).groupBy(x.alias("x")).agg(F.count("*").alias("n"))
    total = per.agg(F.sum("n").alias("all_"))
    return running(per, ["x"], F.col("n"), "below_").join(F.broadcast(total), F.lit(True)).select("x", "n", ((F.col("below_") + F.col("n")) / F.col("all_")).alias("share"))  # one row


def brier_and_ece(rows: DataFrame, bins: int = 5, order: Sequence[str] = ("p", "id")) -> DataFrame:
    """One row: n, Brier score, log loss, expected calibration error."""
    y, p = F.col("correct").cast("int"), F.col("p")
    q = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), p))
    per = equal_bins(rows, bins, order).groupBy("bin").agg(
        F.count("*").alias("n"), F.sum(F.pow(p - y, 2)).alias("b"), F.sum(-(y * F.log(q) + (1 - y) * F.log(1 - q))).alias("l"), (F.abs(F.avg(p) - F.avg(y)) * F.count("*")).alias("e")
    )
    n = F.sum("n")
    return per.agg(n.alias("n"), (F.sum("b") / n).alias("brier"), (F.sum("l") / n).alias("log_loss"), (F.sum("e") / n).alias("ece"))


def auc(rows: DataFrame, score: str = "p", flag: str = "correct") -> DataFrame:
    """Area under the ROC curve by average ranks, from counts per distinct score."""
    per = rows.groupBy(score).agg(F.count_if(F.col(flag)).alias("pos"), F.count_if(~F.col(flag)).alias("neg"))
    return running(per, [score], F.col("neg"), "below").withColumn("w", F.col("pos") * (F.col("below") + F.col("neg") / 2)).agg((F.sum("w") / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))).alias("auc"))


def threshold_sweep(rows: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """rows (score, correct, is_junk, w): weighted precision, recall and F1 at each threshold.

    Rows are summed per interval of thresholds first, so each row is counted once; the sweep is a
    cumulative sum over the intervals.
    """
    at = F.array(*map(F.lit, map(float, thresholds)))
    k = F.size(F.filter(at, lambda t: F.col("score") >= t))
    real = ~F.col("is_junk")
    per = rows.groupBy(k.alias("k")).agg(F.sum(F.when(real & F.col("correct"), F.col("w")).otherwise(0.0)).alias("tp"), F.sum("w").alias("all"), F.sum(F.when(real, F.col("w")).otherwise(0.0)).alias("real"))
    grid = rows.sparkSession.createDataFrame([(i + 1, float(t)) for i, t in enumerate(sorted(thresholds))], "i int, threshold double")
    joined = grid.join(F.broadcast(per), F.lit(True), "left").groupBy("i", "threshold").agg(  # one row per interval on either side
        F.sum(F.when(F.col("k") >= F.col("i"), F.col("tp")).otherwise(0.0)).alias("tp"), F.sum(F.when(F.col("k") >= F.col("i"), F.col("all")).otherwise(0.0)).alias("matched"), F.sum("real").alias("real")
    )
    p, r = F.coalesce(F.col("tp") / F.nullif("matched", F.lit(0.0)), F.lit(0.0)), F.coalesce(F.col("tp") / F.nullif("real", F.lit(0.0)), F.lit(0.0))
    return joined.select("threshold", p.alias("precision"), r.alias("recall"), F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0)).alias("f1"))


def weight_grid(spark: SparkSession, step: int = 20) -> DataFrame:
    """All weight vectors of the simplex in steps of 1 / step with a positive first weight."""
    rows = [(a, b, c, step - a - b - c) for a in range(1, step + 1) for b in range(step - a + 1) for c in range(step - a - b + 1)]
    return spark.createDataFrame([(k, *[x / step for x in r]) for k, r in enumerate(rows)], "combo int, w_sim double, w_fuzz double, w_struct double, w_geo double")


#: Candidates that are scored at once: with 1,540 weight vectors, 25 MB.
SWEEP_ROWS = 2048


def weight_sweep(candidates: DataFrame, grid: DataFrame) -> DataFrame:
    """Per weight vector the share of rows whose best candidate is the true one. candidates: row_id, slot, is_truth, sim, fuzz, struct, geo.

    A row's candidates are brought to one task, which finds every vector's best of them by a matrix
    product, the smaller slot among equal scores (to nine places); only the sums per vector travel.
    """
    spark = candidates.sparkSession
    vectors = grid.orderBy("combo").collect()  # the grid has a fixed size
    shared = spark.sparkContext.broadcast((np.array([v[0] for v in vectors], np.int32), np.array([[v[f"w_{c}"] for v in vectors] for c in ("sim", "fuzz", "struct", "geo")]).reshape(4, -1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        combos, w = shared.value
        hits, n = np.zeros(len(combos), np.int64), 0
        held: pa.Table | None = None

        def add(t: pa.Table) -> None:
            nonlocal n
            row = t.column("row_id").to_numpy()
            start = np.append(0, np.flatnonzero(row[1:] != row[:-1]) + 1)
            x = np.stack([t.column(c).to_numpy() for c in ("sim", "fuzz", "struct", "geo")], 1).astype(float)
            truth = t.column("is_truth").fill_null(False).to_numpy()
            bounds = np.append(start, len(row))
            i = 0
            while i < len(start):
                j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + SWEEP_ROWS, "right")) - 1)
                a, z = bounds[i], bounds[j]
                score = np.round(x[a:z] @ w, 9)
                of = np.repeat(np.arange(j - i), np.diff(bounds[i : j + 1]))
                best = np.maximum.reduceat(score, bounds[i:j] - a)
                place = np.where(score == best[of], np.arange(z - a)[:, None], z - a)
                hits[:] += truth[a:z][np.minimum.reduceat(place, bounds[i:j] - a)].sum(0)
                n += j - i
                i = j

        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            row = t.column("row_id").to_numpy()
            last = int(np.flatnonzero(row != row[-1])[-1]) + 1 if (row != row[-1]).any() else 0  # the last row may go on in the next batch
            if last:
                add(t.slice(0, last))
            held = t.slice(last)
        if held is not None:
            add(held)
        yield pa.RecordBatch.from_pydict({"combo": pa.array(combos), "hits": pa.array(hits), "n": pa.array(np.full(len(combos), n))})

    rows = candidates.select("row_id", "slot", "is_truth", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in ("sim", "fuzz", "struct", "geo")])
    sums = rows.repartition("row_id").sortWithinPartitions("row_id", "slot").mapInArrow(run, "combo int, hits long, n long")
    return sums.groupBy("combo").agg(F.sum("n").alias("n"), (F.sum("hits") / F.sum("n")).alias("top1"))


def margin_sweep(rows: DataFrame, deltas: Sequence[float]) -> DataFrame:
    """Per delta, of OK rows with truth: kept and abstained, correct and wrong ones of either."""
    ok = rows.where((F.col("estado") == "OK") & F.col("has_gt"))
    keep = lambda d: F.col("margen").isNull() | F.isnan("margen") | (F.col("margen") >= d)
    right = F.col("correct_manzana")
    out = ok.agg(*[F.struct(F.lit(float(d)).alias("delta"), F.count_if(keep(d)).alias("kept"), F.count_if(~keep(d)).alias("abstained"), F.count_if(keep(d) & right).alias("kept_right"), F.count_if(~keep(d) & ~right).alias("dropped_wrong")).alias(f"d{i}") for i, d in enumerate(deltas)])
    return out.select(F.explode(F.array(*[f"d{i}" for i in range(len(deltas))])).alias("x")).select("x.*")


def shrunk_cells(rows: DataFrame, m: float) -> DataFrame:
    """Empirical-Bayes rates: kind and band towards kind, kind towards all. rows: kind, band, correct."""
    y = F.col("correct").cast("int")
    cells = rows.groupBy("kind", "band").agg(F.count("*").alias("n"), F.sum(y).alias("s"))
    kinds = cells.groupBy(F.col("kind").alias("k")).agg(F.sum("n").alias("kn"), F.sum("s").alias("ks"))
    total = cells.agg((F.sum("s") / F.sum("n")).alias("g"))
    kinds = kinds.join(F.broadcast(total), F.lit(True)).withColumn("kr", (F.col("ks") + m * F.col("g")) / (F.col("kn") + m))  # one row
    return cells.join(kinds, F.col("kind") == F.col("k")).select("kind", "band", "n", ((F.col("s") + m * F.col("kr")) / (F.col("n") + m)).alias("rate"), F.col("kr").alias("kind_rate"))


def _pooled(n: list[int], s: list[int]) -> list[int]:
    """Pool adjacent violators: of each place, the first place of the block whose mean is its fit."""
    blocks: list[list[int]] = []  # first place, n, s
    for k, (x, y) in enumerate(zip(n, s)):
        blocks.append([k, x, y])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            _, x, y = blocks.pop()
            blocks[-1][1] += x
            blocks[-1][2] += y
    ends = [b[0] for b in blocks[1:]] + [len(n)]
    return [b[0] for b, end in zip(blocks, ends) for _ in range(b[0], end)]


def isotonic(rows: DataFrame, x: str = "p", flag: str = "correct", parts: int = 256) -> DataFrame:
    """Increasing fit of the share correct over x: x, n, s (right ones) and fit of each distinct value.

    Values are counted, and adjacent violators pooled, within equal parts of x's range first; what
    is left, blocks of increasing means, is pooled in one task. The order of pooling does not matter.
    """
    per = rows.where(F.col(x).isNotNull()).groupBy(F.col(x).alias("x")).agg(F.count("*").alias("n"), F.sum(F.col(flag).cast("int")).alias("s"))
    low, high = rows.agg(F.min(x), F.max(x)).first()
    part = F.least(F.lit(parts - 1), F.floor((F.col("x") - F.lit(low)) / F.lit((high - low) or 1.0) * parts)) if low is not None else F.lit(0)

    def within(t: pa.Table) -> pa.Table:
        t = t.sort_by("x")
        values = t.column("x").to_pylist()
        return t.drop(["part"]).append_column("lo", pa.array([values[k] for k in _pooled(t.column("n").to_pylist(), t.column("s").to_pylist())], pa.float64()))

    def across(t: pa.Table) -> pa.Table:
        t = t.sort_by("lo")
        n, s = t.column("n").to_pylist(), t.column("s").to_pylist()
        first, sums = _pooled(n, s), {}
        for k, at in enumerate(first):
            a, b = sums.get(at, (0, 0))
            sums[at] = a + n[k], b + s[k]
        return pa.table({"lo": t.column("lo"), "fit": pa.array([sums[at][1] / sums[at][0] for at in first], pa.float64())})

    local = per.select(F.col("x").cast("double").alias("x"), "n", "s", part.cast("int").alias("part")).groupBy("part").applyInArrow(within, "x double, n long, s long, lo double")
    blocks = local.groupBy("lo").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).withColumn("all", F.lit(0)).groupBy("all").applyInArrow(across, "lo double, fit double")
    return local.join(blocks, "lo").select("x", "n", "s", "fit")


def hybrid(confidence: Column, kind: Column, knots: tuple[Sequence[float], Sequence[float]], q: dict[str, float], q_all: float) -> tuple[Column, Column]:
    """Probabilities of block and parcel: the isotonic value, and its product with the kind's share."""
    block = F.greatest(F.lit(0.02), F.least(F.lit(0.98), C.interpolated(confidence, list(knots[0]), list(knots[1]))))
    known = F.create_map(*[F.lit(x) for pair in q.items() for x in pair]) if q else F.create_map(F.lit(""), F.lit(0.0))
    return block, F.least(block, F.greatest(F.lit(0.001), block * F.coalesce(known[kind], F.lit(float(q_all)))))


def logistic(rows: DataFrame, features: Sequence[str], label: str, c: float = 1.0, positive: str | None = None):
    """A ridge logistic fit of standardised features: means, stds, coefficients, intercept.

    positive: a feature whose coefficient may not be negative; the fit is repeated without it where it is.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    first = rows.agg(F.count("*").alias("n"), *[F.avg(f).alias("m_" + f) for f in features], *[F.stddev_pop(f).alias("s_" + f) for f in features]).first()
    means, stds = {f: first["m_" + f] or 0.0 for f in features}, {f: first["s_" + f] or 1.0 for f in features}

    def fit(use: Sequence[str]):
        z = rows.select(*[C.standardised(F.col(f), means[f], stds[f]).alias(f) for f in use], F.col(label).cast("double").alias("label"))
        model = LogisticRegression(regParam=1 / (c * max(1, first["n"])), elasticNetParam=0.0, standardization=False, maxIter=200).fit(VectorAssembler(inputCols=list(use), outputCol="features").transform(z))
        return dict(zip(use, model.coefficients.toArray().tolist())), float(model.intercept)

    coef, intercept = fit(features)
    if positive and coef.get(positive, 0.0) < 0:
        coef, intercept = fit([f for f in features if f != positive])
    return {"means": means, "stds": stds, "coef": coef, "intercept": intercept}


def profile(df: DataFrame, exact: bool = True) -> DataFrame:
    """Per column: non-null, null and distinct values, in one pass."""
    count = F.count_distinct if exact else F.approx_count_distinct
    one = df.agg(F.count("*").alias("n_"), *[F.struct(F.count(c).alias("non_null"), count(F.col(c)).alias("n_unique")).alias("c_" + c) for c in df.columns])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col("c_" + c + ".non_null").alias("non_null"), (F.col("n_") - F.col("c_" + c + ".non_null")).alias("nulls"), F.col("c_" + c + ".n_unique").alias("n_unique")) for c in df.columns])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def logistic_score(model: dict) -> Column:
    """The probability that a fit of logistic() gives a row."""
    z = F.lit(model["intercept"])
    for f, w in model["coef"].items():
        z = z + w * C.standardised(F.col(f), model["means"][f], model["stds"][f])
    return C.sigmoid(z)


def log_loss(rows: DataFrame, p: Column, label: str) -> float:
    q, y = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), p)), F.col(label).cast("int")
    return rows.agg(F.avg(-(y * F.log(q) + (1 - y) * F.log(1 - q)))).first()[0] or 0.0


def nested_leave_one_out(rows: DataFrame, features: Sequence[str], label: str, group: str, grid: Sequence[float] = (0.1, 1.0, 10.0)) -> DataFrame:
    """rows with p, predicted for each group by a fit on the others; the ridge is chosen on these alone, by the same scheme.

    A loop over the groups (data sets, a handful) on the driver; each fit is distributed.
    """
    groups = [r[0] for r in rows.select(group).distinct().orderBy(group).collect()]
    out = None
    for g in groups:
        train = rows.where(F.col(group) != g)
        inner = [h for h in groups if h != g]

        def loss(c: float, train: DataFrame = train, inner: list = inner) -> float:
            fits = [(h, logistic(train.where(F.col(group) != h), features, label, c)) for h in inner] if len(inner) > 1 else [(inner[0], logistic(train, features, label, c))]
            return sum(log_loss(train.where(F.col(group) == h), logistic_score(m), label) for h, m in fits)

        best = min(grid, key=loss) if inner else grid[0]
        one = rows.where(F.col(group) == g).withColumn("p", logistic_score(logistic(train, features, label, best)))
        out = one if out is None else out.unionByName(one)
    return out


def ships(new: dict[str, float], old: dict[str, float], tolerance: float = 0.0) -> bool:
    """Whether a calibration replaces another: a lower Brier score and no worse calibration error."""
    return new["brier"] < old["brier"] and new["ece"] <= old["ece"] + tolerance


# ---- against a truth and against another geocoder ------------------------------------------------

# Words of rural addresses and of units inside a lot, and the families of failures.
RURAL = ("PANCE", "NAVARRO", "PICHINDE", "ELVIRA", "LEONERA", "GOLONDRINAS", "SALADITO", "FELIDIA", "MONTEBELLO", "VILLACARMELO", "HORMIGUERO", "CORREGIMIENTO", "CGTO", "VEREDA", "VDA")
UNITS = ("AP", "TO", "BLQ", "CA", "LT", "MZ", "INT", "CONJ", "ED", "PH", "OF")
NO_ANSWER = "(no answer)"


def recall_at(rows: DataFrame, ks: Sequence[int] = (1, 5, 20)) -> DataFrame:
    """One row: n, and the share of rows (gt, ids) whose truth is among the first k, for each k."""
    known = rows.where(F.col("gt").isNotNull())
    return known.agg(F.count("*").alias("n"), *[F.avg(F.coalesce(F.array_contains(F.slice("ids", 1, k), F.col("gt")), F.lit(False)).cast("int")).alias(f"recall_{k}") for k in ks])


def run_totals(rows: DataFrame, samples: int = 5) -> DataFrame:
    """Per status and level: n, and of errors up to so many reasons, the smallest rows' first. A task passes on that many only."""
    level = F.coalesce(F.nullif("nivel_precision", F.lit("")), F.lit("(vacio)"))
    per = rows.groupBy("estado", level.alias("nivel_precision")).agg(F.count("*").alias("n"))
    errors = rows.where("estado = 'ERROR'").select("row_id", "motivo").orderBy("row_id").limit(samples).agg(F.transform(F.array_sort(F.collect_list(F.struct("row_id", "motivo"))), lambda x: x["motivo"]).alias("errors"))
    return per.join(F.broadcast(errors), F.lit(True)).withColumn("errors", F.when(F.col("estado") == "ERROR", F.col("errors")).otherwise(F.array().cast("array<string>")))  # one row


def external_agreement(rows: DataFrame, by: str = "dataset") -> DataFrame:
    """Per group how ours (canonical, lat, lon, matched) agrees with another geocoder's answer (other, other_lat, other_lon)."""
    ours, theirs = (F.trim(F.coalesce(c, F.lit(""))) for c in ("canonical", "other"))
    both = F.col("other_lat").isNotNull() & F.col("lat").isNotNull()
    d = F.when(both, C.haversine_m(F.col("other_lat"), F.col("other_lon"), F.col("lat"), F.col("lon")))
    yes = lambda c: F.avg(c.cast("int"))
    return rows.groupBy(by).agg(
        F.count("*").alias("n"), yes(F.col("other").isNotNull()).alias("answered"), yes(theirs != "").alias("normalized"), yes(F.col("other_lat").isNotNull()).alias("located"), yes(F.coalesce("matched", F.lit(False))).alias("matched"),
        yes((ours == theirs) & (ours != "")).alias("exact"), yes((ours != "") & (C.match_key(ours) == C.match_key(theirs))).alias("same_key"), F.count_if(both).alias("both_located"),
        F.median(d).alias("median_m"), yes(d <= 50).alias("within_50"), yes(d <= 100).alias("within_100"),
    )


def accuracy_by_class(rows: DataFrame, of: str = "other_class") -> DataFrame:
    """Of rows with a truth, accuracy per class of another geocoder's answer."""
    return rows.where("has_gt").groupBy(F.coalesce(of, F.lit(NO_ANSWER)).alias(of)).agg(
        F.count("*").alias("n"), share("top1").alias("top1"), share("top5").alias("top5"), share("correct_manzana").alias("manzana"), F.median("dist_m").alias("median_m"), F.avg("confidence").alias("confidence")
    )


def field_agreement(rows: DataFrame, a: Column, b: Column, by: str = "dataset", names: Sequence[str] = ("via_type", "via_number", "via_letters", "cross_number", "plate")) -> DataFrame:
    """Per group the share of rows that parse on both sides, and of these the share in which each part is the same (absent in both included)."""
    both = a["parse_ok"] & b["parse_ok"]
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.avg(both.cast("int")).alias("both_parse_ok"), *[F.avg(F.when(both, a[n].eqNullSafe(b[n]).cast("int"))).alias(n) for n in names])


def failure_family(raw: Column, parse_ok: Column, notes: Column, canonical: Column, comuna: Column, gt_comuna: Column, dist_m: Column) -> Column:
    """What kind of failure a wrong first candidate is. notes: joined."""
    said = F.upper(F.coalesce(raw, F.lit("")))
    rural = said.rlike("|".join(RURAL))
    text = F.concat(F.lit(" "), F.coalesce(canonical, F.lit("")), F.lit(" "))
    unread = F.when(rural, "unparseable: rural / corregimiento").when(F.coalesce(notes, F.lit("")).rlike("no_alphabetic_content|empty"), "unparseable: no address content").otherwise("unparseable: free text / non-address")
    return (
        F.when(~parse_ok, unread)
        .when(rural, "rural / corregimiento (not in urbano_terreno)")
        .when(text.rlike(f" ({'|'.join(UNITS)}) "), "condominium / lote complement")
        .when(~text.contains(" # "), "missing cross number")
        .when(gt_comuna.isNotNull() & ~comuna.eqNullSafe(gt_comuna), "wrong comuna (geographic confusion)")
        .when(dist_m <= 150, "near miss: neighbouring parcel")
        .otherwise("other: letter/number mismatch")
    )


def reference_quality(rows: DataFrame, of: str = "other_class") -> DataFrame:
    """Of rows with a truth, per class of another geocoder's answer: how often both name the same address, and how far apart their points are."""
    d = C.haversine_m(F.col("gt_lat"), F.col("gt_lon"), F.col("other_lat"), F.col("other_lon"))
    same = C.match_key(F.coalesce("gt_address", F.lit(""))) == C.match_key(F.coalesce("other", F.lit("")))
    return rows.where("has_gt").groupBy(F.coalesce(of, F.lit(NO_ANSWER)).alias(of)).agg(
        F.count("*").alias("n"), F.avg(same.cast("int")).alias("same_address"), F.count(d).alias("n_points"), F.median(d).alias("median_m"), F.percentile(d, F.lit(0.9)).alias("p90_m"), F.avg((d <= 25).cast("int")).alias("within_25")
    )


def distance_buckets(rows: DataFrame, edges: Sequence[float], distance: str = "dist_m") -> DataFrame:
    """Rows per bucket of distances (low, high]: the first bucket takes what is at most the first edge, the last what is beyond all."""
    d = C.clean_double(F.col(distance))
    k = F.lit(len(edges))
    for i, e in reversed(list(enumerate(edges))):
        k = F.when(d <= e, i).otherwise(k)
    return rows.where(d.isNotNull()).groupBy(k.alias("bucket")).agg(F.count("*").alias("n"), F.min(d).alias("least"), F.max(d).alias("most"))
