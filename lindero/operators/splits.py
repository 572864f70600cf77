"""Leakage-free splits, seeded samples and label quality."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import nearest_by_md5


class LeakageError(ValueError):
    """Two splits share a key."""


def seeded(key: Column, seed: int) -> Column:
    """A fixed pseudo-random order, the same in every engine that has MD5."""
    return F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}")))


def seeded_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    return df.orderBy(seeded(F.col(key), seed), key).limit(n)


def without_conflicts(df: DataFrame, key: str, value: str) -> DataFrame:
    """Rows whose key has one value only."""
    bad = df.groupBy(F.col(key).alias("k_")).agg(F.min(value).alias("a_"), F.max(value).alias("b_")).where("a_ <> b_").select("k_")
    return df.join(bad, F.col(key) == F.col("k_"), "left_anti")


def keep_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("v")).select(key, "v.*")


def grouped_split(df: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    """df with is_val: whole keys on one side, at least one and at most all but one on the validation side.

    Distinct keys are ranked by hash; the cut is the hash at the wanted rank, found by sorting keys
    alone, so rows are marked by comparing with one value, without a join.
    """
    keys = df.select(key).where(F.col(key).isNotNull()).distinct().withColumn("h_", seeded(F.col(key), seed))
    n = keys.count()
    want = max(1, min(n - 1, round(share * n))) if n > 1 else 0
    cut = keys.orderBy("h_").limit(want).agg(F.max("h_")).first()[0] if want else None
    mark = F.coalesce(seeded(F.col(key), seed) <= F.lit(cut), F.lit(False)) if cut is not None else F.lit(False)
    return df.withColumn("is_val", mark)


def overlap_matrix(splits: dict[str, DataFrame], key: str) -> DataFrame:
    """Distinct keys that each pair of splits shares: a, b, n. One pass: keys with the splits that hold them."""
    tagged = None
    for name, df in splits.items():
        one = df.select(F.col(key).alias("k"), F.lit(name).alias("split")).where("k is not null").distinct()
        tagged = one if tagged is None else tagged.unionByName(one)
    held = tagged.groupBy("k").agg(F.collect_set("split").alias("s"))
    return held.select(F.explode("s").alias("a"), "s").select("a", F.explode("s").alias("b")).groupBy("a", "b").agg(F.count("*").alias("n"))


def assert_disjoint(splits: dict[str, DataFrame], key: str) -> None:
    shared = overlap_matrix(splits, key).where("a < b").collect()
    if shared:
        raise LeakageError("; ".join(f"{r.a} and {r.b} share {r.n} keys" for r in shared))


def label_quality(rows: DataFrame, a: Column, b: Column, name: str = "gt_quality") -> DataFrame:
    """gold where both parse and agree in all street parts, cross number and plate; no_gt without a truth; else noisy. a, b: parsed structs, b null without a truth."""
    from ..functions.columns import plate_agrees

    via = F.lit(True)
    for f in ("type", "number", "letters", "suffix", "suffix_letters", "bis", "quadrant"):
        via = via & a["via_" + f].eqNullSafe(b["via_" + f])
    gold = a["parse_ok"] & b["parse_ok"] & via & (a["cross_number"] == b["cross_number"]) & F.coalesce(plate_agrees(a["plate"], b["plate"]), F.lit(False))
    return rows.withColumn(name, F.when(b.isNull(), "no_gt").when(F.coalesce(gold, F.lit(False)), "gold").otherwise("noisy"))


def band_neighbours(docs: DataFrame, face: list[str], most: int, n: int) -> DataFrame:
    """Up to n neighbours of each document on its face whose plates differ by 1 to most: doc_id, neg_doc_id, delta, slot.

    The band is an equality join too: a document looks into its own and the two next buckets of width
    most, so a crowded face does not pair all with all.
    """
    d = docs.select("doc_id", *face, "plate_no").where("plate_no is not null").withColumn("bucket", F.floor(F.col("plate_no") / most))
    o = d.select(*face, "bucket", F.col("doc_id").alias("neg_doc_id"), F.col("plate_no").alias("other_no"))
    look = d.withColumn("bucket", F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)))
    delta = F.abs(F.col("plate_no") - F.col("other_no"))
    near = look.join(o, [*face, "bucket"]).withColumn("delta", delta).where(F.col("delta").between(1, most))
    return near.withColumn("slot", F.row_number().over(Window.partitionBy("doc_id").orderBy("delta", "other_no", "neg_doc_id"))).where(F.col("slot") <= n).select("doc_id", "neg_doc_id", "delta", "slot")


#: Documents of a corner that are compared at once with as many others.
CORNER_LIST = 2048


def corner_neighbours(docs: DataFrame, seed: int, n: int = 2) -> DataFrame:
    """Documents with the same plate whose via and cross are swapped, the first n in a seeded order: doc_id, neg_doc_id, slot.

    A corner's documents travel in lists of about CORNER_LIST. Each list meets every list of the
    opposite corner in one row, where all pairs are ranked; only the first n of a list leave it, so no
    pair is stored.
    """
    corner = ["via", "cross", "plate"]
    kind = docs.schema["doc_id"].dataType
    said = F.coalesce(F.concat(F.col("doc_id").cast("string"), F.lit("|")), F.lit(""))
    d = docs.select("doc_id", *corner, said.alias("said")).where("via <> cross and plate is not null")
    sizes = d.groupBy(*corner).agg(F.ceil(F.count("*") / CORNER_LIST).cast("int").alias("lists"))
    # Corners without an opposite one leave here; lists_ is how many lists the opposite one has.
    facing = sizes.select(F.col("via").alias("cross"), F.col("cross").alias("via"), "plate", F.col("lists").alias("lists_"))
    dealt = d.join(sizes.join(facing, corner), corner).withColumn("list", F.expr("pmod(xxhash64(said), lists)"))
    lists = dealt.groupBy(*corner, "list").agg(F.collect_list(F.struct("doc_id", "said")).alias("docs"), F.first("lists_").alias("lists_"))
    asked = lists.select(*corner, F.col("list").cast("int").alias("list"), F.col("docs").alias("a"))
    # A list goes to each list of the opposite corner, so a large corner is many rows of many tasks.
    others = lists.select(F.col("via").alias("cross"), F.col("cross").alias("via"), "plate", F.explode(F.sequence(F.lit(0), F.col("lists_") - 1)).alias("list"), F.col("docs").alias("b"))
    pairs = asked.join(others, [*corner, "list"]).select("a", "b")

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                a, b = (batch.column(c)[k].values for c in ("a", "b"))
                left, right = ([x.encode() for x in v.field("said").to_pylist()] for v in (a, b))
                best = list(nearest_by_md5(left, [x + str(seed).encode() for x in right], n))
                i, j, order = zip(*best)
                yield pa.RecordBatch.from_pydict({"doc_id": a.field("doc_id").take(pa.array(i)), "neg_doc_id": b.field("doc_id").take(pa.array(j)), "order": pa.array(order, pa.binary())})

    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("neg_doc_id", kind), T.StructField("order", T.BinaryType())])
    best = pairs.mapInArrow(rank, schema)
    return best.withColumn("slot", F.row_number().over(Window.partitionBy("doc_id").orderBy("order"))).where(F.col("slot") <= n).select("doc_id", "neg_doc_id", "slot")


def same_block_pairs(docs: DataFrame, seed: int, slots: int = 2, block: str = "manzana") -> DataFrame:
    """For each document others of its block, by slot from 0, never itself: those that follow it in a seeded order, in a circle. doc_id, slot, neg_doc_id.

    A block of one document gives none; one with fewer others than slots repeats them. It is a join on
    place in the order, so a block costs as many rows as it has documents, times the slots.
    """
    order = Window.partitionBy(block).orderBy(F.md5(F.concat_ws("|", "doc_id", F.lit(seed))), "doc_id")
    d = docs.where(F.col(block).isNotNull()).select("doc_id", F.col(block).alias("b"), F.row_number().over(order).alias("at"))
    sizes = d.groupBy(F.col("b").alias("sb")).agg(F.count("*").alias("size")).where("size > 1")
    sized = d.join(sizes, F.col("b") == F.col("sb")).drop("sb")
    looks = sized.withColumn("slot", F.explode(F.array(*map(F.lit, range(slots)))))
    step = F.col("slot") % (F.col("size") - 1) + 1
    looks = looks.withColumn("want", (F.col("at") - 1 + step) % F.col("size") + 1)
    others = d.select(F.col("b").alias("ob"), F.col("at").alias("oat"), F.col("doc_id").alias("neg_doc_id"))
    return looks.join(others, (F.col("b") == F.col("ob")) & (F.col("want") == F.col("oat"))).select("doc_id", "slot", "neg_doc_id")


def only_gold(rows: DataFrame, name: str = "gt_quality") -> DataFrame:
    """Rows of gold quality; it is an error if none was told."""
    if name not in rows.columns:
        raise ValueError(f"no column {name}: label_quality() gives it")
    return rows.where(F.col(name) == "gold")
