"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only.

A line is dropped if a line before it, in the order of (doc_id, line number), is equal to it or
within one edit (a character inserted, deleted or replaced) of it. Lines are compared without the
space around them; blank lines are never dropped, and lines under MIN_CHARS characters only if
they are equal, since one edit makes another word of them.

All deletion variants of all lines would be a row per character of the corpus, so variants are only
emitted where a partner can be, which loses nothing:
1. Equal lines are one, the earliest stands for it.
2. Two lines one edit apart, the longer one of M characters, agree in the first half of M or in the
   rest of it. Lines with no such partner are out. Keys hold M, so a line has keys for M of its own
   length and of one more.
3. The same argument, applied to the part that holds the edit until it has at most LEAF characters,
   leaves blocks whose surroundings are equal to a partner's.
4. Only these blocks emit their deletion variants as hashed keys. A variant keyed with its place
   joins lines that differ by a replacement, one without joins the longer line to the shorter, so
   all members of a key are partners and the earliest of each is enough: no pairs within a key.
5. The partner found is verified by edit distance on the texts, and the earliest one is kept.

All groups are sums or minima that are combined before the shuffle; keys are joined back in joins
whose large keys Spark can split. Lines travel as hashes (128 bits); only the texts of possible
partners are read again.

Cases: null and empty texts have no lines. A line of any length is compared whole. Null ids come
first. Rows with a null or repeated id are documents of their own, in some fixed order among equal
ids: such a table is written with a number for each row first, which is part of a line's place then.
Empty tables give empty results. dedup() keeps all columns, other names included.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import among, drop_written, fresh, repeats, table, written
from .quality import SPACE

MIN_CHARS, LEAF = 16, 48


def placed(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs, and the columns that tell its rows apart: doc_id, and a number where that is null or repeated somewhere."""
    if not repeats(docs, nulls=True):
        return docs, ["doc_id"]
    copy = fresh([*docs.columns, *_OURS], "copy_")
    return written(docs.withColumn(copy, F.monotonically_increasing_id()), "copies"), ["doc_id", copy]


#: Names that the tables of this module have; a number column is called otherwise.
_OURS = ("line_no", "raw", "line", "n", "h1", "h2", "halves", "first", "of", "at", "edits")


def lines_of(docs: DataFrame, ids: list[str]) -> DataFrame:
    """ids, line_no (from 0) and line, of lines that are not blank."""
    named = [F.col("doc_id").cast("long").alias("doc_id"), *ids[1:]]
    found = docs.select(*named, F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "raw"))
    return found.select(*ids, "line_no", F.btrim("raw", F.lit(SPACE)).alias("line")).where("line <> ''")


def _half_keys(line: Column, n: Column) -> Column:
    """For M = n and n + 1: the hash of the first half of M, and of the rest of M from the end."""
    out = []
    for more in (0, 1):
        m = n + more
        q = F.floor(m / 2).cast("int")
        out += [F.xxhash64(F.lit(1), m, F.substr(line, F.lit(1), q)), F.xxhash64(F.lit(2), m, F.right(line, m - q))]
    return F.array(*out)


def occurrences(docs: DataFrame, ids: list[str], min_chars: int = MIN_CHARS) -> DataFrame:
    """at (ids and line_no), two hashes, length and half keys (null for short lines) of each line."""
    rows = lines_of(docs, ids).withColumn("n", F.length("line"))
    keys = F.when(F.col("n") >= min_chars, _half_keys(F.col("line"), F.col("n")))
    return rows.select(F.struct(*ids, "line_no").alias("at"), F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"), "n", keys.alias("halves"))


def _shared(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows whose key has more than one line."""
    several = rows.groupBy(*keys).agg(F.min("h1").alias("lo_"), F.max("h1").alias("hi_")).where("lo_ <> hi_").select(*[F.col(k).alias(k + "_") for k in keys])
    return rows.join(several, [F.col(k) == F.col(k + "_") for k in keys], "left_semi")


def _split(rows: DataFrame, leaf: int) -> DataFrame:
    """Blocks longer than leaf in two: the edit is in one half, the other goes into ctx."""
    m, block = F.col("m"), F.col("block")
    q = F.floor(m / 2).cast("int")
    behind = F.struct(F.xxhash64("ctx", F.lit(1), "lo", m, F.substr(block, F.lit(1), q)).alias("ctx"), (F.col("lo") + q).alias("lo"), (m - q).alias("m"), F.substr(block, q + 1).alias("block"))
    front = F.struct(F.xxhash64("ctx", F.lit(2), "lo", m, F.right(block, m - q)).alias("ctx"), F.col("lo").alias("lo"), q.alias("m"), F.substr(block, F.lit(1), F.length(block) - (m - q)).alias("block"))
    same = F.struct("ctx", "lo", "m", "block")
    return rows.select("h1", "first", "short", F.explode(F.when(m > leaf, F.array(behind, front)).otherwise(F.array(same))).alias("x")).select("h1", "first", "short", "x.*")


def _variants(rows: DataFrame) -> DataFrame:
    """key, first, h1, short: the blocks' deletion variants; a shorter line's block stands for itself."""
    block = F.col("block")

    def cut(i: Column) -> Column:
        return F.concat(F.substr(block, F.lit(1), i), F.substr(block, i + 2))

    keys = F.when(F.col("short"), F.array(F.xxhash64("ctx", "lo", "m", F.lit(-1), block))).otherwise(
        F.flatten(F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda i: F.array(F.xxhash64("ctx", "lo", "m", i, cut(i)), F.xxhash64("ctx", "lo", "m", F.lit(-1), cut(i)))))
    )
    return rows.select(F.explode(F.array_distinct(keys)).alias("key"), "first", "h1", "short")


def near_lines(docs: DataFrame, ids: list[str], firsts: DataFrame, leaf: int = LEAF) -> DataFrame:
    """first and of: distinct lines that have an earlier one within one edit. firsts: h1, h2, first, n, halves."""
    keys = firsts.where("halves is not null").select("h1", "first", "n", F.posexplode("halves").alias("t", "key"))
    kept = written(_shared(keys, "key"), "halves")
    wanted = kept.select("first").distinct()
    texts = among(docs.select(*ids, "text"), kept.select(F.col("first.doc_id").alias("d")).distinct(), kept.count())
    texts = lines_of(texts, ids).select(F.struct(*ids, "line_no").alias("at"), "line").join(wanted, F.col("at").eqNullSafe(F.col("first")), "left_semi")
    texts = written(texts, "texts")
    rows = kept.join(texts, F.col("first").eqNullSafe(F.col("at")))
    m = F.col("n") + F.floor(F.col("t") / 2).cast("int")
    q, front = F.floor(m / 2).cast("int"), F.col("t") % 2 == 0
    rows = rows.select(
        "h1", "first", (F.col("t") >= 2).alias("short"), F.xxhash64("key", m).alias("ctx"), F.when(front, q).otherwise(0).alias("lo"), F.when(front, m - q).otherwise(q).alias("m"),
        F.when(front, F.substr("line", q + 1)).otherwise(F.substr(F.col("line"), F.lit(1), F.col("n") - (m - q))).alias("block"),
    )
    longest = kept.agg(F.max("n")).first()[0] or 0
    for _ in range(max(0, math.ceil(math.log2(max(1, (longest + 1) / leaf))))):
        rows = _split(rows, leaf)
    blocks = written(rows.withColumn("place", F.xxhash64("ctx", "lo", "m")), "blocks")
    leaves = _shared(blocks, "place")
    variants = written(_shared(_variants(leaves), "key"), "variants")
    groups = variants.groupBy("key").agg(F.min(F.when(~F.col("short"), F.col("first"))).alias("long"), F.min(F.when(F.col("short"), F.col("first"))).alias("small")).withColumnRenamed("key", "k")
    # With the shorter line in a key, its longer ones are partners of it; without, of each other.
    found = variants.join(groups, F.col("key") == F.col("k")).select("first", F.when(F.col("short"), F.col("long")).otherwise(F.coalesce("small", "long")).alias("of"))
    found = found.where("of < first").distinct()
    t = lambda c: texts.select(F.col("at").alias(c + "_at"), F.col("line").alias(c + "_line"))
    checked = found.join(t("a"), F.col("first").eqNullSafe(F.col("a_at"))).join(t("b"), F.col("of").eqNullSafe(F.col("b_at")))
    out = written(checked.where(F.levenshtein("a_line", "b_line", 1) == 1).groupBy("first").agg(F.min("of").alias("of")), "near")
    drop_written(kept, texts, blocks, variants)
    return out


def dropped(docs: DataFrame, ids: list[str], min_chars: int) -> DataFrame:
    """at, of, edits: the place (ids and line_no) of each line to drop and of the line that it repeats."""
    every = written(occurrences(docs, ids, min_chars), "lines")
    firsts = written(every.groupBy("h1", "h2").agg(F.min("at").alias("first"), F.first("n").alias("n"), F.first("halves").alias("halves")), "firsts")
    near = near_lines(docs, ids, firsts)
    known = firsts.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), "first")
    copies = every.select("h1", "h2", "at").join(known, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2"))).where("at > first").select("at", F.col("first").alias("of"), F.lit(0).alias("edits"))
    return copies.unionByName(near.select(F.col("first").alias("at"), "of", F.lit(1).alias("edits")))


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, line_no, of_doc_id, of_line_no, edits: each line to drop and the line that it repeats."""
    out = dropped(*placed(docs.select("doc_id", "text")), min_chars)
    return out.select("at.doc_id", "at.line_no", F.col("of.doc_id").alias("of_doc_id"), F.col("of.line_no").alias("of_line_no"), "edits")


def dedup(docs: DataFrame, min_chars: int = MIN_CHARS, keep_emptied: bool = False) -> DataFrame:
    """docs without the dropped lines; other columns as they are. A document all of whose lines were dropped goes, unless keep_emptied."""
    rows, ids = placed(docs)
    gone_at, gone, lines = (fresh(rows.columns, c) for c in ("gone_at_", "gone_lines_", "text_lines_"))
    at = dropped(rows.select(*ids, "text"), ids, min_chars).groupBy(F.struct(*[F.col(f"at.{c}").alias(c) for c in ids]).alias(gone_at)).agg(F.collect_set("at.line_no").alias(gone))
    place = F.struct(F.col("doc_id").cast("long").alias("doc_id"), *ids[1:])
    joined = rows.withColumn(lines, F.split(F.col("text"), "\n")).join(at, place == F.col(gone_at), "left")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(F.col(lines), i)), "\n"))
    out = joined.withColumn("text", text)
    if not keep_emptied:
        out = out.where(F.col(gone).isNull() | (F.btrim("text", F.lit(SPACE)) != ""))
    return out.select(*docs.columns)


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dropped_lines(table(spark, sf_dir, "documents"))
