"""Near-duplicate documents by MinHash with tensored banding.

A document is the set of its distinct word shingles (64-bit hashes). Table keys are formed by
combining pairs from two small collections: collection A and collection B hold SIDE keys of WIDTH
minhashes each, and the SIDE * SIDE tables are all pairs (a_i, b_j). So 2 * SIDE * WIDTH minhashes
serve SIDE ** 2 tables of 2 * WIDTH minhashes, a square root of what independent tables would take.
Two documents of similarity s share a table unless all a_i or all b_j differ: with eight sides of two
minhashes the chance of that is under 2 * (1 - s**2)**8, 0.0006 at 0.8 and 0.000004 at 0.9.

1. Equal sets are one class; the smallest id stands for it.
2. In each table the smallest representative of a key is the candidate partner of the others, so a
   key gives as many pairs as it has members, never all pairs.
3. Candidates pass a sketch (one minimum in each of 128 bins of one hash, a byte each) that a linked
   pair fails with chance under a millionth, then are verified on their full sets.
4. Links give components, by minimum labels and pointer jumping over written tables.
5. Keys whose members are not yet one component are taken up again: pairs of members that are not yet
   connected are compared by sketch and, where that passes, by the halves of their shingles' hashes,
   inside a task; only pairs that connect become rows, and these are verified on their full sets. So a
   link whose ends share a table is found even if neither end links to the smallest member. Each pair
   is compared in the first table that it shares. Only members outside a key's largest component are
   compared with all: these are dealt out in blocks of BLOCK, and each block meets each other one and
   each block of the largest component, whose members do not meet each other.

No bucket is cut or skipped. Texts are shingled where they are read; for verification only documents
of candidate pairs are read again.

Cases: null, empty and all-space texts have the empty set and link with nothing. With fewer words
than a shingle has, the whole sequence is the one shingle. Null ids are components of their own
(null). Rows that share an id are documents of their own, linked only if their texts are; the
component of each is the smallest id that it reaches. Empty tables give no rows. Other columns are
ignored by near_duplicates and kept by dedup, which leaves one row of each component, that with the
smallest id (null last), also of rows with null or repeated ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import among, buffer_of, drop_written, fresh, hash_spans, lowered, mixed, repeats, slices, table, word_spans, written

SIDE, WIDTH, BINS = 8, 2, 128
#: Share of agreeing bins, of those filled in either sketch, that a candidate needs: for a threshold t, t less five deviations of 128 bins.
SLACK = 0.18
BLOCK = 4096
WORDS = 5

_RNG = np.random.default_rng(20240229)
_A = _RNG.integers(0, 1 << 62, 2 * SIDE * WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, 2 * SIDE * WIDTH, dtype=np.uint64)
_ODD = _RNG.integers(0, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BIN, _HIGH = np.uint64(BINS - 1), np.uint64(32)


def shingle_sets(buf: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each row in a row, and their n + 1 offsets."""
    low = lowered(buf)
    starts, ends, first = word_spans(low, offs)
    words = hash_spans(low, starts, ends)
    rows = len(offs) - 1
    count = np.diff(first)
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    h = np.zeros(len(words), np.uint64)
    for k in range(min(n, len(words))):
        part = words[k:] * _ODD[k]
        h[: len(words) - k] += (part << np.uint64(k + 1)) | (part >> np.uint64(63 - k))
    h = mixed(h)
    sets, size = [], np.zeros(rows, np.int64)
    for r in np.flatnonzero(count).tolist():
        a, c = int(first[r]), int(count[r])
        if c >= n:
            one = np.unique(h[a : a + c - n + 1])
        else:
            v = np.uint64(c)
            for w in words[a : a + c]:
                v = mixed(np.array([v + np.uint64(1)]) * _ODD[n] ^ w)[0]
            one = np.array([v], np.uint64)
        sets.append(one)
        size[r] = len(one)
    return np.concatenate(sets), np.concatenate([[0], np.cumsum(size)])


def signatures(values: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each non-empty set: 2 * SIDE keys of WIDTH minhashes, and the sketch."""
    n = len(offs) - 1
    sides = np.zeros((n, 2 * SIDE), np.uint64)
    for k in range(2 * SIDE):
        key = np.zeros(n, np.uint64)
        for w in range(WIDTH):
            least = np.minimum.reduceat((values * _A[k * WIDTH + w] + _B[k * WIDTH + w]) >> _HIGH, offs[:-1])
            key = mixed(key * _ODD[w + 8] + least)
        sides[:, k] = key
    h = mixed(values * _ODD[20])
    place = np.repeat(np.arange(n), np.diff(offs)) * BINS + (h & _BIN).astype(np.int64)
    least = np.full(n * BINS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, place, h >> np.uint64(7))
    sketch = np.where(least == np.iinfo(np.uint64).max, 0, 1 + least % np.uint64(255)).astype(np.uint8).reshape(n, BINS)
    return sides, sketch


def fingerprints(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, fp (of the set, null if empty), a and b (keys of the collections), sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, all_ = buffer_of(batch.column(1))
            for i, j in slices(all_):
                values, offs = shingle_sets(buf[all_[i] : all_[j]], all_[i : j + 1] - all_[i], n)
                size = np.diff(offs)
                full = np.flatnonzero(size)
                fp: list = [None] * (j - i)
                a, b, sketch = list(fp), list(fp), list(fp)
                if len(full):
                    bounds = np.append(offs[:-1][full], offs[-1])
                    sides, sk = signatures(values, bounds)
                    one = np.add.reduceat(mixed(values * _ODD[30]), bounds[:-1])
                    two = np.add.reduceat(mixed(values * _ODD[31]), bounds[:-1])
                    for k, r in enumerate(full.tolist()):
                        fp[r] = one[k].tobytes() + two[k].tobytes() + int(size[r]).to_bytes(4, "little")
                        a[r], b[r], sketch[r] = sides[k, :SIDE].view(np.int64), sides[k, SIDE:].view(np.int64), sk[k].tobytes()
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(i, j - i).cast(pa.int64()), "n_shingles": pa.array(size), "fp": pa.array(fp, pa.binary()), "a": pa.array(a, pa.list_(pa.int64())), "b": pa.array(b, pa.list_(pa.int64())), "sketch": pa.array(sketch, pa.binary())})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, fp binary, a array<long>, b array<long>, sketch binary")


def _packed(values: np.ndarray, kind: str) -> bytes:
    return (np.unique(values.astype("<u4")) if kind == "<u4" else values.astype("<u8")).tobytes()


def sets_of(docs: DataFrame, n: int, kind: str = "<u8") -> DataFrame:
    """doc_id and its shingles as little-endian values in order; of kind <u4 the distinct low halves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, all_ = buffer_of(batch.column(1))
            for i, j in slices(all_):
                values, offs = shingle_sets(buf[all_[i] : all_[j]], all_[i : j + 1] - all_[i], n)
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(i, j - i).cast(pa.int64()), "shingles": pa.array([_packed(values[offs[k] : offs[k + 1]], kind) for k in range(j - i)], pa.binary())})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, shingles binary")


def _agree(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Agreeing bins and bins filled in either, of sketches that broadcast against each other."""
    filled = (x | y) != 0
    return ((x == y) & filled).sum(-1), filled.sum(-1)


def sketched(pairs: DataFrame, sketches: DataFrame, least: float) -> DataFrame:
    """Those pairs (l, r) whose sketches agree in a share of least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, BINS) for k in (2, 3))
                same, filled = _agree(x, y)
                keep = pa.array(same >= least * filled)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["l", "r"])

    sk = lambda c: sketches.select(F.col("rep").alias(c), F.col("sketch").alias("s" + c))
    return pairs.join(sk("r"), "r").join(sk("l"), "l").select("l", "r", "sl", "sr").mapInArrow(run, "l long, r long")


def verified(pairs: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Those pairs (l, r) for which 100 * intersection >= percent * union holds for the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), "<u8") for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["l", "r"])

    needed = pairs.select(F.explode(F.array("l", "r")).alias("doc_id")).distinct()
    rows = among(docs.select("doc_id", "text"), needed, 2 * pairs.count())
    sets = sets_of(rows, n).groupBy("doc_id").agg(F.min("shingles").alias("shingles"))
    s = lambda c: sets.select(F.col("doc_id").alias(c), F.col("shingles").alias("s" + c))
    sets = written(sets, "sets")
    out = written(pairs.join(s("r"), "r").join(s("l"), "l").select("l", "r", "sl", "sr").mapInArrow(run, "l long, r long"), "links")
    drop_written(sets)
    return out


def components(links: DataFrame) -> DataFrame:
    """id and label: for each end of a link (l, r) the smallest id that it reaches."""
    edges = written(links.select("l", "r").union(links.select("r", "l")).distinct(), "edges")
    labels = written(edges.groupBy(F.col("l").alias("id")).agg(F.min("r").alias("m")).select("id", F.least("id", "m").alias("label")), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("id", "r"), "r").groupBy("l").agg(F.min("label").alias("near"))
        step = labels.join(near, labels.id == near.l).select("id", "label", F.least("label", "near").alias("now"))
        step = written(step, "step")
        up = step.select(F.col("id").alias("u"), F.col("now").alias("up"))
        new = written(step.join(up, step.now == up.u, "left").select("id", "label", F.least("now", F.coalesce("up", "now")).alias("new")), "labels")
        drop_written(step)
        changed = new.where("new <> label").limit(1).count()
        drop_written(labels)
        labels = new.select("id", F.col("new").alias("label"))
        if not changed:
            drop_written(edges)
            return labels


def labelled(ids: DataFrame, labels: DataFrame) -> DataFrame:
    """ids (rep, ...) with the component of rep."""
    return ids.join(labels, ids.rep == labels.id, "left").withColumn("component", F.coalesce("label", "rep")).drop("id", "label")


_KEY = ["key", "lo", "hi"]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one key and pair of blocks, of rows in their order."""
    held: list[pa.RecordBatch] = []
    mark = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        key = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in _KEY])
        at = 0
        for end in [*(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist(), n]:
            if mark is not None and mark != tuple(key[:, at]):
                yield pa.Table.from_batches(held)
                held = []
            mark = tuple(key[:, at])
            held.append(batch.slice(at, end - at))
            at = end
    if held:
        yield pa.Table.from_batches(held)


class _Members:
    """One key's members: those before member k that are to be compared with it in this table."""

    def __init__(self, rows: pa.Table, least: float):
        rows = rows.combine_chunks()
        self.least, self.within = least, rows.column("lo")[0].as_py() == rows.column("hi")[0].as_py()
        self.t = rows.column("t")[0].as_py()
        self.rep, self.comp, self.block = (rows.column(c).to_numpy() for c in ("rep", "component", "block"))
        self.sk = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(-1, BINS)
        self.a, self.b = (rows.column(c).combine_chunks().flatten().to_numpy().reshape(-1, SIDE) for c in ("a", "b"))
        self.now = self.comp.copy()

    def before(self, k: int) -> np.ndarray:
        other = np.flatnonzero((self.now[:k] != self.now[k]) & (self.within | (self.block[:k] != self.block[k])))
        if len(other):
            first = (self.a[other] == self.a[k]).argmax(1) * SIDE + (self.b[other] == self.b[k]).argmax(1)
            other = other[first == self.t]
            same, filled = _agree(self.sk[other], self.sk[k])
            other = other[same >= self.least * filled]
        return other


_MEMBER = "key long, t int, lo int, hi int, block int, rep long, component long, a array<long>, b array<long>, sketch binary"


def likely_members(members: DataFrame, least: float) -> DataFrame:
    """Those members (_MEMBER) that are to be compared, and pass by sketch, with another of their key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            m = _Members(rows, least)
            keep = np.zeros(len(m.rep), bool)
            for k in range(1, len(m.rep)):
                other = m.before(k)
                keep[other] = True
                keep[k] |= len(other) > 0
            if keep.any():
                yield from rows.filter(pa.array(keep)).combine_chunks().to_batches()

    return members.repartition(*_KEY).sortWithinPartitions(*_KEY, "rep").mapInArrow(run, _MEMBER)


def dealt(members: DataFrame, block: int | None = None) -> DataFrame:
    """Members (key, t, rep, component) of keys of several components, by pair of blocks: key, t, lo, hi, block, rep, component.

    The first blocks hold the members outside the key's largest component, the others that component's.
    A pair of blocks of the largest component is not dealt out, so a key costs its members times the
    blocks of the members outside, not times all blocks.
    """
    block = block or BLOCK
    sizes = members.groupBy("key", "component").count()
    size = sizes.groupBy(F.col("key").alias("k")).agg(F.max(F.struct("count", "component")).alias("most"), F.sum("count").alias("n"))
    size = size.select("k", F.col("most.component").alias("largest"), *[F.ceil(x / block).cast("int").alias(c) for c, x in (("outer", F.col("n") - F.col("most.count")), ("inner_", F.col("most.count")))])
    inside, outer, inner = F.col("component") == F.col("largest"), F.col("outer"), F.col("inner_")
    h = F.xxhash64("rep", "key")
    rows = members.join(size, F.col("key") == F.col("k")).withColumn("block", F.when(inside, outer + F.pmod(h, inner)).otherwise(F.pmod(h, outer)).cast("int"))
    others = F.sequence(F.lit(0), F.when(inside, outer).otherwise(outer + inner) - 1)
    return rows.withColumn("other", F.explode(others)).select("key", "t", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "rep", "component")


def cross_links(members: DataFrame, least: float, percent: int, skip: bool = True) -> DataFrame:
    """Pairs (l, r) of members (_MEMBER and shingles) of one key and different components that hold by the low halves of their shingles' hashes.

    With skip, a pair whose ends are connected by pairs before it is left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            m = _Members(rows, least)
            sets = [np.frombuffer(v.as_buffer(), "<u4") for v in rows.column("shingles")]
            size = np.array([len(x) for x in sets])
            root = {c: c for c in m.comp.tolist()}

            def top(c: int, root: dict = root) -> int:
                while root[c] != c:
                    root[c] = c = root[root[c]]
                return c

            found: list[tuple[int, int]] = []
            for k in range(1, len(sets)):
                other = m.before(k)
                for at in range(0, len(other), 64):
                    near = other[at : at + 64]
                    near = near[m.now[near] != m.now[k]]
                    if not len(near):
                        continue
                    every = np.concatenate([sets[o] for o in near.tolist()])
                    place = np.minimum(np.searchsorted(sets[k], every), size[k] - 1)
                    both = np.add.reduceat((sets[k][place] == every).astype(np.int64), np.cumsum(size[near]) - size[near])
                    yes = near[100 * both >= percent * (size[near] + size[k] - both)]
                    for o in yes.tolist():
                        x, y = top(int(m.comp[o])), top(int(m.comp[k]))
                        if x != y or not skip:
                            found.append((min(int(m.rep[o]), int(m.rep[k])), max(int(m.rep[o]), int(m.rep[k]))))
                            if skip:
                                root[max(x, y)] = min(x, y)
                    if len(yes) and skip:
                        m.now = np.array([top(c) for c in m.comp.tolist()])
            if found:
                l, r = zip(*found)
                yield pa.RecordBatch.from_pydict({"l": pa.array(l, pa.int64()), "r": pa.array(r, pa.int64())})

    return members.repartition(*_KEY).sortWithinPartitions(*_KEY, "rep").mapInArrow(run, "l long, r long").distinct()


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if not repeats(rows, nulls=False):
        return linked(rows, words, percent)
    # Rows with a repeated id get numbers of their own, in a written table, so that these stay the same.
    rows = written(rows.withColumn("row", F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id())), "rows")
    found = linked(rows.select(F.col("row").alias("doc_id"), "text"), words, percent)
    found = written(found.select(F.col("doc_id").alias("row"), "n_shingles", F.col("component_id").alias("part")), "found")
    known = found.join(rows.select(F.col("row").alias("number"), "doc_id"), F.col("row") == F.col("number"), "left").drop("number")
    least = known.where("part is not null").groupBy(F.col("part").alias("of")).agg(F.min("doc_id").alias("component_id"))
    out = known.join(least, F.col("part") == F.col("of"), "left")
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def dedup(docs: DataFrame, words: int = WORDS, percent: int = 80) -> DataFrame:
    """docs with one row of each component, all columns as they are."""
    if not repeats(docs, nulls=True):
        kept = near_duplicates(docs, words, percent).where("kept").select(F.col("doc_id").alias("kept_id_"))
        return docs.join(kept, F.col("doc_id") == F.col("kept_id_"), "left_semi")
    row = fresh(docs.columns, "row_")
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    found = near_duplicates(rows.select(F.col(row).alias("doc_id"), "text"), words, percent).select("doc_id", "component_id")
    ids = rows.select(F.col(row).alias("number"), F.col("doc_id").cast("long").alias("id"))
    first = found.join(ids, F.col("doc_id") == F.col("number")).groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "number")).alias("first"))
    return rows.join(first.select(F.col("first.number").alias("kept_id_")), F.col(row) == F.col("kept_id_"), "left_semi").select(*docs.columns)


def linked(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """near_duplicates() of docs (doc_id, text) whose ids, but for null ones, occur once."""
    least = max(0.0, percent / 100 - SLACK)
    prints = written(fingerprints(docs, words), "prints")
    reps = written(prints.where("fp is not null and doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "reps")
    first = prints.join(reps, (prints.fp == reps.fp) & (prints.doc_id == reps.rep)).select("rep", "a", "b", "sketch")
    first = written(first, "first")
    keys = first.select("rep", F.posexplode("a").alias("i", "x"), "b").select("rep", "i", "x", F.posexplode("b").alias("j", "y")).select(F.xxhash64("i", "j", "x", "y").alias("key"), "rep", (F.col("i") * SIDE + F.col("j")).alias("t"))

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows in the order of their keys, those whose key has another row, with the key's first rep."""
        end: tuple = (None, None, False)  # key, its first rep, whether that rep was given
        for batch in batches:
            key, rep, t = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1, 2))
            if not len(key):
                continue
            new = np.append(True, key[1:] != key[:-1])
            new[0] = key[0] != end[0]
            at = np.flatnonzero(new)
            run = np.cumsum(new) - 1  # -1: still the key before
            leads = np.append(rep[at], end[1] if end[1] is not None else 0)
            lead = leads[run]
            follow = ~new
            counts = np.bincount(run[run >= 0], minlength=len(at)) if len(at) else np.zeros(0, np.int64)
            give = follow.copy()
            give[at] = counts > 1
            out_key, out_lead, out_rep, out_t = key[give], lead[give], rep[give], t[give]
            if follow[0] and not end[2]:
                out_key, out_lead, out_rep, out_t = np.append(end[0], out_key), np.append(end[1], out_lead), np.append(end[1], out_rep), np.append(t[0], out_t)
            end = (key[-1], lead[-1], bool(give[-1]) or (not new[-1]))
            yield pa.RecordBatch.from_pydict({"key": pa.array(out_key, pa.int64()), "lead": pa.array(out_lead, pa.int64()), "rep": pa.array(out_rep, pa.int64()), "t": pa.array(out_t, pa.int32())})

    tables = written(keys.repartition("key").sortWithinPartitions("key", "rep").mapInArrow(shared, "key long, lead long, rep long, t int"), "tables")
    sketches = first.select("rep", "sketch")
    stars = written(sketched(tables.where("lead <> rep").select(F.col("lead").alias("l"), F.col("rep").alias("r")).distinct(), sketches, least), "stars")
    links = verified(stars, docs, words, percent)
    labels = components(links)
    rest = labelled(tables.select("key", "rep", "t"), labels)
    several = rest.groupBy("key").agg(F.min("component").alias("c1"), F.max("component").alias("c2"), F.count("*").alias("n"), F.min("t").alias("t"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("same")).where("c1 <> c2")
    # Keys with the same members are compared once, in the first of their tables.
    several = several.groupBy("n", "same").agg(F.min_by("key", "t").alias("key")).select("key")
    mixed_ = written(rest.join(several, "key"), "mixed")
    again = dealt(mixed_)
    again = again.join(first, "rep").select(*[c.split()[0] for c in _MEMBER.split(", ")])
    again = written(likely_members(again, least), "again")
    needed = again.select(F.col("rep").alias("doc_id")).distinct()
    sets = sets_of(among(docs.select("doc_id", "text"), needed, again.count()), words, "<u4").groupBy(F.col("doc_id").alias("rep")).agg(F.min("shingles").alias("shingles"))
    members = again.join(sets, "rep")
    near = written(cross_links(members, least, percent), "near")
    more = verified(near, docs, words, percent)
    if more.count() < near.count():  # halves of hashes met where whole ones differ: nothing may be left out then
        drop_written(near, more)
        near = written(cross_links(members, least, percent, skip=False), "near")
        more = verified(near, docs, words, percent)
    drop_written(labels, tables, first, stars, mixed_, again, near)
    labels = components(links.union(more))
    drop_written(links, more)
    named = written(labelled(reps, labels).select(F.col("fp").alias("of"), "component"), "named")
    drop_written(labels, reps)
    out = prints.join(named, prints.fp == named.of, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id").eqNullSafe(component)).alias("kept"))


def op6_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4)
