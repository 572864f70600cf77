"""Language identification by prediction by partial matching.

For each language a context tree over bytes up to ORDER bytes deep is counted from a bounded sample
of labelled texts and then frozen. A byte's code length is that of PPM with escape method C and
exclusion: in the deepest context seen it has probability count / (total + distinct), else an escape,
distinct / (total + distinct), leads to the next shorter context, in which the symbols already seen
are left out; below the empty context all bytes are equally likely. Since the statistics are frozen,
all code lengths are laid out in one table, context by symbol by language, and whole texts are scored
by two array lookups a byte: exact code lengths, at every position. The language with the shortest
code wins.

Bounds: the sample is at most SAMPLE_DOCS texts and SAMPLE_BYTES bytes a language, taken by the
hash of their ids. A text longer than SAMPLE_BYTES is taken only if its language has no shorter one,
and then the shortest. There may be any number of languages; contexts are those of the sample, so the
table's size does not grow with the corpus. It grows with languages and scripts: where it would exceed
TABLE_BYTES, the trees are one byte less deep, until it fits. Bytes that no sampled text has share one symbol.

Cases: null texts and texts without a letter are "und" with score 0; a corpus without labels predicts
"und" for all. Texts of any length are scored whole. Ties go to the first language by name. Rows
with equal texts get equal predictions. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import buffer_of, slices, table

ORDER = 3
SAMPLE_DOCS, SAMPLE_BYTES = 500, 1_500_000
SCORE_SLICE = 1 << 20
TABLE_BYTES = 1 << 29
#: Parts in which the sample's texts of a language are ranked before the best of all parts are.
PARTS = 64


class Model:
    """languages; symbol of each byte; context of each triple of symbols; costs in bits."""

    def __init__(self, texts: dict[str, list[bytes]], order: int = ORDER, table_bytes: int = TABLE_BYTES):
        self.languages = sorted(texts)
        used = sorted({b for ts in texts.values() for t in ts for b in set(t)})
        self.a = len(used) + 2  # and one for other bytes, and one before the text
        self.symbol = np.full(256, len(used), np.int64)
        self.symbol[used] = np.arange(len(used))
        self.start, self.order = len(used) + 1, order
        a, self.powers = self.a, [self.a**k for k in range(order + 1)]
        counts: list[list[tuple[np.ndarray, np.ndarray]]] = []  # by order, by language: codes context * a + symbol, and counts
        for k in range(order + 1):
            row = []
            for lang in self.languages:
                codes = [self._codes(t, k) for t in texts[lang]]
                row.append(np.unique(np.concatenate(codes), return_counts=True) if codes else (np.zeros(0, np.int64), np.zeros(0, np.int64)))
            counts.append(row)
        # Contexts in the union of the trees, by order; order k's context c is number base[k] + its place.
        known = [np.unique(np.concatenate([np.zeros(0, np.int64), *(c // a for c, _ in row)])) if k else np.zeros(1, np.int64) for k, row in enumerate(counts)]
        while order > 1 and 4 * sum(map(len, known)) * a * len(self.languages) + 4 * self.powers[order] > table_bytes:
            order -= 1
            known.pop(), counts.pop(), self.powers.pop()
        self.order = order
        base = np.cumsum([0, *map(len, known)])
        self.costs = np.zeros((base[-1], a, max(1, len(self.languages))), np.float32)
        for j in range(len(self.languages)):
            self._fill(j, counts, known, base)
        # Each full context's deepest known one.
        full = np.zeros(self.powers[order], np.int32)
        for k in (k for k in range(1, order + 1) if len(known[k])):
            every = np.arange(self.powers[order]) % self.powers[k]
            at = np.searchsorted(known[k], every)
            at[at == len(known[k])] = 0
            hit = known[k][at] == every
            full[hit] = base[k] + at[hit]
        self.context = full

    def _codes(self, text: bytes, k: int) -> np.ndarray:
        s = np.concatenate([np.full(self.order, self.start), self.symbol[np.frombuffer(text, np.uint8)]])
        n = len(text)
        out = s[self.order :].copy()
        for d in range(1, k + 1):
            out += s[self.order - d : self.order - d + n] * self.a**d
        return out

    def _fill(self, j: int, counts: list, known: list, base: np.ndarray) -> None:
        a = self.a
        # Per context: counts by symbol, from the empty context downward to full order.
        sets: list[dict[int, dict[int, int]]] = []
        for k in range(len(counts)):
            codes, n = counts[k][j]
            tree: dict[int, dict[int, int]] = {}
            for code, c in zip(codes.tolist(), n.tolist()):
                tree.setdefault(code // a, {})[code % a] = c
            sets.append(tree)
        for k in range(len(counts)):
            for place, context in enumerate(known[k].tolist()):
                bits, left, chain = np.zeros(a), np.ones(a, bool), 0.0
                for d in range(k, -1, -1):
                    here = sets[d].get(context % a**d)
                    if not here:
                        continue
                    symbols = np.fromiter(here, np.int64, len(here))
                    n = np.fromiter(here.values(), np.float64, len(here))
                    open_ = left[symbols]
                    symbols, n = symbols[open_], n[open_]
                    if not len(symbols):
                        continue
                    total = n.sum() + len(symbols)
                    bits[symbols] = chain - np.log2(n / total)
                    left[symbols] = False
                    chain -= np.log2(len(symbols) / total)
                bits[left] = chain + np.log2(max(1, left.sum()))
                self.costs[base[k] + place, :, j] = bits

    def lengths(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Code length in bits of each row under each language."""
        n, size = len(offs) - 1, np.diff(offs)
        out = np.zeros((n, len(self.languages)))
        if not len(buf):
            return out
        place = np.arange(len(buf)) + self.order * (np.repeat(np.arange(n), size) + 1)
        s = np.full(len(buf) + self.order * n, self.start, np.int64)
        s[place] = self.symbol[buf]
        code = np.zeros(len(buf), np.int64)
        for d in range(1, self.order + 1):
            code += s[place - d] * self.powers[d - 1]
        cost = self.costs[self.context[code], s[place]]
        full = np.flatnonzero(size)
        out[full] = np.add.reduceat(cost, offs[full], axis=0, dtype=np.float64)
        return out


def learned(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """A model of the labelled texts of docs (doc_id, text, lang); docs is the training part."""
    ranked = docs.where("lang is not null and text is not null").select("lang", F.xxhash64("doc_id", F.xxhash64("text")).alias("h"), F.octet_length("text").alias("n"))
    order = F.greatest("n", F.lit(sample_bytes)), "h"
    for by in (["lang", F.pmod(F.shiftright("h", 32), F.lit(PARTS))], ["lang"]):
        ranked = ranked.select("lang", "h", "n", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).alias("k")).where(F.col("k") <= sample_docs)
    top = ranked
    chosen, had = [], {}
    for lang, h, n, _ in top.orderBy("lang", "k").collect():
        if had.get(lang, 0) == 0 or had[lang] + n <= sample_bytes:
            had[lang] = had.get(lang, 0) + n
            chosen.append((lang, h))
    texts: dict[str, list[bytes]] = {lang: [] for lang in had}
    if chosen:
        spark = docs.sparkSession
        keys = F.broadcast(spark.createDataFrame(chosen, "lang string, h long").distinct())  # at most sample_docs rows of two values a language
        seen = docs.where("lang is not null and text is not null").withColumn("h", F.xxhash64("doc_id", F.xxhash64("text"))).join(keys, ["lang", "h"])
        for lang, text in seen.groupBy("lang", "h").agg(F.first("text").alias("text")).select("lang", "text").collect():
            texts[lang].append(text.encode())
    return Model(texts)


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of each row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            buf, offs = buffer_of(batch.column(1))
            langs: list[str] = []
            scores: list[np.ndarray] = []
            for i, j in slices(offs, SCORE_SLICE):
                b, o = buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                letter = np.concatenate([[0], np.cumsum((b | 32) - 97 < 26)])  # unsigned: below a wraps around
                has = letter[o[1:]] > letter[o[:-1]]
                for k in np.flatnonzero(~has & (np.diff(o) > 0)).tolist():
                    has[k] = any(map(str.isalpha, b[o[k] : o[k + 1]].tobytes().decode("utf-8", "replace")))
                if not m.languages:
                    has[:] = False
                    langs += ["und"] * (j - i)
                    scores.append(np.zeros(j - i))
                    continue
                bits = m.lengths(b, o)
                best = bits.argmin(1)
                share = 1 / np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000)).sum(1)
                langs += [m.languages[x] if y else "und" for x, y in zip(best.tolist(), has.tolist())]
                scores.append(np.where(has, share, 0.0))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).cast(pa.int64()), "lang_pred": pa.array(langs, pa.string()), "score": pa.array(np.concatenate(scores) if scores else [], pa.float64())})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(parts: int, part: int = 2):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % parts == part, F.lit(False))


def op5_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learned(docs.where(~held_out(4)))
    out = predicted(docs, model)
    return out.select("doc_id", held_out(4).alias("held_out"), "lang_pred", "score")
