"""Best-fit packing of tokenised documents into sequences of bounded length.

Bounded-space online best-fit: a fixed number of bins is open at a time. Open bins stand in lists by
their free space, and a bitset (one Python integer) has a bit for each free space that some bin has,
so the best fit, the least free space that is enough, is one shift and one lowest-set-bit. When no
open bin fits and all places are taken, the fullest bin closes to make room for a new one.

Documents are tokenised where they are read; only (doc_id, piece, start, length, checksum) travels.
Each task packs a hash-dealt share of the pieces. Shares are of SHARE_TOKENS tokens, so the bins that
stay open at a share's end are a small part of all sequences, and of more where there would be over
SHARES of them, so that the number of shuffle blocks stays in hand.

Cases: null and empty texts are documents of one end token. Texts of any length are cut into whole
sequences, the first piece taking what is over. Equal rows are packed each by itself; doc_id may be
null or repeated. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import itertools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _IS_SPACE, buffer_of, hash_spans, slices, table, trimmed

MAX_TOKENS = 2048
OPEN_BINS = 2048
END_ID = 0
#: Tokens of a share of the packing; the bins open at its end are at most about a hundredth of it.
SHARE_TOKENS, SHARES = 1 << 25, 1 << 13
#: Bytes of text that are encoded at once.
ENCODED_BYTES = 1 << 21
#: Entries of the cache of encoded words in each Python worker.
CACHED_WORDS = 1_000_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Bins:
    """Open bins by free space."""

    def __init__(self, size: int = MAX_TOKENS, places: int = OPEN_BINS):
        self.size, self.places, self.bits, self.open, self.made = size, places, 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, length: int) -> tuple[int, int]:
        """The bin and the offset in it for an item of 1 to size tokens."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            at = self.by_free[free].pop()
            if not self.by_free[free]:
                self.bits ^= 1 << free
        else:
            if self.open >= self.places:
                fullest = (self.bits & -self.bits).bit_length() - 1
                self.by_free[fullest].pop()
                if not self.by_free[fullest]:
                    self.bits ^= 1 << fullest
                self.open -= 1
            free, at = self.size, self.made
            self.made += 1
            self.open += 1
        if free == length:
            self.open -= 1
        else:
            self.by_free[free - length].append(at)
            self.bits |= 1 << (free - length)
        return at, self.size - free


class Encoder:
    """Token ids of whole texts by a byte-level BPE file; equal words are encoded once.

    A text is cut before a space, and before and behind a line feed, that stand alone between other
    characters. The pattern by which the tokenizer splits a text first has a split at each of these
    places, whatever follows, so the parts' ids in a row are the text's ids. A byte of 128 or more may
    belong to white space too, which would stay with what is before it: nothing is cut between two
    such bytes, nor behind a line feed with one after it. No added token of the vocabulary (a literal
    <|endoftext|> in a text is its one id, as the library has it) holds a space or a line feed.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        if any(c in t.content for t in self.tokenizer.get_added_tokens_decoder().values() for c in " \n"):
            raise ValueError(f"{path} has added tokens with white space, at which texts are cut")
        self.clear()

    def clear(self) -> None:
        # Known words by their hashes, in order: plain arrays take a tenth of a dictionary's memory.
        self.known, self.start, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def _ids(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        start, count = np.zeros(len(words), np.int64), np.zeros(len(words), np.int32)
        for i in range(0, len(words), 16384):
            ids = self._ids(words[i : i + 16384])
            counts = np.fromiter(map(len, ids), np.int64, len(ids))
            total = int(counts.sum())
            while self.used + total > len(self.pool):
                self.pool = np.concatenate([self.pool] * 2)
            self.pool[self.used : self.used + total] = np.fromiter(itertools.chain.from_iterable(ids), np.uint32, total)
            start[i : i + len(ids)] = self.used + np.cumsum(counts) - counts
            count[i : i + len(ids)] = counts
            self.used += total
        at = np.searchsorted(self.known, hashes)
        self.known, self.start, self.count = (np.insert(x, at, y) for x, y in ((self.known, hashes), (self.start, start), (self.count, count)))

    def cuts(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Where in buf a part begins; parts end at row ends."""
        space, high = _IS_SPACE[buf], buf >= 128
        alone = np.zeros(len(buf), bool)
        alone[1:-1] = (buf[1:-1] == 32) | (buf[1:-1] == 10)
        alone[1:-1] &= ~space[:-2] & ~space[2:] & ~(high[:-2] & high[2:])
        at = offs[(offs > 0) & (offs < len(buf))]
        alone[at] = False
        alone[at - 1] = False
        cut = alone.copy()
        cut[1:] |= alone[:-1] & (buf[:-1] == 10) & ~high[1:]
        cut[at] = True
        cut[0] = True
        return cut

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows in a row, and the n + 1 offsets of the rows in them."""
        if not len(buf):
            return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
        cut = self.cuts(buf, offs)
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(buf))
        uniq, first, inverse = np.unique(hash_spans(buf, starts, ends), return_index=True, return_inverse=True)
        if len(self.known) > CACHED_WORDS:
            self.clear()
        at = np.searchsorted(self.known, uniq)
        there = at < len(self.known)
        there[there] = self.known[at[there]] == uniq[there]
        new = np.flatnonzero(~there)
        if len(new):
            raw = buf.tobytes()
            self._learn(uniq[new], [raw[a:z].decode("utf-8", "replace") for a, z in zip(starts[first[new]].tolist(), ends[first[new]].tolist())])
            at = np.searchsorted(self.known, uniq)
        slots = at[inverse]
        counts = self.count[slots]
        total = np.concatenate([[0], np.cumsum(counts)])
        ids = self.pool[np.repeat(self.start[slots] - total[:-1], counts) + np.arange(total[-1])]
        return ids, total[np.searchsorted(starts, offs, "left")]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def documents_ids(batch: pa.RecordBatch, path: str | None) -> Iterator[tuple[int, np.ndarray]]:
    """Row and ids, with the end, of each text of a batch with a column text."""
    buf, offs = buffer_of(batch.column(batch.schema.get_field_index("text")))
    enc = encoder(path or tokenizer_path())
    for i, j in slices(offs, ENCODED_BYTES):
        ids, bounds = enc.encode(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        for k in range(j - i):
            yield i + k, np.append(ids[bounds[k] : bounds[k + 1]], np.uint32(END_ID))


def pieces(docs: DataFrame, path: str | None = None, max_tokens: int = MAX_TOKENS, with_ids: bool = False) -> DataFrame:
    """A row per piece of each document: doc_id, piece, start, length, ids_crc32, and with_ids the ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trimmed()
        for batch in batches:
            rows: list[tuple] = []
            for row, ids in documents_ids(batch, path):
                first = (len(ids) - 1) % max_tokens + 1
                bounds = [0, *range(first, len(ids) + 1, max_tokens)]
                rows += [(row, k, a, b - a, zlib.crc32(ids[a:b].astype("<u4")), ids[a:b] if with_ids else None) for k, (a, b) in enumerate(zip(bounds, bounds[1:]))]
            if not rows:
                continue
            row, k, a, size, crc, ids = zip(*rows)
            columns = {"doc_id": batch.column("doc_id").cast(pa.int64()).take(pa.array(row)), "piece": pa.array(k, pa.int32()), "start": pa.array(a, pa.int64()), "length": pa.array(size, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
            if with_ids:
                columns["ids"] = pa.array(ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(columns)

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES + (", ids array<int>" if with_ids else ""))


def packed(items: DataFrame, shares: int, max_tokens: int = MAX_TOKENS, open_bins: int = OPEN_BINS) -> DataFrame:
    """items (doc_id, piece, length, ...) with sequence_id and offset. length: 1 to max_tokens."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, bins = TaskContext.get().partitionId() << 40, Bins(max_tokens, open_bins)
        for batch in batches:
            places = [bins.add(x) for x in batch.column("length").to_pylist()]
            yield batch.append_column("sequence_id", pa.array([base + a for a, _ in places], pa.int64())).append_column("offset", pa.array([b for _, b in places], pa.int64()))

    order = F.xxhash64("doc_id", "piece")
    schema = items.schema.add("sequence_id", "long").add("offset", "long")
    return items.repartition(shares, order).sortWithinPartitions(order, *items.columns[:4]).mapInArrow(pack, schema)


def pack_documents(docs: DataFrame, path: str | None = None, max_tokens: int = MAX_TOKENS, open_bins: int = OPEN_BINS, share_tokens: int = SHARE_TOKENS) -> DataFrame:
    """Pieces of all documents with their places: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    The pieces are written once to the shared folder, so that their number is known before they are
    dealt and no text is tokenised twice when a task is lost.
    """
    from .common import written

    cut = written(pieces(docs, path, max_tokens), "pieces")
    tokens = cut.agg(F.sum("length")).first()[0] or 0
    return packed(cut, min(SHARES, max(1, -(-tokens // share_tokens))), max_tokens, open_bins)


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
