"""SentencePiece encoding and decoding over a trie of marked words.

A text's words, each with its mark (the space before it), do not influence each other, since no
piece has a mark behind another character. So only distinct words are encoded: sorted, they are the
depth-first order of their trie, and the forward pass over a word goes on from the prefix it shares
with the word before it.

A unigram model's forward pass keeps, for each prefix, the best sum of scores and the last piece on
its path (Viterbi); a character without a piece costs what the library charges, the least score less
UNKNOWN_COST.

The model file at hand is a byte-pair one: the path with the best sum of scores is not its encoding.
There the forward pass keeps, for each prefix, the last piece of the prefix's own encoding: it is the
longest piece that ends there and that byte-pair merging leaves standing next to the last piece before
it. For each prefix there is one such piece, so the pass is exact, and its states depend on the prefix
only, as Viterbi scores do. Words with a run of marks, whose pieces tie in score, are merged directly,
by a heap of neighbours. Characters without a piece become their bytes.

Cases: null and empty texts have no pieces. A mark character in a text is read as a space, as the
format has it, so such a text decodes to spaces there. Ids outside the vocabulary, null and control
ids decode to nothing. Words of any length are encoded whole. Equal texts, equal ids. Empty tables
give no rows. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import buffer_of, slices, table
from .packing import Encoder, tokenizer_path

MARK = "▁"
MEMO = 2_000_000
UNKNOWN_COST = 10.0


def model_type(path: str) -> int:
    """What the model file says it is: 1 unigram (where it says nothing), 2 byte-pair. It is field 3 of field 2, in protocol buffers."""

    def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
        at = 0

        def number() -> int:
            nonlocal at
            out = shift = 0
            while True:
                byte = data[at]
                at += 1
                out |= (byte & 127) << shift
                shift += 7
                if byte < 128:
                    return out

        while at < len(data):
            key = number()
            if key & 7 == 0:
                yield key >> 3, number()
            else:
                size = {1: 8, 5: 4}.get(key & 7) or number()
                yield key >> 3, data[at : at + size]
                at += size

    with open(path, "rb") as f:
        trainer = b"".join(v for k, v in fields(f.read()) if k == 2 and isinstance(v, bytes))
    return next((v for k, v in fields(trainer) if k == 3 and isinstance(v, int)), 1)


class Pieces:
    """The vocabulary, and exact encodings of marked words."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        kind = model_type(path)
        if kind not in (1, 2):
            raise ValueError(f"{path} is neither a unigram nor a byte-pair model")
        n = model.get_piece_size()
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in range(n)]
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.score = [model.get_score(i) for i in range(n)]
        self.vocab = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if model.is_byte(i)}
        self.unknown = model.unk_id()
        self.bytes = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else b"" if special[i] else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]
        self.prepare(kind == 1)
        self.size = n

    def prepare(self, unigram: bool) -> None:
        """What the forward pass looks up. In a byte-pair model only pieces that merging makes of their own characters can end a prefix."""
        self.unigram, self.memo = unigram, {}
        self.whole = {p: i for p, i in self.vocab.items() if unigram or self.merged(p) == [i]}
        self.tails = {p[k:] for p in self.whole for k in range(len(p))}
        self.least = min((self.score[i] for i in self.vocab.values()), default=0.0) - UNKNOWN_COST

    def merged(self, text: str) -> list[int]:
        """Byte-pair merging: the best-scored neighbours first, of equal ones the leftmost. A character without a piece is -1 - its code."""
        return self._merged_long(text) if len(text) > 32 else self._merged_short(text)

    def _merged_long(self, text: str) -> list[int]:
        """By a heap of neighbours and links over what is left: the time grows as n log n."""
        vocab, score, n = self.vocab, self.score, len(text)
        parts: list[str] = list(text)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[float, int, str, str]] = []

        def offer(k: int) -> None:
            if k >= 0 and after[k] >= 0 and (i := vocab.get(parts[k] + parts[after[k]])) is not None:
                heapq.heappush(heap, (-score[i], k, parts[k], parts[after[k]]))

        for k in range(n):
            offer(k)
        while heap:
            _, k, x, y = heapq.heappop(heap)
            j = after[k]
            if parts[k] != x or j < 0 or parts[j] != y:
                continue  # one of the two has been merged since
            parts[k], parts[j], after[k] = x + y, "", after[j]
            if after[k] >= 0:
                before[after[k]] = k
            offer(before[k])
            offer(k)
        return [vocab.get(p, -1 - ord(p[0])) for p in parts if p]

    def _merged_short(self, text: str) -> list[int]:
        parts = list(text)
        vocab, score = self.vocab, self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = vocab.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or score[i] > best):
                    best, at = score[i], k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [vocab.get(p, -1 - ord(p[0])) for p in parts]

    def beside(self, a: int, b: int) -> bool:
        """Whether merging leaves piece b standing behind piece a."""
        key = a * self.size + b
        known = self.memo.get(key)
        if known is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            known = self.memo[key] = self.merged(self.pieces[a] + self.pieces[b]) == [a, b]
        return known

    def encode_sorted(self, words: list[str]) -> Iterator[list[int]]:
        """The ids of each of words, which are in order, by one pass over their trie."""
        if self.unigram:
            yield from map(self.flat, self.best_paths(words))
            return
        whole, tails, beside = self.whole, self.tails, self.beside
        before = ""
        last, back = [-1], [0]  # by length of prefix: its last piece (or -1 - code), and where that begins
        for word in words:
            if MARK in word[1:2]:
                yield self.flat(self.merged(word))
                continue
            shared = 0
            for x, y in zip(before, word):
                if x != y:
                    break
                shared += 1
            del last[shared + 1 :], back[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                fits, at = [], end - 1
                while at >= 0 and (tail := word[at:end]) in tails:
                    if tail in whole:
                        fits.append(at)
                    at -= 1
                for at in reversed(fits):
                    piece = whole[word[at:end]]
                    if not at or last[at] < 0 or beside(last[at], piece):
                        last.append(piece)
                        back.append(at)
                        break
                else:
                    last.append(-1 - ord(word[end - 1]))
                    back.append(end - 1)
            ids, end = [], len(word)
            while end:
                ids.append(last[end])
                end = back[end]
            before = word
            yield self.flat(ids[::-1])

    def best_paths(self, words: list[str]) -> Iterator[list[int]]:
        """Viterbi: the path of the best sum of scores through each of words, which are in order. Of equal sums the one with the longer last piece."""
        whole, tails, score = self.whole, self.tails, self.score
        before = ""
        best, last, back = [0.0], [-1], [0]  # by length of prefix: its best sum, and the last piece on that path, and where that begins
        for word in words:
            shared = 0
            for x, y in zip(before, word):
                if x != y:
                    break
                shared += 1
            del best[shared + 1 :], last[shared + 1 :], back[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                top, piece, start = best[end - 1] + self.least, -1 - ord(word[end - 1]), end - 1
                at = end - 1
                while at >= 0 and (tail := word[at:end]) in tails:
                    i = whole.get(tail)
                    if i is not None and (sum_ := best[at] + score[i]) >= top:
                        top, piece, start = sum_, i, at
                    at -= 1
                best.append(top)
                last.append(piece)
                back.append(start)
            ids, end = [], len(word)
            while end:
                ids.append(last[end])
                end = back[end]
            before = word
            yield ids[::-1]

    def flat(self, ids: list[int]) -> list[int]:
        """Characters without a piece as their bytes, or the unknown piece where the model has no bytes."""
        if min(ids, default=0) >= 0:
            return ids
        return [k for i in ids for k in ([i] if i >= 0 else [self.byte[b] for b in chr(-1 - i).encode()] if self.byte else [self.unknown])]


class MarkedEncoder(Encoder):
    """Ids of whole texts; each row of the buffer begins with its first mark, as a space."""

    def __init__(self, path: str):
        self.pieces = Pieces(path)
        self.clear()

    def cuts(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        space = buf == 32
        cut = space.copy()
        cut[1:] &= ~space[:-1]
        at = offs[:-1]
        cut[at[at < len(buf)]] = True
        return cut

    def _ids(self, words: list[str]) -> list[list[int]]:
        marked = [w.replace(" ", MARK) for w in words]
        order = sorted(range(len(words)), key=marked.__getitem__)
        out: list[list[int]] = [[]] * len(words)
        for k, ids in zip(order, self.pieces.encode_sorted([marked[k] for k in order])):
            out[k] = ids
        return out


_encoders: dict[str, MarkedEncoder] = {}


def marked_encoder(path: str | None) -> MarkedEncoder:
    path = path or tokenizer_path("piece_bpe_32k.model")
    if path not in _encoders:
        _encoders[path] = MarkedEncoder(path)
    return _encoders[path]


def marked(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows with a space before each that is not empty, and with mark characters as spaces."""
    if MARK.encode() in (raw := buf.tobytes()):
        rows = [raw[a:b].replace(MARK.encode(), b" ") for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]
        buf, offs = np.frombuffer(b"".join(rows), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
    at = offs[:-1][np.diff(offs) > 0]
    return np.insert(buf, at, 32), offs + np.concatenate([[0], np.cumsum(np.diff(offs) > 0)])


def encoded_rows(column: pa.Array, path: str | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of a text column: ids in a row and their offsets, the bytes and their offsets."""
    enc = marked_encoder(path)
    buf, all_ = buffer_of(column)
    for i, j in slices(all_):
        b, o = buf[all_[i] : all_[j]], all_[i : j + 1] - all_[i]
        yield (*enc.encode(*marked(b, o)), b, o)


def decode_rows(ids: np.ndarray, offs: np.ndarray, path: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of rows of ids in a row, with their offsets: pieces in a row, less the first mark."""
    pieces = marked_encoder(path).pieces
    if not hasattr(pieces, "pool"):
        size = np.array([len(b) for b in pieces.bytes] + [0], np.int64)
        pieces.pool = (np.frombuffer(b"".join(pieces.bytes), np.uint8), np.cumsum(size) - size, size)
    pool, start, size = pieces.pool
    ids = np.where(ids < pieces.size, ids, pieces.size).astype(np.int64)
    n = size[ids]
    total = np.concatenate([[0], np.cumsum(n)])
    out = pool[np.repeat(start[ids] - total[:-1], n) + np.arange(total[-1])]
    bounds = total[offs]
    first = bounds[:-1][np.diff(bounds) > 0]
    first = first[out[first] == 32]
    keep = np.ones(len(out), bool)
    keep[first] = False
    return out[keep], bounds - np.searchsorted(first, bounds, "left")


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for ids, offs, _, _ in encoded_rows(batch.column(1), path):
                n = len(offs) - 1
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(at, n).cast(pa.int64()), "ids": pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(ids.astype(np.int32)))})
                at += n

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of each row of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.array([-1 if x is None else x for x in r or []], np.int64).astype(np.uint32) for r in batch.column(1).to_pylist()]
            offs = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
            buf, bounds = decode_rows(np.concatenate([np.zeros(0, np.uint32), *rows]), offs, path)
            raw = buf.tobytes()
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).cast(pa.int64()), "text": pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(bounds[:-1], bounds[1:])], pa.string())})

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Each text encoded and decoded again: doc_id, n_pieces, ids_crc32, n_bytes, decoded_crc32, round_trip."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for ids, offs, buf, o in encoded_rows(batch.column(1), path):
                back, bounds = decode_rows(ids, offs, path)
                n = len(offs) - 1
                crc = [zlib.crc32(ids[offs[k] : offs[k + 1]].astype("<u4")) for k in range(n)]
                text = [zlib.crc32(np.ascontiguousarray(back[bounds[k] : bounds[k + 1]])) for k in range(n)]
                same = [t == zlib.crc32(np.ascontiguousarray(buf[o[k] : o[k + 1]])) and bounds[k + 1] - bounds[k] == o[k + 1] - o[k] for k, t in enumerate(text)]
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(at, n).cast(pa.int64()), "n_pieces": pa.array(np.diff(offs)), "ids_crc32": pa.array(crc, pa.int64()), "n_bytes": pa.array(np.diff(bounds)), "decoded_crc32": pa.array(text, pa.int64()), "round_trip": pa.array(same, pa.bool_())})
                at += n

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, n_bytes long, decoded_crc32 long, round_trip boolean")


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
