"""Language-model scoring by Brown's class-based n-grams.

P(text) is the product over tokens of P(class | class before) * P(word | class). The model is made
in passes over compact token tables:

1. Texts are cut into words where they are read and written once as blocks: per block of documents
   the distinct words' hashes, and each token as a number into them. Nothing tokenises again.
2. All words are counted over all training documents, by ranges of hashes. That tells exactly how
   many occur LEAST times and which are the most frequent; the number of classes grows with the fourth
   root of the former, and of the words to start with (TOP at least) it takes eight times as many.
3. Bigrams of these words, and of TAILS groups of all others by their ending, are summed over all
   training documents, and exchange clustering moves one item at a time to the class that most
   increases the average mutual information of neighbouring classes, in sweeps until nothing moves or
   SWEEPS are done. This is the start only.
4. All words are counted over all training documents: blocks ask for their words, packed by ranges of
   hashes (buckets of about BUCKET_WORDS words), and send along how often each class stands before and
   after each word. A bucket sums what the blocks have counted, gives every word that occurs LEAST
   times the class under which its own neighbours are most likely, and answers each block. Neighbours
   that are themselves below the frequent words count there with the class of their ending.
5. Bigrams of the classes are counted anew over all training documents with every word's own class.
6. Class transitions are interpolated with the class's own share, with MASS pseudo-counts. Only words
   that occur less than LEAST times share the class of their ending: such a word has its count less
   DISCOUNT over the tail's; what is left over goes to the unseen words of that ending, of which as
   many are assumed as there are seen ones, and one.

The vocabulary is never broadcast; a block holds the counts of its own words only.

Cases: a null or empty text is one end token. Null ids are scored and never held out. Texts of any
length are scored whole. Repeated rows each get the same score. With no training documents all
probabilities come from the smoothing. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import gc
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buffer_of, drop_written, hash_spans, lowered, padded, slices, table, word_spans, written

TOP, TAILS, CLASSES, SWEEPS = 1000, 256, 48, 8
LEAST = 5
DISCOUNT, MASS = 0.7, 20.0
BLOCK_BYTES = 4 << 20
BUCKET_WORDS = 1 << 19
END = np.uint64(0x9D5A3C7712E4B601)

SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
BLOCKS = "block long, types long, doc_id array<long>, held array<boolean>, size array<int>, words binary, tails binary, counts binary, order binary, tokens binary"


def packed(*columns: np.ndarray) -> bytes:
    """Arrays of equal lengths as one value, byte by byte of their numbers, so that bytes alike stand together."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), c.itemsize).T).tobytes() for c in map(np.ascontiguousarray, columns)))


def opened(data: bytes, *kinds: str) -> list[np.ndarray]:
    """The arrays of packed()."""
    import zstandard

    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    sizes = [np.dtype(k).itemsize for k in kinds]
    n, at, out = len(raw) // sum(sizes), 0, []
    for kind, size in zip(kinds, sizes):
        out.append(np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(kind).reshape(n))
        at += n * size
    return out


def steps(words: np.ndarray) -> np.ndarray:
    """Hashes in order as differences, which are smaller; np.cumsum gives them back."""
    return np.diff(words, prepend=np.uint64(0)).astype("<u8")


def held_out_part(doc_id: int | None, parts: int, part: int) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % parts == part


def blocks(docs: DataFrame, parts: int = 7, part: int = 2) -> DataFrame:
    """Documents (doc_id, text) as blocks; counts: how often each word occurs in training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        pack = zstandard.ZstdCompressor(level=1)
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids = batch.column(0).cast(pa.int64()).to_pylist()
            buf, all_ = buffer_of(batch.column(1))
            for i, j in slices(all_, BLOCK_BYTES):
                low, offs = lowered(buf[all_[i] : all_[j]]), all_[i : j + 1] - all_[i]
                starts, ends, first = word_spans(low, offs)
                h = hash_spans(low, starts, ends)
                data = padded(low)
                last = data[np.maximum(ends - 1, 0)].astype(np.int64)
                tail = (last * 31 + np.where(ends - starts > 1, data[np.maximum(ends - 2, 0)], 0)) % TAILS
                size = np.diff(first) + 1
                stop = np.cumsum(size) - 1
                every = np.full(len(h) + len(size), END)
                tails = np.zeros(len(every), np.int64)
                word = np.ones(len(every), bool)
                word[stop] = False
                every[word], tails[word] = h, tail
                uniq, at, tokens, often = np.unique(every, return_index=True, return_inverse=True, return_counts=True)
                # Frequent words get small numbers, so that the tokens pack well.
                rank = np.empty(len(uniq), np.int64)
                rank[np.argsort(-often, kind="stable")] = np.arange(len(uniq))
                held = [held_out_part(x, parts, part) for x in ids[i:j]]
                train = np.repeat(~np.array(held, bool), size)
                counts = np.bincount(tokens[train], minlength=len(uniq))
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array([number], pa.int64()), "types": pa.array([len(uniq)], pa.int64()), "doc_id": pa.array([ids[i:j]], pa.list_(pa.int64())), "held": pa.array([held], pa.list_(pa.bool_())), "size": pa.array([size.astype(np.int32)], pa.list_(pa.int32())),
                    "words": pa.array([uniq.astype("<u8").tobytes()], pa.binary()), "tails": pa.array([packed(tails[at].astype("<u2"))], pa.binary()), "counts": pa.array([packed(counts.astype("<u4"))], pa.binary()), "order": pa.array([packed(rank.astype("<u4"))], pa.binary()), "tokens": pa.array([pack.compress(rank[tokens].astype("<u4").tobytes())], pa.binary()),
                })
                number += 1

    return docs.select("doc_id", "text").mapInArrow(run, BLOCKS)


#: Columns of blocks that are packed.
PACKED = {"tails": "<u2", "counts": "<u4", "order": "<u4", "items": "<u2"}


def _views(batch: pa.RecordBatch, names: list[str]) -> Iterator[tuple]:
    for k in range(batch.num_rows):
        row = zip(names, (batch.column(c)[k].as_py() for c in names))
        yield tuple(opened(x, PACKED[c])[0] if c in PACKED else np.frombuffer(x, "<u8") if c == "words" else x for c, x in row)


def bucket_width(of: DataFrame) -> int:
    """How many hashes a bucket of about BUCKET_WORDS entries spans."""
    total = of.agg(F.sum("types")).first()[0] or 0
    return (1 << 64) // max(1, -(-total // BUCKET_WORDS)) + 1


def bucketed(words: np.ndarray, width: int) -> tuple[list[tuple[int, int]], list[int]]:
    """Where the words, which are in order, of each bucket stand, and the buckets; only those that there are words for."""
    of_word = (words // np.uint64(width)).astype(np.int64) if width < 1 << 64 else np.zeros(len(words), np.int64)
    begin = np.flatnonzero(np.append(True, of_word[1:] != of_word[:-1])) if len(words) else np.zeros(0, np.int64)
    return list(zip(begin.tolist(), [*begin[1:].tolist(), len(words)])), of_word[begin].tolist()


def counted(of: DataFrame, model: Model, least: int) -> DataFrame:
    """What the buckets answer. kind 0: items (data) and sums (counts) of a block's words in a bucket; 1: a class (in bucket) and how many words below the top (word) it got; 2: types (word) and tokens (n) of a tail (in bucket), without words that are items; 3: n of the end and, as word, all types."""
    width = bucket_width(of)
    shared = of.sparkSession.sparkContext.broadcast(model)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack, m = zstandard.ZstdCompressor(level=1), shared.value
        c = len(m.step)
        for batch in batches:
            for block, held, size, words, tails, counts, order, tokens in _views(batch, ["block", "held", "size", "words", "tails", "counts", "order", "tokens"]):
                item = items_of(words, tails.astype(np.int64), m.top)
                back = np.empty(len(order), np.int64)
                back[order] = np.arange(len(order))
                word = back[_unpacked(tokens)]
                cls = m.of[item][word]
                # Neighbours' classes of the tokens of training documents whose word is below the top.
                at = np.flatnonzero(np.repeat(~np.array(held, bool), size) & ((item >= len(m.top)) & (words != END))[word])
                before, after = np.append(m.of[-1], cls[:-1])[at], cls[at + 1]
                keys, n = np.unique(np.concatenate([word[at] * (2 * c) + before, word[at] * (2 * c) + c + after]), return_counts=True)
                each = np.bincount(keys // (2 * c), minlength=len(words))
                spans, full = bucketed(words, width)
                first = np.append(0, np.cumsum(each))
                entries = [packed(steps(words[i:j]), tails[i:j], counts[i:j]) for i, j in spans]
                code, n, each = (keys % (2 * c)).astype("<u2"), n.astype("<u4"), each.astype("<u4")
                near = [pack.compress(each[i:j].tobytes() + code[first[i] : first[j]].tobytes() + n[first[i] : first[j]].tobytes()) for i, j in spans]
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(full, pa.int32()), "block": pa.array([block] * len(full), pa.int64()), "entries": pa.array(entries, pa.binary()), "near": pa.array(near, pa.binary())})

    def answer(rows: pa.Table) -> pa.Table:
        import zstandard

        m = shared.value
        c = len(m.step)
        parts = [opened(x, "<u8", "<u2", "<u4") for x in rows.column("entries").to_pylist()]
        sizes = [len(x) for x, _, _ in parts]
        words, tails, counts = np.concatenate([np.cumsum(x, dtype=np.uint64) for x, _, _ in parts]), *(np.concatenate([x[k] for x in parts]) for k in (1, 2))
        del parts
        uniq, at, inverse = np.unique(words, return_index=True, return_inverse=True)
        n = np.bincount(inverse, weights=counts, minlength=len(uniq)).astype(np.int64)
        ends = np.cumsum(sizes)
        tail = tails[at].astype(np.int64)
        place = items_of(uniq, tail, m.top)
        top, end = place < len(m.top), uniq == END
        own = ~top & ~end & (n >= least)
        # Summed neighbour counts of the words that get a class of their own, by word and class.
        keys, often = [], []
        for data, size, stop in zip(rows.column("near").to_pylist(), sizes, ends.tolist()):
            data = zstandard.decompress(data)
            each = np.frombuffer(data, "<u4", size)
            k = int(each.sum())
            w = np.repeat(inverse[stop - size : stop], each)
            keep = own[w]
            keys.append((w * (2 * c) + np.frombuffer(data, "<u2", k, 4 * size))[keep])
            often.append(np.frombuffer(data, "<u4", k, 4 * size + 2 * k)[keep])
            del data, each, w, keep
        keys, often = np.concatenate(keys), np.concatenate(often)
        order = np.argsort(keys)
        keys, often = keys[order], often[order]
        start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        keys, often = keys[start], np.add.reduceat(often.astype(np.int64), start) if len(keys) else often
        item = np.where(top | end, m.of[place], c + tail)
        item[own] = m.assigned(keys // (2 * c), keys % (2 * c), often, n)[own]
        got = np.bincount(item[own], minlength=c)
        low = ~top & ~end & ~own & (n > 0)
        types, tokens = np.bincount(tail[low], minlength=TAILS), np.bincount(tail[low], weights=n[low], minlength=TAILS)
        told = [item[inverse].astype("<u2"), n[inverse].astype("<u4")]
        b, kinds = rows.num_rows, [1] * c + [2] * TAILS + [3]
        return pa.table({
            "kind": pa.array([0] * b + kinds, pa.int32()), "block": pa.concat_arrays([rows.column("block").combine_chunks(), pa.nulls(len(kinds), pa.int64())]), "bucket": pa.array([*rows.column("bucket").to_pylist(), *range(c), *range(TAILS), 0], pa.int32()),
            "word": pa.array([0] * b + got.tolist() + types.tolist() + [int((n > 0).sum())], pa.int64()), "n": pa.array([0] * b + [0] * c + tokens.astype(np.int64).tolist() + [int(n.sum())], pa.int64()),
            "data": pa.array([told[0][z - k : z].tobytes() for z, k in zip(ends.tolist(), sizes)] + [None] * len(kinds), pa.binary()),
            "counts": pa.array([packed(told[1][z - k : z]) for z, k in zip(ends.tolist(), sizes)] + [None] * len(kinds), pa.binary()),
        })

    asked = of.select("block", "held", "size", "words", "tails", "counts", "order", "tokens").mapInArrow(ask, "bucket int, block long, entries binary, near binary")
    return asked.groupBy("bucket").applyInArrow(answer, "kind int, block long, bucket int, word long, n long, data binary, counts binary")


def frequent(of: DataFrame, share: int, least: int) -> DataFrame:
    """word and n of all words that occur least times in training documents, and of the share most frequent ones at least, each counted over all blocks."""
    width = bucket_width(of)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, counts in _views(batch, ["words", "counts"]):
                seen = np.flatnonzero((counts > 0) & (words != END))
                words, counts = words[seen], counts[seen]
                spans, full = bucketed(words, width)
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(full, pa.int32()), "entries": pa.array([packed(steps(words[i:j]), counts[i:j]) for i, j in spans], pa.binary())})

    def answer(rows: pa.Table) -> pa.Table:
        parts = [opened(x, "<u8", "<u4") for x in rows.column("entries").to_pylist()]
        uniq, inverse = np.unique(np.concatenate([np.cumsum(x, dtype=np.uint64) for x, _ in parts]), return_inverse=True)
        n = np.bincount(inverse, weights=np.concatenate([x for _, x in parts]), minlength=len(uniq)).astype(np.int64)
        word = uniq.view(np.int64)
        at = np.union1d(np.lexsort((word, -n))[:share], np.flatnonzero(n >= least))
        return pa.table({"word": pa.array(word[at]), "n": pa.array(n[at])})

    asked = of.select("words", "counts").mapInArrow(ask, "bucket int, entries binary")
    return asked.groupBy("bucket").applyInArrow(answer, "word long, n long")


def _unpacked(tokens: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.decompress(tokens), "<u4")


def items_of(words: np.ndarray, tails: np.ndarray, top: np.ndarray) -> np.ndarray:
    """The item of each word: its place in top (sorted), after those its tail, and last the end."""
    at = np.searchsorted(top, words)
    at[at == len(top)] = 0
    hit = top[at] == words if len(top) else np.zeros(len(words), bool)
    return np.where(words == END, len(top) + TAILS, np.where(hit, at, len(top) + tails))


def bigrams(of: DataFrame, top: np.ndarray) -> DataFrame:
    """code (item before * items + item) and n over the training documents; before the first token stands an end."""
    shared = of.sparkSession.sparkContext.broadcast(top)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = shared.value
        m = len(top) + TAILS + 1
        sums = np.zeros(m * m, np.int64)
        for batch in batches:
            for held, size, words, tails, order, tokens in _views(batch, ["held", "size", "words", "tails", "order", "tokens"]):
                item = np.empty(len(words), np.int64)
                item[order] = items_of(words, tails.astype(np.int64), top)
                item = item[_unpacked(tokens)]
                before = np.append(m - 1, item[:-1])
                train = np.repeat(~np.array(held, bool), size)
                sums += np.bincount((before * m + item)[train], minlength=m * m)
        code = np.flatnonzero(sums)
        yield pa.RecordBatch.from_pydict({"code": pa.array(code), "n": pa.array(sums[code])})

    return of.select("held", "size", "words", "tails", "order", "tokens").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def exchange(counts: np.ndarray, classes: int, sweeps: int = SWEEPS) -> np.ndarray:
    """The class of each item from its bigram counts; the last item, the end, keeps a class to itself."""
    m = len(counts)
    classes = max(2, min(classes, m))
    order = np.argsort(-(counts.sum(0)), kind="stable")
    order = order[order != m - 1]
    of = np.zeros(m, np.int64)
    of[order] = np.arange(m - 1) % (classes - 1)
    of[m - 1] = classes - 1
    hot = np.zeros((m, classes))
    hot[np.arange(m), of] = 1
    right, left = counts @ hot, counts.T @ hot  # of each item to and from each class
    g = hot.T @ right

    def f(x: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1e-12))

    total = counts.sum(1)
    into = counts.sum(0)
    for _ in range(sweeps):
        moved = 0
        for w in order.tolist():
            if not total[w] and not into[w]:
                continue
            a, r, s, own = of[w], right[w].copy(), left[w].copy(), counts[w, w]
            r[a] -= own
            s[a] -= own
            g[a, :] -= r
            g[:, a] -= s
            g[a, a] -= own
            rows, cols = g.sum(1), g.sum(0)
            new_row, new_col = g + r, g.T + s  # row b: class b's row and column with w in it
            gain = (f(new_row) - f(g)).sum(1) + (f(new_col) - f(g.T)).sum(1)
            d = np.diag(g)
            gain += f(d + r + s + own) - f(d) - (f(d + r) - f(d)) - (f(d + s) - f(d))
            gain -= f(rows + total[w]) - f(rows) + f(cols + into[w]) - f(cols)
            gain[classes - 1] = -np.inf
            b = int(gain.argmax())
            if b != a and gain[b] <= gain[a] + 1e-9:
                b = a
            g[b, :] += r
            g[:, b] += s
            g[b, b] += own
            if b != a:
                moved += 1
                of[w] = b
                column, row = counts[:, w], counts[w, :]
                right[:, a] -= column
                right[:, b] += column
                left[:, a] -= row
                left[:, b] += row
        if not moved:
            break
    return of


class Model:
    """log10 probabilities: class after class, item in its class, and what a tail's words need."""

    def __init__(self, top: np.ndarray, pairs: np.ndarray, tail_types: np.ndarray, tail_tokens: np.ndarray, tokens: int, types: int, classes: int = CLASSES):
        self.top, self.tokens, self.types = top, tokens, types
        of = exchange(pairs, classes)
        c = int(of.max()) + 1
        hot = np.zeros((len(pairs), c))
        hot[np.arange(len(pairs)), of] = 1
        g = hot.T @ pairs @ hot
        share = (g.sum(0) + 1) / (g.sum() + c)
        self.step = np.log10((g + MASS * share) / (g.sum(1, keepdims=True) + MASS))
        n = pairs.sum(0) + 1.0
        self.size = hot.T @ n
        self.of, self.item = of, np.log10(n / (hot.T @ n)[of])
        lost = np.where(tail_tokens > 0, DISCOUNT * tail_types / np.maximum(tail_tokens, 1), 1.0)
        self.unseen = np.log10(lost / (tail_types + 1))
        self.tail_tokens = np.maximum(tail_tokens, 1)

    def word(self, items: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 P(word | class) of words, given their counts in training."""
        out = self.item[items]
        tail = items - len(self.top)
        low = (tail >= 0) & (tail < TAILS)
        t, c = tail[low], counts[low]
        out[low] += np.where(c > 0, np.log10(np.maximum(c - DISCOUNT, 1e-9) / self.tail_tokens[t]), self.unseen[t])
        return out

    def assigned(self, words: np.ndarray, codes: np.ndarray, often: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The most likely class of each word, given how often (sorted by word) each class stands before it (code below the number of classes) and after it."""
        c = len(self.step)
        near = np.concatenate([self.step, self.step.T])
        out = np.zeros(len(counts), np.int64)
        first = np.flatnonzero(np.append(True, words[1:] != words[:-1])) if len(words) else np.zeros(0, np.int64)
        bounds = np.append(first, len(words))
        i, many = 0, max(1, (1 << 20) // c)
        while i < len(first):
            j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + many, "right")) - 1)
            a, z = bounds[i], bounds[j]
            w = words[first[i:j]]
            fit = np.add.reduceat(near[codes[a:z]] * often[a:z, None], first[i:j] - a) - counts[w, None] * np.log10(self.size + counts[w, None])
            fit[:, self.of[-1]] = -np.inf
            out[w] = fit.argmax(1)
            i = j
        return out


class Full:
    """log10 probabilities once every word of enough occurrences has its class: g are the class bigrams, got the numbers of words below the top by class."""

    def __init__(self, model: Model, g: np.ndarray, got: np.ndarray, tail_types: np.ndarray, tail_tokens: np.ndarray, tokens: int, types: int):
        c = len(g)
        self.tokens, self.types, self.end, self.tail_class = tokens, types, model.of[-1], model.of[len(model.top) : -1]
        share = (g.sum(0) + 1) / (g.sum() + c)
        self.step = np.log10((g + MASS * share) / (g.sum(1, keepdims=True) + MASS))
        self.size = g.sum(0) + got + np.bincount(model.of, minlength=c)
        self.tail_tokens = tail_tokens
        lost = np.where(tail_tokens > 0, DISCOUNT * tail_types / np.maximum(tail_tokens, 1), 1.0)
        self.unseen = np.log10(lost / (tail_types + 1))

    def classes(self, items: np.ndarray) -> np.ndarray:
        return np.append(np.arange(len(self.step)), self.tail_class)[items]

    def word(self, items: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 P(word | class): an item below the number of classes is a word of its own, the others are tails."""
        c = len(self.step)
        low = items >= c
        n = counts.astype(float)
        t = items[low] - c
        n[low] = self.tail_tokens[t]
        out = np.log10((n + 1) / self.size[self.classes(items)])
        k = counts[low]
        out[low] += np.where(k > 0, np.log10(np.maximum(k - DISCOUNT, 1e-9) / np.maximum(self.tail_tokens[t], 1)), self.unseen[t])
        return out


def told(of: DataFrame, answers: DataFrame) -> DataFrame:
    """The blocks with items and counts of their words, which are in the order of their numbers. answers: block, bucket, data, counts."""

    def join(rows: pa.Table, told: pa.Table) -> pa.Table:
        parts = sorted(zip(*(told.column(c).to_pylist() for c in ("bucket", "data", "counts"))))
        order = opened(rows.column("order")[0].as_py(), "<u4")[0]
        found = [np.empty(len(order), "<u2"), np.empty(len(order), "<u4")]
        found[0][order] = np.frombuffer(b"".join(x for _, x, _ in parts), "<u2")
        found[1][order] = np.concatenate([opened(x, "<u4")[0] for _, _, x in parts])
        out = rows.select(["doc_id", "held", "size", "tokens"])
        return out.append_column("items", pa.array([packed(found[0])], pa.binary())).append_column("counts", pa.array([packed(found[1])], pa.binary()))

    rows = of.select("block", "doc_id", "held", "size", "order", "tokens")
    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(join, "doc_id array<long>, held array<boolean>, size array<int>, tokens binary, items binary, counts binary")


def class_bigrams(of: DataFrame, tail_class: np.ndarray, classes: int, end: int) -> DataFrame:
    """code (class before * classes + class) and n over the training documents, when every item has its class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(classes * classes, np.int64)
        every = np.append(np.arange(classes), tail_class)
        for batch in batches:
            for held, size, items, tokens in _views(batch, ["held", "size", "items", "tokens"]):
                cls = every[items][_unpacked(tokens)]
                train = np.repeat(~np.array(held, bool), size)
                sums += np.bincount((np.append(end, cls[:-1]) * classes + cls)[train], minlength=len(sums))
        code = np.flatnonzero(sums)
        yield pa.RecordBatch.from_pydict({"code": pa.array(code), "n": pa.array(sums[code])})

    return of.select("held", "size", "items", "tokens").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def scored(of: DataFrame, model: Full) -> DataFrame:
    """A row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. of: what told() gives."""
    shared = of.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for doc_id, held, size, tokens, item, c in _views(batch, ["doc_id", "held", "size", "tokens", "items", "counts"]):
                item, c, tokens = item.astype(np.int64), c.astype(np.int64), _unpacked(tokens)
                base = np.log10((c + 1) / (m.tokens + 1 * (m.types + 1)))
                cls, word, known = m.classes(item), m.word(item, c), (c > 0).astype(np.int64)
                now = cls[tokens]
                before = np.append(m.end, now[:-1])
                start = np.cumsum(size) - size
                sums = [np.add.reduceat(x, start) for x in (base[tokens], m.step[before, now] + word[tokens], known[tokens])]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc_id, pa.int64()), "held_out": pa.array(held, pa.bool_()), "n_tokens": pa.array(np.array(size, np.int64)), "n_known": pa.array(sums[2]), "train_tokens": pa.array(np.full(len(size), m.tokens)), "base_score": pa.array(sums[0]), "score": pa.array(sums[1])}, SCORES)

    return of.select("doc_id", "held", "size", "tokens", "items", "counts").mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def freed(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of what has been written: nothing reads them again."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def class_count(words: int) -> int:
    """Classes for so many words that are items: CLASSES at 10,000 of them and below, growing with their fourth root."""
    return max(CLASSES, round(CLASSES * (words / 10_000) ** 0.25))


def class_scores(docs: DataFrame, parts: int = 7, part: int = 2, top_words: int | None = None, classes: int | None = None, least: int = LEAST) -> DataFrame:
    """Scores of all documents by a model of those that are not held out. Words seen least times are items; where top_words or classes are not given they grow with the number of such words."""
    of = written(blocks(docs, parts, part), "blocks")
    often = written(frequent(of, top_words or TOP, least), "frequent")
    freed(of.sparkSession)
    classes = classes or class_count(often.where(F.col("n") >= least).count())
    top_words = top_words or max(TOP, 8 * classes)
    best = often.orderBy(F.desc("n"), "word").select("word").limit(top_words).collect()
    top = np.sort(np.array([r[0] for r in best], np.int64).view(np.uint64))
    m = len(top) + TAILS + 1
    pairs = np.zeros((m, m))
    for code, n in bigrams(of, top).collect():
        pairs[divmod(code, m)] = n
    model = Model(top, pairs, np.zeros(TAILS), np.zeros(TAILS), 0, 0, classes)
    del pairs
    answers = written(counted(of, model, least), "answers")
    drop_written(often)
    freed(of.sparkSession)
    c = len(model.step)
    got, types, tokens, all_types, all_tokens = np.zeros(c), np.zeros(TAILS), np.zeros(TAILS), 0, 0
    for kind, k, t, n in answers.where("kind > 0").groupBy("kind", "bucket").agg(F.sum("word"), F.sum("n")).collect():
        if kind == 1:
            got[k] = t
        elif kind == 2:
            types[k], tokens[k] = t, n
        else:
            all_types, all_tokens = t, n
    full = written(told(of, answers.where("kind = 0").select("block", "bucket", "data", "counts")), "told")
    drop_written(of)
    drop_written(answers)
    freed(of.sparkSession)
    g = np.zeros((c, c))
    for code, n in class_bigrams(full, model.of[len(top) : -1], c, int(model.of[-1])).collect():
        g[divmod(code, c)] = n
    return scored(full, Full(model, g, got, types, tokens, all_tokens, all_types))


def op7_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_scores(table(spark, sf_dir, "documents"))
