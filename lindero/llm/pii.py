"""Personal data by a skip-chain conditional random field.

Base spans come from patterns (email, ip, card, phone). The field labels the tokens of a document
that have a digit or an at sign: tokens of base spans are fixed to their kinds, the others are found
by loopy belief propagation over three kinds of potentials:
- a token's own: weights of its shape, its length, what stands beside it, checks such as Luhn's;
- of neighbouring tokens: how labels follow one another;
- of distant tokens with an equal or similar value (the same letters and digits, or the same last
  seven digits): these share a label. Each is tied to the one before it, so a value that occurs n
  times makes n - 1 such links.
Messages go over the graphs of a whole batch at once, damped, until none changes by more than SETTLED
(or ROUNDS times, which only messages that swing for ever reach), so a label reaches every occurrence
of a value, however many lie between. Tokens whose marginal for a kind is at least SURE add spans;
neighbours of one kind are one span. Added spans never overlap base ones.

The weights are trained by pseudo-likelihood, the base spans' labels as the truth, on the tokens of
SAMPLE_DOCS documents, those with the smallest hashes of their ids. Equal situations travel once with
their number, which weighs them; of more than SAMPLE_TOKENS distinct ones, the most frequent are taken.

Cases: null, empty and digit-free texts have no spans. Texts of any length are read whole; there is
no limit on tokens. Null ids are kept. Repeated rows get equal spans. With no training tokens the
field adds nothing. Empty tables give no rows. mask() keeps all columns, other names included.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buffer_of, table

KINDS = ("email", "ip", "card", "phone")
LABELS = 5  # none, then KINDS
BUCKETS = 1 << 12
SAMPLE_DOCS, SAMPLE_TOKENS = 20_000, 50_000
ROUNDS, SETTLED, DAMP, SURE = 1000, 1e-3, 0.3, 0.9
#: What equal or similar tokens weigh towards one label before training says otherwise.
AGREE = 2.0

_AT = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
# A match begins where a run of digits does: looking for one inside a run would take quadratic time.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """As a pattern with the local part before the at sign would find them: the part is the whole run before it."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _AT.match(text, at)):
            out.append((start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[Span]:
    """The patterns' spans by start, then kind."""
    out = [(a, 0, b) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c in "0123456789" for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _shape(word: str) -> str:
    return re.sub(r"(.)\1+", lambda m: m[1] + "+", re.sub(r"[^\W\d_]", "a", re.sub(r"[0-9]", "9", word)))[:24]


def _features(words: list[str], k: int, core: str) -> list[int]:
    digits = re.sub(r"[^0-9]", "", core)
    parts = core.split(".")
    found = [
        "one", "shape=" + _shape(core), f"digits={min(len(digits), 20)}", f"at={'@' in core}", f"dots={min(core.count('.'), 4)}",
        f"plus={core[:1] == '+'}", f"paren={'(' in core}", f"letters={any(map(str.isalpha, core))}",
        f"luhn={13 <= len(digits) <= 19 and digits == core and luhn(digits)}",
        f"octets={len(parts) == 4 and all(p.isdecimal() and p.isascii() and len(p) <= 3 and int(p) <= 255 for p in parts)}",
        "before=" + (_shape(words[k - 1]) if k else "^"), "after=" + (_shape(words[k + 1]) if k + 1 < len(words) else "$"),
    ]
    return [zlib.crc32(f.encode()) % BUCKETS for f in found]


class Graph:
    """Tokens of many documents, with their links."""

    def __init__(self) -> None:
        self.features: list[list[int]] = []
        self.fixed: list[int] = []  # label, or -1
        self.place: list[tuple[int, int, int, int]] = []  # document, word, start, end
        self.chain: list[tuple[int, int]] = []
        self.skip: list[tuple[int, int]] = []

    def add(self, doc: int, text: str, base: list[Span]) -> None:
        spots = [(m.start(), m.end()) for m in _WORD.finditer(text)]
        words = [text[a:b] for a, b in spots]
        seen: dict[str, int] = {}
        last, b = (-2, -1), 0
        longest = 0  # end of the furthest-reaching base span before b
        for k, (start, end) in enumerate(spots):
            word = words[k]
            if not ("@" in word or any(c in word for c in "0123456789")):
                continue
            core = word.strip(".,;:!?\"'<>[]{}")
            if not core:
                continue
            a = start + word.index(core)
            z = a + len(core)
            while b < len(base) and base[b][2] <= start:
                b += 1
            label, j = -1, b
            while j < len(base) and base[j][0] < end:
                if base[j][2] > start:
                    label = base[j][1] + 1
                    break
                j += 1
            node = len(self.fixed)
            self.features.append(_features(words, k, core))
            self.fixed.append(label)
            self.place.append((doc, k, a, z))
            if last[0] == k - 1:
                self.chain.append((last[1], node))
            last = (k, node)
            plain = re.sub(r"[^0-9a-z]", "", core.lower())
            digits = re.sub(r"[^0-9]", "", core)
            for key in {plain if len(plain) >= 6 else "", "#" + digits[-7:] if len(digits) >= 7 else ""} - {""}:
                if (other := seen.get(key)) is not None and (other, node) not in self.skip[-2:]:
                    self.skip.append((other, node))
                seen[key] = node


class Field:
    """Weights of the three kinds of potentials."""

    def __init__(self) -> None:
        self.own = np.zeros((BUCKETS, LABELS))
        self.chain = np.zeros((LABELS, LABELS))
        self.skip = AGREE

    def train(self, rows: list[tuple[int, list[int], int, int, list[int], int]], steps: int = 200, rate: float = 0.5, ridge: float = 1e-3) -> None:
        """Pseudo-likelihood by full gradients. rows: label, features, labels before and behind (-1: none), labels of linked tokens, how often."""
        if not rows:
            return
        y = np.array([r[0] for r in rows])
        x = np.array([r[1] for r in rows])
        before, behind = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
        linked = np.zeros((len(rows), LABELS))
        for k, r in enumerate(rows):
            for label in r[4]:
                linked[k, label] += 1
        truth = np.eye(LABELS)[y]
        share = np.array([r[5] for r in rows], float)[:, None]
        share /= share.sum()
        has_b, has_a = before >= 0, behind >= 0
        for _ in range(steps):
            z = self.own[x].sum(1) + self.skip * linked
            z[has_b] += self.chain[before[has_b]]
            z[has_a] += self.chain[:, behind[has_a]].T
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            d = (p - truth) * share
            g = np.zeros_like(self.own)
            np.add.at(g, x.reshape(-1), np.repeat(d, x.shape[1], 0))
            self.own -= rate * (g + ridge * self.own)
            c = np.zeros_like(self.chain)
            np.add.at(c, before[has_b], d[has_b])
            np.add.at(c.T, behind[has_a], d[has_a])
            self.chain -= rate * (c + ridge * self.chain)
            self.skip -= rate * ((d * linked).sum() + ridge * (self.skip - AGREE))

    def marginals(self, graph: Graph) -> np.ndarray:
        """Each token's label probabilities by loopy belief propagation."""
        n = len(graph.fixed)
        unary = self.own[np.array(graph.features).reshape(n, -1)].sum(1) if n else np.zeros((0, LABELS))
        fixed = np.array(graph.fixed, np.int64)
        at = np.flatnonzero(fixed >= 0)
        unary[at] = -50.0
        unary[at, fixed[at]] = 0.0
        pairs = np.array(graph.chain + graph.skip, np.int64).reshape(-1, 2)
        together = self.skip * np.eye(LABELS)
        pots = np.concatenate([np.broadcast_to(self.chain, (len(graph.chain), LABELS, LABELS)), np.broadcast_to(together, (len(graph.skip), LABELS, LABELS))])
        source, target = np.concatenate([pairs[:, 0], pairs[:, 1]]), np.concatenate([pairs[:, 1], pairs[:, 0]])
        pots = np.concatenate([pots, pots.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(pairs)) + len(pairs), np.arange(len(pairs))])
        message = np.full((len(source), LABELS), -np.log(LABELS))

        def norm(v: np.ndarray) -> np.ndarray:
            top = v.max(-1, keepdims=True)
            return v - top - np.log(np.exp(v - top).sum(-1, keepdims=True))

        belief = unary.copy()
        for _ in range(ROUNDS if len(source) else 0):
            out = (belief[source] - message[back])[:, :, None] + pots
            top = out.max(1, keepdims=True)
            new = norm(np.log(np.exp(out - top).sum(1)) + top[:, 0])
            change = np.abs(np.exp(new) - np.exp(message)).max()
            message = DAMP * message + (1 - DAMP) * new
            belief = unary.copy()
            np.add.at(belief, target, message)
            if change < SETTLED:
                break
        return np.exp(norm(belief))

    def added(self, graph: Graph, bases: dict[int, list[Span]]) -> dict[int, list[Span]]:
        """Spans that the field adds, by document."""
        out: dict[int, list[Span]] = {}
        if all(x >= 0 for x in graph.fixed):
            return out
        p = self.marginals(graph)
        label = p.argmax(1)
        yes = (p.max(1) >= SURE) & (label > 0) & (np.array(graph.fixed) < 0)
        last = (-1, -1, -1)
        for node in np.flatnonzero(yes).tolist():
            doc, word, a, b = graph.place[node]
            kind = int(label[node]) - 1
            if any(x < b and a < y for x, _, y in bases.get(doc, ())):
                continue
            spans = out.setdefault(doc, [])
            if last == (doc, word - 1, kind):
                spans[-1] = (spans[-1][0], kind, b)
            else:
                spans.append((a, kind, b))
            last = (doc, word, kind)
        return out


def _marked_rows(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Rows with a digit or an at sign."""
    hit = np.concatenate([[0], np.cumsum((buf - 48 < 10) | (buf == 64))])  # unsigned: below 0 wraps around
    return np.flatnonzero(hit[offs[1:]] > hit[offs[:-1]])


def batch_spans(column: pa.Array, field: Field) -> dict[int, tuple[str, list[Span], list[Span]]]:
    """Text, base spans and all spans of each row that can have any."""
    buf, offs = buffer_of(column)
    graph, texts, bases = Graph(), {}, {}
    for k in _marked_rows(buf, offs).tolist():
        texts[k] = buf[offs[k] : offs[k + 1]].tobytes().decode("utf-8", "replace")
        bases[k] = base_spans(texts[k])
        graph.add(k, texts[k], bases[k])
    added = field.added(graph, bases)
    return {k: (texts[k], bases[k], sorted(bases[k] + added.get(k, []))) for k in texts}


def trained(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Field:
    """A field from the base spans of the sample."""
    h = F.xxhash64("doc_id")
    last = docs.select(h.alias("h")).orderBy("h").limit(sample_docs).agg(F.max("h")).first()[0]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = buffer_of(batch.column(0))
            graph = Graph()
            for k in _marked_rows(buf, offs).tolist():
                text = buf[offs[k] : offs[k + 1]].tobytes().decode("utf-8", "replace")
                graph.add(k, text, base_spans(text))
            label = [max(0, x) for x in graph.fixed]
            before, behind, linked = [-1] * len(label), [-1] * len(label), [[] for _ in label]
            for a, b in graph.chain:
                before[b], behind[a] = label[a], label[b]
            for a, b in graph.skip:
                linked[a].append(label[b])
                linked[b].append(label[a])
            if label:
                yield pa.RecordBatch.from_pydict({"label": pa.array(label, pa.int32()), "x": pa.array(graph.features, pa.list_(pa.int32())), "before": pa.array(before, pa.int32()), "behind": pa.array(behind, pa.int32()), "linked": pa.array(linked, pa.list_(pa.int32()))})

    field = Field()
    if last is not None:
        found = docs.where(h <= last).select("text").mapInArrow(rows, "label int, x array<int>, before int, behind int, linked array<int>")
        rows_ = found.groupBy(*found.columns).count().orderBy(F.desc("count"), F.xxhash64(*found.columns)).limit(SAMPLE_TOKENS).collect()
        field.train(sorted((r[0], list(r[1]), r[2], r[3], list(r[4]), r[5]) for r in rows_))
    return field


def found(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, counts of base spans, base_sha256, base and spans (all of them)."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    empty = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = batch_spans(batch.column(1), shared.value)
            rows = [([0] * 4, empty, "")] * batch.num_rows
            for k, (_, base, spans) in got.items():
                counts = [0] * 4
                for _, kind, _ in base:
                    counts[kind] += 1
                rows[k] = (counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).cast(pa.int64())} | {f"n_{kind}": pa.array([r[0][i] for r in rows], pa.int64()) for i, kind in enumerate(KINDS)} | {"base_sha256": pa.array([r[1] for r in rows], pa.string()), "spans": pa.array([r[2] for r in rows], pa.string())})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked_text(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, as its kind's name in angle brackets."""
    out, at = [], 0
    for a, kind, b in spans:
        if a >= at:
            out += [text[at:a], f"<{KINDS[kind]}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, field: Field) -> DataFrame:
    """docs with personal data in text replaced by the kinds' names; other columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = batch_spans(batch.column(at), shared.value)
            change = {k: masked_text(text, spans) for k, (text, _, spans) in got.items() if spans}
            if change:
                texts = batch.column(at).to_pylist()
                for k, text in change.items():
                    texts[k] = text
                columns = list(batch.columns)
                columns[at] = pa.array(texts, batch.schema.field(at).type)
                batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            yield batch

    return docs.mapInArrow(run, docs.schema)


def op4_skipchain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return found(docs, trained(docs))
