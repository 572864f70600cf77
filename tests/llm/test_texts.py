"""Personal data, languages, language models and quality rules."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from lindero.llm import brown, langid, pii, quality

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def base(text):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for kind, pattern, low, high in ((2, r"[0-9]([\x20-]?[0-9])+", 14, 19), (3, r"\+[0-9][\x20().0-9-]+[0-9]", 10, 15)):
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            if low <= len(digits) <= high and (kind == 3 or pii.luhn(digits)):
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_are_the_patterns():
    rng = random.Random(4)
    parts = ["a.b@c.de", "@", "x@y", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (262) 555-7240", "+12", " ", "a@b.c@d.ef", "é@ü.de", "12345678901234567890", "\n", "%+-@a.b", "٣٤"]
    for _ in range(2000):
        text = "".join(rng.choice(parts) + rng.choice(["", " ", ","]) for _ in range(rng.randint(0, 8)))
        assert pii.base_spans(text) == base(text), text


@pytest.mark.parametrize("text", ["0" * 5000 + ".1.1.1", "1." + "0" * 9000 + "7.2.255", "1.2.3." + "9" * 6000, "0" * 5000 + "256.1.1.1", "4" * 5000, "+1" + "0" * 9000, "a" * 9000 + "@b.c"])
def test_base_spans_of_very_long_numbers(text):
    import sys

    got, limit = pii.base_spans(text), sys.get_int_max_str_digits()
    try:
        sys.set_int_max_str_digits(0)
        assert got == base(text)
    finally:
        sys.set_int_max_str_digits(limit)


def test_long_runs_take_linear_time():
    began = time.monotonic()
    for text in ("4" * 2_000_000, "1.2.3." * 300_000, "+1" + "(" * 2_000_000, "a" * 2_000_000 + "@", "@" * 1_000_000, "+1" * 500_000):
        pii.base_spans(text)
    assert time.monotonic() - began < 20


def _exact(field, graph):
    """Marginals by summing over all labellings."""
    import itertools

    import numpy as np

    n = len(graph.fixed)
    total = np.zeros((n, pii.LABELS))
    for labels in itertools.product(*[range(pii.LABELS) if x < 0 else [x] for x in graph.fixed]):
        score = sum(field.own[graph.features[k], y].sum() for k, y in enumerate(labels) if graph.fixed[k] < 0)
        score += sum(field.chain[labels[a], labels[b]] for a, b in graph.chain) + field.skip * sum(labels[a] == labels[b] for a, b in graph.skip)
        for k, y in enumerate(labels):
            total[k, y] += math.exp(score)
    return total / total.sum(1, keepdims=True)


def _graph(fixed, chain, skip, rng):
    g = pii.Graph()
    g.fixed, g.chain, g.skip = fixed, chain, skip
    g.features = [[int(rng.integers(0, 40)) for _ in range(3)] for _ in fixed]
    return g


def test_messages_give_the_marginals():
    """Exactly where the links form no ring, and nearly where they do."""
    import numpy as np

    rng = np.random.default_rng(7)
    for _ in range(10):
        field = pii.Field()
        field.own[:40], field.chain, field.skip = rng.normal(0, 0.7, (40, pii.LABELS)), rng.normal(0, 0.7, (pii.LABELS, pii.LABELS)), 1.5
        tree = _graph([-1, 4, -1, -1, -1, -1], [(0, 1), (2, 3)], [(1, 2), (3, 4), (4, 5)], rng)
        assert np.abs(field.marginals(tree) - _exact(field, tree)).max() < 0.01
        ring = _graph([-1, 4, -1, -1, -1], [(0, 1), (1, 2), (2, 3), (3, 4)], [(0, 2), (2, 4)], rng)
        assert np.abs(field.marginals(ring) - _exact(field, ring)).max() < 0.15


def test_a_label_reaches_every_occurrence():
    """A value that occurs 400 times, found once by pattern at the start, has its label at the end too."""
    field = pii.Field()
    field.skip = 8.0
    text = "+1 (262) 555-7240 " + "and 555-7240 " * 400
    graph = pii.Graph()
    graph.add(0, text, pii.base_spans(text))
    assert field.marginals(graph)[-1].argmax() == 4


def test_training_counts_equal_situations():
    """n equal rows and one row that stands for n train alike."""
    import numpy as np

    rows = [(1, [3, 5], -1, 0, [1]), (0, [3, 6], 1, -1, []), (2, [7, 8], 0, -1, [2])]
    one, many = pii.Field(), pii.Field()
    one.train([(*r, k) for r, k in zip(rows, (5, 1, 2))])
    many.train([(*r, 1) for r, k in zip(rows, (5, 1, 2)) for _ in range(k)])
    assert np.allclose(one.own, many.own) and np.allclose(one.chain, many.chain) and one.skip == pytest.approx(many.skip)


def test_private_data(spark, odd, odd_rows, none):
    rng = random.Random(1)
    said = [(10_000 + k, " ".join([f"w{rng.choice('abc')}", f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}", "and", f"u{k}@mail.com", "vers", f"{k}.0", "etc"])) for k in range(300)]
    docs = odd.select("doc_id", "text").union(spark.createDataFrame(said, "doc_id long, text string"))
    field = pii.trained(docs)
    assert field.skip > 0
    rows = {r.doc_id: r for r in pii.found(docs, field).collect()}
    for doc_id, text in [(r[0], r[1]) for r in odd_rows] + said:
        want = base(text or "")
        r = rows[doc_id]
        assert r.base_sha256 == hashlib.sha256(pii.joined(want).encode()).hexdigest()
        assert set(pii.joined(want).split(",")) <= set(r.spans.split(","))
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == i for _, k, _ in want) for i in range(4))
    # A value that is found once by pattern carries its label to where the pattern misses it.
    graph, text = pii.Graph(), "call +1 (262) 555-7240 now or 555-7240 later, 17 cats"
    graph.add(0, text, pii.base_spans(text))
    p = field.marginals(graph)
    words = [text[a:b] for _, _, a, b in graph.place]
    assert p[len(words) - 2].argmax() == 4 and p[words.index("17"), 1:].max() < pii.SURE
    masked = {r.doc_id: r for r in pii.mask(odd, field).collect()}
    assert "<email>" in masked[8].text and "a.b@c.de" not in masked[8].text and masked[8].rep == 1
    assert masked[0].text is None and pii.found(none, field).count() == 0
    assert pii.trained(none).skip == pii.AGREE


def test_ppm_costs_are_exact():
    """Code lengths of the table against a plain walk down the contexts."""
    m = langid.Model({"a": [b"abracadabra"], "b": [b"zzzz yyyy"]}, 3)
    counts = {}
    padded = [m.start] * 3 + [int(m.symbol[b]) for b in b"abracadabra"]
    for i in range(3, len(padded)):
        for d in range(4):
            counts.setdefault(tuple(padded[i - d : i]), Counter())[padded[i]] += 1
    text = b"abraxz"
    seq, want = [m.start] * 3 + [int(m.symbol[b]) for b in text], 0.0
    for i in range(3, len(seq)):
        gone = set()
        for d in range(3, -1, -1):
            here = {s: n for s, n in counts.get(tuple(seq[i - d : i]), {}).items() if s not in gone}
            if not here:
                continue
            total = sum(here.values()) + len(here)
            if seq[i] in here:
                want -= math.log2(here[seq[i]] / total)
                break
            want -= math.log2(len(here) / total)
            gone |= set(here)
        else:
            want += math.log2(m.a - len(gone))
    import numpy as np

    got = m.lengths(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert got[0, 0] == pytest.approx(want, rel=1e-5)


def test_ppm_table_is_bounded():
    """Where the table would be too large, the trees are less deep, as if they had been from the start."""
    import numpy as np

    texts = {"a": [b"abracadabra", b"cabbage"], "b": [b"zzzz yyyy xyz"]}
    whole, less = langid.Model(texts, 3), langid.Model(texts, 2)
    bound = langid.Model(texts, 3, table_bytes=whole.costs.nbytes - 1)
    text = np.frombuffer(b"abyss zebra", np.uint8)
    assert bound.order == 2 and bound.costs.nbytes < whole.costs.nbytes
    assert np.allclose(bound.lengths(text, np.array([0, 11])), less.lengths(text, np.array([0, 11])))


def test_languages(spark, odd, none):
    rng = random.Random(2)
    make = {"xx": "abcdefgh", "yy": "hijklmno"}
    rows = [(k, "".join(rng.choice(make[lang] + " ") for _ in range(200)), lang) for k in range(200) for lang in [rng.choice(list(make))]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learned(docs.where("doc_id < 150"))
    got = {r.doc_id: r.lang_pred for r in langid.predicted(docs, model).collect()}
    assert sum(got[k] == lang for k, _, lang in rows if k >= 150) >= 49
    rows = {r.doc_id: r for r in langid.predicted(odd, model).collect()}
    assert rows[0].lang_pred == rows[1].lang_pred == rows[2].lang_pred == "und" and rows[0].score == 0
    assert all(0 <= r.score <= 1 for r in rows.values())
    assert langid.predicted(none, model).count() == 0
    assert {r.lang_pred for r in langid.predicted(odd, langid.learned(none)).collect()} == {"und"}


def test_languages_are_not_capped(spark):
    """Any number of languages is learned, and texts over the byte budget do not stand for their language."""
    many = spark.createDataFrame([(k, f"text of {k}", f"l{k:03}") for k in range(230)], "doc_id long, text string, lang string")
    assert sorted(langid.learned(many, sample_docs=1).languages) == [f"l{k:03}" for k in range(230)]
    long = spark.createDataFrame([(k, "q" * 200, "xx") for k in range(30)] + [(30, "aaa", "xx"), (31, "z" * 500, "yy"), (32, "w" * 300, "yy")], "doc_id long, text string, lang string")
    m = langid.learned(long, sample_bytes=100)
    rest = m.symbol[ord("!")]
    assert m.symbol[ord("q")] == m.symbol[ord("z")] == rest and rest not in (m.symbol[ord("a")], m.symbol[ord("w")])


def test_class_scores(spark, odd, odd_rows, none):
    rng = random.Random(3)
    more = [(100 + k, " ".join(rng.choice(["the cat sat", "the dog ran", "a bird flew"]) for _ in range(30)), None) for k in range(60)]
    docs = odd.select("doc_id", "text").union(spark.createDataFrame([m[:2] for m in more], "doc_id long, text string"))
    every = [(r[0], r[1]) for r in odd_rows] + [m[:2] for m in more]
    tokens = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    c = Counter(x for d, t in every if not held(d) for x in tokens(t))
    n, v = sum(c.values()), len(c)
    got = brown.class_scores(docs, classes=8).collect()
    assert len(got) == len(every)
    rows = {r.doc_id: r for r in got}
    for d, t in every:
        w, r = tokens(t), rows[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(d), len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel=1e-9)
    out = [r for r in got if r.held_out and r.doc_id >= 100]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    assert brown.class_scores(none).count() == 0


def test_many_buckets_give_the_same_scores(spark, odd, monkeypatch):
    one = sorted(map(tuple, brown.class_scores(odd, classes=6).collect()), key=str)
    monkeypatch.setattr(brown, "BUCKET_WORDS", 50)
    assert sorted(map(tuple, brown.class_scores(odd, classes=6).collect()), key=str) == one


def test_class_model_sums_to_one():
    import numpy as np

    rng = np.random.default_rng(0)
    top = np.sort(rng.integers(1, 1 << 60, 6, dtype=np.uint64))
    m = len(top) + brown.TAILS + 1
    pairs = np.zeros((m, m))
    pairs[:8, :8] = rng.integers(0, 9, (8, 8))
    types, tokens = np.zeros(brown.TAILS), np.zeros(brown.TAILS)
    types[0], tokens[0] = 3, 7
    model = brown.Model(top, pairs, types, tokens, 100, 9, 5)
    assert np.allclose((10**model.step).sum(1), 1)
    share = np.bincount(model.of, weights=10**model.item)
    assert np.allclose(share, 1)
    seen = model.word(np.full(3, 6), np.array([1, 2, 4])) - model.item[6]
    unseen = model.word(np.full(1, 6), np.array([0])) - model.item[6]
    assert (10**seen).sum() + (types[0] + 1) * 10 ** unseen[0] == pytest.approx(1)


def test_words_below_the_top_get_their_own_class(spark):
    """Two words that end alike, both outside the top, follow different words: each takes the class of the words it stands like."""
    rng = random.Random(4)
    pairs = [(rng.choice(["red", "blue"]), rng.choice(["cat", "dog", "catxyz"])) if rng.random() < 0.5 else (rng.choice(["runs", "sits"]), rng.choice(["fast", "well", "fastxyz"])) for _ in range(4000)]
    docs = spark.createDataFrame([(k, " ".join(f"{a} {b}" for a, b in pairs[40 * k : 40 * k + 40])) for k in range(100)], "doc_id long, text string").coalesce(1)
    of = brown.blocks(docs)
    import numpy as np

    h = {w: brown.hash_spans(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w)]))[0] for w in "red blue runs sits cat dog fast well catxyz fastxyz".split()}
    top = np.sort(np.array([h[w] for w in "red blue runs sits cat dog fast well".split()], np.uint64))
    m = len(top) + brown.TAILS + 1
    pairs = np.zeros((m, m))
    for code, n in brown.bigrams(of, top).collect():
        pairs[divmod(code, m)] = n
    model = brown.Model(top, pairs, np.zeros(brown.TAILS), np.zeros(brown.TAILS), 0, 0, 6)
    rows = brown.counted(of, model, 5).where("kind = 0").collect()
    block = of.collect()[0]
    words = np.frombuffer(block.words, "<u8")
    item = dict(zip(words.tolist(), np.frombuffer(rows[0].data[: len(words) * 2], "<u2").tolist()))
    assert len(rows) == 1 and len({item[int(h[w])] for w in ("catxyz", "fastxyz")}) == 2
    assert all(item[int(h[w])] < len(model.step) for w in h)


def test_class_scores_know_words_below_the_top(spark):
    rng = random.Random(5)
    text = lambda: " ".join(x for _ in range(20) for x in rng.choice([("red", "catxyz"), ("runs", "fastxyz")]))
    docs = spark.createDataFrame([(k, text()) for k in range(200)] + [(1000, "red catxyz " * 5), (1001, "red fastxyz " * 5)], "doc_id long, text string")
    rows = {r.doc_id: r.score for r in brown.class_scores(docs, top_words=2, classes=6).collect()}
    assert rows[1000] > rows[1001] + 1
    assert brown.class_count(1_000_000) > brown.class_count(10_000) == brown.CLASSES


def test_exchange_finds_classes():
    import numpy as np

    rng = np.random.default_rng(1)
    kind = np.array([k % 3 for k in range(12)])
    counts = np.array([[rng.integers(40, 60) if kind[b] == (kind[a] + 1) % 3 else rng.integers(0, 3) for b in range(12)] for a in range(12)], float)
    counts = np.pad(counts, (0, 1))
    of = brown.exchange(counts, 4)[:12]
    assert all((of[a] == of[b]) == (kind[a] == kind[b]) for a in range(12) for b in range(12))


def test_quality(spark, odd, odd_rows, none):
    rows = {r.doc_id: r for r in quality.described(odd).collect()}
    for doc_id, text, *_ in odd_rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        hit = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
        ls = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = rows[doc_id]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(w), sum(map(len, w)), len(hit), len(ls) - len(set(ls)))
    assert rows[0].first_failed is not None and rows[1].first_failed is not None
    kept = quality.filter_documents(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {k for k, r in rows.items() if r.first_failed is None}
    assert quality.filter_documents(none).count() == 0 and quality.described(none).count() == 0


def test_cascade_order_does_not_change_the_verdict(odd):
    from pyspark.sql import functions as F

    text = F.col("text")
    names = quality.rules(quality.counts(text, quality.words(text)))
    verdicts = []
    for order in (1, -1):
        figures = {n: (1.0, order * k + 10) for k, n in enumerate(names)}
        verdicts.append([r[0] is None for r in odd.select(_cascade(text, figures)).collect()])
    assert verdicts[0] == verdicts[1]


def test_cascade_is_ordered_by_rejection_per_cost(spark):
    from pyspark.sql import functions as F

    figures = {"dear": (4.0, 0.8), "cheap": (1.0, 0.3), "idle": (0.1, 0.0)}
    rows = spark.range(1).select(quality.cascade({k: F.lit(True) for k in figures}, figures).alias("a"), quality.cascade({"dear": F.lit(True), "cheap": F.lit(False), "idle": F.lit(True)}, figures).alias("b"))
    assert tuple(rows.first()) == ("cheap", "dear")
    # What comes behind a rule that rejects is not computed: it would raise.
    figures = {"first": (1.0, 1.0), "second": (1.0, 0.5)}
    lazy = F.raise_error(F.lit("computed")).cast("boolean")
    assert spark.range(3).where("id > 0").select(quality.cascade({"first": F.col("id") > 0, "second": lazy}, figures)).collect() == [("first",)] * 2


def test_rules_are_measured(spark, none):
    docs = spark.createDataFrame([("few words",)] * 30 + [(" ".join(f"word{k}" for k in range(80)),)] * 10, "text string")
    got = quality.measured(docs)
    assert got["too_few_words"][1] == 0.75 and got["symbols"][1] == 0 and all(s > 0 for s, _ in got.values())
    assert all(share == 0 for _, share in quality.measured(none).values())


def _cascade(text, figures):
    return quality.let(quality.words(text), lambda w: quality.cascade(quality.rules(quality.counts(text, w)), figures))


def test_packed_columns():
    rng = np.random.default_rng(3)
    for n in (0, 1, 1000):
        words = np.unique(rng.integers(0, 1 << 64, n, np.uint64))
        tails, counts = rng.integers(0, 256, len(words)).astype("<u2"), rng.integers(0, 9, len(words)).astype("<u4")
        a, b, c = brown.opened(brown.packed(brown.steps(words), tails, counts), "<u8", "<u2", "<u4")
        assert (np.cumsum(a, dtype=np.uint64) == words).all() and (b == tails).all() and (c == counts).all()
    # Numbers of few values take less than half of what they are.
    assert len(brown.packed(rng.integers(0, 200, 5000).astype("<u4"))) < 2 * 5000


def test_frequent_words_are_exact(spark, monkeypatch):
    """A word that leads in no block but is the most frequent of all is among the first, with its whole count."""
    monkeypatch.setattr(brown, "BLOCK_BYTES", 1)
    monkeypatch.setattr(brown, "BUCKET_WORDS", 30)
    docs = spark.createDataFrame([(k, " ".join([f"own{k}x{j} " * 3 for j in range(8)]) + "all all") for k in range(12)], "doc_id long, text string")
    of = brown.blocks(docs)
    best = sorted(((r.n, r.word) for r in brown.frequent(of, 1, 5).collect()), reverse=True)
    h = brown.hash_spans(np.frombuffer(b"all", np.uint8), np.array([0]), np.array([3])).view(np.int64)[0]
    train = sum(not brown.held_out_part(k, 7, 2) for k in range(12))
    assert of.count() == 12 and best[0] == (2 * train, h) and all(n == 3 for n, _ in best[1:])
