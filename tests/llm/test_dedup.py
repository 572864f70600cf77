"""Near-duplicates, line dedup and the pipeline against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lindero.llm import linededup, neardup, pii
from lindero.llm.common import written


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute_components(rows, n, percent=80):
    sets = {}
    for d, t in rows:
        if d is not None:
            sets.setdefault(d, shingles(t, n))
    root = {d: d for d in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = top(a), top(b)
                root[max(p, q)] = min(p, q)
    return {d: top(d) for d in ids}, sets


def near_rows():
    """Groups around one text whose members link to some members only, and exact copies."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = []
    for _ in range(4):
        base = [word() for _ in range(150)]
        for _ in range(25):
            w = list(base)
            for _ in range(rng.randint(0, 9)):
                w[rng.randrange(len(w))] = word()
            rows.append(" ".join(w))
        rows += [" ".join(base)] * 3
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_near_duplicates(spark):
    rows = near_rows()
    want, sets = brute_components(rows, 5)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.n_shingles == len(sets[r.doc_id]) and r.kept == (r.component_id == r.doc_id) for r in got)


def test_blocks_of_members(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 3)
    rows = near_rows()
    want, _ = brute_components(rows, 5)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_near_duplicates_of_odd_rows(odd, odd_rows, none):
    want, _ = brute_components([(r[0], r[1]) for r in odd_rows], 4)
    got = neardup.near_duplicates(odd, words=4).collect()
    assert len(got) == len(odd_rows)
    for r in got:
        assert r.component_id == (None if r.doc_id is None else want[r.doc_id])
    assert neardup.near_duplicates(none).count() == 0


@pytest.mark.parametrize("n", [4, 5])
def test_every_short_text_alone(n):
    """Texts of 0 to 7 words, each as a slice of its own and all in one."""
    import numpy as np

    texts = [" ".join("abcdefg"[:k]) for k in range(8)] + ["", " ", "a b"]
    def sets(group):
        raw = [t.encode() for t in group]
        values, offs = neardup.shingle_sets(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), n)
        return [values[a:b].tolist() for a, b in zip(offs[:-1], offs[1:])]
    alone = [sets([t])[0] for t in texts]
    assert alone == sets(texts) and [len(x) for x in alone] == [len(shingles(t, n)) for t in texts]
    assert alone[2] == alone[-1] and alone[2] != alone[3]


def test_short_batches(spark):
    rows = [(1, "hello world"), (2, None), (3, "hello world"), (4, "one"), (5, "a b c")]
    for part in (rows, rows[:1], rows[3:4]):
        got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(part, "doc_id long, text string").repartition(5, "doc_id"), words=4).collect()}
        assert got == {d: 1 if t == "hello world" else d for d, t in part}


def test_repeated_ids(spark):
    """Rows that share an id are documents of their own."""
    rng = random.Random(6)
    long = lambda: " ".join(rng.choice("abcdefghijklmnop") * rng.randint(1, 4) for _ in range(80))
    a, b, c = long(), long(), long()
    rows = [(3, a), (3, b), (5, b), (2, a + " more"), (7, c), (7, c), (None, c), (None, a), (9, None), (9, "")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, row string, number int")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect()), key=str)
    n = lambda t: len(shingles(t, 5))
    want = [(3, n(a), 2, False), (3, n(b), 3, True), (5, n(b), 3, False), (2, n(a + " more"), 2, True), (7, n(c), 7, True), (7, n(c), 7, True), (None, n(c), None, True), (None, n(a), None, True), (9, 0, 9, True), (9, 0, 9, True)]
    assert got == sorted(want, key=str)
    kept = neardup.dedup(df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(3, b), (2, a + " more"), (7, c), (9, None), (9, "")], key=str)


def test_blocks_meet_once(spark):
    """Every pair of members of different components meets in exactly one group; members of the largest component meet none of their own."""
    from itertools import combinations

    rows = [(k, 0, 100 * k + r, 1 if r < 9 else r) for k in (1, 2) for r in range(16)]
    df = neardup.dealt(spark.createDataFrame(rows, "key long, t int, rep long, component long"), block=3)
    groups = {}
    for r in df.collect():
        groups.setdefault((r.key, r.lo, r.hi), []).append(r)
    met = [tuple(sorted((x.rep, y.rep))) for g in groups.values() for x, y in combinations(g, 2) if x.component != y.component and (x.lo == x.hi or x.block != y.block)]
    assert sorted(met) == sorted((x[2], y[2]) for x, y in combinations(rows, 2) if x[0] == y[0] and x[3] != y[3])
    assert sum(len(g) for g in groups.values()) == 2 * (9 * 3 + 7 * 6)


def brute_lines(rows, least=linededup.MIN_CHARS):
    def edits(a, b):
        if a == b:
            return 0
        k = 0
        while k < min(len(a), len(b)) and a[k] == b[k]:
            k += 1
        if len(a) < len(b):
            a, b = b, a
        return 1 if (len(a) == len(b) and a[k + 1 :] == b[k + 1 :]) or (len(a) == len(b) + 1 and a[k + 1 :] == b[k:]) else 2

    seen, out = {}, set()
    for d, t in sorted(rows):
        for i, raw in enumerate((t or "").split("\n")):
            s = raw.strip(" \t\n\x0b\f\r")
            if not s:
                continue
            if s in seen:
                out.add((d, i, *seen[s], 0))
                continue
            near = [at for x, at in seen.items() if len(s) >= least and len(x) >= least and edits(x, s) == 1]
            if near:
                out.add((d, i, *min(near), 1))
            seen[s] = (d, i)
    return out


def line_rows():
    rng = random.Random(3)
    base = ["".join(rng.choice("abc de") for _ in range(n)).strip() for n in (14, 16, 17, 20, 47, 48, 49, 97, 200, 500, 3000) for _ in range(2)] + ["a" * 40, "ab" * 60]
    rows = []
    for d in range(60):
        out = []
        for _ in range(6):
            s = rng.choice(base)
            k, r = rng.randrange(len(s)), rng.random()
            out.append(s[:k] + s[k + 1 :] if r < 0.3 else s[:k] + rng.choice("abxé") + s[k:] if r < 0.6 else s[:k] + rng.choice("xyé") + s[k + 1 :] if r < 0.8 else s)
        rows.append((d, "\n".join(out)))
    return [*rows, (60, None), (61, ""), (62, "\n\n \t \n"), (63, rows[0][1] + "\r\n\n  " + rows[1][1])]


def test_lines(spark):
    rows = line_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_lines(rows)
    assert {tuple(r) for r in linededup.dropped_lines(df).collect()} == want
    gone = {x[:2] for x in want}
    kept = {r.doc_id: r.text for r in linededup.dedup(df, keep_emptied=True).collect()}
    for d, t in rows:
        assert kept[d] == (None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone))


def test_lines_of_any_length(spark):
    """Without a least length, short lines one edit apart are found too."""
    rng = random.Random(11)
    rows = [(d, "\n".join("".join(rng.choice("ab1") for _ in range(rng.randint(1, 7))) for _ in range(4))) for d in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in linededup.dropped_lines(df, min_chars=0).collect()} == brute_lines(rows, 0)


def test_lines_of_shared_and_null_ids(spark):
    """No line goes but one that repeats an earlier one, whatever the ids; columns named like ours stay."""
    own = ["this line occurs nowhere else at all", "another line that occurs only here", "the third line of its own, in a row"]
    rows = [(1, own[0] + "\nshared by all the rows of the table"), (1, own[1] + "\nshared by all the rows of the table"), (None, own[2] + "\nshared by all the rows of the table"), (None, "shared by all the rows of the tables\nlast words of a row with no id"), (2, "this line occurs nowhere else at al")]
    df = spark.createDataFrame([(*r, [7], "g", [2], "c") for r in rows], "doc_id long, text string, gone_lines array<int>, gone_id string, text_lines_ array<int>, copy_ string")
    out = linededup.dedup(df, keep_emptied=True)
    assert out.columns == df.columns
    got = out.collect()
    assert len(got) == 5 and all(r.gone_lines == [7] and r.copy_ == "c" for r in got)
    text = "\n".join(r.text for r in got)
    assert all(text.count(x) == 1 for x in own) and text.count("last words of a row with no id") == 1
    assert text.count("shared by all the rows of the table") == 1 and [r.text for r in got if r.doc_id == 2] == [""]
    lines = linededup.dropped_lines(df).collect()
    assert len(lines) == 4 and all(r.edits == 1 for r in lines if r.doc_id == 2)


def test_lines_of_odd_rows(odd, none):
    out = linededup.dedup(odd)
    assert out.columns == odd.columns and out.count() <= odd.count()
    assert linededup.dropped_lines(none).count() == 0 and linededup.dedup(none).count() == 0


def test_no_python_in_native_plans(spark):
    from lindero.llm import quality

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for df in (linededup.dedup(docs), quality.filter_documents(docs), quality.described(docs)):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())


def test_pipeline(spark, tmp_path):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    clean = ["\n".join(" ".join(word() for _ in range(40)) for _ in range(3)) for _ in range(30)]
    rows = list(enumerate(clean))
    rows += [(100, clean[0]), (101, clean[1] + "\nmail me at a.b@c.de and +1 (262) 555-7240 " + " ".join(word() for _ in range(60))), (102, "too short"), (103, None), (104, "## $$ " * 100)]
    one = [word() for _ in range(300)]
    other = [*one[:150], "different", *one[151:]]
    rows += [(105, " ".join(one)), (106, " ".join(other))]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or ""), 7) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, stars int")
    text = dict(rows)
    steps = []
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, ""), name)
        steps.append({r.doc_id: r for r in docs.collect()})
    quality, lines, near, private, packed = steps
    assert set(quality) == {d for d in text if d not in (102, 103, 104)}
    gone = brute_lines([(d, r.text) for d, r in quality.items()])
    want = {d: "\n".join(x for i, x in enumerate(r.text.split("\n")) if (d, i) not in {g[:2] for g in gone}) for d, r in quality.items()}
    assert {d: r.text for d, r in lines.items()} == {d: t for d, t in want.items() if t.strip()}
    assert 100 not in lines and all(r.n_chars == len(r.text) and r.stars == 7 for r in lines.values())
    root, _ = brute_components([(d, r.text) for d, r in lines.items()], 5)
    assert set(near) == {d for d in lines if root[d] == d} and 106 not in near
    assert "a.b@c.de" not in private[101].text and "<email>" in private[101].text and not any(pii.base_spans(r.text) for r in private.values())
    assert set(packed) == set(private)
    assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        empty = written(stage(spark, empty, ""), name)
        assert empty.count() == 0


@pytest.mark.parametrize("name", ["op9_quality"])
def test_sql(spark, name):
    from oracle import compared

    from lindero.llm import queries

    assert compared(queries.QUERIES[name](spark, "/root/testdata/sf0.001"), queries.ORACLES[name], "/root/testdata/sf0.001") == ""
