"""Each registered query on a small folder of tables: its contract's columns, against brute force."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from test_dedup import brute_components, brute_lines
from test_texts import base
from test_tokens import whole_ids

from lindero.llm import linededup, packing, pii, queries

def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def part(doc_id, parts):
    return zlib.crc32(str(doc_id).encode()) % parts == 2


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(2, 8)))
    out = [None, "", " \n\t", "hello world", "1\n\xa0", "a <|endoftext|> b", "0" * 5000 + ".1.1.1", " " * 3000, "mail a.b@c.de or +1 (262) 555-7240\ncall 555-7240", "日本 語　x " * 40, "## $$ " * 90]
    texts = ["\n".join(" ".join(word(letters) for _ in range(30)) + "." for _ in range(4)) for _ in range(12) for letters in ("abcdefgh", "ijklmnopq")]
    out += texts + texts[:3] + [t.replace("a", "b", 1) for t in texts[3:6]] + [texts[0] + "\n" + " ".join(word("abc") for _ in range(4000))]
    return [(3 * k + 1, t, None if k % 7 == 0 else "xx" if k % 2 else "yy") for k, t in enumerate(out)]


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(*r, f"s{r[0] % 2}", len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{at}/documents.parquet")
    pages = [(k, f"http://h/{k}", t and f"<p>{t}</p>") for k, t, _ in rows] + [(900 + k, "http://x", f"<p>{rows[14][1]}</p>") for k in range(3)]
    spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2).write.parquet(f"{at}/pages.parquet")
    return at


def run(spark, folder, name, columns):
    df = queries.QUERIES[name](spark, folder)
    assert df.columns[: len(columns.split())] == columns.split()
    return df.collect()


def test_pack(spark, folder, rows):
    got = run(spark, folder, "op1_pack", "doc_id piece start length ids_crc32 sequence_id offset")
    text = {d: t for d, t, _ in rows}
    by_seq = {}
    for d in text:
        ids = whole_ids(text[d])
        mine = sorted((r for r in got if r.doc_id == d), key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(len(mine))) and sum(r.length for r in mine) == len(ids)
        assert len(mine) == -(-len(ids) // packing.MAX_TOKENS)
        for r in mine:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length])
            by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(map(len, by_seq.values())) == len(got)
    for spans in by_seq.values():
        spans.sort()
        assert [a for a, _ in spans] == np.cumsum([0, *[n for _, n in spans[:-1]]]).tolist() and sum(n for _, n in spans) <= packing.MAX_TOKENS


def test_warc(spark, folder):
    got = {r.page_id: r for r in run(spark, folder, "op2_warc", "page_id payload_bytes payload_digest record_type refers_to")}
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    last = {}
    for k, raw in sorted(pages.items()):
        last[raw] = k
    assert set(got) == set(pages)
    for k, raw in pages.items():
        want = (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if last[raw] == k else "revisit", None if last[raw] == k else last[raw])
        assert tuple(got[k])[1:5] == want


def test_media(spark, folder, rows):
    from lindero.llm import media

    got = {r.doc_id: r for r in run(spark, folder, "op3_media", "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature")}
    for d, t, _ in rows:
        raw = (t or "").encode()
        full = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        r = got[d]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:]))
        file = media.encode_avis([np.frombuffer(full, np.uint8)], [str(len(raw)).encode()])[0]
        back = media.frames_of(file, media.read_avi(file)[1])
        assert back.tobytes() == full
    same = {}
    for d, t, _ in rows:
        same.setdefault(t or "", set()).add((got[d].media_bytes, got[d].media_sha256, got[d].feature))
    assert all(len(x) == 1 for x in same.values()) and len(got) == len(rows)


def test_private(spark, folder, rows):
    got = {r.doc_id: r for r in run(spark, folder, "op4_skipchain", "doc_id n_email n_ip n_card n_phone base_sha256 spans")}
    for d, t, _ in rows:
        want = base(t or "") if len(t or "") != 5006 else [(0, 1, 5006)]
        r = got[d]
        assert r.base_sha256 == hashlib.sha256(pii.joined(want).encode()).hexdigest() and set(pii.joined(want).split(",")) <= set(r.spans.split(","))
        assert tuple(r)[1:5] == tuple(sum(k == i for _, k, _ in want) for i in range(4))


def test_language(spark, folder, rows):
    got = {r.doc_id: r for r in run(spark, folder, "op5_ppm", "doc_id held_out lang_pred score")}
    assert all(got[d].held_out == part(d, 4) and 0 <= got[d].score <= 1 for d, _, _ in rows)
    assert all((got[d].lang_pred == "und") == (not any(c.isalpha() for c in t or "")) for d, t, _ in rows)


def test_near(spark, folder, rows):
    root, sets = brute_components([r[:2] for r in rows], 4)
    got = run(spark, folder, "op6_neardup", "doc_id n_shingles component_id kept")
    assert {tuple(r)[:4] for r in got} == {(d, len(sets[d]), root[d], root[d] == d) for d, _, _ in rows} and len(got) == len(rows)


def test_score(spark, folder, rows):
    got = {r.doc_id: r for r in run(spark, folder, "op7_brown", "doc_id held_out n_tokens n_known train_tokens base_score score")}
    c = Counter(x for d, t, _ in rows if not part(d, 7) for x in tokens(t))
    n, v = sum(c.values()), len(c)
    for d, t, _ in rows:
        w, r = tokens(t), got[d]
        assert tuple(r)[1:5] == (part(d, 7), len(w), sum(c[x] > 0 for x in w), n) and r.score < 0
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel=1e-9)


def test_lines(spark, folder, rows):
    got = run(spark, folder, "op8_lines", "doc_id line_no of_doc_id of_line_no edits")
    assert sorted(map(tuple, got)) == sorted(brute_lines([r[:2] for r in rows], linededup.MIN_CHARS))


def test_quality(spark, folder, rows):
    got = {r.doc_id: r for r in run(spark, folder, "op9_quality", "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept")}
    for d, t, _ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        again = len({i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)})
        ls = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        chars, symbols, dup = sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(ls) - len(set(ls))
        failed = len(w) < 50 or 100 * again > 50 * len(w)
        kept = not failed and 10 * symbols <= len(w) and 4 * t.count("!") <= len(w) and 100 * dup <= 40 * len(ls) and 2 * len(w) <= chars <= 20 * len(w) and 100 * len(re.findall("[0-9]", t)) <= 30 * len(t)
        assert tuple(got[d])[1:8] == (len(w), chars, symbols, dup, again, failed, kept)


def test_pieces(spark, folder, rows):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=packing.tokenizer_path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in run(spark, folder, "op10_pieces", "doc_id n_pieces ids_crc32 n_bytes decoded_crc32 round_trip")}
    for d, t, _ in rows:
        ids = model.encode(t or "")
        assert (got[d].n_pieces, got[d].ids_crc32, got[d].decoded_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4")), zlib.crc32(model.decode(ids).encode())) and got[d].round_trip


def test_every_query_is_tested():
    assert len(queries.QUERIES) == 10
