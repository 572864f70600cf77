"""Packing and the piece tokenizer."""

import functools
import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lindero.llm import packing as p
from lindero.llm import sptok


@functools.cache
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(p.tokenizer_path())


def whole_ids(text):
    return np.array([*library().encode(text or "", add_special_tokens=False).ids, 0], "<u4")


SPACES = "\u0085\u00a0\u1680\u2003\u2028\u202f\u3000\u200b\x1c"


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"ab éß日😀'!.,\n\t 1  <|>", *SPACES, "\n", " ", "<|endoftext|>", "don't", "1234"]), max_size=30).map("".join), min_size=1, max_size=5))
def test_ids_are_the_tokenizers(texts):
    got = dict(p.documents_ids(pa.record_batch({"text": pa.array(texts)}), None))
    for k, t in enumerate(texts):
        assert got[k].tolist() == whole_ids(t).tolist()


@pytest.mark.parametrize("text", ["1\n\xa0", "1\n\xa0 x", "a \xa0 b\n\u3000c", "x\n\u2003\n", "a <|endoftext|>\nb", "<|endoftext|><|endoftext|>", "a\n<|endoftext|> b"])
def test_ids_of_hard_texts(text):
    (_, got), *_ = p.documents_ids(pa.record_batch({"text": pa.array([text])}), None)
    assert got.tolist() == whole_ids(text).tolist()


def test_known_words_take_little_memory():
    import tracemalloc

    enc = p.Encoder(p.tokenizer_path())
    n = 60_000
    buf = np.frombuffer(" ".join(f"w{k}" for k in range(n)).encode(), np.uint8)
    tracemalloc.start()
    try:
        ids, bounds = enc.encode(buf, np.array([0, len(buf)]))
        again, _ = enc.encode(buf, np.array([0, len(buf)]))
        assert (ids == again).all() and bounds[-1] == len(ids)
        del ids, again
        assert tracemalloc.get_traced_memory()[0] < 80 * n
    finally:
        tracemalloc.stop()


def test_bins_are_best_fit():
    rng = random.Random(2)
    bins, free = p.Bins(100, 8), []  # free: of the open bins
    for _ in range(3000):
        n = rng.randint(1, 100)
        fits = [f for f in free if f >= n]
        _, offset = bins.add(n)
        if fits:
            assert 100 - offset == min(fits)
            free.remove(min(fits))
        else:
            assert offset == 0
            if len(free) >= 8:
                free.remove(min(free))
        if offset + n < 100:
            free.append(100 - offset - n)
        assert len(free) == bins.open <= 8


def test_packing(spark, odd, odd_rows, none):
    rows = p.pack_documents(odd, max_tokens=64, open_bins=4).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by_seq.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 64
    for doc_id, text, *_ in odd_rows:
        if doc_id in (None, 3):
            continue
        ids = whole_ids(text)
        pieces = sorted(by_doc[doc_id], key=lambda r: r.piece)
        assert [x.piece for x in pieces] == list(range(-(-len(ids) // 64)))
        assert all(x.length == 64 for x in pieces[1:])
        for x in pieces:
            assert zlib.crc32(ids[x.start : x.start + x.length]) == x.ids_crc32
    assert len(by_doc[3]) == 2 and p.pack_documents(none).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("abcthe éß日😀'!.,\n\t  1▁")), max_size=30), min_size=1, max_size=5))
def test_pieces_are_the_librarys(texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=p.tokenizer_path("piece_bpe_32k.model"))
    at = 0
    for ids, offs, _, _ in sptok.encoded_rows(pa.array(texts), None):
        back, bounds = sptok.decode_rows(ids, offs, None)
        for k in range(len(offs) - 1):
            want = model.encode(texts[at])
            assert ids[offs[k] : offs[k + 1]].tolist() == want
            assert back[bounds[k] : bounds[k + 1]].tobytes().decode() == model.decode(want)
            at += 1


def test_pieces_round_trip(odd, odd_rows, none):
    got = {r.doc_id: r for r in sptok.digests(odd).collect()}
    assert all(r.round_trip for r in got.values())
    assert got[0].n_pieces == got[1].n_pieces == 0
    back = {r.doc_id: r.text for r in sptok.decode_documents(sptok.encode_documents(odd)).collect()}
    for doc_id, text, *_ in odd_rows:
        assert back[doc_id] == (text or "")
    assert sptok.digests(none).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("▁▁▁▁ethaoi日")), max_size=80))
def test_merging_by_heap(text):
    pieces = sptok.marked_encoder(None).pieces
    assert pieces._merged_long(text) == pieces._merged_short(text)


def test_long_runs_of_spaces():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=p.tokenizer_path("piece_bpe_32k.model"))
    began = time.monotonic()
    for text in (" " * 100_000 + "x", "a" + " " * 50_001 + "b" + " " * 333):
        ((ids, *_),) = sptok.encoded_rows(pa.array([text]), None)
        assert ids.tolist() == model.encode(text)
    assert time.monotonic() - began < 30


def test_best_paths():
    """A unigram model: each word's path has the best sum of scores, found by trying all, whatever stood before it."""
    import itertools

    rng = random.Random(5)
    for _ in range(20):
        vocab = {c: -rng.uniform(1, 9) for c in "▁ab"} | {"".join(rng.choice("▁abc") for _ in range(rng.randint(2, 4))): -rng.uniform(1, 12) for _ in range(12)}
        pieces = object.__new__(sptok.Pieces)
        pieces.pieces, pieces.score = list(vocab), list(vocab.values())
        pieces.vocab = {x: i for i, x in enumerate(vocab)}
        pieces.prepare(unigram=True)
        words = sorted({"▁" + "".join(rng.choice("abc") for _ in range(rng.randint(0, 7))) for _ in range(30)})
        cost = lambda part: vocab.get(part, pieces.least if len(part) == 1 else -float("inf"))
        for word, ids in zip(words, pieces.best_paths(words)):
            cuts = (c for k in range(len(word)) for c in itertools.combinations(range(1, len(word)), k))
            best = max(sum(cost(word[a:b]) for a, b in itertools.pairwise([0, *c, len(word)])) for c in cuts)
            assert "".join(pieces.pieces[i] if i >= 0 else chr(-1 - i) for i in ids) == word
            assert sum(pieces.score[i] if i >= 0 else pieces.least for i in ids) == pytest.approx(best)


def test_model_type(tmp_path):
    assert sptok.model_type(p.tokenizer_path("piece_bpe_32k.model")) == 2
    (tmp_path / "m").write_bytes(b"\x0a\x02xx" + b"\x12\x04\x18\x01\x20\x05")
    assert sptok.model_type(str(tmp_path / "m")) == 1


def test_pieces_need_no_order(odd):
    enc = sptok.marked_encoder(None)
    words = [" the", "the", " thesis", " th", "  x", " 日本", "é"]
    one = enc._ids(words)
    assert enc._ids(words[::-1])[::-1] == one


@pytest.mark.parametrize("ids", [[None, 5], [], None, [999999]])
def test_decoding_odd_ids(spark, ids):
    df = spark.createDataFrame([(1, ids)], "doc_id long, ids array<int>")
    assert isinstance(sptok.decode_documents(df).first().text, str)
