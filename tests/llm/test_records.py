"""WARC archives and media columns."""

import base64
import hashlib
import zlib

import numpy as np
import pytest

from lindero.llm import media as m
from lindero.llm import warc as w


def test_warc_round_trip(spark):
    pages = [(1, "http://a/ b\n", "<p>é</p>"), (2, None, None), (3, "u", ""), (4, "u", "<p>é</p>"), (5, "u", "x" * 300_000), (None, "u", "null id"), (7, "u", "same"), (7, "u", "same")]
    pages += [(100 + k, f"http://h/{k}", f"<html><body>page {k} of many</body></html>") for k in range(40)]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, payload string")
    stored = w.archives_of(df, 50_000)
    back = w.read_archives(stored).collect()
    assert len(back) == len(pages) and all(r.error is None for r in back)
    by = {}
    for r in back:
        by.setdefault(r.record_id, []).append(r)
    for page_id, _, html in pages:
        raw = (html or "").encode()
        r = by[f"urn:page:{'-' if page_id is None else page_id}"][0]
        last = max((p[0] for p in pages if (p[2] or "") == (html or "") and p[0] is not None), default=None)
        assert r.payload_bytes == len(raw) and r.payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        if page_id is None or page_id == last:
            assert r.record_type == "response" and bytes(r.payload) == raw and r.refers_to is None
        else:
            assert r.record_type == "revisit" and r.refers_to == f"urn:page:{last}" and r.payload is None
    assert w.read_archives(w.archives_of(df.limit(0))).count() == 0


def test_dictionary_and_damage(spark):
    records = [w.record(k, f"http://h/{k}", f"<html>page {k} of a site with a long common frame</html>".encode()) for k in range(60)]
    data = w.archive(records)
    assert data[:4] == w.DICT_MAGIC and len(data) < sum(map(len, records)) / 3
    assert [f["record_id"] for _, f in w.records_of(data)] == [f"urn:page:{k}" for k in range(60)]
    plain = w.archive(records[:3])
    assert plain[:4] == w.FRAME_MAGIC and len(list(w.records_of(plain))) == 3
    assert list(w.records_of(data[:-5]))[-1][1] == {"error": "frame is cut off"}
    assert list(w.records_of(None)) == [(0, {"error": "no archive"})] and list(w.records_of(b"")) == []
    bad = [records[0], records[1].replace(b"page 1 of", b"page 9 of"), records[2].replace(b"Content-Length: ", b"Content-Length: 9", 1), b"nonsense", records[3]]
    assert [("error" in f) for _, f in w.records_of(w.archive(bad))] == [False, True, True, True, False]
    df = spark.createDataFrame([("a", data), ("b", None)], "path string, content binary")
    assert w.read_archives(df).where("error is not null").count() == 1


def test_frames_are_jpeg():
    rng = np.random.default_rng(1)
    s = rng.integers(0, 256, (3, m.FRAME)).astype(np.uint8)
    file = m.encode_avis([s.reshape(-1)], [b"c"])[0]
    head, places = m.read_avi(file)
    assert head["comment"] == b"c" and len(places) == 3 and (m.frames_of(file, places) == s).all()
    for k, (at, size) in enumerate(places):
        pixels = m.decode_jpeg(file[at : at + size])[:, :, 0].reshape(m.ROWS, 8, m.COLUMNS, 8)
        assert (pixels == s[k].reshape(m.ROWS, 1, m.COLUMNS, 1)).all()
    without = file[: file.index(b"idx1")]
    assert m.read_avi(without)[1] == places
    at = file.index(b"idx1") + 16
    with pytest.raises(ValueError):
        m.read_avi(file[:at] + b"\xff\xff" + file[at + 2 :])


def test_files_of_several_parts():
    """Frames of further RIFF parts, by an index of indexes and without one."""
    import struct

    s = np.random.default_rng(2).integers(0, 256, (5, m.FRAME)).astype(np.uint8)
    first, second = (m.encode_avis([x.reshape(-1)], [b""])[0] for x in (s[:3], s[3:]))
    head, inside = m.read_avi(second)
    chunks = b"".join(b"00dc" + struct.pack("<I", n) + second[at : at + n] + b"\0" * (n % 2) for at, n in inside)
    movi = b"LIST" + struct.pack("<I", 4 + len(chunks)) + b"movi" + chunks
    file = first + b"RIFF" + struct.pack("<I", 4 + len(movi)) + b"AVIX" + movi
    _, places = m.read_avi(file)
    assert len(places) == 5 and (m.frames_of(file, places) == s).all()
    # The same file with an index of indexes in its stream header.
    strh = first.index(b"strh")
    gap = 8 + 24 + 32  # of the super-index, with two entries
    leaves, at = [], len(file) + gap
    moved = [(p + gap if p > strh else p, n) for p, n in places]
    for part in (moved[:3], moved[3:]):
        body = struct.pack("<HBBI4sQI", 2, 0, 1, len(part), b"00dc", 0, 0) + b"".join(struct.pack("<II", p, n) for p, n in part)
        leaves.append((at, b"ix00" + struct.pack("<I", len(body)) + body))
        at += len(leaves[-1][1])
    top = struct.pack("<HBBI4s3I", 4, 0, 0, 2, b"00dc", 0, 0, 0) + b"".join(struct.pack("<QII", p, len(x), 1) for p, x in leaves)
    strl = first.rindex(b"LIST", 0, strh)
    hdrl = first.rindex(b"LIST", 0, strl)
    data = bytearray(file[:strh] + b"indx" + struct.pack("<I", len(top)) + top + file[strh:] + b"".join(x for _, x in leaves))
    for at in (4, strl + 4, hdrl + 4):
        data[at : at + 4] = struct.pack("<I", struct.unpack_from("<I", data, at)[0] + gap)
    # The index stands behind the stream header, as it does in files.
    strh_size = 8 + struct.unpack_from("<I", first, strh + 4)[0]
    data[strh : strh + gap + strh_size] = data[strh + gap : strh + gap + strh_size] + data[strh : strh + gap]
    assert m.read_avi(bytes(data))[1] == moved and (m.frames_of(bytes(data), moved) == s).all()
    data[leaves[0][0] + 36] ^= 1
    with pytest.raises(ValueError):
        m.read_avi(bytes(data))


def test_texts_come_back(odd, odd_rows, none):
    got = {r.doc_id: r for r in m.text_media(odd).collect()}
    for doc_id, text, *_ in odd_rows:
        raw = (text or "").encode()
        full = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        r = got[doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:]))
    assert got[0].media_sha256 == got[1].media_sha256 and got[0].feature == got[1].feature
    assert m.text_media(none).count() == 0


def test_shots(spark):
    frames = np.zeros((30, m.FRAME), np.uint8)
    frames[10:20] = 200
    frames[20:] = 90
    file = m.encode_avis([frames.reshape(-1)], [b""])[0]
    rows = m.clips(spark.createDataFrame([(1, file), (2, b"junk"), (3, None)], "id long, content binary"), "id").collect()
    assert [(r.first_frame, r.last_frame, r.start_ms, r.end_ms) for r in rows if r.key == 1] == [(0, 9, 0, 400), (10, 19, 400, 800), (20, 29, 800, 1200)]
    assert all(r.error for r in rows if r.key != 1)
