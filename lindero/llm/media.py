"""Media columns: motion JPEG in AVI files, read through their RIFF index, with shots as timed clips.

A frame is a baseline greyscale JPEG. encode_avi stores bytes losslessly: a sample is the constant
value of an 8x8 block, so a block has a DC coefficient only, with a quantiser of 8 that makes it
exact. The Huffman code of a DC difference of s bits has 9 - s bits, so each block takes ten bits
(the tenth ends the block) and a scan of 16 x 12 blocks 240 bytes before stuffing, which numpy
packs and unpacks for many frames at once. Any JPEG decoder reads these frames; decode_jpeg, for
frames of other encoders, decodes baseline scans with any tables (or the customary ones, where a
motion-JPEG frame leaves them out), subsampling and restart markers.

A shot begins where the distance of two frames' histograms exceeds what the frames before it lead
to expect: their mean distance plus a multiple of the deviation, and at least a floor.

Cases: null and empty texts are one frame of spaces. A file that is cut off or whose index is
missing is read by walking its chunks; malformed files raise ValueError, in clips() an error row.
Equal inputs have equal files. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import buffer_of, slices, table

COLUMNS, ROWS, FPS = 16, 12, 25
FRAME = COLUMNS * ROWS
HISTORY, DEVIATIONS, FLOOR = 8, 3.0, 0.25

# ---- JPEG ---------------------------------------------------------------------------------------


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


#: Code lengths 1 to 9 have a symbol each: differences of 8 bits the shortest.
_DC_TABLE = bytes([0x00] + [1] * 9 + [0] * 7 + list(range(8, -1, -1)))
_AC_TABLE = bytes([0x10, 1] + [0] * 15 + [0])
HEAD = b"\xff\xd8" + _segment(0xDB, bytes([0, 8] + [1] * 63)) + _segment(0xC0, struct.pack(">BHHBBBB", 8, 8 * ROWS, 8 * COLUMNS, 1, 1, 0x11, 0)) + _segment(0xC4, _DC_TABLE) + _segment(0xC4, _AC_TABLE) + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
TAIL = b"\xff\xd9"
SCAN = FRAME * 10 // 8


def _codes() -> tuple[np.ndarray, np.ndarray]:
    to, back = np.zeros(511, np.uint64), np.full(1024, -999, np.int16)
    for diff in range(-255, 256):
        s = abs(diff).bit_length()
        code = (((1 << (9 - s)) - 2) << s | (diff if diff > 0 else diff + (1 << s) - 1)) << 1
        to[diff + 255], back[code] = code, diff
    return to, back


_TO, _BACK = _codes()


def encode_scans(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """samples (frames, FRAME) to the stuffed scans in a row and their n + 1 offsets."""
    diff = samples.astype(np.int16) - 128
    diff[:, 1:] -= diff[:, :-1].copy()
    code = _TO[diff + 255].reshape(-1, 4)
    word = code[:, 0] << np.uint64(30) | code[:, 1] << np.uint64(20) | code[:, 2] << np.uint64(10) | code[:, 3]
    raw = word.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].reshape(-1)
    at = np.flatnonzero(raw == 255)
    ends = np.arange(len(samples) + 1) * SCAN
    return np.insert(raw, at + 1, 0), ends + np.searchsorted(at, ends)


def decode_scans(data: np.ndarray, n: int) -> np.ndarray:
    """The samples of n stuffed scans in a row."""
    stuffed = np.zeros(len(data), bool)
    stuffed[1:] = (data[:-1] == 255) & (data[1:] == 0)
    raw = data[~stuffed]
    if len(raw) != n * SCAN:
        raise ValueError("a scan has the wrong length")
    five = raw.reshape(-1, 5).astype(np.uint64)
    word = five[:, 0] << np.uint64(32) | five[:, 1] << np.uint64(24) | five[:, 2] << np.uint64(16) | five[:, 3] << np.uint64(8) | five[:, 4]
    code = np.stack([word >> np.uint64(s) & np.uint64(1023) for s in (30, 20, 10, 0)], 1)
    diff = _BACK[code].reshape(n, FRAME)
    if len(diff) and diff.min() < -255:
        raise ValueError("a scan has an unknown code")
    return (np.cumsum(diff, axis=1, dtype=np.int32) + 128).astype(np.uint8)


def _huffman(counts: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    out, code, k = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[length, code] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _dct_basis() -> np.ndarray:
    k = np.arange(8)
    out = np.cos((2 * k[:, None] + 1) * k[None] * np.pi / 16) / 2
    out[:, 0] /= np.sqrt(2)
    return out


def _zigzag() -> list[int]:
    return sorted(range(64), key=lambda p: (p // 8 + p % 8, p // 8 if (p // 8 + p % 8) % 2 else p % 8))


def decode_jpeg(data: bytes) -> np.ndarray:
    """The pixels of a baseline JPEG as (height, width, components) bytes, components as stored."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    basis, zigzag = _dct_basis(), _zigzag()
    quant: dict[int, list[int]] = {}
    tables: dict[int, dict] = {}
    at, every, frame = 2, 0, None
    while True:
        if at + 4 > len(data) or data[at] != 0xFF:
            raise ValueError("malformed JPEG")
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = list(struct.unpack(">64H", body[1:129]) if wide else body[1:65])
                body = body[129 if wide else 65 :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = _huffman(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDD:
            every = int.from_bytes(body, "big")
        elif marker == 0xC0:
            _, height, width, n = struct.unpack(">BHHB", body[:6])
            frame = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
        elif marker in (0xC1, 0xC2, 0xC3) or 0xC5 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("no baseline JPEG")
        elif marker == 0xDA:
            break
    if frame is None:
        raise ValueError("no frame header")
    scan = {body[1 + 2 * k]: (body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])}
    hmax, vmax = max(c[1] for c in frame), max(c[2] for c in frame)
    if len(frame) == 1:
        frame, hmax, vmax = [(frame[0][0], 1, 1, frame[0][3])], 1, 1
    across, down = -(-width // (8 * hmax)), -(-height // (8 * vmax))
    planes = [np.zeros((down * v * 8, across * h * 8)) for _, h, v, _ in frame]
    state = [at, 0, 0]  # position, bits held, number of them

    def bit() -> int:
        if not state[2]:
            if state[0] >= len(data):
                raise ValueError("scan is cut off")
            byte = data[state[0]]
            state[0] += 2 if byte == 255 else 1
            state[1:] = byte, 8
        state[2] -= 1
        return state[1] >> state[2] & 1

    def bits(n: int) -> int:
        v = 0
        for _ in range(n):
            v = v << 1 | bit()
        return v

    def symbol(t: dict) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | bit()
            if (length, code) in t:
                return t[length, code]
        raise ValueError("unknown code")

    def signed(n: int) -> int:
        v = bits(n)
        return v if not n or v >> (n - 1) else v - (1 << n) + 1

    last = [0] * len(frame)
    for mcu in range(across * down):
        if every and mcu and mcu % every == 0:
            state[2] = 0
            if data[state[0]] != 255 or not 0xD0 <= data[state[0] + 1] <= 0xD7:
                raise ValueError("no restart marker")
            state[0] += 2
            last = [0] * len(frame)
        for k, (ident, h, v, q) in enumerate(frame):
            dc, ac = tables[scan[ident][0]], tables[16 + scan[ident][1]]
            for y in range(v):
                for x in range(h):
                    block = np.zeros(64)
                    last[k] += signed(symbol(dc))
                    block[0] = last[k] * quant[q][0]
                    i = 1
                    while i < 64:
                        rs = symbol(ac)
                        if not rs & 15:
                            if rs != 0xF0:
                                break
                            i += 16
                            continue
                        i += rs >> 4
                        block[zigzag[i]] = signed(rs & 15) * quant[q][i]
                        i += 1
                    r, c = (mcu // across * v + y) * 8, (mcu % across * h + x) * 8
                    planes[k][r : r + 8, c : c + 8] = basis @ block.reshape(8, 8) @ basis.T
    full = [np.kron(p, np.ones((vmax // v, hmax // h)))[:height, :width] for p, (_, h, v, _) in zip(planes, frame)]
    return np.clip(np.rint(np.stack(full, 2) + 128), 0, 255).astype(np.uint8)


# ---- AVI ----------------------------------------------------------------------------------------


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def _list(kind: bytes, *parts: bytes) -> bytes:
    body = kind + b"".join(parts)
    return b"LIST" + struct.pack("<I", len(body)) + body


def write_avi(frames: list[bytes], comment: bytes = b"", width: int = 8 * COLUMNS, height: int = 8 * ROWS, fps: int = FPS) -> bytes:
    """An AVI 1.0 file of JPEG frames with its index."""
    n, largest = len(frames), max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // fps, largest * fps, 0, 0x10, n, 0, 1, largest, width, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIhhhh", 0, 0, 0, 0, 1, fps, 0, n, largest, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    head = _list(b"hdrl", _chunk(b"avih", avih), _list(b"strl", _chunk(b"strh", strh), _chunk(b"strf", strf)))
    info = _list(b"INFO", _chunk(b"ICMT", comment)) if comment else b""
    parts, index, at = [], [], 4
    for f in frames:
        size = len(f)
        odd = size & 1
        parts += (b"00dc" + struct.pack("<I", size), f, b"\0") if odd else (b"00dc" + struct.pack("<I", size), f)
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, size))
        at += 8 + size + odd
    body = b"AVI " + head + info + _list(b"movi", *parts) + _chunk(b"idx1", b"".join(index))
    return b"RIFF" + struct.pack("<I", len(body)) + body


def _super_index(data: bytes, at: int, size: int) -> list[tuple[int, int]]:
    """The frames that an index of indexes at this place leads to (OpenDML)."""
    out = []
    _, _, kind, entries = struct.unpack_from("<HBBI", data, at)
    if kind != 0:
        raise ValueError("an index that is not one of indexes")
    for k in range(min(entries, (size - 24) // 16)):
        (leaf,) = struct.unpack_from("<Q", data, at + 24 + 16 * k)
        if leaf + 32 > len(data):
            raise ValueError("an index lies outside the file")
        longs, _, kind, n, name, base = struct.unpack_from("<HBBI4sQ", data, leaf + 8)
        if longs != 2 or kind != 1 or leaf + 32 + 8 * n > len(data):
            raise ValueError("an index of no frames")
        for offset, length in np.frombuffer(data, "<u4", 2 * n, leaf + 32).reshape(-1, 2).tolist():
            place, length = base + offset, length & 0x7FFFFFFF
            if data[place - 8 : place] != name + struct.pack("<I", length) or place + length > len(data):
                raise ValueError("an index entry does not match its chunk")
            out.append((place, length))
    return out


def _walked(data: bytes, at: int, end: int) -> Iterator[tuple[int, int]]:
    """The whole video chunks of a movi list, of its rec lists too."""
    while at + 8 <= end:
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        if data[at : at + 4] == b"LIST":
            yield from _walked(data, at + 12, min(end, at + 8 + size))
        elif data[at + 2 : at + 4] in (b"dc", b"db") and at + 8 + size <= len(data):
            yield at + 8, size
        at += 8 + size + size % 2


def read_avi(data: bytes) -> tuple[dict, list[tuple[int, int]]]:
    """Header fields (fps, width, height, comment) and each video frame's place and size, of all RIFF parts of the file.

    The places come from the index of indexes where there is one, else from the first part's index,
    whose entries must point to chunks of the same name and size; where there is neither, and in
    further parts, from the chunks of the movi lists.
    """
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("no AVI file")
    head: dict = {"fps": float(FPS), "comment": b""}
    movis, index, many = [], None, None
    parts, at = [], 0
    while at + 12 <= len(data) and data[at : at + 4] == b"RIFF" and (at == 0 or data[at + 8 : at + 12] == b"AVIX"):
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        parts.append((at + 12, min(len(data), at + 8 + size)))
        at += 8 + size + size % 2
    stack, video = parts[::-1], False
    while stack:
        at, end = stack.pop()
        while at + 8 <= end:
            name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
            body = at + 8
            after = body + size + size % 2
            if name == b"LIST":
                if data[body : body + 4] == b"movi":
                    movis.append((body, min(end, body + size)))
                else:
                    stack += [(after, end), (body + 4, min(end, body + size))]
                    break
            elif name == b"avih":
                head["width"], head["height"] = struct.unpack_from("<II", data, body + 32)
            elif name == b"strh":
                video = data[body : body + 4] == b"vids"
                if video:
                    scale, rate = struct.unpack_from("<II", data, body + 20)
                    head["fps"] = rate / scale if scale else head["fps"]
            elif name == b"indx" and video and many is None and size >= 24:
                many = _super_index(data, body, min(size, end - body))
            elif name == b"ICMT":
                head["comment"] = data[body : body + size]
            elif name == b"idx1" and index is None:
                index = np.frombuffer(data[body : body + size // 16 * 16], "<u4").reshape(-1, 4)
            at = after
    if not movis:
        raise ValueError("no movi list")
    if many is not None:
        return head, many
    places = []
    if index is not None:
        start, end = movis.pop(0)
        base = start if not len(index) or index[0, 2] < start else 0
        for name, _, at, size in index.tolist():
            if name & 0xFFFF0000 not in (0x63640000, 0x62640000):  # ..dc, ..db
                continue
            at += base
            if data[at : at + 8] != struct.pack("<II", name, size) or at + 8 + size > end:
                raise ValueError("an index entry does not match its chunk")
            places.append((at + 8, size))
    for start, end in movis:
        places += _walked(data, start + 4, end)
    return head, places


def frames_of(data: bytes, places: list[tuple[int, int]]) -> np.ndarray:
    """Luminance samples (frames, values): of our own frames a value per block, of others per pixel."""
    k = len(HEAD)
    if places and all(data[at : at + k] == HEAD and data[at + size - 2 : at + size] == TAIL for at, size in places):
        return decode_scans(np.frombuffer(b"".join([data[at + k : at + size - 2] for at, size in places]), np.uint8), len(places))
    return np.array([decode_jpeg(data[at : at + size])[:, :, 0].reshape(-1) for at, size in places], np.uint8).reshape(len(places), -1)


def histograms(frames: np.ndarray) -> np.ndarray:
    """Sixteen bins per frame, as shares."""
    n, size = frames.shape
    bins = np.bincount((np.arange(n)[:, None] * 16 + (frames >> 4)).reshape(-1), minlength=16 * n)
    return bins.reshape(n, 16) / max(1, size)


def shots(hist: np.ndarray) -> list[tuple[int, int]]:
    """First and last frame of each shot."""
    n = len(hist)
    if n < 2:
        return [(0, n - 1)] if n else []
    d = np.abs(np.diff(hist, axis=0)).sum(1) / 2
    one, two = np.concatenate([[0], np.cumsum(d)]), np.concatenate([[0], np.cumsum(d * d)])
    k = np.arange(len(d))
    a = np.maximum(0, k - HISTORY)
    m = np.maximum(1, k - a)
    mean = (one[k] - one[a]) / m
    dev = np.sqrt(np.maximum(0, (two[k] - two[a]) / m - mean * mean))
    cuts = np.flatnonzero(d > np.maximum(FLOOR, np.where(k > 0, mean + DEVIATIONS * dev, FLOOR))) + 1
    return list(zip([0, *cuts.tolist()], [*(cuts - 1).tolist(), n - 1]))


def encode_avis(payloads: list[np.ndarray], comments: list[bytes]) -> list[bytes]:
    """A file for each payload, whose length is a multiple of FRAME."""
    counts = [len(p) // FRAME for p in payloads]
    data, offs = encode_scans(np.concatenate(payloads).reshape(-1, FRAME) if payloads else np.zeros((0, FRAME), np.uint8))
    raw, offs, at, out = data.tobytes(), offs.tolist(), 0, []
    for n, comment in zip(counts, comments):
        out.append(write_avi([HEAD + raw[offs[k] : offs[k + 1]] + TAIL for k in range(at, at + n)], comment))
        at += n
    return out


def clips(media: DataFrame, key: str, content: str = "content") -> DataFrame:
    """A row per shot of each AVI file: key, clip, first_frame, last_frame, start_ms, end_ms, error."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k in range(batch.num_rows):
                try:
                    data = batch.column(1)[k].as_py()
                    if data is None:
                        raise ValueError("no file")
                    head, places = read_avi(data)
                    for c, (a, b) in enumerate(shots(histograms(frames_of(data, places)))):
                        rows.append((k, c, a, b, round(a * 1000 / head["fps"]), round((b + 1) * 1000 / head["fps"]), None))
                except (ValueError, KeyError, IndexError, struct.error) as e:
                    rows.append((k, None, None, None, None, None, str(e)))
            if rows:
                k, *rest = zip(*rows)
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(k)), *(pa.array(x, t) for x, t in zip(rest, kinds))], ["key", "clip", "first_frame", "last_frame", "start_ms", "end_ms", "error"])

    kind = media.schema[key].dataType.simpleString()
    return media.select(key, content).mapInArrow(find, f"key {kind}, clip int, first_frame long, last_frame long, start_ms long, end_ms long, error string")


def text_media(docs: DataFrame) -> DataFrame:
    """Each text stored as an AVI file, read back, and described: see op3."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = buffer_of(batch.column(1))
            for i, j in slices(offs):
                sizes = np.diff(offs[i : j + 1])
                padded = np.maximum(1, -(-sizes // FRAME)) * FRAME
                ends = np.cumsum(padded)
                all_ = np.full(int(ends[-1]), 32, np.uint8)
                payloads = [all_[e - p : e] for e, p in zip(ends.tolist(), padded.tolist())]
                for k, p in enumerate(payloads):
                    p[: sizes[k]] = buf[offs[i + k] : offs[i + k + 1]]
                files = encode_avis(payloads, [b"bytes=%d" % s for s in sizes.tolist()])
                rows = []
                for data in files:
                    head, places = read_avi(data)
                    frames = frames_of(data, places)
                    back = frames.tobytes()
                    found = shots(histograms(frames))
                    feature = f"{len(frames)}f@{head['fps']:g}:" + ",".join(f"{a}-{b}" for a, b in found)
                    rows.append((int(head["comment"].removeprefix(b"bytes=")), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature))
                n, size, sha, crc, m, msha, feature = zip(*rows)
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(i, j - i).cast(pa.int64()), "n_bytes": pa.array(n, pa.int64()), "payload_bytes": pa.array(size, pa.int64()), "payload_sha256": pa.array(sha), "tail_crc32": pa.array(crc, pa.int64()), "media_bytes": pa.array(m, pa.int64()), "media_sha256": pa.array(msha), "feature": pa.array(feature)})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def store(docs: DataFrame) -> DataFrame:
    """doc_id and content: each text as an AVI file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = buffer_of(batch.column(1))
            for i, j in slices(offs):
                texts = [buf[offs[k] : offs[k + 1]] for k in range(i, j)]
                fill = [np.concatenate([t, np.full(max(1, -(-len(t) // FRAME)) * FRAME - len(t), 32, np.uint8)]) for t in texts]
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(i, j - i).cast(pa.int64()), "content": pa.array(encode_avis(fill, [b"bytes=%d" % len(t) for t in texts]), pa.binary())})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, content binary")


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media(table(spark, sf_dir, "documents"))
