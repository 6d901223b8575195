"""Media columns: ISO base media files, written, walked and indexed without decoding a payload.

``mux`` stores bytes losslessly as fixed-size samples of an uncompressed 8-bit
audio track; ``index`` walks the nested boxes of any ISO media file, decodes the
sample tables (stsd, stts, stss, stsc, stsz/stz2, stco/co64) and gives codec,
duration and the byte ranges of keyframes; ``samples`` reads the payload back by
those tables. Boxes of 64-bit or open-ended size are understood.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from itertools import accumulate

from pyspark.sql import DataFrame

from tessera.llm.common import map_texts

UNIT = 64
#: Boxes that hold boxes (fixed values of the format).
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"}


#: Levels of nested boxes of which the path is kept.
MAX_DEPTH = 64


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


def pad(data: bytes, unit: int = UNIT) -> bytes:
    """``data`` with bytes 0 up to a positive multiple of ``unit``."""
    return data + bytes(-len(data) % unit if data else unit)


def mux(payload: bytes, unit: int = UNIT, rate: int = 8000, per_chunk: int = 64, key_every: int = 16) -> bytes:
    """An ISO media file with ``payload`` as samples of ``unit`` bytes, a keyframe each ``key_every`` samples."""
    if not payload or len(payload) % unit:
        raise ValueError(f"payload must be a positive multiple of {unit} bytes")
    n = len(payload) // unit
    chunks = -(-n // per_chunk)
    last = n - (chunks - 1) * per_chunk
    runs = [(1, per_chunk, 1)] if last == per_chunk else ([(1, per_chunk, 1)] if chunks > 1 else []) + [(chunks, last, 1)]
    keys = range(1, n + 1, key_every)
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isommp41")
    unity = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, rate << 16))
    duration = n * unit

    def moov(base: int) -> bytes:
        offsets = [base + i * per_chunk * unit for i in range(chunks)]
        wide = base + len(payload) >= 1 << 32
        stbl = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, n, unit)),
            _full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
            _full(b"stsc", struct.pack(">I", len(runs)), *[struct.pack(">III", *r) for r in runs]),
            _full(b"stsz", struct.pack(">II", unit, n)),
            _full(b"co64" if wide else b"stco", struct.pack(f">I{chunks}{'Q' if wide else 'I'}", chunks, *offsets)),
        )
        times = struct.pack(">QQIQ", 0, 0, rate, duration)
        minf = _box(b"minf", _full(b"smhd", bytes(4)), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), stbl)
        mdia = _box(b"mdia", _full(b"mdhd", times, struct.pack(">HH", 0x55C4, 0), version=1), _full(b"hdlr", bytes(4), b"soun", bytes(12), b"\0"), minf)
        tkhd = _full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, duration), bytes(8), struct.pack(">hhhh", 0, 0, 0x100, 0), unity, bytes(8), version=1, flags=7)
        mvhd = _full(b"mvhd", times, struct.pack(">IHHII", 0x10000, 0x100, 0, 0, 0), unity, bytes(24), struct.pack(">I", 2), version=1)
        return _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))

    header = 8 if len(payload) + 8 < 1 << 32 else 16
    base = len(ftyp) + len(moov(0)) + header
    return ftyp + moov(base) + _box(b"mdat", payload)


def boxes(data: bytes):
    """(path, body start, body end) of each box, depth first. Damaged sizes end the walk of their level, at any depth."""
    levels: list[tuple[int, int, tuple]] = [(0, len(data), ())]
    while levels:
        start, end, path = levels.pop()
        if start + 8 > end:
            continue
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if start + 16 > end:
                continue
            (size,) = struct.unpack_from(">Q", data, start + 8)
            head = 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            continue
        levels.append((start + size, end, path))
        # Below MAX_DEPTH no table that is read can stand: deeper boxes are told by their kind alone.
        here = (*path, kind) if len(path) < MAX_DEPTH else (*path[:-1], kind)
        yield here, start + head, start + size
        if kind in CONTAINERS:
            levels.append((start + head, start + size, here))


def _numbers(data: bytes, at: int, end: int, fmt: str, width: int = 1) -> tuple:
    (count,) = struct.unpack_from(">I", data, at + 4)
    each = struct.calcsize(">" + fmt) * width
    count = min(count, max(0, (end - at - 8) // each))
    return struct.unpack_from(f">{count * width}{fmt}", data, at + 8)


def index(data: bytes) -> list[dict]:
    """A record per track: codec, handler, timescale, duration, sample count, sizes, offsets, keyframes and their byte ranges.

    Bytes that are no ISO media file give an empty list; a track without a
    sample table of a kind takes the format's default (no stss: every sample is
    a keyframe).
    """
    tracks: list[dict] = []
    for path, a, b in boxes(data):
        kind = path[-1]
        if kind == b"trak":
            tracks.append({"codec": "", "handler": "", "timescale": 0, "duration": 0, "sizes": [], "stsc": (), "chunks": (), "keys": None, "deltas": ()})
        if not tracks or b"trak" not in path:
            continue
        t = tracks[-1]
        try:
            if kind == b"mdhd":
                t["timescale"], t["duration"] = struct.unpack_from(">IQ", data, a + 20) if data[a] == 1 else struct.unpack_from(">II", data, a + 12)
            elif kind == b"hdlr":
                t["handler"] = data[a + 8 : a + 12].decode("latin-1")
            elif kind == b"stsd" and b - a >= 16:
                t["codec"] = data[a + 12 : a + 16].decode("latin-1").strip()
            elif kind == b"stts":
                t["deltas"] = _numbers(data, a, b, "I", 2)
            elif kind == b"stss":
                t["keys"] = _numbers(data, a, b, "I")
            elif kind == b"stsc":
                t["stsc"] = _numbers(data, a, b, "I", 3)
            elif kind == b"stsz":
                fixed, n = struct.unpack_from(">II", data, a + 4)
                t["sizes"] = [fixed] * min(n, len(data) // fixed) if fixed else list(struct.unpack_from(f">{min(n, (b - a - 12) // 4)}I", data, a + 12))
            elif kind == b"stz2":
                bits, n = data[a + 7], struct.unpack_from(">I", data, a + 8)[0]
                raw = data[a + 12 : b]
                t["sizes"] = [x for y in raw for x in (y >> 4, y & 15)][:n] if bits == 4 else list(raw[:n]) if bits == 8 else list(struct.unpack_from(f">{min(n, len(raw) // 2)}H", raw))
            elif kind in (b"stco", b"co64"):
                t["chunks"] = _numbers(data, a, b, "I" if kind == b"stco" else "Q")
        except (struct.error, IndexError):
            t["damaged"] = True
    for t in tracks:
        _place(t)
    return tracks


def _place(t: dict) -> None:
    """Sample offsets from chunks, and the byte ranges of keyframes: from the keyframe's first byte to its end."""
    runs = [t["stsc"][i : i + 3] for i in range(0, len(t["stsc"]), 3)]
    offsets, i = [], 0
    sizes = t["sizes"]
    for r, (first, per, _) in enumerate(runs):
        stop = runs[r + 1][0] - 1 if r + 1 < len(runs) else len(t["chunks"])
        for c in range(max(0, first - 1), min(stop, len(t["chunks"]))):
            own = sizes[i : i + per]
            offsets += accumulate(own[:-1], initial=t["chunks"][c]) if own else ()
            i += len(own)
    t["offsets"] = offsets
    keys = range(1, len(offsets) + 1) if t["keys"] is None else t["keys"]
    t["keyframes"] = [(offsets[k - 1], sizes[k - 1]) for k in keys if 0 < k <= len(offsets)]
    t["n_samples"] = len(offsets)
    t["media_duration"] = sum(n * d for n, d in zip(t["deltas"][::2], t["deltas"][1::2])) or t["duration"]


def samples(data: bytes, track: dict) -> bytes:
    """The track's stored bytes, in sample order, read by its tables; adjoining samples are read at once."""
    out, start, end = [], None, None
    for o, s in zip(track["offsets"], track["sizes"]):
        if o != end:
            if start is not None:
                out.append(data[start:end])
            start = o
        end = o + s
    if start is not None:
        out.append(data[start:end])
    return b"".join(out)


def feature(tracks: list[dict]) -> str:
    """Codec, duration, sample count and the keyframes' byte ranges, as text."""
    return ";".join(
        f"{t['handler']}/{t['codec']} {t['media_duration']}/{t['timescale']} n={t['n_samples']} key=" + ",".join(f"{o}+{s}" for o, s in t["keyframes"]) for t in tracks
    )


def media_columns(docs: DataFrame, unit: int = UNIT, keep_media: bool = False) -> DataFrame:
    """Each row's text as a media file, stored, read back and indexed.

    Per row: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature, codec, duration (seconds), keyframes
    (array of offset and size); the file itself as ``media`` if ``keep_media``.
    Null and empty texts store ``unit`` bytes 0; repeated rows give repeated
    rows; an empty table gives none.
    """

    def make():
        def one(text: str) -> tuple:
            raw = text.encode("utf-8", "surrogatepass")
            stored = mux(pad(raw, unit), unit)
            tracks = index(stored)
            back = samples(stored, tracks[0])
            t = tracks[0]
            return (
                len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(stored), hashlib.sha256(stored).hexdigest(),
                feature(tracks), t["codec"], t["media_duration"] / (t["timescale"] or 1), [{"offset": o, "size": s} for o, s in t["keyframes"]], stored,
            )

        names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "codec", "duration", "keyframes", "media"]
        return lambda texts: dict(zip(names, map(list, zip(*map(one, texts)))))

    schema = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, duration double, keyframes array<struct<offset: long, size: long>>"
    return map_texts(docs, ["doc_id"], schema + (", media binary" if keep_media else ""), make)
