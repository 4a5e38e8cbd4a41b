"""MPEG audio columns (2): frames, tags, variable-bitrate tables, checksums, exact durations and seek offsets.

`parse` reads any MPEG 1/2/2.5 layer I-III stream: it skips ID3v2 and ID3v1 tags, takes a header as a frame only where the
next frame, the end or a tag follows at the computed place, otherwise looks for the next sync byte and counts
what it skipped. Checksums (CRC-16 over the header's last two bytes and the side information, or in layers I and II the bit allocation and scale factor selection) are verified. Durations are
samples and rate, never floats. `store` keeps bytes losslessly as main data of silent layer III frames
(mono, 48 kHz), 64-byte units, behind an ID3v2 tag with the payload's length and a Xing table; `payload` reads them back.
Fixed values of the public formats are the tables below.

Cases: null text is the empty text, whose payload is 64 zero bytes; equal texts give equal values; each row is
encoded on its own; an empty table gives no rows; extra columns are not read, and `index_streams` passes them through, its own names with an underscore where they clash; a null doc_id stays null.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import free_name, ship

# fixed values: bit rates in kbit/s by index 1..14, sample rates by index, of the MPEG audio standards
RATES_V1 = {1: (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448), 2: (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384), 3: (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)}
RATES_V2 = {1: (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256), 2: (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160), 3: (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)}
SAMPLE_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}

UNIT = 64
_HEAD = 4 + 2 + 17  # header, checksum, side information of a mono frame
_SIDE = bytes(17)


def _crc_table() -> list[int]:
    out = []
    for b in range(256):
        c = b << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
        out.append(c)
    return out


_TABLE = _crc_table()


@functools.lru_cache(4096)
def crc16(data: bytes) -> int:
    c = 0xFFFF
    for b in data:
        c = (c << 8 & 0xFFFF) ^ _TABLE[c >> 8 ^ b]
    return c


@dataclass(frozen=True)
class Header:
    version: int
    layer: int
    protected: bool
    kbps: int
    rate: int
    channels: int
    size: int
    samples: int
    side: int
    bound: int = 32  # subbands of layers I and II whose allocation is coded for each channel


@functools.lru_cache(4096)
def header(four: bytes) -> Header | None:
    """The frame header in four bytes, or None."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version, layer = four[1] >> 3 & 3, 4 - (four[1] >> 1 & 3)
    b, r = four[2] >> 4, four[2] >> 2 & 3
    if version == 1 or layer == 4 or b in (0, 15) or r == 3 or four[3] & 3 == 2:
        return None
    kbps, rate = (RATES_V1 if version == 3 else RATES_V2)[layer][b - 1], SAMPLE_RATES[version][r]
    pad, mono = four[2] >> 1 & 1, four[3] >> 6 == 3
    if layer == 1:
        size, samples = (12000 * kbps // rate + pad) * 4, 384
    else:
        samples = 576 if layer == 3 and version != 3 else 1152
        size = samples // 8 * 1000 * kbps // rate + pad
    side = (17 if mono else 32) if version == 3 else (9 if mono else 17)
    bound = 4 * ((four[3] >> 4 & 3) + 1) if four[3] >> 6 == 1 else 32
    return Header(version, layer, not four[1] & 1, kbps, rate, 1 if mono else 2, size, samples, side, bound)


# fixed values: bits of a subband's allocation in layer II as (number of subbands, bits), by the standards' tables B.2a to B.2d and B.1
ALLOCATION = {"a": ((11, 4), (12, 3), (4, 2)), "b": ((11, 4), (12, 3), (7, 2)), "c": ((2, 4), (6, 3)), "d": ((2, 4), (10, 3)), "lsf": ((4, 4), (7, 3), (19, 2))}


def _allocation(h: Header) -> list[int]:
    """Bits of each subband's allocation in layer II."""
    each = h.kbps // h.channels
    if h.version != 3:
        name = "lsf"
    elif each <= 48:
        name = "d" if h.rate == 32000 else "c"
    else:
        name = "a" if h.rate == 48000 or each <= 80 else "b"
    return [bits for n, bits in ALLOCATION[name] for _ in range(n)]


def protected_bits(frame: bytes, h: Header) -> int:
    """How many bits after the checksum it covers."""
    if h.layer == 3:
        return 8 * h.side
    one = lambda k: h.channels if k < h.bound else 1
    if h.layer == 1:
        return sum(4 * one(k) for k in range(32))
    data, at, used = int.from_bytes(frame[6:70].ljust(64, b"\0"), "big"), 0, 0
    for k, bits in enumerate(_allocation(h)):
        for _ in range(one(k)):
            value = data >> 512 - at - bits & (1 << bits) - 1
            at += bits
            if value:
                used += 2 * (h.channels // one(k))  # two bits of scale factor selection for each channel that has samples
    return at + used


def checksum_ok(frame: bytes, h: Header) -> bool:
    """Whether the CRC-16 of a protected frame agrees."""
    bits = protected_bits(frame, h)
    whole, rest = divmod(bits, 8)
    c = crc16(frame[2:4] + frame[6 : 6 + whole])
    for i in range(rest):
        top = (c >> 15) ^ (frame[6 + whole] >> 7 - i & 1)
        c = c << 1 & 0xFFFF ^ (0x8005 if top else 0)
    return c == int.from_bytes(frame[4:6], "big")


@dataclass
class Stream:
    tags: dict[str, str] = field(default_factory=dict)
    first: Header | None = None
    offsets: list[int] = field(default_factory=list)  # byte offset of each audio frame, for seeking
    sizes: list[int] = field(default_factory=list)
    samples: int = 0
    skipped: int = 0
    crc_checked: int = 0
    crc_bad: int = 0
    vbr: dict | None = None
    kbps: set[int] = field(default_factory=set)

    @property
    def duration(self) -> tuple[int, int]:
        """Samples and samples a second: exact."""
        return self.samples, self.first.rate if self.first else 1

    def seek(self, sample: int) -> int:
        """Byte offset of the frame that holds a sample."""
        return self.offsets[min(sample // self.first.samples, len(self.offsets) - 1)]


def _syncsafe(four: bytes) -> int:
    return four[0] << 21 | four[1] << 14 | four[2] << 7 | four[3]


def _id3v2(data: bytes, tags: dict[str, str]) -> int:
    """Reads text frames of an ID3v2.2, 2.3 or 2.4 tag into tags; returns the tag's length, 0 for none."""
    if data[:3] != b"ID3" or len(data) < 10 or max(data[6:10]) > 127:
        return 0
    size, major, flags = 10 + _syncsafe(data[6:10]), data[3], data[5]
    body = data[10:size]
    if flags & 128 and major < 4:  # unsynchronised as a whole
        body = body.replace(b"\xff\0", b"\xff")
    at = 0
    if flags & 64 and major == 3:
        at = 4 + int.from_bytes(body[:4], "big")
    elif flags & 64 and major == 4:
        at = _syncsafe(body[:4].ljust(4, b"\0"))
    name_n, head = (3, 6) if major == 2 else (4, 10)
    while at + head <= len(body) and body[at : at + name_n].isalnum():
        raw = body[at + name_n : at + name_n + (3 if major == 2 else 4)]
        n = _syncsafe(raw) if major == 4 else int.from_bytes(raw, "big")
        name, part = body[at : at + name_n].decode("ascii"), body[at + head : at + head + n]
        if major == 4 and body[at + 9] & 1:  # a length goes before the data
            part = part[4:]
        if major == 4 and body[at + 9] & 2:
            part = part.replace(b"\xff\0", b"\xff")
        if name[0] == "T" and part:
            codec = ("latin-1", "utf-16", "utf-16-be", "utf-8")[min(part[0], 3)]
            parts = part[1:].decode(codec, "replace").rstrip("\0").split("\0")
            tags[parts[0] if name in ("TXXX", "TXX") and len(parts) > 1 else name] = parts[-1].lstrip("\ufeff")
        at += head + n
    return size + (10 if flags & 16 else 0)


def _id3v1(tag: bytes, tags: dict[str, str]) -> None:
    """The fields of an ID3v1 or 1.1 tag of 128 bytes, under names of their own."""
    for name, a, b in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97), ("comment", 97, 127)):
        x = tag[a:b].split(b"\0")[0].rstrip(b" ").decode("latin-1")
        if x:
            tags.setdefault("ID3v1" if name == "title" else f"ID3v1:{name}", x)
    if tag[125] == 0 and tag[126]:
        tags.setdefault("ID3v1:track", str(tag[126]))


def _vbr(frame: bytes, h: Header) -> dict | None:
    for at in (4 + h.side, 6 + h.side):
        if frame[at : at + 4] in (b"Xing", b"Info"):
            flags, at, out = int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8, {"kind": frame[at : at + 4].decode()}
            for bit, name in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    out[name], at = int.from_bytes(frame[at : at + 4], "big"), at + 4
            if flags & 4:
                out["toc"] = list(frame[at : at + 100])
            return out
    if frame[36:40] == b"VBRI":
        entries, scale, width = (int.from_bytes(frame[k : k + 2], "big") for k in (54, 56, 58))
        toc = [scale * int.from_bytes(frame[62 + k * width : 62 + (k + 1) * width], "big") for k in range(entries) if 62 + (k + 1) * width <= len(frame)]
        return {"kind": "VBRI", "bytes": int.from_bytes(frame[46:50], "big"), "frames": int.from_bytes(frame[50:54], "big"), "frames_an_entry": int.from_bytes(frame[60:62], "big"), "toc": toc}
    return None


def _kind(h: Header) -> tuple:
    """What all frames of a stream have in common."""
    return h.version, h.layer, h.rate, h.protected


def parse(data: bytes) -> Stream:
    """All frames of a stream; damaged stretches are skipped and counted."""
    s = Stream()
    at, end = _id3v2(data, s.tags), len(data)
    if end >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        _id3v1(data[end : end + 128], s.tags)
    synced = False
    while at + 4 <= end:
        h = header(data[at : at + 4])
        ok = h is not None and at + h.size <= end and (s.first is None or _kind(h) == _kind(s.first))
        if ok and at + h.size < end:  # a lone sync word in other data isn't a frame
            n = header(data[at + h.size : at + h.size + 4])
            follows = n is not None and _kind(n) == _kind(h)
            sound = h.protected and checksum_ok(data[at : at + h.size], h)
            ok = follows or synced and (sound or not h.protected)
        if not ok:
            synced = False
            nxt = data.find(b"\xff", at + 1, end)
            nxt = end if nxt < 0 else nxt
            s.skipped += nxt - at
            at = nxt
            continue
        synced = True
        frame = data[at : at + h.size]
        if h.protected and h.size > 6:
            s.crc_checked += 1
            s.crc_bad += not checksum_ok(frame, h)
        if s.first is None:
            s.first = h
            s.vbr = _vbr(frame, h)
            if s.vbr:
                at += h.size
                continue
        s.offsets.append(at)
        s.sizes.append(h.size)
        s.samples += h.samples
        s.kbps.add(h.kbps)
        at += h.size
    s.skipped += max(0, end - at)
    return s


@functools.lru_cache(64)
def _silent(kbps: int) -> bytes:
    """Header, checksum and empty side information of a protected mono layer III frame at 48 kHz."""
    head = bytes((0xFF, 0xFA, RATES_V1[3].index(kbps) + 1 << 4 | 1 << 2, 0xC0))
    return head + crc16(head[2:] + _SIDE).to_bytes(2, "big") + _SIDE


def _frame(kbps: int, body: bytes) -> bytes:
    return (_silent(kbps) + body).ljust(3 * kbps, b"\0")


_ROOM = [(k, (3 * k - _HEAD) // UNIT) for k in RATES_V1[3]]


def store(payload: bytes) -> bytes:
    """A playable stream that holds payload, whose length is a multiple of 64."""
    big, most = _ROOM[-1]
    frames = []
    for i in range(0, len(payload), most * UNIT):
        part = payload[i : i + most * UNIT]
        frames.append(_frame(next(k for k, room in _ROOM if room * UNIT >= len(part)), part))
    audio = b"".join(frames)
    n, sizes = len(frames), [len(f) for f in frames]
    total = len(audio) + 144
    toc = bytearray()
    for p in range(100):  # where the frame at p per cent of the time begins, in 256ths of the stream
        toc.append(min(255, (144 + (p * n // 100) * sizes[0]) * 256 // total))
    xing = _frame(48, b"Xing" + (15).to_bytes(4, "big") + n.to_bytes(4, "big") + total.to_bytes(4, "big") + bytes(toc) + bytes(4))
    text = b"\0payload_bytes\0" + str(len(payload)).encode()
    tag = b"TXXX" + len(text).to_bytes(4, "big") + b"\0\0" + text
    size = len(tag)
    id3 = b"ID3\3\0\0" + bytes((size >> 21 & 127, size >> 14 & 127, size >> 7 & 127, size & 127)) + tag
    return id3 + xing + audio + b"TAG" + b"payload".ljust(125, b"\0")


def payload(data: bytes, s: Stream) -> bytes:
    """The stored bytes of a stream written by `store`."""
    return b"".join(data[o + _HEAD : o + _HEAD + (n - _HEAD) // UNIT * UNIT] for o, n in zip(s.offsets, s.sizes))[: int(s.tags["payload_bytes"])]


def feature(s: Stream) -> str:
    n, rate = s.duration
    vbr = s.vbr or {}
    whole = vbr.get("frames") == len(s.offsets)
    return f"layer={s.first.layer};rate={rate};channels={s.first.channels};frames={len(s.offsets)};duration={n}/{rate};kbps={min(s.kbps)}-{max(s.kbps)};table={vbr.get('kind', '')}:{int(whole)};crc={s.crc_checked - s.crc_bad}/{s.crc_checked};skipped={s.skipped};last={s.offsets[-1]}"


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b"\0")


def encode_texts(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) with the stored stream: (doc_id, n_bytes, media)."""
    ship(docs.sparkSession)

    def run(batches):
        for b in batches:
            got = [padded(t) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "n_bytes": [n for n, _ in got], "media": [store(p) for _, p in got]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, n_bytes long, media binary")


FRAMES = "array<struct<byte_offset:long,sample:long>>"
INDEX = f"samples long, sample_rate long, frames long, seek {FRAMES}, tags map<string,string>, vbr_kind string, vbr_frames long, crc_checked long, crc_bad long, skipped long"


def index_streams(media: DataFrame, column: str = "media") -> DataFrame:
    """Adds to each row what the stream holds: exact duration, seek offsets, tags, table, checksum results; nulls for a null or frameless one."""
    from pyspark.sql import types as T

    ship(media.sparkSession)
    kept = [c for c in media.columns]
    fields = [T.StructField(free_name(media, f.name), f.dataType) for f in media.sparkSession.createDataFrame([], INDEX).schema.fields]

    def run(batches):
        for b in batches:
            out = []
            for x in b[column]:
                s = parse(bytes(x)) if x is not None else Stream()
                step = s.first.samples if s.first else 0
                v = s.vbr or {}
                out.append((s.samples, s.first.rate if s.first else None, len(s.offsets), [{"byte_offset": o, "sample": i * step} for i, o in enumerate(s.offsets)], dict(s.tags), v.get("kind"), v.get("frames"), s.crc_checked, s.crc_bad, s.skipped))
            f = pd.DataFrame(out, columns=[f.name for f in fields], index=b.index)
            for k in (1, 6):  # whole numbers with nulls
                f[f.columns[k]] = f[f.columns[k]].astype("Int64")
            yield pd.concat([b, f], axis=1)

    return media.select(*kept).mapInPandas(run, T.StructType([*media.schema.fields, *fields]))


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digests(media: DataFrame) -> DataFrame:
    """From (doc_id, n_bytes, media): sums of what is read back."""
    ship(media.sparkSession)

    def run(batches):
        for b in batches:
            out = []
            for d, n, m in zip(b["doc_id"].astype("Int64"), b["n_bytes"], b["media"]):
                m = bytes(m)
                s = parse(m)
                p = payload(m, s)
                out.append((d, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(m), hashlib.sha256(m).hexdigest(), feature(s)))
            f = pd.DataFrame(out, columns=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])
            f["doc_id"] = f["doc_id"].astype("Int64")
            yield f

    return media.mapInPandas(run, DIGEST)
