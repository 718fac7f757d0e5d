"""MPEG audio columns: frames found by resynchronisation, tags and variable-bitrate tables read,
checksums verified, exact durations and frame offsets stored; and a lossless carrier for byte payloads.

``index_media`` reads any binary column of MPEG-1, -2 and -2.5 audio. ``store_payload`` writes bytes as a
stream of its own: MPEG-2 Layer III, 16 kHz, mono, 144 kbit/s, so that a frame of 576 samples has 648
bytes; its granule is silent and 576 payload bytes stand where the standard lets ancillary data stand,
followed by their CRC-32. The stream opens with an ID3v2 tag and an Info table.

Defined results: null media gives a null index; bytes without any frame give zero frames and no duration;
broken frames are skipped and counted; a null text counts as empty, and an empty one still fills a frame; texts of any length are stored whole, a batch in parts of bounded size;
an empty table gives an empty one; ``store_payload`` reads doc_id and the text only, ``index_media`` keeps all columns, of which one called like its result gives way.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from postgrove.llm.common import numbered, read_table, stored

# Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by bitrate index, and Hz by rate index.
KBITS = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = (44100, 48000, 32000)
UNIT, FRAME, BODY = 576, 648, 15
HEADER = bytes((0xFF, 0xF2, 0xD8, 0xC0))


def crc16(data: bytes) -> int:
    """Polynomial 0x8005, all ones at first, as the frame checksum needs."""
    value = 0xFFFF
    for byte in data:
        value ^= byte << 8
        for _ in range(8):
            value = (value << 1 ^ 0x8005 if value & 0x8000 else value << 1) & 0xFFFF
    return value


class Header:
    """One frame header; ``size`` is 0 if the four bytes are none."""

    __slots__ = ("version", "layer", "rate", "kbits", "size", "samples", "channels", "side", "checked", "kind")

    def __init__(self, word: bytes):
        self.size = 0
        if len(word) < 4 or word[0] != 0xFF or word[1] & 0xE0 != 0xE0:
            return
        version, layer = word[1] >> 3 & 3, 4 - (word[1] >> 1 & 3)
        bits, rate = word[2] >> 4, word[2] >> 2 & 3
        if version == 1 or layer == 4 or bits in (0, 15) or rate == 3:
            return
        self.version = {3: 1.0, 2: 2.0, 0: 2.5}[version]
        family = 1 if version == 3 else 2
        self.layer, self.kbits = layer, KBITS[family, layer][bits - 1]
        self.rate = RATES[rate] // {3: 1, 2: 2, 0: 4}[version]
        self.channels = 1 if word[3] >> 6 == 3 else 2
        self.samples = 384 if layer == 1 else 576 if layer == 3 and family == 2 else 1152
        pad = word[2] >> 1 & 1
        self.size = (12000 * self.kbits // self.rate + pad) * 4 if layer == 1 else self.samples // 8 * 1000 * self.kbits // self.rate + pad
        self.side = {(1, 1): 17, (1, 2): 32, (2, 1): 9, (2, 2): 17}[family, self.channels] if layer == 3 else 0
        self.checked = not word[1] & 1
        self.kind = (self.version, layer, self.rate)


class Stream:
    """What the bytes of one stream hold."""

    def __init__(self, data: bytes, headers: dict[bytes, Header], sums: dict[bytes, int]):
        self.tags: dict[str, str] = {}
        self.offsets: list[int] = []
        self.sizes: list[int] = []
        self.table: dict[str, object] | None = None
        self.crc_good = self.crc_bad = self.crc_none = self.skipped = self.resyncs = self.samples = 0
        self.first: Header | None = None
        begin, end = self._tags(data)
        self._frames(data, begin, end, headers, sums)

    def _tags(self, data: bytes) -> tuple[int, int]:
        begin, end = 0, len(data)
        while data[begin : begin + 3] == b"ID3" and len(data) >= begin + 10:
            size = sum((b & 0x7F) << 7 * (3 - k) for k, b in enumerate(data[begin + 6 : begin + 10]))
            at, stop, version = begin + 10, min(end, begin + 10 + size), data[begin + 3]
            while version >= 3 and at + 10 <= stop and data[at : at + 4].isalnum():
                raw = data[at + 4 : at + 8]
                n = sum((b & 0x7F) << 7 * (3 - k) for k, b in enumerate(raw)) if version == 4 else int.from_bytes(raw, "big")
                body = data[at + 10 : min(stop, at + 10 + n)]
                if data[at : at + 1] == b"T" and body:
                    code = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1")
                    said = body[1:].decode(code, "replace").rstrip("\0")
                    name = data[at : at + 4].decode()
                    if name == "TXXX" and "\0" in said:
                        name, _, said = said.partition("\0")
                    self.tags.setdefault(name, said)
                at += 10 + n
            begin = stop + (10 if data[begin + 5] & 0x10 else 0)
        if end - begin >= 128 and data[end - 128 : end - 125] == b"TAG":
            end -= 128
            for name, a, b in (("TIT2", 3, 33), ("TPE1", 33, 63), ("TALB", 63, 93)):
                self.tags.setdefault(name, data[end + a : end + b].split(b"\0")[0].decode("latin-1").strip())
        return begin, end

    def _frames(self, data: bytes, at: int, end: int, headers: dict[bytes, Header], sums: dict[bytes, int]) -> None:
        def header(k: int) -> Header:
            word = data[k : k + 4]
            found = headers.get(word)
            if found is None:
                if len(headers) > 4096:
                    headers.clear()
                found = headers[word] = Header(word)
            return found

        locked = False
        while at + 4 <= end:
            h = header(at)
            fits = h.size and at + h.size <= end and (self.first is None or h.kind == self.first.kind)
            if fits and not locked and at + h.size + 4 <= end:  # a lone header may be chance: the next must follow
                after = header(at + h.size)
                fits = after.size and after.kind == h.kind
            if not fits:
                self.resyncs += locked
                locked = False
                new = data.find(b"\xff", at + 1, end)
                new = end if new < 0 else new
                self.skipped += new - at
                at = new
                continue
            locked = True
            if self.first is None:
                self.first = h
                self._variable(data, at, h)
                if self.table is not None:
                    at += h.size
                    continue
            if not h.checked or h.layer != 3:
                self.crc_none += 1
            else:
                covered = data[at + 2 : at + 4] + data[at + 6 : at + 6 + h.side]
                want = sums.get(covered)
                if want is None:
                    if len(sums) > 4096:
                        sums.clear()
                    want = sums[covered] = crc16(covered)
                good = want == data[at + 4] << 8 | data[at + 5]
                self.crc_good += good
                self.crc_bad += not good
            self.offsets.append(at)
            self.sizes.append(h.size)
            self.samples += h.samples
            at += h.size
        self.skipped += max(0, end - at)

    def _variable(self, data: bytes, at: int, h: Header) -> None:
        for k in (at + 4 + h.side, at + 6 + h.side):
            if data[k : k + 4] in (b"Xing", b"Info"):
                flags, p = int.from_bytes(data[k + 4 : k + 8], "big"), k + 8
                self.table = {"kind": data[k : k + 4].decode()}
                for bit, name in ((1, "frames"), (2, "bytes")):
                    if flags & bit:
                        self.table[name] = int.from_bytes(data[p : p + 4], "big")
                        p += 4
                if flags & 4:
                    self.table["toc"] = list(data[p : p + 100])
                return
        k = at + 36
        if data[k : k + 4] == b"VBRI":
            self.table = {"kind": "VBRI", "bytes": int.from_bytes(data[k + 10 : k + 14], "big"), "frames": int.from_bytes(data[k + 14 : k + 18], "big")}

    def summary(self) -> dict:
        h, table = self.first, self.table or {}
        seconds = Fraction(self.samples, h.rate) if h else None
        return {
            "version": h and h.version, "layer": h and h.layer, "sample_rate": h and h.rate, "channels": h and h.channels,
            "n_frames": len(self.offsets), "n_samples": self.samples, "duration": seconds is not None and f"{seconds.numerator}/{seconds.denominator}" or None,
            "constant": len(set(self.sizes)) <= 1, "table": table.get("kind"), "table_frames": table.get("frames"), "table_bytes": table.get("bytes"),
            "crc_good": self.crc_good, "crc_bad": self.crc_bad, "crc_none": self.crc_none, "resyncs": self.resyncs, "skipped_bytes": self.skipped,
            "tags": list(self.tags.items()), "frame_offsets": self.offsets,
        }


INDEX = (
    "struct<version:double,layer:int,sample_rate:int,channels:int,n_frames:long,n_samples:long,duration:string,constant:boolean,table:string,table_frames:long,table_bytes:long,"
    "crc_good:long,crc_bad:long,crc_none:long,resyncs:long,skipped_bytes:long,tags:map<string,string>,frame_offsets:array<long>>"
)
INDEX_ARROW = pa.struct(
    [("version", pa.float64()), ("layer", pa.int32()), ("sample_rate", pa.int32()), ("channels", pa.int32()), ("n_frames", pa.int64()), ("n_samples", pa.int64()), ("duration", pa.string()), ("constant", pa.bool_()), ("table", pa.string())]
    + [(c, pa.int64()) for c in ("table_frames", "table_bytes", "crc_good", "crc_bad", "crc_none", "resyncs", "skipped_bytes")]
    + [("tags", pa.map_(pa.string(), pa.string())), ("frame_offsets", pa.list_(pa.int64()))]
)


def in_parts(batch: pa.RecordBatch, column: str, most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` bytes of ``column``, so that one slice's results fit in memory whatever the texts' lengths."""
    sizes = [len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())]
    begin = held = 0
    for k, n in enumerate(sizes):
        held += n
        if held >= most:
            yield batch.slice(begin, k + 1 - begin)
            begin, held = k + 1, 0
    if begin < len(sizes):
        yield batch.slice(begin)


def index_media(df: DataFrame, column: str = "media", into: str = "media_index") -> DataFrame:
    """``df`` with ``into``: what ``column`` holds, frame offsets included. A column of the input that is called so gives way."""
    df = df.drop(into)
    at, given = df.columns.index(column), StructType([*df.schema.fields, StructField(into, StructType.fromDDL(f"x {INDEX}")["x"].dataType)])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        headers, sums = {}, {}
        for batch in batches:
            for part in in_parts(batch, f"c{at}"):
                found = [None if x is None else Stream(x, headers, sums).summary() for x in part.column(at).to_pylist()]
                yield pa.record_batch([*part.columns, pa.array(found, INDEX_ARROW)], [f.name for f in given])

    return numbered(df).mapInArrow(read, given)


def payload_of(text: bytes) -> bytes:
    """``text`` and bytes 255 up to a positive multiple of UNIT."""
    return text + b"\xff" * (max(1, -(-len(text) // UNIT)) * UNIT - len(text))


def write_stream(payload: bytes, n_bytes: int) -> bytes:
    units = np.frombuffer(payload, dtype=np.uint8).reshape(-1, UNIT)
    n = len(units)
    frames = np.zeros((n + 1, FRAME), dtype=np.uint8)
    frames[:, :4] = np.frombuffer(HEADER, dtype=np.uint8)
    frames[:, 4:6] = np.frombuffer(struct.pack(">H", _SILENT), dtype=np.uint8)
    frames[1:, BODY : BODY + UNIT] = units
    checks = [zlib.crc32(payload[k : k + UNIT]) for k in range(0, len(payload), UNIT)]
    frames[1:, BODY + UNIT : BODY + UNIT + 4] = np.array(checks, dtype=">u4").view(np.uint8).reshape(-1, 4)
    toc = bytes(k * 256 // 100 for k in range(100))
    table = b"Info" + struct.pack(">III", 7, n, (n + 1) * FRAME) + toc
    frames[0, BODY : BODY + len(table)] = np.frombuffer(table, dtype=np.uint8)
    said = b"\x03payload_bytes\0" + str(n_bytes).encode()
    tag = b"TXXX" + struct.pack(">IH", len(said), 0) + said
    size = len(tag)
    return b"ID3\x03\0\0" + bytes(size >> 7 * k & 0x7F for k in (3, 2, 1, 0)) + tag + frames.tobytes()


_SILENT = crc16(HEADER[2:] + bytes(9))


def read_payload(media: bytes, offsets: list[int]) -> bytes:
    """The payload of a stream from ``write_stream``; each unit is verified by its own CRC-32."""
    out = []
    for at in offsets:
        unit = media[at + BODY : at + BODY + UNIT]
        if zlib.crc32(unit) != int.from_bytes(media[at + BODY + UNIT : at + BODY + UNIT + 4], "big"):
            raise ValueError(f"the frame at {at} is damaged")
        out.append(unit)
    return b"".join(out)


def store_payload(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` (doc_id, text) as (doc_id, n_bytes, media)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_parts(batch, text):
                raw = [(x or "").encode() for x in part.column(1).to_pylist()]
                media = [write_stream(payload_of(x), len(x)) for x in raw]
                yield pa.record_batch([part.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), text).mapInArrow(write, "doc_id long, n_bytes long, media binary")


def op4_media_columns(spark, sf_dir: str) -> DataFrame:
    """Whole ``documents`` as MPEG audio, written to the shared folder, read back and measured."""
    media = stored(store_payload(read_table(spark, sf_dir, "documents").select("doc_id", "text")), "media")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                x, index = row["media"], row["media_index"]
                payload = read_payload(x, index["frame_offsets"])
                offsets = np.array(index["frame_offsets"], dtype="<i8").tobytes()
                feature = (
                    f"MPEG-{index['version']:g} layer {index['layer']}, {index['sample_rate']} Hz, {index['channels']} ch, frames {index['n_frames']}, seconds {index['duration']}, "
                    f"{index['table']} {index['table_frames']}/{index['table_bytes']}, crc {index['crc_good']}+{index['crc_bad']}, skipped {index['skipped_bytes']}, seek {zlib.crc32(offsets):08x}"
                )
                rows.append((row["doc_id"], row["n_bytes"], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(x), hashlib.sha256(x).hexdigest(), feature))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds], names)

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    return index_media(media).mapInArrow(measure, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
