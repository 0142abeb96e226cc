"""Media columns as MPEG transport streams: a muxer and a demuxer over binary columns.

The stream has 188-byte packets: a program association table (PID 0), a program map table and one
elementary stream of private data in packetized elementary packets (PES), each with a presentation
time stamp. The first transport packet of each PES packet carries an adaptation field with a clock
reference, and the random-access flag where a new group of PES packets begins. Packets of a PID
count from 0 to 15 and round; stuffing goes into adaptation fields. The layout is that of
ISO/IEC 13818-1.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PACKET, SYNC, PAT_PID, PMT_PID, DATA_PID = 188, 0x47, 0, 0x1000, 0x100
#: Bytes of an elementary stream in one PES packet, PES packets from one random-access point to the
#: next, and 90 kHz ticks between their time stamps.
UNIT, GROUP, TICKS = 16384, 8, 3600
PRIVATE = 0x06
#: Payload is padded with bytes 0 to a positive multiple of this.
ALIGN = 64

FEATURES = T.StructType(
    [
        T.StructField("programs", T.IntegerType()),
        T.StructField("stream_type", T.IntegerType()),
        T.StructField("packets", T.LongType()),
        T.StructField("units", T.LongType()),
        T.StructField("discontinuities", T.LongType()),
        T.StructField("crc_errors", T.IntegerType()),
        T.StructField("pts", T.ArrayType(T.LongType())),
        T.StructField("random_access", T.ArrayType(T.LongType())),
        T.StructField("payload", T.BinaryType()),
    ]
)


def padded(data: bytes) -> bytes:
    return data + bytes(max(ALIGN, -(-len(data) // ALIGN) * ALIGN) - len(data))


def _crc_table() -> np.ndarray:
    rows = np.arange(256, dtype=np.uint32) << 24
    for _ in range(8):
        rows = np.where(rows & 0x80000000, (rows << 1) ^ np.uint32(0x04C11DB7), rows << 1).astype(np.uint32)
    return rows


_CRC = _crc_table().tolist()


def crc32_mpeg(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc = (crc << 8 & 0xFFFFFFFF) ^ _CRC[crc >> 24 ^ byte]
    return crc


def _table(pid: int, table_id: int, number: int, body: bytes) -> bytes:
    section = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\0\0" + body
    section += crc32_mpeg(section).to_bytes(4, "big")
    return bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + section + b"\xff" * (PACKET - 5 - len(section))


_TABLES = _table(PAT_PID, 0, 1, b"\0\1" + (0xE000 | PMT_PID).to_bytes(2, "big")) + _table(
    PMT_PID, 2, 1, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\0" + bytes([PRIVATE]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\0"
)


def _stamp(pts: int) -> bytes:
    return bytes([0x21 | pts >> 29 & 14, pts >> 22 & 255, pts >> 14 & 254 | 1, pts >> 7 & 255, pts << 1 & 254 | 1])


def mux(payload: bytes) -> bytes:
    """A transport stream that holds the payload as one elementary stream."""
    parts, counter = [_TABLES], 0
    for k, at in enumerate(range(0, max(1, len(payload)), UNIT)):
        unit, pts = payload[at : at + UNIT], k * TICKS & (1 << 33) - 1
        pes = b"\0\0\1\xbd" + (len(unit) + 8).to_bytes(2, "big") + b"\x80\x80\5" + _stamp(pts) + unit
        clock = (pts << 15 | 0x7E00).to_bytes(6, "big")
        adapt = bytes([0x50 if k % GROUP == 0 else 0x10]) + clock
        room = PACKET - 5 - len(adapt)
        if len(pes) < room:
            adapt += b"\xff" * (room - len(pes))
        head, rest = pes[: PACKET - 5 - len(adapt)], pes[PACKET - 5 - len(adapt) :]
        full, tail = divmod(len(rest), PACKET - 4)
        first = bytes([SYNC, 0x40 | DATA_PID >> 8, DATA_PID & 255, 0x30 | counter, len(adapt)]) + adapt + head
        body = np.empty((full, PACKET), np.uint8)
        body[:, 0], body[:, 1], body[:, 2] = SYNC, DATA_PID >> 8, DATA_PID & 255
        body[:, 3] = 0x10 | (counter + 1 + np.arange(full)) & 15
        body[:, 4:] = np.frombuffer(rest, np.uint8, full * (PACKET - 4)).reshape(full, PACKET - 4)
        parts += [first, body.tobytes()]
        counter = counter + 1 + full & 15
        if tail:
            fill = PACKET - 5 - tail
            adapt = bytes([fill]) + (b"\0" + b"\xff" * (fill - 1) if fill else b"")
            parts.append(bytes([SYNC, DATA_PID >> 8, DATA_PID & 255, 0x30 | counter]) + adapt + rest[full * (PACKET - 4) :])
            counter = counter + 1 & 15
    return b"".join(parts)


def _sections(packets: np.ndarray, bodies: np.ndarray, pid: np.ndarray, starts: np.ndarray, want: int) -> tuple[list[bytes], int]:
    """The whole sections of a PID, over as many packets as each takes; those with a wrong CRC are counted."""
    found, wrong, rest = [], 0, None  # rest: what has come of a section that isn't whole
    for i in np.flatnonzero((pid == want) & (packets[:, 3] & 16 > 0)):
        data = packets[i, bodies[i] :].tobytes()
        if starts[i]:
            point = data[0] if data else 0
            chunks = [] if rest is None else [rest + data[1 : 1 + point]]
            chunks.append(data[1 + point :])
        else:
            chunks = [] if rest is None else [rest + data]
        rest = None
        for chunk in chunks:
            rest = None
            while chunk and chunk[0] != 0xFF:  # stuffing fills what is left
                size = 3 + (int.from_bytes(chunk[1:3], "big") & 0xFFF)
                if len(chunk) < max(3, size):
                    rest = chunk
                    break
                if crc32_mpeg(chunk[:size]) == 0:
                    found.append(chunk[:size])
                else:
                    wrong += 1
                chunk = chunk[size:]
    return found, wrong


def _without_repeats(packets: np.ndarray, mine: np.ndarray) -> np.ndarray:
    """mine (packets of one PID that hold payload) without those that repeat the packet before, which
    a stream may send again with another clock."""
    again = np.flatnonzero((packets[mine[1:], 3] & 15) == (packets[mine[:-1], 3] & 15)) + 1
    plain = [0, 1, 2, 3, 4, 5, *range(12, PACKET)]
    return np.delete(mine, [i for i in again if (packets[mine[i], plain] == packets[mine[i - 1], plain]).all()])


def demux(stream: bytes | None) -> dict | None:
    """The first elementary stream of the first program, with what its packets tell.

    Null for a null stream. One that isn't whole 188-byte packets in step, or without readable
    program tables, gives no payload. Packets that come twice count once. PES packets that don't
    begin like one, or break off within their header, are left out; without any the payload is
    empty. pts has the time stamp of each PES packet that states one, random_access the payload
    offsets of those flagged so.
    """
    if stream is None:
        return None
    out = {"programs": 0, "stream_type": None, "packets": len(stream) // PACKET, "units": 0, "discontinuities": 0, "crc_errors": 0, "pts": [], "random_access": [], "payload": None}
    packets = np.frombuffer(stream, np.uint8)
    if not len(packets) or len(packets) % PACKET or (packets[::PACKET] != SYNC).any():
        return out
    packets = packets.reshape(-1, PACKET)
    pid = (packets[:, 1].astype(np.int32) & 31) << 8 | packets[:, 2]
    starts, has, adapt = (packets[:, 1] & 64) > 0, (packets[:, 3] & 16) > 0, (packets[:, 3] & 32) > 0
    bodies = np.where(adapt, 5 + packets[:, 4].astype(np.int32), 4)
    pats, wrong = _sections(packets, bodies, pid, starts, PAT_PID)
    programs = [(s[i : i + 2], int.from_bytes(s[i + 2 : i + 4], "big") & 0x1FFF) for s in pats for i in range(8, len(s) - 7, 4)]
    programs = [p for n, p in programs if n != b"\0\0"]
    out |= {"programs": len(programs), "crc_errors": wrong}
    if not programs:
        return out
    maps, wrong = _sections(packets, bodies, pid, starts, programs[0])
    out["crc_errors"] += wrong
    at = 12 + (int.from_bytes(maps[0][10:12], "big") & 0xFFF) if maps else 0
    if not maps or at + 5 > len(maps[0]) - 4:
        return out
    out["stream_type"], own = maps[0][at], int.from_bytes(maps[0][at + 1 : at + 3], "big") & 0x1FFF
    mine = _without_repeats(packets, np.flatnonzero((pid == own) & has))
    counts = packets[mine, 3] & 15
    out["discontinuities"] = int(((counts[1:] - counts[:-1] & 15) != 1).sum())
    begins = np.flatnonzero(starts[mine])
    pts, access, payload, size = [], [], [], 0
    for a, b in zip(begins, np.append(begins[1:], len(mine)), strict=False):  # the last without an end of its own
        rows = mine[a:b]
        plain = ~adapt[rows]
        if plain[1:].all():
            pes = packets[rows[0], bodies[rows[0]] :].tobytes() + packets[rows[1:], 4:].tobytes()
        elif plain[1:-1].all():
            pes = packets[rows[0], bodies[rows[0]] :].tobytes() + packets[rows[1:-1], 4:].tobytes() + packets[rows[-1], bodies[rows[-1]] :].tobytes()
        else:
            pes = b"".join(packets[i, bodies[i] :].tobytes() for i in rows)
        if pes[:3] != b"\0\0\1" or len(pes) < 9 + (pes[8] if len(pes) > 8 else 0):
            continue
        length, header = int.from_bytes(pes[4:6], "big"), pes[8]
        data = pes[9 + header : 6 + length] if length else pes[9 + header :]
        if pes[7] & 128 and header >= 5:
            t = pes[9:14]
            pts.append((t[0] >> 1 & 7) << 30 | t[1] << 22 | t[2] >> 1 << 15 | t[3] << 7 | t[4] >> 1)
        if adapt[rows[0]] and packets[rows[0], 4] and packets[rows[0], 5] & 64:
            access.append(size)
        payload.append(data)
        size += len(data)
    return out | {"units": len(payload), "pts": pts, "random_access": access, "payload": b"".join(payload)}


@F.pandas_udf(T.BinaryType())
def _muxed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield batch.map(lambda x: mux(padded((x or "").encode("utf-8", "replace"))))


def with_media(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """docs with a binary column of transport streams that hold the texts as UTF-8, padded; a null
    text counts as empty. Streams are made here, so none is damaged; a column named as `media` is
    replaced, other columns stay."""
    return docs.withColumn(media, _muxed(F.col(text)))


@F.pandas_udf(FEATURES)
def parsed(streams: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """What demux() tells of each stream of a binary column: null for null, a row for any bytes, damaged
    ones included."""
    names = FEATURES.fieldNames()
    for batch in streams:
        rows = [demux(None if x is None else bytes(x)) or dict.fromkeys(names) for x in batch]
        yield pd.DataFrame({n: pd.Series([r[n] for r in rows], dtype=object) for n in names})


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs, of the stream that holds its text, read back: doc_id, n_bytes,
    payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    Null and empty texts hold 64 bytes 0. Repeated rows give repeated equal rows; other columns are
    not read; an empty table gives an empty result.
    """
    n_bytes = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    told = with_media(docs.select(F.col(doc_id).alias("doc_id"), n_bytes.alias("n_bytes"), F.col(text).alias("text")))
    return told.select("doc_id", "n_bytes", _digest(F.col("media")).alias("d")).select("doc_id", "n_bytes", "d.*")


_DIGEST = T.StructType(
    [
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_sha256", T.StringType()),
        T.StructField("tail_crc32", T.LongType()),
        T.StructField("media_bytes", T.LongType()),
        T.StructField("media_sha256", T.StringType()),
        T.StructField("feature", T.StringType()),
    ]
)


@F.pandas_udf(_DIGEST)
def _digest(streams: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in streams:
        rows = []
        for media in map(bytes, batch):
            x = demux(media)
            data, pts = x["payload"], x["pts"]
            said = f"programs={x['programs']};type={x['stream_type']};packets={x['packets']};units={x['units']};discontinuities={x['discontinuities']};crc_errors={x['crc_errors']};pts={'-'.join(map(str, pts[:1] + pts[-1:]))};random_access={','.join(map(str, x['random_access']))}"
            rows.append((len(data), sha256(data).hexdigest(), zlib.crc32(data[-ALIGN:]), len(media), sha256(media).hexdigest(), said))
        yield pd.DataFrame(rows, columns=_DIGEST.fieldNames())
