import random
import zlib
from hashlib import sha256

from skylathe.llm import transport as ts

SIZES = [0, 1, 63, 64, 65, 128, 150, 155, 156, 157, 160, 161, 162, 163, 164, 165, 170, 183, 184, 185, 340, 346, 347, 348, 16383, 16384, 16385, 16384 * 9 + 3, 300_000]


def slow_parse(stream):
    """Packet by packet: payload, random-access offsets, time stamps."""
    data, at, stamps, access, last, pes = b"", [], [], [], None, []
    for i in range(0, len(stream), 188):
        p = stream[i : i + 188]
        assert p[0] == 0x47
        pid = (p[1] & 31) << 8 | p[2]
        if pid != ts.DATA_PID:
            continue
        assert last is None or p[3] & 15 == (last + 1) % 16
        last = p[3] & 15
        body = p[5 + p[4] :] if p[3] & 32 else p[4:]
        if p[1] & 64:
            pes.append([bool(p[3] & 32 and p[5] & 64), b""])
        pes[-1][1] += body
    for flag, b in pes:
        n = int.from_bytes(b[4:6], "big")
        assert len(b) == 6 + n
        access += [len(data)] * flag
        data += b[9 + b[8] :]
    return data, access


def test_round_trip_at_every_size():
    for n in SIZES:
        payload = bytes(i * 7 & 255 for i in range(n))
        stream = ts.mux(payload)
        assert len(stream) % 188 == 0
        got = ts.demux(stream)
        assert got["payload"] == payload == slow_parse(stream)[0]
        assert got["random_access"] == slow_parse(stream)[1]
        assert (got["programs"], got["stream_type"], got["discontinuities"], got["crc_errors"]) == (1, 6, 0, 0)
        assert got["pts"] == [k * ts.TICKS for k in range(got["units"])]


def test_faults_are_seen():
    stream = ts.mux(bytes(5000))
    assert ts.demux(stream[: 188 * 6] + stream[188 * 7 :])["discontinuities"] == 1
    assert ts.demux(stream[:-1])["payload"] is None
    assert ts.demux(b"")["payload"] is None
    assert ts.demux(None) is None
    broken = bytearray(stream)
    broken[10] ^= 1
    assert ts.demux(bytes(broken))["crc_errors"] == 1


def test_query(spark):
    texts = [None, "", "a", "É" * 40, "x" * 64, "y" * 200_000, "a"]
    docs = spark.createDataFrame([(i, t, "m") for i, t in enumerate(texts)] + [(None, "a", "m")], "doc_id long, text string, media string")
    rows = ts.digests(docs).collect()
    for r in rows:
        b = (texts[r.doc_id] if r.doc_id is not None else "a" or "") or ""
        b = b.encode()
        p = b + bytes(max(64, -(-len(b) // 64) * 64) - len(b))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert r.media_sha256 == sha256(ts.mux(p)).hexdigest() and r.media_bytes == len(ts.mux(p))
    assert len(rows) == 8 and ts.digests(docs.limit(0)).count() == 0
    seen = ts.with_media(docs.drop("media")).select(ts.parsed("media").alias("x")).select("x.*").collect()
    assert len(seen) == 8 and all(r.programs == 1 and r.random_access[0] == 0 and r.pts[0] == 0 for r in seen)


def test_damaged_streams_give_rows():
    rng = random.Random(5)
    whole = [ts.mux(rng.randbytes(64 * rng.choice([1, 3, 40, 200]))) for _ in range(20)]
    for i in range(10_000):
        stream = bytearray(rng.choice(whole))
        for _ in range(rng.randint(1, 4)):
            stream[rng.randrange(len(stream))] = rng.randrange(256)
        if i % 4 == 0:  # packets lost, moved or sent again
            at = 188 * rng.randrange(len(stream) // 188)
            stream = stream[:at] + stream[at + 188 * rng.randint(0, 2) :] + stream[at : at + 188 * rng.randint(0, 1)]
        out = ts.demux(bytes(stream))
        assert set(out) == set(ts.FEATURES.fieldNames())
    assert ts.demux(b"")["payload"] is None and ts.demux(None) is None


def test_repeated_packets_count_once():
    data = random.Random(6).randbytes(64 * 500)
    stream = ts.mux(data)
    packets = [stream[i : i + 188] for i in range(0, len(stream), 188)]
    twice = b"".join(p + p * (i % 3 == 0) for i, p in enumerate(packets))
    out, plain = ts.demux(twice), ts.demux(stream)
    assert out["payload"] == data and out["discontinuities"] == 0
    assert {k: v for k, v in out.items() if k not in ("packets", "programs")} == {k: v for k, v in plain.items() if k not in ("packets", "programs")}
    lost = ts.demux(b"".join(packets[:6] + packets[7:]))
    assert lost["discontinuities"] == 1


def test_sections_over_many_packets():
    body = b"".join(n.to_bytes(2, "big") + (0xE000 | 0x100 + n).to_bytes(2, "big") for n in range(1, 120))
    section = b"\0" + (0xB000 | len(body) + 9).to_bytes(2, "big") + b"\0\1\xc1\0\0" + body
    section += ts.crc32_mpeg(section).to_bytes(4, "big")
    data, stream, k = b"\0" + section, b"", 0
    while data:
        part, data = data[:184], data[184:]
        stream += bytes([0x47, 0x40 * (k == 0), 0, 0x10 | k]) + part + b"\xff" * (184 - len(part))
        k += 1
    assert k == 3 and ts.demux(stream)["programs"] == 119
