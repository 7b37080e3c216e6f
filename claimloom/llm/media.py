"""Media columns as MPEG transport streams.

``encode`` stores bytes as a stream of 188-byte packets: a program association
table, a program map table, and packetised elementary packets of one private
data stream, each with a presentation time; the first packet of an elementary
packet carries a clock reference and marks a random-access point.  ``decode``
parses the program tables, checks continuity counters, reassembles the
elementary packets, and reports their timestamps and random-access points.

Defined results: null text counts as empty; the payload is padded with zero
bytes to a positive multiple of 64; equal payloads give equal streams; rows
with a null id and repeated rows are kept; an empty table gives an empty
result; other columns are ignored.  Damaged streams decode to what is intact,
with ``errors`` counting what does not hold.  One row at a time is held.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PACKET = 188
ROOM = 184
SYNC = 0x47
PROGRAM_MAP_PID, DATA_PID, PROGRAM = 0x100, 0x101, 1
PRIVATE_DATA = 0x06
#: Bytes of payload in one elementary packet, and the 90 kHz ticks between two of them.
UNIT, TICKS = 32768, 3600
UNIT_BYTES = 64


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


CRC_TABLE = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ CRC_TABLE[c >> 24 ^ b]
    return c


def _section(table: int, number: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table, 0xB000 | len(body) + 9, number, 0xC1, 0, 0) + body
    return head + struct.pack(">I", crc32_mpeg(head))


def _table_packet(pid: int, section: bytes) -> bytes:
    return (struct.pack(">BHB", SYNC, 0x4000 | pid, 0x10) + b"\0" + section).ljust(PACKET, b"\xff")


TABLES = _table_packet(0, _section(0, 1, struct.pack(">HH", PROGRAM, 0xE000 | PROGRAM_MAP_PID))) + _table_packet(PROGRAM_MAP_PID, _section(2, PROGRAM, struct.pack(">HHBHH", 0xE000 | DATA_PID, 0xF000, PRIVATE_DATA, 0xE000 | DATA_PID, 0xF000)))


def _stamp(pts: int) -> bytes:
    return struct.pack(">BHH", 0x21 | pts >> 29 & 0x0E, pts >> 14 & 0xFFFE | 1, pts << 1 & 0xFFFE | 1)


def _clock(ticks: int) -> bytes:
    return struct.pack(">IH", ticks >> 1 & 0xFFFFFFFF, (ticks & 1) << 15 | 0x7E00)


def encode(payload: bytes) -> bytes:
    """The stream of ``payload``: tables, then its units in order."""
    out, counter = [TABLES], 0
    for k, at in enumerate(range(0, len(payload), UNIT)):
        body = payload[at : at + UNIT]
        pts = k * TICKS
        # start code, private stream 1, length, marker bits and time only
        pes = struct.pack(">IHBBB", 0x000001BD, len(body) + 8, 0x84, 0x80, 5) + _stamp(pts) + body
        lead = b"\x50" + _clock(pts)  # random access and clock reference
        room = ROOM - 1 - len(lead)
        first, rest = pes[:room], pes[room:]
        stuffing = room - len(first)
        out.append(struct.pack(">BHBB", SYNC, 0x4000 | DATA_PID, 0x30 | counter, len(lead) + stuffing) + lead + b"\xff" * stuffing + first)
        counter = counter + 1 & 15
        full = len(rest) // ROOM
        if full:
            packets = np.empty((full, PACKET), np.uint8)
            packets[:, 0], packets[:, 1], packets[:, 2] = SYNC, DATA_PID >> 8, DATA_PID & 0xFF
            packets[:, 3] = 0x10 | (counter + np.arange(full) & 15)
            packets[:, 4:] = np.frombuffer(rest, np.uint8, full * ROOM).reshape(full, ROOM)
            out.append(packets.tobytes())
            counter = counter + full & 15
        if tail := rest[full * ROOM :]:
            spare = ROOM - len(tail)
            field = b"\0" if spare == 1 else struct.pack(">BB", spare - 1, 0) + b"\xff" * (spare - 2)
            out.append(struct.pack(">BHB", SYNC, DATA_PID, 0x30 | counter) + field + tail)
            counter = counter + 1 & 15
    return b"".join(out)


def _programs(payload: bytes, table: int) -> bytes | None:
    """The body of the section that a table's packet carries, if it lies within the packet and its check sum holds."""
    at = 1 + payload[0]
    if at + 3 > len(payload):
        return None
    size = struct.unpack_from(">H", payload, at + 1)[0] & 0xFFF
    section = payload[at : at + 3 + size]
    if size < 9 or len(section) < 3 + size:
        return None
    return section[8:-4] if section[0] == table and crc32_mpeg(section) == 0 else None


def _stamped(pes: bytes, head: int, flags: int) -> int | None:
    """The presentation time of an elementary packet, if its header has room for one."""
    if not flags & 0x80 or head < 5 or len(pes) < 14:
        return None
    x, y, z = struct.unpack_from(">BHH", pes, 9)
    return (x & 0x0E) << 29 | (y & 0xFFFE) << 14 | z >> 1


def decode(media: bytes) -> dict:
    """Payload and features of a stream: programs, streams, packets, errors, (pts, packet) of each unit and random-access points.

    Errors are bytes beyond the last packet, packets without a sync byte (which are left out), tables
    that do not hold, steps of a continuity counter, and elementary packets without a start code, a
    whole header, or the time that they announce.
    """
    usable = len(media) // PACKET
    packets = np.frombuffer(media, np.uint8, usable * PACKET).reshape(usable, PACKET)
    pids = (packets[:, 1].astype(np.int32) & 0x1F) << 8 | packets[:, 2]
    lost = packets[:, 0] != SYNC
    pids[lost] = -1
    errors = int(lost.sum()) + (len(media) % PACKET > 0)
    programs: dict[int, int] = {}
    streams: dict[int, int] = {}
    for i in np.flatnonzero(pids == 0):
        body = _programs(packets[i, 4:].tobytes(), 0)
        errors += body is None
        body = body or b""
        programs.update({n: p & 0x1FFF for n, p in struct.iter_unpack(">HH", body[: len(body) // 4 * 4])})
    for pid in sorted(set(programs.values())):
        for i in np.flatnonzero(pids == pid):
            body = _programs(packets[i, 4:].tobytes(), 2)
            if body is None or len(body) < 4:
                errors += 1
                continue
            at = 4 + (struct.unpack_from(">H", body, 2)[0] & 0xFFF)
            while at + 5 <= len(body):
                kind, stream, extra = struct.unpack_from(">BHH", body, at)
                streams[stream & 0x1FFF] = kind
                at += 5 + (extra & 0xFFF)
    units, random_access, times = [], [], []
    for pid in sorted(streams):
        own = np.flatnonzero(pids == pid)
        rows = packets[own]
        control = rows[:, 3].astype(np.int32)
        carries = control >> 4 & 1  # packets of an adaptation field only do not count on
        errors += int(((control[1:] & 15) != (control[:-1] + carries[1:] & 15)).sum())
        start = np.where(control & 0x20, np.minimum(5 + rows[:, 4].astype(np.int32), PACKET), 4)
        start = np.where(carries, start, PACKET)
        begins = np.flatnonzero((rows[:, 1] & 0x40 > 0) & (carries > 0))
        marked = (control & 0x20 > 0) & (rows[:, 4] > 0) & (rows[:, 5] & 0x40 > 0)
        random_access += own[marked].tolist()
        for a, b in zip(begins, np.append(begins[1:], len(own))[: len(begins)], strict=True):
            inside = start[a:b]
            if (inside[1:-1] == 4).all():  # whole packets between the first and the last
                parts = [rows[a, inside[0] :].tobytes(), rows[a + 1 : b - 1, 4:].tobytes()] + ([rows[b - 1, inside[-1] :].tobytes()] if b - a > 1 else [])
            else:
                parts = [rows[i, start[i] :].tobytes() for i in range(a, b)]
            pes = b"".join(parts)
            if len(pes) < 9 or pes[:3] != b"\0\0\1":
                errors += 1
                continue
            length, flags, head = struct.unpack_from(">HxBB", pes, 4)
            pts = _stamped(pes, head, flags)
            if pts is not None:
                times.append((pts, int(own[a])))
            errors += (pts is None and flags & 0x80 > 0) or (len(pes) < 9 + head)
            units.append(pes[9 + head : 6 + length] if length else pes[9 + head :])
    return {"payload": b"".join(units), "programs": programs, "streams": streams, "packets": usable, "errors": errors, "times": times, "random_access": random_access}


def payload_of(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % UNIT_BYTES if raw else UNIT_BYTES), len(raw)


def encode_column(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media binary) per row."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 64):  # no more than so many streams at a time
                part = batch.slice(k, 64)
                made = [payload_of(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for _, n in made], pa.int64()), pa.array([encode(p) for p, _ in made], pa.binary())], ["id", "n_bytes", "media"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {id_type}, n_bytes long, media binary").withColumnRenamed("id", id_col)


FEATURES = "payload binary, programs map<int,int>, streams map<int,int>, packets long, errors long, times array<struct<pts:long,packet:long>>, random_access array<long>"


def feature_text(got: dict) -> str:
    times = [t for t, _ in got["times"]]
    body = got["payload"]
    shares = np.bincount(np.frombuffer(body, np.uint8) >> 5, minlength=8).tolist()
    return json.dumps({"programs": len(got["programs"]), "streams": sorted(got["streams"].values()), "packets": got["packets"], "errors": got["errors"], "units": len(times), "first_pts": times[0] if times else None, "last_pts": times[-1] if times else None, "random_access": got["random_access"], "bytes_by_top_bits": shares}, separators=(",", ":"))


def decode_column(streams: DataFrame, *, media_col: str = "media") -> DataFrame:
    """``streams`` with what its media column holds: payload, tables, errors, times and random-access points."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in streams.schema)

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                got = [decode(m or b"") for m in part.column(media_col).to_pylist()]
                columns = {n: part.column(n) for n in part.schema.names}
                columns |= {"payload": pa.array([g["payload"] for g in got], pa.binary())}
                columns |= {n: pa.array([list(g[n].items()) for g in got], pa.map_(pa.int32(), pa.int32())) for n in ("programs", "streams")}
                columns |= {n: pa.array([g[n] for g in got], pa.int64()) for n in ("packets", "errors")}
                columns |= {"times": pa.array([[{"pts": t, "packet": p} for t, p in g["times"]] for g in got], pa.list_(pa.struct([("pts", pa.int64()), ("packet", pa.int64())])))}
                columns |= {"random_access": pa.array([g["random_access"] for g in got], pa.list_(pa.int64()))}
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return streams.mapInArrow(run, f"{schema}, {FEATURES}")


def digests(streams: DataFrame, *, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """A row per stream: sizes and digests of the payload as read back and of the stream, and its features as text."""
    id_type = streams.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for media in batch.column(2).to_pylist():
                got = decode(media)
                body = got["payload"]
                for column, value in zip(out, (len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-UNIT_BYTES:]), len(media), hashlib.sha256(media).hexdigest(), feature_text(got)), strict=True):
                    column.append(value)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, out, kinds)], ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    rows = streams.select(F.col(id_col).alias("id"), "n_bytes", F.col(media_col).alias("media"))
    return rows.mapInArrow(run, f"id {id_type}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string").withColumnRenamed("id", id_col)
