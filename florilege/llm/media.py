"""MPEG transport streams: texts stored as elementary packets in 188-byte transport packets, and read back.

`mux` writes one elementary stream of private data, cut into access units. Each unit is a packetised elementary packet
with a presentation timestamp and starts with a random-access indicator and a clock reference; a program association
table and a program map table stand before each, so that a reader can start at any of them.

`demux` parses the program tables, wherever they are and each time they come, and checks their checksums; checks every
continuity counter, of the tables too; reassembles the elementary packets, and returns the payload, timestamps and
random-access points. As the standard has it, a packet may be sent twice (the second is left out), a packet without
payload keeps its counter, the discontinuity indicator lets a counter jump, null packets mean nothing, and packets marked as
damaged are errors. Packets before the first unit start of the stream are left out, if `partial` is set.

Null and empty texts become 64 zero bytes, like any text padded to a positive multiple of 64. Equal texts have
equal streams. Texts may be of any length: a row needs a few times its own bytes, and nothing is kept between rows.
Null ids and repeated rows are rows like any other. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from florilege.llm.common import map_rows

PACKET, PMT_PID, STREAM_PID = 188, 0x1000, 0x0100
TICKS = 3600  # of the 90 kHz clock between access units
#: Bytes of an access unit: 89 packets with its header and clock reference, so that only a stream's last unit needs stuffing.
UNIT = 162 + 184 * 88


def crc32_mpeg(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = ((crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def _section(table: int, ident: int, body: bytes) -> bytes:
    """A program table's section in a packet's 184 bytes, after its pointer field."""
    head = bytes([table]) + (0xB000 | (len(body) + 9)).to_bytes(2, "big") + ident.to_bytes(2, "big") + b"\xc1\x00\x00"
    whole = head + body
    return (b"\x00" + whole + crc32_mpeg(whole).to_bytes(4, "big")).ljust(184, b"\xff")


def _header(pid: int, start: bool, control: int, count: int) -> bytes:
    return bytes([0x47, start << 6 | pid >> 8, pid & 255, control << 4 | count & 15])


#: The two tables, as sections in packets without their counters.
PAT = _section(0, 1, b"\x00\x01" + (0xE000 | PMT_PID).to_bytes(2, "big"))
PMT = _section(2, 1, (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00" + b"\x06" + (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00")


def _stamp(pts: int) -> bytes:
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 255, 1 | pts >> 14 & 0xFE, pts >> 7 & 255, 1 | pts << 1 & 0xFE])


def mux(payload: bytes) -> bytes:
    """The transport stream of a payload."""
    out, count = [], 0
    for unit in range(max(1, -(-len(payload) // UNIT))):
        body = payload[unit * UNIT : (unit + 1) * UNIT]
        pts = unit * TICKS & 0x1FFFFFFFF
        data = b"\x00\x00\x01\xbd" + (len(body) + 8).to_bytes(2, "big") + b"\x80\x80\x05" + _stamp(pts) + body
        stuff = max(0, 176 - len(data))
        clock = bytes([7 + stuff, 0x50]) + (pts << 15 | 0x7E00).to_bytes(6, "big") + b"\xff" * stuff
        out += [_header(0, True, 1, unit), PAT, _header(PMT_PID, True, 1, unit), PMT]
        out += [_header(STREAM_PID, True, 3, count), clock, data[:176]]
        count += 1
        full, rest = divmod(max(0, len(data) - 176), 184)
        if full:
            block = np.empty((full, PACKET), np.uint8)
            block[:, :4] = np.frombuffer(_header(STREAM_PID, False, 1, 0), np.uint8)
            block[:, 3] |= (count + np.arange(full) & 15).astype(np.uint8)
            block[:, 4:] = np.frombuffer(data, np.uint8, full * 184, 176).reshape(full, 184)
            out.append(block.tobytes())
            count += full
        if rest:
            gap = 183 - rest  # what the adaptation field holds after its length byte
            out += [_header(STREAM_PID, False, 3, count), bytes([gap]) + (b"\x00" + b"\xff" * (gap - 1) if gap else b""), data[-rest:]]
            count += 1
    return b"".join(out)


@dataclass
class Stream:
    payload: bytes
    stream_type: int
    packets: int
    stamps: list[int]  # presentation timestamps, one for each elementary packet
    random_access: list[int]  # numbers of the transport packets where reading can start


def _counted(rows: np.ndarray, name: str) -> np.ndarray:
    """Whether each packet of one PID is kept: not where it repeats the one before. ValueError where a counter is wrong.

    A packet with payload counts one more than the one before, one without payload keeps the count; a discontinuity
    indicator lets the count begin anew."""
    keep = np.ones(len(rows), bool)
    control, count = rows[:, 3] >> 4 & 3, rows[:, 3].astype(np.int32) & 15
    adapted = (control & 2 > 0) & (rows[:, 4] > 0)
    jump = adapted & (rows[:, 5] & 0x80 > 0)
    step = (count[1:] - count[:-1]) & 15
    carries = control[1:] & 1 > 0
    # A duplicate has the count of the one before and its bytes, but for a clock reference.
    same = np.zeros(len(rows), bool)
    again = np.flatnonzero(carries & (step == 0) & (control[:-1] & 1 > 0)) + 1
    for k in again.tolist():
        skip = 12 if adapted[k] and rows[k, 5] & 0x10 else 4
        same[k] = bytes(rows[k, :4]) == bytes(rows[k - 1, :4]) and bytes(rows[k, skip:]) == bytes(rows[k - 1, skip:])
        if same[k] and same[k - 1]:
            raise ValueError(f"a continuity counter of {name} is wrong")  # sent twice at most
    right = jump[1:] | same[1:] | np.where(carries, step == 1, step == 0)
    if not right.all():
        raise ValueError(f"a continuity counter of {name} is wrong")
    keep[same] = False
    return keep


def _payload_begin(rows: np.ndarray) -> np.ndarray:
    """Where each packet's payload begins; PACKET where it has none."""
    control = rows[:, 3] >> 4 & 3
    begin = np.where(control & 2 > 0, 5 + rows[:, 4].astype(np.int32), 4)
    if (begin > PACKET).any() or (control == 0).any():
        raise ValueError("an adaptation field is damaged")
    return np.where(control & 1 > 0, begin, PACKET)


def _table(rows: np.ndarray, pid: int, table: int, name: str) -> bytes:
    """The body of a program table; of several that are the last one. Sections may span packets."""
    own = rows[_pids(rows) == pid]
    own = own[_counted(own, name)]
    found, held = None, b""
    for row, begin in zip(own, _payload_begin(own).tolist()):
        data = row.tobytes()[begin:]
        if not data:
            continue
        if row[1] & 0x40:
            held = data[1 + data[0] :]
        elif held:
            held += data
        if len(held) < 3 or len(held) < (size := 3 + (int.from_bytes(held[1:3], "big") & 0x0FFF)):
            continue
        if held[0] == table:
            if size < 12 or crc32_mpeg(held[:size]):
                raise ValueError("a program table's checksum is wrong")
            if held[5] & 1:  # it applies now
                found = held[8 : size - 4]
        held = b""
    if found is None:
        raise ValueError("a program table is missing")
    return found


def _pids(rows: np.ndarray) -> np.ndarray:
    return (rows[:, 1].astype(np.int32) & 0x1F) << 8 | rows[:, 2]


def _program(rows: np.ndarray) -> tuple[int, int]:
    """PID and type of the first program's first stream."""
    body = _table(rows, 0, 0, "the program association table")
    programs = [body[k : k + 4] for k in range(0, len(body) - 3, 4) if body[k : k + 2] != b"\x00\x00"]  # 0 is the network's
    if not programs:
        raise ValueError("a program table is missing")
    body = _table(rows, int.from_bytes(programs[0][2:4], "big") & 0x1FFF, 2, "the program map table")
    body = body[4 + (int.from_bytes(body[2:4], "big") & 0x0FFF) :]
    if len(body) < 5:
        raise ValueError("a program table is missing")
    return int.from_bytes(body[1:3], "big") & 0x1FFF, body[0]


def demux(media: bytes, partial: bool = False) -> Stream:
    """Parse a transport stream; ValueError where a sync byte, table, counter or elementary packet is wrong."""
    if len(media) % PACKET:
        raise ValueError("the stream ends within a packet")
    rows = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if (rows[:, 0] != 0x47).any():
        raise ValueError("a sync byte is missing")
    pids = _pids(rows)
    if (rows[pids != 0x1FFF, 1] & 0x80).any():
        raise ValueError("a packet is marked as damaged")
    pid, kind = _program(rows)
    at = np.flatnonzero(pids == pid)
    at = at[_counted(rows[at], "the stream")]
    own = rows[at]
    begin = _payload_begin(own)
    data = own[np.arange(PACKET) >= begin[:, None]].tobytes()
    access = at[(own[:, 3] & 0x20 > 0) & (own[:, 4] > 0) & (own[:, 5] & 0x40 > 0)]
    edges = np.concatenate([[0], np.cumsum(PACKET - begin)])
    body, stamps = [], []
    starts = edges[:-1][(own[:, 1] & 0x40 > 0) & (begin < PACKET)]
    if (int(starts[0]) if len(starts) else len(data)) and not partial:
        raise ValueError("an elementary packet is damaged: the stream begins within one")
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(data)]):
        size = int.from_bytes(data[a + 4 : a + 6], "big")
        if data[a : a + 3] != b"\x00\x00\x01" or a + 6 + size != b or not data[a + 7] & 0x80:
            raise ValueError("an elementary packet is damaged")
        p = data[a + 9 : a + 14]
        stamps.append((p[0] & 0x0E) << 29 | p[1] << 22 | (p[2] & 0xFE) << 14 | p[3] << 7 | p[4] >> 1)
        body.append(data[a + 9 + data[a + 8] : b])
    return Stream(b"".join(body), kind, len(rows), stamps, access.tolist())


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "replace")
    return len(raw), raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\x00")


def feature(stream: Stream) -> str:
    ends = f"{stream.stamps[0]}-{stream.stamps[-1]}" if stream.stamps else ""
    return f"type={stream.stream_type};packets={stream.packets};units={len(stream.stamps)};pts={ends};access={len(stream.random_access)};first={next(iter(stream.random_access), '')}"


def store(df: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: the stream of each row's padded text."""

    def run(columns: list[list]) -> list[list]:
        got = [padded(t) for t in columns[1]]
        return [columns[0], [n for n, _ in got], [mux(p) for _, p in got]]

    return map_rows(df.select("doc_id", "text"), run, "doc_id long, n_bytes long, media binary")


def read_back(stored: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload, stamps and random-access points, feature, and media of stored streams."""

    def run(columns: list[list]) -> list[list]:
        got = [demux(m) for m in columns[2]]
        return [columns[0], columns[1], [g.payload for g in got], [g.stamps for g in got], [g.random_access for g in got], [feature(g) for g in got], columns[2]]

    return map_rows(stored.select("doc_id", "n_bytes", "media"), run, "doc_id long, n_bytes long, payload binary, stamps array<long>, random_access array<long>, feature string, media binary")


def digests(df: DataFrame) -> DataFrame:
    """Digests of what is stored for each text and of what is read back from there, with timestamps, random-access points and the stream itself."""
    back = read_back(store(df))
    tail = F.substring("payload", -64, 64)
    return back.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(tail).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature", "stamps", "random_access", "media",
    )
