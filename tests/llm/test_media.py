import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from florilege.llm import media


@settings(max_examples=40, deadline=None)
@given(st.one_of(st.binary(max_size=2000), st.sampled_from([media.UNIT - 1, media.UNIT, media.UNIT + 1, 3 * media.UNIT + 7]).map(lambda n: b"x" * n)))
def test_round_trip(payload):
    stream = media.demux(media.mux(payload))
    units = max(1, -(-len(payload) // media.UNIT))
    assert stream.payload == payload and stream.stamps == [k * media.TICKS for k in range(units)] and len(stream.random_access) == units


def packets(media_bytes):
    return [media_bytes[k : k + 188] for k in range(0, len(media_bytes), 188)]


NULL = b"\x47\x1f\xff\x10".ljust(188, b"\xff")


def test_damage_is_found():
    good = media.mux(b"y" * 20_000)
    for front in (b"", NULL * 2, NULL * 7):  # wherever the tables are, and whatever was read before
        n = len(front) // 188
        assert media.demux(front + good).payload == b"y" * 20_000
        for at, match in [(188 * (n + 5), "sync"), (188 * (n + 5) + 3, "continuity"), (188 * n + 20, "checksum"), (188 * (n + 1) + 20, "checksum"), (188 * (n + 2) + 13, "elementary"), (188 * (n + 92) + 15, "checksum")]:
            bad = bytearray(front + good)
            bad[at] ^= 0x05
            with pytest.raises(ValueError, match=match):
                media.demux(bytes(bad))
    parts = packets(good)
    for bad, match in [
        (good[:-1], "within a packet"), (b"".join(parts[:4] + parts[5:]), "continuity"), (b"".join(parts[:5] + [parts[4]] * 2 + parts[5:]), "continuity"), (b"".join(parts[2:90]), "missing"), (b"", "missing"),
        (b"".join([*parts[:4], parts[4][:1] + bytes([parts[4][1] | 0x80]) + parts[4][2:], *parts[5:]]), "damaged"), (b"".join(parts[:2] + parts[3:]), "elementary|continuity"), (b"".join(parts[:95]), "elementary"),
    ]:
        with pytest.raises(ValueError, match=match):
            media.demux(bad)


def test_what_the_standard_allows():
    payload = bytes(range(256)) * 100
    parts = packets(media.mux(payload))
    twice = [p for k, part in enumerate(parts) for p in [part] * (1 + (k % 3 == 0))]  # also tables, and a packet with a clock reference
    assert media.demux(b"".join(twice)).payload == payload
    only = lambda count, flags=0: bytes([0x47, 1, 0, 0x20 | count, 183, flags]).ljust(188, b"\xff")
    with_gaps = [p for k, part in enumerate(parts) for p in [part, *([only(part[3] & 15), NULL] if k in (2, 4, 40) else [])]]
    assert media.demux(b"".join(with_gaps)).payload == payload
    jumped = parts[:50] + [only(9, 0x80)] + [part[:3] + bytes([part[3] & 0xF0 | (part[3] + 9 - parts[49][3]) & 15]) + part[4:] if part[1] & 0x1F == 1 else part for part in parts[50:]]
    assert media.demux(b"".join(jumped)).payload == payload


def test_reading_starts_at_any_random_access_point():
    payload = bytes(range(251)) * 300
    whole = media.mux(payload)
    stream = media.demux(whole)
    assert len(stream.random_access) == 5
    for unit, at in enumerate(stream.random_access):
        back = media.demux(whole[(at - 2) * 188 :])
        assert back.payload == payload[unit * media.UNIT :] and back.stamps == stream.stamps[unit:]
    back = media.demux(whole[50 * 188 :], partial=True)
    assert back.payload == payload[media.UNIT :] and back.stamps == stream.stamps[1:]
    with pytest.raises(ValueError, match="begins within"):
        media.demux(whole[50 * 188 :])


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_digests(request, table):
    df = request.getfixturevalue(table)
    want = []
    for r in df.select("doc_id", "text").collect():
        raw = (r.text or "").encode()
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        want.append((r.doc_id or -1, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    got = media.digests(df).collect()
    assert sorted((r.doc_id or -1, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == sorted(want)
    for r in got:
        stream = media.demux(bytes(r.media))
        assert r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(r.media).hexdigest() and r.media_bytes % 188 == 0
        assert (stream.stamps, stream.random_access, media.feature(stream)) == (r.stamps, r.random_access, r.feature)


def test_stored_streams(odd, nothing):
    rows = media.read_back(media.store(odd)).collect()
    assert {bytes(r.payload) for r in rows if r.doc_id in (5, 6)} == {media.padded("same text here")[1]}
    assert media.digests(nothing).count() == 0
