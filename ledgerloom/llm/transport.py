"""Operator 8: media columns of MPEG transport streams, indexed by elementary packets.

A binary column holds whole streams. For each, the program association table (packets of PID 0) gives the programs and
their map tables, whose sections (checked by CRC-32) give elementary streams and their types; continuity counters are
checked by PID; elementary packets are cut at payload unit starts, joined across transport packets, and stored with
their timestamps (PTS, DTS, in 90 kHz ticks) and whether they are random-access points.

Rules: transport packets of 188 bytes, or 192 or 204 with a prefix or suffix; bytes that don't fit are skipped until
five packets in a row (or all that are left) begin with the sync byte, and each stretch counts as lost sync. A repeat
of a counter with the same content is a duplicate and is dropped once; any other jump that the discontinuity flag
doesn't announce is a break, counted in the elementary packet that it falls into. Packets with the error flag are
dropped. An elementary packet is complete if its declared length (0: none) is reached and no break fell into it.

Results for edge cases: null and empty streams, and streams without a program, give no row. Rows without an id are left
out; rows that share an id are parsed one by one. A stream may end inside a packet: what is there counts, as incomplete.
Extra columns aren't read. `mux` makes streams from bytes: the test tables have none, so the query makes one from each
document's text and parses that.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import text as T
from ledgerloom.llm.common import keyed, spread

UNIT, KEY_EVERY, TICKS = 8192, 4, 3600
TEXT_PID, MAP_PID, TEXT_TYPE, TEXT_STREAM = 0x100, 0x1000, 0x06, 0xBD
NOTE_PID, NOTE_TYPE, NOTE_STREAM, LOSE = 0x101, 0x0F, 0xC0, (7, 3)
_FIELDS = {
    "doc_id": pa.int64(), "program": pa.int32(), "pid": pa.int32(), "stream_type": pa.int32(), "unit": pa.int32(), "stream_id": pa.int32(),
    "pts": pa.int64(), "dts": pa.int64(), "random_access": pa.bool_(), "size": pa.int32(), "complete": pa.bool_(), "breaks": pa.int32(), "digest": pa.string(),
}
_SCHEMA = "doc_id long, program int, pid int, stream_type int, unit int, stream_id int, pts long, dts long, random_access boolean, size int, complete boolean, breaks int, digest string"


def _table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


_CRC = _table()


@lru_cache(maxsize=4096)
def crc32_mpeg(section: bytes) -> int:
    c = 0xFFFFFFFF
    for b in section:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[c >> 24 ^ b]
    return c


# Making streams


def _section(table: int, number: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


def _packet(pid: int, counter: int, payload: bytes, start: bool, key: bool = False) -> bytes:
    """One packet of 188 bytes; stuffing goes to the adaptation field."""
    room = 184 - len(payload)
    if key or room:
        room = max(room, 2) if key else room
        field = b"" if room == 1 else bytes([0x40 if key else 0]) + b"\xff" * (room - 2)
        field = bytes([room - 1]) + field
    else:
        field = b""
    return bytes([0x47]) + (pid | (0x4000 if start else 0)).to_bytes(2, "big") + bytes([(0x30 if field else 0x10) | counter & 15]) + field + payload


@lru_cache(maxsize=64)
def _tables(*programs: tuple[int, int, tuple[tuple[int, int], ...]]) -> bytes:
    """Packets of the association table and of the map of each program: its number, map PID, and streams (PID, type)."""
    fill = lambda s: (b"\x00" + s).ljust(184, b"\xff")
    out = _packet(0, 0, fill(_section(0, 1, b"".join(number.to_bytes(2, "big") + (0xE000 | pid).to_bytes(2, "big") for number, pid, _ in programs))), True)
    for number, map_pid, streams in programs:
        body = (0xE000 | streams[0][0]).to_bytes(2, "big") + b"\xf0\x00" + b"".join(bytes([kind]) + (0xE000 | pid).to_bytes(2, "big") + b"\xf0\x00" for pid, kind in streams)
        out += _packet(map_pid, 0, fill(_section(2, number, body)), True)
    return out


def _stamp(mark: int, ticks: int) -> bytes:
    return bytes([mark << 4 | ticks >> 29 & 14 | 1]) + (ticks >> 14 & 0xFFFE | 1).to_bytes(2, "big") + (ticks << 1 & 0xFFFE | 1).to_bytes(2, "big")


def elementary(stream_id: int, payload: bytes, pts: int, dts: int) -> bytes:
    size = len(payload) + 13
    return b"\x00\x00\x01" + bytes([stream_id]) + (size if size < 65536 else 0).to_bytes(2, "big") + b"\x80\xc0\x0a" + _stamp(3, pts) + _stamp(1, dts) + payload


def mux(data: bytes, unit: int = UNIT, key_every: int = KEY_EVERY, notes: bool = False, lose: tuple[int, int] | None = None) -> bytes:
    """A stream of data in units, unit i at dts i * TICKS, pts one later.

    notes: a second program follows each unit with a packet that says its size. lose (every, at): of units with that rest
    by every and three transport packets or more, the second packet is left out.
    """
    programs = [(1, MAP_PID, ((TEXT_PID, TEXT_TYPE),))] + ([(2, MAP_PID + 1, ((NOTE_PID, NOTE_TYPE),))] if notes else [])
    out, counter = [_tables(*programs)], 0
    for i, at in enumerate(range(0, len(data), unit)):
        packet = elementary(TEXT_STREAM, data[at : at + unit], (i + 1) * TICKS, i * TICKS)
        key = i % key_every == 0
        first = 182 if key else 184
        out.append(_packet(TEXT_PID, counter, packet[:first], True, key))
        gap = lose is not None and i % lose[0] == lose[1] and len(packet) > first + 184
        for p in range(first, len(packet), 184):
            counter += 1
            if not gap or p > first:
                out.append(_packet(TEXT_PID, counter, packet[p : p + 184], False))
        counter += 1
        if notes:
            out.append(_packet(NOTE_PID, i, elementary(NOTE_STREAM, b"size=%d" % len(data[at : at + unit]), (i + 1) * TICKS, i * TICKS), True))
    return b"".join(out)


# Reading streams


def packets(stream: bytes) -> tuple[np.ndarray, int]:
    """All transport packets as rows of 188 bytes, and the number of stretches that were skipped."""
    raw = np.frombuffer(stream, np.uint8)
    if len(raw) >= 188 and len(raw) % 188 == 0:
        rows = raw.reshape(-1, 188)
        if (rows[:, 0] == 0x47).all():
            return rows, 0
    sync = np.flatnonzero(raw == 0x47)
    best = 0, np.zeros((0, 188), np.uint8), int(len(raw) > 0)
    for stride, lead in ((188, 0), (192, 4), (204, 0)):
        runs = _runs(raw, sync[(sync >= lead) & (sync + 188 <= len(raw))], stride)
        total = sum(n for _, n in runs)
        if total > best[0]:
            rows = [np.lib.stride_tricks.as_strided(raw[p:], (n, 188), (stride, 1)) for p, n in runs]
            ends = [lead, *(p + n * stride for p, n in runs)]
            lost = sum(p != e for (p, _), e in zip(runs, ends)) + (len(raw) - ends[-1] > stride - 188)
            best = total, np.concatenate(rows), int(lost)
        if total * 188 == len(raw):
            break
    return best[1], best[2]


def _runs(raw: np.ndarray, sync: np.ndarray, stride: int) -> list[tuple[int, int]]:
    """Places of first packets and numbers of packets in a row. A packet in which the next run begins isn't one."""
    out, k = [], 0
    while k < len(sync):
        p = int(sync[k])
        if not (raw[p : p + 5 * stride : stride] == 0x47).all():
            k += 1
            continue
        line = raw[p::stride] == 0x47
        n = min(len(line) if line.all() else int(np.argmin(line)), (len(raw) - p - 188) // stride + 1)
        if out and p < out[-1][0] + (out[-1][1] - 1) * stride + 188:
            out[-1] = out[-1][0], out[-1][1] - 1
        out.append((p, n))
        k = int(np.searchsorted(sync, p + (n - 1) * stride, "right"))
        while k < len(sync) and p + n * stride > len(raw) - 188 and sync[k] < p + n * stride:
            k += 1  # the run reaches the end: nothing begins inside its last packet
    return [(p, n) for p, n in out if n > 0]


def _sections(rows: np.ndarray, starts: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """Whole sections of one PID with a right CRC."""
    out, held = [], b""

    def take(data: bytes) -> bytes:
        while len(data) >= 3 and data[0] != 0xFF:
            size = 3 + ((data[1] & 15) << 8 | data[2])
            if len(data) < size:
                return data
            section, data = data[:size], data[size:]
            if size >= 12 and crc32_mpeg(section[:-4]) == int.from_bytes(section[-4:], "big"):
                out.append(section)
        return b""

    for row, start, at in zip(rows, starts.tolist(), offsets.tolist()):
        data = row[at:].tobytes()
        if start and data:
            pointer = data[0]
            if held:
                take(held + data[1 : 1 + pointer])
            held = take(data[1 + pointer :])
        elif held:
            held = take(held + data)
    return out


def _ticks(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | b[2] >> 1 << 15 | b[3] << 7 | b[4] >> 1


def parse(stream: bytes) -> tuple[list[tuple], dict[str, int]]:
    """Elementary packets (program, pid, stream type, unit, stream id, pts, dts, random access, payload, complete, breaks) and counts."""
    rows, lost = packets(stream)
    counts = {"packets": len(rows), "lost_sync": lost, "errors": 0, "duplicates": 0, "breaks": 0, "programs": 0}
    if not len(rows):
        return [], counts
    bad = (rows[:, 1] & 0x80) > 0
    counts["errors"] = int(bad.sum())
    rows = rows[~bad]
    start = (rows[:, 1] & 0x40) > 0
    pid = (rows[:, 1].astype(np.int32) & 0x1F) << 8 | rows[:, 2]
    control, counter = rows[:, 3] >> 4 & 3, rows[:, 3] & 15
    adapted, loaded = control >= 2, control % 2 == 1
    length = np.where(adapted, rows[:, 4].astype(np.int32) + 1, 0)
    flags = np.where(adapted & (length > 1), rows[:, 5], 0)
    begin = np.minimum(4 + length, 188)
    order = np.argsort(pid, kind="stable")
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(pid[order])) + 1, [len(order)]])
    groups = {int(pid[order[a]]): order[a:b] for a, b in zip(cuts[:-1], cuts[1:]) if b > a}
    good: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for p, at in groups.items():
        at = at[loaded[at]]
        if p == 0x1FFF or not len(at):
            continue
        jump = (counter[at[1:]].astype(np.int16) - counter[at[:-1]]) % 16
        same = np.append(False, jump == 0)
        for i in np.flatnonzero(same).tolist():
            same[i] = not same[i - 1] and np.array_equal(rows[at[i]], rows[at[i - 1]])
        broken = np.append(False, jump != 1) & ~same & ((flags[at] & 0x80) == 0)
        counts["duplicates"] += int(same.sum())
        counts["breaks"] += int(broken.sum())
        good[p] = at[~same], broken[~same]
    programs: dict[int, int] = {}
    for section in _sections(rows[good[0][0]], start[good[0][0]], begin[good[0][0]]) if 0 in good else []:
        if section[0] == 0:
            for i in range(8, len(section) - 4, 4):
                number = int.from_bytes(section[i : i + 2], "big")
                if number:
                    programs[number] = int.from_bytes(section[i + 2 : i + 4], "big") & 0x1FFF
    streams: dict[int, tuple[int, int]] = {}
    for number, p in sorted(programs.items()):
        for section in _sections(rows[good[p][0]], start[good[p][0]], begin[good[p][0]]) if p in good else []:
            if section[0] == 2 and int.from_bytes(section[3:5], "big") == number:
                i = 12 + ((section[10] & 15) << 8 | section[11])
                while i + 5 <= len(section) - 4:
                    streams.setdefault(int.from_bytes(section[i + 1 : i + 3], "big") & 0x1FFF, (number, section[i]))
                    i += 5 + ((section[i + 3] & 15) << 8 | section[i + 4])
    counts["programs"] = len(programs)
    out = []
    for p, (number, kind) in sorted(streams.items()):
        if p not in good:
            continue
        at, broken = good[p]
        heads = np.flatnonzero(start[at])
        for unit, (a, b) in enumerate(zip(heads.tolist(), [*heads[1:].tolist(), len(at)])):
            some = rows[at[a:b]]
            keep = np.arange(188) >= begin[at[a:b]][:, None]
            data = some[keep].tobytes()
            if len(data) < 9 or data[:3] != b"\x00\x00\x01":
                continue
            declared, pts, dts, body = int.from_bytes(data[4:6], "big"), None, None, 6
            if data[6] >> 6 == 2:
                body = 9 + data[8]
                if data[7] & 0x80 and len(data) >= 14:
                    pts = dts = _ticks(data[9:14])
                    if data[7] & 0x40 and len(data) >= 19:
                        dts = _ticks(data[14:19])
            breaks = int(broken[a:b].sum()) if b > a else 0
            whole = not declared or len(data) >= declared + 6
            payload = data[body : declared + 6] if declared else data[body:]
            out.append((number, p, kind, unit, data[3], pts, dts, bool(flags[at[a]] & 0x40), payload, whole and not breaks, breaks))
    return out, counts


def _index(make: bool, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in T.chunks(batches, column):
            raw, found = data.tobytes(), []
            for doc, a, b in zip(rows.column("doc_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                stream = (mux(raw[a:b], notes=True, lose=LOSE) if b > a else b"") if make else raw[a:b]
                for program, pid, kind, unit, sid, pts, dts, key, payload, whole, breaks in parse(stream)[0]:
                    found.append((doc, program, pid, kind, unit, sid, pts, dts, key, len(payload), whole, breaks, hashlib.md5(payload).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], kind) for i, kind in enumerate(_FIELDS.values())], list(_FIELDS))

    return run


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in T.chunks(batches, "text"):
        raw, found = data.tobytes(), []
        for doc, a, b in zip(rows.column("doc_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
            found += [(doc, p[1], p[3], p[8]) for p in parse(raw[a:b])[0]]
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.binary()))], ["doc_id", "pid", "unit", "payload"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in T.chunks(batches, "text"):
        raw = data.tobytes()
        found = [parse(raw[a:b])[1] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        names = ("packets", "lost_sync", "errors", "duplicates", "breaks", "programs")
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *(pa.array([f[n] for f in found], pa.int32()) for n in names)], ["doc_id", *names])


def transport_index(df: DataFrame, id_col: str = "doc_id", stream_col: str = "stream") -> DataFrame:
    """One row for each elementary packet of each stream, with an MD5 digest of its payload."""
    return keyed(df, id_col, stream_col).mapInArrow(_index(False, "text"), _SCHEMA)


def transport_payloads(df: DataFrame, id_col: str = "doc_id", stream_col: str = "stream") -> DataFrame:
    """(doc_id, pid, unit, payload): the reassembled elementary packets themselves."""
    return keyed(df, id_col, stream_col).mapInArrow(_extract, "doc_id long, pid int, unit int, payload binary")


def transport_health(df: DataFrame, id_col: str = "doc_id", stream_col: str = "stream") -> DataFrame:
    """One row for each stream: packets, stretches of lost sync, error flags, duplicates, continuity breaks, programs."""
    return keyed(df, id_col, stream_col).mapInArrow(_counted, "doc_id long, packets int, lost_sync int, errors int, duplicates int, breaks int, programs int")


def text_transport_index(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """transport_index of a stream made from each text, made and parsed in one pass.

    Each stream has two programs, of text and of notes on its units, and lacks a packet in one unit of seven (LOSE).
    """
    return spread(keyed(df, id_col, text_col)).mapInArrow(_index(True, "text"), _SCHEMA)


def with_streams(df: DataFrame, text_col: str = "text", stream_col: str = "stream") -> DataFrame:
    """df with a column of streams made from a text column, as a media table for tests."""

    @F.pandas_udf("binary")
    def make(texts):  # noqa: ANN001, ANN202
        return texts.map(lambda t: None if t is None else mux(t.encode()))

    return df.withColumn(stream_col, make(F.col(f"`{text_col}`")))
