"""Media columns: MPEG transport streams in a binary column, written and parsed back.

A payload is carried as access units of 576 bytes, up to 32 of them in a packetised elementary (PES) packet
with a presentation timestamp on the 90 kHz clock; a unit lasts 1,080 ticks. A PES packet's first transport
packet is a random-access point with a clock reference, its last one is stuffed by an adaptation field. Program
association and map tables with checksums come first. The parser takes any single-program stream of this kind:
it finds the elementary stream through the tables, checks continuity counters (a repeated packet is dropped, a
gap counts as an error), and reassembles the PES packets.

Beside each stream its index is stored: of every PES packet the number of its first transport packet, its timestamp
and whether it is a random-access point. A reader of one moment cuts the stream at the last such point before it,
and parses no byte in front of it but the tables. The parser finds the same index again, which is checked.

Streams are made and parsed row by row where the rows are, and nothing is shuffled. Defined results: null and
empty texts have the least payload, 576 bytes of 255; equal texts give equal streams; bytes that are no
transport stream give an empty payload and one error; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_view, chunks, documents, written

UNIT, UNITS_EACH, TICKS, FIRST_TICK = 576, 32, 1080, 90_000
PACKET, SYNC, PMT_PID, STREAM_PID, STREAM_TYPE, STREAM_ID = 188, 0x47, 0x1000, 0x0100, 0x06, 0xBD
_COLUMNS = np.arange(PACKET)


def section_crc(data: bytes) -> int:
    """CRC-32 of program tables: polynomial 0x04C11DB7, from all ones, not reflected."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc >> 31 else crc << 1) & 0xFFFFFFFF
    return crc


def _table(table_id: int, number: int, body: bytes) -> bytes:
    """A program table as the payload of one transport packet."""
    length = 5 + len(body) + 4
    head = bytes([table_id, 0xB0 | length >> 8, length & 0xFF, number >> 8, number & 0xFF, 0xC1, 0, 0]) + body
    return b"\0" + head + section_crc(head).to_bytes(4, "big")


def _table_packet(pid: int, table: bytes) -> np.ndarray:
    head = bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10])
    return np.frombuffer((head + table).ljust(PACKET, b"\xff"), np.uint8)


_TABLES = np.stack([
    _table_packet(0, _table(0x00, 1, bytes([0, 1, 0xE0 | PMT_PID >> 8, PMT_PID & 0xFF]))),
    _table_packet(PMT_PID, _table(0x02, 1, bytes([0xE0 | STREAM_PID >> 8, STREAM_PID & 0xFF, 0xF0, 0, STREAM_TYPE, 0xE0 | STREAM_PID >> 8, STREAM_PID & 0xFF, 0xF0, 0]))),
])


def _stamp(ticks: int) -> bytes:
    return bytes([0x21 | ticks >> 29 & 0x0E, ticks >> 22 & 0xFF, ticks >> 14 & 0xFE | 1, ticks >> 7 & 0xFF, ticks << 1 & 0xFE | 1])


def padded(raw: bytes) -> bytes:
    return raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT, b"\xff")


def mux(payload: bytes) -> tuple[bytes, list[tuple[int, int, bool]]]:
    """The payload, whole units, as a transport stream, and its index: packet, timestamp, random access."""
    made, count, points = [_TABLES], 0, []
    for k, first in enumerate(range(0, len(payload), UNIT * UNITS_EACH)):
        data = payload[first : first + UNIT * UNITS_EACH]
        ticks = (FIRST_TICK + k * UNITS_EACH * TICKS) & (1 << 33) - 1
        body = np.frombuffer(b"\0\0\1" + bytes([STREAM_ID]) + (8 + len(data)).to_bytes(2, "big") + b"\x80\x80\x05" + _stamp(ticks) + data, np.uint8)
        full, rest = divmod(len(body) - 176, 184)
        n = 1 + full + (rest > 0)
        out = np.full((n, PACKET), 0xFF, np.uint8)
        out[:, 0], out[:, 1], out[:, 2] = SYNC, STREAM_PID >> 8, STREAM_PID & 0xFF
        out[:, 3] = 0x10 | (count + np.arange(n) & 15)
        out[0, 1] |= 0x40
        out[0, 3] |= 0x20
        out[0, 4:12] = [7, 0x50, *((ticks << 15 | 0x7E00).to_bytes(6, "big"))]
        out[0, 12:] = body[:176]
        out[1 : 1 + full, 4:] = body[176 : 176 + full * 184].reshape(full, 184)
        if rest:
            out[-1, 3] |= 0x20
            out[-1, 4] = 183 - rest
            if rest < 183:
                out[-1, 5] = 0
            out[-1, PACKET - rest :] = body[len(body) - rest :]
        points.append((len(_TABLES) + count, ticks, True))
        count += n
        made.append(out)
    return np.concatenate(made).tobytes(), points


def _section(packets: np.ndarray, pid: np.ndarray, wanted: int, table_id: int) -> bytes | None:
    """The first sound table of that kind on that PID, without head and checksum."""
    for row in packets[(pid == wanted) & (packets[:, 1] & 0x40 > 0)]:
        raw = row.tobytes()
        at = 4 + (1 + raw[4] if raw[3] & 0x20 else 0)
        at += 1 + raw[at]
        end = at + 3 + (raw[at + 1] << 8 & 0x0F00 | raw[at + 2])
        if raw[at] == table_id and end <= PACKET and section_crc(raw[at:end]) == 0:
            return raw[at + 8 : end - 4]
    return None


def demux(stream: bytes) -> tuple[bytes, list[tuple[int, int, bool]], int]:
    """The payload; per PES packet its transport packet, timestamp (-1: none) and whether it is a random-access point; errors."""
    whole = len(stream) // PACKET
    p = np.frombuffer(stream, np.uint8, whole * PACKET).reshape(whole, PACKET)
    errors = int(len(stream) % PACKET > 0) + int((p[:, 0] != SYNC).sum())
    pid = (p[:, 1].astype(np.int32) & 0x1F) << 8 | p[:, 2]
    programs = _section(p, pid, 0, 0x00)
    found = None
    for k in range(0, len(programs or b""), 4):
        if programs[k] or programs[k + 1]:
            found = _section(p, pid, programs[k + 2] << 8 & 0x1F00 | programs[k + 3], 0x02)
            break
    if not found:
        return b"", [], errors + 1
    at = 4 + (found[2] << 8 & 0x0F00 | found[3])
    rows = np.flatnonzero((pid == (found[at + 1] << 8 & 0x1F00 | found[at + 2])) & (p[:, 3] & 0x10 > 0) & (p[:, 0] == SYNC))
    es = p[rows]
    count = es[:, 3] & 15
    step = np.diff(count) & 15
    repeated = np.zeros(len(es), bool)
    repeated[1:] = (step == 0) & (es[1:] == es[:-1]).all(axis=1)
    errors += int(((step != 1) & ~repeated[1:]).sum())
    rows, es = rows[~repeated], es[~repeated]
    adapted = es[:, 3] & 0x20 > 0
    begin = np.where(adapted, np.minimum(5 + es[:, 4].astype(np.int32), PACKET), 4)
    entry = adapted & (es[:, 4] > 0) & (es[:, 5] & 0x40 > 0)
    data = es[_COLUMNS >= begin[:, None]].tobytes()
    place = np.concatenate([[0], np.cumsum(PACKET - begin)])
    heads = np.flatnonzero(es[:, 1] & 0x40)
    parts, points = [], []
    for h, s, e in zip(heads.tolist(), place[heads].tolist(), [*place[heads[1:]].tolist(), len(data)]):
        if data[s : s + 3] != b"\0\0\1" or e - s < 9:
            errors += 1
            continue
        length = data[s + 4] << 8 | data[s + 5]
        end = min(e, s + 6 + length) if length else e
        errors += end != s + 6 + length if length else 0
        d = data[s + 9 : s + 14]
        ticks = (d[0] & 0x0E) << 29 | d[1] << 22 | (d[2] & 0xFE) << 14 | d[3] << 7 | d[4] >> 1 if data[s + 7] & 0x80 else -1
        points.append((int(rows[h]), ticks, bool(entry[h])))
        parts.append(data[s + 9 + data[s + 8] : end])
    return b"".join(parts), points, int(errors)


_POINT = "array<struct<packet:int,pts:bigint,random_access:boolean>>"


def _points(rows: list[list[tuple[int, int, bool]]]) -> pa.Array:
    names = ("packet", "pts", "random_access")
    return pa.array([[dict(zip(names, x)) for x in row] for row in rows], pa.list_(pa.struct(list(zip(names, (pa.int32(), pa.int64(), pa.bool_()))))))


def streams(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media, the stream that carries each row's text, and points, its index."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in chunks(byte_view(batch.column("text"))[1]):
                rows = batch.slice(a, b - a)
                raw = [(t or "").encode() for t in rows.column("text").to_pylist()]
                made = [mux(padded(x)) for x in raw]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array([len(x) for x in raw], pa.int64()), pa.array([m for m, _ in made], pa.binary()), _points([p for _, p in made])], names=["doc_id", "n_bytes", "media", "points"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(step, f"doc_id long, n_bytes long, media binary, points {_POINT}")


def parsed(media: DataFrame) -> DataFrame:
    """media with payload, found (the index as the parser finds it: packet, pts, random_access) and errors."""
    names = [c for c in media.columns if c not in ("payload", "found", "errors")]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in chunks(byte_view(batch.column("media"))[1]):
                rows = batch.slice(a, b - a)
                made = [demux(x or b"") for x in rows.column("media").to_pylist()]
                yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in names], pa.array([m[0] for m in made], pa.binary()), _points([m[1] for m in made]), pa.array([m[2] for m in made], pa.int32())], names=[*names, "payload", "found", "errors"])

    kept = media.select(names)
    schema = kept.withColumns({"payload": F.lit(b""), "found": F.expr(f"cast(array() as {_POINT})"), "errors": F.lit(0)}).schema
    return kept.mapInArrow(step, schema)


def from_moment(media: DataFrame, ticks: int) -> DataFrame:
    """media cut at its last random-access point at that timestamp or before (the first one, if none is), by the stored points alone."""
    entries = F.filter("points", lambda p: p["random_access"])
    at = F.coalesce(F.array_max(F.transform(F.filter(entries, lambda p: p["pts"] <= ticks), lambda p: p["packet"])), F.array_min(entries["packet"]), F.lit(len(_TABLES)))
    head, rest = F.substring("media", 1, len(_TABLES) * PACKET), F.substring("media", at * PACKET + 1, F.length("media"))
    moved = F.transform(F.filter("points", lambda p: p["packet"] >= at), lambda p: F.struct((p["packet"] - at + len(_TABLES)).alias("packet"), p["pts"].alias("pts"), p["random_access"].alias("random_access")))
    return media.withColumns({"media": F.concat(head, rest), "points": moved})


def op9_media_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = parsed(written(streams(documents(spark, sf_dir)), "media"))
    text = lambda *x: F.concat_ws(";", *x)
    feature = text(
        F.concat(F.lit("packets="), F.floor(F.length("media") / PACKET)), F.concat(F.lit("pes="), F.size("points")),
        F.concat(F.lit("entries="), F.size(F.filter("points", lambda p: p["random_access"]))),
        F.concat(F.lit("pts="), F.array_min(F.col("points.pts")), F.lit("-"), F.array_max(F.col("points.pts"))),
        F.concat(F.lit("errors="), F.col("errors") + (F.col("points") != F.col("found")).cast("int")),
    )
    return found.select(
        "doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -32, 32)")).alias("tail_crc32"), F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"),
    )
