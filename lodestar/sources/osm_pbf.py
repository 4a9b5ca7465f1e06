"""OpenStreetMap extracts as a Spark source and sink: `spark.read.format("osm_pbf").load(path)` after `register(spark)`.

A file is a row of blocks, each packed by itself. The driver reads the blocks' headers
only (about 30 bytes for 8,000 entities) and deals runs of blocks of about
`partition_bytes` to tasks, so a planet file is as many tasks as it has such runs. A
task holds one block at a time and hands it on as an Arrow batch.

Rows are kind (node or way), id, lon_e7 and lat_e7 (null for a way), tags, refs (null
for a node). Coordinates are whole numbers of 1e-7 degrees, so sums don't depend on
their order. The option `kinds` leaves out the other kind before it is decoded.
Relations are not read, nor versions and authors. A block that can't be read, and a
file that requires a feature this reader doesn't know, is an error that names the place.
"""

from __future__ import annotations

import lzma
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition
from pyspark.sql.types import StructType

from lodestar.sources.files import ArrowFolderWriter, listed, located

SCHEMA = "kind string, id bigint, lon_e7 bigint, lat_e7 bigint, tags map<string,string>, refs array<bigint>"
#: Fixed values of the format: greatest sizes, entities of a block, features.
MOST_HEADER, MOST_BLOB, ENTITIES = 64 << 10, 32 << 20, 8000
KNOWN_FEATURES = {"OsmSchema-V0.6", "DenseNodes"}
#: Packed bytes of a task; a way of three nodes takes about 8 of them, and its decoding more time than its reading.
PARTITION_BYTES = 2 << 20


# ---- messages of the format

def _varint(data: memoryview, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def _fields(data: memoryview) -> Iterator[tuple[int, int | memoryview]]:
    """Numbers and values of a message's fields."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        wire = tag & 7
        if wire == 0:
            value, at = _varint(data, at)
        elif wire in (1, 2, 5):
            size = {1: 8, 5: 4}.get(wire)
            if size is None:
                size, at = _varint(data, at)
            if at + size > len(data):
                raise ValueError("a field ends after its message")
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"wire type {wire}")
        yield tag >> 3, value


def _packed(data: memoryview) -> np.ndarray:
    """All whole numbers of a packed field at once."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    ends = np.flatnonzero(raw < 128)
    starts = np.r_[0, ends[:-1] + 1]
    place = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((raw & 127).astype(np.uint64) << (7 * place).astype(np.uint64), starts)


def _packed_lists(lists: list[memoryview]) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers of many packed fields at once, and how many each holds."""
    raw = np.frombuffer(b"".join(lists), np.uint8)
    until = np.cumsum(np.array([len(x) for x in lists], np.int64))
    if (raw[until[until > 0] - 1] > 127).any():
        raise ValueError("a number ends after its field")
    numbers = np.r_[0, np.cumsum(raw < 128)][np.r_[0, until]]
    return _packed(raw), np.diff(numbers)


def _signed(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(1)).astype(np.int64) ^ -(values & np.uint64(1)).astype(np.int64)


def _int64(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _unpacked(blob: memoryview) -> memoryview:
    for number, value in _fields(blob):
        if number == 1:
            return value
        if number == 3:
            return memoryview(zlib.decompress(value))
        if number == 4:
            return memoryview(lzma.decompress(value))
        if number == 7:
            import zstandard

            return memoryview(zstandard.ZstdDecompressor().decompress(value, MOST_BLOB))
        if number in (5, 6):
            raise ValueError("blocks packed by lz4 or bzip2 aren't read")
    raise ValueError("a block without data")


def _header(data: memoryview) -> tuple[str, int]:
    found = dict(_fields(data))
    return bytes(found[1]).decode(), found[3]


# ---- blocks to rows

def _entities(block: memoryview, kinds: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    strings, groups, granularity, lat_offset, lon_offset = [], [], 100, 0, 0
    for number, value in _fields(block):
        if number == 1:
            strings = [bytes(s).decode("utf-8", "replace") for n, s in _fields(value) if n == 1]
        elif number == 2:
            groups.append(value)
        elif number == 17:
            granularity = value
        elif number == 19:
            lat_offset = _int64(value)
        elif number == 20:
            lon_offset = _int64(value)
    table = pa.array(strings, pa.string())
    e7 = lambda offset, v: _toward_zero(offset + granularity * v)
    for group in groups:
        singles, ways = [], []
        for number, value in _fields(group):
            if number == 1 and "node" in kinds:
                singles.append(dict(_fields(value)))
            elif number == 2 and "node" in kinds:
                yield _dense(value, table, lambda v: e7(lat_offset, v), lambda v: e7(lon_offset, v))
            elif number == 3 and "way" in kinds:
                ways.append(dict(_fields(value)))
        if singles:
            number = lambda n: _signed(np.array([s[n] for s in singles], np.uint64))
            yield _batch("node", number(1), e7(lon_offset, number(9)), e7(lat_offset, number(8)), _tags(singles, table))
        if ways:
            steps, counts = _packed_lists([w.get(8, memoryview(b"")) for w in ways])
            along, offsets = np.cumsum(_signed(steps)), np.r_[0, np.cumsum(counts)]
            refs = along - np.repeat(np.r_[0, along][offsets[:-1]], counts)  # each way starts from 0
            ids = np.array([w[1] for w in ways], np.uint64).astype(np.int64)
            yield _batch("way", ids, None, None, _tags(ways, table), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(refs, pa.int64())))


def _toward_zero(values: np.ndarray) -> np.ndarray:
    """Billionths of a degree to whole 1e-7 degrees."""
    return np.sign(values) * (np.abs(values) // 100)


def _dense(data: memoryview, table: pa.Array, lat, lon) -> pa.RecordBatch:
    found = dict(_fields(data))
    ids, lats, lons = (np.cumsum(_signed(_packed(found[n]))) for n in (1, 8, 9))
    pairs = _packed(found.get(10, memoryview(b""))).astype(np.int64)
    if len(pairs):  # keys and values by turns, a zero after each node
        ends = np.flatnonzero(pairs == 0)
        counts = np.diff(np.r_[-1, ends]) - 1
        if len(ends) != len(ids) or (counts % 2).any():
            raise ValueError("tags of dense nodes don't fit the nodes")
        pairs = pairs[pairs != 0]
    else:
        counts = np.zeros(len(ids), np.int64)
    return _batch("node", ids, lon(lons), lat(lats), _maps(counts // 2, pairs[0::2], pairs[1::2], table))


def _tags(messages: list[dict], table: pa.Array) -> pa.Array:
    (keys, counts), (values, others) = (_packed_lists([m.get(n, memoryview(b"")) for m in messages]) for n in (2, 3))
    if (counts != others).any():
        raise ValueError("keys and values of tags don't fit")
    return _maps(counts, keys, values, table)


def _maps(counts: np.ndarray, keys: np.ndarray, values: np.ndarray, table: pa.Array) -> pa.Array:
    offsets = pa.array(np.r_[0, np.cumsum(counts)], pa.int32())
    take = lambda at: table.take(pa.array(at.astype(np.int64)))
    return pa.MapArray.from_arrays(offsets, take(keys), take(values))


def _batch(kind: str, ids: np.ndarray, lon, lat, tags: pa.Array, refs: pa.Array | None = None) -> pa.RecordBatch:
    n, longs = len(ids), pa.int64()
    whole = lambda v: pa.nulls(n, longs) if v is None else pa.array(v, longs)
    lists = pa.nulls(n, pa.list_(longs)) if refs is None else refs
    return pa.RecordBatch.from_arrays([pa.array([kind] * n), whole(ids), whole(lon), whole(lat), tags, lists],
                                      ["kind", "id", "lon_e7", "lat_e7", "tags", "refs"])


# ---- rows to blocks

def _to_varint(value: int) -> bytes:
    value &= (1 << 64) - 1
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    out.append(value)
    return bytes(out)


def _zigzag(value: int) -> int:
    return value << 1 ^ value >> 63


def _number(field: int, value: int) -> bytes:
    return _to_varint(field << 3) + _to_varint(value)


def _bytes(field: int, value: bytes) -> bytes:
    return _to_varint(field << 3 | 2) + _to_varint(len(value)) + value


def _list(field: int, values) -> bytes:
    return _bytes(field, b"".join(map(_to_varint, values)))


def _deltas(field: int, values: list[int]) -> bytes:
    return _list(field, (_zigzag(v - b) for v, b in zip(values, [0, *values], strict=False)))


def _zigzags(values: np.ndarray) -> np.ndarray:
    return (values << 1 ^ values >> 63).view(np.uint64)


def _to_varints(values: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Whole numbers as varints in a row, and where each starts, with the end behind."""
    values = values.astype(np.uint64)
    sizes, rest = np.ones(len(values), np.int64), values >> np.uint64(7)
    while rest.any():
        sizes += rest > 0
        rest >>= np.uint64(7)
    starts = np.r_[0, np.cumsum(sizes)]
    out = np.empty(starts[-1], np.uint8)
    for k in range(sizes.max(initial=0)):
        here = np.flatnonzero(sizes > k)
        more = np.where(sizes[here] > k + 1, np.uint8(128), np.uint8(0))
        out[starts[here] + k] = (values[here] >> np.uint64(7 * k) & np.uint64(127)).astype(np.uint8) | more
    return out.tobytes(), starts


def _whole(column: pa.Array, what: str) -> np.ndarray:
    if column.null_count:
        raise ValueError(f"{what} is missing")
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


def _parts(column: pa.Array) -> tuple[np.ndarray, int, int]:
    """Length of each list or map, and where their items start and end."""
    offsets = column.offsets.to_numpy()
    return np.diff(offsets), int(offsets[0]), int(offsets[-1])


def _block(kind: str, rows: pa.RecordBatch) -> bytes:
    """A block of rows of one kind, all numbers of a column packed at once."""
    counts, start, end = _parts(rows.column("tags"))
    n_tags = end - start
    both = pa.concat_arrays([side.slice(start, n_tags).cast(pa.string()) for side in (rows.column("tags").keys, rows.column("tags").items)])
    if both.null_count:
        raise ValueError("a value of a tag is missing")
    both = both.dictionary_encode()
    at = both.indices.to_numpy().astype(np.int64) + 1  # the first string is empty, as 0 parts the tags of nodes
    keys, values, ids = at[:n_tags], at[n_tags:], _whole(rows.column("id"), "an id")
    if kind == "node":
        deltas = lambda field, v: _bytes(field, _to_varints(_zigzags(np.diff(v, prepend=0)))[0])
        flat = np.zeros(2 * n_tags + len(ids), np.int64)
        place = 2 * np.arange(n_tags) + np.repeat(np.arange(len(ids)), counts)
        flat[place], flat[place + 1] = keys, values
        group = _bytes(2, deltas(1, ids) + deltas(8, _whole(rows.column("lat_e7"), "a latitude")) + deltas(9, _whole(rows.column("lon_e7"), "a longitude")) + _bytes(10, _to_varints(flat)[0]))
    else:
        n_refs, first, last = _parts(rows.column("refs"))
        refs = _whole(rows.column("refs").values.slice(first, last - first), "a node of a way")
        begins = np.r_[0, np.cumsum(n_refs)][:-1][n_refs > 0]
        steps = np.diff(refs, prepend=0)
        steps[begins] = refs[begins]  # each way starts from 0
        ends = lambda sizes: np.r_[0, np.cumsum(sizes)]
        packed = [(data, starts[ends(sizes)].tolist()) for (data, starts), sizes in (
            (_to_varints(ids.view(np.uint64)), np.ones(len(ids), np.int64)), (_to_varints(keys), counts), (_to_varints(values), counts), (_to_varints(_zigzags(steps)), n_refs))]
        (i, i_at), (k, k_at), (v, v_at), (r, r_at) = packed
        group = b"".join(_bytes(3, b"\x08" + i[i_at[j]:i_at[j + 1]] + _bytes(2, k[k_at[j]:k_at[j + 1]]) + _bytes(3, v[v_at[j]:v_at[j + 1]]) + _bytes(8, r[r_at[j]:r_at[j + 1]]))
                         for j in range(len(ids)))
    return _bytes(1, b"".join(_bytes(1, s.encode()) for s in ["", *both.dictionary.to_pylist()])) + _bytes(2, group)


def _put(out, name: str, data: bytes) -> None:
    if len(data) > MOST_BLOB:
        raise ValueError("a block of over 32 MB")
    blob = _number(2, len(data)) + _bytes(3, zlib.compress(data))
    header = _bytes(1, name.encode()) + _number(3, len(blob))
    out.write(struct.pack(">I", len(header)) + header + blob)


def _encode(batches: Iterator[pa.RecordBatch], out) -> None:
    _put(out, "OSMHeader", b"".join(_bytes(4, f.encode()) for f in sorted(KNOWN_FEATURES)))
    waiting: dict[str, list[pa.RecordBatch]] = {"node": [], "way": []}

    def put(kind: str, least: int) -> None:
        some = pa.Table.from_batches(waiting[kind])
        while some.num_rows >= least:
            _put(out, "OSMData", _block(kind, some.slice(0, ENTITIES).combine_chunks().to_batches()[0]))
            some = some.slice(ENTITIES)
        waiting[kind] = some.to_batches()

    for batch in batches:
        of = {kind: batch.filter(pc.equal(batch.column("kind"), kind)) for kind in waiting}
        if sum(rows.num_rows for rows in of.values()) < batch.num_rows:
            raise ValueError("kinds are node and way")
        for kind, rows in of.items():
            if rows.num_rows:
                waiting[kind].append(rows)
                if sum(r.num_rows for r in waiting[kind]) >= ENTITIES:
                    put(kind, ENTITIES)
    for kind, some in waiting.items():
        if some:
            put(kind, 1)


# ---- the source

@dataclass
class Blocks(InputPartition):
    """Blocks of one file, from byte to byte."""

    file: str
    start: int
    end: int


class PbfReader(DataSourceReader):
    def __init__(self, path: str, kinds: tuple[str, ...], partition_bytes: int):
        self.path, self.kinds, self.partition_bytes = path, kinds, partition_bytes

    def partitions(self) -> list[Blocks]:
        out, (system, _) = [], located(self.path)
        for file in listed(self.path, (".pbf",)):
            with system.open_input_file(file) as data:
                start = at = 0
                for _, _, end in _blocks(data, 0, data.size(), file):
                    if end - start >= self.partition_bytes:
                        out.append(Blocks(file, start, end))
                        start = end
                    at = end
                if at > start:
                    out.append(Blocks(file, start, at))
        return out or [Blocks("", 0, 0)]

    def read(self, partition: Blocks) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        system, _ = located(self.path)
        with system.open_input_file(partition.file) as data:
            for name, begin, end in _blocks(data, partition.start, partition.end, partition.file):
                data.seek(begin)
                try:
                    block = _unpacked(memoryview(data.read(end - begin)))
                    if name == "OSMHeader":
                        unknown = {bytes(v).decode() for n, v in _fields(block) if n == 4} - KNOWN_FEATURES
                        if unknown:
                            raise ValueError(f"requires {sorted(unknown)}")
                    elif name == "OSMData":
                        yield from _entities(block, self.kinds)
                except (ValueError, KeyError, IndexError, zlib.error, lzma.LZMAError, pa.ArrowInvalid) as wrong:
                    raise ValueError(f"{partition.file}, block at byte {begin}: {wrong}") from wrong


def _blocks(data, at: int, end: int, file: str) -> Iterator[tuple[str, int, int]]:
    """Name, start and end of each block's data; the data are not read."""
    while at < end:
        data.seek(at)
        (size,) = struct.unpack(">I", data.read(4).ljust(4, b"\0"))
        if not 0 < size <= MOST_HEADER:
            raise ValueError(f"{file}: no block at byte {at}")
        name, length = _header(memoryview(data.read(size)))
        begin = at + 4 + size
        at = begin + length
        if length > MOST_BLOB + (1 << 20) or at > end:
            raise ValueError(f"{file}: the block at byte {begin} ends after the file or is too large")
        yield name, begin, at


class OsmPbf(DataSource):
    @classmethod
    def name(cls) -> str:
        return "osm_pbf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> PbfReader:
        kinds = tuple(k.strip() for k in self.options.get("kinds", "node,way").split(","))
        if set(kinds) - {"node", "way"}:
            raise ValueError("kinds are node and way")
        return PbfReader(self.options["path"], kinds, int(self.options.get("partition_bytes", PARTITION_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return ArrowFolderWriter(self.options["path"], ".osm.pbf", _encode, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(OsmPbf)


def extract(spark: SparkSession, path: str) -> DataFrame:
    """The entities of an extract; what is asked of one kind by a filter doesn't decode the other."""
    of = lambda kind: spark.read.format("osm_pbf").option("kinds", kind).load(path).withColumn("kind", F.lit(kind))
    return of("node").unionByName(of("way"))
