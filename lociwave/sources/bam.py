"""Block-compressed alignments (BAM) as a data source that is read in splits and written in parts.

A file is a chain of gzip members that name their own size. A split starts at the
first member from its first byte on; since a record may begin in one member and
end in a later one, the reader then looks for the first place where a chain of
records fits. Every task holds the place where its own last record ends against
what that search finds for the split behind it: the first split starts behind the
header, so by induction every split starts where the one before it ends, or the
read fails. A record belongs to the split in whose members its first byte lies.

``ord`` is the virtual offset: the member's place in the file and the record's
place in the member. Gzip files whose members do not name their size are read by
one task, with places in the inflated stream as ``ord``.
"""

from __future__ import annotations

import bisect
import gzip
import io
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from lociwave.sources.files import RANGE_BYTES, listed, opened, system_of

# The format's codes for operations and letters, its marks, and the empty member at the end.
OPERATIONS, LETTERS = "MIDNSHP=X", "=ACMGRSVTWYHKDBN"
MAGIC, MEMBER = b"BAM\1", b"\x1f\x8b\x08\x04"
END_OF_FILE = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")

SCHEMA = "read_id string, flags int, ref string, pos int, mapq int, cigar array<struct<op:string,len:int>>, mate_ref string, mate_pos int, seq string, qual array<int>, ord bigint"
_ARROW = pa.schema([("read_id", pa.string()), ("flags", pa.int32()), ("ref", pa.string()), ("pos", pa.int32()), ("mapq", pa.int32()), ("cigar", pa.list_(pa.struct([("op", pa.string()), ("len", pa.int32())]))), ("mate_ref", pa.string()), ("mate_pos", pa.int32()), ("seq", pa.string()), ("qual", pa.list_(pa.int32())), ("ord", pa.int64())])
_FIXED = 36
#: Records in a row that must fit before a place counts as the start of one.
CHAIN = 8
RECORDS_AT_ONCE = 4096
#: Bytes of a member before compression, below the format's limit of 64 KiB.
MEMBER_BYTES = 0xFF00


def member_size(head: bytes) -> int | None:
    """The compressed size that a member's header names; None if it is none or names none."""
    if len(head) < 18 or head[:4] != MEMBER:
        return None
    at, end = 12, 12 + struct.unpack_from("<H", head, 10)[0]
    while at + 4 <= min(end, len(head)):
        own = struct.unpack_from("<H", head, at + 2)[0]
        if head[at : at + 2] == b"BC" and own == 2 and at + 6 <= len(head):
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + own
    return None


def first_member(file: BinaryIO, start: int, size: int) -> int:
    """The place of the first member from ``start`` on: its mark, and behind it another or the end of the file."""
    at = start
    while at < size:
        file.seek(at)
        window = file.read(1 << 17)
        i = window.find(MEMBER)
        while i >= 0:
            file.seek(at + i)
            own = member_size(file.read(min(1 << 16, size - at - i)))
            if own is not None and at + i + own <= size:
                file.seek(at + i + own)
                behind = file.read(1 << 10)
                if at + i + own == size or member_size(behind) is not None:
                    return at + i
            i = window.find(MEMBER, i + 1)
        at += max(1, len(window) - len(MEMBER) + 1)
    return size


def members(file: BinaryIO, at: int, size: int) -> Iterator[tuple[int, bytes]]:
    """(place, inflated bytes) of the members from ``at`` on, empty ones left out."""
    while at < size:
        file.seek(at)
        raw = file.read(1 << 16)
        own = member_size(raw)
        if own is None or len(raw) < own:
            raise ValueError(f"no whole member at byte {at}")
        if data := zlib.decompress(raw[:own], 31):
            yield at, data
        at += own


def chunks(file: BinaryIO) -> Iterator[tuple[int, bytes]]:
    """(place in the inflated stream, bytes) of a gzip file of any members."""
    stream, at = gzip.GzipFile(fileobj=io.BufferedReader(file, 1 << 20)), 0
    while data := stream.read(1 << 16):
        yield at, data
        at += len(data)


class Inflated:
    """A window of inflated bytes that grows at its end and is cut at its start."""

    def __init__(self, parts: Iterator[tuple[int, bytes]], size: int, stop: int | None = None):
        self.parts, self.size, self.stop = parts, size, stop
        self.data, self.base, self.limit = bytearray(), 0, None
        self.firsts: list[int] = []
        self.places: list[int] = []

    def more(self) -> bool:
        part = next(self.parts, None)
        if part is None:
            return False
        first = self.base + len(self.data)
        if self.limit is None and self.stop is not None and part[0] >= self.stop:
            self.limit = first
        self.firsts.append(first)
        self.places.append(part[0])
        self.data += part[1]
        return True

    def have(self, n: int) -> bool:
        while len(self.data) < n:
            if not self.more():
                return False
        return True

    def take(self, n: int) -> bytes:
        if not self.have(n):
            raise ValueError("the file is cut")
        out = bytes(self.data[:n])
        self.drop(n)
        return out

    def drop(self, n: int) -> None:
        del self.data[:n]
        self.base += n
        gone = bisect.bisect_right(self.firsts, self.base) - 1
        if gone > 0:
            del self.firsts[:gone], self.places[:gone]

    def where(self, i: int) -> tuple[int, int]:
        """(member, place in it) of byte ``i`` of the window; the size of the file at its end."""
        if not self.have(i + 1):
            return self.size, 0
        k = bisect.bisect_right(self.firsts, self.base + i) - 1
        return self.places[k], self.base + i - self.firsts[k]

    def offsets(self, at: np.ndarray) -> np.ndarray:
        k = np.searchsorted(np.array(self.firsts), self.base + at, "right") - 1
        return (np.array(self.places, np.int64)[k] << 16) + self.base + at - np.array(self.firsts)[k]


def header(stream: Inflated) -> list[str]:
    """The references' names; the stream then stands at the first record."""
    if stream.take(4) != MAGIC:
        raise ValueError("not a BAM file")
    number = lambda: struct.unpack("<i", stream.take(4))[0]
    stream.take(number())
    names = []
    for _ in range(number()):
        names.append(stream.take(number())[:-1].decode())
        number()
    return names


def _fits(data: np.ndarray, refs: int) -> np.ndarray:
    """The places at which the fixed part of a record and its name could stand."""
    n = len(data) - _FIXED - 256
    if n <= 0:
        return np.zeros(0, np.int64)
    word = lambda k: data[k : k + n].astype(np.int64) | data[k + 1 : k + 1 + n].astype(np.int64) << 8 | data[k + 2 : k + 2 + n].astype(np.int64) << 16 | data[k + 3 : k + 3 + n].astype(np.int8).astype(np.int64) << 24
    size, ref, pos, length, mate, mate_pos = (word(k) for k in (0, 4, 8, 20, 24, 28))
    name = data[12 : 12 + n].astype(np.int64)
    ops = data[16 : 16 + n].astype(np.int64) | data[17 : 17 + n].astype(np.int64) << 8
    ok = (ref >= -1) & (ref < refs) & (mate >= -1) & (mate < refs) & (pos >= -1) & (mate_pos >= -1) & (length >= 0) & (name >= 1)
    ok &= size >= 32 + name + 4 * ops + (length + 1) // 2 + length
    at = np.flatnonzero(ok)
    return at[data[at + _FIXED + name[at] - 1] == 0]


def _chain(stream: Inflated, at: int, refs: int) -> bool:
    """Whether records follow each other from here on, to the end of the file or CHAIN of them."""
    for _ in range(CHAIN):
        if not stream.have(at + 4):
            return at == len(stream.data)
        if not stream.have(at + _FIXED):
            return False
        size, ref, pos, name, _, _, ops, _, length, mate, mate_pos = struct.unpack_from("<iiiBBHHHiii", stream.data, at)
        if not (-1 <= ref < refs and -1 <= mate < refs and pos >= -1 and mate_pos >= -1 and length >= 0 and name >= 1 and size >= 32 + name + 4 * ops + (length + 1) // 2 + length):
            return False
        if not stream.have(at + _FIXED + name) or stream.data[at + _FIXED + name - 1] != 0 or not all(33 <= b <= 126 for b in stream.data[at + _FIXED : at + _FIXED + name - 1]):
            return False
        at += 4 + size
        if not stream.have(at):
            return False
    return True


def first_record(file: BinaryIO, start: int, size: int, refs: int) -> tuple[int, int]:
    """(member, place in it) of the first record that begins in or behind the first member from ``start`` on."""
    stream = Inflated(members(file, first_member(file, start, size), size), size)
    tried = 0
    while True:
        more = stream.have(tried + (1 << 17))
        data = np.frombuffer(bytes(stream.data[tried:]) + bytes(0 if more else _FIXED + 256), np.uint8)
        for i in _fits(data, refs).tolist():
            if tried + i < len(stream.data) and _chain(stream, tried + i, refs):
                return stream.where(tried + i)
        if not more:
            return size, 0
        tried += max(0, len(data) - _FIXED - 256)


def records(stream: Inflated) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """(bytes, first byte of each record in them, their virtual offsets) up to the end of the split."""
    while True:
        at, starts, over = 0, [], False
        while len(starts) < RECORDS_AT_ONCE:
            if not stream.have(at + 4):
                if at != len(stream.data):
                    raise ValueError("the file is cut")
                over = True
                break
            if stream.limit is not None and stream.base + at >= stream.limit:
                over = True
                break
            size = int.from_bytes(stream.data[at : at + 4], "little")
            if not stream.have(at + 4 + size):
                raise ValueError("the file is cut")
            starts.append(at)
            at += 4 + size
        if starts:
            own = np.array(starts, np.int64)
            yield bytes(stream.data[:at]), own, stream.offsets(own)
            stream.drop(at)
        if over:
            return


def _places(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The indices of all ranges (first, size), one behind the other."""
    return np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))


def _offsets(size: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(size)]).astype(np.int32)


def _texts(data: np.ndarray, size: np.ndarray) -> pa.Array:
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(_offsets(size)), pa.py_buffer(np.ascontiguousarray(data)))


_LETTER = np.frombuffer(LETTERS.encode(), np.uint8)


def decoded(data: bytes, starts: np.ndarray, ord_: np.ndarray, refs: pa.Array) -> pa.RecordBatch:
    """The records as columns; ``refs`` ends with the name of no reference."""
    buf = np.frombuffer(data, np.uint8)
    head = np.ascontiguousarray(buf[starts[:, None] + np.arange(_FIXED)])
    word, half = head.view("<i4"), head.view("<u2")
    name, ops, length = head[:, 12].astype(np.int64), half[:, 8].astype(np.int64), word[:, 5].astype(np.int64)
    at = starts + _FIXED
    names = _texts(buf[_places(at, name - 1)], name - 1)
    at = at + name
    words = np.ascontiguousarray(buf[_places(at, 4 * ops)]).view("<u4")
    item = pa.StructArray.from_arrays([pa.array(list(OPERATIONS)).take(pa.array(words & 15)), pa.array((words >> 4).astype(np.int32))], ["op", "len"])
    cigar = pa.ListArray.from_arrays(pa.array(_offsets(ops)), item)
    at = at + 4 * ops
    k = _places(np.zeros(len(length), np.int64), length)
    packed = buf[np.repeat(at, length) + (k >> 1)]
    letters = _texts(_LETTER[np.where(k & 1, packed & 15, packed >> 4)], length)
    letters = pa.compute.if_else(pa.array(length == 0), pa.scalar("*"), letters)
    at = at + (length + 1) // 2
    known = np.where((length > 0) & (buf[np.minimum(at, len(buf) - 1)] != 255), length, 0)
    qual = pa.ListArray.from_arrays(pa.array(_offsets(known)), pa.array(buf[_places(at, known)].astype(np.int32)))
    none = len(refs) - 1
    of = lambda i: refs.take(pa.array(np.where(word[:, i] < 0, none, word[:, i])))
    column = lambda x: pa.array(np.ascontiguousarray(x).astype(np.int32))
    return pa.RecordBatch.from_arrays([names, column(half[:, 9]), of(1), column(word[:, 2]), column(head[:, 13]), cigar, of(6), column(word[:, 7]), letters, qual, pa.array(ord_)], schema=_ARROW)


@dataclass
class Split(InputPartition):
    """Bytes of a file; without a stop it is read by one task as plain gzip."""

    path: str
    start: int
    stop: int | None
    size: int


class BamReader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self) -> Sequence[InputPartition]:
        out: list[InputPartition] = []
        for path, size in listed(self.path):
            with opened(path) as file:
                blocked = member_size(file.read(1 << 16)) is not None
            cut = self.split if blocked and self.split else max(1, size)
            out += [Split(path, at, min(at + cut, size) if blocked else None, size) for at in range(0, size, cut)]
        return out

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        with opened(split.path) as file:
            stream = Inflated(chunks(file) if split.stop is None else members(file, 0, split.size), split.size, split.stop)
            names = header(stream)
            refs = pa.array([*names, "*"])
            if split.start:
                member, within = first_record(file, split.start, split.size, len(names))
                if member >= split.stop:
                    return
                stream = Inflated(members(file, member, split.size), split.size, split.stop)
                stream.take(within)
            for data, starts, ord_ in records(stream):
                yield decoded(data, starts, ord_, refs)
            if split.stop is not None and split.stop < split.size and stream.where(0) != first_record(file, split.stop, split.size, len(names)):
                raise ValueError(f"{split.path}: records can not be told from byte {split.stop} on; read it with splitBytes 0")


def encoded(row: dict, ids: dict[str, int]) -> bytes:
    """A record: fixed fields, name, operations, letters of four bits, qualities."""
    seq = "" if row["seq"] in (None, "*") else row["seq"]
    cigar = row["cigar"] or []
    name = row["read_id"].encode() + b"\0"
    end = row["pos"] + max(1, sum(x["len"] for x in cigar if x["op"] in "MDN=X"))
    codes = [LETTERS.find(x) if x in LETTERS else 15 for x in seq.upper()]
    packed = bytes(a << 4 | b for a, b in zip(codes[::2], [*codes[1::2], 0], strict=False))
    qual = bytes(row["qual"]) if row["qual"] else b"\xff" * len(seq)
    fixed = struct.pack("<iiBBHHHiiii", ids.get(row["ref"], -1), row["pos"], len(name), row["mapq"], index_bin(row["pos"], end), len(cigar), row["flags"], len(seq), ids.get(row["mate_ref"], -1), row["mate_pos"], 0)
    body = fixed + name + b"".join(struct.pack("<I", x["len"] << 4 | OPERATIONS.index(x["op"])) for x in cigar) + packed + qual
    return struct.pack("<i", len(body)) + body


def index_bin(start: int, end: int) -> int:
    """The smallest bin of the format's six levels that holds the interval: 8 bins of each level in one of the next."""
    for level in range(5, 0, -1):
        shift = 14 + 3 * (5 - level)
        if start >> shift == (end - 1) >> shift:
            return (8**level - 1) // 7 + (start >> shift)
    return 0


def member(data: bytes) -> bytes:
    press = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = press.compress(data) + press.flush()
    return MEMBER + bytes(5) + b"\xff" + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


@dataclass
class Written(WriterCommitMessage):
    path: str | None


class BamWriter(DataSourceArrowWriter):
    """A file a task under a name of its own; the driver gives them their final names when all are written."""

    def __init__(self, path: str, references: list[tuple[str, int]]):
        self.path, self.references = path, references

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, base = system_of(self.path)
        system.create_dir(base, recursive=True)
        path = f"{base}/_{uuid.uuid4().hex}.tmp"
        ids = {name: i for i, (name, _) in enumerate(self.references)}
        held = bytearray(MAGIC + struct.pack("<ii", 0, len(ids)))
        for name, length in self.references:
            held += struct.pack("<i", len(name.encode()) + 1) + name.encode() + b"\0" + struct.pack("<i", length)
        with system.open_output_stream(path, compression=None) as out:
            for batch in batches:
                for row in batch.to_pylist():
                    held += encoded(row, ids)
                    while len(held) > MEMBER_BYTES:
                        out.write(member(bytes(held[:MEMBER_BYTES])))
                        del held[:MEMBER_BYTES]
            if held:
                out.write(member(bytes(held)))
            out.write(END_OF_FILE)
        return Written(path)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, base = system_of(self.path)
        for i, m in enumerate(m for m in messages if m is not None):
            system.move(m.path, f"{base}/part-{i:05d}.bam")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, _ = system_of(self.path)
        for m in messages:
            if m is not None:
                system.delete_file(m.path)


class BamSource(DataSource):
    """Options: path; splitBytes (0: a task a file); references, for writing, as name:length, comma-joined."""

    @classmethod
    def name(cls) -> str:
        return "lociwave_bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return BamReader(self.options["path"], int(self.options.get("splitBytes", RANGE_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        given = [x.rsplit(":", 1) for x in self.options.get("references", "").split(",") if x]
        return BamWriter(self.options["path"], [(name, int(length)) for name, length in given])


def write(df: DataFrame, path: str) -> None:
    """Alignments as BAM files, one a task; the references are those of the rows, which a header lists anyway, as long as their last record reaches."""
    from pyspark.sql import functions as F

    columns = [x.split(" ")[0] for x in SCHEMA.replace("struct<op:string,len:int>", "").split(", ")]
    spans = df.select("ref", (F.col("pos") + F.greatest(F.length("seq"), F.lit(1))).alias("end")).union(df.select("mate_ref", F.col("mate_pos") + 1)).where("ref <> '*'")
    refs = sorted((r["ref"], r["end"]) for r in spans.groupBy("ref").agg(F.max("end").alias("end")).collect())
    df.sparkSession.dataSource.register(BamSource)
    out = df.select(*[F.col(c).cast(t) for c, t in zip(columns[:-1], ("string", "int", "string", "int", "int", "array<struct<op:string,len:int>>", "string", "int", "string", "array<int>"), strict=True)], F.lit(0).cast("long").alias("ord"))
    out.write.format("lociwave_bam").mode("append").option("references", ",".join(f"{n}:{e}" for n, e in refs)).save(path)
