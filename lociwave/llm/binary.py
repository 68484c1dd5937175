"""Training-order materialisation: keyed Feistel slots and fixed-stride shards.

Token ids are packed into sequences of ``LENGTH`` ids, documents one after another
in the order of their ids, with an end mark after each. Every sequence has a dense
number; a keyed Feistel network over the next even power of two, walked until it
falls below the number of sequences, is a permutation and gives each its global
slot. Shards are ranges of ``SHARD`` slots, one range a task, of ``2 * LENGTH``
bytes a sequence (uint16, little endian), so that slot s stands in shard
``s // SHARD`` at byte ``s % SHARD * 2 * LENGTH``: a reader resumes anywhere by
arithmetic. Shards are written under a fresh name and then moved; a repeated
task writes the same bytes.

Documents are encoded in pieces, the pieces brought into order by range partitions,
and each one's place in the stream of tokens follows from the token counts before
it; a piece is then cut where sequences end. So the shards depend on the documents
alone, not on splits, cores or arrival, and a very long text or a hot id is spread
over tasks. Null ids come first; rows that repeat an id follow one another in the
order of their texts' hashes. Null and empty texts are an end mark alone; the last
sequence is filled up with end marks, which ``n_tokens`` does not count. An id
beyond uint16 is an error. An empty table gives no shards; other columns, whatever
their names, are not read.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import CHUNK_CHARS, VOCABULARY, encode_text, pieces
from .common import delete, file_system, free_shuffles, mix64, numbered, scratch_path, slices, strings, table, written

LENGTH = 2048
SHARD = 4096
END = 50_256
KEY = 20_240_229
FEISTEL_ROUNDS = 6
#: Ranges of shards written one after another, so that the shuffle holds a part of the tokens only.
WAVES = 2


def _half_bits(n: int) -> int:
    return max(1, ((max(1, n - 1)).bit_length() + 1) // 2)


def _round(x: np.ndarray, key: int, turn: int, mask: int) -> np.ndarray:
    return mix64(x + np.uint64((key * 0x9E3779B97F4A7C15 + turn * 0xD6E8FEB86659FD93) % (1 << 64))) & np.uint64(mask)


def permuted(x: np.ndarray, n: int, key: int = KEY, inverse: bool = False) -> np.ndarray:
    """The slot of each number below n (or back): Feistel rounds, walked until below n."""
    half = _half_bits(n)
    mask, shift = (1 << half) - 1, np.uint64(half)
    out = np.asarray(x).astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        v = out[todo]
        left, right = v >> shift, v & np.uint64(mask)
        for turn in reversed(range(FEISTEL_ROUNDS)) if inverse else range(FEISTEL_ROUNDS):
            if inverse:
                left, right = right ^ _round(left, key, turn, mask), left
            else:
                left, right = right, left ^ _round(right, key, turn, mask)
        out[todo] = left << shift | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def stream(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, end: int = END, chunk_chars: int = CHUNK_CHARS) -> tuple[DataFrame, int]:
    """(doc_id, n, ids, at), the number of tokens: pieces of the documents' ids (uint16 under zstd), each with its place in the stream; an end mark closes a document."""
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(F.col(f"`{text_col}`")).alias("hash"), F.col(f"`{text_col}`").cast("string").alias("text"))
    cut, chunks = pieces(rows, "text", chunk_chars, everywhere=True)
    cut = cut.select("row", "k", "last", "rest.doc_id", "rest.hash", "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=3)
        for big in batches:
            for batch in slices(big, "piece"):
                found = [np.append(encode_text(x, vocabulary), end) if y else encode_text(x, vocabulary) for x, y in zip(strings(batch.column("piece")), batch.column("last").to_pylist(), strict=True)]
                if max((x.max(initial=0) for x in found), default=0) >= 1 << 16:
                    raise ValueError("a token id does not fit into uint16")
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "k", "doc_id", "hash")), pa.array([len(x) for x in found], pa.int32()), pa.array([pack.compress(x.astype("<u2").tobytes()) for x in found], pa.binary())], ["row", "k", "doc_id", "hash", "n", "ids"])

    coded = written(cut.mapInArrow(run, "row long, k int, doc_id long, hash long, n int, ids binary"), "bin-pieces")
    delete(chunks)
    free_shuffles(df.sparkSession)
    rows, total = numbered(coded, ["doc_id", "hash", "row", "k"], "n", "bin-stream")
    delete(coded)
    free_shuffles(df.sparkSession)
    return rows.select("doc_id", "n", "ids", "at"), total


def materialise(df: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, length: int = LENGTH, shard: int = SHARD, key: int = KEY, end: int = END, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Writes the shards and a manifest; one row (slot, shard, n_tokens, doc_ids) per sequence."""
    tokens, size = stream(df, id_col, text_col, vocabulary, end, chunk_chars)
    total = -(-size // length)

    shards = -(-total // shard)
    bounds = [shards * i // WAVES for i in range(WAVES + 1)]

    def cut(batches: Iterator[pa.RecordBatch], lo: int, hi: int) -> Iterator[pa.RecordBatch]:
        """The pieces of the sequences whose shards are from lo to below hi."""
        import zstandard

        pack, unpack = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
        for batch in batches:
            first, n = batch.column("at").to_numpy(), batch.column("n").to_numpy().astype(np.int64)
            # Every sequence that a piece has a part of, with the part's place in the piece.
            count = np.where(n > 0, (first + n - 1) // length - first // length + 1, 0)
            piece = np.repeat(np.arange(len(n)), count)
            number = first[piece] // length + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            slot = permuted(number, total, key)
            begin = np.maximum(number * length, first[piece])
            stop = np.minimum((number + 1) * length, (first + n)[piece])
            mine = np.flatnonzero((slot // shard >= lo) & (slot // shard < hi))
            ids, parts, held, data = batch.column("ids"), [], -1, b""
            for i in mine.tolist():
                if piece[i] != held:
                    held = int(piece[i])
                    data = unpack.decompress(ids[held].as_py())
                parts.append(pack.compress(data[2 * int(begin[i] - first[held]) : 2 * int(stop[i] - first[held])]))
            yield pa.RecordBatch.from_arrays([pa.array(slot[mine]), pa.array(slot[mine] // shard), pa.array((begin - number * length)[mine].astype(np.int32)), batch.column("doc_id").take(pa.array(piece[mine])), pa.array(parts, pa.binary())], ["slot", "shard", "start", "doc_id", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        unpack = zstandard.ZstdDecompressor()
        out, own, path, count = None, -1, "", 0
        slot, held, docs = -1, [], []
        rows: list[tuple] = []

        def close() -> None:
            out.close()
            if count != min(shard, total - own * shard):
                raise ValueError(f"shard {own} holds {count} sequences")
            fs.move(path, f"{base}/shard-{own:08d}.bin")

        def put() -> None:
            """One whole sequence to its shard."""
            nonlocal out, own, path, count
            if slot // shard != own:
                if out is not None:
                    close()
                own, path, count = slot // shard, f"{base}/{uuid.uuid4().hex}.tmp", 0
                out = fs.open_output_stream(path, compression=None)
            data = b"".join(held)
            out.write(data + np.full(length - len(data) // 2, end, "<u2").tobytes())
            count += 1
            rows.append((slot, own, len(data) // 2, list(docs)))

        def flush() -> pa.RecordBatch:
            found = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64())), strict=True)], ["slot", "shard", "n_tokens", "doc_ids"])
            rows.clear()
            return found

        for batch in batches:
            for at, doc, ids in zip(batch.column("slot").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                if at != slot:
                    if held:
                        put()
                    slot, held, docs = at, [], []
                held.append(unpack.decompress(ids.as_py()))
                if not docs or docs[-1] != doc:
                    docs.append(doc)
            if rows:
                yield flush()
        if held:
            put()
            close()
            yield flush()

    index = []
    for lo, hi in zip(bounds, bounds[1:], strict=False):
        if lo < hi or not shards and not index:
            dealt = tokens.mapInArrow(lambda batches, lo=lo, hi=hi: cut(batches, lo, hi), "slot long, shard long, start int, doc_id long, ids binary")
            dealt = dealt.repartitionById(max(1, hi - lo), (F.col("shard") - lo).cast("int")).sortWithinPartitions("slot", "start")
            index.append(written(dealt.mapInArrow(run, "slot long, shard long, n_tokens int, doc_ids array<long>"), "bin-index"))
            free_shuffles(df.sparkSession)
    index = reduce(DataFrame.unionByName, index)
    delete(tokens)
    fs, base = file_system(folder)
    fs.create_dir(base, recursive=True)
    with fs.open_output_stream(f"{base}/manifest.json", compression=None) as out:
        out.write(json.dumps({"sequences": total, "length": length, "shard": shard, "key": key, "dtype": "<u2"}).encode())
    return index


def manifest(folder: str) -> dict:
    fs, base = file_system(folder)
    with fs.open_input_stream(f"{base}/manifest.json", compression=None) as file:
        return json.loads(file.read())


def read_slots(folder: str, first: int, count: int) -> np.ndarray:
    """The sequences of ``count`` slots from ``first``; reads nothing else, so a run resumes anywhere."""
    fs, base = file_system(folder)
    form = manifest(folder)
    stride, last = 2 * form["length"], min(first + count, form["sequences"])
    parts = []
    while first < last:
        k, at = divmod(first, form["shard"])
        n = min(last - first, form["shard"] - at)
        with fs.open_input_file(f"{base}/shard-{k:08d}.bin") as file:
            file.seek(at * stride)
            parts.append(np.frombuffer(file.read(n * stride), form["dtype"]))
        first += n
    return np.concatenate(parts).reshape(-1, form["length"]) if parts else np.zeros((0, form["length"]), form["dtype"])


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """(slot, sequence_sha256) of every sequence as it stands in the shards."""
    form = manifest(folder)
    total, shard = form["sequences"], form["shard"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column("id").to_pylist():
                last = min(total, (k + 1) * shard)
                for at in range(k * shard, last, 256):
                    found = read_slots(folder, at, min(256, last - at))
                    yield pa.RecordBatch.from_pydict({"slot": pa.array(np.arange(at, at + len(found)), pa.int64()), "sequence_sha256": [hashlib.sha256(x.tobytes()).hexdigest() for x in found]})

    shards = -(-total // shard)
    return spark.range(0, shards, 1, max(1, min(10_000, shards))).mapInArrow(run, "slot long, sequence_sha256 string")


def op5_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sequence of the tokenised documents with its slot, shard, documents and the digest of its bytes read back."""
    folder = scratch_path(spark, "bin-shards")
    index = materialise(table(spark, sf_dir, "documents").select("doc_id", "text"), folder)
    return index.join(read_digests(spark, folder), "slot").select("slot", "shard", "n_tokens", "doc_ids", "sequence_sha256")
