"""Byte-level BPE encoding and decoding by overlapping chunks.

Texts longer than ``chunk_chars`` characters are cut into chunks that overlap; the
chunks are pre-tokenised in parallel, each from its own start. In an overlap the
two chunks' pre-token boundaries meet again; from the first common boundary on the
later chunk is right too, since the pattern looks at nothing before a match.
Each chunk then encodes the piece between its two meeting points. A text with an
overlap in which no boundaries meet (one pre-token longer than the overlap) is
encoded as a whole. A text of one chunk is its own piece and takes no shuffle.
Decoding concatenates the tokens' bytes.

Null texts count as empty; very long texts are many pieces, but a single pre-token
stays whole and costs what the library takes for it; repeated rows stay; an empty
table gives no rows; bytes that are not UTF-8 are read as replacement characters;
columns that already have an output's name are replaced.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, list_array, slices, strings, table, written

VOCABULARY = "byte_bpe_50k.tiktoken"
CHUNK_CHARS = 16_384
OVERLAP_CHARS = 512
#: A boundary this near to a chunk's cut end may differ in the whole text: a contraction looks two characters ahead.
GUARD_CHARS = 4
# Fixed values of the pattern: what stands behind the apostrophe of a contraction.
CONTRACTED = frozenset({"s", "t", "re", "ve", "m", "ll", "d"})
#: Control characters that some engines take for white space: no cut behind them.
SEPARATORS = np.arange(0x1C, 0x20, dtype=np.uint32)
#: Chunks that are sent on, and ids that are lists of Python, at once.
CHUNKS_AT_ONCE = 64
IDS_AT_ONCE = 1 << 16


@lru_cache(maxsize=2)
def encoder(vocabulary: str):
    """The tiktoken encoding of a public vocabulary file, once per process.

    Its end mark is never allowed in a text, so that it stands for its characters;
    with no special token at all the library would look for the empty one at every byte.
    """
    import public_tokenizers as P
    import tiktoken

    with open(P.path(vocabulary), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(vocabulary, pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": max(ranks.values()) + 1})


@lru_cache(maxsize=2)
def token_bytes(vocabulary: str) -> list[bytes]:
    own = encoder(vocabulary)
    return [own.decode_single_token_bytes(i) for i in range(own.n_vocab)]


def encode_text(text: str | None, vocabulary: str = VOCABULARY) -> np.ndarray:
    return encoder(vocabulary).encode_to_numpy(text, disallowed_special=()).astype(np.int32) if text else np.zeros(0, np.int32)


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """The kind of every code point in the pattern: 0 letter, 1 number, 2 other, 3 white space."""
    import regex

    # By blocks: a string object for each of all code points would take 100 MB for a moment.
    out = np.full(0x110000, 2, np.uint8)
    for start in range(0, len(out), 4096):
        block = "".join(map(chr, range(start, start + 4096)))
        for kind, name in ((0, r"\p{L}+"), (1, r"\p{N}+"), (3, r"\s+")):
            for m in regex.finditer(name, block):
                out[start + m.start() : start + m.end()] = kind
    return out


def boundaries(piece: str, whole_end: bool) -> np.ndarray:
    """Where a piece may be cut: ends of pre-tokens, without those its own cut end may have moved.

    A pre-token that does not end in white space is a whole run of letters, numbers
    or others (a blank before it is its first character), or a contraction: an
    apostrophe that begins a pre-token, that is one behind no other and no blank,
    with its letters. Ends of white space are no cuts: how a run of it is split
    depends on what follows, and a piece that ended there would split it otherwise.
    """
    points = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(points)
    kind = kinds()[points]
    is_end = np.zeros(n + 1, bool)
    is_end[1:n] = kind[1:] != kind[:-1]
    is_end[n] = n > 0
    for k in np.flatnonzero(points == ord("'")).tolist():
        if (k == 0 or kind[k - 1] != 2 and piece[k - 1] != " ") and (size := 2 * (piece[k + 1 : k + 2] in CONTRACTED) or 3 * (piece[k + 1 : k + 3] in CONTRACTED)):
            is_end[k + 1] = False
            is_end[k + size] = True
    ends = np.flatnonzero(is_end)
    ends = ends[(kind[ends - 1] != 3) & ~np.isin(points[ends - 1], SEPARATORS)].astype(np.int32)
    return ends if whole_end else ends[ends <= n - GUARD_CHARS]


def bytes_of(ids: list[int] | np.ndarray, vocabulary: str = VOCABULARY) -> bytes:
    return b"".join(map(token_bytes(vocabulary).__getitem__, ids))


def bytes_of_array(ids: pa.Array | None, vocabulary: str = VOCABULARY) -> bytes:
    """The bytes of one row's ids, of which few at a time are Python's integers."""
    return b"".join(bytes_of(ids.slice(i, IDS_AT_ONCE).to_pylist(), vocabulary) for i in range(0, 0 if ids is None else len(ids), IDS_AT_ONCE))


def encode_rows(df: DataFrame, text_col: str, ids_col: str, vocabulary: str, bytes_col: str | None = None) -> DataFrame:
    """The rows with ``ids_col``, and the bytes that the ids decode to if asked for, in place of ``text_col``; one task holds each text whole."""
    rest = [c for c in df.columns if c.lower() not in (text_col.lower(), ids_col.lower())]
    made = [T.StructField(ids_col, T.ArrayType(T.IntegerType(), False)), *([T.StructField(bytes_col, T.BinaryType())] if bytes_col else [])]
    schema = T.StructType([df.schema[c] for c in rest] + made)
    df = df.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text_col}`").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in slices(big, "__text"):
                ids = [encode_text(x, vocabulary) for x in strings(batch.column("__text"))]
                columns = [list_array(ids, pa.int32()), *([pa.array([bytes_of(x.tolist(), vocabulary) for x in ids], pa.binary())] if bytes_col else [])]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *columns], [*rest, *(x.name for x in made)])

    return df.mapInArrow(run, schema)


def cut_texts(batches: Iterator[pa.RecordBatch], chunk_chars: int, overlap_chars: int, everywhere: bool) -> Iterator[pa.RecordBatch]:
    """(row, n, k, start, piece, rest): the overlapping chunks of each text of (row, rest, text), a few at a time."""
    step = chunk_chars - overlap_chars
    for big in batches:
        for batch in slices(big, "text"):
            texts = strings(batch.column("text"))
            sizes = [len(range(0, max(1, len(x) - overlap_chars), step)) for x in texts]
            for some in batched(((i, k) for i, n in enumerate(sizes) for k in range(n)), CHUNKS_AT_ONCE):
                numbers = [pa.array(x, pa.int32()) for x in ([sizes[i] for i, _ in some], [k for _, k in some], [k * step for _, k in some])]
                own = pa.array([texts[i][k * step : k * step + chunk_chars] for i, k in some], pa.string())
                row = batch.column("row").take(pa.array([i for i, _ in some], pa.int64()))
                rest = batch.column("rest").take(pa.array([i if everywhere or k == 0 else None for i, k in some], pa.int64()))
                yield pa.RecordBatch.from_arrays([row, *numbers, own, rest], ["row", "n", "k", "start", "piece", "rest"])


def ends_of(batches: Iterator[pa.RecordBatch], overlap_chars: int) -> Iterator[pa.RecordBatch]:
    """The chunks with ``e``, the boundaries inside their overlaps, in place of the piece."""
    for big in batches:
        for batch in slices(big, "piece"):
            whole_end = (k == n - 1 for k, n in zip(batch.column("k").to_pylist(), batch.column("n").to_pylist(), strict=True))
            found = ((len(x), boundaries(x, y)) for x, y in zip(strings(batch.column("piece")), whole_end, strict=True))
            e = list_array([e[(e < overlap_chars) | (e >= n - overlap_chars)] for n, e in found], pa.int32())
            names = ["row", "k", "n", "start", "size"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), e], [*names, "e"])


def pieces(df: DataFrame, text_col: str, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS, everywhere: bool = False) -> tuple[DataFrame, DataFrame]:
    """(row, rest, k, last, piece): each text as the pieces that may be encoded apart; and the table of chunks, to be deleted once these are read.

    ``rest`` holds the other columns, in a text's first piece or ``everywhere``; (row, k) orders the pieces.
    """
    if chunk_chars <= 2 * overlap_chars or overlap_chars < 4 * GUARD_CHARS:
        raise ValueError("a chunk must be longer than two overlaps, an overlap than four guards")
    rest = [c for c in df.columns if c.lower() != text_col.lower()]

    text = F.col(f"`{text_col}`")
    is_long = F.coalesce(F.length(text) > chunk_chars, F.lit(False))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in rest], F.lit(True).alias("__kept")).alias("rest"), text.alias("text"), is_long.alias("is_long"))
    short = rows.where("not is_long").select(F.monotonically_increasing_id().alias("row"), "rest", F.lit(0).alias("k"), F.lit(True).alias("last"), F.coalesce("text", F.lit("")).alias("piece"))

    # The number of a row is made once and kept: the chunks are read from the written table. Negative, so that no short text has it.
    cuts = rows.where("is_long").select((-1 - F.monotonically_increasing_id()).alias("row"), "rest", "text")
    made = T.StructType([T.StructField("row", T.LongType()), *[T.StructField(c, T.IntegerType()) for c in ("n", "k", "start")], T.StructField("piece", T.StringType()), T.StructField("rest", cuts.schema["rest"].dataType)])
    chunks = written(cuts.mapInArrow(lambda batches: cut_texts(batches, chunk_chars, overlap_chars, everywhere), made), "bpe-chunks")

    met = chunks.select("row", "k", "n", "start", F.length("piece").alias("size"), "piece")
    met = met.mapInArrow(lambda batches: ends_of(batches, overlap_chars), "row long, k int, n int, start int, size int, e array<int>")
    met = met.select("row", "k", "n", "start", "size", F.transform(F.filter("e", lambda x: x < overlap_chars), lambda x: x + F.col("start")).alias("left"), F.transform(F.filter("e", lambda x: x >= F.col("size") - overlap_chars), lambda x: x + F.col("start")).alias("right"))
    order = Window.partitionBy("row").orderBy("k")
    met = met.withColumn("cut", F.array_min(F.array_intersect("right", F.lead("left").over(order))))
    met = met.select("row", "k", "start", "size", F.lag("cut").over(order).alias("from"), F.col("cut").alias("to"), F.lead("start").over(order).alias("next"), F.min((F.col("cut").isNotNull() | (F.col("k") == F.col("n") - 1)).cast("int")).over(Window.partitionBy("row")).alias("ok"))
    met = met.select("row", "k", "ok", F.when(F.col("ok") == 1, F.coalesce(F.col("from") - F.col("start"), F.lit(0))).otherwise(0).alias("lo"), F.when(F.col("ok") == 1, F.coalesce(F.col("to") - F.col("start"), F.col("size"))).otherwise(F.coalesce(F.col("next") - F.col("start"), F.col("size"))).alias("hi"))
    own = chunks.join(met, ["row", "k"]).select("row", "k", "ok", "rest", (F.col("k") == F.col("n") - 1).alias("last"), F.substring("piece", F.col("lo") + 1, F.col("hi") - F.col("lo")).alias("piece"))
    apart = own.where("ok = 1").select("row", "rest", "k", "last", "piece")
    whole = own.where("ok = 0").groupBy("row").agg(F.first("rest", ignorenulls=True).alias("rest"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "piece"))), lambda x: x["piece"]), "").alias("piece"))
    whole = whole.select("row", "rest", F.lit(0).alias("k"), F.lit(True).alias("last"), "piece")
    return short.unionByName(apart).unionByName(whole), chunks


def encode(df: DataFrame, text_col: str = "text", ids_col: str = "token_ids", vocabulary: str = VOCABULARY, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS, bytes_col: str | None = None) -> DataFrame:
    """The rows with their token ids (array of int), and if asked for the bytes that these decode to, in place of the text.

    Texts of up to ``chunk_chars`` characters are one piece and stay in their task; this is a choice of plan, the ids are the same.
    """
    rest = [c for c in df.columns if c.lower() not in (text_col.lower(), ids_col.lower(), (bytes_col or text_col).lower())]
    df = df.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text_col}`"))
    is_long = F.coalesce(F.length(F.col(f"`{text_col}`")) > chunk_chars, F.lit(False))
    short = encode_rows(df.where(~is_long), text_col, ids_col, vocabulary, bytes_col)
    cut, _ = pieces(df.where(is_long), text_col, chunk_chars, overlap_chars)
    apart = encode_rows(cut.select("row", "k", "rest", "piece"), "piece", "ids", vocabulary)
    apart = apart.groupBy("row").agg(F.first("rest", ignorenulls=True).alias("rest"), F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"])).alias("ids"))
    apart = apart.select(*[F.col("rest").getField(c).alias(c) for c in rest], F.col("ids").alias(ids_col))
    return short.unionByName(decode(apart, ids_col, bytes_col, vocabulary) if bytes_col else apart)


def decode(df: DataFrame, ids_col: str = "token_ids", bytes_col: str = "decoded", vocabulary: str = VOCABULARY) -> DataFrame:
    """The rows with the bytes that their ids stand for; null ids give no bytes."""

    @F.arrow_udf("binary")
    def joined(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield pa.array((bytes_of_array(x.values, vocabulary) for x in column), pa.binary())
            give_back()

    return df.withColumn(bytes_col, joined(F.col(f"`{ids_col}`")))


def digests(df: DataFrame) -> DataFrame:
    ids = F.array_join(F.col("token_ids").cast("array<string>"), " ")
    return df.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document's ids and of the bytes they decode to."""
    return digests(encode(table(spark, sf_dir, "documents").select("doc_id", "text"), bytes_col="decoded"))
