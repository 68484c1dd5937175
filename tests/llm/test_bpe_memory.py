"""Memory of the encoder's tasks: bounded by a piece, not by a batch, a document's ids or the table of code points."""

import tracemalloc

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import functions as F

from lociwave.llm import bpe


def peak(run):
    """MB that Python's objects take at once, and the result."""
    tracemalloc.start()
    try:
        found = run()
        return tracemalloc.get_traced_memory()[1] / 1e6, found
    finally:
        tracemalloc.stop()


def test_kinds_without_an_object_per_code_point():
    most, found = peak(bpe.kinds.__wrapped__)
    assert most < 20
    want = np.full(0x110000, 2, np.uint8)
    every = "".join(map(chr, range(0x110000)))
    for kind, name in ((0, r"\p{L}+"), (1, r"\p{N}+"), (3, r"\s+")):
        for m in regex.finditer(name, every):
            want[m.start() : m.end()] = kind
    assert (found == want).all()


def test_cuts_and_ends_leave_a_few_at_a_time():
    texts = [f"word{i} " * 40_000 for i in range(40)] + ["x" * 4_000_000]
    rest = pa.array([{"doc_id": i} for i in range(len(texts))])
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), rest, pa.array(texts)], ["row", "rest", "text"])
    found = {}

    def run():
        for out in bpe.cut_texts(iter([batch]), 1000, 100, False):
            assert out.num_rows <= bpe.CHUNKS_AT_ONCE
            for r in out.select(["row", "n", "k", "start", "rest"]).to_pylist():
                assert r["rest"] == ({"doc_id": r["row"]} if r["k"] == 0 else None)
                found[r["row"], r["k"]] = r["n"], r["start"]

    most, _ = peak(run)
    assert most < 10
    assert found == {(i, k): (n, k * 900) for i, x in enumerate(texts) for n in [-(-(len(x) - 100) // 900)] for k in range(n)}


def test_decoding_one_row_at_a_time(spark):
    ids = pa.array([[5, 6, 7] * 100_000] * 20, pa.list_(pa.int32()))
    most, found = peak(lambda: [bpe.bytes_of_array(x.values) for x in ids])
    assert most < 30
    assert found[0] == bpe.bytes_of([5, 6, 7]) * 100_000
    rows = spark.createDataFrame([(1, [5, 6, 7]), (2, []), (3, None)], "i int, token_ids array<int>")
    assert [bytes(r.decoded) for r in bpe.decode(rows).orderBy("i").collect()] == [bpe.bytes_of([5, 6, 7]), b"", b""]


def test_pieces_take_any_other_columns(spark):
    text = "Some words, a number 123 and it's more. " * 2000
    docs = spark.range(3).select("id", F.array(F.lit(1.5)).alias("a b"), F.map_from_arrays(F.array(F.lit("k")), F.array("id")).alias("m"), F.lit(text).alias("text"))
    rows = bpe.encode(docs, bytes_col="decoded").orderBy("id").collect()
    assert [(r.id, r["a b"], r.m) for r in rows] == [(i, [1.5], {"k": i}) for i in range(3)]
    assert all(bytes(r.decoded) == text.encode() and list(r.token_ids) == bpe.encode_text(text).tolist() for r in rows)
