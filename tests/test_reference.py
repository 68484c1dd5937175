"""References in blocks: any block size and any cut of the files gives the plain slices."""

import random

import pytest

from lociwave.sources import readers, reference


@pytest.mark.parametrize("size", [1, 7, 64, 5000])
def test_slices_over_borders(spark, size):
    rng = random.Random(size)
    seqs = {f"a{i}": "".join(rng.choice("ACGT") for _ in range(n)) for i, n in enumerate((0, 1, 63, 64, 65, 300))}
    store = reference.stored(spark.createDataFrame(list(seqs.items()), "accession string, seq string"), size).cache()
    assert max(len(r.text) for r in store.collect()) <= size
    assert {r.accession: r.length for r in reference.lengths(store, size).collect()} == {k: len(v) for k, v in seqs.items() if v}
    spans = [(i, f"a{rng.randrange(7)}", s := rng.randrange(-5, 320), s + rng.randrange(-3, 120)) for i in range(120)]
    df = spark.createDataFrame(spans, "k long, accession string, start long, end long")
    want = {k: t for k, a, s, e in spans if (t := seqs.get(a, "")[max(s, 0) : max(e, 0)] if e > s else "")}
    assert {r.k: r.text for r in reference.sliced(store, df, "k", size).collect()} == want
    turned = [(i, "a5", s, e) for i, (s, e) in enumerate([(0, 300), (290, 10), (5, 5), (299, 1), (10, 20)])]
    found = reference.circular(store, spark.createDataFrame(turned, "k long, accession string, start long, end long"), "k", size)
    x = seqs["a5"]
    assert {r.k: r.text for r in found.collect()} == {i: x[s:e] if e > s else x[s:] + x[:e] for i, _, s, e in turned}


def test_fasta_and_profiles_in_blocks(spark, tmp_path):
    rng = random.Random(3)
    seqs = {f"NC_{i}": "".join(rng.choice("ACGTN") for _ in range(n)) for i, n in enumerate((200, 1, 999))}
    for i, names in enumerate((["NC_0", "NC_1"], ["NC_2"])):
        text = "".join(f">{n} a note\n" + "\n".join(seqs[n][k : k + 60] for k in range(0, len(seqs[n]), 60)) + "\n\n" for n in names)
        (tmp_path / f"{i}.fna").write_text(text)
    store = reference.stored_fasta(spark, f"{tmp_path}/*.fna", 50)
    assert {(r.accession, r.block): r.text for r in store.collect()} == {(n, k // 50): x[k : k + 50] for n, x in seqs.items() for k in range(0, len(x), 50)}
    kinds = {n: bytes(rng.choice([0, 1, 2, 4, 8]) for _ in x) for n, x in seqs.items()}
    for n, k in kinds.items():
        (tmp_path / f"{n}.pos").write_bytes(k)
    (tmp_path / "empty.pos").write_bytes(b"")
    store = reference.stored_profile(spark, f"{tmp_path}/*.pos", 50)
    assert {(r.accession, r.block): r.text for r in store.collect()} == {(n, i // 50): "".join(map(str, k[i : i + 50])) for n, k in kinds.items() for i in range(0, len(k), 50)}
    for cut in (1, 64, 1 << 20):
        rows = readers.position_profile(spark, f"{tmp_path}/NC_2.pos", max(cut, 13)).collect()
        assert sorted((r.pos, r.pos_type) for r in rows) == list(enumerate(kinds["NC_2"]))
