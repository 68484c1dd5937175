"""Search and alignment against brute force, the strain filters on edge cases."""

import random

import numpy as np
import pytest
from compare import DATA
from pyspark.sql import functions as F

from lociwave.operators import align, genomes, search
from lociwave.plans import catalog


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def changed(rnd, seq, letters, n):
    seq = list(seq)
    for _ in range(n):
        i = rnd.randrange(len(seq) + 1)
        kind = rnd.randrange(3)
        if kind == 0 or not seq:
            seq.insert(i, rnd.choice(letters))
        elif kind == 1:
            seq.pop(min(i, len(seq) - 1))
        else:
            seq[min(i, len(seq) - 1)] = rnd.choice(letters)
    return "".join(seq)


@pytest.mark.parametrize(("least", "letters"), [(80, "ACDEFGHIKLMNPQRSTVWY"), (80, "AC"), (90, "ACGT"), (60, "ACDEF"), (100, "AC")])
def test_similar_is_whole(spark, least, letters):
    """All lengths from one letter on, equal and repeated sequences, null and empty ones."""
    rnd = random.Random(least)
    base = ["".join(rnd.choice(letters) for _ in range(n)) for n in [*range(1, 31), 60, 61, 90, 150]]
    ours = [None, "", *base, *(changed(rnd, s, letters, rnd.randrange(1 + len(s) // 4)) for s in base * 2)]
    theirs = [None, "", *(changed(rnd, s, letters, rnd.randrange(1 + len(s) // 5)) for s in base * 2), *base, *base[:5]]
    q = spark.createDataFrame(list(enumerate(ours)), "id long, seq string")
    s = spark.createDataFrame([(1000 + i, x) for i, x in enumerate(theirs)], "id long, seq string")
    first = lambda rows, off: {x: off + i for i, x in reversed(list(enumerate(rows))) if x}
    want = {}
    for x, i in first(ours, 0).items():
        for y, j in first(theirs, 1000).items():
            d = edits(x, y)
            if 100 * (max(len(x), len(y)) - d) >= least * max(len(x), len(y)):
                want[i, j] = d
    assert {(r.q, r.s): r.distance for r in search.similar(q, s, least).collect()} == want
    best = {}
    for i, x in enumerate(ours):
        if x:
            hits = [(d / max(len(x), len(theirs[j - 1000])), j) for (k, j), d in want.items() if k == first(ours, 0)[x]]
            if hits:
                best[i] = min(hits)[1]
    assert {r.q: r.s for r in search.top_hits(q, s, least).collect()} == best


def no_broadcast_of_pieces(found):
    """Few sequences are small until they are cut; their pieces are dealt to all tasks and stay off the driver."""
    plan = found._jdf.queryExecution().executedPlan().toString()
    joins = [x for x in plan.split("== Initial Plan ==")[0].splitlines() if "Join" in x]
    assert not [x for x in joins if "BroadcastHashJoin" in x and ("gram" in x or "piece" in x)]
    assert len([x for x in joins if "SortMergeJoin" in x and "piece" in x]) == 2


def some_proteins(spark):
    return spark.range(400).selectExpr("id", "translate(concat(md5(id || ''), md5(id || 'x')), '0123456789abcdef', 'ACDEFGHIKLMNPQRS') AS seq")


def test_pieces_of_a_search_are_no_broadcast(spark):
    rows = some_proteins(spark)
    found = search.similar(rows.where("id % 2 = 0"), rows)
    assert sorted((r.q, r.s, r.distance) for r in found.collect()) == [(i, i, 0) for i in range(0, 400, 2)]
    no_broadcast_of_pieces(found)


def test_pieces_of_top_hits_are_no_broadcast(spark):
    rows = some_proteins(spark)
    found = search.top_hits(rows.where("id % 2 = 1"), rows)
    assert sorted((r.q, r.s, r.identity) for r in found.collect()) == [(i, i, 1.0) for i in range(1, 400, 2)]
    no_broadcast_of_pieces(found)


def test_search_of_empty_tables(spark):
    none = spark.createDataFrame([], "id long, seq string")
    some = spark.createDataFrame([(1, "ACGT")], "id long, seq string")
    assert search.similar(none, some).count() == search.similar(some, none).count() == search.top_hits(some, none).count() == 0
    with pytest.raises(ValueError, match="percentage"):
        search.similar(some, some, 0)


def score(a, b):
    row = [-2 * j for j in range(len(b) + 1)]
    for i, x in enumerate(a):
        new = [-2 * (i + 1)]
        for j, y in enumerate(b):
            new.append(max(row[j] + (2 if x == y else -1), row[j + 1] - 2, new[j] - 2))
        row = new
    return row[-1]


def of_pairs(a, b, pairs):
    return sum(2 if a[i] == b[j] else -1 for i, j in pairs) - 2 * (len(a) + len(b) - 2 * len(pairs))


@pytest.mark.parametrize("cells", [1 << 20, 30])
def test_pairs_are_best_alignments(monkeypatch, cells):
    """The whole table and halves alike, for all lengths, empty ones among them."""
    monkeypatch.setattr(align, "CELLS", cells)
    rnd = random.Random(3)
    for n in range(40):
        a, b = ("".join(rnd.choice("ACG") for _ in range(rnd.randrange(n + 1))) for _ in range(2))
        pairs = align.aligned_pair(np.array([ord(x) for x in a]), np.array([ord(x) for x in b]))
        assert pairs == sorted(pairs) and len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)
        assert of_pairs(a, b, pairs) == score(a, b)


def test_centre_alignment(spark):
    """Rows of a family are of equal length and hold their own letters; against the centre each is a best alignment."""
    rnd = random.Random(5)
    rows = [(1, "x", "ACGTACGT"), (1, "y", None), (1, "z", ""), (2, "only", "MKV"), (3, "p", None), (5, "e", ""), (5, "f", "AC")]
    base = "".join(rnd.choice("ACDEFGHIKL") for _ in range(60))
    rows += [(4, f"m{i}", changed(rnd, base, "ACDEFGHIKL", i)) for i in range(9)]
    found = align.centre_alignment(spark.createDataFrame(rows, "family_id long, id string, seq string")).collect()
    assert len(found) == len(rows)
    seqs = {(f, i): s or "" for f, i, s in rows}
    for family in {1, 2, 3, 4, 5}:
        own = {r.id: r.aligned for r in found if r.family_id == family}
        assert len({len(x) for x in own.values()}) == 1
        assert all(x.replace("-", "") == seqs[family, i] for i, x in own.items())
    lengths = sorted(len(s) for (f, _), s in seqs.items() if f == 4)
    centre = min((abs(len(s) - lengths[4]), i) for (f, i), s in seqs.items() if f == 4)[1]
    four = {r.id: r.aligned for r in found if r.family_id == 4}
    for i, x in four.items():
        both = [(a, b) for a, b in zip(four[centre], x, strict=True) if (a, b) != ("-", "-")]
        assert sum(-2 if "-" in ab else 2 if ab[0] == ab[1] else -1 for ab in both) == score(seqs[4, centre], seqs[4, i])


def test_codons_follow_the_aligned_protein(spark):
    rows = catalog.QUERIES["family_alignment"](spark, DATA).toPandas()
    assert len(rows) and all(c == "".join("---" if x == "-" else x * 3 for x in a) for a, c in zip(rows["aligned"], rows["codons"], strict=True))


def test_strain_filters_on_unknown_values(spark):
    rows = spark.createDataFrame([(1, None, "x", None, "chromosome"), (2, "p", " complete ", "s", "CHROMOSOME"), (3, "p", None, "s", None), (4, "p", "Complete ", "s", "the chromosome 2")], "id long, path string, status string, species string, replicon string")
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(genomes.known_strains(rows)) == [2, 4]
    assert ids(genomes.known_strains(rows, complete=True)) == [2, 4]
    assert ids(genomes.unjoined_strains(rows)) == [1, 2, 3]
    assert ids(genomes.chromosomes(rows)) == [1, 4]
    assert genomes.chromosomes(rows.where(F.lit(False))).count() == 0
