"""The gene sweep against one that goes read by read."""

import random

import pytest

from lociwave.operators import reads


def swept(rows, genes):
    """Reads in file order against a list of genes that shrinks at its front."""
    out, own, now = [], [], None
    for ref, name, pos, end in rows:
        if ref != now:
            if not any(g[0] == ref for g in genes):
                continue
            now, own = ref, [(i, s - 1, e, []) for r, i, s, e in genes if r == ref]
        last = 0
        for k, (_, start, stop, held) in enumerate(own):
            if min(end, stop) > (pos if pos > start else start - 1):
                held.append(name)
            else:
                if pos > stop:
                    last = k
                if end < start:
                    break
        out += [(now, g[0], x) for g in own[:last] for x in g[3]]
        own = own[last:]
    return sorted(out + [(now, g[0], x) for g in own for x in g[3]])


@pytest.mark.parametrize("seed", range(4))
def test_sweep_is_that_of_a_loop(spark, seed):
    rng = random.Random(seed)
    rows = [(ref, 0, p, p + rng.randrange(1, 12)) for ref in ("a", "b", "c") for p in sorted(rng.randrange(200) for _ in range(60))]
    rows = [(r, i, p, e) for i, (r, _, p, e) in enumerate(rows)]
    genes = [(ref, i, s, s + rng.choice([2, 5, 60])) for ref in ("a", "b") for i, s in enumerate(sorted(rng.sample(range(1, 200), 15)))]
    own = spark.createDataFrame(rows, "ref string, read_id long, pos long, end long")
    g = spark.createDataFrame(genes, "ref string, gene_id long, gene_start long, gene_end long")
    found = sorted((r.ref, r.gene_id, r.read_id) for r in reads.swept(own, g, 16).collect())
    assert found == swept(rows, genes)
    whole = sorted((r.ref, r.gene_id, r.read_id) for r in reads.swept(own, g, 16, compat=False).collect())
    assert whole == sorted((r, i, n) for r, n, p, e in rows for q, i, s, t in genes if q == r and p < t and s - 1 < e) and set(whole) != set(found)
    assert reads.swept(own.where("false"), g, 16).count() == 0 and reads.swept(own, g.where("false"), 16).count() == 0
