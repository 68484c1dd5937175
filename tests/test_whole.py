"""Queries over the whole of their input, against brute force and statements without cuts."""

from collections import Counter

import pandas as pd
import pytest
from compare import DATA, duck, rows

from lociwave.plans import catalog, catalogue
from lociwave.sources.views import oracle_views


def whole(views, text):
    return duck().execute(f"WITH RECURSIVE {oracle_views(*views.split())}{text}").df()


def test_ct_by_lag_by_brute_force(spark):
    import statistics

    reads = [r for r in duck().execute(f"WITH {oracle_views('seq_reads')} SELECT read_id, ref, pos, mapq, seq, quals FROM seq_reads").fetchall() if 20 < r[3] < 51]
    found = {}
    for a, ref, p, _, s, u in reads:
        for b, other, q, _, t, v in reads:
            if ref == other and (q, b) > (p, a) and q < p + len(s):
                x = []
                for j in range(min(len(s) - (q - p), len(t))):
                    i = j + q - p
                    good = s[i] in "ATGC" and t[j] in "ATGC" and ord(u[i]) - 33 > 30 and ord(v[j]) - 33 > 30
                    x.append(float(s[i] != t[j]) if good else None)
                for lag in range(4):
                    found.setdefault(((a * 31 + b) % 10, lag), []).extend((c, d) for c, d in zip(x, x[lag:], strict=False) if c is not None and d is not None)
    cov = {}
    for (_, lag), xy in found.items():
        if len(xy) > 10:
            mx, my = (statistics.fmean(v) for v in zip(*xy, strict=True))
            cov.setdefault(lag, []).append(statistics.fmean((x - mx) * (y - my) for x, y in xy))
    got = {r.lag: (r.mean, r.var, r.n) for r in catalog.QUERIES["ct_by_lag"](spark, DATA).collect()}
    assert sorted(got) == sorted(cov) == [0, 1, 2, 3]
    for lag, c in cov.items():
        assert got[lag] == (pytest.approx(statistics.fmean(c), abs=2e-9), pytest.approx(statistics.variance(c), abs=2e-9), len(c))


def test_mated_overlap_joins_all_fragments(spark, tmp_path):
    from lociwave.plans.alignments import MATES

    text = f", {MATES}, fr AS (SELECT m.name AS id, least(l.pos, r.pos) AS a, greatest(l.pos, r.pos) + 20 AS b FROM m JOIN records l ON l.ord = left_ord JOIN records r ON r.ord = right_ord) SELECT y.a - x.a AS shift, count(*) AS n FROM fr x JOIN fr y ON x.a < y.b AND y.a < x.b AND (x.b < y.b OR (x.b = y.b AND x.id < y.id)) GROUP BY 1"
    assert rows(catalog.QUERIES["mated_overlap"](spark, DATA).toPandas()) == rows(whole("records", text))
    # Two records a name, one on each side of its mate: o_orderkey gives the places (% 211) and the mates' (% 199).
    left, right = [k for k in range(1, 2000) if k % 7 and k % 211 < k % 199], [k for k in range(1, 2000) if k % 7 and k % 211 > k % 199]
    names = list(zip(left[:12:2], right[:12:2], strict=True))
    pd.DataFrame([(k, i, "1-URGENT") for i, two in enumerate(names) for k in two], columns=["o_orderkey", "o_custkey", "o_orderpriority"]).to_parquet(tmp_path / "orders.parquet")
    ends = [(max(x % 211 for x in two) + 20, i, min(x % 211 for x in two)) for i, two in enumerate(names)]
    want = Counter(c - a for b, i, a in ends for d, j, c in ends if (b, i) < (d, j) and a < d and c < b)
    assert want and {r["shift"]: r["n"] for r in catalog.QUERIES["mated_overlap"](spark, str(tmp_path)).collect()} == want


def test_read_hits_reads_the_whole_view(spark):
    want = whole("hits", " SELECT p::VARCHAR AS q, s::VARCHAR AS s, 90.5::DOUBLE AS pident, CAST(NULL AS DOUBLE) AS evalue, score AS bitscore FROM hits")
    assert rows(catalog.QUERIES["read_hits"](spark, DATA).toPandas()) == rows(want)


def test_read_sam_reads_every_line(spark):
    want = whole("reads", " SELECT l_orderkey AS read_id, l_partkey::INT AS pos, (l_linenumber * 10)::INT AS mapq, 'M' AS op, 4 AS len, 'ACGT' AS seq, 40 AS first_qual FROM lineitem")
    assert len(want) == len(pd.read_parquet(f"{DATA}/lineitem.parquet")) and rows(catalog.QUERIES["read_sam"](spark, DATA).toPandas()) == rows(want)


def test_mcl_clusters_holds_every_edge(spark):
    from compare import mcl

    edges = whole("hits", f", {catalogue.RECIPROCAL} SELECT a, b FROM ed ORDER BY a, b")
    assert len(edges) > 20
    up = {x: x for x in [*edges.a, *edges.b]}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges.itertuples(index=False):
        up[max(root(a), root(b))] = min(root(a), root(b))
    want = sorted((c[0], x) for _, part in edges.groupby(edges.a.map(root)) for c in mcl(part) for x in c)
    assert {x for _, x in want} == set(up) and sorted(tuple(r) for r in catalog.QUERIES["mcl_clusters"](spark, DATA).collect()) == want


def test_climbed_goes_all_the_way_or_fails(spark):
    from lociwave.operators import genomes

    data = [(i, i + 1, "clade", f"c{i}") for i in range(40)] + [(40, None, "species", "top"), (50, 50, "root", "r"), (51, 50, "clade", "x")]
    taxa = spark.createDataFrame(data, "id long, parent long, rank string, name string")
    got = {r.id: r.found for r in genomes.climbed(taxa, taxa.select("id"), "species").collect()}
    assert got == {i: "top" for i in range(41)} | {50: None, 51: None}
    with pytest.raises(Exception, match="deeper than 8"):
        genomes.climbed(taxa, taxa.select("id"), "species", 8).collect()
