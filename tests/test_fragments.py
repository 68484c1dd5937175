"""Mated fragments against brute force over pairs of reads and places; runs over a workspace by the command line."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lociwave import flows
from lociwave.__main__ import main
from lociwave.operators import fit
from lociwave.operators import fragments as P
from lociwave.operators import sites
from lociwave.plans import workspaces
from lociwave.sources import reference
from lociwave.sources.config import settings

RECORD = "read_id string, ord long, ref string, mate_ref string, pos int, mate_pos int, cigar array<struct<op:string,len:int>>, seq string"
MAXL = 12


def row(name, n, pos, mate, seq, ref="NC_000001", mate_ref="NC_000001", cigar=None):
    return (name, n, ref, mate_ref, pos, mate, cigar or [("M", len(seq))], seq)


@pytest.fixture(scope="module")
def case(spark):
    draw = random.Random(5)
    genome = "".join(draw.choice("ATGC") for _ in range(60))
    kinds = "".join(draw.choice("01234") for _ in range(60))
    records, letters = [], {}
    for i in range(30):
        start, gap = draw.randrange(52), draw.randrange(1, 9)
        one, two = ("".join(draw.choice("ATGCan-") if draw.random() < 0.3 else (genome + "A" * 40)[p + k] for k in range(5)) for p in (start, start + gap))
        records += [row(f"r{i}", 2 * i, start, start + gap, one), row(f"r{i}", 2 * i + 1, start + gap, start, two)]
        letters[f"r{i}"] = (start, one + "*" * (gap - 5) + two if gap >= 5 else one + two[5 - gap :])
    # No mate, a mate elsewhere, unknown values, a repeated left record (the last one counts), an empty read, a deletion.
    records += [row("s", 100, 3, 9, "ATGCA"), row("t", 101, 3, 9, "ATGCA", mate_ref="NC_000002"), row("t", 102, 9, 3, "ATGCA", mate_ref="NC_000002"), row("u", 103, 3, None, "ATGCA", mate_ref=None)]
    records += [row("v", 104, 2, 8, "CCCCC"), row("v", 105, 2, 8, "GGGGG"), row("v", 106, 8, 2, "ATGCA"), row("w", 107, 2, 2, ""), row("w", 108, 2, 3, "")]
    letters["v"] = (2, "GGGGG*ATGCA")
    records += [row("x", 109, 1, 7, "ATGC", cigar=[("M", 2), ("D", 1), ("M", 2)]), row("x", 110, 7, 1, "ATGC")]
    letters["x"] = (1, "AT*GC*ATGC")
    df = spark.createDataFrame(records, RECORD)
    store = lambda text: reference.stored(spark.createDataFrame([("ref|NC_000001.2|", text)], "accession string, seq string"), 16)
    # A store of small blocks, so that fragments go over borders.
    return df, store(genome), store(kinds), genome, kinds, letters


def profile(a, b, kinds, wanted):
    match = {3: "34"}.get(wanted, str(wanted))
    return [None if k not in match or x not in "ATGCatgc" or y not in "ATGCatgc" else int(x != y) for x, y, k in zip(a, b, kinds, strict=True)]


def added(total, key, subs):
    for i, x in enumerate(subs):
        for lag, y in enumerate(subs[i : i + MAXL]):
            if x is not None and y is not None:
                own = total.setdefault((*key, lag), [0, 0, 0, 0])
                for k, v in enumerate((1, x, y, x * y)):
                    own[k] += v


def test_fragments(case):
    found = {r["name"]: (r["start"], r["letters"]) for r in P.fragments(case[0]).collect()}
    assert found == case[5]


def test_against_brute_force(spark, case, monkeypatch):
    df, seq, pos, genome, kinds, letters = case
    monkeypatch.setattr(reference.sliced, "__defaults__", (16,))
    rows = P.placed(P.fragments(df), seq, pos)
    want = {}
    for start, text in letters.values():
        end = start + len(text)
        for p in (0, 1, 3, 4):
            if end <= len(genome):
                added(want, ("genome", p), profile(text, genome[start:end], kinds[start:end], p))
    own = list(letters.values())
    for i, (s1, t1) in enumerate(own):
        for s2, t2 in own[:i]:
            lo, hi = max(s1, s2), min(s1 + len(t1), s2 + len(t2), len(genome))
            if hi > lo:
                for p in (0, 1, 3, 4):
                    added(want, ("reads", p), profile(t1[lo - s1 : hi - s1], t2[lo - s2 : hi - s2], kinds[lo:hi], p))
    found = {}
    for name, f in (("genome", P.against_genome), ("reads", P.against_reads)):
        found |= {(name, r.position, r.lag): [r.n, r.sx, r.sy, r.sxy] for r in f(rows, [0, 1, 3, 4], MAXL).collect() if r.n}
    assert found == want


def test_results(spark):
    sums = spark.createDataFrame([(4, 0, 4.0, 1.0, 1.0, 1.0), (4, 3, 3.0, 1.0, 2.0, 1.0), (4, 4, 3.0, 1.0, 1.0, 1.0), (4, 12, 3.0, 1.0, 1.0, 0.0), (0, 0, 1.0, 0.0, 0.0, 0.0)], "position int, lag long, n double, sx double, sy double, sxy double")
    got = {(r.position, r.lag): (r.value, r.obs, r.Ks, r.VarKs) for r in P.results(sums, 12).collect()}
    assert got == {(4, 0): (0.25, 4, 0.25, 0.25), (4, 1): (pytest.approx(1 / 6), 3, 0.25, 0.25)}


def test_names():
    assert [P.function_name(x) for x in ("Cov_Reads_vs_Reads", "reads_vs_genome", "other")] == ["reads_vs_reads", "reads_vs_genome", ""]


def test_empty(spark, case):
    df, seq, pos = case[0].limit(0), case[1], case[2]
    assert P.covariances(df, seq, pos, sorted(P.FUNCTIONS), [4], MAXL).count() == 0


def test_long_fragment(spark):
    n = 40_000
    rows = spark.createDataFrame([("a", "x", 0, "A" * n, "A" * (n - 1) + "T", "4" * n), ("b", "y", 0, "A", "T", "4")], "accession string, name string, start long, letters string, nucl string, kinds string")
    found = {(r.accession, r.lag): (r.n, r.sx, r.sy, r.sxy) for r in P.against_genome(rows, [4], 5).collect()}
    assert found == {("a", 0): (n, 1, 1, 1), ("b", 0): (1, 1, 1, 1)} | {("a", k): (n - k, 0, 1, 0) for k in range(1, 5)}


def test_fit_without_a_start(spark):
    points = spark.createDataFrame([(k, lag, y) for k, values in enumerate(([0.0] * 12, [0.1, 0.0, 0.2, 0.1], [0.1, 0.2], [1.0])) for lag, y in enumerate(values)], "k int, lag int, value double")
    for kind in ("hyper", "exp"):
        found = {r["k"]: r["b0"] for r in fit.fitted(points, ["k"], kind, 0, 100).collect()}
        assert set(found) == {0, 1, 2, 3} and found[0] is None and found[3] == 1.0


def test_command_line(spark, tmp_path, monkeypatch):
    path = workspaces.workspace(spark, "/root/testdata/sf0.001")
    with pytest.warns(UserWarning, match="no NC_"):
        for name in ("genome_profile", "cov_reads", "fit_reads"):
            main([name, "-w", path])
    own = settings(flows.loaded(path), {})
    assert own.genome_reference == "ref" and own.cov_positions == (0, 1, 3) and own.cov_functions == ("Cov_Reads_vs_Genome", "Cov_Reads_vs_Reads")
    rows = [json.loads(r["value"]) for r in spark.read.text(f"{path}/cov/reads").collect()]
    assert {r["function"] for r in rows} == set(P.FUNCTIONS) and all(len(r["Ct"]) == len(r["CtN"]) for r in rows)
    fits = spark.read.json(f"{path}/fit/reads")
    assert {r["kind"] for r in fits.select("kind").distinct().collect()} == {"exp", "hyper"}
    with pytest.raises(FileNotFoundError):
        flows.cov_reads(spark, settings(flows.loaded(path), {}, out_sam="nowhere"), path)


@pytest.mark.parametrize("lower", [False, True])
def test_reads_are_counted_by_ranges_of_the_genome(spark, monkeypatch, lower):
    """Windows and pieces far smaller than the fragments, and ranges that share places, against pairs of letters as rows."""
    monkeypatch.setattr(P, "PIECE", 16)
    monkeypatch.setattr(P, "CELLS", 1)
    rnd = random.Random(3)
    letters = "ATGC*" + "atgc" * lower
    rows = []
    for i in range(240):
        n = rnd.randrange(1, 70)
        text = "".join(rnd.choice(letters) for _ in range(n))
        rows.append((f"g{i % 2}", f"r{i}", rnd.randrange(150), text, "".join(rnd.choice("01234") for _ in range(n - i % 3))))
    df = spark.createDataFrame(rows, "accession string, name string, start long, letters string, kinds string").repartition(4)
    found = P.against_reads(df, [0, 1, 3], 7)
    bases = [(a, p, name, start + i, x) for a, name, start, text, kinds in rows for p in (0, 1, 3) for i, (x, k) in enumerate(zip(text, kinds, strict=False)) if x != "*" and int(k) in P._kinds(p)]
    pairs = sites.read_pair_covariance(spark.createDataFrame(bases, "accession string, position int, read_id string, pos long, base string"), ["accession", "position"], 7, 2)
    want = pairs.groupBy("accession", "position", F.col("lag").cast("long").alias("lag")).agg(F.sum("pairs").alias("n"), *[F.sum(c).alias(c) for c in ("sx", "sy", "sxy")])
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) and want.count() > 20
    assert P.against_reads(df.where("false"), [1], 7).count() == 0
