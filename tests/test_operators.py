"""Operators against brute force on small inputs, and the known curves of the fits."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociwave.functions import sequence as Q
from lociwave.functions.stats import diversity
from lociwave.operators import codons, fit, genomes, reads, sites
from lociwave.operators.joins import band_join, interval_join
from lociwave.operators.order import running
from lociwave.sources import bam, config, readers

# The nine points of the hyperbolic curve with known parameters.
HYPERBOLIC = (0.01560084, 0.01392907, 0.01301867, 0.01249557, 0.01190561, 0.01131878, 0.01091478, 0.01073981, 0.01043296)
# A measured curve whose exponential parameters are known.
EXPONENTIAL = [
    0.015600839314894, 0.0139290656045694, 0.0130186686714599, 0.0124955670819063, 0.0119056080624362, 0.0113187792329688, 0.0109147762820121,
    0.0107398089318678, 0.010432957597562, 0.0100915976444594, 0.0101028969376478, 0.00968861059257028, 0.00939696310330572, 0.00904486836995573,
    0.00918940665148421, 0.00888282990065732, 0.00849316272929227, 0.00844501339865543, 0.00836104103989298, 0.00823574060655616, 0.00792995458492625,
    0.00796526487551047, 0.00775305172810075, 0.00759204144237381, 0.00757748323895926, 0.00757997755056544, 0.00721357657665209, 0.00698312317012617,
    0.00698183294399716, 0.00707912023540834, 0.00707893994056963, 0.00684181652384852, 0.0067521424093343, 0.00662698538759604, 0.00670548605966183,
    0.00647274631920478, 0.0064794036339043, 0.00623868180220306, 0.00627187358059813, 0.00627595640111926, 0.00606325569397629, 0.0061133601920929,
    0.00608667412361224, 0.00596040223987118, 0.00586620841656913, 0.00579315159638459, 0.00577705304225463, 0.00597741816754824, 0.0056056291878547,
    0.00558441429775262, 0.00559889212690385, 0.00571161600721793, 0.00571499111470105, 0.00553250163924005, 0.00543618864564993, 0.00544722224678508,
    0.00552527801126439, 0.00546836253953338, 0.00529653087115126, 0.0053315111995904, 0.00516602055844801, 0.00532591200236894, 0.00543883472963676,
    0.00518701374378691, 0.00518233896950736, 0.00527440647384635, 0.00519530759917457, 0.00511943244038621, 0.00533370878837805, 0.00507488501562784,
    0.00517446227536103, 0.00511892958567164, 0.00510386658161176, 0.00509795323764871, 0.00486702780322293, 0.00511271440811747, 0.00487071548027738,
    0.00495468112710487, 0.00491275268465846, 0.00491355660989787, 0.00487137398756576, 0.00487963908344826, 0.00488185817339244, 0.00493089954847724,
    0.00488281065577188, 0.00479928800948313, 0.00491826671499934, 0.00489942157084919, 0.00482745917943409, 0.00482468870375351, 0.00488845507626486,
    0.00494458498992408, 0.00486259753846262, 0.00490944865123425, 0.00483462327191793, 0.00487115409857744, 0.00475464713115493, 0.00495289322141842,
    0.004792018029891, 0.0048023983161196,
]


def test_fit_goldens():
    got = fit.fit_hyperbolic(np.arange(1.0, 10), np.array(HYPERBOLIC))
    assert got == pytest.approx([62.352885, 4.122212], abs=1e-5)
    got = fit.fit_exponential(np.arange(1.0, 101), np.array(EXPONENTIAL))
    assert got == pytest.approx([64.426574, 162.115936, 43.732383], abs=1e-5)


def test_fit_too_few_points():
    assert len(fit.least_squares(fit.exponential, np.array([1.0]), np.array([0.5]), np.ones(3))) == 3


def test_band_join_is_the_plain_join(spark):
    rng = random.Random(1)
    data = [(rng.randrange(2), rng.randrange(60), i) for i in range(80)]
    df = spark.createDataFrame(data, "g int, pos long, x int")
    for maxl in (1, 7, 50):
        got = sorted((r.g, r.x_a, r.x_b, r.lag) for r in band_join(df, ["g"], "pos", maxl).collect())
        assert got == sorted((g, x, y, q - p) for g, p, x in data for h, q, y in data if g == h and 0 <= q - p < maxl)


def test_interval_join_is_the_plain_join(spark):
    rng = random.Random(2)
    data = [(0, s := rng.randrange(100), s + rng.randrange(0, 30), i) for i in range(50)]
    df = spark.createDataFrame(data, "g int, start long, end long, x int")
    got = sorted((r.x_a, r.x_b) for r in interval_join(df, df, ["g"], 8).collect())
    assert got == sorted((a[3], b[3]) for a in data for b in data if a[1] < b[2] and b[1] < a[2] and a[2] > a[1] and b[2] > b[1])


def test_released_reads_are_the_queues(spark):
    rng = random.Random(3)
    for _ in range(4):
        data = sorted((rng.randrange(60), i, rng.randrange(1, 20)) for i in range(30))
        queue, out = [], []
        for pos, i, size in data:
            queue.append((pos, i, size))
            if queue[0][0] + queue[0][2] < pos:
                out.append(queue.pop(0)[1])
        df = spark.createDataFrame([("r", p, i, s) for p, i, s in data], "ref string, pos long, read_id long, len long")
        assert sorted(r.read_id for r in reads.released(df, ["ref"]).collect()) == sorted(out)


def test_gene_runs_isolate_the_first_site(spark):
    def ends(genes):
        df = spark.createDataFrame([("g", i, x) for i, x in enumerate(genes)], "genome string, pos long, gene string")
        return [r.n for r in sites.gene_runs(df, ["genome"]).groupBy("run").agg(F.count("*").alias("n")).orderBy("run").collect()]

    assert ends(["a", "a", "a"]) == [1, 2]
    assert ends(["", "", "b"]) == [2, 1]


def test_chunks(spark):
    df = spark.createDataFrame([("g", i) for i in range(250)], "genome string, pos long")
    assert sites.chunked(df, ["genome"], "pos", 100).agg(F.count_distinct("chunk")).first()[0] == 125
    assert sites.chunked(df.where("pos < 30"), ["genome"], "pos", 100).agg(F.min("chunk"), F.count_distinct("chunk")).first()[:] == (1, 30)
    assert sites.chunked(df, ["genome"], "pos", 120, True).agg(F.max("chunk"), F.count("*")).first()[:] == (119, 240)


def test_diversity_closed_form(spark):
    rng = random.Random(4)
    data = [(i, rng.choice("ACG")) for i in range(5) for _ in range(rng.randrange(1, 9))]
    df = spark.createDataFrame(data, "pos long, base string")
    got = {r.pos: r.pi for r in sites.site_diversity(df, ["pos"]).collect()}
    for p in got:
        x = [b for q, b in data if q == p]
        pairs = [(a, b) for i, a in enumerate(x) for b in x[i + 1 :]]
        assert got[p] == (pytest.approx(sum(a != b for a, b in pairs) / len(pairs)) if pairs else None)
    assert spark.range(1).select(diversity(F.lit(1), F.lit(1))).first()[0] is None


def test_lag_zero_counts_twice(spark):
    df = spark.createDataFrame([(0, 0, r, "CTT") for r in range(3)], "gene_id long, gene_pos long, read_id long, codon string")
    assert codons.codon_pairs(df, 1).agg(F.sum("n")).first()[0] == 6
    assert codons.codon_pairs(df, 1, compat=False).agg(F.sum("n")).first()[0] == 3


def test_normalised_without_ks(spark):
    df = spark.createDataFrame([("g", "P2", 1, 2.0, 1.0, 3), ("h", "P2", 0, 0.0, 0.0, 3), ("h", "P4", 1, 1.0, 1.0, 3)], "gene_id string, type string, lag long, mean double, var double, n long")
    got = {(r.gene_id, r.t, r.lag): r.m for r in codons.normalised(df).collect()}
    assert got == {("g", "P2", 3): None, ("h", "Ks", 0): 0.0, ("h", "P4", 3): None}


def test_best_hits_need_both_sides(spark):
    f = spark.createDataFrame([("a", "x", 1), ("b", "x", 2)], "q string, s string, ord int")
    b = spark.createDataFrame([("x", "a", 1), ("x", "b", 2)], "q string, s string, ord int")
    assert [tuple(r) for r in genomes.reciprocal_best_hits(f, b).collect()] == [("a", "x")]


def test_outliers(spark):
    df = spark.createDataFrame([(1, x) for x in (100, 100, 120)], "family_id long, len long")
    assert sorted((r.len, r.keep, r.whole) for r in genomes.without_outliers(df).collect()) == [(100, True, False), (100, True, False), (120, False, False)]


def test_difference_sums_are_those_of_loops(spark):
    rng = random.Random(21)
    rows = []
    for i in range(120):
        size = rng.randrange(0, 12)
        rows.append((i, "".join(rng.choice("ATGCNa") for _ in range(size)), "".join(rng.choice("!I?@") for _ in range(rng.choice([size, size, max(0, size - 2)])))))
    own = spark.createDataFrame(rows, "id long, seq string, quals string")
    letters = {r.id: r.letters for r in reads.masked(own.repartition(3)).collect()}
    assert letters == {i: "".join(c if c in "ATGC" and j < len(q) and ord(q[j]) - 33 > 30 else "-" for j, c in enumerate(s)) for i, s, q in rows}
    assert [r.letters for r in reads.masked(spark.createDataFrame([(1, None, "I"), (2, "AC", None)], own.schema)).orderBy("id").collect()] == ["", "--"]
    pairs = [(rng.randrange(3), letters[rng.randrange(120)], letters[rng.randrange(120)], rng.randrange(0, 9)) for _ in range(300)]
    want = {}
    for g, a, b, shift in pairs:
        n = min(len(a) - shift, len(b))
        if n <= 0:
            continue
        x = [None if "-" in (p, q) else int(p != q) for p, q in zip(a[shift : shift + n], b[:n], strict=True)]
        out = want.setdefault(g, [0] * 11)
        out[0] += 1
        out[1] += sum(v is not None for v in x)
        out[2] += sum(v or 0 for v in x)
        for lag in range(2):
            both = [(p, q) for p, q in zip(x, x[lag:], strict=False) if p is not None and q is not None]
            for k, v in enumerate((len(both), sum(p for p, _ in both), sum(q for _, q in both), sum(p * q for p, q in both))):
                out[3 + 4 * lag + k] += v
    df = spark.createDataFrame(pairs, "g long, letters_a string, letters_b string, shift long").repartition(4)
    assert {r.g: list(r)[1:] for r in reads.difference_sums(df, "g", 2).collect()} == want
    assert reads.difference_sums(df.where("false"), "g", 2).count() == 0


def test_fragment_shifts_count_the_pairs(spark):
    rng = random.Random(22)
    data = [(i, a := rng.randrange(30), a + rng.randrange(0, 9)) for i in rng.sample(range(200), 90)]
    df = spark.createDataFrame(data, "id long, left long, right long")
    found = {r["shift"]: r.n for r in reads.fragment_shifts(df).collect()}
    want = {r.s: r.n for r in reads.mates_overlapping(df, 8).groupBy((F.col("start_b") - F.col("start_a")).alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert found == want and sum(want.values()) > 200


def test_medians_by_rank(spark):
    rng = random.Random(11)
    data = [("hot" if i % 2 else f"f{i % 7}", rng.choice([None, *range(40)])) for i in range(900)] + [(None, 3), (None, 8), ("one", 5), ("none", None)]
    df = spark.createDataFrame(data, "family_id string, len long").repartition(6)
    found = {r.family_id: r["median"] for r in genomes.medians(df, "family_id", "len").collect()}
    assert found == {f: float(np.median([x for g, x in data if g == f and x is not None])) for f in {f for f, x in data if x is not None}}
    rows = genomes.without_outliers(df)
    assert rows.count() == len(data) and "Window" not in rows._jdf.queryExecution().executedPlan().toString()


def test_marks_around_ends_over_ranges(spark):
    rng = random.Random(4)
    size = 500
    sites = [(g, i, rng.random() < 0.1, rng.random() < 0.95, size) for g in ("a", "b") for i in range(size)]
    genes = [(g, k, s := rng.randrange(1, 480), s + rng.randrange(0, 15)) for g in ("a", "b") for k in range(20)]
    stop = {(g, i) for g, i, c, v, _ in sites if c or not v}

    def reach(g, at, step):
        n = 0
        while (g, at % size) not in stop:
            at, n = at + step, n + 1
        return n

    found = {(r.genome, r.gene_id): (r.left, r.right) for r in genomes.expanded(spark.createDataFrame(genes, "genome string, gene_id long, start long, end long"), spark.createDataFrame(sites, "genome string, pos long, coding boolean, valid boolean, length long")).collect()}
    assert found == {(g, k): (reach(g, s - 2, -1), reach(g, e, 1)) for g, k, s, e in genes}


def test_mcl_splits_two_triangles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "z"), ("x", "z"), ("p", "q")], "a string, b string")
    got = genomes.clusters(edges).groupBy("cluster_id").agg(F.sort_array(F.collect_list("member")).alias("m")).collect()
    assert sorted(r.m for r in got) == [["a", "b", "c"], ["p", "q"], ["x", "y", "z"]]


def test_mcl_is_that_of_dense_matrices(spark):
    rng = np.random.default_rng(5)
    pairs = sorted({(f"n{10 * g + int(a):02}", f"n{10 * g + int(b):02}") for g in range(3) for a, b in rng.integers(0, 10, (14, 2))} | {("n03", "n14"), ("n29", "n29")})
    names = sorted({x for p in pairs for x in p})
    m = np.eye(len(names))
    for a, b in pairs:
        m[names.index(a), names.index(b)] = m[names.index(b), names.index(a)] = 1
    m /= m.sum(0)
    for _ in range(60):
        m = (m @ m) ** 2
        m[m < 1e-8] = 0
        m /= m.sum(0)
    owner = (m >= m.max(0) * (1 - 1e-6)).argmax(0)
    wanted = sorted([names[i] for i in np.flatnonzero(owner == o)] for o in set(owner))
    got = genomes.clusters(spark.createDataFrame(pairs, "a string, b string")).groupBy("cluster_id").agg(F.sort_array(F.collect_list("member")).alias("m")).collect()
    assert sorted(r.m for r in got) == wanted and all(r.cluster_id == r.m[0] for r in got) and len(wanted) > 3
    assert genomes.clusters(spark.createDataFrame([], "a string, b string")).count() == 0
    # Slices of two rows: every vertex with more edges is spread over several keys.
    salted = genomes.clusters(spark.createDataFrame(pairs, "a string, b string"), slice_rows=2).groupBy("cluster_id").agg(F.sort_array(F.collect_list("member")).alias("m")).collect()
    assert sorted(r.m for r in salted) == wanted


def test_running_passes_over_ranges(spark):
    rng = random.Random(3)
    data = [(g, i, rng.randrange(100), f"x{rng.randrange(3)}") for g, n in (("a", 400), ("b", 1), (None, 30)) for i in range(n)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "g string, i int, x int, name string").repartition(5)
    got = running(df, ["g"], ["i"], sums={"s": F.col("x")}, tops={"t": F.col("x")}, lags={"before": "name"}, count="n").collect()
    wanted = []
    for g in ("a", "b", None):
        own = sorted(r for r in data if r[0] == g) if g else sorted((r for r in data if r[0] is None), key=lambda r: r[1])
        for k, r in enumerate(own):
            upto = [y[2] for y in own[: k + 1]]
            wanted.append((*r, sum(upto), max(upto), own[k - 1][3] if k else None, len(own)))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, wanted))
    assert running(df.where("false"), ["g"], ["i"], sums={"s": F.col("x")}, count="n").count() == 0


def test_pileup_indels(spark):
    df = spark.createDataFrame([(".+12AAAAAAAAAAAA,T", "G"), ("^+.A$", "G"), (None, "G")], "b string, r string")
    assert [r[0] for r in df.select(Q.pileup_letters(F.col("b"), F.col("r"))).collect()] == ["GAGT", "GA", None]
    assert [r[0] for r in df.select(Q.pileup_letters(F.col("b"), F.col("r"), compat=False)).collect()] == ["GGT", "GA", None]


def test_code():
    code = Q.genetic_code()
    assert len(code) == 64 and code["ATG"] == "M" and code["TGG"] == "W" and code["TAA"] == "*"
    assert len(Q.fourfold()) == 32 and "CTT" in Q.fourfold() and "ATG" not in Q.fourfold()
    assert Q.position_type(9) == Q.CODING and Q.position_type(9, Q.THIRD) == Q.THIRD


def bam_bytes():
    import gzip
    import struct

    seq, cigar = "ACGTN", [(5, "M")]
    name = b"r1\0"
    packed = bytes(bam.LETTERS.index(a) << 4 | bam.LETTERS.index(b) for a, b in zip(seq[::2], (seq + "=")[1::2], strict=True))
    body = struct.pack("<iiBBHHHiiii", 0, 7, len(name), 30, 0, len(cigar), 99, len(seq), 0, 9, 0) + name + b"".join(struct.pack("<I", n << 4 | bam.OPERATIONS.index(op)) for n, op in cigar) + packed + bytes([40] * len(seq))
    data = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 4) + b"chr\0" + struct.pack("<i", 100)
    data += struct.pack("<i", len(body)) + body
    return gzip.compress(data[:20]) + gzip.compress(data[20:])


def test_bam(spark, tmp_path):
    (tmp_path / "x.bam").write_bytes(bam_bytes())
    (row,) = readers.alignments(spark, f"{tmp_path}/x.bam").collect()
    assert (row.read_id, row.ref, row.pos, row.mapq, row.seq, row.qual, row.mate_pos) == ("r1", "chr", 7, 30, "ACGTN", [40] * 5, 9)
    assert [(c.op, c.len) for c in row.cigar] == [("M", 5)]


def test_archives_profiles_and_stems(spark, tmp_path):
    import io
    import tarfile

    with tarfile.open(tmp_path / "s.scaffold.fna.tgz", "w:gz") as tar:
        info = tarfile.TarInfo("a.fna")
        info.size = 4
        tar.addfile(info, io.BytesIO(b">a\nC"))
    assert [(r.member, r.text) for r in readers.archives(spark, f"{tmp_path}/s.scaffold.fna.tgz").collect()] == [("a.fna", ">a\nC")]
    assert [r.stem for r in readers.stems(spark, str(tmp_path)).collect()] == ["s"]
    (tmp_path / "g.pos").write_bytes(bytes([0, 1, 2, 4, 8]))
    assert [r.pos_type for r in readers.position_profile(spark, f"{tmp_path}/g.pos").orderBy("pos").collect()] == [0, 1, 2, 4, 8]


def test_draws_are_with_replacement(spark):
    from collections import Counter

    from lociwave.operators import substitutions

    rows = substitutions.draws(spark, 40, 12).collect()
    boots = {b: Counter(r.idx for r in rows if r.boot == b) for b in range(12)}
    assert all(sum(c.values()) == 40 and set(c) <= set(range(40)) for c in boots.values())
    assert all(len(c) < 40 and max(c.values()) > 1 for c in boots.values()) and len({tuple(sorted(c.items())) for c in boots.values()}) == 12
    assert sorted(map(tuple, rows)) == sorted(map(tuple, substitutions.draws(spark, 40, 12).collect()))
    assert sorted(map(tuple, rows)) != sorted(map(tuple, substitutions.draws(spark, 40, 12, seed=2).collect()))


def test_stale_files(spark, tmp_path):
    import os

    (tmp_path / "a").write_text("x")
    (tmp_path / "b").write_text("y")
    os.utime(tmp_path / "a", (1_000_000, 1_000_000))
    assert readers.stale(spark, f"{tmp_path}/a", f"{tmp_path}/b") and not readers.stale(spark, f"{tmp_path}/b", f"{tmp_path}/a")
    assert readers.stale(spark, f"{tmp_path}/none", f"{tmp_path}/a") and not readers.stale(spark, f"{tmp_path}/a", f"{tmp_path}/none")


def test_order_and_runs(spark):
    from lociwave.operators.order import numbered, runs

    rng = random.Random(9)
    keys = [rng.choice("ab") for _ in range(60)] + ["a"] * 9000 + [None, None, "b"]
    df = spark.createDataFrame([(i * 2, k) for i, k in enumerate(keys)], "ord long, key string").repartition(5)
    placed, total = numbered(df, ["ord"])
    assert total == len(keys) and sorted((r.ord, r.at) for r in placed.collect()) == [(2 * i, i) for i in range(len(keys))]
    want, start = [], 0
    for i, k in enumerate(keys):
        start = i if i == 0 or keys[i - 1] != k else start
        want.append((2 * i, start))
    assert sorted((r.ord, r.run) for r in runs(df, "ord", "key").collect()) == want
    assert numbered(df.where("false"), ["ord"])[1] == 0 and runs(df.where("false"), "ord", "key").count() == 0


def test_states_merge_in_any_order(spark):
    from lociwave.operators import substitutions as X

    rng = random.Random(12)
    data = [(a, r, p, rng.choice([0.0, 1.0, 1.0, None])) for a in range(6) for r in range(5) for p in range(12)]
    subs = spark.createDataFrame(data, "aln long, row long, pos long, x double")
    key = lambda df: sorted((r.kind, r.lag, r.n, round(r.sx, 9), round(r.sxy, 9)) for r in df.collect())
    whole = X.merged(X.states(subs, 4))
    parts = [X.merged(X.states(subs.where(f"aln in {a}"), 4)) for a in ("(0, 3)", "(1)", "(2, 4, 5)")]
    assert key(X.merged(X.merged(parts[2].unionByName(parts[0])).unionByName(parts[1]))) == key(whole)
    found = {(r.kind, r.lag): r for r in X.finished(whole).collect()}
    for r in X.bundle(subs, 4).collect():
        assert found[r.kind, r.lag].n == r.n and found[r.kind, r.lag].value == pytest.approx(r.value, abs=1e-12)
    ks = X.ks(subs).first()
    assert (found["Ks", 0].n, found["Ks", 0].value, found["Ks", 0].var) == (ks.n, pytest.approx(ks.ks), pytest.approx(ks.var_ks))
    assert X.states(subs.where("false"), 4).count() == 0


def test_resampled_states_are_those_of_drawn_bundles(spark):
    from lociwave.operators import substitutions as X

    rng = random.Random(13)
    cells = [(a, k, lag, rng.randrange(1, 9), rng.random(), rng.random(), rng.random()) for a in range(9) for k in ("Ct", "Ks") for lag in range(rng.randrange(1, 80))]
    parts = spark.createDataFrame(cells, "aln long, kind string, lag long, n long, sx double, sy double, sxy double").repartition(3)
    drawn = [(r.boot, r.idx) for r in X.draws(spark, 9, 7).collect()]
    want = {}
    for boot, idx in drawn:
        for a, k, lag, n, *rest in cells:
            if a == idx:
                own = want.setdefault((boot, k, lag), [0.0] * 4)
                for i, v in enumerate((n, *rest)):
                    own[i] += v
    found = {(r.boot, r.kind, r.lag): (r.n, r.sx, r.sy, r.sxy) for r in X.resampled(parts, "aln", 7).collect()}
    assert found.keys() == want.keys() and all(found[k] == pytest.approx(want[k]) for k in want)


def test_settings():
    text = "genome:\n  dir: g\ncov:\n  maxl: 300\n  functions: [a, b]\n  positions:\n    - 1\n    - 4\nfit:\n  exp:\n    start: 3\n"
    got = config.settings(text, {"LOCIWAVE_OUT_DIR": "o"}, reads_dir="r")
    assert (got.genome_dir, got.cov_maxl, got.cov_functions, got.cov_positions, got.fit_exp_start, got.out_dir, got.reads_dir) == ("g", 300, ("a", "b"), (1, 4), 3, "o", "r")
    assert config.settings(text, {"LOCIWAVE_COV_MAXL": "9"}, cov_maxl=5).cov_maxl == 5


def test_proper_pairs(spark):
    m = [("M", 4)]
    data = [("p", 3, 0, "ACGT", 1, m), ("p", 3, 2, "GTAA", 2, m), ("q", 3, 0, "ACGT", 3, m), ("q", 3, 2, "CCAA", 4, m)]
    df = spark.createDataFrame(data, "name string, flags int, pos int, seq string, ord long, cigar array<struct<op:string,len:int>>")
    assert [tuple(r) for r in reads.proper_pairs(df).collect()] == [("p", 1, 2)]


def test_proper_pairs_go_in_twos(spark, tmp_path):
    """Against a buffer with a set of deleted names, as a table and as a stream; state that stays for later batches."""
    from lociwave.streaming import mates

    rng = random.Random(8)
    data = []
    for i in range(160):
        seq = rng.choice(["AAAA", "AAAA", "AAA", "AAAC", ""])
        data.append((f"n{rng.randrange(30)}", i, rng.choice([1, 3, 3, 3]), rng.choice([5, 30, 30]), rng.choice([[("M", 4)]] * 8 + [[("M", 2), ("I", 2)], [("S", 4)]]), rng.randrange(4), seq))
    waiting, deleted, want = {}, set(), []
    for name, i, flags, mapq, cigar, pos, seq in data:
        if not flags & 2:
            continue
        if len(cigar) == 1 and cigar[0][0] == "M" and mapq >= 10:
            if name in waiting:
                j, mate_pos, mate_seq = waiting.pop(name)
                if mates.agree(pos, seq, mate_pos, mate_seq):
                    want.append((name, j, i) if mate_pos <= pos else (name, i, j))
            elif name in deleted:
                deleted.remove(name)
            else:
                waiting[name] = (i, pos, seq)
        elif name in deleted:
            deleted.remove(name)
        elif name in waiting:
            del waiting[name]
        else:
            deleted.add(name)
    df = spark.createDataFrame(data, "name string, ord long, flags int, mapq int, cigar array<struct<op:string,len:int>>, pos long, seq string")
    assert sorted(tuple(r) for r in reads.proper_pairs(df, 10).collect()) == sorted(want) and len(want) > 5
    assert reads.proper_pairs(df.where("false"), 10).count() == 0
    for k in range(3):
        df.where(f"ord % 160 >= {k * 50} and ord < {k * 50 + (50 if k < 2 else 60)}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    mates.proper_pairs(stream, 10).writeStream.format("memory").queryName("mates").option("checkpointLocation", f"{tmp_path}/ck").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert sorted(tuple(r) for r in spark.table("mates").collect()) == sorted(want)
    # A first record is forgotten once the stream is far beyond it.
    for k, rows in enumerate(([("x", 1)], [("y", 500)], [("x", 501), ("y", 502)])):
        spark.createDataFrame([(n, i, 3, 30, [("M", 4)], 7, "ACGT") for n, i in rows], df.schema).coalesce(1).write.parquet(f"{tmp_path}/late/{k}")
        stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/late/*")
        mates.proper_pairs(stream, 10, lateness=100).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck2").outputMode("append").trigger(availableNow=True).start().awaitTermination(60)
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [("y", 500, 502)]


def test_mates_of_many_names_share_states(spark, tmp_path):
    """A state and a call of Python for each bucket of names; names wait over batches, one without a name among them."""
    from lociwave.streaming import mates

    shape = "name long, ord long, flags int, mapq int, cigar array<struct<op:string,len:int>>, pos long, seq string"
    names = [None, *range(1 << 60, (1 << 60) + 2000)]
    record = lambda i, name: (name, i, 3, 30, [("M", 4)], 7, "ACGT")
    for k, rows in enumerate(([record(i, x) for i, x in enumerate(names)], [record(5000 + i, x) for i, x in enumerate(reversed(names))])):
        spark.createDataFrame(rows, shape).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    sink = mates.proper_pairs(stream, 10, buckets=16).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck")
    run = sink.outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    assert 0 < max(p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress if p["stateOperators"]) <= 16
    found = {tuple(r) for r in spark.read.schema("name long, left_ord long, right_ord long").parquet(f"{tmp_path}/out").collect()}
    assert found == {(x, i, 5000 + len(names) - 1 - i) for i, x in enumerate(names)}


def test_streaming_pileup(spark, tmp_path):
    from lociwave.streaming.pileup import site_depths

    for i, pos in enumerate(([1, 1, 2], [300], [600])):
        spark.createDataFrame([("g", p, "A") for p in pos], "genome string, pos long, base string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        query = site_depths(spark.readStream.schema("genome string, pos long, base string").parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName(f"depths{i}").option("checkpointLocation", f"{tmp_path}/ck{i}").outputMode("append").start()
        query.processAllAvailable()
        query.stop()
    assert sorted(tuple(r) for r in spark.table("depths2").collect()) == [("g", 1, 2), ("g", 2, 1), ("g", 300, 1)]


def test_results_in_any_codec(spark, tmp_path):
    """Plain, gzip, zlib and raw DEFLATE files of correlation results give the same rows."""
    import gzip
    import json
    import zlib

    text = "".join(json.dumps({"Ks": k / 4, "VarKs": 1.0, "N": k, "NReads": 2, "Ct": [k / 8], "CtIndices": [0], "CtN": [3]}) + "\n" for k in range(5)).encode()
    raw = zlib.compressobj(9, zlib.DEFLATED, -15)
    for name, data in {"plain": text, "gz": gzip.compress(text), "zlib": zlib.compress(text), "raw": raw.compress(text) + raw.flush()}.items():
        (tmp_path / f"{name}.json").write_bytes(data)
        rows = readers.bootstraps(spark, f"{tmp_path}/{name}.json").collect()
        assert sorted((r.Ks, r.N, r.Ct[0], r.CtN[0]) for r in rows) == [(k / 4, k, k / 8, 3) for k in range(5)]
