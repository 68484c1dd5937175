"""Aligned families through a workspace against plain loops over alignments."""

import base64
import json
import random

import numpy as np
import pytest

from lociwave import flows
from lociwave.operators import substitutions as X
from lociwave.sources import readers
from lociwave.sources.config import settings

MAXL = 9
OTHER = str.maketrans("ATGC", "TACG")
CONFIG = f"genome:\n reference: ref\nspecies:\n file: species.yaml\ncov:\n maxl: {MAXL}\n positions: [0, 3, 1]\n"


def made(draw, genomes, families, expanded):
    """Records cut from the genomes (some on the other strand, one around the origin, one untrusted), changed and gapped."""
    out = []
    for f in range(families):
        own = []
        for g, (acc, seq) in enumerate(genomes.items()):
            if f % 3 == 2 and g == 2:
                continue
            start, n = draw.randrange(1, 60), 18
            strand = "-" if f % 2 else "+"
            to = start + n - 1
            text = seq[start - 1 : to]
            if f == 4 and g == 0:
                start, to, strand = len(seq) - 7, 10, "+"
                text = seq[start - 1 :] + seq[:to]
            if strand == "-":
                text = text.translate(OTHER)[::-1]
            if f == 5 and g == 1:
                text = text[:3] + ("A" if text[3] != "A" else "T") + text[4:]
            at = draw.randrange(12, 18)
            text = text[:at] + "--" + text[at:]
            own.append((acc, text, start, to, strand))
        own.append((list(genomes)[1], "".join(draw.choice("ATGCN") for _ in range(len(own[0][1]))), 1, 20, "+"))
        out.append(own)
    return out


def saved(families):
    coded = lambda x: base64.b64encode(x.encode()).decode()
    return json.dumps([[{"Id": f"{a}{i}", "Name": "n", "Genome": f"{a}.1", "Code": "11", "Prot": "", "Nucl": coded(t), "Loc": {"From": s, "To": e, "Strand": d}} for i, (a, t, s, e, d) in enumerate(own)] for own in families])


def subs_of(own, acc, seq, kinds, position, function):
    """A matrix of substitutions for each trusted reference record of the genome."""
    for i, (a, text, start, to, strand) in enumerate(own):
        if a != acc:
            continue
        if to > start - 1:
            nucl, prof = seq[start - 1 : to], kinds[start - 1 : to]
            if strand == "-":
                nucl, prof = nucl.translate(OTHER)[::-1], prof[::-1]
        else:
            nucl, prof = seq[start - 1 :] + seq[:to], kinds[start - 1 :] + kinds[:to]
        keep = [k for k, x in enumerate(text) if x in "ATGC"]
        read = [text[k] for k in keep]
        n = next((k for k in range(min(len(read), len(nucl))) if read[k] != nucl[k]), min(len(read), len(nucl)))
        if n < len(text) // 2:
            continue
        strip = lambda t, keep=keep, n=n: [t[k] for k in keep][:n]
        if function == "genomes_vs_genome":
            pairs = [(strip(text), strip(t)) for b, t, *_ in own if b != acc]
        else:
            pairs = [(strip(own[j][1]), strip(own[k][1])) for j in range(len(own)) for k in range(j + 1, len(own))]
        match = {3: "34"}.get(position, str(position))
        yield [[float(x != y) if p in match and x in "ATGC" and y in "ATGC" else None for x, y, p in zip(one, two, prof, strict=False)] for one, two in pairs]


def expected(families, strains, acc, seq, kinds, position, function):
    """(type, kind, lag) -> mean of each row's pairs and places, by plain loops: Ks, Ct and Cs."""
    found = {}
    for own in families:
        types = ["pan", "core" if len({a for a, *_ in own}) == strains else "disp"]
        for matrix in subs_of(own, acc, seq, kinds, position, function):
            for t in types:
                for row in matrix:
                    for i, x in enumerate(row):
                        for lag, y in enumerate(row[i : i + MAXL]):
                            if x is not None and y is not None:
                                found.setdefault((t, "Ct", lag), []).append((x, y))
                lead = [k for k, x in enumerate(matrix[0]) if x is not None] if len(matrix) > 3 else []
                for i in lead:
                    for j in lead:
                        if 0 <= j - i < MAXL and all(r[i] is not None and r[j] is not None for r in matrix):
                            x, y = (np.array([r[k] for r in matrix]) for k in (i, j))
                            found.setdefault((t, "Cs", j - i), []).append((x * y).mean() - x.mean() * y.mean())
    out, step = {}, 1 if position == 0 else 3
    for (t, kind, lag), v in found.items():
        if kind == "Ct" and lag == 0:
            xs = [x for x, _ in v]
            out[t, "Ks", 0] = (np.mean(xs), len(xs))
        if lag % step == 0 and lag // step < MAXL // step:
            a = np.array(v)
            out[t, kind, lag // step] = (float((a[:, 0] * a[:, 1]).mean() - a[:, 0].mean() * a[:, 1].mean()) if kind == "Ct" else float(a.mean()), len(v))
    return out


def test_cov_genomes(spark, tmp_path):
    draw = random.Random(3)
    genomes = {f"NC_00000{i}": "".join(draw.choice("ATGC") for _ in range(90)) for i in (1, 2, 3)}
    # Genomes that mostly agree, so that substitutions are rare and common ones of several rows.
    kinds = {a: "".join(draw.choice("00123413") for _ in range(90)) for a in genomes}
    plain, wide = made(draw, genomes, 7, False), made(draw, genomes, 6, True)
    files = {"config.yaml": CONFIG, "species.yaml": "one: [" + ", ".join(f"s/{a}" for a in genomes) + "]\ntwo: [s/none]\n"}
    files["reference_strains.json"] = json.dumps([{"Name": a, "Path": f"s/{a}", "GeneticCode": "11", "Genomes": [{"Accession": f"{a}.1", "Replicon": "chromosome"}]} for a in genomes] + [{"Name": "x", "Path": "s/none", "GeneticCode": "11", "Genomes": [{"Accession": "NC_000009", "Replicon": "chromosome"}]}])
    files |= {f"ref/s/{a}/{a}.fna": f">{a}\n{seq[:50]}\n{seq[50:]}\n" for a, seq in genomes.items()}
    files |= {"ortho/one_orthologs_aligned.json": saved(plain), "ortho/one_expanded_orthologs_aligned.json": saved(wide)}
    files |= {f"ref/profiles/{a}.pos": "".join(chr(int(k)) for k in text) for a, text in kinds.items()}
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    path = str(tmp_path)
    with pytest.warns(UserWarning, match="two_orthologs_aligned"):
        flows.cov_genomes(spark, settings(flows.loaded(path), {}), path)
    found = {}
    for r in (json.loads(x["value"]) for x in spark.read.text(f"{path}/cov/genomes").collect()):
        own = {(r["type"], "Ks", 0): (r["Ks"], r["N"])}
        own |= {(r["type"], k, lag): (v, n) for k in ("Ct", "Cs") for lag, v, n in zip(r[f"{k}Indices"], r[k], r[f"{k}N"], strict=True)}
        found.setdefault((r["accession"], r["function"], r["position"]), {}).update(own)
        assert r["strain"] == f"s/{r['accession']}" and r["species"] == "one"
    seen = set()
    for acc, seq in genomes.items():
        for function in ("genomes_vs_genome", "genomes_vs_genomes"):
            for position in (0, 3, 1):
                want = expected(wide if position == 0 else plain, 3, acc, seq, kinds[acc], position, function)
                want = {k: v for k, v in want.items() if want[k[0], "Ks", 0][1] > 1}
                got = found.get((acc, function, position), {})
                assert got.keys() == want.keys()
                for k, (value, n) in want.items():
                    assert got[k] == (pytest.approx(value), n)
                seen |= {(k[0], k[1]) for k in want}
    assert {("core", "Cs"), ("disp", "Ct"), ("pan", "Ct")} <= seen


def test_no_families(spark, tmp_path):
    (tmp_path / "ortho").mkdir()
    with pytest.warns(UserWarning), pytest.raises(FileNotFoundError):
        flows._families(spark, settings(CONFIG, {}), str(tmp_path), ["one"], [0, 1])


def test_both_layouts(spark, tmp_path):
    record = lambda i, nucl: {"Id": f"r{i}", "Name": "n[{", "Genome": "g", "Code": "11", "Prot": "", "Nucl": base64.b64encode(nucl.encode()).decode(), "Loc": {"From": i, "To": 2, "Strand": "+"}}
    data = [[record(1, "AT"), record(2, "")], [record(3, "G-")]]
    texts = {"one": json.dumps(data), "wide": json.dumps(data, indent=1), "close": json.dumps(data, separators=(",", ":")), "lines": "\n".join(["", *map(json.dumps, data), ""]), "none": "[]"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
        rows = readers.families(spark, str(tmp_path / name)).orderBy("id").collect()
        got = [(r["id"], r["idx"], r["nucl"], r["loc"]["From"]) for r in rows]
        assert got == ([] if name == "none" else [("r1", 0, "AT", 1), ("r2", 1, "", 2), ("r3", 0, "G-", 3)])
        assert len({r["family_id"] for r in rows}) == (0 if name == "none" else 2)


def test_states_are_no_broadcast(spark):
    """Keys of alignments repeat and shuffle as few bytes; the tables behind them don't go through the driver."""
    subs = spark.range(2000).selectExpr("struct(id % 5 AS k, 'a function' AS function) AS aln", "id % 20 AS row", "id div 20 AS pos", "CAST(hash(id) % 2 = 0 AS double) AS x")
    found = X.states(subs, 9)
    assert {r.kind for r in found.collect()} == {"Ks", "Ct", "Cs", "Cm", "Cr"}
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
