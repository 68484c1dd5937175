"""BAM in splits: every split size gives the rows of one task, records lie over members, cut and odd files fail."""

import random
import struct

import pytest

from lociwave.sources import bam, readers


def _rows(n, rng):
    out = []
    for i in range(n):
        size = rng.choice([0, 1, 7, 60, 150, 3000 if i % 97 == 0 else 20])
        seq = "".join(rng.choice("ACGTN") for _ in range(size)) or "*"
        qual = [rng.randrange(0, 60) for _ in range(size)] if i % 5 else []
        cigar = [{"op": "M", "len": size}] if size else []
        out.append({"read_id": f"read{i}" + "x" * rng.randrange(0, 90), "flags": rng.randrange(4096), "ref": rng.choice(["chr1", "chr2", "*"]), "pos": rng.randrange(-1, 1 << 28), "mapq": rng.randrange(256), "cigar": cigar, "mate_ref": rng.choice(["chr2", "*"]), "mate_pos": rng.randrange(-1, 1000), "seq": seq, "qual": qual})
    return out


def _file(rows, size, names=("chr1", "chr2")):
    data = bam.MAGIC + struct.pack("<i", 3) + b"@HD" + struct.pack("<i", len(names))
    for n in names:
        data += struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", 1 << 28)
    data += b"".join(bam.encoded(r, {n: i for i, n in enumerate(names)}) for r in rows)
    return b"".join(bam.member(data[i : i + size]) for i in range(0, len(data), size)) + bam.END_OF_FILE


def _read(path, split):
    reader = bam.BamReader(str(path), split)
    parts = reader.partitions()
    return [r for p in parts for b in reader.read(p) for r in b.to_pylist()], parts


@pytest.mark.parametrize("size", [300, 1111, 65280])
def test_every_split_size_gives_the_rows(tmp_path, size):
    rows = _rows(250, random.Random(size))
    data = _file(rows, size)
    (tmp_path / "a.bam").write_bytes(data)
    whole, _ = _read(tmp_path / "a.bam", 0)
    assert [{k: v for k, v in r.items() if k != "ord"} for r in whole] == rows
    assert [r["ord"] for r in whole] == sorted({r["ord"] for r in whole})
    for split in (1511, 9001, len(data) // 2, len(data) - 28, len(data) + 1):
        found, parts = _read(tmp_path / "a.bam", split)
        assert found == whole and len(parts) == -(-len(data) // split)


def test_one_record_longer_than_splits(tmp_path):
    rng = random.Random(4)
    rows = _rows(5, rng) + [{**_rows(1, rng)[0], "seq": "ACGT" * 40_000, "qual": [], "cigar": []}] + _rows(5, rng)
    (tmp_path / "a.bam").write_bytes(_file(rows, 4000))
    whole, _ = _read(tmp_path / "a.bam", 0)
    assert len(whole) == 11 and _read(tmp_path / "a.bam", 1500)[0] == whole


def test_odd_files(tmp_path):
    (tmp_path / "none.bam").write_bytes(_file([], 1000))
    assert _read(tmp_path / "none.bam", 40)[0] == []
    data = _file(_rows(50, random.Random(1)), 900)
    (tmp_path / "cut.bam").write_bytes(data[: len(data) // 2])
    with pytest.raises(ValueError):
        _read(tmp_path / "cut.bam", 0)
    (tmp_path / "other.bam").write_bytes(bam.member(b"SAM\1" + bytes(40)) + bam.END_OF_FILE)
    with pytest.raises(ValueError):
        _read(tmp_path / "other.bam", 0)
    with pytest.raises(FileNotFoundError):
        _read(tmp_path / "missing.bam", 0)


def test_wrong_starts_are_found_out(tmp_path, monkeypatch):
    (tmp_path / "a.bam").write_bytes(_file(_rows(300, random.Random(2)), 500))
    real = bam.first_record
    monkeypatch.setattr(bam, "first_record", lambda file, start, size, refs: (lambda w: (w[0], w[1] + 1))(real(file, start, size, refs)))
    with pytest.raises(ValueError):
        _read(tmp_path / "a.bam", 4000)


def test_written_parts_are_read_in_splits(spark, tmp_path):
    rows = _rows(2000, random.Random(9))
    df = spark.createDataFrame(rows, bam.SCHEMA.replace(", ord bigint", "")).repartition(3)
    bam.write(df, f"{tmp_path}/out.bam")
    key = lambda r: r["read_id"]
    for split in (0, 9000):
        own = readers.bam(spark, f"{tmp_path}/out.bam", split)
        got = [{**r.asDict(recursive=True)} for r in own.collect()]
        assert own.rdd.getNumPartitions() == 3 if not split else own.rdd.getNumPartitions() > 6
        assert sorted(({k: v for k, v in r.items() if k != "ord"} for r in got), key=key) == sorted(rows, key=key)
