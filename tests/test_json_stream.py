"""Objects of JSON streams: every cut of the bytes gives the same objects."""

import json
import random

import numpy as np
import pytest

from lociwave.sources import json_stream, readers


def _cut(path, size, step):
    out, state, depth = [], 0, 0
    for at in range(0, size, step):
        stop = min(size, at + step)
        out += list(json_stream.objects_of(str(path), at, stop, size, state, depth))
        states, depths = json_stream.effects(str(path), at, stop)
        state, depth = states[state], depth + depths[state]
    return out


TEXTS = ['}{', '{"', '\\', '\\\\"', 'a\n{b', '"', '\\"}', "", "é}日", "[{"]


def test_every_cut_gives_the_objects(tmp_path):
    rng = random.Random(1)
    items = [{"a": rng.choice(TEXTS) + rng.choice(TEXTS), "b": {"c": [rng.choice(TEXTS), {"d": {}}]}, "e": i} for i in range(14)]
    parts = [json.dumps(x, indent=rng.choice([None, 1]), ensure_ascii=rng.choice([True, False])) + rng.choice(["", "\n", " ,\n"]) for x in items]
    data = ("[" + "".join(parts) + "]").encode()
    (tmp_path / "a.json").write_bytes(data)
    for step in [1, 2, 3, 5, 7, 11, 40, 333, len(data)]:
        assert [json.loads(x) for x in _cut(tmp_path / "a.json", len(data), step)] == items


def test_chunks_are_ranges_too(tmp_path, monkeypatch):
    monkeypatch.setattr(json_stream, "_CHUNK", 5)
    data = b'{"x": "}{\\\\"}{"y": "\\\\\\"{"}\n\n{"z": 1}'
    (tmp_path / "a.json").write_bytes(data)
    for step in range(1, len(data) + 1):
        assert [json.loads(x) for x in _cut(tmp_path / "a.json", len(data), step)] == [{"x": "}{\\"}, {"y": '\\"{'}, {"z": 1}]


def test_open_objects_fail(tmp_path):
    (tmp_path / "a.json").write_bytes(b'{"a": 1} {"b": ')
    with pytest.raises(ValueError):
        _cut(tmp_path / "a.json", 15, 4)


def test_reader(spark, tmp_path):
    rows = [{"Genome": rng, "Position": i, "Pi": i / 4, "Num": 1, "Alleles": {"A": i}} for i, rng in enumerate(TEXTS * 20)]
    for k in range(2):
        (tmp_path / f"{k}.json").write_text("".join(json.dumps(r, indent=i % 2 or None) for i, r in enumerate(rows[k::2])))
    (tmp_path / "2.json").write_text("")
    for size in (50, 1 << 20):
        found = sorted((r.Position, r.Genome, r.Pi, r.Alleles["A"]) for r in readers.diversity_json(spark, f"{tmp_path}/*.json", size).collect())
        assert found == [(r["Position"], r["Genome"], r["Pi"], r["Alleles"]["A"]) for r in rows]


def test_changes_are_those_of_each_state():
    draw = np.random.default_rng(5)
    for n in [1, 2, 3, 5, 40] * 200:
        data = draw.choice(np.frombuffer(b'\\\\\\"{}a', np.uint8), n)
        want = [json_stream.scanned(data, s) for s in (json_stream.OUTSIDE, json_stream.INSIDE, json_stream.ESCAPED)]
        assert json_stream.changes(data) == [(state, int(signs.sum())) for _, signs, state in want]


def test_many_ranges_are_few_tasks(spark, tmp_path):
    """Ranges far smaller than a task's share: no task for each of them."""
    (tmp_path / "x.json").write_text("".join(json.dumps({"a": f'}}{{"{i}\\'}) for i in range(2000)))
    found = json_stream.objects(spark, f"{tmp_path}/x.json", 64)
    assert found.rdd.getNumPartitions() <= 8
    assert sorted(json.loads(r.value)["a"] for r in found.collect()) == sorted(f'}}{{"{i}\\' for i in range(2000))
