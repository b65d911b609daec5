import random
from pathlib import Path

import pytest

from quillspark.llm import packing
from quillspark.llm.packing import RoomIndex, best_fit_decreasing, containers, fill

needs_vocabulary = pytest.mark.skipif(not Path(packing.TOKENIZERS, packing.VOCABULARY).exists(), reason="no vocabulary here")
SCHEMA = "doc_id bigint, text string, part int, size int, grp int, bin int, `key` string"


def _brute(sizes, capacity):
    rooms, out = [], [0] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        fits = [r for r in rooms if r >= sizes[k]]
        if fits:
            at = rooms.index(min(fits))
        else:
            rooms.append(capacity)
            at = len(rooms) - 1
        rooms[at] -= sizes[k]
        out[k] = at
    return out, sorted(rooms)


def test_tightest_container_like_brute_force():
    rng = random.Random(1)
    for _ in range(30):
        capacity = rng.choice([1, 7, 64, 100])
        sizes = [rng.randint(0, capacity) for _ in range(rng.randint(0, 80))]
        bins = best_fit_decreasing(sizes, capacity)
        used: dict[int, int] = {}
        for b, s in zip(bins, sizes, strict=True):
            used[b] = used.get(b, 0) + s
        assert all(u <= capacity for u in used.values())
        assert sorted(capacity - u for u in used.values()) == _brute(sizes, capacity)[1]


def test_room_index_edges():
    rooms = RoomIndex(5)
    assert rooms.take(0) is None and rooms.take(6) is None
    rooms.add(5, 1)
    rooms.add(0, 2)
    assert rooms.take(1) == (5, 1) and rooms.take(0) == (0, 2) and rooms.take(0) is None


@needs_vocabulary
def test_every_text_has_its_place(spark):
    texts = ["word " * n for n in (1, 10, 100, 700, 5000)] + [None, "", "same", "same"]
    df = spark.createDataFrame([(i, t, 0, 0, 0, 0, "x") for i, t in enumerate(texts)], SCHEMA)
    rows = containers(df, capacity=512).collect()
    by: dict[str, int] = {}
    for r in rows:
        by[r.container] = by.get(r.container, 0) + r.token_end - r.token_start
    assert all(v <= 512 for v in by.values())
    assert {r.doc_id for r in rows} == set(range(len(texts)))
    parts = sorted((r.token_start, r.token_end) for r in rows if r.doc_id == 4)
    assert parts[0][0] == 0 and all(a[1] == b[0] for a, b in zip(parts, parts[1:], strict=False)) and len(parts) == -(-parts[-1][1] // 512)
    assert sum(r.doc_id != 4 for r in rows) == len({r.doc_id for r in rows if r.doc_id != 4 and r.doc_id != 3}) + sum(r.doc_id == 3 for r in rows)
    stats = fill(containers(df, capacity=512), 512).first()
    assert stats.containers >= stats.fewest
    assert containers(spark.createDataFrame([], SCHEMA)).count() == 0


@needs_vocabulary
def test_groups_are_merged(spark, monkeypatch):
    df = spark.createDataFrame([(i, "word " * (1 + i * 7 % 97), 0, 0, 0, 0, "x") for i in range(1200)], SCHEMA)
    one = fill(containers(df, capacity=256), 256).first()
    monkeypatch.setattr(packing, "GROUP", 200)
    six = fill(containers(df, capacity=256), 256).first()
    assert six.tokens == one.tokens and one.containers <= six.containers <= one.containers + 2


@needs_vocabulary
def test_null_keys_are_spread_and_vocabularies_bounded(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 10)
    df = spark.createDataFrame([(None, "word " * (1 + i % 37), 0, 0, 0, 0, "x") for i in range(120)], SCHEMA)
    rows = containers(df, capacity=64).collect()
    assert len(rows) == 120 and all(r.doc_id is None for r in rows)
    used: dict[str, int] = {}
    for r in rows:
        used[r.container] = used.get(r.container, 0) + r.token_end - r.token_start
    assert max(used.values()) <= 64 and len({c.split("-")[0] for c in used}) > 3
    monkeypatch.setattr(packing, "VOCABULARY_BYTES", 10)
    with pytest.raises(ValueError):
        containers(df)
