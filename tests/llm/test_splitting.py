import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm.splitting import RangeMax, Splitter, audit_chunks, boundary_strengths, pieces_of, split_documents

DOC = "document_id string, text string, ingestion_timestamp string, chunk_index int, document string"
CHUNK = "document_id string, chunk_index int, chunk_text string, char_start int, char_end int, text string, held string"


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=80), st.data())
def test_range_maximum_against_brute_force(values, data):
    table = RangeMax(np.array(values, dtype=np.int8), 64)
    lo = data.draw(st.integers(0, len(values) - 1))
    hi = data.draw(st.integers(lo + 1, min(len(values), lo + 64)))
    best = max(values[lo:hi])
    assert table.query(lo, hi) == (best, max(i for i in range(lo, hi) if values[i] == best))


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab .,\n", max_size=400))
def test_pieces_keep_every_rule(text):
    limit, overlap = 40, 8
    pieces = pieces_of(text, limit, overlap)
    assert bool(pieces) == bool(text)
    for k, (a, b, piece) in enumerate(pieces):
        assert b - a <= limit and piece == text[a:b].strip()
        assert a == (0 if k == 0 else pieces[k - 1][1] - overlap)
        window = text[a + overlap : a + limit]
        if b < len(text) and any(c.isspace() for c in window):
            assert text[b - 1].isspace() and boundary_strengths(text)[b - 1] == boundary_strengths(text)[a + overlap : a + limit].max()
    assert not pieces or pieces[-1][1] == len(text)


def test_sizes_that_cannot_work(spark):
    for limit, overlap in ((0, 0), (10, 10), (10, -1)):
        with pytest.raises(ValueError):
            split_documents(spark.createDataFrame([], DOC), limit=limit, overlap=overlap)


def test_own_pieces_pass_the_audit_and_faults_show(spark):
    text = "One sentence here. " * 400
    docs = spark.createDataFrame([("a", text, "1", 0, "x"), ("a", text, "2", 0, "x"), ("b", "short", "1", 0, "x"), ("c", None, "1", 0, "x"), ("d", "", "1", 0, "x"), (None, "t", "1", 0, "x"), ("u", "x" * 1200, "1", 0, "x")], DOC)
    made = split_documents(docs)
    rows = [(r.document_id, r.chunk_index, r.chunk_text, r.char_start, r.char_end, "x", "y") for r in made.collect()]
    assert {r[0] for r in rows} == {"a", "b", "u"}
    found = lambda some: sorted((r.document_id, r.chunk_index) for r in audit_chunks(spark.createDataFrame(some, CHUNK), docs).collect())
    assert found(rows + rows) == [("c", -1), ("d", -1)]
    k = next(i for i, r in enumerate(rows) if r[:2] == ("a", 2))
    broken = list(rows)
    broken[k] = rows[k][:2] + ("other text",) + rows[k][3:]
    assert found(broken) == [("a", 2), ("c", -1), ("d", -1)]
    assert ("a", 3) in found([r for i, r in enumerate(rows) if i != k])
    assert ("zzz", 0) in found([*rows, ("zzz", 0, "t", 0, 1, "x", "y")])
    assert found([]) == [(d, -1) for d in ("a", "b", "c", "d", "u")]
    assert audit_chunks(spark.createDataFrame([], CHUNK), spark.createDataFrame([], DOC)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .,\n\"", max_size=900), st.integers(1, 200))
def test_blocks_do_not_show(text, block):
    whole = list(Splitter(text, 40, 8, 1 << 20))
    assert list(Splitter(text, 40, 8, block)) == whole == pieces_of(text, 40, 8)
    assert all(b == len(text) or Splitter(text, 40, 8, block).permits(a, b) for a, b, _ in whole)


def test_memory_does_not_grow_with_the_text():
    import tracemalloc

    text = "A sentence of some words stands here. " * 200_000
    tracemalloc.start()
    count = sum(1 for _ in Splitter(text))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert count > 15_000 and peak < 20 << 20


def test_audit_of_long_texts_in_parts_and_buckets(spark, monkeypatch):
    from quillspark.llm import splitting

    monkeypatch.setattr(splitting, "BUCKET", 4)
    docs = spark.createDataFrame([("a", "One sentence é here. " * 400, "1", 0, "x"), ("l", "One sentence, no more here. " * 9000, "1", 0, "x"), ("s", "short", "1", 0, "x")], DOC)
    rows = [(r.document_id, r.chunk_index, r.chunk_text, r.char_start, r.char_end, "x", "y") for r in split_documents(docs).collect()]
    assert audit_chunks(spark.createDataFrame(rows, CHUNK), docs).count() == 0
    bad = [r[:3] + (r[3] + 1,) + r[4:] if r[1] % 100 == 7 else r for r in rows] + [("l", None, "t", 0, 1, "x", "y"), ("l", 3, None, None, None, "x", "y")]
    found = {(r.document_id, r.chunk_index) for r in audit_chunks(spark.createDataFrame(bad, CHUNK), docs).collect()}
    assert {r[:2] for r in rows if r[1] % 100 == 7} <= found and ("l", None) in found and ("l", 3) in found
