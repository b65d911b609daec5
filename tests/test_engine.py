import json
import math
from pathlib import Path

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.functions.text import clean_text, cleaned, document_id, fenced_json, id_list, is_blank, stripped, tokens_lower
from quillspark.functions.vectors import dot, hashed_vectors, l2_normalize, text_prefix
from quillspark import sinks
from quillspark.operators import chunking, detection, experiment, gates, judging, quality, retrieval
from quillspark.plans import rag
from quillspark.sources import datasets, files
from quillspark.streaming import incremental


def test_cleaning():
    assert cleaned(None) == cleaned("") == ""
    assert cleaned("a  b\t c \r\nd\re\f") == "a b c\nd\ne"
    assert cleaned("x​﻿y z　w") == "xy z w"
    assert cleaned("a\n-----\n\n\n\nb\x07") == "a\n\nb"
    assert cleaned("  क्या है ﬁ\n \n x") == "क्या है fi\n\nx"


def test_text_columns(spark):
    df = spark.createDataFrame([(" a ,b,, c ", "   x ", "Kya HAI kya", "t ```json\n{}\n``` u"), (None, None, None, None)], "ids string, s string, q string, f string")
    a, b = df.select(id_list(F.col("ids")).alias("ids"), stripped(F.col("s")).alias("s"), is_blank(F.col("s")).alias("b"), tokens_lower(F.col("q")).alias("t"), fenced_json(F.col("f")).alias("f"), clean_text(F.col("s")).alias("c")).collect()
    assert (a.ids, a.s, a.b, a.t, a.f, a.c) == (["a", "b", "c"], "x", False, ["kya", "hai"], "{}", "x")
    assert (b.ids, b.s, b.b, b.t) == ([], None, True, [])
    assert len(df.select(document_id(F.lit("a/b.txt"), F.lit("3")).alias("x")).first().x) == 16


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    assert [r.u for r in df.select(l2_normalize(F.col("v")).alias("u")).collect()] == [[pytest.approx(0.6), pytest.approx(0.8)], [0.0, 0.0]]
    assert df.select(dot(F.col("v"), F.col("v")).alias("d")).first().d == 25.0
    one, none = hashed_vectors(["hello", ""], 64)
    assert math.isclose(float((one**2).sum()), 1.0, rel_tol=1e-5) and none.sum() == 0 and (hashed_vectors(["x", "hello"], 64)[1] == one).all()
    assert (text_prefix("e5-base", True), text_prefix("e5-base", False), text_prefix("other", True)) == ("query: ", "passage: ", "")


def test_top_k_ties_blocks_and_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 1.0]), (4, [0.0, 1.0]), (5, None), (6, [1.0])]
    corpus = spark.createDataFrame(rows, "id bigint, embedding array<float>")
    queries = spark.createDataFrame([(1, [0.5, 0.5]), (9, [0.0, 2.0])], "query_id bigint, embedding array<float>")
    hits = lambda **kw: sorted((r.query_id, r.id, r["rank"]) for r in retrieval.top_k(queries, corpus, 2, **kw).collect())
    for block in (1, 10):
        assert hits(block=block, without_self=True) == [(1, 2, 1), (1, 3, 2), (9, 2, 1), (9, 3, 2)]
        assert hits(block=block) == [(1, 1, 1), (1, 2, 2), (9, 2, 1), (9, 3, 2)]  # a row of the same key in another table is a row
    assert retrieval.top_k(queries, corpus.limit(0), 2).count() == 0 and retrieval.top_k(queries.limit(0), corpus, 2).count() == 0
    assert retrieval.top_k(queries, corpus, 50).count() == 4 + 4
    ragged = queries.union(spark.createDataFrame([(7, [2.0]), (8, [1.0, 1.0, 1.0])], queries.schema))
    assert {(r.query_id, r.id) for r in retrieval.top_k(ragged, corpus, 1).collect()} == {(1, 1), (9, 2), (7, 6)}


def test_top_k_equals_brute_force_over_many_rows(spark):
    rng = np.random.default_rng(3)
    v, q = rng.integers(-2, 3, (3000, 6)).astype(float), rng.integers(-2, 3, (700, 6)).astype(float)  # many ties
    v[5, 0] = np.nan
    corpus = spark.createDataFrame([(f"k{i}", x.tolist()) for i, x in enumerate(v)], "id string, embedding array<double>").coalesce(1)
    queries = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "query_id int, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.id, r.score) for r in retrieval.top_k(queries, corpus, 7).collect()}
    scores = q @ v.T
    for i in range(len(q)):
        best = sorted((-s, f"k{j}") for j, s in enumerate(scores[i]) if s == s)[:7]
        assert [got[i, n + 1] for n in range(7)] == [(key, -s) for s, key in best]


def test_few_scores_are_looked_at():
    rng = np.random.default_rng(4)
    v, q = rng.normal(size=(8192, 64)), rng.normal(size=(64, 64))
    s = (v @ q.T).astype(np.float32)
    floor = np.sort(s, axis=0)[-5]
    row, at = retrieval._near(s, floor, np.zeros(64), 5)
    assert len(row) == 5 * 64 and (s[row, at] >= floor[at]).all()


def test_equal_vectors_are_searched_once(spark, monkeypatch):
    texts = [("fees are due in June", 9), ("hostel rooms open in July", 2), ("the library is closed", 1)]
    rows = [(f"d{n}_{t[:2]}{i}", "d", t) for n, (t, times) in enumerate(texts) for i in range(times)]
    chunks = spark.createDataFrame(rows, "chunk_id string, document_id string, chunk_text string")
    asked = spark.createDataFrame([("when are fees due",), ("rooms in July",)], "query string")
    ids = lambda: {r.query: [h.chunk_id for h in r.hits] for r in rag.search(asked, rag.build_index(chunks), 4).collect()}
    sizes, plain = [], retrieval.top_k
    monkeypatch.setattr(rag, "top_k", lambda queries, corpus, k, **kw: sizes.append((corpus.count(), k)) or plain(queries, corpus, k, **kw))
    once = ids()
    monkeypatch.setattr(rag, "DISTINCT_SHARE", 0.0)
    assert ids() == once and sizes == [(3, 4), (12, 4)] and once["when are fees due"] == [f"d0_fe{i}" for i in range(4)]
    requests = spark.createDataFrame([("a", "fees", True, 3), ("b", "rooms", True, 99), ("c", " ", True, 9)], "request_id string, query string, mitigation_enabled boolean, top_k int")
    assert {r.request_id: len(r.retrieved_document_ids or []) for r in rag.chat(requests, rag.build_index(chunks)).collect()} == {"a": 3, "b": 0, "c": 0}
    assert sizes[2:] == [(12, 3)]  # as many hits as a valid request wants


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab .\n", max_size=300))
def test_cuts_cover_the_text(text):
    text = text.strip()
    made = list(chunking.cuts(text, 50, 10))
    assert bool(made) == bool(text)
    assert all(b - a <= 50 for a, b in made)
    assert all(y[0] == x[1] - 10 for x, y in zip(made, made[1:], strict=False))
    assert not made or (made[0][0] == 0 and made[-1][1] == len(text))


def test_cut_preferences_and_chunk_rows(spark):
    assert next(chunking.cuts("aaaaaa. bbbb? cccc dddd", 20, 5)) == (0, 8)  # periods come before question marks
    assert next(chunking.cuts("aaaaaa\n\nbb. cc dd ee ff gg", 20, 5)) == (0, 8)
    docs = spark.createDataFrame([("d", "f.txt", "s", "txt", "T", "word " * 60, {"k": "v", "title": "old"}, "now"), ("e", "f", "s", "txt", None, "  ", None, "now"), ("n", "f", "s", "txt", None, None, None, "now")], "document_id string, filename string, source string, document_type string, title string, text string, metadata map<string,string>, ingestion_timestamp string")
    rows = sorted(chunking.chunk_documents(docs, 120, 30).collect(), key=lambda r: r.chunk_index)
    assert [r.chunk_id for r in rows] == [f"d_c{i}" for i in range(len(rows))] and len(rows) > 2
    assert rows[0].metadata == {"k": "v", "title": "T", "filename": "f.txt", "source": "s", "document_type": "txt", "chunk_size_chars": str(len(rows[0].chunk_text))}
    for bad in ((100, 100), (100, 120), (-50, 10), (100, -10)):
        with pytest.raises(ValueError):
            chunking.chunk_documents(docs, *bad)


def test_loaders(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("﻿First line\nmore".encode())
    (tmp_path / "l.txt").write_bytes("café".encode("latin-1"))
    (tmp_path / "b.csv").write_text('Topic,Question,Answer,Category\nT,"What, now?",Do it,C\n,,,\nX,,,Y\n')
    (tmp_path / "c.json").write_text(json.dumps([{"title": "A", "content": "body", "channel": "web"}, {"x": 1}, "plain"]))
    (tmp_path / "bad.json").write_text("{")
    (tmp_path / "z.zip").write_bytes(b"PK")
    (tmp_path / ".hidden.txt").write_text("no")
    (tmp_path / "p.pdf").write_bytes(b"%PDF-1.4\nstream\nBT (Hello \\(x\\)) Tj ET\nendstream")
    (tmp_path / "t.pdf").write_bytes(b"%PDF-1.4\n/Title (Of the meta)\nstream\nBT (One) Tj ET\nendstream\nstream\nbroken\nendstream")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "deep.txt").write_text("not looked at")
    scanned = files.scan_documents(spark, str(tmp_path))
    loaded = files.load_files(scanned).cache()
    docs = {(r.filename, r.title): r for r in files.documents(loaded).collect()}
    assert docs["a.txt", "First line"].text == "First line\nmore" and docs["l.txt", "café"].text == "café"
    q = docs["b.csv", "What, now?"]
    assert q.text == "Question: What, now?\nAnswer: Do it" and q.metadata["Topic"] == "T" and q.metadata["Category"] == "C" and q.metadata["row_index"] == "0"
    assert docs["b.csv", "b Row 3"].text == "Topic: X\nCategory: Y" and ("b.csv", "b Row 2") not in docs
    assert docs["c.json", "A"].text == "A\n\nbody" and docs["c.json", "A"].metadata["channel"] == "web"
    assert docs["c.json", "c #2"].text == '{\n"x": 1\n}' and docs["c.json", "c Item 3"].text == "plain"
    assert docs["c.json", "c #2"].metadata == {"x": "1", "index": "1"} and len({d.document_id for d in docs.values()}) == len(docs)
    assert docs["p.pdf", "Hello (x)"].document_type == "pdf" and docs["t.pdf", "Of the meta"].metadata["extracted_pages"] == "1" and not any(f == "deep.txt" for f, _ in docs)
    assert {r.path.rsplit("/", 1)[1] for r in files.ingest_failures(loaded).collect()} == {"bad.json", "z.zip"}
    assert quality.corpus_manifest(scanned).first().num_source_documents == 8


def test_datasets(spark, tmp_path):
    (tmp_path / "q.csv").write_text('question_id,english,expected_document_ids\nq1,"a, b","d1, d2,,"\n')
    assert datasets.load_queries(spark, str(tmp_path / "q.csv")).first().expected_document_ids == ["d1", "d2"]
    (tmp_path / "q.json").write_text('[{"question_id": "q1"}, {"question_id": "q2"}]')
    (tmp_path / "q.jsonl").write_text('{"question_id": "q1"}\n\n{"question_id": "q2"}\n')
    assert datasets.load_queries(spark, str(tmp_path / "q.json")).count() == datasets.load_queries(spark, str(tmp_path / "q.jsonl")).count() == 2
    (tmp_path / "lines.json").write_text("".join(f'{{"question_id": "q{i}"}}\n' for i in range(5)))
    assert sorted(r.question_id for r in datasets.load_queries(spark, str(tmp_path / "lines.json")).collect()) == [f"q{i}" for i in range(5)]
    (tmp_path / "pretty.json").write_text('{\n  "question_id": "q1"\n}')
    with pytest.raises(Exception, match="(?i)malformed"):
        datasets.load_queries(spark, str(tmp_path / "pretty.json")).collect()
    (tmp_path / "sheet.csv").write_text('question_id,reviewer_1_comments,reviewer_1_decision\nq1,"two\nlines",\n')
    sheet = datasets.read_review_sheet(spark, str(tmp_path / "sheet.csv")).first()
    assert (sheet.reviewer_1_comments, sheet.reviewer_1_decision) == ("two\nlines", "")
    with pytest.raises(FileNotFoundError):
        datasets.load_index(spark, str(tmp_path / "none"))
    stored = spark.createDataFrame([(1, "e", "q", '["a"]'), (2, "e", "p", "broken"), (3, "f", "q", None)], "id int, experiment_id string, question_id string, retrieved_document_ids string")
    assert [(r.id, r.retrieved_document_ids) for r in datasets.scan_results(stored).collect()] == [(2, []), (1, ["a"]), (3, [])]
    assert datasets.scan_results(stored, "f").count() == 1
    with pytest.raises(FileNotFoundError):
        datasets.load_queries(spark, str(tmp_path / "none.json"))
    with pytest.raises(ValueError):
        datasets.load_queries(spark, str(tmp_path))
    assert datasets.read_jsonl(spark, str(tmp_path / "none")).count() == 0


def test_detection(spark):
    cases = {
        "How do I reset my password?": (False, ["English"], 0.7), "college admission-ku eligibility என்ன?": (True, ["English", "Tamil"], 0.85), "Mera account balance क्या है?": (True, ["English", "Hindi"], 0.85),
        "": (False, ["Unknown"], 1.0), "balance क्या": (True, ["English", "Hindi"], 0.95), "12 34": (False, ["Unknown"], 0.7), "என்ன": (False, ["Tamil"], 0.7),
    }
    df = spark.createDataFrame([(k,) for k in cases], "q string").withColumn("d", detection.detect(F.col("q")))
    assert {r.q: (r.d.is_code_mixed, r.d.languages, float(r.d.confidence)) for r in df.collect()} == cases
    assert detection.spans_of("ok yes क 12") == [(0, 6, "English", "ok yes"), (7, 8, "Hindi", "क"), (9, 11, "Unknown", "12")]


def test_normalization_routes(spark):
    def provider(q):
        if "boom" in q:
            raise RuntimeError
        return "" if "empty" in q else f' "{q.upper()}" '

    df = spark.createDataFrame([(1, "plain english"), (2, "mera loan"), (3, "mera boom"), (4, "mera empty"), (5, None), (6, "என்ன")], "id int, q string")
    got = {r.id: (r.normalized_query, r.normalization_applied, r.error_fallback) for r in detection.normalize(df, "q", provider).collect()}
    assert got == {1: ("plain english", False, False), 2: ("MERA LOAN", True, False), 3: ("mera boom", False, True), 4: ("mera empty", False, True), 5: (None, False, False), 6: ("என்ன", True, False)}
    assert not {r.id: r for r in detection.normalize(df, "q", provider, mixed_only=True).collect()}[6].normalization_applied


def test_judge_replies(spark):
    cases = {
        '{"faithfulness_score": 0.72, "explanation": "ok"}': (0.72, True, "ok"), '{"faithfulness_score": 1.5}': (1.0, False, judging.NO_EXPLANATION), '{"faithfulness_score": -0.3, "explanation": null}': (0.0, True, judging.NO_EXPLANATION),
        '```json\n{"faithfulness_score": 0.8}\n```': (0.8, False, judging.NO_EXPLANATION), '{"faithfulness_score": NaN}': (1.0, False, judging.NO_EXPLANATION), '{"faithfulness_score": "0.9"}': (0.9, False, judging.NO_EXPLANATION),
    }
    none = ["", "  ", "nonsense", '{"score": 1}', '{"faithfulness_score": "high"}']
    cut = '{"faithfulness_score": 0.4, "explanation": "the ans'
    df = spark.createDataFrame([(x,) for x in (*cases, *none, cut, None)], "r string").withColumn("p", judging.parse_reply(F.col("r")))
    got = {r.r: tuple(r.p) for r in df.collect()}
    for reply, expect in cases.items():
        assert got[reply] == expect
    assert all(got[x][:2] == (None, None) for x in (*none, None))
    assert got[cut] == (0.4, True, judging.RECOVERED + cut)


def test_matrix_resume_recall(spark):
    queries = spark.createDataFrame([("q1", "a", "b", "c"), ("q2", "d", "e", "f"), ("q2", "d", "e", "f")], "question_id string, english string, tamil_english string, hindi_english string")
    matrix = experiment.experiment_matrix(queries)
    assert matrix.count() == 12 and experiment.experiment_matrix(queries, ["english"], True).count() == 2
    runs = spark.sql("select 'english_baseline' experiment_id, 'q1' question_id, 'english' language, false mitigation_enabled, cast(null as string) error, current_timestamp() completed_at union all select 'english_baseline', 'q2', 'english', false, 'Rate limit 429', current_timestamp()")
    assert experiment.resume_pending(matrix, runs).count() == 11
    summary = {r.experiment_id: (r.total, r.pending, r.skipped) for r in experiment.dry_run_summary(matrix, runs).collect()}
    assert summary["english_baseline"] == (2, 1, 1) and summary["english_mitigated"] == (2, 2, 0)
    assert experiment.transient_errors(runs.withColumn("id", F.lit(1))).first().transient
    cells = spark.createDataFrame([(["d_c10", "x"], ["d_c1"]), (["x", "y"], ["y"]), (["x"], []), (None, ["x"])], "r array<string>, e array<string>")
    assert [tuple(r) for r in cells.select(experiment.success_at(F.col("r"), F.col("e"), 1), experiment.success_at(F.col("r"), F.col("e"), 3)).collect()] == [(1.0, 1.0), (0.0, 1.0), (0.0, 0.0), (0.0, 0.0)]


def test_rag_end_to_end(spark):
    chunks = spark.createDataFrame([("d1_c0", "d1", "The library fee is Rs. 500 per year. It is paid in June"), ("d2_c0", "d2", "Hostel rooms open in July")], "chunk_id string, document_id string, chunk_text string")
    asked = spark.createDataFrame([("1", "what is the library fee per year"), ("2", "  "), ("3", "mera hostel rooms open kab")], "query_id string, query string")
    got = {r.query_id: r for r in rag.answer(asked, rag.build_index(chunks)).collect()}
    assert got["1"].retrieved_document_ids[0] == "d1_c0" and "Rs" in got["1"].generated_answer and got["1"].faithfulness_score > 0.8
    assert got["2"].retrieved_document_ids is None and got["3"].is_code_mixed

    def broken(a, b):
        raise TimeoutError("no reply")

    quick = rag.Retry(2, 0.0)
    failed = rag.answer(asked, rag.build_index(chunks), generate=broken, generator_retry=quick).filter("query_id = '1'").first()
    assert failed.generated_answer is None and "no reply" in failed.error and failed.faithfulness_score is None and failed.hallucination_flag is None
    unjudged = rag.answer(asked, rag.build_index(chunks), judge=broken, judge_retry=quick).filter("query_id = '1'").first()
    assert unjudged.generated_answer and unjudged.hallucination_flag is None and unjudged.faithfulness_explanation.startswith("Judge unavailable: ")


def test_retries_wait_longer_each_time():
    waits, calls = [], []

    def flaky(a, b):
        calls.append(a)
        if len(calls) < 3:
            raise RuntimeError("503 from the service")
        return "ok"

    assert rag.called(flaky, "a", "b", rag.Retry(4, 2.0, sleep=waits.append)) == ("ok", None, 3) and waits == [2.0, 4.0]

    def wrong(a, b):
        raise ValueError("bad request")

    assert rag.called(wrong, "a", "b", rag.Retry(4, 2.0, sleep=waits.append))[2] == 1
    assert rag.called(wrong, "a", "b", rag.Retry(3, 2.0, only_transient=False, sleep=waits.append)) == (None, "ValueError: bad request", 3) and waits == [2.0, 4.0, 2.0, 4.0]


def test_chat_and_own_detector(spark):
    chunks = spark.createDataFrame([(f"d{i}_c0", f"d{i}", f"The library fee of year {i} is Rs. {i}00") for i in range(8)], "chunk_id string, document_id string, chunk_text string")
    rows = [("a", "mera library fee", True, 2), ("b", "library fee", None, None), ("c", "library fee", True, 21), ("d", " ", True, 1), ("e", "mera library fee", False, 1)]
    asked = spark.createDataFrame(rows, "request_id string, query string, mitigation_enabled boolean, top_k int")
    got = {r.request_id: r for r in rag.chat(asked, rag.build_index(chunks), normalizer=detection.content_words).collect()}
    assert len(got["a"].retrieved_document_ids) == 2 and len(got["b"].retrieved_document_ids) == 5 and (got["a"].normalized_query, got["e"].normalized_query) == ("library fee", None)
    assert got["c"].error == "top_k must be from 1 to 20" and got["d"].error == "query must not be blank" and got["c"].answer == "" and got["d"].faithfulness_score is None
    none = lambda q: F.struct(F.lit(False).alias("is_code_mixed"), F.array(F.lit("English")).alias("languages"), F.lit(1.0).alias("confidence"))
    assert {r.is_code_mixed for r in rag.answer(asked, rag.build_index(chunks), "request_id", detector=none).collect()} == {False}


def test_gates_of_files(spark, tmp_path):
    land = tmp_path / "in"
    land.mkdir()
    (land / "a.txt").write_text("one")
    chunks = spark.createDataFrame([("c1", "text"), ("c2", " ")], "chunk_id string, chunk_text string")
    parts = {"chunks": str(tmp_path / "chunks")}
    chunks.coalesce(1).write.json(parts["chunks"])
    data, manifest = str(tmp_path / "q.jsonl"), str(tmp_path / "manifest.json")
    checks = lambda: [r.check for r in gates.file_preflight(spark, data, manifest, parts).collect()]
    assert checks() == ["dataset missing"]
    Path(data).write_text("{}")
    assert checks() == ["manifest missing"]
    Path(manifest).write_text("{")
    assert checks() == ["manifest unreadable"]
    Path(manifest).write_text("{}")
    assert checks() == ["manifest without corpus_hash"]
    gates.write_manifest(spark, str(land), parts, manifest)
    assert checks() == []
    chunks.limit(1).write.mode("overwrite").json(parts["chunks"])
    assert checks() == ["part differs from manifest"]
    parts["index"] = str(tmp_path / "none")
    assert "part missing" in checks()
    found = gates.corpus_gates(chunks, chunks.limit(1))
    assert {r.gate: r.status for r in found.collect()} == {"empty chunks": "FAIL", "index size": "FAIL"}
    assert gates.write_preflight_report(found, str(tmp_path / "p.md")) == "FAIL" and "index size" in (tmp_path / "p.md").read_text()
    with pytest.raises(PermissionError):
        gates.guard_target("/x/Pilot.db", ("pilot",))
    digest = gates.release_snapshot(spark, str(land), {}, str(tmp_path / "release"))
    assert (tmp_path / "release" / "manifest.sha256").read_text().split()[0] == digest and (tmp_path / "release" / "documents" / "a.txt").exists()


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a"]), (2, None)], "id int, ids array<string>")
    sinks.export_json(df.orderBy("id"), str(tmp_path / "x.json"))
    assert json.loads((tmp_path / "x.json").read_text()) == [{"id": 1, "ids": ["a"]}, {"id": 2, "ids": None}]
    sinks.export_csv(df.limit(0), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()
    with pytest.raises(ValueError):
        sinks.few_rows(df, 1)
    vectors = spark.createDataFrame([("a", [1.0])], "chunk_id string, embedding array<double>")
    chunks = spark.createDataFrame([("a", "d", "t"), ("b", "d", "t")], "chunk_id string, document_id string, chunk_text string")
    assert rag.index_of(chunks.limit(1), vectors).count() == 1
    with pytest.raises(ValueError):
        rag.index_of(chunks, vectors)


def test_own_reader(spark):
    files.register_reader(".md", lambda data: iter([files.Part("text", data.decode().lstrip("# "))]))
    try:
        scanned = spark.createDataFrame([("p/x.md", "x.md", ".md", bytearray(b"# Head\nbody"))], "path string, filename string, extension string, content binary")
        assert [(r.title, r.text) for r in files.documents(files.load_files(scanned)).collect()] == [("Head", "Head\nbody")]
    finally:
        del files.READERS[".md"]


def test_quality(spark):
    queries = spark.createDataFrame([("q1", "A", "b", "c", ["d1", "d2"]), ("q2", "a", " ", "f", []), ("SMOKE-1", "x", "y", "z", ["d9"])], "question_id string, english string, tamil_english string, hindi_english string, expected_document_ids array<string>")
    chunks = spark.createDataFrame([("d1", 1, "later", "d1_c1"), ("d1", 0, "first\npart", "d1_c0"), ("d2", 0, "other", "d2_c0")], "document_id string, chunk_index int, chunk_text string, chunk_id string")
    found = {(r.check, r.key) for r in quality.preflight_violations(queries, chunks).collect()}
    assert found == {("mock row", "SMOKE-1"), ("blank tamil_english", "q2"), ("no expected documents", "q2"), ("expected document not indexed", "SMOKE-1:d9")}
    assert {r.question_id: r.evidence for r in quality.gold_evidence(queries, chunks).collect()} == {"q1": "first part | other", "q2": quality.NO_EVIDENCE, "SMOKE-1": quality.NO_EVIDENCE}
    assert [tuple(r) for r in quality.duplicate_queries(queries).collect()] == [("english", "a", 2)]
    with pytest.raises(KeyError):
        quality.apply_review(queries, spark.createDataFrame([("none", "Tamil", "t")], "question_id string, language_variant string, final_approved_query_text string"))
    one, two = (quality.corpus_hash(c, "chunk_id", "chunk_text").first().corpus_hash for c in (chunks, chunks.orderBy("chunk_text").union(chunks)))
    assert one == two


def test_streaming_ingest_and_append(spark, tmp_path):
    land, out = tmp_path / "in", str(tmp_path / "chunks")
    land.mkdir()
    for k in range(2):
        (land / f"f{k}.txt").write_text(f"text number {k}")
        incremental.ingest_new_files(spark, str(land), out, str(tmp_path / "cp")).awaitTermination(120)
    assert {r.chunk_text for r in spark.read.parquet(out).collect()} == {"text number 0", "text number 1"}
    runs = spark.range(4).selectExpr("concat('r', id % 3) run_id", "id")
    runs.write.parquet(str(tmp_path / "runs"))
    for k in range(2):
        stream = spark.readStream.schema(runs.schema).parquet(str(tmp_path / "runs"))
        incremental.append_new_runs(stream, str(tmp_path / "stored"), str(tmp_path / f"cp2{k}")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "stored")).count() == 3


def test_every_sql_names_a_query():
    import __spark_entry__ as driver

    assert driver.oracle_sql().keys() <= driver.queries().keys()
    for sql in driver.oracle_sql().values():
        duckdb.extract_statements(sql)
