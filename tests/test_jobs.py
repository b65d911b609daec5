import json

import pytest

from quillspark import jobs


def test_from_files_to_report(spark, tmp_path, capsys):
    land = tmp_path / "in"
    land.mkdir()
    (land / "library.txt").write_text("The library fee is Rs. 500 per year. It is paid in June at the counter.")
    (land / "hostel.csv").write_text("question,answer\nWhen do rooms open?,Hostel rooms open in July every year\n")
    out = tmp_path / "out"
    jobs.main(["ingest", str(land), str(out)])
    jobs.main(["index", f"{out}/chunks", f"{out}/index"])
    jobs.main(["search", f"{out}/index", "library fee per year", "-k", "1"])
    assert "library fee" in capsys.readouterr().out
    ids = {r.document_type: r.document_id for r in spark.read.json(f"{out}/documents").collect()}
    rows = [{"question_id": f"q{i}", "english": q, "tamil_english": f"{q} evlo", "hindi_english": f"{q} kitna hai", "domain": "d", "script_type": "Romanized", "expected_document_ids": [d]} for i, (q, d) in enumerate((("library fee per year", ids["txt"]), ("hostel rooms open", ids["csv"])))]
    (tmp_path / "q.jsonl").write_text("\n".join(map(json.dumps, rows)))
    jobs.main(["validate", str(tmp_path / "q.jsonl"), f"{out}/index"])
    for _ in range(2):  # the second run finds nothing left to do
        jobs.main(["experiment", str(tmp_path / "q.jsonl"), f"{out}/index", f"{out}/runs"])
    runs = spark.read.parquet(f"{out}/runs")
    assert runs.count() == 12 and runs.filter("recall_at_5 = 1.0").count() == 12
    jobs.main(["analyze", f"{out}/runs", f"{out}/report"])
    summary = json.loads((out / "report" / "analysis_summary.json").read_text())
    assert summary["overview"][0]["questions"] == 2 and len(summary["condition_summary"]) == 6 and summary["classification"] == "ACTUAL" and len(json.loads((out / "report" / "chart_data.json").read_text())["mean"]) == 6
    assert runs.filter("started_at > completed_at or original_query is null").count() == 0
    jobs.main(["export", f"{out}/runs", f"{out}/csv", "--limit", "3"])
    assert spark.read.csv(f"{out}/csv", header=True, multiLine=True).count() == 3
    jobs.main(["manifest", str(land), f"{out}/chunks", f"{out}/index", f"{out}/manifest.json"])
    jobs.main(["validate", str(tmp_path / "q.jsonl"), f"{out}/index", "--chunks", f"{out}/chunks", "--manifest", f"{out}/manifest.json", "--report", f"{out}/preflight.md"])
    assert "PASS" in (out / "preflight.md").read_text()
    capsys.readouterr()
    jobs.main(["experiment", str(tmp_path / "q.jsonl"), f"{out}/index", f"{out}/fresh", "--dry-run"])
    assert "english_baseline" in capsys.readouterr().out
    (tmp_path / "bad.jsonl").write_text(json.dumps(rows[0] | {"english": " "}))
    with pytest.raises(SystemExit):
        jobs.main(["validate", str(tmp_path / "bad.jsonl"), f"{out}/index"])
