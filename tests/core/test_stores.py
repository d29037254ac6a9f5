"""Scans, stores, sinks, learning and requests, which have no SQL."""

import json
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from formloom.operators import catalog, learning, replies, templates
from formloom.sinks import store
from formloom.sources import pdf, readers, stores

ROOT = Path(__file__).resolve().parents[2]


def test_uploads_of_every_kind(spark, tmp_path):
    folder = tmp_path / "up"
    folder.mkdir()
    (folder / "a.txt").write_bytes("café �\r\nx\rtwo\x0bthree".encode() + b"\xff!")
    (folder / "b.json").write_text('{"b":1,"a":["é"]}', encoding="utf-8")
    (folder / "c.json").write_text("{broken", encoding="utf-8")
    (folder / "long.pdf").write_bytes(b"L" * 120)
    (folder / "scan.pdf").write_bytes(b"S")
    (folder / "none.pdf").write_bytes(b"N")
    (folder / "README").write_text("plain")

    def first(content):
        return content.decode() if content[:1] == b"L" else "short"

    def ocr(content):
        return "seen" if content == b"S" else ""

    got = {r["source_file"]: r for r in readers.read_uploads(spark, str(folder), pdf_readers=[lambda c: "", first], ocr=ocr).collect()}
    assert got["a.txt"]["text"] == "café �\nx\ntwo\x0bthree!"
    assert got["a.txt"]["sections"] == ["café �", "x", "two", "three!"]
    assert got["b.json"]["text"] == json.dumps({"b": 1, "a": ["é"]}, indent=2)
    assert got["c.json"]["text"] is None and "JSONDecodeError" in got["c.json"]["error"]
    assert got["long.pdf"]["text"] == "L" * 120 and got["scan.pdf"]["text"] == "seen"
    assert readers.NO_TEXT in got["none.pdf"]["error"]
    assert (got["README"]["suffix"], got["README"]["text"], got["README"]["section_count"]) == ("", "plain", 1)


def test_words_of_pages(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one two")
    (tmp_path / "b.pdf").write_bytes(b"")

    def reader(content):
        if not content:
            raise ValueError("empty")
        for i, w in enumerate([*content.decode().split(), " "]):
            yield {"page_number": 0, "page_width": 600.0, "page_height": 800.0, "text": w, "x0": float(i), "top": 1.0, "x1": i + 0.5, "bottom": 2.0}

    got = pdf.read_words(spark, str(tmp_path), reader).collect()
    assert [(r["source_file"], r["text"]) for r in got] == [("a.pdf", "one"), ("a.pdf", "two")]
    assert all(callable(x) for x in pdf.installed())


def test_stores_that_are_missing_or_corrupt_are_empty(spark, tmp_path):
    bad = tmp_path / "bad.json"
    bad.write_text("{not json")
    for path in (str(bad), str(tmp_path / "none.json")):
        assert stores.read_templates(spark, path).count() == 0
        assert stores.read_bad_patterns(spark, path).count() == 0
        assert stores.read_selection(spark, path) == catalog.default_selection()
    assert stores.table_or_empty(spark, str(tmp_path / "no"), store.ERRORS).count() == 0


def test_stores_round_trip(spark, tmp_path):
    path = tmp_path / "t.json"
    path.write_text(json.dumps([
        {"template_name": "a", "document_type": "nda", "signature": {"zone_density": [0.5, 1]}, "anchors": {"x": {"label": "X", "pattern": r"X\s*:\s*(?P<value>.+)"}}},
        {"template_name": "b", "signature": {}, "anchors": {}, "spatial_anchors": [{"field": "f", "label_text": "l", "norm_x": 0.1, "norm_y": 0.2}]},
    ], indent=2))
    a, b = stores.read_templates(spark, str(path)).orderBy("ord").collect()
    assert (a["document_type"], a["vector"], a["anchors"]) == ("nda", [0.5, 1.0], {"x": r"X\s*:\s*(?P<value>.+)"})
    assert (b["document_type"], b["vector"], b["anchors"], b["spatial_anchors"][0]["norm_y"]) == ("invoice", [], {}, 0.2)
    path.write_text(json.dumps({"nda.x": ["^a$", "^b$"], "invoice.y.z": ["c"]}))
    rows = [tuple(r) for r in stores.read_bad_patterns(spark, str(path)).collect()]
    assert sorted(rows) == [("invoice", "y.z", 0, "c"), ("nda", "x", 0, "^a$"), ("nda", "x", 1, "^b$")]
    selection = catalog.select_fields(catalog.default_selection(), "invoice", ["currency", "odd"])
    assert selection["invoice"] == ["vendor_name", "invoice_number", "invoice_date", "total_amount", "currency", "line_items", "odd"]
    store.save_selection(spark, selection, str(path))
    assert stores.read_selection(spark, str(path)) == selection


def test_catalogue():
    text = catalog.ddl(catalog.default_selection(), "invoice")
    assert text.startswith("CREATE TABLE IF NOT EXISTS invoices (\n    id INTEGER PRIMARY KEY AUTOINCREMENT,\n    source_file TEXT NOT NULL,")
    assert "    vendor_name TEXT NOT NULL,\n" in text and "    total_amount REAL NOT NULL,\n" in text and text.endswith("    line_items TEXT NOT NULL\n);")
    order, lists, optional = catalog.display_fields(catalog.default_selection(), "nda")
    assert order[0] == "document_type" and lists == [] and "agreement_date" not in optional and "permitted_use" in optional
    assert [len(catalog.empty_record(k)) for k in ("invoice", "medical_discharge", "nda", "lab_report", "business_doc", "other")] == [14, 13, 10, 18, 12, 14]
    assert sum(map(len, catalog.FIELDS.values())) == 73


def test_settings():
    got = stores.load_settings({"APP_ENV": " Prod ", "ENABLE_TEMPLATE_LEARNING": "FALSE", "MIN_LEARNING_PASS_RATIO": "0.7"})
    assert (got.environment, got.data_dir, got.learning, got.least_passed, got.provider) == ("prod", "data/prod", False, 0.7, "openai")
    assert got.templates == "data/prod/learned_templates.json"


def test_files_of_documents(spark, tmp_path):
    rows = spark.createDataFrame([("a.b.txt", [("x", None)], ["s1", "sé2"], 1.5)], "source_file string, items array<struct<d:string,n:int>>, trace array<string>, total double")
    out = store.export(rows, str(tmp_path / "out"))
    assert len(out) == 2
    found = next((tmp_path / "out/json/stem=a.b").glob("part*"))
    assert json.loads(found.read_text()) == {"source_file": "a.b.txt", "items": [{"d": "x", "n": None}], "trace": ["s1", "sé2"], "total": 1.5}
    assert found.read_text().startswith('{\n  "source_file"')
    line = spark.read.csv(out[1], header=True, escape='"').first()
    assert line["items"] == "[{'d': 'x', 'n': None}]" and line["trace"] == "['s1', 'sé2']"
    store.write_trace_files(rows, str(tmp_path / "traces"))
    assert json.loads(next((tmp_path / "traces/stem=a.b").glob("part*")).read_text()) == {"trace": ["s1", "sé2"]}
    assert [tuple(r) for r in store.traces_table(rows).collect()] == [("a.b.txt", 1, "s1"), ("a.b.txt", 2, "sé2")]
    store.export_csv(rows, str(tmp_path / "log.csv"))
    assert spark.read.csv(str(tmp_path / "log.csv"), header=True).first()["total"] == "1.5"


def test_logs_and_reset(spark, tmp_path):
    root = str(tmp_path / "db")
    store.ensure_tables(spark, root)
    store.log_errors(spark.createDataFrame([("code", "s", "m"), ("document_processing", "s", "n")], "error_type string, source string, message string"), root, F.lit("2024-01-01 00:00:00"))
    store.log_uploads(spark.createDataFrame([("a", "p", 3)], "original_filename string, upload_path string, file_size_bytes int"), root)
    store.ensure_tables(spark, root)  # what is there stays
    log = spark.read.parquet(f"{root}/error_log")
    assert [(r["error_type"], r["severity"]) for r in store.system_errors(log).collect()] == [("code", "error")] and store.document_errors(log).count() == 1
    assert store.latest(log, "logged_at", ["error_type"], 1).first()["error_type"] == "document_processing"
    assert spark.read.parquet(f"{root}/pdf_uploads").first()["file_size_bytes"] == 3
    (tmp_path / "outputs").mkdir()
    kept = tmp_path / "bad.json"
    kept.write_text("{}")
    store.reset(spark, root, str(tmp_path / "t.json"), str(tmp_path / "outputs"))
    spark.catalog.clearCache()
    assert spark.read.parquet(f"{root}/error_log").count() == 0 and (tmp_path / "t.json").read_text() == "[]"
    assert kept.exists() and not (tmp_path / "outputs").exists()
    logger = store.file_logger(str(tmp_path / "logs"), "formloom-test")
    logger.info("hello")
    assert "INFO     — hello" in (tmp_path / "logs/pipeline.log").read_text()
    assert store.file_logger(str(tmp_path / "logs"), "formloom-test") is logger


def test_learning_keeps_names_and_merges_places(spark):
    place = lambda f, x: {"field": f, "label_text": f, "norm_x": x, "norm_y": 0.0}
    rows = [
        ("nda", 0, "first", [1.0, 0.0], {"a": "1"}, [place("f", 0.1), place("g", 0.2)]),
        ("nda", 1, "second", [1.0, 0.1], {"a": "2"}, [place("g", 0.9)]),
        ("nda", 2, "text", [], {"a": "3"}, None), ("nda", 3, "text2", [], {"a": "4"}, None), ("lab_report", 4, "other", [1.0, 0.0], {}, None),
    ]
    got = learning.learn_templates(spark.createDataFrame(rows, learning.TEMPLATE)).orderBy("document_type", "slot").collect()
    assert [(r["document_type"], r["slot"], r["template_name"], r["ord"]) for r in got] == [("lab_report", 0, "other", 4), ("nda", 0, "first", 1), ("nda", 1, "text", 2), ("nda", 2, "text2", 3)]
    assert [(a["field"], a["norm_x"]) for a in got[1]["spatial_anchors"]] == [("f", 0.1), ("g", 0.9)]


def test_learning_of_text_signatures(spark):
    texts = ["Invoice 12\nTotal 5", "invoice 77\ntotal 9", "memo\nnothing", "memo\nnothing!"]
    rows = spark.createDataFrame([(i, f"t{i}", t) for i, t in enumerate(texts)], "ord long, template_name string, text string")
    got = learning.learn_signatures(rows.withColumn("signature", templates.text_signature(F.col("text")))).collect()
    assert [(r["template_name"], r["ord"]) for r in got] == [("t0", 1), ("t2", 3)]
    with pytest.raises(Exception, match="more than 1 text templates"):
        learning.learn_signatures(rows.withColumn("signature", templates.text_signature(F.col("text"))), cap=1).collect()


def test_text_anchor_is_used_once():
    lines = ["Total: 5", "Tax: 5", "PO Number: 7 Due Date: 8"]
    got = learning.text_anchors({"total_amount": "5", "tax": "5", "subtotal": "5", "po_number": "7", "due_date": "8", "x": "  "}, lines)
    assert {k: v[0] for k, v in got.items()} == {"total_amount": "Total", "tax": "Tax", "po_number": "po number", "due_date": "due date"}


def test_line_labels(spark):
    rows = spark.createDataFrame([(" a : b: c",), ("none",), (":x",)], "l string")
    assert [r[0] for r in rows.select(learning.line_label(F.col("l"))).collect()] == ["a", "", ""]


def test_requests():
    got = replies.request("x" * 20_000, "lab_report", "m", "Groq")
    assert got["temperature"] == 0 and got["response_format"] == {"type": "json_object"} and got["messages"][1]["content"].endswith("x" * 18_000)
    assert "x" * 18_001 not in got["messages"][1]["content"] and "lab_panels (list)" in got["messages"][1]["content"]
    assert "response_format" not in replies.request(None, "invoice", "m", "ollama")
    assert replies.client_options("ollama", None, None) == {"base_url": "http://localhost:11434/v1/", "api_key": "ollama"}
    assert replies.client_options("openai", None, "k") == {"base_url": None, "api_key": "k"}
    assert replies.client_options("groq", "http://x", "k")["base_url"] == "http://x"


def test_entry_without_optional_parts(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__"))
    (copy / "formloom" / "llm" / "__pycache__").mkdir(parents=True)  # what deleting sources may leave behind
    said = subprocess.run(
        [sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, any(n.startswith('op1_') for n in q), len(e.oracle_sql()))"],
        cwd=copy, capture_output=True, text=True, check=True,
    ).stdout.split()
    assert said[1:3] == ["False", "False"] and int(said[0]) > 60 and int(said[3]) > 60
