"""Core operators on small inputs, and every query that has SQL against DuckDB."""

import duckdb
import pytest
from pyspark.sql import functions as F

from formloom.functions import text as X
from formloom.operators import classify, extract, quality_scores, spatial, templates, validate
from formloom.plans.queries import ORACLE_SQL, QUERIES
from formloom.sinks.writers import write
from formloom.sources.readers import read_uploads
from formloom.streaming.ingest import ingest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v"))).first()[0]


@pytest.mark.parametrize("text,want", [("1,234.50", 1234.5), ("$7", 7.0), ("1d", None), ("abc", None), ("1e3", 1000.0), (None, None)])
def test_money(spark, text, want):
    assert one(spark, text, X.money) == want


@pytest.mark.parametrize("text,want", [("2024-1-05", True), ("2024-001-05", False), ("02/30/2024", False), ("2/3/2024", True), ("2024/12/31", True), ("24-01-01", False), (None, False)])
def test_dates(spark, text, want):
    assert one(spark, text, X.valid_date) is want


def test_filler_falls_through_to_the_next_pattern(spark):
    text = "Invoice Number: ____\nInvoice # A-7"
    assert one(spark, text, lambda c: X.first_match(c, extract.PATTERNS["invoice"]["invoice_number"])) == "A-7"


def test_type_ties_and_defaults(spark):
    rows = spark.createDataFrame([("vendor and hospital",), ("nothing",), (None,), ("a calendar",)], "text string")
    assert [r["document_type"] for r in classify.with_document_type(rows).collect()] == ["invoice", "invoice", "invoice", "nda"]


def test_invoice_end_to_end(spark):
    text = "Acme Corp\n12 Road\nINVOICE\nInvoice # 77\nDate: 2024-02-01\nWidget big  3  $2.00  $6.00\nSubtotal: $6.00\nTax: 0.50\nTotal: $6.50"
    row = validate.with_checks(extract.infer_invoice_fields(extract.extract_invoices(spark.createDataFrame([(text,)], "text string"))), "invoice").first()
    assert (row["vendor_name"], row["invoice_number"], row["total_amount"], row["currency"]) == ("Acme Corp", "77", 6.5, "USD")
    assert row["line_items"][0]["description"] == "Widget big" and row["line_items"][0]["quantity"] == 3
    assert not [c for c in row["checks"] if c["status"] == "fail"]


def test_bad_patterns(spark):
    assert one(spark, "___", templates.bad_pattern) == r"^\s*_+\s*$"
    assert one(spark, "N/A", templates.bad_pattern) == r"^\s*N\/A\s*$"
    assert one(spark, " ", templates.bad_pattern) is None


def test_cosine(spark):
    row = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>")
    got = row.select(templates.cosine(F.col("a"), F.col("b")), templates.cosine(F.col("a"), F.col("z"))).first()
    assert tuple(got) == (0.7071, 0.0)


def test_row_clusters(spark):
    words = [("b", 10.0, 0.0, 10.0), ("a", 0.0, 2.0, 12.0), ("c", 0.0, 30.0, 40.0)]
    df = spark.createDataFrame([(words,)], "w array<struct<text:string,x0:double,top:double,bottom:double>>")
    rows = df.select(spatial.cluster_rows(F.col("w")).alias("r")).first()["r"]
    assert [[w["text"] for w in r] for r in rows] == [["b", "a"], ["c"]]


@pytest.mark.parametrize("message,want", [("try again in 1.5s", 2), ("try again in 9m1.2s", 60), ("retry after 30 seconds", 30), ("RESOURCE_EXHAUSTED", 15), ("no", None)])
def test_retry_after(spark, message, want):
    assert one(spark, message, quality_scores.retry_after) == want


def test_files_and_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes(b"one\r\n\r\n two \xff\n")
    (tmp_path / "in" / "b.bin").write_bytes(b"x")
    assert read_uploads(spark, f"{tmp_path}/in").count() == 2
    row = read_uploads(spark, f"{tmp_path}/in", "*.txt").collect()
    assert len(row) == 1 and row[0]["sections"] == ["one", "two"] and row[0]["suffix"] == ".txt"
    assert row[0]["upload_name"].startswith("a_") and len(row[0]["upload_name"]) == 14
    docs = spark.createDataFrame([(1, ["x"])], "doc_id long, tags array<string>")
    write(docs, f"{tmp_path}/csv", "csv")
    assert spark.read.csv(f"{tmp_path}/csv", header=True).first()["tags"] == '["x"]'
    write(spark.createDataFrame([(1, "vendor")], "doc_id long, text string"), f"{tmp_path}/docs")
    ingest(spark, f"{tmp_path}/docs", "doc_id long, text string", classify.with_document_type, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/out/epoch=0").first()["document_type"] == "invoice"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    want = con.sql(ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    show = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
    ours = sorted(tuple(show(r[c]) for c in columns) for r in got.collect())
    theirs = sorted(tuple(show(dict(zip(want.columns, r, strict=True))[c]) for c in columns) for r in want.fetchall())
    assert ours == theirs
