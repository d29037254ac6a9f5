"""Reports, layouts, replies and summaries on small and odd inputs; the queries with SQL against DuckDB."""

import duckdb
import pytest
from pyspark.sql import functions as F

from formloom.operators import layout, replies, reports, summaries, templates
from formloom.plans import more_queries  # noqa: F401
from formloom.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
NAMES = [n for n, f in QUERIES.items() if f.__module__ == more_queries.__name__]


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v"))).first()[0]


@pytest.mark.parametrize("name", NAMES)
def test_query_gives_the_rows_of_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("orders", "customer", "documents"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(ORACLE_SQL[name])
    names = sorted(d[0] for d in want.description)
    order = [[d[0] for d in want.description].index(n) for n in names]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == names
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r) for r in got.select(*names).collect()), key=key) == sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=key)


def test_panels_take_what_python_reads_as_numbers(spark):
    got = one(spark, "Iron\nnan\nug\nZinc\n1e5\nLead\n1d\nGlucose\n\nSODIUM\n5\nu", reports.lab_panels)
    assert [tuple(r) for r in got] == [("Iron", "nan", "ug", "", ""), ("Zinc", "1e5", "Lead", "", "")]


@pytest.mark.parametrize("text", [None, "", "\n\n"])
def test_nothing_in_blank_texts(spark, text):
    assert one(spark, text, reports.lab_panels) == [] and one(spark, text, reports.kpis) == [] and one(spark, text, reports.recommendations) == []
    assert one(spark, text, reports.executive_summary) is None and one(spark, text, reports.document_subtype) is None


def test_several_pairs(spark):
    got = one(spark, "Invoice #: A-1 Date: Jan 1 | PO Number: |", layout.several_pairs)
    assert [tuple(p) for p in got] == [("invoice #", "A-1"), ("date", "Jan 1 |")]
    assert one(spark, "Due Date: x", layout.several_pairs) == []


def test_labels(spark):
    assert one(spark, "  PO   Number :", layout.normalise_label) == "po number"
    assert one(spark, "vat", layout.field_of) == "tax" and one(spark, "nothing", layout.field_of) is None


def test_pages_without_words(spark):
    kind = "w array<struct<text:string,x0:double,top:double,x1:double,bottom:double>>"
    rows = spark.createDataFrame([([],), (None,)], kind).select(layout.page_rows(F.col("w")).alias("r"))
    assert [r[0] for r in rows.select(layout.fields_from_pages(F.array("r"))).collect()] == [{}, None]


def test_replies(spark):
    assert one(spark, "none", replies.json_object) == "none" and one(spark, None, replies.json_object) is None
    asked = replies.ask(spark.createDataFrame([(1, "x" * 20_000), (2, None)], "id long, text string"), lambda t: str(len(t)))
    assert sorted((r["id"], r["reply"]) for r in asked.collect()) == [(1, "18000"), (2, "0")]


def test_signature_scores(spark):
    rows = spark.createDataFrame([("Invoice 12\nTotal 3", "Invoice 99\nTotal 4"), ("abc", "xyz"), (None, "")], "a string, b string")
    signed = rows.select("a", templates.text_signature(F.col("a")).alias("l"), templates.text_signature(F.col("b")).alias("r"))
    scores = {r["a"]: r["score"] for r in templates.score_signatures(signed.union(signed), "l", "r").collect()}
    assert scores == {"Invoice 12\nTotal 3": 1.0, "abc": 0.3, None: 1.0}


def test_no_template_hit(spark):
    rows = spark.createDataFrame([([],), (None,)], "t array<string>")
    assert [tuple(r[0]) for r in rows.select(summaries.template_hit(F.col("t"))).collect()] == [("—", "—")] * 2


def test_full_store_replaces_the_most_similar(spark):
    import random

    from formloom.operators import learning, templates

    r = random.Random(2)
    rows = [(k, i, [r.gauss(0, 1) for _ in range(3)] if i % 9 else [0.0] * 3) for k in ("a", "b") for i in range(60)]
    cos = lambda x, y: round(d / n, 4) if (n := (sum(i * i for i in x) * sum(i * i for i in y)) ** 0.5) and (d := sum(i * j for i, j in zip(x, y, strict=True))) else 0.0
    for cap, merge in ((5, 0.85), (5, 2.0), (200, 2.0)):
        want = {}
        for kind, i, v in rows:
            store = want.setdefault(kind, [])
            scores = [cos(v, x) for _, x in store]
            if store and (max(scores) >= merge or len(store) >= cap):
                store[scores.index(max(scores))] = (i, v)
            else:
                store.append((i, v))
        full = [(k, i, f"t{i}", v, {}, None) for k, i, v in rows]
        got = learning.learn_templates(spark.createDataFrame(full, learning.TEMPLATE).repartition(3), cap, merge).collect()
        assert {(x["document_type"], x["slot"]): x["ord"] for x in got} == {(k, n): i for k, store in want.items() for n, (i, _) in enumerate(store)}


def test_anchors_score_what_has_no_similarity(spark):
    from formloom.operators import learning, templates

    docs = spark.createDataFrame([(1, "a", [], "TOTAL: 5 due"), (2, "a", [1.0], "total: 5"), (3, "a", [], "")], "doc long, document_type string, vector array<double>, text string")
    store = spark.createDataFrame(
        [("a", 0, [1.0], {"x": r"vendor\s*:\s*(?P<value>.+)"}), ("a", 1, [], {"t": r"total\s*:\s*(?P<value>.+)", "v": "vendor", "d": "due"}), ("a", 2, [], None)],
        "document_type string, ord long, vector array<double>, anchors map<string,string>",
    )
    got = {x["doc"]: (x["ord"], x["score"]) for x in templates.best_template(docs, store).collect()}
    assert got == {1: (1, 0.6667), 2: (0, 1.0), 3: (0, 0.0)}


def test_whole_tables_are_matched_and_reported(spark):
    import __spark_entry__ as entry

    for name, source in (("template_match", "embeddings"), ("business_report", "orders")):
        whole = spark.read.parquet(f"/root/testdata/sf0.001/{source}.parquet")
        assert entry.queries()[name](spark, "/root/testdata/sf0.001").count() == whole.count()


def test_rates_are_rounded_by_their_binary_value(spark):
    from formloom.operators import batch

    pairs = [(c, n) for n in range(1, 161) for c in range(n + 1)] + [(7, 2000), (1, 10**11), (10**11 - 1, 10**11), (0, 0)]
    rows = spark.createDataFrame(pairs, "corrections long, documents long")
    got = rows.select("corrections", "documents", batch.review_rate(rows).alias("r")).collect()
    assert [tuple(x) for x in got if x["r"] != (f"{x[0] * 100 / x[1]:.1f}%" if x[1] else "—")] == []


def test_review_rate_of_repeated_and_null_keys(spark, tmp_path):
    from formloom.plans import batch_queries  # noqa: F401

    spark.createDataFrame([(1,), (1,), (2,), (None,), (None,), (3,)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    orders = [(4 * i if i < 3 else 4 * i + 1, 1) for i in range(16)] + [(None, 1), (None, 2), (8, None), (-4, 3), (-3, 3)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    for t in ("orders", "customer"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(ORACLE_SQL["review_rate"]).fetchall()
    got = [(r["o_custkey"], r["review_rate"]) for r in QUERIES["review_rate"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and (1, "18.8%") in got


def test_pages_of_a_small_file_are_read_once_by_many_tasks(spark):
    got = QUERIES["layout_anchors"](spark, SF)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == plan.count("regexp_extract_all(") == 1
    assert got.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_fields_by_anchors_of_odd_pages(spark):
    word, anchor = "array<struct<text:string,x0:double,top:double,x1:double,bottom:double>>", "array<struct<field:string,label_text:string,norm_x:double,norm_y:double>>"
    words = [("PO Number: 7 Vendor: A Vendor: B", 0.0, 10.0, 90.0, 20.0), (":", 0.0, 100.0, 9.0, 110.0), ("plain", 0.0, 200.0, 9.0, 210.0), ("Due Date: x", 300.0, 300.0, 400.0, 310.0)]
    at = [("a", "vendor", 0.0, 0.01), ("b", "", 0.0, 0.01), ("c", "number", 0.05, 0.02), ("d", None, 0.0, 0.1), ("e", "PLAIN", 0.0, 0.2), ("f", "due date", 0.0, 0.3), ("g", "none", 0.0, 0.2), ("a", "", 0.0, 0.2), ("", "", 0.0, 0.2), ("h", "", None, 0.2)]
    rows = spark.createDataFrame([(1, words, at), (2, [], at), (3, None, at), (4, words, []), (5, words, None)], f"i long, w {word}, a {anchor}")
    pages = rows.select("i", "a", layout.page_rows(F.col("w")).alias("rows"))
    got = {r["i"]: r["f"] for r in pages.select("i", layout.fields_by_anchors(F.col("rows"), F.lit(1000.0), F.lit(1000.0), F.col("a")).alias("f")).collect()}
    assert got == {1: {"a": "plain", "b": "7", "c": "7", "d": ":", "e": "plain"}, 2: {}, 3: {}, 4: {}, 5: None}
    assert [tuple(p) for p in one(spark, " Vendor : x: y ", layout.row_pairs)] == [("vendor", "x: y")] and one(spark, None, layout.row_pairs) == []
