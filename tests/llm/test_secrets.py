"""Secret scans: base spans against a scan character by character, and the network on findings of the tables that it has not seen."""

import re
import time

import pytest

pytest.importorskip("formloom.llm")

from formloom.llm import secrets  # noqa: E402

KEY = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")


def brute(text):
    """The contract's rules without a search: matches are tried at every place and grown by hand."""
    out = []
    at = 0
    while at < len(text):  # assign
        names = [n for n in ("password", "passwd", "secret", "token", "apikey", "api_key") if text[at : at + len(n)].lower() == n and text[at : at + len(n)].isascii()]
        end = None
        for n in names:
            i = at + len(n)
            for quote in (1, 0):
                j = i + (quote and text[i : i + 1] in ("'", '"') and text[i : i + 1] != "")
                while text[j : j + 1] == " ":
                    j += 1
                if text[j : j + 1] not in (":", "=") or j >= len(text):
                    continue
                j += 1
                while text[j : j + 1] == " ":
                    j += 1
                k = j + (text[j : j + 1] in ("'", '"') and j < len(text))
                stop = k
                while stop < len(text) and text[stop] in KEY:
                    stop += 1
                if stop > k:
                    end = (stop, stop - k)
                    break
            if end:
                break
        if end:
            if end[1] >= 6:
                out.append((at, 0, "assign", end[0]))
            at = end[0]
        else:
            at += 1
    for rank, kind, lead, body, least in ((1, "access", "AKIA", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 20), (2, "hex", "", "0123456789abcdef", 24)):
        at = 0
        while at < len(text):
            stop = at + len(lead) if text[at : at + len(lead)] == lead else at
            while (stop > at or not lead) and stop < len(text) and text[stop] in body:
                stop += 1
            if stop - at > len(lead):
                if stop - at >= least:
                    out.append((at, rank, kind, stop))
                at = stop
            else:
                at += 1
    return sorted(out)


def documents(spark, sf):
    return [r["text"] or "" for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("text").collect()]


def test_base_spans_match_brute_force(spark):
    odd = [
        "PASSWORD = \"abcdef\" token:'x' secret=  abc", "api_key=\"\"12345678", "apikey : AKIA" + "Z" * 16 + "é", "token=token=token=abcdefg", "0a" * 11 + "0 " + "0a" * 12, "AKIAAKIA" + "B" * 12,
        "secretsecret=aaaaaa passwd\"=zzzzzzz", "", "pass\u212aword=abcdefg token\u017f=abcdefg", "api__key=abcdefg API_KEY'  = 'a.b.c.d=",
    ]
    for text in [*odd, *documents(spark, "sf0.001")]:
        assert secrets.rule_spans(text) == brute(text), text[:80]


def test_findings_of_tables_not_seen(spark):
    found = {}
    for text in documents(spark, "sf0.1"):
        for start, stop, label in secrets.candidates(text, secrets.rule_spans(text)):
            if not label and not secrets.ORDINARY.fullmatch(text, start, stop):
                continue
            for line in secrets.windows(text, start, stop):
                found[line] = found.get(line, False) or label
    rows = sorted(found.items())
    seen, unseen = rows[::2], rows[1::2]
    net = secrets.trained(found=tuple(seen))
    hit = net.probability(secrets.encoded([line for line, _ in unseen])) >= net.threshold
    labels = [label for _, label in unseen]
    assert sum(labels) >= 20
    assert sum(h for h, label in zip(hit, labels, strict=True) if label) >= 0.9 * sum(labels)
    assert sum(label for h, label in zip(hit, labels, strict=True) if h) >= 0.9 * hit.sum()


def test_sample_is_bounded_and_labelled(spark):
    text = "password=abcdef0123456789abcd and anordinarylongword or aZ9kQ2mX7pL4vB8nT1 " * 3
    docs = spark.createDataFrame([(1, text), (2, text), (3, None), (4, "")], "doc_id long, text string")
    rows = secrets.labelled_sample(docs, 2)
    assert len(rows) == 2 and len(secrets.labelled_sample(docs, 100)) == len({line for line, _ in secrets.labelled_sample(docs, 100)})
    assert {label for _, label in secrets.labelled_sample(docs, 100)} == {True, False}


def test_long_texts_take_linear_time():
    net = secrets.trained(examples=200)
    took = []
    for n in (4_000, 16_000):
        text = "token=abcdef12 " * n
        start = time.perf_counter()
        secrets.find_spans([text], net)
        took.append(time.perf_counter() - start)
    assert took[1] < 10 * max(took[0], 0.05)


def test_candidates_touch_rules():
    text = "a token=ABCDEFGHIJKLMNOPQR and QRSTUVWXYZABCDEFGH"
    assert [(text[a:b], f) for a, b, f in secrets.candidates(text, secrets.rule_spans(text))] == [("token=ABCDEFGHIJKLMNOPQR", True), ("QRSTUVWXYZABCDEFGH", False)]
    assert re.fullmatch(secrets.CANDIDATE, "A" * 16)
