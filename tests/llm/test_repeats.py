"""Suffix-array dedup against brute force on periodic, long and oddly keyed texts."""

import random

import pytest

pytest.importorskip("formloom.llm")

from formloom.llm import repeats  # noqa: E402
from tests.llm.test_llm import brute_repeats  # noqa: E402

FIELDS = ("n_bytes", "n_removed", "n_spans", "kept_sha256")


def test_periodic_and_long_texts(spark):
    r = random.Random(5)
    long = " ".join("".join(r.choice("abcdefg") for _ in range(5)) for _ in range(14_000))  # over a block of bytes
    texts = ["x" * 70_000, "ab" * 5_000, "ba" * 4_000 + "c", long, "intro " + long[20_000:70_000], "abc" * 100 + long[:150], "y" * 99, "y" * 100, "y" * 101]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: x for x in repeats.remove_repeats(docs).collect()}
    for i, want in enumerate(brute_repeats(texts)):
        assert tuple(got[i][c] for c in FIELDS) == want, i


def test_periodic_text_makes_few_segments():
    for text in (b"x" * 100_000, b"ab" * 50_000):
        _, _, _, start, stop, _ = repeats.segments([text], 100)
        assert (stop - start).sum() < 3 * len(text)


def test_repeated_and_null_ids(spark):
    r = random.Random(6)
    a, b = ("".join(r.choice("abcdef ") for _ in range(n)) for n in (400, 200))
    rows = [(1, a), (1, a), (2, b), (2, a[:150] + b[:20]), (None, a[100:300] + "!"), (None, None)]
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by_size = {(x["doc_id"], x["n_bytes"]): x for x in got}
    assert len(got) == 6
    assert all(x["n_removed"] == 0 for x in got if x["doc_id"] == 1)  # copies under one id are one text
    assert by_size[(2, 200)]["n_removed"] == 0
    assert by_size[(2, 170)]["n_removed"] == 150
    assert by_size[(None, 201)]["n_removed"] == 200
    assert by_size[(None, 0)]["n_spans"] == 0


@pytest.mark.parametrize("bucket", [1, 20_000])
def test_texts_that_repeat_only_themselves(spark, bucket):
    """Windows that repeat inside the only segment of a gram, or the only unlike one."""
    line = "".join(chr(c) for c in range(65, 91)) * 2
    texts = ["z" * 120, "x" * 168, "w" * 444, "-=" * 51, "v" * 150, "v" * 150, f"{line}{'_' * 130}{line[::-1]}", "0123456789" * 12, "u" * 100]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: x for x in repeats.remove_repeats(docs, bucket=bucket).collect()}
    for i, want in enumerate(brute_repeats(texts)):
        assert tuple(got[i][c] for c in FIELDS) == want, i


def test_segments_that_repeat_themselves_are_marked():
    r = random.Random(7)
    for _ in range(200):
        unit = "".join(r.choice("ab") for _ in range(r.randint(1, 90)))
        text = ("".join(r.choice("cdef") for _ in range(50)) + (unit * 200)[: r.randint(20, 300)]).encode()
        _, _, _, start, stop, kind = repeats.segments([text], 100)
        for a, b, k in zip(start, stop, kind, strict=True):
            windows = [text[i : i + 100] for i in range(a, b - 99)]
            assert k != 1 or len(set(windows)) == len(windows)
