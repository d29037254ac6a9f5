"""URL filters: host rules, and a character language-model ratio for the rest.

A rule fits a host and its subdomains if the path starts with the rule's path; the
longest rule wins.  URLs that no rule fits are judged by two variable-order Markov
models, one of accepted and one of rejected URLs (those that rules allow and block).
Each model interpolates the orders 0 to ``order`` by Witten-Bell smoothing with the
true number of distinct successors.  Its counts come from every ruled URL by one
grouped sum, stay a table that grows with the data, and are joined to the characters
of the URLs to be judged.  A URL is allowed if its log-likelihood difference per
character is at least a threshold, calibrated for balanced accuracy on the fold of
ruled URLs that the models do not see.

Defined results for odd input: a null URL or one without ``://`` has an empty host
and path and fits no rule; its verdict is the model's, of the text as it is; without
ruled URLs of both kinds everything unruled is allowed; null ids pass through;
repeated rows are judged one by one; an empty table gives an empty table; only the
id and URL columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .native import LOWER, UPPER
from .shared import written

#: Rule, verdict.
RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
SCALE = 1_000_000_000  # log ratios are summed as integers, so that the order of addition does not matter
SHARES = 4096


def split_url(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path, both empty without ``://``."""
    url = F.coalesce(url, F.lit(""))
    has = F.contains(url, F.lit("://"))
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.when(has, F.translate(host, UPPER, LOWER)).otherwise(""), F.when(has, path).otherwise("")


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule, null if none fits."""
    found = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        domain, _, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + rest)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def _keys(urls: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per character: its context and itself, packed into one integer, and the URL it belongs to; then the characters of each URL.

    The lowest byte is the character, the next ones what comes before it, so the
    lowest ``n + 1`` bytes are the character in its context of order ``n``.
    """
    raw = [b"\0" * order + (u or "").encode("utf-8") + b"\0" for u in urls]
    data = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.int64)
    lengths = np.array([len(x) for x in raw], dtype=np.int64)
    inside = np.arange(len(data)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    at = np.flatnonzero(inside >= order)
    key = np.zeros(len(at), dtype=np.int64)
    for n in range(order + 1):
        key |= data[at - n] << (8 * n)
    return key, np.repeat(np.arange(len(raw)), lengths)[at], lengths - order


def _counted(rows: DataFrame, order: int) -> DataFrame:
    """key, n0, n1, asked: the keys of ``rows(url, slot)``, counted by slot (0 accepted, 1 rejected, 2 to be scored)."""

    def run(batches):
        for batch in batches:
            urls, slots = batch[0].to_pylist(), batch[1].to_numpy(zero_copy_only=False)
            key, owner, _ = _keys(urls, order)
            distinct, place = np.unique(key, return_inverse=True)
            sums = [np.bincount(place[slots[owner] == k], minlength=len(distinct)) for k in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (distinct, *sums)], ["key", "n0", "n1", "asked"])

    parts = rows.mapInArrow(run, "key long, n0 long, n1 long, asked long")
    return parts.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "asked")])


def _ratios(counted: DataFrame, order: int) -> DataFrame:
    """key, ratio, asked of every asked key: log-likelihood difference of its character, in units of 1 / SCALE.

    A context is followed by at most 256 characters, and a key shortened by a byte comes
    from at most 256 keys, so no group or join key here gathers more rows than that.
    """
    cut = lambda n: F.col("key").bitwiseAND(F.lit((1 << 8 * n) - 1))
    levels = counted.select(
        F.explode(F.array(*[F.struct(F.lit(n).alias("order"), cut(n + 1).alias("key")) for n in range(order + 1)])).alias("k"), "n0", "n1", "asked"
    ).groupBy("k.order", "k.key").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "asked")])
    sums = [F.sum(f"n{c}").alias(f"seen{c}") for c in (0, 1)] + [F.sum((F.col(f"n{c}") > 0).cast("long")).alias(f"kinds{c}") for c in (0, 1)]
    asked = F.collect_list(F.when(F.col("asked") > 0, F.struct("key", "n0", "n1", "asked"))).alias("s")
    levels = levels.groupBy("order", F.shiftright("key", 8).alias("context")).agg(*sums, asked)
    levels = written(levels.select("order", *[f"{x}{c}" for x in ("seen", "kinds") for c in (0, 1)], F.inline("s")), "urls-levels")
    p = None
    for n in range(order + 1):
        rows = levels.filter(F.col("order") == n).withColumn("shorter", cut(n))
        if p is None:
            rows = rows.select("*", F.lit(1 / 256).alias("lower0"), F.lit(1 / 256).alias("lower1"))
        else:
            rows = rows.join(p.select(F.col("key").alias("shorter"), F.col("p0").alias("lower0"), F.col("p1").alias("lower1")), "shorter")
        p = rows.select("key", "asked", *[
            F.when(F.col(f"seen{c}") > 0, (F.col(f"n{c}") + F.col(f"kinds{c}") * F.col(f"lower{c}")) / (F.col(f"seen{c}") + F.col(f"kinds{c}")))
            .otherwise(F.col(f"lower{c}")).alias(f"p{c}") for c in (0, 1)
        ])
    return p.select("key", F.round((F.log("p0") - F.log("p1")) * SCALE).cast("long").alias("ratio"), "asked")


def _scores(rows: DataFrame, ratios: DataFrame, order: int) -> DataFrame:
    """rid, score of ``rows(rid, url)``: the mean ratio of each URL's characters.

    A key with more than 1 in SHARES of all characters (fewer than SHARES such keys can
    be) is looked up where the URL is; only the others are joined, so none is hot.
    """
    total = ratios.agg(F.sum("asked")).first()[0] or 0
    often = ratios.filter(F.col("asked") * SHARES > total).select("key", "ratio").orderBy("key").toArrow()
    hot = rows.sparkSession.sparkContext.broadcast((often["key"].to_numpy(), often["ratio"].to_numpy()))

    def run(batches):
        keys, values = hot.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                key, owner, size = _keys(part[1].to_pylist(), order)
                rid = part[0].to_numpy()
                place = np.searchsorted(keys, key)
                is_hot = place < len(keys)
                is_hot[is_hot] = keys[place[is_hot]] == key[is_hot]
                near = np.zeros(len(rid), dtype=np.int64)
                np.add.at(near, owner[is_hot], values[place[is_hot]])
                # Of each URL one row with its size and what is known here, and a row for each other character.
                none = np.zeros(np.count_nonzero(~is_hot), dtype=np.int64)
                columns = [
                    np.concatenate((rid, rid[owner[~is_hot]])), np.concatenate((np.full(len(rid), -1), key[~is_hot])),
                    np.concatenate((near, none)), np.concatenate((size, none)),
                ]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["rid", "key", "ratio", "size"])

    parts = rows.select("rid", "url").mapInArrow(run, "rid long, key long, ratio long, size long")
    joined = parts.filter("key >= 0").select("rid", "key").join(ratios.select("key", "ratio"), "key").select("rid", "ratio", F.lit(0).cast("long").alias("size"))
    summed = parts.filter("key < 0").select("rid", "ratio", "size").union(joined).groupBy("rid").agg(F.sum("ratio").alias("ratio"), F.sum("size").alias("size"))
    return summed.select("rid", (F.col("ratio") / F.col("size") / SCALE).alias("score"))


def judge_urls(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, order: int = 5, fold: int = 5
) -> DataFrame:
    """page_id, host, path, rule, verdict, score: one row per input row (score null where a rule decides)."""
    if not 0 <= order <= 6:
        raise ValueError("a context of up to 6 bytes and its next byte make one key")
    host, path = split_url(F.col("url"))
    rows = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url"))
    rows = rows.select("page_id", "url", host.alias("host"), path.alias("path"))
    verdict_of = F.create_map(*[F.lit(x) for r in rules for x in r])
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    rows = rows.withColumn("ruled", F.when(F.col("rule").isNotNull(), F.element_at(verdict_of, F.col("rule"))))
    rows = written(rows.withColumn("rid", F.monotonically_increasing_id()), "urls-rows")
    held_out = F.pmod(F.xxhash64("url"), F.lit(fold)) == 0
    kind = F.when(F.col("ruled") == "allow", 0).otherwise(1)
    scored = rows.filter(F.col("ruled").isNull() | held_out)
    trained = rows.filter(F.col("ruled").isNotNull() & ~held_out)
    both = trained.select(kind.alias("kind")).distinct().count() == 2
    slots = rows.select("url", F.when(F.col("ruled").isNull() | held_out, 2).otherwise(kind).alias("slot"))
    ratios = written(_ratios(_counted(slots, order), order), "urls-ratios")
    scores = written(_scores(scored, ratios, order), "urls-scores")

    threshold = 0.0
    if both:  # thousandths of the score on the held-out fold: a bounded histogram
        hist = (
            rows.filter(F.col("ruled").isNotNull() & held_out).select("rid", kind.cast("long").alias("kind")).join(scores, "rid")
            .withColumn("bin", F.greatest(F.lit(-20000), F.least(F.lit(20000), F.round(F.col("score") * 1000).cast("long"))))
            .groupBy("bin").agg(F.sum(1 - F.col("kind")).alias("good"), F.sum("kind").alias("bad"))
            .orderBy("bin").collect()
        )
        good, bad = sum(r["good"] for r in hist), sum(r["bad"] for r in hist)
        best, below_good, below_bad, before = -1.0, 0, 0, None
        for r in hist:
            rate = (good - below_good) / max(good, 1) + below_bad / max(bad, 1)
            if rate > best:
                best, threshold = rate, ((r["bin"] if before is None else (r["bin"] + before) / 2) - 0.01) / 1000
            before = r["bin"]
            below_good, below_bad = below_good + r["good"], below_bad + r["bad"]

    score = F.when(F.col("ruled").isNull(), F.col("score"))
    model = F.when(score >= F.lit(threshold), "allow").otherwise("block") if both else F.lit("allow")
    return rows.join(scores, "rid", "left").select("page_id", "host", "path", "rule", F.coalesce("ruled", model).alias("verdict"), score.alias("score"))
