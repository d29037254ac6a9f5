"""Chat formatting by quotation linking (native).

A line that starts with ``>`` marks is quoted, as deep as it has marks.  Adjacent
quoted lines of one depth form a passage, which is normalised (letters and digits
only, lower case) and hashed.  Passages are joined to messages of the same
conversation whose unquoted text holds that passage as a run of whole lines, as a
run of words (part of a line, or lines wrapped anew) or as the whole message; the latest earlier message wins.  A turn without a link answers
the turn before it.  Conversations are built in reply order without the quotes.

Messages post the runs of their lines and words that are as long as some passage of their
conversation.  The latest earlier message is found per (conversation, hash) by a
running maximum over blocks of turns, not by pairs, so a passage that many turns
state and many quote costs no more than its rows.

Defined results for odd input: a null or empty text is a turn without text; rows
with a null conversation or turn keep their text and have no parent; of repeated
rows with one (conversation, turn) all are returned, with the parent they share; an
empty table gives an empty table; only the four named columns are read.  Parsed turns
are written when the frame is built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .native import let
from .shared import written

_QUOTE = r"^(\s*>)+\s?"


def _depth(line: Column) -> Column:
    marks = F.regexp_extract(line, r"^((?:\s*>)+)", 1)
    return F.length(F.regexp_replace(marks, r"[^>]", ""))


def _normal(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


def _lines(text: Column) -> Column:
    """Struct of depth and body of each line."""
    return F.transform(
        F.split(F.coalesce(text, F.lit("")), "\r?\n"),
        lambda x: F.struct(_depth(x).alias("depth"), F.regexp_replace(x, _QUOTE, "").alias("body")),
    )


def _words(bodies: Column) -> Column:
    """The normalised words of some lines, however they are wrapped."""
    return F.filter(F.transform(F.split(F.array_join(bodies, " "), r"\s+"), _normal), lambda x: x != "")


def _run_hash(words: Column) -> Column:
    """Hash of a run of words; it differs from the hash of the same text as lines."""
    return F.xxhash64(F.lit("words"), F.array_join(words, " "))


def _passages(lines: Column) -> Column:
    """(n, hash, m, run) of the quoted passages, adjacent lines of one depth; n counts the lines with a letter or digit, m the words."""

    def passage(start: Column, stop: Column) -> Column:
        bodies = F.transform(F.slice(lines, start, stop - start), lambda x: x["body"])
        return let(
            F.struct(F.filter(F.transform(bodies, _normal), lambda x: x != "").alias("l"), _words(bodies).alias("w")),
            lambda x: F.struct(
                F.size(x["l"]).alias("n"), F.xxhash64(F.array_join(x["l"], "")).alias("hash"), F.size(x["w"]).alias("m"), _run_hash(x["w"]).alias("run")
            ),
        )

    depths = F.transform(lines, lambda x: x["depth"])
    found = let(
        depths,
        lambda d: let(
            F.filter(F.sequence(F.lit(1), F.size(d)), lambda i: (i == 1) | (F.get(d, i - 1) != F.get(d, i - 2))),
            lambda starts: F.filter(
                F.transform(
                    starts,
                    lambda s, j: F.when(F.get(d, s - 1) > 0, passage(s, F.coalesce(F.get(starts, j + 1), F.size(d) + 1))),
                ),
                lambda p: p["n"] > 0,
            ),
        ),
    )
    return F.array_distinct(found)


def link_turns(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """conv_id, turn, role, reply_to, n_quotes, n_linked, content: one row per input row."""
    empty = F.array().cast("array<struct<n:int,hash:bigint,m:int,run:bigint>>")
    rows = turns.select(
        turns[conv_col].alias("conv_id"), turns[turn_col].alias("turn"), turns[role_col].alias("role"),
        F.explode(F.array(let(_lines(turns[text_col]), lambda x: F.struct(
            F.trim(F.array_join(F.transform(F.filter(x, lambda y: y["depth"] == 0), lambda y: y["body"]), "\n")).alias("content"),
            F.when(F.exists(x, lambda y: y["depth"] > 0), _passages(x)).otherwise(empty).alias("quotes"),
        )))).alias("m"),
    ).select("conv_id", "turn", "role", "m.content", "m.quotes")
    rows = written(rows, "chat-turns")  # parsed once, read by each step
    keyed = "conv_id is not null and turn is not null"
    quotes = rows.filter(keyed).filter(F.size("quotes") > 0).select("conv_id", "turn", F.inline("quotes")).distinct()
    # What a message may be quoted by: the runs of its lines as long as a passage of its conversation, and all of it.
    # A conversation without quotes posts nothing, however long it is.
    lengths = quotes.select("conv_id", "n").distinct()
    lines = F.split("content", "\n")
    stated = rows.filter(keyed).join(quotes.select("conv_id").distinct(), "conv_id", "left_semi").select(
        "conv_id", "turn", F.filter(F.transform(lines, _normal), lambda y: y != "").alias("own"), _words(lines).alias("words")
    ).filter(F.size("own") > 0)
    runs = (
        stated.join(lengths, "conv_id").filter(F.col("n") <= F.size("own"))
        .select("conv_id", "turn", F.explode(F.transform(
            F.sequence(F.lit(1), F.size("own") - F.col("n") + 1), lambda i: F.xxhash64(F.array_join(F.slice("own", i, F.col("n")), ""))
        )).alias("hash"))
    )
    wholes = stated.select("conv_id", "turn", F.xxhash64(F.array_join("own", "")).alias("hash"))
    # Runs of words as long as a passage find a part of a line or message, and lines wrapped anew.
    word_runs = (
        stated.join(quotes.select("conv_id", "m").distinct(), "conv_id").filter((F.col("m") > 0) & (F.col("m") <= F.size("words")))
        .select("conv_id", "turn", F.explode(F.transform(
            F.sequence(F.lit(1), F.size("words") - F.col("m") + 1), lambda i: _run_hash(F.slice("words", i, F.col("m")))
        )).alias("hash"))
    )
    keys = quotes.select("conv_id", "turn", F.col("hash").alias("passage"), F.explode(F.array("hash", "run")).alias("hash"))
    found = _latest_before(keys.select("conv_id", "hash", "turn").distinct(), runs.union(wholes).union(word_runs).distinct())
    links = found.join(keys.distinct(), ["conv_id", "turn", "hash"]).groupBy("conv_id", "turn").agg(
        F.max("from_turn").alias("linked_to"), F.count_distinct("passage").alias("n_linked")
    )
    # The turn before: equal to "the greatest smaller turn", found without gathering a conversation.
    before = _turn_before(rows.filter(keyed).select("conv_id", "turn").distinct())
    out = rows.join(links, ["conv_id", "turn"], "left").join(before, ["conv_id", "turn"], "left")
    return out.select(
        "conv_id", "turn", "role",
        F.coalesce("linked_to", "previous").alias("reply_to"),
        F.size("quotes").cast("long").alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0).cast("long")).alias("n_linked"),
        "content",
    )


def _latest_before(asked: DataFrame, stated: DataFrame, block: int = 1024) -> DataFrame:
    """conv_id, turn, hash, from_turn: for each asked (conv_id, hash, turn), the latest smaller turn that states the hash.

    A running maximum in place of a join, so a passage that many turns state and many
    quote makes no pairs; turns are windowed in blocks, so a huge group is split.
    """
    from pyspark.sql import Window

    keys = ["conv_id", "hash"]
    both = asked.select(*keys, "turn", F.lit(True).alias("asks"), F.lit(None).cast(asked.schema["turn"].dataType).alias("at")).union(
        stated.select(*keys, "turn", F.lit(False), F.col("turn"))
    ).withColumn("block", F.floor(F.col("turn") / block))
    # At one turn the question comes first: a message cannot quote itself.
    inner = Window.partitionBy(*keys, "block").orderBy("turn", F.desc("asks")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("inner", F.max("at").over(inner)).filter("asks")
    ends = stated.groupBy(*keys, F.floor(F.col("turn") / block).alias("block")).agg(F.max("turn").alias("last"))
    asking = seen.select(*keys, "block").distinct()
    marks = asking.select(*keys, "block", F.lit(None).cast(asked.schema["turn"].dataType).alias("last"), F.lit(0).alias("late")).union(
        ends.select(*keys, "block", "last", F.lit(1))
    )
    carry = Window.partitionBy(*keys).orderBy("block", "late").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = marks.withColumn("carry", F.max("last").over(carry)).filter("late = 0").select(*keys, "block", "carry")
    return (
        seen.join(carried, [*keys, "block"], "left")
        .select("conv_id", "turn", "hash", F.coalesce("inner", "carry").alias("from_turn"))
        .filter("from_turn is not null")
    )


def _turn_before(turns: DataFrame, block: int = 1024) -> DataFrame:
    """The greatest smaller turn of each conversation; turns are windowed in blocks, so a huge conversation is split."""
    from pyspark.sql import Window

    blocks = turns.withColumn("block", F.floor(F.col("turn") / block))
    inner = Window.partitionBy("conv_id", "block").orderBy("turn")
    lagged = blocks.withColumn("inner", F.lag("turn").over(inner))
    ends = blocks.groupBy("conv_id", "block").agg(F.max("turn").alias("last"))
    carried = ends.withColumn("carry", F.lag("last").over(Window.partitionBy("conv_id").orderBy("block")))
    return lagged.join(carried.select("conv_id", "block", "carry"), ["conv_id", "block"], "left").select(
        "conv_id", "turn", F.coalesce("inner", "carry").alias("previous")
    )


def _line_of(template: str) -> Column:
    before, _, rest = template.partition("{role}")
    middle, _, after = rest.partition("{text}")
    return F.concat(
        F.lit(before), F.coalesce("role", F.lit("unknown")), F.lit(middle), F.coalesce("content", F.lit("")), F.lit(after)
    )


def conversation_parts(linked: DataFrame, template: str = "<|{role}|>\n{text}\n", block: int = 1024) -> DataFrame:
    """conv_id, part, n_turns, text: each conversation in reply order (by parent, then turn), ``block`` turns a part.

    The parts of a conversation, joined by ``part``, are its text.  The place of a turn is
    added up from counts of blocks, so neither a huge conversation nor a turn with many
    answers is gathered in one place.
    """
    from pyspark.sql import Window

    rows = linked.select("conv_id", F.coalesce("reply_to", F.lit(-1)).alias("p"), "turn", _line_of(template).alias("x"))
    rows = rows.withColumn("pb", F.floor(F.col("p") / block)).withColumn("tb", F.floor(F.col("turn") / block))

    def before(of: DataFrame, group: list[str], by: str, name: str) -> DataFrame:
        w = Window.partitionBy(*group).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        return of.withColumn(name, F.coalesce(F.sum("n").over(w), F.lit(0)))

    by_turns = rows.groupBy("conv_id", "pb", "p", "tb").agg(F.count("*").alias("n"))
    by_parents = by_turns.groupBy("conv_id", "pb", "p").agg(F.sum("n").alias("n"))
    by_blocks = by_parents.groupBy("conv_id", "pb").agg(F.sum("n").alias("n"))
    a = before(by_turns, ["conv_id", "p"], "tb", "in_parent").drop("n")
    b = before(by_parents, ["conv_id", "pb"], "p", "in_block").drop("n")
    c = before(by_blocks, ["conv_id"], "pb", "in_all").drop("n")

    def meet(x: DataFrame, y: DataFrame, keys: list[str]) -> DataFrame:
        y = y.select(*[F.col(k).alias(f"__{k}") for k in keys], *[k for k in y.columns if k not in keys])
        same = F.lit(True)
        for k in keys:
            same = same & x[k].eqNullSafe(y[f"__{k}"])
        return x.join(y, same).drop(*[f"__{k}" for k in keys])

    start = meet(meet(a, b, ["conv_id", "pb", "p"]), c, ["conv_id", "pb"])
    near = F.row_number().over(Window.partitionBy("conv_id", "p", "tb").orderBy("turn", "x"))
    placed = meet(rows.withColumn("near", near).drop("pb"), start.drop("pb"), ["conv_id", "p", "tb"])
    placed = placed.withColumn("place", F.col("in_all") + F.col("in_block") + F.col("in_parent") + F.col("near") - 1)
    return placed.groupBy("conv_id", F.floor(F.col("place") / block).alias("part")).agg(
        F.count("*").alias("n_turns"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "x"))), lambda s: s["x"]), "").alias("text"),
    )


def conversations(linked: DataFrame, template: str = "<|{role}|>\n{text}\n") -> DataFrame:
    """conv_id, n_turns, text: each conversation as one text in reply order (by parent, then turn).

    A conversation's turns meet in one row, which is what its text is; one
    conversation is bounded by what a training example may hold.
    """
    line = _line_of(template)
    return linked.groupBy("conv_id").agg(
        F.count("*").alias("n_turns"),
        F.array_join(
            F.transform(
                F.sort_array(F.collect_list(F.struct(F.coalesce("reply_to", F.lit(-1)).alias("p"), "turn", line.alias("x")))),
                lambda s: s["x"],
            ),
            "",
        ).alias("text"),
    )
