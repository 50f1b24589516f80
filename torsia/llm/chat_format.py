"""Conversations in reply order, without quotations, by linking quotes to their originals.

A line that starts with ``>`` is quoted, once per mark; blanks may stand between
marks. Lines in a row with one level form a passage. Passages and what messages
say themselves are hashed after white space is made single and A-Z lower-cased:
whole, by paragraph and by line. A quoted unit's original is the earliest turn of
the conversation that says it itself; passages of all levels are linked, a unit
that is quoted at several levels once, at its least. A message replies to the
earlier turn from which most characters of its first-level quotes come, of equals
the latest. Deeper levels were quoted by the message that is quoted, so the least
of them decides only where no unit of a level before it is found.

Following replies up gives each message a root and a depth, by pointer doubling.
The order is conversation, root, depth, turn: every reply follows its parent.

Defined results: a message without a quote that can be found is its own root, so
conversations without quotes keep their order; texts without quotes stay as they
are; null text is empty; rows with a null conversation or turn are never linked;
messages that share conversation and turn share their links; of the columns only
conversation, turn, role and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, written

QUOTE = r"^\s{0,3}(>[> ]*)"


def normal(c: Column) -> Column:
    return lower_ascii(F.trim(F.regexp_replace(c, r"\s+", " ")))


def depth(line: Column) -> Column:
    return F.length(F.translate(F.regexp_extract(line, QUOTE, 1), " ", ""))


def units(messages: DataFrame, quoted: bool) -> DataFrame:
    """(conv, turn, level, unit, chars): normalised texts of each quote level, or of level 0: whole, paragraphs and lines, each once a level.

    The lines of a message come together in one row, as long as the message.
    """
    raw = F.split("text", "\n")
    levels = F.filter(F.array_distinct(F.transform(raw, depth)), lambda x: x > 0) if quoted else F.array(F.lit(0))
    messages = messages.select("conv", "turn", "text", F.explode(levels).alias("level"))
    own = F.transform(
        raw, lambda x: F.when(depth(x) == F.col("level"), F.regexp_replace(x, QUOTE, "") if quoted else x)
    )
    # Lines of another level end a passage; blank lines end a paragraph.
    body = F.array_join(own, "\n", "\n\x00\n")
    parts = F.flatten(
        F.array(F.split(body, "\x00"), F.split(body, "\x00|\n[ \t\r]*\n"), F.split(body, "[\x00\n]"))
    )
    said = F.array_distinct(F.filter(F.transform(parts, normal), lambda x: x != ""))
    return messages.select("conv", "turn", "level", F.explode(said).alias("unit")).select(
        "conv", "turn", "level", F.sha2(F.col("unit").cast("binary"), 256).alias("unit"), F.length("unit").alias("chars")
    )


def parents(messages: DataFrame) -> DataFrame:
    """(conv, turn, parent, linked): the turn that each quoting message replies to."""
    quoting = messages.filter(F.col("text").rlike(r"(?m)^\s{0,3}>") & F.col("turn").isNotNull())
    quoted = units(quoting, True).groupBy("conv", "turn", "unit", "chars").agg(F.min("level").alias("level"))
    asked = quoted.select("conv", "unit").distinct()
    said = (
        units(messages.join(quoting.select("conv").distinct(), "conv", "left_semi"), False)
        .join(asked, ["conv", "unit"], "left_semi")
        .groupBy("conv", "unit")
        .agg(F.min("turn").alias("source"))
    )
    votes = (
        quoted.join(said, ["conv", "unit"])
        .filter(F.col("source") < F.col("turn"))
        .groupBy("conv", "turn", "level", "source")
        .agg(F.sum("chars").alias("chars"), F.count(F.lit(1)).alias("n"))
    )
    best = F.max(F.struct((-F.col("level")).alias("up"), "chars", "source")).alias("best")
    return votes.groupBy("conv", "turn").agg(best, F.sum("n").alias("linked")).select(
        "conv", "turn", F.col("best.source").alias("parent"), "linked"
    )


def roots(links: DataFrame) -> DataFrame:
    """(conv, turn, root, depth) of the messages with a parent, in rounds that halve the way."""
    now = written(links.select("conv", "turn", F.col("parent").alias("root"), F.lit(1).cast("long").alias("depth")), "replies")
    while True:
        up = now.select("conv", F.col("turn").alias("root"), F.col("root").alias("over"), F.col("depth").alias("more"))
        new = written(
            now.join(up, ["conv", "root"], "left").select(
                "conv",
                "turn",
                F.coalesce("over", "root").alias("root"),
                (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
                F.col("over").isNotNull().alias("moved"),
            ),
            "replies",
        )
        now = new.drop("moved")
        if new.filter("moved").isEmpty():
            return now


def format_conversations(
    df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(conv_id, turn, role, text, parent_turn, root_turn, depth, n_linked), in reply order."""
    messages = df.select(
        F.col(conv_col).alias("conv"),
        F.col(turn_col).alias("turn"),
        F.col(role_col).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    links = written(parents(messages), "links")
    own = F.filter(F.split("text", "\n"), lambda x: ~x.rlike(QUOTE))
    clean = F.when(
        F.col("text").rlike(r"(?m)^\s{0,3}>"), F.regexp_replace(F.array_join(own, "\n"), r"^\s+|\s+$", "")
    ).otherwise(F.col("text"))
    return (
        messages.withColumn("text", clean)
        .join(links, ["conv", "turn"], "left")
        .join(roots(links), ["conv", "turn"], "left")
        .select(
            F.col("conv").alias("conv_id"),
            "turn",
            "role",
            "text",
            F.col("parent").alias("parent_turn"),
            F.coalesce("root", "turn").alias("root_turn"),
            F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
            F.coalesce("linked", F.lit(0)).cast("long").alias("n_linked"),
        )
        .orderBy("conv_id", "root_turn", "depth", "turn")
    )
