"""Exact duplicates by a most-significant-byte-first radix split of whole texts.

All texts begin as one group.  A level splits each group by the next bytes of
its texts; what is alone in its group leaves, and so do texts that have ended,
which are then equal from the first byte to the last.  Texts are told by their
bytes alone, no digest decides.  A level reads more bytes than the one before
(64, 1 KB, 16 KB, ...), so most texts leave after their first bytes and a text
of n bytes is over after about log n levels.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from hammerline.llm._spark import cut

#: Bytes that the first level reads, how many times more each next one reads, and the most.
FIRST, GROWTH, WIDEST = 64, 16, 4 << 20

#: Groups are broadcast up to so many bytes; beyond, only those of the most rows are, of at most HOT_BYTES together.
BROADCAST_BYTES, HOT_BYTES, HOT_GROUPS = 64 << 20, 16 << 20, 1024

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def folded(text: Column) -> Column:
    """The text with A-Z in lower case and all else as it is; a null is an empty text."""
    return F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower())


def _prefix(text: Column, width: int) -> Column:
    """The first bytes of the folded text; so many characters hold them, so no more are folded."""
    return F.substring(folded(F.substring(text, 1, width)).cast("binary"), 1, width)


def _meet(rows: DataFrame, groups: DataFrame, width: int) -> DataFrame:
    """Each row with its group's number, size and kept id, nulls where it is alone.

    Small tables of groups are broadcast.  Of larger ones the groups with more
    than a share of the rows are, which bounds their number; the others are
    joined by a shuffle, where no key then has more rows than that share.
    """
    size = groups.agg(F.coalesce(F.sum(F.length("piece") + 64), F.lit(0)).alias("bytes"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    keys = ["group", "piece"]
    if size["bytes"] <= BROADCAST_BYTES:
        return rows.join(F.broadcast(groups), keys, "left")
    most = size["rows"] / max(4, min(HOT_GROUPS, HOT_BYTES // width))
    first = rows.join(F.broadcast(groups.where(F.col("n") > most)), keys, "left")
    rest = first.where("node is null").drop("node", "n", "keep").join(groups.where(F.col("n") <= most), keys, "left")
    return first.where("node is not null").unionByName(rest)


def equal_texts(docs: DataFrame, text: str = "text", id_col: str = "doc_id", carry: Mapping[str, Column] | None = None) -> DataFrame:
    """One row per input row: (id, keep_id, group_size, kept) and the columns of `carry`, made of the input's columns.

    keep_id is the largest id among the rows whose texts are equal after A-Z is
    lowered; `kept` tells the rows with that id, so of rows equal in id and text
    all stay.  A null text is an empty one.  Null ids are smaller than all
    others; where a group has no other, keep_id is null and its rows are kept.
    Texts of any length are compared whole.  An empty table gives an empty
    result; the input's other columns may have any names.
    """
    carried = F.struct(*[c.alias(k) for k, c in (carry or {"none": F.lit(None).cast("int")}).items()])
    width = FIRST
    rows = docs.select(F.col(id_col).alias("id"), carried.alias("carry"), F.lit(0).cast("long").alias("group"), F.col(text).alias("text"), _prefix(F.col(text), width).alias("piece"))
    tail = F.substring(folded(F.col("text")).cast("binary"), width + 1, 2**31 - 1)
    done: DataFrame | None = None
    while True:
        groups = rows.groupBy("group", "piece").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keep")).where("n > 1")
        groups = cut(groups.withColumn("node", F.monotonically_increasing_id()))
        # A text that is shorter than the level's bytes has ended.
        goes_on = F.col("node").isNotNull() & (F.length("piece") == width)
        level = cut(_meet(rows, groups, width).select("id", "carry", F.col("node").alias("group"), "n", "keep", F.when(goes_on, tail).alias("tail")))
        left = level.where("tail is null").select("id", F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), "carry")
        done = left if done is None else done.unionByName(left)
        if level.where("tail is not null").isEmpty():
            break
        width = min(width * GROWTH, WIDEST)
        rows = level.where("tail is not null").select("id", "carry", "group", "tail", F.substring("tail", 1, width).alias("piece"))
        tail = F.substring("tail", width + 1, 2**31 - 1)
    kept = F.col("id").eqNullSafe(F.col("keep_id"))
    return done.select(F.col("id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), *[F.col("carry")[k].alias(k) for k in carry or ()])


def drop_copies(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of `docs` that stay, with all their columns: of equal texts those with the largest id."""
    marked = equal_texts(docs, text, id_col, {"row": F.struct(*[F.col(f"`{c}`") for c in docs.columns])})
    return marked.where("kept").select("row.*")
