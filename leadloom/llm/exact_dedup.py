"""Exact deduplication by distributed most-significant-digit radix partitioning.

Texts are equal when identical after lower-casing A-Z. A text is a sequence of digits: its byte length, then its bytes in runs that
grow from FIRST by GROWTH a round. Every round splits each group by the next digit; groups of one document are settled at once, groups
whose texts have ended are groups of equal texts. Equality rests on the bytes alone, no digest takes part.

The first digits of all rows are aggregated (with map-side combination) before anything is carried: only rows whose length and first bytes
occur twice or more take part in the later rounds. Those are written once with a number; the rounds carry the number and what is left of the
text, and only for groups that are not settled; the verdicts are joined back to the rows at the end. Groups are formed by aggregates and joined back through a size-checked
broadcast, or else by a join of two written tables whose hot keys AQE splits, so that a group of a third of all rows stays spread.
The number of rounds is the logarithm of the longest text that is in doubt.

Cases: null text counts as empty; of equal texts the row with the largest doc_id stays (a null doc_id is below all; of rows that repeat
it, exactly one stays); an empty table gives an empty table; columns of any other name are left alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut, join_checked

FIRST, GROWTH = 64, 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normal(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def split_groups(docs: DataFrame, id_col: str, text_col: str, payload: list[Column]) -> tuple[DataFrame, DataFrame]:
    """(rows alone in their first digits, the others with group_size, keep_id, kept): both have the payload's columns in the struct `_doc`, and `_text`."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.struct(*payload).alias("_doc"), F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"), F.octet_length(text).alias("_len"), normal(F.substring(text, 1, FIRST)).alias("_head"))
    shared = cut(rows.groupBy("_len", "_head").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n"), "radix-heads")
    alone = join_checked(rows, shared, ["_len", "_head"], "left_anti", ["_head"])
    doubt = join_checked(rows, shared, ["_len", "_head"], "left_semi", ["_head"])
    doubt = cut(doubt.select("_doc", "_id", "_text", "_len", F.monotonically_increasing_id().alias("_row")), "radix-rows")
    verdicts = cut(settle(doubt), "radix-verdicts")
    return alone.select("_doc", "_text"), join_checked(doubt.select("_row", "_doc", "_text"), verdicts, ["_row"], "inner")


def settle(doubt: DataFrame) -> DataFrame:
    """doubt (_row, _id, _text, _len): _row, group_size, keep_id, kept, by rounds of digits; a group is named by the least row in it."""
    longest = doubt.agg(F.max("_len")).first()[0] or 0
    open_rows = doubt.select("_id", "_row", "_len", F.col("_len").cast("bigint").alias("_group"), F.encode(normal(F.col("_text")), "UTF-8").alias("_rest"))
    settled, at, width = [], 0, FIRST
    while True:
        carried = open_rows.select("_id", "_row", "_len", "_group", F.substring("_rest", 1, width).alias("_digit"), F.substring(F.col("_rest"), F.lit(width + 1), F.lit(1 << 30)).alias("_rest"))
        groups = cut(carried.groupBy("_group", "_digit").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_name")), "radix-groups")
        at, width = at + width, width * GROWTH
        done = (F.col("_n") == 1) | (F.col("_len") <= at)
        joined = join_checked(carried, groups, ["_group", "_digit"], "inner", ["_digit"])
        step = cut(joined.select("_id", "_row", "_len", F.col("_name").alias("_group"), F.when(~done, F.col("_rest")).alias("_rest"), (~done).alias("_open")), "radix")
        settled.append(step.where("not _open").select("_row", "_id", "_group"))
        drop_cut(groups)
        open_rows = step.where("_open")
        if longest <= at or open_rows.isEmpty():
            break
    rows = reduce(DataFrame.unionByName, settled)
    best = rows.groupBy("_group").agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("_id", "_row")).alias("_best"))
    best = cut(best.select("_group", "group_size", F.col("_best._id").alias("keep_id"), F.col("_best._row").alias("_best_row")), "radix-best")
    return join_checked(rows, best, ["_group"], "inner").select("_row", "group_size", "keep_id", (F.col("_row") == F.col("_best_row")).alias("kept"))


def find_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, keep_id, group_size, kept, text_sha256 of the normalised text."""
    alone, equal = split_groups(docs, id_col, text_col, [F.col(f"`{id_col}`").alias("doc_id")])
    both = alone.select("_doc", "_text", F.lit(1).cast("bigint").alias("group_size"), F.col("_doc.doc_id").alias("keep_id"), F.lit(True).alias("kept")).unionByName(equal.drop("_row"))
    sha = F.sha2(F.encode(normal(F.col("_text")), "UTF-8"), 256)
    return both.select(F.col("_doc.doc_id").alias("doc_id"), "keep_id", "group_size", "kept", sha.alias("text_sha256"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of equal texts (all columns)."""
    others = [c for c in docs.columns if c != text_col]
    alone, equal = split_groups(docs, id_col, text_col, [F.col(f"`{c}`") for c in others] or [F.lit(None).alias("_none")])
    both = alone.unionByName(equal.where("kept").select("_doc", "_text"))
    return both.select(*((F.col("_text") if c == text_col else F.col(f"_doc.`{c}`")).alias(c) for c in docs.columns))


#: The same in SQL for DuckDB.
ORACLE = """
with t as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as n from documents)
select doc_id, max(doc_id) over (partition by n) as keep_id, count(*) over (partition by n) as group_size,
  doc_id = max(doc_id) over (partition by n) as kept, sha256(n) as text_sha256 from t
"""
