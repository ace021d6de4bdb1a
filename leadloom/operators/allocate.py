"""Allocation: top-k assignment, waterfall over schedules, capacity slots, order and pages."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from ..functions.lineage import global_rank
from .filters import contact_requirement

ORDERS = {
    "newest": [F.desc, "created_at"], "oldest": [F.asc, "created_at"], "score": [F.desc, "lead_score"], "score_low": [F.asc, "lead_score"], "verification": [F.desc, "verification_score"], "title": [F.asc, "title"],
}
PAGE_SIZES = [10, 25, 50, 100]
EXPORT_MOST = 700


def lead_order(leads: DataFrame, by: str = "newest", key: str = "lead_id") -> DataFrame:
    """One of six orders, ties by id."""
    direction, column = ORDERS.get(by, ORDERS["newest"])
    return leads.orderBy(direction(column), key)


def page(leads: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """A page of an allowed size; numbers outside clamp to the first and last page."""
    size = size if size in PAGE_SIZES else 25
    pages = max(1, -(-leads.count() // size))
    return leads.orderBy(*order).offset((min(max(number, 1), pages) - 1) * size).limit(size)


#: Rows of a part of a clustered table.
PART_ROWS = 100_000


class PagedTable:
    """A table kept in an order for paging: each row has its number, parts hold PART_ROWS numbers each, and a page is read from the one or two parts that its numbers lie in.

    Written once by ranges (no sort in one task); a page, however far behind, opens the files of its parts only, which their folder names tell.
    """

    def __init__(self, spark: SparkSession, path: str, part_rows: int = PART_ROWS):
        self.spark, self.path, self.part_rows = spark, path.rstrip("/"), part_rows

    def write(self, df: DataFrame, order: list[Column]) -> PagedTable:
        ranked = global_rank(df, order, "_n").withColumn("_part", F.floor((F.col("_n") - 1) / self.part_rows))
        ranked.repartition("_part").sortWithinPartitions("_n").write.mode("overwrite").partitionBy("_part").parquet(f"{self.path}/parts")
        ranked.agg(F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(f"{self.path}/size")
        self.spark.createDataFrame([], df.schema).write.mode("overwrite").parquet(f"{self.path}/schema")
        return self

    def rows(self) -> int:
        return self.spark.read.parquet(f"{self.path}/size").first()[0]

    def parts(self, first: int, last: int) -> DataFrame | None:
        """The parts with the rows of these numbers; only their folders are listed."""
        found = range((first - 1) // self.part_rows, (last - 1) // self.part_rows + 1) if last >= first else ()
        if not found:
            return None
        return self.spark.read.option("basePath", f"{self.path}/parts").parquet(*(f"{self.path}/parts/_part={k}" for k in found))

    def page(self, number: int, size: int) -> DataFrame:
        """A page of an allowed size; numbers outside clamp to the first and last page."""
        size = size if size in PAGE_SIZES else 25
        n = self.rows()
        number = min(max(number, 1), max(1, -(-n // size)))
        first, last = (number - 1) * size + 1, min(number * size, n)
        rows = self.parts(first, last)
        if rows is None:
            return self.spark.read.parquet(f"{self.path}/schema")
        return rows.where(F.col("_n").between(first, last)).orderBy("_n").drop("_n", "_part")


def latest_n(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def clamp_limit(n: int, most: int = EXPORT_MOST) -> int:
    return min(max(n, 1), most)


def unassigned(leads: DataFrame, assignments: DataFrame) -> DataFrame:
    return leads.join(assignments.where("is_current").select("lead_id"), "lead_id", "left_anti")


def priority() -> list[Column]:
    """By verification, then score, then age."""
    return [F.desc("verification_score"), F.desc("lead_score"), F.asc("created_at"), F.asc("lead_id")]


def eligible(leads: DataFrame, assignments: DataFrame, minimum: int, requirement: str, verified_only: bool) -> DataFrame:
    """Unassigned leads that a schedule may give out (with the flag verified_ready)."""
    out = unassigned(leads, assignments).where(~F.coalesce(F.col("do_not_contact"), F.lit(False)) & (F.col("lead_score") >= minimum))
    out = out.where("verified_ready") if verified_only else out
    return out.where(contact_requirement(F.lit(requirement)))


def assign_top(leads: DataFrame, assignments: DataFrame, k: int, minimum: int = 0, requirement: str = "any", verified_only: bool = False) -> DataFrame:
    return eligible(leads, assignments, minimum, requirement, verified_only).orderBy(*priority()).limit(k)


#: Places that all schedules of one waterfall may have together: what a task holds of each class.
WATERFALL_PLACES = 1_000_000


def waterfall(leads: DataFrame, assignments: DataFrame, schedules: list[dict]) -> DataFrame:
    """(lead_id, schedule_id): each schedule in turn takes its first k of what is left. schedules is a stated list in order of their next run, with WATERFALL_PLACES places at most.

    All schedules rank leads alike, so the leads in order of priority, each taken by the first schedule that it qualifies for and that has a place left, come to the same. Which schedules a lead
    qualifies for depends on its score (between which of the schedules' minima), its readiness and its contacts alone; leads that agree in these are a class. Of a class
    only as many as all its schedules can take are read, found by class and salt first; these bounded few are assigned in one ordered pass, which holds the places left and, for each class, its first open schedule
    (schedules that are full stay full). The number of jobs doesn't depend on the number of schedules.
    """
    spark = leads.sparkSession
    if sum(s["k"] for s in schedules) > WATERFALL_PLACES:
        raise ValueError(f"more than {WATERFALL_PLACES} places")
    minima, needs = sorted({s.get("minimum", 0) for s in schedules}), sorted({s.get("requirement", "any") for s in schedules})
    pool = unassigned(leads, assignments).where(~F.coalesce(F.col("do_not_contact"), F.lit(False)))
    above = sum((F.coalesce((F.col("lead_score") >= m).cast("int"), F.lit(0)) for m in minima), F.lit(0)).alias("a")
    meets = [F.coalesce(contact_requirement(F.lit(n)), F.lit(False)).alias(f"n{i}") for i, n in enumerate(needs)]
    classed = pool.select("lead_id", *(c for c in ("verification_score", "lead_score", "created_at")), F.struct(above, F.coalesce(F.col("verified_ready"), F.lit(False)).alias("v"), *meets).alias("class"))

    def serves(s: dict, c: Row) -> bool:
        return c["a"] > minima.index(s.get("minimum", 0)) and (c["v"] or not s.get("verified_only", False)) and c[f"n{needs.index(s.get('requirement', 'any'))}"]

    classes = [r[0] for r in classed.select("class").distinct().collect()]  # at most minima + 1 by 2 by 2 ** requirements
    queues = [[i for i, s in enumerate(schedules) if serves(s, c)] for c in classes]
    table = [(n, c, sum(schedules[i]["k"] for i in q)) for n, (c, q) in enumerate(zip(classes, queues, strict=True)) if q]
    out = f"lead_id {leads.schema['lead_id'].dataType.simpleString()}, _schedule int"
    if not table:
        return classed.select("lead_id", F.lit(None).cast("int").alias("schedule_id")).limit(0)
    known = spark.createDataFrame(table, StructType([StructField("_n", IntegerType()), StructField("class", classed.schema["class"].dataType), StructField("_most", LongType())]))
    rows = classed.join(F.broadcast(known), "class")  # a row a class
    for part in ([F.pmod(F.xxhash64("lead_id"), F.lit(int(spark.conf.get("spark.sql.shuffle.partitions"))))], []):
        first = Window.partitionBy("_n", *part).orderBy(*priority())
        rows = rows.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= F.col("_most"))
    places = [s["k"] for s in schedules]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, at = list(places), [0] * len(queues)
        for batch in batches:
            ids, taken = [], []
            for i, n in enumerate(batch.column(1).to_pylist()):
                q = queues[n]
                while at[n] < len(q) and not left[q[at[n]]]:
                    at[n] += 1
                if at[n] < len(q):
                    left[q[at[n]]] -= 1
                    ids.append(i)
                    taken.append(q[at[n]])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(taken, pa.int32())], names=["lead_id", "_schedule"])

    few = rows.select("lead_id", "_n", "verification_score", "lead_score", "created_at").repartition(1).sortWithinPartitions(*priority())  # bounded by the places of each class
    got = few.select("lead_id", "_n").mapInArrow(run, out)
    ids = F.array(*(F.lit(s["schedule_id"]) for s in schedules))
    return got.select("lead_id", F.element_at(ids, F.col("_schedule") + 1).alias("schedule_id"))


def current_assignment(old: DataFrame, new: DataFrame) -> DataFrame:
    """History of assignments: the newest of each lead is current, the others are kept."""
    both = old.drop("is_current").unionByName(new.drop("is_current"))
    newest = Window.partitionBy("lead_id").orderBy(F.desc("assigned_at"), F.desc("assignment_id"))
    return both.withColumn("is_current", F.row_number().over(newest) == 1)


def capacity_slots(due: DataFrame, senders: DataFrame, due_order: list[Column]) -> DataFrame:
    """due with the sender of each row: the least recently used active sender with a free place.

    The first free place of each sender comes in order of last use (NULL first), places used, id; later places after all of them, by their
    number. Place n serves due row n. Rows without a place have a NULL sender.
    """
    free = senders.where(F.col("is_active") & (F.col("sent_today") < F.col("daily_limit")))
    slots = free.select("sender_id", "last_sent_at", "sent_today", F.explode(F.sequence(F.lit(0), F.col("daily_limit") - F.col("sent_today") - 1)).alias("r"))
    first = F.col("r") == 0
    order = [(~first).cast("int"), F.when(first, F.col("last_sent_at")).asc_nulls_first(), F.when(first, F.lit(0)).otherwise(F.col("sent_today") + F.col("r")), F.when(first, F.col("sent_today")), F.col("sender_id"), F.col("r")]
    keyed = slots.select("sender_id", *(c.alias(f"k{i}") if i != 1 else F.when(first, F.col("last_sent_at")).alias("k1") for i, c in enumerate(order)))
    by = [F.col("k0"), F.col("k1").asc_nulls_first(), F.col("k2"), F.col("k3"), F.col("k4"), F.col("k5")]
    placed = global_rank(keyed, by, "slot").select("slot", "sender_id")
    return global_rank(due, due_order, "slot").join(placed, "slot", "left").drop("slot")


__all__ = [n for n in dir() if n[0].islower() and n not in {"annotations", "global_rank", "contact_requirement", "pa"}] + ["ORDERS", "PagedTable"]
