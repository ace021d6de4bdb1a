"""Incremental ingest with Structured Streaming: new rows are kept if no earlier row used any of their keys."""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.ids import canonical_book_key
from ..functions.lineage import cut, drop_cut
from ..functions.text import keyword_slug
from ..operators.dedupe import dedupe_any_key
from ..sources.files import STORE, load_keyword_results
from .keystore import KeyStore, unseen


def key_store(spark: SparkSession, store: str, **sizes: int) -> KeyStore:
    """The keys of a store of rows, in a folder beside it."""
    return KeyStore(spark, f"{store.rstrip('/')}-keys", **sizes)


def accept_new(batch: DataFrame, store: str, keys: Column, order: Column, number: str | None = None, **sizes: int) -> DataFrame:
    """Rows of a batch none of whose keys is in the store from another batch, greedy within the batch; `_keys` is their array of keys. Of the store only buckets of keys that its filters have seen are read."""
    rows = unseen(batch, keys, order, key_store(batch.sparkSession, store, **sizes), number)
    return dedupe_any_key(rows.withColumnRenamed("_keys", "_own"), F.col("_own"), order).withColumnRenamed("_own", "_keys")


def write_batch(batch: DataFrame, store: str, keys: Column, order: Column, number: int, **sizes: int) -> DataFrame:
    """Accept a batch: its rows into a folder named by its number, then their keys. Run again, whether it had failed or not, it replaces both by the same."""
    spark, target = batch.sparkSession, f"{store}/batch={number}"
    accept_new(batch, store, keys, order, str(number), **sizes).write.mode("overwrite").parquet(target)
    new = spark.read.parquet(target)
    key_store(spark, store, **sizes).add(new.select(F.explode("_keys").alias("key")), str(number))
    return new


def ingest(stream: DataFrame, store: str, checkpoint: str, keys: Column, order: Column, then: Callable[[DataFrame, int], None] | None = None, **sizes: int) -> StreamingQuery:
    """Run a stream of rows into the store (Parquet with `_keys`), batch by batch, and stop when it is drained."""

    def one(batch: DataFrame, number: int) -> None:
        new = write_batch(batch, store, keys, order, number, **sizes)
        if then:
            then(new, number)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_batches(batches: list[DataFrame], store: str, keys: Column, order: Column, **sizes: int) -> None:
    """The same over a list of batches, without a stream."""
    for number, batch in enumerate(batches):
        write_batch(batch, store, keys, order, number, **sizes)


def keyword_store(spark: SparkSession, path: str, keyword: str, start: int | None, end: int | None) -> DataFrame | None:
    """The valid rows of a keyword and window in a store of files.save_keyword_results or of accept_keyword, None before the first."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/slug=*/years=*")
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    return load_keyword_results(spark, path, keyword, start, end) if found else None


def rows_known(keys: KeyStore) -> int:
    """How many stored rows a key store answers for: those that it was made anew from, and one for each key since. Only folder names and footers are read."""
    held = keys.keys()
    if held is None:
        return 0
    anew = F.regexp_extract("batch", r"^rows=(\d+)$", 1)
    return held.agg(F.coalesce(F.max(F.try_to_number(F.nullif(anew, F.lit("")), F.lit("999999999999999"))), F.lit(0)).cast("bigint") + F.count_if(anew == "")).first()[0]


def accept_keyword(batch: DataFrame, path: str, keyword: str, start: int | None, end: int | None, most: int | None = None) -> DataFrame:
    """Rows of a batch (ord and the columns of the store but keyword) whose book is new to the store, the first of each book, at most `most` of them in order; appended to the store.

    A batch that is run again adds nothing: its books are in the store by then. The keys of stored books are asked through a KeyStore of the keyword and window, of which only buckets that a filter
    has seen are read; it is made anew where it hasn't a key for each stored row (after a crash between rows and keys, or for rows that were saved without it), which the files' footers tell.
    """
    spark = batch.sparkSession
    keyed = batch.withColumn("_key", canonical_book_key("code")).where("_key <> ''")
    years = f"{start or 'any'}-{end or 'any'}"
    slug = spark.range(1).select(keyword_slug(F.lit(keyword))).first()[0]
    keys = KeyStore(spark, f"{path.rstrip('/')}-keys/{slug}/{years}")
    stored = keyword_store(spark, path, keyword, start, end)
    if stored is not None:
        rows = spark.read.parquet(path).where((F.col("slug") == slug) & (F.col("years") == years)).count()
        if rows != rows_known(keys):
            keys.rebuild(stored.select(canonical_book_key("code").alias("key")).where("key <> ''"), f"rows={rows}")
        keyed = keyed.join(keys.seen(keyed.select(F.col("_key").alias("key"))).withColumnRenamed("key", "_key"), "_key", "left_anti")
    first = keyed.groupBy("_key").agg(F.min_by(F.struct(*batch.columns), F.struct("ord", "title")).alias("r")).select("r.*")
    new = cut(first if most is None else first.orderBy("ord", "title").limit(most), "keyword")
    out = new.drop("ord").withColumns({"keyword": F.lit(keyword), "slug": keyword_slug(F.lit(keyword)), "years": F.lit(f"{start or 'any'}-{end or 'any'}")})
    out.write.mode("append").partitionBy("slug", "years").parquet(path)
    keys.add(new.select(canonical_book_key("code").alias("key")), uuid.uuid4().hex)
    return new


def ingest_keyword(spark: SparkSession, path: str, keyword: str, start: int | None, end: int | None, batches: list[tuple[str, DataFrame]], most: int | None = None, only_new: bool = False) -> DataFrame:
    """Batches of candidates, each (kind, rows), into a keyword's store until `most` books are there (with only_new: until `most` new ones are); the books, stored ones left out with only_new.

    Of five books or more, kind "web" may fill all but 40 %; the rest is kept for catalogs.
    """
    before = None if only_new else keyword_store(spark, path, keyword, start, end)
    out = [] if before is None else [cut(before.select(*STORE.fieldNames()), "keyword")]
    if most is not None and out:
        out = [cut(out[0].orderBy("code").limit(most), "keyword")]
    count = sum(x.count() for x in out)
    reserve = max(1, round(most * 0.4)) if most is not None and most >= 5 else 0
    for kind, batch in batches:
        left = None if most is None else (most - reserve if kind == "web" else most) - count
        if left is None or left > 0:
            new = accept_keyword(batch, path, keyword, start, end, left)
            count += new.count()
            out.append(new.withColumn("keyword", F.lit(keyword)).select(*STORE.fieldNames()))
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], STORE)


def keyword_stream(stream: DataFrame, path: str, checkpoint: str, keyword: str, start: int | None, end: int | None) -> StreamingQuery:
    """The same over a stream of candidates until it is drained, without a cap."""
    one = lambda batch, number: drop_cut(accept_keyword(batch, path, keyword, start, end))
    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: An assignment whose last change is older than this is settled: its row is given out and its state forgotten.
SETTLED = datetime.timedelta(days=90)
TIMES = {"started_at": ("in_progress", "contacted", "follow_up"), "completed_at": ("completed",), "converted_at": ("converted",)}
STATE = "started_at timestamp, completed_at timestamp, converted_at timestamp, status string, at timestamp, due bigint"


class AssignmentState(StatefulProcessor):
    """The state of one assignment: the first time of each kind of change, and the last status; order and repetition of events don't matter."""

    def __init__(self, settled: datetime.timedelta):
        self.settled = int(settled.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("times", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = dict(zip([x.split()[0] for x in STATE.split(", ")], self.state.get() if self.state.exists() else (None,) * 6, strict=True))
        for b in rows:
            b = b[b["at"].notna()]
            for name, statuses in TIMES.items():
                if len(own := b.loc[b["status"].isin(statuses), "at"]):
                    least = own.min().to_pydatetime()
                    now[name] = least if now[name] is None else min(now[name], least)
            if len(b):
                last = b.sort_values(["at", "status"], na_position="first").iloc[-1]
                if now["at"] is None or (last["at"].to_pydatetime(), last["status"] or "") >= (now["at"], now["status"] or ""):
                    now["status"], now["at"] = last["status"], last["at"].to_pydatetime()
        if now["at"] is not None:
            due = int(now["at"].replace(tzinfo=datetime.UTC).timestamp() * 1000) + self.settled
            if now["due"] != due:
                if now["due"] is not None:
                    self.handle.deleteTimer(now["due"])
                self.handle.registerTimer(due)
            now["due"] = due
            self.state.update(tuple(now.values()))
            yield self.row(key, now, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            now = dict(zip([x.split()[0] for x in STATE.split(", ")], self.state.get(), strict=True))
            self.state.clear()
            yield self.row(key, now, True)

    def row(self, key, now: dict, settled: bool) -> pd.DataFrame:
        return pd.DataFrame({"assignment_id": [key[0]], **{c: [now[c]] for c in TIMES}, "status": [now["status"]], "settled": [settled]})

    def close(self) -> None:
        pass


def assignment_stream(changes: DataFrame, late: str = "30 days", settled: datetime.timedelta = SETTLED) -> DataFrame:
    """Times of the states of each assignment over a stream of changes (assignment_id, status, at), in update mode: a row whenever an assignment changes, the last one with `settled`.

    State is kept by assignment, in RocksDB, and ends by an event-time timer `settled` after its last change, so that it holds what is open, not all that ever was. Changes may come late, repeated and
    in any order: the last row of an assignment is the batch fold (`state.assignment_times`) of all its changes that are no more than `late` behind the newest change of all when they come; Spark drops
    what is later still. `settled` must be longer than `late`, else an assignment could be forgotten while changes of it may come.
    """
    kind = f"assignment_id {changes.schema['assignment_id'].dataType.simpleString()}, started_at timestamp, completed_at timestamp, converted_at timestamp, status string, settled boolean"
    if changes.sparkSession.range(1).select(F.expr(f"interval {late} >= interval '{int(settled.total_seconds())}' second")).first()[0]:
        raise ValueError("settled must be longer than late")
    marked = changes.select("assignment_id", "status", "at").withWatermark("at", late)
    return marked.groupBy("assignment_id").transformWithStateInPandas(AssignmentState(settled), kind, "Update", "EventTime")


def first_seen(stream: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """The single-key form with bounded state: the first row of a key within the delay."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])
