"""Deduplication by one key, by alternative keys, by any key, and merging of ranked lists."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.components import components
from ..functions.lineage import cut, drop_cut, global_rank
from ..functions.text import book_key, col, present, text
from ..functions.urls import url_key


def dedupe_first(df: DataFrame, key: Column, order: list[Column], blank_key_kept: bool = False) -> DataFrame:
    """The first row of each key in the order. Rows with a blank key are all kept if asked, else they are one key."""
    n = F.row_number().over(Window.partitionBy("_key").orderBy(*order))
    ranked = df.withColumn("_key", key).withColumn("_n", n)
    keep = F.col("_n") == 1
    return ranked.where(keep | (F.col("_key") == "") if blank_key_kept else keep).drop("_key", "_n")


def dedupe_books(df: DataFrame, order: list[Column], title: str = "title", author: str = "author_name", asin: str = "asin") -> DataFrame:
    """By identifier if there is one, else by title and author."""
    return dedupe_first(df, book_key(title, author, asin), order)


def dedupe_two_namespaces(df: DataFrame, code: Column, title: Column, order: Column) -> DataFrame:
    """Rows with a code: the first of each code. Rows without: dropped if an earlier kept row has the same title.

    Only kept rows block a title. The first row without a code is blocked by kept coded rows before it; among rows without codes the first unblocked one blocks the rest.
    """
    keyed = df.withColumn("_code", F.upper(text(code))).withColumn("_title", F.lower(F.trim(text(title)))).withColumn("_ord", order)
    coded = keyed.where(present("_code")).withColumn("_n", F.row_number().over(Window.partitionBy("_code").orderBy("_ord"))).where("_n = 1").drop("_n")
    plain = keyed.where(~present("_code")).withColumn("_n", F.row_number().over(Window.partitionBy("_title").orderBy("_ord"))).where("_n = 1").drop("_n")
    first = coded.groupBy("_title").agg(F.min("_ord").alias("_first"))
    free = plain.join(first, "_title", "left").where(F.col("_first").isNull() | (F.col("_first") > F.col("_ord"))).drop("_first")
    return coded.unionByName(free.select(coded.columns)).drop("_code", "_title", "_ord")


#: Rows of a component that one task solves, and rows of a larger one that are decided at once.
SOLVED_ROWS = 200_000


def dedupe_any_key(df: DataFrame, keys: Column, order: Column, most: int = SOLVED_ROWS) -> DataFrame:
    """Greedy in order: a row is dropped if any of its keys (an array; blanks are none) was used by a kept row; only kept rows use keys.

    Rows that share no key, directly or through others, don't touch each other, so each connected component is decided by itself. Components of up to `most` rows are solved whole,
    in order, many in one Arrow pass. What is left of larger ones first meets a parallel round (an undecided row wins if it is the first of each of its keys, and drops those it shares a key with), then
    its first `most` rows, which nothing can touch any more but each other, are solved in the same way; what remains may have fallen into smaller components.
    So the rounds of a component of n rows are n / most at the worst, whatever the length of its chains.
    """
    ranked = global_rank(df.withColumn("_ord", order).withColumn("_keys", F.array_distinct(F.filter(keys, lambda k: k > ""))), [F.col("_ord")], "_rank")
    all_rows = cut(ranked, "any-key")
    won = [all_rows.where(F.size("_keys") == 0).select("_rank")]
    pairs = cut(all_rows.select("_rank", F.explode("_keys").alias("_key")), "any-key-pairs")
    while not pairs.isEmpty():
        wins, pairs = _any_key_pass(pairs, most)
        won += wins
    kept = reduce(DataFrame.unionByName, won)
    return all_rows.join(kept, "_rank", "left_semi").drop("_ord", "_keys", "_rank")


def _any_key_pass(pairs: DataFrame, most: int) -> tuple[list[DataFrame], DataFrame]:
    """(winners, what is undecided) after solving the small components, and a round and a first block of the large ones."""
    first = cut(pairs.groupBy("_key").agg(F.min("_rank").alias("_first")), "any-key-first")
    # Components of keys, each known by its first row: what grows with the rows of a key is no edge. A row belongs to its least key's component, whose least row is a first row.
    of_row = cut(pairs.join(first, "_key").groupBy("_rank").agg(F.min("_first").alias("_least"), F.collect_set("_first").alias("_firsts")), "any-key-rows")
    found = components(of_row.where(F.size("_firsts") > 1).select(F.col("_least").alias("a"), F.explode("_firsts").alias("b")))
    roots = of_row.select("_rank", "_least").join(found.withColumnsRenamed({"node": "_least"}), "_least", "left").select("_rank", F.coalesce("root", "_least").alias("root"))
    rows = cut(pairs.join(roots, "_rank"), "any-key-rooted")
    sizes = cut(rows.groupBy("root").agg(F.countDistinct("_rank").alias("n")).where(F.col("n") > most), "any-key-large")
    if sizes.isEmpty():
        wins = cut(_solved(rows), "any-key-won")
        drop_cut(pairs, first, of_row, found, rows, sizes)
        return [wins], pairs.limit(0)
    wins = [cut(_solved(rows.join(sizes, "root", "left_anti")), "any-key-won")]
    large = rows.join(sizes, "root", "left_semi").select("root", "_rank", "_key")
    firsts = large.join(first, "_key").groupBy("_rank").agg(F.every(F.col("_rank") == F.col("_first")).alias("w")).where("w").select("_rank")
    wins.append(cut(firsts, "any-key-won"))
    rest = cut(_undecided(large, wins[-1]), "any-key-rest")
    blocks = cut(_first_rows(rest, most), "any-key-block")
    wins.append(cut(_solved(blocks), "any-key-won"))
    left = cut(_undecided(rest.join(blocks.select("_rank").distinct(), "_rank", "left_anti"), wins[-1], blocks).select("_rank", "_key"), "any-key-pairs")
    drop_cut(pairs, first, of_row, found, rows, sizes, rest, blocks)
    return wins, left


def _undecided(pairs: DataFrame, wins: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """pairs without the rows of wins and those that share a key with one; `of` has the keys of wins if pairs hasn't."""
    used = (pairs if of is None else of).join(wins, "_rank", "left_semi").select("_key").distinct()
    gone = pairs.join(used, "_key", "left_semi").select("_rank").distinct()
    return pairs.join(gone, "_rank", "left_anti")


def _first_rows(pairs: DataFrame, most: int) -> DataFrame:
    """The pairs of the first `most` rows of each root: by the rank among its rows, which runs by ranges."""
    rows = pairs.select("root", "_rank").distinct()
    placed = global_rank(rows, [F.col("root"), F.col("_rank")], "_n")
    least = placed.groupBy("root").agg(F.min("_n").alias("_least"))
    early = placed.join(least, "root").where(F.col("_n") < F.col("_least") + most).select("_rank")
    return pairs.join(early, "_rank", "left_semi")


def _solved(rows: DataFrame) -> DataFrame:
    """The winners (_rank) of whole components (root, _rank, _key), read in order; a component's used keys are held, and forgotten with the next component."""
    hashed = rows.groupBy("root", "_rank").agg(F.collect_list("_key").alias("keys")).repartition("root").sortWithinPartitions("root", "_rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, used = None, set()
        for batch in batches:
            kept = []
            for root, rank, keys in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if root != now:
                    now, used = root, set()
                if used.isdisjoint(keys):
                    kept.append(rank)
                    used.update(keys)
            yield pa.RecordBatch.from_pydict({"_rank": pa.array(kept, pa.int64())})

    return hashed.select("root", "_rank", "keys").mapInArrow(run, "_rank bigint")


def merge_rerank(results: DataFrame, url: str, order: list[Column], group: list[str], most: int) -> DataFrame:
    """Ranked lists of a group as one: first row of each URL in the order, capped, ranked anew from 1."""
    first = results.withColumn("_url", url_key(url)).withColumn("_n", F.row_number().over(Window.partitionBy(*group, "_url").orderBy(*order))).where("_n = 1")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= most).drop("_url", "_n")


def interleave(df: DataFrame, group: list[str], category: Column, order: Column, value: str, most: int) -> DataFrame:
    """Per group: the first of each category, then the second …; the first `most` picks; then distinct by value, first picks kept."""
    turn = F.row_number().over(Window.partitionBy(*group, "_category").orderBy("_ord"))
    turns = df.withColumn("_category", category).withColumn("_ord", order).withColumn("_turn", turn)
    picks = turns.withColumn("_pick", F.row_number().over(Window.partitionBy(*group).orderBy("_turn", "_category"))).where(F.col("_pick") <= most)
    first = picks.withColumn("_n", F.row_number().over(Window.partitionBy(*group, value).orderBy("_pick"))).where("_n = 1")
    return first.withColumn("pick", F.row_number().over(Window.partitionBy(*group).orderBy("_pick"))).drop("_category", "_ord", "_turn", "_pick", "_n")


def new_only(candidates: DataFrame, prior: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates none of whose (non-blank) keys stands in prior rows."""
    out = candidates
    for k in keys:
        out = out.join(prior.where(present(k)).select(k).distinct(), k, "left_anti") if k in prior.columns else out
    return out.select(candidates.columns)


def first_value_fill(rows: DataFrame, key: list[str], columns: list[str], order: Column) -> DataFrame:
    """Per key, the first non-blank value of each column in the order; blank if there is none."""
    pick = [F.coalesce(F.min_by(F.when(present(c), text(c)), F.when(present(c), order)), F.lit("")).alias(c) for c in columns]
    return rows.groupBy(*key).agg(*pick)


def until_target(df: DataFrame, order: list[Column], hit: Column, target: int) -> DataFrame:
    """Rows in order up to and including the one at which the hits reach the target."""
    from ..functions.lineage import running_sum

    hits = F.when(hit, 1).otherwise(0).cast("bigint")
    summed = running_sum(df, order, hits, "_hits")
    return summed.where(F.col("_hits") - hits < target).drop("_hits")


def source_quota(df: DataFrame, code: Column, web: Column, source_order: Column, order: list[Column], most: int, web_share: float = 0.4) -> DataFrame:
    """At most `most` rows, codes unique: web rows get most - round(share · most) places (all of them below 5), the other sources the rest, in order of trust."""
    unique = dedupe_first(df.withColumn("_source", source_order).withColumn("_web", web), code, [F.col("_web").desc(), F.col("_source"), *order])
    web_places = most - (round(web_share * most) if most >= 5 else 0)
    of_web = cut(unique.where("_web").orderBy(*order).limit(web_places), "quota-web")
    rest = unique.where("not _web").orderBy("_source", *order).limit(most - of_web.count())
    return of_web.unionByName(rest).drop("_source", "_web")


def write_batches(df: DataFrame, order: list[Column], size: int, offset: int = 0) -> DataFrame:
    """df with the number of the batch file of each row, continuing after `offset` earlier rows."""
    return global_rank(df, order, "_n").withColumn("batch", (F.floor((F.col("_n") + offset - 1) / size) + 1).cast("int")).drop("_n")


__all__ = ["col", "dedupe_any_key", "dedupe_books", "dedupe_first", "dedupe_two_namespaces", "first_value_fill", "interleave", "merge_rerank", "new_only", "source_quota", "until_target", "write_batches"]
