"""SimHash near-duplicates by tiled exact comparison.

A fingerprint has a bit for each of 64 positions, set if more than half of the document's word shingles (repeats included) have it set in
their 64-bit hash. Distinct fingerprints, in the order of their population counts, are cut into tiles. Tiles are compared with exclusive-or and
bit counts; tile pairs whose population counts differ beyond the radius are never made, and within a pair only fingerprints whose
population counts are within the radius are compared. Out of a tile pair come the links of a spanning forest, not all pairs.

Comparing all tiles is quadratic, so beyond PER_KEY distinct fingerprints tiles are formed among those that agree in a key: of `blocks` blocks of
bits, `blocks` - radius at least are equal in any two fingerprints within the radius, and a key is a hash of one such choice of equal blocks, of so
many values that a key gathers PER_KEY fingerprints at most on average. No link is lost, and a fingerprint has the same few keys at every size
(four with up to 2 ** 27 of them). A key that gathers more than a tile is cut; its tile pairs, not the key, are dealt to tasks.

Cases: null and empty text have fingerprint zero, which links like any other; a document of fewer words than a shingle has its whole
word sequence as one shingle; repeated rows and copies share a fingerprint and are one node; a null doc_id is never the smallest, and a component
of null ids alone has a null component_id; an empty table gives an empty table; columns of any other name are left alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations, repeat
from math import ceil, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, drop_cut, fresh, join_checked, map_texts, small_batches, sql_type
from .components import components

RADIUS, TILE, SEED = 3, 4096, 42
#: Fingerprints that a key should gather on average at most; the number of blocks is chosen for it.
PER_KEY = 1 << 11
#: The pipeline's stage: least Jaccard similarity of shingle sets (4 / 5), the radius within which nearly all such pairs are, and the keys:
#: BANDS keys of ROWS least hashes each; a pair of similarity 0.8 agrees in none of them with a probability of (1 - 0.8 ** 3) ** 14 = 4e-5.
SIMILAR, WIDE, BANDS, ROWS = (4, 5), 20, 14, 3
#: Groups of up to so many fingerprints are compared together, one shift of the rows at a time; of others, so many rows at once.
TINY, RUN = 16, 128

_STATE = np.random.RandomState(SEED)
#: Odd multipliers that make the hash functions of the bands out of one hash.
MULTIPLIERS = _STATE.randint(0, 1 << 62, BANDS * ROWS, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
MASKS = _STATE.randint(0, 1 << 62, BANDS * ROWS, np.int64).astype(np.uint64)


def shingle_hashes(text: str, words: int) -> np.ndarray:
    tokens = text.encode().lower().split()
    if len(tokens) < words:
        shingles = [b" ".join(tokens)] if tokens else []
    else:
        shingles = list(map(b" ".join, zip(*(tokens[i:] for i in range(words)), strict=False)))
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), "<u8", len(shingles))


def fingerprint(text: str, words: int = 3) -> int:
    return fingerprint_of(shingle_hashes(text, words))


def fingerprint_of(hashes: np.ndarray) -> int:
    n = len(hashes)
    if not n:
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 14):
        counts += np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id and fp, the fingerprint as a signed 64-bit integer."""

    def make():
        def work(cols, texts):
            return {"doc_id": cols[0], "fp": np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64)}

        return work

    return map_texts(docs, [id_col, text_col], f"doc_id {sql_type(docs, id_col)}, fp bigint", make)


def block_count(n: int, radius: int) -> int:
    """The least number of blocks with which a choice of equal blocks can part n fingerprints into PER_KEY at most; 0: all of them have one key."""
    if n <= PER_KEY:
        return 0
    blocks = radius + 1
    while blocks < radius + 6 and n / 2 ** (64 * (blocks - radius) / blocks) > PER_KEY:
        blocks += 1
    return blocks


def keyed(distinct: DataFrame, n: int, radius: int) -> DataFrame:
    """A row for each of n fingerprints and choice of equal blocks: key (a hash of the choice and its bits, of n / PER_KEY values) and fp."""
    blocks = block_count(n, radius)
    if not blocks:
        return distinct.select("fp", F.lit(0).cast("bigint").alias("key"))
    values = 1 << max(0, ceil(log2(n / PER_KEY)))
    edge = [64 * i // blocks for i in range(blocks + 1)]
    masks = []
    for choice in combinations(range(blocks), blocks - radius):
        mask = sum(((1 << edge[i + 1]) - 1) ^ ((1 << edge[i]) - 1) for i in choice)
        masks.append(mask - (1 << 64) if mask >= 1 << 63 else mask)
    keys = F.array(*(F.xxhash64(F.lit(i), F.pmod(F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))), F.lit(values))) for i, m in enumerate(masks)))
    return distinct.select("fp", F.explode(keys).alias("key"))


def spanning(n: int, near_to: Callable[[int, np.ndarray], np.ndarray]) -> Iterator[tuple[int, int]]:
    """A spanning forest over positions 0 to n - 1; near_to(i, left) says which of the positions left (ascending) are linked to i."""
    left = np.arange(n)
    while len(left):
        todo, left = [int(left[0])], left[1:]
        while todo and len(left):
            i = todo.pop()
            hit = near_to(i, left)
            if hit.any():
                new, left = left[hit].tolist(), left[~hit]
                todo += new
                yield from ((i, j) for j in new)


def near(fp: np.ndarray, side: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the fingerprints within the radius, between side 0 and side 1, or within one side where there is one alone.

    Only those of near population counts are compared, a run of rows at a time; where links are many, row by row until all are reached.
    """
    bits = np.bitwise_count(fp).astype(np.int64)
    order = np.lexsort((bits, side))
    own, bits, half = fp[order], bits[order], int(np.count_nonzero(side == 0))
    sides = [(0, half), (half, len(own))]
    one = half in (0, len(own))
    signed = own.view(np.int64).tolist()
    # where a population count begins, from -radius on, of either side
    edges = [x + np.searchsorted(bits[x:y], np.arange(-radius, 66 + radius)) for x, y in ([(0, len(own))] if one else sides)]

    def window(first: int, last: int) -> tuple[int, int]:
        """The rows that rows first to last, of one side, are compared with."""
        edge = edges[0] if one or first >= half else edges[1]
        return int(edge[bits[first]]), int(edge[bits[last] + 2 * radius + 1])

    rows, cols, count = [], [], 0
    for first in range(0, len(own) if one else half, RUN):
        last = min(first + RUN, len(own) if one else half)
        a, b = window(first, last - 1)
        a = max(a, first) if one else a
        i, j = np.nonzero(np.bitwise_count(own[first:last, None] ^ own[None, a:b]) <= radius)
        i, j = i + first, j + a
        keep = i < j
        rows.append(i[keep]), cols.append(j[keep])
        count += len(rows[-1])
        if count > 8 * len(own):
            break
    else:
        return [(signed[i], signed[j]) for i, j in forest(len(own), np.concatenate(rows), np.concatenate(cols))] if rows else []

    def near_to(i: int, left: np.ndarray) -> np.ndarray:
        a, b = np.searchsorted(left, window(i, i))
        hit = np.zeros(len(left), bool)
        hit[a:b] = np.bitwise_count(own[left[a:b]] ^ own[i]) <= radius
        return hit

    return [(signed[i], signed[j]) for i, j in spanning(len(own), near_to)]


def forest(n: int, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[int, int]]:
    """Of the links (i, j) between 0 and n - 1, those of a spanning forest."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        a, b = root(x), root(y)
        if a != b:
            parent[max(a, b)] = min(a, b)
            yield x, y


def compare(key: np.ndarray, fp: np.ndarray, side: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links within groups of equal keys (sorted), of spanning forests where a group is not tiny."""
    begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.append(begin, len(key)))
    unsigned, out = fp.view(np.uint64), []
    bits = np.bitwise_count(unsigned).astype(np.int64)
    where = np.repeat(begin + size, size)  # the end of each row's group
    rows, shift = np.flatnonzero(np.repeat((size <= TINY) & (size > 1), size)), 1
    while len(rows := rows[rows + shift < where[rows]]):
        some = rows[np.abs(bits[rows] - bits[rows + shift]) <= radius]
        hit = some[np.bitwise_count(unsigned[some] ^ unsigned[some + shift]) <= radius]
        out.extend(zip(fp[hit].tolist(), fp[hit + shift].tolist(), strict=True))
        shift += 1
    for b, s in zip(begin[size > TINY].tolist(), size[size > TINY].tolist(), strict=True):
        out.extend(near(unsigned[b : b + s], side[b : b + s], radius))
    return out


def links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """distinct (fp): links (a, b) whose components are those of all pairs within the radius."""
    return compared(cut(keyed(distinct, distinct.count(), radius), "simhash-keys"), radius, tile)


def tiles_of(rows: DataFrame, tile: int) -> DataFrame:
    """(key, bits, before, n): of the keys with more rows (fp, key) than a tile, the rows of each population count and those of lesser ones."""
    large = cut(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > tile).select("key"), "simhash-large")
    counts = join_checked(rows, large, ["key"], "left_semi").groupBy("key", F.bit_count("fp").alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    lesser = Window.partitionBy("key").orderBy("bits").rowsBetween(Window.unboundedPreceding, -1)  # 65 rows a key at most
    return cut(counts.select("key", "bits", F.coalesce(F.sum("n").over(lesser), F.lit(0)).alias("before"), "n"), "simhash-tiles")


def tile_pairs(counts: DataFrame, radius: int, tile: int) -> DataFrame:
    """(key, tile, pairs): the tile pairs that a tile's rows go to, and their side there; pairs whose population counts are all farther apart than the radius are left out."""
    ranges = counts.select("key", "bits", F.explode(F.sequence(F.floor(F.col("before") / tile), F.floor((F.col("before") + F.col("n") - 1) / tile))).alias("tile"))
    ranges = cut(ranges.groupBy("key", "tile").agg(F.min("bits").alias("lo"), F.max("bits").alias("hi")), "simhash-ranges")
    # A tile meets those of the population counts that its own, widened by the radius, hold.
    reach = ranges.select("key", F.col("tile").alias("t"), F.explode(F.sequence(F.greatest(F.col("lo") - radius, F.lit(0)), F.least(F.col("hi") + radius, F.lit(64)))).alias("bits"))
    held = ranges.select("key", F.col("tile").alias("u"), F.explode(F.sequence("lo", "hi")).alias("bits"))
    pairs = reach.join(held, ["key", "bits"]).select("key", F.col("t").alias("tile"), F.struct(F.xxhash64("key", F.least("t", "u"), F.greatest("t", "u")).alias("pair"), (F.col("t") > F.col("u")).cast("int").alias("side")).alias("pair"))
    return pairs.groupBy("key", "tile").agg(F.collect_set("pair").alias("pairs"))


def compared(rows: DataFrame, radius: int, tile: int) -> DataFrame:
    """rows (fp, key): the distinct links within keys, by tile pairs where a key has more rows than a tile."""
    counts = tiles_of(rows, tile)
    if counts.isEmpty():
        return found_links(rows.select("fp", "key", F.lit(0).alias("side")), radius)
    row = rows.select("fp", "key", F.bit_count("fp").alias("bits"))
    sized = join_checked(row, counts, ["key", "bits"], "left")  # of a large key every population count is there
    place = F.col("before") + F.pmod(F.xxhash64("fp", "key"), F.col("n"))
    sized = sized.select("fp", "key", F.floor(place / tile).alias("tile"))
    pairs = cut(tile_pairs(counts, radius, tile), "simhash-pairs")
    large = join_checked(sized.where("tile is not null"), pairs, ["key", "tile"], "inner").select("fp", F.explode("pairs").alias("x")).select("fp", F.col("x.pair").alias("key"), F.col("x.side").alias("side"))
    return found_links(sized.where("tile is null").select("fp", "key", F.lit(0).alias("side")).unionByName(large), radius)


def found_links(rows: DataFrame, radius: int) -> DataFrame:
    """rows (fp, key, side): the distinct links (a, b) within keys; a task holds the rows of one key and of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            new = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            key = held[0]
            if len(key) and key[0] != key[-1]:  # the last key may go on
                ends = int(np.searchsorted(key, key[-1]))
                yield batch(compare(*(x[:ends] for x in held), radius))
                held = [x[ends:] for x in held]
        if held is not None and len(held[0]):
            yield batch(compare(*held, radius))

    def batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
        a, b = (pa.array([x[k] for x in found], pa.int64()) for k in (0, 1))
        return pa.RecordBatch.from_arrays([a, b], names=["a", "b"])

    return rows.select("key", "fp", "side").repartition("key").sortWithinPartitions("key").mapInArrow(run, "a bigint, b bigint").distinct()


def group(docs: DataFrame, words: int = 3, radius: int = RADIUS, tile: int = TILE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable)."""
    prints = cut(fingerprints(docs, words, id_col, text_col), "simhash")
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = components(links(distinct.select("fp"), radius, tile)).withColumnRenamed("node", "fp")
    ids = cut(join_checked(distinct, roots, ["fp"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least"), "simhash-roots")
    least = cut(ids.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-least")
    named = cut(join_checked(ids.select("fp", "root"), least, ["root"], "inner").select("fp", "component_id"), "simhash-named")
    drop_cut(distinct, ids, least)
    text = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return join_checked(prints, named, ["fp"], "inner").select("doc_id", text.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words: int = 5, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the document of the smallest doc_id of each component (all columns).

    Rows without an id are kept, since they can't be named; rows that repeat a kept doc_id are kept.
    """
    return without_others(docs, group(docs, words, radius, id_col=id_col, text_col=text_col), id_col)


def without_others(docs: DataFrame, found: DataFrame, id_col: str) -> DataFrame:
    name = fresh(docs, "_gone")
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct()
    kept = found.where("doc_id = component_id").select(F.col("doc_id").alias(name)).distinct()
    gone = cut(gone.join(kept, name, "left_anti"), "simhash-dropped")
    return join_checked(docs.withColumn(name, F.col(f"`{id_col}`")), gone, [name], "left_anti").drop(name)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """The keys of a shingle set: BANDS hashes of ROWS least hashes; of a set without shingles one."""
    own = np.unique(hashes)
    if not len(own):
        return np.zeros(1, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), 1 << 12):
        part = own[at : at + (1 << 12)]
        for k in range(BANDS * ROWS):
            least[k] = min(least[k], ((part ^ MASKS[k]) * MULTIPLIERS[k]).min())
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), i) for i, x in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def similar_links(sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """A spanning forest of the pairs of shingle sets whose Jaccard similarity is SIMILAR or more."""
    (a, b), n = SIMILAR, np.array([len(x) for x in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    edge = np.concatenate(([0], np.cumsum(n)))
    mark = np.zeros(len(ids) + 1, bool)

    def near_to(i: int, left: np.ndarray) -> np.ndarray:
        own, hit = ids[edge[i] : edge[i + 1]], np.minimum(n[left], n[i]) * b >= np.maximum(n[left], n[i]) * a
        mark[own] = True
        for k in np.flatnonzero(hit).tolist():
            j = left[k]
            both = np.count_nonzero(mark[ids[edge[j] : edge[j + 1]]])
            hit[k] = both * b >= (n[i] + n[j] - both) * a
        mark[own] = False
        return hit

    return spanning(len(sets), near_to)


def verified(members: DataFrame, words: int) -> DataFrame:
    """members (key, node, text): links (a, b) of nodes of one key whose shingle sets are similar, as spanning forests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, nodes, sets = None, [], []

        def batch() -> pa.RecordBatch:
            found = list(similar_links(sets)) if len(sets) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([nodes[x[k]] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for b in batches:
            for key, node, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if key != at:
                    yield batch()
                    at, nodes, sets = key, [], []
                nodes.append(node)
                sets.append(np.unique(shingle_hashes(text.as_py(), words)))
        yield batch()
        pa.default_memory_pool().release_unused()

    small_batches(members.sparkSession)
    return members.select("key", "node", "text").mapInArrow(run, "a bigint, b bigint")


def starred(members: DataFrame, words: int) -> DataFrame:
    """members (key, node, text, pivot, pivot_text): key, node, pivot, linked: whether the node's shingle set is similar to the pivot's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}
        (x, y) = SIMILAR
        for b in batches:
            linked = []
            for node, text, pivot, pivot_text in zip(b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), b.column(4), strict=True):
                if pivot not in sets:
                    if len(sets) >= 64:
                        sets.clear()
                    sets[pivot] = np.unique(shingle_hashes(pivot_text.as_py(), words))
                own = np.unique(shingle_hashes(text.as_py(), words))
                both = len(np.intersect1d(own, sets[pivot], assume_unique=True))
                linked.append(node == pivot or both * y >= (len(own) + len(sets[pivot]) - both) * x)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(linked, pa.bool_())], names=["key", "node", "pivot", "linked"])

    small_batches(members.sparkSession)
    return members.select("key", "node", "text", "pivot", "pivot_text").mapInArrow(run, "key bigint, node bigint, pivot bigint, linked boolean")


def to_pairs(star: DataFrame, tile: int) -> DataFrame:
    """star (key, node, linked): node, key of the tile pairs in which the nodes that are not linked to the pivot meet all others of their key."""
    size = lambda c: F.ceil(F.sum(c.cast("int")) / tile).cast("int")
    tiles = cut(star.groupBy("key").agg(size(~F.col("linked")).alias("loose"), size(F.col("linked")).alias("tied")).where("loose > 0"), "similar-tiles")
    placed = join_checked(star.select("key", "node", "linked"), tiles, ["key"], "inner")
    placed = placed.withColumn("t", F.pmod(F.xxhash64("node", "key"), F.when(F.col("linked"), F.col("tied")).otherwise(F.col("loose"))).cast("int"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    mixed = lambda loose, tied: F.xxhash64("key", F.lit("tied"), loose, tied)
    of_tied = F.transform(upto("loose"), lambda u: mixed(u, F.col("t")))
    of_loose = F.concat(F.transform(upto("loose"), lambda u: F.xxhash64("key", F.lit("loose"), F.least("t", u), F.greatest("t", u))), F.transform(upto("tied"), lambda u: mixed(F.col("t"), u)))
    return placed.select("node", F.explode(F.when(F.col("linked"), of_tied).otherwise(of_loose)).alias("key"))


def group_nodes(rows: DataFrame, words: int = 5, radius: int = WIDE, tile: int = TILE, verify_tile: int = 512) -> DataFrame:
    """rows (node, doc_id, text; a written table, a node a row): node, doc_id, component_id: the smallest doc_id reachable over pairs of texts of
    shingle similarity SIMILAR or more, and least_node, the least node that has it.

    Candidates have a key of their least hashes in common and fingerprints within a wide radius, compared in tiles as above. Their components
    hold those looked for; inside each, shingle sets themselves are compared. Where a component has more texts than verify_tile, all are first
    compared with one of them, the pivot; only those that are not similar to it then meet all others, in tile pairs.
    """

    def make():
        def work(cols, texts):
            hashes = [shingle_hashes(t, words) for t in texts]
            return {"node": cols[0], "fp": np.array([fingerprint_of(h) for h in hashes], np.uint64).view(np.int64), "keys": pa.array([band_keys(h) for h in hashes], pa.list_(pa.int64()))}

        return work

    prints = cut(map_texts(rows, ["node", "text"], "node bigint, fp bigint, keys array<bigint>", make), "similar")
    each = prints.select("fp", F.explode("keys").alias("key")).distinct()  # texts of one fingerprint are one candidate
    roots = components(compared(each, radius, tile)).withColumnRenamed("node", "fp")
    own = cut(join_checked(prints.select("node", "fp"), roots, ["fp"], "left").select("node", F.coalesce("root", "fp").alias("key")), "similar-own")
    drop_cut(prints)
    sizes = cut(own.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("pivot")).where("n > 1"), "similar-sizes")
    placed = join_checked(own, sizes, ["key"], "inner")
    texts = rows.select("node", F.coalesce("text", F.lit("")).alias("text"))
    large, meets, stars = cut(placed.where(F.col("n") > verify_tile).select("key", "node", "pivot"), "similar-large"), placed.where(F.col("n") <= verify_tile).select("node", "key"), []
    if not large.isEmpty():
        of_pivots = join_checked(texts, cut(large.select(F.col("pivot").alias("node")).distinct(), "similar-pivots"), ["node"], "left_semi")
        of_pivots = cut(of_pivots.select(F.col("node").alias("pivot"), F.col("text").alias("pivot_text")), "similar-pivot-texts")
        star = cut(starred(join_checked(join_checked(texts, large, ["node"], "inner"), of_pivots, ["pivot"], "inner", ["pivot_text"]), words), "similar-stars")
        stars = [star.where("linked and node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b"))]
        meets = meets.unionByName(to_pairs(star, verify_tile))
    meets = cut(meets, "similar-placed")
    drop_cut(own, sizes)
    members = join_checked(texts, meets, ["node"], "inner").select("key", "node", "text")
    found = cut(reduce(DataFrame.unionByName, stars, verified(members.repartition("key").sortWithinPartitions("key"), words)), "similar-links")
    joined = components(found)
    named = cut(join_checked(rows.select("node", "doc_id"), joined, ["node"], "left").select("node", "doc_id", F.coalesce("root", "node").alias("root")), "similar-named")
    drop_cut(meets, found)
    best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "node"))  # a null doc_id is never the smallest
    least = cut(named.groupBy("root").agg(best.alias("best")).select("root", F.col("best.doc_id").alias("component_id"), F.col("best.node").alias("least_node")), "similar-least")
    return join_checked(named, least, ["root"], "inner").select("node", "doc_id", "component_id", "least_node")


def numbered(docs: DataFrame, node: str, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """docs with a number in column `node`, written once, and of it node, doc_id and text."""
    rows = cut(docs.withColumn(node, F.monotonically_increasing_id()), "similar-rows")
    return rows, rows.select(F.col(node).alias("node"), F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))


def group_similar(docs: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text", **tiles: int) -> DataFrame:
    """Per row of docs: doc_id, component_id: the smallest doc_id reachable over pairs of texts of shingle similarity SIMILAR or more."""
    _, nodes = numbered(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), "_node", "doc_id", "text")
    return group_nodes(nodes, words, **tiles).select("doc_id", "component_id")


def keep_one_similar(docs: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text", **tiles: int) -> DataFrame:
    """docs with one document, that of the smallest doc_id, of each component of texts of shingle similarity SIMILAR or more (all columns).

    Rows are told apart by a number that is written once; rows without an id, and rows that repeat an id, are documents like others.
    """
    node = fresh(docs, "_node")
    rows, nodes = numbered(docs, node, id_col, text_col)
    gone = cut(group_nodes(nodes, words, **tiles).where("node <> least_node").select(F.col("node").alias(node)), "similar-gone")
    return join_checked(rows, gone, [node], "left_anti").drop(node)
