"""Exact groups and SimHash components against brute force, with hot groups and awkward rows."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from leadloom.llm import common, exact_dedup, simhash
from leadloom.llm.components import components

SCHEMA = "doc_id long, text string, kept boolean, _doc int"
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts():
    r = random.Random(4)
    words = ["alpha", "Beta", "gamma", "Éclair", "ß", "x" * 90]
    out = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 3)))) for i in range(300)]
    out += [(1000 + i, "Hot " * 400) for i in range(200)] + [(2000 + i, "hot " * 400 + str(i % 3)) for i in range(60)]
    out += [(3000, "A" * 70000), (3001, "a" * 70000), (3002, "a" * 69999 + "b"), (3003, None), (3004, ""), (5, "alpha"), (5, "alpha"), (None, "only null"), (None, "only null"), (7, "only null")]
    return out


@pytest.mark.parametrize("small", [True, False])
def test_exact_groups(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(exact_dedup, "join_checked", lambda left, right, on, how, wide=(): left.join(right, on, how))
    rows = texts()
    df = spark.createDataFrame([(i, t, True, 1) for i, t in rows], SCHEMA).repartition(3)
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(AZ)].append(i)
    want = []
    for n, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), hashlib.sha256(n.encode()).hexdigest()) for i in ids]
    got = exact_dedup.find_groups(df).collect()
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=key) == sorted(want, key=key)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    assert sum(r.kept for r in got) == len(groups)
    kept = exact_dedup.keep_one(df)
    assert kept.columns == df.columns and kept.count() == len(groups)
    assert exact_dedup.find_groups(df.limit(0)).count() == 0 == exact_dedup.keep_one(df.limit(0)).count()


def brute_fingerprint(text, k):
    w = text.encode().lower().split()
    shingles = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    n = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            n[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * n[b] > len(shingles))


def brute_components(values, radius):
    parent = list(range(len(values)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(values))]


@pytest.mark.parametrize("tile", [8, 512])
@pytest.mark.parametrize("per_key", [1 << 18, 256, 0.0001])
def test_links_lose_nothing(spark, monkeypatch, tile, per_key):
    """Clusters, chains and noise; small tiles split keys, a small per_key takes blocks, and more of them."""
    monkeypatch.setattr(simhash, "PER_KEY", per_key)
    r = random.Random(tile)
    values = [r.getrandbits(64) for _ in range(150)]
    for _ in range(6):
        base = r.getrandbits(64)
        for step in range(25):  # a chain: each three bits from the last
            base ^= sum(1 << b for b in r.sample(range(64), 3))
            values.append(base)
    hub = r.getrandbits(64)
    values += [hub ^ (1 << b) for b in range(60)] + [0, 1, (1 << 64) - 1, (1 << 63)]
    values = sorted(set(values))
    df = spark.createDataFrame([(int(np.uint64(v).astype(np.int64)),) for v in values], "fp long")
    found = {x.node: x.root for x in components(simhash.links(df, 3, tile)).collect()}
    want = brute_components(values, 3)
    signed = [int(np.uint64(v).astype(np.int64)) for v in values]
    classes = defaultdict(set)
    for v, c in zip(signed, want, strict=True):
        classes[c].add(v)
    got = defaultdict(set)
    for v in signed:
        got[found.get(v, v)].add(v)
    assert {frozenset(x) for x in classes.values()} == {frozenset(x) for x in got.values()}


def test_tile_pairs_are_skipped(spark):
    """Pairs of tiles too far apart in population count are not made; at the default settings keys are compared in tiles, and all links are found."""
    r = random.Random(3)
    values = {r.getrandbits(64) for _ in range(3 * simhash.TILE)}
    values |= {v ^ (1 << r.randrange(64)) for v in list(values)[:200]}
    df = spark.createDataFrame([(int(np.uint64(v).astype(np.int64)),) for v in sorted(values)], "fp long")
    rows = df.selectExpr("fp", "0L as key")
    counts = simhash.tiles_of(rows, simhash.TILE)
    sizes = [r["count"] for r in simhash.keyed(df, len(values), 3).groupBy("key").count().collect()]
    assert sum(sizes) == 4 * len(values) and simhash.TINY < min(sizes) and max(sizes) < simhash.TILE
    pairs = simhash.tile_pairs(counts, 3, simhash.TILE).collect()
    n = len(pairs)
    made = {x.pair for p in pairs for x in p.pairs}
    assert n == -(-len(values) // simhash.TILE) and n <= len(made) < n * (n + 1) // 2
    got = {frozenset((x.a, x.b)) for x in simhash.links(df).collect()}
    whole = {frozenset((x.a, x.b)) for x in simhash.compared(rows, 3, simhash.TILE).collect()}
    a = np.array(sorted(values), np.uint64)
    want = [(i + j, j2) for i in range(0, len(a), 500) for j, j2 in np.argwhere(np.bitwise_count(a[i : i + 500, None] ^ a[None]) <= 3) if i + j < j2]
    want = {frozenset((int(a[i].astype(np.int64)), int(a[j].astype(np.int64)))) for i, j in want}
    assert len(want) >= 200 and got <= want and whole <= want
    roots = [{}, {}, {}]
    for edges, parent in ((got, roots[0]), (want, roots[1]), (whole, roots[2])):
        def root(x, parent=parent):
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x
        for x, y in map(tuple, edges):
            parent[max(root(x), root(y))] = min(root(x), root(y))
        for x in list(parent):
            parent[x] = root(x)
    assert roots[0] == roots[1] == roots[2]


@pytest.mark.parametrize("sides", [1, 2])
@pytest.mark.parametrize("dense", [False, True])
def test_near(sides, dense):
    """A spanning forest of all links of a tile pair, or of those between its sides, with few links and with many."""
    r = random.Random(5)
    hub = r.getrandbits(64)
    values = sorted({r.getrandbits(64) for _ in range(300)} | {hub ^ sum(1 << b for b in r.sample(range(64), 2)) for _ in range(400 if dense else 5)})
    fp, side = np.array(values, np.uint64), np.array([r.randrange(sides) for _ in values])
    parts = []
    for pairs in (simhash.near(fp, side, 3), [(int(fp[i].astype(np.int64)), int(fp[j].astype(np.int64))) for i in range(len(fp)) for j in range(i) if (sides == 1 or side[i] != side[j]) and (values[i] ^ values[j]).bit_count() <= 3]):
        group = {int(v): {int(v)} for v in fp.view(np.int64)}
        for a, b in pairs:
            if group[a] is not group[b]:
                group[a] |= group[b]
                for x in group[b]:
                    group[x] = group[a]
        parts.append({frozenset(x) for x in group.values()})
    assert parts[0] == parts[1] and len(simhash.near(fp, side, 3)) == len(fp) - len(parts[0])


def test_simhash_table(spark):
    r = random.Random(9)
    words = [f"w{i}" for i in range(500)]
    base = [r.choice(words) for _ in range(400)]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 30)))) for i in range(80)]
    rows += [(100 + i, " ".join([*base[:200], f"new{i}", *base[200:]])) for i in range(40)] + [(200, "  A b\tC "), (201, "a B c"), (202, "one"), (203, None), (204, ""), (200, "  A b\tC "), (None, "one"), (None, "two words")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fp string")
    prints = [brute_fingerprint(t or "", 3) for _, t in rows]
    roots = brute_components(prints, 3)
    least = {}
    for (i, _), c in zip(rows, roots, strict=True):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    want = sorted((i is None, i or 0, f"{p:016x}", least.get(c) is None, least.get(c) or 0) for (i, _), p, c in zip(rows, prints, roots, strict=True))
    got = simhash.group(df).collect()
    assert sorted((x.doc_id is None, x.doc_id or 0, x.fingerprint, x.component_id is None, x.component_id or 0) for x in got) == want
    assert simhash.group(df.limit(0)).count() == 0
    kept = simhash.keep_one(df, words=3)
    assert kept.columns == df.columns
    ids = [x.doc_id for x in kept.collect()]
    assert set(i for i in ids if i is not None) == set(least.values()) and ids.count(None) == 2


@pytest.mark.parametrize("tile", [4, 1024])
def test_similar_against_jaccard(spark, tile):
    """Near copies of one and more replaced words, chains, a hot group, texts too short for a shingle."""
    r = random.Random(11)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for size in (5, 12, 30, 60, 100, 200, 500, 500):
        for _ in range(6):
            base = [r.choice(words) for _ in range(size)]
            for n in range(6):
                near = list(base)
                for at in r.sample(range(size), min(size, n * size // 100 + (n > 0))):
                    near[at] = r.choice(words)
                rows.append(" ".join(near))
                base = near if n % 2 else base
    passage = " ".join(r.choice(words) for _ in range(60))
    rows += [f"{passage} {' '.join(r.choice(words) for _ in range(60))}" for _ in range(40)]
    rows += [f"hot{i} {passage}" for i in range(60)] + ["one", "ONE", "one two", " ", "", None, "  "]
    rows = [(i if i % 50 else None, t) for i, t in enumerate(rows)]
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and root[i] != root[j]:
                root = [min(root[i], root[j]) if x in (root[i], root[j]) else x for x in root]
    least = {}
    for (i, _), c in zip(rows, root, strict=True):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in simhash.group_similar(df, tile=tile, verify_tile=tile).collect() if x.doc_id is not None}
    assert got == {i: least[c] for (i, _), c in zip(rows, root, strict=True) if i is not None}
    kept = [x.doc_id for x in simhash.keep_one_similar(df).collect()]
    # One document of each component stays: the least id, or one row of a component without ids.
    assert sorted(i for i in kept if i is not None) == sorted(least.values()) and kept.count(None) == len(set(root)) - len(least)
    assert simhash.group_similar(df.limit(0)).count() == 0 == simhash.keep_one_similar(df.limit(0)).count()


def test_small_is_measured(spark):
    df = common.cut(spark.range(10).selectExpr("repeat('x', 1000) as t"), "t")
    assert common.is_small(df, ["t"]) and not common.is_small(df, ["t"], rows=5) and not common.is_small(df, ["t"], size=5000)


def test_texts_that_differ_in_white_space_are_one_candidate(spark, monkeypatch):
    """10,000 texts of one fingerprint are placed once a key, not once a text."""
    seen, real = [], simhash.compared

    def spy(each, radius, tile):
        seen.append(each.groupBy("key").count().agg({"count": "max"}).first()[0])
        return real(each, radius, tile)

    monkeypatch.setattr(simhash, "compared", spy)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(words[:30]) + " " * (1 + i % 100) + "\t" * (i // 100) + " ".join(words[30:])) for i in range(10_000)]
    got = simhash.group_similar(spark.createDataFrame([*rows, (20_000, "another text")], "doc_id long, text string").repartition(8)).collect()
    assert seen == [1] and {x.component_id for x in got} == {0, 20_000} and len(got) == 10_001
