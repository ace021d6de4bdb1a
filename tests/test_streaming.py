"""The key store, the keyword stream, and the state of assignments over a stream, against their batch forms."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from leadloom.operators import state
from leadloom.streaming import ingest
from leadloom.streaming.keystore import KeyStore

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keys_of(spark, names):
    return spark.createDataFrame([(n,) for n in names], "key string")


def test_key_store_reads_touched_buckets(spark, tmp_path):
    store = KeyStore(spark, f"file://{tmp_path}/s", buckets=16, bits=1 << 12)
    assert store.seen(keys_of(spark, ["a"])).count() == 0 and store.keys() is None
    for n in range(3):
        store.add(keys_of(spark, [f"k{i}" for i in range(100 * n, 100 * n + 100)]), str(n))
    ask = lambda names, **more: sorted(r.key for r in store.seen(keys_of(spark, names), **more).collect())
    assert ask(["k5", "k5", "k150", "k299", "k300", "new", ""]) == ["k150", "k299", "k5"]
    assert ask(["k5", "k150"], batch="1") == ["k5"]  # what a batch wrote itself doesn't count
    # One key: the files of its bucket and no others; a new key that no filter has: none.
    read, asked = [], store.keys
    store.keys = lambda buckets=None: read.append(buckets) or asked(buckets)
    ask(["k7"])
    own = asked(read[-1])
    assert len(read[-1]) == 1 and len(own.inputFiles()) == len({f for f in asked().inputFiles() if f"bucket={next(iter(read[-1]))}/" in f}) <= 3
    new = next(f"n{i}" for i in range(1000) if not store._maybe(store.bucketed(keys_of(spark, [f"n{i}"])), store._read("filters", "bucket int, bits binary", set(range(16)))).count())
    ask([new])
    assert read[-1] == set()
    # A batch that is run again replaces what it wrote.
    n = asked().count()
    store.add(keys_of(spark, [f"k{i}" for i in range(100, 200)]), "1")
    assert asked().count() == n
    store.keys = asked
    store.rebuild(asked().select("key"))
    assert asked().count() == n and ask(["k5", "k300"]) == ["k5"]


def test_rerun_of_a_batch_adds_nothing(spark, tmp_path):
    schema, keys, order = "ord long, e string, p string", F.array("e", "p"), F.col("ord")
    r = random.Random(5)
    batches = [spark.createDataFrame([(100 * b + i, f"e{r.randint(0, 25)}", r.choice(["", None, f"p{r.randint(0, 25)}"])) for i in range(15)], schema) for b in range(3)]
    at = f"file://{tmp_path}/rows"
    read = lambda: sorted(map(tuple, spark.read.parquet(at).select("ord", "batch").collect()))
    ingest.ingest_batches(batches, at, keys, order, buckets=8, bits=1 << 12)
    want = read()
    stored = ingest.key_store(spark, at, buckets=8, bits=1 << 12).keys().count()
    for n in (2, 0, 1):  # also after a crash that left keys without rows, or rows without keys
        ingest.write_batch(batches[n], at, keys, order, n, buckets=8, bits=1 << 12)
        if n == 2:
            assert read() == want
    assert {o for o, _ in read()} == {o for o, _ in want} and ingest.key_store(spark, at, buckets=8, bits=1 << 12).keys().count() == stored


def test_keyword_stream_equals_batches(spark, tmp_path):
    rows = [[(10 * b + i, f"9780{r}0000000"[:9] + str(i), f"T{i}", "Jane Doe", "2020", "catalog") for i in range(4)] for b, r in enumerate("121")]
    books = [[(i, f"B0{c[4:]:0>8}", *x) for i, c, *x in part] for part in rows]
    schema, source = "ord long, code string, title string, author_name string, publication_date string, source string", tmp_path / "in"
    source.mkdir()
    for b, part in enumerate(books):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(source / f"b{b}"))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(source))
        ingest.keyword_stream(stream, f"file://{tmp_path}/live", f"file://{tmp_path}/cp", "Kids", None, None).awaitTermination()
        ingest.accept_keyword(spark.createDataFrame(part, schema), f"file://{tmp_path}/batch", "Kids", None, None)
    read = lambda n: sorted(r.code for r in spark.read.parquet(f"{tmp_path}/{n}").collect())
    assert read("live") == read("batch") == sorted({x[1] for part in books for x in part})
    keys = KeyStore(spark, f"file://{tmp_path}/batch-keys/kids/any-any")
    assert ingest.rows_known(keys) == len(read("batch"))


def test_first_seen_within_the_delay(spark, tmp_path):
    rows = [("a", 0), ("b", 1), ("a", 2), ("a", 3)]
    df = spark.createDataFrame([(k, datetime.datetime(2024, 1, 1, 0, m)) for k, m in rows], "k string, at timestamp")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = ingest.first_seen(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "k", "at", "1 hour")
    stream.writeStream.format("memory").queryName("first_seen").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.k for r in spark.table("first_seen").collect()) == ["a", "b"]


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKS)
    yield
    spark.conf.set(key, before)


def test_assignment_stream_equals_the_batch_fold(spark, tmp_path, rocks):
    """Late, repeated and out-of-order changes come to the fold; a settled assignment leaves the state."""
    r = random.Random(8)
    start, statuses = datetime.datetime(2024, 1, 1), ["assigned", "in_progress", "contacted", "completed", "converted", "follow_up"]
    changes = [(i, r.choice(statuses), start + datetime.timedelta(hours=r.randrange(24 * 20))) for i in range(12) for _ in range(r.randrange(1, 7))]
    r.shuffle(changes)
    changes += r.sample(changes, 10)
    old = [(99, "in_progress", start - datetime.timedelta(days=200)), (99, "completed", start - datetime.timedelta(days=190))]
    batches = [old, changes[:20], changes[20:35], changes[35:], [(50, "assigned", start + datetime.timedelta(days=1000))], [(51, "assigned", start + datetime.timedelta(days=1001))]]
    schema, source, got = "assignment_id long, status string, at timestamp", tmp_path / "in", []
    source.mkdir()
    for n, part in enumerate(batches):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(source / f"b{n}"))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(source))
        keep = lambda df, number, n=n: got.append((n, number, df.collect()))
        out = ingest.assignment_stream(stream, late="21 days", settled=datetime.timedelta(days=90))
        out.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    last, settled = {}, set()
    for _, _, rows in sorted(got, key=lambda x: x[:2]):
        for x in rows:
            last[x.assignment_id] = tuple(x)[1:5]
            settled |= {x.assignment_id} if x.settled else set()
    every = spark.createDataFrame([x for b in batches for x in b], schema)
    want = {x.assignment_id: (x.started_at, x.completed_at, x.converted_at, x.status) for x in state.assignment_times(every).collect()}
    assert last == want
    assert settled == {99, *range(12)}
    with pytest.raises(ValueError):
        ingest.assignment_stream(stream, late="91 days", settled=datetime.timedelta(days=90))
