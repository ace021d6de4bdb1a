"""A store of keys in buckets: a batch reads the Bloom filters of the buckets that its keys fall into, and the keys of those buckets alone in which a filter has seen one.

Layout: `keys/bucket=B/batch=N` (key) and `filters/bucket=B` (one row of bits). A batch writes its own partitions by dynamic overwrite, so that a batch that is run again replaces what it wrote
before; a filter that has a key too many only makes a bucket be read in vain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import cut, drop_cut

#: Buckets of a store, bits of a bucket's filter, and bits that a key sets in it. A filter has ten bits a key up to about 100,000 keys.
BUCKETS, BITS, HASHES = 256, 1 << 20, 7
FILTER = "bucket int, bits binary"


def places(one: np.ndarray, two: np.ndarray, bits: int) -> np.ndarray:
    """The bits of keys by their two hashes, a row a key."""
    with np.errstate(over="ignore"):
        steps = one.astype(np.uint64)[:, None] + two.astype(np.uint64)[:, None] * np.arange(HASHES, dtype=np.uint64)
    return (steps % np.uint64(bits)).astype(np.int64)


class KeyStore:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, bits: int = BITS):
        self.spark, self.path, self.buckets, self.bits = spark, path.rstrip("/"), buckets, bits

    # ---- folders ----
    def _there(self, kind: str) -> set[int]:
        """The buckets that the store has, by one listing of names."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
        return {int(n[7:]) for n in names if n.startswith("bucket=")}

    def _read(self, kind: str, schema: str, buckets: set[int]) -> DataFrame | None:
        found = sorted(self._there(kind) & buckets)
        if not found:
            return None
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{kind}").parquet(*(f"{self.path}/{kind}/bucket={b}" for b in found))

    def _write(self, df: DataFrame, kind: str, *by: str) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{self.path}/{kind}")

    def bucketed(self, keys: DataFrame) -> DataFrame:
        return keys.select("key").distinct().withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int"))

    def keys(self, buckets: set[int] | None = None) -> DataFrame | None:
        """Rows (key, bucket, batch) of the given buckets: only their files are listed and read."""
        return self._read("keys", "key string, bucket int, batch string", set(range(self.buckets)) if buckets is None else buckets)

    # ---- asking and adding ----
    def seen(self, keys: DataFrame, batch: str | None = None) -> DataFrame:
        """The keys (column key) that the store has from other batches than `batch`."""
        asked = cut(self.bucketed(keys), "asked-keys")
        touched = {r[0] for r in asked.select("bucket").distinct().collect()}  # at most `buckets` numbers
        filters = self._read("filters", FILTER, touched)
        if filters is None:
            return asked.select("key").limit(0)
        maybe = cut(self._maybe(asked, filters), "maybe-keys")
        stored = self.keys({r[0] for r in maybe.select("bucket").distinct().collect()})
        if stored is None:
            return asked.select("key").limit(0)
        stored = stored if batch is None else stored.where(F.col("batch") != batch)
        return maybe.select("key").join(stored.select("key"), "key", "left_semi")

    def _maybe(self, asked: DataFrame, filters: DataFrame) -> DataFrame:
        """The keys whose bits are all set in their bucket's filter: a bucket's keys of the batch and its filter meet in one task."""
        bits = self.bits

        def probe(keys: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
            if not len(own) or not len(keys):
                return keys.iloc[:0][["key", "bucket"]]
            table = np.frombuffer(own["bits"].iloc[0], np.uint8)
            at = places(keys["one"].to_numpy(), keys["two"].to_numpy(), bits)
            return keys[((table[at >> 3] >> (at & 7)) & 1).all(1)][["key", "bucket"]]

        hashed = self._hashed(asked)
        return hashed.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(probe, "key string, bucket int")

    def _hashed(self, asked: DataFrame) -> DataFrame:
        return asked.select("key", "bucket", F.xxhash64("key", F.lit(1)).alias("one"), F.xxhash64("key", F.lit(2)).alias("two"))

    def add(self, keys: DataFrame, batch: str) -> None:
        """Put the keys of a batch into the store, and into the filters of their buckets."""
        rows = cut(self.bucketed(keys), "added-keys")
        touched = {r[0] for r in rows.select("bucket").distinct().collect()}
        if touched:
            self._write(rows.withColumn("batch", F.lit(batch)).repartition("bucket"), "keys", "bucket", "batch")
            self._write(self._filters(rows, self._read("filters", FILTER, touched)), "filters", "bucket")
        drop_cut(rows)

    def _filters(self, rows: DataFrame, old: DataFrame | None) -> DataFrame:
        """The filters of the rows' buckets, joined with the old ones; written before the folder that they come from is replaced."""
        bits = self.bits

        def of_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """Parts of filters: a task's keys of a bucket, read in the order of buckets."""
            now, table = None, None
            for b in batches:
                for bucket, part in b.groupby("bucket", sort=True):
                    if bucket != now:
                        if now is not None:
                            yield pd.DataFrame({"bucket": [now], "bits": [table.tobytes()]})
                        now, table = bucket, np.zeros(bits // 8, np.uint8)
                    at = places(part["one"].to_numpy(), part["two"].to_numpy(), bits).ravel()
                    np.bitwise_or.at(table, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
            if now is not None:
                yield pd.DataFrame({"bucket": [now], "bits": [table.tobytes()]})

        def join(parts: pd.DataFrame) -> pd.DataFrame:
            both = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in parts["bits"]])
            return pd.DataFrame({"bucket": parts["bucket"].iloc[:1], "bits": [both.tobytes()]})

        new = self._hashed(rows).repartition("bucket").sortWithinPartitions("bucket").mapInPandas(of_rows, FILTER)
        return cut((new if old is None else new.unionByName(old)).groupBy("bucket").applyInPandas(join, FILTER), "filters")

    def rebuild(self, keys: DataFrame, batch: str = "all") -> None:
        """Make the store anew from all keys, as after a crash or for rows that were written without it; also puts the files of many batches together."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fresh = KeyStore(self.spark, f"{self.path}.new", self.buckets, self.bits)
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(fresh.path), True)
        fresh.add(keys, batch)
        fs.delete(at, True)
        fs.rename(self.spark._jvm.org.apache.hadoop.fs.Path(fresh.path), at)


def unseen(rows: DataFrame, keys: Column, order: Column, store: KeyStore, batch: str | None = None) -> DataFrame:
    """rows none of whose keys (an array of strings, put into `_keys` without blanks) the store has from other batches."""
    keyed = rows.withColumns({"_keys": F.array_distinct(F.filter(keys, lambda k: k > "")), "_o": order})
    each = keyed.select("_o", F.explode("_keys").alias("key"))
    hit = each.join(store.seen(each, batch), "key", "left_semi").select("_o").distinct()
    return keyed.join(hit, "_o", "left_anti").drop("_o")
