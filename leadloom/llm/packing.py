"""Best-fit packing of tokenised documents into sequences: bounded-space online best-fit.

A document's tokens, with an end id, are cut only where they exceed a sequence. Whole pieces fill a sequence of their own. The others are
dealt, by a hash of document and piece, to tasks of about `per_task` pieces; in each, an online best-fit keeps at most `open_bins` bins
open. The open bins are keyed by free space: a bitset has a bit for every free space that some open bin has, so the tightest bin that
takes a piece is the lowest set bit at or above its length. When one bin too many is open, the fullest (the lowest bit) is closed first.
Only (doc_id, piece, length) is shuffled, never tokens; a task holds its open bins and nothing else.

Words are cut at white space and their ids kept in a bounded cache of two generations (words of the older one that are met again go on), filled by the tokenizer itself: its pre-tokens never span white
space. Texts with the separators U+001C to U+001F, on which the notions of white space differ, go to the tokenizer whole.

Cases: null and empty text is one piece that holds the end id alone; repeated rows are packed row by row (pieces carry no row name, so
rows that repeat a doc_id and a piece number are told apart by their sequence and offset); an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHED_CHARS, cut, map_texts, sql_type

CAPACITY, OPEN_BINS, PER_TASK, END_ID = 2048, 512, 50_000, 0
CACHE_WORDS = 400_000
ODD_SPACE = re.compile("[\x1c-\x1f]")
#: Letters with one lower-case form each, and those forms; normal forms leave them alone, and a run of them is one pre-token.
LETTERS, PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+"), re.compile("[a-zß-öø-ÿ]+")
#: A word that ends in one of these letters, and marks behind it: they never join it, are one pre-token, and no part of a special token.
MARKED = re.compile("(.*[A-Za-zÀ-ÖØ-öø-ÿ])([!-&(-/:;=?@\\[-`{}~]+)", re.DOTALL)


class WordIds(dict):
    """Ids of words as little-endian 32-bit bytes, filled as they are asked for."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        super().__init__()
        self.old: dict[str, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        # The same model for plain words, which need neither the normaliser nor the split.
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        if len(word) > CACHED_CHARS:
            return self.whole(word)
        if len(self) >= CACHE_WORDS:
            self.old = dict(self)
            self.clear()
        if (ids := self.old.get(word)) is not None:
            self[word] = ids
            return ids
        # The tokenizer lower-cases, and parts letters from a mark behind them: such forms share the ids of the plain word.
        if PLAIN.fullmatch(word):
            ids = np.array(self.bare.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        elif (word.isascii() and "<" not in word or LETTERS.fullmatch(word)) and (low := word.lower()) != word:
            ids = self[low]
        elif m := MARKED.fullmatch(word):
            ids = self[m[1]] + self[m[2]]
        else:
            ids = self.whole(word)
        self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if ODD_SPACE.search(text):
            return self.whole(text)
        return b"".join(map(self.__getitem__, text.split()))


@functools.cache
def load(path: str) -> WordIds:
    return WordIds(path)


def cut_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most `capacity` tokens: doc_id, piece, start, length, ids_crc32."""

    def make():
        words = load(tokenizer_path)
        end = np.array([end_id], "<u4").tobytes()

        def work(cols, texts):
            index, piece, start, length, crc = [], [], [], [], []
            for i, t in enumerate(texts):
                ids = words.encode(t) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    index.append(i), piece.append(k), start.append(at // 4), length.append(len(part) // 4), crc.append(zlib.crc32(part))
            return {"doc_id": cols[0].take(pa.array(index, pa.int64())), "piece": piece, "start": start, "length": length, "ids_crc32": crc}

        return work

    return map_texts(docs, [id_col, text_col], f"doc_id {sql_type(docs, id_col)}, piece int, start bigint, length bigint, ids_crc32 bigint", make)


class OpenBins:
    """At most `most` open bins, keyed by free space."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most, self.count, self.bits = capacity, most, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.next_bin = 0

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) of a piece."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            at = self.by_free[free].pop()
            if not self.by_free[free]:
                self.bits ^= 1 << free
        else:
            free, at = self.capacity, self.next_bin
            self.next_bin += 1
            self.count += 1
        left = free - length
        if left:
            self.by_free[left].append(at)
            self.bits |= 1 << left
            if self.count > self.most:
                self.close((self.bits & -self.bits).bit_length() - 1)
        else:
            self.count -= 1
        return at, self.capacity - free

    def close(self, free: int) -> None:
        self.by_free[free].pop(0)
        if not self.by_free[free]:
            self.bits ^= 1 << free
        self.count -= 1


def pack(pieces: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, per_task: int = PER_TASK) -> DataFrame:
    """pieces (doc_id, piece, start, length, ids_crc32) with sequence_id and offset."""
    pieces = cut(pieces, "pieces")
    fields = ["doc_id", "piece", "start", "length", "ids_crc32"]
    whole = pieces.where(F.col("length") >= capacity).select(*fields, (F.monotonically_increasing_id() * 2 + 1).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    rest = pieces.where(F.col("length") < capacity)
    tasks = max(1, -(-rest.count() // per_task))
    order = F.xxhash64("doc_id", "piece", "ids_crc32")
    dealt = rest.repartition(tasks, order).sortWithinPartitions(order, "doc_id", "piece", "start", "length")
    kind = whole.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bins, first = OpenBins(capacity, open_bins), TaskContext.get().partitionId() << 40
        for b in batches:
            placed = [bins.place(x) for x in b.column(3).to_pylist()]
            ids, offsets = pa.array([2 * (first + x) for x, _ in placed], pa.int64()), pa.array([x for _, x in placed], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, ids, offsets], names=[*fields, "sequence_id", "offset"])

    return whole.unionByName(dealt.select(*fields).mapInArrow(run, kind))


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, per_task: int = PER_TASK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece of docs: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(cut_pieces(docs, tokenizer_path, capacity, id_col=id_col, text_col=text_col), capacity, open_bins, per_task)
