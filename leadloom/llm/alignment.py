"""Cross-tokenizer alignment: which tokens of two tokenizers cover common bytes of a text, and how often they do in the corpus.

Both tokenizers cut the same bytes, so the ends of A's and of B's tokens are two rising sequences, and what they share is found by merging them. The merge
is divided by merge-path: the crossing of every PIECE-th diagonal with the path of the merge is found by binary search, for all diagonals at once;
between two crossings lies a piece with the same number of ends, which is merged without regard to the others. An end of A belongs to the first token of B that ends
there or later, an end of B that is no end of A to the first such token of A: these pairs are the links. A piece knows only its own ends; a token that reaches beyond it is the
first of the next, and whether its first end of B closes a group with the last end of A before it is looked up when pieces are stitched. Ends that both
have close the groups; the groups of a piece are numbered on from those of the pieces before it.

Texts are aligned in blocks of about BLOCK characters. A block's distinct pairs of ids, with their numbers of links, are what is shuffled: they are added up
over the corpus, and the sums come back to the block, whose documents hold indexes into its pairs. A block row is bounded by BLOCK, or by its one text. Within a
block, texts are encoded, merged and digested by slices of about SLICE characters, of which only counts, digests and pairs stay; tokens of a whole block are never held.

A is encoded by cached pair merging over the pre-tokens of `byte_bpe`; B by its library, word by word through a cache, which is exact where no piece joins
two words (`token_counts.load` refuses other vocabularies). A cache holds CACHE_WORDS words at most, in two generations: the older one goes, what is still asked for stays.
Words of more than CACHED_CHARS characters are not cached, so that a cache is bounded in bytes.

Cases: a text that is null, empty, or not given back byte by byte by both tokenizers (one that holds U+2581) has no tokens: zeros and an empty column; null and repeated ids are
rows of their own; an empty table gives an empty table; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import token_counts
from .byte_bpe import ByteBpe
from .common import CACHED_CHARS, cut, drop_cut, join_checked, slices, small_batches, sql_type

#: Ends that a piece of the merge has, characters of a block, and characters that are aligned at one time.
PIECE, BLOCK, SLICE = 1 << 14, 1 << 21, 1 << 17
#: Characters that a document counts in a block beside its text, for its own counts and digest: many empty texts don't make a row without bounds.
DOCUMENT = 64
CACHE_WORDS = 400_000
SPACE = token_counts.SPACE


# ---- the two tokenizers --------------------------------------------------------------------------------------------------------------------------


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others in order from U+0100."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Remembered:
    """Ids of words as 32-bit bytes for a dict that asks here for what it lacks: of late words it holds half of CACHE_WORDS, `older` as many of those before."""

    older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.found(word)
        if len(word) <= CACHED_CHARS:
            if len(self) >= CACHE_WORDS // 2:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids


class BytePieces(Remembered, ByteBpe):
    """A's ids."""

    def found(self, token: str) -> bytes:
        return array("i", self.merge(token.encode())).tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(b"".join(map(self.__getitem__, tokens)), np.int32) for tokens in self.split(texts)]


@functools.cache
def load_a(path: str) -> BytePieces:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, to_byte = spec["model"], byte_alphabet()
    special = {x["content"] for x in spec["added_tokens"]}
    ranks = {bytes(map(to_byte.__getitem__, piece)): i for piece, i in model["vocab"].items() if piece not in special}
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    places = [model["vocab"][m] for m in merged]
    if places != sorted(places) or spec.get("normalizer") or len(merged) + 256 != len(ranks):
        raise ValueError("only byte-level vocabularies without normalisation, with ids in the order of their merges, are read")
    return BytePieces(ranks)


class WordPieces(Remembered, dict):
    """B's ids by words, keyed without their leading space mark."""

    def __init__(self, path: str):
        import sentencepiece

        super().__init__()
        token_counts.load(path)  # refuses a vocabulary that joins words
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self._bytes(i) for i in range(self.library.get_piece_size())]
        self.size = np.array([len(p) for p in pieces], np.int64)
        self.offset = np.concatenate(([0], np.cumsum(self.size)[:-1]))
        self.flat = np.frombuffer(b"".join(pieces), np.uint8)

    decode = ByteBpe.decode

    def _bytes(self, i: int) -> bytes:
        piece = self.library.id_to_piece(i)
        if self.library.is_byte(i):
            return bytes([int(piece[3:5], 16)])
        return piece.replace(SPACE, " ").encode()

    def found(self, word: str) -> bytes:
        ids = self.library.encode(word, num_threads=1) if word else [self.library.piece_to_id(SPACE)]  # no word: a space that ends a text
        return array("i", ids).tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for text in texts:
            words = text.split(" ") if text else []
            if "" in words:  # runs of spaces stay with the word behind them
                words = [run[1:] for run in re.findall(" +[^ ]*", " " + text)]
            out.append(np.frombuffer(b"".join(map(self.__getitem__, words)), np.int32))
        return out


@functools.cache
def load_b(path: str) -> WordPieces:
    return WordPieces(path)


# ---- merging -------------------------------------------------------------------------------------------------------------------------------------


def diagonals(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> np.ndarray:
    """How many ends of A lie before the merge's crossing with every piece-th diagonal, first and last included; of equal ends A's comes first."""
    total = len(a) + len(b)
    d = np.append(np.arange(0, total, piece), total)
    lo, hi = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        i, j = np.minimum(mid, len(a) - 1), np.clip(d - mid - 1, 0, max(len(b) - 1, 0))
        later = open_ & (a[i] <= b[j])
        lo, hi = np.where(later, mid + 1, lo), np.where(open_ & ~later, mid, hi)
    return lo


def align(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of two rising sequences of ends with a common last: the indexes of A and of B, and the ends of B that close a group."""
    if not len(a):
        return (np.zeros(0, np.int64),) * 3
    at = diagonals(a, b, piece)
    d = np.append(np.arange(0, len(a) + len(b), piece), len(a) + len(b))
    left, right, closed = [], [], []
    for i0, i1, j0, j1 in zip(at[:-1], at[1:], (d - at)[:-1], (d - at)[1:], strict=True):
        own_a, own_b = a[i0:i1], b[j0:j1]
        left.append(np.arange(i0, i1))
        right.append(j0 + np.searchsorted(own_b, own_a))
        before = np.searchsorted(own_a, own_b)
        # An end of B closes a group if A has it too: in this piece, or, for the first, as the last end before the piece.
        same = np.zeros(len(own_b), bool)
        if len(own_a):
            same = own_a[np.minimum(before, len(own_a) - 1)] == own_b
        if len(own_b) and i0:
            same[0] |= a[i0 - 1] == own_b[0]
        left.append(i0 + before[~same])
        right.append(j0 + np.flatnonzero(~same))
        closed.append(j0 + np.flatnonzero(same))
    return np.concatenate(left), np.concatenate(right), np.concatenate(closed)


def same_bytes(ids: np.ndarray, vocabulary: ByteBpe | WordPieces, whole: bytes) -> bool:
    return int(vocabulary.size[ids].sum()) == len(whole) and vocabulary.decode(ids) == whole


class Aligner:
    """Aligns blocks of texts."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = load_a(a_path), load_b(b_path)
        self.b_bits = int(len(self.b.size)).bit_length()
        self.bits = self.b_bits + int(len(self.a.size)).bit_length()
        if self.bits > 40:
            raise ValueError("vocabularies of more than 2 ** 40 pairs are not aligned")
        text = lambda n, sep: [f"{i}{sep}" for i in range(n)]
        n = max(len(self.a.size), len(self.b.size))
        self.stride = n
        self.decimal = text(n, ",") + text(n, "|") + text(n, ";")

    def ids(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of both tokenizers, none where one of them doesn't give the text back."""
        none = np.zeros(0, np.int32)
        a, b = self.a.encode([" " + t for t in texts]), self.b.encode(texts)
        for k, t in enumerate(texts):
            whole = b" " + t.encode("utf-8", "surrogatepass")
            if not t or not (same_bytes(a[k], self.a, whole) and same_bytes(b[k], self.b, whole)):
                a[k] = b[k] = none
        return a, b

    def block(self, texts: list[str]) -> dict:
        """Counts and group digests by document; links as pairs (key) with their numbers, documents as indexes into them."""
        parts = [self.slice(texts[a:b], a) for a, b in slices(list(map(len, texts)), SLICE)]
        whole = {k: np.concatenate([p[k] for p in parts]) for k in ("n_a", "n_b", "n_groups", "doc", "pair", "times")}
        doc, times = whole.pop("doc"), whole.pop("times")
        pairs, index = np.unique(whole.pop("pair"), return_inverse=True)
        counts = np.bincount(index, times, minlength=len(pairs)).astype(np.int64)
        return whole | {
            "n_links": whole["n_a"] + whole["n_b"] - whole["n_groups"], "groups_sha256": [x for p in parts for x in p["groups_sha256"]],
            "pairs": pairs, "counts": counts, "of": np.searchsorted(doc, np.arange(len(texts) + 1)), "index": index.astype(np.int32), "times": times,
        }

    def slice(self, texts: list[str], before: int) -> dict:
        """Of texts behind `before` others of the block: counts and group digests by document, and the number of links (times) by document and pair, in their order."""
        many_a, many_b = self.ids(texts)
        n_a, n_b = (np.array([len(x) for x in many], np.int64) for many in (many_a, many_b))
        ids_a, ids_b = np.concatenate(many_a), np.concatenate(many_b)
        ends_a, ends_b = np.cumsum(self.a.size[ids_a]), np.cumsum(self.b.size[ids_b])
        left, right, closed = align(ends_a, ends_b)
        doc_of_b = np.repeat(np.arange(len(texts)), n_b)
        n_groups = np.bincount(doc_of_b[closed], minlength=len(texts))
        key = (doc_of_b[right] << self.bits) | (ids_a[left].astype(np.int64) << self.b_bits) | ids_b[right]
        key.sort()
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        times = np.diff(np.append(first, len(key)))
        return {
            "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "groups_sha256": self.digests(ids_a, ids_b, ends_a, ends_b, closed, n_a, n_b),
            "doc": (key[first] >> self.bits) + before, "pair": key[first] & ((1 << self.bits) - 1), "times": times.astype(np.int32),
        }

    def digests(self, ids_a, ids_b, ends_a, ends_b, closed, n_a, n_b) -> list[str]:
        """SHA-256 of each document's groups, written as a1,a2|b1;a3|b2,b3 in decimal ids; empty for a document without tokens."""
        if not len(closed):
            return [""] * len(n_a)
        last_b = np.zeros(len(ids_b), bool)
        last_b[closed] = True
        last_a = np.zeros(len(ids_a), bool)
        last_a[np.searchsorted(ends_a, ends_b[closed])] = True
        group_a = np.cumsum(last_a) - last_a
        group_b = np.cumsum(last_b) - last_b
        # The place of each token among all: those of its own side before it, and the other side's of the groups before (for B, also of its own).
        sizes_a, sizes_b = np.bincount(group_a), np.bincount(group_b)
        before_a, before_b = np.cumsum(sizes_a), np.cumsum(sizes_b) - sizes_b
        order = np.empty(len(ids_a) + len(ids_b), np.int64)
        order[np.arange(len(ids_a)) + before_b[group_a]] = ids_a + np.where(last_a, self.stride, 0)
        order[np.arange(len(ids_b)) + before_a[group_b]] = ids_b + np.where(last_b, 2 * self.stride, 0)
        written = list(map(self.decimal.__getitem__, order.tolist()))
        at = np.concatenate(([0], np.cumsum(n_a + n_b))).tolist()
        return [hashlib.sha256("".join(written[x:y])[:-1].encode()).hexdigest() if x < y else "" for x, y in zip(at[:-1], at[1:], strict=True)]


# ---- over the corpus -----------------------------------------------------------------------------------------------------------------------------

COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def blocks(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Rows of aligned texts: part and no (which block), docs (counts and digests), pairs and counts (the block's distinct pairs and their links), of, index and times (each document's pairs)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    one = f"struct<doc_id:{sql_type(docs, id_col)},{','.join(f'{c}:bigint' for c in COUNTS)},groups_sha256:string>"
    kind = _parse_datatype_string(f"part int, no int, docs array<{one}>, pairs array<bigint>, counts array<bigint>, of array<int>, index array<int>, times array<int>")
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        aligner, want, part = Aligner(a_path, b_path), to_arrow_schema(kind), TaskContext.get().partitionId()
        ids, texts, size, no = [], [], 0, 0

        def row() -> pa.RecordBatch:
            got = aligner.block(texts)
            per = [{"doc_id": ids[i], **{c: int(got[c][i]) for c in COUNTS}, "groups_sha256": got["groups_sha256"][i]} for i in range(len(ids))]
            cells = [part, no, per, *(got[c] for c in ("pairs", "counts", "of", "index", "times"))]
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(cells, want, strict=True)], schema=want)

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                t = t or ""
                if texts and size + len(t) + DOCUMENT > block:
                    yield row()
                    ids, texts, size, no = [], [], 0, no + 1
                ids.append(i)
                texts.append(t)
                size += len(t) + DOCUMENT
        if texts:
            yield row()

    return docs.select(F.col(f"`{id_col}`").alias("c0"), F.col(f"`{text_col}`").alias("c1")).mapInArrow(run, kind)


def pair_counts(aligned: DataFrame, b_bits: int) -> DataFrame:
    """Per pair of ids: its number of links in the corpus, and whether that is its B id's highest."""
    each = aligned.select(F.explode(F.arrays_zip("pairs", "counts")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.counts").alias("n"))
    each = cut(each.withColumn("b", F.col("pair").bitwiseAND((1 << b_bits) - 1)), "align-pairs")
    best = each.groupBy("b").agg(F.max("n").alias("most"))
    out = cut(each.join(best, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "align-counts")
    drop_cut(each)
    return out


def align_documents(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Per row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    aligned = cut(blocks(docs, a_path, b_path, id_col, text_col, block), "align-blocks", wide_rows=True)
    counts = pair_counts(aligned, int(len(load_b(b_path).size)).bit_length())
    asked = aligned.select("part", "no", F.explode("pairs").alias("pair"))
    known = join_checked(asked, counts, ["pair"], "inner")
    back = known.groupBy("part", "no").agg(F.sort_array(F.collect_list(F.struct("pair", "n", "best"))).alias("known")).select("part", "no", F.col("known.n").alias("n"), F.col("known.best").alias("best"))
    both = aligned.select("part", "no", "docs", "of", "index", "times").join(back, ["part", "no"], "left").select("docs", "of", "index", "times", "n", "best")
    return _sums(both, sql_type(docs, id_col))


def _sums(both: DataFrame, id_type: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kind = _parse_datatype_string(f"doc_id {id_type}, {', '.join(f'{c} bigint' for c in COUNTS)}, n_best bigint, count_sum bigint, groups_sha256 string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        want = to_arrow_schema(kind)
        for batch in batches:
            for r in range(batch.num_rows):
                docs = batch.column(0)[r].values
                of, index, times, n, best = (np.zeros(0, np.int64) if (v := batch.column(c)[r].values) is None else v.to_numpy(zero_copy_only=False) for c in range(1, 6))
                links = times.astype(np.int64)
                sums = np.append(0, np.cumsum(links * n[index] if len(index) else links))
                bests = np.append(0, np.cumsum(links * best[index] if len(index) else links))
                cells = {c: docs.field(c) for c in ("doc_id", *COUNTS, "groups_sha256")}
                cells |= {"n_best": pa.array(np.diff(bests[of]), pa.int64()), "count_sum": pa.array(np.diff(sums[of]), pa.int64())}
                yield pa.RecordBatch.from_arrays([cells[f.name].cast(f.type) for f in want], schema=want)

    return both.mapInArrow(run, kind)
