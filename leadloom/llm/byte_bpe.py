"""Byte-level BPE encoding and decoding.

Pre-tokens are found without a regular expression. Each code point gets a class; with what follows it, the class becomes a symbol;
a symbol is a function from the state before a character to the state after it. These functions compose associatively, so the states
of a long text come from a two-level scan: rows of a matrix are composed column by column, the rows' functions by doubling, and a
second sweep over the columns yields, for every character, whether a pre-token starts there. Slices between starts are merged pair by
pair (lowest rank first) through a bounded cache; their offsets are kept, so that ids can be related to the text, and ids are decoded by
gathering bytes from one flat vocabulary array.

Cases: null and empty text have no ids and decode to nothing; repeated rows are encoded row by row; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import unicodedata
from array import array

import numpy as np
from pyspark.sql import DataFrame

from .common import CACHED_CHARS, map_texts, sql_type

CACHE_TOKENS = 600_000
#: Characters of one scan, and columns of its matrix.
CHUNK, COLUMNS = 1 << 19, 256

# Code-point classes
LETTER, NUMBER, SPACE, BLANK, QUOTE, OTHER = range(6)
#: The white space of Unicode (White_Space), as ranges.
WHITE_SPACE = [(0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]

# Symbols: classes with what follows them
S_LETTER, S_NUMBER, S_OTHER, S_SHORT, S_LONG, S_BLANK_BEFORE, S_SPACE_BEFORE, S_SPACE_RUN, S_RESET = range(9)
# States: nothing open, in letters, in numbers, in other characters, in white space, after a leading blank, one or two letters of a contraction to come
FREE, IN_LETTERS, IN_NUMBERS, IN_OTHER, IN_SPACE, AFTER_BLANK, ONE_LEFT, TWO_LEFT = range(8)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Next state and start flag by symbol and state."""
    after, starts = np.zeros((9, 8), np.uint8), np.ones((9, 8), bool)
    for symbol, state in ((S_LETTER, IN_LETTERS), (S_NUMBER, IN_NUMBERS), (S_OTHER, IN_OTHER)):
        after[symbol], starts[symbol, [state, AFTER_BLANK]] = state, False
    for symbol, state in ((S_SHORT, ONE_LEFT), (S_LONG, TWO_LEFT)):
        after[symbol] = state
        after[symbol, [IN_OTHER, AFTER_BLANK]], starts[symbol, [IN_OTHER, AFTER_BLANK]] = IN_OTHER, False
    after[S_LETTER, TWO_LEFT], after[S_LETTER, ONE_LEFT], starts[S_LETTER, [ONE_LEFT, TWO_LEFT]] = ONE_LEFT, FREE, False
    after[S_BLANK_BEFORE] = AFTER_BLANK
    after[S_SPACE_RUN], starts[S_SPACE_RUN, IN_SPACE] = IN_SPACE, False
    starts[S_RESET] = False
    return after, starts


AFTER, STARTS = _tables()


@functools.cache
def classes() -> np.ndarray:
    """The class of every code point."""
    first = np.frompyfunc(lambda c: unicodedata.category(chr(c))[0], 1, 1)(np.arange(0x110000)).astype("U1")
    out = np.full(0x110001, OTHER, np.uint8)
    out[:-1][first == "L"], out[:-1][first == "N"] = LETTER, NUMBER
    for a, b in WHITE_SPACE:
        out[a : b + 1] = SPACE
    out[0x20], out[0x27] = BLANK, QUOTE
    return out


def symbols(points: np.ndarray) -> np.ndarray:
    """Symbols of code points; documents are divided by the point 0x110000."""
    kind = classes()[points]
    kind[points == 0x110000] = 255
    after = np.append(kind[1:], 255)
    # A plain look-up by class; quotes and white space are mended by what follows.
    out = np.array([S_LETTER, S_NUMBER, S_SPACE_RUN, S_SPACE_RUN, S_OTHER, S_OTHER] + [S_RESET] * 250, np.uint8)[kind]
    ends_run = (after != SPACE) & (after != BLANK) & (after != 255)
    out[(kind == BLANK) & ends_run] = S_BLANK_BEFORE
    out[(kind == SPACE) & ends_run] = S_SPACE_BEFORE
    if len(quotes := np.flatnonzero(kind == QUOTE)):
        padded = np.append(points, [0, 0])
        one, two = padded[quotes + 1], padded[quotes + 2]
        out[quotes[np.isin(one, [ord(c) for c in "stmd"])]] = S_SHORT
        long = np.zeros(len(quotes), bool)
        for a, b in ("re", "ve", "ll"):
            long |= (one == ord(a)) & (two == ord(b))
        out[quotes[long]] = S_LONG
    return out


def starts(points: np.ndarray) -> np.ndarray:
    """For every code point, whether a pre-token starts there."""
    every, state = symbols(points), FREE
    out = np.empty(len(every), bool)
    for at in range(0, len(every), CHUNK):
        part = every[at : at + CHUNK]
        flags, state = _scan(part, state)
        out[at : at + CHUNK] = flags
    return out


def _scan(part: np.ndarray, state: int) -> tuple[np.ndarray, int]:
    n = len(part)
    rows = -(-n // COLUMNS)
    padded = np.full(rows * COLUMNS, S_RESET, np.intp)
    padded[:n] = part
    columns = np.ascontiguousarray(padded.reshape(rows, COLUMNS).T) * 8
    after, begins = AFTER.ravel(), STARTS.ravel()
    # The function of every row: where each of the eight states leads.
    whole = np.tile(np.arange(8, dtype=np.uint8), (rows, 1))
    for column in columns:
        whole = after[column[:, None] + whole]
    step = 1
    while step < rows:  # inclusive scan by doubling; composing is associative
        whole[step:] = np.take_along_axis(whole[step:], whole[:-step], 1)
        step *= 2
    at = np.empty(rows, np.uint8)
    at[0], at[1:] = state, whole[:-1, state]
    flags = np.empty((COLUMNS, rows), bool)
    last = at
    for j, column in enumerate(columns):
        index = column + last
        flags[j], last = begins[index], after[index]
        if j == (n - 1) % COLUMNS:
            end = int(last[-1])
    return flags.T.ravel()[:n], end


class ByteBpe(dict):
    """Ids of pre-tokens as 32-bit bytes, filled as they are asked for."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks
        pieces = sorted(ranks.items(), key=lambda x: x[1])
        n = pieces[-1][1] + 1
        self.size, self.offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for piece, i in pieces:
            self.size[i] = len(piece)
        self.offset[1:] = np.cumsum(self.size)[:-1]
        self.flat = np.frombuffer(b"".join(p for p, _ in pieces), np.uint8)
        self.decimal = list(map(str, range(n)))

    def __missing__(self, token: str) -> bytes:
        ids = array("i", self.merge(token.encode())).tobytes()
        if len(token) <= CACHED_CHARS:
            if len(self) > CACHE_TOKENS:
                self.clear()
            self[token] = ids
        return ids

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: the pair of the lowest rank, leftmost first, is joined until none is left."""
        ranks = self.ranks
        if (i := ranks.get(piece)) is not None:
            return [i]
        n = len(piece)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, left, mid, right = heapq.heappop(agenda)
            if end[left] != mid or end[mid] != right:
                continue
            end[left], end[mid] = right, 0
            if right < n:
                before[right] = left
                if (r := ranks.get(piece[left : end[right]])) is not None:
                    heapq.heappush(agenda, (r, left, right, end[right]))
            if (p := before[left]) >= 0 and (r := ranks.get(piece[p:right])) is not None:
                heapq.heappush(agenda, (r, p, left, right))
        return [ranks[piece[i : end[i]]] for i in range(n) if end[i]]

    def split(self, texts: list[str]) -> list[list[str]]:
        """Pre-tokens of each text, by one scan over all of them."""
        return [[t[a:b] for a, b in zip(at, [*at, len(t)][1:], strict=True)] for t, at in zip(texts, self.offsets(texts), strict=True)]

    def offsets(self, texts: list[str]) -> list[list[int]]:
        """Code-point offsets at which the pre-tokens of each text start."""
        if not texts:
            return []
        lengths = np.array([len(t) for t in texts], np.int64)
        points = np.full(int(lengths.sum()) + len(texts), 0x110000, np.uint32)
        begin = np.concatenate(([0], np.cumsum(lengths + 1)[:-1])).astype(np.int64)
        for t, a in zip(texts, begin, strict=True):
            points[a : a + len(t)] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
        found = np.flatnonzero(starts(points))
        where = np.searchsorted(found, begin)
        return [(found[a:b] - c).tolist() for a, b, c in zip(where, [*where[1:], len(found)], begin, strict=True)]

    def decode(self, ids: np.ndarray) -> bytes:
        sizes = self.size[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ids) else 0
        return self.flat[np.repeat(self.offset[ids] - (ends - sizes), sizes) + np.arange(total)].tobytes()


@functools.cache
def load(path: str) -> ByteBpe:
    with open(path, "rb") as f:
        return ByteBpe({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})


def encode(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, ids, and for every pre-token its code-point offset and the number of ids before it."""

    def make():
        bpe = load(ranks_path)

        def work(cols, texts):
            ids, before = [], []
            offsets = bpe.offsets(texts)
            for t, at in zip(texts, offsets, strict=True):
                own, counts = [], []
                for a, b in zip(at, [*at, len(t)][1:], strict=True):
                    counts.append(len(own))
                    own.extend(np.frombuffer(bpe[t[a:b]], np.int32).tolist())
                ids.append(own)
                before.append(counts)
            return {"doc_id": cols[0], "ids": ids, "offsets": offsets, "ids_before": before}

        return work

    return map_texts(docs, [id_col, text_col], f"doc_id {sql_type(docs, id_col)}, ids array<int>, offsets array<bigint>, ids_before array<bigint>", make)


def decode(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: doc_id and the text of its ids (null ids: empty)."""
    from collections.abc import Iterator

    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(ranks_path)
        for b in batches:
            texts = [bpe.decode(np.array(x or [], np.int64)).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "text": pa.array(texts, pa.string())})

    return encoded.select(id_col, ids_col).mapInArrow(run, f"doc_id {sql_type(encoded, id_col)}, text string")


def round_trip(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode in one pass; per row: doc_id, n_tokens and the digests of the ids and of the decoded bytes."""

    def make():
        bpe = load(ranks_path)

        def work(cols, texts):
            n, ids_sha, text_sha = [], [], []
            for tokens in bpe.split(texts):
                ids = np.frombuffer(b"".join(map(bpe.__getitem__, tokens)), np.int32)
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(bpe.decimal.__getitem__, ids.tolist())).encode()).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            return {"doc_id": cols[0], "n_tokens": n, "ids_sha256": ids_sha, "decoded_sha256": text_sha}

        return work

    return map_texts(docs, [id_col, text_col], f"doc_id {sql_type(docs, id_col)}, n_tokens bigint, ids_sha256 string, decoded_sha256 string", make)
