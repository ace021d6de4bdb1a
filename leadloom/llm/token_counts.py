"""Token counts by byte-pair merging with a heap and a linked list, for a sentence-piece vocabulary with byte fallback.

A text's symbols are its characters (a character outside the vocabulary counts as its UTF-8 bytes). The adjacent pair whose
union is the best piece is popped and merged until none is left; the count is the initial symbols minus the merges, and no
identifier is made.

Texts are cut before each space and the counts of words are kept in a bounded cache. That is exact: where no piece holds two
characters side by side, no merge can ever join them, and load() refuses a vocabulary in which a space follows another character.

Cases: null and empty text count 0; repeated rows are counted row by row; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import heapq
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHED_CHARS, map_texts, sql_type

SPACE = "▁"
#: Entries of a task's cache of words; a full cache is emptied.
CACHE_WORDS = 400_000


class PairCounter(dict):
    """Counts of words (keyed without their leading space mark), filled as they are asked for."""

    def __init__(self, scores: dict[str, float]):
        super().__init__()
        self.scores = scores
        self.joined = {p[i : i + 2] for p in scores for i in range(len(p) - 1)}
        if any(b == SPACE != a for a, b in self.joined):
            raise ValueError("this vocabulary joins words; texts can't be cut at spaces")
        if missing := {c for p in scores if len(p) > 1 for c in p} - scores.keys():
            raise ValueError(f"characters of pieces are no pieces: {sorted(missing)[:5]}")
        self.parts: dict[str, int] = {}

    def __missing__(self, word: str) -> int:
        n = self.count(SPACE + word)
        if len(word) <= CACHED_CHARS:
            if len(self) > CACHE_WORDS:
                self.clear()
            self[word] = n
        return n

    def count(self, run: str) -> int:
        """Tokens of a run of characters, cut further where no piece joins two neighbours."""
        total, start, joined, parts = 0, 0, self.joined, self.parts
        for i in range(1, len(run) + 1):
            if i == len(run) or run[i - 1 : i + 1] not in joined:
                part = run[start:i]
                if (n := parts.get(part)) is None:
                    n = self.merge(part)
                    if len(part) <= CACHED_CHARS:
                        if len(parts) > CACHE_WORDS:
                            parts.clear()
                        parts[part] = n
                total, start = total + n, i
        return total

    def merge(self, part: str) -> int:
        scores = self.scores
        symbols = sum(1 if c in scores else len(c.encode()) for c in part)
        n = len(part)
        if n == 1:
            return symbols
        # Symbol i is part[i:end[i]]; a merged right-hand symbol gets end 0.
        end, before, merges = list(range(1, n + 1)), list(range(-1, n - 1)), 0
        agenda = []
        for i in range(n - 1):
            if (s := scores.get(part[i : i + 2])) is not None:
                agenda.append((-s, i, i + 1, i + 2))
        heapq.heapify(agenda)
        while agenda:
            _, left, mid, right = heapq.heappop(agenda)
            if end[left] != mid or end[mid] != right:
                continue
            end[left], end[mid] = right, 0
            merges += 1
            if right < n:
                before[right] = left
                if (s := scores.get(part[left : end[right]])) is not None:
                    heapq.heappush(agenda, (-s, left, right, end[right]))
            if (p := before[left]) >= 0 and (s := scores.get(part[p:right])) is not None:
                heapq.heappush(agenda, (-s, p, left, right))
        return symbols - merges

    def tokens(self, text: str) -> int:
        if not text:
            return 0
        text = SPACE + text.replace(" ", SPACE)
        if SPACE * 2 in text:
            return sum(map(self.count, re.findall(f"{SPACE}+[^{SPACE}]*", text)))
        return sum(map(self.__getitem__, text.split(SPACE)[1:]))


@functools.cache
def load(path: str) -> PairCounter:
    """Read the pieces and their scores; only plain pieces take part in merges."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    spec, kinds = model.normalizer_spec, {p.type for p in model.pieces}
    if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or kinds & {4, 5} or 6 not in kinds:
        raise ValueError("only vocabularies without normalisation, with a leading space and byte fallback, are counted")
    return PairCounter({p.piece: p.score for p in model.pieces if p.type == 1})


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_tokens, over_limit (more than `limit` tokens)."""

    def make():
        counter = load(model_path)

        def work(ids, texts):
            return {"doc_id": ids[0], "n_bytes": [len(t.encode()) for t in texts], "n_tokens": [counter.tokens(t) for t in texts]}

        return work

    out = map_texts(docs, [id_col, text_col], f"doc_id {sql_type(docs, id_col)}, n_bytes bigint, n_tokens bigint", make)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
