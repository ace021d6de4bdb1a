"""Alignment against the tokenizers' libraries and a comparison of all pairs of byte ranges."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from leadloom.llm import alignment, queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "  ", "a", "a  b", " x\n\n y  ", "▁x", "a▁ b", "don't we're I'll  end ", "日本語テキスト  は", "<|endoftext|> <s></s> <unk>", "\x00\x01 �", "a" * 500, "🙂🙃 é́ ", "x", "x",
    "　  wide", "tab\tand\r\nlines ", "naïve façade 12345 ³ ½ ǅ", "e" * 40 + " " + "ab" * 2000,
]


def library_ids(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    return [x.ids for x in t.encode_batch([" " + x for x in texts], add_special_tokens=False)], sentencepiece.SentencePieceProcessor(model_file=B).encode(texts, num_threads=1)


def brute(rows):
    """(doc_id, text) to results, by comparing every token of A with every token of B."""
    from tokenizers import Tokenizer

    t, chars = Tokenizer.from_file(A), alignment.byte_alphabet()
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=B)
    bytes_a = lambda i: bytes(chars[c] for c in t.id_to_token(i))
    bytes_b = lambda i: bytes([int(p.id_to_piece(i)[3:5], 16)]) if p.is_byte(i) else p.id_to_piece(i).replace("▁", " ").encode()
    texts = [x or "" for _, x in rows]
    found, total = [], Counter()
    for text, ids_a, ids_b in zip(texts, *library_ids(texts), strict=True):
        parts_a, parts_b = list(map(bytes_a, ids_a)), list(map(bytes_b, ids_b))
        whole = (" " + text).encode()
        if not text or b"".join(parts_a) != whole or b"".join(parts_b) != whole:
            found.append(None)
            continue
        ranges = []
        for parts in (parts_a, parts_b):
            ends = np.cumsum([len(x) for x in parts])
            ranges.append(list(zip(ends - [len(x) for x in parts], ends, strict=True)))
        links = [(ids_a[i], ids_b[j]) for i, (s, e) in enumerate(ranges[0]) for j, (u, v) in enumerate(ranges[1]) if s < v and u < e]
        total.update(links)
        both = sorted({e for _, e in ranges[0]} & {e for _, e in ranges[1]})
        groups, last = [], 0
        for end in both:
            groups.append("|".join(",".join(str(i) for i, (s, e) in zip(ids, r, strict=True) if last <= s and e <= end) for ids, r in zip((ids_a, ids_b), ranges, strict=True)))
            last = end
        found.append((len(ids_a), len(ids_b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = Counter()
    for (_, b), n in total.items():
        most[b] = max(most[b], n)
    out = []
    for (i, _), f in zip(rows, found, strict=True):
        out.append((i, 0, 0, 0, 0, 0, 0, "") if f is None else (i, *f[:3], len(f[3]), sum(total[x] == most[x[1]] for x in f[3]), sum(total[x] for x in f[3]), f[4]))
    return sorted(out, key=str)


def got(df, **more):
    return sorted(map(tuple, alignment.align_documents(df, A, B, **more).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=str)


def test_ids_are_the_libraries(spark):
    texts = [r[0] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()] + [x or "" for x in ODD]
    for vocabulary, prefix, want in zip((alignment.load_a(A), alignment.load_b(B)), (" ", ""), library_ids(texts), strict=True):
        for _ in range(2):  # the second time from the cache
            assert [x.tolist() for x in vocabulary.encode([prefix + t for t in texts])] == want


@pytest.mark.parametrize("piece", [1, 2, 3, 7, 1 << 14])
def test_pieces_equal_all_pairs(piece):
    rnd = random.Random(piece)
    for _ in range(150):
        n = rnd.randint(1, 40)
        a, b = (np.array(sorted({*rnd.sample(range(1, n + 1), rnd.randint(0, n)), n})) for _ in range(2))
        left, right, closed = alignment.align(a, b, piece)
        start = lambda ends, i: ends[i - 1] if i else 0
        want = {(i, j) for i in range(len(a)) for j in range(len(b)) if start(a, i) < b[j] and start(b, j) < a[i]}
        assert set(zip(left.tolist(), right.tolist(), strict=True)) == want and len(left) == len(want)
        assert b[np.sort(closed)].tolist() == sorted(set(a.tolist()) & set(b.tolist()))
    at = alignment.diagonals(a, b, piece)
    assert at[0] == 0 and at[-1] == len(a) and all(x <= y for x, y in zip(at[:-1], at[1:], strict=True))


@pytest.mark.parametrize("block", [1, 3000, alignment.BLOCK])
def test_equals_brute_force(spark, block):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("n_chars < 1500").limit(60).collect()
    rows = [(r.doc_id, r.text) for r in docs] + list(enumerate(ODD, 10_000)) + [(7, "Same again."), (7, "Same again."), (None, "No id.")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id bigint, text string, Pairs int, part string").repartition(3)
    assert got(df, block=block) == brute(rows)


def test_shuffled_join_gives_the_same(spark, monkeypatch):
    rows = [(i, f"Word {i % 7} and wörds {'again ' * (i % 5)}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    monkeypatch.setattr("leadloom.llm.common.BROADCAST_ROWS", 0)
    monkeypatch.setattr(alignment, "join_checked", lambda left, right, on, how: left.join(right.hint("merge"), on, how))
    assert got(df, block=200) == brute(rows)


def test_empty_and_long(spark):
    assert got(spark.createDataFrame([], "doc_id bigint, text string")) == []
    long = "many words of one text " * 60_000
    (row,) = got(spark.createDataFrame([(1, long)], "doc_id bigint, text string"))
    ids = library_ids([long])
    assert row[1:3] == (len(ids[0][0]), len(ids[1][0])) and row[4] == row[1] + row[2] - row[3]


def test_query_reads_every_row(spark):
    out = queries.op12_alignment(spark, "/root/testdata/sf0.001")
    assert out.count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()


def test_block_is_aligned_by_slices(monkeypatch):
    texts = [f"Wörter {i} of text, {'again ' * (i % 60)}" for i in range(400)] + ["", "x" * 3000, "", "▁x"]
    whole = alignment.Aligner(A, B).block(texts)
    monkeypatch.setattr(alignment, "SLICE", 1000)
    aligner, asked = alignment.Aligner(A, B), []
    monkeypatch.setattr(aligner, "ids", lambda part: asked.append(sum(map(len, part))) or alignment.Aligner.ids(aligner, part))
    got = aligner.block(texts)
    assert sorted(asked)[-2] <= 1000 and max(asked) == 3000 and sum(asked) == sum(map(len, texts))
    assert got["groups_sha256"] == whole["groups_sha256"] and all(np.array_equal(got[k], whole[k]) for k in whole)


@pytest.mark.parametrize("make", [lambda: alignment.BytePieces(alignment.load_a(A).ranks), lambda: alignment.WordPieces(B)])
def test_caches_keep_late_words(monkeypatch, make):
    monkeypatch.setattr(alignment, "CACHE_WORDS", 100)
    cache, words = make(), [f"wörd{i}" for i in range(1000)]
    found = []
    for i, word in enumerate(words):
        found.append(cache[word])
        assert cache["often"] and len(cache) + len(cache.older) <= 100
        assert i < 100 or "often" in cache or "often" in cache.older
    assert found == [make()[w] for w in words[:1]] + [cache.found(w) for w in words[1:]]


def test_blocks_are_bounded_in_rows_and_groups(spark):
    from urllib.parse import urlparse

    import pyarrow.dataset as ds

    empty = spark.range(0, 5000, 1, 1).selectExpr("id as doc_id", "'' as text")
    assert alignment.blocks(empty, A, B, block=1000 * alignment.DOCUMENT).selectExpr("size(docs) as n").collect() == [(1000,)] * 5
    wide = alignment.cut(spark.range(0, 40, 1, 1).selectExpr("id", "transform(sequence(1, 200000), x -> hash(x, id)) as a"), "wide", wide_rows=True)
    groups = [g for f in ds.dataset(urlparse(wide._cut_path).path, format="parquet").get_fragments() for g in f.row_groups]
    assert len(groups) > 1 and max(g.total_byte_size for g in groups) < 24 << 20 and sum(g.num_rows for g in groups) == 40
    alignment.drop_cut(wide)
