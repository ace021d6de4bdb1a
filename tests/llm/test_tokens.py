"""Token counts and byte-level BPE against the libraries, on awkward and random texts."""

import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from leadloom.llm import byte_bpe, token_counts

PIECES, RANKS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = ["", " ", "  a", "a  b ", "\n\n x\n", "it's 'tis we'll I'd 'S 're've", "x'", "''s", "</s><s><unk>", "<|endoftext|>", "▁a▁▁b", "漢字かな", "😀é", "1½Ⅷ", "\x00\x1c\x85 .", "a" * 3000, " " * 700, "ab, " * 900, "Größe – naïve"]
ALPHABET = st.sampled_from(list(" \n\t'stmdrevl.,;09aAéß漢▁<>😀\x00\x1c\x85　") + ["'ll", "  ", "</s>"])


@pytest.fixture(scope="module")
def libraries():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return sentencepiece.SentencePieceProcessor(model_file=PIECES), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(libraries, text):
    pieces, bytes_ = libraries
    assert token_counts.load(PIECES).tokens(text) == len(pieces.encode(text))
    bpe = byte_bpe.load(RANKS)
    ids = [i for t in bpe.split([text])[0] for i in np.frombuffer(bpe[t], np.int32).tolist()]
    assert ids == bytes_.encode_ordinary(text)
    assert bpe.decode(np.array(ids, np.int64)) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(ALPHABET, max_size=40).map("".join), max_size=5))
def test_random_texts(libraries, texts):
    pieces, bytes_ = libraries
    counter, bpe = token_counts.load(PIECES), byte_bpe.load(RANKS)
    assert [counter.tokens(t) for t in texts] == [len(x) for x in pieces.encode(texts)]
    split = bpe.split(texts)
    assert ["".join(x) for x in split] == texts
    assert [[i for w in x for i in np.frombuffer(bpe[w], np.int32).tolist()] for x in split] == [bytes_.encode_ordinary(t) for t in texts]


def test_states_go_on_over_chunks(monkeypatch):
    text = "it's  a \n test'll ''s x1½ " * 50
    whole = byte_bpe.load(RANKS).split([text])
    monkeypatch.setattr(byte_bpe, "CHUNK", 7)
    monkeypatch.setattr(byte_bpe, "COLUMNS", 3)
    assert byte_bpe.load(RANKS).split([text]) == whole


def test_tables(spark, libraries):
    rows = [(1, None), (2, ""), (2, "twice twice"), (2, "twice twice"), (None, "x" * 50000)]
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, n_tokens int")
    got = token_counts.count_tokens(df, PIECES, limit=10).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == sorted((i or 0, len((t or "").encode()), n := len(libraries[0].encode(t or "")), n > 10) for i, t in rows)
    trip = byte_bpe.round_trip(df, RANKS).collect()
    assert sorted(r.decoded_sha256 for r in trip) == sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t in rows)
    assert sorted(r.ids_sha256 for r in trip) == sorted(hashlib.sha256(",".join(map(str, libraries[1].encode_ordinary(t or ""))).encode()).hexdigest() for _, t in rows)
    back = byte_bpe.decode(byte_bpe.encode(df, RANKS), RANKS).collect()
    assert sorted(r.text for r in back) == sorted(t or "" for _, t in rows)
    assert token_counts.count_tokens(df.limit(0), PIECES).count() == 0 == byte_bpe.round_trip(df.limit(0), RANKS).count()
