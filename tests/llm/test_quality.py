"""Quality rules and packing against brute force."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from leadloom.llm import packing, quality

WORDS = "one two three four five six seven eight nine ten".split()


def docs():
    r = random.Random(2)
    line = lambda n: " ".join(r.choice(WORDS) + str(r.randint(0, 400)) for _ in range(n))
    rows = []
    for i in range(120):
        host = ["big", None, ""][i % 3] if i % 2 else "big"
        body = [line(20) for _ in range(4)]
        if i % 2 == 0:
            body.insert(2, "Same  OLD line of the site")
        if i % 10 == 0:
            body = ["Same old line of the site"] * 30 + body[:1]
        rows.append((i, "\n".join(body), host))
    rows += [(500 + i, "copied line number one here\n" * 12, "big") for i in range(30)]
    rows += [(600, None, "big"), (601, "", None), (602, " \n\t", "x"), (603, "a b c " * 40, "x"), (603, "a b c " * 40, "x"), (None, line(60), "x"), (604, "# * $ % & | < > é " * 3, "x")]
    return rows


def brute(rows, count):
    seen, texts = defaultdict(set), defaultdict(set)
    split = lambda s: s.encode().split()
    for at, (_, t, h) in enumerate(rows):
        unit = at if count == "documents" else t or ""
        texts[h or ""].add(unit)
        for x in (t or "").split("\n"):
            if split(x):
                seen[h or "", b" ".join(split(x.encode().lower().decode("utf-8", "surrogateescape")))].add(unit)
    above = {k for k, v in seen.items() if len(v) > max(quality.MIN_DOCS, quality.MAX_SHARE * len(texts[k[0]]))}
    out = []
    for i, t, h in rows:
        t = t or ""
        w = split(t)
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        inside = {j + o for j in range(len(w) - 2) if grams[w[j], w[j + 1], w[j + 2]] > 1 for o in range(3)}
        lines = [x for x in t.split("\n") if split(x)]
        gone = sum(len(split(x)) for x in lines if (h or "", b" ".join(x.encode().lower().split())) in above)
        failed = len(w) < 50 or 100 * len(inside) > 50 * len(w)
        out.append((i, len(w), sum(len(x.decode()) for x in w), sum(map(t.count, "#*$%&|<>")), len(lines) - len(set(lines)), len(inside), failed, gone, not failed and len(w) - gone >= 0.5 * len(w)))
    return out


@pytest.mark.parametrize("count", ["documents", "texts"])
@pytest.mark.parametrize("small", [True, False])
def test_rules(spark, monkeypatch, small, count):
    if not small:
        monkeypatch.setattr(quality, "is_small", lambda *a, **k: False)
        monkeypatch.setattr(quality, "join_checked", lambda left, right, on, how, wide=(): left.join(right, on, how))
    rows = [*docs(), (700, "\n".join(["word%d of a very long text" % i for i in range(40_000)] + ["Same old line of the site"]), "big")]
    df = spark.createDataFrame([(i, t, h, -1, "z") for i, t, h in rows], "doc_id long, text string, source string, n_words int, host string")
    got = [tuple(r) for r in quality.judge(df, count=count).collect()]
    key = lambda x: tuple((v is None, v) for v in x)
    want = brute(rows, count)
    assert sorted(got, key=key) == sorted(want, key=key)
    kept = quality.clean(df, count=count)
    assert kept.columns == df.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == sorted((w[0] is None, w[0] or 0) for w in want if w[-1])
    assert not kept.where("text like '%OLD line%'").count()
    assert count == "texts" or not any(w[-1] for w in want if w[0] is not None and 500 <= w[0] < 530)
    names = ["_row", "lines", "bad", "_lines"]  # columns that are named as the operator's own stay what they were
    clash = df.toDF("_row", "lines", "bad", "words", "_lines")
    again = quality.clean(clash, "_row", "lines", "bad", count=count)
    assert again.columns == clash.columns and set(names) < set(again.columns)
    assert sorted(map(str, again.collect())) == sorted(str(r).replace("doc_id=", "_row=").replace("text=", "lines=", 1).replace("source=", "bad=").replace("n_words=", "words=").replace("host=", "_lines=") for r in kept.collect())
    assert quality.judge(df.limit(0)).count() == 0 == quality.clean(df.limit(0)).count()


def test_packing(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(["Hello,", "wörld.", "ΑΣ", "x1", "İ", "<|endoftext|>", "A.", "don't"]) for _ in range(r.randint(0, 900)))) for i in range(300)]
    rows += [(900, None), (901, ""), (902, "word " * 5000), (903, "a\x1cb \x85c"), (904, "same"), (904, "same"), (None, "no id")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, piece int")
    got = packing.pack_documents(df, path, per_task=100).collect()
    want = Counter()
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[at : at + 2048], "<u4")
            want[i, k, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in got) == want
    bins = defaultdict(list)
    for x in got:
        bins[x.sequence_id].append((x.offset, x.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack_documents(df.limit(0), path).count() == 0


MARKS = st.sampled_from([*"abzAZéÉßÿÀ×÷µªº,.!'*#$<>|&-_^`~@[]{}()09 ", "'s", "'LL", "<|endoftext|>", "<|endoftext", "e\u0301", "İ", "漢", "\u0301", "\u00ad"])


@settings(max_examples=500, deadline=None)
@given(st.lists(MARKS, max_size=30).map("".join))
def test_word_ids(text):
    """Ids by words, letters and marks are those of the library over the whole text."""
    words = packing.load(public_tokenizers.path("word_bpe_49k.json"))
    assert words.encode(text) == words.whole(text)


def test_few_sequences(spark):
    """Over many pieces in one task, the bins are within 1 % of the least that their tokens could fill."""
    r = random.Random(4)
    lengths = [r.choice([r.randint(1, 2047), r.randint(1, 300)]) for _ in range(20_000)]
    pieces = spark.createDataFrame([(i, 0, 0, n, i) for i, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    assert packing.pack(pieces).select("sequence_id").distinct().count() <= 1.01 * -(-sum(lengths) // 2048)


def test_open_bins_match_a_plain_search():
    r = random.Random(8)
    bins, free = packing.OpenBins(100, 5), []
    for _ in range(3000):
        n = r.randint(1, 99)
        _, offset = bins.place(n)
        fit = min((f for f in free if f >= n), default=None)
        assert offset == (0 if fit is None else 100 - fit)
        if fit is not None:
            free.remove(fit)
        free.append((100 if fit is None else fit) - n)
        free = [f for f in free if f]
        if len(free) > 5:
            free.remove(min(free))
        assert bins.count == len(free) and bins.bits == sum(1 << f for f in set(free))
