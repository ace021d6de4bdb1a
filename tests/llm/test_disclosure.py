"""The whole disclosure rule by plain loops over texts, and contexts that run over neighbouring values."""

import math
import random
from collections import defaultdict

import regex

from leadloom.llm import pii

SEP = r"[\x20\x09-\x0D]+"
BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def values(text):
    """(kind, start, end, raw matches of the kind before and after) of valid matches."""
    for kind, pattern in BASE.items():
        raw = list(regex.finditer(pattern, text))
        for i, m in enumerate(raw):
            digits = regex.sub("[^0-9]", "", m[0])
            ok = {"email": lambda: True, "ip": lambda m=m: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda d=digits: 12 <= len(d) <= 19 and luhn(d), "phone": lambda d=digits: 9 <= len(d) <= 15}[kind]()
            if ok:
                yield kind, m.start(), m.end(), raw[i - 1].end() if i else 0, raw[i + 1].start() if i + 1 < len(raw) else len(text)


def term(piece):
    m = regex.match(r"[^\p{L}\p{N}]*(\p{L}{3,})[^\p{L}\p{N}]*\Z", piece.lower())
    return m[1] if m else ""


def brute(rows):
    texts = {t or "" for _, t in rows}
    contexts, pairs = defaultdict(set), defaultdict(set)
    for text in texts:
        for kind, a, b, left, right in values(text):
            ahead, behind = regex.split(SEP, text[:a]), regex.split(SEP, text[b:])
            own = [regex.split(SEP, text[left:a])[-1], regex.split(SEP, text[b:right])[0]]
            words = ahead[:-1][-pii.WINDOW :] + own + behind[1:][: pii.WINDOW]
            value = text[a:b].lower() if kind == "email" else text[a:b] if kind == "ip" else regex.sub("[^0-9]", "", text[a:b])
            contexts[kind, value].add(" ".join(words))
            for t in set(map(term, words)) - {""}:
                pairs[(kind, value), t].add(" ".join(words))
    holds = defaultdict(set)
    for text in texts:
        for w in regex.split(r"[^\p{L}\p{N}]*" + SEP + r"[^\p{L}\p{N}]*", f" {text.lower()} "):
            holds[w].add(text)
    terms, n = set(), max(len(texts), 2)
    for (e, t), own in pairs.items():
        p = len(contexts[e]) / n
        if len(own) >= pii.MIN_CONTEXTS and len(contexts[e]) >= pii.MIN_CONTEXTS and holds[t]:
            if math.log2(len(own) / len(holds[t]) / p) / math.log2(1 / min(p, 0.5)) >= pii.MIN_SHARE:
                terms.add(t)
    out = []
    for i, text in rows:
        text = text or ""
        spans = [(a, pii.KINDS.index(k), b) for k, a, b, *_ in values(text)]
        for m in regex.finditer(r"[^\x20\x09-\x0D]+", text):
            if term(m[0]) in terms:
                inner = regex.search(r"\p{L}+", m[0])
                spans.append((m.start() + inner.start(), pii.KINDS.index("term"), m.start() + inner.end()))
        out.append((i, ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))))
    return sorted(out, key=str), terms


def got(spark, rows):
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, _words int")
    return sorted(((r.doc_id, r.spans) for r in pii.find(df).collect()), key=str)


def test_equals_plain_loops(spark):
    rnd = random.Random(11)
    plain = "the quick brown words of every day go round and round for good".split()
    people = [("Zorblax", "zor@blax.org"), ("Quimby", "+44 20 7946 0958"), ("Ferndale", "10.0.0.7"), ("Ostrava", "4111 1111 1111 1111"), ("Ünal", "u.nal@mail.example")]
    other = ["a{}@y.example", "1.2.3.{}", "{}00000", "tel:+1 212 555 0{}", "x@", "5500 0000 0000 00{}", "300.1.1.{}", "a{}@b.c;d{}@e.f"]
    rows = [(i, " ".join(rnd.choice(plain) for _ in range(rnd.randrange(30)))) for i in range(60)]
    for i in range(240):
        words = [rnd.choice(plain) for _ in range(rnd.randrange(4, 25))]
        for _ in range(rnd.randrange(5)):
            words.insert(rnd.randrange(len(words)), rnd.choice(other).replace("{}", str(rnd.randrange(10, 99))))
        if rnd.random() < 0.6:
            name, value = rnd.choice(people)
            at = rnd.randrange(len(words))
            near = [name, *(rnd.choice(other).replace("{}", str(i)) for _ in range(rnd.randrange(3))), value]
            words[at:at] = near if rnd.random() < 0.5 else near[::-1]
        rows.append((100 + i, rnd.choice([" ", " ", "\n", "\t "]).join(words) + rnd.choice(["", ".", " "])))
    rows += [(900, f"Word {n} and the day") for n, _ in people] + [(901, None), (902, ""), rows[80], rows[80], (None, rows[90][1])]
    want, terms = brute(rows)
    assert {"zorblax", "ferndale"} <= terms
    assert got(spark, rows) == want


def test_context_runs_over_neighbouring_values(spark):
    """A name stays within five words of an address whatever other address stands between them."""
    filler = [(i, f"Filler text number {chr(97 + i % 26)}{chr(97 + i // 26)} of the corpus") for i in range(60)]
    for between in ("writes ", "a{}@y.example "):
        own = [(100 + i, f"word{chr(97 + i)} Zorblax {between.format(i)}zor@blax.org about {chr(97 + i) * 4}") for i in range(5)]
        found = dict(got(spark, filler + own + [(200, "then Zorblax came")]))
        assert found[200] == "term:5:12", between
    many = [(300, "1.1.1.1, " * 20_000 + "end")]
    assert dict(got(spark, many))[300].count("ip:") == 20_000
