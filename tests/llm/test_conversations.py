"""Conversation repair against a shortest-path search over strings of edits, and its cases."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from leadloom.llm import conversations

WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
LEGAL = re.compile(r"(s?(ua)+)?\Z")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def cheapest(items):
    """items: (role, text, fault). (cost, audit, rows), by relaxing costs and audits from the end; the role initials so far are kept as prefixes of legal strings."""
    n = len(items)
    far = (10**9, "", ())

    def after(state, c):
        return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}.get((state, c)) if c else state

    best = {(n, s): ((0, "", ()) if s in ("", "a") else far) for s in ("", "s", "u", "a")}
    for i in range(n, -1, -1):
        for s in ("", "s", "u", "a"):
            best.setdefault((i, s), far)
            if i < n:
                role, text, fault = items[i]
                late = 3 if fault == "truncated" else 0
                moves = [(4, "D", s, ())]
                if fault not in ("blank", "duplicate"):
                    moves += [(late, "K", after(s, role[:1]), ((role, text),))]
                    moves += [(3 + late, "R", after(s, r[0]), ((r, text),)) for r in ("user", "assistant")]
                for cost, e, to, rows in moves:
                    if to is not None and best[i + 1, to][0] < 10**9:
                        c, audit, rest = best[i + 1, to]
                        best[i, s] = min(best[i, s], (c + cost, e + audit, rows + rest))
        for _ in range(4):
            for s in ("", "s", "u", "a"):
                for r in ("user", "assistant"):
                    if (to := after(s, r[0])) is not None and best[i, to][0] < 10**9:
                        c, audit, rest = best[i, to]
                        best[i, s] = min(best[i, s], (c + 3, "I" + audit, ((r, ""),) + rest))
    return best[0, ""]


def expected(rows):
    by = defaultdict(list)
    for r in damaged(rows):
        by[r[0]].append(r)
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted(by[conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        turns = {r[1] for r in own} - {None}
        seen, items = set(), []
        for _, _, role, text in own:
            ink = text.strip(WHITE)
            fault = "blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else ""
            seen.add((role, text))
            items.append((role, text, fault))
        cost, audit, fixed = cheapest(items)
        assert LEGAL.match("".join(r[:1] for r, _ in fixed))
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(items))
        counts = [sum(f == k for *_, f in items) for k in ("blank", "duplicate", "truncated")]
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest()
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts, illegal, cost, audit, sha)
    return out


def got(spark, rows, **more):
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    return {r[0]: tuple(r[1:]) for r in conversations.report(df, **more).collect()}


def made(seed, n, longest):
    rnd = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rnd.randint(1, longest)):
            role = rnd.choice(["user", "assistant", "system", "user", "assistant", "tool", None, "", "a"])
            rows.append((conv if conv else None, turn if rnd.random() < 0.9 else None, role, rnd.choice(["One.", "Two", "Three!\n", " ", "", None, "What? ", "…", f"No {turn}.", f"Long {turn} " * 50])))
    return rows


@pytest.mark.parametrize("segment,fan", [(2048, 1024), (3, 2)])
def test_repair_equals_search(spark, segment, fan):
    rows = made(5, 60, 25)
    assert got(spark, rows, segment=segment, fan=fan) == expected(rows)


def test_one_conversation_holds_most_rows(spark):
    rows = made(7, 1, 2) + [(9, t, ["user", "assistant", "user", "system"][t * 7 % 4], f"Text {t % 800}{'.' * (t % 3)}") for t in range(900)]
    assert got(spark, rows, segment=16, fan=4) == expected(rows)


def test_hirschberg_is_least(spark):
    rnd = random.Random(3)
    roles = {"s": "system", "u": "user", "a": "assistant", "": "", "?": "?"}
    faults = ["", "blank", "duplicate", "truncated"]
    for _ in range(400):
        symbols = [rnd.randrange(20) for _ in range(rnd.randrange(12))]
        edits, state = conversations.hirschberg(symbols, 0, len(symbols), 0, conversations.AT_END)
        items = [(roles[conversations.INITIALS[s // 4]], "x", faults[s % 4]) for s in symbols]
        assert "".join(edits) + conversations.ending(state) == cheapest(items)[1]


def test_cases(spark):
    none = hashlib.sha256(b"").hexdigest()
    assert got(spark, []) == {}
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert got(spark, [(dropped, 0, "user", "Hi.")]) == {dropped: (0, 0, 0, 0, 0, 0, "", none)}
    plain = next(c for c in range(1000) if all(zlib.crc32(f"{c}:{t}".encode()) % 20 > 4 for t in (0, 1)))
    long = "word " * 400_000 + "."
    rows = [(plain, 0, "user", long), (plain, 1, "assistant", "Yes.")]
    assert got(spark, rows)[plain] == (0, 0, 0, 0, 0, 0, "KK", hashlib.sha256(f"user:{long}\nassistant:Yes.".encode()).hexdigest())
    df = spark.createDataFrame([(plain, 0, "user", "A.", "z", 1), (plain, 1, "assistant", "B.", "z", 2)], "conv_id bigint, turn bigint, role string, text string, Rank string, conv int")
    fixed = conversations.repaired_rows(conversations.repair(df))
    assert [tuple(r) for r in fixed.orderBy("rank", "place").collect()] == [(plain, 1, 0, "user", "A."), (plain, 2, 0, "assistant", "B.")]
