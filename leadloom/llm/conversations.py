"""Conversation structure repair: the cheapest edits after which the roles alternate, found by Hirschberg's divide and conquer.

A conversation's rows, in order, are read by an automaton of four states: nothing yet, after the system row, after a user row, after an assistant
row; it may end in the first and the last. A row is kept, re-roled or deleted; rows may be inserted before it. The least costs of getting from state to
state over a row form a 4x4 matrix, and these matrices compose by (min, +). Reconstruction: the forward cost vector from the start and the backward
cost vector from the end meet in the middle row; among the crossing states of least total the one with the least audit is taken (a backward sweep
over the left half, which carries for each state the crossing that its least edits lead to, settles ties), and both halves are solved alike. Only
vectors of four are held beside the output.

A conversation of any length is cut into segments of SEGMENT rows. Their matrices are composed in groups of FAN, level by level, so that no task
holds more than FAN of them; on the way down each segment gets the costs from its end to the conversation's end, and then, since the least edits
lead from each of four states to one state, the functions of the segments are composed in the same way and give each segment its first state.
Segments are then reconstructed independently of each other.

Edits are K (keep, 0), R (re-role to user or assistant, 3), D (delete, 4; the only edit of a blank or repeated row) and I (insert an empty user or
assistant row, 3); a truncated row that stays adds 3. Of edits of equal cost the least string of initials is taken.

Cases: null roles and texts count as one space, a null conversation id is a conversation of its own, null turns come first; rows of equal turn are ordered by role
and text; a role whose first letter is none of s, u, a can't be kept, an empty role has no letter and can; an empty table gives an empty table; other columns,
whatever their names, are not read.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions.lineage import global_rank

from .common import cut, drop_cut, join_checked, small_batches, sql_type

#: Rows of a segment, and segments that are composed at once.
SEGMENT, FAN = 2048, 1024
COSTS = {"K": 0, "R": 3, "D": 4, "I": 3}
TRUNCATED_COST = 3
#: A character that isn't white space, and what a finished text ends with.
INK, FINISHED = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"
NO_FAULT, BLANK, DUPLICATE, TRUNCATED = range(4)
# States, and what the letters s, u, a lead to from them (-1: nowhere)
START, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT = range(4)
NEXT = {"s": (AFTER_SYSTEM, -1, -1, -1), "u": (AFTER_USER, AFTER_USER, -1, AFTER_USER), "a": (-1, -1, AFTER_ASSISTANT, -1), "": (0, 1, 2, 3), "?": (-1, -1, -1, -1)}
INITIALS = ("s", "u", "a", "", "?")
FAR = 1 << 60
ROLES = {"u": "user", "a": "assistant"}
Vector = list[int]


def damage(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) with nulls of role and text as one space, damaged by crc32 of "conv_id:turn" modulo 20."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind = F.crc32(key.cast("binary")) % 20
    filled = rows.select("conv_id", "turn", *(F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")), kind.alias("_kind")).where("_kind != 0")
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy")
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    return filled.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies).drop("_copy")


def initial(role: Column) -> Column:
    return F.substring(role, 1, 1)


# ---- the automaton -------------------------------------------------------------------------------------------------------------------------------


def _after_inserts(state: int) -> Iterator[tuple[int, str, int]]:
    """States reached by inserting no row, one, or more, until a state repeats."""
    cost, edits, seen = 0, "", set()
    while state not in seen:
        seen.add(state)
        yield state, edits, cost
        to = AFTER_ASSISTANT if state == AFTER_USER else AFTER_USER
        state, edits, cost = to, edits + "I", cost + COSTS["I"]


@functools.cache
def steps(symbol: int) -> tuple[tuple[tuple[int, str], ...], ...]:
    """By state before and state after a row of this symbol (initial and fault): the least cost and, of that cost, the least edits."""
    letter, fault = INITIALS[symbol // 4], symbol % 4
    stays = TRUNCATED_COST if fault == TRUNCATED else 0
    best = [[(FAR, "")] * 4 for _ in range(4)]
    for state in range(4):
        for at, edits, cost in _after_inserts(state):
            ends = [("D", at, COSTS["D"])]
            if fault not in (BLANK, DUPLICATE):
                ends += [("K", NEXT[letter][at], stays)] + [("R", NEXT[x][at], COSTS["R"] + stays) for x in "ua"]
            for edit, to, more in ends:
                if to >= 0:
                    best[state][to] = min(best[state][to], (cost + more, edits + edit))
    return tuple(map(tuple, best))


def ending(state: int) -> str:
    """The inserts that end a conversation in this state."""
    return {START: "", AFTER_ASSISTANT: "", AFTER_USER: "I", AFTER_SYSTEM: "II"}[state]


#: Costs from each state to the end when no row is left.
AT_END: Vector = [len(ending(s)) * COSTS["I"] for s in range(4)]


@functools.cache
def matrix(symbol: int) -> tuple[tuple[int, ...], ...]:
    return tuple(tuple(cost for cost, _ in row) for row in steps(symbol))


def forward(symbols: Sequence[int], lo: int, hi: int, vector: Vector) -> Vector:
    for i in range(lo, hi):
        m = matrix(symbols[i])
        vector = [min(vector[p] + m[p][q] for p in range(4)) for q in range(4)]
    return vector


def backward(symbols: Sequence[int], lo: int, hi: int, vector: Vector) -> Vector:
    for i in range(hi - 1, lo - 1, -1):
        vector = before(matrix(symbols[i]), vector)
    return vector


def before(m: Sequence[Sequence[int]], vector: Vector) -> Vector:
    """Costs from before a row or segment, given those from after it."""
    return [min(m[p][q] + vector[q] for q in range(4)) for p in range(4)]


def one_step(symbol: int, state: int, vector: Vector) -> tuple[str, int]:
    """The least of the cheapest edits of a row, given the costs after it, and the state they lead to. No edits of a row begin with another's, so the least of a row is the least of all."""
    found = steps(symbol)[state]
    least = min(found[q][0] + vector[q] for q in range(4))
    return min((found[q][1], q) for q in range(4) if found[q][0] + vector[q] == least)


def crossing(symbols: Sequence[int], lo: int, hi: int, vector: Vector, which: Sequence[int] = range(4)) -> list[int]:
    """For each state before row lo, the state that the least of the cheapest edits lead to before row hi, given the costs from there."""
    leads = list(range(4))
    for i in range(hi - 1, lo - 1, -1):
        leads = [leads[one_step(symbols[i], p, vector)[1]] for p in range(4)]
        vector = before(matrix(symbols[i]), vector)
    return leads


def hirschberg(symbols: Sequence[int], lo: int, hi: int, state: int, vector: Vector) -> tuple[list[str], int]:
    """The edits of each row from lo to hi, from a state and given the costs from hi on, and the state they lead to."""
    if hi == lo:
        return [], state
    if hi - lo == 1:
        edits, to = one_step(symbols[lo], state, vector)
        return [edits], to
    mid = (lo + hi) // 2
    from_start = [FAR] * 4
    from_start[state] = 0
    left, right = forward(symbols, lo, mid, from_start), backward(symbols, mid, hi, vector)
    total = [a + b for a, b in zip(left, right, strict=True)]
    meet = [q for q in range(4) if total[q] == min(total)]
    if len(meet) == 1:
        only = [FAR] * 4
        only[meet[0]] = right[meet[0]]
    else:
        only = [FAR] * 4
        q = crossing(symbols, lo, mid, right)[state]
        only[q] = right[q]
    head, at = hirschberg(symbols, lo, mid, state, only)
    tail, to = hirschberg(symbols, mid, hi, at, vector)
    return head + tail, to


# ---- segments ------------------------------------------------------------------------------------------------------------------------------------


def _mapped(df: DataFrame, schema: str, work) -> DataFrame:
    """One Arrow pass; work takes a row's values in df's order and gives the values of the new row."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kind = _parse_datatype_string(schema)
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        want = to_arrow_schema(kind)
        for batch in batches:
            rows = [work(*x) for x in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(want)], schema=want)

    return df.mapInArrow(run, kind)


def _matrix(symbols: Sequence[int]) -> list[int]:
    out = []
    for p in range(4):
        start = [FAR] * 4
        start[p] = 0
        out += [min(x, FAR) for x in forward(symbols, 0, len(symbols), start)]
    return out


def _rows4(flat: Sequence[int]) -> list[Sequence[int]]:
    return [flat[4 * p : 4 * p + 4] for p in range(4)]


def _product(matrices: Sequence[Sequence[int]]) -> list[int]:
    out = _rows4(matrices[0])
    for m in map(_rows4, matrices[1:]):
        out = [[min(row[k] + m[k][q] for k in range(4)) for q in range(4)] for row in out]
    return [min(x, FAR) for row in out for x in row]


def _suffixes(items: Sequence[Sequence[int]], last: Vector) -> list[Vector]:
    """Costs after each of the matrices, given those after the last."""
    out = []
    for m in reversed(items):
        out.append(last)
        last = before(_rows4(m), last)
    return out[::-1]


def _chained(items: Sequence[Sequence[int]]) -> list[int]:
    """The function of state that a chain of functions is."""
    return [functools.reduce(lambda at, f: f[at], items, p) for p in range(4)]


def _starts(items: Sequence[Sequence[int]], first: int) -> list[int]:
    return list(itertools.accumulate(items[:-1], lambda at, f: f[at], initial=first))


def _scan(nodes: DataFrame, width: str, join, spread, root, fan: int, name: str) -> tuple[DataFrame, list[DataFrame]]:
    """Compose `value` of the nodes (conv, at: 0, 1, … per conversation) in groups of `fan` until one is left per conversation; hand root down again; every node gets `got`."""
    written, levels = [], [nodes]
    while (levels[-1].agg(F.max("at")).first()[0] or 0) > 0:
        up = levels[-1].groupBy("conv", F.floor(F.col("at") / fan).cast("bigint").alias("up")).agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("g"))
        parent = _mapped(up.select("conv", "up", "g.value"), f"conv {sql_type(nodes, 'conv')}, at bigint, value array<bigint>", lambda conv, at, values: (conv, at, join(values)))
        levels.append(cut(parent, name))
        written.append(levels[-1])
    got = levels[-1].select("conv", "at", F.lit(root).cast(width).alias("got"))
    for level in levels[-2::-1]:
        kids = level.groupBy("conv", F.floor(F.col("at") / fan).cast("bigint").alias("up")).agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("g"))
        pairs = kids.alias("k").join(got.alias("p"), F.col("k.conv").eqNullSafe(F.col("p.conv")) & (F.col("k.up") == F.col("p.at"))).select("k.conv", F.col("k.g.at").alias("ats"), F.col("k.g.value").alias("values"), "p.got")
        listed = _mapped(pairs, f"conv {sql_type(nodes, 'conv')}, ats array<bigint>, gots array<{width}>", lambda conv, ats, values, top: (conv, ats, spread(values, top)))
        got = cut(listed.select("conv", F.explode(F.arrays_zip("ats", "gots")).alias("x")).select("conv", F.col("x.ats").alias("at"), F.col("x.gots").alias("got")), name)
        written.append(got)
    return got, written


def solve(segments: DataFrame, fan: int = FAN) -> DataFrame:
    """Per segment (seg, conv, symbols): `edits`, the edits of each of its rows; a conversation's last has its ending inserts behind.

    Segments of a conversation are numbered by seg. Most conversations are one segment and are solved at once; only the others are composed.
    """
    several = segments.groupBy("conv").agg(F.count(F.lit(1)).alias("n"), F.max("seg").alias("last")).where("n > 1")
    cut_several = cut(several, "conv-several")
    long = segments.join(F.broadcast(cut_several) if cut_several.count() <= 100_000 else cut_several, segments["conv"].eqNullSafe(cut_several["conv"])).select("seg", segments["conv"], "symbols")
    numbered = cut(_numbered(long), "conv-long")
    matrices = cut(_mapped(numbered.select("conv", "at", "symbols"), f"conv {sql_type(segments, 'conv')}, at bigint, value array<bigint>", lambda conv, at, symbols: (conv, at, _matrix(symbols))), "conv-matrices")
    after, w1 = _scan(matrices, "array<bigint>", _product, _suffixes, F.array(*map(F.lit, AT_END)), fan, "conv-costs")
    both = numbered.alias("n").join(after.alias("x"), F.col("n.conv").eqNullSafe(F.col("x.conv")) & (F.col("n.at") == F.col("x.at"))).select("n.conv", "n.at", "n.symbols", "x.got")
    leads = cut(_mapped(both, f"conv {sql_type(segments, 'conv')}, at bigint, value array<bigint>", lambda conv, at, symbols, costs: (conv, at, crossing(symbols, 0, len(symbols), costs))), "conv-leads")
    starts, w2 = _scan(leads, "bigint", _chained, _starts, F.lit(START), fan, "conv-starts")
    at = lambda a, b: F.col(f"{a}.conv").eqNullSafe(F.col(f"{b}.conv")) & (F.col(f"{a}.at") == F.col(f"{b}.at"))
    ends = numbered.alias("n").join(after.alias("x"), at("n", "x")).join(starts.alias("s"), at("n", "s")).join(cut_several.alias("c"), F.col("n.conv").eqNullSafe(F.col("c.conv")))
    known = cut(ends.select("n.seg", F.col("x.got").alias("costs"), F.col("s.got").alias("start"), (F.col("n.seg") == F.col("c.last")).alias("ends")), "conv-ends")
    drop_cut(numbered, matrices, leads, cut_several, *w1, *w2)

    def work(seg, symbols, costs, start, ends):
        edits, state = hirschberg(symbols, 0, len(symbols), START if start is None else start, costs or AT_END)
        return seg, edits, ending(state) if ends in (None, True) else ""

    return _mapped(join_checked(segments, known, ["seg"], "left").select("seg", "symbols", "costs", "start", "ends"), "seg bigint, edits array<string>, ending string", work)


def _numbered(long: DataFrame) -> DataFrame:
    """Number the segments of each conversation from 0: by the global rank of a segment less the least of its conversation."""
    ranked = global_rank(long, [F.col("conv"), F.col("seg")], "at")
    least = ranked.groupBy("conv").agg(F.min("at").alias("least"))
    return ranked.alias("r").join(least.alias("l"), F.col("r.conv").eqNullSafe(F.col("l.conv"))).select("r.seg", "r.conv", "r.symbols", (F.col("r.at") - F.col("l.least")).alias("at"))


def diagnose(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Per row: conv, rank (its place among all rows by conversation and turn), turn, role, text, fault (0 none, 1 blank, 2 duplicate, 3 truncated). Written below the shared folder."""
    filled = [F.coalesce(F.col(f"`{c}`"), F.lit(" ")) for c in (role_col, text_col)]
    plain = rows.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").alias("turn"), filled[0].alias("role"), filled[1].alias("text"))
    ranked = global_rank(plain, [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")], "rank")
    said = F.sha2(F.concat_ws(":", F.hex("role"), "text"), 256)
    named = cut(ranked.select("conv", "rank", "turn", "role", "text", F.when(F.col("text").rlike(INK), said).alias("said")), "conv-rows")
    # Most pairs of role and text occur once; only those that are repeated are joined.
    firsts = cut(named.where("said IS NOT NULL").groupBy("conv", "said").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("conv").alias("c"), F.col("said").alias("s"), "first"), "conv-repeats")
    small = firsts.count() <= 50_000
    found = named.join(F.broadcast(firsts) if small else firsts, (F.col("said") == F.col("s")) & F.col("conv").eqNullSafe(F.col("c")), "left")
    fault = F.when(F.col("said").isNull(), BLANK).when(F.col("rank") > F.col("first"), DUPLICATE).when(~F.col("text").rlike(FINISHED), TRUNCATED).otherwise(NO_FAULT)
    out = cut(found.select("conv", "rank", "turn", "role", "text", fault.alias("fault")), "conv-faults")
    drop_cut(named, firsts)
    return out


def segments_of(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Rows of `diagnose` as segments: seg (the first rank), conv, symbols."""
    letter = F.when(F.col("role") == "", 3).otherwise(F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in zip("sua", range(3), strict=True) for x in kv)), initial(F.col("role"))), F.lit(4)))
    block = F.floor((F.col("rank") - 1) / segment)
    grouped = rows.groupBy("conv", block.alias("block")).agg(F.min("rank").alias("seg"), F.sort_array(F.collect_list(F.struct("rank", (letter * 4 + F.col("fault")).cast("int").alias("symbol")))).alias("g"))
    return grouped.select("seg", "conv", F.col("g.symbol").alias("symbols"))


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", segment: int = SEGMENT, fan: int = FAN) -> DataFrame:
    """Per row of rows: conv, rank, turn, role, text, fault, its edits (inserts before it, then K, R or D) and, at a conversation's last row, the inserts behind it (`ending`)."""
    found = diagnose(rows, conv_col, turn_col, role_col, text_col)
    segments = cut(segments_of(found, segment), "conv-segments")
    solved = solve(segments, fan)
    edits = solved.select("seg", "ending", F.size("edits").alias("n"), F.posexplode("edits").alias("i", "edits"))
    edits = edits.select((F.col("seg") + F.col("i")).alias("rank"), "edits", F.when(F.col("i") == F.col("n") - 1, F.col("ending")).otherwise("").alias("ending"))
    return found.join(edits, "rank").select("conv", "rank", "turn", "role", "text", "fault", "edits", "ending")


def apply_edits(role: str, text: str, edits: str, state: str) -> tuple[list[tuple[str, str]], str]:
    """The repaired rows (role, text) of one row's edits after a row with initial `state`, and the initial of the last row now."""
    out = []
    for edit in edits:
        if edit == "K":
            out.append((role, text))
        elif edit != "D":
            out.append((ROLES["a" if state == "u" else "u"], "" if edit == "I" else text))
        if edit != "D":
            state = out[-1][0][:1] or state
    return out, state


def repaired_rows(repairs: DataFrame) -> DataFrame:
    """The conversations as repaired: conv, rank (of the row that it stands at), place among the rows there, role, text.

    A row's role follows from the letter before it, so the rows of a conversation are read in order; one row at a time is held.
    """
    kind = f"conv {sql_type(repairs, 'conv')}, rank bigint, place int, role string, text string"
    return _stream(repairs, kind, _Rows)


def digest(repairs: DataFrame) -> DataFrame:
    """Per conversation with rows: conv and the counts, cost, audit and SHA-256 of the contract, read in order; one row at a time is held, and the audit."""
    kind = f"conv {sql_type(repairs, 'conv')}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
    return _stream(repairs, kind, _Digest)


class _Rows:
    def __init__(self, conv):
        self.conv, self.state = conv, ""

    def add(self, rank, turn, role, text, fault, edits, ending):
        out, self.state = apply_edits(role, text, edits + ending, self.state)
        for i, (r, t) in enumerate(out):
            yield self.conv, rank, i, r, t

    def end(self):
        return iter(())


class _Digest:
    LEGAL = {"su", "ua", "au"}

    def __init__(self, conv):
        self.conv, self.state, self.audit, self.sha, self.any = conv, "", [], hashlib.sha256(), False
        self.faults, self.illegal, self.cost, self.previous = [0] * 4, 0, 0, None
        self.turns, self.least, self.last = 0, None, None

    def add(self, rank, turn, role, text, fault, edits, ending):
        if turn is not None and turn != self.last:
            self.turns, self.last = self.turns + 1, turn
            self.least = turn if self.least is None else self.least
        self.faults[fault] += 1
        self.illegal += self.previous is not None and self.previous + role[:1] not in self.LEGAL
        self.previous = role[:1]
        self.audit.append(edits + ending)
        self.cost += sum(COSTS[e] for e in edits + ending) + (TRUNCATED_COST if fault == TRUNCATED and "D" not in edits else 0)
        out, self.state = apply_edits(role, text, edits + ending, self.state)
        for r, t in out:
            self.sha.update((("\n" if self.any else "") + f"{r}:{t}").encode("utf-8", "surrogatepass"))
            self.any = True
        return iter(())

    def end(self):
        gaps = 0 if self.least is None else self.last - self.least + 1 - self.turns
        yield self.conv, gaps, *self.faults[1:], self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest()


def _stream(repairs: DataFrame, kind: str, reader: type) -> DataFrame:
    """Read each conversation's rows in order through a reader."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = _parse_datatype_string(kind)
    small_batches(repairs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        want, now, rows, size = to_arrow_schema(schema), None, [], 0
        full = lambda: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(want)], schema=want)
        for batch in batches:
            for conv, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or now.conv != conv:
                    rows += now.end() if now else ()
                    now = reader(conv)
                for new in now.add(*row):
                    rows.append(new)
                    size += len(new[-1])
                    if size > 1 << 20:
                        yield full()
                        rows, size = [], 0
            if rows:
                yield full()
                rows, size = [], 0
        if now:
            rows += now.end()
        if rows:
            yield full()

    ordered = repairs.select("conv", "rank", "turn", "role", "text", "fault", "edits", "ending").repartition("conv").sortWithinPartitions("conv", "rank")
    return ordered.mapInArrow(run, schema)


def report(rows: DataFrame, segment: int = SEGMENT, fan: int = FAN) -> DataFrame:
    """The contract's table for conversations: damaged, repaired, and one row for every conversation that there was; one without rows left has zeros, an empty audit and the hash of the empty string."""
    ids = rows.select("conv_id").distinct()
    done = digest(repair(damage(rows), segment=segment, fan=fan))
    out = ids.join(done, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
