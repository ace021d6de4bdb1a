"""Quality rules with cross-document line frequency.

One Arrow pass takes the figures of every whole text and the hashes of its normalised lines (trimmed, white space runs as one space,
A-Z lower-cased; lines without a word have none). Per host, the documents that hold a line are counted. A line is above its limit on a
host if it is in more than max(min_docs, max_share of the host's documents) of them; such lines are removed, and a document that loses more
than 1 - min_left of its words by this is depleted and rejected. `count` says what is counted: "documents" (each row), or "texts" (exact
copies of a text count once, for tables whose copies are still to be removed: then copies do not condemn a clean text).

The counts are aggregates with map-side combination. The verdict joins the lines above limits by a size-checked broadcast or by a shuffle
join of plain tables, whose hot keys AQE splits. clean() writes the rows once with the hashes of their lines; then a few lines above limits
are sent to the tasks once, more of them are joined to the rows' lines, and only those of its own lines come back to a row.

Cases: null text counts as empty (no words: base_failed); a null host is the host ''; repeated rows and rows without an id are judged row
by row; an empty table gives an empty table; a text without lines above limits is never depleted; columns of any other name are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import cut, drop_cut, is_small, join_checked, map_texts, slices, small_batches, sql_type

BLANKS = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
MIN_DOCS, MAX_SHARE, MIN_LEFT = 10, 0.01, 0.5
FIGURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeat_words(words: list[bytes]) -> int:
    """Words that stand in a 3-word window found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    index = {w: i for i, w in enumerate(set(words))}
    ids = np.fromiter(map(index.__getitem__, words), np.int64, n)
    k = len(index)
    pairs = np.unique(ids[:-1] * k + ids[1:], return_inverse=True)[1]
    _, inverse, counts = np.unique(pairs[:-1] * k + ids[2:], return_inverse=True, return_counts=True)
    again = counts[inverse] > 1
    inside = np.zeros(n, bool)
    for i in range(3):
        inside[i : n - 2 + i] |= again
    return int(inside.sum())


def line_hash(line: bytes) -> int | None:
    """The signed 64-bit hash of a line's normal form (None if it has no word)."""
    words = line.lower().split()
    return xxhash.xxh64_intdigest(b" ".join(words)) - (1 << 63) if words else None


def base_fails(n_words: int, n_repeat: int) -> bool:
    return n_words < 50 or 100 * n_repeat > 50 * n_words


def line_hashes(raw: bytes) -> tuple[list[int], list[int]]:
    """The hash (0 without a word) and the words of every \n-split line."""
    hashes, words = [], []
    for line in raw.split(b"\n"):
        own = line.lower().split()
        hashes.append(xxhash.xxh64_intdigest(b" ".join(own)) - (1 << 63) if own else 0)
        words.append(len(own))
    return hashes, words


def figures(text: str) -> tuple[int, int, int, int, int, dict[int, int]]:
    raw = text.encode()
    words = raw.split()
    seen: set[bytes] = set()
    lines: dict[int, int] = {}
    dup = 0
    for line in raw.split(b"\n"):
        own = line.split()
        if own:
            if line in seen:
                dup += 1
            seen.add(line)
            h = line_hash(line)
            lines[h] = lines.get(h, 0) + len(own)
    chars = len(text) - sum(map(text.count, BLANKS))
    return len(words), chars, sum(map(text.count, SYMBOLS)), dup, repeat_words(words), lines


def text_key(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode()) - (1 << 63)


def measure(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """Per row: its figures, a key of its text, and hashes and words of its distinct lines; `_row` names the row."""

    def make():
        def work(cols, texts):
            rows = [figures(t) for t in texts]
            out = {"doc_id": cols[0], "host": cols[1].cast("string").fill_null("")}
            out |= {k: [r[i] for r in rows] for i, k in enumerate(FIGURES)}
            return out | {
                "text_key": list(map(text_key, texts)),
                "hashes": [list(r[5]) for r in rows],
                "line_words": [list(r[5].values()) for r in rows],
            }

        return work

    schema = f"doc_id {sql_type(docs, id_col)}, host string, " + ", ".join(f"{k} bigint" for k in FIGURES) + ", text_key bigint, hashes array<bigint>, line_words array<bigint>"
    return map_texts(docs, [id_col, host_col, text_col], schema, make).withColumn("_row", F.monotonically_increasing_id())


def lines_above(measured: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, count: str = "documents") -> DataFrame:
    """(host, line) of the lines in too many documents (or distinct texts) of a host; measured has host, text_key and distinct hashes."""
    n = {"documents": F.count(F.lit(1)), "texts": F.countDistinct("text_key")}[count]
    per_line = measured.select("host", "text_key", F.explode("hashes").alias("line")).groupBy("host", "line").agg(n.alias("n"))
    per_host = measured.groupBy("host").agg(n.alias("docs"))
    few = per_line.where(F.col("n") > min_docs)
    return few.join(per_host, "host").where(F.col("n") > F.greatest(F.lit(float(min_docs)), F.col("docs") * max_share)).select("host", "line")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, min_left: float = MIN_LEFT, count: str = "documents") -> DataFrame:
    """Per row of docs: doc_id, its figures, base_failed, n_removed_words, kept."""
    measured = cut(measure(docs, id_col, text_col, host_col), "quality")
    above = cut(lines_above(measured, min_docs, max_share, count), "lines-above")
    lines = measured.select("_row", "host", F.explode(F.arrays_zip("hashes", "line_words")).alias("x")).select("_row", "host", F.col("x.hashes").alias("line"), F.col("x.line_words").alias("words"))
    removed = join_checked(lines, above, ["host", "line"], "left_semi").groupBy("_row").agg(F.sum("words").alias("n_removed_words"))
    out = measured.join(removed, "_row", "left").withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0)))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = out.withColumn("base_failed", failed)
    kept = ~F.col("base_failed") & (F.col("n_words") - F.col("n_removed_words") >= min_left * F.col("n_words"))
    return out.select("doc_id", *FIGURES, "base_failed", "n_removed_words", kept.alias("kept"))


def positions(docs: DataFrame) -> DataFrame:
    """docs with its columns named c0, c1 and so on, so that no name clashes with an operator's own."""
    return docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))


def with_lines(docs: DataFrame, text_col: str, host_col: str) -> DataFrame:
    """docs (columns c0 to cn) with host, text_key, lines and words of every line, failed; the text of a row that fails the base rules is null."""
    at, n = docs.columns.index(text_col), len(docs.columns)
    host = F.coalesce(F.col(f"c{docs.columns.index(host_col)}").cast("string"), F.lit(""))
    rows = positions(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.utf8_length(batch.column(at)), 0).to_pylist()
            for a, b in slices(sizes):
                part, failed, keys, lines, words = batch.slice(a, b - a), [], [], [], []
                texts = part.column(at).to_pylist()
                for text in texts:
                    raw = (text or "").encode()
                    every = raw.split()
                    failed.append(base_fails(len(every), repeat_words(every)))
                    h, w = line_hashes(raw)
                    keys.append(text_key(text or "")), lines.append(h), words.append(w)
                left = pa.array([None if f else t for f, t in zip(failed, texts, strict=True)], part.column(at).type)
                cells = [left if i == at else part.column(i) for i in range(n + 1)]
                cells += [pa.array(keys, pa.int64()), pa.array(lines, pa.list_(pa.int64())), pa.array(words, pa.list_(pa.int32())), pa.array(failed, pa.bool_())]
                yield pa.RecordBatch.from_arrays(cells, names=[*(f"c{i}" for i in range(n)), "host", "text_key", "lines", "words", "failed"])
        pa.default_memory_pool().release_unused()

    small_batches(docs.sparkSession)
    more = rows.select("*", host.alias("host"))
    kind = StructType([*more.schema.fields, *StructType.fromDDL("text_key bigint, lines array<bigint>, words array<int>, failed boolean").fields])
    return more.mapInArrow(run, kind).withColumn("_row", F.monotonically_increasing_id())


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, min_left: float = MIN_LEFT, count: str = "documents") -> DataFrame:
    """docs without rejected rows, and without the lines above limits in the texts that stay (all columns; others unchanged)."""
    rows = cut(with_lines(docs, text_col, host_col), "quality-rows")
    hashes = F.filter(F.array_distinct("lines"), lambda h: h != 0)
    above = cut(lines_above(rows.select("host", "text_key", hashes.alias("hashes")), min_docs, max_share, count), "lines-above")
    left = rows.where("not failed")
    if is_small(above):
        lists = {r.host: np.array(sorted(r.lines)) for r in above.groupBy("host").agg(F.collect_list("line").alias("lines")).collect()}  # its rows were counted
        return _without_lines(left.withColumn("bad", F.lit(None).cast("array<bigint>")), docs, text_col, min_left, lists)
    each = left.select("_row", "host", F.explode(hashes).alias("line"))
    own = each.join(above, ["host", "line"], "left_semi").groupBy("_row").agg(F.collect_set("line").alias("bad"))
    return _without_lines(left.join(own, "_row", "left"), docs, text_col, min_left, {})


def _without_lines(rows: DataFrame, docs: DataFrame, text_col: str, min_left: float, lists: dict[str, np.ndarray]) -> DataFrame:
    """rows of with_lines() without the lines of `lists` by host and of the row's own array `bad`; depleted rows go."""
    columns = docs.columns
    at, n = columns.index(text_col), len(columns)
    sent = docs.sparkSession.sparkContext.broadcast(lists)  # BROADCAST_ROWS lines at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_host = sent.value
        for batch in batches:
            hosts, lines, words, bads = (batch.column(n + i) for i in range(4))
            for a, b in slices(pc.fill_null(pc.utf8_length(batch.column(at)), 0).to_pylist()):
                keep, new = [], []  # a text, or None for the row's own
                for i in range(a, b):
                    bad = bads[i].values.to_numpy() if bads[i].is_valid else by_host.get(hosts[i].as_py())
                    gone = None if bad is None else np.isin(lines[i].values.to_numpy(), bad)
                    if gone is None or not gone.any():
                        keep.append(True), new.append(None)
                        continue
                    own = words[i].values.to_numpy()
                    keep.append(bool(own[~gone].sum() >= min_left * own.sum()))
                    new.append("\n".join(x for x, g in zip(batch.column(at)[i].as_py().split("\n"), gone, strict=True) if not g) if keep[-1] else None)
                part = batch.slice(a, b - a)
                if any(x is not None for x in new):
                    old = part.column(at).to_pylist()
                    new = pa.array([o if x is None else x for x, o in zip(new, old, strict=True)], part.column(at).type)
                else:
                    new = part.column(at)
                part = pa.RecordBatch.from_arrays([new if i == at else part.column(i) for i in range(n)], names=columns)
                yield part.filter(pa.array(keep, pa.bool_()))
        pa.default_memory_pool().release_unused()

    small_batches(docs.sparkSession)
    return rows.select(*(f"c{i}" for i in range(n)), "host", "lines", "words", "bad").mapInArrow(run, docs.schema)


#: The same in SQL for DuckDB.
ORACLE = r"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text, coalesce(source, '') as host from documents),
w as (select r, unnest(x) as word, generate_subscripts(x, 1) as i from (select r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as x from d)),
wc as (select r, count(*) as n_words, sum(length(word)) as word_chars from w group by r),
tri as (select r, i, word as a, lead(word) over (partition by r order by i) as b, lead(word, 2) over (partition by r order by i) as c from w),
again as (select r, i from (select r, i, count(*) over (partition by r, a, b, c) as k from tri where c is not null) where k > 1),
rep as (select r, count(distinct i + o) as n_repeat_words from again, (values (0), (1), (2)) t(o) group by r),
l as (select r, host, text, unnest(string_split(text, chr(10))) as line from d),
lw as (select r, host, text, line, lower_az, n from (select *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as n,
    array_to_string(regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ' ') as lower_az from l) where n > 0),
dup as (select r, count(*) - count(distinct line) as n_dup_lines from lw group by r),
hosts as (select host, count(*) as docs from d group by host),
above as (select host, lower_az from lw join hosts using (host) group by host, lower_az having count(distinct r) > greatest(10.0, 0.01 * any_value(docs))),
gone as (select r, sum(n) as n_removed_words from lw semi join above using (host, lower_az) group by r),
f as (select d.doc_id, coalesce(n_words, 0)::bigint as n_words, coalesce(word_chars, 0)::bigint as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, coalesce(n_dup_lines, 0)::bigint as n_dup_lines,
    coalesce(n_repeat_words, 0)::bigint as n_repeat_words, coalesce(n_removed_words, 0)::bigint as n_removed_words
  from d left join wc using (r) left join rep using (r) left join dup using (r) left join gone using (r))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_removed_words,
  n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and n_words - n_removed_words >= 0.5 * n_words as kept from f
"""
