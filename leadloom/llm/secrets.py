"""Secret scans: patterns propose candidates, a random forest removes the false positives.

Candidates are values assigned to a name, and long tokens with a digit or a change of case inside. Each gets features of its length, its
character transitions (mean log-probability under the character pairs of the corpus dictionary, changes of class), its
coverage by dictionary words, its path (the source of the text) and the words beside it. The dictionary holds the words of 3 to 8
letters that make up WORD_SHARE or more of all such words of the corpus, so there are 1 / WORD_SHARE of them at most, however large the corpus.

The forest is trained from labelled findings: any table of (value, path, left, right, label) will do; by default labelled_findings(),
a set of LABELLED findings made by stated rules (known shapes of secrets beside names of secrets; digests, identifiers, numbers,
words beside harmless words; placeholders and names of variables). Scores are computed for every candidate of the whole corpus.

Cases: null text has no candidates; a null path is the path ''; repeated rows are scanned row by row; an empty table gives an empty
table; without any dictionary word coverage is 0; columns of any other name are left alone.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop_cut, fresh, join_checked, map_texts, small_batches, sql_type
from .pii import redacted

WORD_SHARE, LABELLED, TREES, DEPTH, THRESHOLD = 1e-5, 4000, 20, 8, 0.5
BESIDE = 80

#: Names of secrets, words beside harmless tokens, parts of paths of tests and of settings, placeholders.
SECRET_WORDS = "token secret password passwd pwd apikey api_key access_key private_key auth credential bearer client_secret signing_key".split()
HARMLESS_WORDS = "sha sha1 sha256 md5 commit digest checksum hash etag uuid guid id isbn revision integrity build version order invoice phone example sample dummy placeholder".split()
TEST_PATHS = "test spec fixture example sample mock doc lock".split()
SETTING_PATHS = "env config settings properties yml yaml json secrets credentials".split()
PLACEHOLDERS = "example changeme placeholder your_ your- insert_ insert- _here -here xxxx dummy sample todo redacted".split()
#: Signs around the name of a variable that stands in for a value.
REFERENCES = [("${", "}"), ("$(", ")"), ("{{", "}}"), ("<", ">"), ("%", "%")]

ASSIGNED = re.compile(r"""(?i)[\w.-]{0,40}(?:token|secret|passw(?:or)?d|pwd|api_?key|access_?key|private_?key|auth|credential)[\w.-]{0,20}["']?\s{0,3}(?::=|=>|[:=])\s{0,3}(["'`]?)([^\s"'`,;]{8,})\1""")
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_=.-]{16,}")
MIXED = re.compile(r"[0-9]|[a-z][A-Z]")
#: What a text must hold for the two patterns to find anything.
NAMED = ["token", "secret", "passw", "pwd", "key", "auth", "credential"]
DIGIT, CAMEL = re.compile("[0-9]"), re.compile("[a-z][A-Z]")
NAMES = ["length", "digits", "upper", "symbols", "changes", "transition", "coverage", "variety", "hex", "secret_near", "assigned", "quoted", "harmless_near", "test_path", "setting_path", "placeholder", "reference"]


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans of candidate values, in order, without overlaps (assigned values first)."""
    low = text.lower()
    found = [m.span(2) for m in ASSIGNED.finditer(text)] if any(w in low for w in NAMED) else []
    taken = sorted(found)
    for m in TOKEN.finditer(text) if DIGIT.search(text) or CAMEL.search(text) else ():
        a, b = m.start(), m.start() + len(m.group().rstrip(".-="))
        if b - a >= 16 and MIXED.search(text, a, b) and not any(x < b and a < y for x, y in _around(taken, a)):
            found.append((a, b))
    return sorted(found)


def _around(taken: list[tuple[int, int]], at: int) -> list[tuple[int, int]]:
    from bisect import bisect

    i = bisect(taken, (at, 0))
    return taken[max(0, i - 1) : i + 2]


class Lexicon:
    """Dictionary words and the character pairs that their counts give."""

    def __init__(self, counts: dict[str, int]):
        self.words = frozenset(counts)
        pairs, ones = Counter(), Counter()
        for w, n in counts.items():
            for a, b in zip(w, w[1:], strict=False):
                pairs[a + b] += n
                ones[a] += n
        self.log = {p: math.log((n + 0.5) / (ones[p[0]] + 350.0)) for p, n in pairs.items()}
        self.unseen = math.log(1e-5)

    def transition(self, value: str) -> float:
        v = value.lower()
        return sum(self.log.get(v[i : i + 2], self.unseen) for i in range(len(v) - 1)) / max(1, len(v) - 1)

    def coverage(self, value: str) -> float:
        v, i, hit = value.lower(), 0, 0
        while i < len(v):
            for k in range(8, 2, -1):
                if v[i : i + k] in self.words:
                    hit, i = hit + len(v[i : i + k]), i + k
                    break
            else:
                i += 1
        return hit / max(1, len(v))


def features(value: str, path: str, left: str, right: str, lexicon: Lexicon) -> list[float]:
    n = max(1, len(value))
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.isalpha() else "s" for c in value]
    near = re.findall(r"[a-z_0-9]+", f"{left[-40:]} {right[:20]}".lower())
    low, where = value.lower(), path.lower()
    has = lambda words: float(any(w in x for x in near for w in words))
    return [
        float(min(len(value), 1000)), kinds.count("d") / n, kinds.count("u") / n, kinds.count("s") / n,
        sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n, lexicon.transition(value), lexicon.coverage(value), len(set(low)) / min(n, 36),
        float(re.fullmatch(r"[0-9a-f]+", low) is not None), has(SECRET_WORDS), float(re.search(r"[:=]\s*[\"'`]?$", left) is not None), float(left[-1:] in "\"'`" and left != ""),
        float(any(w in HARMLESS_WORDS for w in near)), float(any(w in where for w in TEST_PATHS)), float(any(w in where for w in SETTING_PATHS)), float(any(w in low for w in PLACEHOLDERS)),
        float(any(value.startswith(a) and value.endswith(b) for a, b in REFERENCES)),
    ]


def dictionary(docs: DataFrame, text_col: str = "text", share: float = WORD_SHARE) -> dict[str, int]:
    """The words of 3 to 8 letters that make up `share` or more of all, with their counts: 1 / share of them at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            short = {w: n for w, n in counts.items() if 3 <= len(w) <= 8 and w.isalpha()}
            counts.clear()
            return pa.RecordBatch.from_pydict({"word": pa.array(short.keys(), pa.string()), "n": pa.array(short.values(), pa.int64())})

        for b in batches:
            for t in b.column(0):
                counts.update((t.as_py() or "").lower().split())
                if len(counts) > 100_000:
                    yield out()
        yield out()

    small_batches(docs.sparkSession)
    counts = cut(docs.select(F.col(f"`{text_col}`")).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    return {r.word: r.n for r in counts.where(F.col("n") >= max(2.0, share * total)).collect()}


def labelled_findings(words: list[str], n: int = LABELLED, seed: int = 7) -> list[tuple[str, str, str, str, int]]:
    """(value, path, left, right, label) by stated rules; `words` fill the sentences around."""
    r = random.Random(seed)
    words = words or ["some", "text"]
    text = lambda k: " ".join(r.choice(words) for _ in range(k))
    chars = lambda alphabet, k: "".join(r.choice(alphabet) for _ in range(k))
    hexa, base = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    shapes = [
        lambda: chars(hexa, r.choice([32, 40, 48, 64])), lambda: chars(base, r.randint(20, 64)), lambda: chars(base + "+/", 40), lambda: "AKIA" + chars(base[:26] + base[52:], 16),
        lambda: "ghp_" + chars(base, 36), lambda: "sk_live_" + chars(base, 24), lambda: f"eyJ{chars(base, 20)}.{chars(base, 40)}.{chars(base, 43)}", lambda: chars(base + "!@#$%^&*", r.randint(10, 20)),
    ]
    harmless = [
        lambda: (f"{r.choice(['commit', 'sha1', 'checksum', 'digest'])} ", chars(hexa, r.choice([32, 40, 64]))),
        lambda: (f"{r.choice(['uuid', 'id'])}: ", "-".join(chars(hexa, k) for k in (8, 4, 4, 4, 12))),
        lambda: (text(1) + " ", chars("0123456789", r.randint(16, 24))),
        lambda: (text(1) + " ", "".join(r.choice(words) for _ in range(r.randint(3, 7))) + r.choice(["", "1", "22"])),
        lambda: (text(1) + " ", "".join(r.choice(words).capitalize() for _ in range(r.randint(3, 6)))),
        lambda: ("see ", "/".join(r.choice(words) for _ in range(r.randint(3, 6))) + f"/{r.randint(1, 99)}.html"),
        lambda: (f"{r.choice(SECRET_WORDS)} = \"", r.choice(["xxxxxxxxxxxxxxxx", "your_api_key_here1", "EXAMPLEKEY000000", "changeme-changeme1", "<placeholder-value-1>"])),
        lambda: (f"{r.choice(SECRET_WORDS)} = ", "".join(r.choice(words) for _ in range(3)) + "_" + r.choice(words)),
        lambda: ("at ", f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}T{r.randint(10, 23)}.{r.randint(10, 59)}.{r.randint(10, 59)}"),
    ]
    cased = lambda v: r.choice([v, v.upper(), v.capitalize()])
    assigned = lambda: r.choice(SECRET_WORDS) + r.choice([" = \"", "=", ": "])
    several = lambda sign: sign.join(r.choice(words) for _ in range(r.randint(1, 3)))
    enclosed = lambda v: v.join(r.choice(REFERENCES))
    stand_in = lambda sign: cased(sign.join([r.choice(["your", "insert", "example", "sample", "dummy", "my"]), several(sign), r.choice(["here", "value", "key", "1", "123"])]))
    harmless += [
        lambda: (assigned(), enclosed(several("_"))),
        lambda: (assigned(), enclosed(cased(several("_")))),
        lambda: (assigned(), stand_in(r.choice("_-"))),
    ]
    out = []
    for i in range(n):
        path = r.choice(["", f"src{r.randint(0, 99)}", "config.yml", ".env", "tests/fixture.json", "docs/readme", "package-lock.json"])
        if i % 2:
            name = r.choice(SECRET_WORDS)
            left = f"{text(6)} " + r.choice([f'{name} = "', f"{name}: ", f"{name}='", f'"{name}": "', f"{name.upper()}="])
            out.append((r.choice(shapes)(), path, left, f'" {text(6)}', 1))
        else:
            before, value = r.choice(harmless)()
            out.append((value, path, f"{text(6)} {before}", f" {text(6)}", 0))
    return out


def train(spark: SparkSession, lexicon: Lexicon, labelled: list[tuple[str, str, str, str, int]]) -> RandomForestClassificationModel:
    rows = [(features(v, p, a, b, lexicon), float(y)) for v, p, a, b, y in labelled]
    table = spark.createDataFrame(rows, "x array<double>, label double").select(array_to_vector("x").alias("features"), "label").coalesce(2).cache()
    model = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=7).fit(table)
    table.unpersist()
    return model


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", labelled: list[tuple[str, str, str, str, int]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Per candidate of docs: doc_id, start, end (code points, end exclusive), score, is_secret."""
    spark = docs.sparkSession
    counts = dictionary(docs, text_col)
    lexicon = Lexicon(counts)
    model = train(spark, lexicon, labelled_findings(sorted(counts)[:2000]) if labelled is None else labelled)
    sent = spark.sparkContext.broadcast(lexicon)  # 1 / WORD_SHARE words at most

    def make():
        def work(cols, texts):
            paths = cols[1].cast("string").fill_null("").to_pylist()
            index, start, end, x = [], [], [], []
            for i, (t, p) in enumerate(zip(texts, paths, strict=True)):
                for a, b in candidates(t):
                    index.append(i), start.append(a), end.append(b)
                    x.append(features(t[a:b], p, t[max(0, a - BESIDE) : a], t[b : b + BESIDE], sent.value))
            return {"doc_id": cols[0].take(pa.array(index, pa.int64())), "start": start, "end": end, "x": x}

        return work

    schema = f"doc_id {sql_type(docs, id_col)}, start bigint, end bigint, x array<double>"
    found = map_texts(docs, [id_col, path_col, text_col], schema, make).withColumn("features", array_to_vector("x"))
    scored = model.transform(found)
    score = vector_to_array("probability")[1]
    return scored.select("doc_id", "start", "end", score.alias("score"), (score >= threshold).alias("is_secret"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", label: str = "[SECRET]") -> DataFrame:
    """docs with every secret in the texts replaced by a label (all rows and columns). Rows are told apart by a number that is written once."""
    row = fresh(docs, "_row")
    rows = cut(docs.withColumn(row, F.monotonically_increasing_id()), "secret-rows")
    hits = cut(scan(rows, row, text_col, path_col).where("is_secret").select(F.col("doc_id").alias(row), F.struct("start", F.lit(0).alias("rank"), "end").alias("s")), "secret-hits")
    name = fresh(rows, "_spans")
    spans = cut(hits.groupBy(row).agg(F.sort_array(F.collect_list("s")).alias(name)), "secret-spans")
    drop_cut(hits)
    text = F.col(f"`{text_col}`")
    new = F.when(F.col(name).isNull(), text).otherwise(redacted(text, F.col(name), F.array(F.lit(label))))
    return join_checked(rows, spans, [row], "left").select(*(new.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns))
