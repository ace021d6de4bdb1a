r"""Personal data: base patterns, and terms that reveal the values found (information-theoretic sanitisation). SQL functions only.

Base spans per kind are leftmost and do not overlap: email, ip (parts at most 255), card (12 to 19 digits, Luhn), phone (9 to 15
digits). The patterns are written with possessive runs and look-behinds that match the same spans in linear time. Positions follow from
the lengths of the gaps between matches, summed in a window over the few matches of a text.

Disclosure: each value found is a protected entity e. Its contexts are the distinct WINDOW-word surroundings of its mentions, so copies of
a text count once. A term t (three letters or more) reveals the share log2(P(e|t) / P(e)) / log2(1 / P(e)) of what there is to know of
e, with P(e|t) = contexts of e with t / texts with t, and P(e) = contexts of e / all texts; copies of a text count once in all of these. A term that reveals MIN_SHARE or more of some
entity, and is seen in MIN_CONTEXTS of its contexts, exceeds the disclosure threshold: its occurrences become spans of kind `term` in
every text. Texts with a term are counted over the whole corpus for the terms that stand in contexts. Texts are told apart by their SHA-256.

Cases: null text counts as empty; repeated rows are judged row by row; an empty table gives an empty table; where no term exceeds the threshold
the spans are the base spans; columns of any other name are left alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, fresh, join_checked

#: The kinds in their order, with patterns.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain for a pattern to be tried.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
KINDS = [*PATTERNS, "term"]
WINDOW, MIN_CONTEXTS, MIN_SHARE = 5, 2, 0.9
SEPARATOR = r"[\x20\x09-\x0D]"


def term(piece: Column) -> Column:
    """A word's term: lower case, without what is no letter at its ends; empty if letters do not make it up, or fewer than three do."""
    return F.regexp_extract(F.lower(piece), r"^[^\p{L}\p{N}]*(\p{L}{3,})[^\p{L}\p{N}]*$", 1)


def key_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), 256))


def pieces(gap: Column) -> Column:
    """What white space divides, empty pieces at the ends included."""
    return F.split(gap, SEPARATOR + "+", -1)


def matches(text: Column, kind: str) -> Column:
    """Array of a kind's raw matches: m, gap (the length of the text since the last match), gap_words and m_words (how often white space stands in it and in the match), and before and after, what adjoins the match within its word."""
    pattern = F.lit(PATTERNS[kind])
    found, gaps = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, PATTERNS[kind], -1)
    rows = F.transform(
        F.arrays_zip(found.alias("m"), F.slice(gaps, 1, F.size(found)).alias("g"), F.slice(gaps, 2, F.size(found)).alias("h")),
        lambda x: F.struct(
            x["m"].alias("m"), F.char_length(x["g"]).alias("gap"), (F.size(pieces(x["g"])) - 1).alias("gap_words"), (F.size(pieces(x["m"])) - 1).alias("m_words"),
            F.element_at(pieces(x["g"]), -1).alias("before"), F.element_at(pieces(x["h"]), 1).alias("after"),
        ),
    )
    hit = text.rlike(PATTERNS[kind] if NEEDS[kind] else r"[0-9][\x20-]?[0-9](?:[\x20-]?[0-9]){10}")
    if NEEDS[kind]:
        hit = F.contains(text, F.lit(NEEDS[kind])) & hit
    return F.when(hit, rows)


def luhn(digits: Column) -> Column:
    """Whether the Luhn sum of a digit string is a multiple of ten."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)))
    return F.aggregate(values, F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0))) % 10 == 0


def valid(kind: Column, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    n = F.length(digits)
    ip = F.forall(F.split(m, r"\."), lambda x: (F.length(F.ltrim(x, F.lit("0"))) <= 3) & (F.coalesce(F.try_to_number(F.right(x, F.lit(3)), F.lit("999")).cast("int"), F.lit(0)) <= 255) & (F.length(F.regexp_replace(x, "^0+", "")) <= 3))
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", ip)
        .when(kind == "card", F.when(n.between(12, 19), luhn(digits)).otherwise(False))
        .otherwise(n.between(9, 15))
    )


def scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A written row per row of docs: _row, doc_id, _key (of its text), the raw matches of each kind and, where there are some, the words of the text."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    found = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(f"`{id_col}`").alias("doc_id"), key_of(text).alias("_key"), text.alias("_text"), *(matches(text, k).alias(k) for k in PATTERNS))
    words = F.when(F.coalesce(*(F.size(F.nullif(k, F.array())) for k in PATTERNS), F.lit(0)) > 0, pieces(F.col("_text"))).alias("_words")
    return cut(found.select("_row", "doc_id", "_key", *PATTERNS, words), "pii-matches")


def base_spans(found: DataFrame) -> DataFrame:
    """A row per valid match: _row, _key, kind, start, end, m, first and last (the places of the words at its ends among those of the text), before, after."""
    each = reduce(DataFrame.unionByName, (found.where(F.col(k).isNotNull()).select("_row", "_key", F.lit(k).alias("kind"), F.posexplode(k).alias("i", "x")).select("_row", "_key", "kind", "i", "x.*") for k in PATTERNS))
    until = Window.partitionBy("_row", "kind").orderBy("i")
    end = F.sum(F.col("gap") + F.char_length("m")).over(until)
    last = F.sum(F.col("gap_words") + F.col("m_words")).over(until)
    placed = each.withColumns({"end": end, "last": last}).withColumns({"start": F.col("end") - F.char_length("m"), "first": F.col("last") - F.col("m_words")})
    return placed.where(valid(F.col("kind"), F.col("m"))).select("_row", "_key", "kind", F.col("start").cast("bigint"), F.col("end").cast("bigint"), "m", F.col("first").cast("int"), F.col("last").cast("int"), "before", "after")


def surrounded(spans: DataFrame, found: DataFrame) -> DataFrame:
    """(kind, m, words, _key) of each valid match: the WINDOW words on each side of it in the whole text, whatever stands there, and what adjoins it in its own word."""
    of_row = cut(spans.groupBy("_row").agg(F.collect_list(F.struct("kind", "m", "first", "last", "before", "after")).alias("x")), "pii-of-rows")
    rows = found.select("_row", "_key", "_words").join(of_row, "_row")
    ahead = lambda x: F.slice("_words", F.greatest(x["first"] - WINDOW, F.lit(0)) + 1, F.least(x["first"], F.lit(WINDOW)))
    words = lambda x: F.concat(ahead(x), F.array(x["before"], x["after"]), F.slice("_words", x["last"] + 2, WINDOW))
    each = F.transform("x", lambda x: F.struct(x["kind"].alias("kind"), x["m"].alias("m"), words(x).alias("words")))
    return rows.select("_key", F.explode(each).alias("x")).select("_key", "x.*")


def contexts(spans: DataFrame) -> DataFrame:
    """(entity, context, terms, _key) of each match (kind, m, words, _key); a context is the hash of its words, _key of its text."""
    words = F.col("words")
    terms = F.filter(F.array_distinct(F.transform(words, term)), lambda t: t != "")
    entity = F.concat_ws(":", "kind", F.when(F.col("kind") == "email", F.lower("m")).when(F.col("kind") == "ip", F.col("m")).otherwise(F.regexp_replace("m", "[^0-9]", "")))
    return spans.select(entity.alias("entity"), F.xxhash64(F.array_join(words, " ")).alias("context"), terms.alias("terms"), "_key")


def revealing_terms(docs: DataFrame, matched: DataFrame, n_texts: int, text_col: str, min_contexts: int, min_share: float) -> DataFrame:
    """Written table of the terms above the disclosure threshold.

    The texts that hold a term in some context are no more than all its texts. Terms that stay below the threshold even with that smaller
    count are settled by it, so that only the few others are counted over the corpus.
    """
    each = cut(contexts(matched), "pii-contexts")
    in_contexts = each.select("_key", F.explode("terms").alias("term")).distinct().groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    seen = each.drop("_key").distinct()
    per_entity = seen.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e")).where(F.col("n_e") >= min_contexts)
    pairs = seen.select("entity", F.explode("terms").alias("term")).groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_et")).where(F.col("n_et") >= min_contexts)
    p_e = F.col("n_e") / F.lit(float(max(n_texts, 2)))
    share = F.log2(F.col("n_et") / F.col("n_t") / p_e) / F.log2(1 / F.least(p_e, F.lit(0.5)))
    pairs = cut(pairs.join(per_entity, "entity").join(in_contexts, "term").where(share >= min_share).drop("n_t"), "pii-pairs")
    candidates = cut(pairs.select("term").distinct(), "pii-candidates")
    counts = join_checked(text_terms(docs, text_col), candidates, ["term"], "left_semi", ["term"]).distinct().groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    return cut(join_checked(pairs, cut(counts, "pii-counts"), ["term"], "inner", ["term"]).where(share >= min_share).select("term").distinct(), "pii-terms")


def text_terms(docs: DataFrame, text_col: str) -> DataFrame:
    """(_key, term): each term of each text once."""
    text = F.col(f"`{text_col}`")
    words = F.array_distinct(F.split(F.concat(F.lit(" "), F.lower(text), F.lit(" ")), r"[^\p{L}\p{N}]*" + SEPARATOR + r"+[^\p{L}\p{N}]*"))
    each = docs.where(text.isNotNull()).select(key_of(text).alias("_key"), F.explode(words).alias("term"))
    return each.where(F.length("term") >= 3)


def term_spans(docs: DataFrame, terms: DataFrame, text_col: str) -> DataFrame:
    """(_key, start, end) of the occurrences of terms in every distinct text that holds one."""
    text = F.col(f"`{text_col}`")
    keys = cut(join_checked(text_terms(docs, text_col), terms, ["term"], "left_semi", ["term"]).select("_key").distinct(), "pii-keys")
    texts = join_checked(docs.where(text.isNotNull()).select(key_of(text).alias("_key"), text.alias("_text")), keys, ["_key"], "left_semi").dropDuplicates(["_key"])
    pieces = texts.select("_key", F.posexplode(F.split("_text", SEPARATOR, -1)).alias("i", "piece"))
    before = Window.partitionBy("_key").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.withColumn("at", F.coalesce(F.sum(F.char_length("piece") + 1).over(before), F.lit(0))).withColumn("term", term(F.col("piece"))).where("term <> ''")
    lead = F.char_length(F.regexp_extract("piece", r"^[^\p{L}\p{N}]*", 0))
    return join_checked(placed, terms, ["term"], "left_semi", ["term"]).select("_key", (F.col("at") + lead).alias("start"), (F.col("at") + lead + F.char_length(F.regexp_extract("piece", r"^[^\p{L}\p{N}]*(\p{L}+)", 1))).alias("end"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_contexts: int = MIN_CONTEXTS, min_share: float = MIN_SHARE) -> DataFrame:
    """Per row of docs: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, and _key and _spans for sanitise()."""
    found = scan(docs, id_col, text_col)
    base = cut(base_spans(found), "pii-base")
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1
    own = cut(base.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("start", rank.alias("rank"), "end"))).alias("_base")), "pii-own")
    terms = revealing_terms(docs, surrounded(base, found), found.select("_key").distinct().count(), text_col, min_contexts, min_share)
    added = cut(term_spans(docs, terms, text_col).groupBy("_key").agg(F.collect_list(F.struct("start", F.lit(KINDS.index("term")).alias("rank"), "end")).alias("_terms")), "pii-added")
    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint>>")
    rows = join_checked(join_checked(found.select("_row", "doc_id", "_key"), own, ["_row"], "left"), added, ["_key"], "left")
    rows = rows.withColumn("_base", F.coalesce("_base", none)).withColumn("_spans", F.sort_array(F.concat("_base", F.coalesce("_terms", none))))
    count = lambda k: F.size(F.filter("_base", lambda s: s["rank"] == KINDS.index(k))).cast("bigint").alias(f"n_{k}")
    return rows.select("doc_id", *map(count, PATTERNS), F.sha2(joined(F.col("_base")), 256).alias("base_sha256"), joined(F.col("_spans")).alias("spans"), "_key", "_spans")


def redacted(text: Column, spans: Column, labels: Column) -> Column:
    """text with each span (start, rank, end; sorted) replaced by its label; overlapping spans go together under the first label."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))
    step = lambda a, s: F.struct(
        F.when(s["start"] >= a["at"], F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.element_at(labels, s["rank"] + 1))).otherwise(a["out"]).alias("out"),
        F.greatest(a["at"], s["end"]).alias("at"),
    )
    return F.aggregate(spans, start, step, lambda a: F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.char_length(text))))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """docs with base spans generalised to their kind and revealing terms removed (all columns)."""
    found = find(docs, id_col, text_col, **limits).where(F.size("_spans") > 0)
    key = fresh(docs, "_key")
    keyed = docs.withColumn(key, key_of(F.col(f"`{text_col}`")))
    name = fresh(keyed, "_spans")
    spans = cut(found.select(F.col("_key").alias(key), F.col("_spans").alias(name)).dropDuplicates([key]), "pii-spans")
    labels = F.array(*(F.lit(f"[{k}]" if k != "term" else "") for k in KINDS))
    own = F.col(f"`{text_col}`")
    text = F.when(F.col(name).isNull(), own).otherwise(redacted(own, F.col(name), labels))
    return join_checked(keyed, spans, [key], "left").select(*(text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns))
