"""Column functions over names and titles. All stay in the JVM."""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c: Column | str) -> Column:
    """The value, with NULL as blank."""
    return F.coalesce(col(c).cast("string"), F.lit(""))


def bound(value: Column, rule: Callable[[Column], Column]) -> Column:
    """rule(value), with the value evaluated once however often the rule reads it, so that the expression stays small."""
    return F.element_at(F.transform(F.array(value), rule), 1)


def blank(c: Column | str) -> Column:
    return text(c) == ""


def present(c: Column | str) -> Column:
    return text(c) > ""


def first_present(*columns: Column | str) -> Column:
    """The first non-blank value, or blank."""
    return F.coalesce(*(F.nullif(text(c), F.lit("")) for c in columns), F.lit(""))


def alternation(words: list[str]) -> str:
    """A pattern of any of the words, grouped by first letter: at each place of a value a search tries the letters, not all words."""
    ends: dict[str, list[str]] = {}
    for w in words:
        ends.setdefault(w[:1], []).append(re.escape(w[1:]))
    return "|".join(f"{re.escape(k)}(?:{'|'.join(v)})" for k, v in ends.items())


def has_any(c: Column | str, words: list[str]) -> Column:
    """Whether the lower-cased value contains any of the words."""
    return F.lower(text(c)).rlike(alternation(words))


@functools.cache
def _decompositions() -> tuple[str, str, dict[str, str]]:
    """From Unicode's compatibility decompositions: characters with one ASCII character (as two strings), and those with more."""
    one, many = {}, {}
    for point in range(0x80, 0x30000):
        c = chr(point)
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if x < "\x80") if not 0xD800 <= point < 0xE000 else ""
        if len(plain) == 1:
            one[c] = plain
        elif plain:
            many[c] = plain
    return "".join(one), "".join(one.values()), many


def ascii_fold(c: Column | str) -> Column:
    """Compatibility decomposition without what is not ASCII; ASCII values pass through untouched."""
    one, plain, many = _decompositions()
    table = F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in many.items())), F.lit("\x01"), F.lit("\x02"))  # one literal, folded once
    wide = "[" + "".join(many) + "]"

    def fold(value: Column) -> Column:
        spread = F.array_join(F.transform(F.split(value, ""), lambda x: F.coalesce(F.when(x > "\x7f", F.element_at(table, x)), x)), "")
        folded = F.regexp_replace(F.translate(F.when(value.rlike(wide), spread).otherwise(value), one, plain), r"[^\x00-\x7F]", "")
        return F.when(value.rlike(r"[^\x00-\x7F]"), folded).otherwise(value)

    return fold(text(c)) if isinstance(c, str) else bound(text(c), fold)  # a column by name costs nothing to read again


def squeeze(c: Column, pattern: str = r"[^a-z0-9]+") -> Column:
    return F.trim(F.regexp_replace(c, pattern, " "))


def normalize_text(c: Column | str) -> Column:
    """Folded to ASCII, lower case, runs of other characters as one space, trimmed; NULL is blank."""
    return squeeze(F.lower(ascii_fold(c)))


def compact(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(ascii_fold(c)), "[^a-z0-9]+", "")


author_key = normalize_text


def book_key(title: Column | str, author: Column | str, asin: Column | str | None = None) -> Column:
    """asin:<ID> if there is an identifier, else title::author."""
    by_name = F.concat_ws("::", normalize_text(title), normalize_text(author))
    return by_name if asin is None else F.when(present(asin), F.concat(F.lit("asin:"), F.upper(text(asin)))).otherwise(by_name)


def strip(c: Column, chars: str) -> Column:
    return F.btrim(c, F.lit(chars))


def clean_listing_title(c: Column | str) -> Column:
    """Without shop suffixes, a parenthesis that names a binding, and punctuation at the ends."""
    out = text(c)
    for pattern in (r"(?i)\s*[:|-]\s*Amazon\..*$", r"(?i)\s*[:|-]\s*Amazon.*$", r"(?i)\s*\([^)]*Paperback[^)]*\)"):
        out = F.regexp_replace(out, pattern, "")
    return strip(out, " -:|")


def _words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def clean_person_name(c: Column | str) -> Column:
    """Without noise, cut at the first stop word."""
    value = text(c)
    for i, pattern in enumerate(fixed.NAME_NOISE):
        value = F.regexp_replace(value, pattern, "")
        if i == 0:
            value = F.trim(value)

    def kept(words: Column) -> Column:
        stops = F.transform(words, lambda w: F.lower(strip(w, ".,;:()[]\"'")).isin(fixed.NAME_STOPS))
        return bound(F.array_position(stops, True), lambda at: F.when(at > 0, F.slice(words, F.lit(1), (at - 1).cast("int"))).otherwise(words))

    return strip(F.array_join(bound(_words(value), kept), " "), " ,.-:|")


def valid_person_name(c: Column | str, low: int = 3, high: int = 60, min_words: int = 2) -> Column:
    """Length, at least min_words words, no stop word, a letter. Bounds and words are the variants' parameters."""

    def holds(value: Column) -> Column:
        words = F.transform(_words(value), lambda w: F.lower(strip(w, ".,;:()[]")))
        usual = lambda words: (F.size(words) >= min_words) & ~F.exists(words, lambda w: w.isin(fixed.NAME_STOPS))
        return F.char_length(value).between(low, high) & value.rlike(r"\p{L}") & bound(words, usual)

    return bound(text(c), holds)


def corporate_author(c: Column | str) -> Column:
    name = F.trim(F.lower(text(c)))
    return (name != "") & (name.rlike(fixed.COMPANY_CONSTRUCTION) | name.rlike("|".join(fixed.COMPANY_PATTERNS)))


def tokens(c: Column | str, least: int, stops: list[str], distinct: bool) -> Column:
    out = F.filter(F.split(normalize_text(c), " "), lambda w: (F.length(w) >= least) & ~w.isin(stops))
    return F.array_distinct(out) if distinct else out


def author_tokens(c: Column | str) -> Column:
    return tokens(c, 3, fixed.AUTHOR_STOPS, False)


def title_tokens(c: Column | str) -> Column:
    return tokens(c, 4, fixed.TITLE_STOPS, True)


def title_anchor(c: Column | str, most: int = 6) -> Column:
    """Titles of more than `most` words: their first four significant words, connectors at the ends left out."""
    words = _words(text(c))
    normal = lambda w: squeeze(F.lower(w))
    strong = F.filter(words, lambda w: ~normal(w).isin(fixed.TITLE_STOPS + fixed.CONNECTORS))
    chosen = F.slice(F.when(F.size(strong) > 0, strong).otherwise(words), 1, 4)
    weak = F.transform(chosen, lambda w: normal(w).isin(fixed.CONNECTORS))
    head = F.array_position(weak, False).cast("int")
    tail = F.array_position(F.reverse(weak), False).cast("int")
    kept = F.when(head > 0, F.slice(chosen, head, F.size(chosen) - head - tail + 2)).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(words) <= most, F.trim(text(c))).otherwise(strip(F.array_join(kept, " "), " :-"))


def placeholder_title(title: Column | str, code: Column | str) -> Column:
    rule = lambda n, k: n.isin("", "missing", "unknown") | n.startswith("book for asin") | n.startswith("book for isbn") | ((k != "") & (n == k))
    return bound(F.struct(normalize_text(title).alias("n"), normalize_text(code).alias("k")), lambda x: rule(x["n"], x["k"]))


def name_is_title_fragment(name: Column | str, title: Column | str) -> Column:
    """Whether every token of the name stands in the title (a name without tokens counts as one)."""
    return F.size(F.array_except(author_tokens(name), F.split(normalize_text(title), " "))) == 0


def split_title_by_author(c: Column | str) -> Column:
    """struct(title, author) of "Title by Author" at the end, else the title with a blank author."""
    value = text(c)
    pattern = r"^(.*\S)\s+by\s+(\p{Lu}[\w.'-]*(?:\s+\p{Lu}[\w.'-]*){1,3})\s*$"
    author = F.regexp_extract(value, pattern, 2)
    return F.struct(F.when(author != "", F.regexp_extract(value, pattern, 1)).otherwise(value).alias("title"), author.alias("author"))


def authors_from_colon_title(c: Column | str) -> Column:
    """Names out of "Title: Last, First, Last, First: id": pairs of capitalised parts, left to right, distinct."""
    value = text(c)
    nothing = F.array().cast("array<string>")
    capital = lambda w: w.rlike(r"^\p{Lu}")

    def pairs(part: Column) -> Column:
        # Each name is held until the next part decides: a pair takes both, otherwise the scan moves by one.
        start = F.struct(F.lit("").alias("last"), nothing.alias("found"))
        step = lambda a, s: F.when(
            capital(a["last"]) & capital(s), F.struct(F.lit("").alias("last"), F.concat(a["found"], F.array(F.concat_ws(" ", s, a["last"]))).alias("found"))
        ).otherwise(F.struct(s.alias("last"), a["found"].alias("found")))
        return F.aggregate(F.transform(F.split(part, ","), lambda x: F.trim(x)), start, step, lambda a: a["found"])

    names = F.flatten(F.transform(F.split(value, ":"), lambda p: pairs(F.trim(p))))
    found = F.array_distinct(F.filter(F.transform(names, clean_person_name), lambda n: valid_person_name(n)))
    return F.when(F.contains(value, F.lit(",")), found).otherwise(nothing)  # a pair has a comma within


STRONG_BY = r"\bby\s+([A-Z][A-Za-z .'-]{1,40})\s*\((?:Author|Illustrator|Contributor|Editor|Writer)\)"
PLAIN_BY = r"\bby\s+([A-Z][a-zA-Z.'-]{1,30}(?:\s+[A-Z][a-zA-Z.'-]{1,30}){1,3})"
TAIL = r"(?:\s*(?:\.\.\.|[.:|-]|$))"


def guess_title_author(title: Column | str, snippet: Column | str) -> Column:
    """struct(title, author, confidence) by the ladder: colon form .75, labelled "by" .8, plain "by" .6, none .35; the title loses its author."""
    first = lambda names: F.try_element_at(F.filter(names, lambda n: valid_person_name(n)), F.lit(1))
    plain = lambda s: first(F.transform(F.regexp_extract_all(s, F.lit(PLAIN_BY), 1), clean_person_name))

    # Each step is bound: the next ones read it many times, and it is evaluated once a row.
    def names(s: Column) -> Column:
        raw = F.coalesce(F.nullif(F.regexp_extract(s["hint"], STRONG_BY, 1), F.lit("")), F.nullif(F.regexp_extract(s["cleaned"], STRONG_BY, 1), F.lit("")))
        labelled = bound(clean_person_name(raw), lambda n: F.when(valid_person_name(n), n))
        colon = F.try_element_at(authors_from_colon_title(s["title"]), F.lit(1))
        return F.struct(s["title"].alias("title"), s["cleaned"].alias("cleaned"), s["hint"].alias("hint"), colon.alias("colon"), labelled.alias("labelled"))

    def with_by(s: Column) -> Column:  # read where no stronger form has a name
        by = F.when(s["colon"].isNull() & s["labelled"].isNull(), F.coalesce(plain(s["hint"]), plain(s["cleaned"])))
        return F.struct(s["title"].alias("title"), s["cleaned"].alias("cleaned"), s["colon"].alias("colon"), s["labelled"].alias("labelled"), by.alias("by"))

    def chosen(s: Column) -> Column:
        confidence = F.when(s["colon"].isNotNull(), 0.75).when(s["labelled"].isNotNull(), 0.8).when(s["by"].isNotNull(), 0.6).otherwise(0.35)
        any_by = F.regexp_extract(s["cleaned"], r"\s+by\s+([A-Z][a-zA-Z.'-]{1,30}(?:\s+[A-Z][a-zA-Z.'-]{1,30}){1,3})" + TAIL, 1)
        return F.struct(s["title"].alias("title"), s["cleaned"].alias("cleaned"), F.coalesce(s["colon"], s["labelled"], s["by"], F.lit("")).alias("author"), confidence.alias("confidence"), any_by.alias("any_by"))

    def bare(s: Column) -> Column:
        cleaned, author, any_by = s["cleaned"], s["author"], s["any_by"]
        own = F.concat(F.lit(r"(?i)\s+by\s+"), F.regexp_replace(author, r"([.'\-+*?()\[\]{}|^$\\])", r"\\$1"), F.lit(TAIL))
        usual = F.exists(F.split(F.lower(any_by), r"\s+"), lambda w: w.isin(fixed.TITLE_TAIL_STOPS))
        return (
            F.when((author != "") & F.regexp_like(cleaned, own), strip(F.regexp_replace(cleaned, own, F.lit("")), " -:|"))
            .when((author != "") & (any_by != "") & ~usual, strip(F.regexp_replace(cleaned, r"\s+by\s+[A-Z][a-zA-Z.'-]{1,30}(?:\s+[A-Z][a-zA-Z.'-]{1,30}){1,3}" + TAIL, ""), " -:|"))
            .otherwise(cleaned)
        )

    def short(tailless: Column) -> Column:
        head = F.trim(F.substring_index(tailless, "...", 1))
        return F.when(F.contains(tailless, F.lit("...")) & (F.char_length(head) > 5), head).otherwise(tailless)

    def guess(s: Column) -> Column:
        final = F.left(strip(F.regexp_replace(bound(bare(s), short), r"(?i)\s*Amazon\.com\s*.*$", ""), " -:|"), F.lit(500))
        return F.struct(first_present(final, F.left(s["title"], F.lit(500))).alias("title"), F.left(s["author"], F.lit(255)).alias("author"), s["confidence"].alias("confidence"))

    texts = F.struct(text(title).alias("title"), clean_listing_title(title).alias("cleaned"), text(snippet).alias("hint"))
    return bound(bound(bound(bound(texts, names), with_by), chosen), guess)


def parse_review_title(title: Column | str, snippet: Column | str) -> Column:
    """struct(title, author, confidence) of a review's title: labels of reviews and sites stripped; "by" in the title .7, in both texts .6, else none."""
    bare = F.regexp_replace(text(title), r"(?i)^\s*(?:book\s+)?review\s*[:\-|]\s*|\s*[\-|]\s*(?:book\s+)?reviews?\b.*$|\s*\|.*$", "")
    inside = F.regexp_extract(bare, PLAIN_BY, 1)
    around = F.regexp_extract(F.concat_ws(" ", bare, text(snippet)), PLAIN_BY, 1)
    author = clean_person_name(first_present(inside, around))
    confidence = F.when(inside != "", 0.7).when(around != "", 0.6).otherwise(0.0)
    return F.struct(strip(F.regexp_replace(bare, r"(?i)\s+by\s+.*$", ""), " -:|\"'").alias("title"), author.alias("author"), confidence.alias("confidence"))


def humanize_slug(url: Column | str) -> Column:
    """The last part of a path, without a numeric tail, in title case."""
    last = F.try_element_at(F.filter(F.split(F.regexp_replace(text(url), r"[?#].*$", ""), "/"), lambda p: p != ""), F.lit(-1))
    return F.initcap(F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(last, F.lit("")), r"[-_]?\d+$", ""), r"[-_]+", " ")))


def keyword_slug(c: Column | str) -> Column:
    """Lower-case words joined by hyphens; beyond 80 characters the first 69 and a digest; blank is `keyword`."""
    words = F.trim(F.regexp_replace(F.lower(text(c)), r"\s+", " "))
    slug = strip(F.regexp_replace(words, "[^a-z0-9]+", "-"), "-")
    long = F.concat(F.left(slug, F.lit(69)), F.lit("-"), F.left(F.sha2(words, 256), F.lit(10)))
    return F.when(slug == "", "keyword").when(F.length(slug) > 80, long).otherwise(slug)
