"""Column functions over book identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound, first_present, text
from .urls import listing_id, marketplace_host

TOKEN = r"(?i)https?://[^\s,;]+|(?:97[89][\s-]?)?(?:\d[\s-]?){9}[\dXx]|\b[A-Za-z0-9]{10}\b"


def _digit(code: Column, i: Column) -> Column:
    c = F.substring(code, i, F.lit(1))
    return F.when(c == "X", 10).otherwise(F.try_to_number(c, F.lit("9")).cast("int"))


def _weighted(code: Column, n: int, weight) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.lit(n)), F.lit(0), lambda a, i: a + F.coalesce(_digit(code, i), F.lit(0)) * weight(i))


def isbn10_valid(code: Column) -> Column:
    return F.when(code.rlike(r"^\d{9}[\dX]$"), _weighted(code, 10, lambda i: i) % 11 == 0).otherwise(False)


def isbn13_valid(code: Column) -> Column:
    return F.when(code.rlike(r"^97[89]\d{10}$"), _weighted(code, 13, lambda i: F.when(i % 2 == 1, 1).otherwise(3)) % 10 == 0).otherwise(False)


def to_isbn13(isbn10: Column) -> Column:
    stem = F.concat(F.lit("978"), F.left(isbn10, F.lit(9)))
    check = (10 - _weighted(stem, 12, lambda i: F.when(i % 2 == 1, 1).otherwise(3)) % 10) % 10
    return F.concat(stem, check.cast("string"))


def to_isbn10(isbn13: Column) -> Column:
    """The 10-form of a 978 code; 979 codes have none (blank)."""
    stem = F.substring(isbn13, 4, 9)
    check = (11 - _weighted(stem, 9, lambda i: 11 - i) % 11) % 11
    return F.when(isbn13.startswith("978"), F.concat(stem, F.when(check == 10, "X").otherwise(check.cast("string")))).otherwise("")


def canonical_isbn(value: Column) -> Column:
    """Ten or thirteen characters of a code without spaces and hyphens, else blank."""
    bare = F.upper(F.regexp_replace(value, r"[\s-]", ""))
    return F.when(bare.rlike(r"^(\d{9}[\dX]|\d{13})$"), bare).otherwise("")


def analyze_identifier(c: Column | str) -> Column:
    """struct(canonical, type, valid, confidence, isbn10, isbn13, warnings). A code is tried as an ISBN before it is tried as B0… ."""
    candidate = bound(F.trim(text(c)), lambda raw: F.coalesce(F.when(marketplace_host(raw).isNotNull(), F.coalesce(listing_id(raw), F.lit(""))), raw))
    return bound(candidate, lambda x: bound(canonical_isbn(x), lambda code: _analysis(x, code)))


def _analysis(candidate: Column, code: Column) -> Column:
    is10, is13 = F.length(code) == 10, F.length(code) == 13
    good = F.when(is10, isbn10_valid(code)).when(is13, isbn13_valid(code)).otherwise(False)
    other = F.upper(F.regexp_replace(candidate, "[^A-Za-z0-9]", ""))
    listing = other.rlike("^B0[A-Z0-9]{8}$")
    isbn = is10 | is13
    warning = F.when(isbn & ~good, F.array(F.lit("The ISBN checksum is invalid."))).when(~isbn & ~listing, F.array(F.lit("Expected a valid ISBN-10, ISBN-13, ASIN, or Amazon book URL."))).otherwise(F.array().cast("array<string>"))
    return F.struct(
        F.when(isbn, code).otherwise(other).alias("canonical"),
        F.when(is10, "isbn10").when(is13, "isbn13").when(listing, "asin").otherwise("unknown").alias("type"),
        F.when(isbn, good).otherwise(listing).alias("valid"),
        F.when(isbn & good, 1.0).when(~isbn & listing, 0.65).otherwise(0.0).alias("confidence"),
        F.when(is10 & good, code).when(is13 & good, to_isbn10(code)).otherwise("").alias("isbn10"),
        F.when(is13 & good, code).when(is10 & good, to_isbn13(code)).otherwise("").alias("isbn13"),
        warning.alias("warnings"),
    )


def book_code(c: Column | str) -> Column:
    return bound(analyze_identifier(c), lambda a: F.when(a["valid"], a["canonical"]).otherwise(""))


def canonical_book_key(c: Column | str) -> Column:
    """The 13-form of an ISBN, so that both forms of a code are one book; other valid codes as they are."""
    return bound(analyze_identifier(c), lambda a: F.when(a["valid"], first_present(a["isbn13"], a["canonical"])).otherwise(""))


def identifier_type(c: Column | str) -> Column:
    v = text(c)
    return F.when(v.rlike("^B0[A-Z0-9]{8}$"), "asin").when(F.length(v) == 13, "isbn13").when(F.length(v) == 10, "isbn10").otherwise("unknown")


def isbns_in_text(c: Column | str) -> Column:
    """The valid ISBNs of a text, in order."""
    found = F.regexp_extract_all(text(c), F.lit(r"\b((?:97[89][\s-]?)?(?:\d[\s-]?){9}[\dXx])\b"), 1)
    return F.filter(F.transform(found, canonical_isbn), lambda x: isbn10_valid(x) | isbn13_valid(x))


def isbn_in_text(c: Column | str) -> Column:
    return F.coalesce(F.try_element_at(isbns_in_text(c), F.lit(1)), F.lit(""))


def asin_in_text(c: Column | str) -> Column:
    return F.upper(F.regexp_extract(text(c), r"(?i)\b(B0[A-Z0-9]{8})\b", 1))


def best_isbn(values: Column) -> Column:
    """Of an array of raw codes: the first valid one in 13-form, else the first valid one, else blank."""
    valid = F.filter(F.transform(values, canonical_isbn), lambda x: isbn10_valid(x) | isbn13_valid(x))
    return F.coalesce(F.try_element_at(F.filter(valid, lambda x: F.length(x) == 13), F.lit(1)), F.try_element_at(valid, F.lit(1)), F.lit(""))


def listing_identity(c: Column | str) -> Column:
    """struct(qualified, alias, evidence): a possible listing alias, never qualified without a listing URL."""
    return bound(analyze_identifier(c), _listing_of)


def _listing_of(a: Column) -> Column:
    alias = F.when(~a["valid"], "").when(a["type"] == "asin", a["canonical"]).otherwise(a["isbn10"])
    evidence = F.when(~a["valid"], "invalid_identifier").when(a["type"] == "asin", "asin_requires_amazon_product_evidence").when(a["isbn10"] != "", "isbn10_requires_amazon_product_evidence").otherwise("no_amazon_asin_mapping")
    return F.struct(F.lit(False).alias("qualified"), alias.alias("amazon_asin"), evidence.alias("evidence"))


def identifier_tokens(c: Column | str) -> Column:
    """Identifier-like tokens of a free text, in order, without closing marks; if there are none, its parts."""
    value = text(c)
    found = F.regexp_extract_all(value, F.lit(TOKEN), 0)
    parts = F.filter(F.split(value, r"[\s,;]+"), lambda x: x != "")
    return F.transform(F.when(F.size(found) > 0, found).otherwise(parts), lambda x: F.rtrim(x, F.lit(".)]}>")))
