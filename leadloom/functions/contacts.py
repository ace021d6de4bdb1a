"""Contact values: extraction from text, syntax, phone grammar. Phones are read by North American and international (+) grammar; no phone library is used."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .ids import isbn10_valid
from .text import alternation, bound, text
from .urls import blocked_mail, desk_mailbox, in_domains

EMAIL = r"(?i)(?<![\w.+-])[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}(?![\w-])"
SYNTAX = r"^(?!\.)(?!.*\.\.)[A-Za-z0-9!#$%&'*+/=?^_`{|}~.-]{1,64}(?<!\.)@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,63}$"
PHONE = r"(?<![\w+])(?:\+?1[\s.-]?)?\(?[2-9]\d{2}\)?[\s.-]?[2-9]\d{2}[\s.-]?\d{4}(?!\w)|(?<![\w+])\+[1-9](?:[\s.()-]{0,2}\d){7,14}(?!\w)"
BOOK_CONTEXT = r"(?i)\b(isbn|isbn-?13|isbn-?10|asin|barcode|pages|page\s+count|dimensions|weight|paperback|hardcover|edition|publisher|publication|price|checkout|catalog|qty|quantity)\b"
PHONE_CONTEXT = r"(?i)(contact|call|phone|tel|booking|publicity|media|school visit|speaking)"
TOLL_FREE = ["800", "833", "844", "855", "866", "877", "888"]


def email_syntax(c: Column | str) -> Column:
    return F.trim(text(c)).rlike(SYNTAX)


def dummy_email(c: Column | str) -> Column:
    return F.lower(text(c)).rlike(alternation(fixed.DUMMY_MAIL))


def deobfuscate_email(c: Column | str, guarded: bool = True) -> Column:
    """at/dot forms to plain ones. Guarded: only bracketed or spaced "at" and "dot"; else any inner letters "at", as the older rule had it."""
    v = F.trim(text(c))
    at, dot = (r"(?i)\s*[(\[<]\s*at\s*[)\]>]\s*|\s+at\s+", r"(?i)\s*[(\[<]\s*dot\s*[)\]>]\s*|\s+dot\s+") if guarded else (r"(?i)\s*[(\[<]?\s*at\s*[)\]>]?\s*", r"(?i)\s*[(\[<]?\s*dot\s*[)\]>]?\s*")
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(v, at, "@"), dot, "."), r"\s+", "")
    return F.when(v.rlike(r"[\s(\[<]"), plain).otherwise(v) if guarded else plain  # the guarded forms need white space or a bracket


def valid_email(c: Column | str) -> Column:
    return bound(deobfuscate_email(c), lambda plain: email_syntax(plain) & ~dummy_email(plain))


def usable_email(c: Column | str) -> Column:
    """Valid, not on a blocked domain, no desk."""
    return bound(F.lower(deobfuscate_email(c)), lambda plain: valid_email(plain) & ~blocked_mail(plain) & ~desk_mailbox(plain, strict=True))


def _with_context(value: Column, pattern: str, side: int) -> Column:
    """Array of (raw, before, after) of the matches, with `side` characters around, from the gaps between matches. Matches and gaps are found once; values without a match have no gaps made."""
    # A split compiles its pattern for every value, a replacement once a task: the gaps are split at a mark that the value hasn't got.
    marked = F.split(F.regexp_replace(value, pattern, "\x01"), "\x01", -1)
    gaps = F.when(F.contains(value, F.lit("\x01")), F.split(value, pattern, -1)).otherwise(marked)

    def around(found: Column) -> Column:
        zipped = bound(gaps, lambda g: F.arrays_zip(found.alias("raw"), F.slice(g, 1, F.size(found)).alias("b"), F.slice(g, 2, F.size(found)).alias("a")))
        return F.transform(zipped, lambda x: F.struct(x["raw"].alias("raw"), F.right(x["b"], F.lit(side)).alias("before"), F.left(x["a"], F.lit(side)).alias("after")))

    none = F.array().cast("array<struct<raw:string,before:string,after:string>>")
    return bound(F.regexp_extract_all(value, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, around(found)).otherwise(none))


def extract_emails(c: Column | str) -> Column:
    """Addresses of a text: no hint of scripts in them or within 120 characters, no blacklisted domain, valid syntax; lower case, distinct, in order."""

    def good(mail: Column, x: Column) -> Column:
        window = F.lower(F.concat_ws(" ", x["before"], x["raw"], x["after"]))
        domain = F.substring_index(mail, "@", -1)
        return ~mail.rlike(alternation(fixed.SCRIPT_HINTS)) & ~in_domains(domain, fixed.BLOCKED_MAIL) & ~window.rlike(alternation(fixed.SCRIPT_WINDOW)) & email_syntax(mail)

    def found(value: Column) -> Column:
        mails = F.transform(_with_context(value, EMAIL, 120), lambda x: bound(F.lower(F.btrim(x["raw"], F.lit(".,;:()[]{}<>"))), lambda mail: F.when(good(mail, x), mail)))
        return F.when(F.contains(value, F.lit("@")), F.array_distinct(F.array_compact(mails))).otherwise(F.array().cast("array<string>"))

    return bound(text(c), found)


def e164(c: Column | str) -> Column:
    """+1 and ten digits for North American numbers, + and 8 to 15 digits for others; NULL if neither."""
    nanp = r"^[2-9]\d{2}[2-9]\d{6}$"

    def read(v: Column, d: Column) -> Column:
        plus = v.startswith("+")
        return (
            F.when(v.rlike(r"[A-Za-z]"), None)
            .when(~plus & d.rlike(nanp), F.concat(F.lit("+1"), d))
            .when(d.startswith("1") & F.substring(d, 2, 20).rlike(nanp), F.concat(F.lit("+"), d))
            .when(plus & ~d.startswith("1") & F.length(d).between(8, 15), F.concat(F.lit("+"), d))
        )

    return bound(F.trim(text(c)), lambda v: bound(F.regexp_replace(v, "[^0-9]", ""), lambda d: read(v, d)))


def phone_details(c: Column | str) -> Column:
    """struct(valid, e164, line_type, region, is_fake, is_premium); fictional and premium numbers are invalid."""
    return details_of(e164(c))


def details_of(e: Column) -> Column:
    """phone_details() of an E.164 number, NULL if none."""
    area = F.when(e.startswith("+1"), F.substring(e, 3, 3))
    fake = F.coalesce(e.rlike(r"^\+1\d{3}55501\d\d$") | e.rlike(r"^\+1(\d)\1{9}$"), F.lit(False))
    premium = F.coalesce(area == "900", F.lit(False))
    line = F.when(e.isNull(), "unknown").when(area.isin(TOLL_FREE), "toll_free").when(premium, "premium_rate").when(area.isNotNull(), "landline").otherwise("unknown")
    region = F.when(e.startswith("+1"), "US").otherwise("")
    return F.struct((e.isNotNull() & ~fake & ~premium).alias("valid"), F.coalesce(e, F.lit("")).alias("e164"), line.alias("line_type"), region.alias("region"), fake.alias("is_fake"), premium.alias("is_premium"))


def plan_prefixes(plans: list = fixed.NUMBER_PLANS) -> dict[str, tuple[str, str, int, int, int]]:
    """Prefixes of international numbers (country code and leading digits) with region, kind, the length of the country code, and the least and greatest national length."""
    return {code + lead: (region, kind, len(code), low, high) for code, region, _, kinds in plans for lead, kind, low, high in kinds}


def by_plan(c: Column | str, region: str = "US", plans: list = fixed.NUMBER_PLANS) -> Column:
    """struct(valid, e164, line_type, region) of a number by its numbering plan.

    Digits with + or 00 in front are international; others are of `region`, whose trunk prefix goes. The longest prefix of the number in the plans' table is found as in a trie, level by level, in a map of
    literals; it tells kind and lengths. Numbers without a prefix, of another length, and premium ones are not valid; of those of another length nothing more is told.
    """
    table, (code, _, trunk, _) = plan_prefixes(plans), next(p for p in plans if p[1] == region)
    known = F.create_map(*(x for k, (r, kind, n, low, high) in table.items() for x in (F.lit(k), F.struct(F.lit(r).alias("region"), F.lit(kind).alias("kind"), F.lit(n).alias("n"), F.lit(low).alias("low"), F.lit(high).alias("high")))))
    levels = range(max(map(len, table)), min(map(len, table)) - 1, -1)

    def parts(raw: Column) -> Column:
        digits = F.regexp_replace(raw, "[^0-9]", "")
        national = F.regexp_replace(digits, f"^{trunk}", "") if trunk else digits
        full = F.when(raw.rlike(r"^\s*\(?\+"), digits).when(digits.startswith("00"), F.substring(digits, 3, 30)).otherwise(F.concat(F.lit(code), national))
        return bound(full, lambda f: F.struct(f.alias("full"), raw.rlike(r"^[\d\s().+/-]+$").alias("plain"), F.coalesce(*(F.try_element_at(known, F.substring(f, 1, k)) for k in levels)).alias("plan")))

    def told(p: Column) -> Column:
        plan = p["plan"]
        return bound(F.coalesce((F.length(p["full"]) - plan["n"]).between(plan["low"], plan["high"]), F.lit(False)) & p["plain"], lambda fits: F.struct(
            (fits & F.coalesce(plan["kind"] != "premium_rate", F.lit(False))).alias("valid"), F.when(fits, F.concat(F.lit("+"), p["full"])).otherwise("").alias("e164"),
            F.when(fits, plan["kind"]).otherwise("unknown").alias("line_type"), F.when(fits, plan["region"]).otherwise("").alias("region"),
        ))

    raw = F.regexp_replace(F.trim(text(c)), r"(?i)\s*(?:ext\.?|x|#)\s*\d+$", "")
    return bound(bound(raw, parts), told)


def extract_phones(c: Column | str, require_context: bool = True) -> Column:
    """Numbers of a text that are no ISBN, not in the sentence of book data, and (if asked) near a word of contact; E.164, distinct, in order."""

    def good(x: Column) -> Column:
        bare = F.upper(F.regexp_replace(x["raw"], r"[^\dxX]", ""))
        isbn = bare.rlike(r"^97[89]\d{10}$") | (F.length(bare).eqNullSafe(10) & isbn10_valid(bare))
        left, right = F.regexp_extract(F.right(x["before"], F.lit(40)), r"[^.!?\n;]*\z", 0), F.regexp_extract(F.left(x["after"], F.lit(40)), r"^[^.!?\n;]*", 0)
        near = F.concat_ws(" ", x["before"], x["raw"], x["after"]).rlike(PHONE_CONTEXT)
        return ~isbn & ~left.rlike(BOOK_CONTEXT) & ~right.rlike(BOOK_CONTEXT) & (near | F.lit(not require_context))

    numbers = lambda value: F.transform(_with_context(value, PHONE, 120), lambda x: F.when(good(x), e164(x["raw"])))
    return bound(text(c), lambda value: F.array_distinct(F.array_compact(numbers(value))))


def obfuscated_emails(c: Column | str) -> Column:
    """Addresses written as "name [at] domain [dot] com" in prose; a pronoun is no local part."""
    local = r"(?i)(?<![\w.+-])([A-Z0-9._%+-]+)\s*(?:[\[({<]\s*at\s*[\])}>]|\s+at\s+)\s*"
    dotted = local + r"([A-Z0-9-]+(?:\s*(?:[\[({<]\s*dot\s*[\])}>]|\s+dot\s+)\s*[A-Z0-9-]+)+)(?![\w-])"
    plain = local + r"([A-Z0-9-]+(?:\.[A-Z0-9-]+)+)(?![\w-])"
    value = text(c)

    def pairs(pattern: str) -> Column:
        zipped = F.arrays_zip(F.regexp_extract_all(value, F.lit(pattern), 1).alias("l"), F.regexp_extract_all(value, F.lit(pattern), 2).alias("d"))
        kept = F.filter(zipped, lambda x: ~F.lower(x["l"]).isin("me", "you", "us", "him", "her", "them", "it", "we", "i"))
        return F.transform(kept, lambda x: F.lower(F.concat(x["l"], F.lit("@"), F.regexp_replace(x["d"], r"(?i)\s*(?:[\[({<]\s*dot\s*[\])}>]|\s+dot\s+)\s*", "."))))

    ok = lambda m: email_syntax(m) & ~m.rlike(alternation(fixed.SCRIPT_HINTS)) & ~in_domains(F.substring_index(m, "@", -1), fixed.BLOCKED_MAIL)
    return F.array_distinct(F.filter(F.concat(pairs(dotted), pairs(plain)), ok))


def xor_decode(c: Column | str) -> Column:
    """The address of a hex payload whose first byte is the key of the others; blank if it is none."""
    v = F.trim(text(c))
    key = F.conv(F.left(v, F.lit(2)), 16, 10).cast("int")
    bytes_ = F.transform(F.sequence(F.lit(3), F.length(v) - 1, F.lit(2)), lambda i: F.chr(F.conv(F.substring(v, i, F.lit(2)), 16, 10).cast("int").bitwiseXOR(key)))
    return F.when(v.rlike("^(?:[0-9a-fA-F]{2}){2,}$"), F.array_join(bytes_, "")).otherwise("")


def normalized_contact(channel: Column | str, c: Column | str) -> Column:
    """E-mail in lower case, phones in E.164 where they parse, else trimmed."""
    v = F.trim(text(c))
    return F.when(text(channel) == "email", F.lower(v)).otherwise(F.coalesce(e164(v), v))
