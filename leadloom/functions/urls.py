"""Column functions over URLs, hosts and domains."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import alternation, bound, col, first_present, has_any, present, text


def host(url: Column | str) -> Column:
    """Lower-case host of a URL; a URL that Spark's parser rejects (a space in it, say) is read by a pattern. Blank without a host."""
    value = text(url)
    loose = F.regexp_extract(value, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:@]*)", 1)
    return F.lower(F.coalesce(F.try_parse_url(value, F.lit("HOST")), loose))


def path(url: Column | str) -> Column:
    return F.regexp_extract(text(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def suffixes(domain: Column) -> Column:
    """The domain and all its parents: a.b.c, b.c, c."""
    labels = F.split(domain, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def in_domains(domain: Column, listed: list[str]) -> Column:
    """Whether the domain equals a listed one or lies under it."""
    return domain.rlike(rf"(?:^|\.)(?:{alternation(listed)})\z")


def marketplace_host(url: Column | str) -> Column:
    """The marketplace that a URL's host is or lies under, else NULL."""
    return F.nullif(F.regexp_extract(F.rtrim(host(url), F.lit(".")), rf"(?:^|\.)({alternation(fixed.MARKETPLACE_HOSTS)})\z", 1), F.lit(""))


def listing_id(url: Column | str) -> Column:
    return F.nullif(F.upper(F.regexp_extract(text(url), r"(?i)/(?:dp|gp/product|product)/([A-Z0-9]{10})(?:[/?#]|$)", 1)), F.lit(""))


def canonical_listing_url(url: Column | str, tag: Column | str | None = None) -> Column:
    market, code = marketplace_host(url), listing_id(url)
    query = F.lit("") if tag is None else F.when(present(tag), F.concat(F.lit("?tag="), F.url_encode(text(tag)))).otherwise("")
    return F.when(market.isNotNull() & code.isNotNull(), F.concat(F.lit("https://www."), market, F.lit("/dp/"), code, query)).otherwise(text(url))


def listing_confidence(title: Column | str, url: Column | str, snippet: Column | str) -> Column:
    """0 off the marketplaces; .45, .35 more for an identifier, .15 for a term; at most .95."""
    hit = has_any(F.concat_ws(" ", text(title), text(snippet)), fixed.LISTING_TERMS)
    score = F.lit(0.45) + F.when(listing_id(url).isNotNull(), 0.35).otherwise(0.0) + F.when(hit, 0.15).otherwise(0.0)
    return F.when(marketplace_host(url).isNull(), 0.0).otherwise(F.least(F.round(score, 2), F.lit(0.95)))


def verified_listing_url(url: Column | str, stored_id: Column | str) -> Column:
    code, stored = F.when(marketplace_host(F.trim(text(url))).isNotNull(), listing_id(F.trim(text(url)))), F.upper(F.trim(text(stored_id)))
    return F.coalesce(code.isNotNull() & ((stored == "") | (stored == code)), F.lit(False))


def host_contains(url: Column | str, fragments: list[str]) -> Column:
    return host(url).rlike(alternation(fragments))


def platform_source(url: Column | str) -> Column:
    return host_contains(url, fixed.PLATFORM_HOSTS)


class SuffixRules:
    """Public-suffix rules as their list writes them: `co.uk`, `*.ck` (any label below), `!www.ck` (an exception to a wildcard); blank lines and those that start with // are passed over."""

    def __init__(self, lines: Iterable[str]):
        rules = [x.split()[0].strip(".").lower() for x in lines if x.strip() and not x.lstrip().startswith("//")]
        self.exceptions = [r[1:] for r in rules if r.startswith("!")]
        self.wild = [r[2:] for r in rules if r.startswith("*.")]
        self.plain = [r for r in rules if r[0] not in "!*"]
        self.deepest = max((r.count(".") + 1 for r in rules), default=1)

    def suffix_labels(self, labels: Column) -> Column:
        """How many labels at the end are the public suffix: those of an exception less one, else of the longest rule, else one.

        The ends of a domain are looked up in hashed sets of literals, one of each kind of rule, up to the depth of the deepest rule: the longest match costs a few look-ups a row, and no join.
        """
        n = F.size(labels)
        ends = F.transform(F.sequence(F.lit(1), F.least(n, F.lit(self.deepest))), lambda k: F.struct(k.alias("k"), F.array_join(F.slice(labels, n - k + 1, k), ".").alias("s")))
        within = lambda s, rules: s.isin(rules) if rules else F.lit(False)
        below = lambda s: F.when(F.contains(s, F.lit(".")), F.regexp_replace(s, r"^[^.]*\.", ""))
        excepted = F.array_max(F.transform(F.filter(ends, lambda e: within(e["s"], self.exceptions)), lambda e: e["k"]))
        matched = F.array_max(F.transform(F.filter(ends, lambda e: within(e["s"], self.plain) | F.coalesce(within(below(e["s"]), self.wild), F.lit(False))), lambda e: e["k"]))
        return F.coalesce(excepted - 1, matched, F.lit(1))


def registered_domain(domain: Column, rules: SuffixRules | None = None) -> Column:
    """The last label before the public suffix, with it; a host without one is itself, as is an address of numbers. Without rules the suffixes of two labels of fixed.TWO_LABEL_SUFFIXES hold."""
    if rules is not None:
        labels = F.split(F.lower(domain), r"\.")
        keep = rules.suffix_labels(labels) + 1
        inside = F.array_join(F.slice(labels, F.size(labels) - keep + 1, keep), ".")
        return F.when(domain.rlike(r"^\d+(\.\d+){3}$") | (F.size(labels) < keep), F.lower(domain)).otherwise(inside)
    # Read from the end of the string, without an array of labels: this is evaluated for every address and URL.
    low = F.lower(domain)
    two, three = F.substring_index(low, ".", -2), F.substring_index(low, ".", -3)
    return F.when(domain.rlike(r"^\d+(\.\d+){3}$"), low).when(two.isin(fixed.TWO_LABEL_SUFFIXES), three).otherwise(two)


def registered_domain_of_url(url: Column | str, rules: SuffixRules | None = None) -> Column:
    return registered_domain(host(url), rules)


def registered_domain_of_email(email: Column | str) -> Column:
    value = text(email)
    return F.when(F.contains(value, F.lit("@")), registered_domain(F.substring_index(value, "@", -1))).otherwise("")


def local_part(email: Column | str) -> Column:
    value = text(email)
    return F.when(F.contains(value, F.lit("@")), F.lower(F.substring_index(value, "@", 1))).otherwise("")


def blocked_mail(email: Column | str) -> Column:
    """On a blocked domain or without a domain."""
    return bound(registered_domain_of_email(email), lambda domain: (domain == "") | in_domains(domain, fixed.BLOCKED_MAIL))


def desk_mailbox(email: Column | str, strict: bool = False) -> Column:
    return local_part(email).isin(fixed.DESKS + (["sales", "marketing"] if strict else []))


def under(a: Column, b: Column) -> Column:
    """Equal, or one a sub-domain of the other."""
    return (a == b) | a.endswith(F.concat(F.lit("."), b)) | b.endswith(F.concat(F.lit("."), a))


def domains_align(email: Column | str, url: Column | str) -> Column:
    a, b = registered_domain_of_email(email), registered_domain_of_url(url)
    return (a != "") & (b != "") & under(a, b)


def mail_on_website(email: Column | str, website: Column | str) -> Column:
    """The score's looser form: substring containment of domains, free mail left out."""
    mail = F.trim(F.split_part(F.lower(text(email)), F.lit("@"), F.lit(2)))
    site = F.regexp_replace(F.lower(text(website)), r"^[^:]*://", "")
    site = F.trim(F.regexp_replace(F.substring_index(site, "/", 1), r"^www\.", ""))
    usable = F.contains(text(email), F.lit("@")) & present(website) & ~mail.isin([d for d in fixed.FREE_MAIL if d != "googlemail.com"])
    return usable & (F.contains(site, mail) | F.contains(mail, site))


def url_key(url: Column | str) -> Column:
    value = F.regexp_replace(F.lower(F.trim(text(url))), r"^[a-z][a-z0-9+.-]*://", "")
    return F.regexp_replace(F.regexp_replace(value, r"[?#].*$", ""), "/+$", "")


def root_website(url: Column | str) -> Column:
    return F.regexp_extract(text(url), r"^(https?://[^/?#]+)", 1)


def url_handle(url: Column | str) -> Column:
    """The last part of the path, without @, lower case."""
    parts = F.filter(F.split(path(url), "/"), lambda p: p != "")
    return F.lower(F.ltrim(F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit("")), F.lit("@")))


def public_url(url: Column | str) -> Column:
    """An http(s) URL with a host that is not local and no private part in its path."""
    h = host(url)
    parts = F.transform(F.split(path(url), "/"), F.lower)
    local = h.isin("localhost", "0.0.0.0") | h.startswith("127.")
    return text(url).rlike("^(?i)https?://") & (h != "") & ~local & ~F.arrays_overlap(parts, F.array(*map(F.lit, fixed.PRIVATE_PATHS)))


def publisher_site(url: Column | str, *values: Column | str) -> Column:
    words = F.concat_ws(" ", F.replace(host(url), F.lit("-"), F.lit(" ")), *map(text, values))
    return present(url) & ~platform_source(url) & words.rlike(fixed.PUBLISHER_HINT)


def role_hint(*values: Column | str) -> Column:
    return F.concat_ws(" ", *map(text, values)).rlike(fixed.ROLE_HINT)


def classify_url(url: Column | str) -> Column:
    """struct(kind, confidence): listing, social class, unrelated, publisher site or author site, in that order."""
    low = F.lower(text(url))
    kind = F.when(F.contains(low, F.lit("amazon.")) & low.rlike("/dp/|/gp/product/|/product/"), "amazon_book")
    confidence = F.when(kind == "amazon_book", 0.9)
    for part, name in fixed.SOCIAL_HOSTS.items():
        hit = F.contains(low, F.lit(part))
        kind = kind.when(hit, name)
    kind = kind.when(platform_source(url), "unrelated").when(publisher_site(url), "publisher_site").otherwise("author_site")
    confidence = F.when(kind == "amazon_book", 0.9).when(kind == "unrelated", 0.2).when(kind == "publisher_site", 0.55).when(kind == "author_site", 0.45).otherwise(0.85)
    return F.struct(kind.alias("kind"), confidence.alias("confidence"))


#: Paths that are tried on an author's site.
SITE_PATHS = ["/"] + [f"/{p}" for p in "contact contact-us about about-me about-the-author author books media media-kit press press-kit school-visits author-visits speaking events appearances work-with-me hire-me faq".split()]


def candidate_pages(url: Column | str) -> Column:
    root = root_website(url)
    return F.when(root != "", F.transform(F.array(*map(F.lit, SITE_PATHS)), lambda p: F.concat(root, p))).otherwise(F.array().cast("array<string>"))


__all__ = [n for n in dir() if not n.startswith("_") and n not in {"F", "Column", "annotations", "fixed", "alternation", "bound", "col", "first_present", "has_any", "present", "text"}]
