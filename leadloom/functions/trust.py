"""Identity and trust rules as boolean columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .contacts import usable_email
from .text import author_tokens, bound, col, compact, normalize_text, present, squeeze, text, title_tokens
from .urls import blocked_mail, desk_mailbox, domains_align, host, local_part, path, platform_source, public_url, publisher_site, registered_domain_of_email, registered_domain_of_url, role_hint


def _last(tokens: Column) -> Column:
    return F.coalesce(F.try_element_at(tokens, F.lit(-1)), F.lit(""))


def identity_appears(author: Column | str, title: Column | str, *values: Column | str, bridge: bool = True, surname: bool = True) -> Column:
    """Whether the author is named in the values: as a phrase, joined, by all tokens, by a surname of five letters (if allowed), or by the surname with min(2, n) title tokens (bridge)."""
    plain = normalize_text(F.concat_ws(" ", *map(text, values)))
    # Bound, so that tokens and texts are evaluated once a row and not once a token.
    parts = F.struct(author_tokens(author).alias("own"), title_tokens(title).alias("of_title"), plain.alias("plain"))
    return bound(parts, lambda p: bound(F.replace(p["plain"], F.lit(" "), F.lit("")), lambda joined: identity_of(p["own"], p["of_title"], p["plain"], joined, bridge, surname)))


def identity_of(own: Column, of_title: Column, plain: Column, joined: Column, bridge: bool = True, surname: bool = True) -> Column:
    """identity_appears() over prepared columns: tokens of author and title, the normal and the compact text."""
    phrase, run = F.array_join(own, " "), F.array_join(own, "")
    every = (F.size(own) >= 2) & F.forall(own, lambda t: F.contains(plain, t) | (F.contains(joined, t) if surname else F.lit(False)))
    out = F.contains(plain, phrase) | F.contains(joined, run) | every
    last = _last(own)
    if surname:
        out = out | (F.contains(plain, last) & (F.length(last) >= 5))
    if bridge:
        hits = F.size(F.filter(of_title, lambda t: F.contains(plain, t) | F.contains(joined, t)))
        least = F.least(F.lit(2), F.size(of_title))
        out = out | (F.contains(plain, last) & (hits >= least) & (F.lit(surname) | (least > 0)))
    return (F.size(own) > 0) & out


def identity_strict(author: Column | str, title: Column | str, *values: Column | str, bridge: bool = True) -> Column:
    """Without the lone-surname rule; all tokens must stand in the plain text."""
    return identity_appears(author, title, *values, bridge=bridge, surname=False)


#: Words of a name as the export and batch rules read them; the characters of a page's opening that they look at.
NAME_WORD, OPENING = r"[A-Za-z][A-Za-z'.-]+", 2500


def long_names(author: Column | str) -> Column:
    """The words of a name of four characters or more, in lower case; apostrophes, dots and hyphens are part of a word."""
    return F.transform(F.filter(F.regexp_extract_all(text(author), F.lit(NAME_WORD), F.lit(0)), lambda t: F.length(t) >= 4), F.lower)


def run_of(c: Column | str) -> Column:
    """Lower-case letters and digits without what stands between; accents are not folded, unlike compact()."""
    return F.regexp_replace(F.lower(text(c)), "[^a-z0-9]+", "")


def named_in_text(author: Column | str, *values: Column | str) -> Column:
    """Exports and batches: the joined name stands in the joined values, or min(2, n) of its long words stand in the values, plain or joined. A name without a long word is never found."""
    words = F.lower(F.concat_ws(" ", *map(text, values)))
    return named_of(long_names(author), run_of(author), words, run_of(words))


def named_of(own: Column, joined: Column, words: Column, run: Column) -> Column:
    """named_in_text() over prepared columns: long words and joined form of the name, the lower-case text and its joined form."""
    hits = F.size(F.filter(own, lambda t: F.contains(words, t) | F.contains(run, t)))
    return (F.size(own) > 0) & (F.contains(run, joined) | (hits >= F.least(F.lit(2), F.size(own))))


def profile_named(author: Column | str, title: Column | str, *values: Column | str) -> Column:
    """Social profiles: the whole name as a phrase or joined, else a surname of four characters with min(2, n) words of the title of four characters, one at least."""
    parts = lambda c: F.filter(F.split(squeeze(F.lower(text(c))), " "), lambda t: t != "")
    own, of_title = parts(author), F.filter(parts(title), lambda t: F.length(t) >= 4)
    plain = squeeze(F.lower(F.concat_ws(" ", *map(text, values))))
    whole = F.contains(plain, F.array_join(own, " ")) | F.contains(F.replace(plain, F.lit(" ")), F.array_join(own, ""))
    by_surname = (F.length(_last(own)) >= 4) & F.contains(plain, _last(own))
    hits = F.size(F.filter(of_title, lambda t: F.contains(plain, t)))
    return (F.size(own) > 0) & (whole | (by_surname & (F.size(of_title) > 0) & (hits >= F.least(F.lit(2), F.size(of_title)))))


def site_owned(author: Column | str, url: Column | str, page_title: Column | str, opening: Column | str | None = None) -> Column:
    """Whether a site looks like the author's: the joined name in its domain or page title, first and last long word in the domain, or a surname of five characters there.

    With the page's text as opening: in place of the lone surname, the joined name in the text's first OPENING characters, or the surname in the domain and the first word there.
    """
    own, joined = long_names(author), run_of(author)
    domain, first, last = run_of(F.regexp_replace(host(url), r"^www\.", "")), F.coalesce(F.try_element_at(own, F.lit(1)), F.lit("")), _last(own)
    out = F.contains(domain, joined) | F.contains(run_of(page_title), joined) | ((F.size(own) >= 2) & F.contains(domain, first) & F.contains(domain, last))
    if opening is None:
        out = out | ((F.length(last) >= 5) & F.contains(domain, last))
    else:
        start = run_of(F.left(text(opening), F.lit(OPENING)))
        out = out | F.contains(start, joined) | (F.contains(domain, last) & F.contains(start, first))
    return (F.size(own) > 0) & out


def label_matches(name: Column | str, label: Column | str) -> Column:
    """Every token of the name is a word of the label."""
    own = author_tokens(name)
    return (F.size(own) > 0) & (F.size(F.array_except(own, F.split(normalize_text(label), " "))) == 0)


def trusted_source(author: Column | str, title: Column | str, field: Column | str, value: Column | str, url: Column | str, kind: Column | str, source_title: Column | str | None = None, snippet: Column | str | None = None, named: Column | None = None, own: Column | None = None, usable: Column | None = None) -> Column:
    """Whether a source of a kind may vouch for a contact value. named, own and usable may be prepared: whether the author appears, their tokens, and whether type, value and source allow it."""
    f, v, k = text(field), text(value), text(kind)
    source_title, snippet = (F.lit("") if c is None else c for c in (source_title, snippet))
    social = k == "social_profile"
    usable = (v != "") & present(url) & k.isin(fixed.TRUSTED_TYPES) & (social | ~platform_source(url)) if usable is None else usable
    named = identity_appears(author, title, url, source_title, snippet) if named is None else named
    is_mail = f.isin(fixed.EMAIL_FIELDS)
    open_mail = ~blocked_mail(v) & ~desk_mailbox(v)
    by_social = named & F.when(is_mail, open_mail).otherwise(True)

    own, local = author_tokens(author) if own is None else own, compact(local_part(v))
    domain = compact(registered_domain_of_url(url))
    in_domain = F.exists(own, lambda t: (F.length(t) >= 4) & F.contains(domain, t))
    in_local = (F.size(own) > 0) & (F.contains(local, F.array_join(own, "")) | F.contains(local, _last(own)))
    handle, owned = local.isin(fixed.AUTHOR_HANDLES), k.isin("contact_page", "official_author_site", "groq_extraction")
    of_agent = f.isin("representation_email", "publicist_email")
    aligned = domains_align(v, url) & (named | in_domain | in_local | handle | owned | of_agent)
    public = named | in_local | (handle & owned)
    agent = named | role_hint(source_title, snippet) | publisher_site(url, source_title, snippet)
    by_mail = open_mail & (aligned | F.when(f == "public_email", public).otherwise(agent))
    by_phone = named | role_hint(url, source_title, snippet)
    return usable & F.when(social, by_social).when(is_mail, by_mail).when(f == "public_phone", by_phone).otherwise(named)


def email_matches_author(email: Column | str, author: Column | str, url: Column | str, trusted: Column) -> Column:
    """A usable address on an aligned or non-free domain of a trusted source, or with the name in its local part."""
    domain = F.lower(F.substring_index(text(email), "@", -1))
    by_source = trusted & (domains_align(email, url) | ~domain.isin(fixed.FREE_MAIL))

    def holds(x: Column) -> Column:
        own, local = x["own"], x["local"]
        last, run = _last(own), F.array_join(own, "")
        named = F.contains(local, run) | (F.contains(local, last) & (F.length(last) >= 4)) | ((F.size(own) >= 2) & F.forall(F.slice(own, 1, 2), lambda t: F.contains(local, t)))
        return (F.size(own) > 0) & (by_source | named)

    return usable_email(email) & ~platform_source(url) & bound(F.struct(author_tokens(author).alias("own"), compact(local_part(email)).alias("local")), holds)


def trusted_site(url: Column | str, author: Column | str, title: Column | str, page_title: Column | str | None = None) -> Column:
    return public_url(url) & ~platform_source(url) & identity_strict(author, title, url, *([] if page_title is None else [page_title]))


def trusted_social(url: Column | str, author: Column | str, title: Column | str) -> Column:
    return identity_strict(author, title, F.concat_ws(" ", path(url), host(url)), bridge=False)


def filter_socials(socials: Column, author: Column | str, title: Column | str) -> Column:
    """A map of field to URL, without URLs that do not name the author."""
    return F.map_filter(socials, lambda _, u: trusted_social(u, author, title))


def result_matches_book(result: Column | str, title: Column | str, code: Column | str) -> Column:
    """The identifier stands in the text, or min(3, n) title tokens do; placeholder titles never match by title."""
    from .text import placeholder_title

    def by_title(p: Column) -> Column:
        hits = F.size(F.filter(p["of_title"], lambda t: F.contains(p["plain"], t)))
        return (F.size(p["of_title"]) > 0) & (hits >= F.least(F.lit(3), F.size(p["of_title"])))

    by_id = present(code) & F.contains(F.lower(text(result)), F.lower(F.trim(text(code))))
    return by_id | (~placeholder_title(title, code) & bound(F.struct(normalize_text(result).alias("plain"), title_tokens(title).alias("of_title")), by_title))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


__all__ = ["any_of", "email_matches_author", "filter_socials", "identity_appears", "identity_strict", "label_matches", "long_names", "named_in_text", "named_of", "profile_named", "registered_domain_of_email", "result_matches_book", "site_owned", "trusted_site", "trusted_social", "trusted_source", "col"]
