"""Predicates and filters over leads and their books."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.coerce import year_window_string
from ..functions.contacts import email_syntax, usable_email
from ..functions.scores import with_lead_score
from ..functions.text import author_tokens, bound, corporate_author, normalize_text, present, text
from ..functions.trust import identity_appears, trusted_site, trusted_social
from ..functions.urls import platform_source, verified_listing_url

CONTACTS = ["public_email", "public_phone", "representation_email", "publicist_email"]


def any_present(columns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, map(present, columns))


def contactable(leads: DataFrame, extra: list[str] = ()) -> DataFrame:
    """Any contact column (or one of extra) is not blank."""
    return leads.where(any_present([*CONTACTS, *extra]))


def lead_search(
    leads: DataFrame,
    q: str = "",
    status: str = "",
    video_status: str = "",
    score_min: int | None = None,
    score_max: int | None = None,
    has_email: bool = False,
    has_phone: bool = False,
    has_listing: bool = False,
    has_website: bool = False,
    do_not_contact: bool = False,
    min_confidence: float | None = None,
    year_start: int | None = None,
    year_end: int | None = None,
    assignments: DataFrame | None = None,
    assignment_status: str = "",
    owner: str | int | None = None,
) -> DataFrame:
    """Optional filters, all of which must hold. Expects the flags verified_ready and needs_review where status asks for them."""
    out = leads
    if q.strip():
        needle = q.strip().lower()
        out = out.where(reduce(lambda a, b: a | b, (F.contains(F.lower(text(c)), F.lit(needle)) for c in ("title", "author_name", *fixed.EMAIL_FIELDS))))
    if status:
        out = out.where({"verified": F.expr("verified_ready"), "other": F.expr("needs_review")}.get(status, F.col("verification_status") == status))
    if video_status:
        out = out.where(F.col("video_status") == video_status)
    if score_min is not None:
        out = out.where(F.col("verification_score") >= score_min)
    if score_max is not None:
        out = out.where(F.col("verification_score") <= score_max)
    if has_email:
        out = out.where(any_present(fixed.EMAIL_FIELDS))
    if has_phone:
        out = out.where(present("public_phone"))
    if has_listing:
        out = out.where(present("amazon_book_url"))
    if has_website:
        out = out.where(present("canonical_website"))
    if do_not_contact:
        out = out.where("do_not_contact")
    if min_confidence:
        out = out.where(F.col("extraction_confidence") >= min_confidence)
    if year_start is not None or year_end is not None:
        out = out.where(year_window_string("publication_date", year_start, year_end))
    if assignments is not None and (assignment_status or owner is not None):
        current = assignments.where("is_current")
        current = current.where(F.col("status") == assignment_status) if assignment_status else current
        current = current.where(F.col("owner_id") == owner) if owner is not None else current
        out = out.join(current.select("lead_id"), "lead_id", "left_semi")
    return out


def visible_to(leads: DataFrame, assignments: DataFrame, role: str, user) -> DataFrame:
    """Management sees all, sales the leads currently assigned to them, others none."""
    if role in {"super_admin", "admin"}:
        return leads
    if role != "sales":
        return leads.where(F.lit(False))
    return leads.join(assignments.where(F.col("is_current") & (F.col("owner_id") == user)).select("lead_id"), "lead_id", "left_semi")


RUN_GROUPS = {"active": ["pending", "running"], "failed": ["failed", "canceled"]}


def run_search(runs: DataFrame, q: str = "", status: str = "") -> DataFrame:
    out = runs
    if q:
        out = out.where(F.contains(F.lower(text("keyword")), F.lit(q.lower())) | F.contains(F.lower(text("source_provider")), F.lit(q.lower())))
    return out.where(F.col("status").isin(RUN_GROUPS.get(status, [status]))) if status else out


def drop_corporate(df: DataFrame, author: str = "author_name") -> DataFrame:
    """Rows whose author is no company; blank authors stay."""
    return df.where(~corporate_author(author))


def purge_rejected(leads: DataFrame) -> tuple[DataFrame, Column]:
    """The rows that stay (NULL-safe), and the condition of those that go."""
    gone = F.coalesce(F.col("lead_tier") == "rejected", F.lit(False)) | F.coalesce(F.col("manual_review_status") == "rejected", F.lit(False))
    return leads.where(~gone), gone


def qualified(leads: DataFrame, listing: bool = False, author: bool = False, email: bool = False, phone: bool = False) -> DataFrame:
    out = leads.where(~F.col("do_not_contact"))
    for on, c in ((listing, "amazon_book_url"), (author, "author_name"), (phone, "public_phone")):
        out = out.where(present(c)) if on else out
    return out.where(any_present(fixed.EMAIL_FIELDS)) if email else out


def contact_requirement(requirement: Column | str) -> Column:
    """Whether a lead row meets the requirement named in a column."""
    r = text(requirement) if not isinstance(requirement, Column) else requirement
    email, phone = any_present(fixed.EMAIL_FIELDS), present("public_phone")
    return F.when(r == "email_or_phone", email | phone).when(r == "email_only", email).when(r == "phone_only", phone).when(r == "email_and_phone", email & phone).when(r == "verified_contact", F.col("verified_ready")).otherwise(True)


def messages(*pairs: tuple[Column, str | Column]) -> Column:
    """The messages whose condition holds, in order."""
    return F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), m if isinstance(m, Column) else F.lit(m)) for c, m in pairs)))


def compliance_errors(row_sources: dict[str, Column]) -> Column:
    """Messages on opt-out (alone if it holds), location, contact mail and the evidence of each mail; row_sources has a flag per field: evidence with a source exists."""
    place = F.lower(F.trim(text("location")))
    foreign = place.rlike(rf"\b(?:{'|'.join(fixed.FOREIGN)})\b")
    mail = F.coalesce(*(F.nullif(text(c), F.lit("")) for c in fixed.EMAIL_FIELDS), F.lit(""))
    names = {"public_email": "Public email", "representation_email": "Representation email", "publicist_email": "Publicist email"}
    rest = messages(
        (foreign, F.concat(F.lit("Compliance error: Author location '"), text("location"), F.lit("' is in a non-target foreign country."))),
        (mail == "", "Compliance error: Lead is missing a valid contact email."),
        ((mail != "") & ~usable_email(mail), F.concat(F.lit("Compliance error: Contact email '"), mail, F.lit("' is invalid, a dummy placeholder, or a generic administrative desk."))),
        *((present(c) & ~row_sources[c], f"Compliance error: {names[c]} is missing registered public source URL evidence.") for c in fixed.EMAIL_FIELDS),
    )
    return F.when(F.coalesce(F.col("do_not_contact"), F.lit(False)), F.array(F.lit("Compliance error: Lead is marked as do-not-contact (Opted Out)."))).otherwise(rest)


def verification_errors(verified: dict[str, Column], compliance: Column, require_listing: bool = True, require_email: bool = True, social_only: bool = False) -> Column:
    """The ordered messages of the gate; verified has a flag per contact field: a trusted source supports it."""
    own = messages(
        (F.lit(require_listing) & ~verified_listing_url("amazon_book_url", "asin"), "Missing a verified Amazon marketplace book URL."),
        (~present("title") | ~present("author_name"), "Missing title or author."),
        (corporate_author("author_name"), "Author is a publisher or company, not an individual author."),
        (~F.col("is_childrens_book"), "Book was classified as not a children's book."),
        (F.col("identity_confidence") < 0.65, "Author identity confidence is below verified threshold."),
        (F.lit(require_email) & ~any_present(fixed.EMAIL_FIELDS), "Missing public email."),
        (present("public_email") & ~verified["public_email"], "Public email is missing a high-confidence author-site/contact-page source."),
        (present("representation_email") & ~verified["representation_email"], "Representation email is missing a verified agency/publisher source."),
        (present("publicist_email") & ~verified["publicist_email"], "Publicist email is missing a verified publisher/publicity source."),
        (present("public_phone") & ~verified["public_phone"], "Public phone is missing a verified author-site/contact-page source."),
        (F.lit(not social_only) & ~any_present([*CONTACTS, "contact_page_url"]), "No direct public email, phone, or contact page."),
    )
    return F.concat(own, compliance)


def approval_decision(verified: dict[str, Column], compliance: Column, has_book_evidence: Column, location_source: Column, incomplete_video: bool = False, identity_override: bool = False) -> Column:
    """struct(ok, errors): eligibility (verified_ready and uploader flags), sources, video, suppression, identity, then the gate without duplicates."""
    suppressed = F.coalesce(F.col("do_not_contact"), F.lit(False)) | (text("manual_review_status") == "do_not_contact")
    own = messages(
        (suppressed, "Lead is marked do-not-contact."),
        (~F.col("has_verified_contact"), "Lead has no current system-verified contact."),
        (~verified_listing_url("amazon_book_url", "asin") & ~has_book_evidence, "Lead needs an Amazon URL or strong book source."),
        (~present("author_name"), "Lead needs an author name."),
        (~present("title"), "Lead needs a book title."),
        (~any_present(["public_email", "public_phone", "contact_page_url", "canonical_website", "instagram_url", "facebook_url"]), "Lead needs at least one public contact path."),
        (present("public_email") & ~verified["public_email"], "public_email is missing a source URL."),
        (present("public_phone") & ~verified["public_phone"], "public_phone is missing a source URL."),
        (present("location") & ~location_source, "location is missing a source URL."),
        ((text("video_status") == "not_checked") & F.lit(not incomplete_video), "Video search is incomplete."),
        (suppressed, "Lead is marked do-not-contact."),
        ((F.col("identity_confidence") < 0.5) & F.lit(not identity_override), "Author identity is unclear."),
    )
    gate = verification_errors(verified, compliance, require_email=False, social_only=True)
    errors = bound(own, lambda o: F.concat(o, F.array_except(gate, o)))
    return bound(errors, lambda e: F.struct((F.size(e) == 0).alias("ok"), e.alias("errors")))


def usable_author(name: Column | str) -> Column:
    """Whether an export takes the name for an author's: the length of its normal form, no part that is no name, two words of two letters or more."""

    def holds(value: Column) -> Column:
        bad = reduce(lambda a, b: a | b, (F.contains(value, F.lit(w)) for w in fixed.EXPORT_NAME_STOPS))
        return F.char_length(value).between(5, 90) & ~bad & (F.size(F.regexp_extract_all(value, F.lit("[a-z][a-z]+"), F.lit(0))) >= 2)

    return bound(normalize_text(name), holds)


def export_validation_errors(best: Column) -> Column:
    """Up to seven messages on a row to export; best is the struct of its best contact evidence, or NULL."""
    suppressed = F.coalesce(F.col("do_not_contact"), F.lit(False)) | (text("manual_review_status") == "do_not_contact")
    holds = [
        ~usable_author("author_name"), ~F.contains(text("amazon_book_url"), F.lit("/dp/")), ~any_present(["public_email", "public_phone"]), present("public_email") & ~email_syntax("public_email"),
        best.isNull(), suppressed, text("verification_status") != "verified",
    ]
    return messages(*zip(holds, fixed.EXPORT_ERRORS, strict=True))


def clear_unverified(leads: DataFrame, verified: dict[str, Column]) -> DataFrame:
    """Contact columns blank unless a trusted source supports them, a warning for each that was cleared."""
    gone = {c: present(c) & ~v for c, v in verified.items()}
    warnings = F.concat(F.coalesce(F.col("warnings"), F.array().cast("array<string>")), messages(*((g, f"{c} was cleared: no trusted source.") for c, g in gone.items())))
    return leads.withColumns({"warnings": warnings} | {c: F.when(g, "").otherwise(F.col(c)) for c, g in gone.items()})


def drop_untrusted_extracted(extracted: DataFrame, items: DataFrame, verified: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(extracted, items): contact values that no trusted source supports become null with a warning, and their evidence items go.

    extracted has lead_id, the contact columns, warnings (or none) and what `verified` reads; items has lead_id, field_name, field_value.
    """
    gone = {c: present(c) & ~v for c, v in verified.items()}
    warnings = F.col("warnings") if "warnings" in extracted.columns else F.lit(None)
    told = messages(*((g, f"Dropped {c} because its source was not an author/agent/publisher contact page for this book.") for c, g in gone.items()))
    lost = extracted.select("lead_id", F.explode(F.array_compact(F.array(*(F.when(g, F.struct(F.lit(c).alias("field_name"), text(c).alias("field_value"))) for c, g in gone.items())))).alias("x")).select("lead_id", "x.*")
    out = extracted.withColumns({"warnings": F.concat(F.coalesce(warnings.cast("array<string>"), F.array().cast("array<string>")), told)} | {c: F.when(~g, F.col(c)) for c, g in gone.items()})
    return out, items.join(lost.distinct(), ["lead_id", "field_name", "field_value"], "left_anti")


#: Addresses of profiles that may not lie on catalogs or shops.
URLS = ("canonical_website", "contact_page_url", "publisher_url")


def unsupported(verified: dict[str, Column], urls: list[str]) -> dict[str, Column]:
    """Per column, whether it is to be cleared: a contact without a trusted source, an address on a catalog or shop."""
    return {c: present(c) & ~v for c, v in verified.items()} | {c: present(c) & platform_source(c) for c in urls}


def sanitize_contacts(leads: DataFrame, verified: dict[str, Column], urls: list[str] = URLS) -> DataFrame:
    """leads with contacts without a trusted source and profile addresses on catalogs or shops blank, n_contacts and n_urls cleared and their names (`cleared`), and a warning for each."""
    urls = [c for c in urls if c in leads.columns]
    # Staged, so that each host is read once a row: the warnings, counts, names and columns all ask for it.
    rows = leads.withColumns({f"_gone_{c}": g for c, g in unsupported(verified, urls).items()})
    contacts, pages = ({c: F.col(f"_gone_{c}") for c in names} for names in (verified, urls))
    told = messages(
        *((g, f"Sanitized {c}: source did not pass trusted author/agent/publisher checks.") for c, g in contacts.items()),
        *((g, F.concat(F.lit(f"Sanitized {c}: removed catalog/bookstore/library URL "), text(c), F.lit("."))) for c, g in pages.items()),
    )
    count = lambda flags: reduce(lambda a, b: a + b, (F.coalesce(g, F.lit(False)).cast("int") for g in flags.values()), F.lit(0))
    before = F.coalesce(F.col("warnings").cast("array<string>"), F.array().cast("array<string>")) if "warnings" in leads.columns else F.array().cast("array<string>")
    gone = F.array_compact(F.array(*(F.when(g, F.lit(c)) for c, g in (contacts | pages).items())))
    out = rows.withColumns({"warnings": F.concat(before, told), "n_contacts": count(contacts), "n_urls": count(pages), "cleared": gone} | {c: F.when(g, "").otherwise(F.col(c)) for c, g in (contacts | pages).items()})
    return out.drop(*(f"_gone_{c}" for c in contacts | pages))


def sanitize_counts(sanitized: DataFrame) -> DataFrame:
    """The counts of a dry run: rows scanned and changed, contacts and addresses cleared."""
    changed = (F.col("n_contacts") > 0) | (F.col("n_urls") > 0)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return sanitized.agg(F.count(F.lit(1)).alias("scanned"), F.count_if(changed).alias("changed"), total("n_contacts").alias("cleared_contacts"), total("n_urls").alias("cleared_urls"))


def sanitize_leads(star: DataFrame, verified: dict[str, Column], as_of_year: int, key: str = "author_id") -> tuple[DataFrame, DataFrame]:
    """(leads, profiles): sanitize_contacts with what follows from it.

    leads are the rows of star (leads with their book and author) after clearing; those that were changed have a new lead_score, lead_tier and service_needs, and manual_review_status `rejected` if they are rejected now.
    profiles are those of profiles_to_clear. Nothing is written: each is worked out where it is read, and the profiles need no score.
    """
    scored = with_lead_score(sanitize_contacts(star, verified), as_of_year)
    changed = F.size("cleared") > 0
    status = F.when(changed & (F.col("tier") == "rejected"), "rejected").otherwise(F.col("manual_review_status"))
    needs = F.when(changed, F.col("needs")).otherwise(F.col("service_needs") if "service_needs" in star.columns else F.lit(None).cast("array<string>"))
    kept = {"lead_score": F.when(changed, F.col("score")).otherwise(F.col("lead_score")), "lead_tier": F.when(changed, F.col("tier")).otherwise(F.col("lead_tier")), "service_needs": needs, "manual_review_status": status}
    return scored.withColumns(kept).drop("score", "tier", "needs"), profiles_to_clear(star, verified, key)


def profiles_to_clear(leads: DataFrame, verified: dict[str, Column], key: str = "author_id", urls: list[str] = URLS) -> DataFrame:
    """(key, cleared: field names): which columns of which author profiles are to be blank: addresses on catalogs or shops, and agent and publicist mails that sanitize_contacts clears on one of the author's leads.

    Public contacts are the lead's own and not judged; an address is judged once a profile that has it, not once a lead.
    """
    urls, mails = [c for c in urls if c in leads.columns], {c: v for c, v in verified.items() if c not in ("public_email", "public_phone")}
    any_of = lambda fields: [F.bool_or(f"_gone_{c}").alias(f"_gone_{c}") for c in fields]
    held = leads.where(F.col(key).isNotNull()).select(key, *urls, *(g.alias(f"_gone_{c}") for c, g in unsupported(mails, []).items()))
    pages = held.groupBy(key, *urls).agg(*any_of(mails)).withColumns({f"_gone_{c}": g for c, g in unsupported({}, urls).items()})
    own = pages.groupBy(key).agg(*any_of([*mails, *urls]))
    names = F.array_compact(F.array(*(F.when(F.col(f"_gone_{c}"), F.lit(c)) for c in sorted([*mails, *urls]))))
    return own.select(key, names.alias("cleared")).where(F.size("cleared") > 0)


def clear_profiles(authors: DataFrame, profiles: DataFrame, key: str = "author_id") -> DataFrame:
    """authors with the columns that sanitize_leads names blank."""
    fields = [c for c in ("canonical_website", "contact_page_url", "publisher_url", "representation_email", "publicist_email") if c in authors.columns]
    rows = authors.join(profiles.select(key, F.col("cleared").alias("_cleared")), key, "left")
    return rows.withColumns({c: F.when(F.coalesce(F.array_contains("_cleared", c), F.lit(False)), "").otherwise(F.col(c)) for c in fields}).drop("_cleared").select(authors.columns)


SOCIALS = ["instagram_url", "facebook_url", "tiktok_url", "youtube_url", "linkedin_url"]


def drop_unmatched_urls(extracted: DataFrame, listing: str = "canonical_url") -> DataFrame:
    """extracted (author_name, title, URL columns, warnings or none) without URLs that fail their check, each with a warning: website and contact page that are no trusted site of the author, social
    profiles that don't name the author, publisher addresses on catalogs or shops. A publisher address that is the listing's own goes without a warning."""
    site = lambda c: ~trusted_site(c, "author_name", "title")
    told = {"canonical_website": ("Dropped unverified official website candidate: ", site("canonical_website")), "contact_page_url": ("Dropped unverified contact page candidate: ", site("contact_page_url"))}
    told |= {c: ("Dropped social profile that did not match the author identity: ", ~trusted_social(c, "author_name", "title")) for c in SOCIALS}
    told["publisher_url"] = ("Dropped catalog/bookstore URL misclassified as publisher: ", platform_source("publisher_url"))
    own = present("publisher_url") & (F.col("publisher_url") == F.col(listing)) if listing in extracted.columns else F.lit(False)
    held = {c: present(c) & F.coalesce(bad, F.lit(True)) for c, (_, bad) in told.items() if c in extracted.columns}
    if "publisher_url" in held:
        held["publisher_url"] &= ~F.coalesce(own, F.lit(False))
    before = F.col("warnings").cast("array<string>") if "warnings" in extracted.columns else F.lit(None).cast("array<string>")
    lines = messages(*((g, F.concat(F.lit(told[c][0]), text(c))) for c, g in held.items()))
    gone = held | ({"publisher_url": held["publisher_url"] | F.coalesce(own, F.lit(False))} if "publisher_url" in held else {})
    return extracted.withColumns({"warnings": F.concat(F.coalesce(before, F.array().cast("array<string>")), lines)} | {c: F.when(~g, F.col(c)) for c, g in gone.items()})


def usable_results(results: DataFrame, code: Column | None = None) -> DataFrame:
    """Search results that are no access wall or generic page; with a code, only those that hold it."""
    words = F.lower(F.concat_ws(" ", text("title"), text("snippet"), text("url")))
    out = results.where(~reduce(lambda a, b: a | b, (F.contains(words, F.lit(w)) for w in fixed.ACCESS_WALLS)))
    return out if code is None else out.where(F.contains(words, F.lower(text(code))))


__all__ = [n for n in dir() if n[0].islower() and n not in {"annotations", "reduce", "fixed", "author_tokens", "normalize_text", "identity_appears", "email_syntax", "platform_source", "with_lead_score", "trusted_site", "trusted_social"}] + ["CONTACTS", "URLS"]
