"""Wide and relational exports. Each returns DataFrames; write_csv() writes them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.contacts import email_syntax
from ..functions.text import alternation, first_present, normalize_text, present, text
from ..functions.trust import long_names, named_of, run_of
from ..functions.urls import registered_domain_of_url
from .dedupe import dedupe_first
from .filters import any_present, export_validation_errors, usable_author
from .aggregates import source_urls

LEAD = ["lead_id", "public_email", "public_phone", "representation_email", "publicist_email", "location", "video_status", "video_confidence", "lead_score", "lead_tier", "verification_status", "verification_score", "extraction_confidence", "manual_review_status", "do_not_contact", "created_at"]
BOOK = ["book_id", "title", "asin", "amazon_book_url", "category", "publisher", "publication_date", "rating", "review_count", "is_childrens_book", "is_picture_or_illustrated_book", "has_aplus_content"]
AUTHOR = ["author_id", "author_name", "canonical_website", "contact_page_url", "instagram_url", "facebook_url", "tiktok_url", "youtube_url", "linkedin_url", "goodreads_url", "amazon_author_url", "identity_confidence"]


def leads_wide(star: DataFrame, evidence: DataFrame, verified: DataFrame) -> DataFrame:
    """A flat row per lead: columns of lead, book and author that the star has; public contacts only if verified (lead_id, channel); the best evidence of each; all sources joined."""
    ok = verified.select("lead_id", "channel").distinct().groupBy("lead_id").pivot("channel", ["email", "phone"]).agg(F.lit(True)).withColumnsRenamed({"email": "_email_ok", "phone": "_phone_ok"})
    best = evidence.where(F.col("field_name").isin("public_email", "public_phone") & present("source_url")).groupBy("lead_id").pivot("field_name", ["public_email", "public_phone"]).agg(F.max(F.struct("confidence", "source_url")))
    best = best.select("lead_id", *(F.col(f"{c}.{k}").alias(f"{c}_{n}") for c in ("public_email", "public_phone") for k, n in (("source_url", "evidence_url"), ("confidence", "evidence_confidence"))))
    rows = star.join(ok, "lead_id", "left").join(best, "lead_id", "left").join(source_urls(evidence), "lead_id", "left")
    columns = [c for c in dict.fromkeys(LEAD + BOOK + AUTHOR) if c in star.columns]
    hidden = {"public_email": F.col("_email_ok"), "public_phone": F.col("_phone_ok")}
    return rows.select(*(F.when(F.coalesce(hidden[c], F.lit(False)), text(c)).otherwise("").alias(c) if c in hidden else F.col(c) for c in columns), *[c for c in best.columns if c != "lead_id"], text("source_urls").alias("source_urls"))


def tables_four(star: DataFrame, contacts: DataFrame, activities: DataFrame) -> dict[str, DataFrame]:
    """Authors, books, contact evidence and outreach, keyed by lead id."""
    author_type = F.when(F.col("is_picture_or_illustrated_book"), "illustrated").when(F.col("is_childrens_book"), "children").otherwise("other")
    cover = F.when(F.col("rating") >= 4.5, "strong").when(F.col("rating") >= 4.0, "fair").when(F.col("rating").isNotNull(), "weak").otherwise("unknown")
    return {
        "authors": star.select("lead_id", "author_name", author_type.alias("author_type"), *[c for c in AUTHOR[2:] if c in star.columns]),
        "books": star.select("lead_id", *[c for c in BOOK if c in star.columns], cover.alias("cover_quality")),
        "contacts": contacts.select("lead_id", F.col("field_name").alias("contact_type"), F.col("field_value").alias("contact_value"), "source_url", "confidence"),
        "outreach": activities,
    }


def filtered(star: DataFrame, status: str = "", with_email: bool = False, required: list[str] = (), with_social: bool = False, include_dnc: bool = False, most: int = 700) -> DataFrame:
    out = star if include_dnc else star.where(~F.coalesce(F.col("do_not_contact"), F.lit(False)))
    out = out.where(F.col("verification_status") == status) if status else out
    out = out.where(any_present(fixed.EMAIL_FIELDS)) if with_email else out
    for c in required:
        out = out.where(present(c))
    if with_social:
        out = out.where(any_present([c for c in ("instagram_url", "facebook_url", "tiktok_url", "youtube_url", "linkedin_url") if c in star.columns]))
    return out.orderBy(F.desc("lead_score"), "lead_id").limit(min(max(most, 1), 700))


def lead_key() -> Column:
    """Identifier, else mail, else author and title."""
    return first_present(F.upper(text("asin")), F.lower(text("public_email")), F.concat_ws("::", normalize_text("author_name"), normalize_text("title")))


def validated(star: DataFrame, best: DataFrame, most: int | None = None) -> DataFrame:
    """Verified leads without a validation error, first of each key by verification score, then newest."""
    rows = star.join(best.select("lead_id", F.struct("field_name", "field_value", "source_url", "confidence").alias("best")), "lead_id", "left")
    good = rows.where(F.size(export_validation_errors(F.col("best"))) == 0)
    order = [F.desc("verification_score"), F.desc("created_at"), F.col("lead_id")]
    out = dedupe_first(good, lead_key(), order)
    return out if most is None else out.orderBy(*order).limit(min(max(most, 1), 700))


def contact_evidence(evidence: DataFrame, subjects: DataFrame, floor: float = 0.45) -> DataFrame:
    """Per lead of subjects (lead_id, author_name) the best evidence of its public mail and of its phone, as structs; NULL where there is none.

    Evidence has a source off the generic domains whose URL, title or snippet names the author, a confidence of `floor` or more, and a mail of valid form. The greatest confidence, then the newest, then the greatest id is best.
    """
    mail = F.col("field_name") == "public_email"
    fit = F.col("field_name").isin("public_email", "public_phone") & present("source_url") & (F.col("confidence") >= floor) & (~mail | email_syntax("field_value"))
    rows = evidence.where(fit & ~registered_domain_of_url("source_url").isin(fixed.GENERIC_CONTACT_DOMAINS))
    # Staged, so that names and texts are evaluated once a row and not once a word.
    rows = rows.withColumn("_words", F.lower(F.concat_ws(" ", *map(text, ("source_url", "source_title", "source_snippet"))))).withColumn("_run", run_of("_words"))
    people = subjects.select("lead_id", long_names("author_name").alias("_own"), run_of("author_name").alias("_joined"))
    named = rows.join(people, "lead_id").where(named_of(F.col("_own"), F.col("_joined"), F.col("_words"), F.col("_run")))
    best = lambda c: F.max_by(F.struct("field_value", "source_url", "confidence"), F.when(F.col("field_name") == c, F.struct("confidence", "created_at", "evidence_id")))
    return named.groupBy("lead_id").agg(best("public_email").alias("email"), best("public_phone").alias("phone"))


def contactable(star: DataFrame, evidence: DataFrame) -> DataFrame:
    """Verified leads that may be contacted, with a listing's URL, a name that one can write to, and evidence of a mail or phone; first of each key by verification score, then newest.

    The star's columns, with public_email and public_phone as the evidence has them (else blank), phone_or_email, contact_source_url and contact_confidence of the mail's evidence, else of the phone's.
    """
    name = F.lower(text("author_name"))
    may = present("amazon_book_url") & usable_author("author_name") & ~name.rlike(alternation(fixed.OUTREACH_NAME_STOPS)) & ~F.coalesce(F.col("do_not_contact"), F.lit(False))
    leads = star.where(may & (F.col("verification_status") == "verified")).withColumn("_key", lead_key())
    best = contact_evidence(evidence, leads)
    first = F.coalesce("email", "phone")
    mail, phone = text("email.field_value"), text("phone.field_value")
    over = {"public_email": mail, "public_phone": phone, "phone_or_email": first_present(mail, phone), "contact_source_url": first["source_url"], "contact_confidence": first["confidence"]}
    rows = leads.join(best, "lead_id").withColumns(over).drop("email", "phone")
    return dedupe_first(rows, F.col("_key"), [F.desc("verification_score"), F.desc("created_at"), F.col("lead_id")]).drop("_key")


def best_prospects(star: DataFrame, excluded_authors: list[str] = (), excluded_domains: list[str] = ()) -> DataFrame:
    """Leads with a contact path, without excluded authors and domains, first of each identifier or title::author."""
    out = star.where(any_present([c for c in ("public_email", "public_phone", "representation_email", "publicist_email", "contact_page_url") if c in star.columns]))
    for words, c in ((excluded_authors, "author_name"), (excluded_domains, "public_email")):
        for w in words:
            out = out.where(~F.contains(F.lower(text(c)), F.lit(w.lower())))
    key = first_present(F.upper(text("asin")), F.concat_ws("::", normalize_text("title"), normalize_text("author_name")))
    return dedupe_first(out, key, [F.desc("lead_score"), F.desc("extraction_confidence"), F.desc("created_at"), F.col("lead_id")])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


__all__ = ["best_prospects", "contact_evidence", "contactable", "filtered", "lead_key", "leads_wide", "tables_four", "validated", "write_csv"]
