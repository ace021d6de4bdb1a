"""Rule-based scores, tiers, needs and classes. Each function takes the names of columns it finds in the row."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed
from .ids import identifier_type
from .text import alternation, blank, first_present, has_any, present, text
from .urls import mail_on_website

#: The needs, each with its condition's name; labels of pitches are a parameter.
PITCHES = {"video": "Pitch: video", "web": "Pitch: web", "publishing": "Pitch: publishing"}
PUBLISHING_NEEDS = ["Cover redesign", "Illustration", "Editing", "Amazon listing optimization", "A+ Content", "Author Page optimization"]
NOTHING = F.lit  # columns that a table lacks are read as NULL


def traditional_publisher(c: Column | str) -> Column:
    return has_any(c, fixed.TRADITIONAL_PUBLISHERS)


def recency_points(publication: Column | str, as_of_year: int) -> Column:
    """10, 8, 5 or 0 by the age of the first 20xx year."""
    year = F.regexp_extract(text(publication), r"(20\d{2})", 1).try_cast("int")
    age = F.lit(as_of_year) - year
    return F.when(year.isNull(), 0).when(age <= 1, 10).when(age <= 2, 8).when(age <= 5, 5).otherwise(0)


class Row:
    """Columns of a lead row by name, with NULL for those that are missing."""

    def __init__(self, columns: Mapping[str, Column] | list[str]):
        self.columns = columns if isinstance(columns, Mapping) else {c: F.col(c) for c in columns}

    def __getitem__(self, name: str) -> Column:
        return self.columns.get(name, F.lit(None))

    def text(self, name: str) -> Column:
        return text(self[name])

    def has(self, name: str) -> Column:
        return present(self[name])

    def true(self, name: str) -> Column:
        return F.coalesce(self[name].cast("boolean"), F.lit(False))


def service_needs(row: Row, pitches: Mapping[str, str] = PITCHES, with_pitches: bool = True) -> Column:
    """Needs in order, then pitches. A NULL rating makes no need of its own."""
    rating, about, bio = row["rating"].cast("double"), row.text("description"), row.text("author_bio")
    below = lambda x: F.coalesce(rating < x, F.lit(False))
    aplus, site = row.true("has_aplus_content"), row.has("canonical_website")
    video = row.text("video_status").isin("no_public_video_found", "unclear")
    others = row.true("has_other_books")
    social = row.has("instagram_url") | row.has("tiktok_url") | row.has("youtube_url") | row.has("facebook_url")
    few = F.coalesce(row["max_followers"].cast("bigint") < 5000, F.lit(False))
    short = lambda c, n: (c != "") & (F.char_length(c) < n)
    ladder = [
        ("Cover redesign", below(4.2)),
        ("Illustration", row.true("is_picture_or_illustrated_book") & below(4.5)),
        ("Editing", short(about, 150) | below(4.0)),
        ("Amazon listing optimization", short(about, 250)),
        ("A+ Content", ~aplus),
        ("Author Page optimization", ~row.has("amazon_author_url") | short(bio, 100)),
        ("Website development", ~site),
        ("Book trailer / animation", video),
        ("Series branding", others),
        ("Social media growth", few & social),
    ]
    flags = dict(ladder)
    needs = F.array_compact(F.array(*(F.when(c, n) for n, c in ladder)))
    if not with_pitches:
        return needs
    publishing = F.lit(False)
    for n in PUBLISHING_NEEDS:
        publishing = publishing | flags[n]
    publishing = publishing | (others & (below(4.3) | short(about, 250) | ~aplus))
    tags = [(pitches["video"], video | flags["Illustration"]), (pitches["web"], ~site | others), (pitches["publishing"], publishing)]
    return F.concat(needs, F.array_compact(F.array(*(F.when(c, n) for n, c in tags))))


def _rejected(row: Row) -> Column:
    return row.true("do_not_contact") | traditional_publisher(row["publisher"]) | F.coalesce(~row["is_childrens_book"].cast("boolean"), F.lit(False))


def _contact_points(row: Row, on_site: Column) -> Column:
    points = lambda name, n: F.when(row.has(name), n).otherwise(0)
    return (
        points("public_email", 15) + F.when(row.has("representation_email") | row.has("publicist_email"), 12).otherwise(0) + points("public_phone", 8)
        + points("contact_page_url", 8) + points("canonical_website", 6) + points("instagram_url", 3) + points("tiktok_url", 3)
        + points("youtube_url", 2) + points("facebook_url", 2) + points("linkedin_url", 2) + F.when(on_site, 8).otherwise(0)
    )


def _score(row: Row, as_of_year: int, rejected: Column, on_site: Column, n_needs: Column, contact: Column) -> Column:
    """Fit, independence, needs, contact, recency, upsell, confidence."""
    child = F.coalesce(row["is_childrens_book"].cast("boolean"), F.lit(False))
    fit = F.when(child, F.when(row.true("is_picture_or_illustrated_book"), 20).otherwise(10)).otherwise(0)
    identity = F.coalesce(row["identity_confidence"].cast("double"), F.lit(0.0))
    identity = F.when(on_site, F.greatest(identity, F.lit(0.85))).otherwise(identity)
    extraction = F.coalesce(row["extraction_confidence"].cast("double"), F.lit(0.0))
    total = (
        fit + 20 + F.least(F.lit(25), n_needs * 5) + F.least(F.lit(20), contact) + recency_points(row["publication_date"], as_of_year)
        + F.when(row.true("has_other_books"), 5).otherwise(0) + F.when(identity >= 0.8, 8).otherwise(0) + F.when(extraction >= 0.7, 4).otherwise(0)
        - F.when(identity < 0.5, 15).otherwise(0) - F.when(extraction < 0.4, 20).otherwise(0) - F.when(row.true("author_title_mismatch_risk"), 25).otherwise(0)
    )
    return F.when(rejected, 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), total))).cast("int")


def _tier(row: Row, rejected: Column, score: Column) -> Column:
    mail = row.has("public_email") | row.has("representation_email") | row.has("publicist_email")
    video = row.text("video_status").isin("no_public_video_found", "unclear")
    return F.when(rejected, "rejected").when((score >= 80) & mail & video, "hot").when(score >= 65, "warm").when(score >= 50, "cold").otherwise("rejected")


def lead_score(row: Row, as_of_year: int, pitches: Mapping[str, str] = PITCHES) -> Column:
    """struct(score, tier, needs) of one row as an expression; over tables use with_lead_score, which evaluates its parts once."""
    rejected, on_site = _rejected(row), mail_on_website(row["public_email"], row["canonical_website"])
    score = _score(row, as_of_year, rejected, on_site, F.size(service_needs(row, pitches, False)), _contact_points(row, on_site))
    needs = F.when(rejected, F.array().cast("array<string>")).otherwise(service_needs(row, pitches))
    return F.struct(score.alias("score"), _tier(row, rejected, score).alias("tier"), needs.alias("needs"))


def with_lead_score(leads: DataFrame, as_of_year: int, pitches: Mapping[str, str] = PITCHES) -> DataFrame:
    """leads with score, tier and needs. Rejects first (score 0, no needs).

    The parts are staged as columns, so that the needs and the total are evaluated once a row, whatever reads them.
    """
    row, rejected, on_site = Row(leads.columns), F.col("_rejected"), F.col("_on_site")
    staged = leads.withColumns({"_rejected": _rejected(row), "_on_site": mail_on_website(row["public_email"], row["canonical_website"]), "_all": service_needs(row, pitches)})
    staged = staged.withColumn("_contact", _contact_points(row, on_site))
    wanted = F.size(F.filter("_all", lambda n: ~n.isin(list(pitches.values()))))  # pitches stand behind the needs and make no points
    staged = staged.withColumn("score", _score(row, as_of_year, rejected, on_site, wanted, F.col("_contact")))
    needs = F.when(rejected, F.array().cast("array<string>")).otherwise(F.col("_all"))
    return staged.withColumns({"tier": _tier(row, rejected, F.col("score")), "needs": needs}).drop("_rejected", "_on_site", "_all", "_contact")


def classify_book(*values: Column | str) -> Column:
    """struct(is_childrens, is_picture, confidence, reject_reason) by terms in title, category, publisher, snippets."""
    words = F.trim(F.concat_ws(" ", *map(text, values)))
    child, picture = has_any(words, fixed.CHILD_TERMS), has_any(words, fixed.PICTURE_TERMS)
    known = words != ""
    base = F.when(child, 0.75).otherwise(0.25)
    return F.struct(
        F.when(known, child).alias("is_childrens"), F.when(known, picture).alias("is_picture"),
        F.when(picture, F.greatest(base, F.lit(0.8))).otherwise(base).alias("confidence"),
        F.when(~child, "No explicit children's-book signal found.").alias("reject_reason"),
    )


def classify_video(title: Column | str, description: Column | str, book_title: Column | str, author: Column | str) -> Column:
    words = F.lower(F.concat_ws(" ", text(title), text(description)))
    hit = lambda terms: words.rlike(alternation(terms))
    trailer, animated, aloud = hit(["trailer"]), hit(fixed.ANIMATED_TERMS), hit(fixed.READ_ALOUD_TERMS)
    named = lambda c: F.when((F.trim(text(c)) != "") & F.contains(words, F.lower(F.trim(text(c)))), True)
    return F.struct(
        named(book_title).alias("matches_book"), named(author).alias("matches_author"), trailer.alias("is_book_trailer"), animated.alias("is_animated_video"),
        aloud.alias("is_read_aloud"), hit(["interview"]).alias("is_author_interview"), F.when(trailer | animated | aloud, 0.8).otherwise(0.2).alias("confidence"),
    )


def topic_signal(*values: Column | str) -> Column:
    return has_any(F.concat_ws(" ", *map(text, values)), fixed.TOPIC_HINTS)


def layered_validation(row: Row, source: Column | str) -> Column:
    """struct(identifier_type, score, layers, summary): a weighted sum, at most .99, to 3 places."""
    kind = identifier_type(F.upper(first_present(row["asin"], row["isbn"])))
    sources = F.lit(0.1)
    for name, x in fixed.SOURCE_SCORES.items():
        sources = F.when(text(source) == name, x).otherwise(sources)
    ai = F.coalesce(row["book_classification_confidence"].cast("double"), F.lit(0.0))
    signal = topic_signal(row["title"], row["category"], row["source_title"], row["source_snippet"])
    layers = [
        (kind != "unknown", F.concat(F.lit("valid_"), kind), F.lit(0.28)), (row.has("title"), F.lit("title_present"), F.lit(0.08)), (row.has("author_name"), F.lit("author_present"), F.lit(0.08)),
        (row.has("publication_date"), F.lit("publication_date_present"), F.lit(0.06)), (row.has("cover_image_url"), F.lit("cover_present"), F.lit(0.04)),
        (F.lit(True), F.concat(F.lit("source_"), text(source)), sources), (row.true("catalog_verified"), F.lit("catalog_record_verified"), F.lit(0.05)),
        (F.coalesce(row["metadata_source_count"].cast("int") >= 2, F.lit(False)), F.lit("multi_source_agreement"), F.lit(0.05)),
        (row.true("is_childrens_book"), F.lit("ai_childrens_match"), F.least(ai * 0.18, F.lit(0.18))),
        (row.true("is_picture_or_illustrated_book"), F.lit("ai_picture_or_illustrated_match"), F.least(ai * 0.1, F.lit(0.1))), (signal, F.lit("keyword_childrens_signal"), F.lit(0.08)),
    ]
    score = sum((F.when(c, x).otherwise(0.0) for c, _, x in layers), F.lit(0.0))
    names = F.array_compact(F.array(*(F.when(c, n) for c, n, _ in layers)))
    return F.struct(kind.alias("identifier_type"), F.bround(F.least(score, F.lit(0.99)), 3).alias("score"), names.alias("layers"), F.array_join(names, "; ").alias("summary"))


def render_template(template: Column | str, row: Row) -> Column:
    """Six placeholders, with defaults for blanks."""
    values = {
        "{{author_name}}": F.when(row.has("author_name"), row.text("author_name")).when(row.has("profile_name"), row.text("profile_name")).otherwise("there"),
        "{{book_title}}": F.when(row.has("title"), row.text("title")).otherwise("your book"),
        "{{suggested_first_line}}": row.text("suggested_first_line"),
        "{{suggested_pitch_angle}}": row.text("suggested_pitch_angle"),
        "{{video_status}}": F.initcap(F.replace(row.text("video_status"), F.lit("_"), F.lit(" "))),
        "{{lead_score}}": row.text("lead_score"),
    }
    out = text(template)
    for k, v in values.items():
        out = F.replace(out, F.lit(k), v)
    return out


def rule_brief(row: Row) -> Column:
    """struct(focus, summary, first_line) of a lead: what to lead with, by its first need, and short texts."""
    needs = row["needs"]
    has = lambda n: F.array_contains(F.coalesce(needs, F.array().cast("array<string>")), n)
    focus = F.when(has("Book trailer / animation") | has("Illustration"), "video").when(has("Website development") | has("Series branding"), "web").otherwise("publishing")
    name = F.when(row.has("author_name"), row.text("author_name")).otherwise("the author")
    summary = F.format_string("%s wrote %s; tier %s, score %s.", name, F.when(row.has("title"), row.text("title")).otherwise("a book"), row.text("tier"), row.text("score"))
    line = F.when(focus == "video", "Have you thought of a short film for the book?").when(focus == "web", "A home for the series could help readers find you.").otherwise("A few changes to the listing could help readers find the book.")
    return F.struct(focus.alias("focus"), summary.alias("summary"), F.concat(F.lit("Hello "), name, F.lit(". "), line).alias("first_line"))


def brief_markdown(row: Row, links: Column) -> Column:
    """A lead's brief as markdown, all sections of fixed.BRIEF; links is an array of URLs. A field with alternatives shows the first present one."""
    labels = F.create_map(*(F.lit(x) for pair in fixed.VIDEO_LABELS.items() for x in pair))
    status = row.text("video_status")
    video = F.when(status == "no_public_video_found", fixed.NO_VIDEO).otherwise(F.coalesce(F.try_element_at(labels, status), status))

    def value(name: str) -> Column:
        *fields, last = name.split("|")
        default = F.lit(last) if fields else F.lit("")
        return F.coalesce(*(F.nullif(video if f == "video_text" else row.text(f), F.lit("")) for f in (fields or [last])), default)

    def line(form: str) -> Column:
        parts = re.split(r"\{([a-z_A-Z0|]+)\}", form)  # texts and names of fields by turns
        return F.concat(*(value(x) if i % 2 else F.lit(x) for i, x in enumerate(parts)))

    sections = [F.concat_ws("\n", F.lit(f"## {head}"), *map(line, lines)) for head, lines in fixed.BRIEF]
    sources = F.when(F.size(links) > 0, F.array_join(F.transform(links, lambda u: F.concat(F.lit("- "), u)), "\n")).otherwise("- Missing")
    return F.concat(F.concat_ws("\n\n", F.lit("# Lead Brief"), *sections, F.concat(F.lit("## Source Links\n"), sources)), F.lit("\n"))


def blank_unless(condition: Column, c: Column | str) -> Column:
    return F.when(condition, text(c)).otherwise("")


__all__ = [n for n in dir() if n[0].islower() and n not in {"annotations", "re", "fixed", "alternation", "blank", "first_present", "has_any", "present", "text"}] + ["Row", "PITCHES"]
