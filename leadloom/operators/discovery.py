"""Rows of search results to candidates, recovered authors and contacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import contacts, fixed, ids, scores, trust, urls
from ..functions.coerce import year_in_window
from ..functions.lineage import spread
from ..functions.text import bound, clean_listing_title, first_present, guess_title_author, name_is_title_fragment, placeholder_title, present, text, title_anchor, valid_person_name

CONTACT_INTENT = r"(?i)contact|email|e-mail|booking|reach|get in touch|publicity|press|media kit|school visit"


def listing_candidates(results: DataFrame) -> DataFrame:
    """results (result_id, title, url, snippet) that carry a listing id, a valid author and a topic signal, parsed."""
    rows = spread(results.withColumn("asin", urls.listing_id("url")).where(F.col("asin").isNotNull()).select("result_id", "asin", "title", "snippet"))
    topic = scores.topic_signal("title", "snippet")
    # A generator in place of a filter: the guess is evaluated once a row, and stays above the deal.
    good = F.when(topic, bound(guess_title_author("title", "snippet"), lambda g: F.when(valid_person_name(g["author"]), F.array(g))))
    return rows.select("result_id", "asin", F.explode(good).alias("g")).select("result_id", "asin", F.col("g.title").alias("title"), F.col("g.author").alias("author_name"), F.col("g.confidence").alias("confidence"))


def recover_missing_author(books: DataFrame, results: DataFrame) -> DataFrame:
    """Blank authors filled from the first matching result (book_id, ord, title, snippet, url) in order; (book_id, author_name, confidence, recovered)."""
    missing = books.where(~present("author_name")).select("book_id", F.col("title").alias("_title"), F.col("asin").alias("_asin"))
    words = F.concat_ws(" ", text("title"), text("snippet"), text("url"))
    hits = spread(results.select("book_id", "ord", "title", "snippet", "url").join(missing, "book_id"))
    # A column in place of filters: each rule is evaluated once a row, and a result that fails one has no name.
    name = bound(guess_title_author("title", "snippet")["author"], lambda n: F.when(valid_person_name(n) & ~name_is_title_fragment(n, "_title"), n))
    named = hits.select("book_id", "ord", F.when(trust.result_matches_book(words, "_title", "_asin"), name).alias("_name"))
    first = named.groupBy("book_id").agg(F.min_by("_name", F.when(F.col("_name").isNotNull(), F.col("ord"))).alias("_name"))
    out = books.join(first, "book_id", "left")
    found = F.col("_name").isNotNull()
    confidence = F.when(found, F.greatest(F.coalesce("book_data_confidence", F.lit(0.0)), F.lit(0.72))).otherwise(F.col("book_data_confidence"))
    return out.select("book_id", F.when(found, F.col("_name")).otherwise(text("author_name")).alias("author_name"), confidence.alias("confidence"), found.alias("recovered"))


def snippet_contacts(results: DataFrame) -> DataFrame:
    """results (result_id, kind, title, snippet, url, author_name, book_title) as contact rows with type and confidence by the trust in the source."""
    site = (F.col("kind") == "author_site") & trust.trusted_site("url", "author_name", "book_title", "title")
    social = F.col("kind").isin("instagram", "facebook", "tiktok", "linkedin", "youtube") & trust.trusted_social("url", "author_name", "book_title")
    words = F.concat_ws(" ", text("title"), text("snippet"))
    none = F.array().cast("array<struct<field:string,value:string,evidence_type:string,confidence:double>>")

    def contacts_of(s: Column) -> Column:
        trusted = s["site"] | s["social"]
        kind = F.when(s["social"], "social_profile").when(s["site"], "contact_page").otherwise("web_search_result")
        row = lambda field, value, confidence: F.struct(F.lit(field).alias("field"), value.alias("value"), kind.alias("evidence_type"), confidence.alias("confidence"))
        of_mail, of_phone = F.when(s["site"], 0.72).when(s["social"], 0.65).otherwise(0.52), F.when(s["social"], 0.62).otherwise(0.68)
        own = F.filter(contacts.extract_emails(s["words"]), lambda m: trust.email_matches_author(m, "author_name", "url", trusted))
        mails = F.when(trusted | F.concat_ws(" ", s["words"], text("url")).rlike(CONTACT_INTENT), F.transform(own, lambda m: row("public_email", m, of_mail)))
        phones = F.when(trusted, F.transform(contacts.extract_phones(s["words"]), lambda p: row("public_phone", p, of_phone)))
        return F.concat(F.coalesce(mails, none), F.coalesce(phones, none))

    # One generator over mails and phones: results are read once, and a source is judged once a row.
    judged = F.struct(F.coalesce(site, F.lit(False)).alias("site"), F.coalesce(social, F.lit(False)).alias("social"), words.alias("words"))
    rows = spread(results.select("result_id", "kind", "title", "snippet", "url", "author_name", "book_title"))
    return rows.select("result_id", F.explode(bound(judged, contacts_of)).alias("c")).select("result_id", "c.*")


def profile_audit(profiles: DataFrame) -> DataFrame:
    """profiles (lead_id, platform, profile_url, profile_text, author_name, title): identity score 90 or 30, followers, and contacts at .85 from texts that name the author (trust.profile_named)."""
    from ..functions.coerce import follower_count

    named = trust.profile_named("author_name", "title", "profile_text", "profile_url")
    rows = profiles.withColumn("_named", named)
    none = F.array().cast("array<string>")
    found = F.when(F.col("_named"), F.array_union(contacts.extract_emails("profile_text"), contacts.extract_phones("profile_text", require_context=False))).otherwise(none)
    return rows.select("lead_id", "platform", "profile_url", F.when(F.col("_named"), 90).otherwise(30).alias("identity_score"), follower_count("profile_text").alias("follower_count"), F.transform(found, lambda v: F.struct(v.alias("value"), F.lit(0.85).alias("confidence"))).alias("contacts"))


def search_candidates(results: DataFrame, source: str, start: int | None, end: int | None) -> DataFrame:
    """results (result_id, title, snippet, url) that carry a code, as candidates: the listing's id, else an ISBN, else a listing id in the texts; a year in the texts must lie in the window."""
    words = F.concat_ws(" ", text("title"), text("snippet"), text("url"))
    listed = F.when(urls.marketplace_host("url").isNotNull(), ids.book_code(urls.listing_id("url")))
    year = F.regexp_extract(F.concat_ws(" ", text("title"), text("snippet")), r"\b(19\d{2}|20\d{2})\b", 1)
    rows = results.withColumns({"code": first_present(listed, ids.isbn_in_text(words), ids.asin_in_text(words)), "publication_date": year})
    rows = rows.where(present("code") & year_in_window("publication_date", start, end, lenient=True))
    parsed = rows.withColumn("g", guess_title_author("title", text("snippet")))
    return parsed.select(
        "result_id", "code", first_present("g.title", "title").alias("title"), text("g.author").alias("author_name"), "publication_date", F.lit(source).alias("source"),
        text("url").alias("source_url"), text("title").alias("source_title"), text("snippet").alias("source_snippet"), F.col("g.confidence").alias("book_data_confidence"),
    )


def catalog_candidates(rows: DataFrame, source: str, start: int | None, end: int | None) -> DataFrame:
    """Catalog rows (record_id, asin, isbn, title, author_name, publication_date and more, any of them missing) with a valid code and no date outside the window; confidence .65 where none is given."""
    have = set(rows.columns)
    of = lambda *names: first_present(*(F.col(n) for n in names if n in have)) if have.intersection(names) else F.lit("")
    given = F.nullif(F.col("book_data_confidence").cast("double"), F.lit(0.0)) if "book_data_confidence" in have else F.lit(None).cast("double")
    title = of("source_title", "amazon_source_title", "title")
    out = rows.select(
        "record_id", ids.book_code(of("asin", "isbn")).alias("code"), first_present(of("title"), title).alias("title"), of("author_name").alias("author_name"), of("publication_date").alias("publication_date"),
        of("cover_image_url").alias("cover_image_url"), of("publisher").alias("publisher"), of("category").alias("category"), F.lit(source).alias("source"), of("source_url", "amazon_source_url", "info_link").alias("source_url"),
        title.alias("source_title"), of("source_snippet", "amazon_source_snippet", "description").alias("source_snippet"), F.coalesce(given, F.lit(0.65)).alias("book_data_confidence"),
    )
    return out.where(present("code") & year_in_window("publication_date", start, end, lenient=True))


def contact_plans(limit: int) -> Column:
    """Map of plan to its queries, distinct, in order, over the staged columns _author, _title, _code, _tail, _pair and _titled.

    discovery: the first `limit` of the purposes by turns; deep, video: their lists; metadata: by title and code, none for placeholder
    titles. Without an author discovery and deep are empty.
    """
    values = {"{pair}": F.col("_pair"), "{author}": F.col("_author"), "{tail}": F.col("_tail"), "{title}": F.col("_title")}
    title, code, titled, named = F.col("_title"), F.col("_code"), F.col("_titled"), F.col("_author") != ""

    def filled(forms: list[str], condition: Column = F.lit(True)) -> Column:
        def fill(form: str) -> Column:
            parts = [form]
            for key in values:
                parts = [y for x in parts for y in ([x] if x in values else [z for w in x.split(key) for z in (w, key)][:-1])]
            return F.concat(*(values[x] if x in values else F.lit(x) for x in parts if x))

        return F.when(condition, F.array_distinct(F.array(*map(fill, forms)))).otherwise(F.array().cast("array<string>"))

    turns = [form for forms in zip(*fixed.AUTHOR_SEARCHES.values(), strict=True) for form in forms][: max(1, limit)]
    by_code = F.when(titled & (code != ""), F.concat(F.lit('"'), code, F.lit('" "'), title, F.lit('"')))
    meta = F.array(F.when(titled, F.concat(F.lit('"'), title, F.lit('" author'))), F.when(titled, F.concat(F.lit('"'), title, F.lit('" "by"'))), by_code, F.when(code != "", F.concat(F.lit('"'), code, F.lit('" author'))))
    plans = {"discovery": filled(turns, named), "deep": filled(fixed.DEEP_SEARCHES, named), "video": filled(fixed.VIDEO_SEARCHES), "metadata": F.array_distinct(F.array_compact(meta))}
    return F.create_map(*(x for name, c in plans.items() for x in (F.lit(name), c)))


def contact_query_rows(books: DataFrame, limit: int = 24) -> DataFrame:
    """(book_id, plan, pos from 0, query) of books (book_id, author_name, title, asin): a projection, no join with the templates. What all templates share is staged once a row."""
    rows = books.select("book_id", *(F.trim(text(c)).alias(n) for c, n in (("author_name", "_author"), ("title", "_title"), ("asin", "_code"))))
    rows = rows.withColumns({"_anchor": title_anchor("_title"), "_titled": (F.col("_title") != "") & ~placeholder_title("_title", "_code")})
    rows = rows.withColumn("_tail", F.when(F.col("_anchor") != "", F.concat(F.lit(' "'), "_anchor", F.lit('"'))).otherwise(""))
    rows = rows.withColumn("_pair", F.concat(F.lit('"'), "_author", F.lit('"'), "_tail"))
    plans = rows.select("book_id", F.explode(contact_plans(limit)).alias("plan", "queries"))
    return plans.select("book_id", "plan", F.posexplode("queries").alias("pos", "query"))


__all__ = ["catalog_candidates", "clean_listing_title", "contact_query_rows", "listing_candidates", "profile_audit", "recover_missing_author", "search_candidates", "snippet_contacts"]
