"""Joins: the lead star, eligibility, matching of records, filling from other records."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed
from ..functions.contacts import normalized_contact
from ..functions.lineage import cut
from ..functions.text import author_key, book_key, first_present, normalize_text, present, text
from ..functions.trust import label_matches
from ..functions.urls import registered_domain_of_email, registered_domain_of_url, suffixes

#: Contact column of a lead -> channel.
CHANNELS = {"public_email": "email", "representation_email": "email", "publicist_email": "email", "public_phone": "phone"}


def lead_star(leads: DataFrame, books: DataFrame, authors: DataFrame, candidates: DataFrame | None = None, briefs: DataFrame | None = None) -> DataFrame:
    """Lead with its book, author, primary contact and brief; the last three may be absent."""
    out = leads.join(books, "book_id").join(authors.drop("author_name", "created_at"), "author_id", "left")
    if candidates is not None:
        primary = candidates.where("is_primary").select("lead_id", F.col("normalized_value").alias("primary_contact"), F.col("channel").alias("primary_channel"))
        out = out.join(primary, "lead_id", "left")
    return out if briefs is None else out.join(briefs, "lead_id", "left")


def lead_nested(leads: DataFrame, **children: DataFrame) -> DataFrame:
    """Leads with their children (tables with lead_id) as sorted arrays of structs.

    Children are dealt as rows: an aggregate before the deal would make nothing smaller, and sort and spill all of them.
    """
    out = leads
    for name, df in children.items():
        rows = df.repartition("lead_id").groupBy("lead_id").agg(F.sort_array(F.collect_list(F.struct(*[c for c in df.columns if c != "lead_id"]))).alias(name))
        out = out.join(rows, "lead_id", "left")
    return out


def current_contacts(leads: DataFrame) -> DataFrame:
    """(lead_id, channel, value): the non-blank contact columns as rows."""
    pairs = F.array(*(F.struct(F.lit(ch).alias("channel"), text(c).alias("value")) for c, ch in CHANNELS.items()))
    return leads.select("lead_id", F.explode(pairs).alias("x")).select("lead_id", "x.*").where(present("value"))


def verified_current(leads: DataFrame, candidates: DataFrame, case_insensitive: bool = False) -> DataFrame:
    """Verified candidates (not from the import shortcut, not blank) equal to a current contact of the same channel."""
    usable = candidates.where((F.col("verification_status") == "verified") & (text("deliverability_status") != "manual_import") & present("normalized_value"))
    fold = lambda c: F.when(F.col("channel") == "email", F.lower(F.trim(c))).otherwise(F.trim(c)) if case_insensitive else c
    now = current_contacts(leads).withColumn("_v", fold(F.col("value"))).select("lead_id", "channel", "_v")
    return usable.withColumn("_v", fold(F.col("normalized_value"))).join(now, ["lead_id", "channel", "_v"], "left_semi").drop("_v")


def open_leads(leads: DataFrame) -> DataFrame:
    return leads.where(~F.coalesce(F.col("do_not_contact"), F.lit(False)) & (text("manual_review_status") != "do_not_contact"))


def verified_ready(leads: DataFrame, candidates: DataFrame, case_insensitive: bool = False) -> DataFrame:
    return open_leads(leads).join(verified_current(leads, candidates, case_insensitive).select("lead_id"), "lead_id", "left_semi")


def needs_review(leads: DataFrame, candidates: DataFrame, case_insensitive: bool = False) -> DataFrame:
    rest = open_leads(leads).where(text("verification_status") != "not_verified")
    return rest.join(verified_current(leads, candidates, case_insensitive).select("lead_id"), "lead_id", "left_anti")


def eligibility(leads: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per lead: is_ready, reasons, and the strongest verified current candidate (primary, score, then newest)."""
    strongest = F.max_by("candidate_id", F.struct(F.col("is_primary").cast("int"), "verification_score", "created_at", "candidate_id")).alias("candidate_id")
    best = verified_current(leads, candidates, True).groupBy("lead_id").agg(strongest)
    rows = leads.join(best, "lead_id", "left")
    suppressed = F.coalesce(F.col("do_not_contact"), F.lit(False)) | (text("manual_review_status") == "do_not_contact")
    missing = F.when(F.col("candidate_id").isNull(), F.when(F.coalesce(F.col("uploader_attested"), F.lit(False)), "import_awaiting_verification").otherwise("no_current_verified_contact"))
    reasons = F.array_compact(F.array(F.when(suppressed, "do_not_contact"), missing))
    return rows.select("lead_id", (F.size(reasons) == 0).alias("is_ready"), reasons.alias("reasons"), "candidate_id")


def matching_evidence(candidates: DataFrame, evidence: DataFrame) -> DataFrame:
    """(candidate_id, evidence_id) where raw or normalized values agree: two equi-joins, since an OR join would be a nested loop."""
    left = candidates.select("candidate_id", "lead_id", "field_name", "channel", "raw_value", "normalized_value")
    right = evidence.where(present("source_url")).select("evidence_id", "lead_id", "field_name", "field_value")
    by_raw = left.join(right, (left.lead_id == right.lead_id) & (left.field_name == right.field_name) & (left.raw_value == right.field_value)).select("candidate_id", "evidence_id")
    normal = right.join(left.select("lead_id", "field_name", "channel").distinct(), ["lead_id", "field_name"]).withColumn("normalized_value", normalized_contact("channel", "field_value"))
    by_normal = left.join(normal, ["lead_id", "field_name", "normalized_value"]).select("candidate_id", "evidence_id")
    return by_raw.unionByName(by_normal).distinct()


def siblings(subjects: DataFrame, rows: DataFrame, row_id: str = "lead_id", author: str = "author_name", author_id: str = "author_id") -> DataFrame:
    """(row, sibling) for the subjects, the rows that are asked for: rows with the same author name (case-insensitive) or author id."""
    keyed = lambda df: df.select(F.col(row_id).alias("row"), F.lower(F.trim(text(author))).alias("name"), F.col(author_id).alias("aid"))
    a, b = keyed(subjects), keyed(rows).withColumnRenamed("row", "sibling")
    named = a.where(present("name"))
    by_name = named.join(b.select("sibling", "name"), "name").select("row", "sibling")
    by_id = named.join(b.select("sibling", "aid"), "aid").select("row", "sibling")
    alone = a.where(~present("name")).select("row", F.col("row").alias("sibling"))
    return by_name.unionByName(by_id).unionByName(alone).dropDuplicates()


def sibling_counts(rows: DataFrame, row_id: str = "lead_id", author: str = "author_name", author_id: str = "author_id") -> DataFrame:
    """Per row its classes (name, author id) and how many rows are its siblings, itself included; no pairs are made.

    Rows of the name and rows of the id are counted once each, less those that share both. A row without a name is alone.
    """
    keyed = rows.select(F.col(row_id).alias("row"), F.lower(F.trim(text(author))).alias("name"), F.col(author_id).alias("aid"))
    n = F.count(F.lit(1))
    by_name, by_id, both = keyed.groupBy("name").agg(n.alias("n")), keyed.groupBy("aid").agg(n.alias("i")), keyed.groupBy("name", "aid").agg(n.alias("b"))
    out = keyed.join(by_name, "name").join(by_id, "aid").join(both, ["name", "aid"])
    return out.select("row", "name", "aid", F.when(present("name"), F.col("n") + F.col("i") - F.col("b")).otherwise(1).alias("siblings"))


def match_existing(rows: DataFrame, books: DataFrame, title: str = "title", author: str = "author_name", asin: str = "asin") -> DataFrame:
    """rows with the id of the first existing book by key, else by identifier, else by title::author."""
    earliest = lambda key: books.withColumn("_k", key).where(present("_k")).groupBy("_k").agg(F.min_by("book_id", F.struct("created_at", "book_id")).alias("_b"))
    keys = [(book_key(title, author, asin), F.col("normalized_key")), (F.upper(text(asin)), F.upper(text("asin"))), (book_key(title, author), book_key("title", "author_name"))]
    out = rows
    for i, (own, theirs) in enumerate(keys):
        out = out.withColumn("_k", own).join(earliest(theirs).withColumnRenamed("_b", f"_b{i}"), "_k", "left").drop("_k")
    return out.withColumn("existing_book_id", F.coalesce("_b0", "_b1", "_b2")).drop("_b0", "_b1", "_b2")


#: Evidence rows and values of a key that one task reads together, and digits that a number must have to be looked for by its digits.
SHARD_ROWS, SHARD_VALUES, LEAST_DIGITS = 10_000, 10_000, 7


def value_in_evidence(values: DataFrame, evidence: DataFrame, shard_rows: int = SHARD_ROWS, shard_values: int = SHARD_VALUES) -> DataFrame:
    """values (lead_id, value, …) that stand in some evidence text of the lead, literally or by their digits.

    Evidence is dealt by lead and shard (a lead with many rows has many shards, salted), and a lead's distinct values are sent to each of its shards, in chunks of shard_values. A task reads
    a shard's values first, builds one Aho-Corasick automaton of the literal values and one of the digits, and runs each text through them once: a text's cost is its length, whatever the number of
    values. Only values that were found are shuffled back.
    """
    asked = values.where("lead_id IS NOT NULL").select("lead_id", F.lower(text("value")).alias("_value")).distinct()
    texts = evidence.where("lead_id IS NOT NULL").select("lead_id", F.lower(F.concat_ws(" ", text("field_value"), text("source_snippet"))).alias("_text")).distinct().join(asked.select("lead_id").distinct(), "lead_id", "left_semi")
    texts, asked = cut(texts, "evidence-texts"), cut(asked, "evidence-values")
    shards = texts.groupBy("lead_id").agg(F.ceil(F.count(F.lit(1)) / shard_rows).alias("_shards"))
    chunks = asked.groupBy("lead_id").agg(F.ceil(F.count(F.lit(1)) / shard_values).alias("_chunks"))
    sizes = cut(shards.join(chunks, "lead_id"), "evidence-shards")
    each = lambda c: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(c) - 1))
    shard, chunk = F.pmod(F.xxhash64("_text"), F.col("_shards")), F.pmod(F.xxhash64("_value"), F.col("_chunks"))
    of_values = asked.join(sizes, "lead_id").select("lead_id", each("_shards").alias("_shard"), chunk.alias("_chunk"), F.lit(0).alias("_kind"), F.col("_value").alias("_s"))
    of_texts = texts.join(sizes, "lead_id").select("lead_id", shard.alias("_shard"), each("_chunks").alias("_chunk"), F.lit(1).alias("_kind"), F.col("_text").alias("_s"))
    place = ["lead_id", "_shard", "_chunk"]
    dealt = of_values.unionByName(of_texts).repartition(*place).sortWithinPartitions(*place, "_kind")
    kind = f"lead_id {asked.schema['lead_id'].dataType.simpleString()}, _value string"
    found = dealt.mapInArrow(_found_values, kind).distinct()
    return values.withColumn("_value", F.lower(text("value"))).join(found, ["lead_id", "_value"], "left_semi").select(values.columns)


def _found_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lead, value) of the values that the texts behind them hold; a shard's rows come together, values first."""
    import ahocorasick

    key, wanted, literal, numeric, hits, built = None, [], None, None, set(), False

    def automaton(keyed: dict[str, list[str]]):
        out = ahocorasick.Automaton()
        for k, of in keyed.items():
            out.add_word(k, of)
        out.make_automaton()
        return out if keyed else None

    def build() -> None:
        nonlocal literal, numeric
        digits: dict[str, list[str]] = {}
        for v in wanted:
            d = "".join(c for c in v if c in "0123456789")
            if len(d) >= LEAST_DIGITS:
                digits.setdefault(d, []).append(v)
        literal, numeric = automaton({v: [v] for v in wanted if v}), automaton(digits)
        if "" in wanted:  # stands in every text
            hits.add("")

    for batch in batches:
        out: list[tuple] = []
        for lead, shard, chunk, kind, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (lead, shard, chunk) != key:
                key, wanted, literal, numeric, hits, built = (lead, shard, chunk), [], None, None, set(), False
            if kind == 0:
                wanted.append(s)
                continue
            before = set(hits)
            if not built:
                build()
                built = True
            for one, t in ((literal, s), (numeric, "".join(c for c in s if c in "0123456789"))):
                if one is not None:
                    for _, of in one.iter(t):
                        hits.update(of)
            out += [(lead, v) for v in hits - before]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], batch.column(0).type), pa.array([v for _, v in out], pa.string())], names=["lead_id", "_value"])


#: Patterns up to this many are sent to the terms.
GRID_PATTERNS = 10_000


def query_grid(patterns: DataFrame, terms: DataFrame) -> DataFrame:
    """(query, ord): each pattern (pattern, p) with each term (term, t), patterns first, first occurrence of a query kept. The patterns are a stated list, sent to the terms once counted; a longer one is paired in blocks."""
    few = patterns.limit(GRID_PATTERNS + 1).count() <= GRID_PATTERNS
    rows = terms.crossJoin(F.broadcast(patterns) if few else patterns).withColumn("query", F.replace("pattern", F.lit("{term}"), F.col("term")))
    first = rows.groupBy("query").agg(F.min(F.struct("p", "t")).alias("ord"))
    return first.select("query", "ord.p", "ord.t")


def latest_per(df: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """Per key the values of the newest row."""
    return df.groupBy(key).agg(*(F.max_by(v, F.struct(*order)).alias(v) for v in values))


def domain_suffix_match(df: DataFrame, domain: Column, listed: DataFrame, column: str = "domain") -> DataFrame:
    """Rows whose domain equals or lies under a listed one: an equi-join on the parents of the domain."""
    parents = df.withColumn("_parents", suffixes(domain)).withColumn("_row", F.monotonically_increasing_id())
    hits = parents.select("_row", F.explode("_parents").alias(column)).join(listed.select(column).distinct(), column, "left_semi").select("_row").distinct()
    return parents.join(hits, "_row", "left_semi").drop("_row", "_parents")


def suppress(leads: DataFrame, suppression: DataFrame, email: str = "public_email", author: str = "author_name") -> DataFrame:
    """Leads whose mail, mail domain and author are not on the suppression table."""
    out = leads.withColumns({"_e": F.lower(text(email)), "_d": F.lower(F.substring_index(text(email), "@", -1)), "_a": author_key(author)})
    for mine, theirs in (("_e", F.lower(text("email"))), ("_d", F.lower(text("domain"))), ("_a", author_key("author_name"))):
        out = out.join(suppression.select(theirs.alias(mine)).where(present(mine)).distinct(), mine, "left_anti")
    return out.select(leads.columns)


def reuse_best(rows: DataFrame, records: DataFrame, code: str, columns: list[str], confidence: str = "confidence") -> DataFrame:
    """Blank columns filled from the record of the same code with the highest confidence."""
    best = records.where(present(code)).groupBy(code).agg(*(F.max_by(c, F.struct(confidence, c)).alias(f"_{c}") for c in columns))
    out = rows.join(best, code, "left")
    return out.select(*(first_present(c, f"_{c}").alias(c) if c in columns else F.col(c) for c in rows.columns))


def review_to_listing(reviews: DataFrame, listings: DataFrame) -> DataFrame:
    """reviews (review_id, title, author_name) with the first listing (listing_id, title, author_name, asin, ord) of both keys, else of the title alone."""
    coded = listings.where(present("asin")).select("listing_id", "ord", normalize_text("title").alias("_t"), normalize_text("author_name").alias("_a"))
    both = coded.groupBy("_t", "_a").agg(F.min_by("listing_id", "ord").alias("_both"))
    alone = coded.groupBy("_t").agg(F.min_by("listing_id", "ord").alias("_alone"))
    keyed = reviews.withColumns({"_t": normalize_text("title"), "_a": normalize_text("author_name")})
    return keyed.join(both, ["_t", "_a"], "left").join(alone, "_t", "left").withColumn("listing_id", F.coalesce("_both", "_alone")).drop("_t", "_a", "_both", "_alone")


def author_domains(leads: DataFrame, evidence: DataFrame) -> DataFrame:
    """(lead_id, domain): domains of the author's sites and of trusted author-owned evidence (a flag `trusted`)."""
    own = leads.select("lead_id", F.explode(F.array("canonical_website", "contact_page_url")).alias("url"))
    owned = evidence.where(F.col("trusted") & F.col("evidence_type").isin(fixed.OWNED_TYPES)).select("lead_id", F.col("source_url").alias("url"))
    return own.unionByName(owned).select("lead_id", registered_domain_of_url("url").alias("domain")).where(present("domain")).distinct()


def domain_alignment(candidates: DataFrame, domains: DataFrame) -> DataFrame:
    """candidates with domain_aligned: the mail's domain is one of the author's."""
    keyed = candidates.withColumn("domain", registered_domain_of_email("normalized_value"))
    return keyed.join(domains.withColumn("domain_aligned", F.lit(True)), ["lead_id", "domain"], "left").withColumn("domain_aligned", F.coalesce("domain_aligned", F.lit(False))).drop("domain")


def fill_from_contacts(leads: DataFrame, contacts: DataFrame, columns: list[str]) -> DataFrame:
    """Blank columns of leads from the first contact (lead_id, field, value, ord, confidence); confidence rises to the largest used, a warning is added."""
    first = contacts.where(F.col("field").isin(columns) & present("value")).groupBy("lead_id").pivot("field", columns).agg(F.min_by(F.struct("value", "confidence"), "ord"))
    rows = leads.join(first.select("lead_id", *(F.col(c).alias(f"_{c}") for c in columns)), "lead_id", "left")
    used = {c: ~present(c) & F.col(f"_{c}").isNotNull() for c in columns}
    raised = F.greatest(F.coalesce("extraction_confidence", F.lit(0.0)), *(F.when(u, F.col(f"_{c}.confidence")).otherwise(0.0) for c, u in used.items()), F.lit(0.0))
    some = reduce(lambda a, b: a | b, used.values())
    warnings = F.concat(F.coalesce(F.col("warnings"), F.array().cast("array<string>")), F.when(some, F.array(F.lit("Contact filled from search evidence."))).otherwise(F.array().cast("array<string>")))
    filled = rows.withColumns({"extraction_confidence": raised, "warnings": warnings} | {c: F.when(u, F.col(f"_{c}.value")).otherwise(F.col(c)) for c, u in used.items()})
    return filled.select(leads.columns)


def fill_missing(rows: DataFrame, fallback: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Blank columns from the fallback row of the same key."""
    other = fallback.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    return rows.join(other, key, "left").select(*(first_present(c, f"_{c}").alias(c) if c in columns else F.col(c) for c in rows.columns))


def attach_evidence(evidence: DataFrame, leads: DataFrame) -> DataFrame:
    """Evidence of a book without a lead gets the book's lead and author."""
    own = leads.groupBy("book_id").agg(F.min(F.struct("created_at", "lead_id", "author_id")).alias("_l"))
    rows = evidence.join(own, "book_id", "left")
    return rows.withColumns({"lead_id": F.coalesce("lead_id", "_l.lead_id"), "author_id": F.coalesce("author_id", "_l.author_id")}).select(evidence.columns)


def entity_profiles(people: DataFrame, entities: DataFrame) -> DataFrame:
    """people (person_id, name) with their entity (person_id, ord, label, hint, …): the first label match with a hint, else the last label match."""
    hits = people.join(entities, "person_id").where(label_matches("name", "label"))
    columns = [c for c in entities.columns if c not in {"person_id", "ord", "hint"}]
    pick = F.coalesce(F.min_by(F.struct(*columns, "hint"), F.when(F.col("hint"), F.col("ord"))), F.max_by(F.struct(*columns, "hint"), "ord"))
    best = hits.groupBy("person_id").agg(pick.alias("e")).select("person_id", "e.*")
    return best.withColumn("confidence", F.when(F.col("hint"), 0.8).otherwise(0.65))


def staged_fill(rows: DataFrame, tiers: list[DataFrame], key: str, columns: list[str], until: str) -> DataFrame:
    """Blank columns filled by tiers in order; a row whose `until` column is filled takes nothing from later tiers."""
    out = rows
    for tier in tiers:
        other = tier.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
        is_open = ~present(until)
        out = out.join(other, key, "left").select(*(F.when(is_open, first_present(c, f"_{c}")).otherwise(text(c)).alias(c) if c in columns else F.col(c) for c in rows.columns))
    return out


def first_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
