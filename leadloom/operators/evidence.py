"""The evidence engine: sources of a value, best evidence, consensus, candidate checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed
from ..functions.contacts import details_of, e164, email_syntax, normalized_contact
from ..functions.lineage import cut, running_sum
from ..functions.text import author_tokens, normalize_text, present, text, title_tokens
from ..functions.trust import identity_of, trusted_source
from ..functions.urls import blocked_mail, platform_source, registered_domain_of_email, registered_domain_of_url

CONTACT_COLUMNS = list(fixed.FIELD_ROLES)
VERSION = "1"


def with_trust(evidence: DataFrame, subjects: DataFrame) -> DataFrame:
    """evidence with `trusted`, judged by the author and title of its lead (subjects: lead_id, author_name, title)."""
    # Staged, so that tokens and normal texts are evaluated once a row and not wherever the rule reads them.
    people = subjects.select("lead_id", author_tokens("author_name").alias("_own"), title_tokens("title").alias("_of_title"))
    # Rows that can't be trusted by their type, blank value or source are marked first: their texts are not folded and not searched.
    social = text("evidence_type") == "social_profile"
    may = text("evidence_type").isin(fixed.TRUSTED_TYPES) & present("field_value") & present("source_url") & (social | ~platform_source("source_url"))
    words = F.concat_ws(" ", text("source_url"), text("source_title"), text("source_snippet"))
    marked = evidence.withColumn("_may", F.coalesce(may, F.lit(False)))
    folded = marked.withColumn("_plain", F.when(F.col("_may"), normalize_text(words))).withColumn("_joined", F.replace("_plain", F.lit(" "), F.lit("")))
    rows = folded.join(people, "lead_id").withColumn("_named", F.when(F.col("_may"), identity_of(F.col("_own"), F.col("_of_title"), F.col("_plain"), F.col("_joined"))))
    trust = trusted_source(F.lit(""), F.lit(""), "field_name", "field_value", "source_url", "evidence_type", "source_title", "source_snippet", F.col("_named"), F.col("_own"), F.col("_may"))
    return rows.withColumn("trusted", F.coalesce(F.when(F.col("_may"), trust), F.lit(False))).drop("_own", "_of_title", "_plain", "_joined", "_named", "_may")


def verified_fields(evidence: DataFrame) -> DataFrame:
    """(lead_id, field_name, field_value) that a trusted source of an allowed type vouches for, with confidence .6 or more (phones .55)."""
    floor = F.when(F.col("field_name") == "public_phone", 0.55).otherwise(0.6)
    good = evidence.where(F.col("trusted") & present("source_url") & F.col("evidence_type").isin(fixed.TRUSTED_TYPES) & (F.col("confidence") >= floor))
    return good.select("lead_id", "field_name", "field_value").distinct()


def has_verified_source(values: DataFrame, evidence: DataFrame) -> DataFrame:
    """values (lead_id, field_name, field_value) that have a verified source."""
    return values.join(verified_fields(evidence), ["lead_id", "field_name", "field_value"], "left_semi")


def best_evidence(evidence: DataFrame, keys: list[str], guard: Column | None = None, n: int = 1) -> DataFrame:
    """The n best rows of each key by confidence, then recency; guards hold before the choice."""
    rows = evidence if guard is None else evidence.where(guard)
    order = Window.partitionBy(*keys).orderBy(F.col("confidence").desc(), F.col("created_at").desc(), F.col("evidence_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def best_contact_evidence(evidence: DataFrame, subjects: DataFrame) -> DataFrame:
    """Per lead the best contact evidence that names the author, off blocked domains, of a mail or phone."""
    is_mail = F.col("field_name").isin(fixed.EMAIL_FIELDS)
    enough = (F.col("evidence_type").isin(fixed.OWNED_TYPES) & (F.col("confidence") >= 0.65)) | (F.col("evidence_type").isin(fixed.TRUSTED_TYPES) & (F.col("confidence") >= 0.6))
    # What the evidence alone decides is decided before the join, the dear rules last; texts and tokens are staged, so that they are evaluated once a row.
    fit = evidence.where(F.col("field_name").isin(CONTACT_COLUMNS) & enough & ~platform_source("source_url") & F.coalesce(~is_mail | ~blocked_mail("field_value"), F.lit(False)))
    plain = fit.withColumn("_plain", normalize_text(F.concat_ws(" ", text("source_url"), text("source_title"), text("source_snippet")))).withColumn("_joined", F.replace("_plain", F.lit(" "), F.lit("")))
    people = subjects.select("lead_id", author_tokens("author_name").alias("_own"), title_tokens("title").alias("_of_title"))
    named = plain.join(people, "lead_id").where(identity_of(F.col("_own"), F.col("_of_title"), F.col("_plain"), F.col("_joined")))
    return best_evidence(named, ["lead_id"]).drop("_own", "_of_title", "_plain", "_joined", "rank")


def top_evidence(evidence: DataFrame, current: DataFrame, n: int = 3) -> DataFrame:
    """The n best rows of each field that agree with the lead's current value (lead_id, field_name, value) and are off platforms."""
    rows = evidence.join(current.withColumnRenamed("value", "field_value"), ["lead_id", "field_name", "field_value"], "left_semi")
    return best_evidence(rows, ["lead_id", "field_name"], ~platform_source("source_url"), n)


def evidence_by_field(evidence: DataFrame) -> DataFrame:
    """Per lead and field, the evidence in order of confidence."""
    item = F.struct((-F.col("confidence")).alias("minus"), "evidence_id", "field_value", "source_url")
    return evidence.groupBy("lead_id", "field_name").agg(F.sort_array(F.collect_list(item)).alias("items")).withColumn("items", F.transform("items", lambda x: F.struct(x["evidence_id"], x["field_value"], x["source_url"], (-x["minus"]).alias("confidence"))))


def consensus(observations: DataFrame, keys: list[str]) -> DataFrame:
    """observations (keys, value, norm, ord): per key the most common normal value (ties: seen first), its first spelling, count, total, percent, alternatives."""
    per_value = observations.groupBy(*keys, "norm").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("seen"), F.min_by("value", "ord").alias("value"))
    rank = F.struct((-F.col("n")).alias("minus"), "seen", "value", "norm", "n")
    grouped = per_value.groupBy(*keys).agg(F.sort_array(F.collect_list(rank)).alias("all"), F.sum("n").alias("total"))
    best = F.col("all")[0]
    others = F.transform(F.slice("all", 2, 1_000_000), lambda x: F.struct(x["value"].alias("value"), x["n"].alias("count"), F.floor(100 * x["n"] / F.col("total")).cast("int").alias("percent")))
    return grouped.select(*keys, best["value"].alias("value"), best["norm"].alias("norm"), best["n"].alias("matching"), "total", F.floor(100 * best["n"] / F.col("total")).cast("int").alias("percent"), others.alias("alternatives"))


def consensus_status(agreed: DataFrame, current: Column) -> DataFrame:
    """consensus() with a status against a current normal value (blank: none)."""
    several = F.size("alternatives") > 0
    status = F.when(F.col("total").isNull(), "missing").when(current == "", "available_elsewhere").when(current != F.col("norm"), "conflict").when(several, "consistent_with_conflict").otherwise("consistent")
    return agreed.withColumn("status", status)


def field_agreement(records: DataFrame, keys: list[str]) -> DataFrame:
    """records (keys, provider, value, ord) of one field: the majority value, agreement to two places (half-even), providers."""
    norm = F.trim(F.regexp_replace(F.lower(text("value")), "[^a-z0-9]+", " "))
    rows = records.where(present("value")).withColumn("norm", norm)
    agreed = consensus(rows, keys)
    sources = rows.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set("provider")), "; ").alias("sources"))
    return agreed.withColumn("agreement", F.bround(F.col("matching") / F.col("total"), 2)).join(sources, keys).drop("alternatives", "norm", "percent")


def resolution_confidence(n: Column, title_agreement: Column, author_agreement: Column, publisher: Column, date: Column) -> Column:
    """0, .52 or .62 + .25 of the mean agreement, .04 for a publisher, .03 for a date; at most .95."""
    core = F.array_compact(F.array(title_agreement, author_agreement))
    mean = F.when(F.size(core) > 0, F.aggregate(core, F.lit(0.0), lambda a, x: a + x) / F.size(core)).otherwise(0.0)
    base = F.when(n == 0, 0.0).when(n == 1, 0.52).otherwise(0.62 + mean * 0.25)
    extra = F.when((n > 0) & present(publisher), 0.04).otherwise(0.0) + F.when((n > 0) & present(date), 0.03).otherwise(0.0)
    return F.bround(F.least(base + extra, F.lit(0.95)), 2)


def candidate_inputs(leads: DataFrame, evidence: DataFrame) -> DataFrame:
    """(lead_id, field_name, channel, role, raw_value, normalized_value): contact columns, then evidence, first of each (channel, normal value)."""
    names = list(fixed.FIELD_ROLES)
    own = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(c).alias("field_name"), text(c).alias("raw_value")) for i, c in enumerate(names)))
    rows = leads.select("lead_id", F.explode(own).alias("x")).select("lead_id", "x.*", F.lit("").alias("evidence_id"))
    more = evidence.where(F.col("field_name").isin(names)).select("lead_id", F.lit(len(names)).alias("ord"), "field_name", text("field_value").alias("raw_value"), F.col("evidence_id").cast("string"))
    channels = F.create_map(*(F.lit(x) for c, (ch, _) in fixed.FIELD_ROLES.items() for x in (c, ch)))
    roles = F.create_map(*(F.lit(x) for c, (_, r) in fixed.FIELD_ROLES.items() for x in (c, r)))
    both = rows.unionByName(more).where(present("raw_value")).withColumn("channel", channels[F.col("field_name")]).withColumn("role", roles[F.col("field_name")])
    both = both.withColumn("normalized_value", normalized_contact("channel", "raw_value"))
    first = Window.partitionBy("lead_id", "channel", "normalized_value").orderBy("ord", "evidence_id")
    return both.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("lead_id", "field_name", "channel", "role", "raw_value", "normalized_value")


def shared_counts(candidates: DataFrame) -> DataFrame:
    """(channel, normalized_value, leads): in how many leads a value stands. Counted over the whole table; hot values are pre-aggregated."""
    return candidates.select("channel", "normalized_value", "lead_id").distinct().groupBy("channel", "normalized_value").agg(F.count(F.lit(1)).alias("leads"))


def shared_with_others(candidates: DataFrame) -> DataFrame:
    """candidates with shared_count, the number of other leads that have the value."""
    return candidates.join(shared_counts(candidates), ["channel", "normalized_value"]).withColumn("shared_count", F.col("leads") - 1).drop("leads")


def shared_as_of(uses: DataFrame, checks: DataFrame) -> DataFrame:
    """checks (lead_id, channel, normalized_value, checked_at, …) with shared_count: in how many other leads the value stood by then, given uses (lead_id, channel, normalized_value, used_at).

    An event-time sweep: the first use of each lead and value, and the checks, are put in one order by value, time and kind (uses first at equal times), and the uses are summed along it by ranges;
    less the sum at the value's start this is the number of leads so far. Rows of one value are never gathered, and no use meets a check. A use without a time stands from the beginning; a check without one, or without a value, has no count.
    """
    value = ["channel", "normalized_value"]
    asked = F.col("checked_at").isNotNull() & F.col("channel").isNotNull() & F.col("normalized_value").isNotNull()
    first = uses.groupBy("lead_id", *value).agg(F.min(F.coalesce("used_at", F.lit("0001-01-01").cast("timestamp"))).alias("used_at"))
    first = cut(first, "first-uses")
    own = checks.where(asked).join(first, ["lead_id", *value], "left").withColumn("_own", F.coalesce((F.col("used_at") <= F.col("checked_at")).cast("int"), F.lit(0))).drop("used_at")
    rows = own.withColumns({"_at": F.col("checked_at").cast("timestamp"), "_use": F.lit(0)})
    marks = first.select("lead_id", *value, F.col("used_at").cast("timestamp").alias("_at"), F.lit(1).alias("_use"))
    swept = running_sum(rows.unionByName(marks, allowMissingColumns=True), [*map(F.col, value), F.col("_at"), F.col("_use").desc(), F.col("lead_id")], F.col("_use").cast("bigint"), "_sum")
    start = swept.groupBy(*value).agg(F.min(F.col("_sum") - F.col("_use")).alias("_start"))
    out = swept.where("_use = 0").join(start, value).withColumn("shared_count", F.col("_sum") - F.col("_start") - F.col("_own"))
    return out.select(*checks.columns, "shared_count").unionByName(checks.where(~asked).withColumn("shared_count", F.lit(None).cast("bigint")))


def check(kind: str, result: Column, points: Column, reason: Column) -> Column:
    return F.struct(F.lit(kind).alias("check_type"), result.alias("result"), points.cast("int").alias("score_delta"), reason.alias("reason_code"))


def _yes(flag: Column, otherwise: str = "unknown") -> Column:
    return F.when(flag, "pass").otherwise(otherwise)


def candidate_checks(candidates: DataFrame, evidence: DataFrame, leads: DataFrame, domains: DataFrame, shared_threshold: int = 3) -> DataFrame:
    """candidates with checks (array of structs), score, status and reason.

    candidates: candidate_inputs() and optionally deliverability_status; evidence: with_trust(); leads: lead_id, identity_confidence;
    domains: author_domains().
    """
    norm = evidence.where(present("source_url")).withColumn("normalized_value", normalized_contact(F.when(F.col("field_name") == "public_phone", "phone").otherwise("email"), "field_value"))
    sources = norm.where("trusted").groupBy("lead_id", "field_name", "normalized_value").agg(F.countDistinct(F.nullif(registered_domain_of_url("source_url"), F.lit(""))).alias("n_domains"))
    rows = candidates.join(sources, ["lead_id", "field_name", "normalized_value"], "left").join(leads.select("lead_id", "identity_confidence"), "lead_id", "left")
    rows = rows.join(shared_counts(candidates), ["channel", "normalized_value"], "left")
    aligned = domains.select("lead_id", F.col("domain").alias("_domain"), F.lit(True).alias("_aligned"))
    rows = rows.withColumn("_domain", registered_domain_of_email("normalized_value")).join(aligned, ["lead_id", "_domain"], "left")
    delivery = text("deliverability_status") if "deliverability_status" in candidates.columns else F.lit("unknown")
    delivery = F.when(delivery == "", "unknown").otherwise(delivery)

    # Staged, so that each is evaluated once a row and the checks read plain columns.
    rows = rows.withColumns({"_syntax": email_syntax("normalized_value"), "_off": blocked_mail("normalized_value"), "_e164": e164("normalized_value")})
    rows = rows.withColumn("_details", details_of(F.col("_e164")))
    syntax = F.col("_syntax")
    blocked = syntax & F.col("_off")
    source = syntax & ~blocked & F.col("n_domains").isNotNull()
    identity = source & F.coalesce(F.col("identity_confidence") >= 0.65, F.lit(False))
    on_domain = F.coalesce(F.col("_aligned"), F.lit(False))
    others = F.coalesce(F.col("leads") - 1, F.lit(0))
    shared = others >= shared_threshold
    several = F.coalesce(F.col("n_domains") >= 2, F.lit(False))
    points = lambda flag, n: F.when(flag, n).otherwise(0)
    role = F.concat(F.lit("role_"), F.col("role"))
    email = F.array(
        check("syntax", _yes(syntax, "fail"), points(syntax, 15), F.when(syntax, "valid_syntax").otherwise("invalid_syntax")),
        check("source_policy", F.when(blocked, "fail").otherwise("pass"), F.lit(0), F.when(blocked, "blocked_email_domain").otherwise("allowed_email_domain")),
        check("trusted_source", _yes(source), points(source, 30), F.when(source, "trusted_exact_source").otherwise("missing_trusted_source")),
        check("identity_match", _yes(identity), points(identity, 30), F.when(identity, "identity_aligned").otherwise("identity_inconclusive")),
        check("role_match", F.lit("pass"), F.lit(10), role),
        check("domain_alignment", _yes(on_domain), points(on_domain, 10), F.when(on_domain, "email_on_author_domain").otherwise("email_domain_not_author_owned")),
        check("deliverability", F.when(delivery == "deliverable", "pass").when(delivery == "undeliverable", "fail").otherwise("unknown"), points(delivery == "deliverable", 15), F.concat(F.lit("smtp_"), delivery)),
        check("shared_channel", F.when(shared, "unknown").otherwise("pass"), F.lit(0), F.when(shared, F.concat(F.lit("shared_across_"), others.cast("string"), F.lit("_leads"))).otherwise("unique_to_lead")),
        check("corroboration", _yes(several & ~shared), points(several & ~shared, 15), F.when(several & ~shared, "multiple_independent_sources").otherwise("single_source")),
    )
    details = F.col("_details")
    bad = details["is_fake"] | details["is_premium"]
    number = details["valid"]
    backed = number & F.col("n_domains").isNotNull()
    known = backed & F.coalesce(F.col("identity_confidence") >= 0.65, F.lit(False))
    phone = F.array(
        check("phone_validity", _yes(number, "fail"), points(number, 15), F.when(number, "valid_e164").otherwise("invalid_phone")),
        check("phone_line_type", F.when(bad, "fail").otherwise("pass"), F.lit(0), F.when(bad, "premium_or_fake_number").otherwise(F.concat(F.lit("line_"), details["line_type"]))),
        check("trusted_source", _yes(backed), points(backed, 30), F.when(backed, "trusted_exact_source").otherwise("missing_trusted_source")),
        check("identity_match", _yes(known), points(known, 35), F.when(known, "identity_aligned").otherwise("identity_inconclusive")),
        check("role_match", F.lit("pass"), F.lit(10), role),
        check("corroboration", _yes(several & backed), points(several & backed, 10), F.when(several & backed, "multiple_independent_sources").otherwise("single_source")),
    )
    is_mail = F.col("channel") == "email"
    # Written once: score, status and reason all read the checks, which would otherwise be evaluated for each of them.
    checked = cut(rows.withColumn("checks", F.when(is_mail, email).otherwise(phone)).withColumn("_delivery", delivery), "checks")
    score = F.least(F.lit(100), F.aggregate("checks", F.lit(0), lambda a, c: a + c["score_delta"]))
    passed = lambda k: F.exists("checks", lambda c: (c["check_type"] == k) & (c["result"] == "pass"))
    syntax, blocked, source, identity = passed("syntax"), ~passed("source_policy"), passed("trusted_source"), passed("identity_match")
    number, known = passed("phone_validity"), identity
    of_mail = F.when(syntax & ~blocked & source & identity & F.col("_delivery").isin("deliverable", "unknown") & (F.col("score") >= 85), "verified").when(~syntax | blocked | (F.col("_delivery") == "undeliverable"), "not_verified").otherwise("other")
    of_phone = F.when(known & (F.col("score") >= 90), "verified").when(~number, "not_verified").otherwise("other")
    open_checks = F.transform(F.filter("checks", lambda c: c["result"] != "pass"), lambda c: c["reason_code"])
    reason = F.when(F.size(open_checks) == 0, "All required verification checks passed.").otherwise(F.array_join(open_checks, "; "))
    done = checked.withColumn("score", score).withColumn("status", F.when(is_mail, of_mail).otherwise(of_phone)).withColumn("reason", reason)
    return done.select(*candidates.columns, "checks", "score", "status", "reason")


def check_log(checked: DataFrame, checked_at: Column) -> DataFrame:
    """A row for each check of each candidate, with version and time; to be appended to a log."""
    return checked.select("lead_id", "channel", "normalized_value", F.explode("checks").alias("c")).select("lead_id", "channel", "normalized_value", "c.*", F.lit(VERSION).alias("checker_version"), checked_at.alias("checked_at"))


def selection_key() -> Column:
    rank = lambda table, c: F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[F.col(c)]
    return F.struct(rank(fixed.STATUS_RANK, "status").alias("a"), F.col("score").alias("b"), rank(fixed.CHANNEL_RANK, "channel").alias("c"), F.coalesce(rank(fixed.ROLE_RANK, "role"), F.lit(0)).alias("d"), F.col("normalized_value").alias("e"))


def primary_candidate(checked: DataFrame) -> DataFrame:
    """checked with is_primary: the strongest candidate of each lead."""
    best = checked.groupBy("lead_id").agg(F.max(selection_key()).alias("_best"))
    return checked.join(best, "lead_id").withColumn("is_primary", F.col("_best") == selection_key()).drop("_best")


def ranked_candidates(checked: DataFrame) -> DataFrame:
    """Per lead, its candidates in order of selection as an array of structs (a lead has few)."""
    item = F.struct(selection_key().alias("k"), "normalized_value", "status", "score", "reason")
    return checked.groupBy("lead_id").agg(F.sort_array(F.collect_list(item), False).alias("x")).select("lead_id", F.transform("x", lambda x: F.struct(x["normalized_value"].alias("candidate"), x["status"].alias("status"), x["score"].alias("score"), x["reason"].alias("reason"))).alias("candidates"))


def lead_status(leads: DataFrame, checked: DataFrame) -> DataFrame:
    """Per lead: any verified, all not verified, else other; and the primary's score (0 without candidates)."""
    rolled = checked.groupBy("lead_id").agg(F.bool_or(F.col("status") == "verified").alias("v"), F.every(F.col("status") == "not_verified").alias("n"), F.max(selection_key()).alias("k"))
    status = F.when(F.col("v"), "verified").when(F.col("n"), "not_verified").otherwise("other")
    return leads.select("lead_id").join(rolled, "lead_id", "left").select("lead_id", F.when(F.col("k").isNull(), "other").otherwise(status).alias("status"), F.coalesce("k.b", F.lit(0)).alias("score"))


def evidence_rows(entities: DataFrame, key: str, columns: dict[str, str], source: str) -> DataFrame:
    """A row for each non-blank column of an entity, with the evidence type of its column."""
    items = F.array(*(F.struct(F.lit(c).alias("field_name"), text(c).alias("field_value"), F.lit(t).alias("evidence_type")) for c, t in columns.items()))
    return entities.select(key, text(source).alias("source_url"), F.explode(items).alias("x")).select(key, "source_url", "x.*").where(present("field_value"))


def insert_absent(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """existing with the new rows whose keys are not there yet (the first of each key)."""
    fresh = new.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")
    return existing.unionByName(fresh.select(existing.columns))
