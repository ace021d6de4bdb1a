"""Reports: counts, shares, statuses. Each is one grouped aggregate with conditional counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import present, text
from .filters import any_present


def share(part: Column, whole: Column) -> Column:
    """Integer percent, half-even; 0 of nothing."""
    return F.when(whole > 0, F.bround(100 * part / whole, 0)).otherwise(0).cast("int")


def counts(df: DataFrame, by: list[str], **conditions: Column) -> DataFrame:
    """Rows and conditional counts per group."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), *(F.count_if(c).alias(n) for n, c in conditions.items()))


def dashboard_kpis(leads: DataFrame) -> DataFrame:
    """One row of conditional counts and percents over leads (with the flag verified_ready)."""
    flags = {
        "verified": F.col("verified_ready"), "not_verified": F.col("verification_status") == "not_verified", "with_email": any_present(fixed.EMAIL_FIELDS), "with_phone": present("public_phone"),
        "hot": F.col("lead_tier") == "hot", "warm": F.col("lead_tier") == "warm", "cold": F.col("lead_tier") == "cold", "rejected": F.col("lead_tier") == "rejected",
        "no_video": F.col("video_status") == "no_public_video_found", "do_not_contact": F.col("do_not_contact"), "contactable": any_present([*fixed.EMAIL_FIELDS, "public_phone"]),
    }
    one = leads.agg(F.count(F.lit(1)).alias("total"), *(F.count_if(c).alias(n) for n, c in flags.items()))
    return one.withColumns({f"{n}_percent": share(F.col(n), F.col("total")) for n in ("verified", "with_email", "with_phone", "contactable")})


def team_performance(assignments: DataFrame) -> DataFrame:
    done, won = F.col("status") == "completed", F.col("status") == "converted"
    return counts(assignments.where("is_current"), ["owner_id"], completed=done, converted=won, pending=~(done | won))


def team_roster(users: DataFrame, assignments: DataFrame) -> DataFrame:
    """Per user, also those without assignments."""
    done = counts(assignments.where("is_current"), ["owner_id"], completed=F.col("status") == "completed", converted=F.col("status") == "converted")
    rows = users.join(done, users.user_id == done.owner_id, "left")
    return rows.select("user_id", *(F.coalesce(c, F.lit(0)).alias(n) for c, n in (("total", "assigned"), ("completed", "completed"), ("converted", "converted"))))


def run_counts(runs: DataFrame, books: DataFrame, leads: DataFrame) -> DataFrame:
    """Per run: distinct books and leads, pre-aggregated so that the two joins do not multiply."""
    of_book = books.groupBy("run_id").agg(F.count(F.lit(1)).alias("books"))
    of_lead = leads.join(books.select("book_id", "run_id"), "book_id").groupBy("run_id").agg(F.count(F.lit(1)).alias("leads"))
    rows = runs.join(of_book, "run_id", "left").join(of_lead, "run_id", "left")
    return rows.select(*runs.columns, F.coalesce("books", F.lit(0)).alias("books"), F.coalesce("leads", F.lit(0)).alias("leads"))


def search_log_counts(results: DataFrame, kind: str) -> DataFrame:
    return counts(results, ["log_id"], of_kind=F.col("classification") == kind)


def run_diagnostics(books: DataFrame, leads: DataFrame, evidence: DataFrame, videos: DataFrame) -> DataFrame:
    """Per run: evidence, leads with videos, books without author, leads without any contact."""
    in_run = leads.join(books.select("book_id", "run_id"), "book_id")
    of_book = counts(books, ["run_id"], missing_author=~present("author_name")).withColumnRenamed("total", "books")
    of_lead = counts(in_run, ["run_id"], missing_contact=~any_present([*fixed.EMAIL_FIELDS, "public_phone"])).withColumnRenamed("total", "leads")
    keys = in_run.select("lead_id", "run_id")
    of_evidence = evidence.join(keys, "lead_id").groupBy("run_id").agg(F.count(F.lit(1)).alias("evidence"))
    of_video = videos.select("lead_id").distinct().join(keys, "lead_id").groupBy("run_id").agg(F.count(F.lit(1)).alias("with_videos"))
    out = of_book
    for part in (of_lead, of_evidence, of_video):
        out = out.join(part, "run_id", "left")
    return out.na.fill(0)


def evidence_types(books: DataFrame, leads: DataFrame, evidence: DataFrame) -> DataFrame:
    return evidence.join(leads.select("lead_id", "book_id"), "lead_id").join(books.select("book_id", "run_id"), "book_id").groupBy("run_id", "evidence_type").agg(F.count(F.lit(1)).alias("n"))


def lead_list_stats(flags: DataFrame) -> DataFrame:
    """flags: verified_ready, needs_review, verified_email, verified_phone per lead."""
    return flags.agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.col(c)).alias(c) for c in ("verified_ready", "needs_review", "verified_email", "verified_phone")))


def verified_contactable(candidates: DataFrame, requirement: str = "", allow_unchecked: bool = False) -> DataFrame:
    """One row: distinct leads with a qualifying candidate."""
    good = F.col("verification_status") == "verified"
    if allow_unchecked:
        good = good | ((F.col("channel") == "email") & (F.col("verification_status") == "other") & (F.col("verification_score") >= 75) & (F.col("deliverability_status") == "unknown"))
    return candidates.where(good & F.col("channel").isin(["email"] if requirement == "email_only" else ["email", "phone"])).agg(F.countDistinct("lead_id").alias("leads"))


def stale_leads(leads: DataFrame, candidates: DataFrame, cutoff: Column, most: int | None = None) -> DataFrame:
    """Verified leads whose newest check is before the cutoff, or absent; oldest first."""
    newest = candidates.groupBy("lead_id").agg(F.max("last_checked_at").alias("last_checked"))
    rows = leads.where(F.col("verification_status") == "verified").join(newest, "lead_id", "left").where(F.col("last_checked").isNull() | (F.col("last_checked") < cutoff))
    return rows if most is None else rows.orderBy(F.col("last_checked").asc_nulls_first(), "lead_id").limit(most)


def batch_counters(rows: DataFrame, status: str = "verification_status", by: list[str] = ()) -> DataFrame:
    s = F.col(status)
    return counts(rows, list(by), verified=s == "verified", not_verified=s == "not_verified", other=s == "other", errors=s.isNull())


def run_summary(books: DataFrame, leads: DataFrame) -> DataFrame:
    in_run = leads.join(books.select("book_id", "run_id"), "book_id")
    of_lead = counts(in_run, ["run_id"], verified=F.col("verification_status") == "verified", hot=F.col("lead_tier") == "hot").withColumnRenamed("total", "leads")
    return books.groupBy("run_id").agg(F.count(F.lit(1)).alias("books")).join(of_lead, "run_id", "left").na.fill(0)


def max_followers(profiles: DataFrame) -> DataFrame:
    return profiles.groupBy("lead_id").agg(F.max("follower_count").alias("max_followers"))


def video_status(videos: DataFrame) -> DataFrame:
    """Per lead, over classifications of confidence .4 or more: animated, trailer (both .75), all read aloud, unclear, none (.7)."""
    ok = F.coalesce(F.col("classification_confidence") >= 0.4, F.lit(False))
    sure = ok & (F.col("classification_confidence") >= 0.75)
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    of = lambda cond: F.max(F.when(cond, F.col("classification_confidence")))
    agg = videos.groupBy("lead_id").agg(
        F.bool_or(sure & flag("is_animated_video")).alias("animated"), F.bool_or(sure & flag("is_book_trailer")).alias("trailer"), F.bool_or(ok).alias("some"),
        F.every(~ok | flag("is_read_aloud")).alias("aloud"), of(ok & flag("is_animated_video")).alias("c_animated"), of(ok & flag("is_book_trailer")).alias("c_trailer"), of(ok).alias("c_any"),
    )
    status = F.when(F.col("animated"), "found_animated_video").when(F.col("trailer"), "found_trailer").when(F.col("some") & F.col("aloud"), "found_read_aloud_only").when(F.col("some"), "unclear").otherwise("no_public_video_found")
    confidence = F.when(F.col("animated"), F.col("c_animated")).when(F.col("trailer"), F.col("c_trailer")).when(F.col("some"), F.col("c_any")).otherwise(0.7)
    return agg.select("lead_id", status.alias("video_status"), confidence.alias("video_confidence"))


def source_urls(evidence: DataFrame) -> DataFrame:
    """Distinct sources of each lead, joined (sorted, since no order is given)."""
    return evidence.where(present("source_url")).groupBy("lead_id").agg(F.array_join(F.array_sort(F.collect_set("source_url")), "; ").alias("source_urls"))


def corroborated(evidence: DataFrame, domain: Column, least: int = 2) -> DataFrame:
    """(lead_id, field_name, field_value, n_domains, corroborated) over trusted evidence."""
    rows = evidence.where("trusted").withColumn("_d", F.nullif(domain, F.lit("")))
    return rows.groupBy("lead_id", "field_name", "field_value").agg(F.countDistinct("_d").alias("n_domains")).withColumn("corroborated", F.col("n_domains") >= least)


def import_stats(rows: DataFrame) -> DataFrame:
    """Statuses, contacts, created and enriched rows (existing_book_id NULL or not)."""
    return rows.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("verification_status") == "verified").alias("verified"), F.count_if(F.col("verification_status") == "not_verified").alias("not_verified"), F.count_if(F.col("verification_status") == "other").alias("other"),
        F.count_if(present("public_email")).alias("with_email"), F.count_if(present("public_phone")).alias("with_phone"), F.count_if(F.col("existing_book_id").isNull()).alias("created"), F.count_if(F.col("existing_book_id").isNotNull()).alias("enriched"),
    )


def schedule_capacity(schedules: DataFrame, leads: DataFrame, assignments: DataFrame) -> DataFrame:
    """One row: active schedules, their daily places, assigned and unassigned leads."""
    plan = schedules.agg(F.count_if("is_active").alias("active"), F.coalesce(F.sum(F.when(F.col("is_active"), F.col("daily_lead_count"))), F.lit(0)).alias("capacity"))
    held = assignments.where("is_current").select("lead_id").distinct().withColumn("held", F.lit(True))
    state = leads.select("lead_id").join(held, "lead_id", "left").agg(F.count_if(F.col("held").isNotNull()).alias("assigned"), F.count_if(F.col("held").isNull()).alias("unassigned"))
    return plan.crossJoin(state)  # one row each


def task_status_counts(tasks: DataFrame, now: Column) -> DataFrame:
    running = F.col("execution_status") == "running"
    due = F.col("is_active") & (F.col("next_run_at").isNull() | (F.col("next_run_at") <= now)) & ~running
    return tasks.agg(F.count(F.lit(1)).alias("total"), F.count_if("is_active").alias("active"), F.count_if(running).alias("running"), F.count_if(due).alias("due"))


def run_progress(items: DataFrame, by: list[str], finished: Column, running: Column, elapsed: Column) -> DataFrame:
    """Percent of finished items (at most 99 while running) and seconds left at the pace so far."""
    agg = items.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.count_if(finished).alias("finished"), F.bool_or(running).alias("is_running"), F.max(elapsed).alias("elapsed"))
    percent = F.floor(100 * F.col("finished") / F.col("total")).cast("int")
    left = F.when(F.col("finished") > 0, F.floor(F.col("elapsed") / F.col("finished") * (F.col("total") - F.col("finished"))).cast("bigint"))
    return agg.withColumn("percent", F.when(F.col("is_running"), F.least(percent, F.lit(99))).otherwise(percent)).withColumn("seconds_left", left).drop("elapsed")


def provider_list(rows: DataFrame, key: str) -> DataFrame:
    return rows.where(present("provider")).groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("provider")), "; ").alias("providers"))


def assignment_stats(assignments: DataFrame) -> DataFrame:
    s = F.col("status")
    return assignments.where("is_current").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(s == "assigned").alias("new"), F.count_if(s.isin("in_progress", "contacted", "follow_up")).alias("in_progress"),
        F.count_if(s == "completed").alias("completed"), F.count_if(s == "converted").alias("converted"), F.count_if(s.isin("invalid", "rejected")).alias("invalid"),
    )


def last_event(events: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Per key the newest row's value."""
    return events.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


__all__ = [n for n in dir() if n[0].islower() and n not in {"annotations", "fixed", "present", "text", "any_present"}]
