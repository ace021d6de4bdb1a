"""State changes: upserts, stale flags, due rows, campaigns, assignments, bulk updates. Each returns the new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.coerce import next_occurrence
from ..functions.text import author_key, book_key, first_present, present, text
from .allocate import capacity_slots
from .dedupe import first_value_fill


def upsert_blank_fill(existing: DataFrame, new: DataFrame, key: Column, columns: list[str]) -> DataFrame:
    """existing and new rows as one row per key; blanks filled in order, existing rows first. A verified new status upgrades."""
    rows = existing.withColumn("_gen", F.lit(0)).unionByName(new.withColumn("_gen", F.lit(1)), allowMissingColumns=True).withColumn("_key", key)
    filled = first_value_fill(rows, ["_key"], columns, F.struct("_gen", "ord"))
    if "verification_status" in existing.columns:
        status = rows.groupBy("_key").agg(F.bool_or(F.col("verification_status") == "verified").alias("_v"), F.min_by("verification_status", F.struct("_gen", "ord")).alias("_s"))
        filled = filled.join(status, "_key").withColumn("verification_status", F.when(F.col("_v"), "verified").otherwise(F.col("_s"))).drop("_v", "_s")
    return filled.withColumnRenamed("_key", "key")


def upsert_by_key(existing: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key over both tables; of equal order, the new one."""
    both = existing.withColumn("_gen", F.lit(0)).unionByName(new.withColumn("_gen", F.lit(1)))
    last = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order), F.desc("_gen"))
    return both.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "_gen")


def import_rows(rows: DataFrame, trust_status: bool = False) -> dict[str, DataFrame]:
    """Five tables out of canonical import rows (with row_id): a book and a lead for each row, authors by key, candidates, evidence."""
    base = rows.withColumns({"book_id": F.concat(F.lit("book-"), "row_id"), "lead_id": F.concat(F.lit("lead-"), "row_id"), "author_id": author_key("author_name"), "normalized_key": book_key("title", "author_name", "asin")})
    status = F.col("verification_status") if trust_status else F.lit("other")
    contacts = F.array(
        F.struct(F.lit(0).alias("ord"), F.lit("email").alias("channel"), F.lit("public_email").alias("field_name"), text("public_email").alias("value"), text("public_email_source_url").alias("source_url")),
        F.struct(F.lit(1).alias("ord"), F.lit("phone").alias("channel"), F.lit("public_phone").alias("field_name"), text("public_phone").alias("value"), text("public_phone_source_url").alias("source_url")),
    )
    each = base.select("lead_id", "book_id", F.explode(F.filter(contacts, lambda c: c["value"] > "")).alias("c")).select("lead_id", "book_id", "c.*")
    first = F.row_number().over(Window.partitionBy("lead_id").orderBy("ord")) == 1
    return {
        "books": base.select("book_id", "title", "author_name", "asin", "normalized_key"),
        "authors": first_value_fill(base.where(present("author_id")), ["author_id"], ["author_name", "author_website", "contact_page_url"], F.col("row_id")),
        "leads": base.select("lead_id", "book_id", "author_id", "public_email", "public_phone", status.alias("verification_status")),
        "candidates": each.select("lead_id", "channel", F.col("value").alias("normalized_value"), F.lit("other").alias("verification_status"), F.lit(0).alias("verification_score"), first.alias("is_primary")),
        "evidence": each.where(F.col("source_url").rlike("^https?://")).select("lead_id", "book_id", "field_name", F.col("value").alias("field_value"), "source_url", F.lit("manual").alias("evidence_type")),
    }


def flag_stale(leads: DataFrame, stale: DataFrame, now: Column) -> DataFrame:
    """leads with contacts_stale and its time set for the stale ones, other rows as they were."""
    marked = leads.join(stale.select("lead_id", F.lit(True).alias("_stale")), "lead_id", "left")
    is_stale = F.col("_stale").isNotNull()
    before = F.col("stale_at") if "stale_at" in leads.columns else F.lit(None).cast("timestamp")
    return marked.withColumns({"contacts_stale": is_stale | F.coalesce(F.col("contacts_stale"), F.lit(False)), "stale_at": F.when(is_stale, now).otherwise(before)}).drop("_stale")


def settle_stale(leads: DataFrame, rechecked: DataFrame) -> DataFrame:
    """After a recheck (lead_id, status): still verified leads lose the flag, others gain a warning."""
    rows = leads.join(rechecked.select("lead_id", F.col("status").alias("_status")), "lead_id", "left")
    ok = F.coalesce(F.col("_status") == "verified", F.lit(False))
    lost = F.col("_status").isNotNull() & ~ok
    warnings = F.coalesce(F.col("warnings"), F.array().cast("array<string>"))
    return rows.withColumns({"contacts_stale": F.when(ok, False).otherwise(F.col("contacts_stale")), "warnings": F.when(lost, F.array_append(warnings, F.lit("Contact could not be verified again."))).otherwise(warnings)}).drop("_status")


def due_rows(schedules: DataFrame, now: Column, key: str) -> DataFrame:
    """Active rows that were never scheduled or whose time has come, in order."""
    return schedules.where(F.col("is_active") & (F.col("next_run_at").isNull() | (F.col("next_run_at") <= now))).orderBy(F.col("next_run_at").asc_nulls_first(), key)


def with_next_run(schedules: DataFrame, reference: Column) -> DataFrame:
    """schedules with the next occurrence after the reference."""
    return schedules.withColumn("next_run_at", next_occurrence(reference, F.col("frequency"), F.col("interval_hours"), F.col("days_of_week"), F.col("run_time")))


SENDABLE = {"queued": 1, "step1_sent": 2, "step2_sent": 3}


def due_enrollments(enrollments: DataFrame, leads: DataFrame, steps: DataFrame, senders: DataFrame, now: Column) -> DataFrame:
    """What is to happen to each due enrollment: step, sender, new status, next action. Nothing is sent.

    Without an address or a step it is completed; without a free sender it is tried an hour later; after a message the next step follows
    its delay, or it is completed.
    """
    target = F.create_map(*(F.lit(x) for kv in SENDABLE.items() for x in kv))[F.col("status")]
    due = enrollments.where(F.col("status").isin(list(SENDABLE)) & (F.col("next_action_date") <= now)).withColumn("step_number", target)
    address = first_present("public_email", "representation_email", "publicist_email")
    rows = due.join(leads.select("lead_id", address.alias("recipient")), "lead_id", "left")
    rows = rows.join(steps.select("campaign_id", "step_number", "subject"), ["campaign_id", "step_number"], "left")
    later = steps.select("campaign_id", (F.col("step_number") - 1).alias("step_number"), F.col("delay_days").alias("next_delay"))
    rows = rows.join(later, ["campaign_id", "step_number"], "left").withColumn("can_send", present("recipient") & F.col("subject").isNotNull())
    order = [F.col("next_action_date"), F.col("enrollment_id")]
    sent = capacity_slots(rows.where("can_send"), senders, order)
    ended = rows.where(~F.col("can_send")).withColumn("sender_id", F.lit(None).cast(sent.schema["sender_id"].dataType))
    both = sent.unionByName(ended)
    goes = F.col("can_send") & F.col("sender_id").isNotNull()
    status = F.when(~F.col("can_send"), "completed").when(~goes, F.col("status")).when(F.col("next_delay").isNull(), "completed").otherwise(F.concat(F.lit("step"), F.col("step_number").cast("string"), F.lit("_sent")))
    at = F.when(F.col("can_send") & ~goes, F.timestamp_add("HOUR", F.lit(1), now)).when(goes & F.col("next_delay").isNotNull(), F.timestamp_add("DAY", F.col("next_delay"), now)).otherwise(F.col("next_action_date"))
    return both.select("enrollment_id", "lead_id", F.when(goes, F.col("step_number")).alias("sent_step"), "sender_id", status.alias("new_status"), at.alias("next_action_date"))


def assignment_times(changes: DataFrame) -> DataFrame:
    """changes (assignment_id, status, at): the first times of starting, completing and converting, and the last status."""
    first = lambda s: F.min(F.when(F.col("status").isin(s), F.col("at")))
    return changes.groupBy("assignment_id").agg(
        first(["in_progress", "contacted", "follow_up"]).alias("started_at"), first(["completed"]).alias("completed_at"), first(["converted"]).alias("converted_at"), F.max_by("status", F.struct("at", "status")).alias("status"),
    )


def add_counters(base: DataFrame, runs: DataFrame, key: str, total: str, amount: str) -> DataFrame:
    """base with the sums of runs added to its totals."""
    sums = runs.groupBy(key).agg(F.sum(amount).alias("_sum"))
    return base.join(sums, key, "left").withColumn(total, F.col(total) + F.coalesce("_sum", F.lit(0))).drop("_sum")


def rescore(leads: DataFrame, scored: DataFrame) -> DataFrame:
    """New scores and tiers (lead_id, score, tier); a lead that is no longer rejected leaves that review status."""
    rows = leads.join(scored.select("lead_id", F.col("score").alias("_s"), F.col("tier").alias("_t")), "lead_id", "left")
    freed = (F.col("manual_review_status") == "rejected") & F.coalesce(F.col("_t") != "rejected", F.lit(False))
    return rows.withColumns({"lead_score": F.coalesce("_s", "lead_score"), "lead_tier": F.coalesce("_t", "lead_tier"), "manual_review_status": F.when(freed, "needs_review").otherwise(F.col("manual_review_status"))}).drop("_s", "_t")


def reverify_selection(leads: DataFrame, status: str = "", ids: DataFrame | None = None, most: int | None = None) -> DataFrame:
    out = leads if ids is None else leads.join(ids.select("lead_id"), "lead_id", "left_semi")
    out = out.where(F.col("verification_status") == status) if status else out
    return out if most is None else out.orderBy("created_at", "lead_id").limit(most)


def bulk_update(leads: DataFrame, ids: DataFrame, action: str, visible: DataFrame | None = None) -> DataFrame:
    """reject, do_not_contact or delete the leads of an id list (within the visible ones); other rows stay."""
    chosen = ids.select("lead_id").distinct()
    chosen = chosen if visible is None else chosen.join(visible.select("lead_id"), "lead_id", "left_semi")
    if action == "delete":
        return leads.join(chosen, "lead_id", "left_anti")
    rows = leads.join(chosen.withColumn("_hit", F.lit(True)), "lead_id", "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    if action == "reject":
        rows = rows.withColumn("manual_review_status", F.when(hit, "rejected").otherwise(F.col("manual_review_status")))
    elif action == "do_not_contact":
        rows = rows.withColumns({"do_not_contact": hit | F.col("do_not_contact"), "manual_review_status": F.when(hit, "do_not_contact").otherwise(F.col("manual_review_status"))})
    else:
        raise ValueError(f"unknown action {action}")
    return rows.drop("_hit")


def gate(score: Column, tier: Column, errors: Column) -> Column:
    """struct(score, tier): rejected with 0 if any error is left."""
    bad = F.size(errors) > 0
    return F.struct(F.when(bad, 0).otherwise(score).alias("score"), F.when(bad, "rejected").otherwise(tier).alias("tier"))


__all__ = [n for n in dir() if n[0].islower() and n not in {"annotations", "author_key", "book_key", "first_present", "present", "text", "capacity_slots", "first_value_fill", "next_occurrence"}]
