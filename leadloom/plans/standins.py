"""Lead tables derived from the general tables, so that every operator runs on data that grows with them.

Each definition is one SELECT that Spark and DuckDB read alike; queries apply operators to the Spark side, and their SQL twins start from
the same definition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FIRST = "case {0} % 5 when 0 then 'Alex' when 1 then 'Casey' when 2 then 'Drew' when 3 then 'Jules' else 'Kim' end"
LAST = "case {0} % 7 when 0 then 'Maple' when 1 then 'Quill' when 2 then 'Rowan' when 3 then 'Tern' when 4 then 'Umber' when 5 then 'Vale' else 'Wren' end"
NAME = f"{FIRST} || ' ' || {LAST}"

SQL = {
    "books": f"""
        select p_partkey as book_id, p_partkey % 25 as run_id,
          case when p_partkey % 31 = 0 then '' when p_partkey % 4 = 0 then 'The ' || p_name || ' (Large Paperback) - Amazon.com' else p_name end as title,
          case when p_partkey % 17 = 0 then '' when p_partkey % 13 = 0 then 'Brand House Press' else {NAME.format("p_size")} end as author_name,
          case when p_partkey % 3 = 0 then 'B0' || lpad('' || (p_partkey % 1500), 8, '0') else '' end as asin,
          case when p_partkey % 3 = 0 then 'https://www.amazon.co.uk/dp/B0' || lpad('' || (p_partkey % 1500), 8, '0') || '/ref=x' when p_partkey % 3 = 1 then 'https://amazon.com.shop.example.test/dp/B000000001' else '' end as amazon_book_url,
          case p_size % 6 when 0 then 'Penguin Kids' when 1 then 'Quill and Co' else '' end as publisher, p_type as category,
          case when p_size % 5 = 0 then '' else '' || (1990 + p_size % 37) end as publication_date,
          cast(p_size % 51 as double) / 10 as rating, p_size * 7 as review_count,
          case p_size % 3 when 0 then true when 1 then false else null end as is_childrens_book, p_size % 2 = 0 as is_picture_or_illustrated_book, p_size % 4 = 0 as has_aplus_content, p_size as author_id
        from part""",
    "authors": f"""
        select distinct p_size as author_id, {NAME.format("p_size")} as profile_name,
          case when p_size % 3 = 0 then '' else 'https://www.' || lower({LAST.format("p_size")}) || (p_size % 7) || '.example.test/home' end as canonical_website,
          case when p_size % 4 = 0 then 'https://' || lower({LAST.format("p_size")}) || '.example.test/contact' else '' end as contact_page_url,
          case when p_size % 5 = 0 then 'https://instagram.com/' || lower({FIRST.format("p_size")}) else '' end as instagram_url,
          case when p_size % 7 = 0 then '' else 'bio of the author' end as author_bio, p_size % 6 = 0 as has_other_books,
          cast(p_size % 11 as double) / 10 as identity_confidence
        from part""",
    "leads": """
        select o_orderkey as lead_id, o_custkey as book_id, o_custkey % 50 + 1 as author_id, o_custkey % 40 as owner_id,
          case when o_orderkey % 3 <> 0 then 'a' || (o_orderkey % 997) || '@s' || (o_orderkey % 11) || '.example.test' else '' end as public_email,
          case when o_orderkey % 7 = 0 then 'agent' || (o_orderkey % 53) || '@desk.example.test' else '' end as representation_email,
          case when o_orderkey % 23 = 0 then 'press' || (o_orderkey % 5) || '@press.example.test' else '' end as publicist_email,
          case when o_orderkey % 4 = 0 then '+1212' || lpad('' || (2000000 + o_orderkey % 9973), 7, '0') else '' end as public_phone,
          case o_orderkey % 9 when 0 then 'London, UK' when 1 then 'Boston, USA' when 2 then 'Pakistan' else '' end as location,
          case o_orderstatus when 'F' then 'verified' when 'O' then 'other' else 'not_verified' end as verification_status,
          cast(floor(o_totalprice) as bigint) % 101 as lead_score, cast(floor(o_totalprice / 7) as bigint) % 101 as verification_score,
          case when o_totalprice > 400000 then 'hot' when o_totalprice > 250000 then 'warm' when o_totalprice > 100000 then 'cold' else 'rejected' end as lead_tier,
          case o_orderpriority when '1-URGENT' then 'not_checked' when '2-HIGH' then 'unclear' when '3-MEDIUM' then 'no_public_video_found' else 'found_trailer' end as video_status,
          case when o_orderkey % 37 = 0 then 'do_not_contact' when o_orderkey % 19 = 0 then 'rejected' else 'needs_review' end as manual_review_status,
          o_orderkey % 29 = 0 as do_not_contact, o_orderkey % 6 = 0 as uploader_attested, cast(o_custkey % 10 as double) / 10 as extraction_confidence, o_orderdate as created_at
        from orders""",
    "candidates": """
        select l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || cast(floor(l_extendedprice) as bigint) as candidate_id, l_orderkey as lead_id,
          case when l_linenumber % 3 = 0 then 'phone' else 'email' end as channel,
          case when l_linenumber % 3 = 0 then '+1212' || lpad('' || (2000000 + (l_orderkey + case when l_quantity > 25 then 0 else 1 end) % 9973), 7, '0')
            else 'a' || ((l_orderkey + case when l_quantity > 25 then 0 else 1 end) % 997) || '@s' || (l_orderkey % 11) || '.example.test' end as normalized_value,
          case l_returnflag when 'A' then 'verified' when 'N' then 'other' else 'not_verified' end as verification_status, cast(l_quantity as bigint) * 2 as verification_score,
          case when l_linestatus = 'O' and l_linenumber = 7 then 'manual_import' else 'unknown' end as deliverability_status, l_linenumber = 1 as is_primary, l_shipdate as created_at,
          case when l_suppkey % 9 = 0 then null else l_shipdate end as last_checked_at
        from lineitem""",
    "evidence": f"""
        select l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || cast(floor(l_extendedprice) as bigint) as evidence_id, l_orderkey as lead_id, l_partkey as book_id,
          case l_linenumber % 4 when 0 then 'public_phone' when 1 then 'public_email' when 2 then 'representation_email' else 'location' end as field_name,
          case when l_linenumber % 4 = 0 then '+1212' || lpad('' || (2000000 + l_orderkey % 9973), 7, '0') when l_linenumber % 4 = 3 then 'Boston, USA'
            else 'a' || (l_orderkey % 997) || '@s' || ((l_orderkey + l_suppkey % 2) % 11) || '.example.test' end as field_value,
          case l_suppkey % 4 when 0 then '' when 1 then 'https://www.goodreads.com/a/' || l_suppkey when 2 then 'https://www.s' || (l_orderkey % 11) || '.example.test/contact' else 'http://' || lower({LAST.format("l_suppkey")}) || '.example.test/p/' || l_partkey end as source_url,
          case l_linenumber % 5 when 0 then 'contact_page' when 1 then 'official_author_site' when 2 then 'social_profile' when 3 then 'web_search_result' else 'manual' end as evidence_type,
          {NAME.format("l_suppkey")} || ' books' as source_title, 'write to the author' as source_snippet, round(1 - l_discount * 6, 2) as confidence, l_shipdate as created_at
        from lineitem""",
    "assignments": """
        select o_orderkey as assignment_id, o_orderkey as lead_id, o_custkey % 40 as owner_id, o_orderkey % 2 = 0 as is_current, o_orderdate as assigned_at,
          case o_orderpriority when '1-URGENT' then 'completed' when '2-HIGH' then 'converted' when '3-MEDIUM' then 'in_progress' when '5-LOW' then 'invalid' else 'assigned' end as status
        from orders where o_orderkey % 5 <> 0""",
    "users": "select s_suppkey as user_id, s_suppkey % 3 <> 0 as is_active from supplier",
    "runs": "select n_nationkey as run_id, case n_nationkey % 5 when 0 then 'pending' when 1 then 'running' when 2 then 'failed' when 3 then 'canceled' else 'completed' end as status, 'Kids ' || n_name as keyword, 'provider' || n_regionkey as source_provider from nation",
    "videos": """
        select l_orderkey as lead_id, l_linenumber % 2 = 0 as is_book_trailer, l_suppkey % 3 = 0 as is_animated_video, l_partkey % 2 = 0 as is_read_aloud, round(1 - l_discount * 7, 2) as classification_confidence
        from lineitem""",
    "schedules": "select s_suppkey as schedule_id, s_suppkey % 3 <> 0 as is_active, s_suppkey % 9 as daily_lead_count, case when s_suppkey % 4 = 0 then null else date '2024-01-01' + cast(s_suppkey % 60 as int) end as next_day from supplier",
    "profiles": "select l_orderkey as lead_id, case when l_tax > 0.05 then null else cast(l_quantity as bigint) * l_partkey end as follower_count from lineitem",
    "senders": "select s_suppkey as sender_id, cast(s_suppkey % 6 as int) as daily_limit, cast(s_suppkey % 4 as int) as sent_today, case when s_suppkey % 5 = 0 then null else date '2024-01-01' + cast(s_suppkey % 30 as int) end as last_day, s_suppkey % 7 <> 0 as is_active from supplier",
    "results": f"""
        select event_id, user_id as log_id, 'https://' || case value > 50 when true then 'www.' else '' end || 'site' || (event_id % 40) || '.example.test/p/' || (event_id % 13) as url,
          {NAME.format("event_id")} || ' on ' || event_type as title, event_type as classification, cast(event_id % 3 as int) as provider, ts from events""",
}

BASE = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A general table, or one derived from it."""
    if name in SQL:
        source = SQL[name].rsplit("from ", 1)[1].split()[0]
        return spark.sql(SQL[name].replace(f"from {source}", f"from {{{source}}}"), **{source: table(spark, sf_dir, source)})
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_sql(*names: str) -> str:
    """The same derived tables as a WITH clause."""
    return "with " + ",\n".join(f"{n} as ({SQL[n]})" for n in names)
