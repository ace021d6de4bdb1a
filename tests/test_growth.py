"""What keeps the work of a row, and what is dealt, from growing: by plans, and by plain loops over the rules that were rewritten for it."""

import os
import re

from pyspark.sql import functions as F

from leadloom.plans import QUERIES
from leadloom.plans.registry import Tables

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_contacts_of_a_text_are_searched_once(spark):
    """matches and gaps stood five times in the plan. Contexts are as plain loops have them, with a mark in the text too."""
    from leadloom.functions import contacts

    assert plan_of(QUERIES["page_contact_record"](spark, SF)).count(contacts.EMAIL) <= 3
    texts = ["", "no one", "a@b.test", "x\x01y a@b.test \x01 B@c.test, a@b.test.", "call 212-200-1234; isbn 212-200-1235", "+44 20 7946 0958 a@b.test\n(212) 200 1234\x01"]
    df = spark.createDataFrame([(x,) for x in texts], "v string")
    for pattern in (contacts.EMAIL, contacts.PHONE):
        for row in df.select("v", contacts._with_context(F.col("v"), pattern, 5).alias("x")).collect():
            found, gaps = [m[0] for m in re.finditer(pattern, row["v"], re.ASCII)], [g for g in re.split(re.sub(r"\((?![?])", "(?:", pattern.replace(r"\(", "\x02")).replace("\x02", r"\("), row["v"], flags=re.ASCII)]
            want = [(r, b[-5:], a[:5]) for r, b, a in zip(found, gaps, gaps[1:], strict=False)]
            assert [tuple(x) for x in row["x"]] == want, row
    got = [r[0] for r in df.select(contacts.extract_phones("v", require_context=False)).collect()]
    assert got == [[], [], [], [], ["+12122001234"], ["+442079460958", "+12122001234"]]
    assert [r[0] for r in df.select(contacts.extract_emails("v")).collect()] == [[], [], ["a@b.test"], ["a@b.test", "b@c.test"], [], ["a@b.test"]]


def test_listings_are_parsed_above_a_deal(spark):
    """two small files left the parsing to two tasks."""
    from leadloom.functions.text import STRONG_BY

    plan = plan_of(QUERIES["parse_listing_candidate"](spark, SF))
    assert STRONG_BY in plan and plan.rindex(STRONG_BY) < plan.index("Repartition")


def test_recovery_guesses_a_name_once(spark):
    """the guess stood in the plan wherever a filter read it, 14 times, each within the join's condition."""
    from leadloom.functions.text import STRONG_BY
    from leadloom.operators import discovery

    assert plan_of(QUERIES["recover_missing_author"](spark, SF)).count(STRONG_BY) <= 4
    books = spark.createDataFrame([(1, "", "The Blue Kite", "", 0.5), (2, "Kim Vale", "Red Hat Tales", "", 0.5), (3, None, "Green Boat Journey", "", None)], "book_id int, author_name string, title string, asin string, book_data_confidence double")
    rows = [(1, 1, "Other things by Robin Rowan", "", "u"), (1, 3, "Blue Kite by Casey Quill", "", "u"), (1, 2, "The Blue Kite by Drew Maple", "", "u"), (2, 1, "Red Hat Tales by Drew Maple", "", "u"), (3, 1, "Green Boat Journey", None, None)]
    results = spark.createDataFrame(rows, "book_id int, ord int, title string, snippet string, url string")
    got = {r["book_id"]: (r["author_name"], r["confidence"], r["recovered"]) for r in discovery.recover_missing_author(books, results).collect()}
    assert got == {1: ("Drew Maple", 0.72, True), 2: ("Kim Vale", 0.5, False), 3: ("", None, False)}


def test_snippets_are_judged_once(spark):
    """mails and phones judged every source for themselves, and tokens and texts were written out again in each filter."""
    from leadloom.operators import discovery

    plan = plan_of(QUERIES["snippet_contacts"](spark, SF))
    assert plan.count("translate(") <= 10 and plan.count("Generate") == 1 and plan.count("Repartition") == 1
    rows = [
        (1, "author_site", "Kim Vale, author", "Write to kim@kimvale.test or call 212-200-1234", "https://kimvale.test/contact", "Kim Vale", "Kites"),
        (2, "instagram", "Kim Vale", "kim.vale@gmail.com, phone 212 200 1234", "https://instagram.com/kimvale", "Kim Vale", "Kites"),
        (3, "other", "Contact", "kimvale@kv.test, call 212-200-1234", "https://x.test/", "Kim Vale", "Kites"),
        (4, "other", "Nothing", "kimvale@kv.test", "https://x.test/", "Kim Vale", "Kites"),
        (5, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "result_id int, kind string, title string, snippet string, url string, author_name string, book_title string")
    got = sorted((r["result_id"], r["field"], r["value"], r["evidence_type"], r["confidence"]) for r in discovery.snippet_contacts(df).collect())
    assert got == [
        (1, "public_email", "kim@kimvale.test", "contact_page", 0.72), (1, "public_phone", "+12122001234", "contact_page", 0.68),
        (2, "public_phone", "+12122001234", "social_profile", 0.62),
        (3, "public_email", "kimvale@kv.test", "web_search_result", 0.52),
    ]


def test_directory_pages_are_dealt_and_read_in_slices(spark):
    """a table was made for every page, in as many tasks as the small pages' bytes asked for."""
    import pyarrow as pa

    from leadloom.sources import directory

    assert plan_of(QUERIES["directory_details"](spark, SF)).count("Repartition") == 2
    n = 2 * directory.SLICE + 1
    html = [None, "", *('<li><a href="/p/1">T</a><img src="/i.png"><b>by me</b></li>' for _ in range(n - 2))]
    batch = pa.RecordBatch.from_pydict({"page_id": list(range(n)), "url": [None, *["https://a.test/"] * (n - 1)], "html": pa.array(html, pa.string())})
    out = list(directory.by_slices(directory.cards_of, directory.CARDS_ARROW)(iter([batch])))
    assert [b.num_rows for b in out] == [directory.SLICE - 2, directory.SLICE, 1]
    assert out[2].to_pylist() == [{"page_id": n - 1, "page_url": "https://a.test/", "pos": 0, "href": "https://a.test/p/1", "anchor": "T", "lines": ["T", "by me"], "image": "https://a.test/i.png"}]
    empty = list(directory.by_slices(directory.cards_of, directory.CARDS_ARROW)(iter([batch.slice(0, 2)])))
    assert [b.num_rows for b in empty] == [0]


def test_best_evidence_folds_a_text_once(spark):
    """the join's condition folded the evidence's texts for every token of a name; sources that can't count were joined and folded too."""
    plan = plan_of(QUERIES["export_validated"](spark, SF))
    joins = [line for line in plan.split("\n") if "Join Inner" in line]
    assert joins and not any("translate(" in line for line in joins)
    assert plan.count("translate(") <= 12


def test_sanitizing_judges_only_the_flags_it_reads(spark):
    """F16: the trust of every source was judged for flags that nothing read; hosts of profiles were read again by each warning, count and column."""
    from leadloom.operators import filters
    from leadloom.plans import queries_tables, queries_text

    flagged = queries_tables.source_flags(Tables(spark, SF), "s")
    assert not [c for c in flagged.columns if c.startswith("v_")] and "s_public_email" in flagged.columns
    rows = flagged.withColumn("contact_page_url", F.expr(queries_text.PROFILE_PAGE))
    plan = plan_of(filters.sanitize_contacts(rows, queries_tables.flags("s")).select("warnings", "n_urls", "cleared", "contact_page_url"))
    assert plan.count("try_parse_url") + plan.count("parse_url") <= 4 or plan.count("goodreads\\.") <= 4


def test_cleared_profiles_need_no_trust(spark):
    """profiles are cleared by the flags of any source; their plan judged trusted ones as well."""
    from leadloom.plans import queries_tables

    plan = lambda kinds: plan_of(queries_tables.source_flags(Tables(spark, SF), kinds))
    assert "translate(" in plan("v") and "translate(" not in plan("s")


def test_components_of_keys_have_no_edge_for_a_row(spark, monkeypatch):
    """each row was a node, so that the rows of a common key met in one task's join; now keys are, and rows of one key make no edge."""
    from leadloom.operators import dedupe

    seen, solve = [], dedupe.components
    monkeypatch.setattr(dedupe, "components", lambda edges: (seen.append(edges.where("a <> b").distinct().count()), solve(edges))[1])
    rows = [(i, ["hot", "p1" if i % 2 else "p2", f"own{i}" if i < 5 else ""]) for i in range(2000)] + [(2000 + i, [f"c{i}", f"c{i + 1}"]) for i in range(50)]
    df = spark.createDataFrame(rows, "id int, k array<string>")
    got = {r["id"] for r in dedupe.dedupe_any_key(df, F.col("k"), F.col("id")).select("id").collect()}
    used, want = set(), set()
    for i, k in rows:
        k = {x for x in k if x}
        if not used & k:
            want.add(i)
            used |= k
    assert got == want and len(seen) == 1 and seen[0] < 60


def test_children_are_dealt_as_rows(spark):
    """children were gathered, sorted and spilled once before they were dealt, and once after. A lead's arrays are whole."""
    from leadloom.operators import match

    leads = spark.createDataFrame([(1,), (2,), (None,)], "lead_id int")
    kids = spark.createDataFrame([(1, i % 7, "x" * i) for i in range(300)] + [(None, 1, "y")], "lead_id int, a int, b string")
    df = match.lead_nested(leads, kids=kids)
    plan = df._jdf.queryExecution().executedPlan().toString()
    deal, gather = plan.index("REPARTITION_BY_COL"), plan.rindex("partial_collect_list")
    assert gather < deal
    rows = {r["lead_id"]: r["kids"] for r in df.collect()}
    assert [tuple(x) for x in rows[1]] == sorted((i % 7, "x" * i) for i in range(300)) and rows[2] is None and rows[None] is None


def test_site_pages_are_read_above_a_deal(spark):
    """one or two small files left the reading of pages to as many tasks; names stood three times in the plan."""
    from leadloom.functions import contacts

    plan = plan_of(QUERIES["site_lead_rows"](spark, SF))
    assert plan.index(contacts.EMAIL) < plan.index("Repartition") and plan.count("welcome to") <= 10


def test_profiles_are_cleared_without_scores(spark):
    """clearing profiles scored every lead, wrote all of them as files and judged contacts that no profile has."""
    from leadloom.operators import filters

    kept = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    folder = kept.removeprefix("file://").removeprefix("file:")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    plan = plan_of(QUERIES["sanitize_profiles"](spark, SF))
    assert (set(os.listdir(folder)) if os.path.isdir(folder) else set()) == before
    assert "representation_email#" in plan and not [c for c in ("public_email#", "public_phone#", "lead_score#", " title#") if c in plan]

    shop, own = "https://www.goodreads.com/a/1", "https://kim.test/"
    leads = [
        (1, 1, "a@b.test", "g@b.test", "", "1", own, shop, True), (2, 1, "a@b.test", "", "p@b.test", "1", own, own, False), (3, 2, "a@b.test", "g@b.test", "p@b.test", "1", own, None, True),
        (4, None, "", "g@b.test", "", "", shop, shop, False), (5, 3, "a@b.test", None, "", "1", shop, "", None), (6, 4, "a@b.test", "g@b.test", "p@b.test", "", own, own, None), (7, 5, "a@b.test", "", "", "1", own, own, False),
    ]
    fields = ["public_email", "representation_email", "publicist_email", "public_phone"]
    df = spark.createDataFrame(leads, f"lead_id int, author_id int, {', '.join(f'{c} string' for c in fields)}, canonical_website string, contact_page_url string, ok boolean")
    verified = {c: F.col("ok") for c in fields}
    want = {}
    for row in leads:
        values = dict(zip(fields + ["canonical_website", "contact_page_url"], row[2:8], strict=True))
        gone = {c for c in ("representation_email", "publicist_email") if values[c] and row[8] is False} | {c for c in ("canonical_website", "contact_page_url") if values[c] == shop}
        if row[1] is not None and gone:
            want[row[1]] = want.get(row[1], set()) | gone
    assert want and {r["author_id"]: set(r["cleared"]) for r in filters.profiles_to_clear(df, verified).collect()} == want
    staged = filters.sanitize_contacts(df, verified).where("author_id is not null").select("author_id", F.explode("cleared").alias("c")).where(~F.col("c").isin("public_email", "public_phone")).distinct().collect()
    assert {(r["author_id"], r["c"]) for r in staged} == {(k, c) for k, v in want.items() for c in v}
