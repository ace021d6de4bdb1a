"""Set-based operators against plain loops, and unit cases of the rules."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from leadloom.functions import coerce, contacts, ids, scores, text, trust, urls
from leadloom.operators import aggregates, allocate, dedupe, evidence, exports, filters, match, state
from leadloom.sources import catalogs, files, pages
from leadloom.streaming import ingest


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def ask(spark, f, *values):
    return one(spark, f(*(F.lit(v) for v in values)))


# ---- loops ----
@pytest.mark.parametrize("seed", range(4))
def test_any_key(spark, seed):
    r = random.Random(seed)
    rows = [(i, [r.choice(["", *"abcdefghij"]) for _ in range(r.randint(0, 3))]) for i in range(60)]
    used, want = set(), []
    for i, keys in rows:
        own = {k for k in keys if k}
        if not own & used:
            want.append(i)
            used |= own
    df = spark.createDataFrame(rows, "id long, keys array<string>")
    assert sorted(x.id for x in dedupe.dedupe_any_key(df, F.col("keys"), F.col("id")).collect()) == want


def test_any_key_long_chain(spark):
    """Each row shares a key with the next, so that every round decides a row or two; there is no bound on rounds."""
    df = spark.createDataFrame([(i, [f"k{i}", f"k{i + 1}"]) for i in range(110)], "id long, keys array<string>").coalesce(1)
    assert sorted(x.id for x in dedupe.dedupe_any_key(df, F.col("keys"), F.col("id")).collect()) == list(range(0, 110, 2))


@pytest.mark.parametrize("most", [1, 5, 1000])
def test_any_key_in_blocks(spark, most):
    """Components above the bound are decided by rounds and blocks, to the loop's result."""
    r = random.Random(most)
    rows = [(i, [f"k{i}", f"k{i + 1}"]) for i in range(20)] + [(100 + i, [r.choice("abcdefghijklm") for _ in range(r.randint(0, 3))]) for i in range(20)]
    r.shuffle(rows)
    used, want = set(), []
    for i, keys in sorted(rows):
        if not used & set(keys):
            want.append(i)
            used |= set(keys)
    df = spark.createDataFrame(rows, "id long, keys array<string>")
    assert sorted(x.id for x in dedupe.dedupe_any_key(df, F.col("keys"), F.col("id"), most).collect()) == want


def test_any_key_chain_of_100000_rows(spark):
    """Jobs don't grow with the chain: the component is found in about log n rounds and solved in one pass."""
    n = 100_000
    df = spark.range(n).select("id", F.array(F.concat(F.lit("k"), F.col("id")), F.concat(F.lit("k"), F.col("id") + 1)).alias("keys"))
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup("any-key"))
    spark.sparkContext.setJobGroup("any-key", "chain")
    got = dedupe.dedupe_any_key(df, F.col("keys"), F.col("id"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got.agg(F.count(F.lit(1)), F.sum(F.col("id") % 2)).first() == (n // 2, 0) and 0 < jobs() < 400


def test_waterfall_of_500_schedules(spark):
    """Equal to the loop over schedules, in as many jobs as for three."""
    r = random.Random(2)
    leads = [(i, r.randrange(101), r.randrange(101), r.randrange(50), r.choice(["", "a@b.test"]), r.choice(["", "+1"]), r.random() < 0.5, r.choice([None, False, False, True])) for i in range(3000)]
    names = "lead_id long, verification_score int, lead_score int, created_at int, public_email string, public_phone string, verified_ready boolean, do_not_contact boolean"
    df = spark.createDataFrame(leads, names).withColumns({"representation_email": F.lit(""), "publicist_email": F.lit("")})
    taken = spark.createDataFrame([(i, i % 2 == 0) for i in range(0, 3000, 7)], "lead_id long, is_current boolean")
    needs = {"any": lambda e, p, v: True, "email_only": lambda e, p, v: e, "phone_only": lambda e, p, v: p, "email_and_phone": lambda e, p, v: e and p, "verified_contact": lambda e, p, v: v}
    schedules = [{"schedule_id": 1000 + i, "k": r.randrange(9), "minimum": r.choice([0, 20, 55, 90]), "requirement": r.choice(list(needs)), "verified_only": r.random() < 0.3} for i in range(500)]
    rest = sorted((x for x in leads if x[0] % 14 and not x[7]), key=lambda x: (-x[1], -x[2], x[3], x[0]))
    want = {}
    for s in schedules:
        own = [x for x in rest if x[0] not in want and x[2] >= s["minimum"] and (x[6] or not s["verified_only"]) and needs[s["requirement"]](bool(x[4]), bool(x[5]), x[6])]
        want |= {x[0]: s["schedule_id"] for x in own[: s["k"]]}
    jobs = []
    for part in (schedules[:3], schedules):
        spark.sparkContext.setJobGroup(f"waterfall-{len(part)}", "x")
        got = {x.lead_id: x.schedule_id for x in allocate.waterfall(df, taken, part).collect()}
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"waterfall-{len(part)}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == want and jobs[1] <= jobs[0] + 2
    assert allocate.waterfall(df.limit(0), taken, schedules).count() == 0 == allocate.waterfall(df.where("lead_score > 100"), taken, schedules).count()


def test_value_in_evidence_of_a_hot_lead(spark):
    """One lead has 100,000 evidence rows: they are dealt over many shards, and every value is found that a plain search finds."""
    r = random.Random(4)
    word = lambda: r.choice(["mail", "Anna@Site.test", "call", "(212) 555-01", "77 and 212 555 0177", "+1 212", "x@y", "é"])
    hot = [(1, word(), f"{word()} {i}", i) for i in range(99_990)] + [(1, "Write to Rare@Place.test", None, 0), (1, None, "0044 (20) 7946-0958 x", 0)]
    few = [(2, "only 555-1234 here", "", 0), (3, "", "", 0), (None, "anna", "", 0)]
    values = [(i, v, "k") for i in (1, 2, 3, 4, None) for v in ("anna@site", "RARE@place.test", "+44 20 7946 0958", "204479", "2125550177", "555-12", "5551234", "", None, "nowhere", "nowhere", "x@y", "Y@X", "É")]
    df = spark.createDataFrame(values, "lead_id long, value string, _text string")
    ev = spark.createDataFrame(hot + few, "lead_id long, field_value string, source_snippet string, shards int").repartition(4)
    digits = lambda t: "".join(c for c in t if c.isdigit())
    texts = {}
    for i, a, b, _ in hot + few:
        texts.setdefault(i, set()).add(" ".join([a or "", b or ""]).strip().lower() if not (a and b) else f"{a} {b}".lower())
    has = lambda i, v: i is not None and any(v in t or (len(digits(v)) >= 7 and digits(v) in digits(t)) for t in texts.get(i, ()))
    want = sorted(((i, v) for i, v, _ in values if has(i, (v or "").lower())), key=str)
    for more in ({}, {"shard_rows": 700, "shard_values": 3}):
        got = match.value_in_evidence(df, ev, **more)
        assert got.columns == df.columns and sorted(((x.lead_id, x.value) for x in got.collect()), key=str) == want


def test_a_far_page_reads_one_part(spark, tmp_path):
    df = spark.range(250_000).withColumn("k", F.pmod(F.xxhash64("id"), F.lit(1000)))
    paged = allocate.PagedTable(spark, f"file://{tmp_path}/t", 1_000).write(df, [F.desc("k"), F.col("id")])
    want = [x.id for x in df.orderBy(F.desc("k"), "id").offset(9_999 * 25).limit(25).collect()]
    page = paged.page(10_000, 25)
    assert [x.id for x in page.collect()] == want and page.columns == df.columns and len(page.inputFiles()) == 1
    assert len(paged.page(41, 25).inputFiles()) == 1 and len(paged.page(11, 100).collect()) == 100
    assert [x.id for x in paged.page(10**6, 25).collect()] == want and paged.page(-3, 7).count() == 25
    assert allocate.PagedTable(spark, f"file://{tmp_path}/e").write(df.limit(0), [F.col("id")]).page(1, 25).count() == 0


def test_numbering_plans(spark):
    for raw, region, want in [
        ("020 7946 0958", "GB", (True, "+442079460958", "landline", "GB")), ("+44 7700 900123", "US", (True, "+447700900123", "mobile", "GB")), ("06 12 34 56 78", "FR", (True, "+33612345678", "mobile", "FR")),
        ("0800 1111", "GB", (True, "+448001111", "toll_free", "GB")), ("0909 8790123", "GB", (False, "+449098790123", "premium_rate", "GB")), ("0171 2345678", "DE", (True, "+491712345678", "mobile", "DE")), ("91 123 45 67", "ES", (True, "+34911234567", "landline", "ES")), ("91 123 45", "ES", (False, "", "unknown", "")),
        ("(212) 555-0123 x9", "US", (True, "+12125550123", "landline", "US")), ("112", "US", (False, "", "unknown", "")), ("no number", "US", (False, "", "unknown", "")), ("", "GB", (False, "", "unknown", "")), (None, "GB", (False, "", "unknown", "")),
    ]:
        got = one(spark, contacts.by_plan(F.lit(raw).cast("string"), region))
        assert (bool(got.valid), got.e164, got.line_type, got.region) == want, raw


def test_review_status_blocks_the_export(spark):
    row = {"lead_id": 1, "author_name": "Alex Maple", "title": "A", "asin": "", "amazon_book_url": "https://x.example/dp/B000000001", "public_email": "a@b.org", "public_phone": "", "do_not_contact": False, "verification_status": "verified", "verification_score": 5, "created_at": 1}
    rows = [row | {"manual_review_status": ""}, row | {"lead_id": 2, "manual_review_status": "do_not_contact", "verification_score": 9}, row | {"lead_id": 3, "manual_review_status": "", "verification_score": 7}]
    star = spark.createDataFrame(rows)
    best = spark.createDataFrame([(i, "public_email", "a@b.org", "https://s.example", 0.9) for i in (1, 2, 3)], "lead_id long, field_name string, field_value string, source_url string, confidence double")
    assert [r.lead_id for r in exports.validated(star, best).collect()] == [3]


@pytest.mark.parametrize("seed", range(3))
def test_two_namespaces(spark, seed):
    r = random.Random(seed)
    rows = [(i, r.choice(["", "", "A", "b", "C"]), r.choice(["x", "y", "z", "w"])) for i in range(25)]
    codes, titles, want = set(), set(), []
    for i, c, t in rows:
        if (c and c.upper() in codes) or (not c and t in titles):
            continue
        if c:
            codes.add(c.upper())
        titles.add(t)
        want.append(i)
    df = spark.createDataFrame(rows, "id long, c string, t string")
    assert sorted(x.id for x in dedupe.dedupe_two_namespaces(df, F.col("c"), F.col("t"), F.col("id")).collect()) == want


@pytest.mark.parametrize("seed", range(3))
def test_capacity(spark, seed):
    r = random.Random(seed)
    day = datetime.datetime(2024, 1, 1)
    senders = [(i, r.randint(0, 4), r.randint(0, 3), None if r.random() < 0.3 else day + datetime.timedelta(days=r.randint(0, 9)), r.random() < 0.8) for i in range(6)]
    due = list(range(15))
    state_of = {i: [limit, sent, last, on] for i, limit, sent, last, on in senders}
    now, want = day + datetime.timedelta(days=99), {}
    for d in due:
        free = [(s[2] is not None, s[2] or day, s[1], i) for i, s in state_of.items() if s[3] and s[1] < s[0]]
        if free:
            i = min(free)[-1]
            want[d] = i
            state_of[i][1] += 1
            state_of[i][2] = now
        else:
            want[d] = None
    got = allocate.capacity_slots(spark.createDataFrame([(d,) for d in due], "d long"), spark.createDataFrame(senders, "sender_id long, daily_limit int, sent_today int, last_sent_at timestamp, is_active boolean"), [F.col("d")])
    assert {x.d: x.sender_id for x in got.collect()} == want


def test_until_target_and_quota(spark):
    r = random.Random(1)
    rows = [(i, r.random() < 0.3, f"c{r.randint(0, 12)}", r.random() < 0.5, r.randint(0, 2)) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, hit boolean, code string, web boolean, src int")
    hits, want = 0, []
    for i, hit, *_ in rows:
        if hits >= 7:
            break
        want.append(i)
        hits += hit
    assert sorted(x.id for x in dedupe.until_target(df, [F.col("id")], F.col("hit"), 7).collect()) == want
    picked = dedupe.source_quota(df, F.col("code"), F.col("web"), F.col("src"), [F.col("id")], 10).collect()
    assert len({x.code for x in picked}) == len(picked) <= 10 and sum(x.web for x in picked) <= 6


def test_interleave(spark):
    rows = [("g", c, i, q) for i, (c, q) in enumerate([("a", "q1"), ("a", "q2"), ("b", "q1"), ("c", "q4"), ("a", "q5"), ("b", "q6")])]
    got = dedupe.interleave(spark.createDataFrame(rows, "g string, c string, o long, q string"), ["g"], F.col("c"), F.col("o"), "q", 5).orderBy("pick").collect()
    assert [x.q for x in got] == ["q1", "q4", "q2", "q6"]  # picks q1 q1 q4 q2 q6, then distinct


# ---- rules ----
def test_text(spark):
    a = lambda f, *v: ask(spark, f, *v)
    assert a(text.normalize_text, "  Ünïcode – ﬁne ½ Straße!! ") == "unicode fine 12 strae"
    assert a(text.normalize_text, None) == ""
    assert a(text.book_key, "The Cat's Hat", "Dr. Doe", "b0abc") == "asin:B0ABC" and a(text.book_key, "The Cat's Hat", "Dr. Doe", "") == "the cat s hat::dr doe"
    assert a(text.clean_listing_title, "My Book (Large Paperback) - Amazon.com: x") == "My Book"
    assert a(text.clean_person_name, "Visit Amazon's Jane Q. Doe Page") == "Jane Q. Doe" and a(text.clean_person_name, "Jane Doe Paperback 2020") == "Jane Doe"
    assert [a(text.valid_person_name, n) for n in ("Jane Doe", "Jane", "Doe Books", "12 34")] == [True, False, False, False]
    assert a(text.corporate_author, "The Editors of Foo") and a(text.corporate_author, "Acme Publishing LLC") and not a(text.corporate_author, "Jane Doe")
    assert a(text.authors_from_colon_title, "Brave Day: Ludwig, Trudy, Barton, Patrice: 9780593306376") == ["Trudy Ludwig", "Patrice Barton"]
    g = a(text.guess_title_author, "Night Owl by Jane Doe - Amazon.com", "")
    assert (g.title, g.author, g.confidence) == ("Night Owl", "Jane Doe", 0.6)
    assert a(text.guess_title_author, "Night Owl", "by Jane Doe (Author)").confidence == 0.8
    assert a(text.title_anchor, "The Very Long Tale of a Small and Brave Mouse") == "Very Long Tale Small" and a(text.title_anchor, "Short One") == "Short One"
    assert a(text.keyword_slug, "  Kids'  Books ") == "kids-books" and len(a(text.keyword_slug, "word " * 40)) == 80
    assert a(text.humanize_slug, "https://x.test/p/my-book-title-123/") == "My Book Title"


def test_urls(spark):
    a = lambda f, *v: ask(spark, f, *v)
    assert a(urls.marketplace_host, "https://smile.amazon.co.uk/dp/B000000001") == "amazon.co.uk" and a(urls.marketplace_host, "https://amazon.com.evil.test/dp/B000000001") is None
    assert a(urls.canonical_listing_url, "http://www.amazon.com/gp/product/b00abcdefg?x=1", "t-1") == "https://www.amazon.com/dp/B00ABCDEFG?tag=t-1"
    assert a(urls.verified_listing_url, "https://amazon.com/dp/B00ABCDEFG", "b00abcdefg") and not a(urls.verified_listing_url, "https://amazon.com/dp/B00ABCDEFG", "B000000001")
    assert a(urls.registered_domain_of_url, "https://a.b.example.co.uk/x") == "example.co.uk" and a(urls.host, "http://a b.test/x") == "a b.test"
    assert a(urls.blocked_mail, "x@sub.goodreads.com") and a(urls.blocked_mail, "") and not a(urls.blocked_mail, "x@jane.test")
    assert a(urls.domains_align, "me@mail.jane.test", "https://www.jane.test/c") and not a(urls.domains_align, "me@other.test", "https://jane.test")
    assert a(urls.url_key, "HTTPS://X.test/a/?q#f") == "x.test/a" and a(urls.url_handle, "https://x.test/@Jane/") == "jane"
    assert not a(urls.public_url, "http://localhost/x") and not a(urls.public_url, "https://x.test/admin/") and a(urls.public_url, "https://x.test/a")
    assert a(urls.classify_url, "https://instagram.com/x").kind == "instagram" and a(urls.classify_url, "https://foopress.test").kind == "author_site"
    assert len(a(urls.candidate_pages, "https://x.test/a")) == 20


def test_ids(spark):
    a = lambda v: ask(spark, ids.analyze_identifier, v)
    x = a("978-0-306-40615-7")
    assert (x.type, x.valid, x.isbn10, x.isbn13) == ("isbn13", True, "0306406152", "9780306406157")
    assert a("0-8044-2957-X").isbn13 == "9780804429573" and not a("9780306406158").valid and a("9791034304455").isbn10 == ""
    assert a("https://www.amazon.com/dp/B00ABCDEFG").type == "asin" and a("nonsense").type == "unknown"
    assert ask(spark, ids.canonical_book_key, "0306406152") == ask(spark, ids.canonical_book_key, "9780306406157")
    assert ask(spark, ids.listing_identity, "0306406152").amazon_asin == "0306406152"
    assert one(spark, ids.best_isbn(F.array(F.lit("x"), F.lit("0306406152"), F.lit("9780306406157")))) == "9780306406157"


def test_coerce(spark):
    a = lambda f, *v: ask(spark, f, *v)
    assert [a(coerce.int_or_null, v) for v in ("1,234", "1.234", "4.5", "", "x", "-2.7")] == [1234, 1234, 4, None, None, -2]
    assert [str(a(coerce.decimal_or_null, v)) for v in ("4.125", "5.01", "x")] == ["4.13", "None", "None"]
    assert [a(coerce.status_value, v) for v in ("Verified", "needs proof - verified", "A - good", "invalid", "")] == ["verified", "other", "verified", "not_verified", "other"]
    assert [a(coerce.clean_pub_date, v) for v in ("2025.0", "2024-05-01 00:00:00", "March 3, 2021", "2020/7", "c. 1999", "x")] == ["2025", "2024-05-01", "2021-03-03", "2020-07", "1999", ""]
    assert a(coerce.follower_count, "about 12.3K followers, 1,200 subscribers") == 12300
    assert a(coerce.clamp_confidence, "High") == 0.85 and a(coerce.clamp_confidence, "7") == 1.0 and a(coerce.clamp_confidence, "bad") == 0.0
    assert a(coerce.children_flags, "no").is_childrens is False and a(coerce.children_flags, "picture book").is_picture is True and a(coerce.children_flags, "").is_picture is None


def test_contacts(spark):
    a = lambda f, *v: ask(spark, f, *v)
    assert a(contacts.extract_emails, "Mail Jane@Jane.test, or jane@jane.test; x@goodreads.com") == ["jane@jane.test"]
    assert a(contacts.extract_emails, "var x = 'a@b.test'") == []
    assert a(contacts.extract_phones, "call (212) 555-7788; ISBN 9780306406157") == ["+12125557788"] and a(contacts.extract_phones, "212-555-7788") == []
    assert a(contacts.deobfuscate_email, "matt [at] site (dot) test") == "matt@site.test" and one(spark, contacts.deobfuscate_email(F.lit("matt@x.test"), guarded=False)) == "m@t@x.test"
    assert a(contacts.obfuscated_emails, "write jane.doe [at] site [dot] test or contact me at x.test") == ["jane.doe@site.test"]
    d = a(contacts.phone_details, "+1 212 555 0123")
    assert d.is_fake and not d.valid and a(contacts.phone_details, "+1 800 234 5678").line_type == "toll_free"
    key = 0x42
    assert a(contacts.xor_decode, f"{key:02x}" + "".join(f"{ord(c) ^ key:02x}" for c in "a@b.test")) == "a@b.test" and a(contacts.xor_decode, "zz") == ""


def test_trust(spark):
    a = lambda f, *v, **k: one(spark, f(*(F.lit(x) for x in v), **k))
    assert a(trust.identity_appears, "Jane Doeson", "Owl Night", "https://janedoeson.test") and a(trust.identity_appears, "Jane Doeson", "", "by Doeson") and not a(trust.identity_strict, "Jane Doeson", "", "by Doeson")
    assert a(trust.named_in_text, "Jane O'Neil", "a talk by JANE-ONEIL") and a(trust.named_in_text, "Ann Maple", "Mr Maple") and not a(trust.named_in_text, "Jane Maple", "Mr Maple")
    assert not a(trust.named_in_text, "Al Bo", "al bo") and not a(trust.named_in_text, None, "x") and not a(trust.named_in_text, "Jane Doeson", None)
    assert a(trust.profile_named, "Al Bo", "", "@albo") and a(trust.profile_named, "Jane Maple", "Night Owls", "maple, night owls") and not a(trust.profile_named, "Jane Maple", "The Owl", "maple, the owl") and not a(trust.profile_named, None, "", "x")
    assert a(trust.site_owned, "Jane Maple", "https://www.maple-books.test", None) and not a(trust.site_owned, "Jane Mapl", "https://mapl.test", "") and a(trust.site_owned, "Jane Mapl", "https://x.test", "Jane Mapl: home")
    assert a(trust.site_owned, "Jane Mapl", "https://mapl.test", "", "I am Jane") and not a(trust.site_owned, "Jane Maple", "https://maple.test", "", "I am Ann") and not a(trust.site_owned, "Jane Mapl", None, None, "y " * 2500 + "Jane Mapl")
    ok = lambda field, value, url, kind: a(trust.trusted_source, "Jane Doe", "Owl", field, value, url, kind)
    assert ok("public_email", "me@janedoe.test", "https://janedoe.test/c", "contact_page")
    assert not ok("public_email", "me@janedoe.test", "https://goodreads.com/janedoe", "contact_page")
    assert not ok("public_email", "support@janedoe.test", "https://janedoe.test/c", "contact_page") and not ok("public_email", "me@janedoe.test", "https://janedoe.test", "web_search_result")
    assert ok("public_phone", "+12125557788", "https://janedoe.test", "manual") and ok("public_phone", "1", "https://instagram.com/janedoe", "social_profile")


def test_scores(spark):
    def score(**values):
        base = {"is_childrens_book": True, "is_picture_or_illustrated_book": True, "rating": 4.0, "has_aplus_content": False, "public_email": "a@jane.test", "canonical_website": "https://jane.test", "video_status": "unclear", "identity_confidence": 0.9, "extraction_confidence": 0.9, "publication_date": "2026", "publisher": ""} | values
        return one(spark, scores.lead_score(scores.Row({k: F.lit(v) for k, v in base.items()}), 2026))

    s = score()
    assert (s.score, s.tier) == (20 + 20 + 25 + 20 + 10 + 8 + 4 - 7, "hot") or s.score == 100
    assert score(publisher="Penguin").tier == "rejected" and score(is_childrens_book=False).score == 0 and score(do_not_contact=True).needs == []
    low = score(identity_confidence=0.1, extraction_confidence=0.1, public_email="", canonical_website="")
    assert low.score == 20 + 20 + 25 + 10 - 15 - 20 and low.tier == "rejected"
    assert "Cover redesign" in s.needs and any(n.startswith("Pitch:") for n in s.needs)
    t = scores.render_template(F.lit("Hi {{author_name}}, {{book_title}}"), scores.Row({"author_name": F.lit(""), "title": F.lit("Owl")}))
    assert one(spark, t) == "Hi there, Owl"


def test_checks(spark):
    leads = spark.createDataFrame([(1, "me@janedoe.test", "", "", "", 0.9, "https://janedoe.test", ""), (2, "bad", "", "", "+12125550123", 0.9, "", "")], "lead_id long, public_email string, representation_email string, publicist_email string, public_phone string, identity_confidence double, canonical_website string, contact_page_url string")
    seen = spark.createDataFrame([("e1", 1, "public_email", "me@janedoe.test", "https://janedoe.test/c", "contact_page", "Jane Doe", "", 0.9)], "evidence_id string, lead_id long, field_name string, field_value string, source_url string, evidence_type string, source_title string, source_snippet string, confidence double")
    people = spark.createDataFrame([(1, "Jane Doe", "Owl"), (2, "Joe Bloggs", "Cat")], "lead_id long, author_name string, title string")
    trusted = evidence.with_trust(seen, people)
    got = {x.normalized_value: x for x in evidence.candidate_checks(evidence.candidate_inputs(leads, seen), trusted, leads, match.author_domains(leads, trusted)).collect()}
    assert (got["me@janedoe.test"].status, got["me@janedoe.test"].score) == ("verified", 95)
    assert got["bad"].status == "not_verified" and got["+12125550123"].status == "not_verified"
    assert len(got["bad"].checks) == 9 and len(got["+12125550123"].checks) == 6


def test_pages(spark):
    coded = "42" + "".join(f"{ord(c) ^ 0x42:02x}" for c in "xor@jane.test")
    html = f"""<html><head><title>Jane Doe</title><meta name="description" content="d"></head><body><script>var a='no@no.test'</script><h1>Jane Doe, Author</h1>
      <a href="mailto:mail@jane.test?x=1">m</a><a href="tel:+12125557788">t</a><a data-cfemail="{coded}">c</a><a href="/contact-me">Contact</a><a href="/a.pdf">f</a><a href="https://instagram.com/jane">i</a>
      <form action="/contact"><input name="email"><textarea name="message"></textarea></form><form action="/search"><input name="q"></form>write to me: jane [at] jane [dot] test</body></html>"""
    parsed = pages.parse_pages(spark.createDataFrame([(1, "https://jane.test/home", html), (2, "x", None)], "page_id long, url string, html string"))
    facts = {x.page_id: x for x in pages.page_facts(parsed).collect()}
    assert facts[1].title == "Jane Doe" and "var a" not in facts[1].page_text and facts[1].description == "d"
    assert {x.value for x in pages.hidden_contacts(parsed).collect()} >= {"mail@jane.test", "xor@jane.test", "jane@jane.test", "+12125557788"}
    assert [x.action for x in pages.contact_forms(parsed).collect()] == ["https://jane.test/contact"]
    links = pages.page_links(parsed)
    assert pages.contact_links(links).first().contact_links == ["https://jane.test/contact-me"] and pages.social_links(links).first().socials == {"instagram_url": "https://instagram.com/jane"}


def test_catalogs(spark):
    rows = [
        ("9780306406157", "google_books", '{"items":[{"volumeInfo":{"title":"No","industryIdentifiers":[{"identifier":"1"}]}},{"volumeInfo":{"title":"Yes","authors":["A B"],"industryIdentifiers":[{"identifier":"0306406152"}]}}]}'),
        ("9780306406157", "crossref", '{"message":{"items":[{"title":["T"],"author":[{"given":"A","family":"B"}],"ISBN":["9780306406157"],"published":{"date-parts":[[2001]]}}]}}'),
        ("9780306406157", "wikidata", '{"results":{"bindings":[{"itemLabel":{"value":"Q12"}}]}}'),
        ("9780306406157", "internet_archive", "not json"),
    ]
    got = {x.provider: x for x in catalogs.catalog_records(spark.createDataFrame(rows, "isbn string, provider string, payload string")).collect()}
    assert set(got) == {"google_books", "crossref"} and got["google_books"].title == "Yes" and got["crossref"].authors == ["A B"] and got["crossref"].publication_date == "2001"


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_bytes(b"\xef\xbb\xbfBook Name,Author / Owner,Primary Email\nOwl,Jane Doe,\"a@b.test\"\n,,\nCat,Joe,\n")
    rows = files.project_aliases(files.read_lead_files(spark, str(tmp_path / "in/a.csv")), ["title", "author_name", "public_email", "asin"])
    assert sorted(map(tuple, rows.collect())) == [("Cat", "Joe", "", ""), ("Owl", "Jane Doe", "a@b.test", "")]
    store = str(tmp_path / "store")
    found = spark.createDataFrame([("0306406152", "T", "A B", "2001", "s"), ("bad", "T", "A B", "2001", "s"), ("9780306406157", "U", "", "2001", "s")], "code string, title string, author_name string, publication_date string, source string")
    files.save_keyword_results(found, store, "Kids Books", 2000, None)
    assert [x.code for x in files.load_keyword_results(spark, store, "kids books", 2000, None).collect()] == ["0306406152"]
    assert files.load_keyword_results(spark, store, "kids-books", 2000, None).count() == 0


def test_tabs(spark):
    books = spark.createDataFrame([("1", "Owl"), ("2", "Cat")], "`lead id` string, `book title` string")
    authors = spark.createDataFrame([("1", "Jane", 1), ("1", "Janet", 2)], "`lead id` string, `author name` string, ord int")
    found = spark.createDataFrame([("1", "Phone", "p1", "u1", 1), ("1", "email", "e1", "u2", 2), ("1", "email", "e2", "u3", 3)], "`lead id` string, `contact type` string, `contact value` string, `source url` string, ord int")
    outreach = spark.createDataFrame([("2", "angle", 1)], "`lead id` string, `outreach angle` string, ord int")
    got = {x["lead id"]: x for x in files.reassemble_tabs(books, authors, found, outreach).collect()}
    assert got["1"]["author name"] == "Janet" and got["1"]["public email"] == "e1" and got["1"]["public phone"] == "p1" and got["2"]["outreach angle"] == "angle" and got["2"]["public email"] == ""


def test_stream_equals_batches(spark, tmp_path):
    r = random.Random(3)
    batches = [[(100 * b + i, f"e{r.randint(0, 20)}", f"p{r.randint(0, 20)}") for i in range(12)] for b in range(3)]
    schema, source = "ord long, e string, p string", tmp_path / "in"
    keys, order = F.array(F.col("e"), F.col("p")), F.col("ord")
    source.mkdir()
    for b, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(source / f"b{b}"))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(source))
        ingest.ingest(stream, str(tmp_path / "live"), str(tmp_path / "cp"), keys, order).awaitTermination()
    ingest.ingest_batches([spark.createDataFrame(rows, schema) for rows in batches], str(tmp_path / "batch"), keys, order)
    used, want = set(), []
    for o, e, p in sum(batches, []):
        if not {e, p} & used:
            want.append(o)
            used |= {e, p}
    read = lambda n: sorted(x.ord for x in spark.read.parquet(str(tmp_path / n)).collect())
    assert read("live") == read("batch") == want


def test_enrollments(spark):
    now = datetime.datetime(2024, 1, 10)
    rows = spark.createDataFrame([(1, 1, 1, "queued", now), (2, 2, 1, "step1_sent", now), (3, 3, 1, "queued", now), (4, 4, 1, "queued", now + datetime.timedelta(days=1)), (5, 1, 1, "queued", now)], "enrollment_id long, lead_id long, campaign_id long, status string, next_action_date timestamp")
    leads = spark.createDataFrame([(1, "a@b.test"), (2, "c@d.test"), (3, "")], "lead_id long, public_email string").withColumns({"representation_email": F.lit(""), "publicist_email": F.lit("")})
    steps = spark.createDataFrame([(1, 1, "s1", 3), (1, 2, "s2", 4)], "campaign_id long, step_number int, subject string, delay_days int")
    senders = spark.createDataFrame([(7, 2, 0, None, True)], "sender_id long, daily_limit int, sent_today int, last_sent_at timestamp, is_active boolean")
    got = {x.enrollment_id: x for x in state.due_enrollments(rows, leads, steps, senders, F.lit(now)).collect()}
    assert set(got) == {1, 2, 3, 5}
    assert got[1].new_status == "step1_sent" and got[1].next_action_date == now + datetime.timedelta(days=4) and got[1].sender_id == 7
    assert got[2].new_status == "completed" and got[3].new_status == "completed" and got[3].sender_id is None
    assert got[5].new_status == "queued" and got[5].next_action_date == now + datetime.timedelta(hours=1)


def test_progress_and_gate(spark):
    errors = filters.messages((F.lit(True), "one"), (F.lit(None).cast("boolean"), "no"), (F.lit(True), "two"))
    assert one(spark, errors) == ["one", "two"]
    assert one(spark, state.gate(F.lit(70), F.lit("warm"), errors)).tier == "rejected"
    assert [one(spark, aggregates.share(F.lit(a), F.lit(b))) for a, b in ((1, 8), (3, 8), (0, 0))] == [12, 38, 0]


def test_keyword_ingest_with_caps(spark, tmp_path):
    """Web rows fill six of ten places, catalogs the rest; later runs take new books only, or the stored ones up to the cap."""
    from leadloom.streaming import ingest

    code = lambda i: f"B00000{i:04d}"

    def batch(codes):
        rows = [(i, c, f"Title {c}", "Kim Rowan", "2010", "listing") for i, c in enumerate(codes)]
        return spark.createDataFrame(rows, "ord long, code string, title string, author_name string, publication_date string, source string")

    run = lambda batches, **more: sorted(r.code for r in ingest.ingest_keyword(spark, f"file://{tmp_path}/store", "Kids", None, None, batches, **more).collect())
    bad = ["no code", ""]
    assert run([("web", batch([*bad, *map(code, range(20)), code(0)])), ("catalog", batch(map(code, range(3, 40))))], most=10) == [code(i) for i in range(10)]
    assert run([("catalog", batch(map(code, range(100))))], most=3, only_new=True) == [code(i) for i in (10, 11, 12)]
    assert run([("catalog", batch(map(code, range(100))))], most=4) == [code(i) for i in range(4)]
    assert run([("web", batch(map(code, range(100))))], only_new=True) == [code(i) for i in range(13, 100)]


def test_contactable_without_evidence(spark):
    """Nulls in any column, ties and repeated rows of evidence, and a lead without evidence."""
    star = spark.createDataFrame(
        [(1, "Jane Maple", "The Owl", "B1", "https://a.test/dp/B1", "verified", False, 5, "2024-01-01", "old@x.test", ""), (2, "Jane Maple", "The Owl", "b1", "u", "verified", None, 5, "2024-01-02", "", ""), (3, None, None, None, None, None, None, None, None, None, None), (4, "Ann Birch", "Elm", "", "u", "verified", False, 1, "2024-01-01", "", "")],
        "lead_id long, author_name string, title string, asin string, amazon_book_url string, verification_status string, do_not_contact boolean, verification_score int, created_at string, public_email string, public_phone string",
    )
    row = lambda lead, key, field="public_email", value="jane@maple.test", confidence=0.9, url="https://janemaple.test": (lead, key, field, value, url, None, None, confidence, "2024-01-01")
    found = [row(1, "a"), row(2, "a"), row(2, "b", value="j@maple.test"), row(2, "b", value="j@maple.test"), row(2, "c", "public_phone", "+12125557788", 0.5), row(2, "d", confidence=0.44), row(2, "e", url="https://youtube.com/janemaple"), row(4, "f"), row(None, None, None, None, None, None)]
    evidence = spark.createDataFrame(found, "lead_id long, evidence_id string, field_name string, field_value string, source_url string, source_title string, source_snippet string, confidence double, created_at string")
    got = exports.contactable(star, evidence)
    assert [(r.lead_id, r.public_email, r.public_phone, r.phone_or_email, r.contact_confidence) for r in got.collect()] == [(2, "j@maple.test", "+12125557788", "j@maple.test", 0.9)]
    assert exports.contactable(star.limit(0), evidence).count() == 0 == exports.contactable(star, evidence.limit(0)).count()
