"""The rules of trust, checks and gates by plain loops over the smallest tables: each query gives the loop's rows."""

import os
import re
from collections import defaultdict

import pytest

from leadloom.functions import fixed
from leadloom.plans import QUERIES
from leadloom.plans.standins import with_sql
from tests.oracle import connect

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
FIELDS = list(fixed.FIELD_ROLES)
MAILS = fixed.EMAIL_FIELDS


def norm(x):
    return re.sub("[^a-z0-9]+", " ", (x or "").lower()).strip()


def joined(x):
    return norm(x).replace(" ", "")


def host(url):
    m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def registered(domain):
    labels = domain.lower().split(".")
    keep = 3 if ".".join(labels[-2:]) in fixed.TWO_LABEL_SUFFIXES else 2
    return ".".join(labels[-keep:])


def mail_domain(mail):
    return registered(mail.rpartition("@")[2]) if "@" in mail else ""


def below(domain, listed):
    return any(domain == d or domain.endswith("." + d) for d in listed)


def platform(url):
    return any(p in host(url) for p in fixed.PLATFORM_HOSTS)


def people(name):
    return [w for w in norm(name).split() if len(w) >= 3 and w not in fixed.AUTHOR_STOPS]


def identity(author, title, *texts):
    own, words = people(author), " ".join(x or "" for x in texts)
    plain, run, last = norm(words), joined(words), (people(author) or [""])[-1]
    if not own:
        return False
    if " ".join(own) in plain or "".join(own) in run or (len(own) >= 2 and all(t in plain or t in run for t in own)) or (last in plain and len(last) >= 5):
        return True
    of_title = list(dict.fromkeys(w for w in norm(title).split() if len(w) >= 4 and w not in fixed.TITLE_STOPS))
    return last in plain and sum(t in plain or t in run for t in of_title) >= min(2, len(of_title))


def open_mail(v):
    domain = mail_domain(v)
    return domain != "" and not below(domain, fixed.BLOCKED_MAIL) and v.partition("@")[0].lower() not in fixed.DESKS


def trusted(e, lead):
    kind, url, value, field = e["evidence_type"], e["source_url"], e["field_value"], e["field_name"]
    social = kind == "social_profile"
    if not value or not url or kind not in fixed.TRUSTED_TYPES or (platform(url) and not social):
        return False
    author, texts = lead["author_name"], (url, e["source_title"], e["source_snippet"])
    named = identity(author, lead["title"], *texts)
    mail, own = field in MAILS, people(author)
    if social:
        return named and (not mail or open_mail(value))
    if mail:
        local, domain = joined(value.partition("@")[0]), joined(registered(host(url)))
        a, b = mail_domain(value), registered(host(url))
        same = a != "" and b != "" and (a == b or a.endswith("." + b) or b.endswith("." + a))
        in_local = bool(own) and ("".join(own) in local or own[-1] in local)
        handle, owned = local in fixed.AUTHOR_HANDLES, kind in ("contact_page", "official_author_site", "groq_extraction")
        aligned = same and (named or any(len(t) >= 4 and t in domain for t in own) or in_local or handle or owned or field != "public_email")
        words = " ".join([host(url).replace("-", " "), e["source_title"], e["source_snippet"]])
        agent = named or re.search(fixed.ROLE_HINT, f"{e['source_title']} {e['source_snippet']}") or (not platform(url) and re.search(fixed.PUBLISHER_HINT, words))
        return open_mail(value) and bool(aligned or ((named or in_local or (handle and owned)) if field == "public_email" else agent))
    if field == "public_phone":
        return bool(named or re.search(fixed.ROLE_HINT, " ".join(texts)))
    return named


class World:
    """The tables as dictionaries, and what the loops make of them."""

    def __init__(self):
        con = connect(SF)
        rows = lambda sql: [dict(zip(r.columns, x, strict=True)) for r in [con.sql(with_sql("leads", "books", "authors", "evidence", "candidates") + sql)] for x in r.fetchall()]
        self.leads = rows("select * from leads join (select * exclude (author_id) from books) using (book_id) left join authors using (author_id)")
        self.by_id = {x["lead_id"]: x for x in self.leads}
        self.evidence = [e for e in rows("select * from evidence") if e["lead_id"] in self.by_id]
        self.of_lead = defaultdict(list)
        for e in self.evidence:
            e["trusted"] = trusted(e, self.by_id[e["lead_id"]])
            self.of_lead[e["lead_id"]].append(e)
        self.verified = {(e["lead_id"], e["field_name"], e["field_value"]) for e in self.evidence if e["trusted"] and e["confidence"] >= (0.55 if e["field_name"] == "public_phone" else 0.6)}
        self.sourced = {(e["lead_id"], e["field_name"], e["field_value"]) for e in self.evidence if e["source_url"]}

    def flag(self, lead, field, kept):
        return (lead["lead_id"], field, lead[field]) in kept

    def best(self, lead):
        def good(e):
            mail = e["field_name"] in MAILS
            enough = (e["evidence_type"] in fixed.OWNED_TYPES and e["confidence"] >= 0.65) or (e["evidence_type"] in fixed.TRUSTED_TYPES and e["confidence"] >= 0.6)
            named = identity(lead["author_name"], lead["title"], e["source_url"], e["source_title"], e["source_snippet"])
            blocked = mail and (mail_domain(e["field_value"]) == "" or below(mail_domain(e["field_value"]), fixed.BLOCKED_MAIL))
            return e["field_name"] in FIELDS and enough and named and not blocked and not platform(e["source_url"])

        found = [e for e in self.of_lead[lead["lead_id"]] if good(e)]
        return min(found, key=lambda e: (-e["confidence"], -e["created_at"].toordinal(), e["evidence_id"])) if found else None

    def compliance(self, x):
        if x["do_not_contact"]:
            return ["Compliance error: Lead is marked as do-not-contact (Opted Out)."]
        mail = next((x[c] for c in MAILS if x[c]), "")
        out = []
        if any(re.search(rf"\b{w}\b", x["location"].strip().lower()) for w in fixed.FOREIGN):
            out.append(f"Compliance error: Author location '{x['location']}' is in a non-target foreign country.")
        if not mail:
            out.append("Compliance error: Lead is missing a valid contact email.")
        elif not (open_mail(mail) and mail.partition("@")[0] not in ("sales", "marketing") and not any(d in mail for d in fixed.DUMMY_MAIL)):
            out.append(f"Compliance error: Contact email '{mail}' is invalid, a dummy placeholder, or a generic administrative desk.")
        names = {"public_email": "Public email", "representation_email": "Representation email", "publicist_email": "Publicist email"}
        return out + [f"Compliance error: {names[c]} is missing registered public source URL evidence." for c in MAILS if x[c] and not self.flag(x, c, self.sourced)]

    def listing(self, x):
        m = re.search(r"/dp/([A-Z0-9]{10})(?:[/?#]|$)", x["amazon_book_url"])
        market = any(host(x["amazon_book_url"]) == h or host(x["amazon_book_url"]).endswith("." + h) for h in fixed.MARKETPLACE_HOSTS)
        return bool(m and market and (not x["asin"] or m[1] == x["asin"].upper()))

    def gate(self, x, email=True, social_only=False):
        v = lambda c: self.flag(x, c, self.verified)
        tests = [
            (not self.listing(x), "Missing a verified Amazon marketplace book URL."),
            (not x["title"] or not x["author_name"], "Missing title or author."),
            (x["author_name"] == "Brand House Press", "Author is a publisher or company, not an individual author."),
            (x["is_childrens_book"] is False, "Book was classified as not a children's book."),
            (x["identity_confidence"] is not None and x["identity_confidence"] < 0.65, "Author identity confidence is below verified threshold."),
            (email and not any(x[c] for c in MAILS), "Missing public email."),
            (x["public_email"] and not v("public_email"), "Public email is missing a high-confidence author-site/contact-page source."),
            (x["representation_email"] and not v("representation_email"), "Representation email is missing a verified agency/publisher source."),
            (x["publicist_email"] and not v("publicist_email"), "Publicist email is missing a verified publisher/publicity source."),
            (x["public_phone"] and not v("public_phone"), "Public phone is missing a verified author-site/contact-page source."),
            (not social_only and not any(x[c] for c in (*FIELDS, "contact_page_url")), "No direct public email, phone, or contact page."),
        ]
        return [m for bad, m in tests if bad] + self.compliance(x)

    def candidates(self):
        """(lead, channel, value) -> (field, role), the first of contact columns, then evidence."""
        out = {}
        for x in self.leads:
            own = [(i, "", c, x[c]) for i, c in enumerate(FIELDS)] + [(len(FIELDS), e["evidence_id"], e["field_name"], e["field_value"]) for e in self.of_lead[x["lead_id"]] if e["field_name"] in FIELDS]
            for _, _, field, value in sorted(own, key=lambda r: r[:2]):
                if value:
                    channel, role = fixed.FIELD_ROLES[field]
                    out.setdefault((x["lead_id"], channel, value.lower() if channel == "email" else value), (field, role))
        return out

    def checks(self):
        """Rows of candidate_checks, and the log's (type, result, points, reason) of each."""
        found, uses = self.candidates(), defaultdict(set)
        for lead, channel, value in found:
            uses[channel, value].add(lead)
        rows, log = {}, {}
        for (i, channel, value), (field, role) in found.items():
            x = self.by_id[i]
            backed = [e for e in self.of_lead[i] if e["trusted"] and e["source_url"] and e["field_name"] == field and e["field_value"] == value]
            domains = {registered(host(e["source_url"])) for e in backed} - {""}
            known, several = (x["identity_confidence"] or 0) >= 0.65, len(domains) >= 2
            owned = {registered(host(u)) for u in (x["canonical_website"], x["contact_page_url"], *(e["source_url"] for e in self.of_lead[i] if e["trusted"] and e["evidence_type"] in fixed.OWNED_TYPES))} - {""}
            others = len(uses[channel, value]) - 1
            if channel == "email":
                blocked, on_domain = below(mail_domain(value), fixed.BLOCKED_MAIL), mail_domain(value) in owned
                source = not blocked and bool(backed)
                shared = others >= 3
                c = [
                    ("syntax", "pass", 15, "valid_syntax"), ("source_policy", "fail" if blocked else "pass", 0, "blocked_email_domain" if blocked else "allowed_email_domain"),
                    ("trusted_source", "pass" if source else "unknown", 30 * source, "trusted_exact_source" if source else "missing_trusted_source"),
                    ("identity_match", "pass" if source and known else "unknown", 30 * (source and known), "identity_aligned" if source and known else "identity_inconclusive"),
                    ("role_match", "pass", 10, f"role_{role}"), ("domain_alignment", "pass" if on_domain else "unknown", 10 * on_domain, "email_on_author_domain" if on_domain else "email_domain_not_author_owned"),
                    ("deliverability", "unknown", 0, "smtp_unknown"), ("shared_channel", "unknown" if shared else "pass", 0, f"shared_across_{others}_leads" if shared else "unique_to_lead"),
                    ("corroboration", "pass" if several and not shared else "unknown", 15 * (several and not shared), "multiple_independent_sources" if several and not shared else "single_source"),
                ]
            else:
                fake = bool(re.match(r"\+1\d{3}55501\d\d$", value) or re.match(r"\+1(\d)\1{9}$", value))
                valid = bool(re.match(r"\+1[2-9]\d\d[2-9]\d{6}$", value)) and not fake
                back = valid and bool(backed)
                c = [
                    ("phone_validity", "pass" if valid else "fail", 15 * valid, "valid_e164" if valid else "invalid_phone"), ("phone_line_type", "fail" if fake else "pass", 0, "premium_or_fake_number" if fake else "line_landline"),
                    ("trusted_source", "pass" if back else "unknown", 30 * back, "trusted_exact_source" if back else "missing_trusted_source"),
                    ("identity_match", "pass" if back and known else "unknown", 35 * (back and known), "identity_aligned" if back and known else "identity_inconclusive"),
                    ("role_match", "pass", 10, f"role_{role}"), ("corroboration", "pass" if several and back else "unknown", 10 * (several and back), "multiple_independent_sources" if several and back else "single_source"),
                ]
            score, result = min(100, sum(p for _, _, p, _ in c)), {k: r for k, r, _, _ in c}
            if channel == "email":
                fine = result["source_policy"] == "pass" and result["trusted_source"] == result["identity_match"] == "pass"
                status = "verified" if fine and score >= 85 else "not_verified" if result["source_policy"] == "fail" else "other"
            else:
                status = "verified" if result["identity_match"] == "pass" and score >= 90 else "other" if result["phone_validity"] == "pass" else "not_verified"
            rows[i, channel, value] = (score, status, "; ".join(w for _, r, _, w in c if r != "pass") or "All required verification checks passed.")
            log[i, channel, value] = c
        return rows, log


@pytest.fixture(scope="module")
def world():
    return World()


def got(spark, name, *columns):
    return sorted((tuple(r[c] for c in columns) for r in QUERIES[name](spark, SF).collect()), key=str)


def test_trust(spark, world):
    assert any(e["trusted"] for e in world.evidence) and not all(e["trusted"] for e in world.evidence)
    assert got(spark, "source_trusted", "evidence_id", "trusted") == sorted(((e["evidence_id"], e["trusted"]) for e in world.evidence), key=str)
    own = [x for x in world.leads if x["public_email"]]
    assert got(spark, "has_verified_source", "lead_id") == sorted(((x["lead_id"],) for x in own if world.flag(x, "public_email", world.verified)), key=str)
    assert got(spark, "reconcile_contacts", "lead_id", "field_value", "score") == sorted(((x["lead_id"], x["public_email"], 0.7 if world.flag(x, "public_email", world.verified) else 0.3) for x in own), key=str)


def test_best_evidence(spark, world):
    best = {x["lead_id"]: b for x in world.leads if (b := world.best(x))}
    assert len(best) > 10
    assert got(spark, "best_contact_evidence", "lead_id", "evidence_id") == sorted(((i, b["evidence_id"]) for i, b in best.items()), key=str)


def test_cleared_contacts(spark, world):
    want = []
    for x in world.leads:
        gone = [c for c in ("public_email", "representation_email", "publicist_email", "public_phone") if x[c] and not world.flag(x, c, world.verified)]
        want.append((x["lead_id"], "" if "public_email" in gone else x["public_email"], "" if "public_phone" in gone else x["public_phone"], "; ".join(f"{c} was cleared: no trusted source." for c in gone)))
    assert got(spark, "clear_unverified_contacts", "lead_id", "public_email", "public_phone", "warnings") == sorted(want, key=str)


def test_gates(spark, world):
    assert got(spark, "compliance_errors", "lead_id", "errors") == sorted(((x["lead_id"], "\n".join(world.compliance(x))) for x in world.leads), key=str)
    assert got(spark, "verification_errors", "lead_id", "errors") == sorted(((x["lead_id"], "\n".join(world.gate(x))) for x in world.leads), key=str)


def test_checks(spark, world):
    rows, log = world.checks()
    assert {r[1] for r in rows.values()} >= {"other"} and len({r[0] for r in rows.values()}) > 4
    assert got(spark, "candidate_checks", "lead_id", "channel", "normalized_value", "score", "status", "reason") == sorted((k + r for k, r in rows.items()), key=str)
    lines = got(spark, "append_check_log", "lead_id", "channel", "normalized_value", "check_type", "result", "score_delta", "reason_code")
    assert lines == sorted((k + c for k, cs in log.items() for c in cs), key=str)


def test_expressions_read_by_many_rules_stay_small(spark):
    """Sizes of analysed plans: each was several times as large while a step was written out wherever a later one read it."""
    from leadloom.functions import contacts, urls
    from leadloom.functions import text as X

    df = spark.createDataFrame([("a", "b")], "a string, b string")
    rules = {"usable": (contacts.usable_email("a"), 8_000), "blocked": (urls.blocked_mail("a"), 4_000), "align": (urls.domains_align("a", "b"), 15_000), "guess": (X.guess_title_author("a", "b"), 60_000)}
    for name, (rule, most) in rules.items():
        assert len(df.select(rule.alias("x"))._jdf.queryExecution().analyzed().toString()) < most, name


def test_domains_by_their_ends(spark):
    """Registered, blocked and marketplace domains against plain loops over labels."""
    from pyspark.sql import functions as F

    from leadloom.functions import urls

    hosts = ["", ".", "a", "co.uk", "x.co.uk", "a.b.x.co.uk", "example.com", "EXAMPLE.com", "a.example.com", "notexample.com", "example.com.", "example.com\n", "a..b", ".com", "1.2.3.4", "www.amazon.co.uk", "amazon.com.shop.test", "amazonXcom", "shop.goodreads.com"]
    ends = lambda h: [".".join(h.split(".")[i:]) for i in range(h.count(".") + 1)]

    def registered(h):
        if all(x.isdigit() for x in h.split(".")) and h.count(".") == 3:
            return h
        w = h.lower().split(".")
        keep = 3 if ".".join(w[-2:]) in fixed.TWO_LABEL_SUFFIXES else 2
        return ".".join(w[-keep:])

    df = spark.createDataFrame([(h,) for h in hosts], "h string")
    got = df.select("h", urls.registered_domain(F.col("h")).alias("r"), urls.in_domains(F.col("h"), fixed.BLOCKED_MAIL).alias("b"), urls.marketplace_host(F.concat(F.lit("https://"), "h", F.lit("/x"))).alias("m")).collect()
    for x in got:
        assert x["r"] == registered(x["h"]), x
        assert x["b"] == bool(set(ends(x["h"])) & set(fixed.BLOCKED_MAIL)), x
        assert x["m"] == next((e for e in ends(x["h"].lower().rstrip(".")) if e in fixed.MARKETPLACE_HOSTS), None) or "\n" in x["h"], x


def test_pages_are_read_in_small_slices():
    """A batch of any size is read and given on by slices; nulls are blank pages."""
    import pyarrow as pa

    from leadloom.sources import pages

    n = 2 * pages.SLICE + 1
    html = [None, "", *('<title>T</title><a href="/x">y</a><form action="/f"><textarea name="m"></textarea></form><a href="mailto:a@b.test">m</a>' for _ in range(n - 2))]
    batch = pa.RecordBatch.from_pydict({"page_id": list(range(n)), "url": [None, *["https://a.test/"] * (n - 1)], "html": pa.array(html, pa.string())})
    out = list(pages.read_batches(iter([batch])))
    assert [b.num_rows for b in out] == [pages.SLICE, pages.SLICE, 1]
    rows = [r for b in out for r in b.to_pylist()]
    assert [r["page_id"] for r in rows] == list(range(n)) and rows[0]["url"] == "" and rows[1]["links"] == []
    assert rows[2]["links"] == [{"href": "https://a.test/x", "anchor": "y"}] and rows[2]["forms"][0]["has_message"] and rows[2]["attributes"] == [{"kind": "mailto", "value": "a@b.test"}]


def test_patterns_of_words_are_grouped_by_first_letter():
    from leadloom.functions.text import alternation

    words = ["amazon.", "archive.org", "b", "", "bc+"]
    assert alternation(words).count("|a") == 0 and alternation(["amazon.", "archive.org"]).count("a(?:") == 1
    for value in ["xamazon.y", "amazonx", "archive.org", "archiveXorg", "bc+", "c", ""]:
        for some in (words[:2], words[:3], words[4:], words):
            assert bool(re.search(alternation(some), value)) == any(w in value for w in some), (value, some)


def test_approval_reads_sources_of_locations_and_books(spark):
    from leadloom.plans import queries_tables
    from leadloom.plans.registry import Tables

    class Fewer(Tables):
        """Evidence without the books of every fifth number."""

        def __getattr__(self, name):
            df = super().__getattr__(name)
            return df.where("book_id % 5 <> 0") if name == "evidence" else df

    t = Fewer(spark, SF)
    seen = t.evidence.collect()
    told = {(e.lead_id, e.field_value) for e in seen if e.field_name == "location" and e.source_url}
    books = {e.book_id for e in seen}
    errors = {x.lead_id: x.errors.split("\n") for x in queries_tables.approval_decision(t).collect()}
    leads = t.leads.collect()
    assert sorted(errors) == sorted(x.lead_id for x in leads)
    kinds = set()
    for x in leads:
        own = errors[x.lead_id]
        missing = bool(x.location) and (x.lead_id, x.location) not in told
        no_book = "Missing a verified Amazon marketplace book URL." in own and x.book_id not in books
        assert ("location is missing a source URL." in own) == missing and ("Lead needs an Amazon URL or strong book source." in own) == no_book
        kinds.add((bool(x.location), missing, no_book))
    assert {(True, True, True), (True, False, False), (False, False, True)} <= kinds
