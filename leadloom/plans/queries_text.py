"""Queries of column expressions, scores and extraction jobs over names, texts and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import coerce, contacts, fixed, ids, scores, trust, urls
from ..functions import text as X
from ..operators import evidence, filters, state
from ..operators.dedupe import dedupe_first
from ..sources import catalogs, files, pages
from .queries_tables import BOOK_KEY, NORM, flags, judged, source_flags, star
from .registry import Tables, query


# ---- text and names ----
@query(sql=r"select doc_id, trim(regexp_replace(lower(regexp_replace(strip_accents(text), '[^\x00-\x7F]', '', 'g')), '[^a-z0-9]+', ' ', 'g')) as n from documents")
def normalize_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.normalize_text("text").alias("n"))


@query("books", sql=f"select book_id, {BOOK_KEY} as key from books")
def book_key(t: Tables) -> DataFrame:
    return t.books.select("book_id", X.book_key("title", "author_name", "asin").alias("key"))


@query("books", sql=f"select book_id, {NORM.format('author_name')} as author_key, replace({NORM.format('author_name')}, ' ', '') as compact from books")
def author_key(t: Tables) -> DataFrame:
    return t.books.select("book_id", X.author_key("author_name").alias("author_key"), X.compact("author_name").alias("compact"))


@query("books", sql="select book_id, trim(regexp_replace(regexp_replace(title, '\\s*[:|-]\\s*Amazon.*$', '', 'i'), '\\s*\\([^)]*Paperback[^)]*\\)', '', 'i'), ' -:|') as title from books")
def clean_listing_title(t: Tables) -> DataFrame:
    return t.books.select("book_id", X.clean_listing_title("title").alias("title"))


@query("books", sql="select book_id, case when author_name = 'Brand House Press' then '' else author_name end as name, author_name not in ('', 'Brand House Press') as valid from books")
def person_names(t: Tables) -> DataFrame:
    noisy = F.concat(F.when(X.present("author_name"), F.lit("Visit Amazon's ")).otherwise(""), F.col("author_name"), F.when(X.present("author_name"), F.lit(" (Author) Paperback")).otherwise(""))
    return t.books.select("book_id", X.clean_person_name(noisy).alias("name"), X.valid_person_name("author_name").alias("valid"))


TITLE_TOKENS = f"list_distinct(list_filter(string_split({NORM.format('title')}, ' '), lambda x: len(x) >= 4 and not list_contains({fixed.TITLE_STOPS}, x)))"


@query("books", sql=f"""select book_id, array_to_string(list_filter(string_split(lower(author_name), ' '), lambda x: len(x) >= 3), ' ') as author_tokens,
  array_to_string(list_sort({TITLE_TOKENS}), ' ') as title_tokens from books""")
def author_and_title_tokens(t: Tables) -> DataFrame:
    return t.books.select("book_id", F.array_join(X.author_tokens("author_name"), " ").alias("author_tokens"), F.array_join(F.sort_array(X.title_tokens("title")), " ").alias("title_tokens"))


@query()
def metadata_from_results(t: Tables) -> DataFrame:
    """Per log: the title of its first usable result, and the first name found."""
    usable = t.results.select("log_id", "event_id", X.clean_listing_title("title").alias("clean"), X.parse_review_title("title", F.lit(""))["author"].alias("name"))
    return usable.groupBy("log_id").agg(F.min_by("clean", "event_id").alias("title"), F.min_by(F.nullif("name", F.lit("")), F.when(X.present("name"), F.col("event_id"))).alias("author"))


TITLED = "case cast(book_id % 6 as int) when 0 then title when 1 then 'Missing' when 2 then 'unknown tale' when 3 then 'Book for ASIN ' || title when 4 then asin else 'book  for-ISBN 978' end"


@query("books", sql=f"select book_id, {NORM.format('t')} in ('', 'missing', 'unknown') or {NORM.format('t')} like 'book for asin%' or {NORM.format('t')} like 'book for isbn%' or ({NORM.format('asin')} <> '' and {NORM.format('t')} = {NORM.format('asin')}) as placeholder from (select book_id, asin, {TITLED} as t from books)")
def placeholder_title(t: Tables) -> DataFrame:
    return t.books.select("book_id", X.placeholder_title(F.expr(TITLED), "asin").alias("placeholder"))


LONG_TITLES = "case cast(book_id % 5 as int) when 0 then title when 1 then 'The Tale of ' || title || ' and the ' || title when 2 then ' of the  and in on at to for ' when 3 then 'About the ' || author_name || ' in a very long and winding story' else '' end"


@query("books", sql=rf"""with w as (select book_id, trim(t) as t, list_filter(string_split_regex(t, '\s+'), lambda x: x <> '') as w from (select book_id, {LONG_TITLES} as t from books)),
s as (select *, list_filter(w, lambda x: not list_contains({fixed.TITLE_STOPS + fixed.CONNECTORS}, trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g')))) as s from w)
select book_id, case when len(w) <= 6 then t else trim(array_to_string(s[1:4], ' '), ' :-') end as anchor from s""")
def title_anchor(t: Tables) -> DataFrame:
    return t.books.select("book_id", X.title_anchor(F.expr(LONG_TITLES)).alias("anchor"))


IN_TITLES = "case cast(book_id % 4 as int) when 0 then title when 1 then author_name || ' and ' || title when 2 then substr(author_name, 1, 4) || ' of ' || title else upper(author_name) end"


@query("books", sql=f"select book_id, len(list_filter(list_filter(string_split({NORM.format('author_name')}, ' '), lambda x: len(x) >= 3 and not list_contains({fixed.AUTHOR_STOPS}, x)), lambda x: not list_contains(string_split({NORM.format('t')}, ' '), x))) = 0 as fragment from (select book_id, author_name, {IN_TITLES} as t from books)")
def name_is_title_fragment(t: Tables) -> DataFrame:
    return t.books.select("book_id", X.name_is_title_fragment("author_name", F.expr(IN_TITLES)).alias("fragment"))


ENDS = "case cast(book_id % 4 as int) when 0 then title || ' by ' || author_name when 1 then title || '  by  ' || author_name || ' Jr. ' when 2 then title || ' by the ' || author_name else title end"
SPLIT = r"'^(.*\S)\s+by\s+(\p{Lu}[\w.''-]*(?:\s+\p{Lu}[\w.''-]*){1,3})\s*$'"


@query("books", sql=f"select book_id, case when author <> '' then regexp_extract(t, {SPLIT}, 1) else t end as title, author from (select *, regexp_extract(t, {SPLIT}, 2) as author from (select book_id, {ENDS} as t from books))")
def split_title_by_author(t: Tables) -> DataFrame:
    return t.books.select("book_id", X.split_title_by_author(F.expr(ENDS)).alias("x")).select("book_id", "x.*")


COLONS = "title || ': ' || split_part(author_name, ' ', 2) || ', ' || split_part(author_name, ' ', 1) || case when book_id % 2 = 0 then ', Doe, Jamie' else ', illustrated' end || ': 9780689851599'"


@query("books", sql="select book_id, array_to_string(list_filter([case when author_name = 'Brand House Press' then '' else author_name end, case when book_id % 2 = 0 then 'Jamie Doe' else '' end], lambda x: x <> ''), '; ') as authors from books")
def authors_from_colon_title(t: Tables) -> DataFrame:
    return t.books.select("book_id", F.array_join(X.authors_from_colon_title(F.expr(COLONS)), "; ").alias("authors"))


BARE = "regexp_replace(regexp_replace(title, ' - Amazon.com$', ''), ' [(]Large Paperback[)]$', '')"
GUESSED = f"case cast(book_id % 4 as int) when 0 then {BARE} || ' by ' || author_name || ' (Author)' when 1 then {BARE} || ': ' || split_part(author_name, ' ', 2) || ', ' || split_part(author_name, ' ', 1) || ': 9780689851599' when 2 then {BARE} || ' by ' || author_name || ' | Amazon.com' else title end"


@query(
    "books",
    sql=f"""with g as (select book_id, {BARE} as bare, case when author_name = 'Brand House Press' then '' else author_name end as name, author_name, cast(book_id % 4 as int) as form from books)
select book_id, case when name <> '' and form in (0, 1, 2) then name else '' end as author, cast(case when name = '' or form = 3 then 0.35 when form = 0 then 0.8 when form = 1 then 0.75 else 0.6 end as double) as confidence from g""",
)
def guess_title_author(t: Tables) -> DataFrame:
    """Titles as search results have them, parsed by the ladder."""
    return t.books.select("book_id", X.guess_title_author(F.expr(GUESSED), F.lit("")).alias("g")).select("book_id", "g.author", F.col("g.confidence").cast("double").alias("confidence"))


REVIEWS = f"case cast(book_id % 3 as int) when 0 then 'Book Review: ' || {BARE} || ' by ' || author_name || ' | The Shelf' when 1 then {BARE} || ' - book reviews of the week' else 'review - ' || {BARE} end"


@query(
    "books",
    sql=f"""select book_id, case when book_id % 3 = 0 and title = '' then trim('by ' || author_name) else {BARE} || case when book_id % 3 = 0 and author_name = '' then ' by' else '' end end as title, case when author_name = 'Brand House Press' or book_id % 3 = 2 then '' else author_name end as author,
cast(case when author_name = '' or book_id % 3 = 2 then 0 when book_id % 3 = 0 then 0.7 else 0.6 end as double) as confidence from books""",
)
def parse_review_title(t: Tables) -> DataFrame:
    snippet = F.when(F.col("book_id") % 3 == 1, F.concat(F.lit("A word by "), "author_name"))
    return t.books.select("book_id", X.parse_review_title(F.expr(REVIEWS), snippet).alias("p")).select("book_id", "p.title", "p.author", F.col("p.confidence").cast("double").alias("confidence"))


SLUGS = "case cast(page_id % 4 as int) when 0 then url when 1 then 'https://x.test/p/the-long__tale-' || page_id || '/?q=1' when 2 then 'https://x.test/A_bc-DEF#' || page_id else url || '/' end"


@query(sql=rf"""with s as (select page_id, coalesce(list_filter(string_split(regexp_replace({SLUGS}, '[?#].*$', ''), '/'), lambda p: p <> '')[-1], '') as p from pages),
w as (select page_id, trim(regexp_replace(regexp_replace(p, '[-_]?\d+$', ''), '[-_]+', ' ', 'g')) as w from s)
select page_id, array_to_string(list_transform(string_split(lower(w), ' '), lambda x: upper(x[1]) || x[2:]), ' ') as title from w""")
def humanize_slug(t: Tables) -> DataFrame:
    return t.pages.select("page_id", X.humanize_slug(F.expr(SLUGS)).alias("title"))


@query(sql=r"""with w as (select doc_id, trim(regexp_replace(lower(coalesce(text, '')), '[\t\n\x0B\f\r ]+', ' ', 'g'), ' ') as w from documents), s as (select doc_id, w, trim(regexp_replace(w, '[^a-z0-9]+', '-', 'g'), '-') as s from w)
select doc_id, case when s = '' then 'keyword' when length(s) > 80 then s[1:69] || '-' || sha256(w)[1:10] else s end as slug from s""")
def keyword_slug(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.keyword_slug("text").alias("slug"))


# ---- URLs and identifiers ----
@query(
    "books",
    sql="""select book_id, case when asin > '' then 'amazon.co.uk' end as market, case when amazon_book_url = '' then null when asin > '' then asin else 'B000000001' end as code, case when asin > '' then 'https://www.amazon.co.uk/dp/' || asin else amazon_book_url end as canonical, asin > '' as verified from books""",
)
def listing_urls(t: Tables) -> DataFrame:
    u = "amazon_book_url"
    return t.books.select("book_id", urls.marketplace_host(u).alias("market"), urls.listing_id(u).alias("code"), urls.canonical_listing_url(u).alias("canonical"), urls.verified_listing_url(u, "asin").alias("verified"))


@query("books", sql="select book_id, case when asin = '' then 0.0 when title like '%Paperback%' then 0.95 else 0.8 end as confidence from books")
def listing_confidence(t: Tables) -> DataFrame:
    return t.books.select("book_id", urls.listing_confidence("title", "amazon_book_url", F.lit("")).alias("confidence"))


#: Addresses of every class by a number of the lead; the kinds in SQL stand beside them.
LINKS = [
    ("source_url", "case when source_url = '' then null when contains(source_url, 'goodreads.') then 'goodreads' else 'author_site' end"),
    ("'https://www.amazon.co.uk/dp/B000000001'", "'amazon_book'"),
    ("'https://www.amazon.com/author/' || lead_id", "'unrelated'"),
    ("'https://www.Instagram.com/a' || lead_id", "'instagram'"),
    ("'https://youtu.be/' || lead_id", "'youtube'"),
    ("'https://en.wikipedia.org/wiki/' || lead_id", "'unrelated'"),
    ("'https://quill-press.example.test/' || lead_id", "'publisher_site'"),
    ("'https://impressive.example.test/press/' || lead_id", "'author_site'"),
]


def linked(k: int) -> str:
    return f"case lead_id % {len(LINKS)} " + " ".join(f"when {i} then {x[k]}" for i, x in enumerate(LINKS)) + " end"


@query("evidence", sql=f"select evidence_id, kind, cast(case kind when 'amazon_book' then 0.9 when 'unrelated' then 0.2 when 'publisher_site' then 0.55 when 'author_site' then 0.45 else 0.85 end as double) as confidence from (select evidence_id, coalesce({linked(1)}, 'author_site') as kind from evidence)")
def classify_url(t: Tables) -> DataFrame:
    """Blank addresses are read as an author's site, as the rule has them."""
    rows = t.evidence.select("evidence_id", F.expr(linked(0)).alias("url"))
    return rows.select("evidence_id", urls.classify_url("url").alias("c")).select("evidence_id", "c.kind", F.col("c.confidence").cast("double").alias("confidence"))


@query(sql="select page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) as host, regexp_extract(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), '([^.]+[.][^.]+)$', 1) as registered, regexp_replace(regexp_replace(regexp_replace(lower(url), '^[a-z]+://', ''), '[?#].*$', ''), '/+$', '') as url_key, regexp_extract(url, '^(https?://[^/?#]+)', 1) as root from pages")
def url_parts(t: Tables) -> DataFrame:
    return t.pages.select("page_id", urls.host("url").alias("host"), urls.registered_domain_of_url("url").alias("registered"), urls.url_key("url").alias("url_key"), urls.root_website("url").alias("root"))


#: Rules of the caller, with wildcards and exceptions, and domains that meet each of them.
SUFFIXES = ["// rules", "com", "uk", "co.uk", "jp", "*.kawasaki.jp", "!city.kawasaki.jp", "*.ck", "!www.ck", "net", "example.net", "b.c.test"]
DOMAINS = "case cast(page_id % 12 as int) when 0 then regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[/?#].*$', '') when 1 then 'a' || page_id || '.co.uk' when 2 then 'x.y' || page_id || '.co.uk' when 3 then 'shop' || page_id || '.ck' when 4 then 'a.shop' || page_id || '.ck' when 5 then 'A.WWW.ck' when 6 then 'www.ck' when 7 then 'z.k' || page_id || '.kawasaki.jp' when 8 then 'q.city.kawasaki.jp' when 9 then 'a.b.c.test' when 10 then 'n' || page_id || '.a.b.c.test' else '10.0.0.7' end"


@query(
    sql=f"""with d as (select page_id, lower({DOMAINS}) as d from pages), r as (select unnest({[x for x in SUFFIXES if not x.startswith("//")]}) as rule), l as (select page_id, d, string_split(d, '.') as w from d),
e as (select page_id, d, w, unnest(range(1, len(w) + 1)) as k from l), s as (select *, array_to_string(w[len(w) - k + 1:], '.') as s from e),
m as (select page_id, d, w, max(case when '!' || s = rule then k end) as x, max(case when s = rule or (rule like '*.%' and k > 1 and array_to_string(w[len(w) - k + 2:], '.') = rule[3:]) then k end) as y from s left join r on true group by all)
select page_id, case when regexp_matches(d, '^[0-9]+([.][0-9]+){{3}}$') or len(w) <= coalesce(x - 1, y, 1) then d else array_to_string(w[len(w) - coalesce(x - 1, y, 1):], '.') end as registered from m"""
)
def public_suffixes(t: Tables) -> DataFrame:
    """Registered domains by rules of the caller: plain, wildcard, exception."""
    return t.pages.select("page_id", urls.registered_domain(F.expr(DOMAINS), urls.SuffixRules(SUFFIXES)).alias("registered"))


@query("evidence", sql="select evidence_id, contains(source_url, 'goodreads.') as blocked from evidence")
def blocked_hosts(t: Tables) -> DataFrame:
    return t.evidence.select("evidence_id", urls.platform_source("source_url").alias("blocked"))


MAILS = "case lead_id % 6 when 0 then public_email when 1 then 'admin@s' || lead_id || '.example.test' when 2 then 'Support@shop.amazon.co.uk' when 3 then 'x' || lead_id || '@mail.goodreads.com' when 4 then 'no-reply@press.example.test' else 'no address' end"


@query("leads", sql="select lead_id, case lead_id % 6 when 0 then public_email = '' else lead_id % 6 in (2, 3, 5) end as blocked, lead_id % 6 in (1, 2, 4) as desk from leads")
def blocked_email_domains(t: Tables) -> DataFrame:
    return t.leads.select("lead_id", F.expr(MAILS).alias("m")).select("lead_id", urls.blocked_mail("m").alias("blocked"), urls.desk_mailbox("m").alias("desk"))


SITES = "case lead_id % 5 when 0 then canonical_website when 1 then 'https://books.s' || lead_id || '.example.test/a' when 2 then 'https://www.other.example.org/x' when 3 then 'http://EXAMPLE.test' else 'no site' end"


@query("leads", "authors", sql="select lead_id, public_email > '' and case lead_id % 5 when 0 then coalesce(canonical_website, '') > '' else lead_id % 5 in (1, 3) end as aligned from leads left join authors using (author_id)")
def domains_align(t: Tables) -> DataFrame:
    return t.leads.join(t.authors, "author_id", "left").select("lead_id", urls.domains_align("public_email", F.expr(SITES)).alias("aligned"))


@query(sql="select page_id, url like 'http%' and not list_has_any(string_split(lower(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)), '/'), ['admin', 'login', 'signin', 'account', 'cart', 'checkout', 'wp-admin', 'dashboard']) as ok from pages")
def public_url_syntax(t: Tables) -> DataFrame:
    return t.pages.select("page_id", urls.public_url("url").alias("ok"))


OFFICES = "case lead_id % 5 when 0 then source_url when 1 then 'https://quill-press.example.test/x' when 2 then 'https://www.goodreads.com/press' when 3 then 'https://impressive.example.test' else '' end"
OFFICE_TITLES = "case lead_id % 5 when 0 then source_title when 1 then 'write to the agency' when 2 then 'a School  visit, school visits' when 3 then 'Submissions open' else 'quiet repress title' end"


@query("evidence", sql="select evidence_id, lead_id % 5 = 1 as publisher, lead_id % 5 in (1, 2, 3) as hint from evidence")
def publisher_or_agency_site(t: Tables) -> DataFrame:
    return t.evidence.select("evidence_id", urls.publisher_site(F.expr(OFFICES)).alias("publisher"), urls.role_hint(F.expr(OFFICE_TITLES)).alias("hint"))


@query("authors", sql=f"select author_id, regexp_extract(canonical_website, '^(https?://[^/?#]+)', 1) || p as page from authors, (select unnest({urls.SITE_PATHS}) as p) where canonical_website > ''")
def candidate_pages(t: Tables) -> DataFrame:
    return t.authors.select("author_id", F.explode(urls.candidate_pages("canonical_website")).alias("page"))


ISBN = "978' || lpad('' || (p_partkey % 1000000000), 9, '0')"
CHECK13 = "(10 - (list_sum(list_transform(range(1, 13), lambda i: cast(substr(s, cast(i as int), 1) as int) * case when i % 2 = 1 then 1 else 3 end)) % 10)) % 10"


@query(sql=f"with c as (select p_partkey, '{ISBN} as s from part) select p_partkey, s || p_partkey % 10 as code, {CHECK13} = p_partkey % 10 as valid from c")
def isbn_checksums(t: Tables) -> DataFrame:
    code = F.concat(F.lit("978"), F.lpad((F.col("p_partkey") % 1_000_000_000).cast("string"), 9, "0"), (F.col("p_partkey") % 10).cast("string"))
    return t.part.select("p_partkey", code.alias("code"), ids.isbn13_valid(code).alias("valid"))


@query()
def analyze_identifier(t: Tables) -> DataFrame:
    raw = F.element_at(F.array(F.col("asin"), F.concat(F.lit("978-0-"), F.lpad(F.col("book_id").cast("string"), 9, "0")), F.col("amazon_book_url"), F.col("title")), (F.col("book_id") % 4 + 1).cast("int"))
    return t.books.select("book_id", ids.analyze_identifier(raw).alias("a")).select("book_id", "a.canonical", "a.type", "a.valid", "a.isbn10", "a.isbn13")


@query()
def identifier_batch(t: Tables) -> DataFrame:
    """Identifiers in every document: tokens, their analysis, one row per book."""
    tokens = t.documents.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(ids.TOKEN), 0)).alias("pos", "token")).withColumn("a", ids.analyze_identifier("token")).where("a.valid")
    return dedupe_first(tokens.select("doc_id", "pos", "a.canonical", "a.isbn13"), X.first_present("isbn13", "canonical"), [F.col("doc_id"), F.col("pos")])


@query()
def isbn_in_text(t: Tables) -> DataFrame:
    found = t.documents.select("doc_id", ids.isbn_in_text("text").alias("isbn"), ids.asin_in_text("text").alias("asin"))
    return found.withColumn("code", ids.book_code("isbn"))


@query("books", sql="select book_id, asin as amazon_asin, case when asin > '' then 'asin_requires_amazon_product_evidence' else 'invalid_identifier' end as evidence from books")
def listing_identity(t: Tables) -> DataFrame:
    return t.books.select("book_id", ids.listing_identity("asin").alias("i")).select("book_id", "i.amazon_asin", "i.evidence")


@query()
def best_isbn(t: Tables) -> DataFrame:
    codes = F.array(F.concat(F.lit("978"), F.lpad("book_id", 10, "0")), F.lpad("book_id", 10, "0"), F.col("asin"))
    return t.books.select("book_id", ids.best_isbn(codes).alias("isbn"))


@query()
def build_book_record(t: Tables) -> DataFrame:
    """Books with a code, author and topic; class and layered validation."""
    c = scores.classify_book("title", "category", "publisher")
    rows = t.books.where(X.present("author_name") & X.present("asin")).withColumn("c", c).withColumn("is_childrens_book", F.coalesce("is_childrens_book", "c.is_childrens"))
    v = scores.layered_validation(scores.Row(rows.columns), F.lit("open_library"))
    return rows.select("book_id", v.alias("v")).select("book_id", "v.identifier_type", "v.score", "v.summary")


# ---- identity ----
#: Texts that name the author in full, joined, by the surname, not at all, by surname and title, and with the names turned.
NAMED = """case lead_id % 6 when 0 then 'a visit by ' || author_name when 1 then 'by ' || lower(replace(author_name, ' ', '')) when 2 then 'on Mr ' || split_part(author_name, ' ', 2)
  when 3 then 'nobody here' when 4 then split_part(author_name, ' ', 2) || ' wrote ' || title else split_part(author_name, ' ', 2) || ', ' || split_part(author_name, ' ', 1) end"""
PERSON = "author_name <> '' and author_name <> 'Brand House Press'"


@query("leads", "books", sql=f"""select lead_id, case when lead_id % 6 in (0, 1) then author_name <> '' when lead_id % 6 = 2 then {PERSON} and (len(split_part(author_name, ' ', 2)) >= 5 or len({TITLE_TOKENS}) = 0) else {PERSON} and lead_id % 6 > 3 end as named,
  case when lead_id % 6 in (0, 1) then author_name <> '' when lead_id % 6 = 4 then {PERSON} and len({TITLE_TOKENS}) > 0 else {PERSON} and lead_id % 6 = 5 end as strict from leads join books using (book_id)""")
def identity_appears(t: Tables) -> DataFrame:
    rows = t.leads.join(t.books.drop("author_id"), "book_id").withColumn("words", F.expr(NAMED))
    return rows.select("lead_id", trust.identity_appears("author_name", "title", "words").alias("named"), trust.identity_strict("author_name", "title", "words").alias("strict"))


#: Sites by a number of the lead: of the whole name, of the surname, of the names turned, of somebody else, none.
OWN_SITES = """case lead_id % 5 when 0 then 'https://www.' || lower(replace(author_name, ' ', '')) || '.test/a' when 1 then 'https://' || lower(split_part(author_name, ' ', 2)) || '-books.test'
  when 2 then 'http://' || lower(split_part(author_name, ' ', 2)) || '.by.' || lower(split_part(author_name, ' ', 1)) || '.test:80/' when 3 then 'https://tales.test/' || lower(replace(author_name, ' ', '')) else null end"""
HEADS = "case lead_id % 7 when 0 then author_name || ' at home' when 1 then null else 'Home' end"
LONG = r"list_transform(list_filter(regexp_extract_all(author_name, '[A-Za-z][A-Za-z''.-]+'), lambda x: len(x) >= 4), lambda x: lower(x))"
RUN = "regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9]+', '', 'g')"
SITE_DOMAIN = r"regexp_replace(coalesce(regexp_extract(site, '^[a-z]+://(?:www\.)?([^/:]*)', 1), ''), '[^a-z0-9]+', '', 'g')"


@query("leads", "books", sql=f"""with r as (select lead_id, author_name, title, {NAMED} as words, {OWN_SITES} as site, {HEADS} as head from leads join books using (book_id)),
s as (select *, {LONG} as own, {RUN.format('author_name')} as run, {RUN.format('words')} as words_run, {RUN.format('head')} as head_run, {SITE_DOMAIN} as d, {NORM.format('words')} as plain,
  list_filter(string_split({NORM.format('author_name')}, ' '), lambda x: x > '') as people, list_filter(string_split({NORM.format('title')}, ' '), lambda x: len(x) >= 4) as tw from r),
o as (select *, len(own) > 0 and (contains(d, run) or contains(head_run, run) or (len(own) >= 2 and contains(d, own[1]) and contains(d, own[-1]))) as site_or_title from s)
select lead_id, len(own) > 0 and (contains(words_run, run) or len(list_filter(own, lambda x: contains(lower(words), x) or contains(words_run, x))) >= least(2, len(own))) as in_text,
  len(people) > 0 and (contains(plain, array_to_string(people, ' ')) or contains(words_run, array_to_string(people, '')) or (len(people[-1]) >= 4 and contains(plain, people[-1]) and len(tw) > 0
    and len(list_filter(tw, lambda x: contains(plain, x))) >= least(2, len(tw)))) as on_profile,
  site_or_title or (len(own) > 0 and len(own[-1]) >= 5 and contains(d, own[-1])) as owned,
  site_or_title or (len(own) > 0 and (contains(words_run, run) or (contains(d, own[-1]) and contains(words_run, own[1])))) as owned_by_text from o""")
def identity_variants(t: Tables) -> DataFrame:
    """The rules of exports, social profiles and batches beside identity_appears."""
    rows = t.leads.join(t.books.drop("author_id"), "book_id").withColumns({"words": F.expr(NAMED), "site": F.expr(OWN_SITES), "head": F.expr(HEADS)})
    return rows.select(
        "lead_id", trust.named_in_text("author_name", "words").alias("in_text"), trust.profile_named("author_name", "title", "words").alias("on_profile"),
        trust.site_owned("author_name", "site", "head").alias("owned"), trust.site_owned("author_name", "site", "head", "words").alias("owned_by_text"),
    )


@query("books", sql="select book_id, author_name not in ('') as hit from books")
def label_matches(t: Tables) -> DataFrame:
    return t.books.select("book_id", trust.label_matches("author_name", F.concat("author_name", F.lit(" (writer)"))).alias("hit"))


@query()
def email_matches_author(t: Tables) -> DataFrame:
    return t.leads.join(t.books.drop("author_id"), "book_id").select("lead_id", trust.email_matches_author("public_email", "author_name", "amazon_book_url", F.lit(True)).alias("hit"))


@query()
def trusted_site(t: Tables) -> DataFrame:
    rows = t.authors.join(t.books.select("author_id", "title", "author_name"), "author_id")
    return rows.select("author_id", "title", trust.trusted_site("canonical_website", "author_name", "title").alias("site"), trust.trusted_social("instagram_url", "author_name", "title").alias("social"))


#: Texts of results by a number of the book: its title, its identifier in another text, half its title, another text.
RESULT_TEXTS = "case cast(book_id % 4 as int) when 0 then 'About: ' || title when 1 then 'an item ' || lower(asin) || ' of a shop' when 2 then substr(title, 1, 12) else 'something else' end"
TITLE_WORDS = f"list_distinct(list_filter(string_split({NORM.format('title')}, ' '), lambda x: len(x) >= 4 and not list_contains({fixed.TITLE_STOPS}, x)))"


@query("books", sql=f"with r as (select book_id, asin, title, {RESULT_TEXTS} as t, {TITLE_WORDS} as w from books), h as (select *, len(list_filter(w, lambda x: contains({NORM.format('t')}, x))) as n from r) select book_id, (asin > '' and contains(lower(t), lower(asin))) or ({NORM.format('title')} not in ('', 'missing', 'unknown') and len(w) > 0 and n >= least(3, len(w))) as hit from h")
def result_matches_book(t: Tables) -> DataFrame:
    return t.books.select("book_id", trust.result_matches_book(F.expr(RESULT_TEXTS), "title", "asin").alias("hit"))


@query("authors", "books", sql="select book_id, case when author_name not in ('', 'Brand House Press') and book_id % 3 <> 2 then 'https://instagram.com/' || lower(replace(author_name, ' ', '.')) else '' end as kept, 2 as n from books")
def filter_socials_by_identity(t: Tables) -> DataFrame:
    """Of two profiles of each book's author those that name them."""
    own = F.when((F.col("book_id") % 3 != 2) & (F.col("author_name") != "Brand House Press"), F.concat(F.lit("https://instagram.com/"), F.lower(F.replace("author_name", F.lit(" "), F.lit("."))))).otherwise(F.lit("https://instagram.com/tales"))
    socials = F.create_map(F.lit("instagram_url"), own, F.lit("youtube_url"), F.lit("https://youtube.com/readers"))
    rows = t.books.select("book_id", F.size(socials).alias("n"), trust.filter_socials(socials, "author_name", "title").alias("s"))
    return rows.select("book_id", F.array_join(F.map_values("s"), " ").alias("kept"), "n")


@query("books", sql="""with r as (select book_id, cast(book_id % 4 as int) as n, case when book_id % 5 = 0 then null else cast(book_id % 13 as double) / 13 end as a, case when book_id % 7 = 0 then null else cast(book_id % 3 as double) / 7 end as b, publisher, publication_date from books),
m as (select *, coalesce((coalesce(a, 0) + coalesce(b, 0)) / nullif((a is not null)::int + (b is not null)::int, 0), 0) as mean from r)
select book_id, round_even(least(0.95, case n when 0 then 0 when 1 then 0.52 else 0.62 + mean * 0.25 end + case when n > 0 and publisher > '' then 0.04 else 0 end + case when n > 0 and publication_date > '' then 0.03 else 0 end), 2) as confidence from m""")
def resolution_confidence(t: Tables) -> DataFrame:
    one, two = F.when(F.col("book_id") % 5 != 0, (F.col("book_id") % 13).cast("double") / 13), F.when(F.col("book_id") % 7 != 0, (F.col("book_id") % 3).cast("double") / 7)
    return t.books.select("book_id", evidence.resolution_confidence((F.col("book_id") % 4).cast("int"), one, two, F.col("publisher"), F.col("publication_date")).alias("confidence"))


CLEANED = "case cast(book_id % 6 as int) when 0 then ' None ' when 1 then 'N/A' when 2 then 'false' when 3 then null when 4 then ' no ' else '  ' || title || ' ' end"


@query("books", sql=f"select book_id, case when lower(trim(coalesce({CLEANED}, ''))) in ('', 'none', 'no', 'n/a', 'null', 'false') then '' else trim({CLEANED}) end as contact from books")
def clean_contact(t: Tables) -> DataFrame:
    return t.books.select("book_id", coerce.clean_contact(F.expr(CLEANED)).alias("contact"))


@query()
def reconcile_contacts(t: Tables) -> DataFrame:
    """Per lead and field: whether trusted evidence holds the value, with the score .7 or .3."""
    good = evidence.verified_fields(judged(t))
    rows = t.leads.where(X.present("public_email")).select("lead_id", F.lit("public_email").alias("field_name"), F.col("public_email").alias("field_value"))
    return rows.join(good.withColumn("_ok", F.lit(True)), ["lead_id", "field_name", "field_value"], "left").select("lead_id", "field_value", F.when(F.col("_ok"), 0.7).otherwise(0.3).alias("score"))


# ---- scores ----
def score_sql(rows: str) -> str:
    """Queries over `rows` (the lead star as a FROM item, with the names of its columns) that end in `scored`: every column with score, tier and needs."""
    mail = "split_part(lower(public_email), '@', 2)"
    site = "regexp_replace(regexp_extract(lower(coalesce(canonical_website, '')), '^[^:]*://([^/]*)', 1), '^www[.]', '')"
    has = lambda c: f"coalesce({c}, '') > ''"
    return f"""s0 as (select *, coalesce(do_not_contact, false) or contains(lower(coalesce(publisher, '')), 'penguin') or coalesce(not is_childrens_book, false) as rejected,
  contains(public_email, '@') and {has('canonical_website')} and (contains({site}, {mail}) or contains({mail}, {site})) as on_site,
  coalesce(has_other_books, false) as others, coalesce(video_status, '') in ('no_public_video_found', 'unclear') as video, coalesce(rating < 4.5 and is_picture_or_illustrated_book, false) as art from {rows}),
s1 as (select *, list_filter([case when rating < 4.2 then 'Cover redesign' end, case when art then 'Illustration' end, case when rating < 4.0 then 'Editing' end, case when not coalesce(has_aplus_content, false) then 'A+ Content' end,
  'Author Page optimization', case when not {has('canonical_website')} then 'Website development' end, case when video then 'Book trailer / animation' end, case when others then 'Series branding' end], lambda x: x is not null) as base from s0),
s2 as (select *, case when rejected then 0 else greatest(0, least(100, case when is_childrens_book then case when is_picture_or_illustrated_book then 20 else 10 end else 0 end + 20 + least(25, len(base) * 5)
  + least(20, case when {has('public_email')} then 15 else 0 end + case when {has('representation_email')} or {has('publicist_email')} then 12 else 0 end + case when {has('public_phone')} then 8 else 0 end + case when {has('contact_page_url')} then 8 else 0 end
    + case when {has('canonical_website')} then 6 else 0 end + case when {has('instagram_url')} then 3 else 0 end + case when on_site then 8 else 0 end)
  + case when publication_date not like '20%' then 0 when 2026 - cast(publication_date as int) <= 1 then 10 when 2026 - cast(publication_date as int) <= 2 then 8 when 2026 - cast(publication_date as int) <= 5 then 5 else 0 end
  + case when others then 5 else 0 end + case when greatest(coalesce(identity_confidence, 0), case when on_site then 0.85 else 0 end) >= 0.8 then 8 else 0 end + case when coalesce(extraction_confidence, 0) >= 0.7 then 4 else 0 end
  - case when greatest(coalesce(identity_confidence, 0), case when on_site then 0.85 else 0 end) < 0.5 then 15 else 0 end - case when coalesce(extraction_confidence, 0) < 0.4 then 20 else 0 end)) end::int as score from s1),
scored as (select *, case when rejected then 'rejected' when score >= 80 and video and ({has('public_email')} or {has('representation_email')} or {has('publicist_email')}) then 'hot' when score >= 65 then 'warm' when score >= 50 then 'cold' else 'rejected' end as tier,
  case when rejected then '' else array_to_string(list_concat(base, list_filter([case when video or art then 'Pitch: video' end, case when others or not {has('canonical_website')} then 'Pitch: web' end, 'Pitch: publishing'], lambda x: x is not null)), '; ') end as needs from s2)"""


STAR = "(select * from leads join (select * exclude (author_id) from books) using (book_id) left join authors using (author_id))"


@query("leads", "books", "authors", sql=f"with {score_sql(STAR)} select lead_id, score, tier, needs from scored")
def lead_score(t: Tables) -> DataFrame:
    return scores.with_lead_score(star(t), 2026).select("lead_id", "score", "tier", F.array_join("needs", "; ").alias("needs"))


@query(
    "leads", "books", "authors",
    sql="""select lead_id, array_to_string(list_filter([case when rating < 4.2 then 'Cover redesign' end, case when is_picture_or_illustrated_book and rating < 4.5 then 'Illustration' end, case when rating < 4.0 then 'Editing' end, case when not has_aplus_content then 'A+ Content' end, 'Author Page optimization',
case when coalesce(canonical_website, '') = '' then 'Website development' end, case when video_status in ('no_public_video_found', 'unclear') then 'Book trailer / animation' end, case when has_other_books then 'Series branding' end], lambda x: x is not null), '; ') as needs
from leads l join books b using (book_id) left join authors a on a.author_id = l.author_id""",
)
def service_needs(t: Tables) -> DataFrame:
    s = star(t)
    return s.select("lead_id", F.array_join(scores.service_needs(scores.Row(s.columns), with_pitches=False), "; ").alias("needs"))


@query("books", sql="select book_id, case when publication_date not like '20%' then 0 when 2026 - cast(publication_date as int) <= 1 then 10 when 2026 - cast(publication_date as int) <= 2 then 8 when 2026 - cast(publication_date as int) <= 5 then 5 else 0 end as points from books")
def recency_points(t: Tables) -> DataFrame:
    return t.books.select("book_id", scores.recency_points("publication_date", 2026).alias("points"))


#: Every name of the list in turn, in capitals or inside a longer name, and the book's own publisher.
PUBLISHERS = f"case when book_id % 3 = 0 then publisher when book_id % 3 = 1 then upper({fixed.TRADITIONAL_PUBLISHERS}[cast(book_id % {len(fixed.TRADITIONAL_PUBLISHERS)} as int) + 1]) else 'The ' || {fixed.TRADITIONAL_PUBLISHERS}[cast(book_id % {len(fixed.TRADITIONAL_PUBLISHERS)} as int) + 1] || ' Group' end"


@query("books", sql=f"select book_id, len(list_filter({fixed.TRADITIONAL_PUBLISHERS}, lambda x: contains(lower({PUBLISHERS}), x))) > 0 as traditional from books")
def reject_traditional_publisher(t: Tables) -> DataFrame:
    names = F.array(*map(F.lit, fixed.TRADITIONAL_PUBLISHERS))
    name = F.element_at(names, (F.col("book_id") % len(fixed.TRADITIONAL_PUBLISHERS)).cast("int") + 1)
    own = F.when(F.col("book_id") % 3 == 0, F.col("publisher")).when(F.col("book_id") % 3 == 1, F.upper(name)).otherwise(F.concat(F.lit("The "), name, F.lit(" Group")))
    return t.books.select("book_id", scores.traditional_publisher(own).alias("traditional"))


@query("books", sql="select book_id, contains(lower(title || ' ' || publisher), 'kids') as is_childrens, case when contains(lower(title || ' ' || publisher), 'kids') then 0.75 else 0.25 end as confidence from books where title || publisher <> '' union all select book_id, null, 0.25 from books where title || publisher = ''")
def classify_book(t: Tables) -> DataFrame:
    return t.books.select("book_id", scores.classify_book("title", "publisher").alias("c")).select("book_id", "c.is_childrens", "c.confidence")


@query(sql="select event_id, contains(p, 'trailer') as is_book_trailer, case when contains(p, 'trailer') then 0.8 else 0.2 end as confidence from (select event_id, event_type || case when event_id % 4 = 0 then ' trailer' else '' end as p from events)")
def classify_video(t: Tables) -> DataFrame:
    title = F.concat("event_type", F.when(F.col("event_id") % 4 == 0, F.lit(" Trailer")).otherwise(""))
    return t.events.select("event_id", scores.classify_video(title, F.lit(""), F.lit(""), F.lit("")).alias("c")).select("event_id", "c.is_book_trailer", "c.confidence")


@query(sql="select doc_id, regexp_matches(lower(text), 'children|child|kids|picture book|illustrated|juvenile|storybook|bedtime|early reader|preschool') as topic from documents")
def topic_signal(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", scores.topic_signal("text").alias("topic"))


@query("leads", sql="select lead_id from leads where lead_tier = 'hot' and lead_score >= 80")
def hot_alert_rows(t: Tables) -> DataFrame:
    return t.leads.where((F.col("lead_tier") == "hot") & (F.col("lead_score") >= 80)).select("lead_id")


@query()
def rule_brief(t: Tables) -> DataFrame:
    s = scores.with_lead_score(star(t), 2026)
    return s.select("lead_id", scores.rule_brief(scores.Row(s.columns)).alias("b")).select("lead_id", "b.*")


@query("leads", "books", sql="select lead_id, 'Dear ' || case when author_name > '' then author_name else 'there' end || ': ' || case when title > '' then title else 'your book' end || ' (' || lead_score || ')' as body from leads join books using (book_id)")
def render_template(t: Tables) -> DataFrame:
    s = t.leads.join(t.books.drop("author_id"), "book_id")
    return s.select("lead_id", scores.render_template(F.lit("Dear {{author_name}}: {{book_title}} ({{lead_score}})"), scores.Row(s.columns)).alias("body"))


@query("leads", "books", "authors", sql=f"with {score_sql(STAR)}, e as (select *, title = '' or author_name = 'Brand House Press' as bad from scored) select lead_id, case when bad then 0 else score end as score, case when bad then 'rejected' else tier end as tier from e")
def gate_and_finalize(t: Tables) -> DataFrame:
    s = star(t)
    errors = F.array_compact(F.array(F.when(~X.present("title"), "title"), F.when(X.corporate_author("author_name"), "company")))
    return scores.with_lead_score(s, 2026).select("lead_id", state.gate(F.col("score"), F.col("tier"), errors).alias("g")).select("lead_id", "g.*")


@query("leads", "books", "authors", sql=f"with {score_sql(STAR)} select lead_id, score as lead_score, tier as lead_tier, case when manual_review_status = 'rejected' and tier <> 'rejected' then 'needs_review' else manual_review_status end as manual_review_status from scored")
def rescore_after_enrich(t: Tables) -> DataFrame:
    scored = scores.with_lead_score(star(t), 2026).select("lead_id", "score", "tier")
    return state.rescore(t.leads.withColumn("lead_score", F.col("lead_score").cast("int")), scored).select("lead_id", "lead_score", "lead_tier", "manual_review_status")


#: Profiles whose address is a catalog's, and fields whose source stands in the evidence.
PROFILE_PAGE = "case when author_id % 5 = 0 then 'https://www.goodreads.com/author/show/1' else contact_page_url end"
FIELDS = ("public_email", "representation_email", "publicist_email", "public_phone")
CLEARED = f"""w as (select * replace ({PROFILE_PAGE} as contact_page_url) from {STAR}), f as (select w.*, {", ".join(f"{c} > '' and not exists (select 1 from evidence e where e.lead_id = w.lead_id and e.field_name = '{c}' and e.field_value = w.{c} and e.source_url > '') as g_{c}" for c in FIELDS)}, coalesce(author_id % 5 = 0 and contact_page_url > '', false) as g_page from w),
g as (select * replace ({", ".join(f"case when g_{c} then '' else {c} end as {c}" for c in FIELDS)}, case when g_page then '' else contact_page_url end as contact_page_url), {" or ".join(f"g_{c}" for c in FIELDS)} or g_page as changed from f)"""


def profile_pages(rows: DataFrame) -> DataFrame:
    return rows.withColumn("contact_page_url", F.expr(PROFILE_PAGE))


@query(
    "leads", "books", "authors", "evidence",
    sql=f"with {CLEARED}, {score_sql('g')} select lead_id, public_email, contact_page_url, case when changed then score else lead_score end as lead_score, case when changed then tier else lead_tier end as lead_tier, case when changed and tier = 'rejected' then 'rejected' else manual_review_status end as manual_review_status from scored",
)
def sanitize_leads(t: Tables) -> DataFrame:
    """Leads after clearing and scoring anew; here a contact is supported by evidence with a source."""
    leads, _ = filters.sanitize_leads(profile_pages(source_flags(t, "s")), flags("s"), 2026)
    return leads.select("lead_id", "public_email", "contact_page_url", F.col("lead_score").cast("bigint").alias("lead_score"), "lead_tier", "manual_review_status")


@query(
    "leads", "books", "authors", "evidence",
    sql=f"with {CLEARED}, p as (select author_id, bool_or(g_page) as page, bool_or(g_representation_email) as agent, bool_or(g_publicist_email) as press from g group by 1) select a.author_id, case when coalesce(page, false) then '' else {PROFILE_PAGE.replace('author_id', 'a.author_id')} end as contact_page_url, case when coalesce(agent, false) then '' else 'agent@desk.example.test' end as representation_email, case when coalesce(press, false) then '' else 'press@press.example.test' end as publicist_email from authors a left join p using (author_id)",
)
def sanitize_profiles(t: Tables) -> DataFrame:
    """Author profiles after the clearing of their leads, of whose contacts only those that a profile has are judged."""
    shared = ("representation_email", "publicist_email")
    rows = profile_pages(t.authors).withColumns({"representation_email": F.lit("agent@desk.example.test"), "publicist_email": F.lit("press@press.example.test")})
    gone = filters.profiles_to_clear(profile_pages(source_flags(t, "s", shared)), flags("s", shared))
    return filters.clear_profiles(rows, gone).select("author_id", "contact_page_url", "representation_email", "publicist_email")


#: URLs of an extraction by a number of the lead, and whether they pass; the names in them are the author's in every second form.
SITE_URL = "case cast(lead_id % 5 as int) when 0 then 'https://www.' || lower(replace(author_name, ' ', '')) || '.test/' when 1 then 'https://shop' || lead_id || '.test/' when 2 then 'https://www.goodreads.com/' || lower(replace(author_name, ' ', '')) when 3 then '' else null end"
SOCIAL_URL = "case cast(lead_id % 3 as int) when 0 then 'https://instagram.com/' || lower(replace(author_name, ' ', '_')) when 1 then 'https://instagram.com/readers_of_tales' else '' end"
PUBLISHER_URL = "case cast(lead_id % 4 as int) when 0 then 'https://quill-press.test/' when 1 then 'https://www.goodreads.com/press' when 2 then 'https://www.amazon.com/dp/B000000001' else null end"


@query(
    "leads", "books",
    sql=f"""with r as (select lead_id, author_name, author_name <> '' as named, {SITE_URL} as site, {SOCIAL_URL} as social, {PUBLISHER_URL} as publisher from leads join books using (book_id))
select lead_id, case when lead_id % 5 = 0 and named then site when lead_id % 5 = 3 then '' end as canonical_website, case when lead_id % 3 = 2 then '' when lead_id % 3 = 0 and named then social end as instagram_url, case when lead_id % 4 = 0 then publisher end as publisher_url,
(coalesce(site, '') > '' and not (lead_id % 5 = 0 and named))::int + (social > '' and not (lead_id % 3 = 0 and named))::int + (lead_id % 4 = 1)::int as n_warnings from r""",
)
def drop_unmatched_urls(t: Tables) -> DataFrame:
    """Site, social and publisher URLs of an extraction after the gate; the listing's own URL is no publisher."""
    rows = t.leads.join(t.books.drop("author_id"), "book_id").select("lead_id", "author_name", F.lit("A tale").alias("title"), F.expr(SITE_URL).alias("canonical_website"), F.expr(SOCIAL_URL).alias("instagram_url"), F.expr(PUBLISHER_URL).alias("publisher_url"), F.lit("https://www.amazon.com/dp/B000000001").alias("canonical_url"))
    return filters.drop_unmatched_urls(rows).select("lead_id", "canonical_website", "instagram_url", "publisher_url", F.size("warnings").alias("n_warnings"))


# ---- contacts and coercion ----
#: What is written behind each text: an address, the same in capitals, one on a blocked domain, one beside a hint of scripts, one without a top-level domain.
WRITTEN = "case cast(doc_id % 5 as int) when 0 then '. Write to a' || doc_id || '@site' || doc_id % 7 || '.test, or A' || doc_id || '@SITE' || doc_id % 7 || '.TEST.' when 1 then ' info@goodreads.com' when 2 then '" + "x" * 130 + " (b' || doc_id || '@other.test)' when 3 then ' sentry c' || doc_id || '@other.test' else ' d@other' end"


@query(sql="select doc_id, case when doc_id % 5 = 0 then 'a' || doc_id || '@site' || doc_id % 7 || '.test' else 'b' || doc_id || '@other.test' end as email from documents where doc_id % 5 in (0, 2)")
def extract_emails(t: Tables) -> DataFrame:
    """The texts' own addresses are on a blocked domain."""
    return t.documents.select("doc_id", F.explode(contacts.extract_emails(F.concat("text", F.expr(WRITTEN)))).alias("email"))


@query()
def extract_phones(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.explode(contacts.extract_phones("text", require_context=False)).alias("phone"))


#: Numbers as they stand: landline, toll-free, premium, fictional, foreign, with brackets, with a word; digits from the candidate's own.
NUMBERS = """case verification_score % 7 when 0 then normalized_value when 1 then '+1800' || substr(normalized_value, 6) when 2 then '+1900' || substr(normalized_value, 6) when 3 then '+121255501' || right(normalized_value, 2)
  when 4 then '+4420' || substr(normalized_value, 6) when 5 then '(212) ' || substr(normalized_value, 6, 3) || '-' || substr(normalized_value, 9) else 'call ' || normalized_value end"""


@query("candidates", sql=f"""select candidate_id, case verification_score % 7 when 5 then '+1212' || substr(normalized_value, 6) when 6 then '' else {NUMBERS} end as e164, case when verification_score % 7 in (0, 3, 5) then 'landline' when verification_score % 7 = 1 then 'toll_free' when verification_score % 7 = 2 then 'premium_rate' else 'unknown' end as line_type,
  case when verification_score % 7 in (4, 6) then '' else 'US' end as region, verification_score % 7 = 3 as is_fake, verification_score % 7 in (0, 1, 4, 5) as valid from candidates where channel = 'phone'""")
def phone_details(t: Tables) -> DataFrame:
    return t.candidates.where("channel = 'phone'").select("candidate_id", contacts.phone_details(F.expr(NUMBERS)).alias("d")).select("candidate_id", "d.e164", "d.line_type", "d.region", "d.is_fake", "d.valid")


#: Numbers of several plans as people write them, right and wrong; digits from the order's number.
PLANNED = """case cast(o_orderkey % 12 as int) when 0 then '+44 20 7946 ' || lpad('' || o_orderkey % 10000, 4, '0') when 1 then '0044 (7700) ' || lpad('' || o_orderkey % 1000000, 6, '0') when 2 then '(212) 2' || lpad('' || o_orderkey % 100, 2, '0') || '-0100 ext. 5' when 3 then '1-800-' || lpad('' || o_orderkey % 10000000, 7, '0')
  when 4 then '+33 6 12 34 56 ' || lpad('' || o_orderkey % 100, 2, '0') when 5 then '+33 612' when 6 then '+49 30 ' || o_orderkey when 7 then '+34 806 ' || lpad('' || o_orderkey % 1000000, 6, '0') when 8 then '+61 1800 ' || lpad('' || o_orderkey % 1000000, 6, '0') when 9 then '+999 12345678'
  when 10 then '+49 170' || lpad('' || o_orderkey % 10000000, 7, '0') else 'call 212 555 ' || o_orderkey end"""
PREFIXES = ", ".join(f"('{k}', '{r}', '{kind}', {n}, {low}, {high})" for k, (r, kind, n, low, high) in contacts.plan_prefixes().items())


@query(
    sql=rf"""with t as (select o_orderkey, trim(regexp_replace({PLANNED}, '\s*ext[.] *[0-9]+$', '')) as raw from orders), d as (select *, regexp_replace(raw, '[^0-9]', '', 'g') as d from t),
f as (select o_orderkey, raw, case when starts_with(raw, '+') then d when starts_with(d, '00') then d[3:] else '1' || regexp_replace(d, '^1', '') end as f from d), p(prefix, region, kind, n, low, high) as (values {PREFIXES}),
m as (select f.*, p.* , row_number() over (partition by o_orderkey order by length(prefix) desc nulls last) as k from f left join p on starts_with(f, prefix)),
r as (select *, coalesce(length(f) - n between low and high, false) and regexp_matches(raw, '^[0-9 ().+/-]+$') as fits from m where k = 1)
select o_orderkey, coalesce(fits and kind <> 'premium_rate', false) as valid, case when fits then '+' || f else '' end as e164, case when fits then kind else 'unknown' end as line_type, case when fits then region else '' end as region from r""",
)
def phone_plans(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", contacts.by_plan(F.expr(PLANNED)).alias("p")).select("o_orderkey", F.coalesce("p.valid", F.lit(False)).alias("valid"), "p.e164", "p.line_type", "p.region")


@query("leads", sql="select lead_id, public_email > '' as valid from leads")
def email_syntax(t: Tables) -> DataFrame:
    return t.leads.select("lead_id", contacts.email_syntax("public_email").alias("valid"))


@query("leads", sql="select lead_id, public_email as plain from leads")
def deobfuscate_email(t: Tables) -> DataFrame:
    hidden = F.replace(F.replace("public_email", F.lit("@"), F.lit(" [at] ")), F.lit("."), F.lit(" (dot) "))
    return t.leads.select("lead_id", contacts.deobfuscate_email(hidden).alias("plain"))


@query("leads", sql="select lead_id, public_email as email from leads where public_email > ''")
def obfuscated_emails(t: Tables) -> DataFrame:
    prose = F.concat(F.lit("write to "), F.replace(F.replace("public_email", F.lit("@"), F.lit(" [at] ")), F.lit("."), F.lit(" [dot] ")), F.lit(" please"))
    return t.leads.where(X.present("public_email")).select("lead_id", F.explode(contacts.obfuscated_emails(prose)).alias("email"))


@query("profiles", sql="select lead_id, max(case when follower_count is null then null else cast(floor(cast(round(follower_count / 1000.0, 1) as double) * 1000.0) as bigint) end) as followers from profiles group by 1")
def follower_count(t: Tables) -> DataFrame:
    words = F.concat(F.lit("about "), F.round(F.col("follower_count") / 1000.0, 1).cast("decimal(20,1)").cast("string"), F.lit("K followers"))
    return t.profiles.select("lead_id", coerce.follower_count(words).alias("f")).groupBy("lead_id").agg(F.max("f").alias("followers"))


@query(sql="select p_partkey, p_size as rating_count, p_size * 1000 as grouped from part")
def int_or_null(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", coerce.int_or_null(F.concat(F.col("p_size").cast("string"), F.lit(".7"))).cast("int").alias("rating_count"), coerce.int_or_null(F.concat(F.col("p_size").cast("string"), F.lit(",000"))).cast("int").alias("grouped"))


@query(sql="select p_partkey, case when p_size <= 5 then cast(p_size as decimal(3, 2)) end as rating, cast(p_size as double) as value from part")
def decimal_or_null(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", coerce.decimal_or_null(F.col("p_size").cast("string")).alias("rating"), coerce.float_or_zero(F.col("p_size").cast("string")).alias("value"))


@query("leads", sql="select lead_id, case verification_status when 'verified' then 'verified' when 'not_verified' then 'not_verified' else 'other' end as status, do_not_contact as dnc, video_status as video from leads")
def status_values(t: Tables) -> DataFrame:
    return t.leads.select("lead_id", coerce.status_value(F.initcap(F.replace("verification_status", F.lit("_"), F.lit(" ")))).alias("status"), coerce.bool_value(F.when(F.col("do_not_contact"), "Yes").otherwise("no")).alias("dnc"), coerce.video_status_value(F.initcap(F.replace("video_status", F.lit("_"), F.lit(" ")))).alias("video"))


@query(sql="select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as iso, strftime(o_orderdate, '%Y-%m') as ym, cast(year(o_orderdate) as int) as y from orders")
def clean_pub_date(t: Tables) -> DataFrame:
    long = F.date_format("o_orderdate", "MMMM d, yyyy")
    return t.orders.select("o_orderkey", coerce.clean_pub_date(long).alias("iso"), coerce.clean_pub_date(F.date_format("o_orderdate", "yyyy/M")).alias("ym"), coerce.publication_year(long).alias("y"))


@query("leads", sql="select lead_id, round_even((least(greatest(extraction_confidence, 0), 1) + 0.85) / 2, 2) as merged from leads")
def merge_confidence(t: Tables) -> DataFrame:
    return t.leads.select("lead_id", coerce.merge_confidence("extraction_confidence", F.lit("high")).alias("merged"))


@query("books", sql="select book_id, rating as rating, cast(review_count as bigint) as reviews from books")
def rating_from_text(t: Tables) -> DataFrame:
    return t.books.select("book_id", coerce.rating_of_text(F.concat(F.col("rating").cast("decimal(3,1)").cast("string"), F.lit(" out of 5 stars"))).alias("rating"), coerce.review_count_of_text(F.concat(F.format_number("review_count", 0), F.lit(" ratings"))).alias("reviews"))


@query(sql="select event_id, json_extract_string(props, '$.k') as k, '' as missing from events")
def json_state_fields(t: Tables) -> DataFrame:
    return t.events.select("event_id", coerce.state_field("props", "k").alias("k"), coerce.state_field("props", "none").alias("missing"))


#: Rows of a sheet by a number of the lead: in place; the name beside a phone; the address in its proof column, with and without another proof.
SHEET = {
    "author_name": "case when lead_id % 4 = 1 then 'Verified children author' else 'Alex Maple' end", "phone": "case when lead_id % 4 = 1 then 'Kim Rowan' else public_phone end", "email": "case when lead_id % 4 > 1 then 'none' else public_email end",
    "email_proof": "case when lead_id % 4 > 1 then public_email else 'https://x.example.test/m' end", "phone_proof": "case when lead_id % 4 = 2 then 'https://x.example.test/p' else '' end",
}
CELLS = ["lead_id", *(f"{v} as {k}" for k, v in SHEET.items())]


@query("leads", sql=f"""with s as (select {', '.join(CELLS)} from leads) select lead_id, case when lead_id % 4 = 1 then 'Kim Rowan' else author_name end as author_name, case when lead_id % 4 = 1 then '' else phone end as phone,
  case when lead_id % 4 > 1 then email_proof else email end as email, case when lead_id % 4 > 1 and email_proof > '' then phone_proof else email_proof end as email_proof, case when email_proof > '' and lead_id % 4 > 1 then '' else phone_proof end as phone_proof from s""")
def repair_shifted_columns(t: Tables) -> DataFrame:
    sheet = t.leads.selectExpr(*CELLS)
    return coerce.repair_shifted(sheet)


# ---- pages ----
@query()
def page_facts(t: Tables) -> DataFrame:
    return pages.page_facts(pages.parse_pages(t.pages))


@query()
def page_links(t: Tables) -> DataFrame:
    return pages.page_links(pages.parse_pages(t.pages))


#: What is added to every page: a mail link, links of contact intent and others, social profiles, forms, an attribute with a phone.
CONTACTS = """'<p>Write <a href="mailto:A' || page_id || '@site' || page_id % 7 || '.test?subject=x">us</a></p><a href="/contact-' || page_id || '">Write</a><a href="/contact-' || page_id || '">again</a><a href="/files/press.pdf">Press</a><a href="/">Contact</a><a href="/x/' || page_id || '">Book an event</a>'
 || '<a href="https://other' || page_id % 9 || '.test/contact">Elsewhere</a><a href="https://www.instagram.com/a' || page_id || '">I</a><a href="https://instagram.com/b">J</a>' || case when page_id % 2 = 0 then '<a href="https://youtu.be/' || page_id || '">V</a>' else '' end
 || '<form action="/send#top" id="contact-form"><input name="email"><textarea name="message"></textarea></form><form action="/find" id="search"><input name="q"></form><form action="/say"><input name="email">' || case when page_id % 3 = 0 then '<textarea name="message"></textarea>' else '' end || '</form><span data-phone="+1 (212) 2' || lpad('' || page_id % 100, 2, '0') || '-0000"></span>'"""
ROOT = "regexp_extract(url, '^(https?://[^/?#]+)', 1)"


def parsed_with_contacts(t: Tables) -> DataFrame:
    return pages.parse_pages(t.pages.withColumn("html", F.concat("html", F.expr(CONTACTS))))


@query(sql=f"select page_id, {ROOT} || '/contact-' || page_id || ' ' || {ROOT} || '/x/' || page_id as links from pages")
def contact_links(t: Tables) -> DataFrame:
    return pages.contact_links(pages.page_links(parsed_with_contacts(t))).select("page_id", F.array_join("contact_links", " ").alias("links"))


@query(sql="select page_id, 'https://other' || page_id % 9 || '.test/contact' as links from pages")
def external_links(t: Tables) -> DataFrame:
    return pages.external_links(pages.page_links(parsed_with_contacts(t))).select("page_id", F.array_join("external_links", " ").alias("links"))


@query(sql="select page_id, 'instagram_url=https://www.instagram.com/a' || page_id || case when page_id % 2 = 0 then ' youtube_url=https://youtu.be/' || page_id else '' end as socials from pages")
def social_links(t: Tables) -> DataFrame:
    """The first link of each platform."""
    found = pages.social_links(pages.page_links(parsed_with_contacts(t)))
    return found.select("page_id", F.array_join(F.transform(F.map_entries("socials"), lambda x: F.concat_ws("=", x["key"], x["value"])), " ").alias("socials"))


@query(sql=f"select page_id, {ROOT} || '/send' as action, 'contact_form' as kind, 'email message' as fields from pages union all select page_id, {ROOT} || '/say', 'generic_form', 'email message' from pages where page_id % 3 = 0")
def contact_forms(t: Tables) -> DataFrame:
    return pages.contact_forms(parsed_with_contacts(t)).select("page_id", "action", "kind", F.array_join("fields", " ").alias("fields"))


@query(sql="select page_id, 'email' as field, 'a' || page_id || '@site' || page_id % 7 || '.test' as value from pages union all select page_id, 'phone', '+12122' || lpad('' || page_id % 100, 2, '0') || '0000' from pages")
def hidden_contacts(t: Tables) -> DataFrame:
    return pages.hidden_contacts(parsed_with_contacts(t))


#: Hosts of official pages: another's, one of a blocked part, the author's; paths with and without a hint; titles that name the author or not.
OFFICIAL_URL = """'https://' || case when page_id % 3 = 0 then 'quiet' when page_id % 7 = 0 then 'alexmaple-news' else 'alexmaple' end || '.test/' || case when page_id % 11 = 0 then 'x' else 'about' end || page_id"""


@query(
    sql="""select page_id, case when page_id % 5 = 0 or page_id % 10 = 3 then '' else 'a' || page_id || '@site.test' end as email, case when page_id % 5 = 1 then '' else '+12122000000' end as phone, case when page_id % 2 = 0 then 0.78 else 0.68 end as confidence
from pages where (page_id % 9 = 0 or (page_id % 3 <> 0 and page_id % 7 <> 0)) and page_id % 11 <> 0""",
)
def contact_match(t: Tables) -> DataFrame:
    """Contacts of pages that are the author's own by site or title, official and not blocked."""
    words = "'Home of Alex Maple, who wrote ' || case when page_id % 2 = 0 then 'The Owl, A Tale' else 'tales' end || '. Contact: ' || case when page_id % 5 = 0 then '' when page_id % 10 = 3 then 'support@site.test' else 'a' || page_id || '@site.test' end || case when page_id % 5 = 1 then '' else ' phone 212-200-0000 ' end"
    title = F.expr("case when page_id % 9 = 0 then 'Alex Maple' else 'Home' end")
    rows = t.pages.select("page_id", F.expr(OFFICIAL_URL).alias("url"), title.alias("title"), F.expr(words).alias("page_text"), F.lit("Alex Maple").alias("author_name"), F.lit("The Owl: a tale").alias("book_title"))
    return pages.contact_match(rows).select("page_id", "email", "phone", F.col("confidence").cast("double").alias("confidence"))


@query()
def author_from_page(t: Tables) -> DataFrame:
    return pages.parse_pages(t.pages).select("page_id", pages.author_from_page("h1", "h2", "title", F.lit("")).alias("author"))


# ---- files and catalogs ----
@query("books", sql="select '' || book_id as id, title, case when author_name > '' then author_name else 'x' end as author_name from books")
def header_alias_projection(t: Tables) -> DataFrame:
    """Columns under odd headers, read through the aliases."""
    raw = t.books.select(F.col("book_id").cast("string").alias("Notes"), F.col("title").alias("Book / Project"), F.col("author_name").alias("Author"), F.lit("x").alias("Author / Owner"))
    out = files.project_aliases(files.with_normal_headers(raw), ["notes", "title", "author_name"])
    return out.withColumnRenamed("notes", "id").withColumn("title", F.col("title"))


@query(sql="select o_custkey as file, case when o_custkey % 2 = 0 then 2 else 1 end as header_idx from orders group by 1")
def detect_header_row(t: Tables) -> DataFrame:
    """A grid per customer: title lines, the header, rows."""
    grid = t.orders.select(F.col("o_custkey").alias("file")).distinct().select("file", F.posexplode(F.array(F.array(F.lit("Leads")), F.when(F.col("file") % 2 == 0, F.array(F.lit("of the week"))).otherwise(F.array(F.lit("Title"), F.lit("Author"), F.lit("Phone"))), F.array(F.lit("Book Name"), F.lit("Author / Owner"), F.lit("x")))).alias("row_idx", "cells"))
    return files.detect_header_row(grid)


@query("books", sql="select distinct amazon_book_url as url from books where amazon_book_url > ''")
def seed_urls_explode(t: Tables) -> DataFrame:
    rows = t.books.select(F.col("amazon_book_url").alias("author_website"), F.lit("").alias("contact_page_url"), F.lit("").alias("contact_source_url"), F.col("amazon_book_url").alias("all_source_urls"), "author_name", "amazon_book_url", "asin", F.lit("").alias("public_email"), F.lit("").alias("public_phone"), F.lit("").alias("phone_or_email"), F.col("book_id").alias("ord"))
    return files.seed_urls(rows).select("url")


@query("books", sql="select '' || book_id as isbn, title, author_name as authors from books where title > '' and author_name > ''")
def catalog_records(t: Tables) -> DataFrame:
    """Payloads as a catalog sends them, read back into records."""
    rows = t.books.where("title > '' and author_name > ''")
    payload = F.to_json(F.struct("title", F.array(F.struct(F.col("author_name").alias("name"))).alias("authors")))
    payloads = rows.select(F.col("book_id").cast("string").alias("isbn"), F.lit("open_library").alias("provider"), payload.alias("payload"))
    return catalogs.catalog_records(payloads).select("isbn", "title", F.array_join("authors", "; ").alias("authors"))


@query()
def volume_candidates(t: Tables) -> DataFrame:
    payload = F.to_json(F.struct("title", F.array("author_name").alias("authors"), F.col("publication_date").alias("publishedDate"), F.lit("a picture book for children").alias("description")))
    return catalogs.volume_candidates(t.books.select(F.col("book_id").alias("volume_id"), payload.alias("payload")))


#: Codes of editions: right ones, of which the numbers from 1500 repeat, and a tenth with a wrong check digit.
EDITION = f"with c as (select *, '978' || lpad('' || (book_id % 1500), 9, '0') as s from books), e as (select *, s || ({CHECK13} + case when book_id % 10 = 3 then 1 else 0 end) % 10 as isbn, try_cast(publication_date as int) as y from c)"


@query("books", sql=f"{EDITION}, g as (select isbn, min(book_id) as doc_id from e where book_id % 10 <> 3 and y between 2000 and 2020 group by isbn) select doc_id, y as year from g join e on doc_id = book_id")
def edition_candidates(t: Tables) -> DataFrame:
    s = F.concat(F.lit("978"), F.lpad((F.col("book_id") % 1500).cast("string"), 9, "0"))
    total = sum((F.substring(s, i, 1).cast("int") * (1 if i % 2 else 3) for i in range(1, 13)), F.lit(0))
    isbn = F.concat(s, (((10 - total % 10) % 10 + F.when(F.col("book_id") % 10 == 3, 1).otherwise(0)) % 10).cast("string"))
    docs = t.books.select(F.col("book_id").alias("doc_id"), "title", F.array("author_name").alias("author_names"), F.array("asin", isbn).alias("isbns"), F.array(F.col("publication_date").try_cast("int")).alias("years"))
    return catalogs.edition_candidates(docs, 2000, 2020).select("doc_id", "year")


@query()
def import_rows(t: Tables) -> DataFrame:
    """Leads as an upload, split into five tables; the candidates."""
    rows = t.leads.join(t.books.drop("author_id"), "book_id").select(F.col("lead_id").cast("string").alias("row_id"), "title", "author_name", "asin", "public_email", "public_phone", F.lit("https://p.example.test").alias("public_email_source_url"), F.lit("").alias("public_phone_source_url"), "verification_status", F.lit("").alias("author_website"), F.lit("").alias("contact_page_url"))
    return state.import_rows(rows)["candidates"]


# ---- discovery ----
def results_of_books(t: Tables) -> DataFrame:
    """A search result for each book, as an engine shows it."""
    name = F.when(X.present("author_name"), F.col("author_name")).otherwise("Robin Example")
    rows = t.books.withColumn("_name", name)
    return rows.select("book_id", F.col("book_id").alias("result_id"), F.lit(1).alias("ord"), F.concat("title", F.lit(" by "), "_name").alias("title"), F.concat(F.lit("A picture book by "), "_name", F.lit(". Contact "), F.lower(F.replace("_name", F.lit(" "), F.lit("."))), F.lit("@mail.test")).alias("snippet"), F.col("amazon_book_url").alias("url"), "author_name", F.col("title").alias("book_title"))


@query("books", sql="select book_id as result_id, case when asin > '' then asin else 'B000000001' end as asin from books where amazon_book_url > '' and author_name <> 'Brand House Press'")
def parse_listing_candidate(t: Tables) -> DataFrame:
    from ..operators import discovery

    return discovery.listing_candidates(results_of_books(t)).select("result_id", "asin")


@query()
def recover_missing_author(t: Tables) -> DataFrame:
    from ..operators import discovery

    return discovery.recover_missing_author(t.books.withColumn("book_data_confidence", F.lit(0.5)), results_of_books(t))


@query()
def snippet_contacts(t: Tables) -> DataFrame:
    from ..operators import discovery

    return discovery.snippet_contacts(results_of_books(t).withColumn("kind", F.lit("author_site")))


#: Profiles of the author in full, by surname and title, of somebody else, by surname alone.
PROFILES = """case book_id % 4 when 0 then author_name when 1 then split_part(author_name, ' ', 2) || ' wrote ' || title when 2 then 'Someone' else split_part(author_name, ' ', 2) end || ' has ' || book_id || ' followers. Write to me@mail.test'"""


@query("books", sql=f"""with r as (select book_id, {NORM.format(f"({PROFILES}) || ' https://instagram.com/x'")} as plain, list_filter(string_split({NORM.format('author_name')}, ' '), lambda x: x > '') as own, list_filter(string_split({NORM.format('title')}, ' '), lambda x: len(x) >= 4) as tw from books),
h as (select *, len(own) > 0 and (contains(plain, array_to_string(own, ' ')) or contains(replace(plain, ' ', ''), array_to_string(own, '')) or (len(own[-1]) >= 4 and contains(plain, own[-1]) and len(tw) > 0 and len(list_filter(tw, lambda x: contains(plain, x))) >= least(2, len(tw)))) as hit from r)
select book_id as lead_id, case when hit then 90 else 30 end as identity_score, book_id as follower_count, case when hit then 1 else 0 end as contacts from h""")
def profile_audit(t: Tables) -> DataFrame:
    from ..operators import discovery

    rows = t.books.select(F.col("book_id").alias("lead_id"), F.lit("instagram").alias("platform"), F.lit("https://instagram.com/x").alias("profile_url"), F.expr(PROFILES).alias("profile_text"), "author_name", "title")
    return discovery.profile_audit(rows).select("lead_id", "identity_score", "follower_count", F.size("contacts").alias("contacts"))


@query("books", sql="select book_id as person_id, author_name as label, case when book_id % 2 = 0 then 0.8 else 0.65 end as confidence from books where author_name <> ''")
def entity_profiles(t: Tables) -> DataFrame:
    from ..operators import match

    people = t.books.select(F.col("book_id").alias("person_id"), F.col("author_name").alias("name"))
    entities = t.books.select(F.col("book_id").alias("person_id"), F.lit(1).alias("ord"), F.col("author_name").alias("label"), (F.col("book_id") % 2 == 0).alias("hint"))
    return match.entity_profiles(people, entities).select("person_id", "label", "confidence")


@query()
def site_lead_rows(t: Tables) -> DataFrame:
    """Pages of each author's site, with the listings of their books."""
    site = F.col("author_id").alias("site")
    person = F.when(X.present("author_name"), F.col("author_name")).otherwise("Robin Example")
    of = t.books.select(site, F.col("book_id").alias("pos"), F.concat(F.lit("https://a.test/"), F.col("book_id").cast("string")).alias("url"), F.concat(F.lit("books for children; contact me@mail.test "), "title").alias("page_text"), person.alias("h1"), F.lit("").alias("h2"), "title")
    links = t.books.where(X.present("amazon_book_url")).select(site, F.col("book_id").alias("pos"), F.col("amazon_book_url").alias("href"))
    return pages.site_lead_rows(of, links)
