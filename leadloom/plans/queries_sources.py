"""Queries of candidates from catalogs, directories and searches, of query plans, contact records and briefs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, scores
from ..functions import text as X
from ..functions.lineage import shared_dir
from ..operators import discovery
from ..sources import catalogs, directory, pages
from ..streaming import ingest
from .queries_tables import NORM
from .registry import Tables, query

IN_WINDOW = "(publication_date = '' or cast(publication_date as int) between 2000 and 2020)"


@query(
    "leads",
    sql="""select lead_id as page_id, case when lead_id % 2 = 0 then 'https://s' || (lead_id % 11) || '.example.test/contact' end as contact_page_url, nullif(public_email, '') as public_email, nullif(public_phone, '') as public_phone,
      case when lead_id % 5 = 0 then 'instagram_url' else '' end as socials, (public_email > '')::int + (public_phone > '')::int + (lead_id % 5 = 0)::int as evidence,
      case when public_email > '' or public_phone > '' or lead_id % 5 = 0 then 0.65 else 0.25 end as confidence, case when public_email > '' or public_phone > '' or lead_id % 5 = 0 then '' else 'No public contact data found on s' || (lead_id % 11) || '.example.test.' end as warnings from leads""",
)
def page_contact_record(t: Tables) -> DataFrame:
    """A page of each lead's site, with its contacts in the text and a profile among the links."""
    site = F.concat(F.lit("https://s"), (F.col("lead_id") % 11).cast("string"), F.lit(".example.test"))
    said = F.concat(F.when(X.present("public_email"), F.concat(F.lit("Write to "), F.col("public_email"), F.lit(" soon. "))).otherwise(""), F.when(X.present("public_phone"), F.concat(F.lit("Call "), F.col("public_phone"), F.lit(" to talk."))).otherwise("The author of books."))
    links = F.array_compact(F.array(F.when(F.col("lead_id") % 5 == 0, F.struct(F.concat(F.lit("https://instagram.com/a"), F.col("lead_id").cast("string")).alias("href"), F.lit("me").alias("anchor")))))
    rows = t.leads.select(F.col("lead_id").alias("page_id"), site.alias("website"), F.concat(site, F.when(F.col("lead_id") % 2 == 0, "/contact").otherwise("/about")).alias("url"), said.alias("page_text"), links.alias("links"))
    return pages.page_contact_record(rows).select("page_id", "contact_page_url", "public_email", "public_phone", F.array_join(F.map_keys("socials"), " ").alias("socials"), F.size("evidence").alias("evidence"), "confidence", F.array_join("warnings", " ").alias("warnings"))


@query(
    "books",
    sql=f"""select book_id as result_id, code, publication_date, 'web' as source from (select *, case when asin > '' then asin when book_id % 5 = 0 then '9780306406157' when amazon_book_url > '' then 'B000000001' end as code from books)
      where code is not null and {IN_WINDOW}""",
)
def search_candidate(t: Tables) -> DataFrame:
    """Results with a listing URL, an ISBN in the snippet, or a listing id in another site's URL."""
    snippet = F.concat(F.lit("Out in "), F.col("publication_date"), F.when(F.col("book_id") % 5 == 0, F.lit(", ISBN 978-0-306-40615-7")).otherwise(""))
    rows = t.books.select(F.col("book_id").alias("result_id"), F.concat("title", F.lit(" by "), "author_name").alias("title"), snippet.alias("snippet"), F.col("amazon_book_url").alias("url"))
    return discovery.search_candidates(rows, "web", 2000, 2020).select("result_id", "code", "publication_date", "source")


@query("books", sql=f"select book_id as record_id, asin as code, title, author_name, publication_date, case when book_id % 2 = 0 then 0.9 else 0.65 end as book_data_confidence from books where asin > '' and {IN_WINDOW}")
def catalog_candidate(t: Tables) -> DataFrame:
    rows = t.books.select(F.col("book_id").alias("record_id"), "asin", "title", "author_name", "publication_date", F.when(F.col("book_id") % 2 == 0, 0.9).alias("book_data_confidence"))
    return discovery.catalog_candidates(rows, "catalog", 2000, 2020).select("record_id", "code", "title", "author_name", "publication_date", "book_data_confidence")


def plans_sql() -> str:
    """The query plans as SQL: each template by position, distinct per plan, numbered again."""
    fill = "replace(replace(replace(replace({}, '{{pair}}', pair), '{{author}}', author_name), '{{tail}}', tail), '{{title}}', title)"
    say = lambda form: fill.format("'" + form.replace("'", "''") + "'")
    turns = [form for forms in zip(*fixed.AUTHOR_SEARCHES.values(), strict=True) for form in forms]
    titled = f"{NORM.format('title')} <> '' and not ({NORM.format('title')} = lower(asin) and asin > '')"
    meta = [f"case when {titled} then '\"' || title || '\" author' end", f"case when {titled} then '\"' || title || '\" \"by\"' end", f"case when {titled} and asin > '' then '\"' || asin || '\" \"' || title || '\"' end", "case when asin > '' then '\"' || asin || '\" author' end"]
    parts = [("discovery", list(map(say, turns)), "author_name > ''"), ("deep", list(map(say, fixed.DEEP_SEARCHES)), "author_name > ''"), ("video", list(map(say, fixed.VIDEO_SEARCHES)), "true"), ("metadata", meta, "true")]
    each = " union all ".join(f"select book_id, '{name}' as plan, unnest([{', '.join(cells)}]) as query, unnest(range({len(cells)})) as i from b where {where}" for name, cells, where in parts)
    return f"""with b as (select *, '"' || author_name || '"' || tail as pair from (select *, case when anchor > '' then ' "' || anchor || '"' else '' end as tail
        from (select *, case when title like 'The %' then regexp_extract(title, '^The (.*) \\(Large', 1) || ' (Large' else title end as anchor from books))),
      q as ({each}), once as (select book_id, plan, query, min(i) as i from q where query is not null group by all)
      select book_id, plan, row_number() over (partition by book_id, plan order by i) - 1 as pos, query from once"""


@query("books", sql=plans_sql())
def contact_query_rows(t: Tables) -> DataFrame:
    return discovery.contact_query_rows(t.books)


@query(
    "books",
    sql="""select 'k' || (book_id // 10) as keyword, case when book_id % 3 <> 0 then 'crossref' else 'internet_archive' end as provider, lpad('' || book_id, 10, '0') as code, title, author_name, publication_date, case when book_id % 3 <> 0 then 0.66 else 0.6 end as confidence
      from books where (book_id % 3 <> 0 or book_id % 2 = 0) and title > '' and publication_date > '' and cast(publication_date as int) between 1995 and 2020""",
)
def keyword_catalog_candidates(t: Tables) -> DataFrame:
    """Payloads of ten books each, as two catalogs send them, that share books."""
    code = F.lpad(F.col("book_id").cast("string"), 10, "0")
    keyword = F.concat(F.lit("k"), F.floor(F.col("book_id") / 10).cast("string")).alias("keyword")
    person = F.struct(F.lit("").alias("given"), F.col("author_name").alias("family"))
    year = F.col("publication_date").try_cast("int")
    item = F.struct("book_id", F.array("title").alias("title"), F.array(person).alias("author"), F.array(code).alias("ISBN"), F.struct(F.array(F.array(year)).alias("date-parts")).alias("published"))
    cr = t.books.where("book_id % 3 <> 0").groupBy(keyword).agg(F.to_json(F.struct(F.struct(F.array_sort(F.collect_list(item)).alias("items")).alias("message"))).alias("payload"))
    doc = F.struct("book_id", F.concat(F.lit("i"), code).alias("identifier"), "title", F.array("author_name").alias("creator"), F.concat(F.lit("in "), F.col("publication_date")).alias("date"), code.alias("isbn"))
    ia = t.books.where("book_id % 2 = 0").groupBy(keyword).agg(F.to_json(F.struct(F.struct(F.array_sort(F.collect_list(doc)).alias("docs")).alias("response"))).alias("payload"))
    rows = cr.select("keyword", F.lit("crossref").alias("provider"), "payload").unionByName(ia.select("keyword", F.lit("internet_archive").alias("provider"), "payload"))
    return catalogs.keyword_catalog_candidates(rows, 1995, 2020).select("keyword", "provider", "code", "title", "author_name", "publication_date", "confidence")


def browse_pages(t: Tables) -> DataFrame:
    """A directory's pages of twenty projects each."""
    who = F.when(X.present("author_name"), F.concat(F.lit("<div>by "), "author_name", F.lit("</div>"))).otherwise("")
    key = F.col("book_id").cast("string")
    card = F.concat(F.lit('<li><a href="/project/book-'), key, F.lit('?from=list"><b>'), "title", F.lit('</b></a><a href="/project/book-'), key, F.lit('">More</a>'), who, F.lit('<p>About the book.</p><img src="/c/'), key, F.lit('.png"></li>'))
    html = F.concat(F.lit("<html><body><ul>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("book_id", card.alias("card")))), lambda x: x["card"]), ""), F.lit("</ul></body></html>"))
    return t.books.groupBy(F.floor(F.col("book_id") / 20).alias("page_id")).agg(html.alias("html")).withColumn("url", F.concat(F.lit("https://shelf.example.test/browse/"), F.col("page_id").cast("string")))


def detail_pages(t: Tables) -> DataFrame:
    """The pages of every other project."""
    key = F.col("book_id").cast("string")
    html = F.concat(F.lit('<html><h1 class="public-project-title">'), "title", F.lit(' II</h1><div class="public-project-credit"><a href="/profile/'), key, F.lit('">Robin Rowan</a>, author</div><div class="public-project-synopsis">A longer text about number '), key, F.lit(".</div></html>"))
    return t.books.where("book_id % 2 = 0").select(F.concat(F.lit("https://shelf.example.test/project/book-"), key).alias("url"), html.alias("html"))


@query("books", sql="select book_id // 20 as page_id, 'https://shelf.example.test/project/book-' || book_id as project_url, title, author_name, 'About the book.' as snippet, 'https://shelf.example.test/c/' || book_id || '.png' as cover_image_url, case when author_name > '' then 0.78 else 0.62 end as confidence from books where title > ''")
def directory_cards(t: Tables) -> DataFrame:
    return directory.directory_cards(browse_pages(t))


@query("books", sql="select 'https://shelf.example.test/project/book-' || book_id as project_url, case when book_id % 2 = 0 then title || ' II' else title end as title, case when book_id % 2 = 0 then 'Robin Rowan' else author_name end as author_name, case when book_id % 2 = 0 then 'A longer text about number ' || book_id || '.' else 'About the book.' end as snippet from books where title > ''")
def directory_details(t: Tables) -> DataFrame:
    cards = directory.directory_cards(browse_pages(t))
    return directory.merge_details(cards, directory.project_details(detail_pages(t))).select("project_url", "title", "author_name", "snippet")


@query("books", sql="select book_id as result_id, case when title = '' then 'Book' else title end as title, case when author_name = 'Brand House Press' then '' else author_name end as author_name, case when author_name in ('', 'Brand House Press') then 0.5 else 0.68 end as confidence from books where book_id % 4 <> 3")
def directory_results(t: Tables) -> DataFrame:
    """Results of the directory's site; every fourth is no project."""
    url = F.concat(F.lit("https://shelf.example.test/"), F.when(F.col("book_id") % 4 == 3, "help/book-").otherwise("project/book-"), F.col("book_id").cast("string"))
    rows = t.books.select(F.col("book_id").alias("result_id"), F.concat("title", F.lit(" | Example, the directory")).alias("title"), F.concat(F.lit("A work by "), "author_name", F.lit(". More")).alias("snippet"), url.alias("url"))
    return directory.directory_results(rows, "example.test").select("result_id", "title", "author_name", "confidence")


@query(
    "books",
    sql="""with c as (select *, row_number() over (partition by asin order by case when book_id % 7 = 0 then 0 else 1 + book_id % 2 end, book_id) as n from books where asin > '' and author_name > '' and publication_date > '' and cast(publication_date as int) >= 2000)
      select asin as code, title, author_name, publication_date from c where n = 1 and book_id % 7 <> 0""",
)
def incremental_keyword_ingest(t: Tables) -> DataFrame:
    """Two batches into a keyword's store that holds a first one; the new books."""
    import uuid

    good = t.books.where("asin > '' and author_name > '' and publication_date > '' and cast(publication_date as int) >= 2000")
    rows = good.select(F.col("book_id").alias("ord"), F.col("asin").alias("code"), "title", "author_name", "publication_date", F.lit("listing").alias("source"))
    spark = t.books.sparkSession
    store = f"{shared_dir(spark)}/keywords-{uuid.uuid4().hex}"
    ingest.ingest_keyword(spark, store, "Kids books", 2000, None, [("catalog", rows.where("ord % 7 = 0"))])
    batches = [(kind, rows.where(f"ord % 7 <> 0 and ord % 2 = {i}")) for i, kind in enumerate(["web", "catalog"])]
    return ingest.ingest_keyword(spark, store, "kids books", 2000, None, batches, only_new=True).select("code", "title", "author_name", "publication_date")


@query("leads", sql="select lead_id, batch from (select lead_id, cast(lead_id % 3 as int) as batch, public_email, row_number() over (partition by public_email order by lead_id % 3, created_at, lead_id) as n from leads) where n = 1 or public_email = ''")
def incremental_lead_ingest(t: Tables) -> DataFrame:
    """All leads in three batches by address into a store with bucketed keys; a batch is run again, as after a failure."""
    import uuid

    spark = t.leads.sparkSession
    store = f"{shared_dir(spark)}/leads-{uuid.uuid4().hex}"
    keys, order = F.array("public_email"), F.struct("created_at", "lead_id")
    for number in (0, 1, 1, 2):
        ingest.write_batch(t.leads.where(F.col("lead_id") % 3 == number), store, keys, order, number, buckets=16, bits=1 << 16)
    return spark.read.parquet(store).select("lead_id", F.col("batch").cast("int").alias("batch"))


def brief_sql() -> str:
    field = {
        "video_text": "case video_status when 'no_public_video_found' then 'No public video found in searched sources.' when 'not_checked' then 'Not checked' when 'unclear' then 'Unclear' else 'Found trailer' end",
        "fit_reason": "'Tier ' || lead_tier", "sales_agent_summary": "'Lead ' || lead_id", "book_data_confidence": "'0.5'", "video_confidence": "''", "suggested_pitch_angle": "''", "suggested_first_line": "'Hello'", "what_to_say": "''", "what_not_to_say": "''", "facebook_url": "''",
        "identity_confidence": "cast(identity_confidence as varchar)", "extraction_confidence": "cast(extraction_confidence as varchar)",
    }
    import re

    def line(form: str) -> str:
        cells = []
        for i, x in enumerate(re.split(r"\{([^}]*)\}", form)):
            *names, last = x.split("|")
            cells.append("'" + x + "'" if i % 2 == 0 else "coalesce(" + ", ".join([f"nullif({field.get(n, n)}, '')" for n in names or [last]] + [f"'{last if names else ''}'"]) + ")")
        return " || ".join(cells)

    nl = " || chr(10) || "
    body = (nl + "chr(10) || ").join(nl.join([f"'## {head}'", *map(line, lines)]) for head, lines in fixed.BRIEF)
    return f"select lead_id, '# Lead Brief' || chr(10) || chr(10) || {body} || chr(10) || chr(10) || '## Source Links' || chr(10) || case when amazon_book_url > '' then '- ' || amazon_book_url else '- Missing' end || chr(10) as brief from leads join (select * exclude (author_id) from books) using (book_id) left join authors using (author_id)"


@query("leads", "books", "authors", sql=brief_sql())
def brief_rows(t: Tables) -> DataFrame:
    rows = t.leads.join(t.books.drop("author_id"), "book_id").join(t.authors, "author_id", "left")
    rows = rows.withColumns({"fit_reason": F.concat(F.lit("Tier "), "lead_tier"), "sales_agent_summary": F.concat(F.lit("Lead "), F.col("lead_id").cast("string")), "book_data_confidence": F.lit(0.5), "suggested_first_line": F.lit("Hello")})
    links = F.array_compact(F.array(F.nullif(F.col("amazon_book_url"), F.lit(""))))
    return rows.select("lead_id", scores.brief_markdown(scores.Row(rows.columns), links).alias("brief"))
