"""File sources: lead files, header discovery, tabs, batch folders, the keyword store."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import fixed
from ..functions.coerce import year_in_window
from ..functions.ids import book_code
from ..functions.text import blank, first_present, keyword_slug, normalize_text, present, text


def normal_header(name: str) -> str:
    import re

    return re.sub(r"[^a-z0-9]+", " ", (name or "").strip().lower()).strip()


def with_normal_headers(df: DataFrame) -> DataFrame:
    """Columns renamed to their normal form; of names that fall together the first is kept, blank names are dropped."""
    seen: dict[str, str] = {}
    for c in df.columns:
        seen.setdefault(normal_header(c), c)
    return df.select(*(F.col(f"`{c}`").alias(n) for n, c in seen.items() if n))


def drop_empty(df: DataFrame) -> DataFrame:
    return df.where(reduce(lambda a, b: a | b, (present(F.col(f"`{c}`")) for c in df.columns), F.lit(False)))


def read_lead_files(spark: SparkSession, path: str) -> DataFrame:
    """UTF-8 CSV (a byte-order mark is dropped), all strings, normal headers, rows without values left out."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return drop_empty(with_normal_headers(raw))


def project_aliases(df: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Canonical fields: the first non-empty value among a field's aliases, in order; blank if none is there."""
    have = set(df.columns)

    def field(name: str) -> Column:
        own = [a for a in dict.fromkeys(map(normal_header, fixed.HEADER_ALIASES[name])) if a in have]
        return (first_present(*(F.trim(text(F.col(f"`{a}`"))) for a in own)) if own else F.lit("")).alias(name)

    return df.select(*map(field, fields or fixed.HEADER_ALIASES))


def detect_header_row(grid: DataFrame, most: int = 25) -> DataFrame:
    """grid (file, row_idx, cells): per file the row, among the first `most`, with a title and an author alias and the most known aliases; ties: the earliest."""
    known = {k: sorted(set(map(normal_header, v))) for k, v in fixed.HEADER_ALIASES.items()}
    names = F.array(*(F.lit(x) for x in sorted({a for v in known.values() for a in v})))
    cells = F.array_distinct(F.transform("cells", lambda c: F.trim(F.regexp_replace(F.lower(F.trim(text(c))), "[^a-z0-9]+", " "))))
    rows = grid.where(F.col("row_idx") < most).withColumn("_c", cells)
    has = lambda k: F.arrays_overlap(F.col("_c"), F.array(*map(F.lit, known[k])))
    hits = rows.where(has("title") & has("author_name")).withColumn("_n", F.size(F.array_intersect("_c", names)))
    return hits.groupBy("file").agg(F.max_by("row_idx", F.struct("_n", -F.col("row_idx"))).alias("header_idx"))


def grid_rows(grid: DataFrame, headers: DataFrame) -> DataFrame:
    """(file, row_idx, values): rows below the header as maps of normal header to cell; rows without values left out."""
    head = grid.join(headers, "file").where("row_idx = header_idx").select("file", "header_idx", F.col("cells").alias("_h"))
    rows = grid.join(head, "file").where("row_idx > header_idx")
    normal = F.transform("_h", lambda c: F.trim(F.regexp_replace(F.lower(F.trim(text(c))), "[^a-z0-9]+", " ")))
    pairs = F.filter(F.arrays_zip(normal.alias("k"), F.transform("cells", lambda c: F.trim(text(c))).alias("v")), lambda x: F.coalesce(x["k"] > "", F.lit(False)))
    first = F.map_from_entries(F.aggregate(pairs, F.array().cast("array<struct<k:string,v:string>>"), lambda a, x: F.when(F.exists(a, lambda y: y["k"] == x["k"]), a).otherwise(F.array_append(a, F.struct(x["k"].alias("k"), F.coalesce(x["v"], F.lit("")).alias("v"))))))
    return rows.select("file", "row_idx", first.alias("values")).where(F.exists(F.map_values("values"), lambda v: v > ""))


def reassemble_tabs(books: DataFrame, authors: DataFrame, contacts: DataFrame, outreach: DataFrame, order: str = "ord") -> DataFrame:
    """Rows of books with author and outreach values over them (the last row of an id wins), the first phone and mail contact where absent."""
    last = lambda df: df.withColumn("_n", F.row_number().over(Window.partitionBy("lead id").orderBy(F.desc(order)))).where("_n = 1").drop("_n", order)
    out = books
    for tab in (last(authors), last(outreach)):
        other = tab.select("lead id", *(F.col(f"`{c}`").alias(f"_{c}") for c in tab.columns if c != "lead id"), F.lit(True).alias("_there"))
        joined = out.join(other, "lead id", "left")
        old = [F.when(F.col("_there"), F.col(f"`_{c}`")).otherwise(F.col(f"`{c}`")).alias(c) if f"_{c}" in other.columns else F.col(f"`{c}`") for c in out.columns]
        new = [F.col(f"`{c}`").alias(c[1:]) for c in other.columns if c not in {"lead id", "_there"} and c[1:] not in out.columns]
        out = joined.select(*old, *new)
    kind = normalize_text("contact type")
    item = F.struct(text("contact value").alias("v"), text("source url").alias("u"))
    of = lambda word: F.min_by(item, F.when(F.contains(kind, F.lit(word)), F.col(order)))
    first = contacts.groupBy("lead id").agg(of("phone").alias("_p"), of("email").alias("_e"))
    joined = out.join(first, "lead id", "left")
    pairs = {"public phone": "_p.v", "phone source url": "_p.u", "public email": "_e.v", "email source url": "_e.u"}
    return joined.select(*(c if c not in pairs else F.coalesce(F.col(f"`{c}`"), F.col(pairs[c]), F.lit("")).alias(c) for c in out.columns), *(F.coalesce(F.col(v), F.lit("")).alias(c) for c, v in pairs.items() if c not in out.columns))


def read_batch_dir(spark: SparkSession, folder: str) -> DataFrame:
    """All batch_*.csv of a folder, with `_file` for their order."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("pathGlobFilter", "batch_*.csv").csv(folder)
    return raw.withColumn("_file", F.col("_metadata.file_name"))


def seed_rows(spark: SparkSession, path: str) -> DataFrame:
    """CSV rows with trimmed, lower-case headers."""
    raw = spark.read.option("header", True).option("escape", '"').csv(path)
    return raw.toDF(*(c.strip().lower() for c in raw.columns))


SEED_URLS = ["author_website", "contact_page_url", "contact_source_url"]


def seed_urls(rows: DataFrame, order: str = "ord") -> DataFrame:
    """(url, lead): distinct http(s) URLs of three columns and a `;` list; the lead of the last complete row, else NULL."""
    urls = F.concat(F.array(*(F.trim(text(c)) for c in SEED_URLS)), F.transform(F.split(text("all_source_urls"), ";"), lambda x: F.trim(x)))
    contact = first_present("public_email", "public_phone", "phone_or_email")
    complete = present("author_name") & present("amazon_book_url") & present("asin") & (contact != "")
    lead = F.struct("author_name", "amazon_book_url", "asin", contact.alias("contact"))
    each = rows.select(F.explode(F.array_distinct(urls)).alias("url"), F.when(complete, lead).alias("lead"), F.when(complete, F.col(order)).alias("_o")).where(F.col("url").rlike("^https?://"))
    return each.groupBy("url").agg(F.max_by("lead", "_o").alias("lead"))


STORE = T.StructType([T.StructField(c, T.StringType()) for c in ("keyword", "code", "title", "author_name", "publication_date", "source")])


def save_keyword_results(rows: DataFrame, path: str, keyword: str, start: int | None, end: int | None) -> None:
    """Write rows (STORE without keyword) into the store, one partition per keyword and window; a partition is replaced as a whole."""
    years = f"{start or 'any'}-{end or 'any'}"
    first = Window.partitionBy("code").orderBy("source", "title")
    unique = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    out = unique.withColumns({"keyword": F.lit(keyword), "slug": keyword_slug(F.lit(keyword)), "years": F.lit(years)})
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slug", "years").parquet(path)


def load_keyword_results(spark: SparkSession, path: str, keyword: str, start: int | None, end: int | None) -> DataFrame:
    """Stored rows of a keyword and window that are still valid: same keyword, a valid code, an author, the year inside (unknown only without bounds)."""
    years = f"{start or 'any'}-{end or 'any'}"
    rows = spark.read.parquet(path).where((F.col("slug") == keyword_slug(F.lit(keyword))) & (F.col("years") == years) & (F.lower(F.trim("keyword")) == keyword.strip().lower()))
    dated = year_in_window("publication_date", start, end, lenient=not (start or end))
    return rows.where((book_code("code") != "") & ~blank("author_name") & dated).drop("slug", "years")


__all__ = [n for n in dir() if n[0].islower() and n not in {"annotations", "reduce", "fixed", "year_in_window", "book_code", "blank", "first_present", "keyword_slug", "normalize_text", "present", "text"}]
