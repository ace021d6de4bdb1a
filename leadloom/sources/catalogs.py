"""Catalog payloads (JSON text, one row each) to candidate records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.coerce import publication_year, year_in_window
from ..functions.ids import analyze_identifier, best_isbn, canonical_book_key
from ..functions.text import first_present, has_any, present, text, valid_person_name

#: Payload schemas by provider.
SCHEMAS = {
    "open_library": "url string, title string, authors array<struct<name:string>>, publishers array<struct<name:string>>, publish_date string, cover struct<large:string,medium:string,small:string>",
    "google_books": "items array<struct<volumeInfo:struct<title:string,authors:array<string>,publisher:string,publishedDate:string,description:string,canonicalVolumeLink:string,infoLink:string,industryIdentifiers:array<struct<identifier:string>>,imageLinks:struct<large:string,medium:string,thumbnail:string>>>>",
    "crossref": "message struct<items:array<struct<DOI:string,URL:string,title:array<string>,author:array<struct<given:string,family:string,name:string>>,publisher:string,ISBN:array<string>,abstract:string,published:struct<`date-parts`:array<array<int>>>>>>",
    "internet_archive": "response struct<docs:array<struct<identifier:string,title:string,creator:array<string>,date:string,publisher:string,description:string>>>",
    "wikidata": "results struct<bindings:array<struct<item:struct<value:string>,title:struct<value:string>,itemLabel:struct<value:string>,authorLabel:struct<value:string>,publisherLabel:struct<value:string>,date:struct<value:string>>>>",
}
RECORD = ["provider", "source_url", "title", "authors", "publisher", "publication_date", "cover_image_url", "description"]
NONE = F.array


def plain(c: Column) -> Column:
    """Without tags, entities of spaces, or double spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(text(c), r"<[^>]+>|&nbsp;", " "), r"\s+", " "))


def names(c: Column) -> Column:
    return F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(text(x))), lambda x: x != "")


def first(c: Column) -> Column:
    return F.coalesce(F.try_element_at(c, F.lit(1)), F.lit(""))


def catalog_records(payloads: DataFrame) -> DataFrame:
    """payloads (isbn, provider, payload) as one record each: providers that list several items give the first that carries the identifier (or, where they list none, the first)."""
    base = payloads.select("isbn", "provider", "payload")
    of = lambda p: base.where(F.col("provider") == p).withColumn("j", F.from_json("payload", SCHEMAS[p]))
    codes = analyze_identifier("isbn")
    same = F.array_compact(F.array(F.nullif(codes["canonical"], F.lit("")), F.nullif(codes["isbn10"], F.lit("")), F.nullif(codes["isbn13"], F.lit(""))))
    clean_code = lambda x: F.upper(F.regexp_replace(x, r"[^0-9A-Za-z]", ""))

    def record(df: DataFrame, url: Column, title: Column, authors: Column, publisher: Column, date: Column, cover: Column, about: Column) -> DataFrame:
        cells = dict(zip(RECORD[1:], (url, F.trim(text(title)), authors, F.trim(text(publisher)), F.trim(text(date)), text(cover), about), strict=True))
        return df.select("isbn", "provider", *(c.alias(k) for k, c in cells.items())).where(present("title"))

    ol = of("open_library")
    j = F.col("j")
    out = record(ol, first_present(j["url"], F.concat(F.lit("https://openlibrary.org/isbn/"), F.col("isbn"))), j["title"], names(j["authors"]["name"]), first(names(j["publishers"]["name"])), j["publish_date"], first_present(j["cover"]["large"], j["cover"]["medium"], j["cover"]["small"]), F.lit(""))
    items = F.filter(j["items"], lambda x: F.arrays_overlap(F.transform(x["volumeInfo"]["industryIdentifiers"], lambda y: clean_code(y["identifier"])), same))
    gb = of("google_books").withColumn("v", F.try_element_at(items, F.lit(1))["volumeInfo"])
    v = F.col("v")
    out = out.unionByName(record(gb, first_present(v["canonicalVolumeLink"], v["infoLink"]), v["title"], names(v["authors"]), v["publisher"], v["publishedDate"], F.regexp_replace(first_present(v["imageLinks"]["large"], v["imageLinks"]["medium"], v["imageLinks"]["thumbnail"]), "^http://", "https://"), F.trim(text(v["description"]))))
    fits = F.filter(j["message"]["items"], lambda x: (F.coalesce(F.size(x["ISBN"]), F.lit(0)) <= 0) | F.arrays_overlap(F.transform(x["ISBN"], clean_code), same))
    cr = of("crossref").withColumn("v", F.try_element_at(F.filter(fits, lambda x: present(F.try_element_at(x["title"], F.lit(1)))), F.lit(1)))
    people = names(F.transform(v["author"], lambda a: first_present(F.trim(F.concat_ws(" ", a["given"], a["family"])), a["name"])))
    year = F.try_element_at(F.try_element_at(v["published"]["date-parts"], F.lit(1)), F.lit(1)).cast("string")
    out = out.unionByName(record(cr, first_present(v["URL"], F.concat(F.lit("https://doi.org/"), v["DOI"])), first(v["title"]), people, v["publisher"], year, F.lit(""), F.left(plain(v["abstract"]), F.lit(1000))))
    ia = of("internet_archive").withColumn("v", F.try_element_at(F.filter(j["response"]["docs"], lambda x: present(x["title"]) & present(x["identifier"])), F.lit(1)))
    out = out.unionByName(record(ia, F.concat(F.lit("https://archive.org/details/"), v["identifier"]), v["title"], names(v["creator"]), v["publisher"], F.coalesce(publication_year(v["date"]).cast("string"), F.lit("")), F.concat(F.lit("https://archive.org/services/img/"), v["identifier"]), F.left(plain(v["description"]), F.lit(1000))))
    wd = of("wikidata").withColumn("b", j["results"]["bindings"])
    b = F.col("b")
    pick = lambda k: first(names(b[k]["value"]))
    people = F.array_distinct(F.filter(names(b["authorLabel"]["value"]), lambda a: ~a.rlike(r"^Q\d+$")))
    out = out.unionByName(record(wd, first_present(pick("item"), F.lit("https://www.wikidata.org")), first_present(pick("title"), pick("itemLabel")), people, pick("publisherLabel"), F.coalesce(publication_year(pick("date")).cast("string"), F.lit("")), F.lit(""), F.lit("")).where(~F.col("title").rlike(r"^Q\d+$")))
    return out


def best_isbn_of_fields(*fields: Column) -> Column:
    """The best identifier of several arrays of raw codes."""
    return best_isbn(F.flatten(F.array(*(F.coalesce(f, F.array().cast("array<string>")) for f in fields))))


VOLUME = "title string, subtitle string, authors array<string>, publisher string, publishedDate string, description string, categories array<string>, language string, imageLinks struct<thumbnail:string>, industryIdentifiers array<struct<identifier:string>>"


def volume_candidates(volumes: DataFrame) -> DataFrame:
    """volumes (volume_id, payload): title with subtitle, first valid author, topic present, additive confidence .55 to .95; first per identifier, else per title and author."""
    rows = volumes.withColumn("v", F.from_json("payload", VOLUME))
    v = F.col("v")
    title = F.concat_ws(": ", F.nullif(F.trim(text(v["title"])), F.lit("")), F.nullif(F.trim(text(v["subtitle"])), F.lit("")))
    author = first(F.filter(names(v["authors"]), lambda n: valid_person_name(n)))
    code = best_isbn(F.transform(F.coalesce(v["industryIdentifiers"], F.array().cast("array<struct<identifier:string>>")), lambda x: x["identifier"]))
    topic = has_any(F.concat_ws(" ", title, text(v["description"]), F.concat_ws(" ", v["categories"])), fixed.TOPIC_HINTS)
    score = F.lit(0.55) + F.when(code != "", 0.15).otherwise(0.0) + F.when(author != "", 0.1).otherwise(0.0) + F.when(present(v["publishedDate"]), 0.05).otherwise(0.0) + F.when(present(v["description"]), 0.05).otherwise(0.0) + F.when(present(v["imageLinks"]["thumbnail"]), 0.05).otherwise(0.0)
    return rows.select("volume_id", title.alias("title"), author.alias("author_name"), code.alias("code"), text(v["publishedDate"]).alias("publication_date"), F.least(F.round(score, 2), F.lit(0.95)).alias("confidence"), topic.alias("_topic")).where(F.col("_topic") & present("title")).drop("_topic")


def edition_candidates(docs: DataFrame, start: int | None, end: int | None) -> DataFrame:
    """docs (doc_id, title, author_names, isbns, years): best identifier, newest year inside the window (dropped if there is none), first of each identifier."""
    inside = F.filter("years", lambda y: (y >= (start or 0)) & (y <= (end or 9999)))
    rows = docs.select("doc_id", "title", first(names(F.col("author_names"))).alias("author_name"), best_isbn(F.col("isbns")).alias("code"), F.array_max(inside).alias("year"))
    good = rows.where(F.col("year").isNotNull() & (F.col("code") != ""))
    keep = good.groupBy("code").agg(F.min("doc_id").alias("doc_id"))
    return good.join(keep, ["code", "doc_id"], "left_semi")


KEYWORD = {
    "crossref": SCHEMAS["crossref"],
    "internet_archive": "response struct<docs:array<struct<identifier:string,title:string,creator:string,date:string,publisher:string,isbn:string>>>",
}


def listed(c: Column) -> Column:
    """The trimmed non-blank strings of a field that holds a string or a JSON list of strings."""
    many = F.when(F.trim(text(c)).startswith("["), F.from_json(c, "array<string>")).otherwise(F.array(c))
    return names(many)


def keyword_catalog_candidates(payloads: DataFrame, start: int | None, end: int | None, most: int = 25) -> DataFrame:
    """payloads (keyword, provider, payload) of two catalogs' searches: one row per listed code of ten or thirteen characters, in order, years strictly inside the window, at most `most` rows a payload; of equal codes (either form) of a keyword the first by provider and place."""
    codes = lambda c: F.filter(F.transform(c, lambda x: F.regexp_replace(x, "[^0-9Xx]", "")), lambda x: F.length(x).isin(10, 13))
    nothing = F.array().cast("array<string>")

    def rows(provider: str, items: Column, row) -> DataFrame:
        df = payloads.where(F.col("provider") == provider).withColumn("j", F.from_json("payload", KEYWORD[provider]))
        made = F.filter(F.transform(F.coalesce(items, F.array().cast(df.select(items.alias("x")).schema["x"].dataType)), row), lambda r: (r["title"] != "") & r["ok"] & year_in_window(r["publication_date"], start, end, lenient=False))
        each = F.flatten(F.transform(made, lambda r: F.transform(r["codes"], lambda code: F.struct(code.alias("code"), *(r[k].alias(k) for k in ("title", "author_name", "publication_date", "publisher", "cover_image_url", "source_url", "confidence"))))))
        return df.select("keyword", "provider", F.posexplode(F.slice(each, 1, most)).alias("pos", "r")).select("keyword", "provider", "pos", "r.*")

    def of_crossref(x: Column) -> Column:
        people = names(F.transform(F.coalesce(x["author"], F.array().cast("array<struct<given:string,family:string,name:string>>")), lambda a: first_present(F.trim(F.concat_ws(" ", F.nullif(a["given"], F.lit("")), F.nullif(a["family"], F.lit("")))), a["name"])))
        year = text(F.try_element_at(F.try_element_at(x["published"]["date-parts"], F.lit(1)), F.lit(1)))
        url = first_present(x["URL"], F.when(present(x["DOI"]), F.concat(F.lit("https://doi.org/"), x["DOI"])), F.lit("https://api.crossref.org"))
        title = F.trim(text(F.try_element_at(x["title"], F.lit(1))))
        return F.struct(codes(F.coalesce(x["ISBN"], nothing)).alias("codes"), F.lit(True).alias("ok"), title.alias("title"), first(people).alias("author_name"), year.alias("publication_date"), F.trim(text(x["publisher"])).alias("publisher"), F.lit("").alias("cover_image_url"), url.alias("source_url"), F.lit(0.66).alias("confidence"))

    def of_archive(x: Column) -> Column:
        ident = F.trim(text(x["identifier"]))
        at = lambda place: F.concat(F.lit(f"https://archive.org/{place}/"), ident)
        year = F.coalesce(publication_year(first(listed(x["date"]))).cast("string"), F.lit(""))
        return F.struct(codes(listed(x["isbn"])).alias("codes"), (ident != "").alias("ok"), first(listed(x["title"])).alias("title"), first(listed(x["creator"])).alias("author_name"), year.alias("publication_date"), first(listed(x["publisher"])).alias("publisher"), at("services/img").alias("cover_image_url"), at("details").alias("source_url"), F.lit(0.6).alias("confidence"))

    out = rows("crossref", F.col("j")["message"]["items"], of_crossref).unionByName(rows("internet_archive", F.col("j")["response"]["docs"], of_archive))
    keyed = out.withColumn("_key", first_present(canonical_book_key("code"), F.upper("code")))
    best = keyed.groupBy("keyword", "_key").agg(F.min_by(F.struct(*out.columns), F.struct("provider", "pos", "source_url")).alias("r"))
    return best.select("r.*")


__all__ = ["best_isbn_of_fields", "catalog_records", "edition_candidates", "keyword_catalog_candidates", "volume_candidates", "SCHEMAS"]
