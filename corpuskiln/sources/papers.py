"""Paper records from Atom feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.common import none_if_empty, or_empty, strip

ENTRY = (
    "id string, title string, summary string, published string, author array<struct<name:string>>, "
    "link array<struct<_href:string,_rel:string,_title:string,_type:string>>, category array<struct<_term:string>>"
)


def parse_feed(feeds: DataFrame, xml_col: str = "xml") -> DataFrame:
    """One row for every titled entry of Atom documents: title, authors, abstract, categories, arxiv_url, pdf_link, published, arxiv_id.

    Line feeds in titles and abstracts become spaces. The page link is the last one that is `alternate`,
    or untitled with abs in it, else the id; the pdf link is the last one titled pdf or of that type."""
    entries = F.regexp_extract_all(or_empty(F.col(xml_col)), F.lit(r"(?s)(<entry[\s>].*?</entry>)"), 1)
    entry = feeds.select(*[c for c in feeds.columns if c != xml_col], F.posexplode(entries).alias("pos", "entry_xml"))
    e = entry.withColumn("e", F.from_xml("entry_xml", ENTRY))
    flat = lambda c: F.replace(strip(or_empty(c)), F.lit("\n"), F.lit(" "))
    links = F.coalesce(F.col("e.link"), F.array().cast("array<struct<_href:string,_rel:string,_title:string,_type:string>>"))
    page = F.filter(links, lambda x: (or_empty(x["_rel"]) == "alternate") | ((or_empty(x["_title"]) == "") & F.contains(or_empty(x["_href"]), F.lit("abs"))))
    pdf = F.filter(links, lambda x: (or_empty(x["_title"]) == "pdf") | (or_empty(x["_type"]) == "application/pdf"))
    last = lambda a: or_empty(F.try_element_at(a, F.lit(-1))["_href"])
    full_id = strip(or_empty(F.col("e.id")))
    names = F.transform(F.coalesce("e.author", F.array().cast("array<struct<name:string>>")), lambda a: strip(or_empty(a["name"])))
    return e.select(
        *[c for c in feeds.columns if c != xml_col], "pos", flat(F.col("e.title")).alias("title"), names.alias("authors"), flat(F.col("e.summary")).alias("abstract"),
        F.transform(F.coalesce("e.category", F.array().cast("array<struct<_term:string>>")), lambda c: or_empty(c["_term"])).alias("categories"),
        F.coalesce(none_if_empty(last(page)), full_id).alias("arxiv_url"), last(pdf).alias("pdf_link"), F.substring(strip(or_empty(F.col("e.published"))), 1, 10).alias("published"),
        F.when(F.contains(full_id, F.lit("/abs/")), F.substring_index(full_id, "/abs/", -1)).otherwise(full_id).alias("arxiv_id"),
    ).where("title <> ''")


def paper_text(title: Column, authors: Column, published: Column, abstract: Column, page: Column | None = None, most: int = 8000) -> Column:
    """Header and abstract, and the page's text if there is room for it; cut at `most`."""
    base = F.format_string("Title: %s\nAuthors: %s\nPublished: %s\n\n%s", strip(or_empty(title)), F.array_join(authors, ", "), or_empty(published), strip(or_empty(abstract)))
    more = F.lit("") if page is None else F.when((F.char_length(base) < most) & (or_empty(page) != ""), F.concat(F.lit("\n\n"), page)).otherwise("")
    return F.substring(F.concat(base, more), 1, most)
