"""Point queries of the serving API."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGE_SIZE = 50


def of_dump(rows: DataFrame, *, wiki_name: str | None = None, dump_date: str | None = None) -> DataFrame:
    """The rows of one wiki and dump date of a store, which prunes its partitions; None leaves a key open.

    Wikis and dumps number their pages anew, so a lookup by id in a store of
    several has to name them; a store of one may leave them out.
    """
    for key, value in (("wiki_name", wiki_name), ("dump_date", dump_date)):
        if value is not None:
            rows = rows.filter(F.col(key) == value)
    return rows


def latest_dump(page: DataFrame, wiki_name: str) -> str | None:
    """The newest dump date of a wiki."""
    return page.filter(F.col("wiki_name") == wiki_name).agg(F.max("dump_date")).first()[0]


def page_id(page: DataFrame, title: str, **dump: str | None) -> int | None:
    row = of_dump(page, **dump).filter(F.col("page_title") == title).select("page_id").orderBy("page_id").first()
    return row and row[0]


def page_title(page: DataFrame, id_: int, **dump: str | None) -> str | None:
    row = of_dump(page, **dump).filter(F.col("page_id") == id_).select("page_title").first()
    return row and row[0]


def is_redirect(page: DataFrame, title: str, **dump: str | None) -> bool | None:
    """None for an unknown page."""
    row = of_dump(page, **dump).filter(F.col("page_title") == title).select("is_redirect").first()
    return row and row[0]


def links(page: DataFrame, link: DataFrame, id_: int, *, incoming: bool = False, number: int = 1, **dump: str | None) -> DataFrame:
    """The ``number``-th PAGE_SIZE links of a page with titles (null where unknown)."""
    page, link = of_dump(page, **dump), of_dump(link, **dump)
    key, value = ("page_link", "page_id") if incoming else ("page_id", "page_link")
    rows = link.filter(F.col(key) == id_).select(F.col(value).alias("linked_id")).orderBy("linked_id").offset((number - 1) * PAGE_SIZE).limit(PAGE_SIZE)
    titles = page.select(F.col("page_id").alias("linked_id"), "page_title")
    return rows.join(titles, "linked_id", "left")


def degree(link: DataFrame, id_: int, **dump: str | None) -> DataFrame:
    return of_dump(link, **dump).filter((F.col("page_id") == id_) | (F.col("page_link") == id_)).agg(F.count_if(F.col("page_id") == id_).alias("num_links"), F.count_if(F.col("page_link") == id_).alias("times_linked"))


def neighbours(page: DataFrame, link: DataFrame, id_: int, *, sort: str = "times_linked", limit: int | None = None, **dump: str | None) -> DataFrame:
    """Linked pages with their degrees, the highest ``sort`` first; only their own links are counted."""
    if sort not in ("num_links", "times_linked"):
        raise ValueError(f"unknown sort {sort!r}")
    page, link = of_dump(page, **dump), of_dump(link, **dump)
    near = link.filter(F.col("page_id") == id_).select(F.col("page_link").alias("linked_id"))
    rows = near
    for by, name in (("page_id", "num_links"), ("page_link", "times_linked")):
        own = link.select(F.col(by).alias("linked_id")).join(near, "linked_id", "left_semi")
        rows = rows.join(own.groupBy("linked_id").agg(F.count("*").alias(name)), "linked_id", "left")
    rows = rows.select("linked_id", F.coalesce("num_links", F.lit(0)).alias("num_links"), F.coalesce("times_linked", F.lit(0)).alias("times_linked"))
    rows = rows.orderBy(F.desc(sort), "linked_id")
    rows = rows.limit(limit) if limit else rows
    return rows.join(page.select(F.col("page_id").alias("linked_id"), "page_title"), "linked_id", "left")


def pages_with_prefix(page: DataFrame, prefix: str, *, limit: int = 100, wildcards: bool = False) -> DataFrame:
    """Pages whose title starts with ``prefix``, case ignored.

    With ``wildcards`` the prefix is a LIKE pattern, in which ``_`` and ``%``
    stand for any character and any text.
    """
    found = F.lower("page_title").like(prefix.lower() + "%") if wildcards else F.lower("page_title").startswith(prefix.lower())
    return page.filter(found).orderBy("page_title", "page_id").limit(limit)


def similar_titles(page: DataFrame, text: str, *, limit: int = 20) -> DataFrame:
    rows = page.withColumn("distance", F.levenshtein(F.lower("page_title"), F.lit(text.lower())))
    return rows.orderBy("distance", "page_id").limit(limit)


def popular_pages(views: DataFrame, page: DataFrame, n: int) -> DataFrame:
    """The n most viewed articles that exist, namespaced titles left out."""
    rows = views.filter(~F.col("article").contains(":")).join(page.select(F.col("page_title").alias("article"), "page_id"), "article")
    return rows.orderBy("rank", "page_id").limit(n)
