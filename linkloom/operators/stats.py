"""Per-wiki statistics and their roll-ups.

``page`` has wiki_name, page_id, page_title, is_redirect; ``link`` has
wiki_name, page_id, page_link; both may have a dump_date. Every wiki and dump
date numbers its pages from 1, so all joins and groups are keyed by them; a
link leads to a page of its own wiki. Ties go to the smaller id or name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import cut

GLOBAL = "global"
KEYS = ("dump_date", "wiki_name")


def keys(rows: DataFrame, *more: str) -> list[str]:
    """The columns that tell wikis and dumps apart, and ``more``."""
    return [*(c for c in KEYS if c in rows.columns), *more]


def with_global(rows: DataFrame, *aggregates: Column) -> DataFrame:
    """Aggregates per wiki and over all wikis (of each dump date, if there is one), in one pass."""
    if "dump_date" in rows.columns:
        found = rows.groupingSets([["dump_date", "wiki_name"], ["dump_date"]], "dump_date", "wiki_name").agg(*aggregates)
    else:
        found = rows.rollup("wiki_name").agg(*aggregates)
    return found.withColumn("wiki_name", F.coalesce("wiki_name", F.lit(GLOBAL)))


def page_counts(page: DataFrame) -> DataFrame:
    return with_global(page, F.count("*").alias("num_pages"), F.count_if("is_redirect").alias("num_redirects"))


def link_counts(link: DataFrame) -> DataFrame:
    return with_global(link, F.count("*").alias("num_links"))


def _targets(link: DataFrame) -> DataFrame:
    return link.select(*keys(link), F.col("page_link").alias("page_id"))


def linked_redirects(page: DataFrame, link: DataFrame) -> DataFrame:
    """Links (not pages) that lead to a redirect."""
    redirects = page.filter("is_redirect").select(*keys(page, "page_id"))
    return with_global(_targets(link).join(redirects, keys(link, "page_id"), "left_semi"), F.count("*").alias("num_linked_redirects"))


def dead_pages(page: DataFrame, link: DataFrame) -> DataFrame:
    """Pages without outgoing links."""
    return page.join(link.select(*keys(link, "page_id")), keys(link, "page_id"), "left_anti").select(*page.columns)


def orphan_pages(page: DataFrame, link: DataFrame) -> DataFrame:
    """Pages that no link leads to."""
    return page.join(_targets(link), keys(link, "page_id"), "left_anti").select(*page.columns)


def dead_orphans(page: DataFrame, link: DataFrame) -> DataFrame:
    return orphan_pages(dead_pages(page, link), link)


def with_degrees(page: DataFrame, link: DataFrame) -> DataFrame:
    """Pages with n_out and n_in (null: none): each end of the links is summed once before it meets the pages."""
    out = link.groupBy(*keys(link, "page_id")).agg(F.count("*").alias("n_out"))
    into = _targets(link).groupBy(*keys(link, "page_id")).agg(F.count("*").alias("n_in"))
    rows = page.select(*keys(page, "page_id", "is_redirect"))
    return rows.join(out, keys(link, "page_id"), "left").join(into, keys(link, "page_id"), "left")


def _missing() -> list[Column]:
    dead, orphan = F.col("n_out").isNull(), F.col("n_in").isNull()
    return [F.count_if(dead).alias("num_dead"), F.count_if(orphan).alias("num_orphan"), F.count_if(dead & orphan).alias("num_dead_orphan")]


def missing_counts(page: DataFrame, link: DataFrame) -> DataFrame:
    """num_dead, num_orphan and num_dead_orphan, from one join with both degrees."""
    return with_global(with_degrees(page, link), *_missing())


def degrees(link: DataFrame, by: str) -> DataFrame:
    """Number of links of each page: by page_id the outgoing, by page_link the incoming ones."""
    return link.select(*keys(link), F.col(by).alias("page_id")).groupBy(*keys(link, "page_id")).agg(F.count("*").alias("n"))


def top_degrees(page: DataFrame, link: DataFrame, by: str, k: int = 10) -> DataFrame:
    """The k pages of all wikis with most links ``by`` page_id (outgoing) or page_link; titles join after the limit."""
    top = degrees(link, by).orderBy(F.desc("n"), *keys(link, "page_id")).limit(k)
    return top.join(page.select(*keys(page, "page_id", "page_title")), keys(link, "page_id"), "left").select("page_id", "page_title", "n", *keys(link))


def top_degrees_by_wiki(link: DataFrame, by: str, k: int = 10) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys(link)).orderBy(F.desc("n"), "page_id"))
    return degrees(link, by).withColumn("place", place).filter(F.col("place") <= k)


def top_lists(page: DataFrame, link: DataFrame, by: str, k: int = 10) -> DataFrame:
    """(wiki_name, pages): the k pages with most links of every wiki and, under the name of all, of all wikis.

    The total's list is taken from the wikis' lists, so its input is k rows a wiki.
    """
    per = top_degrees_by_wiki(link, by, k).drop("place")
    per = per.join(page.select(*keys(page, "page_id", "page_title")), keys(link, "page_id"), "left")
    entry = F.struct(F.col("page_id"), F.col("page_title"), F.col("wiki_name"), F.col("n").alias("count"))
    order = F.struct(-F.col("n"), F.col("wiki_name"), F.col("page_id"))
    rows = per.select(*keys(link), order.alias("o"), entry.alias("e"))
    lists = with_global(rows, F.sort_array(F.collect_list(F.struct("o", "e"))).alias("l"))
    return lists.withColumn("pages", F.transform(F.slice("l", 1, k), lambda x: x["e"])).drop("l")


def _longest(page: DataFrame, redirects: bool) -> DataFrame:
    """``longest_titles`` with the title's own wiki (of_wiki), which differs where all wikis are meant."""
    rows = page if redirects else page.filter("not is_redirect")
    first = F.max_by(F.struct("page_id", "page_title"), F.struct(F.length("page_title"), -F.col("page_id")))
    per = rows.groupBy(*keys(page)).agg(first.alias("p")).select(*keys(page), "p.page_id", "p.page_title", F.col("wiki_name").alias("of_wiki"))
    dates = [k for k in keys(page) if k != "wiki_name"]
    best = F.min_by(F.struct("page_id", "page_title", "of_wiki"), F.struct(-F.octet_length("page_title"), "page_id", "wiki_name"))
    over_all = per.groupBy(*dates).agg(best.alias("p")).filter("p is not null").select(*dates, F.lit(GLOBAL).alias("wiki_name"), "p.page_id", "p.page_title", "p.of_wiki")
    return per.union(over_all)


def longest_titles(page: DataFrame, *, redirects: bool = True) -> DataFrame:
    """Per wiki the longest title by characters, and over all wikis (of a dump date) the longest of these by bytes."""
    return _longest(page, redirects).drop("of_wiki")


def degree_histogram(link: DataFrame, by: str = "page_id") -> DataFrame:
    return degrees(link, by).groupBy(F.col("n").alias("degree")).agg(F.count("*").alias("num_pages"))


def summary(page: DataFrame, link: DataFrame) -> DataFrame:
    """All counts of every wiki and of all together, one row a wiki: one pass over pages with their degrees, one over links."""
    to_redirects = F.sum(F.when(F.col("is_redirect"), F.col("n_in"))).alias("num_linked_redirects")
    counts = with_global(with_degrees(page, link), F.count("*").alias("num_pages"), F.count_if("is_redirect").alias("num_redirects"), to_redirects, *_missing())
    out = counts.join(link_counts(link), keys(page), "left")
    names = ("num_pages", "num_redirects", "num_links", "num_linked_redirects", "num_dead", "num_orphan", "num_dead_orphan")
    return out.select(*keys(page), *(F.coalesce(c, F.lit(0)).alias(c) for c in names))


def extremes(summary: DataFrame, stat: str) -> DataFrame:
    """Wikis with the most and the least of a statistic (of each dump date, if there is one), the total left out."""
    rows = summary.filter(F.col("wiki_name") != GLOBAL)
    most = F.min_by(F.struct("wiki_name", F.col(stat).alias("value")), F.struct(-F.col(stat), F.col("wiki_name")))
    least = F.min_by(F.struct("wiki_name", F.col(stat).alias("value")), F.struct(F.col(stat), F.col("wiki_name")))
    dates = [k for k in keys(summary) if k != "wiki_name"]
    rows = rows.groupBy(*dates).agg(most.alias("most"), least.alias("least"))
    return rows.select(*dates, F.lit(stat).alias("stat"), F.col("most.wiki_name").alias("max_wiki"), F.col("most.value").alias("max_value"), F.col("least.wiki_name").alias("min_wiki"), F.col("least.value").alias("min_value"))


# Names of a document's counts, and the columns of a summary that they have (fixed values of the format).
DOCUMENT_COUNTS = {
    "num_pages": "num_pages",
    "num_redirects": "num_redirects",
    "num_links": "num_links",
    "num_linked_redirects": "num_linked_redirects",
    "num_dead_pages": "num_dead",
    "num_orphan_pages": "num_orphan",
    "num_dead_orphan_pages": "num_dead_orphan",
}


def document(
    page: DataFrame,
    link: DataFrame,
    *,
    created_at: str,
    dump_date: str,
    seconds_taken: int = 0,
    k: int = 10,
    bfs_samples: DataFrame | None = None,
    pair_samples: DataFrame | None = None,
    web_sizes: DataFrame | None = None,
    local_sizes: DataFrame | None = None,
) -> DataFrame:
    """One JSON document (column value) with all statistics of one dump date.

    Counts, top lists and longest names are maps from wiki to value.
    ``bfs_samples`` and ``pair_samples`` have wiki_name and a struct column
    sample; sizes have wiki_name and byte counts, and tables they were summed
    over; what is not given is null. An extreme is an array of wiki and value.
    Of tables with a dump_date only the rows of ``dump_date`` count.
    """
    page, link = (rows.filter(F.col("dump_date") == dump_date).drop("dump_date") if "dump_date" in rows.columns else rows for rows in (page, link))
    total = cut(summary(page, link))
    wikis = F.sort_array(F.collect_set(F.when(F.col("wiki_name") != GLOBAL, F.col("wiki_name"))))

    def by_wiki(name: str, value: Column) -> Column:
        return F.map_from_entries(F.sort_array(F.collect_list(F.struct("wiki_name", value.alias("v"))))).alias(name)

    counts = [by_wiki(name, F.col(column)) for name, column in DOCUMENT_COUNTS.items()]
    found = total.agg(*counts, wikis.alias("wikis"))
    for stat in ("num_pages", "num_links"):
        pair = lambda side: F.array(F.col(f"{side}_wiki"), F.col(f"{side}_value").cast("string"))
        found = found.crossJoin(extremes(total, stat).select(pair("max").alias(f"max_{stat}"), pair("min").alias(f"min_{stat}")))
    for name, by in (("most_linked", "page_link"), ("most_links", "page_id")):
        found = found.crossJoin(top_lists(page, link, by, k).agg(by_wiki(name, F.col("pages"))))
    for name, redirects in (("longest_name", True), ("longest_name_no_redirect", False)):
        found = found.crossJoin(_longest(page, redirects).agg(by_wiki(name, F.struct("page_id", "page_title", F.col("of_wiki").alias("wiki_name")))))
    for name, samples in (("bfs_sample_stats", bfs_samples), ("bi_bfs_sample_stats", pair_samples)):
        found = found.withColumn(name, F.lit(None)) if samples is None else found.crossJoin(samples.agg(by_wiki(name, F.col("sample"))))
    for name, sizes in (("web_wiki_sizes", web_sizes), ("local_wiki_sizes", local_sizes)):
        found = found.withColumn(name, F.lit(None)) if sizes is None else found.crossJoin(sizes.agg(F.sort_array(F.collect_list(F.struct(*sizes.columns))).alias(name)))
    found = found.withColumns({"created_at": F.unix_timestamp(F.lit(created_at).cast("timestamp")), "dump_date": F.lit(dump_date), "seconds_taken": F.lit(seconds_taken)})
    # an extreme's number stands beside a name in one array, which no column type can say
    text = F.regexp_replace(F.to_json(F.struct(*found.columns)), r'"((?:max|min)_num_(?:pages|links))":\[("(?:[^"\\]|\\.)*"),"(\d+)"\]', '"$1":[$2,$3]')
    return found.select(text.alias("value"))


_ENTRY = "struct<page_id:bigint,page_title:string,wiki_name:string,count:bigint>"
EXTREMES = ("max_num_pages", "min_num_pages", "max_num_links", "min_num_links")
#: What ``read_document`` finds in a document.
DOCUMENT_SCHEMA = ", ".join([
    *(f"{name} map<string,bigint>" for name in DOCUMENT_COUNTS),
    *(f"{name} map<string,array<{_ENTRY}>>" for name in ("most_linked", "most_links")),
    *(f"{name} map<string,struct<page_id:bigint,page_title:string,wiki_name:string>>" for name in ("longest_name", "longest_name_no_redirect")),
    *(f"{name} array<string>" for name in EXTREMES),
    "created_at bigint", "dump_date string", "wikis array<string>", "seconds_taken bigint",
])


def read_document(documents: DataFrame) -> DataFrame:
    """The fields of documents in column value; extremes as (wiki_name, value)."""
    fields = documents.select(F.from_json("value", DOCUMENT_SCHEMA, {"mode": "FAILFAST"}).alias("d")).select("d.*")
    return fields.withColumns({name: F.struct(F.get(name, F.lit(0)).alias("wiki_name"), F.get(name, F.lit(1)).cast("bigint").alias("value")) for name in EXTREMES})


def document_rows(documents: DataFrame) -> DataFrame:
    """(stat, wiki_name, value) of every statistic in documents; lists and names as text."""
    fields = read_document(documents)
    plain = lambda name, value: F.transform(F.map_entries(name), lambda e: F.struct(F.lit(name).alias("stat"), e["key"].alias("wiki_name"), value(e["value"]).alias("value")))
    listed = lambda pages: F.array_join(F.transform(pages, lambda p: F.concat_ws(":", p["wiki_name"], p["page_id"].cast("string"), p["count"].cast("string"))), ",")
    rows = [plain(name, lambda v: v.cast("string")) for name in DOCUMENT_COUNTS]
    rows += [plain(name, listed) for name in ("most_linked", "most_links")]
    rows += [plain(name, lambda v: v["page_title"]) for name in ("longest_name", "longest_name_no_redirect")]
    rows += [F.array(F.struct(F.lit(name).alias("stat"), F.col(name)["wiki_name"].alias("wiki_name"), F.col(name)["value"].cast("string").alias("value"))) for name in EXTREMES]
    return fields.select(F.explode(F.concat(*rows)).alias("r")).select("r.*")


#: Statistics by name: functions of (page, link).
REGISTRY: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {
    "page_counts": lambda page, link: page_counts(page),
    "link_counts": lambda page, link: link_counts(link),
    "linked_redirects": linked_redirects,
    "missing_counts": missing_counts,
    "most_linked": lambda page, link: top_lists(page, link, "page_link"),
    "most_links": lambda page, link: top_lists(page, link, "page_id"),
    "longest_titles": lambda page, link: longest_titles(page),
    "longest_titles_no_redirect": lambda page, link: longest_titles(page, redirects=False),
    "summary": summary,
}


def missing_stats(record: DataFrame, wikis: DataFrame) -> DataFrame:
    """Wikis that a record lacks, so that a rerun computes only these."""
    return wikis.join(record.select("wiki_name"), "wiki_name", "left_anti")


def merged_stats(record: DataFrame, fresh: DataFrame) -> DataFrame:
    """A record with the rows of ``fresh``, which replace those of the same wiki."""
    return record.join(fresh.select(*keys(fresh)), keys(fresh), "left_anti").unionByName(fresh)
