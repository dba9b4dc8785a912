"""From dump rows to the page and link tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Columns that tell wikis and dumps apart; each wiki and dump numbers its rows anew.
KEYS = ("dump_date", "wiki_name")


def _keys(*tables: DataFrame) -> list[str]:
    """The keys that all tables have."""
    return [k for k in KEYS if all(k in t.columns for t in tables)]


def pages(dump: DataFrame) -> DataFrame:
    """Pages of the article namespace, with the dump's keys if it has any."""
    return dump.filter("page_namespace = 0").select(*_keys(dump), "page_id", "page_title", F.coalesce(F.col("page_is_redirect") == 1, F.lit(False)).alias("is_redirect"))


def count_articles(dump: DataFrame) -> DataFrame:
    return dump.filter("page_namespace = 0 and page_is_redirect = 0").agg(F.count("*").alias("num_articles"))


def link_targets(dump: DataFrame) -> DataFrame:
    return dump.filter("lt_namespace = 0").select(*_keys(dump), "lt_id", "lt_title")


def resolve_links(pagelinks: DataFrame, linktarget: DataFrame, page: DataFrame, *, require_source: bool = False) -> DataFrame:
    """(dump_date and wiki_name, if all tables have them, page_id, page_link): links whose target title is a page.

    A link is resolved within its own wiki and dump. A key that only some of
    the tables have is an error, since ids and titles of different wikis would meet. Only the
    namespace of a source is checked unless ``require_source``, so sources can
    be missing from ``page``. Both joins are left to the planner.
    """
    keys = _keys(pagelinks, linktarget, page)
    for key in KEYS:
        if key not in keys and any(key in t.columns for t in (pagelinks, linktarget, page)):
            raise ValueError(f"all three tables need {key}, or none")
    rows = pagelinks.filter("pl_from_namespace = 0").select(*keys, "pl_from", F.col("pl_target_id").alias("lt_id"))
    rows = rows.join(link_targets(linktarget), [*keys, "lt_id"])
    rows = rows.join(page.select(*keys, F.col("page_id").alias("page_link"), F.col("page_title").alias("lt_title")), [*keys, "lt_title"])
    rows = rows.select(*keys, F.col("pl_from").alias("page_id"), "page_link")
    return rows.join(page.select(*keys, "page_id"), [*keys, "page_id"], "left_semi") if require_source else rows


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    """Key values that occur more than once."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def checked_unique(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` themselves; duplicate keys are an error, as after a load with a unique index."""
    first = duplicates(rows, *keys).first()
    if first:
        raise ValueError(f"duplicate key {first.asDict()}")
    return rows


def title_map(page: DataFrame) -> DataFrame:
    """title to id; of pages that share a title the first id counts."""
    return page.groupBy("page_title").agg(F.min("page_id").alias("page_id"))


def last_map(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """key to value; the last row by ``order`` counts."""
    return rows.groupBy(key).agg(F.max_by(value, order).alias(value))


def adjacency(link: DataFrame, *, incoming: bool = False) -> DataFrame:
    """Neighbour lists, for small results; traversals use the link table itself."""
    key, value = ("page_link", "page_id") if incoming else ("page_id", "page_link")
    return link.groupBy(key).agg(F.sort_array(F.collect_list(value)).alias("neighbours"))
