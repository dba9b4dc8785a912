"""The validation chain: stored links of sampled pages against live ones, with what excuses a difference.

Steps are gated: a dump that is not loaded is not validated, and what the live
lists do not explain is held against the raw dump itself before a wiki fails.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import checks

#: What tells differences apart.
DIFFERENCE = ["page_id", "title", "outgoing", "change"]


def differences(stored: DataFrame, live: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, title, outgoing, change) of ``pages`` (page_id): links that only the live lists have are missing, those only stored are outdated.

    Both sides have page_id, title and outgoing (whether the page links or is linked); equal rows count once.
    """
    keys = ["page_id", "title", "outgoing"]
    own, theirs = (side.join(pages.select("page_id").distinct(), "page_id", "left_semi").select(*keys) for side in (stored, live))
    change = F.when(F.col("change") == "added", "missing").otherwise("outdated")
    return checks.difference(own, theirs, keys).withColumn("change", change)


def unexplained(found: DataFrame, evidence: DataFrame, dump_date: str) -> DataFrame:
    """The differences that no evidence excuses.

    ``evidence`` has page_id, title and outgoing, the times added_at,
    created_at and deleted_at, and in_old_revision; a difference without evidence is not excused.
    """
    rows = found.join(evidence, ["page_id", "title", "outgoing"], "left").withColumn("dump_date", F.to_timestamp(F.lit(dump_date), "yyyyMMdd"))
    return checks.verdicts(rows).groupBy(*DIFFERENCE).agg(F.max("excuse").alias("excuse")).filter("excuse IS NULL").select(*DIFFERENCE)


def post_validation(stored: DataFrame, live: DataFrame, pages: DataFrame, evidence: DataFrame, dump_date: str) -> DataFrame:
    """Unexplained differences of the loaded tables."""
    return unexplained(differences(stored, live, pages), evidence, dump_date)


def pre_validation(dump_links: DataFrame, live: DataFrame, pages: DataFrame, evidence: DataFrame, dump_date: str, *, verify_recency: bool = True) -> DataFrame:
    """Unexplained differences of the raw dump's links (page_id, title), outgoing ones only.

    Without ``verify_recency`` no evidence counts, and all differences are returned.
    """
    outgoing = dump_links.select("page_id", "title", F.lit(True).alias("outgoing"))
    found = differences(outgoing, live.filter("outgoing"), pages)
    return unexplained(found, evidence, dump_date) if verify_recency else found


def sound(info: DataFrame, wiki_name: str, dump_date: str) -> bool:
    """The gate: whether the dump of a wiki is loaded."""
    return not info.filter((F.col("wiki_name") == wiki_name) & (F.col("dump_date") == dump_date) & F.col("is_done")).isEmpty()


def accepted(post: DataFrame, pre: DataFrame) -> DataFrame:
    """One row (num_post, num_new, is_validated): a load is accepted if the raw dump already had all of its differences."""
    known = pre.select(*DIFFERENCE, F.lit(True).alias("_known")).distinct()
    rows = post.join(known, DIFFERENCE, "left")
    return rows.agg(F.count("*").alias("num_post"), F.count_if(F.col("_known").isNull()).alias("num_new")).withColumn("is_validated", F.col("num_new") == 0)


def validate(info: DataFrame, stored: DataFrame, dump_links: DataFrame, live: DataFrame, pages: DataFrame, evidence: DataFrame, *, wiki_name: str, dump_date: str, seconds: float = 0.0) -> DataFrame:
    """``info`` with the verdict on one wiki and dump: is_validated, num_pages_validated and validation_time_s of its row.

    Other rows stay as they are; a dump that is not loaded is an error. Only
    outgoing differences can be excused by the raw dump, which has no others.
    """
    if not sound(info, wiki_name, dump_date):
        raise ValueError(f"the dump {dump_date} of {wiki_name} is not loaded")
    post = post_validation(stored, live, pages, evidence, dump_date)
    pre = pre_validation(dump_links, live, pages, evidence, dump_date, verify_recency=False)
    verdict = accepted(post, pre).select("is_validated").crossJoin(pages.select("page_id").distinct().agg(F.count("*").cast("int").alias("n"))).first()
    here = (F.col("wiki_name") == wiki_name) & (F.col("dump_date") == dump_date)
    fresh = {"is_validated": F.lit(verdict["is_validated"]), "num_pages_validated": F.lit(verdict["n"]), "validation_time_s": F.lit(float(seconds))}
    return info.withColumns({name: F.when(here, value).otherwise(F.col(name)) for name, value in fresh.items()})
