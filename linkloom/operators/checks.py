"""Set differences, validation rules and relations of the scheduler."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def difference(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of either side that the other lacks, tagged ``added`` or ``deleted``."""
    added = new.select(*keys).distinct().join(old.select(*keys), keys, "left_anti").withColumn("change", F.lit("added"))
    return added.union(old.select(*keys).distinct().join(new.select(*keys), keys, "left_anti").withColumn("change", F.lit("deleted")))


def difference_counts(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return difference(old, new, keys).agg(F.count_if(F.col("change") == "added").alias("num_added"), F.count_if(F.col("change") == "deleted").alias("num_deleted"))


def is_subset(part: DataFrame, whole: DataFrame, keys: list[str]) -> bool:
    return part.select(*keys).join(whole.select(*keys), keys, "left_anti").isEmpty()


def verdicts(differences: DataFrame) -> DataFrame:
    """Rows (change, evidence) with the rule that excuses them, or null.

    An expected link that is missing is excused if it was added after the dump,
    if its page was created after it, or if the old revision lacks it; one that
    is outdated if it was deleted after the dump or if the old revision has it.
    """
    missing = F.when(F.col("added_at") > F.col("dump_date"), "added after dump").when(F.col("created_at") > F.col("dump_date"), "page created after dump").when(~F.col("in_old_revision"), "absent from old revision")
    outdated = F.when(F.col("deleted_at") > F.col("dump_date"), "deleted after dump").when(F.col("in_old_revision"), "present in old revision")
    return differences.withColumn("excuse", F.when(F.col("change") == "missing", missing).otherwise(outdated))


def common_dates(rows: DataFrame, n_wikis: int) -> DataFrame:
    """Dump dates that all ``n_wikis`` wikis have."""
    return rows.groupBy("dump_date").agg(F.count_distinct("wiki_name").alias("n")).filter(F.col("n") == n_wikis).select("dump_date")


def complete_dumps(files: DataFrame, tables: list[str]) -> DataFrame:
    """(wiki_name, dump_date) that have all of ``tables``."""
    need = F.array(*map(F.lit, tables))
    rows = files.groupBy("wiki_name", "dump_date").agg(F.collect_set("table").alias("have"))
    return rows.filter(F.size(F.array_except(need, "have")) == 0).select("wiki_name", "dump_date")


def todo(available: DataFrame, finished: DataFrame) -> DataFrame:
    """Available (wiki_name, dump_date) that are not finished."""
    return available.select("wiki_name", "dump_date").distinct().join(finished.select("wiki_name", "dump_date"), ["wiki_name", "dump_date"], "left_anti")


def enqueue(open_dumps: DataFrame, wanted: list[str]) -> DataFrame:
    """Tasks (wiki_name, dump_date, required) for open dumps.

    The newest dump date requires all ``wanted`` wikis, an older one those that are open for it, sorted.
    """
    per = open_dumps.filter(F.col("dump_date").isNotNull()).groupBy("dump_date").agg(F.sort_array(F.collect_set("wiki_name")).alias("wikis"))
    newest = per.agg(F.max("dump_date").alias("dump_date")).withColumn("newest", F.lit(True))
    everything = F.array(*map(F.lit, wanted)).cast("array<string>")
    required = F.when(F.col("newest"), everything).otherwise(F.col("wikis")).alias("required")
    return per.join(newest, "dump_date", "left").select(F.explode("wikis").alias("wiki_name"), "dump_date", required)


def unprocessed(files: DataFrame) -> DataFrame:
    """(wiki_name, dump_date) with a download but no store that holds anything, of files (wiki_name, dump_date, kind, size)."""
    keys = ["wiki_name", "dump_date"]
    stored = files.filter((F.col("kind") == "store") & (F.col("size") > 0)).select(*keys)
    return files.filter("kind = 'download'").select(*keys).distinct().join(stored, keys, "left_anti")


def without_block(documents: DataFrame, block: str) -> DataFrame:
    """Dump dates whose statistics document lacks a block."""
    return documents.filter(F.col(block).isNull()).select("dump_date").distinct()


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of every key."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order)))
    return rows.withColumn("_place", place).filter("_place = 1").drop("_place")


def task_order(tasks: DataFrame) -> DataFrame:
    """Running tasks first, then those without a dump date, then the newest dumps and latest starts."""
    return tasks.orderBy(F.when(F.col("status") == "RUNNING", 0).otherwise(1), F.desc_nulls_first("dump_date"), F.desc_nulls_last("started_at"), "name")


def dump_status(tasks: DataFrame, now: str) -> DataFrame:
    """One status per dump date: running before failed before done within a day before scheduled."""
    recent = (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("finished_at")) <= 86_400
    per = tasks.groupBy("dump_date").agg(F.bool_or(F.col("status") == "RUNNING").alias("r"), F.bool_or(F.col("status") == "FAILED").alias("f"), F.bool_or((F.col("status") == "DONE") & F.coalesce(recent, F.lit(False))).alias("d"))
    return per.select("dump_date", F.when(F.col("r"), "RUNNING").when(F.col("f"), "FAILED").when(F.col("d"), "DONE").otherwise("SCHEDULED").alias("status"))


def largest_category(members: DataFrame) -> DataFrame:
    """Per page the largest of its categories (page_id, category), ties to the name; project categories are left out."""
    rows = members.filter(~F.col("category").startswith("Wikipedia:"))
    sizes = rows.groupBy("category").agg(F.count("*").alias("size"))
    sized = rows.join(sizes, "category")
    return sized.groupBy("page_id").agg(F.min_by("category", F.struct(-F.col("size"), F.col("category"))).alias("category"), F.max("size").alias("size"))
