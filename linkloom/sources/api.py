"""Saved answers of a paged query API: chains of continuation, link lists, revisions, differences.

A saved answer is a row (request, token, value): what was asked, the
continuation token that the request carried (null for the first), and the JSON
text. An answer names the token of the next one. Chains of all requests are
followed side by side, one join a page.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.tables import cut

#: Properties of a query answer: the list's name, its continuation token and the rows' schema (fixed values of the API).
PROPERTIES = {
    "links": ("plcontinue", "ns int, title string"),
    "linkshere": ("lhcontinue", "pageid bigint, ns int, title string, redirect boolean"),
    "revisions": ("rvcontinue", "revid bigint, parentid bigint, timestamp string"),
}


def follow(answers: DataFrame, prop: str) -> DataFrame:
    """(request, place, value, complete) of the answers that a chain reaches from its first one.

    complete is false for every answer of a chain whose last known answer names
    one that was not saved. An answer that no chain reaches has no row; of
    answers saved twice for one token the lesser text counts; a token that
    leads back into its chain ends it.
    """
    key = PROPERTIES[prop][0]
    one = answers.groupBy("request", "token").agg(F.min("value").alias("value"))
    rows = cut(one.select("request", "token", "value", F.get_json_object("value", f"$.continue.{key}").alias("next")))
    now, parts, place = rows.filter("token IS NULL").withColumn("seen", F.array().cast("array<string>")), [], 0
    steps = rows.filter("token IS NOT NULL")
    while True:
        now = cut(now.select("request", "value", "next", "seen", F.lit(place).alias("place")))
        if now.isEmpty():
            break
        parts.append(now)
        going = now.filter("next IS NOT NULL AND NOT array_contains(seen, next)").select("request", F.col("next").alias("token"), F.concat("seen", F.array("next")).alias("seen"))
        now, place = going.join(steps, ["request", "token"]).select("request", "value", "next", "seen"), place + 1
    if not parts:
        return rows.select("request", F.lit(0).alias("place"), "value", F.lit(True).alias("complete")).limit(0)
    found = functools.reduce(DataFrame.union, parts)
    last = found.groupBy("request").agg(F.max_by(F.col("next").isNull() | F.expr("array_contains(seen, next)"), "place").alias("complete"))
    return found.join(last, "request").select("request", "place", "value", "complete")


def listed(chains: DataFrame, prop: str) -> DataFrame:
    """(request, complete, page_id, and the columns of the property): the rows of all answers of followed chains, one after the other.

    An answer without the list adds nothing; text that is no JSON is an error.
    """
    schema = PROPERTIES[prop][1]
    shape = f"query struct<pages:array<struct<pageid:bigint,{prop}:array<struct<{', '.join(f'{n}:{t}' for n, t in (c.split() for c in schema.split(', ')))}>>>>>"
    parsed = chains.select("request", "complete", F.from_json("value", shape, {"mode": "FAILFAST"}).alias("d"))
    pages = parsed.select("request", "complete", F.explode("d.query.pages").alias("p"))
    return pages.select("request", "complete", F.col("p.pageid").alias("page_id"), F.explode(f"p.{prop}").alias("r")).select("request", "complete", "page_id", "r.*")


def link_titles(answers: DataFrame, *, incoming: bool = False) -> DataFrame:
    """(request, title, complete): linked article titles of every request, each once."""
    prop = "linkshere" if incoming else "links"
    rows = listed(follow(answers, prop), prop).filter("ns = 0")
    return rows.groupBy("request", "title").agg(F.bool_and("complete").alias("complete"))


def revision_before(revisions: DataFrame, dates: DataFrame) -> DataFrame:
    """(request, revid): the latest revision of each request strictly before its date (request, at timestamp); null where all are later."""
    rows = dates.join(revisions.select("request", "revid", F.to_timestamp("timestamp").alias("_at")), "request", "left")
    return rows.groupBy("request").agg(F.max_by("revid", F.when(F.col("_at") < F.col("at"), F.struct("_at", "revid"))).alias("revid"))


def created_at(revisions: DataFrame) -> DataFrame:
    """(request, created_at): the time of each request's first revision."""
    return revisions.groupBy("request").agg(F.min(F.to_timestamp("timestamp")).alias("created_at"))


def differences(value: Column, *, added: bool) -> Column:
    """The first texts of all inserted (or deleted) parts of an inline comparison."""
    tag = "ins" if added else "del"
    body = F.coalesce(F.get_json_object(value, "$.compare.body"), F.lit(""))
    return F.regexp_extract_all(body, F.lit(rf"<{tag}(?:\s[^>]*)?>([^<]+)"), F.lit(1))
