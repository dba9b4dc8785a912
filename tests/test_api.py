"""Saved API answers and the validation chain against hand-made cases."""

import json

import pytest
from pyspark.sql import functions as F

from linkloom.operators import validation
from linkloom.schemas import INFO
from linkloom.sources import api


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def answer(prop, entries, token=None, page=1):
    more = {"continue": {api.PROPERTIES[prop][0]: token, "continue": "||"}} if token else {"batchcomplete": True}
    return json.dumps(more | {"query": {"pages": [{"pageid": page, "ns": 0, prop: entries}]}})


def link(title, ns=0):
    return {"ns": ns, "title": title}


@pytest.fixture(scope="module")
def answers(spark):
    saved = [
        ("A", None, answer("links", [link("x"), link("Talk:y", 1)], "t1")),
        ("A", "t1", answer("links", [link("y")], "t2")),
        ("A", "t2", answer("links", [link("z"), link("x")])),
        ("A", "t9", answer("links", [link("never reached")])),
        ("B", None, answer("links", [link("p")], "lost", page=2)),
        ("C", None, json.dumps({"query": {"pages": [{"pageid": 3, "missing": True}]}})),
        ("D", "t1", answer("links", [link("no first answer")])),
        ("E", None, answer("links", [link("a")], "loop", page=5)),
        ("E", "loop", answer("links", [link("b")], "loop", page=5)),
        ("E", "loop", answer("links", [link("b")], "loop", page=5)),
    ]
    return spark.createDataFrame(saved, "request string, token string, value string")


def test_chains_of_answers(spark, answers):
    chains = api.follow(answers, "links").select("request", "place", "complete")
    assert rows(chains) == [("A", 0, True), ("A", 1, True), ("A", 2, True), ("B", 0, False), ("C", 0, True), ("E", 0, True), ("E", 1, True)]
    assert rows(api.link_titles(answers)) == [("A", "x", True), ("A", "y", True), ("A", "z", True), ("B", "p", False), ("E", "a", True), ("E", "b", True)]
    assert rows(api.listed(api.follow(answers, "links"), "links").filter("request = 'B'")) == [("B", False, 2, 0, "p")]
    assert api.link_titles(answers.limit(0)).count() == 0
    broken = spark.createDataFrame([("A", None, "{no json")], "request string, token string, value string")
    with pytest.raises(Exception, match="MALFORMED|malformed|Malformed"):
        api.link_titles(broken).collect()
    incoming = spark.createDataFrame([("A", None, answer("linkshere", [{"pageid": 7, "ns": 0, "title": "q", "redirect": False}]))], "request string, token string, value string")
    assert rows(api.link_titles(incoming, incoming=True)) == [("A", "q", True)]


def test_revisions_and_differences(spark):
    entries = [{"revid": 3, "parentid": 2, "timestamp": "2024-03-01T00:00:00Z"}, {"revid": 2, "parentid": 1, "timestamp": "2024-02-01T00:00:00Z"}, {"revid": 1, "parentid": 0, "timestamp": "2024-01-01T00:00:00Z"}]
    saved = spark.createDataFrame([("A", None, answer("revisions", entries[:2], "n")), ("A", "n", answer("revisions", entries[2:]))], "request string, token string, value string")
    revisions = api.listed(api.follow(saved, "revisions"), "revisions")
    dates = spark.createDataFrame([("A", "2024-03-01 00:00:00"), ("B", "2024-03-01 00:00:00")], "request string, t string").select("request", F.to_timestamp("t").alias("at"))
    assert rows(api.revision_before(revisions, dates)) == [("A", 2), ("B", None)]
    assert str(api.created_at(revisions).first()["created_at"]) == "2024-01-01 00:00:00"
    compare = spark.createDataFrame([(json.dumps({"compare": {"body": '<ins class="a">[[New]]</ins> <del>Old</del><ins>two<b>x</b></ins>'}}),), ("{}",)], "value string")
    assert [tuple(r) for r in compare.select(api.differences(F.col("value"), added=True), api.differences(F.col("value"), added=False)).collect()] == [(["[[New]]", "two"], ["Old"]), ([], [])]


def test_validation_chain(spark):
    links = "page_id bigint, title string, outgoing boolean"
    stored = spark.createDataFrame([(1, "same", True), (1, "gone", True), (1, "kept", True), (2, "in", False), (9, "not sampled", True)], links)
    live = spark.createDataFrame([(1, "same", True), (1, "new", True), (1, "late", True), (1, "lost", True)], links)
    pages = spark.createDataFrame([(1,), (2,), (2,)], "page_id bigint")
    evidence = spark.createDataFrame(
        [(1, "new", True, "2024-10-01 00:00:00", None, None, True), (1, "late", True, None, None, None, True), (1, "gone", True, None, None, "2024-10-02 00:00:00", False), (2, "in", False, None, None, None, True)],
        links + ", added_at string, created_at string, deleted_at string, in_old_revision boolean",
    ).withColumns({c: F.to_timestamp(c) for c in ("added_at", "created_at", "deleted_at")})
    post = validation.post_validation(stored, live, pages, evidence, "20240901")
    # late stands in the old revision and was not added since; lost and kept have no evidence
    assert rows(post) == [(1, "kept", True, "outdated"), (1, "late", True, "missing"), (1, "lost", True, "missing")]
    raw = spark.createDataFrame([(1, "same"), (1, "kept"), (1, "gone"), (1, "late")], "page_id bigint, title string")
    pre = validation.pre_validation(raw, live, pages, evidence, "20240901", verify_recency=False)
    assert rows(pre) == [(1, "gone", True, "outdated"), (1, "kept", True, "outdated"), (1, "lost", True, "missing"), (1, "new", True, "missing")]
    assert rows(validation.pre_validation(raw, live, pages, evidence, "20240901")) == [(1, "kept", True, "outdated"), (1, "lost", True, "missing")]
    assert rows(validation.accepted(post, pre)) == [(3, 1, False)]
    info = spark.createDataFrame([("w", "20240901", True, 1.0, False, 0, 0.0), ("w", "20240801", False, 1.0, False, 0, 0.0)], INFO)
    fail = validation.validate(info, stored, raw, live, pages, evidence, wiki_name="w", dump_date="20240901", seconds=2.5)
    assert {(r["dump_date"], r["is_validated"], r["num_pages_validated"], r["validation_time_s"]) for r in fail.collect()} == {("20240901", False, 2, 2.5), ("20240801", False, 0, 0.0)}
    done = validation.validate(info, stored, raw.filter("title <> 'late'"), live, pages, evidence, wiki_name="w", dump_date="20240901")
    assert {(r["dump_date"], r["is_validated"]) for r in done.collect()} == {("20240901", True), ("20240801", False)}
    with pytest.raises(ValueError, match="not loaded"):
        validation.validate(info, stored, raw, live, pages, evidence, wiki_name="w", dump_date="20240801")
