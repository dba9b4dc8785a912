"""Kept results: one for each request and page, recomputed for a new dump."""

from linkloom.operators import serve
from linkloom.operators.results import ResultStore


def test_results_by_request(spark, tmp_path):
    link = spark.createDataFrame([(1, i) for i in range(2, 122)], "page_id bigint, page_link bigint")
    page = spark.createDataFrame([(i, f"T{i}") for i in range(1, 122)], "page_id bigint, page_title string")
    runs = []

    def ask(store, number):
        def compute():
            runs.append(number)
            return serve.links(page, link, 1, number=number)

        return sorted(r["linked_id"] for r in store.get("links", compute, wiki="w", page_id=1, number=number).collect())

    store = ResultStore(spark, str(tmp_path), "20240901")
    # the page number is part of the key
    assert ask(store, 1) == list(range(2, 52)) and ask(store, 2) == list(range(52, 102)) and ask(store, 3) == list(range(102, 122))
    assert ask(store, 2) == list(range(52, 102)) and runs == [1, 2, 3]
    assert store.path("links", a=1, b=2) == store.path("links", b=2, a=1) != store.path("links", a="1", b=2)
    (tmp_path / "20240901" / store.path("links", wiki="w", page_id=1, number=3).rsplit("/", 1)[1] / "_SUCCESS").unlink()
    assert not store.holds("links", wiki="w", page_id=1, number=3) and ask(store, 3) == list(range(102, 122)) and runs == [1, 2, 3, 3]
    later = ResultStore(spark, str(tmp_path), "20241001")
    assert ask(later, 1) == list(range(2, 52)) and runs[-1] == 1 and len(runs) == 5
    assert later.forget_older() == ["20240901"] and later.forget_older() == [] and ask(later, 1) and len(runs) == 5
    assert ResultStore(spark, str(tmp_path / "none"), "x").forget_older() == []
