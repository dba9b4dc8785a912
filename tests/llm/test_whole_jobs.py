"""What a review found cut short: each test failed before its finding was settled."""

import math
import random

from linkloom.llm import near_copies, quality_rules, simhash

KINDS = "doc_id bigint, text string, source string"


def words(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choices("abcdefghij", k=6)) for _ in range(n)]


def jaccard(a, b):
    a, b = set(near_copies.shingle_set(a)), set(near_copies.shingle_set(b))
    return len(a & b) / len(a | b)


def test_pipeline_near_copies_of_similarity_0_8_go(spark, monkeypatch):
    import corpus_pipeline

    rows, far = [], 0
    for group in range(30):
        base = words(group, 150)
        rows.append((10 * group, " ".join(base), "s"))
        for copy in (1, 2):
            other = list(base)
            for at in (40, 110)[:copy]:
                other[at] = f"changed{copy}"
            rows.append((10 * group + copy, " ".join(other), "s"))
            far += bin(simhash.fingerprint(rows[-1][1]) ^ simhash.fingerprint(" ".join(base))).count("1") > 2
            assert jaccard(rows[-1][1], " ".join(base)) >= 0.8
        half = base[:75] + words(1000 + group, 75)
        rows.append((10 * group + 3, " ".join(half), "s"))
    assert far > 5
    expected = sorted(i for g in range(30) for i in (10 * g, 10 * g + 3))
    docs = spark.createDataFrame(rows, KINDS)
    for limit in (16, 2):
        monkeypatch.setattr(near_copies, "PAIR_BUCKET", limit)
        assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == expected
    assert corpus_pipeline.near_duplicates(spark, docs.filter("false"), "").count() == 0


def test_pipeline_keeps_one_row_of_each_class_whatever_its_ids(spark):
    one, two, three = (" ".join(words(k, 40)) for k in (1, 2, 3))
    rows = [
        (1, one, "a"), (1, two, "b"), (5, two, "c"), (6, one, "d"), (6, one, "d"),
        (None, three, "e"), (None, three, "e"), (None, three, "f"), (None, one, "g"),
        (7, "", "h"), (7, None, "h"), (None, " ", "i"),
    ]
    docs = spark.createDataFrame(rows, KINDS)
    expected = [(1, one, "a"), (1, two, "b"), (7, None, "h"), (None, three, "e")]
    for keep_one in (simhash.keep_one, near_copies.keep_one):
        assert sorted(map(str, map(tuple, keep_one(docs).collect()))) == sorted(map(str, expected))


def test_pipeline_against_brute_force_shingle_sets(spark, data):
    import hashlib

    import duckdb
    import pytest

    import corpus_pipeline
    from linkloom.llm import byte_bpe, quality_rules, secret_scan, source_mixing
    from linkloom.llm.queries import vocabulary
    from linkloom.llm.sql import mix_sql

    tiktoken = pytest.importorskip("tiktoken")
    tokenizers = pytest.importorskip("public_tokenizers")
    ranks = byte_bpe.read_ranks(vocabulary("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    documents = spark.read.parquet(f"{data}/documents.parquet")
    kept = quality_rules.assess(documents, spark.read.parquet(f"{data}/labels.parquet").filter("quality = 1 and toxic = 0").selectExpr("doc_id as id")).filter("kept")
    frame = documents.join(kept, "doc_id", "left_semi").toPandas().sort_values("doc_id")
    root = {i: i for i in frame.doc_id}
    texts = dict(zip(frame.doc_id, frame.text, strict=True))
    for a in texts:
        for b in texts:
            if a < b and root[a] != root[b] and jaccard(texts[a], texts[b]) >= 0.8:
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    frame = frame[[root[i] == i for i in frame.doc_id]].copy()
    net = secret_scan.trained()
    frame["text"] = [secret_scan.redacted(t, s, "[SECRET]") for t, (_, s) in zip(frame.text, secret_scan._found(list(frame.text), net), strict=True)]
    con = duckdb.connect()
    con.register("documents", frame)
    mixed = con.execute(mix_sql([3, 1, 2], 1.5, 2.0, source_mixing.ROUNDS)).df()
    expected = []
    for i, size, taken in zip(mixed.doc_id, mixed["size"], mixed.taken, strict=True):
        text = dict(zip(frame.doc_id, frame.text, strict=True))[i]
        numbers = library.encode_ordinary(text)
        expected += [(i, len(numbers), hashlib.sha256(",".join(map(str, numbers)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())] * (taken // size if taken else 0)
    assert sorted(map(tuple, corpus_pipeline.run(spark, data).collect())) == sorted(expected)


def test_op7_secret_scan_sees_every_character_of_a_candidate():
    from linkloom.llm import secret_scan

    net, key = secret_scan.trained(), "ghp_a8Bd93kLmQ2xZt7Rw5Yn1Vc6Hj0Ks4TbNe8q"
    path = "/home/builder/projects/common/releases/version1/archive/linux"
    texts = [f"see {path}/{key}/download/latest now", f"see {path}/{path}/{key}{path} now", f"see {path}/{path}{path}/download now"]
    found = [secret_scan.redacted(t, s, "X") for t, (_, s) in zip(texts, secret_scan._found(texts, net), strict=True)]
    assert [key in text for text in found] == [False, False, False] and found[2] == texts[2]
    for length in (12, 48, 49, 72, 73, 500):
        assert {at for low, high in secret_scan.windows(7, 7 + length) for at in range(low, high)} == set(range(7, 7 + length))


def test_op7_secret_scan_letters_only_and_protruding_keys():
    from linkloom.llm import secret_scan

    net, letters = secret_scan.trained(), "xQzRtKpWvBnMsLdFgHjCyTqXwZkPbVnR"
    blocks = "9f86d081884c7d659a2feaa0c55ad015-a3bf4f1b-2b0b822c"
    texts = [f"key {letters} end", f"id {blocks} end", "an internationalization of responsibilities", "x " + "-" * 40 + " y"]
    found = [secret_scan.redacted(t, s, "X") for t, (_, s) in zip(texts, secret_scan._found(texts, net), strict=True)]
    assert found == ["key X end", "id X end", *texts[2:]]
    scores = secret_scan.secret_scores(secret_scan.held_out_secrets(1500, 555), net)
    assert (scores >= net.threshold).mean() > 0.98


def test_op1_warc_walks_quoted_values():
    import time

    from linkloom.llm import warc

    page = '<a href="/x" title="Don\'t">Read</a> <a href="/y">two</a><p>It\'s here</p> end'
    assert warc.extract(page) == ("", "Read two\nIt's here\nend", ["/x", "/y"])
    inside = "<b>1</b>" * 20 + '<a href="/no">in</a>'
    page = f"<div srcdoc='{inside}'>out <a data-html='{inside}' data-href=/n href = /z>z</a><a href=''>e</a><a href>n</a><a title='>' HREF=\"/q?a&amp;b\">q</a></div>"
    assert warc.extract(page) == ("", "out zenq", ["/z", "", "/q?a&b"])
    assert warc.extract("<p don't>one</p><a href=\"/u>two</a>")[1] == "one\ntwo"
    at = time.time()
    for piece in ('<a "', "<a'>'", '<a x="', "<a x='>", "<a x=\"'>", "<a = =", "<a x= "):
        warc.extract(piece * 50000)
    assert time.time() - at < 20


def test_op9_source_mixing_cuts_within_repeated_ids(spark):
    from linkloom.llm import source_mixing

    same = " ".join(words(5, 6))
    for number in (lambda k: None, lambda k: 7, lambda k: k):
        rows = [(number(k), " ".join(words(k, 3 + k % 5)) if k % 2 else same, "s") for k in range(200)]
        docs = spark.createDataFrame(rows, KINDS)
        found = source_mixing.mix(docs, weights=[1], share=1.5).collect()
        assert len(found) == 200 and all(r["taken"] in (r["size"], 2 * r["size"]) for r in found)
        total, smallest_left = sum(r["taken"] for r in found), min(r["size"] for r in found if r["taken"] == r["size"])
        assert found[0]["target"] - smallest_left < total <= found[0]["target"]
        kept = source_mixing.keep_mixed(docs, weights=[1], share=1.5).collect()
        assert sum(len(r["text"].split()) for r in kept) == total
        assert {tuple(r) for r in kept} == set(rows)


def test_op1_warc_returns_its_records(spark, data):
    from linkloom.llm import queries, warc

    for r in queries.op1_warc(spark, data).limit(20).collect():
        for kind in ("metadata", "conversion"):
            ((headers, block),) = warc.read_records(bytes(r[f"{kind}_record"]))
            assert headers["warc-type"] == kind and len(block) == r[f"{kind}_bytes"]


def test_op1_warc_keeps_source_headers_and_digests(spark, tmp_path):
    import gzip

    from linkloom.llm import warc

    page = "<title>T</title><p>caf\u00e9</p><a href='/x'>x</a>".encode()
    packed = gzip.compress(page)
    chunks = b"".join(b"%x\r\n%s\r\n" % (len(packed[k : k + 9]), packed[k : k + 9]) for k in range(0, len(packed), 9)) + b"0\r\n\r\n"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\nContent-Encoding: gzip\r\n\r\n" + chunks
    own = [("WARC-Type", "response"), ("WARC-Record-ID", "<urn:1>"), ("WARC-Target-URI", "http://e/"), ("WARC-Date", "d"), ("WARC-Payload-Digest", "sha1:GIVEN"), ("WARC-IP-Address", "1.2.3.4")]
    bad = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: many\r\n\r\nlost\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(bad + warc.record(own, http))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(warc.record(own, http))[:-12])
    (tmp_path / "c.warc").write_bytes(b"")
    found = warc.derivatives(warc.responses_from_warc(spark, str(tmp_path))).collect()
    assert found and all(r["response_id"] == "<urn:1>" and r["payload_digest"] == "sha1:GIVEN" for r in found)
    ((headers, block),) = warc.read_records(bytes(found[0]["metadata_record"]))
    assert headers["warc-refers-to"] == "<urn:1>" and headers["warc-refers-to-payload-digest"] == "sha1:GIVEN"
    assert b"source-header: warc-ip-address: 1.2.3.4\r\n" in block and b"outlink: /x\r\n" in block
    assert "caf\u00e9 x" in bytes(found[0]["conversion_record"]).decode().replace("\n", " ")


def test_op8_topk_search_scores_huge_components(spark):
    from pyspark.sql import functions as F

    from linkloom.llm import topk_search

    rows = [(0, [1e9, 1.0]), (1, [1e6, 3.0]), (2, [1e6, 2.0]), (3, [1e300, 1.0]), (4, [-1e6, 5.0])]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = [tuple(r) for r in topk_search.top_k(vectors, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert found == [(0, k, i, 1024 * 1024 * int(10**9 * x + y)) for k, i, x, y in ((1, 1, 10**6, 3), (2, 2, 10**6, 2), (3, 4, -(10**6), 5)) if abs(1024 * 1024 * int(10**9 * x + y)) < 1 << 63]


def test_op9_source_mixing_probabilities_and_certain_documents(spark):
    import math

    from pyspark.sql import functions as F

    from linkloom.llm import source_mixing

    sizes = [3, 5, 8, 13, 21, 400, 900, 5, 5, 8]
    for gap in (1, 50, 700, 1000, 1367):
        rows = spark.createDataFrame([("s", n, math.floor(math.sqrt(n) * 16)) for n in sizes], "source string, size bigint, x bigint")
        per = spark.createDataFrame([("s", gap)], "source string, gap bigint")
        found = source_mixing.inclusion(rows, per).first()
        weight, sure = {k: math.floor(math.sqrt(n) * 16) for k, n in enumerate(sizes)}, set()
        while True:
            rest = [k for k in weight if k not in sure]
            scale = (gap - sum(sizes[k] for k in sure)) / sum(weight[k] * sizes[k] for k in rest)
            over = {k for k in rest if scale * weight[k] >= 1}
            if not over:
                break
            top = max(weight[k] for k in over)
            sure |= {k for k in over if weight[k] == top}
        assert abs(found["scale"] - scale) < 1e-12 and found["rest"] == gap - sum(sizes[k] for k in sure)
        assert {k for k in weight if weight[k] > found["above"]} == sure
        expected = sum(sizes[k] for k in sure) + sum(scale * weight[k] * sizes[k] for k in weight if k not in sure)
        assert abs(expected - gap) < 1e-9
    docs = spark.createDataFrame([(k, " ".join(["w"] * (1 + k % 60)), "s") for k in range(600)], KINDS)
    found = source_mixing.mix(docs, weights=[1], share=0.4).collect()
    share = lambda low, high: sum(r["taken"] > 0 for r in found if low <= r["size"] <= high) / sum(low <= r["size"] <= high for r in found)
    assert share(1, 10) < share(30, 60) and share(1, 10) > 0
    assert source_mixing.mix(docs, weights=[1], share=1.5, preference=F.lit(None).cast("double")).count() == 600


def test_stages_keep_columns_of_any_name_and_kind(spark):
    from linkloom.llm import quality_rules, secret_scan, source_mixing

    kinds = "doc_id bigint, text string, source string, `_id` int, `_times` int, `a.b` string, _row_hash string, m map<string,int>, _root int"
    rows = [(k, " ".join(words(k, 40)) if k else None, "s", k, k, "x", "y", {"k": k}, 1) for k in range(6)] + [(5, " ".join(words(5, 40)), "s", 5, 5, "x", "y", {"k": 5}, 1)]
    docs, none = spark.createDataFrame(rows, kinds), spark.createDataFrame([], kinds)
    trusted = spark.createDataFrame([(1,)], "id bigint")
    stages = {
        "good": lambda df: quality_rules.keep_good(df, trusted),
        "simhash": simhash.keep_one,
        "copies": near_copies.keep_one,
        "redact": secret_scan.redact,
        "mixed": lambda df: source_mixing.keep_mixed(df, weights=[1], share=1.5),
    }
    for name, stage in stages.items():
        found = stage(docs)
        assert found.columns == docs.columns, name
        got = [tuple(r) for r in found.collect()]
        assert got and all(r in rows for r in got), name
        if name in ("simhash", "copies"):
            assert sorted(r[0] for r in got) == [0, 1, 2, 3, 4, 5]
        assert stage(none).count() == 0, name


def test_all_trusted_documents_fit_the_model(spark, monkeypatch):
    monkeypatch.setattr(quality_rules, "MAX_TRUSTED", 1, raising=False)
    docs = spark.createDataFrame([(i, f"word{i % 3} " * 20) for i in range(9)], "doc_id bigint, text string")
    trusted = spark.createDataFrame([(0,), (1,), (3,), (4,), (None,)], "id bigint")
    raw, target = [0] * quality_rules.BUCKETS, [0] * quality_rules.BUCKETS
    for doc_id, grams in quality_rules._prepared(docs, [docs["doc_id"]], "text").select("doc_id", quality_rules._grams()).collect():
        for g in grams:
            raw[g] += 1
            target[g] += doc_id in (0, 1, 3, 4)
    share, smooth = sum(target) / sum(raw), quality_rules.SMOOTHING
    expected = [round(quality_rules.SCALE * math.log((t + smooth) / (share * r + smooth))) for r, t in zip(raw, target, strict=True)]
    assert quality_rules.gram_weights(docs, trusted) == expected


def test_trusted_ids_travel_to_the_texts(spark):
    """The planner's limit moves no text; marks are right across words of 64 ids, below zero, for nulls, repeats and strings."""
    ids = [-130, -65, -64, -1, 0, 1, 63, 64, 127, 128, 2**40, -(2**63), 2**63 - 1, None, None, 5, 5]
    good = {-130, -64, -1, 0, 63, 128, -(2**63), 2**63 - 1, 5}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for kind, name in (("bigint", lambda x: x), ("string", lambda x: None if x is None else str(x))):
            docs = spark.createDataFrame([(name(i), f"text {i}") for i in ids], f"doc_id {kind}, text string")
            trusted = spark.createDataFrame([(name(i),) for i in [*good, 0, 77, None]], f"id {kind}")
            rows, _ = quality_rules._marked(docs, trusted, "doc_id", "text")
            assert sorted((str(r[0]), r[2]) for r in rows.collect()) == sorted((str(name(i)), i in good) for i in ids)
            plan = rows._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        few = spark.createDataFrame([(i,) for i in range(640)], "id int")
        docs = spark.createDataFrame([(i, "x") for i in range(700)], "doc_id int, text string")
        rows, marks = quality_rules._marked(docs, few, "doc_id", "text")
        assert rows.filter("_good").count() == 640 and marks.count() == 10
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_pipeline_f2_near_copies_go_through_fingerprints(spark, monkeypatch):
    base = words(7, 400)
    texts = [" ".join(base), " ".join(base[:-1]), " ".join(base[:200] + ["other"] + base[201:]), " ".join(words(8, 90)), "", None]
    docs = spark.createDataFrame([(i, x, "s") for i, x in enumerate(texts)], KINDS)
    rows = near_copies.sketches(docs, id_col="doc_id", text_col="text")
    assert [r["fp"] % (1 << 64) for r in rows.orderBy("doc_id").collect()] == [simhash.fingerprint(x, 5) for x in texts]
    node = {r["doc_id"]: r["node"] for r in rows.collect()}
    pairs = {frozenset(r) for r in near_copies.printed(rows).collect()}
    assert pairs == {frozenset((node[i], node[k])) for i in range(4) for k in range(i) if (simhash.fingerprint(texts[i], 5) ^ simhash.fingerprint(texts[k], 5)).bit_count() <= 2}
    assert pairs
    calls = []
    monkeypatch.setattr(simhash, "links", lambda *a, f=simhash.links, **b: calls.append(1) or f(*a, **b))
    assert sorted(r["doc_id"] for r in near_copies.keep_one(docs).collect()) == [0, 3, 4] and calls


def test_op3_byte_bpe_pipeline_plans_keep_no_ranks_as_text(spark):
    from linkloom.llm import byte_bpe
    from linkloom.llm.queries import vocabulary

    ranks = byte_bpe.read_ranks(vocabulary("byte_bpe_multi_50k.tiktoken"))
    found = byte_bpe.encode(spark.createDataFrame([(1, "some unseenwordings", "s")], KINDS), ranks, max_frequent=10)
    assert found.count() == 1
    formatted = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    assert len(found._jdf.queryExecution().explainString(formatted)) < 2 * byte_bpe.PLAN_TEXT


def test_op3_byte_bpe_ranks_are_no_literals_and_rows_of_words_may_end_anywhere(spark, monkeypatch):
    import hashlib

    from linkloom.llm import byte_bpe
    from linkloom.llm.queries import vocabulary

    ranks = byte_bpe.read_ranks(vocabulary("byte_bpe_multi_50k.tiktoken"))
    texts = ["some unseenwordings, foldedagain  andagain", None, "", " x\n\nqwzxv" + "ab" * 700, "some unseenwordings zzzyq qqqzzté世界 foldedagain", "qwzxv qqqzzt"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    for words, size, most in ((2, 1 << 20, 4), (8192, 10, 100), (8192, 1 << 20, 100)):
        for name, value in {"ROW_WORDS": words, "ROW_BYTES": size, "MAX_WORDS": most}.items():
            monkeypatch.setattr(byte_bpe, name, value)
        found = byte_bpe.encode(docs, ranks, with_ids=True, max_frequent=1)
        for r in found.collect():
            text = texts[r["doc_id"]] or ""
            ids = [i for w in byte_bpe.words_of(text) for i in ([ranks[w.encode()]] if w.encode() in ranks else byte_bpe.merge_long(w.encode(), ranks))]
            assert (r["n_tokens"], r["ids"], r["decoded_sha256"]) == (len(ids), ids, hashlib.sha256(text.encode()).hexdigest())
        assert found.count() == len(texts)
    kept = spark.conf.get("spark.sql.maxPlanStringLength")
    spark.conf.set("spark.sql.maxPlanStringLength", str(1 << 27))  # nothing is cut from the plan's text
    formatted = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("extended")
    found = byte_bpe.encode(docs, ranks, max_frequent=1)
    spark.conf.set("spark.sql.maxPlanStringLength", str(1 << 27))
    assert len(found._jdf.queryExecution().explainString(formatted)) < 200_000
    spark.conf.set("spark.sql.maxPlanStringLength", kept)
