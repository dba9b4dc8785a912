"""Token alignment, toxicity and vector codes against brute-force versions, libraries and edge cases."""

import bisect
import collections
import hashlib
import random
import zlib

import numpy as np
import pytest

from linkloom.llm import token_alignment, toxicity, vector_codes
from linkloom.llm.queries import QUERIES, vocabulary

public = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id bigint, text string, label int, block string, n_a string, score string"

# Token alignment

ODD = [
    None, "", " ", "  ", "\n", "\n\n", " \n ", "a", "▁", "x▁y", "<0x0A>", "<s> </s> <unk>", "<|endoftext|> x", "é漢字😀　x", "a\tb", "a\x1cb", "\x85x", "a b",
    "  two  words \n\n three\n", "\n a\n  b \n\n", "it's we'll 's", "\x00a b", "x" * 3000, "end ", "end  ", "The the THE the",
]


@pytest.fixture(scope="module")
def files():
    return vocabulary("byte_bpe_50k.json").decode(), vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def brute(files):
    """A function from a text to (ids of A, ids of B, links as (id, id) of occurrences, groups) by plain loops over the libraries' tokens."""
    import sentencepiece
    from tokenizers import Tokenizer

    library = Tokenizer.from_str(files[0])
    library.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_proto=files[1])
    shown = {c: b for b, c in _bytes_to_unicode().items()}
    entries = {i: bytes(shown[c] for c in e) for e, i in library.get_vocab(with_added_tokens=False).items() if all(c in shown for c in e)}

    def spans(tokens):
        ends = np.cumsum([len(t) for t in tokens]).tolist()
        return list(zip([0, *ends[:-1]], ends, strict=True))

    def run(text):
        if not text:
            return [], [], [], []
        a, b = library.encode(f" {text}", add_special_tokens=False).ids, pieces.encode(text)
        bytes_a = [entries[i] for i in a]
        bytes_b = [bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not b"".join(bytes_a) == b"".join(bytes_b) == f" {text}".encode():
            return [], [], [], []
        at_a, at_b = spans(bytes_a), spans(bytes_b)
        starts, links = [s for s, _ in at_b], []
        for i, (begin, end) in zip(a, at_a, strict=True):
            j = max(0, bisect.bisect_right(starts, begin) - 1)
            while j < len(b) and at_b[j][0] < end:
                if at_b[j][1] > begin:
                    links.append((i, b[j]))
                j += 1
        groups, i, j = [], 0, 0
        for cut in sorted({e for _, e in at_a} & {e for _, e in at_b}):
            own_a, own_b = [], []
            while i < len(a) and at_a[i][1] <= cut:
                own_a.append(a[i])
                i += 1
            while j < len(b) and at_b[j][1] <= cut:
                own_b.append(b[j])
                j += 1
            groups.append(",".join(map(str, own_a)) + "|" + ",".join(map(str, own_b)))
        return a, b, links, groups

    return run


def _bytes_to_unicode():
    """The usual display of bytes in byte-level vocabularies."""
    out, extra = {}, 0
    for b in range(256):
        if chr(b).isprintable() and b != 32 and b != 0xA0 and b != 0xAD:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return out


def test_alignment_of_random_texts(files, brute):
    rng = random.Random(5)
    texts = [*ODD, *("".join(rng.choices(" \n\tabthe,.<▁漢😀é'0", k=rng.randint(0, 50))) for _ in range(800)), *("".join(rng.choices(" \nabthe,.é'", k=rng.randint(0, 60))) for _ in range(800))]
    aligner = token_alignment.Aligner(token_alignment.TwoEncoders(*files))
    assert aligner.encoders.apart
    documents = [aligner.take(t) for t in texts]
    aligner.flush()
    for text, document in zip(texts, documents, strict=True):
        a, b, links, groups = brute(text)
        counts, digest, pairs, times = document.result()
        assert counts == [len(a), len(b), len(groups), len(links)], repr(text)
        assert digest == (hashlib.sha256(";".join(groups).encode()).hexdigest() if a else "")
        found = {(p >> token_alignment.ID_BITS, p & ((1 << token_alignment.ID_BITS) - 1)): n for p, n in zip(pairs.tolist(), times.tolist(), strict=True)}
        assert found == collections.Counter(links)


def test_alignment_in_parts(files, brute, monkeypatch):
    """Texts longer than a part, chunks that are forgotten, memories that roll over."""
    monkeypatch.setattr(token_alignment, "ALIGN_BYTES", 4096)
    monkeypatch.setattr(token_alignment, "JOINED_CHARS", 100)
    monkeypatch.setattr(token_alignment, "MEMO_ENTRIES", 50)
    monkeypatch.setattr(token_alignment, "MEMO_CHARS", 5)
    rng = random.Random(6)
    texts = [" ".join("".join(rng.choices("abcdeé.", k=rng.randint(1, 9))) for _ in range(n)) for n in (3000, 10, 4000, 1)]
    aligner = token_alignment.Aligner(token_alignment.TwoEncoders(*files))
    documents = [aligner.take(t) for t in texts]
    aligner.flush()
    for text, document in zip(texts, documents, strict=True):
        a, b, links, groups = brute(text)
        counts, digest, pairs, times = document.result()
        assert (counts, digest) == ([len(a), len(b), len(groups), len(links)], hashlib.sha256(";".join(groups).encode()).hexdigest())
        assert len(pairs) == len(set(links)) and times.sum() == len(links)


def expected_links(texts, brute):
    results = [brute(t) for t in texts]
    count = collections.Counter(p for _, _, links, _ in results for p in set(links))
    best = collections.Counter()
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    return [
        (len(a), len(b), len(groups), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if a else "")
        for a, b, links, groups in results
    ]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_link_tokens(spark, files, brute, monkeypatch):
    monkeypatch.setattr(token_alignment, "BLOCK_BYTES", 1000)  # reaches the tasks with the function
    texts = [*ODD, "again the same", "again the same"]
    rows = [(i, t, None, "own", "own", "own") for i, t in enumerate(texts)] + [(None, "no id here", 1, None, None, None), (3, texts[3], 1, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = token_alignment.link_tokens(docs, *files).collect()
    expected = [(r[0], *e) for r, e in zip(rows, expected_links([r[1] for r in rows], brute), strict=True)]
    key = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted(((r["doc_id"], *(r[c] for c in COLUMNS)) for r in found), key=key) == sorted(expected, key=key)
    assert token_alignment.link_tokens(spark.createDataFrame([], SCHEMA), *files).count() == 0


def test_link_tokens_of_all_documents(spark, data, brute):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    found = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in QUERIES["op11_token_alignment"](spark, data).collect()}
    assert found == dict(zip(texts, expected_links(list(texts.values()), brute), strict=True))


# Toxicity


def test_toxicity_separates_planted_words(spark):
    rng = random.Random(7)
    calm = ["lorem", "ipsum", "dolor", "sit", "amet", "tempor", "labore", "magna", "aliqua", "veniam"]
    rows, labels = [], []
    for i in range(400):
        words = rng.choices(calm, k=rng.randint(20, 60))
        toxic = i % 4 == 0
        for _ in range(3 * toxic):
            words[rng.randrange(len(words))] = rng.choice(["Scoundrel", "blockhead!", "numbskull"])
        rows.append((i, " ".join(words), None, "b", "n", "own"))
        if i < 300:
            labels.append((i, int(toxic)))
    edge = [(1000, None, None, None, None, None), (1001, "", None, None, None, None), (1002, "... !!!", None, None, None, None), (None, "lorem numbskull blockhead", None, None, None, None), (5, rows[5][1], None, None, None, None), (1003, "lorem ipsum " * 50_000 + "z" * 5000, None, None, None, None)]
    docs = spark.createDataFrame(rows + edge, SCHEMA)
    known = spark.createDataFrame([*labels, (None, 1), (7, None)], "id bigint, label int")
    found = collections.defaultdict(list)
    for r in toxicity.classify(docs, known).collect():
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
        found[r["doc_id"]].append(r["score"])
    assert len(found[5]) == 2 and len(set(found[5])) == 1 and len(found[1000]) == len(found[1003]) == len(found[None]) == 1
    assert found[1000] == found[1001] == found[1002]
    assert all((found[i][0] >= 0.5) == (i % 4 == 0) for i in range(300, 400))
    assert toxicity.classify(spark.createDataFrame([], SCHEMA), known).count() == 0
    flat = {round(r["score"], 9) for r in toxicity.classify(docs, known.limit(0)).collect()}
    assert len(flat) == 1  # nothing is known


def test_toxicity_pieces_and_profiles():
    assert toxicity.pieces("Abcdef abc") == {" abcdef ", " abc ", " abcd", " abcde", " abcdef"} - {" abcd"} | {" abcd", " abc "}
    assert toxicity.g_statistic(5, 10, 50, 100) == pytest.approx(0) and toxicity.g_statistic(10, 10, 0, 100) > 40
    kept = toxicity.toxic_pieces([(" villa", 50, 0), (" villain", 50, 0), (" villain ", 50, 0), (" villainy ", 3, 0), (" the ", 90, 900)], 100, 1000)
    assert kept == [" villain "]
    words = toxicity.Dictionaries(b" villain  rogue ", b" lorem  ipsum ")
    plain, marked = np.array(toxicity.profile("lorem ipsum lorem", words)), np.array(toxicity.profile("lorem VILLAIN lorem", words))
    assert plain.sum() == marked.sum() == 3 and marked[toxicity.LOW + 3 :].sum() == 1 and plain[toxicity.LOW + 3 :].sum() == 0
    assert list(toxicity.words("x" * 130)) == ["x" * 64, "x" * 64, "xx"]


def test_toxicity_query_on_held_out_labels(spark, data):
    rows = {r["doc_id"]: r for r in QUERIES["op12_toxicity"](spark, data).collect()}
    assert len(rows) == spark.read.parquet(f"{data}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for i, r in rows.items())


# Vector codes


def plain_codes(vectors, parts, entries, rounds):
    """(code, error) of each integer vector and the codebooks, by plain rounds with Python's integers; vectors are in order of their ids."""
    width = len(vectors[0]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in vectors]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            groups = collections.defaultdict(list)
            for c in cut:
                groups[nearest(c[p], book)[1]].append(c[p])
            for i, members in groups.items():
                book[i] = [sum(column) // len(members) for column in zip(*members, strict=True)]
    found = [[nearest(c[p], books[p]) for p in range(parts)] for c in cut]
    return [("".join(f"{i:02x}" for _, i in f), sum(d for d, _ in f)) for f in found], hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()


VECTORS = "vec_id bigint, embedding array<double>, label int, entry int, v string, id string"


@pytest.mark.parametrize("size", [1.0, 0.002, 1e15])
def test_vector_codes_against_plain_rounds(spark, size):
    """Many ties (few distinct small vectors), usual ones, and numbers beyond exact doubles."""
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, size) for _ in range(8)], rng.choice([None, 1, 1, 1, 2]), 1, "v", "x") for i in range(120)]
    odd = [(500, None, 1, 1, "v", "x"), (501, [1.0, None, *[1.0] * 6], 1, 1, "v", "x"), (502, [float("nan")] * 8, 1, 1, "v", "x"), (503, [float("inf")] * 8, 1, 1, "v", "x"), (504, [], 1, 1, "v", "x"), (505, [1.0] * 7, 1, 1, "v", "x")]
    last = [(600, rows[3][1], 2, 1, "v", "x"), (600, rows[3][1], 2, 1, "v", "x"), (None, rows[4][1], None, 1, "v", "x")]
    out = vector_codes.encode(spark.createDataFrame(rows + odd + last, VECTORS).repartition(3), entries=10, rounds=3).collect()
    kept = rows + last
    codes, digest = plain_codes([[int(np.floor(x * 1024.0)) for x in r[1]] for r in kept], 4, 10, 3)
    total = collections.Counter()
    for r, (_, error) in zip(kept, codes, strict=True):
        total[r[2]] += error
    most = vector_codes.MOST
    expected = [(r[0], code, min(most, error), min(most, total[r[2]]), digest) for r, (code, error) in zip(kept, codes, strict=True)]
    key = lambda r: (-1 if r[0] is None else r[0], *r[1:])
    assert sorted((tuple(r) for r in out), key=key) == sorted(expected, key=key)


def test_vector_codes_edge_cases(spark):
    none = spark.createDataFrame([], VECTORS)
    assert vector_codes.encode(none).count() == 0
    few = vector_codes.encode(spark.createDataFrame([(1, [0.5] * 4, None, 1, "", ""), (2, [0.25] * 8, None, 1, "", "")], VECTORS)).collect()
    assert [(r["vec_id"], r["code"], r["error"], r["label_error"]) for r in few] == [(1, "00000000", 0, 0)]  # the other length takes no part
    with pytest.raises(ValueError, match="between"):
        vector_codes.encode(none, entries=257)


def test_bounds_prune_and_stay_safe():
    """Few pairs are compared after the first round, and bounds hold on both sides."""
    rng = np.random.default_rng(9)
    centres = rng.integers(-500, 500, (64, 16))
    x = centres[rng.integers(0, 64, 2000)] + rng.integers(-20, 20, (2000, 16))
    books = vector_codes.Codebooks(x[:64].reshape(1, 64, 16).astype(np.int64))
    entry, upper, lower = vector_codes.first(x, books.entries[0])
    for _ in range(4):
        upper, lower = vector_codes.above(upper), vector_codes.below(lower)
        sums = {(0, e): (int((entry == e).sum()), x[entry == e].sum(axis=0).tolist()) for e in np.unique(entry)}
        books = books.replaced(sums)
        entry, upper, lower, compared = vector_codes.again(x, books.entries[0], entry, upper, lower, books.moved[0], books.half[0])
        exact = np.sqrt(vector_codes.distances(x, books.entries[0]))
        assert (entry == np.argmin(exact, axis=1)).all()
        assert (lower <= exact).all() and (upper >= exact[np.arange(len(x)), entry]).all()
    assert compared < 0.1 * x.shape[0] * 64
    values = np.array([0.0, 1e-9, 0.1, 3.3, 2049.0, 65503.0, 1e9])
    assert (vector_codes.below(values) <= values).all() and (vector_codes.above(values) >= values).all()
