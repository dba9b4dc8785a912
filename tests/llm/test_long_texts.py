"""Words beyond the fold, and texts beyond a megabyte, against the libraries."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest

from linkloom.llm import byte_bpe, token_counts, token_output
from linkloom.llm.queries import vocabulary

public = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    word = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=3000))
    long = " ".join("".join(rng.choices("etaoinshr", k=rng.randint(1, 8))) for _ in range(260_000))
    assert len(long) > 1 << 20
    return [word, f"{word} {word}, x", "é" * 2000, long, long[: 1 << 20] + " wide 漢字", "short"]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def test_byte_bpe(docs, texts):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = byte_bpe.read_ranks(vocabulary("byte_bpe_multi_50k.tiktoken"))
    assert ranks == {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary("byte_bpe_multi_50k.tiktoken").splitlines())}
    library = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for most in (byte_bpe.MAX_FREQUENT, 10):  # how many words are folded ahead changes nothing
        for r in byte_bpe.encode(docs, ranks, max_frequent=most).collect():
            ids = library.encode_ordinary(texts[r["doc_id"]])
            assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_token_counts(docs, texts):
    sentencepiece = pytest.importorskip("sentencepiece")
    library = sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    for r in token_counts.count_tokens(docs, vocabulary("piece_bpe_32k.model")).collect():
        assert r["n_tokens"] == len(library.encode(texts[r["doc_id"]]))


def test_token_output(spark, docs, texts, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    token_output.write_tokens(docs, str(tmp_path / "tokens"), vocabulary("byte_bpe_50k.json").decode(), end_id=2)
    start = 0
    for r in sorted(token_output.token_index(spark, str(tmp_path / "tokens")).collect()):
        ids = [*library.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_words_go_to_the_model_alone(monkeypatch):
    """New words of plain texts skip the library's splitting and are encoded once; ids stay those of the library, over generations of the memory too."""
    monkeypatch.setattr(token_output, "MEMO_ENTRIES", 40)
    encoder = token_output.WordEncoder(vocabulary("byte_bpe_50k.json").decode())
    library, rng = encoder.library, random.Random(5)

    class ModelOnly:
        def __init__(self):
            self.seen = []
            self.model = self

        def tokenize(self, word):
            self.seen.append(word)
            return library.model.tokenize(word)

    encoder.library = only = ModelOnly()
    letters = [*map(chr, range(256)), "e", "t", " ", " "]
    plain = ["".join(rng.choices(letters, k=k)) for k in (0, 1, 2, 30, 300) for _ in range(20)] + ["".join(map(chr, range(256))), "it's  they'll\r\n\x85 \xa0x"]
    for texts in (plain[:60], plain[60:], plain):
        found = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)]
        assert found == [library.encode(x, add_special_tokens=False).ids for x in texts]
    monkeypatch.setattr(token_output, "MEMO_ENTRIES", 1000)
    before = len(only.seen)
    encoder.encode(["again again again", " again again"])
    assert len(only.seen) - before <= 2
