import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from zonalpanel.llm import byte_bpe, queries

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
with open(PATH, "rb") as file:
    RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
LIBRARY = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})
ODD = [
    "", " ", "it's I'LL 's ''s don't", "a\x1cb \x85 \xa0 c d　", "日本語 한국어 ①² ½", "😀😀 x️", "<|endoftext|>", "\n\n \n\t a",
    "x" * 3000, "ab" * 700 + "a", "=" * 257, "=" * 256, " " * 1000, "漢字" * 300, "\x00\x7f", "aaa aaaa aaaaa" * 20,
]


def random_texts(n):
    rng = random.Random(3)
    common = [32, 32, 10, 39, 46, 97, 98, 101, 115, 116, 0xC3, 233, 768, 0x4E00, 0x1F600]
    return ["".join(chr(rng.choice(common) if rng.random() < 0.9 else rng.randrange(1, 0xD7FF)) for _ in range(600)) for _ in range(n)]


def test_ids_and_bytes_are_the_librarys():
    encoder = byte_bpe.ByteEncoder(PATH, PATTERN)
    texts = ODD + random_texts(60)
    for text, data in zip([*texts, None], encoder.encode_texts([*texts, None]), strict=True):
        ids = np.frombuffer(data, "<u4")
        assert ids.tolist() == LIBRARY.encode_ordinary(text or "")
        assert encoder.decode(ids) == (text or "").encode()


def test_merges_in_step_and_alone_agree():
    encoder = byte_bpe.ByteEncoder(PATH, PATTERN)
    rng = random.Random(4)
    for size in (2, 8, 64, 256):
        pieces = [bytes(rng.choice(b"abthe ") for _ in range(rng.randint(size // 2 + 1, size))) for _ in range(30)]
        assert encoder.merge_in_step(pieces, size) == [encoder.merge_alone(p) for p in pieces]


def test_long_texts_and_a_full_dictionary(monkeypatch):
    encoder = byte_bpe.ByteEncoder(PATH, PATTERN)
    monkeypatch.setattr(byte_bpe, "LONG_TEXT", 400)
    monkeypatch.setattr(byte_bpe, "KNOWN", 60)
    for text in random_texts(10):
        assert np.frombuffer(encoder.encode_texts([text])[0], "<u4").tolist() == LIBRARY.encode_ordinary(text)


def test_round_trip_of_a_table(documents, corpus):
    rows = byte_bpe.decode(byte_bpe.encode(documents(corpus), PATH, PATTERN), PATH, PATTERN).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(i) for i, _ in corpus)
    expected = {tuple(LIBRARY.encode_ordinary(t or "")): (t or "").encode() for _, t in corpus}
    assert {tuple(r.ids): bytes(r.decoded) for r in rows} == expected


def test_query_digests(spark, tmp_path, documents, corpus):
    rows = [r for r in corpus if r[0] is not None and r[0] < 75]
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in queries.op13_byte_bpe(spark, str(tmp_path)).collect()}

    def digest(data):
        return hashlib.sha256(data).hexdigest()

    expected = set()
    for i, text in rows:
        ids = LIBRARY.encode_ordinary(text or "")
        expected.add((i, len(ids), digest(",".join(map(str, ids)).encode()), digest((text or "").encode())))
    assert got == expected


def test_empty_table_clashing_column_and_unknown_ids(spark, documents):
    assert byte_bpe.encode(documents([]), PATH, PATTERN).count() == 0
    given = spark.createDataFrame([(1, [], "old"), (2, None, "old")], "doc_id int, ids array<int>, decoded string")
    assert [bytes(r.decoded) for r in byte_bpe.decode(given, PATH, PATTERN).collect()] == [b"", b""]
    wrong = spark.createDataFrame([(1, [99_999_999])], "doc_id int, ids array<int>")
    with pytest.raises(Exception, match="not in the vocabulary"):
        byte_bpe.decode(wrong, PATH, PATTERN).collect()
