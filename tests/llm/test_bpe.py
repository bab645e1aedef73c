import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from zonalpanel.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
ODD = [
    "", "  ", "<|endoftext|>a<|startoftext|>", "a<|endoftext|>b", "<|endoftext|", "ΣΑΣ ΑΣ", "İstanbul DŽ ǅ", "é x́",
    " a b\x85c\x1cd", "aaaaaaaaa aaa bbbbbbb", "日本語 한국어 ①²", "it's I'LL 'sx ''s don't", "a\xa0b​c", "😀😀 x️", "x" * 5000,
    "x×y÷z ÀÉÞß Ÿÿ ÃŽa1b22 3½", "a\x00b \x7f", "<| |> <|x|>", "END. end, (end) [1] a-b_c",
]


def random_texts(n):
    rng = random.Random(1)
    common = [32, 32, 39, 46, 66, 115, 100, 0xC3, 233, 300, 768, 0x345, 0x3A3, 0x1F600, 0xD7]
    return ["".join(chr(rng.choice(common) if rng.random() < 0.9 else rng.randrange(1, 0x3000)) for _ in range(500)) for _ in range(n)]


def test_ids_and_decoding_are_the_librarys():
    encoder = bpe.encoder(PATH)
    texts = ODD + random_texts(40)
    for text, data in zip([*texts, None], encoder.encode_texts(pa.array([*texts, None])), strict=True):
        ids = np.frombuffer(data, "<u4")
        expected = LIBRARY.encode(text or "", add_special_tokens=False).ids
        assert ids.tolist() == expected
        assert encoder.decode(ids) == LIBRARY.decode(expected, skip_special_tokens=False)


def test_other_kinds_of_files_are_refused():
    with pytest.raises(ValueError):
        bpe.Encoder(public_tokenizers.path("byte_bpe_50k.json"))


def test_round_trip_of_a_table(spark, documents, corpus):
    rows = bpe.decode(bpe.encode(documents(corpus), PATH), PATH).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(i) for i, _ in corpus)
    by_ids = {}
    for _, text in corpus:
        ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
        by_ids[np.array(ids, "<u4").tobytes()] = LIBRARY.decode(ids, skip_special_tokens=False)
    assert {bytes(r.ids): r.decoded_text for r in rows} == by_ids


def test_empty_table_and_clashing_column(spark, documents):
    assert bpe.encode(documents([]), PATH).count() == 0
    given = spark.createDataFrame([(1, bytearray(b""), "old"), (2, None, "old")], "doc_id int, ids binary, decoded_text string")
    assert [r.decoded_text for r in bpe.decode(given, PATH).collect()] == ["", ""]
