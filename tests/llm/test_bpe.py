import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from docquarry.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "a   b\n", "\n\n a", "\t\tx", "don't we'll 'tis I'VE", "x y  z\x85w\x1cv\x0bq", "日本語 テスト 🙂🙂", "é́ ñ", "12345 678,9", "a<|endoftext|>b <|endoftext|>", "<|endoftext|", "!!!'s it's''s", "\r\n \r\n", " \n \n ", "ﬁ Ⅷ ² ½", "a​b", "﻿x", "=" * 300 + " " * 300 + "-" * 99]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_as_the_library(library, spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect() if r.text]
    for text in [*ODD, *texts]:
        want = library.encode(text, add_special_tokens=False).ids
        assert bpe.encode(PATH, text) == want, text[:80]
        v, e = bpe.loaded(PATH)
        n, ids, decoded = bpe.round_trip(v, e, text)
        assert (n, ids) == (len(want), hashlib.sha256(",".join(map(str, want)).encode()).hexdigest())
        assert decoded == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()


def test_random_strings(library):
    rng = random.Random(4)
    alphabet = "ab  \n\t'sté1!<|endoftext|>ß日" + "  e"
    for _ in range(400):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60)))
        assert bpe.encode(PATH, text) == library.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("unit", ["a", "ab", "=", "'", "!'s", " ", "\n", "0", "日", "é'", "the", "-_", "a1"])
def test_long_runs_stream(library, unit):
    text = "x " + unit * (200_000 // len(unit)) + " end"
    assert bpe.encode(PATH, text) == library.encode(text, add_special_tokens=False).ids


def test_memory_stays_bounded():
    v = bpe.loaded(PATH)[0]
    e = bpe.Encoder(v)
    most = 0
    for _ in range(60):
        e.feed("abcdefgh" * 1000)
        most = max(most, len(e.left))
    assert most <= bpe.SLICE + 8000
    e.finish()


def test_tokens_are_stable_under_any_continuation(library):
    v = bpe.loaded(PATH)[0]
    e = bpe.Encoder(v)
    rng = random.Random(2)
    letters = "etaoinshrdlu"
    for _ in range(100):
        head = "".join(rng.choice(letters) for _ in range(v.lookahead + 60)).encode()
        stable, end = [], 0
        for t in e.merged(head):
            end += len(v.token_bytes[t])
            if end > 60:
                break
            stable.append(t)
        for _ in range(3):
            tail = "".join(rng.choice(letters) for _ in range(20)).encode()
            assert e.merged(head + tail)[: len(stable)] == stable


def test_decoder_waits_for_whole_characters():
    v = bpe.loaded(PATH)[0]
    ids = bpe.encode(PATH, "🙂é日本")
    d = bpe.Decoder(v)
    assert "".join([d.feed([i]) for i in ids] + [d.finish()]) == "🙂é日本"
    assert d.feed(ids[:1]) + d.finish() == "�"


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 5), (None, "", 6), (2, "a b", 7), (2, "a b", 7)], "doc_id long, text string, n_tokens int")
    out = bpe.encode_decode(spark, docs, PATH).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert [(r.n_tokens, r.ids_sha256 == empty, r.decoded_sha256 == empty) for r in out] == [(0, True, True), (0, True, True), (2, False, False), (2, False, False)]
    assert bpe.encode_decode(spark, docs.where("false"), PATH).count() == 0
    assert [r.ids for r in bpe.encode_texts(spark, docs, PATH).collect()][2] == bpe.encode(PATH, "a b")


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b", "d", "e")], "doc_id long, text string, _d string, _digest string")
    row = bpe.encode_decode(spark, docs, PATH).first()
    assert (row._d, row._digest, row.n_tokens, len(row)) == ("d", "e", 2, 7)


@pytest.mark.parametrize("change", [("pre_tokenizer", {"type": "Whitespace"}), ("normalizer", {"type": "NFC"}), ("pre_tokenizer", {"type": "ByteLevel", "add_prefix_space": True, "use_regex": True}), ("decoder", None), ("model", {"type": "WordPiece"})])
def test_other_kinds_of_vocabulary_are_refused(change):
    spec = {"model": {"type": "BPE"}, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}, "decoder": {"type": "ByteLevel"}, "added_tokens": [{"id": 0, "content": "x"}]}
    bpe.check_kind(spec)
    with pytest.raises(ValueError):
        bpe.check_kind({**spec, change[0]: change[1]})
