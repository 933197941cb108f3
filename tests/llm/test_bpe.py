"""The tokenizer against an independent implementation, and exact round trips."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from plumbline.llm.bpe import Codec, load_ranks, round_trip

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def encoding():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(PATH), special_tokens={})


def texts():
    r = random.Random(5)
    out = ["", " ", "a" * 700, "ab" * 333, "hello world's\n\n end", "<|endoftext|>", "\U0001F600" * 40, "x\x1c\x85 y z", "=-" * 90, "é" * 30]
    out += ["".join(r.choice("aab") for _ in range(r.randrange(65, 400))) for _ in range(10)]
    out += ["".join(chr(r.choice([r.randrange(0, 0x250), r.randrange(0x400, 0x3100)])) for _ in range(200)) for _ in range(30)]
    return out


def test_codec_is_exact(encoding):
    for text, (ids, n, back) in zip(texts(), Codec(PATH, public_tokenizers.PATTERN).encode_texts(texts()), strict=True):
        want = encoding.encode_ordinary(text)
        assert ids == " ".join(map(str, want)) and n == len(want) and back == text.encode()


def test_round_trip(odd_docs, no_docs, encoding):
    got = round_trip(odd_docs, PATH, public_tokenizers.PATTERN, ids=True, decoded=True).collect()
    source = {r["doc_id"]: r["text"] or "" for r in odd_docs.collect()}
    assert len(got) == 9
    for r in got:
        want = encoding.encode_ordinary(source[r["doc_id"]])
        assert r["ids"] == want and r["n_tokens"] == len(want) and r["decoded"] == source[r["doc_id"]]
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(source[r["doc_id"]].encode()).hexdigest()
    assert round_trip(no_docs, PATH, public_tokenizers.PATTERN).count() == 0


def test_decoding_follows_the_ids(encoding, monkeypatch):
    c = Codec(PATH, public_tokenizers.PATTERN)
    coded = c.encode(texts())
    assert c.decode([ids for _, ids in coded]) == [t.encode() for t in texts()]
    monkeypatch.setattr("plumbline.llm.bpe.DECODE_TOKENS", 7)  # sequences that go through several queries
    assert c.decode([ids for _, ids in coded]) == [t.encode() for t in texts()]
    for _, ids in coded:
        if len(ids):
            wrong = ids.copy()
            wrong[len(ids) // 2] = 1000 if ids[len(ids) // 2] != 1000 else 1001
            assert c.decode([wrong])[0] != c.decode([ids])[0] and c.decode([wrong])[0] == encoding.decode_bytes(wrong.tolist())


def test_queries_of_few_rows_give_the_same(monkeypatch):
    want = [line for line, _ in Codec(PATH, public_tokenizers.PATTERN).encode(texts())]
    monkeypatch.setattr("plumbline.llm.bpe.QUERY_ROWS", 500)
    assert [line for line, _ in Codec(PATH, public_tokenizers.PATTERN).encode(texts())] == want
