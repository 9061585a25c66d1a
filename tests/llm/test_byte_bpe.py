import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from demandspark.llm import byte_bpe

from edge import edge_docs, edge_rows, empty_docs, prose

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def model():
    return byte_bpe.ByteBpe(byte_bpe.load_ranks(PATH), public_tokenizers.PATTERN)


def test_round_trip_of_edge_rows(spark, reference):
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"])
                 for r in byte_bpe.round_trip(edge_docs(spark), PATH, public_tokenizers.PATTERN).collect())
    want = []
    for doc, text, *_ in edge_rows():
        ids = reference.encode_ordinary(text or "")
        want.append((str(doc), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want)
    assert byte_bpe.round_trip(empty_docs(spark), PATH, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("text", [
    "a  b", "a \n b", " lead", "trail  ", "\n\n\n", "a  b", "tab\t\tx", "don't we'll I'M", "12 345 6²", "\x1c x \x1c",
    "a​b　 c", "é ́x", "<|endoftext|>", "🙂🙂🙂 ok", "x" * 700, "ab" * 400, "Donaudampfschifffahrt" * 30,
    "漢字" * 300, "\u0085a b", "===--->>>", prose(2, 50).replace(" ", "  ")])
def test_against_tiktoken(model, reference, text):
    ids = model.encode([text])[0]
    assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(text)
    assert model.decode([ids])[0] == text.encode()


def test_random_long_words(model, reference):
    rng = np.random.default_rng(3)
    letters = np.array(list("aetionshrdlu"))
    texts = ["".join(rng.choice(letters, n)) for n in (200, 257, 300, 900, 2500)]
    for text, ids in zip(texts, model.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(text)


@pytest.mark.parametrize("kind,n", [("letters", 20_000), ("letters", 200_000), ("one", 200_000), ("blank", 200_000),
                                    ("han", 100_000), ("syllables", 60_000), ("pair", 60_000)])
def test_very_long_words(model, reference, kind, n):
    """Whole words of up to 200,000 letters, in bounded memory."""
    rng = np.random.default_rng(8)
    pools = {"letters": list("abcdefghijklmnopqrstuvwxyz"), "one": ["a"], "blank": [" "], "pair": ["ab"],
             "han": [chr(0x4E00 + i) for i in range(3000)], "syllables": ["tion", "ing", "ed", "the", "er", "re", "on"]}
    text = "".join(rng.choice(pools[kind], n))
    ids = model.encode([text])[0]
    assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(text)


def test_parts_are_cut_where_no_token_spans(model):
    word = b"qzxqvtheringtion" * 40
    parts = model._parts(word)
    assert b"".join(parts) == word and len(parts) > 1
    cuts = set(np.cumsum([len(p) for p in parts])[:-1].tolist())
    for i in range(len(word)):
        for j in range(i + 2, min(len(word), i + 40) + 1):
            if word[i:j] in model.ranks:
                assert not cuts & set(range(i + 1, j))


def test_unknown_ids_raise(model):
    with pytest.raises(ValueError):
        model.decode([np.array([60_000], "<u4").tobytes()])
