"""Words given to the tokenizer many at a time have the ids that it gives whole texts; words of the coder carry."""

from __future__ import annotations

import json
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from quantloom.llm import token_output

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture
def encoder():
    with open(PATH, encoding="utf-8") as f:
        return token_output.StretchEncoder(f.read())


def test_ids_are_those_of_whole_texts(encoder):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    odd = ["", None, " \t\x0b\x0c\r\n", "it's dogs' 's 'S don't. we'll!", "ÀÉÎ.ÿ µm ªº 1ª ×÷ naïve,, Straße!?", "İstanbul ΣΑΣ. ǅ éa café. Å", "a<|endoftext|>. endoftext|> <|endoftext|>b", "x_y _x x_ a-b C++ (word) \"word\" 12ab ab12 ²³¹ ½",
           "a b c\u0085d", "日本語。ok。", "</w> w</w> word</w>", "\x00a a\x00 \x1fq"]
    draw = random.Random(5)
    odd += [" ".join("".join(draw.choice("abcXYZéÀß.,!'-_1<|>́ ") for _ in range(draw.randint(1, 9))) for _ in range(40)) for _ in range(60)]
    for _ in range(2):  # asked and remembered
        got = [i.tolist() for i in encoder.encode(pa.array(odd, pa.string()))]
        assert got == [library.encode(t or "", add_special_tokens=False).ids for t in odd]


def test_library_gets_words_many_at_a_time(encoder):
    draw, asked, library = random.Random(6), [], encoder.tokenizer

    class Counting:
        def encode_batch_fast(self, texts, **options):
            asked.extend(texts)
            return library.encode_batch_fast(texts, **options)

    encoder.tokenizer = Counting()
    words = ["".join(draw.choice("abcdefghij") for _ in range(8)) for _ in range(2000)]
    text = " ".join(w + draw.choice(["", ".", "###"]) for w in words + [w.title() for w in words])
    (ids,) = encoder.encode(pa.array([text]))
    assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(asked) < len(words) / 32  # before, each word by itself and with its signs or capitals


def test_words_of_the_coder_carry():
    rng = np.random.default_rng(8)
    for names, n in ((3, 300_000), (40_000, 300_000), (1, 5000), (2, 1)):
        ids = np.minimum(rng.geometric(0.3, n) - 1, names - 1) if names < 10 else rng.integers(0, names, n)
        words, sizes = token_output.encode_block(ids, names)
        assert words.dtype == np.dtype("<u2") and sizes.sum() == len(words)
        assert np.array_equal(token_output.decode_block(words, sizes, n, names), ids)
        damaged = rng.integers(0, 1 << 16, len(words)).astype("<u2")  # wrong numbers, no error
        assert len(token_output.decode_block(damaged, sizes, n, names)) == n


def test_plain_words_pass_the_normalizer_by(encoder):
    library, asked = encoder.tokenizer, []

    class Counting:
        def encode_batch_fast(self, texts, **options):
            asked.extend(texts)
            return library.encode_batch_fast(texts, **options)

    encoder.tokenizer = Counting()
    text = "Straße straßen naïve zebra, ÀÉ zebras?! don't ab12 µm ªº"
    (ids,) = encoder.encode(pa.array([text]))
    assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
    assert sorted(asked) == ["", ",", "?!", "ab12", "don't"]  # before, every word


@pytest.mark.parametrize("change", ["capitals", "vowels", "added"])
def test_other_tokenizers_keep_their_own_rules(change):
    from tokenizers import Tokenizer

    with open(PATH, encoding="utf-8") as f:
        made = json.load(f)
    if change == "capitals":
        made["normalizer"] = None
    elif change == "vowels":
        made["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = r"[aeiou]+|[^\saeiou]+"
    else:
        made["added_tokens"].append(dict(made["added_tokens"][0], id=49408, content="ebra"))
    model = json.dumps(made)
    texts = ["Zebra zebras, the ZEBRA. naïve", "a zebra", ""]
    library = Tokenizer.from_str(model)
    got = [i.tolist() for i in token_output.StretchEncoder(model).encode(pa.array(texts))]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_long_and_unused_pieces_are_forgotten(encoder, monkeypatch):
    monkeypatch.setattr(token_output, "STRETCHES", 30)
    draw = random.Random(9)
    texts = [" ".join(["often", "x" * 70, "-" * 200] + ["".join(draw.choice("abcdef") for _ in range(5)) for _ in range(20)]) for _ in range(12)]
    for text in texts + texts:
        (ids,) = encoder.encode(pa.array([text]))
        assert ids.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
        known = encoder.known.to_pylist()
        assert len(known) <= 30 and max(map(len, known)) <= 64 and "often" in known
        assert len(encoder.ids) == len(encoder.used) == len(known)


def test_shares_of_order_0_are_a_power_of_two(monkeypatch):
    rng = np.random.default_rng(10)
    ids = np.minimum(rng.geometric(0.01, 60_000) - 1, 2999)
    words, sizes = token_output.encode_block(ids, 3000)
    for n in (1, 3000, 20_000):
        model = token_output._Model(n, 4, 2, finds=True)
        assert model.share[:-1].sum() == 1 << int(model.bits) and model.share[:-1].min() > 0
        assert model.finds == (n < 1 << 14)
    monkeypatch.setattr(token_output, "FOUND_BITS", 0)  # looked up by order, not in a list
    assert np.array_equal(token_output.decode_block(words, sizes, len(ids), 3000), ids)
