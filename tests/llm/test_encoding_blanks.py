"""Ids by the pattern that looks nowhere ahead against the tokenizers library, on blanks of all kinds."""

import random

import public_tokenizers
from tokenizers import Tokenizer

from webfacts.llm import packing

BLANKS = ["\t", "\n", "\x0b", "\x0c", "\r", " ", "\x85", "\xa0", " ", " ", " ", " ", " ", "　"]
OTHER = ["\x1c", "\x1f", "​", "﻿", "᠎", "a", "Zq", "é", "7", "42", "'s", "'", "!?", "<|endoftext|>", "\U0001f600", "和"]


def test_ids_with_any_blanks():
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    whole.encode_special_tokens = True
    encode, rng = packing.encoder("byte_bpe_50k.json"), random.Random(5)
    texts = ["", " ", "  ", " \n", "a  b", "a \x1cb", "a\n\n b", "  a", "a  ", "a \n\n  \n"]
    texts += ["".join(rng.choices(BLANKS + [" "] * 8 + ["\n"] * 4 if rng.random() < 0.6 else OTHER, k=1)[0] for _ in range(rng.randint(1, 30))) for _ in range(8000)]
    for t in texts:
        assert encode(t).tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t)


def test_one_call_for_a_text_without_runs_of_blanks():
    calls = []
    packing._ids(lambda x: calls.append(x) or [], "one two\nthree  ")
    packing._ids(lambda x: calls.append(x) or [], "a  b\n\n\tc")
    assert calls == ["one two\nthree  ", "a ", " b\n\n", "\tc"]
