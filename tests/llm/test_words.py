"""How words of letters beyond ASCII are split before they are encoded."""

import random
import unicodedata

import public_tokenizers
import pytest

from graphloom.llm import bpe


@pytest.fixture(scope="module")
def automaton():
    return bpe.automaton(public_tokenizers.path("word_bpe_49k.json"))


def test_plain_words_skip_the_pattern(automaton, monkeypatch):
    monkeypatch.setattr(bpe, "_SPLIT", None)
    letters = bpe.byte_letters()
    shown = lambda w: "".join(letters[b] for b in w.encode())
    assert automaton.split("Ciónllció") == [shown("ciónllció")] and automaton.split("CIÓN.") == [shown("ción"), "."]


def test_words_are_split_as_by_the_pattern(automaton):
    rng, letters = random.Random(5), bpe.byte_letters()
    pool = "aBé Ñ.,!'sΣςσİıßǅ١٢½中́ΩÅⅣ_-\x01😀" + "".join(map(chr, rng.sample(range(0x80, 0xD800), 300)))
    for _ in range(5000):
        word = "".join(rng.choice(pool) for _ in range(rng.randint(1, 6))).replace(" ", "")
        found = bpe._SPLIT.findall("".join(c.lower() for c in unicodedata.normalize("NFC", word)))
        if not word.isascii():
            assert automaton._plain(word) == ["".join(letters[b] for b in w.encode()) for w in found], word
