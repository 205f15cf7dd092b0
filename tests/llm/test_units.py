"""Units of words and marks take a short way to their ids, the same as the library's."""

import random

import numpy as np
import regex
from tokenizers import Tokenizer

from placewise.llm import queries, tokens

PATH = queries.vocabulary("byte_bpe_50k.json")


def test_ids_of_words_marks_and_blanks_are_the_librarys(monkeypatch):
    draw = random.Random(4)
    words = ["the", "House", "don't", "we'll", "'s", "l'été", "straße", "日本", "ªº", "x1", "12", "naïve", "_", "é", "ɐɑ", "á", "word", "Ω"]
    ends = ["", "", ".", ",", "...", "!?", "'", "',", "\"", "_", ")", "。", "\n", ".\nThat"]
    texts = ["".join(draw.choice(words) + draw.choice(ends) + draw.choice([" "] * 8 + ["  ", "\n", " ", "\t "]) for _ in range(60)) for _ in range(80)] + ["", " ", "the"]
    model = Tokenizer.from_file(PATH)
    want = [np.array(model.encode(t, add_special_tokens=False).ids, np.uint16).tobytes() for t in texts]
    for most in (500_000, 5, 0):
        monkeypatch.setattr(tokens, "REMEMBERED", most)
        encode = tokens._encoder(PATH, "uint16", True)
        assert encode(texts) == want and [encode([t])[0] for t in texts] == want


def test_new_words_with_marks_need_no_pattern(monkeypatch):
    seen, compiled = [], regex.compile

    class Counted:
        def __init__(self, *given):
            self.pattern = compiled(*given)

        def findall(self, text):
            seen.append(text)
            return self.pattern.findall(text)

    monkeypatch.setattr(regex, "compile", Counted)
    encode = tokens._encoder(PATH, "uint16", False)
    encode([" ".join(f"word{a}{b}{end}" for a in "abcdefgh" for b in "éstuv" for end in ("", ".", ",")) for _ in range(3)])
    assert len(seen) == 3  # each text's first unit
