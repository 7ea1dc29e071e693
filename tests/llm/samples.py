"""Invented texts for the tests."""

import random


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(["The", "tion", "andre", "shed", "über", "élan", "von", "esta"]) + r.choice("abcdefgh") + r.choice(["", "ing", "en", ","]) for _ in range(words))
