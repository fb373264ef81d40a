"""Obfuscated forms, and Viterbi decoding against all readings enumerated."""

from __future__ import annotations

import math
import random
from functools import cache

import numpy as np
import pytest

from rosterlake.llm import toxicity

WORDS = "ass shit idiot moron fuck stupid the and of to house garden window letter people".split()


@cache
def model() -> np.ndarray:
    counts = np.zeros((64, 64, 64))
    for word in WORDS:
        k = [0, 0, *toxicity.classes_of(word), 0]
        for a, b, c in zip(k, k[1:], k[2:], strict=False):
            counts[a, b, c] += 50
    return toxicity.smoothed(counts)


@pytest.mark.parametrize(
    "token,word",
    [("a$$", "ass"), ("$h!7", "shit"), ("5h17", "shit"), ("!diot", "idiot"), ("id-iot", "idiot"), ("f*ck", "fuck"),
     ("1d10t", "idiot"), ("m0r0n!", "moron"), ("stuuupid", "stupid"), ("|d|ot", "idiot")],
)
def test_forms_are_restored(token, word):
    assert toxicity.hides_something(token)
    reader = toxicity.Reader(model())
    assert word in reader.words(token) and reader.restored(f"the {token} of") == f"the {word} of"


def test_spaced_letters():
    reader = toxicity.Reader(model())
    assert "ass" in {w for t in reader.tokens("you a s s there") for w in reader.words(t)}
    assert reader.restored("the a s s of") == "the ass of"


@pytest.mark.parametrize("token", ["house", "2024", "38.101.105.188", "...", "!", "-", "", "4111111111111111", "(437)"])
def test_plain_tokens_stay(token):
    assert not toxicity.hides_something(token)


@pytest.mark.parametrize("token", ["+1", "+12", "+49-170", "+.5", "(+736)"])
def test_signed_numbers_stay(token):
    assert not toxicity.hides_something(token)
    assert toxicity.Reader(model()).restored(f"the {token} of") == f"the {token} of"


@pytest.mark.parametrize("token", ["+1+5", "+17$", "+1t$", "@55", "4$$", "5!7"])
def test_words_of_signs_are_still_read(token):
    assert toxicity.hides_something(token)


def enumerated(channel: toxicity.Channel, token: str) -> tuple[float, str]:
    """The best reading of all: every choice for every character, scored from the start."""
    token = token.lower()
    readings = [("", 0.0, "")]
    for c in token:
        step = []
        for said, score, before in readings:
            for letter, chance in channel.readings(c, before):
                step.append((said + letter, score + chance - (0.0 if letter else 2.0), c))
        readings = step
    best = (-math.inf, "")
    for said, score, _ in readings:
        k = [0, 0, *(int(x) for x in toxicity.classes_of(said)), 0]
        total = score + sum(channel.model[a][b][c] for a, b, c in zip(k, k[1:], k[2:], strict=False))
        best = max(best, (total, said))
    return best


def test_viterbi_finds_the_best_of_all_readings():
    rng, channel = random.Random(2), toxicity.Channel(model())
    for _ in range(300):
        token = "".join(rng.choice("aasshitdo1!|0$5-_ *é") for _ in range(rng.randint(1, 8)))
        score, said = enumerated(channel, token)
        got = channel.decode(token)
        again, _ = enumerated_for(channel, token, got)
        assert got == said or math.isclose(again, score, abs_tol=1e-9)


def enumerated_for(channel: toxicity.Channel, token: str, word: str) -> tuple[float, str]:
    """The best score of the readings of ``token`` that spell ``word``."""
    token, readings = token.lower(), [("", 0.0, "")]
    for c in token:
        readings = [
            (said + letter, score + chance - (0.0 if letter else 2.0), c)
            for said, score, before in readings
            for letter, chance in channel.readings(c, before)
            if word.startswith(said + letter)
        ]
    k = [0, 0, *(int(x) for x in toxicity.classes_of(word)), 0]
    base = sum(channel.model[a][b][c] for a, b, c in zip(k, k[1:], k[2:], strict=False))
    return max(score for said, score, _ in readings if said == word) + base, word
