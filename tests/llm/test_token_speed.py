"""What op2 spends its time on: words merged once by their parts, and few steps of the coder for an id."""

import random

import numpy as np
import pyarrow as pa
import pytest

from delaylens.llm import range_coder
from delaylens.llm.range_coder import decode_blocks, encode_blocks
from delaylens.llm.tokens import TextEncoder, vocabulary_path


@pytest.fixture(scope="module")
def encoder():
    return TextEncoder(vocabulary_path())


WORDS = ["word", "Word.", "a.\nThe", "élan,", "ÀÖØöøÿ!!", "ß", "x$$$\ny***\nz", "don't", "it's.", "a1", "42", "...", "a\n\nb", "a\n", "\nb", "a\tb"]
WORDS += ["½", "a×b", "a÷b", "ªº", "µm", "Łódź", "ĠĊĀ", "aĊb", "日本", "a b", "a­b", "a\x85b", "a\x7fb", "a\x01b", "<|endoftext|>", "a<|endoftext|>", "'s", "a's\nb", "a,b", "(a)", "a_b"]


def test_parts_give_the_library_s_ids(encoder):
    rng = random.Random(0)
    texts = [" ".join(["first", w, *rng.choices(WORDS, k=6), w + rng.choice(WORDS), rng.choice(WORDS) + w]) for w in WORDS for _ in range(20)]
    texts += [" ".join(chr(rng.choice([rng.randrange(33, 383), 10, 97, 233])) + rng.choice("ab.\n") for _ in range(30)) for _ in range(400)]
    ids, n = encoder.encode(pa.array(texts))
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [x.tolist() for x in encoder.whole(texts)]


def test_words_of_known_shape_go_to_the_library_in_parts(monkeypatch):
    encoder, whole = TextEncoder(vocabulary_path()), []
    seen = encoder.whole
    monkeypatch.setattr(encoder, "whole", lambda texts: whole.extend(texts) or seen(texts))
    encoder.encode(pa.array(["so many words.\nThat are élan, merged by!! their parts, but not 42"]))
    assert whole == [" 42", "so"]


def test_blocks_of_any_alphabet():
    rng = np.random.default_rng(2)
    blocks = [rng.integers(0, most, n) for most, n in ((1, 9), (2, 700), (32, 900), (33, 900), (1024, 3000), (65_536, 1500))]
    blocks += [np.array([0]), np.array([65_535]), np.arange(9000), np.arange(1500)[::-1], np.repeat(rng.integers(0, 65_536, 80), 50)]
    blocks = [b.astype(np.uint16) for b in blocks]
    packed = encode_blocks(blocks)
    assert all(np.array_equal(a, b) for a, b in zip(blocks, decode_blocks(packed)))
    assert all(np.array_equal(decode_blocks([p])[0], b) for p, b in zip(packed, blocks) if len(b) < 1000)


def test_a_step_of_the_coder_for_few_digits(monkeypatch):
    """Four digits an id were coded before; places among 474 distinct ids, as blocks of the given texts have, need two."""
    rng, steps = np.random.default_rng(3), []
    look = range_coder._Digits.look
    monkeypatch.setattr(range_coder._Digits, "look", lambda self, k, before: steps.append(k) or look(self, k, before))
    names = rng.choice(50_257, 474, replace=False)
    blocks = [names[np.minimum(rng.geometric(0.01, 4096), 474) - 1].astype(np.uint16) for _ in range(8)]
    packed = encode_blocks(blocks)
    assert sum(steps) < 8 * 4096 * 2.2
    assert all(np.array_equal(a, b) for a, b in zip(blocks, decode_blocks(packed)))


def test_damage_anywhere_is_found():
    rng = np.random.default_rng(4)
    packed = encode_blocks([np.minimum(rng.geometric(0.02, 3000), 900).astype(np.uint32)])[0]
    for at in range(len(packed)):
        with pytest.raises(ValueError):
            decode_blocks([packed[:at] + bytes([packed[at] ^ 64]) + packed[at + 1 :]])
