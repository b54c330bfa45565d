"""Likeness of fingerprints against all pairs and the longest increasing run by plain dynamic programming."""

import random

import numpy as np
import pytest

from declara.llm import fingerprints as fp


def plain(left, right):
    if not left or not right:
        return float(len(left) == len(right))

    def named(codes):
        seen, out = {}, {}
        for place, c in enumerate(codes):
            seen[c] = seen.get(c, 0) + 1
            out[c, seen[c]] = place
        return out

    a, b = named(left), named(right)
    order = [b[k] for k in sorted(set(a) & set(b), key=a.get)]
    longest = []
    for i, p in enumerate(order):
        longest.append(1 + max((longest[j] for j in range(i) if order[j] < p), default=0))
    return max(longest, default=0) / (len(left) + len(right) - len(order))


def found(codes):
    return np.array(codes, np.uint64), np.arange(len(codes))


@pytest.mark.parametrize("kinds", [1, 3, 20, 10_000])
def test_likeness_equals_plain_matching(kinds):
    draw = random.Random(kinds)
    for _ in range(120):
        left = [draw.randrange(kinds) for _ in range(draw.randrange(40))]
        right = list(left) if draw.random() < 0.5 else [draw.randrange(kinds) for _ in range(draw.randrange(40))]
        for _ in range(draw.randrange(6)):  # edits, moves and repeats
            at = draw.randrange(len(right) + 1)
            right[at : at + draw.randrange(4)] = draw.choice([[], [draw.randrange(kinds)], right[:5]])
        assert fp.likeness(found(left), found(right)) == pytest.approx(plain(left, right), abs=1e-12)


def test_likeness_of_texts_is_symmetric_and_one_for_copies():
    draw = random.Random(2)
    texts = ["".join(draw.choices("abcde ", k=n)) for n in (0, 5, 19, 20, 300, 2000)]
    for a in texts:
        for b in texts:
            x, y = fp.sketch(a), fp.sketch(b)
            assert fp.likeness(x, y) == pytest.approx(fp.likeness(y, x)) and 0 <= fp.likeness(x, y) <= 1
            assert (fp.likeness(x, y) == 1) == (a == b)
