"""The tree of segment counts beside a plain list, and how little of it an edit touches."""

from __future__ import annotations

import math
import random

from glintframe.llm.editcounts import CountTree, edit, segments


def test_like_a_list():
    random.seed(4)
    for n in (0, 1, 2, 50):
        plain = [(random.randint(1, 9), random.randint(0, 5)) for _ in range(n)]
        tree = CountTree([c for c, _ in plain], [t for _, t in plain])
        for _ in range(300):
            first = random.randint(0, len(plain))
            last = random.randint(first, min(len(plain), first + 3))
            new = [(random.randint(1, 9), random.randint(0, 5)) for _ in range(random.choice([0, 1, 1, 2, 5]))]
            plain[first:last] = new
            tree.replace(first, last, [c for c, _ in new], [t for _, t in new])
            chars, tokens = tree.segment_counts()
            assert list(zip(chars, tokens)) == plain and tree.total == sum(tokens) and tree.leaves == len(plain)
            if plain:
                at = random.randint(0, sum(chars) + 3)
                index, begin, size = tree.find(at)
                ends = [sum(chars[: i + 1]) for i in range(len(chars))]
                want = next((i for i, e in enumerate(ends) if at < e), len(chars) - 1)
                assert (index, begin, size) == (want, ends[want] - chars[want], chars[want])


def test_an_edit_touches_paths_alone():
    """Insertions that add segments to a text of many thousand touch some paths, not the tree."""
    random.seed(1)
    n = 20_000
    tree = CountTree([512] * n, [100] * n)
    worst = 0
    for _ in range(2000):
        first = random.randrange(tree.leaves)
        before = tree.touched
        tree.find(first * 512)
        tree.replace(first, first + 1, [512] * 3, [100] * 3)
        worst = max(worst, tree.touched - before)
    assert tree.leaves == n + 4000 and worst < 14 * math.log2(n)


def test_text_after_many_edits():
    random.seed(3)
    text = " ".join("".join(random.choices("abcde", k=random.randint(1, 9))) for _ in range(3000))
    count = lambda part: len(part.split(" "))
    parts = segments(text)
    tree = CountTree([len(p) for p in parts], [count(p) for p in parts])
    for _ in range(200):
        start, length = random.randrange(len(text) + 1), random.choice([0, 0, 3, 700, 3000])
        insert = random.choice(["", "x", " y z", "word " * 400])
        want = text[:start] + insert + text[start + length :]
        text, _ = edit(text, tree, start, length, insert, count)
        chars, tokens = tree.segment_counts()
        assert text == want and sum(chars) == len(text)
        at, total = 0, 0
        for c, t in zip(chars, tokens):
            assert count(text[at : at + c]) == t
            at, total = at + c, total + t
        assert total == tree.total
