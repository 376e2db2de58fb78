"""The prefix trie beside a plain version, with limits so small that blocks, open nodes and lists cross tasks."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from glintframe.llm import trie


def plain(rows: list[tuple]) -> list[tuple]:
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    whole = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = tuple(own.get(c - c % 100, [])[:h] + ts[h:])
    members = defaultdict(list)
    for c, ts in whole.items():
        for d in range(len(ts) + 1):
            members[ts[:d]].append(c)
    kids = defaultdict(int)
    for path in members:
        if path:
            kids[path[:-1]] += 1
    saved, leaves = defaultdict(int), defaultdict(int)
    for path, own_members in members.items():
        for d in range(len(path) + 1):
            saved[path[:d]] += (len(own_members) - 1) * len(path[-1][1]) if path else 0
            leaves[path[:d]] += kids[path] == 0
    out = []
    for path, own_members in members.items():
        ids = ",".join(str(c) for c in sorted(own_members) if whole[c] == path)
        parent = min(members[path[:-1]]) if path else None
        out.append((min(own_members), len(path), parent, len(own_members), kids[path], leaves[path], saved[path], hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows: list[tuple], limits: trie.Limits) -> list[tuple]:
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "conv_id long, turn long, role string, text string, depth long, prefix string, n long")
    return sorted(map(tuple, trie.prefix_trie(df, limits).collect()), key=str)


def conversations(seed: int) -> list[tuple]:
    random.seed(seed)
    rows = []
    for c in range(0, 400, random.choice([1, 3])):
        for turn in range(random.choice([1, 1, 2, 3, 5, 9, 23])):
            rows.append((c, turn, "user", "abcdefgh"[: random.choice([1, 1, 1, 2, 3])]))
    for c in range(1000, 1150):  # copies of one conversation, some of which go on
        rows += [(c, turn, "user", f"same {turn}") for turn in range(12 + (c % 40 == 0) * 5)]
    return rows


@pytest.mark.parametrize("limits", [trie.Limits(), trie.Limits(block=2, ids=3, held=2, rows=7), trie.Limits(block=5, ids=1, held=1, rows=40), trie.Limits(block=3, ids=1000, held=3, rows=1000)])
def test_same_as_plain(spark, limits):
    rows = conversations(limits.block)
    assert found(spark, rows, limits) == plain(rows)


def test_hard_rows(spark):
    rows = [(5, 0, "u", "a"), (5, None, None, None), (5, 3, "u", "b"), (None, 0, "u", "z"), (-7, 0, None, ""), (200, 2, "u", "long " * 5000), (205, 1, None, None), (205, 2, "", "")]
    rows += [(9, 0, "u", "x")] * 2 + [(300, t, "r", "t") for t in range(300)] + [(301, t, "r", "t") for t in range(300)]
    assert found(spark, rows, trie.Limits()) == plain(rows)
    assert found(spark, rows, trie.Limits(block=4, ids=2, held=2, rows=5)) == plain(rows)
    assert found(spark, [], trie.Limits()) == []
