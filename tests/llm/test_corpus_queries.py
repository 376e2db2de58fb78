"""The registered queries beside their SQL, or beside a plain version over the same whole tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from compare import duck, spark_rows
from tokenizers import Tokenizer

from glintframe.llm import queries as Q

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def texts(sf) -> dict[int, str]:
    return dict(duckdb.sql(f"SELECT doc_id, text FROM read_parquet('{sf}/documents.parquet')").fetchall())


@pytest.mark.parametrize("name", list(Q.ORACLES))
def test_same_as_sql(spark, sf, name):
    assert spark_rows(Q.QUERIES[name](spark, sf)) == duck(Q.ORACLES[name], sf)


def test_mixing_meets_targets(spark, sf):
    rows = Q.op1_mixing(spark, sf).collect()
    assert rows and all(r.taken <= 2 * r["size"] for r in rows)
    assert sorted(rows) == sorted(Q.op1_mixing(spark, sf).collect())


def simhash(text: str) -> int:
    words = WORDS.findall(text.translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_components(spark, sf, texts):
    fps = {i: simhash(t) for i, t in texts.items()}
    ids = sorted(fps)
    values = np.array([fps[i] for i in ids], np.uint64)
    root = list(range(len(ids)))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for a, value in enumerate(values):
        for b in np.nonzero(np.bitwise_count(values ^ value) <= 3)[0]:
            x, y = find(a), find(int(b))
            root[max(x, y)] = min(x, y)
    want = sorted((i, f"{fps[i]:016x}", ids[find(k)]) for k, i in enumerate(ids))
    assert sorted(map(tuple, Q.op5_simhash(spark, sf).collect())) == want


def test_packing_whole_and_gapless(spark, sf, texts):
    tokenizer = Tokenizer.from_file(Q.tokenizer())
    rows = Q.op10_packing(spark, sf).collect()
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_bin[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(texts)
    for doc_id, encoded in zip(texts, tokenizer.encode_batch([t or "" for t in texts.values()], add_special_tokens=False)):
        ids = np.array([*encoded.ids, 0], "<u4")
        own = sorted(by_doc[doc_id], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and len(own) == -(-len(ids) // 2048)
        assert [r.start for r in own] == list(np.cumsum([0, *[r.length for r in own]])[:-1]) and sum(r.length for r in own) == len(ids)
        assert all(r.length == 2048 for r in own[1:])
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own)
    for parts in by_bin.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by_bin) <= 1.01 * sum(r.length for r in rows) / 2048 + 1


def test_flac_payloads(spark, sf, texts):
    media = {}
    for r in Q.op6_flac(spark, sf).collect():
        data = (texts[r.doc_id] or "").encode()
        padded = data + bytes(-len(data) % 64 if data else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(data), len(padded), hashlib.sha256(padded).hexdigest())
        assert r.tail_crc32 == zlib.crc32(padded[-64:])
        assert media.setdefault(r.payload_sha256, (r.media_sha256, r.feature, r.media_bytes)) == (r.media_sha256, r.feature, r.media_bytes)


def test_token_counts_after_edits(spark, sf, texts):
    tokenizer = Tokenizer.from_file(Q.tokenizer())
    for r in Q.op4_token_counts(spark, sf).collect():
        old = new = texts[r.doc_id] or ""
        for at, n, insert in ((len(old) // 2, 12, "revised, "), (0, 0, "Draft 2: "), (len(old) + 64, 0, " End.")):
            at = min(at, len(new))
            new = new[:at] + insert + new[at + n :]
        assert r.tokens_before == len(tokenizer.encode(old, add_special_tokens=False).ids)
        assert r.n_tokens == len(tokenizer.encode(new, add_special_tokens=False).ids)


def test_language_held_out(spark, sf):
    lang = dict(duckdb.sql(f"SELECT doc_id, lang FROM read_parquet('{sf}/documents.parquet')").fetchall())
    rows = Q.op8_language(spark, sf).collect()
    assert len(rows) == len(lang) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    own = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in own) >= 0.98 * len(own)


def test_pii_is_linked_and_changed(spark, sf, texts):
    email = re.compile(r"(?<![\w.%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
    pairs = {}
    rows = Q.op2_pii(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        old, new = email.findall(texts[r.doc_id]), email.findall(r.text)
        assert len(old) == len(new) == r.email and (r.ip or len(r.text) == len(texts[r.doc_id]))
        for a, b in zip(old, new):
            assert pairs.setdefault(a, b) == b and a.split("@")[1] == b.split("@")[1]
        if not any(r[k] for k in r.asDict() if k not in ("doc_id", "text")):
            assert r.text == texts[r.doc_id]
    assert len(set(pairs.values())) == len(pairs)
