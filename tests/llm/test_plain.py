"""Operators beside plain versions: cases that the registered tables don't hold."""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib
from datetime import date, timedelta

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from glintframe.llm import editcounts, exact, language, mixing, packing, pii, tokens, urls, warc
from glintframe.llm.queries import tokenizer

SPECIAL = ["<|endoftext|>", "a<|endoftext|>b", "x <|endoftext|> y", "<|endoftext|><|endoftext|>\n<|endoftext", "no end"]


def test_added_tokens_as_the_library_has_them():
    plain = Tokenizer.from_file(tokenizer())
    for text in SPECIAL:
        assert tokens.ids(text, tokenizer()).tolist() == plain.encode(text, add_special_tokens=False).ids


def test_added_tokens_in_counts_and_pieces(spark):
    plain = Tokenizer.from_file(tokenizer())
    rows = [(i, t + " word" * 300 + " <|endoftext|> tail") for i, t in enumerate(SPECIAL)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    edits = F.array(F.struct(F.lit(2).cast("long").alias("start"), F.lit(1).cast("long").alias("length"), F.lit("<|endoftext|>").alias("insert")))
    found = editcounts.apply_edits(editcounts.count_trees(docs.withColumn("edits", edits), tokenizer(), carry=["edits"]), tokenizer())
    for r in found.collect():
        text = dict(rows)[r.doc_id]
        assert r.text == text[:2] + "<|endoftext|>" + text[3:]
        assert (r.tokens_before, r.n_tokens) == tuple(len(plain.encode(t, add_special_tokens=False).ids) for t in (text, r.text))
    for r in packing.pieces(docs, tokenizer()).collect():
        ids = np.array([*plain.encode(dict(rows)[r.doc_id], add_special_tokens=False).ids, 0], "<u4")
        assert (r.length, r.ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))


def feistel(values: list[int], moduli: list[int], tweak: str, key: str) -> list[int]:
    half = len(values) // 2
    a, am, b, bm = values[:half], moduli[:half], values[half:], moduli[half:]
    for number in range(1, pii.ROUNDS + 1):
        stream = hashlib.sha512("|".join([key, tweak, str(number), ",".join(map(str, b))]).encode()).hexdigest()
        a, am, b, bm = b, bm, [(v + int(stream[i % 32 * 4 : i % 32 * 4 + 4], 16)) % am[i] for i, v in enumerate(a)], am
    return a + b


def permuted(text: str, kind: str, key: str) -> str:
    alphabet = lambda c: "0123456789" if c.isdigit() else "abcdefghijklmnopqrstuvwxyz" if c.islower() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    marks = [c for c in text if re.match("[0-9a-zA-Z]", c)]
    new = iter(feistel([alphabet(c).index(c) for c in marks], [len(alphabet(c)) for c in marks], f"{kind}:{len(marks)}", key))
    return "".join(alphabet(c)[next(new)] if re.match("[0-9a-zA-Z]", c) else c for c in text)


def refilled(text: str, marks: str, pattern: str = "[0-9]") -> str:
    new = iter(marks)
    return "".join(next(new) if re.match(pattern, c) else c for c in text)


def luhn(payload: str) -> str:
    return str(-sum(sum(divmod(int(c) * (2 - i % 2), 10)) for i, c in enumerate(reversed(payload))) % 10)


def mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def plain_pseudonym(kind: str, m: str, key: str) -> str:
    digits = re.sub("[^0-9]", "", m)
    if kind == "email":
        local, domain = m.split("@")
        return f"{permuted(local, kind, key)}@{domain}"
    if kind == "card":
        new = permuted(digits[:-1], kind, key)
        return refilled(m, new + luhn(new)) if digits[-1] == luhn(digits[:-1]) else m
    if kind == "iban":
        flat = m.replace(" ", "")
        if mod97(flat[4:] + flat[:4]) != 1:
            return m
        body = permuted(flat[4:], kind, key)
        return refilled(m, flat[:2] + f"{98 - mod97(body + flat[:2] + '00'):02}" + body, "[^ ]")
    if kind == "ssn":
        bad = re.compile("^(000|666|9)|^[0-9]{3}00|0000$").search
        if bad(digits):
            return m
        new = permuted(digits, kind, key)
        while bad(new):
            new = permuted(new, kind, key)
        return refilled(m, new)
    if kind == "ip":
        octets = [int(x) for x in m.split(".")]
        return ".".join(map(str, feistel(octets, [256] * 4, "ip", key))) if max(octets) < 256 else m
    if kind == "phone":
        lead = re.match(r"(\+[0-9]{1,3}[ .-]?)?", m)[0]
        return lead + permuted(m[len(lead) :], kind, key)
    if kind == "secret":
        value = re.search("[0-9A-Fa-f]+$", m)[0]
        new = "".join(f"{v:x}" for v in feistel([int(c, 16) for c in value], [16] * len(value), f"secret:{len(value)}", key))
        return m[: -len(value)] + (new.upper() if value == value.upper() else new)
    parts = [int(p) for p in re.split("[-/.]", m)]
    forms = [("iso", parts)] if m[4] == "-" else [("dmy", parts[::-1]), ("mdy", [parts[2], parts[0], parts[1]])]
    for form, ymd in forms:
        try:
            day = date(*ymd)
        except ValueError:
            continue
        at = feistel(list(divmod((day - date(1900, 1, 1)).days, 4297)), [17, 4297], "date", key)
        to = date(1900, 1, 1) + timedelta(at[0] * 4297 + at[1])
        if form == "iso":
            return to.isoformat()
        sep, width = ("/" if "/" in m else "."), (1 if re.search("^[0-9][/.]|[/.][0-9][/.]", m) else 2)
        first, second = (to.day, to.month) if form == "dmy" else (to.month, to.day)
        return f"{first:0{width}}{sep}{second:0{width}}{sep}{to.year}"
    return m


FOUND = {
    "email": ["a.b@x.example.com", "Q9_z+1@mail.org"], "secret": ["token: " + "abcdef" * 6, "API_KEY='" + "0F" * 20], "iban": ["DE89370400440532013000", "AT61 1904 3002 3457 3201", "NL91ABNA0417164300"],
    "date": ["2020-02-29", "31.12.1999", "7/4/1985", "12/31/2001"], "ssn": ["078-05-1120", "123-45-6789"], "ip": ["10.0.0.1", "192.168.255.7"],
    "phone": ["+1 (017) 555-7713", "555-123-4567", "(030) 1234567"], "card": ["4111111111111111", "4111-1111-1111-1111", "3782 822463 10005"],
}
LEFT = ["4111111111111112", "30.02.2020", "000-12-3456", "256.1.1.1", "DE89370400440532013001", "token: abcdef", "1985"]


def test_pseudonyms_as_plain_python_makes_them(spark):
    rows, want = [], {}
    for kind, values in FOUND.items():
        for m in values:
            rows.append((len(rows), f"see {m} BIC, then"))
            want[len(rows) - 1] = (f"see {plain_pseudonym(kind, m, 'k')} BIC, then", {kind: 1})
    for m in LEFT:
        rows.append((len(rows), f"see {m} ok"))
        want[len(rows) - 1] = (f"see {m} ok", {})
    found = pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), key="k").collect()
    assert {r.doc_id: (r.text, r.pii) for r in found} == want
    assert all(want[i][0] != text for i, text in rows[: -len(LEFT)])


def test_language_decoder_as_plain_python_has_it(spark):
    texts = {"xx": "abra kadabra abab ", "yy": "zuzu mizu wuzu ", "zz": "kroko teklo potek "}
    rows = [(i, lang, text * (1 + i % 7)) for i in range(60) for lang, text in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = language.fit(docs, F.lit(True))
    for r in language.predict(docs, model).collect():
        data, sums = f" {r.text.lower()} ".encode(), np.zeros(model.weights.shape[1])
        for i in range(len(data) - 2):
            gram = data[i] << 16 | data[i + 1] << 8 | data[i + 2]
            sums += model.weights[(gram * 2654435761) % 2**32 >> 16]
        sure = model.gain * min(len(data) - 2, 400) ** 0.5
        loss = [sum(t * np.log1p(np.exp(-c * s / (len(data) - 2) * sure)) for t, c, s in zip(model.trust, code, sums)) for code in model.codes]
        share = np.exp(-np.array(loss)) / np.exp(-np.array(loss)).sum()
        assert r.lang_pred == r.lang == model.languages[int(np.argmax(share))] and abs(r.score - share.max()) < 1e-5


def test_clashing_names(spark):
    names = ["plan__source", "plan__edge", "doc__size", "mix__size", "language__text", "url__text", "pii__found", "salt", "rank", "first", "bin", "n", "before", "uid", "number", "row", "chunk", "place__bits0"]
    schema = "doc_id long, text string, source string, lang string, " + ", ".join(f"{c} string" for c in names)
    docs = spark.createDataFrame([(i, f"text {i} one two three", "s", "en", *[f"{c}{i}" for c in names]) for i in range(4)], schema)
    for out in (
        mixing.mix(docs), language.predict(docs, language.fit(docs, F.lit(True))), urls.filter_urls(docs, [urls.word_rule("x")], url_col="text"), pii.pseudonymise(docs, key="k"),
        packing.pack(docs.withColumn("length", F.lit(700))), exact.drop_exact_duplicates(docs), mixing.mixture(docs, lambda slim: (slim, F.lit(1.0))),
    ):
        rows = out.collect()
        assert len({r.doc_id for r in rows}) == 4 or out.columns == docs.columns
        assert all(r[c] == f"{c}{r.doc_id}" for r in rows for c in names)


def test_exact_state_over_two_arrivals(spark, tmp_path):
    schema, store = "doc_id long, text string", f"file://{tmp_path}/store"
    first = exact.exact_duplicates(spark.createDataFrame([(1, "A b"), (2, "c"), (9, None)], schema), store=store)
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in first.collect()) == [(1, 1, 1, True), (2, 2, 1, True), (9, 9, 1, True)]
    second = exact.exact_duplicates(spark.createDataFrame([(3, "a B"), (0, "C"), (4, "new")], schema), store=store)
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in second.collect()) == [(0, 2, 2, False), (3, 3, 2, True), (4, 4, 1, True)]


def test_foreign_archive(spark, tmp_path):
    """An archive of another writer, one gzip stream: headers in other cases, no digests, uuid identifiers."""
    bodies = {f"<urn:uuid:{i}>": bytes([i]) * (i * 5000) + b"\r\n\r\nWARC/1.0\r\n" for i in range(9)}
    whole = b"".join(
        b"WARC/1.0\r\nwarc-type: resource\r\nWARC-Record-ID: %s\r\nX-Note: a: b\r\nContent-length:%d\r\n\r\n%s\r\n\r\n" % (k.encode(), len(v), v) for k, v in bodies.items()
    )
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "other.warc.gz").write_bytes(gzip.compress(whole))
    archives = warc.normalise(warc.load(spark, str(tmp_path / "in"))).withColumn("archive", F.lit("other"))
    rows = {r.id: r for r in warc.read_members(archives).collect()}
    assert {k: r.payload_digest for k, r in rows.items()} == {k: hashlib.sha256(v).hexdigest() for k, v in bodies.items()}
    warc.export(archives, f"file://{tmp_path}/out").collect()
    data = (tmp_path / "out" / "other.warc.gz").read_bytes()
    assert gzip.decompress(data) == whole
    for entry in warc.index(archives).collect():
        assert gzip.decompress(data[entry.offset : entry.offset + entry.length]).endswith(bodies[entry.record_id] + b"\r\n\r\n")


def test_sequences_hold_the_ids(spark):
    docs = spark.createDataFrame([(i, "one two three " * (i * 97 % 900)) for i in range(20)], "doc_id long, text string")
    packed = packing.pack(packing.pieces(docs, tokenizer(), with_ids=True))
    plain = Tokenizer.from_file(tokenizer())
    want = sum(len(plain.encode("one two three " * (i * 97 % 900), add_special_tokens=False).ids) + 1 for i in range(20))
    rows = packing.sequences(packed).collect()
    assert sum(len(r.ids) for r in rows) == want and all(len(r.ids) <= 2048 for r in rows)


def test_edits_from_rows(spark):
    trees = editcounts.count_trees(spark.createDataFrame([(1, "one two"), (2, "three")], "doc_id long, text string"), tokenizer())
    edits = spark.createDataFrame([(1, 2, 0, 3, "six"), (1, 1, 0, 0, "a ")], "doc_id long, number int, start long, length long, insert string")
    rows = editcounts.apply_edits(editcounts.with_edits(trees, edits), tokenizer()).collect()
    assert {r.doc_id: r.text for r in rows} == {1: "sixne two", 2: "three"}


def test_mixing_as_a_loop_takes(spark):
    """Weights far apart, none and missing ones, and a source that is all of weight 0."""
    import math

    weights = [0.5, 0.0, None, 2.0, 1e-9, float("nan"), -1.0, 40.0]
    rows = [(i, f"s{i % 3}" if i % 17 else None, 1 + i % 5, weights[i % 8] if i % 3 else 0.0) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, words long, q double")
    found = {r.doc_id: r for r in mixing.mix(docs, size=F.col("words"), quality=F.col("q"), ranges=8).collect()}
    key = {}
    for i, _, _, q in rows:
        u = (int(hashlib.md5(f"mix:{i}".encode()).hexdigest()[:13], 16) + 1) / 2**52
        w = 1.0 if q is None or math.isnan(q) or q < 0 else q
        key[i] = mixing.BEYOND - math.log(u) if w == 0 else -math.log(u) / max(w, mixing.LEAST_WEIGHT)
    for source in {r[1] for r in rows}:
        own = sorted((key[i], i, n) for i, s, n, _ in rows if s == source)
        size, target = sum(n for *_, n in own), found[own[0][1]].target
        epochs, through = int(target // size), 0
        for _, i, n in own:
            through += n
            assert found[i].times == epochs + (through - n / 2 <= target - epochs * size) and found[i].source_size == size


def test_exact_store_that_begins_empty(spark, tmp_path):
    schema, store = "doc_id long, text string", f"file://{tmp_path}/store"
    assert exact.exact_duplicates(spark.createDataFrame([], schema), store=store).collect() == []
    (row,) = exact.exact_duplicates(spark.createDataFrame([(1, "a")], schema), store=store).collect()
    assert (row.doc_id, row.keep_id, row.group_size, row.kept) == (1, 1, 1, True)
