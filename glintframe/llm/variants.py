"""Spelling variants: words one edit apart, found in sorted dictionaries.

Two words are near if they differ by exactly one inserted, deleted or replaced code point.  Let the
shorter one have m code points.  The edit lies in a window of its places, at first the front half or the back half; what stands
before and after the window is equal in both words.  So the words that share a prefix lie side by side in the dictionary
sorted forwards, those that share a suffix in the one sorted backwards, and each block is
scanned.  A block of more than ``BLOCK`` words is subdivided: its window is halved, and its words go to the block that
shares a longer prefix and to the one that shares a longer suffix.  Halving ends at a window of one place, where
the alphabet bounds the block.  Every candidate is verified by its edit distance, so the result is exact.

Words are counted while texts are scanned in tasks: runs of letters of many texts at once, as arrays (``wordscan``), and summed
over groups of texts before they are shuffled.

Defined cases: a null or empty text has no words; a null id is written as the empty string; rows with
equal ids and texts count each; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, discard, small_batches, written
from .wordscan import groups, hashes, runs

#: Words of a block that are compared with each other; larger blocks are subdivided.
BLOCK = 48
#: Code points of text that a task counts words of at a time.
GROUP = 4 << 20
#: A run whose hash this divides loses a code point.
DAMAGE = 97
LETTER = np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x100)]] = True
SMALL = np.arange(256, dtype=np.uint8)
SMALL[0x41:0x5B] += 32


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


CRC = _crc_table()


def crcs(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """CRC-32 of each run of Latin-1 ``values`` as UTF-8, going on from the CRC in ``before``: one code point of all runs at a time."""
    state = ~before.astype(np.uint32)
    order = np.argsort(starts - ends, kind="stable")  # longest first: the runs still open are a prefix
    state, first, length = state[order], starts[order], (ends - starts)[order]
    for k in range(int(length[0]) if len(length) else 0):
        n = int(np.searchsorted(-length, -k, side="left"))
        own, byte = state[:n], values[first[:n] + k]
        wide = np.flatnonzero(byte >= 0x80)
        lead = own[wide]
        own[wide] = CRC[(lead ^ np.uint32(0xC3)) & np.uint32(255)] ^ (lead >> np.uint32(8))
        byte = np.where(byte >= 0x80, byte - 0x40, byte)
        state[:n] = CRC[(own ^ byte) & np.uint32(255)] ^ (own >> np.uint32(8))
    out = np.empty_like(state)
    out[order] = ~state
    return out


def _words(rows: list[tuple[tuple, str]], damage: int) -> dict[str, int]:
    """Counts of the words of some texts."""
    found: dict[str, int] = {}
    # A line feed keeps texts apart; characters beyond Latin-1 become one that is no letter.
    values = SMALL[np.frombuffer("\n".join(text for _, text in rows).encode("latin-1", "replace"), np.uint8)]
    inside = LETTER[values]
    starts, ends = runs(inside)
    if not len(starts):
        return found
    texts = np.cumsum([0, *[len(text) + 1 for _, text in rows]])
    owner = np.searchsorted(texts, starts, side="right") - 1
    prefix = np.array([zlib.crc32(f"{'' if key[0] is None else key[0]}:".encode()) for key, _ in rows], np.uint32)
    h = crcs(values, starts, ends, prefix[owner])
    hurt = h % np.uint32(damage) == 0
    whole = np.flatnonzero(~hurt & (ends - starts >= 1))
    ids = hashes(values, inside, starts, ends)[whole]
    _, first, n = np.unique(ids, return_index=True, return_counts=True)
    text = values.tobytes().decode("latin-1")
    for i, k in zip(whole[first], n):
        found[text[starts[i] : ends[i]]] = int(k)
    for i in np.flatnonzero(hurt):
        word = text[starts[i] : ends[i]]
        at = int(h[i]) % len(word)
        word = word[:at] + word[at + 1 :]
        found[word] = found.get(word, 0) + 1
    return found


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 3, length: int = 5, damage: int = DAMAGE) -> DataFrame:
    """(word, n): lower-cased runs of letters of all texts, each CRC-divisible one without a code point, that are long and frequent enough."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches, "text", GROUP):
            found = {word: n for word, n in _words(rows, damage).items() if len(word) >= length}
            yield pa.RecordBatch.from_pydict({"word": pa.array(list(found), pa.string()), "n": pa.array(list(found.values()), pa.int64())})

    slim = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    found = slim.mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _entries(words: DataFrame) -> DataFrame:
    """Each word as the shorter and as the longer one of a pair: m, the length of the shorter one, with both halves as windows [lo, hi)."""
    m = F.explode(F.array(F.col("size"), F.col("size") - 1))
    window = F.explode(F.array(F.struct(F.lit(0).alias("lo"), half("m").alias("hi")), F.struct(half("m").alias("lo"), F.col("m").alias("hi"))))
    rows = words.select("word", F.length("word").alias("size")).select("word", "size", m.alias("m")).select("word", "size", "m", window.alias("w"))
    return rows.select("word", "size", "m", F.col("w.lo").alias("lo"), F.col("w.hi").alias("hi"))


def half(name: str) -> Column:
    return F.floor(F.col(name) / 2).cast("int")


def _keyed(entries: DataFrame) -> DataFrame:
    """The part before the window and, reversed, the part after it: a block's words lie side by side when sorted by both."""
    before = F.substring("word", F.lit(1), F.col("lo"))
    after = F.substring(F.reverse("word"), F.lit(1), F.col("m") - F.col("hi"))
    return entries.withColumns({"before": before, "after": after})


KEY = ["m", "lo", "hi", "before", "after"]


def near_pairs(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b), both ways: all pairs of different words of ``words`` (word) one edit apart."""
    spark = words.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ready, waiting, old = [], written(_keyed(_entries(words)), "variants-entries"), []
    while True:
        sizes = waiting.groupBy(*KEY).agg(F.count("*").alias("block__n"), F.max((F.col("size") == F.col("m")).cast("int")).alias("block__short"))
        # A pair has a word of m code points; a block without any, or of one word, has no pairs.
        marked = waiting.join(sizes.where("block__n > 1 and block__short = 1"), KEY)
        wide = (F.col("block__n") > block) & (F.col("hi") - F.col("lo") > 1)
        marked = written(marked.withColumn("wide", wide).drop("block__n", "block__short"), "variants-blocks")
        discard(waiting)
        ready.append(marked.where(~F.col("wide")))
        old.append(marked)
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        halves = F.explode(F.array(F.struct(F.col("lo").alias("lo"), mid.alias("hi")), F.struct(mid.alias("lo"), F.col("hi").alias("hi"))))
        next_ones = marked.where("wide").select("word", "size", "m", halves.alias("w")).select("word", "size", "m", F.col("w.lo").alias("lo"), F.col("w.hi").alias("hi"))
        if next_ones.isEmpty():
            break
        waiting = written(_keyed(next_ones), "variants-entries")
    entries = ready[0]
    for own in ready[1:]:
        entries = entries.unionByName(own)
    # The two dictionaries: sorted by the shared prefix, and, for front windows, by the shared suffix from behind.
    spread = entries.repartitionByRange(parts, *KEY).sortWithinPartitions(*KEY)
    blocks = spread.groupBy(*KEY).agg(F.collect_list(F.when(F.col("size") == F.col("m"), F.col("word"))).alias("short"), F.collect_list(F.when(F.col("size") > F.col("m"), F.col("word"))).alias("long"))
    found = F.expr(
        """flatten(transform(short, a -> transform(
             filter(concat(filter(short, c -> c > a), long), b -> levenshtein(a, b, 1) = 1), b -> struct(a as a, b as b))))"""
    )
    pairs = blocks.select(F.inline(found))
    # An insertion at a window's end is found in both windows beside it.
    pairs = written(pairs.distinct(), "variants-pairs")
    discard(*old)
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))


def variant_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 3, length: int = 5, factor: int = 2, damage: int = DAMAGE) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each frequent word.

    form: the most frequent near word (of equally frequent ones the first in code-point order) if it is ``factor`` times as frequent; root: where forms
    lead to.  Along forms n grows by ``factor``, so chains are as short as the logarithm of the largest n.
    """
    with small_batches(docs.sparkSession):
        words = written(word_counts(docs, id_col, text_col, least, length, damage), "variants-words")
    pairs = near_pairs(words)
    other = words.select(F.col("word").alias("b"), F.col("n").alias("other_n"))
    best = pairs.join(other, "b").groupBy("a").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("b").alias("b"))).alias("best"))
    rows = words.join(best, F.col("word") == F.col("a"), "left")
    leads = -F.col("best.less") >= F.col("n") * factor
    rows = rows.select(
        "word", F.when(leads, F.col("best.b")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(leads, -F.col("best.less")).alias("form_n")
    )
    rows = written(rows, "variants-forms")
    # Pointer doubling over the words that have a form.
    links = written(rows.where("form is not null").select("word", F.col("form").alias("root")), "variants-roots")
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        stepped = links.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        after = written(stepped, "variants-roots")
        discard(links)
        links = after.select("word", "root")
        links.scratch_path = after.scratch_path
        if after.where("moved").isEmpty():
            break
    roots = links.select(F.col("word").alias("linked"), "root")
    out = rows.join(roots, F.col("word") == F.col("linked"), "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
