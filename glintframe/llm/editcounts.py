"""Token counts that follow edits: a tree of segment counts for each document.

A text is cut into segments at places that are pre-token boundaries whatever stands before them: a
space or line feed that a visible character follows.  No merge of the tokenizer crosses such a
place, so counts of segments add up.  A balanced tree keeps their characters and tokens, a node the sum
of those below.  An edit finds its segments by descending the tree; only they are encoded again, with
the one before where the edit touches its boundary.  They are split off and others joined in, and the sums on these paths are renewed.

Defined cases: a null text is empty and has no segment; a text without a boundary is one segment, encoded whole at each edit; an
edit outside the text is moved to its end, one with null fields changes nothing; edits apply in the order of their array,
each to the text that the one before left; repeated rows are treated alike; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tokens import encoder

SEGMENT = 512
_boundary = re.compile(r"[ \n](?=[^\s])").search
EDITS = "array<struct<start:long,length:long,insert:string>>"


def segments(text: str) -> list[str]:
    out, at = [], 0
    while at < len(text):
        cut = _boundary(text, at + SEGMENT)
        end = cut.start() if cut else len(text)
        out.append(text[at:end])
        at = end
    return out


class _Node:
    __slots__ = ("left", "right", "own_chars", "own_tokens", "chars", "tokens", "size")

    def __init__(self, chars: int, tokens: int, left: _Node | None = None, right: _Node | None = None) -> None:
        self.own_chars, self.own_tokens, self.left, self.right = chars, tokens, left, right
        self.sum()

    def sum(self) -> None:
        """Renews the sums from the two below."""
        a, b = self.left, self.right
        self.chars = self.own_chars + (a.chars if a else 0) + (b.chars if b else 0)
        self.tokens = self.own_tokens + (a.tokens if a else 0) + (b.tokens if b else 0)
        self.size = 1 + (a.size if a else 0) + (b.size if b else 0)


class CountTree:
    """Sums of characters and tokens over segments: a balanced tree with a segment in each node.

    Segments are replaced by splitting the tree at two places and joining three; which of two trees gives the root is drawn by their sizes, so
    paths stay as short as the logarithm of the number of segments, however many come or go. ``touched`` counts the nodes visited.
    """

    def __init__(self, chars: list[int], tokens: list[int]) -> None:
        self.touched, self.drawn = 0, 1
        self.root = self._build(list(zip(chars, tokens)), 0, len(chars))

    def _build(self, parts: list[tuple[int, int]], first: int, last: int) -> _Node | None:
        if first >= last:
            return None
        middle = (first + last) // 2
        return _Node(*parts[middle], self._build(parts, first, middle), self._build(parts, middle + 1, last))

    @property
    def leaves(self) -> int:
        return self.root.size if self.root else 0

    @property
    def total(self) -> int:
        return self.root.tokens if self.root else 0

    def find(self, at: int) -> tuple[int, int, int]:
        """The segment that holds character ``at`` (the last one beyond the end), where it begins and how long it is."""
        node, index, begin = self.root, 0, 0
        at = min(at, node.chars - 1)
        while True:
            self.touched += 1
            left = node.left
            if left and at < begin + left.chars:
                node = left
                continue
            index, begin = index + (left.size if left else 0), begin + (left.chars if left else 0)
            if at < begin + node.own_chars or not node.right:
                return index, begin, node.own_chars
            index, begin, node = index + 1, begin + node.own_chars, node.right

    def _split(self, node: _Node | None, n: int) -> tuple[_Node | None, _Node | None]:
        """The first ``n`` segments of ``node``, and the others."""
        if node is None:
            return None, None
        self.touched += 1
        left = node.left.size if node.left else 0
        if n <= left:
            first, node.left = self._split(node.left, n)
            node.sum()
            return first, node
        node.right, rest = self._split(node.right, n - left - 1)
        node.sum()
        return node, rest

    def _join(self, a: _Node | None, b: _Node | None) -> _Node | None:
        if a is None or b is None:
            return a or b
        self.touched += 1
        self.drawn = (self.drawn * 6364136223846793005 + 1442695040888963407) & (2**64 - 1)
        if (self.drawn >> 33) % (a.size + b.size) < a.size:
            a.right = self._join(a.right, b)
            a.sum()
            return a
        b.left = self._join(a, b.left)
        b.sum()
        return b

    def replace(self, first: int, last: int, chars: list[int], tokens: list[int]) -> None:
        """Segments first to last - 1 give way to others; only the paths to both places change."""
        before, rest = self._split(self.root, first)
        _, after = self._split(rest, last - first)
        self.root = self._join(self._join(before, self._build(list(zip(chars, tokens)), 0, len(chars))), after)

    def segment_counts(self) -> tuple[list[int], list[int]]:
        chars, tokens, path, node = [], [], [], self.root
        while path or node:
            while node:
                path.append(node)
                node = node.left
            node = path.pop()
            chars.append(node.own_chars)
            tokens.append(node.own_tokens)
            node = node.right
        return chars, tokens


def edit(text: str, tree: CountTree, start: int, length: int, insert: str, count) -> tuple[str, int]:
    """The edited text, and how many characters were encoded again; ``tree`` is changed to match."""
    start = min(max(0, start), len(text))
    end = min(start + max(0, length), len(text))
    new = text[:start] + insert + text[end:]
    if not tree.leaves:
        first, last, at, upto = 0, 0, 0, 0
    else:
        first, at, _ = tree.find(start)
        # The boundary holds as long as it and the character behind it stay.
        if start < at + 2 and first:
            first, at, _ = tree.find(at - 1)
        final, begun, size = tree.find(end)
        last, upto = final + 1, begun + size
    region = new[at : upto + len(new) - len(text)]
    parts = segments(region)
    tree.replace(first, last, [len(p) for p in parts], [count(p) for p in parts])
    return new, len(region)


def _counter(tokenizer: str):
    encode = encoder(tokenizer)
    return lambda text: len(encode(text))


def count_trees(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """(doc_id, text, segment_chars, segment_tokens, n_tokens) and the columns ``carry``: what later edits start from."""
    extra = list(carry or [])
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("text", T.StringType())])
    schema = schema.add("segment_chars", T.ArrayType(T.IntegerType())).add("segment_tokens", T.ArrayType(T.IntegerType())).add("n_tokens", T.LongType())
    for name in extra:
        schema = schema.add(docs.schema[name])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(tokenizer)
        for batch in batches:
            chars, tokens = [], []
            for text in batch.column(1):
                parts = segments(text.as_py() or "")
                chars.append([len(p) for p in parts])
                tokens.append([count(p) for p in parts])
            kind = pa.list_(pa.int32())
            columns = [batch.column(0), batch.column(1), pa.array(chars, kind), pa.array(tokens, kind), pa.array(list(map(sum, tokens)), pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, *batch.columns[2:]], [f.name for f in schema.fields])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *extra).mapInArrow(run, schema)


def apply_edits(trees: DataFrame, tokenizer: str, *, edits_col: str = "edits") -> DataFrame:
    """Rows of ``count_trees`` with their ``edits`` (array of start, length, insert) applied.

    text, segment_chars, segment_tokens and n_tokens are those after the edits; added are
    tokens_before and reencoded, the characters that were encoded again.
    """
    schema = T.StructType([trees.schema["doc_id"], trees.schema["text"], trees.schema["segment_chars"], trees.schema["segment_tokens"]])
    schema = schema.add("n_tokens", T.LongType()).add("tokens_before", T.LongType()).add("reencoded", T.LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(tokenizer)
        for batch in batches:
            rows: list[tuple] = []
            for text, chars, tokens, edits in zip(*(batch.column(i) for i in range(1, 5))):
                now, tree = text.as_py() or "", CountTree(chars.as_py(), tokens.as_py())
                before, again = tree.total, 0
                for e in edits.as_py() or []:
                    if e and None not in (e["start"], e["length"], e["insert"]):
                        now, n = edit(now, tree, e["start"], e["length"], e["insert"], count)
                        again += n
                rows.append((now, *tree.segment_counts(), tree.total, before, again))
            kinds = [pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.int64()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 6, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [f.name for f in schema.fields])

    return trees.select("doc_id", "text", "segment_chars", "segment_tokens", edits_col).mapInArrow(run, schema)


def with_edits(trees: DataFrame, edits: DataFrame) -> DataFrame:
    """``trees`` with the array of their edits from rows (doc_id, number, start, length, insert)."""
    ordered = F.sort_array(F.collect_list(F.struct("number", "start", "length", "insert")))
    own = edits.groupBy(F.col("doc_id").alias("edit__id")).agg(ordered.alias("edits"))
    own = own.withColumn("edits", F.transform("edits", lambda e: F.struct(e["start"].alias("start"), e["length"].alias("length"), e["insert"].alias("insert"))))
    return trees.join(own, F.col("doc_id") == F.col("edit__id"), "left").drop("edit__id")
