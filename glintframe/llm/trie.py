"""The prefix trie of conversations, from their sorted turn arrays.

A turn counts as 16 bytes of its digest.  A conversation becomes an array of these, in blocks of a few dozen turns, and the
blocks are range-sorted by what comes before them (``prefix``), their bytes and the conversation.  Conversations that share their first turns are then
neighbours.  Each task sweeps its sorted rows once with a stack: the length of the prefix that a row shares with the row
before (their LCP) says which open nodes end and which begin; a node that ends knows its members and its subtree.  Only
nodes on the path of a task's first or last row may go on in another task; these (at most two paths a task) leave as open parts, are merged by their
path, and pass their sums on to their ancestors.

A node at the end of a block has its further turns in the next block's trie.  What hangs below (children, leaves, tokens) is summed over
the blocks' tries by doubling, in as many rounds as the logarithm of the blocks of the longest conversation.  So no
task needs a whole conversation, nor all that share a first turn, whatever share of the rows these hold.

Ids of the conversations that end at a node are hashed in the sweep, in their order.  Long lists, and those that
a task's first or last row belongs to, leave as strings of some thousand ids; SHA-256 is serial by definition, so the strings of one
node meet in one task, as a stream.

Defined cases: turns of one conversation with equal numbers are ordered by their digests; a null turn number comes
first; a null role or text is empty; rows without a conv_id belong to no conversation and are left out; an
empty table has no conversation and no node, not even a root; other columns are left out.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from hashlib import blake2b, sha256
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glintframe.operators import scan

from .common import discard, written

#: Bytes of a turn's digest.
TURN = 16
#: Conversations of a family share its first one's turns, up to ``SHARED`` - 1 of them.
FAMILY, SHARED = 100, 6
CLOSED, OPEN, LIST = 0, 1, 2


class Limits(NamedTuple):
    """Turns of a block; ids in a string; children of an open node that are held until it ends; blocks that a task sweeps, about.  Results don't depend on them."""

    block: int = 64
    ids: int = 8192
    held: int = 4096
    rows: int = 200_000


SWEPT = """kind int, place int, depth long, block long, prefix string, conv long, parent_conv long, parent binary, ident binary, path array<binary>, n long,
  children long, leaves long, saved long, len long, below long, x_leaves long, x_saved long, top long, ends long, sha string, part int, seq long, ids string"""


def turns(conversations: DataFrame) -> DataFrame:
    """(conv, pos, turn, len): turns numbered from 0 within their conversation, with their digest and code points."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)), 1, TURN)
    slim = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").alias("number"), digest.alias("turn"), F.length(text).cast("long").alias("len"))
    slim = written(slim, "trie-turns")
    numbered = scan.ranked(slim, ["conv"], F.col("number"), F.col("turn"), "pos")
    out = written(numbered.select("conv", (F.col("pos") - 1).alias("pos"), "turn", "len"), "trie-numbered")
    discard(slim)
    return out


def rebuilt(numbered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((conv, pos, turn, len), (conv, length)) of the rebuilt conversations: the first turns of the family's first one, then the own turns after as many."""
    h = (F.crc32(F.col("conv").cast("string")) % SHARED).cast("long")
    base = F.col("conv") - F.col("conv") % FAMILY
    sizes = numbered.groupBy("conv").agg(F.count("*").alias("n"))
    firsts = numbered.where((F.col("conv") % FAMILY == 0) & (F.col("pos") < SHARED - 1)).select(F.col("conv").alias("base"), "pos", "turn", "len")
    lead = firsts.groupBy("base").agg(F.count("*").alias("lead"))  # SHARED - 1 at most
    told = sizes.select("conv", "n", h.alias("h"), base.alias("base")).join(lead, "base", "left")
    told = told.select("conv", "base", "n", "h", F.least("h", F.coalesce("lead", F.lit(0))).alias("shift"))
    told = written(told, "trie-conversations")
    # The rows of a large conversation needn't meet: families are few rows a conversation, own turns move by their conversation's shift.
    moved = told.where("shift <> h").select(F.col("conv").alias("moved__conv"), "shift")
    own = numbered.where(F.col("pos") >= h).join(moved, F.col("conv") == F.col("moved__conv"), "left")
    own = own.select("conv", (F.col("pos") - h + F.coalesce("shift", h)).alias("pos"), "turn", "len")
    shared = told.join(firsts, "base").where("pos < h").select("conv", "pos", "turn", "len")  # a family is FAMILY conversations at most
    return own.unionByName(shared), told.select("conv", (F.col("shift") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))


def blocks(rows: DataFrame, lengths: DataFrame, size: int) -> DataFrame:
    """(conv, block, key, lens, n, ends, prefix, through): arrays of up to ``size`` turns; ``prefix`` and ``through`` tell what was before and what is up to here."""
    at = F.floor(F.col("pos") / size)
    parts = rows.select("conv", at.alias("block"), F.struct("pos", "turn", "len").alias("t"), F.lit(False).alias("end"))
    last = lengths.select("conv", F.floor(F.greatest(F.col("length") - 1, F.lit(0)) / size).alias("block"), F.lit(None).cast(parts.schema["t"].dataType).alias("t"), F.lit(True).alias("end"))
    grouped = parts.unionByName(last).groupBy("conv", "block").agg(F.sort_array(F.collect_list("t")).alias("t"), F.max("end").alias("ends"))  # ``size`` turns at most
    key = F.aggregate("t", F.lit(b""), lambda s, x: F.concat(s, x["turn"]))
    made = grouped.select("conv", "block", key.alias("key"), F.col("t.len").alias("lens"), F.size("t").alias("n"), "ends")
    made = written(made, "trie-blocks")
    # Conversations of one block need no sums.  A sum over a block's place and digest stands for its bytes.
    long_ones = made.where("not (ends and block = 0)")
    mark = F.sha2(F.concat(F.col("block").cast("string").cast("binary"), F.lit(b":"), F.col("key")), 256)
    number = lambda i: F.conv(F.substring(mark, i, 15), 16, 10).cast("decimal(20,0)")
    summed = scan.carried(long_ones, ["conv"], F.col("block"), F.col("key"), {"sum_a": number(1), "sum_b": number(16)})
    text = lambda a, b: F.concat_ws(":", a.cast("string"), b.cast("string"))
    a, b = F.col("sum_a"), F.col("sum_b")
    marked = summed.select("conv", "block", "key", "lens", "n", "ends", F.when(F.col("block") == 0, "").otherwise(text(a - number(1), b - number(16))).alias("prefix"), text(a, b).alias("through"))
    plain = made.where("ends and block = 0").withColumns({"prefix": F.lit(""), "through": F.lit(None).cast("string")})
    out = written(plain.unionByName(marked), "trie-blocks")
    discard(made)
    return out


class _Node:
    __slots__ = ("n", "conv", "children", "leaves", "saved", "len", "below", "x_leaves", "x_saved", "top", "ends", "ids", "listed", "sha", "held", "left", "edge", "ident", "told")

    def __init__(self, length: int, left: bool) -> None:
        self.n = self.children = self.leaves = self.saved = self.below = self.x_leaves = self.x_saved = self.ends = 0
        self.conv = self.top = self.sha = self.ident = None
        self.len, self.left = length, left
        self.edge = self.listed = self.told = False
        self.ids, self.held = [], []


class _Sweep:
    """The stack over one task's sorted rows.  ``out`` are rows of ``SWEPT``."""

    def __init__(self, part: int, limits: Limits) -> None:
        self.limits = limits
        self.part, self.seq, self.first = part, 0, True
        self.out: list[dict] = []
        self.stack: list[_Node] = []
        self.at: tuple[int, str] | None = None
        self.key = b""

    def ident(self, depth: int) -> bytes:
        node = self.stack[depth]
        if node.ident is None:
            block, prefix = self.at
            node.ident = blake2b(struct.pack("<q", block) + prefix.encode() + b"/" + self.key[: depth * TURN], digest_size=TURN).digest()
        return node.ident

    def flush_ids(self, depth: int) -> None:
        node = self.stack[depth]
        self.out.append(dict(kind=LIST, ident=self.ident(depth), part=self.part, seq=self.seq, ids=",".join(map(str, node.ids))))
        self.seq += 1
        node.ids, node.listed = [], True

    def seal(self, depth: int, last: bool) -> None:
        """A node's ids are over: hashed here, unless some are in another task or have left before."""
        node = self.stack[depth]
        if node.ids and (last or node.edge or node.listed):
            self.flush_ids(depth)
        elif node.ids:
            node.sha, node.ids = sha256(",".join(map(str, node.ids)).encode()).hexdigest(), []

    def pop(self, last: bool) -> None:
        depth, node = len(self.stack) - 1, self.stack[-1]
        self.seal(depth, last)
        block, prefix = self.at
        up = self.stack[-2] if depth else None
        mine = dict(place=depth, depth=block * self.limits.block + depth, block=block, prefix=None if depth else prefix, conv=node.conv, n=node.n, ends=node.ends, sha=node.sha, top=node.top)
        if node.left or last:
            path = [self.ident(i) for i in range(depth + 1)]
            sums = dict(children=node.children, leaves=node.leaves, saved=node.saved, below=node.below, x_leaves=node.x_leaves, x_saved=node.x_saved, len=node.len)
            self.out.append(dict(kind=OPEN, ident=path[-1], path=path, **mine, **sums))
            self.out += [{**row, "parent": path[-1]} for row in node.held]
        else:
            parent_conv = node.top if block and not depth else node.conv
            self.out += [{**row, "parent_conv": parent_conv} for row in node.held]
            children = node.children + node.below
            leaves = node.leaves + node.x_leaves + (0 if children else 1)
            saved = node.saved + node.x_saved + (node.n - 1) * node.len
            row = dict(kind=CLOSED, ident=self.ident(depth) if node.told or node.listed else None, children=children, leaves=leaves, saved=saved, **mine)
            if up is None:
                self.out.append(row)
            else:
                up.children, up.leaves, up.saved = up.children + 1, up.leaves + leaves, up.saved + saved
                up.held.append(row)
                if len(up.held) >= self.limits.held:  # their parent's own row will tell its conversation
                    up.told, name = True, self.ident(depth - 1)
                    self.out += [{**own, "parent": name} for own in up.held]
                    up.held = []
        self.stack.pop()
        if up is not None:
            up.n += node.n
            up.conv = node.conv if up.conv is None else min(up.conv, node.conv)

    def row(self, block: int, prefix: str, key: bytes, conv: int, lens: list[int], ends: bool, below: int, x_leaves: int, x_saved: int, top: int | None) -> None:
        depth = len(key) // TURN
        if self.at != (block, prefix):
            while self.stack:
                self.pop(False)
            self.at, self.key = (block, prefix), b""
            self.stack.append(_Node(0, self.first))
        same, most = 0, min(len(self.key), len(key))
        if self.key[:most] == key[:most]:
            same = most // TURN
        else:
            while self.key[same * TURN : same * TURN + TURN] == key[same * TURN : same * TURN + TURN]:
                same += 1
        while len(self.stack) > same + 1:
            self.pop(False)
        if len(self.stack) <= depth:
            self.seal(len(self.stack) - 1, False)  # shorter arrays come first: no more of them
        self.key = key
        while len(self.stack) <= depth:
            self.stack.append(_Node(lens[len(self.stack) - 1], self.first))
        node = self.stack[-1]
        node.edge, self.first = node.edge or self.first, False
        node.n += 1
        node.conv = conv if node.conv is None else min(node.conv, conv)
        node.below, node.x_leaves, node.x_saved = node.below + below, node.x_leaves + x_leaves, node.x_saved + x_saved
        if top is not None:
            self.stack[0].top = top
        if ends:
            node.ends += 1
            node.ids.append(conv)
            if len(node.ids) >= self.limits.ids:
                self.flush_ids(depth)

    def end(self) -> None:
        while self.stack:
            self.pop(True)


FIELDS = ["block", "prefix", "key", "conv", "lens", "ends", "below", "x_leaves", "x_saved", "top"]
_KINDS = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<binary>": pa.list_(pa.binary())}
ARROW = pa.schema([(name, _KINDS[kind]) for name, kind in (field.split() for field in SWEPT.split(","))])


def swept(rows: DataFrame, limits: Limits) -> DataFrame:
    """The parts of nodes, and strings of ids, that each task's sweep over its range of the sorted rows gives."""
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // limits.rows))
    order = ["block", "prefix", "key", "conv"]
    spread = rows.select(*FIELDS).repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _Sweep(TaskContext.get().partitionId(), limits)
        for batch in batches:
            for row in zip(*[column.to_pylist() for column in batch.columns]):
                own.row(*row)
                if len(own.out) >= limits.held:
                    yield pa.RecordBatch.from_pylist(own.out, ARROW)
                    own.out = []
        own.end()
        yield pa.RecordBatch.from_pylist(own.out, ARROW)

    return written(spread.mapInArrow(sweep, SWEPT), "trie-swept")


NODE = ["place", "depth", "block", "prefix", "conv", "parent_conv", "parent", "ident", "n", "children", "leaves", "saved", "ends", "sha", "top"]


def stitched(found: DataFrame) -> DataFrame:
    """Whole nodes: closed ones as they are, open ones merged by path, each with what the open ones below it add."""
    sums = ["n", "children", "leaves", "saved", "below", "x_leaves", "x_saved", "ends"]
    same_for_all = ["place", "depth", "block", "prefix", "path", "len"]
    parts = found.where(F.col("kind") == OPEN)
    whole = parts.groupBy("ident").agg(*[F.first(c).alias(c) for c in same_for_all], *[F.sum(c).alias(c) for c in sums], F.min("conv").alias("conv"), F.max("sha").alias("sha"), F.max("top").alias("top"))
    whole = written(whole, "trie-open")
    up = F.get("path", F.col("place") - 1)
    kids = whole.where("place > 0").groupBy(up.alias("of")).agg(F.count("*").alias("kids"))
    whole = whole.join(kids, F.col("ident") == F.col("of"), "left").withColumn("children", F.col("children") + F.col("below") + F.coalesce("kids", F.lit(0)))
    leaves = F.col("leaves") + F.col("x_leaves") + F.when(F.col("children") == 0, 1).otherwise(0)
    saved = F.col("saved") + F.col("x_saved") + (F.col("n") - 1) * F.col("len")
    below = whole.select(F.explode("path").alias("above"), leaves.alias("leaves"), saved.alias("saved"))  # a path has a block's turns and its root at most
    below = below.groupBy("above").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    merged = whole.drop("leaves", "saved").join(below, F.col("ident") == F.col("above"))
    merged = merged.withColumns({"parent": F.when(F.col("place") > 0, up), "parent_conv": F.lit(None).cast("long")}).select(*NODE)
    return found.where(F.col("kind") == CLOSED).select(*NODE).unionByName(merged)


def hashed(found: DataFrame) -> DataFrame:
    """(listed, list_sha): hashes of the lists that left the sweep as strings, each streamed through one task."""
    strings = found.where(F.col("kind") == LIST).select("ident", "part", "seq", "ids")
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state, done = None, None, []
        for batch in batches:
            for own, ids in zip(batch.column("ident").to_pylist(), batch.column("ids").to_pylist()):
                if own != name:
                    done += [(name, state.hexdigest())] if state else []
                    name, state = own, sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
        done += [(name, state.hexdigest())] if state else []
        yield pa.RecordBatch.from_pydict({"listed": pa.array([d[0] for d in done], pa.binary()), "list_sha": pa.array([d[1] for d in done], pa.string())})

    return strings.repartition(parts, "ident").sortWithinPartitions("ident", "part", "seq").mapInArrow(digest, "listed binary, list_sha string")


def _below(rows: DataFrame, limits: Limits) -> DataFrame | None:
    """(block, prefix, up, children, leaves, saved) of each trie of later blocks: its first turns, and its whole subtree; None if there is none."""
    deep = rows.where("block > 0")
    if deep.isEmpty():
        return None
    # A node whose conversations go on is no leaf, though its children are in the next block.
    found = swept(deep.withColumns({"below": F.when(F.col("ends"), 0).otherwise(1).cast("long"), "x_leaves": F.lit(0).cast("long"), "x_saved": F.lit(0).cast("long"), "top": F.lit(None).cast("long")}), limits)
    roots = stitched(found).where("place = 0").select("block", "prefix", "children", "leaves", "saved")
    links = rows.where("not ends").select((F.col("block") + 1).alias("block"), F.col("through").alias("prefix"), F.when(F.col("block") > 0, F.col("prefix")).alias("up")).distinct()
    tries = written(roots.join(links, ["block", "prefix"]).withColumn("far", F.lit(1).cast("long")), "trie-tries")
    discard(found)
    while not tries.where("up is not null").isEmpty():
        # Sums of all tries nearer than ``far``; those of the tries ``far`` below are as far-reaching, so the reach doubles.
        more = tries.where("up is not null").groupBy((F.col("block") - F.col("far")).alias("block"), F.col("up").alias("prefix")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        above = tries.select((F.col("block") + F.col("far")).alias("below_block"), F.col("prefix").alias("below_up"), F.col("up").alias("next_up"))
        stepped = tries.join(more, ["block", "prefix"], "left").join(above, (F.col("block") == F.col("below_block")) & (F.col("up") == F.col("below_up")), "left")
        stepped = stepped.select(
            "block", "prefix", F.col("next_up").alias("up"), "children", (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"),
            (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"), (F.col("far") * 2).alias("far"),
        )
        before, tries = tries, written(stepped, "trie-tries")
        discard(before)
    return tries


def _extras(rows: DataFrame, limits: Limits) -> DataFrame:
    """``rows`` with what a node at a block's end has below it, and what the next block's trie has above, each on one row of the node."""
    none = {name: F.lit(0).cast("long") for name in ("below", "x_leaves", "x_saved")}
    tries = _below(rows, limits)
    if tries is None:
        return rows.withColumns({**none, "top": F.lit(None).cast("long")})
    on = F.when(~F.col("ends"), F.col("conv"))
    ends = rows.where(F.col("n") == limits.block).groupBy("block", "prefix", "key").agg(F.min("conv").alias("top"), F.min(on).alias("conv"), F.max(F.when(~F.col("ends"), F.col("through"))).alias("through"))
    ends = written(ends.where("conv is not null").drop("prefix", "key"), "trie-ends")
    sums = tries.select((F.col("block") - 1).alias("block"), F.col("prefix").alias("through"), F.col("children").alias("below"), F.col("leaves").alias("x_leaves"), F.col("saved").alias("x_saved"))
    up = ends.join(sums, ["block", "through"]).select("conv", "block", "below", "x_leaves", "x_saved", F.lit(None).cast("long").alias("top"))
    heads = rows.where("block > 0").groupBy("block", "prefix").agg(F.min("conv").alias("conv"))
    tops = ends.select((F.col("block") + 1).alias("block"), F.col("through").alias("prefix"), "top")
    down = heads.join(tops, ["block", "prefix"]).select("conv", "block", *[v.alias(k) for k, v in none.items()], "top")
    extras = up.unionByName(down).groupBy("conv", "block").agg(*[F.sum(c).alias(c) for c in none], F.max("top").alias("top"))
    deep = rows.where("block > 0 or not ends").join(extras, ["conv", "block"], "left")
    deep = deep.withColumns({c: F.coalesce(c, F.lit(0)) for c in none})
    return deep.unionByName(rows.where("block = 0 and ends").withColumns({**none, "top": F.lit(None).cast("long")}))


def prefix_trie(conversations: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The nodes of the rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    numbered = turns(conversations)
    rows = blocks(*rebuilt(numbered), limits.block)
    discard(numbered)
    found = swept(_extras(rows, limits), limits)
    nodes = written(stitched(found), "trie-nodes")
    lists = written(hashed(found), "trie-lists")
    discard(found, rows)
    # Nodes that tell others of their conversation: two paths a task, and one for each ``held`` children.
    known = F.when((F.col("place") == 0) & (F.col("block") > 0), F.col("top")).otherwise(F.col("conv"))
    told = written(nodes.where("ident is not null").select(F.col("ident").alias("told"), known.alias("told_conv")), "trie-told")
    out = nodes.where("place > 0 or block = 0")
    waits = F.col("parent").isNotNull()
    out = out.where(~waits).unionByName(out.where(waits).join(told, F.col("parent") == F.col("told"), "left").withColumn("parent_conv", F.col("told_conv")).drop("told", "told_conv"))
    listed = (F.col("ends") > 0) & F.col("sha").isNull()
    out = out.where(~listed).unionByName(out.where(listed).join(lists, F.col("ident") == F.col("listed"), "left").withColumn("sha", F.col("list_sha")).drop("listed", "list_sha"))
    kind = conversations.schema["conv_id"].dataType
    return out.select(
        F.col("conv").cast(kind).alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.col("parent_conv").cast(kind).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("sha", F.sha2(F.lit(b""), 256)).alias("ends_sha256"),
    )
