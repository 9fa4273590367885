"""The prefix trie of conversations, from a Cartesian tree over their sorted order.

A conversation is the sequence of its turns' keys (16 bytes of a SHA-256 of
role and text). Conversations are sorted by that sequence and dealt into blocks
by range; L is the number of turns that one shares with the one before it. A
node of the trie is then an interval of the sorted order: it opens where L is
below its depth and ends at the next L below its depth.

Each block finds nearest smaller values of L by a stack. What is popped is a
node of the Cartesian tree with its interval: equal values stay one node, and
the depths between a node and its parent, which have the same interval, are
kept as one range and expanded at the end. Depths still open at a block's end
look for the first later block whose minimum is smaller, and rows without a
smaller value before them in their block for the last such block before. Block
minima and sums are one row a block (a driver's array; their number is bounded
by the number of shuffle partitions), so the search goes on in parallel, and the
place inside the found block is met by an equality join on (block, depth).

Members, smallest ids, leaves and words are sums or minima over intervals:
carried on the stack, with those of whole blocks between and of the found
block's rows before the end added for intervals over several blocks. Of a node
that holds most conversations no task sees more than its block's rows; only
the SHA-256 of the ids that end in one node is one stream, read in portions.

Defined results: turns of equal number are ordered by their key; null roles and
texts are empty; rows without conv_id take no part; an empty table gives no
nodes. Columns besides conv_id, turn, role and text are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import n_words, shuffle_partitions, written

KEY = 16
#: Least rows of a block while there are fewer blocks than shuffle partitions.
BLOCK_ROWS = 4096
#: Ids in one row of a run that goes over several blocks.
PORTION = 8192
FIRST, LAST = -1, (1 << 63) - 1
NODE, OPEN, BEFORE, LEFT, RUN, TOTAL = range(6)
SCHEMA = "kind int, block bigint, start bigint, pstart bigint, u bigint, v bigint, n bigint, least bigint, words bigint, own bigint, leaves bigint, kids bigint, total bigint, w array<bigint>, ends string"


def turn_sequences(conversations: DataFrame) -> DataFrame:
    """conv_id, keys (hex, one per turn) and words (of each turn), in the order of turns, nulls first."""
    filled = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    key = F.substring(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256), 1, 2 * KEY)
    turn = F.struct(F.col("turn").isNotNull().alias("known"), "turn", key.alias("key"), n_words().alias("words"))
    grouped = filled.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return grouped.select("conv_id", F.col("t.key").alias("keys"), F.col("t.words").alias("words"))


def share_openings(sequences: DataFrame, base: Column, turns: Column, most: int) -> DataFrame:
    """Every conversation with its first ``turns`` (at most ``most``) turns replaced by those of the conversation ``base``, as many as that has."""
    opening = sequences.select(F.col("conv_id").alias("base_id"), F.slice("keys", 1, most).alias("base_keys"), F.slice("words", 1, most).alias("base_words"))
    met = sequences.withColumn("base", base).withColumn("h", turns).join(opening, F.col("base") == F.col("base_id"), "left")

    def rebuilt(name: str, kind: str) -> Column:
        return F.concat(F.slice(F.coalesce(f"base_{name}", F.array().cast(kind)), F.lit(1), F.col("h")), F.slice(name, F.col("h") + 1, F.size(name))).alias(name)

    return met.select("conv_id", rebuilt("keys", "array<string>"), rebuilt("words", "array<bigint>"))


def shared_turns(a: bytes, b: bytes) -> int:
    """Number of first keys that are equal."""
    low, high = 0, min(len(a), len(b)) // KEY
    if a[: high * KEY] == b[: high * KEY]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low * KEY : middle * KEY] == b[low * KEY : middle * KEY]:
            low = middle
        else:
            high = middle
    return low


def ids_digest(portions: Iterator[str]) -> str:
    """SHA-256 of comma-joined ids that come in portions."""
    out = hashlib.sha256()
    for i, portion in enumerate(portions):
        out.update((b"," if i else b"") + portion.encode())
    return out.hexdigest()


class Interval:
    """Depths lo+1 to hi that opened at ``start`` and are still open, and sums over the rows since."""

    def __init__(self, start=None, lo=-1, hi=-1, parent=None, own=0, total=0, upto=(0,)):
        self.start, self.lo, self.hi, self.parent, self.first_own, self.total, self.upto = start, lo, hi, parent, own, total, upto
        self.n, self.least, self.words, self.own, self.leaves, self.kids = 0, None, 0, 0, 0, 0
        self.run: list[int] | None = None

    def add(self, n: int, least: int | None, words: int, own: int, leaves: int) -> None:
        self.n += n
        self.words += words
        self.own += own
        self.leaves += leaves
        if least is not None:
            self.least = least if self.least is None else min(self.least, least)

    def sums(self) -> tuple:
        return self.n, self.least, self.words, self.own, self.leaves

    def before(self, u: int, v: int) -> list[int]:
        """Words in the turns before each depth from u+1 to v."""
        return [self.upto[max(d - 1, 0)] for d in range(u + 1, v + 1)]


class Block:
    """The stack over one block's rows in their order; what it finds is appended to ``out`` as rows of SCHEMA."""

    def __init__(self, number: int, out: list[tuple]):
        self.number, self.out = number, out
        self.keys: bytes | None = None
        self.floor = Interval()
        self.stack = [self.floor]
        self.lowest: int | None = None
        self.unmet: dict[int, int] = {}
        self.outer: list[int] = []
        self.outer_depth = 0

    def emit(self, kind: int, start=None, parent=None, u=None, v=None, sums=(None,) * 5, kids=None, total=None, w=None, ends=None) -> None:
        self.out.append((kind, self.number, start, parent, u, v, *sums, kids, total, w, ends))

    def cut(self, depth: int) -> None:
        """Ends all open depths above ``depth``."""
        while (top := self.stack[-1]) is not self.floor and top.hi > depth:
            u = max(depth, top.lo)
            ends = ids_digest(iter([",".join(map(str, top.run))])) if top.run else None
            self.emit(NODE, top.start, top.parent if u == top.lo else top.start, u, top.hi, top.sums(), top.kids, top.total, top.before(u, top.hi), ends)
            if u == top.lo:
                self.pop()
            else:
                top.hi, top.kids, top.run = u, 1, None

    def pop(self) -> None:
        top = self.stack.pop()
        self.stack[-1].add(top.n, top.least, top.words, top.own + top.first_own, top.leaves)

    def shared(self, keys: bytes) -> int:
        """L of the row with these keys; the row before it is a leaf if it is longer."""
        if self.keys is None:
            return -1
        depth = shared_turns(self.keys, keys)
        if self.floor.n or len(self.stack) > 1:
            self.stack[-1].leaves += depth < len(self.keys) // KEY
        return depth

    def row(self, at: int, conv: int, keys: bytes, words: list[int]) -> None:
        depth, length = self.shared(keys), len(keys) // KEY
        self.cut(depth)
        if self.lowest is None or depth < self.lowest:
            for d in range(depth + 1, (depth if self.lowest is None else self.lowest) + 1):
                self.emit(BEFORE, v=d, sums=self.floor.sums())
            self.lowest = depth
        top = self.stack[-1]
        if top is not self.floor:
            parent = top.start
            top.kids += length > depth
        else:
            parent = None
            if depth >= 0:
                self.unmet[depth] = self.unmet.get(depth, 0) + (length > depth)
        upto = [0, *np.cumsum(words).tolist()] if words else [0]
        if length > depth:
            new = Interval(at, depth, length, parent, upto[-1] - upto[max(depth, 0)], upto[-1], upto)
            new.add(1, conv, upto[-1], 0, 0)
            new.run = [conv]
            self.stack.append(new)
        else:
            top.add(1, conv, upto[-1], 0, 0)
            if top is self.floor:
                self.outer.append(conv)
                self.outer_depth = depth
            else:
                top.run.append(conv)
        self.keys = keys

    def close(self, following: bytes | None) -> None:
        """``following``: keys of the next block's first row."""
        if self.lowest is None:
            return
        last = len(self.keys) // KEY
        depth = -1
        if following is None:
            self.stack[-1].leaves += 1
        else:
            depth = self.shared(following)
        self.cut(depth)
        goes_on = following is not None and depth == last == len(following) // KEY
        while (top := self.stack[-1]) is not self.floor:
            for d in range(top.hi, top.lo, -1):
                ends = None
                if d == top.hi and top.run and goes_on:
                    self.portions(top.run, top.start, d)
                elif d == top.hi and top.run:
                    ends = ids_digest(iter([",".join(map(str, top.run))]))
                self.emit(OPEN, top.start, top.parent if d == top.lo + 1 else top.start, d - 1, d, top.sums(), top.kids if d == top.hi else 1, top.total, top.before(d - 1, d), ends)
            self.pop()
        if self.outer:
            self.portions(self.outer, None, self.outer_depth)
        for depth, kids in self.unmet.items():
            self.emit(LEFT, v=depth, kids=kids)
        self.emit(TOTAL, v=self.lowest, sums=self.floor.sums())

    def portions(self, run: list[int], start: int | None, depth: int) -> None:
        for i in range(0, len(run), PORTION):
            self.emit(RUN, start, v=depth, sums=(i, None, None, None, None), ends=",".join(map(str, run[i : i + PORTION])))


def _blocks(rows: DataFrame, tasks: int) -> DataFrame:
    """What the stacks find in all blocks of (block, at, conv_id, keys, words), each with the keys of the rows around it at FIRST and LAST."""
    import pyspark.sql.types as T

    names = [f.name for f in T.StructType.fromDDL(SCHEMA).fields]
    kinds = [pa.int32(), *[pa.int64()] * 12, pa.list_(pa.int64()), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        block: Block | None = None
        following = None

        def taken() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            for number, at, conv, keys, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block is None or block.number != number:
                    if block:
                        block.close(following)
                    block, following = Block(number, out), None
                if at == FIRST:
                    block.keys = keys
                elif at == LAST:
                    following = keys
                else:
                    block.row(at, conv, keys, words)
                if len(out) >= 10_000:
                    yield taken()
        if block:
            block.close(following)
        if out:
            yield taken()

    return rows.select("block", "at", "conv_id", "keys", "words").repartition(tasks, "block").sortWithinPartitions("block", "at").mapInArrow(run, SCHEMA)


def _sorted_blocks(sequences: DataFrame, blocks: int) -> DataFrame:
    """The sequences in their order, block by block, each block with the keys of its neighbours' nearest rows."""
    spark = sequences.sparkSession
    ordered = sequences.select("conv_id", F.unhex(F.array_join("keys", "")).alias("keys"), "words").repartitionByRange(blocks, "keys", "conv_id").sortWithinPartitions("keys", "conv_id")
    ordered = written(ordered.withColumn("at", F.monotonically_increasing_id()).withColumn("block", F.shiftright("at", 33)), "trie-sorted")
    edges = written(ordered.groupBy("block").agg(F.min_by("keys", "at").alias("head"), F.max_by("keys", "at").alias("tail")), "trie-edges")
    numbers = sorted(r.block for r in edges.select("block").collect())
    pairs = spark.createDataFrame(list(zip(numbers, numbers[1:], strict=False)), "one bigint, next bigint")
    none = [F.lit(None).cast("bigint").alias("conv_id"), F.col("keys"), F.lit(None).cast("array<bigint>").alias("words")]
    before = edges.join(F.broadcast(pairs), F.col("block") == F.col("one")).select(F.col("next").alias("block"), F.lit(FIRST).cast("bigint").alias("at"), F.col("tail").alias("keys"))
    after = edges.join(F.broadcast(pairs), F.col("block") == F.col("next")).select(F.col("one").alias("block"), F.lit(LAST).cast("bigint").alias("at"), F.col("head").alias("keys"))
    around = before.unionByName(after).select("block", "at", *none)
    return ordered.select("block", "at", "conv_id", "keys", "words").unionByName(around)


class Minima:
    """Minima and sums of all blocks, in their order: one row a block."""

    def __init__(self, totals: list):
        totals = sorted(totals, key=lambda r: r.block)
        column = lambda name: np.array([getattr(r, name) for r in totals], dtype=np.int64)
        self.block, self.lowest, self.least = column("block"), column("v"), column("least")
        self.upto = {k: np.concatenate([[0], np.cumsum(column(k))]) for k in ("n", "words", "own", "leaves")}

    def nearest_before(self, block: int, depth: int) -> int:
        at = int(np.searchsorted(self.block, block))
        return int(self.block[np.flatnonzero(self.lowest[:at] < depth)[-1]])

    def nearest_after(self, block: int, depth: int) -> tuple:
        """The first later block with a smaller minimum (none: -1), and the sums of the blocks between."""
        at = int(np.searchsorted(self.block, block)) + 1
        lower = self.lowest[at:] < depth
        end = at + int(lower.argmax()) if lower.any() else len(self.block)
        between = [int(u[end] - u[at]) for u in self.upto.values()]
        return int(self.block[end]) if end < len(self.block) else -1, int(self.least[at:end].min()) if end > at else None, *between


def _resolved(found: DataFrame, minima: Minima) -> tuple[DataFrame, DataFrame]:
    """Nodes of all depths with their whole intervals and parents' starts, and (start, v, ends) of runs over several blocks."""
    shared = found.sparkSession.sparkContext.broadcast(minima)
    opens = found.where(F.col("kind") == OPEN)

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [shared.value.nearest_before(*x) for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int64())], names=["block", "v", "kids", "home"])

    left = found.where(F.col("kind") == LEFT).select("block", "v", "kids").mapInArrow(homes, "block bigint, v bigint, kids bigint, home bigint")
    starts = opens.select(F.col("block").alias("home"), "v", F.col("start").alias("left_start"))
    left = written(left.join(starts, ["home", "v"]).select(F.col("block").alias("left_block"), F.col("v").alias("left_v"), "left_start", "kids"), "trie-left")

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [shared.value.nearest_after(*x) for x in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(c, pa.int64()) for c in zip(*at, strict=True)]], names=[*("block", "start", "v"), *later]) if at else pa.RecordBatch.from_arrays([*b.columns, *[pa.array([], pa.int64())] * 6], names=["block", "start", "v", *later])

    later = ["to", "mid_least", "mid_n", "mid_words", "mid_own", "mid_leaves"]
    after = opens.select("block", "start", "v").mapInArrow(ends, ", ".join(f"{c} bigint" for c in ["block", "start", "v", *later]))
    before = found.where(F.col("kind") == BEFORE).select(F.col("block").alias("to"), "v", *[F.col(c).alias(f"end_{c}") for c in ("n", "least", "words", "own", "leaves")])
    more_kids = left.groupBy(F.col("left_start").alias("start"), F.col("left_v").alias("v")).agg(F.sum("kids").alias("end_kids"))
    rest = after.join(before, ["to", "v"], "left").join(more_kids, ["start", "v"], "left").drop("block", "to")
    added = lambda c: (F.col(c) + F.coalesce(f"mid_{c}", F.lit(0)) + F.coalesce(f"end_{c}", F.lit(0))).alias(c)
    whole = opens.join(rest, ["start", "v"]).select("block", "start", "pstart", "u", "v", added("n"), F.least("least", "mid_least", "end_least").alias("least"), added("words"), added("own"), added("leaves"), (F.col("kids") + F.coalesce("end_kids", F.lit(0))).alias("kids"), "total", "w", "ends")
    nodes = found.where(F.col("kind") == NODE).select(whole.columns).unionByName(whole)
    unmet = F.col("pstart").isNull() & (F.col("u") >= 0)
    met = nodes.where(unmet).join(left.drop("kids"), (F.col("block") == F.col("left_block")) & (F.col("u") == F.col("left_v"))).withColumn("pstart", F.col("left_start")).select(nodes.columns)
    nodes = written(nodes.where(~unmet).unionByName(met), "trie-nodes")
    runs = found.where(F.col("kind") == RUN).select("block", "start", "v", F.col("n").alias("portion"), "ends")
    runs = runs.join(left.select("left_block", "left_v", "left_start"), (F.col("block") == F.col("left_block")) & (F.col("v") == F.col("left_v")), "left").select(F.coalesce("start", "left_start").alias("start"), "v", "block", "portion", "ends")
    return nodes, _run_digests(runs)


def _run_digests(runs: DataFrame) -> DataFrame:
    """(start, v, run_ends) from the portions of each run, read one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([digest.hexdigest()])], names=["start", "v", "run_ends"])

        for batch in batches:
            for start, v, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if key == (start, v):
                    digest.update(b"," + text.encode())
                    continue
                if key:
                    yield done()
                key, digest = (start, v), hashlib.sha256(text.encode())
        if key:
            yield done()

    tasks = shuffle_partitions(runs.sparkSession)
    return runs.repartition(tasks, "start", "v").sortWithinPartitions("start", "v", "block", "portion").mapInArrow(run, "start bigint, v bigint, run_ends string")


def prefix_trie(sequences: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per distinct beginning of (conv_id, keys, words): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    conv_id is the smallest id among the conversations that begin so; ends_sha256
    is of the ids of those that are no longer, in numerical order.
    """
    tasks = shuffle_partitions(sequences.sparkSession)
    sequences = written(sequences, "trie-sequences")
    blocks = max(1, min(tasks, -(-sequences.count() // block_rows)))
    found = written(_blocks(_sorted_blocks(sequences, blocks), blocks), "trie-found")
    minima = Minima(found.where(F.col("kind") == TOTAL).select("block", "v", "n", "least", "words", "own", "leaves").collect())
    nodes, digests = _resolved(found, minima)
    # A parent's smallest id is fetched once for each block that has children of it.
    asked = nodes.where("pstart is not null").select("block", "pstart", "u").distinct()
    ids = asked.join(nodes.select(F.col("start").alias("pstart"), F.col("v").alias("u"), F.col("least").alias("parent_id")), ["pstart", "u"])
    nodes = nodes.join(ids, ["block", "pstart", "u"], "left").join(digests, ["start", "v"], "left")
    depths = nodes.select("*", F.posexplode("w").alias("i", "before")).withColumn("depth", F.col("u") + 1 + F.col("i"))
    top = F.col("depth") == F.col("v")
    saved = F.col("words") - F.col("n") * F.col("before") - F.col("own") - (F.col("total") - F.col("before"))
    return depths.select(
        F.col("least").alias("conv_id"), "depth", F.when(F.col("i") == 0, F.col("parent_id")).otherwise(F.col("least")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.when(top, F.col("kids")).otherwise(1).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"), saved.alias("saved_tokens"),
        F.coalesce(F.when(top, F.coalesce("run_ends", "ends")), F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
