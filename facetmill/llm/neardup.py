"""Near-duplicate documents: MinHash with tensored banding, links verified on full sets.

A document's set of word shingles is sketched by two collections of ``SIDE``
small keys, each made of ``WIDTH`` minhashes. A table key combines one small
key of each collection, so SIDE * SIDE tables of 2 * WIDTH minhashes cost only
2 * SIDE * WIDTH minhashes. At a similarity of 0.8 a pair misses every table
with a probability below 1 in 10,000; above that, it falls quickly.

1. Documents with the same set are one class; the smallest id stands for it.
2. Classes are dealt out by the small keys of the first collection, with those
   of the second as payload; a key that nobody shares ends there. Inside a
   shared key the second collection gives the buckets.
3. Every class is put into the canopy of a center: the smallest member of one
   of its buckets with which its sketch agrees often enough, else itself. Where
   a bucket holds classes of several canopies, those of the larger center also
   join the canopy of the smaller, if their sketch allows a link to one of its
   classes: if x is in the canopy of p, y agrees with p on no fewer minhashes
   than x does, less those on which x and y differ. So the members of every
   pair that shares a bucket and could be linked meet in a canopy, and a bucket
   of n similar classes costs about n rows, not n * n.
4. Members are verified against their center on full sets, and the components
   of these links are found. Canopies that are one component are done.
5. In the others, a member is told by its differences to the center: shingles
   that it has besides, and those that it lacks. Two members of which one is
   not linked to the center can only be linked if they share differences, and
   how many follows from their sizes. So members meet by those of their rarest
   differences of which one must be shared (a prefix, as in joins of similar
   sets), first all with the smallest member that has the same difference, then
   those of different components among each other. Candidates are verified on
   their differences, which give the exact similarity. Members that are equally
   far from the center, but have little else in common, never meet, so their
   number does not count by its square. Nor do two members meet by a difference
   behind which either has fewer left than they must share.

Full sets are made again from the texts for the documents that need them only.

Defined results: null and empty texts, and texts without words, have an empty
set and are linked with nothing; repeated rows each get their row; a row
without id is linked by its text, but its id names no component (null if it
has no other member) and it is never marked as kept. Columns besides doc_id
and text are not looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import written
from .components import connected_components, extended_components
from .shingles import mixed, shingle_sets

WIDTH, SIDE = 3, 14
#: Minhashes of a sketch, all that are made. At a similarity of 0.8 a pair differs on more than SLACK of them about 5 times in a million.
PROBE = 2 * SIDE * WIDTH
SLACK = 33
#: Minhashes that must agree with a center to be of its canopy.
TIGHT = 42
#: Rows that share a small key above which the key is dealt with apart.
HOT_ROWS = 200_000
#: Rows and bytes of texts that are sketched at once.
PORTION_ROWS, PORTION_BYTES = 512, 4 << 20
#: Nodes up to which the table of those whose texts are read again is broadcast (8 bytes each).
BROADCAST_NODES = 1_000_000
_MULTIPLIERS, _OFFSETS = (mixed(np.arange(lo, lo + 2 * SIDE * WIDTH, dtype=np.uint64)) for lo in (1, 1001))
_MULTIPLIERS = _MULTIPLIERS | np.uint64(1)


def minhashes(values: np.ndarray) -> np.ndarray:
    """The least value of the set under each hash function."""
    least = np.full(len(_MULTIPLIERS), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(values), 2048):
        np.minimum(least, (values[at : at + 2048, None] * _MULTIPLIERS + _OFFSETS).min(axis=0), out=least)
    return least


def small_keys(least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two collections of small keys, for rows of minhashes."""
    folded = least.reshape(len(least), 2, SIDE, WIDTH)
    key = np.broadcast_to(np.arange(SIDE, dtype=np.uint64), folded.shape[:3])
    for w in range(WIDTH):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + folded[..., w])
    return key[:, 0], key[:, 1]


def _portions(batches: Iterator[pa.RecordBatch], text: int = 1) -> Iterator[pa.RecordBatch]:
    """Batches of at most PORTION_ROWS rows and about PORTION_BYTES bytes in column ``text``, but one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        at = 0
        while at < batch.num_rows:
            room = np.searchsorted(np.cumsum(sizes[at : at + PORTION_ROWS], dtype=np.int64), PORTION_BYTES, side="right")
            n = max(1, int(room))
            yield batch.slice(at, n)
            at += n


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, set_key (a digest of the set), a and b (small keys), probe (minhashes for comparison)."""
    names = ["doc_id", "n_shingles", "set_key", "a", "b", "probe"]

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _portions(batches):
            sets = shingle_sets(batch.column(1).to_pylist(), k)
            least = np.stack([minhashes(s) for s in sets]) if sets else np.zeros((0, len(_MULTIPLIERS)), np.uint64)
            a, b = small_keys(least)
            lists = lambda x, kind: pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, SIDE, dtype=np.int32)), pa.array(x.ravel(), kind))
            probe = (least[:, :PROBE] >> np.uint64(40)).astype(np.uint16)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    lists(a.view(np.int64), pa.int64()), lists((b >> np.uint64(32)).astype(np.uint32).view(np.int32), pa.int32()),
                    pa.array([p.tobytes() for p in probe], pa.binary()),
                ],
                names=names,
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(sketch, "doc_id bigint, n_shingles bigint, set_key binary, a array<bigint>, b array<int>, probe binary")


def bucket_rows(classes: DataFrame) -> DataFrame:
    """(bucket, node, pivot) for every membership of a bucket with at least two members; buckets with the same members are one.

    Small keys with very many rows are counted first. Their rows are not dealt
    out by that key: buckets are summed up before the shuffle, and joined to
    their members in a join whose large keys Spark splits.
    """
    rows = classes.select("node", F.col("b"), F.explode("a").alias("ka"))
    hot = written(rows.groupBy("ka").agg(F.count("*").alias("n")).where(F.col("n") > HOT_ROWS).select("ka"), "neardup-hot")
    split = not hot.isEmpty()
    cells_of = lambda df: df.select("node", "ka", F.posexplode("b").alias("j", "kb"))
    keys = ["ka", "j", "kb"]
    kept = lambda df: df.where("members > 1").select(F.xxhash64("who", "members", "pivot").alias("bucket"), "node", "pivot")
    stats = {"pivot": F.min("node"), "members": F.count("*"), "who": F.bit_xor(F.xxhash64("node"))}

    cold = rows.join(hot, "ka", "left_anti") if split else rows
    shared = cold.withColumn("sharing", F.count("*").over(Window.partitionBy("ka"))).where("sharing > 1")
    in_bucket = Window.partitionBy(*keys)
    found = kept(cells_of(shared).withColumns({c: f.over(in_bucket) for c, f in stats.items()}))
    if split:
        cells = cells_of(rows.join(hot, "ka", "left_semi"))
        found = found.unionByName(kept(cells.join(cells.groupBy(*keys).agg(*[f.alias(c) for c, f in stats.items()]), keys)))
    return found.distinct()


def agreement(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Adds agree, the number of equal minhashes, to pairs (x, y)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                p, q = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint16).reshape(-1, PROBE) for c in ("px", "py"))
                yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y"), pa.array((p == q).sum(axis=1).astype(np.int32))], names=["x", "y", "agree"])

    side = lambda c: classes.select(F.col("node").alias(c), F.col("probe").alias(f"p{c}"))
    return pairs.join(side("x"), "x").join(side("y"), "y").select("x", "y", "px", "py").mapInArrow(count, "x bigint, y bigint, agree int")


def canopies(buckets: DataFrame, classes: DataFrame) -> DataFrame:
    """(center, node, agree): the canopy of every class that shares a bucket, and those that it joins besides."""
    nearest = lambda found: found.where(F.col("agree") >= TIGHT).groupBy(F.col("x").alias("node")).agg(F.min_by(F.struct(F.col("y").alias("center"), "agree"), "y").alias("own"))
    star = buckets.where("node <> pivot").select(F.col("node").alias("x"), F.col("pivot").alias("y")).distinct()
    first = written(nearest(agreement(star, classes)).select("node", "own.center"), "neardup-centers")
    # A second try, with the smallest center that a member of one of its buckets has.
    held = buckets.join(first, "node", "left").select("bucket", "node", F.coalesce("center", "node").alias("center"))
    least = held.groupBy("bucket").agg(F.min("center").alias("least"), F.max("center").alias("most")).where("least < most")
    second = held.join(least, "bucket").where("least < center and least <> node").select(F.col("node").alias("x"), F.col("least").alias("y"))
    again = agreement(second.unionByName(first.select(F.col("node").alias("x"), F.col("center").alias("y"))).distinct(), classes)
    tight = nearest(again).select("node", "own.*")
    everyone = buckets.select("node").distinct()
    own = written(everyone.join(tight, "node", "left").select(F.coalesce("center", "node").alias("center"), "node", F.coalesce("agree", F.lit(PROBE)).alias("agree")), "neardup-own")

    held = buckets.join(own.select("node", "center"), "node").select("bucket", "node", "center")
    # Of a bucket's many members with the same center, one row is left here.
    cells = held.groupBy("bucket", "center").agg(F.lit(1).alias("one"))
    mixed_ = cells.groupBy("bucket").agg(F.min("center").alias("low"), F.max("center").alias("high")).where("low < high").select(F.col("bucket").alias("mixed"), "low")
    smaller = cells.join(mixed_, F.col("bucket") == F.col("mixed")).select("bucket", F.col("center").alias("y"))
    late = held.join(mixed_, (F.col("bucket") == F.col("mixed")) & (F.col("center") > F.col("low"))).select("bucket", "node", "center")
    meeting = late.join(smaller, "bucket").where("y < center and y <> node").select(F.col("node").alias("x"), "y").distinct()
    floor = own.groupBy(F.col("center").alias("y")).agg(F.min("agree").alias("floor"))
    joined = agreement(meeting, classes).join(floor, "y").where(F.col("agree") >= F.col("floor") - SLACK).select(F.col("y").alias("center"), F.col("x").alias("node"), "agree")
    return own.unionByName(joined)


def with_set_key(rows: DataFrame, k: int) -> DataFrame:
    """Adds set_key and wordless (the set is empty) to rows with a column text."""
    at = rows.columns.index("text")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _portions(batches, at):
            sets = shingle_sets(batch.column(at).to_pylist(), k)
            keys = pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, keys, pa.array([not len(s) for s in sets], pa.bool_())], names=[*batch.schema.names, "set_key", "wordless"])

    return rows.mapInArrow(digests, T.StructType([*rows.schema.fields, T.StructField("set_key", T.BinaryType()), T.StructField("wordless", T.BooleanType())]))


def stand_in() -> Column:
    """The number, below zero, of a class without any id."""
    return -1 - F.shiftrightunsigned(F.xxhash64("set_key"), 1)


def full_sets(docs: DataFrame, needed: DataFrame, k: int) -> DataFrame:
    """(node, full): the whole shingle sets of the needed nodes, from the documents' texts."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _portions(batches):
            found = [s.tobytes() for s in shingle_sets(batch.column(1).to_pylist(), k)]
            keys = [hashlib.blake2b(s, digest_size=16).digest() for s in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(found, pa.binary())], names=["node", "set_key", "full"])

    schema = "node bigint, set_key binary, full binary"
    needed = written(needed, "neardup-needed")
    if needed.count() <= BROADCAST_NODES:
        needed = F.broadcast(needed)
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text")
    named = texts.where("node is not null").join(needed, "node", "left_semi").dropDuplicates(["node", "text"]).mapInArrow(sets, schema)
    unnamed = texts.where("node is null").mapInArrow(sets, schema).withColumn("node", stand_in()).join(needed, "node", "left_semi").dropDuplicates(["node"])
    return named.unionByName(unnamed).select("node", "full")


def verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (x, y) whose full sets reach the similarity, as links (u, v)."""

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for p, q in zip(batch.column("fx"), batch.column("fy"), strict=True):
                p, q = np.frombuffer(p.as_py(), dtype=np.uint64), np.frombuffer(q.as_py(), dtype=np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield batch.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))

    full = written(full_sets(docs, pairs.select(F.explode(F.array("x", "y")).alias("node")).distinct(), k), "neardup-sets")
    side = lambda c: full.select(F.col("node").alias(c), F.col("full").alias(f"f{c}"))
    sized = lambda c: F.octet_length(f"f{c}")
    fits = 100 * F.least(sized("x"), sized("y")) >= percent * F.greatest(sized("x"), sized("y"))
    both = pairs.join(side("x"), "x").join(side("y"), "y").where(fits)
    return both.select("x", "y", "fx", "fy").mapInArrow(linked, "x bigint, y bigint").withColumnsRenamed({"x": "u", "y": "v"})


def difference_lists(x: np.ndarray, c: np.ndarray, percent: int) -> tuple[np.ndarray, bool, int, int]:
    """Of a set and its center's: the differences, whether the two are linked, and the lengths of two prefixes of differences.

    A shingle that ``x`` has besides is its hash, one that it lacks is the
    hash's complement. For a linked pair of which one is not linked to the
    center, and of which ``x`` has the fewer (more) differences, one of any
    first ``few`` (``many``) differences of ``x`` is shared.
    """
    place = np.minimum(np.searchsorted(c, x), len(c) - 1)
    there = c[place] == x
    lacks = np.ones(len(c), dtype=bool)
    lacks[place[there]] = False
    diff = np.sort(np.concatenate([x[~there], ~c[lacks]]))
    both, far, size = int(there.sum()), len(diff), len(x)
    r, most = (100 - percent) / (100 + percent), size * 100 / percent
    # The other's differences are no fewer than this, and its size no more than both bounds.
    least_other = max(0.0, far - r * (size + most))
    share_small = far - r * (size + most) / 2
    share_large = (far + least_other - r * (size + min(most, len(c) + least_other))) / 2
    few, many = (far - max(1, math.ceil(s - 1e-6)) + 1 for s in (share_small, share_large))
    return diff, 100 * both >= percent * (size + len(c) - both), few, many


def differences(rest: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """From (center, node, outside): adds size, far (number of differences), diff, near (linked to the center), few and many."""
    names = ["center", "node", "outside", "size", "far", "near", "few", "many", "diff"]

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in range(6)]
            for fx, fc in zip(batch.column("fx"), batch.column("fc"), strict=True):
                x, c = np.frombuffer(fx.as_py(), dtype=np.uint64), np.frombuffer(fc.as_py(), dtype=np.uint64)
                diff, near, few, many = difference_lists(x, c, percent)
                for column, value in zip(columns, (len(x), len(diff), near, few, many, diff.view(np.int64)), strict=True):
                    column.append(value)
            kinds = [pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names[:3]], *[pa.array(v, t) for v, t in zip(columns, kinds, strict=True)]], names=names)

    nodes = rest.select("node").union(rest.select("center")).distinct()
    full = written(full_sets(docs, nodes, k), "neardup-sets")
    both = rest.join(full.withColumnRenamed("full", "fx"), "node").join(full.select(F.col("node").alias("center"), F.col("full").alias("fc")), "center")
    return both.select("center", "node", "outside", "fx", "fc").mapInArrow(told, "center bigint, node bigint, outside boolean, size int, far int, near boolean, few int, many int, diff array<bigint>")


def postings(diffs: DataFrame) -> DataFrame:
    """(center, token, node, outside, size, far, at, first): each member under those of its rarest differences by which it can meet another; ``at``: the difference's place among all of the member's; ``first``: of the shorter prefix."""
    tokens = diffs.where("far > 0").select("center", "node", "outside", "size", "far", "few", "many", F.xxhash64("diff").alias("which"), F.explode("diff").alias("token"))
    shared = tokens.groupBy("center", "token").agg(F.count("*").alias("n"), F.max("outside").alias("useful")).where("n > 1 and useful").drop("useful")
    # Differences by which nobody outside can be met come first in the order, and need no rows.
    own = Window.partitionBy("center", "node", "which")  # rows of one id may have different texts
    placed = tokens.join(shared, ["center", "token"]).withColumn("at", F.row_number().over(own.orderBy("n", "token"))).withColumn("at", F.col("at") + F.col("far") - F.count("*").over(own))
    return placed.where("at <= many").select("center", "token", "node", "outside", "size", "far", "at", (F.col("at") <= F.col("few")).alias("first"))


def linked_by_differences(pairs: DataFrame, diffs: DataFrame, percent: int) -> DataFrame:
    """The pairs (center, x, y) whose sets reach the similarity, as links (u, v)."""

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for p, q, n, m in zip(batch.column("dx"), batch.column("dy"), batch.column("nx").to_pylist(), batch.column("ny").to_pylist(), strict=True):
                common = len(np.intersect1d(p.values.to_numpy(), q.values.to_numpy(), assume_unique=True))
                apart = len(p) + len(q) - 2 * common
                # |x and y| = (n + m - apart) / 2, |x or y| = (n + m + apart) / 2
                keep.append(100 * (n + m - apart) >= percent * (n + m + apart))
            yield batch.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))

    side = lambda c: diffs.select("center", F.col("node").alias(c), F.col("size").alias(f"n{c}"), F.col("diff").alias(f"d{c}"))
    both = pairs.join(side("x"), ["center", "x"]).join(side("y"), ["center", "y"])
    return both.select("x", "y", "nx", "ny", "dx", "dy").mapInArrow(linked, "x bigint, y bigint").withColumnsRenamed({"x": "u", "y": "v"})


def similar_size(a: str, b: str, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def least_shared(a: str, b: str, percent: int) -> Column:
    """The number of differences that two members (names of their rows) must share to be linked, from their sizes and numbers of differences."""
    return (F.col(f"{a}.far") + F.col(f"{b}.far") - (100 - percent) / (100 + percent) * (F.col(f"{a}.size") + F.col(f"{b}.size"))) / 2 - 1e-6


def remaining_links(rest: DataFrame, docs: DataFrame, roots: DataFrame, k: int, percent: int) -> DataFrame:
    """``roots`` extended by the links inside canopies of (center, node, outside) of which one end is outside the center's component."""
    diffs = written(differences(rest, docs, k, percent), "neardup-differences")
    lists = written(postings(diffs), "neardup-postings")
    pivots = lists.groupBy("center", "token").agg(F.min_by(F.struct("node", "outside", "size", "far"), "node").alias("pivot"))
    star = (
        lists.alias("own").join(pivots, ["center", "token"])
        .where((F.col("node") != F.col("pivot.node")) & (F.col("outside") | F.col("pivot.outside")) & similar_size("own.size", "pivot.size", percent))
        .where(least_shared("own", "pivot", percent) <= F.least("own.far", "pivot.far"))
        .select("center", F.col("node").alias("x"), F.col("pivot.node").alias("y"))
        .distinct()
    )
    direct = diffs.where("near and outside").select(F.col("node").alias("u"), F.col("center").alias("v"))
    roots = extended_components(roots, written(linked_by_differences(star, diffs, percent).unionByName(direct), "neardup-links"))
    rooted = lists.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    apart = rooted.groupBy("center", "token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("center", "token")
    open_lists = written(rooted.join(apart, ["center", "token"], "left_semi"), "neardup-open")
    if open_lists.isEmpty():
        return roots
    few, many = open_lists.where("first").alias("few"), open_lists.alias("many")
    meet = (F.col("few.center") == F.col("many.center")) & (F.col("few.token") == F.col("many.token"))
    # If this is the first difference that they share, they share no more than what comes after it.
    can_share = 1 + F.least(F.col("few.far") - F.col("few.at"), F.col("many.far") - F.col("many.at"))
    pairs = (
        few.join(many, meet)
        .where((F.struct("few.far", "few.node") < F.struct("many.far", "many.node")) & (F.col("few.root") != F.col("many.root")) & (F.col("few.outside") | F.col("many.outside")) & similar_size("few.size", "many.size", percent))
        .where(can_share >= least_shared("few", "many", percent))
        .select(F.col("few.center").alias("center"), F.col("few.node").alias("x"), F.col("many.node").alias("y"))
        .distinct()
    )
    more = written(linked_by_differences(pairs, diffs, percent), "neardup-links")
    return roots if more.isEmpty() else extended_components(roots, more)


def rooted_rows(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, set_key, group (the smallest node of the row's component; null for an empty set) and component_id of every document."""
    if percent < 80:
        raise ValueError("the tables are made for similarities of 0.8 and more")
    rows = written(signatures(docs, k), "neardup-signatures")
    classes = (
        rows.where("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("least"), F.first("n_shingles").alias("n"), F.first("a").alias("a"), F.first("b").alias("b"), F.first("probe").alias("probe"))
        .withColumn("node", F.coalesce("least", stand_in()))
    )
    classes = written(classes, "neardup-classes")
    buckets = written(bucket_rows(classes), "neardup-buckets")
    members = written(canopies(buckets, classes), "neardup-canopies")
    near = members.where("node <> center").where(F.col("agree") >= PROBE - SLACK).select(F.col("node").alias("x"), F.col("center").alias("y"))
    links = written(verified(written(near, "neardup-pairs"), docs, k, percent), "neardup-links")
    roots = connected_components(links)
    rooted = members.join(roots, "node", "left").select("center", "node", F.coalesce("root", "node").alias("root"))
    flagged = rooted.join(roots.select(F.col("node").alias("center"), F.col("root").alias("main")), "center", "left").withColumn("outside", F.col("root") != F.coalesce("main", "center"))
    unsettled = flagged.groupBy("center").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("center")
    rest = written(flagged.join(unsettled, "center", "left_semi").select("center", "node", "outside").distinct(), "neardup-rest")
    if not rest.isEmpty():
        roots = written(remaining_links(rest, docs, roots, k, percent), "neardup-roots")
    named = roots.join(classes.select("node", "least"), "node").groupBy("root").agg(F.min("least").alias("component_id"))
    by_node = roots.join(named, "root").select("node", "root", "component_id")
    of_class = classes.join(by_node, "node", "left").select("set_key", F.coalesce("root", "node").alias("group"), F.coalesce("component_id", "least").alias("component_id"))
    placed = rows.select("doc_id", "n_shingles", "set_key").join(of_class, "set_key", "left")
    return placed.withColumn("component_id", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document; links are pairs whose shingle sets reach ``percent`` (80 at least)."""
    found = rooted_rows(docs, k, percent)
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents with one of each group of near duplicates left, with the columns of ``docs``.

    The document with the group's smallest id stays, of a group without ids
    any one. Where the smallest id is repeated, its rows are told apart by their
    sets of shingles, and one of each set stays. Documents without words all stay.
    """
    found = written(rooted_rows(docs, k, percent), "neardup-found")
    ids = found.groupBy("doc_id").agg(F.count("*").alias("n"), F.min((F.col("n_shingles") > 0) & ~F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("away"))
    ids = ids.where("n > 1 or doc_id is null or away").select(F.col("doc_id").alias("known_id"), (F.col("doc_id").isNull() | (F.col("n") > 1)).alias("odd"))
    ids = written(ids, "neardup-gone")
    near = F.broadcast if ids.count() <= BROADCAST_NODES else lambda df: df
    plain = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    left = plain.join(near(ids), F.col("doc_id").eqNullSafe(F.col("known_id")), "left_anti")
    odd = written(ids.where("odd"), "neardup-odd")
    if not odd.isEmpty():
        of_odd = found.join(odd, F.col("doc_id").eqNullSafe(F.col("known_id")), "left_semi")
        named = of_odd.where("n_shingles > 0 and doc_id = component_id").select("doc_id", "set_key").distinct()
        unnamed = of_odd.where("n_shingles > 0 and component_id is null").groupBy("group").agg(F.min("set_key").alias("set_key")).select(F.lit(None).cast("long").alias("doc_id"), "set_key")
        chosen = named.unionByName(unnamed).withColumnsRenamed({"doc_id": "one_id", "set_key": "one_key"})
        rows = with_set_key(plain.join(odd, F.col("doc_id").eqNullSafe(F.col("known_id")), "left_semi"), k)
        single = rows.where("not wordless").groupBy("doc_id", "set_key").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
        stay = single.join(chosen, F.col("doc_id").eqNullSafe(F.col("one_id")) & (F.col("set_key") == F.col("one_key")), "left_semi").select("row")
        stay = stay.unionByName(rows.where("wordless").select("row"))
        left = left.select("row").unionByName(stay)
    return left.select("row.*")
