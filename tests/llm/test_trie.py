"""The prefix trie against plain dictionaries of beginnings."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from facetmill.llm.queries import conversation_trie
from facetmill.llm.trie import shared_turns

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "conv_id long, turn long, role string, text string, depth int, keys string, n int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, key, (role, text)))
    own = {c: [t[-1] for t in sorted(v)] for c, v in own.items()}
    sign = lambda c: -1 if c < 0 else 1
    base = lambda c: c - sign(c) * (abs(c) % 20)
    convs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        convs[c] = tuple(own.get(base(c), [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = defaultdict(set)
    for p in members:
        if p:
            children[p[:-1]].add(p)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p in sorted(members, key=len, reverse=True):
        leaves[p] += not children[p]
        saved[p] += (len(members[p]) - 1) * (len(WORD.findall(p[-1][1])) if p else 0)
        if p:
            leaves[p[:-1]] += leaves[p]
            saved[p[:-1]] += saved[p]
    ends = lambda p: hashlib.sha256(",".join(map(str, sorted(c for c in members[p] if len(convs[c]) == len(p)))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], ends(p)) for p, m in members.items())


def run(spark, rows, block_rows=4096):
    data = spark.createDataFrame([(*r, 1, "k", 2) for r in rows], SCHEMA)
    got = conversation_trie(data, block_rows).select(*COLUMNS)
    assert all(t == "bigint" for c, t in got.dtypes if c != "ends_sha256")
    return sorted(map(tuple, got.collect()))


def made(rng, n, alphabet, longest):
    rows = []
    for c in range(n):
        for t in range(rng.randrange(1, longest)):
            rows.append((c * rng.choice([1, 1, 1, 7]), t, rng.choice(["user", "assistant", None]) if rng.random() < 0.1 else "user", rng.choice(alphabet)))
    return rows


@pytest.mark.parametrize(("seed", "alphabet", "longest", "block_rows"), [(1, ["a b", "c"], 8, 10), (2, ["x y z"], 12, 7), (3, ["a", "b", None, "", "c d"], 5, 50), (4, ["a b", "c"], 9, 4096)])
def test_equals_brute_force(spark, seed, alphabet, longest, block_rows):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        rows = made(random.Random(seed), 160, alphabet, longest)
        rows += [(-3, 0, "user", "a b"), (-3, 1, "user", "a b"), (None, 0, "user", "none"), (7, None, "user", "a b"), (7, None, "user", "c"), (7, 0, "user", "c"), (7, 0, "user", "c"), (1_000_019, 0, None, None)]
        assert run(spark, rows, block_rows) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_hot_conversation_over_many_blocks(spark):
    """One conversation with hundreds of copies, which also end inside longer ones."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    try:
        rows = [(c * 20, t, "user", f"turn {t}") for c in range(300) for t in range(2 + (c % 5 == 0) * 3)]
        rows += [(c * 20, t, "user", f"other {min(c, 320)} {t}") for c in range(300, 340) for t in range(c % 7 + 1)]
        assert run(spark, rows, 5) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("rows", [[], [(None, 1, "user", "x")], [(5, 0, "user", "only")], [(1, 0, "u", "x"), (2, 0, "u", "x"), (3, 0, "u", "y")], [(4, t, "user", "long " * 400) for t in range(600)]])
def test_small_tables(spark, rows):
    assert run(spark, rows) == brute(rows)


def test_shared_turns():
    rng = random.Random(1)
    for _ in range(500):
        a = [rng.randrange(2) for _ in range(rng.randrange(0, 40))]
        b = a[: rng.randrange(0, len(a) + 1)] + [rng.randrange(3) for _ in range(rng.randrange(0, 5))]
        raw = lambda x: b"".join(bytes([v] * 16) for v in x)
        want = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert shared_turns(raw(a), raw(b)) == want
