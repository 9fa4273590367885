"""Sharding, mixing and fingerprints against brute force on small tables."""

import hashlib
import random
import re
import unicodedata
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from facetmill.llm.fingerprints import fingerprint_documents, fingerprint_edits
from facetmill.llm.mixing import mix_sources, repeat_documents
from facetmill.llm.sharding import minimax_cuts, shard_documents

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, bucket string, digest string, shard int"


def docs_table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None, 1, "x", "d", 7) for i, t, s in rows], SCHEMA)


ROWS = [
    (5, "one two  three", "b"), (9, "One two three ", "b"), (1, None, "a"), (2, "", None), (7, "x" * 5000, "c"), (None, "null id", "a"),
    (11, "ﬁne straße", "a"), (12, "FINE STRASSE", "a"), (20, "w " * 3000, "c"), (21, "one two  three", "b"), (30, "été z", None), (31, "été z", "b"), (33, "\U0001f600 smile", "c"), (34, " tab\tnew\nline", "c"),
]
ROWS += [(100 + i, f"word{i} " * (i % 17 + 1), "abc"[i % 3]) for i in range(150)]
ROWS += [(300 + i, "copy of the hot text", "a") for i in range(120)]


def fold(text):
    nfkc = lambda s: unicodedata.normalize("NFKC", s)
    return re.sub(r"\s+", " ", nfkc(nfkc(text).casefold())).strip(" ")


def wide(text):
    def chained(seed):  # Spark hashes the seed as a 4-byte integer first, and its hash seeds the text's
        first = xxhash.xxh64_intdigest(seed.to_bytes(4, "little"), seed=42)
        return xxhash.xxh64_hexdigest(text.encode(), seed=first)

    return chained(1) + chained(2)


def test_fingerprints_equal_brute_force(spark):
    got = {r.doc_id: r for r in fingerprint_edits(docs_table(spark, ROWS)).collect()}
    ordered = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))
    assert len(got) == len(ROWS)
    for (i, t, _), (_, n, _) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        t, n = t or "", n or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + n[:half]
        r = got[i]
        assert r.n_chars == len(t)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == wide(fold(t))
        assert r.edited_fingerprint == wide(fold(edited))
        assert r.near_edited == float(fold(t) == fold(edited))
        assert r.near_next == float(fold(t) == fold(n))
    assert got[5].fingerprint == got[9].fingerprint == got[21].fingerprint
    assert got[11].fingerprint == got[12].fingerprint and got[30].fingerprint == got[31].fingerprint


@pytest.mark.parametrize("rows", [[], [(1, "alone here", "a")], [(None, None, None)], [(3, "same", "a"), (3, "same", "a")]])
def test_small_tables(spark, rows):
    docs = docs_table(spark, rows)
    assert fingerprint_edits(docs).count() == len(rows)
    assert fingerprint_documents(docs).count() == len(rows)
    assert shard_documents(docs).count() == len(rows)
    assert mix_sources(docs).count() == len(rows)


def test_colliding_digests_are_told_apart(spark, monkeypatch):
    import facetmill.llm.fingerprints as fp

    monkeypatch.setattr(fp, "digest", lambda canon: F.when(canon.startswith("w"), "same").otherwise(F.sha2(canon, 256)))
    got = {r.doc_id: r.fingerprint for r in fp.fingerprint_documents(docs_table(spark, [(1, "wa", "s"), (2, "wb", "s"), (3, "WA ", "s"), (4, "c", "s")])).collect()}
    assert got[1] == got[3] != got[2] and got[4] == hashlib.sha256(b"c").hexdigest()


def test_sharding(spark):
    got = shard_documents(docs_table(spark, ROWS), shards=16).collect()
    texts = {i: t or "" for i, t, _ in ROWS}
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((i is None, i or 0) for i, _, _ in ROWS)
    slots, shard_of, sizes = defaultdict(list), defaultdict(set), defaultdict(int)
    for r in got:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
        slots[r.shard].append(r.slot)
        shard_of[raw].add(r.shard)
        sizes[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in shard_of.values())
    assert set(slots) <= set(range(16))


def test_minimax_is_optimal():
    rng = random.Random(3)
    for _ in range(60):
        sizes = [rng.choice([0, 1, 5, rng.randrange(100)]) for _ in range(rng.randrange(1, 12))]
        k = rng.randrange(1, 6)
        cuts = minimax_cuts(np.array(sizes), k)
        loads = [sum(sizes[a:b]) for a, b in zip([0, *cuts], [*cuts, len(sizes)], strict=True)]
        best = [[0] + [10**9] * len(sizes)]
        for _ in range(k):
            best.append([min(max(best[-1][j], sum(sizes[j:i])) for j in range(i + 1)) for i in range(len(sizes) + 1)])
        assert len(loads) == k and max(loads) == best[k][-1] and cuts == sorted(cuts)
    even = minimax_cuts(np.array([7] * 1000 + [9] * 600), 16)
    loads = [sum(([7] * 1000 + [9] * 600)[a:b]) for a, b in zip([0, *even], [*even, 1600], strict=True)]
    assert max(loads) - min(loads) <= 9


def brute_targets(sizes, weights, ratio, epochs):
    caps = {s: epochs * n for s, n in sizes.items()}
    left, open_ = ratio * sum(sizes.values()), set(sizes)
    target = {}
    while open_:
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > caps[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = caps[s]
        left, open_ = ratio * sum(sizes.values()) - sum(target.values()), open_ - over
    return target


def test_mixing(spark):
    docs = docs_table(spark, ROWS)
    got = mix_sources(docs).collect()
    assert sorted(map(str, got)) == sorted(map(str, mix_sources(docs.repartition(3)).collect()))
    count = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in ROWS}
    sizes = defaultdict(int)
    for i, _, s in ROWS:
        sizes[s] += count[i]
    weights = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    want = brute_targets(sizes, weights, 1.5, 2.0)
    source, taken = {i: s for i, _, s in ROWS}, defaultdict(int)
    for r in got:
        s = source[r.doc_id]
        assert (r.size, r.source_size, r.source) == (count[r.doc_id], sizes[s], s)
        assert r.target == pytest.approx(want[s])
        assert 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    for s, t in taken.items():
        most = max(r.copies for r in got if r.source == s)
        left = [r.size for r in got if r.source == s and r.copies < most]
        assert 0 <= want[s] - t < min([x for x in left if x], default=1)  # no document that was left still fits
    copies = {r.doc_id: r.copies for r in got}
    repeated = repeat_documents(docs)
    assert repeated.columns == docs.columns
    assert {r.doc_id: r["count"] for r in repeated.groupBy("doc_id").count().collect()} == {i: c for i, c in copies.items() if c}


@pytest.mark.parametrize("rows_per_round", [1, 16_384])
def test_mixing_tries_the_documents_behind_a_giant_one(spark, monkeypatch, rows_per_round):
    import facetmill.llm.mixing as mixing

    monkeypatch.setattr(mixing, "ROWS_PER_BUCKET", 16)
    monkeypatch.setattr(mixing, "EDGE_ROWS", rows_per_round, raising=False)
    sizes = {i: 20 + i % 23 for i in range(400)} | {1000: 9000, 1001: 0}
    docs = docs_table(spark, [(i, "w " * n, "s") for i, n in sizes.items()] + [(2000 + i, "w " * 5, None) for i in range(40)])
    for seed in range(2):  # the giant is in another bucket each time
        rows = mix_sources(docs, weights=(1, 1), budget_ratio=0.6, seed=seed).collect()
        keys = {r.doc_id: r.k for r in docs.select("doc_id", mixing.keyed(docs, seed)[1].alias("k")).collect()}
        for source in ("s", None):
            own = [r for r in rows if r.source == source]
            n_buckets = -(-len(own) // 16)
            room, want = own[0].target - own[0].source_size * (own[0].target // own[0].source_size), {}
            for r in sorted(own, key=lambda r: (keys[r.doc_id] % n_buckets, keys[r.doc_id])):
                want[r.doc_id] = r.size <= room
                room -= r.size * want[r.doc_id]
            whole = int(own[0].target // own[0].source_size)
            assert {r.doc_id: r.copies - whole for r in own} == want
            assert room < min([r.size for r in own if not want[r.doc_id]], default=float("inf"))
