"""Near duplicates against brute force over all pairs."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from facetmill.llm.components import connected_components, extended_components
from facetmill.llm.neardup import difference_lists, drop_near_duplicates, minhashes, near_duplicates, small_keys
from facetmill.llm.shingles import shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_set(text, k):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < k:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def brute_components(rows, k):
    sets = [brute_set(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    named = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            named[find(i)].append(doc)
    return sets, [min(named[find(i)], default=None) for i in range(len(rows))]


def corpus(rng, n):
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 7)))
    passage = [word() for _ in range(60)]
    texts = []
    for i in range(n):
        words = [word() for _ in range(rng.randrange(3, 160))]
        if i % 5 == 0:
            words = passage + words
        texts.append(words)
        for _ in range(rng.choice([0, 0, 1, 3])):
            copy = list(rng.choice(texts[-4:]))
            for _ in range(max(1, int(len(copy) * rng.choice([0.01, 0.03, 0.05])))):
                copy[rng.randrange(len(copy))] = word()
            texts.append(copy)
    hot = [word() for _ in range(120)]
    for _ in range(60):
        copy = list(hot)
        copy[rng.randrange(120)] = word()
        texts.append(copy)
    return [rng.choice([" ", "\n", "  "]).join(w) for w in texts]


@pytest.mark.parametrize("k", [2, 5])
def test_equals_brute_force(spark, k):
    rng = random.Random(k)
    rows = list(enumerate(corpus(rng, 150)))
    rng.shuffle(rows)
    rows += [(9000, None), (9001, ""), (9002, " \t\n"), (9003, "One"), (9004, "oNE "), (9005, "one two"), (9006, "ONE\ttwo"), (9007, "É two"), (9008, "é two"), (None, "unnamed text"), (None, "unnamed  text"), (9009, "same row"), (9009, "same row"), (9010, "w " * 20000), (9011, "w " * 19000), (None, "one two")]
    docs = spark.createDataFrame([(i, t, 3, 4, True) for i, t in rows], "doc_id long, text string, n int, node int, kept boolean")
    sets, component = brute_components(rows, k)
    got = near_duplicates(docs, k).collect()
    show = lambda x: sorted(map(repr, x))
    assert show((r.doc_id, r.n_shingles, r.component_id) for r in got) == show((i, len(s), c if s else i) for (i, _), s, c in zip(rows, sets, component, strict=True))
    assert all(r.kept == (r.doc_id is not None and r.doc_id == r.component_id) for r in got)
    left = drop_near_duplicates(docs, k)
    assert left.columns == docs.columns
    want = sorted({i for (i, _), s, c in zip(rows, sets, component, strict=True) if i is not None and (c == i or not s)})
    assert sorted(r.doc_id for r in left.collect() if r.doc_id is not None) == want


def test_large_canopy(spark):
    """Copies of one text that are near to it, but hardly to each other, with and without the text itself."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(150)]
    rows = []
    for i in range(150):
        copy = list(base)
        for _ in range(rng.randrange(3, 9)):
            copy[rng.randrange(150)] = word()
        rows.append((i, " ".join(copy)))
    rows.append((400, " ".join(base)))
    sets, component = brute_components(rows[:-1], 2)
    assert 1 < len(set(component)) < 150
    for part in (rows[:-1], rows):
        sets, component = brute_components(part, 2)
        got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(part, "doc_id long, text string"), 2).collect()}
        assert got == {i: c for (i, _), c in zip(part, component, strict=True)}


def template_copies(rng, n, share=0.18):
    """Texts of 120 words that share all but ``share`` of them."""
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    base = [word() for _ in range(120)]
    at = range(int(120 * (1 - share)), 120)
    return [" ".join(word() if j in at else w for j, w in enumerate(base)) for _ in range(n)]


def test_unlinked_copies_do_not_meet_in_pairs(spark):
    """5,000 texts at a similarity of about 0.7: candidates grow in proportion."""
    import facetmill.llm.neardup as nd

    rows = list(enumerate(template_copies(random.Random(3), 5000)))
    sets = [brute_set(t, 2) for _, t in rows[:40]]
    assert all(0.6 < len(a & b) / len(a | b) < 0.8 for a in sets for b in sets if a is not b)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    rest = docs.where("doc_id > 0").select(nd.F.lit(0).cast("long").alias("center"), nd.F.col("doc_id").alias("node"), nd.F.lit(True).alias("outside"))
    diffs = nd.differences(rest, docs, 2, 80).persist()
    assert diffs.where("near").count() == 0
    assert nd.postings(diffs).where("first").count() < 5 * len(rows)
    diffs.unpersist()
    got = near_duplicates(docs, 2).collect()
    assert all(r.component_id == r.doc_id for r in got) and len(got) == len(rows)


def test_clusters_of_unlinked_canopies(spark):
    """Groups of near copies whose originals are near to each other, but not linked."""
    rng = random.Random(12)
    rows = []
    for text in template_copies(rng, 12, 0.2):
        for _ in range(rng.randrange(1, 25)):
            words = text.split(" ")
            words[rng.randrange(120)] = "changed" + str(rng.randrange(9))
            rows.append(" ".join(words))
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    sets, component = brute_components(rows, 2)
    assert len(set(component)) > 5
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    assert got == {i: c for (i, _), c in zip(rows, component, strict=True)}


def test_hot_keys_give_the_same_buckets(spark, monkeypatch):
    import facetmill.llm.neardup as nd

    rows = [r for r in enumerate(corpus(random.Random(6), 60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    classes = nd.signatures(docs, 2).withColumnRenamed("doc_id", "node").persist()
    whole = sorted(nd.bucket_rows(classes).collect())
    monkeypatch.setattr(nd, "HOT_ROWS", 3)
    assert sorted(nd.bucket_rows(classes).collect()) == whole


def test_prefixes_of_differences_never_miss_a_link():
    """Any order of the differences: a linked pair of which one is not linked to the center shares one of the prefixes."""
    rng, linked = np.random.default_rng(4), 0
    universe = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    for _ in range(3000):
        c = np.unique(universe[rng.integers(0, 4000, rng.integers(5, 120))])
        change = lambda base, keep: np.unique(np.concatenate([base[rng.random(len(base)) < keep], universe[rng.integers(0, 4000, rng.integers(0, 1 + int(len(base) * (1.05 - keep) * rng.random() * 2)))]]))  # noqa: B023, E731
        x = change(c, rng.uniform(0.55, 1))
        y = change(x, rng.uniform(0.85, 1))
        if not len(x) or not len(y):
            continue
        both = len(np.intersect1d(x, y))
        (dx, near_x, few_x, many_x), (dy, near_y, few_y, many_y) = difference_lists(x, c, 80), difference_lists(y, c, 80)
        both_c = len(np.intersect1d(x, c))
        assert near_x == (100 * both_c >= 80 * (len(x) + len(c) - both_c))
        apart = len(dx) + len(dy) - 2 * len(np.intersect1d(dx, dy))
        assert apart == len(x) + len(y) - 2 * both
        if 100 * both < 80 * (len(x) + len(y) - both) or near_x and near_y:
            continue
        linked += 1
        order = {int(t): rng.random() for t in np.concatenate([dx, dy])}
        prefix = lambda d, n: set(sorted(map(int, d), key=order.get)[: max(0, n)])  # noqa: B023, E731
        small, large = ((dx, few_x), (dy, many_y)) if len(dx) <= len(dy) else ((dy, few_y), (dx, many_x))
        assert prefix(*small) & prefix(*large)
        if len(dx) == len(dy):
            assert prefix(dy, few_y) & prefix(dx, many_x)
    assert linked > 200


def test_one_row_of_each_group_stays_whatever_its_id(spark):
    """Repeated and missing ids: rows are told apart by their text too."""
    a, b, c = "alpha beta gamma delta eps", "one two three four five", "red green blue black white"
    rows = [(5, a, 1), (5, b, 2), (3, b, 3), (None, c, 4), (None, c, 5), (None, c + " !", 6), (None, a, 7), (7, "", 8), (7, "", 9), (None, None, 10), (8, "same id", 11), (8, "same id", 11), (9, "x y z", 12), (9, "u v w", 13)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row long")
    left = sorted(r.row for r in drop_near_duplicates(docs).collect())
    assert [x for x in left if x not in (4, 5)] == [1, 3, 6, 8, 9, 10, 11, 12, 13] and sum(x in (4, 5) for x in left) == 1


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(docs).count() == 0
    assert drop_near_duplicates(docs).count() == 0


def test_shingle_sets_tell_the_same_texts_apart():
    rng = random.Random(9)
    texts = [t or "" for t in corpus(rng, 40)] + ["", " ", "a", "a b", "A  B", "a b c", "b c a", "ab c", "a bc"]
    for k in (1, 2, 5):
        want = [brute_set(t, k) for t in texts]
        got = shingle_sets(texts, k)
        seen = {}
        for w, g in zip(want, got, strict=True):
            assert len(w) == len(g) and (np.diff(g.astype(object)) > 0).all()
            assert seen.setdefault(w, g.tobytes()) == g.tobytes()
        assert len(set(seen.values())) == len(seen)


def test_tables_find_pairs_at_the_least_similarity():
    rng, found = np.random.default_rng(0), 0
    for _ in range(400):
        base = rng.integers(0, 2**63, 360, dtype=np.uint64)
        x, y = base[:324], base[36:]  # 288 of 360: exactly 0.8
        (a, b), (c, d) = (small_keys(minhashes(np.sort(s))[None]) for s in (x, y))
        found += bool((a == c).any() and (b == d).any())
    assert found >= 399


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(0, 300)] + [(1000 + i, 1000) for i in range(200)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)] + [(5, 5)]
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in links:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: find(i) for i in root}
    half = len(links) // 2
    first = connected_components(spark.createDataFrame(links[:half], "u long, v long"))
    assert {r.node: r.root for r in extended_components(first, spark.createDataFrame(links[half:], "u long, v long")).collect()} == got
