"""The quality classifier: voting against brute force, held-out accuracy, odd rows."""

import random
import zlib

import numpy as np
import pytest

from facetmill.llm.common import table
from facetmill.llm.quality import NEIGHBOURS, classify_quality, fit_vectors, keep_quality, term_vector
from facetmill.llm.shingles import parts_at_spaces, word_hashes

SF = "/root/testdata/sf0.01"


def test_votes_equal_brute_force():
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdef ,.") if i % 3 else rng.choice("#$%ABC") for _ in range(300)) for i in range(120)]
    terms = np.stack([term_vector(t) for t in texts])
    labels = np.array([int(i % 3 > 0) for i in range(120)])
    model = fit_vectors(terms[:90], labels[:90])
    got = model.score(terms[90:])
    z, known = model.project(terms[90:]), model.project(terms[:90])
    for i in range(30):
        sims = sorted(((float(z[i] @ v), int(y)) for v, y in zip(known, labels, strict=False)), reverse=True)[:NEIGHBOURS]
        votes = [(max(s, 0.0), y) for s, y in sims]
        assert got[i] == pytest.approx(sum(w * y for w, y in votes) / sum(w for w, _ in votes), abs=1e-3)


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in classify_quality(table(spark, SF, "documents"), table(spark, SF, "labels")).collect()}
    assert len(got) == table(spark, SF, "documents").count()
    right = total = 0
    for r in table(spark, SF, "labels").collect():
        x = got[r.doc_id]
        assert x.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3)
        if x.held_out:
            total += 1
            right += x.predicted == r.quality
    assert right / total > 0.95


def test_labels_of_held_out_rows_are_not_learned(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    flipped = labels.selectExpr("doc_id", "case when pmod(crc32(cast(cast(doc_id as string) as binary)), 5) = 0 then 1 - quality else quality end as quality")
    assert sorted(classify_quality(docs, labels).collect()) == sorted(classify_quality(docs, flipped).collect())


def test_all_labels_are_learned_from_in_a_large_table_of_labels(spark, monkeypatch):
    """Labels of other documents do not thin the sample."""
    import facetmill.llm.quality as quality

    docs = spark.createDataFrame([(i, f"text number {i} of the table") for i in range(300)], "doc_id long, text string")
    labels = spark.range(300_000).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    seen = []
    monkeypatch.setattr(quality, "fit_vectors", lambda terms, marks: seen.append(len(marks)))
    quality.fit_quality(docs, labels, max_labelled=1000)
    assert seen == [sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(300))]


def test_parts_of_a_long_text_give_its_words():
    words = [f"w{i % 977}" for i in range(50_000)]
    raw = " ".join(words).encode()
    assert b"".join(parts_at_spaces(raw, 1000)) == raw
    whole, parts = word_hashes(raw), np.concatenate([word_hashes(p) for p in parts_at_spaces(raw, 1000)])
    assert (whole == parts).all() and len(set(whole.tolist())) == 977
    assert np.isfinite(term_vector("x" * 3_000_000)).all() and np.isfinite(term_vector("a b " * 700_000)).all()


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (3, "good words here", 0.1), (3, "good words here", 0.1), (None, "good words here", 0.2), (4, "#### $$$$ %%%%" * 9000, 0.2)], "doc_id long, text string, quality_score double")
    labels = spark.createDataFrame([(3, 1), (4, 0), (4, None), (None, 0), (9, 7)], "doc_id long, quality int")
    got = classify_quality(docs, labels).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    assert len({r.score for r in got if r.doc_id == 3}) == 1
    assert keep_quality(docs, labels).columns == docs.columns
    assert classify_quality(docs.limit(0), labels).count() == 0
    assert {r.score for r in classify_quality(docs, labels.limit(0)).collect()} == {1.0}
