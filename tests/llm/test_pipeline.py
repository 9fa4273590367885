"""The pipeline's stages, each against the stage before it."""

from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from facetmill.llm.common import scratch, table, written
from facetmill.llm.mixing import mix_sources
from facetmill.llm.neardup import near_duplicates
from facetmill.llm.quality import classify_quality

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        out.append((docs, stage(spark, docs, SF)))
        docs = written(out[-1][1], name)
    return out


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "mixing", "packing"]


def test_quality(spark, stages):
    docs, kept = stages[0]
    good = {r.doc_id for r in classify_quality(docs, table(spark, SF, "labels")).collect() if r.predicted}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == good
    assert good >= {r.doc_id for r in table(spark, SF, "labels").where("quality = 1").collect()}


def test_near_duplicates(stages):
    docs, kept = stages[1]
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in near_duplicates(docs, 5).collect() if r.kept or r.n_shingles == 0)


def test_mixing(stages):
    docs, mixed = stages[2]
    assert mixed.columns == docs.columns
    want = {r.doc_id: r.copies for r in mix_sources(docs).collect() if r.copies}
    assert Counter(r.doc_id for r in mixed.collect()) == want


def test_packing(spark, stages):
    docs, packed = stages[3]
    tokens, windows = defaultdict(int), defaultdict(int)
    for r in packed.collect():
        tokens[r.doc_id] += r.length
        windows[r.sequence_id] += r.length
    copies = Counter(r.doc_id for r in docs.collect())
    assert set(tokens) == set(copies)
    per_doc = {r.doc_id: r.doc_tokens for r in packed.collect()}
    assert all(tokens[i] == n * per_doc[i] for i, n in copies.items())
    assert max(windows.values()) <= 2048
    assert corpus_pipeline.run(spark, SF).count() > 0


def tables(spark, folder, docs, labels=((1, 1, 0), (2, 0, 0), (None, 1, 0))):
    """Tables in a folder, with columns whose names the stages use themselves."""
    extra = "quality_score double, row string, source_right string, copies int, node long, deal long"
    rows = [(i, t, "en", s, None, 0.5, "r", "s", 3, 4, 5) for i, t, s in docs]
    spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {extra}").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return f"file://{folder}"


GOOD = "The committee met on Tuesday to discuss the budget for the coming year and its likely costs. "


@pytest.mark.parametrize(
    "docs",
    [
        [],
        [(None, None, None)],
        [(1, "", "a"), (2, None, "a")],
        [(1, GOOD, "a"), (2, "#### $$$$ %%%%" * 40, "a"), (3, GOOD, None), (3, GOOD, None), (None, GOOD, "b"), (None, GOOD, "b"), (7, None, "a"), (8, "", "c"), (9, "x " * 60_000, "c")] + [(20 + i, f"{GOOD}Item {i} of {i * 7} was put off. " * (i % 4 + 1), "ab"[i % 2]) for i in range(40)],
    ],
)
def test_odd_tables(spark, tmp_path, docs):
    """Nulls, empty and long texts, repeated rows, empty tables and clashing columns go through all stages."""
    folder = tables(spark, tmp_path, docs)
    seen = table(spark, folder, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = written(stage(spark, seen, folder), name)
        assert out.columns == seen.columns
        assert {(r.doc_id, r.text) for r in out.collect()} <= {(r.doc_id, r.text) for r in seen.collect()}
        seen = out
    packed = corpus_pipeline.run(spark, folder).collect()
    assert Counter(r.doc_id for r in packed if r.start == 0) == Counter(r.doc_id for r in seen.collect())


def test_scratch_keeps_only_what_it_is_told(spark):
    with scratch(spark) as keep:
        other = written(spark.range(5), "other")
        kept = keep(other.where("id > 1"), "kept")
        assert other.count() == 5
    assert kept.count() == 3
    with pytest.raises(Exception, match="exist|EXIST"):
        other.count()
