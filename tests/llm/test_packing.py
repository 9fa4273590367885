"""Packing against the tokenizer itself, and differencing against brute force."""

import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from facetmill.llm.common import table
from facetmill.llm.packing import combined_checksum, cut_to_fit, differencing, encode, grain_checksums, pack_documents, pack_group

TOKENIZER = "byte_bpe_50k.json"
TEXTS = ["", None, "Hello world", "hello  hello\n\tagain's 123 4567", "straße ÀÉ 東京 \U0001f600!!", "<|endoftext|> in text<|endoftext|>", "word " * 9000, "x" * 5000, "a\u0301\u00ad\u00a0b", " ", "\x00\x7f"]


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(TOKENIZER))


def test_same_ids(reference):
    rng = random.Random(1)
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice("abc déß 東'\n1!<|") for _ in range(200)) for _ in range(200)]
    for text in texts:
        assert encode(text, TOKENIZER).tolist() == [*reference.encode(text, add_special_tokens=False).ids, 1]


def test_same_ids_on_the_whole_table(spark, reference):
    for row in table(spark, "/root/testdata/sf0.01", "documents").select("text").toLocalIterator():
        assert encode(row.text or "", TOKENIZER)[:-1].tolist() == reference.encode(row.text or "", add_special_tokens=False).ids


LONG = [" " * 2_000_000 + "x", "a" + "\t" * 2_000_000, "\n" * 2_000_000 + " b", " \n\r\t" * 500_000 + "x", "\u00a0" * 1_000_000 + "x", "abcdefghij" * 100_000, "q" * 3_000_000, "x " * 300_000, "!" * 500_000 + " " * 99_999 + "y", "a" + " " * 100_000 + "b <|endoftext|>"]


@pytest.mark.parametrize("i", range(len(LONG)))
def test_same_ids_on_long_runs(reference, i):
    assert encode(LONG[i], TOKENIZER)[:-1].tolist() == reference.encode(LONG[i], add_special_tokens=False).ids


def test_long_runs_are_packed(spark, reference):
    rows = [(i, LONG[i]) for i in (0, 1, 2, 9)] + [(100, "short")]
    got = defaultdict(int)
    for r in pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), TOKENIZER).collect():
        got[r.doc_id] += r.length
    assert got == {i: 1 + len(reference.encode(t, add_special_tokens=False).ids) for i, t in rows}


def test_checksums_of_pieces():
    ids = np.random.default_rng(3).integers(0, 50_000, 1111).astype("<u4")
    grains = grain_checksums(ids)
    for start, end in ((0, 1111), (0, 32), (32, 64), (0, 1088), (1088, 1111), (96, 1111), (512, 512)):
        assert combined_checksum(grains, start, end) == zlib.crc32(ids[start:end].tobytes())


def test_every_id_lies_in_one_piece(spark, reference):
    rows = [(i, t, 7) for i, t in enumerate(TEXTS * 30)] + [(None, "no id", 1), (3, "again", 1), (3, "again", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int")
    got = pack_documents(docs, TOKENIZER).collect()
    want = defaultdict(list)
    for i, t, _ in rows:
        want[i].append([*reference.encode(t or "", add_special_tokens=False).ids, 1])
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
        windows[r.sequence_id].append((r.offset, r.length))
    for i, all_ids in want.items():
        # Each piece is one of a document with this id, with the right checksum, and together they have every place as often as there are documents.
        places = Counter()
        for start, length, crc, doc_tokens in pieces[i]:
            assert any(len(ids) == doc_tokens and crc == zlib.crc32(np.array(ids[start : start + length], dtype="<u4").tobytes()) for ids in all_ids)
            places.update((doc_tokens, at) for at in range(start, start + length))
        assert places == Counter((len(ids), at) for ids in all_ids for at in range(len(ids)))
    total = 0
    for w in windows.values():
        at = 0
        for offset, length in sorted(w):
            assert offset == at
            at += length
        assert at <= 2048
        total += at
    assert total / (2048 * len(windows)) > 0.95


def test_empty_table(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string"), TOKENIZER).count() == 0


def brute_differencing(sizes, k):
    """The textbook form: k-tuples with zeros."""
    partial = [sorted([s] + [0] * (k - 1), reverse=True) for s in sizes]
    while len(partial) > 1:
        partial.sort(key=lambda p: p[0] - p[-1], reverse=True)
        a, b, *rest = partial
        partial = [*rest, sorted((x + y for x, y in zip(a, reversed(b), strict=True)), reverse=True)]
    return partial[0]


def test_differencing_equals_the_textbook_form():
    rng = random.Random(5)
    for n, k in itertools.product((1, 2, 5, 8, 13), (1, 2, 3, 5)):
        sizes = rng.sample(range(1, 5000), n)
        got = differencing(sizes, k)
        assert sorted(i for w in got for i in w) == list(range(n))
        loads = sorted((sum(sizes[i] for i in w) for w in got), reverse=True)
        assert loads + [0] * (k - len(loads)) == brute_differencing(sizes, k)


def test_windows_rise_until_all_fit_or_cuts_are_due():
    rng = random.Random(2)
    for trial in range(40):
        sizes = [rng.randrange(1, 2048) if trial % 2 else rng.randrange(1100, 2048) for _ in range(rng.randrange(1, 80))]
        windows = pack_group(sizes)
        check_pieces(sizes, windows)
        assert len(windows) <= max(2, 1.06 * sum(sizes) / 2048 + 2)


def check_pieces(sizes, windows):
    for i, size in enumerate(sizes):
        at = 0
        for start, end in sorted((s, e) for w in windows for j, s, e in w if j == i):
            assert start == at and end > start and (end % 32 == 0 or end == size)
            at = end
        assert at == size
    assert max(sum(e - s for _, s, e in w) for w in windows) <= 2048


def test_cuts_fit():
    sizes = [1500] * 9 + [2000, 700, 31, 5]
    check_pieces(sizes, cut_to_fit([[(i, 0, s) for i, s in enumerate(sizes)], []]))


def test_short_documents_are_rarely_cut(spark):
    got = pack_documents(table(spark, "/root/testdata/sf0.01", "documents"), TOKENIZER).collect()
    windows, tokens = defaultdict(set), {}
    for r in got:
        windows[r.doc_id].add(r.sequence_id)
        tokens[r.doc_id] = r.doc_tokens
    short = [len(w) for i, w in windows.items() if tokens[i] <= 2048]
    assert sum(short) / len(short) < 1.1
    assert sum(r.length for r in got) / (2048 * len({r.sequence_id for r in got})) > 0.98
