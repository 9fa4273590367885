"""Packing documents into windows by Karmarkar-Karp multiway differencing.

A document's ids are cut where the window is full; what is left at its end is
an item. Full windows stand alone. Items are dealt out evenly by hash, whatever
document they come from, and packed in groups: partial partitions with the
largest differences are merged first, the fullest window of the one with the
emptiest of the other, so imbalances cancel. The number of windows starts at
the least that could hold the group and rises while any window exceeds the
capacity, as long as no more than ``SLACK`` of the windows is padding; what is
too much for a window then is cut off an item of it and put where there is room.

Checksums are taken while a document is tokenised, so ids are made once and
never shuffled: an item carries the checksums of its grains of ``GRAIN`` ids, of
which that of any piece between grains is combined. The pieces are written
before they are dealt out, so a task that runs again deals as before. A group is
a bounded number of items, so neither a very long document nor a large group of
copies meets in one task.

Defined results: a null or empty text is the end mark alone; repeated rows are
packed each for itself; an empty table gives an empty result. Columns besides
doc_id and text are not looked at.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import shuffle_partitions, written

CAPACITY, END = 2048, 1
#: Items are cut at multiples of so many ids.
GRAIN = 32
#: Share of padding up to which the number of windows rises before items are cut.
SLACK = 0.02
GROUP = 512
#: Texts with so many white-space characters in a row are read by another library.
LONG_SPACE = 100_000
#: Rows of a task in packing: a partition has about this many documents while there are partitions enough.
DOCS_PER_TASK = 16_384


@functools.lru_cache(maxsize=2)
def encoder(tokenizer: str):
    """A byte-pair encoder with the vocabulary and special tokens of a byte-level tokenizers file."""
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(tokenizer) if "/" not in tokenizer else tokenizer, encoding="utf-8") as f:
        data = json.load(f)
    # The printable characters that stand for bytes in such files: most bytes for themselves, the others from 256 on.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    special = {x["content"]: x["id"] for x in data["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in data["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding(tokenizer, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special), tuple(special)


@functools.lru_cache(maxsize=2)
def reference_encoder(tokenizer: str):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(tokenizer) if "/" not in tokenizer else tokenizer)


def encode(text: str, tokenizer: str) -> np.ndarray:
    """The ids and the end mark. The faster library's pattern overflows at very long white space; the other one, with the same ids, reads texts that have it."""
    if len(text) >= LONG_SPACE and re.search(rf"\s{{{LONG_SPACE}}}", text):
        return np.array([*reference_encoder(tokenizer).encode(text, add_special_tokens=False).ids, END], dtype="<u4")
    own, special = encoder(tokenizer)
    ids = own.encode(text, allowed_special="all") if any(s in text for s in special) else own.encode_ordinary(text)
    return np.array([*ids, END], dtype="<u4")


def grain_checksums(ids: np.ndarray) -> bytes:
    """CRC-32 of every grain, as unsigned 32-bit numbers."""
    raw = ids.tobytes()
    return np.array([zlib.crc32(raw[at : at + 4 * GRAIN]) for at in range(0, len(raw), 4 * GRAIN)], dtype="<u4").tobytes()


def combined_checksum(grains: bytes, start: int, end: int) -> int:
    """CRC-32 of an item's ids from ``start`` (a multiple of GRAIN) to ``end`` (another, or the item's end)."""
    crc = 0
    for at, grain in zip(range(start, end, GRAIN), np.frombuffer(grains, dtype="<u4")[start // GRAIN :].tolist(), strict=False):
        # The checksum of what came before, carried over as many bytes as follow, is that with zeros instead of them, less that of the zeros.
        zeros = bytes(4 * min(GRAIN, end - at))
        crc = zlib.crc32(zeros, crc) ^ zlib.crc32(zeros) ^ grain
    return crc


def differencing(sizes: Sequence[int], k: int) -> list[list[int]]:
    """Multiway Karmarkar-Karp: k lists of indices into sizes, near equal in their sums.

    A partial partition is kept as its non-empty windows, fullest first; only
    where two have more than k windows together do any of these meet.
    """
    if k == 1:
        return [list(range(len(sizes)))]
    heap = [(-s, i, [(s, (i,))]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    tie = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        meet = len(a) + len(b) - k
        if meet > 0:
            met = [(x[0] + y[0], x[1] + y[1]) for x, y in zip(a[len(a) - meet :], reversed(b[len(b) - meet :]), strict=True)]
            merged = a[: len(a) - meet] + met + b[: len(b) - meet]
        else:
            merged = a + b
        merged.sort(key=lambda w: -w[0])
        spread = merged[0][0] - (merged[-1][0] if len(merged) == k else 0)
        heapq.heappush(heap, (-spread, tie, merged))
        tie += 1
    return [list(w[1]) for w in heap[0][2]] if heap else []


def pack_group(sizes: Sequence[int], capacity: int = CAPACITY, slack: float = SLACK) -> list[list[tuple[int, int, int]]]:
    """Windows of at most ``capacity`` as lists of pieces (item, start, end); their number rises until all fit, or until cuts are due."""
    total = sum(sizes)
    k = max(1, -(-total // capacity))
    most = max(k + 1, int((1 + slack) * total / capacity))
    while True:
        windows = differencing(sizes, k)
        over = max((sum(sizes[i] for i in w) for w in windows), default=0) - capacity
        pieces = [[(i, 0, sizes[i]) for i in w] for w in windows]
        if over <= 0:
            return pieces
        if k >= most:
            return cut_to_fit(pieces, capacity)
        k += 1


def cut_to_fit(windows: list[list[tuple[int, int, int]]], capacity: int = CAPACITY) -> list[list[tuple[int, int, int]]]:
    """Moves what is above the capacity, cut off each window's largest item, to windows with room or new ones."""
    spare: list[tuple[int, int, int]] = []
    room = []
    for w in windows:
        over = sum(e - s for _, s, e in w) - capacity
        while over > 0:
            w.sort(key=lambda x: x[1] - x[2])
            i, start, end = w.pop(0)
            keep = start + max(0, end - start - over) // GRAIN * GRAIN
            if keep > start:
                w.append((i, start, keep))
            spare.append((i, keep, end))
            over -= end - keep
        room.append(-over)
    spare.sort(key=lambda x: x[1] - x[2])
    heap = [(-r, j) for j, r in enumerate(room)]
    heapq.heapify(heap)
    while spare:
        i, start, end = spare.pop(0)
        free, j = (-heap[0][0], heap[0][1]) if heap else (0, 0)
        if free < min(GRAIN, end - start):
            free, j = capacity, len(windows)
            windows.append([])
            heapq.heappush(heap, (-free, j))
        stop = end if end - start <= free else start + free // GRAIN * GRAIN
        windows[j].append((i, start, stop))
        heapq.heapreplace(heap, (stop - start - free, j))
        if stop < end:
            spare.insert(0, (i, stop, end))
    return windows


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spreads consecutive numbers over all 63-bit numbers."""
    x = x.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(1)).astype(np.int64)


def cut_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Full windows and items of every document: doc_id, start, length, ids_crc32, doc_tokens, grains (an item's checksums), and deal, by which they are dealt out."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (TaskContext.get().partitionId() + 1) << 40
        for batch in batches:
            row, start, length, crc, tokens, grains = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                ids = encode(text.as_py() or "", tokenizer)
                for at in range(0, len(ids), capacity):
                    part = ids[at : at + capacity]
                    row.append(i)
                    start.append(at)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    tokens.append(len(ids))
                    grains.append(grain_checksums(part) if len(part) < capacity else b"")
            deal = _mixed(np.arange(seen, seen + len(row)))
            seen += len(row)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *[pa.array(x, pa.int64()) for x in (start, length, crc, tokens)], pa.array(grains, pa.binary()), pa.array(deal, pa.int64())], names=names)

    id_type = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "grains", "deal"]
    return docs.select("doc_id", "text").mapInArrow(pieces, f"doc_id {id_type}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, grains binary, deal bigint")


def pack_pieces(pieces: DataFrame, tasks: int, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Sequences of full windows and items, with sequence_id and offset; each task packs its share group by group."""
    names = [c for c in pieces.columns if c not in ("deal", "grains")]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []

        def windows_of(rows: pa.Table) -> pa.RecordBatch:
            nonlocal window
            starts, sizes, crcs = (rows.column(c).to_pylist() for c in ("start", "length", "ids_crc32"))
            items = [i for i, s in enumerate(sizes) if s < capacity]
            groups = [[(i, 0, s)] for i, s in enumerate(sizes) if s >= capacity]
            groups += [[(items[j], a, b) for j, a, b in w] for w in pack_group([sizes[i] for i in items], capacity)] if items else []
            order, start, length, crc, sequence, offset = [], [], [], [], [], []
            for members in groups:
                at = 0
                for i, a, b in members:
                    order.append(i)
                    start.append(starts[i] + a)
                    length.append(b - a)
                    crc.append(crcs[i] if b - a == sizes[i] else combined_checksum(rows.column("grains")[i].as_py(), a, b))
                    sequence.append(window)
                    offset.append(at)
                    at += b - a
                window += 1
            take = lambda c: rows.column(c).take(pa.array(order, pa.int64())).combine_chunks()
            return pa.RecordBatch.from_arrays([take("doc_id"), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), take("doc_tokens"), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

        for batch in batches:
            held.append(batch)
            rows = pa.Table.from_batches(held)
            whole = rows.num_rows // group * group
            for at in range(0, whole, group):
                yield windows_of(rows.slice(at, group))
            held = rows.slice(whole).to_batches()
        if held:
            yield windows_of(pa.Table.from_batches(held))

    fields = [pieces.schema[n] for n in names]
    schema = T.StructType([*fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return pieces.repartition(tasks, "deal").sortWithinPartitions("deal").mapInArrow(packed, schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    pieces = written(cut_documents(docs, tokenizer, capacity), "packing-pieces")
    tasks = max(1, min(shuffle_partitions(docs.sparkSession), -(-pieces.count() // DOCS_PER_TASK)))
    return pack_pieces(pieces, tasks, capacity)
