"""Canonical exact digests of documents.

A text's canonical form is its compatibility normalisation (NFKC) with case
folded and every run of white space folded to one space, trimmed. The digest is
128 bits wide: two differently seeded xxhash64 values of the canonical form,
which is made once for every document. Documents are grouped by digest; inside a bucket with several documents the
canonical bytes are compared, and where they differ (a collision) the digest
alone no longer stands for the text, so each text's own SHA-256 is appended.
Hence equal fingerprints mean equal canonical texts.

Only DataFrame functions are used; normalisation and case folding come from
the ICU classes that Spark ships, called as SQL functions.

Defined results: a null text counts as empty; repeated rows keep their own row
and get equal fingerprints; null ids come first in the order of documents.
Columns besides doc_id and text are not looked at.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import shuffle_partitions, text_or_empty, written

#: Repeated digests up to which their table (33 bytes each) is broadcast.
BROADCAST_DIGESTS = 500_000


def canonical(text: Column) -> Column:
    """NFKC, full case folding, white space folded; for a non-null text."""
    nfkc = lambda c: F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    folded = nfkc(F.java_method(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), nfkc(text), F.lit(True)))
    return F.trim(F.regexp_replace(folded, r"(?U)\s+", " "))


def digest(canon: Column) -> Column:
    """32 hexadecimal digits from two xxhash64 values with different seeds."""
    part = lambda seed: F.lpad(F.lower(F.hex(F.xxhash64(F.lit(seed), canon))), 16, "0")
    return F.concat(part(1), part(2))


def with_digest(docs: DataFrame) -> DataFrame:
    """(doc_id, text, digest, sha): every document's canonical form is made once, for its digest and its SHA-256."""
    rows = docs.select("doc_id", text_or_empty().alias("text")).withColumn("canon", canonical(F.col("text")))
    return rows.select("doc_id", "text", digest(F.col("canon")).alias("digest"), F.sha2("canon", 256).alias("sha"))


def collided(docs: DataFrame, digests: DataFrame) -> DataFrame:
    """The digests of (doc_id, digest) rows that stand for more than one canonical text.

    Digests are counted first; the canonical forms of those documents whose
    digest occurs again are made once more and compared byte by byte. Equal
    texts are merged before they are dealt out. The ids of these documents are
    broadcast while their counted number allows it, else joined by shuffle.
    """
    again = digests.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
    ids = written(digests.join(again, "digest").select(F.col("doc_id").alias("again_id")).distinct(), "fingerprint-again")
    if ids.count() <= BROADCAST_DIGESTS:
        ids = F.broadcast(ids)
    canon = docs.join(ids, F.col("doc_id").eqNullSafe(F.col("again_id")), "left_semi").select(canonical(text_or_empty()).alias("canon")).withColumn("digest", digest(F.col("canon")))
    distinct = canon.groupBy("digest", "canon").agg(F.lit(1).alias("one"))
    return distinct.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest")


def final(digest_col: str, sha_col: str) -> Column:
    return F.when(F.col("hit").isNull(), F.col(digest_col)).otherwise(F.concat(digest_col, F.lit("-"), sha_col))


def resolve(rows: DataFrame, clashes: DataFrame, digest_col: str, sha_col: str, out: str) -> DataFrame:
    """Replaces a digest that stands for several texts by digest and SHA-256."""
    hits = clashes.select(F.col("digest").alias("clash"), F.lit(1).alias("hit"))
    return rows.join(hits, F.col(digest_col) == F.col("clash"), "left").withColumn(out, final(digest_col, sha_col)).drop("clash", "hit", sha_col)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint for every document."""
    rows = written(with_digest(docs).drop("text"), "fingerprint-rows")
    clashes = written(collided(docs, rows), "fingerprint-clashes")
    return resolve(rows, clashes, "digest", "sha", "fingerprint").select("doc_id", "fingerprint")


def with_next(rows: DataFrame) -> DataFrame:
    """Adds next_text, next_digest and next_sha to (doc_id, text, digest, sha): those of the next document by id; the first follows the last.

    Ids are cut into ranges at quantiles that are ids themselves, so a range's
    first id is known; the rows of that id also go, marked, to the end of the
    range before, where the window finds them as the last row's successor.
    """
    n = 4 * shuffle_partitions(rows.sparkSession)
    # One number per range comes to the driver.
    ends = rows.agg(F.min("doc_id").alias("low"), F.percentile_approx("doc_id", [i / n for i in range(1, n)], 100 * n).alias("cuts"), F.max(F.col("doc_id").isNull()).alias("nulls")).first()
    starts = sorted({*([ends.low] if ends.low is not None else []), *(ends.cuts or [])})
    if ends.nulls:
        starts = [None, *starts]
    # Two steps find a row's range: the group of ranges, then the range in it.
    step = max(1, math.isqrt(len(starts)))
    known = [s for s in starts if s is not None]
    shift = len(starts) - len(known)
    groups = F.from_json(F.lit(json.dumps([known[i : i + step] for i in range(0, len(known), step)])), "array<array<bigint>>")
    firsts = F.from_json(F.lit(json.dumps(known[::step])), "array<bigint>")
    group = F.size(F.filter(firsts, lambda s: s <= F.col("doc_id")))
    inside = F.get(groups, group - 1)
    own = F.when(F.col("doc_id").isNull(), 0).otherwise((group - 1) * step + F.size(F.filter(inside, lambda s: s <= F.col("doc_id"))) + (shift - 1))
    is_first = F.coalesce(F.array_contains(inside, F.col("doc_id")), F.lit(True))
    place = lambda at, tail: F.struct(at.alias("range"), F.lit(tail).alias("tail"))
    places = F.when(is_first, F.array(place(own, 0), place(F.pmod(own - 1, F.lit(max(1, len(starts)))), 1))).otherwise(F.array(place(own, 0)))
    in_range = Window.partitionBy("range").orderBy("tail", F.asc_nulls_first("doc_id"), "text")
    following = {f"next_{c}": F.lead(c).over(in_range) for c in ("text", "digest", "sha")}
    return rows.withColumn("place", F.explode(places)).select("doc_id", "text", "digest", "sha", "place.*").withColumns(following).where("tail = 0").drop("range", "tail")


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, whose last half is replaced by the start of the next document."""
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.expr("substring(text, 1, n_chars - half)"), F.expr("substring(next_text, 1, half)"))
    texts = (
        with_next(with_digest(docs))
        .withColumn("n_chars", F.length("text"))
        .withColumn("half", half)
        .withColumn("edited", edited)
        .select("doc_id", F.col("n_chars").cast("long"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "digest", "sha", "next_digest", "next_sha", canonical(F.col("edited")).alias("edited_canon"))
    )
    made = texts.select("doc_id", "n_chars", "edited_sha256", "digest", "sha", "next_digest", "next_sha", digest(F.col("edited_canon")).alias("edited_digest"), F.sha2("edited_canon", 256).alias("edited_sha"))
    likeness = lambda other: ((F.col("digest") == F.col(f"{other}_digest")) & (F.col("sha") == F.col(f"{other}_sha"))).cast("double")
    rows = written(made.withColumn("near_edited", likeness("edited")).withColumn("near_next", likeness("next")).drop("next_digest", "next_sha"), "fingerprint-rows")
    by_bytes = collided(docs, rows.select("doc_id", "digest"))
    # Edited texts exist only here; among themselves and against the documents their canonical bytes' SHA-256 is compared.
    both = rows.select(F.explode(F.array(F.struct("digest", "sha"), F.struct(F.col("edited_digest").alias("digest"), F.col("edited_sha").alias("sha")))).alias("x"))
    by_sha = both.groupBy("x.digest").agg(F.min("x.sha").alias("low"), F.max("x.sha").alias("high")).where("low < high").select("digest")
    clashes = written(by_bytes.union(by_sha).distinct(), "fingerprint-clashes")
    rows = resolve(rows, clashes, "digest", "sha", "fingerprint")
    rows = resolve(rows, clashes, "edited_digest", "edited_sha", "edited_fingerprint")
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
