"""URL filter: rules first, then the ratio of two character language models.

Accepted and rejected URLs each get a variable-order Markov model of characters
(contexts of up to ``ORDER`` characters, Witten-Bell smoothing down to single
characters). A URL is scored by the log-likelihood difference of the two models
for its host and path, divided by its length, and blocked below a threshold
that is calibrated on labelled URLs kept out of the fit.

Labels are given as a table of URLs, or, without one, made from a short list of
words in host names. The fit sees every distinct labelled URL, unless the caller
sets ``max_urls``; every sequence that occurs in them is kept, so the model grows
with the distinct sequences of ``ORDER`` + 1 characters. The model is held as one
value: an array of hash buckets, each a small map from character sequence to
weight. Scoring walks over a URL's characters once, in time proportional to its
length, and looks sequences up from the longest down, inside one projection
over the URLs: no join, no shuffle, no Python.

Defined results: a null URL, or one without ``://``, has empty host and path;
what has no character to score gets score 0 and is allowed; without rejected
(or accepted) URLs to learn from, everything outside the rules is allowed; URLs
of any length are scored whole; repeated rows are judged alike. Only page_id
and url are read.
"""

from __future__ import annotations

import contextlib
import math
import uuid
from collections.abc import Iterator, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import hash_sample, written

ORDER = 4
#: Entries of a bucket of the model, about.
BUCKET_ENTRIES = 2
#: Marks the time before a text, and the weight of leaving a context.
START, LEAVE = "\x01", "\x02"
#: Symbols over which the single-character models are smoothed, and the count added to each.
ALPHABET, ADDED = 128, 0.5

# Words in host names by which URLs are labelled as rejected for the fit.
REJECTED_WORDS = ("adult", "ads", "bet", "bets", "casino", "gambling", "loans", "pills", "poker", "porn", "spam", "viagra", "xxx")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest (verdict, rule) that fits, as rule and verdict columns; null if none does."""
    fitting = []
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        at = rule.index("/")
        fits = ((host == rule[:at]) | F.endswith(host, F.lit("." + rule[:at]))) & F.startswith(path, F.lit(rule[at:]))
        fitting.append((fits, rule, verdict))
    pick = lambda k: F.coalesce(F.lit(None).cast("string"), *[F.when(f[0], F.lit(f[k])) for f in fitting])
    return pick(1), pick(2)


def _grams(labelled: DataFrame) -> DataFrame:
    """(gram, accepted count, rejected count) of all sequences of 1 to ORDER + 1 characters that end at a character of a text."""
    chars = labelled.where("text <> ''").select("accepted", F.split(F.concat(F.lit(START * ORDER), F.col("text")), "").alias("c"))
    ending_at = lambda i: F.concat(*[F.get("c", i - back) for back in range(ORDER, -1, -1)])
    longest = chars.select("accepted", F.explode(F.transform(F.sequence(F.lit(ORDER), F.size("c") - 1), ending_at)).alias("longest"))
    hits = F.col("accepted").cast("long")
    counts = longest.groupBy("longest").agg(F.sum(hits).alias("acc"), F.sum(1 - hits).alias("rej"))
    grams = counts.select("acc", "rej", F.explode(F.array(*[F.substr("longest", F.lit(ORDER + 1 - k), F.lit(k + 1)) for k in range(ORDER + 1)])).alias("gram"))
    return grams.groupBy("gram").agg(F.sum("acc").alias("acc"), F.sum("rej").alias("rej"))


def fit(labelled: DataFrame) -> DataFrame:
    """From (text, accepted) rows to a table of (key, weight): log-probability differences of sequences, and of leaving their contexts."""
    counts = written(_grams(labelled).withColumn("k", F.length("gram") - 1), "url-grams")
    everywhere = Window.partitionBy(F.lit(0))
    smooth = lambda c: (F.col(c) + ADDED) / (F.sum(c).over(everywhere) + ADDED * ALPHABET)
    level = counts.where("k = 0").select("gram", F.lit("").alias("ctx"), smooth("acc").alias("pa"), smooth("rej").alias("pr"), F.lit(0.0).alias("leave"))
    levels = [level]
    for k in range(1, ORDER + 1):
        ctx = F.substr("gram", F.lit(1), F.lit(k))
        at = counts.where(F.col("k") == k).withColumn("ctx", ctx)
        own = Window.partitionBy("ctx")
        for c in ("acc", "rej"):
            at = at.withColumn(f"{c}_n", F.sum(c).over(own)).withColumn(f"{c}_t", F.sum((F.col(c) > 0).cast("long")).over(own))
        below = level.select(F.col("gram").alias("suffix"), F.col("pa").alias("pa_below"), F.col("pr").alias("pr_below"))
        at = at.join(below, F.expr("substring(gram, 2)") == F.col("suffix"))
        left = lambda c: F.when(F.col(f"{c}_n") > 0, F.col(f"{c}_t") / (F.col(f"{c}_n") + F.col(f"{c}_t"))).otherwise(1.0)
        here = lambda c, p: F.when(F.col(f"{c}_n") > 0, F.col(c) / (F.col(f"{c}_n") + F.col(f"{c}_t"))).otherwise(0.0) + left(c) * F.col(p)
        level = at.select("gram", "ctx", here("acc", "pa_below").alias("pa"), here("rej", "pr_below").alias("pr"), F.log(left("acc") / left("rej")).alias("leave"))
        levels.append(level)
    grams = reduce(DataFrame.unionByName, levels)
    leaving = grams.where("ctx <> ''").groupBy(F.concat(F.lit(LEAVE), "ctx").alias("key")).agg(F.first("leave").alias("weight"))
    return grams.select(F.col("gram").alias("key"), F.log(F.col("pa") / F.col("pr")).alias("weight")).unionByName(leaving)


def packed(entries: DataFrame, buckets: int) -> DataFrame:
    """The entries as one row with one value: an array of ``buckets`` maps."""
    full = entries.groupBy(F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("b")).agg(F.collect_list(F.struct("key", "weight")).alias("e"))
    every = entries.sparkSession.range(buckets).select(F.col("id").alias("b")).join(full, "b", "left").select("b", F.coalesce("e", F.array().cast(full.schema["e"].dataType)).alias("e"))
    rows = F.array_sort(F.collect_list(F.struct("b", "e")))
    return every.agg(F.transform(rows, lambda x: F.map_from_entries(x["e"])).alias("table"))


@contextlib.contextmanager
def as_variable(model: DataFrame) -> Iterator[Column]:
    """The one value of packed() as a session variable; a DataFrame built meanwhile keeps the value."""
    spark, name = model.sparkSession, f"url_model_{uuid.uuid4().hex}"
    spark.sql(f"DECLARE VARIABLE {name} ARRAY<MAP<STRING, DOUBLE>>")
    try:
        spark.sql(f"SET VARIABLE {name} = (SELECT table FROM {{model}})", model=model)
        yield F.expr(name)
    finally:
        spark.sql(f"DROP TEMPORARY VARIABLE IF EXISTS {name}")


def log_ratio(text: Column, model: Column, unseen: float) -> Column:
    """Length-normalised log-likelihood difference of a text; one step per character, which knows the ORDER characters before it."""

    def found(key: Column) -> Column:
        return F.element_at(F.get(model, F.pmod(F.xxhash64(key), F.size(model)).cast("int")), key)

    def weight(longest: Column) -> Column:
        out = F.lit(unseen)
        for k in range(ORDER + 1):
            place = F.lit(ORDER + 1 - k)
            leave = F.coalesce(found(F.concat(F.lit(LEAVE), F.substr(longest, place, F.lit(k)))), F.lit(0.0)) if k else F.lit(0.0)
            out = F.coalesce(found(F.substr(longest, place, F.lit(k + 1))), leave + out)
        return out

    def step(acc: Column, char: Column) -> Column:
        longest = F.concat(acc["last"], char)
        return F.struct((acc["total"] + weight(longest)).alias("total"), F.substr(longest, F.lit(2), F.lit(ORDER)).alias("last"))

    start = F.struct(F.lit(0.0).alias("total"), F.lit(START * ORDER).alias("last"))
    total = F.aggregate(F.split(text, ""), start, step, lambda acc: acc["total"])
    return F.when(F.length(text) > 0, total / F.length(text)).otherwise(0.0)


def scored_text(url: Column) -> Column:
    """What the models see of a URL: its host and lower-cased path."""
    host, path = host_and_path(url)
    return F.concat(host, lower_ascii(path))


def word_labels(pages: DataFrame, rejected_words: Sequence[str] = REJECTED_WORDS) -> DataFrame:
    """(url, accepted): every URL, labelled by the words (runs of letters) of its host."""
    words = F.split(host_and_path(F.col("url"))[0], "[^a-z]+")
    return pages.select("url", (~F.arrays_overlap(words, F.array(*map(F.lit, rejected_words)))).alias("accepted"))


def fit_sample(labelled: DataFrame, max_urls: int | None = None) -> DataFrame:
    """(text, accepted) of all distinct texts of each class, or of the ``max_urls`` first by hash."""
    rows = labelled.where("accepted is not null").select(scored_text(F.col("url")).alias("text"), "accepted").where(F.length("text") > 0)
    if max_urls is None:
        return rows.distinct()
    rows = rows.withColumn("place", F.xxhash64("text"))
    about = {r.accepted: r.n for r in rows.groupBy("accepted").agg(F.approx_count_distinct("text").alias("n")).collect()}
    first = lambda flag: hash_sample(rows.where(F.col("accepted") == flag).distinct(), "place", max_urls, about.get(flag, 0))
    return first(True).unionByName(first(False)).drop("place")


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], labelled: DataFrame | None = None, max_urls: int | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and score of every page; ``labelled``: (url, accepted), else labels come from REJECTED_WORDS."""
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("text", F.concat("host", lower_ascii(F.col("path"))))
    sample = fit_sample(word_labels(pages) if labelled is None else labelled, max_urls)
    sample = written(sample.withColumn("fold", F.pmod(F.xxhash64("text", F.lit("fold")), F.lit(5))), "url-labelled")
    train = sample.where("fold > 0")
    chars = {r.accepted: r.chars for r in train.groupBy("accepted").agg(F.sum(F.length("text")).alias("chars")).collect()}
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    if len(chars) < 2:
        return urls.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.lit("allow")).alias("verdict"), F.lit(0.0).alias("score"))
    unseen = math.log((chars[False] + ADDED * ALPHABET) / (chars[True] + ADDED * ALPHABET))
    entries = written(fit(train), "url-entries")
    with as_variable(written(packed(entries, max(1, entries.count() // BUCKET_ENTRIES)), "url-model")) as model:
        held = sample.where("fold = 0").select("accepted", log_ratio(F.col("text"), model, unseen).alias("score"))
        scored = urls.withColumn("score", log_ratio(F.col("text"), model, unseen))
    low, high = F.percentile(F.when(F.col("accepted"), F.col("score")), F.lit(0.01)), F.percentile(F.when(~F.col("accepted"), F.col("score")), F.lit(0.99))
    threshold = held.agg(((low + high) / 2).alias("t")).first().t or 0.0
    judged = F.coalesce(verdict, F.when((F.col("score") < threshold) & (F.col("text") != ""), F.lit("block")).otherwise("allow"))
    return scored.select("page_id", "host", "path", rule.alias("rule"), judged.alias("verdict"), "score")
