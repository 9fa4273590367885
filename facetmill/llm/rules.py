"""Quality rules whose cutoffs are certified to reject few good documents in every stratum.

Every text is counted whole, in its row, by DataFrame functions only. Documents
that fail the base rules go. For the others each rule has a score from 0 to
1000, and a policy is one cutoff per rule: a document is rejected if any score
reaches its cutoff.

Labelled documents are dealt into two folds by a hash. The selection fold gives
every stratum a sequence of policies, lax to strict: at each level the lowest
cutoff per rule that rejects no more than that share of the good documents and
of which nine in ten rejected ones are bad. The holdout fold then tests the
policies in that order: with n good documents of which k are rejected, a policy
passes if P(Bin(n, limit) <= k), summed exactly, is at most ``risk`` divided
by the number of strata. The strictest policy before the first failure is
taken. Testing in a fixed order needs no correction inside a stratum
and the division (Bonferroni) corrects for the strata, so with probability
1 - risk no stratum rejects more than ``limit`` of its good documents
beyond the base rules. A stratum with too few labels has no cutoffs.

Histograms of scores (at most 1001 values a rule and stratum) are all that is
gathered; a stratum of any share of the rows is aggregated before it is
shuffled, and cutoffs meet the documents under a salt.

Defined results: a null text has no words; a null stratum is a stratum; labels
that are null, neither 0 nor 1, or disagree about a document are not used;
rows with equal ids are judged each for itself (and each is counted as labelled);
empty tables give empty results or no cutoffs. Texts are split at ``\\n``
only. Columns besides doc_id, text and the stratum are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, join_group_value, n_words, written

WINDOW = 8
RULES = ("symbols", "dup_lines", "repeats", "upper", "long_words", "short_words")
LIMIT, RISK = 0.03, 0.05
#: Share of the selection fold's good documents, in thousandths, that each policy may reject by one rule.
LEVELS = (0, 1, 2, 5, 10, 20)
#: Of the selection fold's documents that a cutoff rejects, so many tenths must be bad.
PRECISION_TENTHS = 9


def bound_once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column, size: int = WINDOW) -> Column:
    """Number of words that lie in a window of ``size`` words found twice or more among ``words``.

    Windows meet by a 64-bit hash, in sorted order; neighbours count as equal if their words are.
    """
    nothing = F.lit(0).cast("long")

    def covered(words: Column, hashed: Column) -> Column:
        pairs = F.sort_array(F.transform(hashed, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def positions(pairs: Column) -> Column:
            def equal(e: Column, other: Column) -> Column:
                same = other["h"] == e["h"]
                return F.coalesce(F.when(same, F.slice(words, e["i"] + 1, F.lit(size)) == F.slice(words, other["i"] + 1, F.lit(size))), F.lit(False))

            marked = F.transform(pairs, lambda e, k: F.when(equal(e, F.get(pairs, k - 1)) | equal(e, F.get(pairs, k + 1)), e["i"]))
            return F.sort_array(F.filter(marked, lambda i: i.isNotNull()))

        begin = F.struct(nothing.alias("n"), F.lit(0).alias("end"))
        total = F.aggregate(
            bound_once(pairs, positions), begin, lambda s, i: F.struct((s["n"] + (i + size) - F.greatest(s["end"], i)).cast("long").alias("n"), (i + size).alias("end")), lambda s: s["n"]
        )
        return total

    def windows(hashes: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(hashes) - size), lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(size)]))

    def count(words: Column) -> Column:
        by_window = lambda hashed: F.when(F.size(F.array_distinct(hashed)) < F.size(hashed), covered(words, hashed)).otherwise(nothing)
        return bound_once(F.transform(words, lambda w: F.xxhash64(w)), lambda hashes: bound_once(windows(hashes), by_window))

    return F.when(F.size(words) <= size, nothing).otherwise(bound_once(words, count))


def text_counts(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """doc_id, stratum and the counts of every whole text."""
    rows = docs.select("doc_id", F.col(stratum).alias("stratum"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counts = {
        "n_words": n_words(),
        "word_chars": F.length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")).cast("long"),
        "n_symbols": F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_upper": F.regexp_count("text", F.lit(r"\p{Lu}")).cast("long"),
        "lines": bound_once(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), F.size(F.array_distinct(x)).cast("long").alias("distinct"))),
        "n_repeat_words": repeated_words(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))),
    }
    out = rows.select("doc_id", "stratum", *[c.alias(k) for k, c in counts.items()])
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return out.select("doc_id", "stratum", "n_words", "word_chars", "n_symbols", (F.col("lines.n") - F.col("lines.distinct")).alias("n_dup_lines"), "n_repeat_words", "n_upper", F.col("lines.n").alias("n_lines"), failed.alias("base_failed"))


def rule_scores() -> dict[str, Column]:
    """Scores from 0 to 1000 (higher is worse) of a document with words."""
    share = lambda a, b: F.expr(f"least(1000L, (1000 * {a}) div greatest({b}, 1L))")
    length = F.expr("least(1000L, (10 * word_chars) div greatest(n_words, 1L))")
    shares = share("n_symbols", "word_chars"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words"), share("n_upper", "word_chars")
    return dict(zip(RULES, (*shares, length, F.lit(1000).cast("long") - length), strict=True))


def ln_factorial(x: Column) -> Column:
    """Exact up to 20, then Stirling's series (relative error below 1e-14)."""
    y = x.cast("double")
    series = (y + 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * F.pow(y, F.lit(3.0))) + 1 / (1260 * F.pow(y, F.lit(5.0)))
    return F.when(x <= 20, F.ln(F.factorial(F.least(x, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def binomial_below(k: Column, n: Column, q: float) -> Column:
    """P(Bin(n, q) <= k) for k below n * q; 1 for others (it is above a half there or so).

    Terms are summed from k downwards, where they only fall; those beyond ten
    standard deviations are below 1e-20 of the first.
    """
    first = F.exp(ln_factorial(n) - ln_factorial(k) - ln_factorial(n - k) + k * math.log(q) + (n - k) * math.log1p(-q))
    width = F.ceil(10 * F.sqrt(n * q)) + 20
    begin = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def step(s: Column, j: Column) -> Column:
        term = s["term"] * j * ((1 - q) / q) / (n - j + 1)
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    terms = F.when(k > 0, F.aggregate(F.sequence(k, F.greatest(k - width, F.lit(1)), F.lit(-1)), begin, step, lambda s: s["sum"])).otherwise(1.0)
    return F.when(k.cast("double") >= n * q, 1.0).otherwise(first * terms)


def _reaches(cutoffs: Column) -> Column:
    """Whether any score of the row is at its cutoff or above."""
    return F.coalesce(F.greatest(*[F.coalesce(F.col(name) >= cutoffs[name], F.lit(False)) for name in RULES]), F.lit(False))


def certified_cutoffs(counts: DataFrame, labels: DataFrame, limit: float = LIMIT, risk: float = RISK, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """Per stratum with labelled documents: n (good holdout documents), k (those rejected), level and its cutoffs (null: none certified)."""
    scores = rule_scores()
    said = labels.where("quality in (0, 1)").groupBy(F.col("doc_id").alias("label_id")).agg(F.min("quality").alias("good"), F.max("quality").alias("most")).where("good = most")
    known = counts.where("not base_failed").join(said, F.col("doc_id") == F.col("label_id")).select("stratum", "good", (F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1) < "8").alias("selects"), *[c.alias(k) for k, c in scores.items()])
    known = written(known.groupBy("stratum", "good", "selects", *scores).agg(F.count("*").alias("n")), "rules-labelled")
    # Selection: for each stratum, rule and score, what a cutoff there would reject.
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("score")) for k in scores])).alias("x")
    by_score = known.where("selects").select("stratum", "good", "n", each).groupBy("stratum", F.col("x.rule").alias("rule"), F.col("x.score").alias("score")).agg(F.sum(F.expr("n * good")).alias("good"), F.sum(F.expr("n * (1 - good)")).alias("bad"))
    rule = Window.partitionBy("stratum", "rule")
    down = rule.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    at = by_score.select("stratum", "rule", "score", F.sum("good").over(down).alias("good"), F.sum("bad").over(down).alias("bad"), F.sum("good").over(rule).alias("all_good"))
    at = at.where((F.col("score") > 0) & (10 * F.col("bad") >= PRECISION_TENTHS * (F.col("good") + F.col("bad"))))
    lowest = lambda name, level: F.min(F.when((F.col("rule") == name) & (1000 * F.col("good") <= level * F.col("all_good")), F.col("score"))).alias(name)
    policies = at.groupBy("stratum").agg(*[F.struct(*[lowest(name, level) for name in scores]).alias(f"policy{i}") for i, level in enumerate(levels)])
    # Holdout: good documents, and how many of them each policy rejects.
    held = join_group_value(known.where("not selects and good = 1"), policies, "stratum")
    tested = held.groupBy("stratum").agg(F.sum("n").alias("n"), *[F.sum(F.when(_reaches(F.col(f"policy{i}")), F.col("n")).otherwise(0)).alias(f"k{i}") for i in range(len(levels))])
    tested = written(join_group_value(tested, policies, "stratum"), "rules-tested")
    strata = max(1, tested.count())
    passes = [binomial_below(F.col(f"k{i}"), F.col("n"), limit) <= risk / strata for i in range(len(levels))]
    before_failure = F.array(*[F.col(f"passes{i}") for i in range(len(levels))])
    level = F.array_position(F.concat(before_failure, F.array(F.lit(False))), False).cast("int") - 2
    tested = tested.select("*", *[c.alias(f"passes{i}") for i, c in enumerate(passes)]).withColumn("level", level)
    picked = lambda what: F.when(F.col("level") >= 0, F.get(F.array(*[F.col(f"{what}{i}") for i in range(len(levels))]), F.col("level")))
    return tested.select("stratum", "n", picked("k").alias("k"), "level", picked("policy").alias("cutoffs"))


def judge_quality(docs: DataFrame, labels: DataFrame, stratum: str = "lang", limit: float = LIMIT, risk: float = RISK) -> DataFrame:
    """Per document: its counts, base_failed and kept."""
    counts = written(text_counts(docs, stratum), "rules-counts")
    cutoffs = written(certified_cutoffs(counts, labels, limit, risk).select("stratum", "cutoffs"), "rules-cutoffs")
    met = join_group_value(counts, cutoffs, "stratum").select("*", *[c.alias(k) for k, c in rule_scores().items()])
    kept = ~F.col("base_failed") & ~_reaches(F.col("cutoffs"))
    return met.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "n_upper", "n_lines")
