"""Quality rules against plain Python counts, exact binomial sums and a plain selection of cutoffs."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from facetmill.llm.rules import LEVELS, RULES, binomial_below, certified_cutoffs, judge_quality, text_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, stratum string, n_words int, kept int, quality int, good int"
LABELS = "doc_id long, quality int, toxic int, stratum string"


def counted(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    often = Counter(windows)
    inside = {i + j for i, x in enumerate(windows) if often[x] > 1 for j in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(w) < 20 or 100 * len(inside) > 30 * len(w)
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(inside), "n_upper": sum(c.isupper() for c in text), "n_lines": len(lines), "base_failed": failed}


def scores(c):
    share = lambda a, b: min(1000, 1000 * c[a] // max(1, c[b]))
    length = min(1000, 10 * c["word_chars"] // max(1, c["n_words"]))
    return dict(zip(RULES, (share("n_symbols", "word_chars"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words"), share("n_upper", "word_chars"), length, 1000 - length), strict=True))


def brute_cutoffs(docs, labels, limit, risk):
    said = defaultdict(set)
    for i, q in labels:
        if q in (0, 1):
            said[i].add(q)
    known = [(lang, min(said[i]), hashlib.md5(str(i).encode()).hexdigest()[0] < "8", scores(counted(t))) for i, t, lang in docs if i is not None and len(said.get(i, ())) == 1 and not counted(t)["base_failed"]]
    strata = {lang for lang, good, selects, _ in known if good and not selects}
    out = {}
    for lang in strata:
        chosen = [(g, s) for x, g, selects, s in known if x == lang and selects]
        held = [s for x, g, selects, s in known if x == lang and g and not selects]
        best = None
        for level in LEVELS:
            policy = {}
            for rule in RULES:
                for cut in sorted({s[rule] for _, s in chosen if s[rule] > 0}):
                    good = sum(s[rule] >= cut for g, s in chosen if g)
                    bad = sum(s[rule] >= cut for g, s in chosen if not g)
                    if 10 * bad >= 9 * (good + bad) and 1000 * good <= level * sum(g for g, _ in chosen):
                        policy[rule] = cut
                        break
            k = sum(any(s[r] >= c for r, c in policy.items()) for s in held)
            n, q = len(held), Fraction(limit)
            if sum(math.comb(n, j) * q**j * (1 - q) ** (n - j) for j in range(k + 1)) > risk / len(strata):
                break
            best = policy
        out[lang] = best
    return out


def made(rng, n):
    docs, labels = [], []
    for i in range(n):
        lang = rng.choice(["en", "en", "en", "de", None, "rare"]) if i % 40 else "rare"
        lang = "de" if lang == "rare" and i % 40 else lang
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(24, 60))]
        bad = rng.random() < 0.25
        if bad:
            kind = rng.randrange(3)
            words = [w + "###" for w in words] if kind == 0 else [w.upper() for w in words] if kind == 1 else words
        elif rng.random() < 0.02:
            words = [w + "#" for w in words]
        docs.append((i, " ".join(words), lang))
        if rng.random() < 0.9:
            labels.append((i, int(not bad)))
    return docs, labels


def tables(spark, docs, labels):
    rows = [(i, t, lang, "x", 1, 1, 1, 1) for i, t, lang in docs]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame([(i, q, 0, "y") for i, q in labels], LABELS)


def test_counts(spark):
    line = "a line of eight words that comes twice"
    texts = [None, "", " \n\t", "one", " ".join("abcdefgh"), " ".join("abcdefghi"), "x " * 9, f"{line}\n{line}\n\nother\n {line}", "la la " * 500, "a b c d e f g h i j " * 3, "É\U0001f600 # % <b>\x0bq\x0cÑ\r\nQ"]
    texts += [f"{line} middle words here {line} end {line}", " ".join(str(i % 13) for i in range(90)), "w" * 100_000, " ".join(f"w{i}" for i in range(200_000)) + " w5 w6 w7 w8 w9 w10 w11 w12"]
    rng = random.Random(4)
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randrange(8, 60))) for _ in range(60)]
    docs, _ = tables(spark, [(i, t, "en") for i, t in enumerate(texts)], [])
    got = {r.doc_id: r for r in text_counts(docs).collect()}
    for i, t in enumerate(texts):
        want = counted(t)
        assert {k: got[i][k] for k in want} == want, t


def test_cutoffs_equal_plain_selection(spark):
    docs, labels = made(random.Random(5), 1500)
    labels += [(3, 1), (3, 0), (4, None), (5, 7), (9_999_999, 1)]
    docs += [(6, docs[6][1], docs[6][2])] * 2 + [(None, docs[7][1], "en")]
    got = {}
    rows, known = tables(spark, docs, labels)
    for r in certified_cutoffs(text_counts(rows), known).collect():
        got[r.stratum] = None if r.cutoffs is None else {k: v for k, v in r.cutoffs.asDict().items() if v is not None}
    want = brute_cutoffs(docs, labels, 0.03, 0.05)
    assert got == want
    assert want["en"] and want["rare"] is None  # too few labels
    verdicts = defaultdict(list)
    for r in judge_quality(rows, known).collect():
        verdicts[r.doc_id].append(r.kept)
    for i, t, lang in docs:
        c = counted(t)
        cut = want.get(lang) or {}
        assert verdicts[i][0] == (not c["base_failed"] and not any(scores(c)[k] >= v for k, v in cut.items()))
    assert sum(map(len, verdicts.values())) == len(docs)


@pytest.mark.parametrize("docs", [[], [(1, None, None)], [(1, "x " * 30, "en"), (1, "y " * 30, "en")]])
def test_odd_tables(spark, docs):
    for labels in ([], [(1, 1)], [(1, 1), (1, 0)]):
        rows, known = tables(spark, docs, labels)
        assert judge_quality(rows, known).count() == len(docs)


def test_binomial_sums(spark):
    cases = [(k, n) for n in (0, 1, 5, 19, 20, 21, 50, 400, 3000) for k in (0, 1, 2, 5, 11, 30, 80) if k <= n]
    got = spark.createDataFrame(cases, "k long, n long").select("k", "n", binomial_below(F.col("k"), F.col("n"), 0.03).alias("p")).collect()
    q = Fraction(3, 100)
    for k, n, p in got:
        exact = float(sum(math.comb(n, j) * q**j * (1 - q) ** (n - j) for j in range(k + 1)))
        assert p == 1.0 if k >= n * q else p == pytest.approx(exact, rel=1e-9)


def test_huge_holdout(spark):
    p = spark.createDataFrame([(29_000_000, 1_000_000_000)], "k long, n long").select(binomial_below(F.col("k"), F.col("n"), 0.03)).collect()[0][0]
    assert 0 <= p < 1e-300


def test_limit_is_kept(spark):
    """Over many draws, strata whose rejected share of good documents exceeds the limit are rare."""
    rng = random.Random(8)
    docs, labels = made(rng, 3000)
    rows, known = tables(spark, docs, labels)
    kept = {r.doc_id: r.kept for r in judge_quality(rows, known, limit=0.05).collect()}
    good = [(i, lang) for i, t, lang in docs if "#" not in t.rstrip("#")[:-1] or "##" not in t]
    per = defaultdict(list)
    truth = dict(labels)
    for i, lang in good:
        if truth.get(i) == 1:
            per[lang].append(not kept[i])
    assert all(sum(x) / len(x) <= 0.06 for x in per.values())
