"""The registered queries of this subpackage, one per operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .codes import compress_vectors
from .common import table, written
from .extraction import extract_pages
from .fingerprints import fingerprint_edits
from .mixing import mix_sources
from .neardup import near_duplicates
from .packing import pack_documents
from .quality import classify_quality
from .rules import LEVELS, LIMIT, RISK, judge_quality
from .sharding import shard_documents
from .topk import exact_top_k
from .trie import BLOCK_ROWS, prefix_trie, share_openings, turn_sequences
from .url_filter import filter_urls
from .warc import archive_round_trip

#: Name of a public vocabulary file, or a path.
TOKENIZER = "byte_bpe_50k.json"
#: Verdict and rule (host, then path) of the URL filter.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's URL."""
    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op2_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_pages(table(spark, sf_dir, "pages"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"), TOKENIZER, capacity=2048)


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best inner products of every fiftieth vector with all others."""
    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, factor=256)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A WARC record per page, written to seekable bundles and read back."""
    return archive_round_trip(table(spark, sf_dir, "pages"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards 0 to 15 of all documents, near equal in bytes."""
    placed = shard_documents(table(spark, sf_dir, "documents"), shards=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from the labels that are not held out."""
    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: two-word shingles, similarity 0.8."""
    return near_duplicates(table(spark, sf_dir, "documents"), k=2, percent=80)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all sources, weights 3, 1, 2 repeating, half as many words again as there are, two epochs at most."""
    mixed = mix_sources(table(spark, sf_dir, "documents"), weights=(3, 1, 2), budget_ratio=1.5, max_epochs=2.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical digests of every document and of its edited text."""
    return fingerprint_edits(table(spark, sf_dir, "documents"))


def conversation_trie(conversations: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The prefix trie of conversations, each opened by up to three turns of the one whose id is the next lower multiple of 20."""
    own = written(turn_sequences(conversations), "trie-own")
    turns = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")
    return prefix_trie(share_openings(own, F.col("conv_id") - F.col("conv_id") % 20, turns, most=3), block_rows)


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct beginning of the rebuilt conversations, with its members, children, leaves and saved words."""
    return conversation_trie(table(spark, sf_dir, "conversations"))


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A code of four bytes for every vector, with its error."""
    return compress_vectors(table(spark, sf_dir, "embeddings"), parts=4, entries=256, rounds=4, factor=1024)


def op13_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and the certified rules' verdict of every document."""
    return judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_extraction": op2_extraction,
    "op3_packing": op3_packing,
    "op4_top_k": op4_top_k,
    "op5_warc": op5_warc,
    "op6_sharding": op6_sharding,
    "op7_quality": op7_quality,
    "op8_minhash": op8_minhash,
    "op9_mixing": op9_mixing,
    "op10_fingerprints": op10_fingerprints,
    "op11_trie": op11_trie,
    "op12_codes": op12_codes,
    "op13_rules": op13_rules,
}


def _codes_sql(rounds: int = 4) -> str:
    """Rounds over all pairs of parts and entries; sums of whole numbers are exact in double precision here."""
    ctes = ["""v as materialized (
            select vec_id, label, list_transform(embedding, lambda x: floor(1024 * cast(x as double))) as e
            from embeddings
            where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ),
        p as materialized (select vec_id, label, q, e[q * len(e) // 4 + 1:(q + 1) * len(e) // 4] as x from v, range(4) t(q)),
        b0 as materialized (
            select q, dense_rank() over (order by vec_id) - 1 as entry, x from p
            where vec_id in (select vec_id from v order by vec_id limit 256)
        )"""]
    for r in range(rounds + 1):
        ctes.append(f"""a{r} as materialized (
            select vec_id, any_value(label) as label, q, any_value(x) as x,
                   min(struct_pack(d := list_inner_product(x, x) + list_inner_product(y, y) - 2 * list_inner_product(x, y), entry := entry)) as best
            from (select p.*, b.entry, b.x as y from p join b{r} b on b.q = p.q) group by vec_id, q
        )""")
        if r < rounds:
            ctes.append(f"""m{r} as (
            select q, entry, list(floor(total / n) order by i) as x
            from (select q, best.entry as entry, i, sum(x[i]) as total, count(*) as n from a{r}, lateral (select unnest(range(1, len(x) + 1)) as i) group by all)
            group by q, entry
        ),
        b{r + 1} as materialized (select b.q, b.entry, coalesce(m.x, b.x) as x from b{r} b left join m{r} m on m.q = b.q and m.entry = b.entry)""")
    return "with " + ",\n        ".join(ctes) + f""",
        c as (
            select vec_id, any_value(label) as label, string_agg(lpad(lower(hex(best.entry)), 2, '0'), '' order by q) as code, cast(sum(best.d) as bigint) as error
            from a{rounds} group by vec_id
        ),
        s as (select sha256(string_agg(array_to_string(list_transform(x, lambda z: cast(cast(z as bigint) as varchar)), ','), ',' order by q, entry)) as codebooks_sha256 from b{rounds})
        select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256, label from c, s"""


def _rules_sql() -> str:
    """Counts from all windows, then selection and test of the cutoffs for every level at once."""
    rules = {"symbols": "1000 * n_symbols // greatest(word_chars, 1)", "dup_lines": "1000 * n_dup_lines // greatest(n_lines, 1)", "repeats": "1000 * n_repeat_words // greatest(n_words, 1)", "upper": "1000 * n_upper // greatest(word_chars, 1)", "long_words": "10 * word_chars // greatest(n_words, 1)"}
    scores = ", ".join(f"least(1000, {e}) as {k}" for k, e in rules.items()) + ", 1000 - long_words as short_words"
    names = [*rules, "short_words"]
    hit = " or ".join(f"coalesce(s.{k} >= c.{k}, false)" for k in names)
    cuts = ", ".join(f"min(score) filter (rule = '{k}' and 1000 * good <= level * all_good) as {k}" for k in names)
    long = " union all ".join(f"select lang, quality, '{k}' as rule, {k} as score from known where selects" for k in names)
    return rf"""
        with d as (
            select doc_id, lang, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
                   list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l
            from documents
        ),
        win as (select doc_id, i, array_to_string(w[i:i + 7], ' ') as s from d, lateral (select unnest(range(1, len(w) - 6)) as i)),
        rep as (select doc_id, i from (select *, count(*) over (partition by doc_id, s) as c from win) where c > 1),
        cov as (select doc_id, count(distinct i + j) as n from rep, range(8) t(j) group by doc_id),
        f as materialized (
            select doc_id, lang, len(w) as n_words, length(array_to_string(w, '')) as word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) as n_symbols,
                   len(l) - len(list_distinct(l)) as n_dup_lines, coalesce(n, 0) as n_repeat_words, len(regexp_extract_all(t, '\p{{Lu}}')) as n_upper, len(l) as n_lines,
                   n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed
            from d left join cov using (doc_id)
        ),
        s as materialized (select *, {scores} from f),
        known as materialized (
            select s.*, quality, substr(md5(cast(doc_id as varchar)), 1, 1) < '8' as selects
            from s join (select doc_id, min(quality) as quality from labels where quality in (0, 1) group by doc_id having min(quality) = max(quality)) using (doc_id)
            where not base_failed
        ),
        h as (select lang, rule, score, sum(quality) as good, sum(1 - quality) as bad from ({long}) group by all),
        a as (
            select lang, rule, score, sum(good) over (partition by lang, rule order by score desc) as good, sum(bad) over (partition by lang, rule order by score desc) as bad,
                   sum(good) over (partition by lang, rule) as all_good
            from h
        ),
        p as (select lang, level, {cuts} from a, (select unnest({list(LEVELS)}) as level) where score > 0 and 10 * bad >= 9 * (good + bad) group by lang, level),
        k as (
            select s.lang, v.level, count(*) as n, count(*) filter ({hit}) as k
            from (select * from known where not selects and quality = 1) s cross join (select unnest({list(LEVELS)}) as level) v
            left join p c on c.lang is not distinct from s.lang and c.level = v.level
            group by s.lang, v.level
        ),
        t as (
            select *, case when k >= n * {LIMIT} then 1 else list_sum(list_transform(range(0, k + 1),
                lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({LIMIT}) + (n - j) * ln(1 - {LIMIT})))) end as below,
                count(distinct lang) over () + max(cast(lang is null as int)) over () as strata
            from k
        ),
        o as (select lang, level, bool_and(below <= {RISK} / strata) over (partition by lang order by level) as ok from t),
        c as (select p.* from p join (select lang, max(level) as level from o where ok group by lang) b on b.lang is not distinct from p.lang and b.level = p.level)
        select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_upper, n_lines, not base_failed and not ({hit}) as kept
        from s left join c on c.lang is not distinct from s.lang"""


#: DuckDB SQL of the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {
    # The tables' pages mark their article, and hold four kinds of character references.
    "op2_extraction": r"""
        with a as (select page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) as t from pages),
        b as (select page_id, url, regexp_replace(regexp_replace(t, '<br>|</?(p|h1)>', ' ', 'g'), '<[^>]*>', '', 'g') as t from a),
        c as (select page_id, url, replace(replace(replace(replace(replace(replace(t, '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', chr(1)), '&amp', chr(1)), chr(1), '&') as t from b),
        d as (select page_id, url, trim(regexp_replace(t, '\s+', ' ', 'g')) as text from c)
        select page_id, url, text, length(text) as n_chars from d""",
    "op4_top_k": """
        with v as (
            select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e
            from embeddings
            where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ),
        s as (
            select q.vec_id as query_id, c.vec_id as vec_id, cast(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) as bigint) as score
            from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0
        ),
        r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
        select query_id, cast(rank as int) as rank, vec_id, score from r where rank <= 5""",
    "op5_warc": """
        with p as (select page_id, coalesce(html, '') as html, strlen(coalesce(html, '')) as n from pages),
        q as (select *, case when n >= 1000 then max(page_id) over (partition by html) end as top from p)
        select page_id, n as payload_bytes, sha1(html) as payload_digest,
               case when top <> page_id then 'revisit' else 'response' end as record_type,
               case when top <> page_id then top end as refers_to
        from q""",
    "op8_minhash": r"""
        with recursive d as (
            select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
            from documents
        ),
        s as (
            select distinct doc_id, s from (
                select doc_id, unnest(case when len(w) < 2 then w else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end) as s from d
            )
        ),
        n as (select doc_id, count(*) as n from s group by doc_id),
        p as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
        l as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 80 * (a.n + b.n - c)),
        e as (select x, y from l union all select y, x from l),
        r as (select doc_id as x, doc_id as y from d union select r.x, e.y from r join e on r.y = e.x),
        m as (select x, min(y) as component_id from r group by x)
        select d.doc_id, coalesce(n.n, 0) as n_shingles, m.component_id, d.doc_id = m.component_id as kept
        from d join m on m.x = d.doc_id left join n on n.doc_id = d.doc_id""",
    # A beginning is a list of (role, text); CRC-32 goes through the bits of the id's digits.
    "op11_trie": r"""
        with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
        own as (select conv_id as c, list(struct_pack(role := role, text := text) order by turn nulls first) as s from t group by conv_id),
        h as (
            select c, s, c - c % 20 as base, xor(list_reduce(list_transform(string_split(cast(c as varchar), ''), lambda ch: cast(ascii(ch) as bigint)),
                lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x // 2, (x % 2) * 3988292384)), 4294967295), 4294967295) % 4 as n
            from own
        ),
        r as materialized (select h.c, list_concat(coalesce(b.s, [])[1:n], h.s[n + 1:]) as s from h left join own b on b.c = h.base),
        m as (select c, s, d, s[1:d] as p from r, lateral (select unnest(range(0, len(s) + 1)) as d)),
        nodes as materialized (
            select p, d, min(c) as conv_id, count(*) as n_convs, sha256(coalesce(string_agg(cast(c as varchar), ',' order by c) filter (len(s) = d), '')) as ends_sha256,
                   case when d = 0 then 0 else len(regexp_extract_all(p[d].text, '[^\x20\x09-\x0D]+')) end as words
            from m group by p, d
        ),
        k as (select p[1:d - 1] as p, count(*) as n from nodes where d > 0 group by all),
        w as materialized (select nodes.*, coalesce(k.n, 0) as n_children from nodes left join k using (p)),
        up as (select p[1:e] as p, n_children, n_convs, words from w, lateral (select unnest(range(0, d + 1)) as e)),
        sub as (select p, count(*) filter (n_children = 0) as n_leaves, sum((n_convs - 1) * words) as saved_tokens from up group by p)
        select w.conv_id, cast(w.d as bigint) as depth, q.conv_id as parent_conv_id, w.n_convs, w.n_children, sub.n_leaves, cast(sub.saved_tokens as bigint) as saved_tokens, w.ends_sha256
        from w join sub using (p) left join nodes q on q.p = w.p[1:w.d - 1] and w.d > 0""",
    "op12_codes": _codes_sql(),
    "op13_rules": _rules_sql(),
}
