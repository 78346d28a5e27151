"""The ten queries of the subpackage, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from quadrille.llm.dedup import repeated_bytes, repeated_words
from quadrille.llm.leaks import find_leaks
from quadrille.llm.ngrams import score_texts
from quadrille.llm.pieces import encode_pieces
from quadrille.llm.quality import Limits, quality_measures
from quadrille.llm.quotes import link_quotes
from quadrille.llm.shards import kd_shards
from quadrille.llm.simhash import simhash_components
from quadrille.llm.spark_io import table
from quadrille.llm.urls import RULES, judge_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: SQL for the words of a text.
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def query(name: str, oracle: str | None = None):
    def register(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return register


_L = Limits()


def _covered(m: int) -> str:
    """SQL: by document, the words in m-word windows that the document has twice or more."""
    return f"""
    SELECT doc_id, count(DISTINCT p) AS n FROM (
      SELECT doc_id, unnest(range(i, i + {m})) AS p FROM (
        SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, h) AS c FROM (
          SELECT doc_id, unnest(range(1, len(w) - {m} + 2)) AS i, hash(list_slice(w, i, i + {m} - 1)) AS h FROM d WHERE len(w) >= {m}))
      WHERE c > 1) GROUP BY doc_id"""


@query("op1_sentencepiece")
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(table(spark, sf_dir, "documents", ["doc_id", "text"]))


@query("op2_latent_decontamination")
def op2_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents", ["doc_id", "text"]), table(spark, sf_dir, "benchmark"))


_MARKS = r"^(\s*>)+ ?"
_NORM = r"lower(trim(regexp_replace({}, '\s+', ' ', 'g')))"


@query(
    "op3_quotation_linking",
    rf"""
    WITH m AS (SELECT conv_id AS c, turn AS t, role, coalesce(text, '') AS text FROM conversations),
    l AS (SELECT c, t, i, length(regexp_replace(regexp_extract(x, '{_MARKS}'), '[^>]', '', 'g')) AS level, regexp_replace(x, '{_MARKS}', '') AS said
      FROM (SELECT c, t, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS i FROM m)),
    b AS (SELECT c, t, trim(coalesce(string_agg(said, chr(10) ORDER BY i) FILTER (WHERE level = 0), '')) AS body FROM l GROUP BY c, t),
    runs AS (SELECT c, t, level, {_NORM.format("string_agg(said, chr(10) ORDER BY i)")} AS q
      FROM (SELECT *, i - row_number() OVER (PARTITION BY c, t, level ORDER BY i) AS island FROM l) WHERE level > 0 GROUP BY c, t, level, island),
    bw AS (SELECT c, t, string_split({_NORM.format("body")}, ' ') AS w FROM b),
    says AS (SELECT DISTINCT c, t, {_NORM.format("x")} AS q FROM (SELECT c, t, body AS x FROM b UNION ALL SELECT c, t, unnest(regexp_split_to_array(body, '\n\s*\n')) FROM b UNION ALL SELECT c, t, unnest(string_split(body, chr(10))) FROM b)
      UNION SELECT c, t, array_to_string(list_slice(w, i, i + 4), ' ') FROM (SELECT c, t, w, unnest(range(1, len(w) - 3)) AS i FROM bw WHERE len(w) >= 5)),
    quotes AS (SELECT row_number() OVER () AS r, c, t, level, q, string_split(q, ' ') AS w FROM runs WHERE q <> ''),
    parts AS (SELECT r, c, t, level, q AS p FROM quotes WHERE len(w) < 5
      UNION ALL SELECT r, c, t, level, array_to_string(list_slice(w, i, i + 4), ' ') FROM (SELECT *, unnest(range(1, len(w) - 3, 5)) AS i FROM quotes WHERE len(w) >= 5)
      UNION ALL SELECT r, c, t, level, array_to_string(list_slice(w, len(w) - 4, len(w)), ' ') FROM quotes WHERE len(w) >= 5 AND len(w) % 5 <> 0),
    named AS (SELECT r, c, t, level, (SELECT max(s.t) FROM says s WHERE s.c = p.c AND s.q = p.p AND s.t < p.t) AS original FROM parts p),
    votes AS (SELECT r, c, t, level, original, count(*) AS n, sum(count(*)) OVER (PARTITION BY r) AS of FROM named GROUP BY r, c, t, level, original),
    found AS (SELECT c, t, level, CASE WHEN 2 * max(n) FILTER (WHERE original IS NOT NULL) >= max(of) THEN arg_max(original, n * 1000000000 + original) END AS original FROM votes GROUP BY r, c, t, level),
    links AS (SELECT c, t, count(*) AS n_quotes, count(original) AS n_linked, max(original) FILTER (WHERE level = low) AS replied
      FROM (SELECT *, min(level) FILTER (WHERE original IS NOT NULL) OVER (PARTITION BY c, t) AS low FROM found) GROUP BY c, t),
    p AS (SELECT b.c, b.t, body, replied, coalesce(n_quotes, 0) AS n_quotes, coalesce(n_linked, 0) AS n_linked, lag(b.t) OVER w AS prior, row_number() OVER w AS pos
      FROM b LEFT JOIN links k ON b.c = k.c AND b.t = k.t WINDOW w AS (PARTITION BY b.c ORDER BY b.t)),
    s AS (SELECT *, CASE WHEN prior IS NULL OR coalesce(replied, prior) <> prior THEN pos END AS head FROM p),
    h AS (SELECT *, max(head) OVER (PARTITION BY c ORDER BY t) AS begun FROM s)
    SELECT h.c AS conv_id, h.t AS turn, m.role, coalesce(replied, prior, -1) AS parent_turn, (SELECT x.t FROM h x WHERE x.c = h.c AND x.pos = h.begun) AS branch, h.pos - begun AS place,
      CAST(n_quotes AS BIGINT) AS n_quotes, CAST(n_linked AS BIGINT) AS n_linked, body AS message, '<|' || m.role || '|>' || chr(10) || body || chr(10) AS chat
    FROM h JOIN m ON m.c = h.c AND m.t = h.t""",
)
def op3_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = link_quotes(table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"]))
    return linked.withColumn("parent_turn", F.coalesce("parent_turn", F.lit(-1)))  # -1: it answers nobody


@query(
    "op4_suffix_repetition",
    f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
    r5 AS ({_covered(_L.window)}), r10 AS ({_covered(_L.repeat_words)}), far AS ({_covered(_L.longest + 1)}),
    b AS (
      SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))
           - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(r5.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(r10.n, 0) AS BIGINT) AS covered_words,
        far.n IS NOT NULL AS too_long
      FROM d LEFT JOIN r5 ON d.doc_id = r5.doc_id LEFT JOIN r10 ON d.doc_id = r10.doc_id LEFT JOIN far ON d.doc_id = far.doc_id),
    f AS (SELECT *, n_words < {_L.least_words} OR 100 * n_repeat_words > {_L.window_percent} * n_words AS base_failed FROM b)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
      NOT base_failed AND 100 * covered_words <= {_L.covered_percent} * n_words AND NOT too_long AS kept, covered_words
    FROM f""",
)
def op4_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_measures(table(spark, sf_dir, "documents", ["doc_id", "text"])).drop("longest_repeat")


@query("op5_simhash_pivots")
def op5_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents", ["doc_id", "text"]))


@query(
    "op6_bucket_pointer_dedup",
    """
    WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
    win AS (SELECT doc_id, i, md5(substr(x, 2 * i - 1, 200)) AS h FROM (SELECT doc_id, x, unnest(range(1, n - 98)) AS i FROM d WHERE n >= 100)),
    again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS k FROM win) WHERE k > 1),
    fresh AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER w <= 100 THEN 0 ELSE 1 END AS begins FROM again WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
    spans AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM (SELECT doc_id, i, sum(begins) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM fresh) GROUP BY doc_id, r),
    ends AS (SELECT doc_id, a, b FROM spans UNION ALL SELECT doc_id, n + 1, n + 1 FROM d),
    gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a, b), 1) AS from_b FROM ends),
    kept AS (SELECT g.doc_id, sum(b - a) AS n_removed, count(*) - 1 AS n_spans, string_agg(substr(x, 2 * from_b - 1, 2 * (a - from_b)), '' ORDER BY a, b) AS t
      FROM gaps g JOIN d ON d.doc_id = g.doc_id GROUP BY g.doc_id)
    SELECT d.doc_id, d.n AS n_bytes, CAST(n_removed AS BIGINT) AS n_removed, CAST(n_spans AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept.t, ''))) AS kept_sha256
    FROM d JOIN kept ON kept.doc_id = d.doc_id""",
)
def op6_bucket_pointer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes(table(spark, sf_dir, "documents", ["doc_id", "text"]))


@query(
    "op7_fm_index_dedup",
    f"""
    WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
    win AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 19), ' ')) AS h FROM (
      SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
    again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS k FROM win) WHERE k > 1),
    gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM again),
    lists AS (SELECT doc_id, count(*) AS n, list(p) AS ps FROM gone GROUP BY doc_id),
    kept AS (SELECT d.doc_id, string_agg(x.word, ' ' ORDER BY x.p) AS t FROM (
        SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) x
      JOIN d ON x.doc_id = d.doc_id LEFT JOIN gone ON gone.doc_id = x.doc_id AND gone.p = x.p WHERE gone.p IS NULL GROUP BY d.doc_id)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(lists.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
    FROM d LEFT JOIN lists ON d.doc_id = lists.doc_id LEFT JOIN kept ON d.doc_id = kept.doc_id""",
)
def op7_fm_index_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_words(table(spark, sf_dir, "documents", ["doc_id", "text"]))


_RULE_ROWS = ", ".join(f"('{v}', '{r[: r.find('/')]}', '{r[r.find('/') :]}')" for v, r in RULES)


@query(
    "op8_bloom_cascade",
    f"""
    WITH rules(verdict, h, p) AS (VALUES {_RULE_ROWS}),
    u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    s AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            substr(regexp_extract(rest, '^[^?#]*'), length(regexp_extract(rest, '^[^/?#]*')) + 1) AS path FROM u),
    f AS (SELECT page_id, arg_max(rules.h || rules.p, length(rules.h || rules.p)) AS rule, arg_max(rules.verdict, length(rules.h || rules.p)) AS verdict
          FROM s JOIN rules ON (host = rules.h OR ends_with(host, '.' || rules.h)) AND starts_with(path, rules.p) GROUP BY page_id)
    SELECT s.page_id, host, path, f.rule, coalesce(f.verdict, 'allow') AS verdict FROM s LEFT JOIN f ON s.page_id = f.page_id""",
)
def op8_bloom_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages", ["page_id", "url"]))


@query("op9_kd_tree_shards")
def op9_kd_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards(table(spark, sf_dir, "documents", ["doc_id", "text", "lang"]))


@query("op10_kneser_ney")
def op10_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents", ["doc_id", "text"]))
