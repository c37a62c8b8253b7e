"""The registered queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import collocations, sharding, substrings, turn_trie
from .arrow_sequences import op3_arrow_sequences
from .collocations import op11_collocations
from .media import op1_media
from .mixing import op6_mixing
from .ngram_join import op7_ngram_join
from .packing import op4_packing
from .quality_model import op2_quality_model
from .quality_rules import op9_quality_rules
from .secrets import op5_secrets
from .sharding import op10_sharding
from .substrings import op13_substring_dedup
from .turn_trie import op12_turn_trie
from .warc import op8_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    q.__name__: q
    for q in (op1_media, op2_quality_model, op3_arrow_sequences, op4_packing, op5_secrets, op6_mixing, op7_ngram_join, op8_warc, op9_quality_rules, op10_sharding, op11_collocations, op12_turn_trie, op13_substring_dedup)
}

def _sharding_sql() -> str:
    """One look-up by MD5 in the table of shards, given as a list."""
    return f"""
        WITH t AS (SELECT unnest({sharding.fill(sharding.SHARDS).tolist()}) AS shard, unnest(range(0, {sharding.SLOTS})) AS slot),
        d AS (SELECT doc_id, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) % {sharding.SLOTS} AS INTEGER) AS slot FROM documents)
        SELECT doc_id, slot, printf('shard-%03d', shard) AS shard FROM d JOIN t USING (slot)"""


#: The other queries are tested against brute force, round trips or held-out accuracy.
ORACLE_SQL: dict[str, str] = {
    "op10_sharding": _sharding_sql(),
    "op11_collocations": collocations.SQL,
    "op12_turn_trie": turn_trie.SQL,
    "op13_substring_dedup": substrings.SQL,
    "op8_warc": """
        WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS digest, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
        f AS (SELECT digest, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY digest)
        SELECT p.page_id, CAST(n AS BIGINT) AS payload_bytes, p.digest AS payload_digest,
               CASE WHEN f.first <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN f.first <> p.page_id THEN f.first END AS refers_to
        FROM p LEFT JOIN f ON p.digest = f.digest AND p.n >= 100""",
    "op9_quality_rules": r"""
        WITH w AS (SELECT doc_id, CASE WHEN lang IN ('en', 'de', 'fr', 'es') THEN lang ELSE 'other' END AS s, coalesce(text, '') AS t,
                          regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
        g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
        twice AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
        covered AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS o) GROUP BY doc_id),
        q AS (SELECT w.doc_id, s, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
                     CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
                     length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS n_capitals FROM w LEFT JOIN covered ON covered.doc_id = w.doc_id),
        v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
                     [CASE WHEN word_chars > 0 THEN least(1000, floor(1000 * n_symbols / word_chars)) ELSE 0 END, CASE WHEN n_words > 0 THEN least(1000, floor(1000 * n_repeat_words / n_words)) ELSE 0 END,
                      CASE WHEN n_lines > 0 THEN least(1000, floor(1000 * n_dup_lines / n_lines)) ELSE 0 END, CASE WHEN word_chars > 0 THEN least(1000, floor(1000 * n_capitals / word_chars)) ELSE 0 END,
                      CASE WHEN n_words > 0 THEN least(1000, floor(20 * word_chars / n_words)) ELSE 100 END, CASE WHEN n_words > 0 THEN greatest(0, 200 - floor(20 * word_chars / n_words)) ELSE 100 END] AS vals FROM q),
        l AS (SELECT *, list_min(list_transform(range(1, 7), lambda r: 21 - len(list_filter(range(0, 21), lambda t: vals[r] > [200, 500, 500, 300, 200, 160][r] - ([190, 400, 350, 260, 80, 45][r] * t) // 20)))) AS lev FROM v),
        good AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
        h AS (SELECT s, lev FROM l JOIN good USING (doc_id) WHERE NOT base_failed),
        need AS (SELECT CAST(ceil(ln(0.05 / 5) / ln(1 - 0.01)) AS BIGINT) AS need),
        sizes AS (SELECT s, row_number() OVER (ORDER BY n, s) AS k, n FROM (SELECT s, count(*) AS n FROM h GROUP BY s)),
        walk AS (WITH RECURSIVE r AS (
                   SELECT CAST(0 AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS s, CAST(0 AS BIGINT) AS m, CAST(0 AS BIGINT) AS pos, CAST(0 AS HUGEINT) AS total
                   UNION ALL
                   SELECT z.k, z.s, r.pos, CASE WHEN r.total + z.n >= need THEN r.pos + 1 ELSE r.pos END, CASE WHEN r.total + z.n >= need THEN 0 ELSE r.total + z.n END FROM r JOIN sizes z ON z.k = r.k + 1, need)
                 SELECT * FROM r WHERE k > 0),
        merged AS (SELECT s, least(m, greatest((SELECT max(pos) FROM walk) - 1, 0)) AS m, greatest((SELECT max(pos) FROM walk), 1) AS strata FROM walk),
        tried AS (SELECT m, strata, t, count(*) AS n, count(*) FILTER (lev <= t) AS k FROM h JOIN merged USING (s), (SELECT unnest(range(0, 21)) AS t) GROUP BY ALL),
        chosen AS (SELECT m, max(t) AS t FROM tried
                   WHERE k < n * 0.01 AND list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.01) + (n - i) * ln(0.99)))) <= 0.05 / strata GROUP BY m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(lev <= chosen.t, false) AS kept
        FROM l LEFT JOIN merged USING (s) LEFT JOIN chosen USING (m)""",
}
