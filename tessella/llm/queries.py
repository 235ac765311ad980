"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import fill_in_middle, fingerprints, html_extract, langid, minhash, mixing, packing, pii, prefix_trie, quality_classifier, quality_rules, secrets, sentencepiece_codec
from .common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tokenizer(name: str) -> str:
    """Where a public vocabulary file lies; the default of the path parameters."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(read_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, added=packing.added_tokens(tokenizer("byte_bpe_50k.json")))


def op2_streaming_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_table(read_table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


QUERIES["op1_word_backoff"] = langid.query
QUERIES["op2_streaming_viterbi"] = op2_streaming_viterbi
QUERIES["op3_line_frequency"] = quality_rules.query
QUERIES["op4_bag_minhash"] = minhash.query
QUERIES["op5_order_minhash"] = fingerprints.query
QUERIES["op6_minimum_cut"] = html_extract.query
QUERIES["op7_feistel_pseudonyms"] = pii.query
QUERIES["op8_pattern_packing"] = op8_pattern_packing
QUERIES["op9_weak_labels"] = quality_classifier.query
QUERIES["op10_secret_ledger"] = secrets.query
QUERIES["op11_hash_threshold"] = mixing.query
QUERIES["op12_learned_index"] = fill_in_middle.query
QUERIES["op13_perfect_hash_trie"] = prefix_trie.query

#: The rules' SQL; 15 digits of the MD5 stand for the hash of a line.
ORACLES["op3_line_frequency"] = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, source, text, list_filter(string_split_regex(text, '[ \x09-\x0d]+'), lambda x: x <> '') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \x09-\x0d]')) AS lines FROM d),
g AS (SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM g),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (VALUES (0), (1), (2)) t(k) WHERE n > 1 GROUP BY doc_id),
l AS (SELECT doc_id, source, text, len(list_filter(string_split_regex(line, '[ \x09-\x0d]+'), lambda x: x <> '')) AS n, substr(md5(regexp_replace(trim(regexp_replace(lower(line), '[ \x09-\x0d]+', ' ', 'g')), '[0-9]+', '0', 'g')), 1, 15) AS h FROM (SELECT doc_id, source, text, unnest(lines) AS line FROM w)),
f AS (SELECT source, h FROM (SELECT DISTINCT source, h, text FROM l) GROUP BY source, h HAVING count(*) > 20),
gone AS (SELECT doc_id, sum(n) AS n FROM l JOIN f ON l.h = f.h AND l.source IS NOT DISTINCT FROM f.source GROUP BY doc_id),
b AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(ws) - coalesce(gone.n, 0) AS BIGINT) AS words_left FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN gone USING (doc_id)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT *, NOT base_failed AND 100 * words_left >= 30 * n_words AS kept FROM v
"""


def mixing_sql() -> str:
    """The mix by sorting: the running size by hash within a source against its budget, a round for each threshold."""
    head = r"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce('=' || source, '~') AS key, CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[ \x09-\x0d]+'), lambda x: x <> '')) AS BIGINT) AS size, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || CAST(length(coalesce(text, '')) AS VARCHAR)), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT key, CAST(sum(size) AS BIGINT) AS source_size, CAST(2 * sum(size) AS BIGINT) AS bound, [5, 2, 1][CAST((row_number() OVER (ORDER BY key) - 1) % 3 + 1 AS INT)] AS w FROM d GROUP BY key),
o AS (SELECT *, row_number() OVER r AS k, sum(bound) OVER r - bound AS caps, sum(w) OVER () - (sum(w) OVER r - w) AS free, 1.5 * sum(source_size) OVER () AS goal FROM s WINDOW r AS (ORDER BY bound / w, key ROWS UNBOUNDED PRECEDING)),
l AS (SELECT (CAST(goal AS DOUBLE) - caps) / free AS level FROM o WHERE (CAST(goal AS DOUBLE) - caps) / free * w <= bound ORDER BY k LIMIT 1),
t AS (SELECT key, source_size, CASE WHEN level * w > bound THEN CAST(bound AS DOUBLE) ELSE level * w END AS target FROM s, l),
s0 AS MATERIALIZED (SELECT key, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole, CAST(floor(target) AS BIGINT) - (CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END) * source_size AS budget, CAST(-1 AS BIGINT) AS from_h, false AS ended FROM t)"""
    turn = """,
c{k} AS MATERIALIZED (SELECT d.*, budget, sum(size) OVER (PARTITION BY key ORDER BY h ROWS UNBOUNDED PRECEDING) AS upto FROM d JOIN s{j} USING (key) WHERE NOT ended AND budget > 0 AND budget >= {near} * target AND size BETWEEN 1 AND budget AND h > from_h),
s{k} AS MATERIALIZED (SELECT key, source_size, target, whole, budget - coalesce(fits, 0) AS budget, coalesce(to_h, from_h) AS from_h, ended OR to_h IS NULL AS ended FROM s{j} LEFT JOIN (SELECT key, min(h) FILTER (upto > budget) AS to_h, max(upto) FILTER (upto <= budget) AS fits FROM c{k} GROUP BY key) USING (key))"""
    more = " UNION ALL ".join(f"SELECT doc_id, h FROM c{k} WHERE upto <= budget" for k in range(1, mixing.ROUNDS + 1))
    tail = f"""
SELECT d.doc_id, d.size, CAST(source_size AS BIGINT) AS source_size, target, CAST(d.size * (whole + CASE WHEN m.h IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS taken
FROM d JOIN s0 USING (key) LEFT JOIN ({more}) m ON m.doc_id = d.doc_id AND m.h = d.h
"""
    return head + "".join(turn.format(j=k - 1, k=k, near=mixing.NEAR) for k in range(1, mixing.ROUNDS + 1)) + tail


ORACLES["op11_hash_threshold"] = mixing_sql()

ORACLES["op12_learned_index"] = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
h AS (SELECT doc_id, text, CAST(length(text) AS BIGINT) AS n, CAST('0x' || substr(d, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(d, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(d, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(d, 25, 8) AS BIGINT) AS h4 FROM t),
c AS (SELECT doc_id, text, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b, CASE WHEN n = 0 OR h3 % 100 >= 90 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substr(text, 1, a) AS prefix, substr(text, a + 1, b - a) AS middle, substr(text, b + 1) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""

#: A node's sums run over its members' paths, in which each node below counts once, for its smallest member.
ORACLES["op13_perfect_hash_trie"] = """
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS p, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT c, c - c % 20 AS f, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda x, y: list_reduce(list_prepend(xor(x, y), range(8)), lambda a, b: xor(a >> 1, 3988292384 * (a & 1)))), 4294967295) % 4 AS h FROM (SELECT DISTINCT c FROM t)),
g AS (SELECT k.c, k.f, k.h, least(k.h, coalesce(n, 0)) AS head FROM k LEFT JOIN (SELECT c, count(*) AS n FROM t GROUP BY c) b ON b.c = k.f),
r AS (SELECT g.c, p + 1 AS d, role, text FROM g JOIN t ON t.c = g.f WHERE p < head UNION ALL SELECT g.c, p - h + head + 1, role, text FROM g JOIN t ON t.c = g.c WHERE p >= h),
w AS (SELECT c, d, md5(CAST(list(md5(CAST(length(role) AS VARCHAR) || ':' || role || text)) OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING) AS VARCHAR)) AS id, len(list_filter(string_split_regex(text, '[ \\x09-\\x0d]+'), lambda x: x <> '')) AS words FROM r UNION ALL SELECT c, 0, '', 0 FROM g),
v AS (SELECT *, lag(id) OVER (PARTITION BY c ORDER BY d) AS up, d = max(d) OVER (PARTITION BY c) AS ends FROM w),
n AS (SELECT id, min(c) AS conv_id, any_value(d) AS depth, any_value(up) AS up, count(*) AS n_convs, any_value(words) AS words, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM v GROUP BY id),
m AS (SELECT n.*, u.conv_id AS parent_conv_id, coalesce(ch.n, 0) AS n_children FROM n LEFT JOIN n u ON u.id = n.up LEFT JOIN (SELECT up, count(*) AS n FROM n GROUP BY up) ch ON ch.up = n.id),
s AS (SELECT v.id, sum(CASE WHEN v.c = m.conv_id AND n_children = 0 THEN 1 ELSE 0 END) OVER z AS leaves, sum(CASE WHEN v.c = m.conv_id THEN (n_convs - 1) * m.words ELSE 0 END) OVER z AS saved FROM v JOIN m USING (id) WINDOW z AS (PARTITION BY v.c ORDER BY v.d DESC ROWS UNBOUNDED PRECEDING))
SELECT conv_id, CAST(depth AS BIGINT) AS depth, parent_conv_id, CAST(n_convs AS BIGINT) AS n_convs, CAST(n_children AS BIGINT) AS n_children, CAST(x.leaves AS BIGINT) AS n_leaves, CAST(x.saved AS BIGINT) AS saved_tokens, ends_sha256
FROM m JOIN (SELECT id, sum(leaves) AS leaves, sum(saved) AS saved FROM s GROUP BY id) x USING (id)
"""
