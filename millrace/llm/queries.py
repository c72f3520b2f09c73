"""The registered queries of the operators and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (chat, decontaminate, embeddings, extract, jaccard, packing, phrases, prefix_trie, quality, sentencepieces,
               sharding, toxicity, urls)
from .common import settle, table

Query = Callable[[SparkSession, str], DataFrame]

# Words as the contracts have them: runs without ASCII white space.
WORDS_SQL = r"regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+')"

JACCARD_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, {WORDS_SQL.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(generate_series(1, len(w) - 3), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
  FROM w),
e AS (SELECT doc_id, unnest(s) AS g FROM s),
pair AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared
  FROM e x JOIN e y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
link AS (
  SELECT a, b FROM pair JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b
  WHERE 100 * shared >= 85 * (len(x.s) + len(y.s) - shared)),
both_ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (
  SELECT a, b FROM both_ways
  UNION SELECT r.a, n.b FROM reach r JOIN both_ways n ON n.a = r.b)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles,
       least(s.doc_id, coalesce((SELECT min(b) FROM reach r WHERE r.a = s.doc_id), s.doc_id)) AS component_id
FROM s
"""


def vocabulary(name: str) -> str:
    """A file of the public tokenizers."""
    import public_tokenizers
    return str(public_tokenizers.path(name))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity and grade of every document; ``toxic`` are those above grade 0."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", "expected_severity", "grade", "toxic")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = sentencepieces.encode(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids_crc32", "parity", "round_trip")


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"), width=4, num=85, den=100)


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"), limit=0.9)


# Every page is a capture, fetched at a time that follows from its number. The lists
# follow from the pages' hosts and paths: entries dated through the same year, some of
# which take the key off the list again.
def _captures(pages: DataFrame) -> DataFrame:
    seconds = F.col("page_id") * 37 % 366 * 86400 + F.col("page_id") * 7919 % 86400
    return pages.select("page_id", "url", F.timestamp_seconds(F.lit(1704067200) + seconds).alias("fetched_at"))


def _entries(pages: DataFrame) -> DataFrame:
    """Three dated entries of each host and of each host and first path segment: listed,
    taken off, listed under another category."""
    found = pages.select(F.filter(urls.keys(F.col("url"), [1]), lambda k: F.length(F.regexp_replace(k, "[^/]", "")) <= 1)
                         .alias("keys")).select(F.explode("keys").alias("key")).distinct()
    spread = F.conv(F.substring(F.md5("key"), 1, 6), 16, 10).cast("long")
    first = F.lit(1704067200) + spread % 300 * 86400
    return found.where(spread % 3 == 0).withColumn("e", F.explode(F.array(*[
        F.struct(F.lit(c).alias("category"), F.timestamp_seconds(first + d * 86400).alias("at"), F.lit(x).alias("listed"))
        for c, d, x in (("spam", 0, True), ("spam", 40, False), ("adult", 20, True))]))).select("key", "e.*")


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's capture judged by the list of its fetch time."""
    pages = table(spark, sf_dir, "pages")
    judged = urls.judge(_captures(pages), _entries(pages), "page_id", "url", "fetched_at")
    return judged.select(F.col("capture_id").alias("page_id"), F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss")
                         .alias("fetched_at"), F.array_join("categories", ",").alias("categories"), "blocked")


URLS_SQL = r"""
WITH cap AS (
  SELECT page_id, url, 1704067200 + page_id * 37 % 366 * 86400 + page_id * 7919 % 86400 AS t,
         lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host,
         list_filter(string_split(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'),
                     lambda s: s <> '') AS seg
  FROM pages),
keyed AS (
  SELECT DISTINCT page_id, t, array_to_string(string_split(host, '.')[i:], '.') AS key
  FROM cap, unnest(generate_series(1, greatest(len(string_split(host, '.')) - 1, 1))) x(i) WHERE host <> ''
  UNION
  SELECT page_id, t, host || '/' || array_to_string(seg[1:i], '/')
  FROM cap, unnest(generate_series(1, least(len(seg), 4))) x(i) WHERE host <> ''),
listed AS (
  SELECT key, 1704067200 + ('0x' || substr(md5(key), 1, 6))::BIGINT % 300 * 86400 AS first
  FROM (SELECT DISTINCT key FROM keyed WHERE length(regexp_replace(key, '[^/]', '', 'g')) <= 1)
  WHERE ('0x' || substr(md5(key), 1, 6))::BIGINT % 3 = 0),
valid AS (
  SELECT key, 'spam' AS category, first AS lo, first + 40 * 86400 AS hi FROM listed
  UNION ALL SELECT key, 'adult', first + 20 * 86400, 9000000000000 FROM listed),
hit AS (
  SELECT page_id, string_agg(DISTINCT category, ',' ORDER BY category) AS categories
  FROM keyed JOIN valid USING (key) WHERE lo <= t AND t < hi GROUP BY page_id)
SELECT page_id, strftime(make_timestamp(t * 1000000), '%Y-%m-%d %H:%M:%S') AS fetched_at,
       coalesce(categories, '') AS categories, categories IS NOT NULL AS blocked
FROM cap LEFT JOIN hit USING (page_id)
"""


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    measured = settle(quality.measures(docs).drop("text"), "measured")
    judged = quality.judge(measured, quality.cutoffs(measured, table(spark, sf_dir, "labels")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept")


def _quality_sql() -> str:
    rules, tests = [], []
    for rule in quality.RULES:
        for step, c in enumerate(rule.cutoffs):
            tests.append(f"SELECT lang, '{rule.name}' AS rule, {step} AS step, count(*) AS n, "
                         f"count(*) FILTER ({rule.scale} * {rule.left} > {c} * {rule.right}) AS k FROM good GROUP BY lang")
        cutoff = " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(rule.cutoffs))
        rules.append(f"coalesce((SELECT {rule.scale} * {rule.left} > (CASE step {cutoff} END) * {rule.right} FROM best b "
                     f"WHERE b.rule = '{rule.name}' AND b.lang IS NOT DISTINCT FROM m.lang), false)")
    alpha = quality.ALPHA / len(quality.RULES)
    return rf"""
WITH w AS (SELECT doc_id, lang, coalesce(text, '') AS t, {WORDS_SQL.format("text")} AS w FROM documents),
win AS (
  SELECT doc_id, unnest(generate_series(1, len(w) - 4)) AS i, w FROM (SELECT DISTINCT doc_id, w FROM w) WHERE len(w) >= 5),
hashed AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS h FROM win),
twice AS (SELECT doc_id, i FROM hashed QUALIFY count(*) OVER (PARTITION BY doc_id, h) > 1),
covered AS (
  SELECT doc_id, sum(least(5, coalesce(lead_i - i, 5))) AS n FROM (
    SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS lead_i FROM twice) GROUP BY doc_id),
m AS (
  SELECT doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS lines FROM w)
  LEFT JOIN covered USING (doc_id)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
good AS (
  SELECT * FROM judged WHERE NOT base_failed
  AND doc_id IN (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1)),
tests AS ({" UNION ALL ".join(tests)}),
passed AS (
  SELECT lang, rule, step FROM tests
  WHERE k < {alpha!r} * n AND (
    SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({alpha!r}) + (n - i) * ln(1 - {alpha!r})))
    FROM unnest(generate_series(0, k)) x(i)) <= {quality.DELTA!r} / (SELECT count(*) FROM tests)),
best AS (SELECT lang, rule, max(step) AS step FROM passed GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR {" OR ".join(rules)}) AS kept
FROM judged m
"""


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages"))


# Tools that the calls below are checked against.
TOOLS = {"search": {"query": ("string", True), "limit": ("integer", False)},
         "lookup": {"term": ("string", True), "exact": ("boolean", False)}}


def _tool_messages(turns: DataFrame) -> DataFrame:
    """Conversations with assistant turns as tool calls and, in even conversations, user
    turns as results of the call before. Some arguments break their schema."""
    conv, turn = F.col("conv_id"), F.col("turn")
    name = (lambda t: F.concat(F.lit("c"), conv.cast("string"), F.lit("_"), t.cast("string")))
    word = F.regexp_extract(F.coalesce("text", F.lit("")), r"^[A-Za-z]*", 0)
    is_call = F.col("role") == "assistant"
    is_result = (F.col("role") == "user") & (turn > 0) & (conv % 2 == 0)
    search = F.concat(F.lit('{"query": "'), word, F.lit('", "limit": '),
                      F.when(conv % 7 == 0, F.lit('"many"')).otherwise((turn % 10).cast("string")), F.lit("}"))
    lookup = F.concat(F.lit('{"exact": '), (conv % 3 == 0).cast("string"),
                      F.when(conv % 11 == 0, F.lit("")).otherwise(F.concat(F.lit(', "term": "'), word, F.lit('"'))),
                      F.lit("}"))
    return turns.select(
        "conv_id", "turn", F.when(is_result, F.lit("tool")).otherwise(F.col("role")).alias("role"), "text",
        F.when(is_call, name(turn)).when(is_result, name(turn - 1)).alias("id"),
        F.when(is_call, F.when(turn % 4 == 1, F.lit("search")).otherwise(F.lit("lookup"))).alias("name"),
        F.when(is_call, F.when(turn % 4 == 1, search).otherwise(lookup)).alias("arguments"),
        F.when(is_call & (turn > 2) & (conv % 3 == 0), name(turn - 2)).alias("after"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = _tool_messages(table(spark, sf_dir, "conversations"))
    return chat.format_chat(messages, TOOLS).withColumn("problems", F.array_join("problems", ","))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards whose row counts differ by one at most."""
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = sharding.shard(docs, 8, ["doc_id", "text_crc32"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op11_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


LOWER_SQL = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAMINATION_SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({LOWER_SQL.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all({LOWER_SQL.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + 9], ' ') AS g
  FROM b, unnest(generate_series(1, greatest(len(w) - 9, 1))) x(i) WHERE len(w) > 0),
pos AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT DISTINCT k FROM win), d, unnest(generate_series(1, len(w) - k + 1)) x(i)),
hit AS (SELECT doc_id, i, k, item_id FROM pos JOIN win USING (k, g)),
marked AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(generate_series(i, i + k - 1)) x(p) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN marked USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"), least=10, top=2000)


COLLOCATIONS_SQL = rf"""
WITH p AS (
  SELECT lang, w FROM (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
      SELECT coalesce(lang, 'und') AS lang,
             unnest(regexp_split_to_array({LOWER_SQL.format("text")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents))
  WHERE len(w) > 0),
f AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM (VALUES (1), (2), (3)) n(k), p, unnest(generate_series(1, len(w) - k + 1)) x(i) GROUP BY ALL),
total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE k >= 2 AND f >= 10),
cut AS (
  SELECT c.lang, c.phrase, c.a, j, l.f AS l, r.f AS r,
         1000000::HUGEINT * c.a * c.a // (l.f::HUGEINT * r.f) AS score
  FROM cand c, unnest(generate_series(1, c.k - 1)) x(j), f l, f r
  WHERE l.lang = c.lang AND l.phrase = array_to_string(c.w[1:j], ' ')
    AND r.lang = c.lang AND r.phrase = array_to_string(c.w[j + 1:], ' ')),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inside AS (
  SELECT lang, array_to_string(w[i:i + 1], ' ') AS phrase, max(a) AS longer
  FROM cand, unnest(generate_series(1, 2)) x(i) WHERE k = 3 GROUP BY ALL),
ranked AS (
  SELECT best.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM best LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""


def op13_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return prefix_trie.trie(prefix_trie.shared_openings(prefix_trie.sequences(turns)))


# crc32 of a short text, by bit, as DuckDB has no such function.
_CRC_SQL = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(CAST({0} AS VARCHAR))),
  lambda i: ord(substr(CAST({0} AS VARCHAR), i + 1, 1))::BIGINT)),
  lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END))"""

TRIE_SQL = rf"""
WITH t AS (
  SELECT conv_id, list(struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) ORDER BY turn NULLS FIRST,
    md5(CAST(octet_length(CAST(encode(coalesce(role, '')) AS BLOB)) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, ''))) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT *, xor({_CRC_SQL.format("conv_id")}, 4294967295::BIGINT) % 4 AS h FROM t),
seq AS (
  SELECT h.conv_id, list_concat(coalesce(b.turns, [])[1:h.h], h.turns[h.h + 1:]) AS s
  FROM h LEFT JOIN t b ON b.conv_id = h.conv_id - h.conv_id % 20),
member AS (SELECT conv_id, d, s[1:d] AS path, s[d] AS last, len(s) = d AS ends FROM seq, unnest(generate_series(0, len(s))) x(d)),
node AS (
  SELECT path, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         len(regexp_extract_all(coalesce(any_value(last).text, ''), '[^\x20\x09-\x0D]+')) AS words,
         coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '') AS ends
  FROM member GROUP BY path, d),
child AS (SELECT path[1:depth - 1] AS path, depth - 1 AS depth, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY ALL),
known AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN child USING (path, depth)),
below AS (
  SELECT path[1:d] AS path, d AS depth, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens
  FROM known, unnest(generate_series(0, depth)) x(d) GROUP BY ALL)
SELECT k.conv_id, CAST(k.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, k.n_convs, k.n_children,
       CAST(b.n_leaves AS BIGINT) AS n_leaves, CAST(b.saved_tokens AS BIGINT) AS saved_tokens, sha256(k.ends) AS ends_sha256
FROM known k JOIN below b ON b.path = k.path AND b.depth = k.depth
LEFT JOIN known p ON k.depth > 0 AND p.depth = k.depth - 1 AND p.path = k.path[1:k.depth - 1]
"""


QUERIES = (op1_best_fit_packing, op2_toxicity, op3_sentencepiece, op4_ngram_jaccard_join, op5_embedding_near_dedup,
           op6_url_filters, op7_quality_rules, op8_html_extraction, op9_chat_formatting, op10_sharding,
           op11_benchmark_decontamination, op12_phrase_collocations, op13_conversation_prefix_trie)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op4_ngram_jaccard_join": JACCARD_SQL, "op6_url_filters": URLS_SQL, "op7_quality_rules": _quality_sql(),
            "op11_benchmark_decontamination": DECONTAMINATION_SQL, "op12_phrase_collocations": COLLOCATIONS_SQL,
            "op13_conversation_prefix_trie": TRIE_SQL}
