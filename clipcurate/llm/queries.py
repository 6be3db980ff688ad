"""The operators as queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipcurate.llm import embedding_dedup, exact_dedup, filter_audit, mixing, packing, pii, prefix_trie, quality_rules, sharding, simhash, toxicity, url_filter, warc
from clipcurate.llm.common import scratch_path, spread, table

HOST_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Rules for hosts of advertisements and adult content, which the host rules above overrule.
PATTERN_RULES = ("|ads-track.", "|adult-x.", "/ads/", "/adult/")

PSEUDONYM_KEY = "spark.clipcurate.pseudonym.key"


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [url_filter.prefix_rule(r, a, rank=1) for a, r in HOST_RULES] + [url_filter.wildcard_rule(r, "block") for r in PATTERN_RULES]
    v = F.col("url_verdict")
    judged = url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return judged.select("page_id", v.host.alias("host"), v.path.alias("path"), F.when(v["rank"] == 1, v.rule).alias("rule"), v.verdict.alias("verdict"))


OP1_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(action, host, path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
f AS (SELECT h.page_id, h.host, h.path, r.host || r.path AS rule, r.action, row_number() OVER (PARTITION BY h.page_id ORDER BY length(r.host || r.path) DESC NULLS LAST) AS k
  FROM h LEFT JOIN r ON (h.host = r.host OR h.host LIKE '%.' || r.host) AND starts_with(h.path, r.path))
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN regexp_matches(host || path, '(^|\.)(ads-track|adult-x)\.') OR contains(host || path, '/ads/') OR contains(host || path, '/adult/') THEN 'block' ELSE 'allow' END) AS verdict
FROM f WHERE k = 1
"""


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("toxicity")
    scored = toxicity.toxicity_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", t.held_out.alias("held_out"), t.score.alias("score"), t.predicted.alias("predicted"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embedding_dedup.embedding_components(table(spark, sf_dir, "embeddings"))
    return found.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


OP3_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE embedding IS NOT NULL),
n AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v WHERE list_dot_product(e, e) > 0 AND isfinite(list_dot_product(e, e))),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a, n b WHERE a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) >= 0.95),
c(node, other) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT c.node, l.b FROM c JOIN l ON c.other = l.a)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id) AS n_links, min(c.other) AS component_id, min(c.other) = e.vec_id AS kept
FROM embeddings e JOIN c ON c.node = e.vec_id GROUP BY e.vec_id
"""


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, path = F.col("placement"), scratch_path(spark, "shards")
    placed = sharding.shuffle_into_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), shards=8)
    sharding.write_shards(placed, path)
    written, text = sharding.read_shards(spark, path, placed.schema), F.coalesce("text", F.lit(""))
    return written.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"),
        p.shard.alias("shard"), p.slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP5_SQL = """
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256 FROM t WINDOW w AS (PARTITION BY text_sha256)
"""


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, sf_dir, "documents"), shingle=4, radius=4)
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "source", "copies")


def op9_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = [F.col(f"pii.{k}").alias(f"n_{k}") for k in pii.KINDS]
    key = spark.conf.get(PSEUDONYM_KEY, "a key for synthetic tables only")  # real corpora: set a secret
    return pii.pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), key).select("doc_id", "text", *kinds)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    index = warc.write_warc(warc.warc_records(table(spark, sf_dir, "pages")), path)
    return warc.read_records(index, path).drop("payload", "url")


OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, strlen(payload) AS payload_bytes, sha1(payload) AS h FROM p),
b AS (SELECT page_id, payload_bytes, translate(
  to_base(('0x' || substr(h, 1, 15))::BIGINT, 32, 12) || to_base(('0x' || substr(h, 16, 15))::BIGINT, 32, 12) || to_base(('0x' || substr(h, 31, 10))::BIGINT, 32, 8),
  '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest FROM d),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM m
"""


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations")).drop("key", "parent")


OP11_SQL = """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(role)::VARCHAR || ':' || role || text)) AS k FROM c),
b AS (SELECT DISTINCT conv_id, conv_id - conv_id % 100 AS base, list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ascii(substr(conv_id::VARCHAR, i, 1))::BIGINT) AS bytes FROM c),
i AS (SELECT conv_id, base, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda a, x:
  list_reduce(list_prepend(xor(a, x), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda r, z: xor(r >> 1, 3988292384 * (r & 1)))), 4294967295) % 6 AS h FROM b),
r AS (SELECT i.conv_id, k, role, text FROM i JOIN k ON k.conv_id = i.base WHERE k <= h UNION ALL SELECT conv_id, k, role, text FROM i JOIN k USING (conv_id) WHERE k > h),
p AS (SELECT conv_id, coalesce(p, []) AS p FROM i LEFT JOIN (SELECT conv_id, list({'role': role, 'text': text} ORDER BY k) AS p FROM r GROUP BY conv_id) USING (conv_id)),
e AS (SELECT conv_id, p, unnest(range(0, len(p) + 1)) AS d FROM p),
n AS (SELECT p[1:d] AS q, d, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (d = len(p)), '') AS ends FROM e GROUP BY 1, 2),
u AS (SELECT q[1:d - 1] AS q, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN d > 0 THEN (n_convs - 1) * length(q[d].text) ELSE 0 END AS saved FROM n LEFT JOIN u USING (q)),
s AS (SELECT q[1:a] AS q, sum((n_children = 0)::INT)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM m) GROUP BY 1)
SELECT m.conv_id, m.d AS depth, o.conv_id AS parent_conv_id, m.n_convs, m.n_children, s.n_leaves, s.saved_tokens, sha256(m.ends) AS ends_sha256
FROM m JOIN s USING (q) LEFT JOIN n o ON m.d > 0 AND o.q = m.q[1:m.d - 1]
"""


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    words = quality_rules.split_words(t)
    capitals = F.length(t) - F.length(F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    filters = {
        "A": F.size(words) < 50, "B": quality_rules.let(words, lambda w: 100 * F.size(F.array_distinct(w)) < 65 * F.size(w)), "C": 100 * capitals > 5 * F.length(t),
        "D": t.rlike("[#$%&*|]"), "E": filter_audit.REPEATS,
    }
    return filter_audit.audit_filters(spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source")), table(spark, sf_dir, "labels"), filters)


OP12_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x FROM documents),
w AS (SELECT *, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY x) AS first FROM t),
m AS (SELECT doc_id, part, (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT + 4 * (100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 5 * length(x))::INT
  + 8 * regexp_matches(x, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first, false)::INT AS mask FROM w),
g AS (SELECT doc_id, max((quality IS NOT DISTINCT FROM 1)::INT) AS good, max((toxic IS NOT DISTINCT FROM 1)::INT) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM m LEFT JOIN g USING (doc_id) GROUP BY part, mask),
f(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
  AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
s AS (SELECT filter_order, s.step::INT AS step, bits[s.step] AS bit, coalesce(list_sum(bits[1:s.step - 1]), 0)::INT AS gone FROM o, range(1, 6) s(step)),
r AS (SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (mask & (gone | bit) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (mask & gone = 0 AND mask & bit > 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (mask & gone > 0 AND mask & bit > 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (mask & gone = 0 AND mask & bit > 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (mask & gone = 0 AND mask & bit > 0), 0)::BIGINT AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r
"""


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judge_quality(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return found.select("doc_id", *counts, "base_failed", "kept", F.round("quality", 4).alias("quality"))


def _op13_sql(rules: tuple[quality_rules.Rule, ...] = quality_rules.RULES, prior: quality_rules.Prior = quality_rules.Prior(), rounds: int = 30) -> str:
    """The measures by plain SQL, the rounds of expectation-maximisation as a recursive query over patterns of votes."""
    k, (a, a_n), (b, b_n), (g, g_n) = len(rules), prior.right_on_good, prior.right_on_bad, prior.good
    votes = ", ".join(f"CASE WHEN {r.bad} THEN -1 WHEN {r.good} THEN 1 ELSE 0 END" for r in rules)
    odds = "ln(m.good / (1 - m.good)) + list_sum(list_transform(range(1, {0}), lambda j: CASE v[j] WHEN 1 THEN ln(m.a[j] / (1 - m.b[j])) WHEN -1 THEN ln((1 - m.a[j]) / m.b[j]) ELSE 0.0 END))".format(k + 1)
    shares = lambda vote, weight, at, n: "[" + ", ".join(f"(sum(CASE WHEN v[{j}] = {vote} THEN {weight} ELSE 0.0 END) + {at * n!r}) / (sum(CASE WHEN v[{j}] <> 0 THEN {weight} ELSE 0.0 END) + {n!r})" for j in range(1, k + 1)) + "]::DOUBLE[]"
    return rf"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
w AS (SELECT *, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(x, chr(10)), lambda y: regexp_matches(y, '[^\x20\x09-\x0D]')) AS l FROM t),
p AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g, unnest(range(1, len(w) - 1)) AS i FROM w),
c AS (SELECT doc_id, count(DISTINCT i + d) AS n_repeat_words FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS k FROM p), (VALUES (0), (1), (2)) v(d) WHERE k > 1 GROUP BY doc_id),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(x, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(l) AS n_lines, length(regexp_replace(x, '[^A-Z]', '', 'g')) AS n_upper,
  len(list_filter(w, lambda y: regexp_matches(y, '\p{{L}}'))) AS n_alpha_words, len(list_filter(w, lambda y: regexp_matches(y, '{quality_rules.PLAIN_WORD.replace("'", "''")}'))) AS n_plain_words,
  len(list_filter(l, lambda y: regexp_matches(y, '{quality_rules.ENDED_LINE.replace("'", "''")}'))) AS n_ended_lines, length(regexp_replace(x, '[^0-9]', '', 'g')) AS n_digits
  FROM w LEFT JOIN c USING (doc_id)),
v AS (SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({quality_rules.BASE_FAILS}) AS base_failed, [{votes}] AS v FROM m),
n AS (SELECT v, count(*)::DOUBLE AS n FROM v WHERE NOT base_failed GROUP BY v),
em(r, m) AS (SELECT 0, {{'good': {g!r}::DOUBLE, 'a': {[a] * k}::DOUBLE[], 'b': {[b] * k}::DOUBLE[]}} UNION ALL
  SELECT any_value(r) + 1, {{'good': ((coalesce(sum(n * p), 0.0) + {g * g_n!r}) / (coalesce(sum(n), 0.0) + {g_n!r}))::DOUBLE, 'a': {shares(1, "n * p", a, a_n)}, 'b': {shares(-1, "n * (1 - p)", b, b_n)}}}
  FROM (SELECT r, n, v, 1 / (1 + exp(-({odds}))) AS p FROM em, n WHERE r < {rounds}) GROUP BY r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND p >= 0.5 AS kept, CASE WHEN NOT base_failed THEN round(p, 4) END AS quality
FROM (SELECT v.*, 1 / (1 + exp(-({odds}))) AS p FROM v, em WHERE r = {rounds})
"""


OP13_SQL = _op13_sql()


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f for f in (op1_url_filter, op2_toxicity, op3_embedding_dedup, op4_sharding, op5_exact_dedup, op6_best_fit_packing, op7_simhash_dedup, op8_source_mixing, op9_pii_pseudonyms, op10_warc,
                               op11_conversation_trie, op12_filter_audit, op13_quality_rules, pipeline)
}
SQL = {"op1_url_filter": OP1_SQL, "op5_exact_dedup": OP5_SQL, "op10_warc": OP10_SQL, "op3_embedding_dedup": OP3_SQL, "op11_conversation_trie": OP11_SQL, "op12_filter_audit": OP12_SQL, "op13_quality_rules": OP13_SQL}
