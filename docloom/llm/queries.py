"""The registered queries of this subpackage and, where SQL can express them, their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import convrepair, decontam, htmltext, langid, mixing, quality, resample, simhash, substrings, tokencount, tokenstore, urlfilter, warc
from docloom.llm.common import scratch_path, table

#: Where the public vocabularies lie; None: the installed package that carries them.
TOKENIZER_DIR: str | None = None


def vocabulary(name: str) -> str:
    if TOKENIZER_DIR is not None:
        return f"{TOKENIZER_DIR}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all documents to the weights 5, 2, 1."""
    return mixing.mix_plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents to a store of token ids and read it back."""
    path = scratch_path(spark, "tokens")
    tokenstore.write_store(table(spark, sf_dir, "documents"), path, vocabulary("byte_bpe_50k.json"))
    tokenstore.check_manifest(spark, path)
    return tokenstore.read_checksums(spark, path)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge all documents against the whole benchmark in windows of 13 words."""
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge the urls of all pages by the four rules."""
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"), urlfilter.rule_table(spark), "page_id")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token counts of all documents under the 32k piece vocabulary."""
    return tokencount.token_counts(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return htmltext.main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their groups within 4 bits."""
    found = simhash.near_copies(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, fertility of the 32k piece vocabulary, and the verdict for all documents."""
    rated = quality.rate(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))
    return rated.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_tokens", "fertility", "fallback", "entropy"
    )


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cut 50-byte strings of all documents that documents with smaller ids hold."""
    return substrings.cut_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train on the documents that are not held out, then label all documents."""
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.learn(docs.select("doc_id", "text", "lang")))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draw a quarter of all documents towards the benchmark's word runs."""
    found = resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op12_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages to WARC archives, equal payloads once, and read the archives back."""
    pages, path = table(spark, sf_dir, "pages"), scratch_path(spark, "warc")
    warc.write_archives(pages, path)
    found = warc.read_records(spark, path, pages.schema["page_id"].dataType.simpleString())
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damage all conversations and repair them by the cheapest edits."""
    conversations = table(spark, sf_dir, "conversations")
    return convrepair.audit_conversations(conversations, convrepair.damage(conversations))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_token_store": op2_token_store,
    "op3_decontaminate": op3_decontaminate,
    "op4_url_filter": op4_url_filter,
    "op5_token_counts": op5_token_counts,
    "op6_html_text": op6_html_text,
    "op7_simhash": op7_simhash,
    "op8_quality_rules": op8_quality_rules,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_language_id": op10_language_id,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_warc_archives": op12_warc_archives,
    "op13_conversation_repair": op13_conversation_repair,
}

SQL: dict[str, str] = {
    "op1_mix_sources": r"""
WITH d AS (
  SELECT doc_id, source, md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS k,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM s),
w AS (SELECT *, CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM r),
f AS (SELECT *, row_number() OVER l AS ord,
        (sum(source_size) OVER () - coalesce(3 * sum(source_size) OVER (l ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
          / (sum(weight) OVER (l ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
      FROM w WINDOW l AS (ORDER BY source_size::DOUBLE / weight, place)),
g AS (SELECT *, (3 * source_size)::DOUBLE <= level * weight AS capped FROM f),
h AS (SELECT *, min(CASE WHEN NOT capped THEN ord END) OVER () AS first_ord FROM g),
t AS (SELECT source, source_size,
        CASE WHEN first_ord IS NULL OR ord < first_ord THEN (3 * source_size)::DOUBLE
             ELSE (SELECT level FROM h h2 WHERE h2.ord = h.first_ord) * weight END AS target FROM h),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END AS epochs FROM t),
p AS (SELECT source, k, sum(size) AS words,
        coalesce(sum(sum(size)) OVER (PARTITION BY source ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d GROUP BY source, k),
c AS (SELECT p.source, p.k, (floor(b.target + 0.5)::BIGINT - b.epochs * b.source_size - p.before)::BIGINT AS rest
      FROM p JOIN b ON p.source IS NOT DISTINCT FROM b.source
      WHERE p.before <= floor(b.target + 0.5)::BIGINT - b.epochs * b.source_size AND floor(b.target + 0.5)::BIGINT - b.epochs * b.source_size < p.before + p.words),
z AS (SELECT c.source, c.k, c.rest, d.size, count(*) AS n,
        coalesce(sum(d.size * count(*)) OVER (PARTITION BY c.source ORDER BY d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shorter,
        sum(count(*)) OVER (PARTITION BY c.source ORDER BY d.size ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_rows
      FROM c JOIN d ON c.source IS NOT DISTINCT FROM d.source AND c.k = d.k GROUP BY c.source, c.k, c.rest, d.size),
v AS (SELECT source, k, min_by(((rest - shorter)::BIGINT // left_rows::BIGINT), size)::BIGINT AS share FROM z WHERE shorter + left_rows * size > rest GROUP BY source, k)
SELECT d.doc_id, d.size, b.source_size, b.target,
  (b.epochs * d.size + CASE WHEN d.k < v.k THEN d.size WHEN d.k = v.k THEN least(d.size, v.share) ELSE 0 END)::BIGINT AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
LEFT JOIN v ON v.source IS NOT DISTINCT FROM d.source
""",
    "op3_decontaminate": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT coalesce(item_id::VARCHAR, '') AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT id, CASE WHEN len(w) >= 13 THEN w[p:p + 12] ELSE w END AS gram FROM i, unnest(range(1, greatest(len(w) - 12, 1) + 1)) t(p) WHERE len(w) > 0),
l AS (SELECT DISTINCT len(gram) AS n FROM g),
s AS (SELECT r, p, n, w[p:p + n - 1] AS gram FROM d, l, unnest(range(1, len(w) - n + 2)) t(p)),
o AS (SELECT r, p, n, id FROM s JOIN g USING (gram)),
h AS (SELECT r, count(DISTINCT p + k) AS n_hit FROM o, unnest(range(0, n)) t(k) GROUP BY r),
m AS (SELECT r, count(DISTINCT id) AS n_items, string_agg(DISTINCT id, ',' ORDER BY id) AS ids FROM o GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN m USING (r)
""",
    "op4_url_filter": r"""
WITH u AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
r(rule_host, rule_path, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
f AS (SELECT u.*, rule_host || rule_path AS rule, verdict,
        row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC NULLS LAST) AS place
      FROM u LEFT JOIN r ON (u.host = rule_host OR ends_with(u.host, '.' || rule_host)) AND starts_with(u.path, rule_path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM f WHERE place = 1
""",
    "op11_importance_resampling": r"""
WITH d AS (
  SELECT 'd' AS side, row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL SELECT 'b', row_number() OVER (), NULL, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
f AS (
  SELECT side, r, unnest(w) AS f FROM d
  UNION ALL SELECT side, r, w[p] || ' ' || w[p + 1] FROM d, unnest(range(1, len(w))) t(p)),
g AS (SELECT side, r, f, count(*) AS n FROM f GROUP BY ALL),
tab AS (SELECT list(list_reduce(range(8), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, range) ORDER BY range) AS tab FROM range(256)),
u AS (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM g)),
c AS (
  SELECT f, xor(4294967295, list_reduce(list_transform(range(1, length(x), 2), lambda k: ('0x' || substr(x, k, 2))::BIGINT),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295)) % 10000 AS bucket FROM u, tab),
n AS (SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0) AS s, coalesce(sum(n) FILTER (side = 'b'), 0) AS t FROM g JOIN c USING (f) GROUP BY bucket),
w AS (
  SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * ((SELECT sum(s) FROM n) + 10000)::DOUBLE) / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM n) + 10000)::DOUBLE)))::BIGINT AS gain FROM n),
m AS (SELECT r, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n)::DOUBLE)::BIGINT AS weight FROM g JOIN c USING (f) JOIN w USING (bucket) WHERE side = 'd' GROUP BY r),
h AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT::DOUBLE + 0.5) / 4294967296)))::BIGINT)::BIGINT AS score
  FROM d LEFT JOIN m USING (r) WHERE side = 'd'),
o AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER (PARTITION BY n_words >= 20) AS able FROM h)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 25 * able // 100 THEN place END::BIGINT AS rank FROM o
""",
    "op12_warc_archives": r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS x, coalesce(html, '') AS html FROM pages),
g AS (SELECT *, row_number() OVER (PARTITION BY html ORDER BY page_id NULLS LAST) AS place, first(page_id) OVER (PARTITION BY html ORDER BY page_id NULLS LAST) AS response FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(x, 5 * (k // 4)::BIGINT + 1, 5))::BIGINT >> (15 - 5 * (k % 4))::INT) & 31) + 1)::BIGINT, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN place > 1 THEN response END AS refers_to
FROM g
""",
    "op13_conversation_repair": r"""
WITH RECURSIVE tab AS (SELECT list(list_reduce(range(8), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, range) ORDER BY range) AS tab FROM range(256)),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
d AS (SELECT k.*, xor(4294967295, list_reduce(list_transform(string_split(key, ''), lambda c: ascii(c)::BIGINT), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295)) % 20 AS dmg FROM k, tab),
r AS (SELECT conv_id, turn, CASE WHEN dmg = 4 THEN 'user' ELSE role END AS role, CASE dmg WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM d, unnest(range(CASE WHEN dmg = 3 THEN 2 ELSE 1 END)) WHERE dmg <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS n,
  right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS z, CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE 'o' END AS i FROM r),
f AS (SELECT *, CASE WHEN z = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate' WHEN z NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, lag(i) OVER (PARTITION BY conv_id ORDER BY n) || i AS pair FROM o),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
  string_agg(CASE fault WHEN '' THEN i WHEN 'truncated' THEN upper(i) ELSE translate(i, 'suao', 'xyz_') END, '' ORDER BY n) AS sig FROM f GROUP BY conv_id),
w AS (
  SELECT sig, length(sig) AS p, {'c': 0, 'a': ''} AS v0, {'c': 4, 'a': 'II'} AS v1, {'c': 2, 'a': 'I'} AS v2, {'c': 0, 'a': ''} AS v3 FROM (SELECT DISTINCT sig FROM c)
  UNION ALL
  SELECT sig, p - 1, list_min([b0, {'c': b2.c + 2, 'a': 'I' || b2.a}, {'c': b3.c + 4, 'a': 'II' || b3.a}]), list_min([b1, {'c': b2.c + 2, 'a': 'I' || b2.a}, {'c': b3.c + 4, 'a': 'II' || b3.a}]),
    list_min([b2, {'c': b3.c + 2, 'a': 'I' || b3.a}]), list_min([b3, {'c': b2.c + 2, 'a': 'I' || b2.a}])
  FROM (SELECT sig, p,
      list_min([{'c': v0.c + 3, 'a': 'D' || v0.a}, {'c': v2.c + 2 + t + g, 'a': 'R' || v2.a}, CASE lower(x) WHEN 's' THEN {'c': v1.c + t, 'a': 'K' || v1.a} WHEN 'u' THEN {'c': v2.c + t, 'a': 'K' || v2.a} ELSE {'c': 1000000000, 'a': ''} END]) AS b0,
      list_min([{'c': v1.c + 3, 'a': 'D' || v1.a}, {'c': v2.c + 2 + t + g, 'a': 'R' || v2.a}, CASE lower(x) WHEN 'u' THEN {'c': v2.c + t, 'a': 'K' || v2.a} ELSE {'c': 1000000000, 'a': ''} END]) AS b1,
      list_min([{'c': v2.c + 3, 'a': 'D' || v2.a}, {'c': v3.c + 2 + t + g, 'a': 'R' || v3.a}, CASE lower(x) WHEN 'a' THEN {'c': v3.c + t, 'a': 'K' || v3.a} ELSE {'c': 1000000000, 'a': ''} END]) AS b2,
      list_min([{'c': v3.c + 3, 'a': 'D' || v3.a}, {'c': v2.c + 2 + t + g, 'a': 'R' || v2.a}, CASE lower(x) WHEN 'u' THEN {'c': v2.c + t, 'a': 'K' || v2.a} ELSE {'c': 1000000000, 'a': ''} END]) AS b3
    FROM (SELECT *, CASE WHEN x IN ('S', 'U', 'A', 'O') THEN 1 ELSE 0 END AS t, CASE WHEN x IN ('x', 'y', 'z', '_') THEN 1000000000 ELSE 0 END AS g FROM (SELECT *, substr(sig, p, 1) AS x FROM w WHERE p > 0)))),
s AS (SELECT sig, v0.c AS cost, v0.a AS audit FROM w WHERE p = 0),
e AS (
  SELECT sig, audit, 0 AS step, 0 AS state, 0 AS n, '' AS edit, '' AS role FROM s
  UNION ALL
  SELECT sig, audit, step + 1, CASE edit2 WHEN 'D' THEN state WHEN 'K' THEN CASE lower(substr(sig, n + 1, 1)) WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END ELSE CASE state WHEN 2 THEN 3 ELSE 2 END END,
    n + CASE edit2 WHEN 'I' THEN 0 ELSE 1 END, edit2, CASE WHEN edit2 IN ('I', 'R') THEN CASE state WHEN 2 THEN 'assistant' ELSE 'user' END END
  FROM (SELECT *, substr(audit, step + 1, 1) AS edit2 FROM e WHERE step < length(audit))),
h AS (SELECT c.conv_id, sha256(string_agg(coalesce(e.role, f.role) || ':' || CASE WHEN edit = 'I' THEN '' ELSE f.text END, chr(10) ORDER BY step)) AS x
  FROM c JOIN e ON e.sig = c.sig AND edit IN ('K', 'R', 'I') LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM c.conv_id AND f.n = e.n GROUP BY c.conv_id)
SELECT q.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0)::BIGINT AS cost,
  coalesce(audit, '') AS audit, coalesce(h.x, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) q LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM q.conv_id LEFT JOIN s USING (sig) LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM q.conv_id
""",
}
