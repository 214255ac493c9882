"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, decontaminate, divergence, exact_dedup, line_dedup, near_dedup, periodic, repetition, runtime, token_counts, token_shards, toxicity, url_filter, warc

#: Token that ends a document in token shards.
END_ID = 2
#: Documents of more tokens are over the limit.
TOKEN_LIMIT = 1024
#: The chain's categories in order; ``junk`` is quality 0.
CATEGORIES = ("junk", "toxic")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """Path of a public tokenizer file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return decontaminate.verdicts(found)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(_read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def category_labels(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", (1 - F.col("quality")).alias("junk"), "toxic")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _read(spark, sf_dir, "documents")
    chain = toxicity.train(documents, category_labels(_read(spark, sf_dir, "labels")), CATEGORIES)
    scored = toxicity.score(documents.select("doc_id", "text"), chain)
    p = F.col("probabilities")
    return scored.select("doc_id", *[F.round(p[i], 6).alias(f"p_{c}") for i, c in enumerate(CATEGORIES)], (p[len(CATEGORIES) - 1] >= chain.threshold).alias("toxic"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_read(spark, sf_dir, "documents"), near_dedup.CONTRACT)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = runtime.shared_path(spark, "warc")
    warc.archive_pages(_read(spark, sf_dir, "pages"), folder)
    back = warc.read_archives(spark, folder, "record_id string, record_type string, payload_digest string, refers_to string, payload_bytes bigint, payload binary")
    page = lambda c: F.expr(f"try_cast(substring({c}, 10) AS BIGINT)")
    # Of responses, what was read; of revisits, what their records say of a payload that is elsewhere.
    digest, size = F.coalesce(F.sha2("payload", 256), "payload_digest"), F.coalesce(F.octet_length("payload").cast("bigint"), "payload_bytes")
    return back.where(F.col("record_type").isin("response", "revisit")).select(page("record_id").alias("page_id"), size.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", page("refers_to").alias("refers_to"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages")
    judged = url_filter.filter_urls(pages, url_filter.repeated_urls(pages))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op7_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = runtime.shared_path(spark, "token-shards")
    manifest = token_shards.write_shards(_read(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), END_ID, folder)
    back = token_shards.read_shards(manifest)
    return back.select("doc_id", "start", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op8_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = repetition.judge(repetition.measure_repetition(_read(spark, sf_dir, "documents")))
    too_long = F.col("longest") > repetition.MAX_LONGEST
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "covered", too_long.alias("too_long"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digest(bpe.encode_decode(_read(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json")))


def bpe_digest(coded: DataFrame) -> DataFrame:
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("n_lines").cast("bigint").alias("n_lines"), F.size("removed").cast("bigint").alias("n_removed"), F.sha2("text", 256).alias("text_sha256"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_read(spark, sf_dir, "documents")).select("lang", "source", "part", "item", "value", "rank")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.detect_runs(_read(spark, sf_dir, "documents"), plant=True)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    most = F.expr("1000 * best.length div best.period")
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period", most.alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.dedup(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_token_counts": op2_token_counts,
    "op3_toxicity": op3_toxicity,
    "op4_near_dedup": op4_near_dedup,
    "op5_warc": op5_warc,
    "op6_url_filter": op6_url_filter,
    "op7_token_shards": op7_token_shards,
    "op8_repetition": op8_repetition,
    "op9_bpe": op9_bpe,
    "op10_line_dedup": op10_line_dedup,
    "op11_source_divergence": op11_source_divergence,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_exact_dedup": op13_exact_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op1_decontaminate": r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wi AS (
  SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(generate_series(1, greatest(1, len(w) - 12))) AS i FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM wi),
dp AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM dw, sizes WHERE len(w) >= n)),
hit AS (SELECT dp.doc_id, dp.i, dp.n, wi.item FROM dp JOIN wi USING (n, win)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
""",
    "op5_warc": r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f USING (d)
""",
    "op6_url_filter": r"""
WITH p AS (
  SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
h AS (
  SELECT page_id, rest,
    coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
    list_sort(list_filter(string_split(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(ref|utm_[a-z]+)(=|$)'))) AS q
  FROM p),
c AS (
  SELECT *, CASE WHEN rest IS NOT NULL THEN regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END END AS canonical FROM h),
rules(rule, rh, rp, rv) AS (VALUES ('com/en/', 'com', '/en/', 'block'), ('example.com/en/7', 'example.com', '/en/7', 'allow'),
  ('net/de/', 'net', '/de/', 'allow'), ('example.net/de/8', 'example.net', '/de/8', 'block'), ('org/es/', 'org', '/es/', 'block')),
fit AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(rv, length(rule)) AS rv
  FROM c JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id),
listed AS (SELECT canonical FROM c WHERE canonical IS NOT NULL GROUP BY canonical HAVING count(*) >= 2)
SELECT page_id, host, path, rule, coalesce(rv, CASE WHEN canonical IN (SELECT canonical FROM listed) THEN 'block' END, 'allow') AS verdict
FROM c LEFT JOIN fit USING (page_id)
""",
    # Exact sets and links by a join of shingles; MinHash misses a link with a chance below 3e-7.
    "op4_near_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(3, len(w)) - 1], ' ') AS sh
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM p JOIN n x ON u = x.doc_id JOIN n y ON v = y.doc_id WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT u, v FROM l UNION SELECT v, u FROM l),
r AS (SELECT doc_id AS node, doc_id AS seen FROM w UNION SELECT r.node, e.v FROM r JOIN e ON r.seen = e.u),
c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, w.doc_id = component_id AS kept FROM w JOIN c ON w.doc_id = c.node LEFT JOIN n ON w.doc_id = n.doc_id
""",
    # A repeat of so many words or more is there if a window of so many words is there twice.
    "op8_repetition": rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM w, (VALUES (3), ({repetition.MIN_REPEAT}), ({repetition.MAX_LONGEST + 1})) t(k) WHERE len(w) >= k)),
twice AS (SELECT doc_id, k, i FROM win WHERE (doc_id, k, win) IN (SELECT (doc_id, k, win) FROM win GROUP BY doc_id, k, win HAVING count(*) > 1)),
hit AS (SELECT doc_id, k, count(DISTINCT p) AS n FROM (SELECT doc_id, k, unnest(generate_series(i, i + k - 1)) AS p FROM twice) GROUP BY doc_id, k),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (
  SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(l.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(a.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(b.n, 0) AS BIGINT) AS covered, c.n IS NOT NULL AS too_long
  FROM w LEFT JOIN lines l ON l.doc_id = w.doc_id LEFT JOIN hit a ON a.doc_id = w.doc_id AND a.k = 3 LEFT JOIN hit b ON b.doc_id = w.doc_id AND b.k = {repetition.MIN_REPEAT} LEFT JOIN hit c ON c.doc_id = w.doc_id AND c.k = {repetition.MAX_LONGEST + 1}),
j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND 100 * covered <= {repetition.MAX_COVERED} * n_words AND NOT too_long AS kept FROM j
""",
    "op10_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS pos FROM documents),
solid AS (
  SELECT doc_id, pos, trim(line, chr(32) || chr(9) || chr(13)) AS t, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS k
  FROM lines WHERE trim(line, chr(32) || chr(9) || chr(13)) <> ''),
win AS (
  SELECT * FROM (SELECT doc_id, k, t || chr(10) || lead(t, 1) OVER w || chr(10) || lead(t, 2) OVER w AS win FROM solid WINDOW w AS (PARTITION BY doc_id ORDER BY k)) WHERE win IS NOT NULL),
ranked AS (
  SELECT doc_id, k, first_value(doc_id) OVER f AS fd, first_value(k) OVER f AS fk FROM win WINDOW f AS (PARTITION BY win ORDER BY doc_id, k)),
later AS (
  SELECT doc_id, CASE WHEN doc_id = fd THEN greatest(k, fk + 3) ELSE k END AS a, k + 2 AS b FROM ranked WHERE NOT (doc_id = fd AND k = fk)),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(a, b)) AS k FROM later),
removed AS (SELECT s.doc_id, s.pos FROM gone JOIN solid s USING (doc_id, k)),
kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM lines WHERE NOT EXISTS (SELECT 1 FROM removed r WHERE r.doc_id = lines.doc_id AND r.pos = lines.pos) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(string_split(d.text, chr(10))) AS BIGINT) AS n_lines,
  (SELECT count(*) FROM removed r WHERE r.doc_id = d.doc_id) AS n_removed, sha256(coalesce(kept.text, '')) AS text_sha256
FROM documents d LEFT JOIN kept USING (doc_id)
""",
    "op11_source_divergence": r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
kept AS (SELECT lang, term FROM (SELECT lang, row, unnest(list_distinct(w)) AS term FROM d) GROUP BY lang, term HAVING count(*) >= 30),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(w) AS term FROM d) JOIN kept USING (lang, term) GROUP BY ALL),
total AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, term, coalesce(n, 0) AS n, 1 + 1000000000 * (coalesce(n, 0) + 5)::HUGEINT // (coalesce(total, 0) + 5 * v) AS p
  FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN total USING (lang, source) LEFT JOIN c USING (lang, source, term)),
q AS (SELECT lang, term, 1 + 1000000000 * (sum(n) + 5)::HUGEINT // (sum(sum(n)) OVER (PARTITION BY lang) + 5 * any_value(v)) AS q FROM p JOIN v USING (lang) GROUP BY lang, term),
pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang AS l, x.source AS s, y.source AS t, sum(abs(x.p - y.p)) AS f FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) ON a.lang = l AND a.source = s AND b.source = t),
term AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
""",
    "op13_exact_dedup": r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents),
k AS (SELECT body, count(*) AS group_size, arg_min(doc_id, (-points, doc_id)) AS keep_id FROM d GROUP BY body)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM d JOIN k USING (body)
""",
}
