"""Driver queries: texts, hashes, vectors, retrieval, markup."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import scalars, text
from ledgerloom.operators import joins, ordinals, retrieval
from ledgerloom.plans.catalog import query, read

DIMENSIONS = 64


@query("""
WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
i AS (SELECT doc_id, 0 AS k, 'Introduction' AS section, CASE WHEN starts_with(l[1], '# ') OR starts_with(l[1], '>') THEN '' ELSE trim(l[1], E' \\t\\r\\f\\x0b') END AS text FROM s),
r AS (SELECT doc_id, unnest(generate_series(2, len(l))) AS k, l FROM s),
b AS (SELECT * FROM i UNION ALL SELECT doc_id, k, 'Part', trim(l[k], E' \\t\\r\\f\\x0b') FROM r),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, section ORDER BY k) AS d, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS pos FROM b WHERE text <> '')
SELECT doc_id, CAST(pos AS BIGINT) AS pos, CASE WHEN d = 1 THEN section ELSE section || ' (' || d || ')' END AS section, sha256(text) AS text_hash FROM n
""")
def section_chunks(spark, sf_dir):
    """Sections of pages made of documents: front matter, title, a quote, then a header before each further line."""
    head = F.lit("---\ntitle: x\n---\n# Title\n> generated\n")
    page = F.concat(head, F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n---\n## Part\n")))
    pages = read(spark, sf_dir, "documents").select("doc_id", page.alias("markdown"))
    return retrieval.sections(pages, "doc_id", "markdown").select("doc_id", F.col("pos").cast("bigint").alias("pos"), "section", F.sha2("text", 256).alias("text_hash"))


_TOKENS = r"list_transform(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda x: substr(x, 1, 6))"
_STEMS = r"list_transform(regexp_extract_all(lower(text), '\p{L}[\p{L}\p{Nd}]{2,}'), lambda x: substr(x, 1, 6))"


@query(f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n, CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct FROM (SELECT doc_id, {_TOKENS} AS t FROM documents)")
def token_counts(spark, sf_dir):
    """Search tokens of each document."""
    t = read(spark, sf_dir, "documents").select("doc_id", text.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("bigint").alias("n"), F.size(F.array_distinct("t")).cast("bigint").alias("n_distinct"))


@query(f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n, CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct FROM (SELECT doc_id, {_STEMS} AS t FROM documents)")
def stem_counts(spark, sf_dir):
    """Keyword stems of each document."""
    t = read(spark, sf_dir, "documents").select("doc_id", text.stems(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("bigint").alias("n"), F.size(F.array_distinct("t")).cast("bigint").alias("n_distinct"))


_FNV = "list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(generate_series(1, octet_length(encode(token))), lambda i: CAST(('0x' || substr(hex(encode(token)), 2 * i - 1, 2)) AS BIGINT))), lambda h, b: (xor(h, b) * 16777619) & 4294967295)"


@query(f"SELECT token, CAST({_FNV} AS BIGINT) AS h FROM (SELECT DISTINCT unnest({_TOKENS}) AS token FROM documents)")
def fnv_tokens(spark, sf_dir):
    """Hashes of distinct tokens."""
    t = read(spark, sf_dir, "documents").select(F.explode(text.tokens(F.col("text"))).alias("token")).distinct()
    return t.select("token", text.fnv1a(F.col("token")).alias("h"))


_HASHED = f"""
WITH t AS (SELECT doc_id, unnest({_TOKENS}) AS token FROM documents), u AS (SELECT token, CAST({_FNV} AS BIGINT) AS h FROM (SELECT DISTINCT token FROM t)),
s AS (SELECT doc_id, h, count(*) AS tf FROM t JOIN u USING (token) GROUP BY doc_id, h)
"""


def _hashed(spark, sf_dir, table="documents", key="doc_id"):
    return retrieval.hashed(read(spark, sf_dir, table), key, text.tokens(F.col("text")))


@query(_HASHED + "SELECT doc_id, string_agg(h || ':' || tf, ' ' ORDER BY h) AS vector FROM s GROUP BY doc_id")
def sparse_tf(spark, sf_dir):
    """Sparse vectors: token ids and counts in order of id."""
    v = retrieval.sparse_vectors(_hashed(spark, sf_dir), "doc_id")
    pairs = F.zip_with("idx", "val", lambda i, x: F.concat_ws(":", i, x.cast("bigint")))
    return v.select("doc_id", F.array_join(pairs, " ").alias("vector"))


@query(_HASHED + f"""
, c AS (SELECT doc_id, h % {DIMENSIONS} AS cell, sum(tf) AS n FROM s GROUP BY ALL)
SELECT doc_id, CAST(cell AS BIGINT) AS cell, round(CAST(n AS DOUBLE) / sqrt(CAST(sum(n * n) OVER (PARTITION BY doc_id) AS DOUBLE)), 6) AS x FROM c
""")
def dense_hash_norm(spark, sf_dir):
    """Hashed bags of words of length 1."""
    return retrieval.dense_cells(_hashed(spark, sf_dir), "doc_id", DIMENSIONS).select("doc_id", "cell", F.round("x", 6).alias("x"))


@query(f"""
WITH h AS (SELECT doc_id, lang, sha1(unhex('{text.NAMESPACE}') || encode('page-' || doc_id || chr(10) || lang)) AS s FROM documents)
SELECT doc_id, substr(s, 1, 8) || '-' || substr(s, 9, 4) || '-5' || substr(s, 14, 3) || '-' || substr('89ab89ab89ab89ab', 1 + CAST('0x' || substr(s, 17, 1) AS INT), 1) || substr(s, 18, 3) || '-' || substr(s, 21, 12) AS id FROM h
""")
def point_ids(spark, sf_dir):
    """Name-based ids of page sections."""
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", text.point_id(F.concat(F.lit("page-"), "doc_id"), F.col("lang")).alias("id"))


@query("""
WITH q AS (SELECT label, arg_min(embedding, vec_id) AS e FROM embeddings GROUP BY label),
s AS (SELECT q.label, v.vec_id, round(list_cosine_similarity(CAST(e AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) AS score FROM q, embeddings v),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT CAST(label AS BIGINT) AS label, vec_id, CAST(rank AS BIGINT) AS rank FROM r WHERE rank <= 5
""")
def cosine_topk(spark, sf_dir):
    """The nearest five vectors to the first of each label."""
    v = read(spark, sf_dir, "embeddings")
    q = v.groupBy(F.col("label").cast("bigint").alias("label")).agg(F.min_by("embedding", "vec_id").alias("e"))
    return retrieval.dense_best(v, "vec_id", "embedding", q, "label", "e", 5, 6).select(F.col("label").cast("bigint").alias("label"), "vec_id", F.col("rank").cast("bigint").alias("rank"))


_BM = f"""
WITH d AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest({_TOKENS}) AS token FROM documents) GROUP BY ALL),
q AS (SELECT item_id, token, count(*) AS tf FROM (SELECT item_id, unnest({_TOKENS}) AS token FROM benchmark) GROUP BY ALL),
w AS (SELECT token, ln(1 + ((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM d GROUP BY token),
s AS (SELECT item_id, doc_id, sum(q.tf * d.tf * idf) AS score FROM q JOIN w USING (token) JOIN d USING (token) GROUP BY ALL),
sr AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM s)
"""


def _sparse_ranks(spark, sf_dir, k):
    docs, tokens = read(spark, sf_dir, "documents"), text.tokens(F.col("text"))
    q = retrieval.token_frequencies(read(spark, sf_dir, "benchmark"), "item_id", tokens)
    weights = retrieval.idf(docs, tokens, q, docs.count())
    asked = q.join(weights, "token").select("item_id", "token", (F.col("tf") * F.col("idf")).alias("weight"))
    return retrieval.sparse_best(docs, "doc_id", tokens, asked, "item_id", k, 6)


@query(_BM + "SELECT item_id, doc_id, CAST(rank AS BIGINT) AS rank, round(score, 4) AS score FROM sr WHERE rank <= 20")
def bm_dot(spark, sf_dir):
    """The best twenty documents of each benchmark text by sparse dot product with idf."""
    return _sparse_ranks(spark, sf_dir, 20).select("item_id", "doc_id", F.col("rank").cast("bigint").alias("rank"), F.round("score", 4).alias("score"))


_RRF = _BM + f"""
, hd AS (SELECT doc_id, CAST({_FNV} AS BIGINT) % {DIMENSIONS} AS cell, tf FROM d), hq AS (SELECT item_id, CAST({_FNV} AS BIGINT) % {DIMENSIONS} AS cell, tf FROM q),
cd AS (SELECT doc_id, cell, CAST(sum(tf) AS DOUBLE) AS n FROM hd GROUP BY ALL), cq AS (SELECT item_id, cell, CAST(sum(tf) AS DOUBLE) AS n FROM hq GROUP BY ALL),
nd AS (SELECT doc_id, sqrt(sum(n * n)) AS z FROM cd GROUP BY doc_id), nq AS (SELECT item_id, sqrt(sum(n * n)) AS z FROM cq GROUP BY item_id),
ds AS (SELECT item_id, doc_id, sum(cq.n * cd.n) / (any_value(nq.z) * any_value(nd.z)) AS score FROM cq JOIN cd USING (cell) JOIN nq USING (item_id) JOIN nd USING (doc_id) GROUP BY ALL),
dr AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM ds),
f AS (SELECT item_id, doc_id, sum(1.0 / (60 + rank)) AS score FROM (SELECT item_id, doc_id, rank FROM sr WHERE rank <= 20 UNION ALL SELECT item_id, doc_id, rank FROM dr WHERE rank <= 20) GROUP BY ALL),
fr AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM f)
"""


def _hybrid(spark, sf_dir, k):
    """Dense and sparse lists of twenty, fused; the best k."""
    docs = retrieval.dense_vectors(_hashed(spark, sf_dir), "doc_id", DIMENSIONS)
    items = retrieval.dense_vectors(_hashed(spark, sf_dir, "benchmark", "item_id"), "item_id", DIMENSIONS)
    near = retrieval.dense_best(docs, "doc_id", "dense", items, "item_id", "dense", 20, 6)
    both = retrieval.fuse([near, _sparse_ranks(spark, sf_dir, 20)], "item_id", "doc_id")
    return retrieval.ranked(both, "item_id", "doc_id", k, 9)


@query(_RRF + "SELECT item_id, doc_id, CAST(rank AS BIGINT) AS rank FROM fr WHERE rank <= 5")
def rrf_hybrid(spark, sf_dir):
    """Hybrid retrieval for each benchmark text."""
    return _hybrid(spark, sf_dir, 5).select("item_id", "doc_id", F.col("rank").cast("bigint").alias("rank"))


_SNIPPET = "CASE WHEN length(s) > 240 THEN substr(s, 1, 240) || '…' ELSE s END"
_LINES = "array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, E' \\t\\r\\f\\x0b')), lambda x: x <> ''), ' ')"


@query(_RRF + f"""
, h AS (SELECT item_id, rank, lang, {_LINES} AS s FROM fr JOIN documents USING (doc_id) WHERE rank <= 5)
SELECT item_id, coalesce(string_agg(rank || '. ' || lang || ': ' || {_SNIPPET}, chr(10) ORDER BY rank), 'Nothing found.') AS answer FROM benchmark LEFT JOIN h USING (item_id) GROUP BY item_id
""")
def ask_offline(spark, sf_dir):
    """Answers made of numbered snippets of the best hits."""
    hits = _hybrid(spark, sf_dir, 5).join(read(spark, sf_dir, "documents").select("doc_id", "lang", "text"), "doc_id")
    every = read(spark, sf_dir, "benchmark").select("item_id").join(hits, "item_id", "left")
    return retrieval.offline_answer(every, "item_id", "rank", "lang", "text")


_QUERY = "The eringing of thanea and heedonly with ouestion"


@query(f"""
WITH q AS (SELECT list_distinct({_STEMS.replace("text", f"'{_QUERY}'")}) AS q), d AS (SELECT doc_id, list_distinct({_STEMS}) AS t FROM documents),
s AS (SELECT doc_id, CAST(len(list_intersect(t, q)) AS DOUBLE) / greatest(len(q), 1) AS score FROM d, q)
SELECT doc_id, round(score, 6) AS score FROM s WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 5
""")
def keyword_search(spark, sf_dir):
    """The five documents with most of a question's stems."""
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), text.stems(F.col("text")).alias("stems"))
    return retrieval.keyword_scores(d, _QUERY, "stems").select(F.col("pos").alias("doc_id"), F.round("score", 6).alias("score"))


@query(r"""
WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="/([^"]*)"', 1)) AS name FROM pages)
SELECT page_id, name, 'docs/' || name || '.md' AS resolved, '../' || name || '.md' AS relative, NULL AS missed, CASE WHEN name = 'the' THEN 'known' ELSE 'plain' END AS label FROM h
""")
def link_resolve(spark, sf_dir):
    """Links of pages as relative page links: resolved, made relative again, and looked up."""
    h = read(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1))).alias("name"))
    page = F.concat(F.lit("docs/en/p"), "page_id", F.lit(".md"))
    quoted = F.replace(F.url_encode("name"), F.lit("+"), F.lit("%20"))
    h = h.select("page_id", "name", scalars.resolve_path(page, F.concat(F.lit(".././../docs/"), quoted, F.lit(".md#top?x"))).alias("resolved"), page.alias("page"))
    known = spark.createDataFrame([("docs/the.md", "known")], "resolved string, label string")
    out = joins.lookup_default(h, known, "resolved", "label", F.lit("plain"))
    return out.select("page_id", "name", "resolved", scalars.relative_path(F.col("page"), F.col("resolved")).alias("relative"), scalars.resolve_path(F.col("page"), F.lit("https://x/y.md")).alias("missed"), "label")


@query(r"""
SELECT doc_id, sha256(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) AS xml, sha256(replace(replace(replace(text, chr(13), ''), chr(10), ' '), '|', '\|')) AS cell,
  sha256('"' || replace(replace(text, '\', '\\'), '"', '\"') || '"') AS yaml, sha256(replace(text || ']]>', ']]>', ']]]]><![CDATA[>')) AS cdata FROM documents
""")
def md_escape(spark, sf_dir):
    """Texts escaped for XML, Markdown tables, YAML and CDATA."""
    t = F.col("text")
    return read(spark, sf_dir, "documents").select("doc_id", *[F.sha2(x, 256).alias(n) for n, x in (("xml", scalars.xml_escape(t)), ("cell", scalars.table_cell(t)), ("yaml", scalars.yaml_quote(t)), ("cdata", scalars.cdata(F.concat(t, F.lit("]]>")))))])


@query("""
SELECT p_partkey, 'LineItem' || p_partkey || 'Handler' AS short, 'Acme.Shop.LineItem' || p_partkey || 'Handler<,>' AS full, 'Line item' || p_partkey || ' handler' AS human, 'LineItem' || p_partkey AS stripped, 'line_item' || p_partkey || '_handler' AS snake,
  'http_server' || p_partkey AS acronym, 'httpserver' || p_partkey AS simple, 'Acme.Shop' AS module, 'Api' AS layer, 'src/' || p_brand || '.cs' AS path, p_size AS line FROM part
""")
def names(spark, sf_dir):
    """Type names, locations and naming styles."""
    p = read(spark, sf_dir, "part")
    id_ = F.concat(F.lit("T:Acme.Shop.LineItem"), "p_partkey", F.lit("Handler`2"))
    name, server = scalars.short(id_), F.concat(F.lit("HTTPServer"), "p_partkey")
    place = F.concat(F.lit("src/"), "p_brand", F.lit(".cs:"), "p_size")
    return p.select(
        "p_partkey", name.alias("short"), scalars.full(id_).alias("full"), scalars.humanize(name).alias("human"), scalars.strip_suffix(name, "Command", "Handler").alias("stripped"), scalars.snake_acronyms(name).alias("snake"), scalars.snake_acronyms(server).alias("acronym"), scalars.snake_simple(server).alias("simple"),
        scalars.module_of(F.lit("Acme.Shop.Api")).alias("module"), scalars.layer_of(F.lit("Acme.Shop.Api")).alias("layer"), scalars.location_path(place).alias("path"), scalars.location_line(place).alias("line"),
    )


@query("SELECT doc_id, sha256(lang || chr(10) || chr(1) || source || chr(10) || chr(1) || text) AS h FROM documents")
def content_hash(spark, sf_dir):
    """Hashes of several parts."""
    return read(spark, sf_dir, "documents").select("doc_id", text.content_hash(F.col("lang"), F.col("source"), F.col("text")).alias("h"))


@query(r"""
SELECT conv_id, CAST(count(*) AS BIGINT) AS n, string_agg(turn || ' ' || role, ', ' ORDER BY turn) AS places FROM conversations WHERE regexp_matches(text, '(?i)(^|[^\p{L}\p{N}_])the($|[^\p{L}\p{N}_])') GROUP BY conv_id
""")
def find_usages(spark, sf_dir):
    """Turns that use a word, grouped by conversation."""
    c = read(spark, sf_dir, "conversations").where(F.col("text").rlike("(?i)(^|[^\\p{L}\\p{N}_])the($|[^\\p{L}\\p{N}_])"))
    return c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), ordinals.ordered_join(F.concat_ws(" ", "turn", "role"), F.col("turn"), ", ").alias("places"))


@query(f"""
WITH s AS (SELECT doc_id, {_LINES} AS s, lang || chr(10) || source || chr(10) || chr(10) || text AS e FROM documents)
SELECT doc_id, {_SNIPPET} AS snippet, CASE WHEN length(s) > 600 THEN substr(s, 1, 600) || '…' ELSE s END AS clipped, sha256(e) AS embedding_text, 'offline-hash:64' AS embedder FROM s
""")
def snippets(spark, sf_dir):
    """Snippets, longer cuts and the text that is embedded."""
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", scalars.snippet(F.col("text")).alias("snippet"), scalars.snippet(F.col("text"), 600).alias("clipped"), F.sha2(text.embedding_text(F.col("lang"), F.col("source"), F.col("text")), 256).alias("embedding_text"), F.lit(f"offline-hash:{DIMENSIONS}").alias("embedder"))
