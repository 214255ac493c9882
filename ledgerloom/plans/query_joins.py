"""Driver queries: joins, sets and synchronisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import joins, ordinals, sync
from ledgerloom.plans.catalog import query, read


def _edges(spark, sf_dir):
    """Suppliers send to the nation that their name's number falls on, counted to 30; nations handle their own message."""
    sent = read(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("entry_id"), F.lit(0).alias("pos"), F.when(F.col("s_acctbal") < 0, "publishes").otherwise("sends").alias("type"), F.concat(F.lit("N"), F.pmod("s_suppkey", F.lit(30))).alias("target"))
    own = read(spark, sf_dir, "nation").select(F.concat(F.lit("H"), "n_nationkey").alias("entry_id"), F.lit(0).alias("pos"), F.lit("handles").alias("type"), F.concat(F.lit("N"), "n_nationkey").alias("target"))
    return sent.unionByName(own)


_EDGES = """
WITH sent AS (SELECT 'S' || s_suppkey AS source, CASE WHEN s_acctbal < 0 THEN 'publishes' ELSE 'sends' END AS type, 'N' || (s_suppkey % 30) AS message FROM supplier),
h AS (SELECT 'H' || n_nationkey AS handler, 'N' || n_nationkey AS message FROM nation)
"""


@query(_EDGES + "SELECT source, type, message, handler FROM sent LEFT JOIN h USING (message)")
def outgoing_left(spark, sf_dir):
    """Where each entry leads; no handler is null."""
    return joins.outgoing(_edges(spark, sf_dir)).drop("pos")


@query(_EDGES + "SELECT handler, source, type, message FROM sent JOIN h USING (message)")
def incoming_inner(spark, sf_dir):
    """Who triggers each handler."""
    return joins.incoming(_edges(spark, sf_dir))


@query("""
SELECT p_partkey, s_name FROM (SELECT p_partkey, s_name, row_number() OVER (PARTITION BY p_partkey ORDER BY s_suppkey) AS n
  FROM part LEFT JOIN supplier ON p_partkey = s_suppkey OR p_size * 3 = s_suppkey) WHERE n = 1
""")
def or_lookup_first(spark, sf_dir):
    """The first supplier that agrees with a part in either key."""
    part = read(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 3).cast("bigint").alias("by_size"))
    return joins.or_lookup(part, read(spark, sf_dir, "supplier"), "p_partkey", [("p_partkey", "s_suppkey"), ("by_size", "s_suppkey")], "s_suppkey", ["s_name"]).select("p_partkey", "s_name")


def _seconds(column: str = "ts"):
    return F.unix_seconds(F.col(column).cast("timestamp"))


_SPANS = """
WITH e AS (SELECT event_id, user_id, event_type, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events),
p AS (SELECT event_id AS span, user_id, s AS low, s + 86400 AS high FROM e WHERE event_type = 'signup')
"""


def _events(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", _seconds().alias("s"))


def _signups(events):
    return events.where("event_type = 'signup'").select(F.col("event_id").alias("span"), "user_id", F.col("s").alias("low"), (F.col("s") + 86400).alias("high"))


@query(_SPANS + "SELECT e.event_id, coalesce((SELECT min(span) FROM p WHERE p.user_id = e.user_id AND e.s BETWEEN low AND high), -1) AS span FROM e")
def range_lookup(spark, sf_dir):
    """The first day-long span after a signup that covers each event of the user."""
    e = _events(spark, sf_dir)
    return joins.range_lookup(e, _signups(e), "event_id", "user_id", "s", "low", "high", "span", ["span"]).select("event_id", F.coalesce("span", F.lit(-1)).alias("span"))


@query(_SPANS + "SELECT event_id FROM e WHERE EXISTS (SELECT 1 FROM p WHERE p.user_id = e.user_id AND e.s BETWEEN low AND high)")
def range_semi(spark, sf_dir):
    """Events inside any such span."""
    e = _events(spark, sf_dir)
    return joins.range_semi(e, _signups(e), "user_id", "s", "low", "high", 86400).select("event_id")


@query("""
WITH e AS (SELECT event_id, user_id, event_type, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events),
n AS (SELECT a.event_id, min(b.s) AS next_at FROM e a LEFT JOIN e b ON b.event_type = 'purchase' AND a.user_id = b.user_id AND b.s >= a.s WHERE a.event_type = 'error' GROUP BY a.event_id)
SELECT event_id, coalesce(next_at, -1) AS next_at, coalesce((SELECT min(b.event_id) FROM e a JOIN e b USING (user_id) WHERE a.event_id = n.event_id AND b.event_type = 'purchase' AND b.s = n.next_at), -1) AS next_value FROM n
""")
def asof_forward(spark, sf_dir):
    """The first purchase of the user at or after each error."""
    e = _events(spark, sf_dir)
    out = joins.asof_forward(e.where("event_type = 'error'"), e.where("event_type = 'purchase'"), "user_id", "s", "event_id")
    return out.select("event_id", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("next_at", "next_value")])


@query("SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderpriority) = (SELECT count(DISTINCT o_orderpriority) FROM orders)")
def relational_division(spark, sf_dir):
    """Customers who have ordered with every priority there is."""
    orders = read(spark, sf_dir, "orders")
    return joins.divide(orders, "o_custkey", "o_orderpriority", orders)


@query("""
WITH c AS (SELECT c_custkey, 0 AS rank, 'n' || (c_custkey % 40) AS k FROM customer UNION ALL SELECT c_custkey, 1, CASE WHEN c_acctbal >= 0 THEN 'n' || c_nationkey END FROM customer),
f AS (SELECT c_custkey, rank, n_name, row_number() OVER (PARTITION BY c_custkey ORDER BY rank) AS r FROM c JOIN nation ON k = 'n' || n_nationkey)
SELECT c.c_custkey, CAST(coalesce(rank, -1) AS BIGINT) AS rank, n_name FROM customer c LEFT JOIN f ON c.c_custkey = f.c_custkey AND r = 1
""")
def priority_lookup(spark, sf_dir):
    """The nation under the first of two keys that names one."""
    customer = read(spark, sf_dir, "customer")
    nation = read(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("key"), "n_name")
    keys = [F.concat(F.lit("N"), F.pmod("c_custkey", F.lit(40))), F.when(F.col("c_acctbal") >= 0, F.concat(F.lit("N"), "c_nationkey"))]
    return joins.priority_lookup(customer, nation, "c_custkey", keys, "key", ["n_name"]).select("c_custkey", F.coalesce("rank", F.lit(-1)).cast("bigint").alias("rank"), "n_name")


@query("""
SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' OR EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity >= 50)
""")
def semi_or_exists(spark, sf_dir):
    """Orders that are urgent or have a large line: an existence join."""
    large = read(spark, sf_dir, "lineitem").where("l_quantity >= 50")
    return joins.semi_or(read(spark, sf_dir, "orders"), large, [("o_orderkey", "l_orderkey")], F.col("o_orderpriority") == "1-URGENT").select("o_orderkey")


@query("""
SELECT 'order' AS kind, o_orderkey AS id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
UNION ALL SELECT 'document', doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id)
""")
def anti_orphans(spark, sf_dir):
    """Orders without lines and documents without labels."""
    orders, lines = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem").select("l_orderkey")
    a = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"))
    b = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"))
    return a.unionByName(b)


@query("SELECT n_name, r_name FROM nation, region")
def cross_attach(spark, sf_dir):
    """Every region attached to every nation: the small side is counted first."""
    return joins.attach_all(read(spark, sf_dir, "nation").select("n_name"), read(spark, sf_dir, "region").select("r_name"))


@query("""
WITH uses AS (SELECT DISTINCT c_nationkey AS a, s_nationkey AS b FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey
  UNION SELECT x.n_nationkey, y.n_nationkey FROM nation x JOIN nation y USING (n_regionkey))
SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b FROM uses WHERE a <> b AND b IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)
""")
def depends_on(spark, sf_dir):
    """Nations that each nation depends on: by purchases or region, not itself, only known ones."""
    nation = read(spark, sf_dir, "nation")
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").join(read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("b")), "l_suppkey")
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey")).join(read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("a")), "c_custkey")
    bought = lines.join(orders, "l_orderkey").select("a", "b").distinct()
    near = nation.select("n_regionkey", F.col("n_nationkey").alias("a")).join(nation.select("n_regionkey", F.col("n_nationkey").alias("b")), "n_regionkey").select("a", "b")
    known = nation.where("n_regionkey < 3").select(F.col("n_nationkey").alias("b"))
    return bought.unionByName(near).where("a <> b").distinct().join(known, "b", "left_semi").select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"))


@query("""
SELECT l_returnflag, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN coalesce(p_name, 'unknown') = 'unknown' THEN 1 ELSE 0 END) AS BIGINT) AS n_default, min(coalesce(p_name, 'unknown')) AS least
FROM lineitem LEFT JOIN (SELECT p_partkey, p_name FROM part WHERE p_size > 25) ON l_partkey = p_partkey GROUP BY l_returnflag
""")
def lookup_default(spark, sf_dir):
    """Names of large parts, else a default."""
    part = read(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    named = joins.lookup_default(read(spark, sf_dir, "lineitem").select("l_returnflag", "l_partkey"), part, "l_partkey", "p_name", F.lit("unknown"))
    return named.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("p_name") == "unknown").alias("n_default"), F.min("p_name").alias("least"))


@query("SELECT l_partkey, string_agg(DISTINCT CAST(l_suppkey AS VARCHAR), ',' ORDER BY CAST(l_suppkey AS VARCHAR)) AS suppliers FROM lineitem GROUP BY l_partkey")
def inverse_map(spark, sf_dir):
    """Distinct suppliers of each part."""
    return read(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.array_join(F.array_sort(F.collect_set(F.col("l_suppkey").cast("string"))), ",").alias("suppliers"))


@query("""
SELECT l_orderkey, string_agg(p_name, '; ' ORDER BY l_linenumber, l_partkey, l_suppkey) AS names FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey
""")
def array_ids_join(spark, sf_dir):
    """Names of the parts in each order's list of ids, in its order."""
    place = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey")))
    lists = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(place, lambda s: s["l_partkey"]).alias("ids"))
    out = joins.by_id_array(lists, read(spark, sf_dir, "part").withColumnRenamed("p_partkey", "id"), "l_orderkey", "ids", "id", "p_name")
    return out.select("l_orderkey", F.array_join("p_name_list", "; ").alias("names"))


@query("""
SELECT 'D' || doc_id AS code, true AS manual FROM labels WHERE quality = 0
UNION ALL SELECT 'd' || doc_id, false FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 0)
""")
def override_union(spark, sf_dir):
    """Manual entries win over proposed ones of the same name."""
    manual = read(spark, sf_dir, "labels").where("quality = 0").select(F.concat(F.lit("D"), "doc_id").alias("code"))
    return joins.override_union(manual, read(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("code")), "code")


@query("SELECT sha256(text) AS h, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    """Texts that several documents have."""
    return sync.duplicates(read(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("h")), "h")


@query("""
SELECT doc_id, CASE n WHEN 0 THEN 'missing' ELSE 'duplicate' END AS error FROM (
  SELECT d.doc_id, (SELECT count(*) FROM labels l WHERE l.doc_id = d.doc_id) + (SELECT count(*) FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 1) AS n FROM documents d) WHERE n <> 1
""")
def exactly_once(spark, sf_dir):
    """Documents that no label names, or several do (toxic ones are named twice)."""
    labels = read(spark, sf_dir, "labels")
    uses = labels.select("doc_id").unionByName(labels.where("toxic = 1").select("doc_id"))
    return sync.exactly_once(read(spark, sf_dir, "documents"), uses, "doc_id")


@query("""
WITH e AS (SELECT DISTINCT c_nationkey AS nation, c_mktsegment AS segment FROM customer WHERE c_acctbal < 0), a AS (SELECT DISTINCT c_nationkey AS nation, c_mktsegment AS segment FROM customer WHERE c_acctbal > 9000)
SELECT nation, segment, 'missing' AS side FROM (SELECT * FROM e EXCEPT SELECT * FROM a) UNION ALL SELECT nation, segment, 'extra' FROM (SELECT * FROM a EXCEPT SELECT * FROM e) WHERE NOT starts_with(segment, 'AUTO')
""")
def golden_diff(spark, sf_dir):
    """What is expected and missing, and what is there beyond it (but for what is ignored)."""
    c = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"), "c_acctbal")
    return sync.golden_diff(c.where("c_acctbal < 0"), c.where("c_acctbal > 9000"), ["nation", "segment"], F.col("segment").startswith("AUTO"))


@query("SELECT c_nationkey AS nation FROM customer WHERE c_acctbal < -900 EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000")
def set_diff(spark, sf_dir):
    """Nations of poor customers without a rich supplier."""
    a = read(spark, sf_dir, "customer").where("c_acctbal < -900").select(F.col("c_nationkey").alias("nation"))
    return sync.set_difference(a, read(spark, sf_dir, "supplier").where("s_acctbal > 8000").select(F.col("s_nationkey").alias("nation")), ["nation"])


_STATES = """
WITH o AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE lang <> 'de'), n AS (SELECT doc_id, sha256(CASE WHEN lang = 'fr' THEN text || '!' ELSE text END) AS h FROM documents WHERE source <> 'src3')
"""


def _old_new(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    old = d.where("lang <> 'de'").select("doc_id", F.sha2("text", 256).alias("h"))
    return old, d.where("source <> 'src3'").select("doc_id", F.sha2(F.when(F.col("lang") == "fr", F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("h"))


@query(_STATES + """
SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'create' WHEN n.doc_id IS NULL THEN 'delete' WHEN o.h = n.h THEN 'unchanged' ELSE 'update' END AS action FROM o FULL JOIN n ON o.doc_id = n.doc_id
""")
def sync_actions(spark, sf_dir):
    """What a changed corpus needs, by content hash."""
    return sync.changes(*_old_new(spark, sf_dir), "doc_id", "h")


@query(_STATES + """
, a AS (SELECT CASE WHEN o.doc_id IS NULL THEN 'create' WHEN n.doc_id IS NULL THEN 'delete' WHEN o.h = n.h THEN 'unchanged' ELSE 'update' END AS action FROM o FULL JOIN n ON o.doc_id = n.doc_id)
SELECT action, CAST(count(*) AS BIGINT) AS n FROM a GROUP BY action
""")
def sync_counts(spark, sf_dir):
    """The same, counted."""
    return sync.changes(*_old_new(spark, sf_dir), "doc_id", "h").groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH pages AS (SELECT doc_id, lang || ':' || doc_id AS title, sha256(text) AS h, source AS parent FROM documents),
r AS (SELECT lang || ':' || doc_id AS title, CASE WHEN lang = 'es' THEN NULL ELSE doc_id END AS own, sha256(text) AS h, CASE WHEN source = 'src5' THEN 'v1' ELSE 'v2' END AS f, CASE WHEN source = 'src7' THEN 'root' ELSE source END AS parent FROM documents WHERE lang <> 'de')
SELECT doc_id AS page_id, CASE WHEN r.title IS NULL THEN 'create' WHEN own IS DISTINCT FROM doc_id THEN 'foreign' WHEN r.h = pages.h AND f = 'v2' AND r.parent = pages.parent THEN 'unchanged' ELSE 'update' END AS action FROM pages LEFT JOIN r USING (title)
""")
def publish_actions(spark, sf_dir):
    """Per page: create, foreign, unchanged or update."""
    d = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.concat("lang", F.lit(":"), "doc_id").alias("title"), F.sha2("text", 256).alias("hash"))
    pages = d.select(F.col("doc_id").alias("page_id"), "title", "hash", F.col("source").alias("parent"))
    remote = d.where("lang <> 'de'").select("title", F.when(F.col("lang") != "es", F.col("doc_id")).alias("stamp_page_id"), F.col("hash").alias("stamp_hash"), F.when(F.col("source") == "src5", "v1").otherwise("v2").alias("stamp_format"), F.when(F.col("source") == "src7", "root").otherwise(F.col("source")).alias("parent"))
    return sync.publish_actions(pages, remote, "v2")


@query("""
WITH o AS (SELECT CASE WHEN lang = 'es' THEN 'out/../' WHEN lang = 'fr' THEN 'other/' ELSE 'out/' END || doc_id || '.md' AS path FROM documents), n AS (SELECT 'out/' || doc_id || '.md' AS path FROM documents WHERE source <> 'src3')
SELECT path FROM o WHERE starts_with(path, 'out/') AND NOT contains(path, '..') AND path NOT IN (SELECT path FROM n)
""")
def stale_paths(spark, sf_dir):
    """Generated files that are no longer, only inside the output folder."""
    d = read(spark, sf_dir, "documents")
    folder = F.when(F.col("lang") == "es", "out/../").when(F.col("lang") == "fr", "other/").otherwise("out/")
    return sync.stale_paths(d.select(F.concat(folder, "doc_id", F.lit(".md")).alias("path")), d.where("source <> 'src3'").select(F.concat(F.lit("out/"), "doc_id", F.lit(".md")).alias("path")), "out")


_POINTS = """
WITH pages AS (SELECT DISTINCT source AS page_id FROM documents WHERE source <> 'src3'),
pt AS (SELECT 'p' || doc_id AS id, source AS page_id, CASE WHEN source = 'src5' AND lang = 'fr' THEN 'old' ELSE source END AS page_hash, CASE WHEN source = 'src7' THEN 'offline-hash:32' ELSE 'offline-hash:64' END AS embedder FROM documents WHERE source <> 'src9')
"""


def _points(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    pages = d.where("source <> 'src3'").select(F.col("source").alias("page_id"), F.col("source").alias("hash")).distinct()
    points = d.where("source <> 'src9'").select(F.concat(F.lit("p"), "doc_id").alias("id"), F.col("source").alias("page_id"), F.when((F.col("source") == "src5") & (F.col("lang") == "fr"), "old").otherwise(F.col("source")).alias("page_hash"), F.when(F.col("source") == "src7", "offline-hash:32").otherwise("offline-hash:64").alias("embedder"))
    return points, pages, d


@query(_POINTS + """
SELECT page_id, CAST(count(pt.id) AS BIGINT) AS n_points, coalesce(bool_and(page_hash = page_id AND embedder = 'offline-hash:64'), false) AS current FROM pages LEFT JOIN pt USING (page_id) GROUP BY page_id
""")
def page_state(spark, sf_dir):
    """Whether all points of a page have its hash and embedder."""
    points, pages, _ = _points(spark, sf_dir)
    return sync.page_states(points, pages, F.lit("offline-hash:64"))


@query(_POINTS + """
, cur AS (SELECT page_id FROM pages LEFT JOIN pt USING (page_id) GROUP BY page_id HAVING coalesce(bool_and(page_hash = page_id AND embedder = 'offline-hash:64'), false)),
ch AS (SELECT 'p' || doc_id AS id, source AS page_id FROM documents WHERE lang <> 'es' AND source <> 'src3'),
up AS (SELECT * FROM ch WHERE page_id NOT IN (SELECT page_id FROM cur))
SELECT 'upsert' AS action, id FROM up UNION ALL
SELECT 'delete', id FROM pt WHERE page_id NOT IN (SELECT page_id FROM pages) OR page_id NOT IN (SELECT page_id FROM cur) AND id NOT IN (SELECT id FROM up)
""")
def index_sync(spark, sf_dir):
    """Points to write and to delete: orphans of gone pages, and gone sections of changed ones."""
    points, pages, d = _points(spark, sf_dir)
    chunked = d.where("lang <> 'es' AND source <> 'src3'").select(F.concat(F.lit("p"), "doc_id").alias("id"), F.col("source").alias("page_id"))
    up, gone = sync.index_sync(points, pages, chunked, "offline-hash:64")
    return up.select(F.lit("upsert").alias("action"), "id").unionByName(gone.select(F.lit("delete").alias("action"), "id"))


@query("""
SELECT doc_id, 'blank text' AS error FROM documents WHERE trim(text) = '' UNION ALL SELECT doc_id, 'no label' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT doc_id, 'repeated text' FROM documents WHERE text IN (SELECT text FROM documents GROUP BY text HAVING count(*) > 1) UNION ALL SELECT doc_id, 'slug' FROM documents WHERE NOT regexp_matches(source || '-' || lang, '^[a-z0-9]+(-[a-z]+)*$')
""")
def quality_errors(spark, sf_dir):
    """All validation errors of all documents."""
    d = read(spark, sf_dir, "documents")
    label = read(spark, sf_dir, "labels").select("doc_id")
    say = lambda df, text: df.select("doc_id", F.lit(text).alias("error"))
    hashed = d.select("doc_id", F.sha2("text", 256).alias("h"))
    out = say(d.where(F.trim("text") == ""), "blank text").unionByName(say(d.join(label, "doc_id", "left_anti"), "no label"))
    out = out.unionByName(say(hashed.join(sync.duplicates(hashed, "h"), "h", "left_semi"), "repeated text"))
    return out.unionByName(say(d.where(~F.concat_ws("-", "source", "lang").rlike("^[a-z0-9]+(-[a-z]+)*$")), "slug"))


@query("""
WITH f AS (SELECT o_custkey, o_orderstatus AS s, min(o_orderkey) AS k, max(CASE o_orderstatus WHEN 'P' THEN 2 WHEN 'F' THEN 1 ELSE 0 END) AS p FROM orders GROUP BY ALL)
SELECT o_custkey, string_agg(s, ' / ' ORDER BY k) AS statuses, CASE max(p) WHEN 2 THEN 'insert' WHEN 1 THEN 'delete' ELSE 'update' END AS op FROM f GROUP BY o_custkey
""")
def group_collect_ordered(spark, sf_dir):
    """Distinct statuses of each customer in order of their first order, and the strongest operation."""
    status = F.col("o_orderstatus")
    first = read(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.min("o_orderkey").alias("k"))
    has = lambda s: F.max(F.when(status == s, 1)).isNotNull()
    return first.groupBy("o_custkey").agg(ordinals.ordered_join(status, F.col("k"), " / ").alias("statuses"), F.when(has("P"), "insert").when(has("F"), "delete").otherwise("update").alias("op"))


@query("SELECT user_id, CAST(count(*) AS BIGINT) AS n, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS ids FROM events WHERE lower(event_type) = lower('PURCHASE') GROUP BY user_id")
def table_rows(spark, sf_dir):
    """Rows of one named part of a table, its name without regard to case."""
    e = read(spark, sf_dir, "events").where(F.lower("event_type") == F.lower(F.lit("PURCHASE")))
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), ordinals.ordered_join(F.col("event_id").cast("string"), F.col("event_id"), ",").alias("ids"))
