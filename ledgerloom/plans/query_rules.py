"""Driver queries: comparison, rules, filters, flags, projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import predicates, scalars
from ledgerloom.operators import joins, rules
from ledgerloom.plans.catalog import query, read


def _big(column: str):
    """A double as whole-number text."""
    return F.floor(column).cast("bigint").cast("string")


@query("""
WITH r AS (
  SELECT c.c_custkey, g.r FROM customer c JOIN orders o ON c_custkey = o_custkey,
  LATERAL (VALUES (coalesce(nullif(o_orderstatus, 'O') = 'P', false)),
                  (CASE WHEN o_totalprice <= 400000 THEN floor(o_totalprice) > 300000 END)) AS g(r))
SELECT c_custkey, CASE WHEN bool_or(coalesce(r, false)) THEN 'violated' WHEN count(*) = count(*) FILTER (NOT r) THEN 'ok' ELSE 'unknown' END AS state,
  CAST(count(*) AS BIGINT) AS n_results, bool_or(r IS NULL) AS any_unknown
FROM r GROUP BY c_custkey
""")
def rule_eval_3vl(spark, sf_dir):
    """State of two guards over each customer's orders, one of them unknown for large orders."""
    orders = read(spark, sf_dir, "orders").select("o_custkey", F.nullif("o_orderstatus", F.lit("O")).alias("status"), F.when(F.col("o_totalprice") <= 400000, _big("o_totalprice")).alias("total"))
    guards = F.array(predicates.compare_with(F.col("status"), "==", "OrderStatus.P"), predicates.compare_with(F.col("total"), ">", "300_000m"))
    each = orders.join(read(spark, sf_dir, "customer").select("c_custkey"), F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", F.explode(guards).alias("r"))
    return each.groupBy("c_custkey").agg(rules.state_of(F.col("r")).alias("state"), F.count(F.lit(1)).alias("n_results"), F.bool_or(F.col("r").isNull()).alias("any_unknown"))


def _values(rows: list) -> str:
    return ", ".join("(" + ("NULL" if x is None else "'" + x + "'") + ")" for x in rows)


_NUM = r"regexp_matches({0}, '^\s*([+-]?[0-9][0-9,]*(\.[0-9]*)?|[+-]?\.[0-9]+|[0-9][0-9,]*(\.[0-9]*)?[+-])\s*$')"
_CAST = "TRY_CAST(regexp_replace(replace(trim({0}), ',', ''), '^(.*)([+-])$', '\\2\\1') AS DECIMAL(28,10))"


@query(f"""
WITH o(op) AS (VALUES {_values(list(predicates.OPERATORS))}),
p AS (SELECT p_partkey,
  CASE p_partkey % 9 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '  ' WHEN 3 THEN p_brand WHEN 4 THEN CAST(p_size AS VARCHAR) WHEN 5 THEN '1,' || lpad(CAST(p_size AS VARCHAR), 3, '0') WHEN 6 THEN CAST(p_size AS VARCHAR) || '-' WHEN 7 THEN '1e' || p_size ELSE 'true' END AS actual,
  CASE p_partkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'null' WHEN 2 THEN '"' || lower(p_brand) || '"' WHEN 3 THEN '1_' || lpad(CAST(p_size AS VARCHAR), 3, '0') || 'm' WHEN 4 THEN CAST(p_size AS VARCHAR) WHEN 5 THEN 'Kind.' || p_brand ELSE 'true' END AS rhs FROM part),
n AS (SELECT *, CASE WHEN rhs IS NULL OR rhs = 'null' THEN NULL WHEN rhs LIKE '"%' THEN trim(rhs, '"') WHEN regexp_matches(rhs, '^[0-9][0-9_]*m?$') THEN regexp_replace(rhs, '[_m]', '', 'g') ELSE regexp_extract(rhs, '[^.]*$') END AS e FROM p, o),
k AS (SELECT *, CASE WHEN {_NUM.format("actual")} THEN {_CAST.format("actual")} END AS x, CASE WHEN {_NUM.format("e")} THEN {_CAST.format("e")} END AS y,
  trim(coalesce(actual, '')) = '' AS blank FROM n)
SELECT p_partkey, op, negated, result FROM (SELECT p_partkey, op,
  CASE op WHEN '==' THEN '!=' WHEN '!=' THEN '==' WHEN '<' THEN '>=' WHEN '>=' THEN '<' WHEN '>' THEN '<=' WHEN '<=' THEN '>' WHEN 'is_null' THEN 'is_not_null' WHEN 'is_not_null' THEN 'is_null'
    WHEN 'is_empty' THEN 'is_not_empty' WHEN 'is_not_empty' THEN 'is_empty' WHEN 'is_true' THEN 'is_false' ELSE 'is_true' END AS negated,
  CASE WHEN op = 'is_null' THEN actual IS NULL WHEN op = 'is_not_null' THEN actual IS NOT NULL WHEN op = 'is_empty' THEN blank WHEN op = 'is_not_empty' THEN NOT blank
    WHEN op = 'is_true' THEN lower(actual) = 'true' WHEN op = 'is_false' THEN lower(actual) = 'false'
    WHEN actual IS NULL OR e IS NULL THEN CASE op WHEN '==' THEN actual IS NOT DISTINCT FROM e WHEN '!=' THEN actual IS DISTINCT FROM e END
    WHEN x IS NOT NULL AND y IS NOT NULL THEN CASE op WHEN '==' THEN x = y WHEN '!=' THEN x <> y WHEN '<' THEN x < y WHEN '<=' THEN x <= y WHEN '>' THEN x > y ELSE x >= y END
    WHEN op = '==' THEN lower(actual) = lower(e) WHEN op = '!=' THEN lower(actual) <> lower(e) END AS result FROM k)
""")
def compare_matrix(spark, sf_dir):
    """All operators on values and constants of every form, made of each part's brand and size."""
    size, brand, three = F.col("p_size").cast("string"), F.col("p_brand"), F.lpad(F.col("p_size").cast("string"), 3, "0")
    pick = lambda n, *forms: F.element_at(F.array(*[f.cast("string") for f in forms]), (F.col("p_partkey") % n + 1).cast("int"))
    actual = pick(9, F.lit(None), F.lit(""), F.lit("  "), brand, size, F.concat(F.lit("1,"), three), F.concat(size, F.lit("-")), F.concat(F.lit("1e"), size), F.lit("true"))
    right = pick(7, F.lit(None), F.lit("null"), F.concat(F.lit('"'), F.lower(brand), F.lit('"')), F.concat(F.lit("1_"), three, F.lit("m")), size, F.concat(F.lit("Kind."), brand), F.lit("true"))
    every = read(spark, sf_dir, "part").select("p_partkey", actual.alias("actual"), right.alias("rhs"), F.explode(F.array(*map(F.lit, predicates.OPERATORS))).alias("op"))
    return every.select("p_partkey", "op", predicates.negate(F.col("op")).alias("negated"), predicates.compare(F.col("actual"), F.col("op"), F.col("rhs")).alias("result"))


@query("""
WITH q AS (SELECT l_returnflag, nullif(CAST(floor(l_quantity) AS BIGINT), 50) AS q FROM lineitem)
SELECT l_returnflag, CAST(count(*) FILTER (q < 25) AS BIGINT) AS n_true, CAST(count(*) FILTER (q >= 25) AS BIGINT) AS n_false, CAST(count(*) FILTER (q IS NULL) AS BIGINT) AS n_unknown,
  CAST(count(*) FILTER (q > 25) AS BIGINT) AS n_flipped FROM q GROUP BY l_returnflag
""")
def rule_negate_partition(spark, sf_dir):
    """An operator, its negation and unknown cut the rows into three; flipping exchanges the sides."""
    q = F.nullif(_big("l_quantity"), F.lit("50"))
    less = predicates.compare_with(q, "<", "25")
    not_less = predicates.compare_with(q, predicates.NEGATED["<"], "25")
    flipped = predicates.compare_with(q, predicates.FLIPPED["<"], "25")
    return read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count_if(less).alias("n_true"), F.count_if(not_less).alias("n_false"), F.count_if(less.isNull()).alias("n_unknown"), F.count_if(flipped).alias("n_flipped"))


@query("""
WITH m AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F' AND o_totalprice >= 100000) AS matched, count(*) AS total FROM orders GROUP BY o_custkey)
SELECT o_custkey, CAST(matched AS BIGINT) AS matched, CAST(total AS BIGINT) AS total, matched = 0 AS is_null_fires, matched > 0 AS any_fires, NOT (matched > 0) AS not_any_fires FROM m
""")
def filter_match_counts(spark, sf_dir):
    """Rows that satisfy a filter's atoms, and guards on the filter's result."""
    condition = "Where(o => o.Status == OrderStatus.F && o.Total >= 100_000 && o.Id == id)"
    atoms = rules.filter_atoms(F.lit(condition.replace("100_000", "100000")))
    value = lambda a: F.when(a["property"] == "Status", F.col("o_orderstatus")).when(a["property"] == "Total", _big("o_totalprice"))
    bound = F.filter(atoms, lambda a: a["right"].isNull() | predicates.is_constant(a["right"]))
    ok = F.forall(bound, lambda a: F.coalesce(predicates.compare(value(a), a["op"], a["right"]), F.lit(False)))
    m = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count_if(ok).alias("matched"), F.count(F.lit(1)).alias("total"))
    fires = lambda c: rules.filter_fires(F.lit(c), F.col("matched"))
    return m.select("o_custkey", "matched", "total", fires("order is null").alias("is_null_fires"), fires("orders.Any()").alias("any_fires"), fires("!orders.Any()").alias("not_any_fires"))


@query("""
WITH v AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
f AS (SELECT event_id, CASE WHEN k < 40 THEN 'true' WHEN k < 80 THEN 'FALSE' END AS value FROM v)
SELECT event_id, lower(value) = 'true' AS enabled_result, lower(value) <> 'true' AS negated_result FROM f
""")
def config_flag_eval(spark, sf_dir):
    """A feature flag read from each event's properties; missing means unknown."""
    k = F.get_json_object("props", "$.k").try_cast("int")
    value = F.when(k < 40, "true").when(k < 80, "FALSE")
    flag = lambda c: rules.flag_result(F.lit(c), value)
    return read(spark, sf_dir, "events").select("event_id", flag('flags.IsEnabledAsync("Pay")').alias("enabled_result"), flag('!flags.IsEnabledAsync("Pay")').alias("negated_result"))


@query("""
WITH r AS (SELECT o_custkey, nullif(o_orderstatus, 'P') = 'O' AS r FROM orders)
SELECT o_custkey, CASE WHEN count(DISTINCT coalesce(CAST(r AS VARCHAR), 'unknown')) = 1 THEN bool_or(r) END AS result FROM r GROUP BY o_custkey
""")
def single_outcome(spark, sf_dir):
    """The outcome on which all rows of a customer agree (unknown counts as an outcome)."""
    r = F.when(F.col("o_orderstatus") != "P", predicates.compare_with(F.col("o_orderstatus"), "==", "OrderStatus.O"))
    return read(spark, sf_dir, "orders").groupBy("o_custkey").agg(rules.single_outcome(r).alias("result"))


_EXITS = {"click": "return", "error": "throw:Net.Timeout", "purchase": "silent_success", "signup": "fail:Taken", "view": "validation"}


@query("""
WITH x(event_type, exit) AS (VALUES ('click', 'return'), ('error', 'throw:Net.Timeout'), ('purchase', 'silent_success'), ('signup', 'fail:Taken'), ('view', 'validation'))
SELECT event_id, exit LIKE 'fail:%' OR exit LIKE 'throw:%' OR exit = 'validation' AS failure,
  CASE exit WHEN 'return' THEN '`return`' WHEN 'silent_success' THEN '`Result.Ok()`, nobody is told' WHEN 'validation' THEN '`Result.Fail` (gate)' WHEN 'fail:Taken' THEN '`Taken`' ELSE 'throws `Net.Timeout`' END AS label,
  CASE exit WHEN 'return' THEN 'Nothing happens and nobody is told.' WHEN 'silent_success' THEN 'Nothing happens and nobody is told.' WHEN 'validation' THEN 'The input is refused.' WHEN 'fail:Taken' THEN 'Refused with `Taken`.' ELSE '`Net.Timeout` is thrown.' END AS on_fail,
  regexp_matches(event_type, '(?i)fail|reject|cancel|error') AS failed_status, exit IN ('silent_success', 'return') AS silent
FROM events JOIN x USING (event_type)
""")
def labels_case(spark, sf_dir):
    """Failure, label and consequence of the exit that each event stands for."""
    exit_ = F.element_at(F.create_map(*[F.lit(x) for p in _EXITS.items() for x in p]), F.col("event_type"))
    e = read(spark, sf_dir, "events").select("event_id", "event_type", exit_.alias("exit"))
    x = F.col("exit")
    return e.select(
        "event_id", scalars.is_failure(x).alias("failure"), scalars.exit_label(x, F.lit("gate"), scalars.EXIT_LABELS).alias("label"), scalars.exit_label(x, F.lit(None).cast("string"), scalars.ON_FAIL).alias("on_fail"), scalars.is_negative(F.col("event_type"), scalars.FAILED_STATUS).alias("failed_status"), x.isin("silent_success", "return").alias("silent")
    )


@query("""
SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority <> '3-MEDIUM' AND regexp_matches(o_orderpriority, '[=<>!?(]|^[12]')
""")
def kind_filters(spark, sf_dir):
    """Rows by kind, by what they are not, and by a pattern; in order of key."""
    o = read(spark, sf_dir, "orders")
    kept = o.where(F.col("o_orderstatus").isin("F", "O") & (F.col("o_orderpriority") != "3-MEDIUM") & F.col("o_orderpriority").rlike("[=<>!?(]|^[12]"))
    return kept.select("o_orderkey", "o_orderpriority").orderBy("o_orderkey")


@query(f"""
WITH v AS (SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN p_size || '_000m' WHEN 1 THEN p_size || '.5M' WHEN 2 THEN 'src/' || p_type || '/Handler.cs:' || p_size WHEN 3 THEN 'src/Pay/' || p_size || '.cs:' || p_partkey
  WHEN 4 THEN p_name WHEN 5 THEN '[*]' WHEN 6 THEN 'Łódź_' || p_size ELSE 'Créé par Ñandú ' || p_type END AS x FROM part)
SELECT p_partkey, x, CASE WHEN regexp_matches(x, '^[0-9][0-9_]*(\\.[0-9]+)?[mM]?$') THEN regexp_replace(x, '[_mM]', '', 'g') ELSE x END AS literal,
  CASE WHEN regexp_matches(x, '^.+:-?[0-9]+$') THEN regexp_extract(x, '[^/]*$') ELSE x END AS file_line,
  CASE WHEN x = '[*]' THEN x ELSE regexp_replace(translate(x, '{scalars.MARKED}', '{scalars.FOLDED}'), '[^A-Za-z0-9_]', '', 'g') END AS state_id,
  CASE WHEN regexp_matches(x, '^[^\\s\\[\\]()]+:[0-9]+$') THEN '[' || regexp_extract(x, '[^/]*$') || '](https://git/c0ffee/' || regexp_extract(x, '^(.+):[0-9]+$', 1) || '#L' || regexp_extract(x, '[0-9]+$') || ')' ELSE x END AS link,
  CAST(2 ** least(length(x), 6) AS BIGINT) AS delay
FROM v
""")
def literals(spark, sf_dir):
    """Number literals, locations, diagram ids and retry delays, made of each part."""
    x, size = F.col("x"), F.col("p_size").cast("string")
    forms = [F.concat(size, F.lit("_000m")), F.concat(size, F.lit(".5M")), F.concat(F.lit("src/"), "p_type", F.lit("/Handler.cs:"), size), F.concat(F.lit("src/Pay/"), size, F.lit(".cs:"), F.col("p_partkey").cast("string")), F.col("p_name"), F.lit("[*]"), F.concat(F.lit("Łódź_"), size), F.concat(F.lit("Créé par Ñandú "), "p_type")]
    parts = read(spark, sf_dir, "part").select("p_partkey", F.element_at(F.array(*forms), (F.col("p_partkey") % 8 + 1).cast("int")).alias("x"))
    return parts.select(
        "p_partkey", "x", scalars.numeric_literal(x).alias("literal"), scalars.file_line(x).alias("file_line"), scalars.state_id(x).alias("state_id"), scalars.code_link(x, "https://git/{commit}/{path}#L{line}", F.lit("c0ffee")).alias("link"), F.pow(F.lit(2), F.least(F.length(x), F.lit(6))).cast("bigint").alias("delay")
    )
