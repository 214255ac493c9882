"""Rules over case data: guards are conditions at which a rule is broken.

Tables (see ``sources.facts`` and ``sources.snapshots``): ``guards`` with ``rule_id``;
``entities`` and ``fields``; the snapshot's ``tables``, ``rows`` and ``config``, each
with a ``case_id``. All rules of all cases are evaluated together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import conditions, predicates, scalars
from ledgerloom.operators import graph, joins

#: How a condition asks for a feature flag (fixed value: input grammar).
FLAG = 'IsEnabledAsync\\(\\s*"([^"]+)"'


def single_outcome(result: Column) -> Column:
    """Aggregate: the only outcome (null counts as one), else null."""
    n = F.count(F.lit(1))
    return F.when((n > 0) & (F.count_if(result) == n), True).when((n > 0) & (F.count_if(~result) == n), False)


def state_of(result: Column, counted: Column | None = None) -> Column:
    """Aggregate: ``violated`` if any result is true, ``ok`` if there are some and all are false, else ``unknown``; of those that are ``counted``."""
    own = F.lit(True) if counted is None else F.coalesce(counted, F.lit(False))
    n = F.count_if(own)
    return F.when(F.count_if(own & result) > 0, "violated").when((n > 0) & (n == F.count_if(own & ~result)), "ok").otherwise("unknown")


def flag_result(condition: Column, value: Column) -> Column:
    """A feature flag's guard: its value, turned by a leading ``!``; unknown without a value."""
    enabled = F.lower(F.trim(value, F.lit('"'))) == "true"
    return F.when(condition.rlike("^\\s*!"), ~enabled).otherwise(enabled)


def filter_fires(condition: Column, matched: Column) -> Column:
    """A guard on the result of a filter: fires on no match if it asks for null, else on a match; a leading ``!`` turns it."""
    bare = F.replace(condition, F.lit(" "), F.lit(""))
    fires = F.when(F.contains(bare, F.lit("isnull")) | F.contains(bare, F.lit("==null")), matched == 0).otherwise(matched > 0)
    return F.when(bare.startswith("!"), ~fires).otherwise(fires)


def filter_atoms(condition: Column) -> Column:
    """Atoms ``(property, op, right)`` of ``M(p => a && b)``; null if it has an ``||`` or another form."""
    form = "(?s)^\\w+\\(\\s*(\\w+)\\s*=>\\s*(.+)\\)$"
    text = F.trim(condition)
    p, body = F.regexp_extract(text, form, 1), F.regexp_extract(text, form, 2)
    compare = "^(\\w+)\\.(\\w+)\\s*(==|!=|<=|>=|<|>)\\s*(.+)$"

    def atom(raw: Column) -> Column:
        a = F.trim(raw)
        of = lambda pattern, own, prop, op, right: F.when(a.rlike(pattern) & (F.regexp_extract(a, pattern, own) == p), F.struct(F.regexp_extract(a, pattern, prop).alias("property"), op.alias("op"), right.alias("right")))
        nothing = F.lit(None).cast("string")
        return F.coalesce(
            of("^!\\s*(\\w+)\\.(\\w+)$", 1, 2, F.lit("is_false"), nothing),
            of("^(\\w+)\\.(\\w+)$", 1, 2, F.lit("is_true"), nothing),
            of(compare, 1, 2, F.regexp_extract(a, compare, 3), F.trim(F.regexp_extract(a, compare, 4))),
        )

    atoms = F.transform(F.split(body, "&&"), atom)
    return F.when((body != "") & ~F.contains(body, F.lit("||")) & ~F.exists(atoms, lambda x: x.isNull()), atoms)


def table_keys() -> list[Column]:
    """Names under which a snapshot may hold an entity's table, best first."""
    snake = scalars.snake_simple(F.col("entity"))
    return [F.col("table"), F.col("entity"), F.concat(snake, F.lit("s")), snake, F.concat(F.col("entity"), F.lit("s"))]


def _small(df: DataFrame, most: int = 10_000) -> DataFrame:
    """A table of guards or entities, broadcast unless it is large."""
    return F.broadcast(df) if df.count() <= most else df


def table_asks(entities: DataFrame) -> DataFrame:
    """``(entity, key, rank)``: the lower-cased names under which a snapshot may hold an entity's table, with the best rank of each."""
    tries = F.filter(F.array(*[F.struct(F.lit(i).alias("rank"), F.lower(c).alias("key")) for i, c in enumerate(table_keys())]), lambda s: s["key"].isNotNull())
    return entities.select("entity", F.explode(tries).alias("t")).groupBy("entity", F.col("t.key").alias("key")).agg(F.min("t.rank").alias("rank"))


def entity_tables(entities: DataFrame, cases: DataFrame, tables: DataFrame) -> DataFrame:
    """``(case_id, entity, rank, snap_table)``: the snapshot's table of each entity in each case, null if it was not fetched."""
    found = tables.select("case_id", F.col("table").alias("snap_table"), F.lower("table").alias("key")).join(_small(table_asks(entities)), "key")
    first = found.groupBy("case_id", "entity").agg(F.min_by("snap_table", "rank").alias("snap_table"))
    return joins.attach_all(cases.select("case_id"), entities.select("entity").distinct()).join(first, ["case_id", "entity"], "left")


def candidates(wanted: DataFrame, fields: DataFrame) -> DataFrame:
    """``(ask, entity)``: the entities that have all properties of an ask (``ask, property``)."""
    need = wanted.groupBy("ask").agg(F.count_distinct(F.lower("property")).alias("need"))
    have = wanted.join(fields.select("entity", F.lower("name").alias("_name")).distinct(), F.lower(F.col("property")) == F.col("_name"))
    return have.groupBy("ask", "entity").agg(F.count_distinct(F.lower("property")).alias("n")).join(need, "ask").where("n = need").select("ask", "entity")


def structure(guards: DataFrame) -> DataFrame:
    """Guards with ``left_side, op, right_side`` out of their ``condition`` where they have none and it is a single comparison."""
    form = conditions.structured(conditions.normal_form(F.col("condition")))
    own = F.col("left_side").isNotNull() | (F.col("kind") == "filter")
    found = guards.withColumn("_form", F.when(~own, form))
    return found.select(*[F.coalesce(c, f"_form.{part}").alias(c) if (part := {"left_side": "left", "op": "op", "right_side": "right"}.get(c)) else F.col(c) for c in guards.columns])


def _meet(left: DataFrame, small: DataFrame, on: list[str], most: int = 10_000) -> DataFrame:
    """``left`` joined with a small side that is counted and broadcast, at most ``most`` rows of it at a time."""
    blocks = max(1, -(-small.count() // most))
    block = F.pmod(F.xxhash64(*[F.col(c) for c in small.columns]), F.lit(blocks))
    out = None
    for b in range(blocks):
        one = left.join(F.broadcast(small if blocks == 1 else small.where(block == b)), on)
        out = one if out is None else out.unionByName(one)
    return out


def _name(kind: str, *of: str) -> Column:
    """The name of an ask: ``s`` a guard's comparison, ``a`` a comparison in its condition, ``c`` the condition, ``f`` a filter, ``x`` a flag."""
    return F.concat_ws("\u0001", F.lit(kind), *of)


#: The ask of guards that nothing in a case decides.
_NOTHING = "n"
#: What a record of a case is.
_CASE, _TABLE, _ROW, _CONFIG = range(4)
#: An atom as rows meet it: lower-cased names of its column, best first, the operator, the constant and the number that it means.
_ATOM = ("k0", "k1", "k2", "op", "expected", "b")


def _atoms(asked: DataFrame, fields: DataFrame) -> DataFrame:
    """``asked`` (``entity, property, op, right, ...``) with what its atoms need, worked out once for all rows."""
    f = fields.select(F.col("entity").alias("_entity"), F.lower("name").alias("_name"), F.col("column").alias("_column"))
    named = asked.join(f, (F.col("entity") == F.col("_entity")) & (F.lower(F.col("property")) == F.col("_name")), "left")
    keys = {f"k{i}": F.lower(c) for i, c in enumerate((F.col("_column"), scalars.snake_simple(F.col("property")), F.col("property")))}
    return named.withColumns(keys | {"expected": predicates.normalize(F.col("right"))}).withColumn("b", predicates.number(F.col("expected")))


def _held(low: Column, atom) -> tuple[Column, Column]:
    """Whether a row, by its lower-cased names, has an atom's column, and the value."""
    there = [F.coalesce(F.map_contains_key(low, atom(f"k{i}")), F.lit(False)) for i in range(3)]
    value = F.lit(None).cast("string")
    for i in (2, 1, 0):
        value = F.when(there[i], F.try_element_at(low, atom(f"k{i}"))).otherwise(value)
    return there[0] | there[1] | there[2], value


def _all_hold(atoms: Column, low: Column) -> Column:
    """Whether all of some atoms are known to hold for a row."""
    keep = ("op", "expected", "b")
    valued = F.transform(atoms, lambda a: F.struct(_held(low, lambda c: a[c])[1].alias("value"), *[a[c].alias(c) for c in keep]))
    sided = F.transform(valued, lambda a: F.struct(a["value"].alias("value"), predicates.number(a["value"]).alias("a"), *[a[c].alias(c) for c in keep]))
    return F.coalesce(F.forall(sided, lambda a: F.coalesce(predicates.decide(a["value"], a["op"], a["expected"], a["a"], a["b"]), F.lit(False))), F.lit(True))


def _comparisons(guards: DataFrame, parse: bool) -> DataFrame:
    """``(ask, owner, place, left_side, op, right)``: the comparisons of guards; with ``parse`` also those in a condition, by their places."""
    own = guards.where("left_side IS NOT NULL").select(_name("s", "guard_id").alias("ask"), _name("s", "guard_id").alias("owner"), F.lit(None).cast("int").alias("place"), "left_side", "op", F.col("right_side").alias("right"))
    if not parse:
        return own
    formed = guards.where("left_side IS NULL").select("guard_id", F.posexplode(conditions.normal_form(F.col("condition"))["atoms"]).alias("place", "a")).where("a.op IS NOT NULL")
    return own.unionByName(formed.select(_name("a", "guard_id", "place").alias("ask"), _name("c", "guard_id").alias("owner"), "place", F.col("a.left").alias("left_side"), "a.op", F.col("a.right").alias("right")))


def _asks(guards: DataFrame, filters: DataFrame, entities: DataFrame, fields: DataFrame, parse: bool) -> tuple[DataFrame, DataFrame]:
    """What guards and filters ask of cases: by ask, and by the records that answer.

    The first: ``(ask, owner, place, left_side, property, can, sole, condition)``; ``can``: a
    filter can be read, ``sole``: the entity if no case is needed to tell it. The second:
    ``(ask, entity, key, rank, filters, more, ...)`` with an atom, for each name of a table
    (``more``: the other atoms of a filter).
    """
    text, number = F.lit(None).cast("string"), F.lit(None).cast("int")
    compared = graph.cut(_comparisons(guards, parse).select("*", scalars.tail(F.col("left_side")).alias("property")))
    filters = graph.cut(filters.select(_name("f", "guard_id").alias("ask"), "condition", filter_atoms(F.col("condition")).alias("atoms")))
    e = entities.groupBy(F.lower("entity").alias("_e")).agg(F.min("entity").alias("entity"))
    direct = compared.join(e, F.lower(F.regexp_extract("left_side", "^(.+)\\.[^.]*$", 1)) == F.col("_e"), "left")
    wanted = direct.where("entity IS NULL").select("ask", "property").unionByName(filters.select("ask", F.explode("atoms").alias("a")).select("ask", "a.property").distinct())
    guess = candidates(wanted, fields).join(entities.select("entity"), "entity", "left_semi").select("ask", "entity")
    pairs = graph.cut(direct.where("entity IS NOT NULL").select("ask", "entity").unionByName(guess))
    sole = pairs.groupBy("ask").agg(F.when(F.count(F.lit(1)) == 1, F.min("entity")).alias("sole"))
    asks = compared.select("ask", "owner", "place", "left_side", "property", F.lit(None).cast("boolean").alias("can"), text.alias("condition"))
    asks = asks.unionByName(filters.select("ask", F.col("ask").alias("owner"), number.alias("place"), text.alias("left_side"), text.alias("property"), F.col("atoms").isNotNull().alias("can"), "condition"))
    # A filter's comparisons with something else than a constant are bound to the case and dropped.
    kept = F.filter("atoms", lambda a: a["right"].isNull() | predicates.is_constant(a["right"]))
    parts = filters.join(pairs, "ask").select("ask", "entity", F.posexplode(kept).alias("at", "a")).select("ask", "entity", "at", "a.property", "a.op", "a.right")
    every = _atoms(parts, fields).groupBy("ask", "entity").agg(F.array_sort(F.collect_list(F.struct("at", *_ATOM))).alias("every"))
    whole = filters.select("ask").join(pairs, "ask").join(every, ["ask", "entity"], "left")
    whole = whole.select("ask", "entity", F.lit(True).alias("filters"), *[F.col("every")[0][c].alias(c) for c in _ATOM], F.slice("every", F.lit(2), F.greatest(F.size("every") - 1, F.lit(0))).alias("more"))
    one = _atoms(compared.join(pairs, "ask"), fields).select("ask", "entity", F.lit(False).alias("filters"), *_ATOM, F.lit(None).cast(whole.schema["more"].dataType).alias("more"))
    return asks.join(sole, "ask", "left"), one.unionByName(whole).join(table_asks(entities), "entity")


def _records(meets: DataFrame, cases: DataFrame, tables: DataFrame | None, rows: DataFrame, config: DataFrame) -> DataFrame:
    """Cases with their tables, rows and settings, as far as anything asks for them; all of a case in one partition, so that what is grouped by case and more is not dealt again."""
    text = F.lit(None).cast("string")
    other = {"name": text, "row_pos": F.lit(None).cast(rows.schema["pos"].dataType), "row": F.lit(None).cast(rows.schema["row"].dataType), "flag_value": text}
    record = lambda df, what, **own: df.select("case_id", F.lit(what).alias("what"), *[own.get(c, other[c]).alias(c) for c in other])

    def met(df: DataFrame, name: str, kind: int) -> DataFrame:
        keys = meets.where(F.col("kind") == kind).select(F.col("key").alias("_key")).distinct()
        return df.where("case_id IS NOT NULL").join(F.broadcast(keys), F.lower(name) == F.col("_key"), "left_semi")

    every = record(cases, _CASE, name=F.lit("")).unionByName(record(met(rows, "table", _TABLE), _ROW, name=F.col("table"), row_pos=F.col("pos"), row=F.col("row")))
    if tables is not None:
        every = every.unionByName(record(met(tables, "table", _TABLE), _TABLE, name=F.col("table")))
    return every.unionByName(record(met(config, "key", _CONFIG), _CONFIG, name=F.col("key"), flag_value=F.col("value"))).repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "case_id")


def _answers(meets: DataFrame, cases: DataFrame, tables: DataFrame | None, rows: DataFrame, config: DataFrame) -> DataFrame:
    """``(case_id, ask, n_entities, best)`` for each case and ask: how many of its entities were fetched, and what the best table, or the setting, says.

    Asks are sent to the records: a row's names and an ask's constant are worked out
    once, not for each pair, and no ask of a case is joined with anything over a shuffle.
    """
    low = F.map_from_arrays(F.transform(F.map_keys("row"), F.lower), F.map_values("row"))
    kind = F.when(F.col("what") == _ROW, _TABLE).otherwise(F.col("what"))
    every = _records(meets, cases, tables, rows, config).select("*", low.alias("_low"), kind.alias("kind"), F.lower("name").alias("key")).drop("row")
    has, value = _held(F.col("_low"), F.col)
    v = _meet(every, meets, ["kind", "key"]).withColumn("has", has).withColumn("value", value).withColumn("_a", predicates.number(F.col("value")))
    v = v.withColumn("one", predicates.decide(F.col("value"), F.col("op"), F.col("expected"), F.col("_a"), F.col("b")))
    row, filters = F.col("what") == _ROW, F.col("filters")
    ok = F.when(row & ~filters, F.col("one")).when(row & F.col("row_pos").isNotNull(), (F.col("op").isNull() | F.coalesce("one", F.lit(False))) & _all_hold(F.col("more"), F.col("_low")))
    snap_table = F.when(F.col("what").isin(_TABLE, _ROW), F.col("name"))
    shown = F.when(row & ~filters, F.coalesce("value", F.lit("null"))).when(F.col("what") == _CONFIG, F.col("flag_value"))
    v = v.select("case_id", "ask", "entity", snap_table.alias("snap_table"), "what", "rank", "row_pos", F.when(row, F.col("has")).alias("has"), ok.alias("ok"), shown.alias("value"))
    # Equal values come together before they are listed, so a list is as long as the evidence that it becomes.
    valued = v.groupBy("case_id", "ask", "entity", "snap_table", "value").agg(
        F.min("rank").alias("rank"),
        F.min("row_pos").alias("row_pos"),
        F.bool_or(F.col("what") == _CASE).alias("asked"),
        F.bool_or(F.col("what").isin(_TABLE, _CONFIG) | (F.lit(tables is None) & (F.col("what") == _ROW))).alias("fetched"),
        F.bool_or(F.col("what") == _CONFIG).alias("flag"),
        F.bool_and("has").alias("has"),
        F.count("row_pos").alias("n"),
        F.count_if(F.col("what") == _ROW).alias("total"),
        F.count_if("ok").alias("matched"),
        F.count_if(~F.col("ok")).alias("failed"),
    )
    said = valued.groupBy("case_id", "ask", "entity", "snap_table").agg(
        *[F.min(c).alias(c) for c in ("rank", "has")],
        *[F.max(c).alias(c) for c in ("asked", "fetched")],
        *[F.sum(c).alias(c) for c in ("n", "total", "matched", "failed")],
        F.collect_list(F.when(F.col("flag") | ((F.col("total") > 0) & F.col("value").isNotNull()), F.struct("row_pos", "value"))).alias("shown"),
    )
    outcome = F.when((F.col("total") > 0) & (F.col("matched") == F.col("total")), True).when((F.col("total") > 0) & (F.col("failed") == F.col("total")), False)
    best = F.struct("rank", "snap_table", "n", "total", "has", "matched", outcome.alias("outcome"), F.sort_array("shown").alias("shown"))
    each = said.select("case_id", "ask", "asked", F.when(F.col("fetched"), F.col("entity")).alias("entity"), F.when(F.col("fetched"), best).alias("best"))
    found = each.groupBy("case_id", "ask").agg(F.bool_or("asked").alias("asked"), F.min("entity").alias("first"), F.max("entity").alias("last"), F.min("best").alias("best"))
    n = F.when(F.col("first").isNull(), 0).when(F.col("first") == F.col("last"), 1).otherwise(2)
    return found.where("asked").select("case_id", "ask", n.alias("n_entities"), "best")


def _results(answers: DataFrame, asks: DataFrame, parse: bool) -> DataFrame:
    """``(case_id, owner, every, matched, lost, flags)``: what guards, filters and flags come to; ``every``: ``(place, result, evidence)`` of a guard's comparisons."""
    told = F.col("sole").isNotNull() | (F.col("n_entities") == 1)
    values = F.transform("best.shown", lambda s: s["value"])
    each = _meet(answers, asks, ["ask"]).withColumn("flags", F.when(F.col("left_side").isNull() & F.col("can").isNull(), values)).withColumn("told", told).withColumn("best", F.when(F.col("told"), F.col("best")))
    b = lambda c: F.col(f"best.{c}")
    none = F.col("best").isNull()
    compared = (
        F.when(~F.col("told"), F.concat(F.lit("no table known for "), "left_side"))
        .when(none, F.concat(F.lit("table not fetched: "), "sole"))
        .when(b("n") == 0, F.concat(F.lit("no row in "), b("snap_table")))
        .when(~b("has"), F.concat(F.lit("no column "), "property", F.lit(" in "), b("snap_table")))
        .otherwise(F.concat(b("snap_table"), F.lit("."), "property", F.lit(" = "), F.array_join(values, ", ")))
    )
    filtered = (
        F.when(~F.col("can"), F.concat(F.lit("filter can't be checked: "), F.col("condition")))
        .when(~F.col("told"), F.concat(F.lit("no table known for filter: "), F.col("condition")))
        .when(none, F.concat(F.lit("table not fetched: "), "sole"))
        .otherwise(F.concat(b("snap_table"), F.lit(": "), b("matched").cast("string"), F.lit(" of "), b("total").cast("string"), F.lit(" rows match")))
    )
    is_filter = F.col("can").isNotNull()
    one = F.struct("place", F.when((b("n") > 0) & b("has"), b("outcome")).alias("result"), F.when(is_filter, filtered).when(F.col("left_side").isNotNull(), compared).alias("evidence"))
    each = each.select("case_id", "owner", one.alias("one"), F.when(F.col("can"), b("matched")).alias("matched"), (F.col("told") & none & F.coalesce("can", F.lit(True))).alias("lost"), "flags")
    if not parse:
        return each.select("case_id", "owner", F.array("one").alias("every"), "matched", "lost", "flags")
    return each.groupBy("case_id", "owner").agg(F.array_sort(F.collect_list("one")).alias("every"), F.max("matched").alias("matched"), F.bool_or("lost").alias("lost"), F.flatten(F.collect_list("flags")).alias("flags"))


def evaluate(rule_guards: DataFrame, entities: DataFrame, fields: DataFrame, cases: DataFrame, tables: DataFrame | None, rows: DataFrame, config: DataFrame, parse: bool = False) -> DataFrame:
    """``(case_id, rule_id, state, silent, evidence, missing)`` for each rule and case; ``missing``: evidence that says what the case lacks.

    ``rule_guards``: ``rule_id, pos, guard_id, kind, condition, exit, left_side, op,
    right_side``. Only a rule's first filter counts; once it has one, every other guard
    that is neither validation nor a flag is decided by the filter's count. With ``parse``
    guards without a structured form are evaluated by what their condition says. Without
    ``tables`` a case has the tables that it has rows of.
    """
    is_filter = F.col("kind") == "filter"
    own = F.col("filter_id").eqNullSafe(F.col("guard_id"))
    filters = rule_guards.where(is_filter).groupBy("rule_id").agg(F.min_by("guard_id", "pos").alias("filter_id"))
    only_filters = rule_guards.groupBy("rule_id").agg((F.min(F.when(is_filter, 1).otherwise(0)) == 1).alias("only"))
    flag = F.regexp_extract("condition", FLAG, 1)
    uses = rule_guards.join(filters, "rule_id", "left").join(only_filters, "rule_id").withColumn("flag", F.when(flag != "", flag))
    by = F.when(is_filter, F.when(own, "f").otherwise(_NOTHING)).when(F.col("exit") == "validation", _NOTHING).when(F.col("flag").isNotNull(), "x").when(F.col("filter_id").isNotNull(), "f").otherwise("s")
    uses = graph.cut(uses.withColumn("by", by))
    asks, meets = _asks(uses.where("by = 's'").dropDuplicates(["guard_id"]), uses.where(is_filter & own).dropDuplicates(["guard_id"]), entities, fields, parse)
    asks = graph.cut(asks)
    flags = uses.where("by = 'x'").select(F.lower("flag").alias("key")).distinct().withColumn("ask", _name("x", "key"))
    bare = flags.select("ask").unionByName(uses.sparkSession.range(1).select(F.lit(_NOTHING).alias("ask")))
    asks_all = asks.unionByName(bare.withColumn("owner", F.col("ask")), allowMissingColumns=True)
    meets = meets.withColumn("kind", F.lit(_TABLE)).unionByName(flags.withColumn("kind", F.lit(_CONFIG)), allowMissingColumns=True)
    meets = graph.cut(meets.unionByName(asks_all.select("ask", F.lit(_CASE).alias("kind"), F.lit("").alias("key")), allowMissingColumns=True))
    found = _results(_answers(meets, cases, tables, rows, config), graph.cut(asks_all), parse)
    guards = asks.where("left_side IS NOT NULL").select(F.col("owner").alias("_owner")).distinct()
    compared = F.when(F.col("left_side").isNotNull(), _name("s", "guard_id")).otherwise(_name("c", "guard_id"))
    asked = F.when(F.col("by") == "f", _name("f", "filter_id")).when(F.col("by") == "x", F.concat_ws("\u0001", F.lit("x"), F.lower("flag"))).when(F.col("by") == "s", compared)
    uses = uses.withColumn("_asked", asked).join(guards, F.col("_asked") == F.col("_owner"), "left")
    uses = uses.withColumn("owner", F.when((F.col("by") == "s") & F.col("_owner").isNull(), _NOTHING).otherwise(F.coalesce("_asked", F.lit(_NOTHING)))).drop("_asked")
    if parse:
        uses = uses.withColumn("form", F.when(F.col("_owner").startswith("c"), conditions.normal_form(F.col("condition"))))
    every = _meet(found, graph.cut(uses), ["owner"])
    s_result, s_evidence = F.col("every")[0]["result"], F.col("every")[0]["evidence"]
    if parse:
        each = F.map_from_entries(F.transform(F.filter("every", lambda x: x["place"].isNotNull()), lambda x: F.struct(x["place"], x["result"])))
        every = every.withColumn("results", each)
        s_result = F.when(F.col("form").isNotNull(), conditions.holds(F.col("form"), lambda a, place: F.try_element_at("results", place))).otherwise(s_result)
        s_evidence = F.when(F.col("form").isNotNull(), F.array_join(F.array_distinct(F.transform("every", lambda x: x["evidence"])), "; ")).otherwise(s_evidence)
    s_evidence = F.when(F.col("_owner").isNotNull(), s_evidence)
    values = F.when(F.size("flags") > 0, F.col("flags")).otherwise(F.array(F.lit(None).cast("string")))
    every = every.withColumn("flag_value", F.explode(values))
    result = (
        F.when(is_filter, F.when(F.col("only") & own, F.col("matched") == 0))
        .when(F.col("exit") == "validation", F.lit(None).cast("boolean"))
        .when(F.col("flag").isNotNull(), flag_result(F.col("condition"), F.col("flag_value")))
        .when(F.col("filter_id").isNotNull(), filter_fires(F.col("condition"), F.col("matched")))
        .otherwise(s_result)
    )
    evidence = (
        F.when(is_filter, F.when(own, F.col("every")[0]["evidence"]))
        .when(F.col("exit") == "validation", F.concat(F.lit("input data, not in the database: "), F.col("condition")))
        .when(F.col("flag").isNotNull(), F.when(F.col("flag_value").isNull(), F.concat(F.lit("no value for flag "), F.col("flag"))).otherwise(F.concat(F.lit("flag "), F.col("flag"), F.lit(" = "), F.col("flag_value"))))
        .when(F.col("filter_id").isNotNull(), F.lit(None).cast("string"))
        .otherwise(F.coalesce(s_evidence, F.concat(F.lit("can't be checked: "), F.col("condition"))))
    )
    # What the case lacks, by its reason: a table of the guard or the filter, or a flag's value.
    lacks = (
        F.when(is_filter, own & F.col("lost"))
        .when(F.col("exit") == "validation", F.lit(False))
        .when(F.col("flag").isNotNull(), F.col("flag_value").isNull())
        .when(F.col("filter_id").isNotNull(), F.lit(False))
        .otherwise(F.col("_owner").isNotNull() & F.col("lost"))
    )
    every = every.withColumn("lost", lacks)
    counted = ~is_filter | (F.col("only") & own)
    judged = every.withColumn("result", result).withColumn("evidence", evidence).withColumn("counted", counted)
    said = F.when(F.col("evidence").isNotNull(), F.struct(F.when(is_filter, -1).otherwise(F.col("pos")).alias("o"), "evidence", "lost"))
    found = judged.groupBy("case_id", "rule_id").agg(
        state_of(F.col("result"), F.col("counted")).alias("state"),
        F.bool_or(F.col("exit").isin("silent_success", "return")).alias("silent"),
        F.sort_array(F.collect_list(said)).alias("said"),
    )
    missing = F.array_distinct(F.transform(F.filter("said", lambda x: x["lost"]), lambda x: x["evidence"]))
    return found.select("case_id", "rule_id", "state", "silent", F.transform("said", lambda x: x["evidence"]).alias("evidence"), F.sort_array(missing).alias("missing"))
