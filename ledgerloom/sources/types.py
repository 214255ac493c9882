"""Facts of types and calls, where another tool has read them from code, made into entries.

``types``: ``type_id, namespace, project, is_static, is_abstract, interfaces, base_types``
(arrays of type ids without their arguments). Reading source code is not done here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import scalars

#: What a type must implement or derive from to be an entry of a kind; the first that fits counts (fixed values).
KINDS = (("validator", "AbstractValidator"), ("behavior", "IPipelineBehavior"), ("request_handler", "IRequestHandler"), ("event_handler", "INotificationHandler"))


def _has(name: str) -> Column:
    short = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), scalars.short)
    return F.array_contains(F.concat(short(F.col("interfaces")), short(F.col("base_types"))), name)


def entry_kind(kinds: Sequence[tuple[str, str]] = KINDS) -> Column:
    """The kind of a type's entry; null for types that are none (abstract and static ones among them)."""
    out = F.lit(None).cast("string")
    for kind, name in reversed(kinds):
        out = F.when(_has(name), kind).otherwise(out)
    return F.when(~F.coalesce("is_abstract", F.lit(False)) & ~F.coalesce("is_static", F.lit(False)), out)


def entries(types: DataFrame) -> DataFrame:
    """``(entry_id, kind, module, layer)`` of the types that are entries."""
    found = types.withColumn("kind", entry_kind()).where("kind IS NOT NULL")
    return found.select(F.concat(F.lit("T:"), "type_id").alias("entry_id"), "kind", scalars.module_of(F.col("project")).alias("module"), scalars.layer_of(F.col("project")).alias("layer"))


def is_event() -> Column:
    return _has("INotification")


def is_entity(suffixes: Sequence[str], errors: Sequence[str] = ("Exception", "Error")) -> Column:
    """Whether a type is an entity: not static, in a namespace with one of the suffixes, no event and no error."""
    placed = F.lit(False)
    for s in suffixes:
        placed = placed | F.col("namespace").endswith(s)
    wrong = F.lit(False)
    for e in errors:
        wrong = wrong | _has(e)
    return F.coalesce(placed, F.lit(False)) & ~F.coalesce("is_static", F.lit(False)) & ~is_event() & ~wrong


def endpoints(routes: DataFrame) -> DataFrame:
    """``(entry_id, kind)`` of routes ``verb, route``: ``VERB /route`` with one slash before and none after."""
    path = F.concat(F.lit("/"), F.regexp_replace(F.coalesce("route", F.lit("")), "^/+|/+$", ""))
    return routes.select(F.concat(F.upper("verb"), F.lit(" "), path).alias("entry_id"), F.lit("endpoint").alias("kind"))


def implementations(calls: DataFrame, implements: DataFrame) -> DataFrame:
    """Calls (``caller, callee``) of interface methods lead to their implementations (``method, implementation``); others stay. ``caller, callee, target``."""
    return calls.join(implements.select(F.col("method").alias("callee"), F.col("implementation").alias("_to")).distinct(), "callee", "left").select("caller", "callee", F.coalesce("_to", "callee").alias("target"))


def dependencies(constructors: DataFrame) -> DataFrame:
    """``(type_id, dependencies)``: parameter types of the widest constructor (``type_id, pos, parameters``), the first of equally wide ones."""
    best = constructors.groupBy("type_id").agg(F.min(F.struct((-F.size("parameters")).alias("n"), "pos", "parameters")).alias("c"))
    return best.select("type_id", F.col("c.parameters").alias("dependencies"))


def exit_of(statement: Column, argument: Column) -> Column:
    """The exit that a guard's branch makes: ``statement`` is what it does, ``argument`` the thrown or failed type."""
    return (
        F.when(statement == "throw", F.concat(F.lit("throw:"), scalars.short(argument)))
        .when(statement == "fail", F.concat(F.lit("fail:"), scalars.tail(argument)))
        .when((statement == "return") & argument.isNull(), "return")
        .when((statement == "return") & (scalars.tail(argument) == "Ok"), "silent_success")
        .when(statement == "return", "return_value")
        .when(statement == "propagate", "propagate")
    )


def result_handling(uses: DataFrame) -> DataFrame:
    """``(send_id, detail)``: what happens to the result of a send, by its strongest use (``send_id, use``): propagated, http, logged, used, else ignored."""
    rank = F.when(F.col("use") == "propagated", 0).when(F.col("use") == "http", 1).when(F.col("use") == "logged", 2).when(F.col("use") == "used", 3).otherwise(4)
    names = F.array(*[F.lit(x) for x in ("propagated", "http", "logged", "used", "ignored")])
    return uses.groupBy("send_id").agg(F.element_at(names, F.min(rank) + 1).alias("detail"))


def constant_text(kind: Column, value: Column, type_name: Column) -> Column:
    """A constant as facts write it: ``Type.Member`` of an enum, quoted text, true or false, a number with a point; null otherwise."""
    return (
        F.when(kind == "enum", F.concat(type_name, F.lit("."), value))
        .when(kind == "string", F.concat(F.lit('"'), value, F.lit('"')))
        .when(kind == "bool", F.lower(value))
        .when((kind == "number") & F.replace(value, F.lit(","), F.lit(".")).rlike("^[+-]?[0-9.]+([eE][+-]?[0-9]+)?$"), F.replace(value, F.lit(","), F.lit(".")))
        .when(kind == "null", "null")
    )


def first_guard(writes: DataFrame, guards: DataFrame) -> DataFrame:
    """``(method, field, condition)``: the guard that a status write (``method, field``) depends on.

    Of the failing guards of the method (``method, pos, field, op, right_side, condition,
    exit``) the first that compares the written field by ``!=`` with a constant, else the first.
    """
    failing = guards.where(scalars.is_failure(F.col("exit"))).select("method", "pos", F.col("field").alias("_field"), "op", "right_side", "condition")
    on_field = F.coalesce((F.col("_field") == F.col("field")) & (F.col("op") == "!=") & F.col("right_side").isNotNull(), F.lit(False))
    both = writes.select("method", "field").distinct().join(failing, "method", "left")
    return both.groupBy("method", "field").agg(F.min_by("condition", F.when(F.col("condition").isNotNull(), F.struct((~on_field).alias("other"), "pos"))).alias("condition"))
