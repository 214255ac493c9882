"""Comparison of case data with the constants of rules.

The result is true, false or null (unknown). It is unlike SQL's ``=``: equality with
null is decided, numbers compare as numbers when both sides are, other text compares
without regard to case and has no order.
"""

from __future__ import annotations

import re
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

DECIMAL = "decimal(38,10)"
#: White space around, one sign, thousands commas and a point; no exponent.
NUMBER = r"^\s*([+-]?[0-9][0-9,]*(\.[0-9]*)?|[+-]?\.[0-9]+|[0-9][0-9,]*(\.[0-9]*)?[+-])\s*$"
NEGATED = {"==": "!=", "!=": "==", "<": ">=", ">=": "<", ">": "<=", "<=": ">", "is_null": "is_not_null", "is_not_null": "is_null", "is_empty": "is_not_empty", "is_not_empty": "is_empty", "is_true": "is_false", "is_false": "is_true"}
FLIPPED = {"<": ">", ">": "<", "<=": ">=", ">=": "<="}
OPERATORS = tuple(NEGATED)


def number(text: Column) -> Column:
    """The number that a text means, else null. A sign may also come last. Bare digits, the common case, need no pattern."""
    digits = F.length(text).between(1, 18) & (F.translate(text, "0123456789", "") == "")
    plain = F.regexp_replace(F.trim(text), ",", "")
    turned = F.regexp_replace(plain, "^(.*)([+-])$", "$2$1")
    return F.when(digits, text.try_cast(DECIMAL)).when(text.rlike(NUMBER), turned.try_cast(DECIMAL))


def normalize(right: Column) -> Column:
    """A rule's constant as data would hold it: null, unquoted text, a bare number, or a member's name."""
    digits = F.replace(F.regexp_replace(right, "[mM]+$", ""), F.lit("_"), F.lit(""))
    return (
        F.when(right.isNull() | (right == "null"), F.lit(None).cast("string"))
        .when(right.startswith('"'), F.regexp_replace(right, '^"+|"+$', ""))
        .when(number(digits).isNotNull(), digits)
        .otherwise(F.substring_index(right, ".", -1))
    )


def is_constant(text: Column) -> Column:
    """Whether a filter's right side is a constant. Underscores are not taken out here, so ``20_000m`` is none."""
    bare = F.regexp_replace(text, "[mM]+$", "")
    return text.isin("true", "false", "null") | text.startswith('"') | number(bare).isNotNull() | text.rlike("^[A-Z]\\w*\\.[A-Z]\\w*$")


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, so that nested expressions don't multiply."""
    return F.element_at(F.transform(F.array(value), body), 1)


def compare(actual: Column, op: Column, right: Column) -> Column:
    """True, false or null (unknown) for the twelve operators; any other gives null."""
    known = F.struct(actual.alias("actual"), op.alias("op"), normalize(right).alias("expected"))
    sides = lambda s: F.struct(s["actual"].alias("actual"), s["op"].alias("op"), s["expected"].alias("expected"), number(s["actual"]).alias("a"), number(s["expected"]).alias("b"))
    return _let(known, lambda s: _let(sides(s), _decide))


def _decide(s: Column) -> Column:
    return decide(*(s[c] for c in ("actual", "op", "expected", "a", "b")))


def decide(actual: Column, op: Column, expected: Column, a: Column, b: Column) -> Column:
    """``compare`` with what is worked out beforehand: the normalized constant, and the numbers of both sides."""
    blank = F.coalesce(actual, F.lit("")).rlike("(?U)^\\s*$")
    same = F.lower(actual) == F.lower(expected)
    numeric = F.when(op == "==", a == b).when(op == "!=", a != b).when(op == "<", a < b).when(op == "<=", a <= b).when(op == ">", a > b).when(op == ">=", a >= b)
    one_null = F.when(op == "==", actual.isNull() & expected.isNull()).when(op == "!=", actual.isNotNull() | expected.isNotNull())
    return (
        F.when(op == "is_null", actual.isNull())
        .when(op == "is_not_null", actual.isNotNull())
        .when(op == "is_empty", blank)
        .when(op == "is_not_empty", ~blank)
        .when(op == "is_true", F.lower(actual) == "true")
        .when(op == "is_false", F.lower(actual) == "false")
        .when(actual.isNull() | expected.isNull(), one_null)
        .when(a.isNotNull() & b.isNotNull(), numeric)
        .when(op == "==", same)
        .when(op == "!=", ~same)
    )


def constant(right: str | None) -> tuple[str | None, Decimal | None]:
    """A rule's constant, as ``normalize`` and ``number`` give it, where it is known beforehand."""
    if right is None or right == "null":
        return None, None
    if right.startswith('"'):
        text = right.strip('"')
    else:
        digits = re.sub("[mM]+$", "", right).replace("_", "")
        text = digits if re.search(NUMBER, digits) else right.rsplit(".", 1)[-1]
    if not re.search(NUMBER, text):
        return text, None
    plain = re.sub("^(.*)([+-])$", r"\2\1", text.strip(" ").replace(",", ""))
    return text, Decimal(plain)


def compare_with(actual: Column, op: str, right: str | None) -> Column:
    """``compare`` with an operator and a constant that are known beforehand: only what they need is computed for a row."""
    expected, b = constant(right)
    unknown = F.lit(None).cast("boolean")
    if op in ("is_null", "is_not_null"):
        return actual.isNull() if op == "is_null" else actual.isNotNull()
    if op in ("is_empty", "is_not_empty"):
        blank = F.coalesce(actual, F.lit("")).rlike("(?U)^\\s*$")
        return blank if op == "is_empty" else ~blank
    if op in ("is_true", "is_false"):
        return F.lower(actual) == op[3:]
    if expected is None:
        return actual.isNull() if op == "==" else actual.isNotNull() if op == "!=" else unknown
    same = F.lower(actual) == expected.lower()
    text = same if op == "==" else ~same if op == "!=" else unknown
    if b is not None:
        a, c = number(actual), F.lit(b).cast(DECIMAL)
        numeric = {"==": a == c, "!=": a != c, "<": a < c, "<=": a <= c, ">": a > c, ">=": a >= c}.get(op, unknown)
        text = F.when(a.isNotNull(), numeric).otherwise(text)
    return F.when(actual.isNotNull(), text).otherwise(F.lit(op == "!=") if op in ("==", "!=") else unknown)


def _lookup(op: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), op)


def negate(op: Column) -> Column:
    """The operator that holds exactly where this one does not."""
    return _lookup(op, NEGATED)


def flip(op: Column) -> Column:
    """The operator with its sides exchanged."""
    return F.coalesce(_lookup(op, FLIPPED), op)


def opposite(condition: Column) -> Column:
    """The text of a negated condition."""
    return (
        F.when(condition.rlike("^[^=!<>&|]+ != [^=!<>&|]+$"), F.replace(condition, F.lit(" != "), F.lit(" == ")))
        .when(condition.rlike("^[^=!<>&|]+ == [^=!<>&|]+$"), F.replace(condition, F.lit(" == "), F.lit(" != ")))
        .otherwise(F.concat(F.lit("!("), condition, F.lit(")")))
    )
