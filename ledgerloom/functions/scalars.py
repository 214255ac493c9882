"""Scalar functions on names, locations, paths and markup, Column in and Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def _letters_with_marks() -> tuple[str, str]:
    """Letters that decompose to an ASCII letter and marks, and these letters; ``ł`` stands for ``l``."""
    import unicodedata

    plain = {chr(c): unicodedata.normalize("NFD", chr(c))[0] for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]}
    pairs = {c: p for c, p in plain.items() if p != c and p.isascii()} | {"ł": "l", "Ł": "L"}
    return "".join(pairs), "".join(pairs.values())


MARKED, FOLDED = _letters_with_marks()


def tail(value: Column) -> Column:
    """What follows the last dot."""
    return F.substring_index(value, ".", -1)


def short(type_id: Column) -> Column:
    """Bare type name: without ``T:``, namespace and generic arity."""
    return F.regexp_replace(tail(F.regexp_replace(type_id, "^T:", "")), "`.*$", "")


def full(type_id: Column) -> Column:
    """Type name with namespace; an arity of n is shown as ``<``, n - 1 commas, ``>``."""
    plain = F.regexp_replace(type_id, "^T:", "")
    arity = F.coalesce(F.regexp_extract(plain, "`(\\d+)$", 1).try_cast("int"), F.lit(1))
    return F.when(F.contains(plain, F.lit("`")), F.concat(F.substring_index(plain, "`", 1), F.lit("<"), F.repeat(F.lit(","), F.greatest(arity - 1, F.lit(0))), F.lit(">"))).otherwise(plain)


def humanize(name: Column) -> Column:
    """PascalCase as a sentence."""
    spaced = F.regexp_replace(name, "(?<=[a-z0-9])(?=[A-Z])", " ")
    return F.concat(F.upper(F.substring(spaced, 1, 1)), F.lower(F.substring(spaced, 2, 1 << 30)))


def strip_suffix(name: Column, *suffixes: str) -> Column:
    """Without the first suffix that it ends with, if more than that is left."""
    out = name
    for s in reversed(suffixes):
        out = F.when(name.endswith(s) & (F.length(name) > len(s)), F.left(name, F.length(name) - len(s))).otherwise(out)
    return out


def snake_acronyms(name: Column) -> Column:
    """snake_case that keeps acronyms together and splits them from the next word (column naming)."""
    return F.lower(F.regexp_replace(name, "(?<=[a-z0-9])([A-Z])|(?<=[A-Z])([A-Z])(?=[a-z])", "_$1$2"))


def snake_simple(name: Column) -> Column:
    """snake_case that splits only after a small letter or digit (snapshot keys)."""
    return F.lower(F.regexp_replace(name, "(?<=[a-z0-9])([A-Z])", "_$1"))


def module_of(project: Column) -> Column:
    """Before the last dot; all of it without one."""
    return F.when(F.contains(project, F.lit(".")), F.regexp_replace(project, "\\.[^.]*$", "")).otherwise(project)


def layer_of(project: Column) -> Column:
    """After the last dot; empty without one."""
    return F.when(F.contains(project, F.lit(".")), tail(project)).otherwise("")


def location_path(location: Column) -> Column:
    """Path of ``path:line`` (last colon); null if there is no whole number after it."""
    path = F.regexp_extract(location, "^(.+):(-?\\d+)$", 1)
    return F.when((path != "") & location_line(location).isNotNull(), path)


def location_line(location: Column) -> Column:
    return F.regexp_extract(location, "^(.+):(-?\\d+)$", 2).try_cast("int")


def file_line(location: Column) -> Column:
    """``name:line`` of a location, other text as it is."""
    path = location_path(location)
    return F.when(path.isNotNull(), F.concat(F.substring_index(path, "/", -1), F.lit(":"), location_line(location).cast("string"))).otherwise(location)


def numeric_literal(value: Column) -> Column:
    """A number without its ``m`` and underscores; other text as it is."""
    return F.when(value.rlike("^[0-9][0-9_]*(\\.[0-9]+)?[mM]?$"), F.regexp_replace(value, "[_mM]", "")).otherwise(value)


def xml_escape(text: Column) -> Column:
    out = text
    for c, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(c), F.lit(name))
    return out


def cdata(text: Column) -> Column:
    """Text that may stand in a CDATA section."""
    return F.replace(text, F.lit("]]>"), F.lit("]]]]><![CDATA[>"))


def table_cell(text: Column) -> Column:
    """Text for a Markdown table: one line, bars escaped once."""
    line = F.replace(F.replace(text, F.lit("\r"), F.lit("")), F.lit("\n"), F.lit(" "))
    return F.regexp_replace(line, "(?<!\\\\)\\|", "\\\\|")


def yaml_quote(text: Column) -> Column:
    inner = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), inner, F.lit('"'))


def code_url(template: str, commit: Column, path: Column, line: Column) -> Column:
    """A source link; blanks in the path become ``%20``."""
    out = F.replace(F.lit(template), F.lit("{commit}"), commit)
    out = F.replace(out, F.lit("{path}"), F.replace(path, F.lit(" "), F.lit("%20")))
    return F.replace(out, F.lit("{line}"), line)


def code_link(location: Column, template: str, commit: Column) -> Column:
    """``path:line`` as a link (only its label without a template); other text as it is."""
    label = F.concat(F.substring_index(location_path(location), "/", -1), F.lit(":"), location_line(location).cast("string"))
    linked = F.concat(F.lit("["), label, F.lit("]("), code_url(template, commit, location_path(location), location_line(location).cast("string")), F.lit(")")) if template else label
    return F.when(location.rlike("^[^\\s\\[\\]()]+:\\d+$"), linked).otherwise(location)


def state_id(label: Column) -> Column:
    """Folded to ASCII letters, digits and ``_``; the start mark stays."""
    return F.when(label == "[*]", label).otherwise(F.regexp_replace(F.translate(label, MARKED, FOLDED), "[^A-Za-z0-9_]", ""))


def accusative(name: Column) -> Column:
    """First word in lower case, its final ``a`` as ``ę``."""
    first, rest = F.lower(F.substring_index(name, " ", 1)), F.regexp_extract(name, "^[^ ]*(.*)$", 1)
    return F.concat(F.regexp_replace(first, "a$", "ę"), rest)


def relative_path(page: Column, target: Column) -> Column:
    """Path of ``target`` seen from the folder of ``page``."""
    folder = F.slice(F.split(page, "/"), F.lit(1), F.size(F.split(page, "/")) - 1)
    to = F.split(target, "/")
    most = F.least(F.size(folder), F.size(to) - 1)
    same = F.zip_with(F.slice(folder, F.lit(1), most), F.slice(to, F.lit(1), most), lambda a, b: a == b)
    first_difference = F.array_position(same, F.lit(False)).cast("int")
    common = F.when(first_difference > 0, first_difference - 1).otherwise(most)
    return F.concat(F.repeat(F.lit("../"), F.size(folder) - common), F.array_join(F.slice(to, common + 1, F.size(to) - common), "/"))


def resolve_path(page: Column, url: Column) -> Column:
    """The page that a relative ``.md`` link means: without ``#`` and ``?`` parts, percent-decoded, ``.`` and ``..`` applied; else null."""
    bare = F.regexp_replace(url, "[#?].*$", "")
    decoded = F.try_url_decode(F.replace(bare, F.lit("+"), F.lit("%2B")))
    folder = F.slice(F.split(page, "/"), F.lit(1), F.size(F.split(page, "/")) - 1)
    steps = F.aggregate(
        F.concat(folder, F.split(decoded, "/")),
        F.array().cast("array<string>"),
        lambda path, step: F.when(step.isin("", "."), path).when(step == "..", F.slice(path, F.lit(1), F.greatest(F.size(path) - 1, F.lit(0)))).otherwise(F.array_append(path, step)),
    )
    return F.when(decoded.endswith(".md") & ~url.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.array_join(steps, "/"))


def clip(text: Column, most: int) -> Column:
    """At most so many characters, an ellipsis where more were."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def snippet(text: Column, most: int = 240) -> Column:
    """Trimmed lines that are not empty, joined by blanks and clipped."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x, F.lit(" \t\r\f\x0b"))), lambda x: x != "")
    return clip(F.array_join(lines, " "), most)


def ordinal_key(value: Column) -> Column:
    """A key that sorts texts by their UTF-16 units (Spark's own order is that of UTF-8 bytes, which differs beyond U+FFFF)."""
    return F.encode(value, "UTF-16BE")


def exit_kind(exit_: Column) -> Column:
    """The form of an exit, its argument apart."""
    return F.substring_index(exit_, ":", 1)


def is_failure(exit_: Column) -> Column:
    return (exit_ == "validation") | exit_.startswith("fail:") | exit_.startswith("throw:")


#: Words that tell of a negative outcome: of a flow's last status, and of a written status (fixed values).
FAILED_STATUS = "fail|reject|cancel|error"
NEGATIVE_OUTCOME = "fail|reject|cancel|declin|error|refus"


def is_negative(value: Column, words: str = NEGATIVE_OUTCOME) -> Column:
    return value.rlike(f"(?i){words}")


def exit_label(exit_: Column, behavior: Column, labels: dict[str, str]) -> Column:
    """The text for an exit. ``labels`` maps exits and the prefixes ``fail:`` and ``throw:`` to texts in which ``{}`` is the argument (for ``validation`` the behavior)."""
    start, _, end = labels.get("", "`{}`").partition("{}")
    other = F.concat(F.lit(start), exit_, F.lit(end))
    for key, text in labels.items():
        if not key:
            continue
        before, mark, after = text.partition("{}")
        argument = F.coalesce(behavior, F.lit("validation")) if key == "validation" else F.substring(exit_, len(key) + 1, 1 << 30)
        shown = F.concat(F.lit(before), argument, F.lit(after)) if mark else F.lit(text)
        other = F.when(exit_.startswith(key) if key.endswith(":") else exit_ == key, shown).otherwise(other)
    return other


#: The keys are the forms of exits (fixed values); the texts are English and ours, another language is another table. ``""`` is for all other exits.
EXIT_LABELS = {
    "": "`{}`",
    "validation": "`Result.Fail` ({})",
    "silent_success": "`Result.Ok()`, nobody is told",
    "return": "`return`",
    "return_value": "`return` of a value",
    "propagate": "hands an error on",
    "filter": "the query finds nothing",
    "fail:": "`{}`",
    "throw:": "throws `{}`",
}
ON_FAIL = {
    "": "Ends with `{}`.",
    "validation": "The input is refused.",
    "silent_success": "Nothing happens and nobody is told.",
    "return": "Nothing happens and nobody is told.",
    "return_value": "A value comes back early.",
    "filter": "The query finds nothing.",
    "propagate": "The caller gets the error.",
    "fail:": "Refused with `{}`.",
    "throw:": "`{}` is thrown.",
}
