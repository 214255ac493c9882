"""What was found about cases, as lines of text: the finding, its trail, the rules behind it, and what is not known.

Lines of all cases are one DataFrame; a page about a single case collects its own lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import scalars
from ledgerloom.operators import ordinals

#: What a verdict of ``diagnose.verdict`` means.
FINDINGS = {
    "cause_found": "A broken rule explains the stop.",
    "outside_code": "The trail leads to a refusal, or to something that other systems do.",
    "candidates": "The trail breaks off. One of the open rules below may be why.",
    "insufficient_data": "The data leave open where the trail ends.",
    "no_problem_found": "Nothing stopped: what can be seen of every step is there.",
}
STEPS = {"done": "seen", "not_done": "missing", "no_trace": "nothing to see", "external": "elsewhere", "unknown": "open"}
RULES = {"violated": "broken", "unknown": "open", "ok": "kept"}
PARTS = ("Finding", "Trail", "Rules", "Gaps")


def _word(of: Column, words: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in words.items() for x in pair]), of)


def lines(verdicts: DataFrame, steps: DataFrame, traces: DataFrame, states: DataFrame, rules: DataFrame, guards: DataFrame, titles: DataFrame, template: str = "", commit: str = "") -> DataFrame:
    """``case_id, part, place, text``: the lines of every case in order of part and place.

    ``verdicts``: rows of ``diagnose.analyze``; ``steps``: ``case_id, flow_id, no,
    entry_id, state``; ``traces``: ``case_id, entry_id, evidence``; ``states``: rule states
    with ``entry_id``; ``rules``: ``entry_id, no, guard_ids, conditions, on_fail``;
    ``guards``: ``entry_id, guard_id, path, line``; ``titles``: ``entry_id, title``. Of
    rules those of the flow's steps are told that are causes, open ones that may be, and
    kept ones; with what was seen, and where they are in the code.
    """
    flow = verdicts.select("case_id", "flow_id", "verdict", "break_no", "negative", "causes", "candidates", "missing")
    said = F.concat_ws(" ", _word(F.col("verdict"), FINDINGS), F.concat(F.lit("Process: `"), "flow_id", F.lit("`.")), F.concat(F.lit("Outcome: "), "negative", F.lit(".")))
    finding = flow.select("case_id", F.lit(0).alias("part"), F.struct(F.lit(0).alias("a"), F.lit("").alias("b"), F.lit(0).alias("c")).alias("place"), said.alias("text"))

    own = steps.join(flow.select("case_id", "flow_id", "break_no"), ["case_id", "flow_id"])
    seen = traces.groupBy("case_id", "entry_id").agg(F.array_join(F.array_sort(F.collect_set("evidence")), "; ").alias("seen"))
    told = own.join(titles, "entry_id", "left").join(seen, ["case_id", "entry_id"], "left")
    state = F.when((F.col("state") == "not_done") & (F.col("no") == F.col("break_no")), "**ends here**").otherwise(_word(F.col("state"), STEPS))
    step = F.concat(F.col("no").cast("string"), F.lit(". "), F.coalesce("title", "entry_id", F.lit("another system")), F.lit(": "), state, F.when(F.col("seen") != "", F.concat(F.lit(" ("), "seen", F.lit(")"))).otherwise(""))
    trail = told.select("case_id", F.lit(1).alias("part"), F.struct(F.col("no").cast("int").alias("a"), F.lit("").alias("b"), F.lit(0).alias("c")).alias("place"), step.alias("text"))

    named = rules.withColumn("rule_id", F.concat_ws("#", "entry_id", "no"))
    location = F.concat_ws(":", "path", F.col("line").cast("string"))
    at = named.select("rule_id", "entry_id", F.posexplode("guard_ids").alias("pos", "guard_id")).join(guards.select("entry_id", "guard_id", scalars.code_link(location, template, F.lit(commit)).alias("code")), ["entry_id", "guard_id"])
    places = at.groupBy("rule_id").agg(F.array_join(ordinals.ordered_distinct(F.col("code"), F.col("pos")), ", ").alias("code"))
    looked = states.join(own.select("case_id", "entry_id").distinct(), ["case_id", "entry_id"]).join(flow.select("case_id", "causes", "candidates"), "case_id")
    rank = F.when(F.array_contains("causes", F.col("rule_id")), 0).when(F.array_contains("candidates", F.col("rule_id")), 1).when(F.col("state") == "ok", 2)
    looked = looked.withColumn("rank", rank).where("rank IS NOT NULL").join(named.select("rule_id", "no", "conditions", "on_fail"), "rule_id", "left").join(places, "rule_id", "left").join(titles, "entry_id", "left")
    head = F.concat(F.lit("- "), _word(F.col("state"), RULES), F.lit(": **"), F.coalesce("title", "entry_id"), F.lit(", "), F.coalesce(F.col("no").cast("string"), "rule_id"), F.lit("**"), F.coalesce(F.concat(F.lit(" if `"), "conditions", F.lit("`")), F.lit("")), F.coalesce(F.concat(F.lit(". Then: "), "on_fail"), F.lit("")), F.when(F.col("silent"), " (nobody is told)").otherwise(""))
    below = F.concat(F.transform(F.coalesce("evidence", F.array().cast("array<string>")), lambda e: F.concat(F.lit("  - seen: "), e)), F.when(F.col("code") != "", F.array(F.concat(F.lit("  - code: "), "code"))).otherwise(F.array().cast("array<string>")))
    ruled = looked.select("case_id", F.lit(2).alias("part"), "rank", "rule_id", F.posexplode(F.concat(F.array(head), below)).alias("i", "text"))
    ruled = ruled.select("case_id", "part", F.struct(F.col("rank").alias("a"), F.col("rule_id").alias("b"), F.col("i").alias("c")).alias("place"), "text")

    gaps = flow.select("case_id", F.lit(3).alias("part"), F.posexplode("missing").alias("i", "m")).select("case_id", "part", F.struct(F.col("i").alias("a"), F.lit("").alias("b"), F.lit(0).alias("c")).alias("place"), F.concat(F.lit("- "), "m").alias("text"))
    return finding.unionByName(trail).unionByName(ruled).unionByName(gaps)


def page(question: str, said: str | None, case: list[tuple[int, str]], hits: list[dict], calls: list[tuple[str, str]]) -> str:
    """One answer as Markdown: the question as its title, what a model said, the lines (part, text) of a case, what was read and asked."""
    out = [f"# {question}", said.strip() if said else "Found without a language model:"]
    for i, title in enumerate(PARTS):
        own = [text for part, text in case if part == i]
        if own:
            out.append("\n".join([f"## {title}", "", *own]))
    if hits:
        out.append("\n".join(["## Read", "", *(f"- {h['title']}, {h['section']} ({h['page_id']})" for h in hits)]))
    if calls:
        out.append("\n".join(["## Looked up", "", *(f"- {name}: `{arguments}`" for name, arguments in calls)]))
    return "\n\n".join(out) + "\n"


def of_case(found: DataFrame, case_id: str) -> list[tuple[int, str]]:
    """The lines of one case, as many as its process has steps and rules."""
    return [(r.part, r.text) for r in found.where(F.col("case_id") == case_id).orderBy("part", "place").select("part", "text").collect()]
