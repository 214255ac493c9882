"""Markdown pages from cards, their manifest, and a storage format for wikis."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import scalars
from ledgerloom.operators import joins, sync


def bullets(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")


def table(header: list[str], rows: Column, cells) -> Column:
    """A Markdown table; ``cells(row)`` gives its columns."""
    line = lambda xs: F.concat(F.lit("| "), F.concat_ws(" | ", *xs), F.lit(" |"))
    top = F.lit("| " + " | ".join(header) + " |\n|" + "---|" * len(header))
    return F.concat_ws("\n", top, F.array_join(F.transform(rows, lambda r: line([scalars.table_cell(F.coalesce(c.cast("string"), F.lit(""))) for c in cells(r)])), "\n"))


def mermaid(kind: str, lines: Column) -> Column:
    return F.concat(F.lit(f"```mermaid\n{kind}\n"), F.array_join(F.transform(lines, lambda x: F.concat(F.lit("    "), x, F.lit("\n"))), ""), F.lit("```"))


def section(title: str, body: Column, items: Column) -> Column:
    """A titled block; null, and so left out, when there are no items."""
    return F.when(F.coalesce(F.size(items), F.lit(0)) > 0, F.concat(F.lit(f"## {title}\n\n"), body))


def page(title: Column, page_id: Column, commit: Column, slug: Column, blocks: list[Column], notes: Column) -> Column:
    """Front matter, a notice, the blocks that are not null or empty, and the notes."""
    head = F.concat(F.lit("---\ntitle: "), scalars.yaml_quote(title), F.lit("\npage_id: "), scalars.yaml_quote(page_id), F.lit("\ngenerated: true\nsource_commit: "), commit, F.lit("\n---\n\n"))
    notice = F.concat(F.lit("> Generated from code. Do not edit. Put additions into `"), slug, F.lit(".notes.md`."))
    own = F.coalesce(notes, F.concat(F.lit("(notes from `"), slug, F.lit(".notes.md`, if there are any)")))
    body = F.filter(F.array(F.concat(F.lit("# "), title), notice, *blocks, F.lit("## Notes"), own), lambda b: b.isNotNull() & (b != ""))
    return F.concat(head, F.array_join(body, "\n\n"), F.lit("\n"))


def use_case_pages(cards: DataFrame, commit: str, notes: DataFrame) -> DataFrame:
    """``page_id, path, title, kind, parent_page_id, content, hash`` of use cases; ``notes``: ``path, notes``."""
    slug = F.regexp_replace("title", "[^\\p{L}\\p{N}]+", "-")
    c = cards.withColumn("slug", slug).withColumn("path", F.concat(F.lit("use-cases/"), slug, F.lit(".md"))).join(notes.select("path", "notes"), "path", "left")
    blocks = [
        section("Triggers", bullets(F.col("triggers")), F.col("triggers")),
        section("Business rules", table(["#", "Rule", "When broken"], F.col("rules"), lambda r: [r["no"], r["conditions"], r["on_fail"]]), F.col("rules")),
        section("Effects", bullets(F.col("effects")), F.col("effects")),
        section("Data", table(["Operation", "Table", "Columns"], F.col("data"), lambda r: [r["op"], r["table"], r["columns"]]), F.col("data")),
    ]
    return _paged(c.withColumn("content", page(F.col("title"), F.col("page_id"), F.lit(commit), F.col("slug"), blocks, F.col("notes"))), "use_case")


def entity_pages(cards: DataFrame, commit: str, notes: DataFrame) -> DataFrame:
    c = cards.withColumn("title", F.col("name")).withColumn("slug", F.col("name")).withColumn("path", F.concat(F.lit("entities/"), "name", F.lit(".md"))).join(notes.select("path", "notes"), "path", "left")
    blocks = [
        section("Statuses", table(["Status", "Final"], F.col("statuses"), lambda r: [r["state"], F.when(r["is_final"], "yes").otherwise("no")]), F.col("statuses")),
        F.when(F.coalesce(F.size("diagram"), F.lit(0)) > 0, mermaid("stateDiagram-v2", F.col("diagram"))),
        section("Fields", table(["Field", "Type", "Column"], F.col("fields"), lambda r: [r["name"], r["type"], r["column"]]), F.col("fields")),
    ]
    return _paged(c.withColumn("content", page(F.col("title"), F.col("page_id"), F.lit(commit), F.col("slug"), blocks, F.col("notes"))), "entity")


def _paged(c: DataFrame, kind: str, parent: Column | None = None) -> DataFrame:
    up = F.concat(F.lit("module:"), "module") if parent is None else parent
    return c.select("page_id", "path", "title", F.lit(kind).alias("kind"), up.alias("parent_page_id"), "content", F.sha2("content", 256).alias("hash"))


#: The page above those of modules, flows, global rules and terms.
SYSTEM = "system"


def link(page_id: Column) -> Column:
    return F.concat(F.lit("[[page:"), page_id, F.lit("]]"))


def _below_system(c: DataFrame, kind: str, commit: str, notes: DataFrame, blocks: list[Column]) -> DataFrame:
    """Pages of rows ``page_id, path, title, slug`` and what the blocks need."""
    c = c.join(notes.select("path", "notes"), "path", "left")
    up = F.lit(None).cast("string") if kind == "system" else F.lit(SYSTEM)
    return _paged(c.withColumn("content", page(F.col("title"), F.col("page_id"), F.lit(commit), F.col("slug"), blocks, F.col("notes"))), kind, up)


def _links(title: str, ids: Column) -> Column:
    return section(title, bullets(F.transform(ids, link)), ids)


def flow_modules(steps: DataFrame, homes: DataFrame) -> DataFrame:
    """``flow_id, no, module``: of the entry, else of the step before, else of the flow's root; ``homes``: ``entry_id, module``."""
    at = lambda name: homes.select(F.col("entry_id").alias(name), F.col("module").alias(f"_{name}"))
    own = steps.join(at("entry_id"), "entry_id", "left").withColumn("root", F.substring("flow_id", 6, 1 << 30)).join(at("root"), "root", "left")
    before = own.select("flow_id", F.col("no").alias("parent_no"), F.col("_entry_id").alias("_before"))
    return own.join(before, ["flow_id", "parent_no"], "left").select("flow_id", "no", F.coalesce("_entry_id", "_before", "_root").alias("module"))


def flow_pages(steps: DataFrame, diagram: tuple[DataFrame, DataFrame], stops: DataFrame, titles: DataFrame, homes: DataFrame, commit: str, notes: DataFrame) -> DataFrame:
    """Pages of flows: diagram, steps and silent stops; ``titles``: ``entry_id, title``."""
    ordered = lambda order, value, name: F.transform(F.array_sort(F.collect_list(F.struct(*order, value.alias("v")))), lambda x: x["v"]).alias(name)
    nodes, edges = diagram
    label = F.concat(F.lit('"'), F.replace("label", F.lit('"'), F.lit("#quot;")), F.lit('"'))
    shown = F.when(F.col("shape") == "decision", F.concat("id", F.lit("{"), label, F.lit("}"))).when(F.col("shape") == "end", F.concat("id", F.lit("(["), label, F.lit("])"))).otherwise(F.concat("id", F.lit("["), label, F.lit("]")))
    drawn = nodes.groupBy("flow_id").agg(ordered([F.length("id").alias("n"), F.col("id")], shown, "nodes"))
    plain, named = F.when(F.col("dashed"), "-.->").otherwise("-->"), F.when(F.col("dashed"), F.concat(F.lit('-. "'), "label", F.lit('" .->'))).otherwise(F.concat(F.lit('-- "'), "label", F.lit('" -->')))
    arrow = F.concat_ws(" ", "src", F.coalesce(named, plain), "dst")
    arrows = edges.groupBy("flow_id").agg(ordered([F.length("src").alias("n"), F.col("src"), F.length("dst").alias("m"), F.col("dst")], arrow, "arrows"))
    s = steps.join(titles.select("entry_id", "title"), "entry_id", "left").join(flow_modules(steps, homes), ["flow_id", "no"])
    row = F.struct("no", F.coalesce(F.when(F.col("title").isNotNull(), link(F.col("entry_id"))), "entry_id", "external").alias("process"), "module", F.when(F.col("dashed"), "external call").alias("mode"))
    each = s.groupBy("flow_id").agg(F.array_sort(F.collect_list(row)).alias("steps"), F.min_by(F.coalesce("title", "entry_id"), F.when(F.col("entry_id").isNotNull(), F.col("no"))).alias("first"))
    place = F.concat(F.lit("step "), "no", F.coalesce(F.concat(F.lit(", rule "), "rule"), F.lit("")))
    why = F.when(F.col("kind") == "swallowed", F.lit("An error of `{}` is only logged or ignored.")).when(F.col("kind") == "final_status", F.lit("`{}` is final; nothing resumes the process.")).otherwise(F.lit("`{}`: no trace in data or logs."))
    silent = stops.groupBy("flow_id").agg(F.array_sort(F.collect_list(F.struct("no", place.alias("place"), F.replace(why, F.lit("{}"), F.col("what")).alias("reason")))).alias("stops"))
    c = each.join(drawn, "flow_id", "left").join(arrows, "flow_id", "left").join(silent, "flow_id", "left")
    slug = F.regexp_replace(F.substring("flow_id", 6, 1 << 30), "[^\\p{L}\\p{N}]+", "-")
    c = c.select(F.col("flow_id").alias("page_id"), F.concat(F.lit("Process: "), F.coalesce("first", "flow_id")).alias("title"), F.regexp_replace(slug, "^-|-$", "").alias("slug"), "steps", "nodes", "arrows", "stops")
    lines = F.concat("nodes", F.coalesce("arrows", F.array().cast("array<string>")))
    blocks = [
        F.when(F.coalesce(F.size("nodes"), F.lit(0)) > 0, mermaid("flowchart TD", lines)),
        section("Steps", table(["Step", "Process", "Module", "Mode"], F.col("steps"), lambda r: [r["no"], r["process"], r["module"], r["mode"]]), F.col("steps")),
        section("Where the process may stop without an error", table(["Place", "Reason"], F.col("stops"), lambda r: [r["place"], r["reason"]]), F.col("stops")),
    ]
    return _below_system(c.withColumn("path", F.concat(F.lit("flows/"), "slug", F.lit(".md"))), "flow", commit, notes, blocks)


def global_rule_pages(entries: DataFrame, guards: DataFrame, applies: DataFrame, commit: str, notes: DataFrame) -> DataFrame:
    """Pages of behaviors: where each applies (``behavior, entry_id, no``) and its logic."""
    own = entries.where("kind = 'behavior'").select(F.col("entry_id").alias("page_id"), F.col("location"))
    logic = guards.groupBy(F.col("entry_id").alias("page_id")).agg(F.array_sort(F.collect_list(F.struct("pos", "condition", scalars.exit_label(F.col("exit"), F.lit(None).cast("string"), scalars.EXIT_LABELS).alias("label"), "location"))).alias("logic"))
    on = applies.groupBy(F.col("behavior").alias("page_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("no", "entry_id"))), lambda x: x["entry_id"]).alias("applies"))
    name = scalars.short(F.col("page_id"))
    c = own.join(logic, "page_id", "left").join(on, "page_id", "left").withColumn("title", scalars.humanize(name)).withColumn("slug", name).withColumn("path", F.concat(F.lit("global-rules/"), name, F.lit(".md")))
    code = lambda location: F.concat(F.lit("[[code:"), location, F.lit("]]"))
    blocks = [
        F.concat(F.lit("Runs around the logic of commands: "), code(F.col("location")), F.lit(".")),
        _links("Where it applies", F.col("applies")),
        section("Logic in code", table(["Condition", "Exit", "Place"], F.col("logic"), lambda r: [F.concat(F.lit("`"), r["condition"], F.lit("`")), r["label"], code(r["location"])]), F.col("logic")),
    ]
    return _below_system(c, "global_rule", commit, notes, blocks)


def module_pages(modules: DataFrame, use_cases: DataFrame, entities: DataFrame, in_flows: DataFrame, commit: str, notes: DataFrame) -> DataFrame:
    """A page for each module that exists or that a page is in; ``in_flows``: ``flow_id, module``."""
    member = lambda df, kind, key: df.where("module IS NOT NULL").select("module", F.lit(kind).alias("kind"), F.col(key).alias("id"))
    members = member(use_cases, "use_case", "page_id").unionByName(member(entities, "entity", "page_id")).unionByName(member(in_flows, "flow", "flow_id"))
    of = lambda kind: F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("id")))).alias(kind)
    names = modules.select("module").unionByName(members.select("module")).distinct()
    c = names.join(members.groupBy("module").agg(of("use_case"), of("entity"), of("flow")), "module", "left").join(modules.select("module", "depends_on"), "module", "left")
    c = c.withColumn("needs", F.transform("depends_on", lambda m: F.concat(F.lit("module:"), m))).withColumn("page_id", F.concat(F.lit("module:"), "module"))
    c = c.withColumn("title", F.concat(F.lit("Module "), "module")).withColumn("slug", F.col("module")).withColumn("path", F.concat(F.lit("modules/"), "module", F.lit(".md")))
    blocks = [_links("Use cases", F.col("use_case")), _links("Entities", F.col("entity")), _links("Processes through the module", F.col("flow")), _links("Depends on", F.col("needs"))]
    return _below_system(c, "module", commit, notes, blocks)


def glossary_page(terms: DataFrame, commit: str, notes: DataFrame) -> DataFrame:
    """One page of all terms ``term, code_name, meaning``."""
    c = terms.agg(F.array_sort(F.collect_list(F.struct(F.lower("term").alias("low"), "term", "code_name", "meaning"))).alias("terms"))
    c = c.withColumns({"page_id": F.lit("glossary"), "title": F.lit("Glossary"), "slug": F.lit("glossary"), "path": F.lit("glossary.md")})
    code = lambda r: F.when(r["code_name"] != "", F.concat(F.lit("`"), r["code_name"], F.lit("`")))
    shown = table(["Term", "Name in code", "Meaning"], F.col("terms"), lambda r: [r["term"], code(r), r["meaning"]])
    return _below_system(c, "glossary", commit, notes, [F.when(F.size("terms") > 0, shown).otherwise("No terms.")])


def system_page(pages: DataFrame, commit: str, notes: DataFrame) -> DataFrame:
    """One page that leads to those of modules, flows, global rules and terms among ``pages``."""
    of = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("page_id")))).alias(kind)
    c = pages.agg(of("module"), of("flow"), of("global_rule"), of("glossary"))
    c = c.withColumns({"page_id": F.lit(SYSTEM), "title": F.lit("System overview"), "slug": F.lit("index"), "path": F.lit("index.md")})
    blocks = [_links("Modules", F.col("module")), _links("Processes", F.col("flow")), _links("Global rules", F.col("global_rule")), _links("Glossary", F.col("glossary"))]
    return _below_system(c, "system", commit, notes, blocks)


def resolve_links(pages: DataFrame, template: str, commit: str) -> DataFrame:
    """Pages with their link tokens replaced: ``[[page:id|label]]`` by a relative link, ``[[code:path:line|label]]`` by a source link; unknown pages become plain text.

    The tokens are taken out of each page with their places, joined to the pages they
    mean, and put back in order.
    """
    # The grammar of link tokens is a fixed value.
    token = "\\[\\[(?:page:[^\\]|]+|code:[^\\]|]+:\\d+)(?:\\|[^\\]]*)?\\]\\]"
    cut = pages.select("page_id", "path", "content", F.regexp_extract_all("content", F.lit(token), F.lit(0)).alias("tokens"), F.split("content", token, -1).alias("texts"))
    each = cut.select("page_id", "path", F.posexplode("tokens").alias("pos", "token"))
    inner = F.regexp_extract("token", "^\\[\\[(page|code):([^\\]|]+)(?:\\|([^\\]]*))?\\]\\]$", 2)
    label = F.regexp_extract("token", "\\|([^\\]]*)\\]\\]$", 1)
    each = each.withColumn("id", inner).withColumn("label", F.when(F.contains("token", F.lit("|")), label))
    to = pages.select(F.col("page_id").alias("id"), F.col("path").alias("to_path"), F.col("title").alias("to_title"))
    found = each.join(to, "id", "left")
    page_link = F.when(F.col("to_path").isNotNull(), F.concat(F.lit("["), F.coalesce("label", "to_title"), F.lit("]("), scalars.relative_path(F.col("path"), F.col("to_path")), F.lit(")"))).otherwise(F.coalesce("label", "id"))
    shown = F.coalesce("label", scalars.file_line(F.col("id")))
    url = scalars.code_url(template, F.lit(commit), scalars.location_path(F.col("id")), scalars.location_line(F.col("id")).cast("string"))
    code_link = F.concat(F.lit("["), shown, F.lit("]("), url, F.lit(")")) if template else shown
    done = found.groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.when(F.col("token").startswith("[[code:"), code_link).otherwise(page_link).alias("t")))), lambda s: s["t"]).alias("links"))
    joined = cut.join(done, "page_id", "left")
    pieces = F.zip_with("texts", F.coalesce("links", F.array().cast("array<string>")), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    content = F.when(F.size("tokens") > 0, F.array_join(pieces, "")).otherwise(F.col("content"))
    new = joined.select("page_id", content.alias("content"))
    return pages.drop("content", "hash").join(new, "page_id").withColumn("hash", F.sha2("content", 256)).select(*pages.columns)


def duplicate_warnings(pages: DataFrame) -> DataFrame:
    """Paths and titles that several pages have."""
    a = sync.duplicates(pages, "path").select(F.lit("path").alias("what"), F.col("path").alias("value"), "n")
    return a.unionByName(sync.duplicates(pages, "title").select(F.lit("title").alias("what"), F.col("title").alias("value"), "n"))


def manifest(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "path", "title", "kind", "parent_page_id", "hash")


def page_or_card(ask: DataFrame, pages: DataFrame, cards: DataFrame) -> DataFrame:
    """For each asked ``page_id``: the rendered page, else the card as JSON, else a message."""
    rest = [c for c in cards.columns if c != "page_id"]
    out = ask.join(pages.select("page_id", "content"), "page_id", "left").join(cards.select("page_id", F.to_json(F.struct(*rest)).alias("card")), "page_id", "left")
    return out.select("page_id", F.coalesce("content", "card", F.concat(F.lit("Unknown page "), "page_id")).alias("content"))


_INLINE = re.compile(r"`([^`]+)`|\*\*(.+?)\*\*|\*(.+?)\*|!?\[([^\]]*)\]\(([^)\s]+)\)")
_ITEM = re.compile(r"( *)([-*+]|[0-9]+[.)]) +(.*)")


def plain_text(text: str) -> str:
    """The text of inline Markdown: link labels, code and emphasis without their marks."""
    return _INLINE.sub(lambda m: m[1] if m[1] is not None else plain_text(next(x for x in (m[2], m[3], m[4]) if x is not None)), text)


def _list(rows: list[tuple[int, bool, str]], titles: dict[str, str]) -> str:
    """Items ``(indent, numbered, text)`` as nested lists; an item is below the last one that is indented less."""
    out, i = [], 0
    while i < len(rows):
        indent, numbered, _ = rows[i]
        tag, items = "ol" if numbered else "ul", []
        while i < len(rows) and rows[i][0] <= indent and rows[i][1] == numbered:
            own = rows[i]
            end = next((j for j in range(i + 1, len(rows)) if rows[j][0] <= own[0]), len(rows))
            items.append(f"<li>{_inline(own[2], titles)}{_list(rows[i + 1 : end], titles)}</li>")
            i = end
        out.append(f"<{tag}>{''.join(items)}</{tag}>")
    return "".join(out)


def _inline(text: str, titles: dict[str, str]) -> str:
    out, at = [], 0
    for m in _INLINE.finditer(text):
        out.append(html.escape(text[at : m.start()], quote=True))
        at = m.end()
        if m[1] is not None:
            out.append(f"<code>{html.escape(m[1], quote=True)}</code>")
        elif m[2] is not None:
            out.append(f"<strong>{_inline(m[2], titles)}</strong>")
        elif m[3] is not None:
            out.append(f"<em>{_inline(m[3], titles)}</em>")
        elif m[0].startswith("!"):
            alt, source = html.escape(m[4], quote=True), html.escape(m[5], quote=True)
            inner = f'<ri:url ri:value="{source}" />' if re.match(r"[a-z]+:", m[5]) else f'<ri:attachment ri:filename="{html.escape(m[5].rsplit("/", 1)[-1], quote=True)}" />'
            out.append(f'<ac:image ac:alt="{alt}">{inner}</ac:image>')
        elif m[5] in titles:
            out.append(f'<ac:link><ri:page ri:content-title="{html.escape(titles[m[5]], quote=True)}" /><ac:link-body>{_inline(m[4], titles)}</ac:link-body></ac:link>')
        elif re.match(r"[a-z]+:", m[5]):
            out.append(f'<a href="{html.escape(m[5], quote=True)}">{_inline(m[4], titles)}</a>')
        else:
            out.append(_inline(m[4], titles))
    return "".join(out) + html.escape(text[at:], quote=True)


def to_storage(markdown: str, titles: dict[str, str] | None = None) -> str:
    """Storage-format XHTML of our Markdown: headings, paragraphs, quotes, lists, tables, code and diagrams."""
    titles = titles or {}
    lines = re.sub(r"\A---\n.*?\n---\n", "", markdown.replace("\r\n", "\n"), flags=re.S).split("\n")
    out, i = [], 0
    block = lambda tag, rows: out.append(f"<{tag}>" + "".join(rows) + f"</{tag}>")
    while i < len(lines):
        line = lines[i]
        if line.startswith("```"):
            end = next((j for j in range(i + 1, len(lines)) if lines[j].startswith("```")), len(lines))
            body = "\n".join(lines[i + 1 : end]).replace("]]>", "]]]]><![CDATA[>")
            out.append(f'<ac:structured-macro ac:name="code"><ac:parameter ac:name="language">{html.escape(line[3:].strip() or "none")}</ac:parameter><ac:plain-text-body><![CDATA[{body}]]></ac:plain-text-body></ac:structured-macro>')
            i = end + 1
        elif m := re.match(r"(#{1,6}) (.*)", line):
            out.append(f"<h{len(m[1])}>{_inline(m[2], titles)}</h{len(m[1])}>")
            i += 1
        elif line == "---":
            out.append("<hr />")
            i += 1
        elif _ITEM.fullmatch(line):
            items = []
            while i < len(lines) and (m := _ITEM.fullmatch(lines[i]) or (re.match(r" +\S", lines[i]) if lines[i].strip() else None)):
                if m.re is _ITEM:
                    items.append((len(m[1]), m[2][0].isdigit(), m[3]))
                else:  # a line that goes on with the item before
                    items[-1] = (*items[-1][:2], f"{items[-1][2]} {lines[i].strip()}")
                i += 1
            out.append(_list(items, titles))
        elif line.startswith(("> ", "|")):
            lead = line[0]
            end = next((j for j in range(i, len(lines)) if not lines[j].startswith(lead)), len(lines))
            rows = lines[i:end]
            if lead == ">":
                block("blockquote", [f"<p>{_inline(r[2:], titles)}</p>" for r in rows])
            else:
                cells = [[c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", r.strip()[1:-1])] for r in rows if not re.fullmatch(r"[|\-: ]+", r)]
                body = ["<tr>" + "".join(f"<{t}>{_inline(c, titles)}</{t}>" for c in r) + "</tr>" for k, r in enumerate(cells) for t in ["th" if k == 0 else "td"]]
                out.append("<table><tbody>" + "".join(body) + "</tbody></table>")
            i = end
        elif line.strip():
            end = next((j for j in range(i, len(lines)) if not lines[j].strip() or lines[j].startswith(("#", "```", "> ", "|")) or _ITEM.fullmatch(lines[j])), len(lines))
            out.append(f"<p>{_inline(' '.join(lines[i:max(end, i + 1)]), titles)}</p>")
            i = max(end, i + 1)
        else:
            i += 1
    return "".join(out)


def storage(pages: DataFrame) -> DataFrame:
    """``page_id, storage``: links to other pages by their titles, by way of a map of the titles that each page's links resolve to."""
    href = F.regexp_extract_all("content", F.lit("\\]\\(([^)\\s]+)\\)"), F.lit(1))
    links = pages.select("page_id", "path", F.explode(F.array_distinct(href)).alias("href")).withColumn("to", scalars.resolve_path(F.col("path"), F.col("href")))
    named = joins.lookup_default(links, pages.select(F.col("path").alias("to"), F.col("title").alias("to_title")), "to", "to_title", F.lit(None).cast("string")).where("to_title IS NOT NULL")
    maps = named.groupBy("page_id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("href", "to_title")))).alias("titles"))

    @F.pandas_udf("string")
    def convert(content: pd.Series, titles: pd.Series) -> pd.Series:
        import json

        return pd.Series([to_storage(c, json.loads(t) if t else {}) for c, t in zip(content, titles)])

    return pages.join(maps, "page_id", "left").select("page_id", convert("content", "titles").alias("storage"))
