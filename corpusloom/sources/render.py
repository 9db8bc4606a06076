"""Writers of documents: CSV table, Markdown, HTML preview."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.sources.files import CSV_HEADER
from corpusloom.storage import require_shared, shared_file


def csv_lines(elements: DataFrame) -> DataFrame:
    """Elements with ``line``: their row of the CSV table, in the JVM.

    Text rows carry language, statistics, hash and uniqueness; a group's row its title or
    the coordinates of its cell; its end nothing.
    """
    elements = T.with_statistics(elements)
    numbers = [F.col(n).cast("string") for n in T.STATISTICS]
    quoted = lambda c: F.concat(F.lit('"'), T.csv_encoded(F.coalesce(c, F.lit(""))), F.lit('"'))
    flag = F.when(F.col("is_unique"), "True").when(~F.col("is_unique"), "False").otherwise("")
    head = F.concat_ws(";", "elt_type", "cmd", F.col("nesting_level").cast("string"))
    full = F.concat_ws(";", head, quoted(F.col("text")), F.coalesce("lang", F.lit("?")), *numbers, F.coalesce(F.col("hash").cast("string"), F.lit("")), flag)
    label = F.when(F.col("elt_type").isin("TableHeader", "TableCell"), T.cell_coordinates(F.col("row"), F.col("rowspan"), F.col("col"), F.col("colspan"))).otherwise(F.col("text"))
    start = F.concat(head, F.lit(";"), quoted(label), F.lit(";" * 9))
    line = F.when(F.col("cmd") == "Text", full).when(F.col("cmd") == "Title", full).when(F.col("cmd") == "End", F.concat(head, F.lit(";" * 10))).otherwise(start)
    return elements.withColumn("line", line).drop(*T.STATISTICS)


def csv_documents(elements: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(id, csv): the whole table of each document, with header, in order."""
    rows = csv_lines(elements).groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("x"))
    return rows.select(id_col, F.concat(F.lit("﻿" + CSV_HEADER + "\n"), F.array_join(F.transform("x", lambda r: r["line"]), "\n"), F.lit("\n")).alias("csv"))


class Tree:
    """Group or text of a document, rebuilt from its rows."""

    __slots__ = ("kind", "level", "text", "row", "rowspan", "col", "colspan", "unique", "children")

    def __init__(self, r):
        self.kind, self.level, self.text, self.unique = r.elt_type, int(r.nesting_level), r.text, bool(r.is_unique) if r.is_unique is not None else False
        self.row, self.rowspan, self.col, self.colspan = (int(v) if v == v and v is not None else 0 for v in (r.row, r.rowspan, r.col, r.colspan))
        self.children: list[Tree] = []

    def blank(self) -> bool:
        return all(c.kind != "TextBlock" and not (c.kind in ("Section", "Table") and c.text) and c.blank() for c in self.children)


def forest(rows: pd.DataFrame) -> list[Tree]:
    top: list[Tree] = []
    stack: list[Tree] = []
    for r in rows.itertuples(index=False):
        if r.cmd == "End":
            stack.pop()
            continue
        node = Tree(r)
        (stack[-1].children if stack else top).append(node)
        if r.cmd == "Start":
            stack.append(node)
    return top


def _order(node: Tree, strict_parity: bool) -> list[Tree]:
    """Children of a node; a list that begins an item goes behind its text.

    With ``strict_parity`` that happens only if all other children are text, as the
    model has it.
    """
    kids = node.children
    if node.kind == "ListItem" and len(kids) > 1 and kids[0].kind in ("List", "NavigationList"):
        rest = kids[1:]
        if all(c.kind == "TextBlock" for c in rest):
            return [*rest, kids[0]]
        if not strict_parity:
            at = next(i for i, c in enumerate(rest) if c.kind != "TextBlock")
            return [*rest[:at], kids[0], *rest[at:]]
    return kids


def markdown(top: list[Tree], strict_parity: bool = True) -> str:
    out: list[str] = []
    inside: list[str] = []  # open items and cells

    def write(node: Tree, first: bool) -> None:
        cell = bool(inside) and inside[-1] == "cell"
        if node.kind == "TextBlock":
            if cell:
                out.append(f"{node.text} ")
            elif inside:
                indent = "" if strict_parity or first else "  " * (len(inside) + 1)
                out.append(f"{indent}{node.text}\n")
            else:
                out.append(f"{node.text}\n\n")
            return
        if node.kind in ("Section", "List", "NavigationList", "Table") and not node.text and node.blank():
            return
        if not cell:
            if node.kind in ("TableHeader", "TableCell"):
                out.append(("|\n" if node.col == 1 and node.row > 1 else "") + "| ")
            elif node.kind == "Section":
                out.append("#" * min(node.level, 6) + " ")
            elif node.kind == "ListItem":
                out.append("  " * len(inside) + "- ")
            if node.text and node.kind in ("Section", "Table"):
                out.append(f"{node.text}\n\n")
        pushed = {"ListItem": "item", "TableHeader": "cell", "TableCell": "cell"}.get(node.kind)
        if pushed:
            inside.append(pushed)
        for i, child in enumerate(_order(node, strict_parity)):
            write(child, i == 0)
        # what an item or cell is inside of decides about its end, before it is left
        if not (inside and inside[-1] == "cell"):
            if node.kind in ("List", "NavigationList"):
                out.append("\n")
            elif node.kind == "Table":
                out.append("|\n\n")
        if pushed:
            inside.pop()

    for node in top:
        write(node, True)
    return "".join(out) + "\n"


def html_preview(top: list[Tree], title: str | None, uri: str | None, metadata: dict[str, str] | None = None, strict_parity: bool = True) -> str:
    esc = lambda t: (t or "").replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;").replace("'", "&#39;")
    tags = {"List": "ul", "NavigationList": "ul", "ListItem": "li", "Table": "table", "TableHeader": "th", "TableCell": "td"}
    out = ["<!doctype html>", "<html>", "<head>", f"<title>{esc(title)}</title>", f'<meta name="Uri" content="{esc(uri)}">']
    out += [f'<meta name="Metadata" content="{esc(k)}={esc(v)}">' for k, v in (metadata or {}).items()]
    out += ["</head>", "<body>", f'<div class="p-2"><a href="{esc(uri)}" target="_blank">{esc(uri)}</a></div>']

    def write(node: Tree) -> None:
        if node.kind == "TextBlock":
            out.append(f'<div class="p-2">{esc(node.text)}</div>')
            return
        if node.kind in ("Section", "List", "NavigationList", "Table") and not node.text and node.blank():
            return
        if node.kind == "Section":
            level = min(node.level, 6)
            out.append(f"<h{level}>{esc(node.text)}</h{level}>")
        else:
            if node.kind in ("TableHeader", "TableCell") and node.col == 1:
                out.append("<tr>")
            spans = "".join(f' {name}="{n}"' for name, n in (("rowspan", node.rowspan), ("colspan", node.colspan)) if n > 1)
            out.append(f"<{tags[node.kind]}{spans}" + (f' title="{esc(node.text)}"' if node.text else "") + ">")
        for child in _order(node, strict_parity):
            write(child)
        if node.kind != "Section":
            out.append(f"</{tags[node.kind]}>")

    for node in top:
        write(node)
    return "\n".join([*out, "</body>", "</html>", ""])


def render_documents(elements: DataFrame, form: str = "markdown", id_col: str = "page_id", strict_parity: bool = True) -> DataFrame:
    """(id, text): each document as Markdown or HTML preview, from the rows of its unique view.

    A document's rows are one group of bounded size, that of a page.
    """

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos").astype(object).where(lambda x: x.notna(), None)
        top = forest(rows)
        title = next((t for t in rows["title"] if t), None)
        text = markdown(top, strict_parity) if form == "markdown" else html_preview(top, title, None, strict_parity=strict_parity)
        return pd.DataFrame({id_col: [rows[id_col].iloc[0]], "text": [text]})

    return elements.groupBy(id_col).applyInPandas(one, f"{id_col} bigint, text string")


def flat_markdown(blocks: DataFrame, id_col: str = "doc_id", pos: str = "pos", text: str = "block") -> DataFrame:
    """(id, markdown) of documents of text blocks alone, in the JVM: blocks in order, an empty line after each."""
    joined = blocks.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct(pos, text))).alias("x"))
    return joined.select(id_col, F.concat(F.array_join(F.transform("x", lambda r: r[text]), "\n\n"), F.lit("\n\n\n")).alias("markdown"))


def write_documents(texts: DataFrame, folder: str, name: str = "name", text: str = "text") -> None:
    """One file a document, written by the executors below a shared folder, which an address names on a cluster."""
    require_shared(texts.sparkSession, folder)

    def save(rows: Iterator) -> None:
        for r in rows:
            with shared_file(f"{folder.rstrip('/')}/{r[0].lstrip('/')}") as out:  # a repeated task writes the same file again
                out.write(r[1].encode("utf-8", "surrogatepass"))

    texts.select(name, text).foreachPartition(save)
