"""Markdown: cells, tables, list items, blocks, front matter, whole files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions import text as T
from foliospark.operators.reading_order import with_previous


def table_row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def table_markdown(rows: Column, header_rows: Column, alignments: Column) -> Column:
    """A table of array<array<string>>: padded rows, header rows fused with <br>, alignment markers."""
    n = F.array_max(F.transform(rows, F.size))
    blank = lambda k: F.array_repeat(F.lit(""), k)
    grid = F.transform(rows, lambda r: F.concat(F.transform(r, T.escape_cell), blank(n - F.size(r))))
    marks = F.transform(F.slice(F.concat(F.coalesce(alignments, F.array().cast("array<string>")), F.array_repeat(F.lit("left"), n)), F.lit(1), n), lambda a: F.when(a == "center", ":---:").when(a == "right", "---:").otherwise(":---"))
    h = F.greatest(F.lit(0), F.least(F.coalesce(header_rows, F.lit(0)), F.size(rows) - 1))
    fused = F.transform(F.sequence(F.lit(0), n - 1), lambda c: F.array_join(F.filter(F.transform(F.slice(grid, F.lit(1), h), lambda r: F.get(r, c)), lambda x: x != ""), "<br>"))
    head = F.when(h == 0, table_row(blank(n))).when(h == 1, table_row(F.get(grid, F.lit(0)))).otherwise(table_row(fused))
    body = F.transform(F.slice(grid, h + 1, F.greatest(F.size(grid), F.lit(1))), table_row)
    return F.when((F.size(rows) > 0) & (n > 0), F.array_join(F.concat(F.array(head, table_row(marks)), body), "\n")).otherwise("")


def list_item(text: Column, marker: Column, ordered: Column, level: Column) -> Column:
    """An item with its own marker: numbers stay ordered, letters and roman numerals stay in the text."""
    m = F.trim(F.coalesce(marker, F.lit("")))
    num = F.regexp_extract(m, "^\\(?(\\d{1,3})[.)]?$", 1)
    indent = F.repeat(F.lit("  "), F.coalesce(level, F.lit(0)))
    t = T.escape_text(T.strip(F.coalesce(text, F.lit(""))))
    kept = F.regexp_replace(F.concat(indent, F.lit("- "), m, F.lit(" "), t), " +$", "")
    return F.when(F.coalesce(ordered, F.lit(False)) & (num != ""), F.concat(indent, num.cast("int").cast("string"), F.lit(". "), t)).when(F.coalesce(ordered, F.lit(False)), kept).otherwise(F.concat(indent, F.lit("- "), t))


def block_markdown(previous_kind: Column, page_markers: bool = True, review_markers: bool = True) -> Column:
    """Markdown of a typed block, blank lines around it included; needs the columns of the blocks table."""
    t = T.strip(F.coalesce("text", F.lit("")))
    body = T.escape_text(t)
    spaced = lambda c: F.concat(F.lit("\n"), c, F.lit("\n\n"))
    review = F.when(F.coalesce("needs_review", F.lit(False)), F.concat(F.lit("<!-- REVISAR: "), F.coalesce("review_reason", F.lit("conferir")), F.lit(" -->\n"))).otherwise("") if review_markers else F.lit("")
    heading = F.concat(F.repeat(F.lit("#"), F.coalesce("level", F.lit(1))), F.lit(" "), T.escape_text(F.when(F.coalesce("numbering", F.lit("")) != "", F.concat("numbering", F.lit(" "), t)).otherwise(t)))
    paragraph = F.when(body == "", "").when(F.col("style") == "quote", spaced(F.regexp_replace(body, "(?m)^", "> "))).when(F.col("style") == "caption", spaced(F.concat(F.lit("*"), body, F.lit("*")))).when(F.col("style") == "pre", spaced(F.concat(F.lit("```\n"), F.col("text"), F.lit("\n```")))).otherwise(spaced(body))
    item = F.concat(F.when(previous_kind.eqNullSafe(F.lit("list_item")), "").otherwise("\n"), list_item(F.col("text"), F.col("marker"), F.col("ordered"), F.col("list_level")), F.lit("\n"))
    note = spaced(F.concat(F.lit("> **["), F.coalesce(F.nullif(F.trim("marker"), F.lit("")), F.lit("*")), F.lit("]** "), body))
    breaks = F.concat(F.lit("\n<!-- página "), F.col("page").cast("string"), F.lit(" -->\n\n")) if page_markers else F.lit("")
    kind = F.col("kind")
    out = F.when(kind == "heading", spaced(heading)).when(kind == "paragraph", paragraph).when(kind == "list_item", item).when(kind == "footnote", note).when(kind == "page_break", breaks).when((kind == "table") & (t != ""), spaced(t)).when(kind == "figure", spaced(F.concat(F.lit("!["), F.regexp_replace(t, "\\]", "\\\\]"), F.lit("](assets/"), F.col("block_id"), F.lit(".png)")))).otherwise("")
    return F.concat(review, out)


def front_matter(meta: DataFrame) -> DataFrame:
    """(doc_id, front): meta needs filename, pages, sha256, title, author."""
    line = lambda k, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(k + ': "'), T.yaml_escape(c), F.lit('"\n'))).otherwise("")
    return meta.select("doc_id", F.concat(F.lit('---\norigem: "'), T.yaml_escape(F.col("filename")), F.lit('"\npaginas: '), F.col("pages").cast("string"), F.lit("\nsha256: "), F.col("sha256"), F.lit("\n"), line("titulo_pdf", F.col("title")), line("autor_pdf", F.col("author")), F.lit("---\n")).alias("front"))


def documents(ordered: DataFrame, front: DataFrame | None = None, page_markers: bool = True, review_markers: bool = True) -> DataFrame:
    """(doc_id, markdown) of ordered blocks (ord): rendered block by block, then gathered per file as its text."""
    rows = with_previous(ordered, "kind", "pk").select("doc_id", "ord", block_markdown(F.col("pk"), page_markers, review_markers).alias("md"))
    text = rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "md"))), lambda x: x["md"]), "").alias("body"))
    if front is None:
        return text.select("doc_id", T.collapse_blank_lines(F.col("body")).alias("markdown"))
    return text.join(front, "doc_id", "left").select("doc_id", T.collapse_blank_lines(F.concat(F.coalesce("front", F.lit("")), F.lit("\n"), "body")).alias("markdown"))


def end_footnotes(blocks: DataFrame) -> DataFrame:
    """(doc_id, notes): footnotes as a closing section, keyed page-marker."""
    f = blocks.where("kind = 'footnote'").select("doc_id", "page", "seq", F.concat(F.lit("[^"), F.col("page").cast("string"), F.lit("-"), F.coalesce(F.nullif(F.trim("marker"), F.lit("")), F.lit("*")), F.lit("]: "), T.strip(F.coalesce("text", F.lit("")))).alias("line"))
    return f.groupBy("doc_id").agg(F.concat(F.lit("\n---\n\n## Notas de rodapé\n\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "seq", "line"))), lambda x: x["line"]), "\n"), F.lit("\n")).alias("notes"))
