"""Problem 4: deeply nested records as related flat tables (shared inlining).

1. ``schema_graph`` takes a census of the corpus: for every path, how often it
   held an object, a list or a scalar.  An element below one of its own kind
   (same name, similar fields) is that element again, so recursion of any depth
   is one node that refers to itself.
2. ``plan_tables`` decides on that graph: elements that occur once under their
   parent are inlined as columns; repeated elements, elements shared by
   several parents and elements that contain themselves get a table.  Elements
   of one name and similar fields under several parents share ONE table;
   optional fields do not part them.
3. ``flatten`` walks every record once and emits rows of all tables, each with
   its own id, its parent's table and id (the foreign key) and its position.

Defined results: null, blank, cut-off or non-JSON records give no row; a null
entry of a list gives no row but keeps its position; a lone object where a
list is planned counts as a list of one; a list or object written as JSON text
counts as what it holds; equal rows count once; extra columns are ignored.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ALIKE = 0.5  # share of fields two elements of one name have in common at least


class Node(NamedTuple):
    path: str
    objects: int
    lists: int
    scalars: int
    self_: bool = False  # holds its own kind somewhere below


class Table(NamedTuple):
    path: str
    parent: str | None  # the first of parents; None for the root
    columns: tuple[str, ...]
    parents: tuple[str, ...] = ()
    paths: tuple[str, ...] = ()  # every place of the element


def alike(a: frozenset[str] | set[str], b: frozenset[str] | set[str]) -> bool:
    """Whether two elements of one name are of one kind: enough of the smaller one's fields are in the other."""
    return bool(a) and bool(b) and len(a & b) >= ALIKE * min(len(a), len(b)) and len(a & b) >= min(2, len(a), len(b))


Above = tuple[tuple[str, Any, str], ...]  # (name, content, path) of the objects around a value


def fields(value: Any) -> frozenset[str]:
    """Names of the fields of an object, or of all objects of a list."""
    value = unwrap(value)
    if isinstance(value, dict):
        return frozenset(value)
    if isinstance(value, list):
        return frozenset(k for v in value if isinstance(x := unwrap(v), dict) for k in x)
    return frozenset()


def step(path: str, name: str, value: Any, above: Above) -> tuple[str, Above]:
    """(path of a field, what stands around its content): the path of an element above if it is that element again."""
    at = f"{path}.{name}" if path else name
    if value is not None and not isinstance(value, (dict, list, str)):
        return at, above
    for n, around, p in reversed(above):
        if n == name and (value is None or value in ([], {}) or alike(fields(value), fields(around))):
            at = p
            break
    return at, (*above, (name, value, at))


def unwrap(value: Any) -> Any:
    """A list or object written as JSON text, however often, taken as what it holds."""
    while isinstance(value, str) and value.lstrip()[:1] in ("[", "{", '"'):
        try:
            inner = json.loads(value)
        except (ValueError, RecursionError):
            break
        if isinstance(inner, str) and inner.lstrip()[:1] not in ("[", "{", '"'):
            break  # a quoted word is a word
        value = inner
    return value


def parse(text: str | None) -> Any:
    """The record as an object, or None if it cannot be read."""
    if text is None:
        return None
    try:
        value = unwrap(json.loads(text))
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def _census(adapt: Callable[[dict], dict] | None):
    def census(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, list[int]] = {}  # path -> objects, lists, scalars, met again below itself

        def visit(record: dict) -> None:
            waiting: list[tuple[Any, str, Above]] = [(record, "", ())]
            while waiting:
                value, path, above = waiting.pop()
                value = unwrap(value)
                c = counts.setdefault(path, [0, 0, 0, 0])
                if isinstance(value, dict):
                    c[0] += 1
                    for k, v in value.items():
                        plain = path.replace("[]", "")
                        at, around = step(plain, k, v, above)
                        if at != (f"{plain}.{k}" if plain else k):
                            counts.setdefault(at, [0, 0, 0, 0])[3] += 1
                        waiting.append((v, at, around))
                elif isinstance(value, list):
                    c[1] += 1
                    waiting += [(v, path + "[]", above) for v in value if v is not None]
                elif value is not None:
                    c[2] += 1

        for pdf in batches:
            for text in pdf["json"]:
                record = parse(text)
                if record is not None:
                    visit(adapt(record) if adapt else record)
        yield pd.DataFrame([(p, *c) for p, c in counts.items()], columns=["path", "objects", "lists", "scalars", "again"])

    return census


def schema_graph(records: DataFrame, json_col: str, adapt: Callable[[dict], dict] | None = None) -> dict[str, Node]:
    """path -> Node over all records. The paths of the schema reach the driver, never its records."""
    seen = records.select(F.col(json_col).alias("json")).mapInPandas(_census(adapt), "path string, objects bigint, lists bigint, scalars bigint, again bigint")
    rows = seen.groupBy("path").agg(F.sum("objects").alias("o"), F.sum("lists").alias("l"), F.sum("scalars").alias("s"), F.sum("again").alias("a")).collect()
    graph: dict[str, Node] = {}
    for r in rows:
        path = r["path"].replace("[]", "")
        old = graph.get(path, Node(path, 0, 0, 0))
        graph[path] = Node(path, old.objects + r["o"], old.lists + r["l"], old.scalars + r["s"], old.self_ or r["a"] > 0)
    return graph


def plan_tables(graph: dict[str, Node], repeated: tuple[str, ...] = ()) -> dict[str, Table]:
    """path -> Table. repeated: paths known to repeat even where the corpus at hand shows only lone elements."""
    known = set(graph) | set(repeated) | {p for r in repeated for p in [".".join(r.split(".")[: i + 1]) for i in range(r.count(".") + 1)]} | {""}
    children: dict[str, set[str]] = {}
    for p in known - {""}:
        children.setdefault(p.rpartition(".")[0], set()).add(p)
    many = {p for p in known if p and (p in repeated or (p in graph and graph[p].lists))}

    def signature(p: str) -> frozenset[str]:
        return frozenset(c.rpartition(".")[2] for c in children.get(p, ()))

    # one kind of element: one name and similar fields, whoever holds it; paths named as repeated stay apart
    kind: dict[str, str] = {}
    for p in sorted(known - {""}, key=lambda q: (q.count("."), q)):
        first = next((q for q in kind if kind[q] == q and q.rpartition(".")[2] == p.rpartition(".")[2] and q not in repeated and p not in repeated and len(signature(p)) > 1 and alike(signature(q), signature(p))), p)
        kind[p] = first
    often = Counter(kind.values())
    shared = {p for p, t in kind.items() if often[t] > 1}
    recursive = {p for p, n in graph.items() if p and n.self_}
    roots = {""} | many | shared | recursive

    def owner(p: str) -> str:
        while p and p not in roots:
            p = p.rpartition(".")[0]
        return p

    home = lambda p: kind.get(p, p)
    columns: dict[str, set[str]] = {home(r): set() for r in roots}
    for p in known - {""}:
        if p not in roots and not children.get(p):
            o = owner(p)
            columns[home(o)].add(p[len(o) :].lstrip("."))
    for p in roots - {""}:
        if p in graph and graph[p].scalars and not children.get(p):
            columns[home(p)].add("value")
    out = {}
    for t in columns:
        places = tuple(sorted(r for r in roots if home(r) == t))
        above = {home(owner(p.rpartition(".")[0])) for p in places if p} | ({t} if any(p in recursive for p in places) else set())
        parents = tuple(sorted(above))
        out[t] = Table(t, min((q for q in parents if q != t), default=None) if t else None, tuple(sorted(columns[t])), parents, places)
    return out


ROWS = "record string, tbl string, row_id string, parent_tbl string, parent_id string, parent_pos int, pos int, cells map<string,string>"


def flatten(records: DataFrame, key: str, json_col: str, tables: dict[str, Table], adapt: Callable[[dict], dict] | None = None) -> DataFrame:
    """Rows of all tables: (key, tbl, row_id, parent_tbl, parent_id, parent_pos, pos, cells); tbl is the path of its table.

    parent_pos is the position of the parent row in its own list, -1 under the root."""
    home = {place: t.path for t in tables.values() for place in (t.paths or (t.path,))}

    def cell(value: Any) -> str | None:
        if value is None or isinstance(value, str):
            return value
        return json.dumps(value, ensure_ascii=False)

    def rows_of(record: dict, rec: str) -> Iterator[tuple]:
        # (content, place, row id, parent's table, parent's id, parent's position, position, what stands around)
        waiting: list[tuple] = [(record, "", rec, None, None, -1, 0, ())]
        while waiting:
            value, place, row_id, parent_tbl, parent_id, parent_pos, pos, above = waiting.pop()
            cells: dict[str, str | None] = {}
            inside: list[tuple[Any, str, str, Above]] = [(value, place, "", above)]
            while inside:
                v, at, rel, around = inside.pop()
                v = unwrap(v)
                if rel and at in home:
                    for i, entry in enumerate(v if isinstance(v, list) else [v]):
                        entry = unwrap(entry)
                        if entry is not None:
                            waiting.append((entry, at, f"{row_id}/{rel}[{i}]", home[place], row_id, pos if place else -1, i, around))
                elif isinstance(v, dict):
                    for k, x in v.items():
                        inside.append((x, *_named(*step(at, k, x, around), rel, k)))
                else:
                    cells[rel or "value"] = cell(v)
            yield rec, home[place], row_id, parent_tbl, parent_id, parent_pos, pos, cells

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: list[tuple] = []
            for rec, text in zip(pdf["record"], pdf["json"]):
                record = parse(text)
                if record is not None:
                    out += rows_of(adapt(record) if adapt else record, rec)
            yield pd.DataFrame(out, columns=["record", "tbl", "row_id", "parent_tbl", "parent_id", "parent_pos", "pos", "cells"])

    source = records.select(F.col(key).cast("string").alias("record"), F.col(json_col).alias("json")).where("json is not null").distinct()
    rows = source.mapInPandas(walk, ROWS)
    return rows.withColumn(key, F.col("record").cast(records.schema[key].dataType)).select(key, "tbl", "row_id", "parent_tbl", "parent_id", "parent_pos", "pos", "cells")


def _named(at: str, around: Above, rel: str, name: str) -> tuple[str, str, Above]:
    return at, f"{rel}.{name}" if rel else name, around


def as_table(rows: DataFrame, key: str, table: Table) -> DataFrame:
    """One flat table of the plan: keys, foreign key, position and a column per inlined element."""
    cols = [F.col("cells")[c].alias(c.replace(".", "_")) for c in table.columns]
    parent = ["parent_tbl"] if len(table.parents) > 1 else []  # a shared or recursive element says which table its parent is in
    return rows.where(F.col("tbl") == table.path).select(key, "row_id", *parent, "parent_id", "parent_pos", "pos", *cols)


# The repeated elements of a processing report and the keys of one table entry.
REPORT_REPEATED = ("paginas", "tabelas.detalhe", "warnings", "warnings.detail.paginas")
REPORT_CHILDREN = {"paginas": "paginas", "tabelas.detalhe": "tabelas", "warnings": "warnings", "warnings.detail.paginas": "warning_pages"}
SUMMARY_KEYS = {"detalhe", "total", "para_revisar", "motores_de_reserva", "abaixo_do_limiar"}


def adapt_report(record: dict) -> dict:
    """Give table entries one home: tabelas.detalhe, also where tabelas is the list itself or a lone entry."""
    tables = unwrap(record.get("tabelas"))
    if isinstance(tables, list) or (isinstance(tables, dict) and tables and not SUMMARY_KEYS & set(tables)):
        record = {**record, "tabelas": {"detalhe": tables}}
    elif isinstance(tables, dict):
        record = {**record, "tabelas": tables}
    return record


def report_tables(reports: DataFrame, key: str = "report_id", json_col: str = "resultado_processamento") -> tuple[DataFrame, dict[str, Table]]:
    """(rows of all tables, plan) of processing reports."""
    plan = plan_tables(schema_graph(reports, json_col, adapt_report), REPORT_REPEATED)
    return flatten(reports, key, json_col, plan, adapt_report), plan


def report_children(reports: DataFrame, key: str = "report_id", json_col: str = "resultado_processamento") -> DataFrame:
    """(key, child, parent_pos, pos) of the four flattened children of every readable report."""
    rows, _ = report_tables(reports, key, json_col)
    child = F.element_at(F.create_map(*[F.lit(x) for kv in REPORT_CHILDREN.items() for x in kv]), F.col("tbl"))
    kept = rows.where(F.col("tbl").isin(list(REPORT_CHILDREN)))
    return kept.select(key, child.alias("child"), F.when(F.col("tbl") == "warnings.detail.paginas", F.col("parent_pos")).otherwise(-1).alias("parent_pos"), "pos").distinct()
