"""Content guard: multiset fingerprints of a file's text, their differences, and guarded edits.

An edit is accepted only if characters, numbers and words are the same multisets before and after, spaces and hyphens
aside. Accepted edits leave the fingerprint as it is, so each edit is judged by the blocks it touches alone.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from foliospark.functions import text as T

# Characters an edit may add or remove.
MUTABLE = " \t\r\n -‐‑‒–—\xad"


@F.pandas_udf(StringType())
def fold_text(s: pd.Series) -> pd.Series:
    """NFKC and case folding, which Spark has no function for."""
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


def fields(blocks: DataFrame) -> DataFrame:
    """(doc_id, field): every text that carries content: block texts, heading numberings, list and note markers."""
    b = blocks.distinct()
    extra = F.when(F.col("kind") == "heading", F.col("numbering")).when(F.col("kind").isin("list_item", "footnote"), F.col("marker"))
    textual = F.when(F.col("kind").isin("heading", "paragraph", "list_item", "footnote", "table", "figure"), F.col("text"))
    return b.select("doc_id", F.explode(F.array_compact(F.array(textual, extra))).alias("field")).where("field <> ''")


def fingerprint(blocks: DataFrame, folded: bool = True) -> DataFrame:
    """(doc_id, layer, token, n) with layers chars, numbers and words. folded=False uses lower() in place of NFKC and case folding."""
    f = fields(blocks).withColumn("t", fold_text(F.col("field")) if folded else F.lower("field"))
    split = lambda layer, tokens: f.select("doc_id", F.lit(layer).alias("layer"), F.explode(tokens).alias("token"))
    chars = split("chars", F.filter(F.split("t", ""), lambda c: (c != "") & ~F.lit(MUTABLE).contains(c)))
    numbers = split("numbers", F.regexp_extract_all("t", F.lit(T.NUMBER), F.lit(0)))
    words = split("words", F.regexp_extract_all("t", F.lit(T.WORD), F.lit(0)))
    return chars.unionByName(numbers).unionByName(words).groupBy("doc_id", "layer", "token").agg(F.count("*").alias("n"))


def difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """(doc_id, layer, token, added, removed): multiset differences both ways."""
    key = ["doc_id", "layer", "token"]
    j = before.withColumnRenamed("n", "b").join(after.withColumnRenamed("n", "a"), key, "full").na.fill(0, ["a", "b"])
    return j.select(*key, F.greatest(F.lit(0), F.col("a") - F.col("b")).alias("added"), F.greatest(F.lit(0), F.col("b") - F.col("a")).alias("removed")).where("added > 0 or removed > 0")


def explainable(removed: Counter, added: Counter) -> bool:
    """Whether the new words are exact fusions of two vanished ones, and nothing else vanished."""
    if not added and not removed:
        return True
    left = Counter({w: n for w, n in removed.items() if n > 0})
    for word, n in added.items():
        for _ in range(n):
            for cut in range(1, len(word)):
                a, b = word[:cut], word[cut:]
                if left[a] > 0 and left[b] > 0 and not (a == b and left[a] < 2):
                    left[a] -= 1
                    left[b] -= 1
                    break
            else:
                return False
    return not +left


def preserved(diff: DataFrame) -> DataFrame:
    """(doc_id, preserved) of the files with a difference; files without one are preserved."""

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, hard, words in zip(pdf["doc_id"], pdf["hard"], pdf["words"]):
                gone, new = Counter(), Counter()
                for w in words:
                    new[w["token"]] += w["added"]
                    gone[w["token"]] += w["removed"]
                rows.append((doc, not hard and explainable(+gone, +new)))
            yield pd.DataFrame(rows, columns=["doc_id", "preserved"])

    per = diff.groupBy("doc_id").agg(F.count_if(F.col("layer") != "words").alias("hard"), F.collect_list(F.when(F.col("layer") == "words", F.struct("token", "added", "removed"))).alias("words"))
    return per.mapInPandas(judge, "doc_id string, preserved boolean")


def summary(diff: DataFrame, k: int = 6) -> DataFrame:
    """(doc_id, summary): per layer the k most frequent tokens added and removed."""
    long_ = diff.select("doc_id", "layer", "token", F.explode(F.array(F.struct(F.lit("acrescentou").alias("way"), F.col("added").alias("n")), F.struct(F.lit("removeu").alias("way"), F.col("removed").alias("n")))).alias("x")).select("doc_id", "layer", "token", "x.*").where("n > 0")
    from pyspark.sql import Window

    top = long_.withColumn("r", F.row_number().over(Window.partitionBy("doc_id", "layer", "way").orderBy(F.desc("n"), "token"))).where(F.col("r") <= k)
    part = top.groupBy("doc_id", "layer", "way").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", F.concat("token", F.lit("×"), F.col("n").cast("string")).alias("t")))), lambda x: x["t"]), ", ").alias("s"))
    line = F.concat("way", F.lit(" "), "layer", F.lit(" ["), "s", F.lit("]"))
    return part.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(line)), "; ").alias("summary"))


# Edits. A block is a dict of the columns below.
BLOCK_COLUMNS = ["block_id", "seq", "kind", "text", "style", "level", "numbering", "marker", "ordered", "source", "needs_review", "review_reason", "n_rows", "header_rows"]


class EditError(Exception):
    """An edit that cannot be applied."""


def _content(blocks: list[dict]) -> tuple[Counter, Counter, Counter]:
    import re

    chars, numbers, words = Counter(), Counter(), Counter()
    for b in blocks:
        extra = b["numbering"] if b["kind"] == "heading" else b["marker"] if b["kind"] in ("list_item", "footnote") else None
        for f in (b["text"], extra):
            if f:
                t = unicodedata.normalize("NFKC", f).casefold()
                chars.update(c for c in t if c not in MUTABLE)
                numbers.update(re.findall(r"\d[\d.,:/]*\d|\d", t))
                words.update(re.findall(r"[^\W\d_]+", t))
    return chars, numbers, words


def same_content(before: list[dict], after: list[dict]) -> bool:
    (c0, n0, w0), (c1, n1, w1) = _content(before), _content(after)
    return c0 == c1 and n0 == n1 and explainable(w0 - w1, w1 - w0)


def apply_edit(blocks: dict[str, dict], op: dict) -> list[str]:
    """Apply op in place; ids of removed blocks. blocks: id -> block."""
    ids = list(op["ids"] if op["ids"] is not None else [])
    missing = [i for i in ids if i not in blocks]
    if missing or not ids:
        raise EditError(f"id fora do documento: {missing[0] if missing else ''}")
    chosen = [blocks[i] for i in ids]
    first, kind, gone = chosen[0], op["op"], []

    def need(ok: bool, why: str) -> None:
        if not ok:
            raise EditError(why)

    if kind == "merge_blocks":
        need(len(ids) > 1 and all(b["kind"] in ("paragraph", "list_item") for b in chosen), "união pede dois ou mais parágrafos ou itens")
        for other in chosen[1:]:
            a, t = (first["text"] or "").rstrip(), (other["text"] or "").lstrip()
            first["text"] = a[:-1] + t if a.endswith("-") else f"{a} {t}".strip()
            gone.append(other["block_id"])
            del blocks[other["block_id"]]
        chosen = [first]
    elif kind == "set_heading_level":
        need(first["kind"] == "heading" and 1 <= (op["level"] or 0) <= 6, "o alvo deveria ser título com nível de 1 a 6")
        first["level"] = op["level"]
    elif kind == "promote_to_heading":
        need(first["kind"] in ("paragraph", "list_item") and 1 <= (op["level"] or 0) <= 6, "título só nasce de parágrafo ou item, nível de 1 a 6")
        first.update(numbering=first["marker"] if first["kind"] == "list_item" else None, kind="heading", level=op["level"], marker=None)
    elif kind == "demote_to_paragraph":
        need(first["kind"] == "heading", "o alvo deveria ser título com nível de 1 a 6")
        first.update(kind="paragraph", style="body", text=f"{first['numbering']} {first['text']}".strip() if first["numbering"] else first["text"], numbering=None, level=None)
    elif kind == "promote_to_list":
        need(all(b["kind"] == "paragraph" for b in chosen), "o alvo deveria ser parágrafo")
        for b in chosen:
            b.update(kind="list_item", ordered=bool(op["ordered"]), marker="1." if op["ordered"] else "-")
    elif kind == "mark_as_footnote":
        need(first["kind"] == "paragraph", "o alvo deveria ser parágrafo")
        first.update(kind="footnote", marker=op["marker"] or "*")
    elif kind == "mark_as_quote":
        need(first["kind"] == "paragraph", "o alvo deveria ser parágrafo")
        first["style"] = "quote"
    elif kind == "reorder":
        order = sorted(b["seq"] for b in chosen)
        need(len(ids) > 1 and order == list(range(order[0], order[0] + len(order))), "nova ordem pede blocos vizinhos sem lacuna")
        for seq, b in zip(order, chosen):
            b["seq"] = seq
    elif kind == "set_table_header_rows":
        need(first["kind"] == "table" and 0 <= (op["header_rows"] or 0) <= 3 and (op["header_rows"] or 0) < (first["n_rows"] or 0), "linhas de cabeçalho: de 0 a 3 e menos que a tabela")
        first["header_rows"] = op["header_rows"]
    elif kind == "flag_review":
        first.update(needs_review=True, review_reason=f"apontado: {op['note']}")
        return gone
    else:
        raise EditError(f"tipo de edição sem regra: {kind}")
    for b in chosen:
        b["source"] = "ai"
    return gone


EDITED = "doc_id string, op_seq int, outcome string, detail string, block_id string, seq bigint, kind string, text string, style string, level int, numbering string, marker string, ordered boolean, source string, needs_review boolean, review_reason string, n_rows int, header_rows int, removed boolean"


def guarded_edits(blocks: DataFrame, ops: DataFrame) -> DataFrame:
    """Outcome of every op and the state of the blocks the ops of a file touch: rows of EDITED.

    Only blocks that some op names travel; ops of a file run in order of op_seq, each on a copy."""
    named = ops.select("doc_id", F.explode("ids").alias("block_id")).distinct()
    cols = [F.col(c) if c in blocks.columns else F.lit(None).cast("int").alias(c) for c in BLOCK_COLUMNS]
    touched = blocks.distinct().join(named, ["doc_id", "block_id"]).groupBy("doc_id").agg(F.collect_list(F.struct(*cols)).alias("blocks"))
    queue = ops.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("op_seq", "op", "ids", "level", "marker", "ordered", "header_rows", "note", "reason"))).alias("ops"))
    ready = queue.join(touched, "doc_id", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split(" ")[0] for c in EDITED.split(", ")]
        for pdf in batches:
            out = []
            for doc, queue_, have in zip(pdf["doc_id"], pdf["ops"], pdf["blocks"]):
                state = {b["block_id"]: dict(b) for b in (have if have is not None else [])}
                removed: dict[str, dict] = {}
                for op in queue_:
                    ids = [i for i in dict.fromkeys(op["ids"] if op["ids"] is not None else []) if i in state]
                    trial = {i: dict(state[i]) for i in ids}  # an edit changes nothing but the blocks it names
                    try:
                        gone = apply_edit(trial, op)
                    except EditError as e:
                        out.append((doc, int(op["op_seq"]), "failed", str(e), *[None] * 15))
                        continue
                    if not same_content([state[i] for i in ids], list(trial.values())):
                        out.append((doc, int(op["op_seq"]), "rejected", op["op"], *[None] * 15))
                        continue
                    for g in gone:
                        removed[g] = state.pop(g)
                    state.update(trial)
                    out.append((doc, int(op["op_seq"]), "applied", op["op"], *[None] * 15))
                for b, dead in [*((b, False) for b in state.values()), *((b, True) for b in removed.values())]:
                    out.append((doc, None, None, None, *[b[c] for c in names[4:-1]], dead))
            frame = pd.DataFrame(out, columns=names)
            for c in ("op_seq", "seq", "level", "n_rows", "header_rows"):
                frame[c] = frame[c].astype("Int64")
            yield frame

    return ready.mapInPandas(run, EDITED)


def edit_totals(outcome: DataFrame) -> DataFrame:
    """(doc_id, proposed, applied, rejected, failed)."""
    o = outcome.where("outcome is not null")
    return o.groupBy("doc_id").agg(F.count("*").alias("proposed"), *[F.count_if(F.col("outcome") == k).alias(k) for k in ("applied", "rejected", "failed")])
