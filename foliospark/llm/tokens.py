"""Problem 8: token ids of a whole corpus under a public byte-level BPE.

The corpus is cut into pre-token pieces by the tokenizer's pattern, every
*distinct* piece is encoded once by a fold of ranked merges (higher-order
functions over its byte array, no Python), and ids are put back by piece.

Frequent pieces would make the join back a skewed one: the HOT_PIECES most
frequent pieces (a fixed number) are a literal map and are put back inside
their document's row, so no row of theirs is ever shuffled.  All others, a few
per document, leave their place as a negative number and meet their ids in a
shuffle join.

Defined results: null and empty texts give an empty list; whitespace is
encoded as any other text; duplicate documents keep their own rows; a null key
is a key like others.
"""

from __future__ import annotations

import base64
import json
import os
import zlib
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.runtime import cut, spread

VOCABULARY = os.environ.get("FOLIOSPARK_BPE", "/opt/tokenizers/byte_bpe_50k.tiktoken")
BUCKETS = 8192
HOT_PIECES = 4096

# Fixed value: the white-space class of the tokenizer's pattern; Java's \s is ASCII only.
WS = "\\t-\\r\\x{85} \\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"
PIECE = f"'(?:[sdmt]|ll|ve|re)| ?\\p{{L}}++| ?\\p{{N}}++| ?[^{WS}\\p{{L}}\\p{{N}}]++|[{WS}]+(?![^{WS}])|[{WS}]"


@lru_cache(maxsize=4)
def _ranks(path: str) -> dict[str, int]:
    """Token bytes in hex -> id. Bounded by the vocabulary, never by the corpus."""
    with open(path, "rb") as f:
        return {base64.b64decode(a).hex().upper(): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=4)
def _rank_json(path: str) -> str:
    slots: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for token, rank in _ranks(path).items():
        slots[zlib.crc32(token.encode()) % BUCKETS][token] = rank
    return json.dumps(slots, separators=(",", ":"))


def rank_map(path: str) -> Column:
    """The rank map as a literal, spread over hash slots: a lookup in one large Spark map is a linear scan."""
    return F.from_json(F.lit(_rank_json(path)), "array<map<string,int>>")


def _let(value: Column, body) -> Column:
    """Bind value once inside an expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def encode_piece(piece: Column, path: str = VOCABULARY) -> Column:
    """Ids of one pre-token piece: merge the adjacent pair of lowest rank until none is left."""
    ranks = rank_map(path)

    def look(token: Column) -> Column:
        return F.get(ranks, (F.crc32(token) % BUCKETS).cast("int"))[token]

    def start(hexed: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), (F.length(hexed) / 2 - 1).cast("int")), lambda i: F.substring(hexed, i * 2 + 1, F.lit(2)))
        return _let(
            parts,
            lambda p: F.struct(
                p.alias("parts"),
                F.when(F.size(p) > 1, F.transform(F.sequence(F.lit(0), F.size(p) - 2), lambda i: look(F.concat(F.get(p, i), F.get(p, i + 1)))))
                .otherwise(F.array().cast("array<int>"))
                .alias("ranks"),
            ),
        )

    def merge(s: Column, _: Column) -> Column:
        def at(pos: Column) -> Column:  # pos: 1-based place of the leftmost best pair
            parts, rs = s["parts"], s["ranks"]
            n = F.size(parts)
            joined = F.concat(F.get(parts, pos - 1), F.get(parts, pos))
            left = F.when(pos > 1, F.array(look(F.concat(F.get(parts, pos - 2), joined)))).otherwise(F.array().cast("array<int>"))
            right = F.when(pos + 1 < n, F.array(look(F.concat(joined, F.get(parts, pos + 1))))).otherwise(F.array().cast("array<int>"))
            return F.struct(
                F.concat(F.slice(parts, F.lit(1), pos - 1), F.array(joined), F.slice(parts, pos + 2, n)).alias("parts"),
                F.concat(F.slice(rs, F.lit(1), F.greatest(pos - 2, F.lit(0))), left, right, F.slice(rs, pos + 2, n)).alias("ranks"),
            )

        best = F.array_min(s["ranks"])
        return F.when(best.isNull(), s).otherwise(_let(F.array_position(s["ranks"], best).cast("int"), at))

    def fold(hexed: Column) -> Column:
        rounds = F.sequence(F.lit(1), F.greatest(F.lit(1), (F.length(hexed) / 2 - 1).cast("int")))
        done = F.aggregate(rounds, start(hexed), merge)
        return F.transform(done["parts"], look)

    hexed = F.hex(F.encode(piece, "utf-8"))
    whole = look(hexed)
    return F.when(whole.isNotNull(), F.array(whole)).otherwise(fold(hexed))


def pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))


def piece_table(docs: DataFrame, path: str = VOCABULARY, text: str = "text") -> DataFrame:
    """(piece, n, ids): every distinct piece of the corpus, encoded once."""
    counted = docs.where(F.col(text) != "").select(F.explode(pieces(F.col(text))).alias("piece")).groupBy("piece").agg(F.count("*").alias("n"))
    return cut(counted.select("piece", "n", encode_piece(F.col("piece"), path).alias("ids")))


def _hot_map(table: DataFrame, value: str, kind: str):
    """Column function: the value of a hot piece, null for others. HOT_PIECES rows reach the driver, whatever the corpus."""
    slot = F.pmod(F.hash("piece"), F.lit(BUCKETS)).alias("slot")
    slots: list[dict] = [{} for _ in range(BUCKETS)]
    for r in table.orderBy(F.desc("n"), "piece").limit(HOT_PIECES).select("piece", slot, value).collect():
        slots[r["slot"]][r["piece"]] = r[value]
    literal = F.from_json(F.lit(json.dumps(slots, separators=(",", ":"))), f"array<map<string,{kind}>>")
    return lambda piece: F.get(literal, F.pmod(F.hash(piece), F.lit(BUCKETS)))[piece]


def _rest(marks: Column) -> Column:
    """Places of pieces whose value is still unknown; a mark is -1 - place."""
    return F.transform(F.filter(marks, lambda x: x < 0), lambda x: -x - 1)


def encode_corpus(docs: DataFrame, path: str = VOCABULARY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids) for every row of docs; key must be unique. Extra columns are ignored."""
    docs = spread(docs.select(key, text), key)
    table = piece_table(docs, path, text)
    hot = _hot_map(table, "ids", "array<int>")
    d = docs.select(F.col(key), pieces(F.coalesce(F.col(text), F.lit(""))).alias("__p"))
    d = d.withColumn("__ids", F.flatten(F.transform("__p", lambda p, i: F.coalesce(hot(p), F.array(-i - 1)))))
    rest = F.transform(_rest(F.col("__ids")), lambda i: F.struct(i.alias("pos"), F.get("__p", i).alias("piece")))
    part = cut(d.select(key, "__ids", rest.alias("__rest")))
    more = part.select(F.col(key).alias("__k"), F.inline("__rest")).join(table.select("piece", "ids"), "piece")
    more = more.groupBy("__k").agg(F.map_from_entries(F.collect_list(F.struct("pos", "ids"))).alias("__more"))
    whole = part.drop("__rest").join(more, F.col(key).eqNullSafe(F.col("__k")), "left")
    filled = F.flatten(F.transform("__ids", lambda x: F.when(x < 0, F.col("__more")[-x - 1]).otherwise(F.array(x))))
    return whole.select(key, F.when(F.col("__more").isNull(), F.col("__ids")).otherwise(filled).alias("ids"))


def token_counts(docs: DataFrame, path: str = VOCABULARY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens bigint) for every row of docs; 0 for null and empty texts."""
    docs = spread(docs.select(key, text), key)
    table = piece_table(docs, path, text).select("piece", "n", F.size("ids").alias("size"))
    hot = _hot_map(table, "size", "int")
    d = docs.select(F.col(key), pieces(F.coalesce(F.col(text), F.lit(""))).alias("__p")).withColumn("__n", F.transform("__p", lambda p, i: F.coalesce(hot(p), -i - 1)))
    known = F.aggregate("__n", F.lit(0).cast("long"), lambda a, x: a + F.greatest(x, F.lit(0)))
    part = cut(d.select(key, known.alias("n_tokens"), F.transform(_rest(F.col("__n")), lambda i: F.get("__p", i)).alias("__rest")))
    more = part.select(key, F.explode("__rest").alias("piece")).join(table.select("piece", "size"), "piece").select(key, F.col("size").cast("long").alias("n_tokens"))
    return part.select(key, "n_tokens").unionByName(more).groupBy(key).agg(F.sum("n_tokens").alias("n_tokens"))


@lru_cache(maxsize=4)
def _token_json(path: str) -> str:
    ranks = _ranks(path)
    back = [""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        back[rank] = token
    return json.dumps(back)


def decode_ids(ids: Column, path: str = VOCABULARY) -> Column:
    """Text of a list of ids: its tokens' bytes concatenated, then decoded; an empty list gives ''."""
    tokens = F.from_json(F.lit(_token_json(path)), "array<string>")
    return F.decode(F.unhex(F.array_join(F.transform(ids, lambda i: F.get(tokens, i)), "")), "utf-8")
