"""Benchmark decontamination: one Aho-Corasick automaton over benchmark windows.

Every run of 13 consecutive words of a benchmark item (the whole item if it has
fewer) is a pattern of word numbers.  Documents are normalised and scanned once;
matches give the words hit, the items met and, for documents with hits, offsets
in the original text.  The automaton itself is pyahocorasick's: a trie with
failure links in C, where Python code would run for each word.

One automaton holds up to BLOCK_BYTES of benchmark text, so that it fits beside
the data in each Python worker; a larger benchmark takes a scan for each block,
each of which finds its state written by the one before.

Defined results: a null or empty text has no words and no hits; an item without
text or words, or with a null id, takes no part; equal items with ids of their own each count; rows
are judged one by one, so repeated rows repeat their result; an empty benchmark
hits nothing; items with one id are one item.  Other columns of the documents are kept; the result is one
struct column whose name is a parameter.
"""

from __future__ import annotations

import re

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import cut, table, unused

WINDOW = 13
#: UTF-8 bytes of benchmark text in one broadcast; a larger benchmark is scanned block by block.
BLOCK_BYTES = 2_000_000
#: A document is contaminated if it has hits and SHARE * hits >= words.
SHARE = 20

_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_STATE = "struct<n_words:bigint,starts:array<int>,ends:array<int>,items:array<string>>"
_NORMAL = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_built: dict[str, object] = {}


def normal_words(text: str | None) -> list[bytes]:
    """Lower-cased words of a text as UTF-8."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(_NORMAL).split()


def automaton(items: list[tuple[str, str]], window: int) -> tuple[ahocorasick.Automaton, dict[bytes, int]]:
    """(patterns -> (words, items that hold them), number of each word from 1)."""
    held: dict[tuple[int, ...], tuple[int, set[str]]] = {}
    numbers: dict[bytes, int] = {}
    for item, text in items:
        words = [numbers.setdefault(w, len(numbers) + 1) for w in normal_words(text)]
        for i in range(max(1, len(words) - window + 1) if words else 0):
            part = tuple(words[i : i + window])
            held.setdefault(part, (len(part), set()))[1].add(item)
    auto = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for pattern, value in held.items():
        auto.add_word(pattern, value)
    if held:
        auto.make_automaton()
    return auto, numbers


def _automaton(token: str, items, window: int):
    """Built once in each Python worker."""
    if token not in _built:
        _built.clear()
        _built[token] = automaton(items, window)
    return _built[token]


def hits(words: list[bytes], auto, numbers: dict[bytes, int]) -> tuple[list[tuple[int, int]], set[str]]:
    """Merged [start, end) runs of hit words, and the items met."""
    if not len(auto) or not words:
        return [], set()
    runs, items = [], set()
    for end, (length, own) in auto.iter(tuple([numbers.get(w, 0) for w in words])):
        items |= own
        runs.append((end + 1 - length, end + 1))
    return merged(runs), items


def merged(runs) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def scan(block: list[tuple[str, str]], window: int, broadcast):
    """Column function over (text, state so far) for one block of items."""
    token = f"{hash(tuple(block))}-{window}"

    @F.pandas_udf(_STATE)
    def one(text: pd.Series, starts: pd.Series, ends: pd.Series, items: pd.Series) -> pd.DataFrame:
        auto, numbers = _automaton(token, broadcast.value, window)
        rows = []
        for t, a, b, had in zip(text, starts, ends, items, strict=True):
            words = normal_words(t)
            runs, met = hits(words, auto, numbers)
            if len(a):
                runs = merged([*runs, *zip(map(int, a), map(int, b), strict=True)])
            met.update(had)
            rows.append((len(words), [x for x, _ in runs], [y for _, y in runs], list(met)))
        return pd.DataFrame(rows, columns=["n_words", "starts", "ends", "items"])

    return one


def original_offsets(text: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
    """Character offsets in the original text of runs of words."""
    out = []
    for t, a, b in zip(text, starts, ends, strict=True):
        if not len(a):
            out.append([])
            continue
        at = [m.span() for m in _WORD.finditer(re.sub("[A-Z]", lambda m: m[0].lower(), t))]
        out.append([{"start": at[x][0], "end": at[y - 1][1]} for x, y in zip(a, b, strict=True)])
    return pd.Series(out)


def blocks(bench: DataFrame, block_bytes: int):
    """Items in blocks of a bounded size; one block at a time is on the driver."""
    block, size = [], 0
    rows = bench.select(F.col("item_id").cast("string").alias("i"), F.col("text").alias("t")).dropna()
    for r in rows.toLocalIterator():
        if block and size + len(r.t) > block_bytes:
            yield block
            block, size = [], 0
        block.append((r.i, r.t))
        size += len(r.t)
    yield block


def decontaminate(
    docs: DataFrame, bench: DataFrame, window: int = WINDOW, share: int = SHARE,
    block_bytes: int = BLOCK_BYTES, out: str = "decontamination", text: str = "text", offsets: bool = True,
) -> DataFrame:
    """docs with a struct column `out`: n_words, n_hit, items, spans (original offsets), contaminated."""
    spark = docs.sparkSession
    none = F.array().cast("array<int>")
    state = F.struct(F.lit(0).cast("long").alias("n_words"), none.alias("starts"), none.alias("ends"), F.array().cast("array<string>").alias("items"))
    df = docs
    tmp = unused(docs, f"_{out}_state")
    for i, block in enumerate(blocks(bench, block_bytes)):
        if i:
            df = cut(df)
        one = scan(block, window, spark.sparkContext.broadcast(block))
        df = df.withColumn(tmp, one(F.col(text), state["starts"], state["ends"], state["items"]))
        state = F.col(tmp)
    n_hit = F.aggregate(F.zip_with(state["starts"], state["ends"], lambda a, b: b - a), F.lit(0).cast("long"), lambda x, y: x + y)
    fields = [
        state["n_words"].alias("n_words"), n_hit.alias("n_hit"), F.array_sort(state["items"]).alias("items"),
        ((n_hit > 0) & (n_hit * share >= state["n_words"])).alias("contaminated"),
    ]
    if offsets:
        where = F.pandas_udf(original_offsets, "array<struct<start:int,end:int>>")
        fields.append(where(F.col(text), state["starts"], state["ends"]).alias("spans"))
    return df.withColumn(out, F.struct(*fields)).drop(tmp)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    d = F.col("d")
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), out="d", offsets=False).select(
        "doc_id", d["n_words"].alias("n_words"), d["n_hit"].alias("n_hit"),
        F.size(d["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(d["items"], ",").cast("binary"), 256).alias("items_sha256"),
        d["contaminated"].alias("contaminated"),
    )
