"""Substring dedup by level-wise doubling.

Windows of 20 words that start earlier too are removed.  Levels look at runs of
5, 10 and 20 words: windows repeated at one length alone are extended to twice
that length, until none are left or the windows themselves are compared.  At
each level a window stands for the least of the runs it holds, so neighbouring
windows share a row; pieces that agree in the digest of all their words are
settled at once, the others go on (see repeats.py).

Defined results: null and empty texts have no words and keep the empty string;
texts with fewer words than a window are kept; of two rows with one id neither
starts earlier at the same place; a null id is the largest; ids that are no
integers are refused; other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import cut, table
from .repeats import arrays, covered, doc_id, every_document, firsts, fits, identified, pieces, settled, with_places
from .text import Batch, steps

WINDOW = 20
LEVELS = (5, 10, 20)


def repeated_words(docs: DataFrame, window: int = WINDOW, levels=LEVELS) -> DataFrame:
    """(id, doc, place): packed places of windows that start earlier too. docs: (id, doc, text), each text once."""
    found, some = None, docs
    for gram in levels:
        level = cut(settled(pieces(some, "word", window, gram)))
        later = level.filter("later").select("id", "doc", "place")
        found = later if found is None else found.unionByName(later)
        if gram != window:
            some = with_places(docs, level.filter("open"))
    return found


def _strip(docs: DataFrame, window: int) -> DataFrame:
    names = ["id", "lost", "n_words", "n_removed", "kept"]
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches):
        for whole in batches:
            for a, b, raw in steps(whole.column("text")):
                batch = Batch(raw)
                start, end, first = batch.words()
                rows = []
                ids, lost, gone = (whole.column(c).slice(a, b - a).to_pylist() for c in ("id", "lost", "gone"))
                for i, places in enumerate(arrays(whole, "places", a, b)):
                    lo, hi = first[i], first[i + 1]
                    text, off, n = raw[i], batch.at[i], int(hi - lo)
                    keep = np.ones(n, bool)
                    if gone[i] and n >= window:
                        keep[:] = False
                    for x, y in zip(*covered(places, window, n), strict=True):
                        keep[x:y] = False
                    left = np.flatnonzero(keep) + lo
                    kept = b" ".join([text[x:y] for x, y in zip((start[left] - off).tolist(), (end[left] - off).tolist(), strict=True)])
                    rows.append((ids[i], lost[i], n, n - len(left), kept))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    gone = F.coalesce(F.col("id") > F.col("first_id"), F.lit(False)).alias("gone")
    stripped = docs.select("id", "lost", "text", "places", gone).mapInArrow(run, "id long, lost boolean, n_words long, n_removed long, kept binary")
    return stripped.select(doc_id(), "n_words", "n_removed", F.col("kept").cast("string").alias("kept"))


def dedup_substrings(docs: DataFrame, window: int = WINDOW, levels=LEVELS) -> DataFrame:
    """doc_id, n_words, n_removed and kept, the words that are left, joined by spaces."""
    fits(window, levels)
    known = identified(docs)
    return _strip(every_document(known, repeated_words(firsts(known), window, levels)), window)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
