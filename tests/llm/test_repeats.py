"""Repeated windows of other lengths, rows alike in id and text, and names and labels that clash."""

import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from usagelake.llm import repeats, sharding, toxicity
from usagelake.llm.substring_dedup import dedup_substrings
from usagelake.llm.suffix_dedup import dedup_bytes


def left_bytes(texts, window):
    seen = Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - window + 1):
            if seen[t[i : i + window]] > 1:
                gone[i : i + window] = True
        out.append(bytes(np.frombuffer(t, np.uint8)[~gone]))
    return out


def left_words(rows, window):
    """rows (id, words): what is left of each, a null id being the largest."""
    rank = lambda i: (i is None, i or 0)
    first = {}
    for i, w in rows:
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            first[key] = min(first.get(key, (rank(i), s)), (rank(i), s))
    out = []
    for i, w in rows:
        gone = np.zeros(len(w), bool)
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < (rank(i), s):
                gone[s : s + window] = True
        out.append((i, len(w), int(gone.sum()), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize("window", [300, 500])
def test_long_windows_of_bytes(spark, window):
    rng = random.Random(window)
    some = lambda n: "".join(rng.choice("ab cdefg") for _ in range(n))
    shared, run = some(3000), "x" * 1500  # a run of one byte has long pieces
    texts = [some(200) + shared[:1400] + some(90), shared[900:], some(400) + shared[2400:2399 + window], run + some(50), some(30) + run[:700], some(window), None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_removed"], bytes(r["kept"])) for r in dedup_bytes(df, window).collect()}
    raw = [(t or "").encode() for t in texts]
    assert got == {i: (len(t) - len(k), k) for i, (t, k) in enumerate(zip(raw, left_bytes(raw, window), strict=True))}


@pytest.mark.parametrize("window, levels", [(300, (5, 300)), (280, (1, 40, 280))])
def test_long_windows_of_words(spark, window, levels):
    rng = random.Random(window)
    some = lambda n: [rng.choice("abcdefg") * rng.randint(1, 2) for _ in range(n)]
    shared = some(900)
    rows = [(0, some(30) + shared[:700]), (1, shared[200:] + some(40)), (2, ["y"] * 700), (3, some(5) + ["y"] * 400), (None, shared[:500]), (4, some(50))]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in dedup_substrings(df, window, levels).collect())
    assert got == Counter(left_words(rows, window))


def test_places_that_do_not_fit_are_refused(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for window, levels in ((70_000, (5, 70_000)), (10, (20,)), (10, (0, 10))):
        with pytest.raises(ValueError):
            dedup_substrings(df, window, levels)
    place = repeats.pack(2**40, 65_535)
    assert repeats.first_of(place) == 2**40 and repeats.count_of(place) == 65_535


@pytest.mark.parametrize("key", [None, 7])
def test_rows_alike_in_id_and_text_are_one_text(spark, key):
    """Their places grow with their number, not with its square."""
    rng = random.Random(1)
    text = " ".join(f"w{rng.randrange(900)}" for _ in range(250))
    half = " ".join(text.split()[60:190])
    df = spark.range(20_000).select(F.lit(key).cast("long").alias("doc_id"), F.lit(text).alias("text"))
    df = df.unionByName(spark.createDataFrame([(9, f"before {half} after")], "doc_id long, text string"))
    known = repeats.identified(df)
    assert repeats.firsts(known).count() == 2
    words = Counter((r["doc_id"], r["n_removed"]) for r in dedup_substrings(df).collect())
    other = 130 if key == 7 else 0
    assert words == Counter({(key, 0 if key == 7 else 130): 20_000, (9, other): 1})
    got = Counter((r["doc_id"], r["n_removed"]) for r in dedup_bytes(df).collect())
    assert got == Counter({(key, len(text)): 20_000, (9, len(half) + 2): 1})  # the spaces around it repeat too


def test_repeated_texts_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(repeats, "spread_join", lambda left, right, keys, **how: spread(left, right, keys, 1, 3, **how))
    from usagelake.llm.frames import spread_join as spread

    rows = [(i, "same text here", "t") for i in range(20)] + [(100 + i, f"pair {i // 2}", "t") for i in range(10)] + [(200, None, "t"), (201, "", "t"), (202, "alone", "t")]
    known = repeats.identified(spark.createDataFrame(rows, "doc_id long, text string, x string"))
    assert Counter((r["id"], r["first_id"], r["copies"]) for r in known.collect()) == Counter(
        [(i, 0, 20) for i in range(20)] + [(100 + i, 100 + i // 2 * 2, 2) for i in range(10)] + [(200, 200, 2), (201, 200, 2), (202, None, None)])


def test_shard_names_never_clash(spark):
    df = spark.createDataFrame([(i, 5, 6) for i in range(50)], "doc_id long, shard int, Slot int")
    got = sharding.shard(df, shards=3)
    assert got.columns == ["doc_id", "shard", "Slot", "_shard", "_slot"] and {(r["shard"], r["Slot"]) for r in got.collect()} == {(5, 6)}
    assert sorted(Counter(r["_shard"] for r in got.collect()).values()) == [16, 17, 17]


def test_shards_are_drawn_uniformly(spark):
    """Every way to deal five rows to two shards is as likely: 200 seeds against the expected share."""
    counts = defaultdict(int)
    cells, _ = sharding.cell_sizes(6, 2, 3)
    for seed in range(600):
        row = sharding.matrix_row(0, np.array([3, 3]), cells, seed)
        counts[tuple(int(x) for x in row)] += 1
    # three of six rows are the chunk's; a shard takes three: 9, 9 and 1, 1 of 20 ways
    assert sum(counts.values()) == 600 and {sum(k) for k in counts} == {3}
    per = len(cells) // 2
    first = Counter()
    for k, n in counts.items():
        first[sum(k[:per])] += n
    for got, ways in ((first[0], 1), (first[1], 9), (first[2], 9), (first[3], 1)):
        assert abs(got / 600 - ways / 20) < 4 * np.sqrt(ways / 20 * (1 - ways / 20) / 600)


def test_labels_that_disagree_both_count():
    texts = ["you utter fool"] * 6 + ["what a fine day"] * 6 + ["so it goes"] * 2
    toxic = [1] * 6 + [0] * 6
    one, other = toxicity.train(texts, [*toxic, 1, 0]), toxicity.train(texts, [*toxic, 0, 1])
    if one is not None:
        assert np.allclose(one.scores(["so it goes"]), other.scores(["so it goes"]))
    assert toxicity.train(["a", "a"], [0, 1]) is not None and toxicity.train(["a", "b"], [1, 1]) is None


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(3)
    for n in (1, 2, 6):
        score, trans = rng.normal(0, 1.5, n), rng.normal(0, 1, 3)
        odds, *_ = toxicity.marginals(score, np.array([0, n]), trans)
        weight = np.zeros((n, 2))
        for tags in itertools.product((0, 1), repeat=n):
            w = sum(s for s, t in zip(score, tags, strict=True) if t) + sum({(0, 1): trans[0], (1, 0): trans[1], (1, 1): trans[2]}.get(p, 0.0) for p in itertools.pairwise((0, *tags, 0)))  # words outside are clean
            for i, t in enumerate(tags):
                weight[i, t] += np.exp(w)
        assert np.allclose(odds / (1 + odds), weight[:, 1] / weight.sum(axis=1))


def test_held_out_is_never_null(spark, folder):
    top = folder("nullid", documents=([(None, "a", 1), (1, "b", 1), (None, None, 1)], "doc_id long, text string, score int"), labels=([], "doc_id long, quality int, toxic int"))
    got = toxicity.op9_toxicity(spark, top).collect()
    assert len(got) == 3 and all(r["held_out"] is not None and 0 <= r["score"] <= 1 for r in got)


def test_steps_hold_one_step_of_texts():
    import tracemalloc

    import pyarrow as pa

    from usagelake.llm.text import chunks, encode, steps

    texts = ["é" * 700, None, "", "x" * 5000, "y", *["word " * 600] * 2000]
    column = pa.array(texts).slice(0)
    raw, seen = encode(texts), []
    tracemalloc.start()
    for a, b, got in steps(column, 100_000):
        assert got == raw[a:b]
        seen.append((a, b))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == list(chunks(raw, 100_000))
    assert peak < 1_000_000 < sum(map(len, raw))
    assert list(steps(pa.array([], pa.string()))) == []


def test_powers_are_held_as_far_as_they_are_used():
    from usagelake.llm import text

    base = 12345 | 1
    assert text.powers(base, 3).tolist() == [1, base, base**2]
    assert len(text._powers[base]) < 10_000
    assert text.powers(base, 20_000)[19_999] == pow(base, 19_999, 1 << 64)
