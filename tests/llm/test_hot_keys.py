"""Learned URL verdicts against brute force; hot keys are dealt apart; the chance that a sketch loses a link."""

import math
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from usagelake.llm import frames, mixing, near_duplicates, urls

RULES = (("net/x/", "block"), ("net/x/y/2", "allow"), ("a.net/u/1", "block"), ("a.net/u/2", "allow"), ("com/p/9", "allow"), ("b.com/", "allow"), ("com/p/", "allow"))


def pages(n=900, seed=5):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        host = rng.choice(["a.net", "a.net", "b.net", "b.com", "c.com", "none.edu"])
        depth = rng.randrange(6)
        segments = [rng.choice(["x", "y", "u", "p", str(rng.randrange(60)), str(rng.randrange(3))]) for _ in range(depth)]
        out.append(f"http://{host}/{'/'.join(segments)}")
    return out + ["http://a.net/u/1"] * 150 + [None, "nothing", "http://b.net/x", "http://b.net/x/", "http://b.net//x"]


def brute_tree(name, paths, ups, done):
    """paths: (page, segments left) under one node; ups gets each page's templates."""
    left = [(p, r) for p, r in paths if r]
    done += [p for p, r in paths if not r]
    if not left:
        return
    shared = os.path.commonprefix([r for _, r in left])
    stem = "/".join([name, *shared])
    split = [(p, r[len(shared)] if len(r) > len(shared) else None, r[len(shared) + 1 :]) for p, r in left]
    counts = Counter()
    for p, s, _ in split:
        if s is not None:
            counts[s] += p[2]
    wild = len(counts) > urls.VARIABLE_VALUES and sum(counts.values()) < len(counts) * urls.VARIABLE_PAGES
    below = defaultdict(list)
    for p, s, r in split:
        node = stem if s is None else f"{stem}/{'*' if wild else s}"
        for x in (stem, node):
            if x not in ups[p]:
                ups[p].append(x)
        below[node].append((p, r))
    for node, some in below.items():
        brute_tree(node, some, ups, done)


def brute_purity(ups, labelled, blocked):
    """Purity of each path: its branches' pooled counts, smoothed from the root down."""
    p = dict.fromkeys(ups, (sum(blocked.values()) + urls.PRIOR / 2) / (sum(labelled.values()) + urls.PRIOR))
    for level in range(max(map(len, ups.values()))):
        parents = defaultdict(lambda: defaultdict(list))
        for k, up in ups.items():
            if len(up) > level:
                parents[up[level - 1] if level else ""][up[level]].append(k)
        now = dict(p)
        for nodes in parents.values():
            lb = {n: (sum(labelled[k] for k in ks), sum(blocked[k] for k in ks)) for n, ks in nodes.items()}
            place = lambda l, b: min(int(math.asin(math.sqrt(b / l)) * (urls.BINS / (math.pi / 2))), urls.BINS - 1)
            bins = defaultdict(lambda: [0, 0])
            for l, b in lb.values():
                if l:
                    bins[place(l, b)][0] += l
                    bins[place(l, b)][1] += b
            branches, last = [], None
            for at in sorted(bins):
                l, b = bins[at]
                if last is not None:
                    l0, b0 = last
                    share = (b + b0) / (l + l0)
                    alike = abs(b / l - b0 / l0) <= urls.ALIKE * math.sqrt(share * (1 - share) * (1 / l + 1 / l0))
                if last is None or not alike:
                    branches.append([])
                branches[-1].append(at)
                last = l, b
            pool = {at: [sum(bins[x][i] for x in br) for i in (0, 1)] for br in branches for at in br}
            for n, ks in nodes.items():
                if lb[n][0]:
                    l, b = pool[place(*lb[n])]
                    for k in ks:
                        now[k] = (b + urls.PRIOR * p[k]) / (l + urls.PRIOR)
        p = now
    return p


@pytest.mark.parametrize("rows, hot", [(1_000_000, 100_000), (0, 5), (3, 10**6)])
def test_learned_verdicts_against_brute_force(spark, monkeypatch, rows, hot):
    """Small look-up tables, hot keys apart, and plain shuffles give the brute-force tree, purity and verdict."""
    spread = frames.spread_join
    monkeypatch.setattr(urls, "spread_join", lambda left, right, keys, **how: spread(left, right, keys, rows, hot, **how))
    given = pages()
    df = spark.createDataFrame([(i, u, i, -i) for i, u in enumerate(given)], "page_id long, url string, n long, ruled long").repartition(5)
    got = {r["page_id"]: r.asDict() for r in urls.judge(df, rules=RULES).collect()}
    assert len(got) == len(given) and all(r["n"] == i and r["ruled"] == -i for i, r in got.items())  # extra columns stay

    seen, labelled, blocked = Counter(), Counter(), Counter()
    says = dict(RULES)
    for r in got.values():
        k = r["host"], r["path"]
        seen[k] += 1
        labelled[k] += r["rule"] is not None
        blocked[k] += says.get(r["rule"]) == "block"
    keys = {k: (*k, n) for k, n in seen.items()}
    ups, done = {v: [v[0]] for v in keys.values()}, []
    for host in {k[0] for k in keys}:
        brute_tree(host, [(v, [s for s in k[1].split("/") if s]) for k, v in keys.items() if k[0] == host], ups, done)
    assert sorted(done) == sorted(keys.values())
    up = {k: ups[v] for k, v in keys.items()}
    want = brute_purity(up, labelled, blocked)
    for r in got.values():
        k = r["host"], r["path"]
        assert r["template"] == up[k][-1] and math.isclose(r["purity"], want[k], rel_tol=1e-9)
        assert r["verdict"] == (says[r["rule"]] if r["rule"] else "block" if want[k] > 0.5 else "allow")
    assert {r["verdict"] for r in got.values() if r["rule"] is None and r["host"]} == {"allow", "block"}
    assert any("*" in r["template"] for r in got.values())


def test_a_hot_id_is_ordered_in_many_tasks(spark, monkeypatch):
    """Most rows have no id, or one id: no task orders all of them, and the mix still meets its targets."""
    monkeypatch.setattr(mixing, "ORDER_ROWS", 16)
    rows = [(None, "a", 3)] * 600 + [(7, "b", 5)] * 300 + [(i, "c", i % 9) for i in range(100, 400)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long").repartition(4)
    base = df.withColumn("_row", F.monotonically_increasing_id()).withColumn("source_no", F.ascii("source"))
    dealt = mixing.order_buckets(base, 75, 3)
    assert dealt.count() == len(rows)
    assert max(r["count"] for r in dealt.groupBy("source_no", "_bucket").count().collect()) <= 4 * 16
    out, pieces = mixing.mix(df)
    taken = out.join(pieces.groupBy("_row").agg(F.sum("n").alias("taken")), "_row", "left").fillna(0, ["taken"]).collect()
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in taken) == Counter(rows)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in taken)
    total, target = Counter(), {r["source"]: r["target"] for r in taken}
    for r in taken:
        total[r["source"]] += r["taken"]
    assert all(abs(total[s] - target[s]) <= 1 for s in "abc")


def test_equal_rows_share_what_they_take(spark, monkeypatch):
    """A row repeated many times is joined to its share by counted look-up, whichever way that goes."""
    rows = [(1, "same old words", "a")] * 200 + [(i, f"word {i} of many", "b") for i in range(60)] + [(None, None, None), (None, "", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want, spread = None, frames.spread_join
    for limit, hot in ((1_000_000, 100_000), (0, 5), (0, 1000)):
        monkeypatch.setattr(mixing, "spread_join", lambda left, right, keys, at=(limit, hot), **how: spread(left, right, keys, *at, **how))
        got = Counter(map(tuple, mixing.taken_copies(df).collect()))
        want = want or got
        assert got == want and set(got) <= set(rows)


def test_registers_lose_no_link_near_the_threshold():
    """Pairs whose sets are 0.80 to 0.82 alike, of equal and unequal sizes: none is dropped on its registers.

    Under the sketch's law a pair is dropped with a probability below 40 exp(-DOUBT) (see maybe_linked) and, for too few
    equal registers, below the binomial tail that is summed here.
    """
    rng = np.random.default_rng(8)
    lost = 0
    for trial in range(1500):
        union = int(rng.integers(60, 900))
        both = math.ceil(rng.uniform(0.8, 0.82) * union)
        own = int(rng.integers(0, union - both + 1))
        h = rng.integers(0, 2**64, union, np.uint64)
        a, b = h[: both + own], np.concatenate([h[:both], h[both + own :]])
        at = np.array([0, len(a), len(a) + len(b)])
        regs = near_duplicates.registers(np.concatenate([a, b]), at)
        same = np.array([(regs[0] == regs[1]).sum()])
        more = np.array([(regs[0] > regs[1]).sum()])
        kept = near_duplicates.maybe_linked(more, near_duplicates.REGISTERS - same - more, same, float(len(a)), np.array([float(len(b))]), 0.8)
        lost += not kept[0] or same[0] < near_duplicates.FEWEST * near_duplicates.REGISTERS
    assert lost == 0
    m, few = near_duplicates.REGISTERS, math.ceil(near_duplicates.FEWEST * near_duplicates.REGISTERS)
    assert sum(math.comb(m, k) * 0.8**k * 0.2 ** (m - k) for k in range(few)) < 1e-20
