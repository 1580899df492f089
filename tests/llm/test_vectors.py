"""Vector codes, ball k-means and covering SimHash against brute force and SQL."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from usagelake.llm import clusters, frames, simhash, vector_codes
from usagelake.llm.queries import ORACLE_SQL, QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x20\x09-\x0d]+")
NAN, INF = float("nan"), float("inf")


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def vectors(n=400, length=64, seed=3):
    """Clustered and random vectors, many copies, ties on a coarse grid, and rows that take no part."""
    rng = np.random.default_rng(seed)
    heart = rng.normal(0, 1, (5, length))
    rows = [(i, (heart[i % 5] + rng.normal(0, 0.1 + 0.5 * (i % 3), length)).round(1 if i % 2 else 3).tolist(), i % 4 or None, 7, "x") for i in range(n)]
    rows += [(1000 + i, rows[17][1], 2, 7, "x") for i in range(n // 2)]  # a third of all are copies
    rows += [rows[3], rows[3], (None, rows[4][1], 1, 7, "x"), (None, rows[9][1], None, 7, "x"), (-5, [0.0] * length, 1, 7, "x"), (-6, [-0.001] * length, 1, 7, "x")]
    rows += [(5000, None, 1, 7, "x"), (5001, [NAN] * length, 1, 7, "x"), (5002, [1.0] * (length - 1) + [None], 1, 7, "x"), (5003, [INF] + [0.0] * (length - 1), 1, 7, "x"), (5004, [3.0e30] + [0.5] * (length - 1), 1, 7, "x")]
    return rows


SCHEMA = "vec_id long, embedding array<double>, label int, cluster int, code string"  # the last two clash with results


def kept(rows, scale, most):
    fine = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    return [(r[0], r[2], [max(-most, min(most, math.floor(scale * x))) if abs(scale * x) > most else math.floor(scale * x) for x in r[1]]) for r in fine]


def square(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def brute_codes(rows, length=64):
    most = math.floor(math.sqrt(2.0**61 / length))
    rows = [r for r in kept(rows, 256, most) if len(r[2]) == length]
    w = length // 16
    cut = [[r[2][p * w : (p + 1) * w] for p in range(16)] for r in rows]
    start = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][2]))[:64]
    books = [[cut[i][p] for i in start] for p in range(16)]

    def near(x, book):
        return min((square(x, e), n) for n, e in enumerate(book))

    for _ in range(2):
        for p in range(16):
            at = defaultdict(list)
            for c in cut:
                at[near(c[p], books[p])[1]].append(c[p])
            books[p] = [[sum(x) // len(at[e]) for x in zip(*at[e], strict=True)] if at[e] else old for e, old in enumerate(books[p])]
    digest = sha(",".join(str(x) for b in books for e in b for x in e))
    found = [[near(c[p], books[p]) for p in range(16)] for c in cut]
    total = defaultdict(int)
    for r, f in zip(rows, found, strict=True):
        total[r[1]] += sum(d for d, _ in f)
    return Counter((r[0], "".join(f"{n:02x}" for _, n in f), sum(d for d, _ in f), total[r[1]], digest) for r, f in zip(rows, found, strict=True))


def brute_clusters(rows):
    most = math.floor(math.sqrt(2.0**61 / 64))
    rows = [r for r in kept(rows, 64, most) if len(r[2]) == 64]
    start = sorted(rows, key=lambda r: (r[0] is None, sha(f"1:{r[0]}"), r[2]))[:16]
    cent = [r[2] for r in start]
    near = lambda v: min((square(v, c), i) for i, c in enumerate(cent))
    for _ in range(3):
        at = defaultdict(list)
        for r in rows:
            at[near(r[2])[1]].append(r[2])
        cent = [[sum(x) // len(at[i]) for x in zip(*at[i], strict=True)] if at[i] else c for i, c in enumerate(cent)]
    found = [near(r[2]) for r in rows]
    total = defaultdict(int)
    for d, i in found:
        total[i] += d
    shas = [sha(",".join(map(str, c))) for c in cent]
    return Counter((r[0], i, d, total[i], sum(total.values()), shas[i]) for r, (d, i) in zip(rows, found, strict=True))


CODES = ("vec_id", "code", "error", "label_error", "codebooks_sha256")
BALLS = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def got(df, columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


@pytest.mark.parametrize("n", [100, 20, 1])
def test_codes_and_clusters_against_brute_force(spark, folder, n):
    rows = vectors(n) if n > 1 else vectors(20)[:1]
    top = folder(f"vectors{n}", embeddings=(rows, SCHEMA))
    assert got(QUERIES["op11_vector_codes"](spark, top), CODES) == brute_codes(rows)
    assert got(QUERIES["op13_ball_kmeans"](spark, top), BALLS) == brute_clusters(rows)


def test_lengths_have_codebooks_of_their_own(spark, folder):
    rows = vectors(40) + vectors(30, 32, 5) + [(9000 + i, [0.5 * i] * 7, 1, 7, "x") for i in range(3)] + [(9100, [], 1, 7, "x")]
    top = folder("lengths", embeddings=(rows, SCHEMA))
    all_of = got(QUERIES["op11_vector_codes"](spark, top), ("vec_id", "code", "error", "codebooks_sha256"))
    want = Counter()
    for length in (64, 32):
        for (i, code, error, _, digest), k in brute_codes(rows, length).items():
            want[i, code, error, digest] += k
    want += Counter({(9000 + i, None, None, None): 1 for i in range(3)}) + Counter({(9100, "00" * 16, 0, sha("")): 1})
    assert all_of == want
    assert got(QUERIES["op13_ball_kmeans"](spark, top), BALLS) == brute_clusters(rows)


def test_annulus_search_is_exact_with_ties():
    rng = np.random.default_rng(8)
    for width, spread, k in [(4, 3, 64), (4, 300, 64), (1, 2, 7), (8, 2**27, 256)]:
        entries, x = rng.integers(-spread, spread + 1, (k, width)), rng.integers(-spread, spread + 1, (500, width))
        number, d = vector_codes.Annuli(entries).nearest(x)
        every = ((x[:, None, :] - entries[None]) ** 2).sum(2)
        assert (d == every.min(1)).all() and (number == every.argmin(1)).all()


def test_annulus_search_leaves_far_norms_alone():
    entries = np.array([[i * 1000, 0] for i in range(200)])
    book, seen = vector_codes.Annuli(entries), []
    inner = book.within
    book.within = lambda norm, distance: seen.append(inner(norm, distance)) or seen[-1]
    number, _ = book.nearest(np.array([[50_010, 3]]))
    assert number[0] == 50 and len(seen) == 1 and seen[0][1] - seen[0][0] <= 1


def test_balls_move_members_to_the_nearest_centroid():
    rng = np.random.default_rng(2)
    for spread in (3, 1000):
        old, x = rng.integers(-spread, spread, (16, 64)), rng.integers(-spread, spread, (3000, 64))
        new = old + rng.integers(-1, 2, (16, 64))
        new[7] = new[3]  # equal centroids
        cluster = ((x[:, None, :] - old[None]) ** 2).sum(2).argmin(1)
        radius = np.array([np.sqrt(((x[cluster == i] - new[i]) ** 2).sum(1).max(initial=0)) for i in range(16)])
        to, d = clusters.Balls(new, radius).move(x, cluster)
        every = ((x[:, None, :] - new[None]) ** 2).sum(2)
        assert (d == every.min(1)).all() and (to == every.argmin(1)).all()


def test_far_balls_are_no_neighbours():
    centroids = np.zeros((4, 64), np.int64)
    centroids[:, 0] = [0, 10, 1000, 1010]
    balls = clusters.Balls(centroids, np.full(4, 20.0))
    assert [sorted(n.tolist()) for n in balls.near] == [[1], [0], [3], [2]]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    con.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.01/embeddings.parquet'")
    rel = con.sql(ORACLE_SQL[name])
    df = QUERIES[name](spark, "/root/testdata/sf0.01")
    assert sorted(df.columns) == sorted(rel.columns)
    assert got(df, rel.columns) == Counter(rel.fetchall())


def test_codes_decode_to_the_error(spark):
    """The code of a vector names entries whose distances are its error: codebooks refit by hand."""
    rows = vectors(60)
    df = spark.createDataFrame(rows, SCHEMA)
    coded = vector_codes.compress(df, parts=8, entries=5, rounds=1, scale=10)
    assert {len(r["code"]) for r in coded.collect()} == {16} and coded.agg(F.max("code")).first()[0] < "05" * 8 + "z"


# SimHash


def fingerprint(text):
    ws = WORD.findall((text or "").translate(LOWER))
    shingles = [" ".join(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))] if ws else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(items, radius=3):
    """items: (id, fingerprint) -> the least id that each fingerprint reaches."""
    fps = sorted({f for _, f in items})
    root = {f: f for f in fps}

    def top(f):
        while root[f] != f:
            f = root[f]
        return f

    for a, b in combinations(fps, 2):
        if (a ^ b).bit_count() <= radius:
            root[top(a)] = top(b)
    least = {}
    for i, f in items:
        if i is not None:
            least[top(f)] = min(i, least.get(top(f), i))
    return {f: least.get(top(f)) for f in fps}


def test_simhash(spark, folder, docs_rows):
    rng = random.Random(4)
    base = " ".join(f"w{rng.randrange(500)}" for _ in range(900))
    rows = docs_rows + [(2000 + i, base.replace(f" w{rng.randrange(500)} ", f" z{i} "), "en", "a", 0, "x") for i in range(40)]
    top = folder("simhash", documents=(rows, DOCS))
    items = [(r[0], fingerprint(r[1])) for r in rows]
    comp = brute_components(items)
    want = Counter((i, f"{f:016x}", comp[f]) for i, f in items)
    assert got(QUERIES["op12_covering_simhash"](spark, top), ("doc_id", "fingerprint", "component_id")) == want
    assert len(set(comp.values())) < len(comp)  # some texts link
    # Spark's own hash is the same function
    word = "".join(rng.choice("aé🙂 ") for _ in range(77))
    assert spark.range(1).select(F.xxhash64(F.lit(word))).first()[0] % 2**64 == xxhash.xxh64_intdigest(word.encode(), 42)


def test_hash_of_every_length():
    rng = random.Random(1)
    raw = [bytes(rng.randrange(256) for _ in range(n)) for n in [*range(140), 1000, 3333]]
    end = np.cumsum([len(x) for x in raw])
    h = simhash.xxh64(np.frombuffer(b"".join(raw), np.uint8), end - [len(x) for x in raw], end)
    assert [int(x) for x in h] == [xxhash.xxh64_intdigest(x, 42) for x in raw]


def test_masks_cover_every_choice_of_positions():
    masks = simhash.covering_masks()
    assert len(masks) == 15 and all(any(not m & (1 << a | 1 << b | 1 << c) for m in masks) for a, b, c in combinations(range(64), 3))
    finer = simhash.finer_masks(masks[0])
    out = [i for i in range(64) if not masks[0] >> i & 1]
    assert all(any(not f & (1 << a | 1 << b | 1 << c) for f in finer) for a, b, c in combinations(out, 3))


@pytest.mark.parametrize("bucket", [8, 20, 2048])
def test_large_buckets_lose_no_link(spark, bucket):
    """Fingerprints crowded around a few points, so that buckets are covered again and again."""
    rng = random.Random(6)
    heart = [rng.getrandbits(64) for _ in range(3)]
    fps = {heart[i % 3] ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(7))) & (2**64 - 1) for i in range(500)}
    fps |= {rng.getrandbits(64) for _ in range(100)}
    items = [(i, f) for i, f in enumerate(sorted(fps))]
    signed = spark.createDataFrame([(simhash.signed(f),) for _, f in items], "fp long")
    links = simhash.near_links(signed, bucket=bucket).collect()
    assert all(((r["a"] ^ r["b"]) % 2**64).bit_count() <= 3 for r in links)
    root = {f: f for _, f in items}

    def top(f):
        while root[f] != f:
            f = root[f]
        return f

    for r in links:
        root[top(r["a"] % 2**64)] = top(r["b"] % 2**64)
    groups = defaultdict(set)
    for _, f in items:
        groups[top(f)].add(f)
    want = defaultdict(set)
    for f, c in brute_components(items).items():
        want[c].add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_small_buckets_are_refused(spark):
    with pytest.raises(ValueError):
        simhash.near_links(spark.createDataFrame([(1,)], "fp long"), bucket=7)


def test_long_text_and_many_equal_rows(spark, folder):
    rng = random.Random(9)
    long = " ".join(rng.choice(["alpha", "beta", "gamma\n", "delta"]) + str(rng.randrange(999)) for _ in range(60_000))
    rows = [(i, "same words here again", "hot") for i in range(3000)] + [(None, None, None)] * 50 + [(7000, long, "x"), (7001, long.replace("alpha7 ", "zz "), "x"), (7002, "", "x")]
    top = folder("long", documents=(rows, "doc_id long, text string, fp string"))  # fp clashes with an inner name
    found = got(QUERIES["op12_covering_simhash"](spark, top), ("doc_id", "fingerprint", "component_id"))
    comp = brute_components([(r[0], fingerprint(r[1])) for r in rows[2999:]] + [(0, fingerprint(rows[0][1]))])
    assert found == Counter((r[0], f"{(f := fingerprint(r[1]) if i >= 3000 else fingerprint(rows[0][1])):016x}", comp[f]) for i, r in enumerate(rows))


def test_spread_join_deals_hot_keys_apart(spark):
    left = spark.createDataFrame([(i % 7 if i % 2 else 0, i) for i in range(400)], "k long, x long")
    right = left.groupBy("k").agg(F.count("*").alias("n"), F.max("x").alias("top"))
    want = Counter(map(tuple, left.join(right, "k").select("k", "x", "n", "top").collect()))
    for rows, hot in ((100, 5), (2, 50), (2, 5), (2, 1000)):
        assert Counter(map(tuple, frames.spread_join(left, right, ["k"], rows, hot).select("k", "x", "n", "top").collect())) == want
