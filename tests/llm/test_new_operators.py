"""Ball hashing, quantile summaries and the Merkle manifest against brute force, with their edge cases."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict
from hashlib import sha256

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from vocalis.llm import merkle, quantiles, ranks, simhash

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def groups(nodes, linked):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def family(rng, size, spread):
    """Fingerprints around a few centres, many of them within a few bits."""
    out = set()
    while len(out) < size:
        centre = rng.getrandbits(64) if rng.random() < 0.2 or not out else rng.choice(sorted(out)[:50])
        for bit in rng.sample(range(64), rng.randint(0, spread)):
            centre ^= 1 << bit
        out.add(centre)
    return sorted(out)


@pytest.mark.parametrize("radius", [1, 2, 3, 4])
@pytest.mark.parametrize("limit", [1 << 22, 3000])
def test_collisions_connect_what_brute_force_links(radius, limit):
    fps = family(random.Random(radius), 120, 5)
    found = simhash.collisions(np.array(fps, dtype=np.uint64), np.zeros(len(fps), dtype=np.uint64), 64, radius, limit)
    pairs = list(zip(*[x.tolist() for x in found], strict=True))
    assert all((a ^ b).bit_count() <= radius for a, b in pairs)
    near = [(a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= radius]
    assert groups(fps, pairs) == groups(fps, near)
    assert len(pairs) < len(fps) ** 2 / 2


@pytest.mark.parametrize(("bucket", "slot"), [(1 << 19, 1 << 22), (1 << 12, 1 << 13)])
def test_links_over_buckets(spark, monkeypatch, bucket, slot):
    """Few and many leading bits, with and without crowded prefixes."""
    monkeypatch.setattr(simhash, "BUCKET_VALUES", bucket)
    monkeypatch.setattr(simhash, "SLOT_VALUES", slot)
    fps = family(random.Random(9), 300, 4)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    rows = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp bigint"), 4).collect()
    unsigned = lambda x: x % (1 << 64)
    near = [(a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 4]
    assert groups(fps, [(unsigned(r.a), unsigned(r.b)) for r in rows]) == groups(fps, near)


def test_fingerprint_is_that_of_the_definition():
    rng = random.Random(4)
    for n in (0, 1, 3, 4, 5, 40, 700):
        text = "\t".join(rng.choice(["Été", "THE", "cat", "a\x0bb", "Ünder"]) for _ in range(n)) + "\n "
        assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)
    assert simhash.fingerprint(b" \n") == 0


def test_fingerprint_in_blocks(monkeypatch):
    text = " ".join(f"w{i % 37}" for i in range(1000))
    whole = simhash.fingerprint(text.encode())
    monkeypatch.setattr(simhash, "BLOCK", 7)
    assert simhash.fingerprint(text.encode()) == whole == plain_fingerprint(text)


def test_components_against_brute_force(spark):
    rng = random.Random(1)
    words = [f"word{i}" for i in range(200)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 400))) for _ in range(40)]
    for t in list(texts[:25]):
        w = t.split()
        for _ in range(3):
            w = list(w)
            w[rng.randrange(len(w))] = rng.choice(words)
            texts.append(" ".join(w))
    texts += [texts[0], texts[0].upper(), None, "", " \n", "one", "x" * 100]
    rows = [(1000 - 7 * i, t, "en", "s", 1) for i, t in enumerate(texts)]
    rows += [rows[3], (None, texts[1], None, None, None), (None, "nobody else says this", None, None, None), (5, " ".join(words * 500), None, None, None)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("fp", F.lit("clash")).withColumn("root", F.lit(1))
    got = simhash.components(docs).collect()
    fps = [plain_fingerprint(r[1]) for r in rows]
    at = groups(sorted(set(fps)), [(a, b) for a in set(fps) for b in set(fps) if a < b and (a ^ b).bit_count() <= 4])
    least = {}
    for r, f in zip(rows, fps, strict=True):
        if r[0] is not None:
            least[at[f]] = min(least.get(at[f], r[0]), r[0])
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, got)) == sorted(key((r[0], f"{f:016x}", least.get(at[f]))) for r, f in zip(rows, fps, strict=True))
    assert len(set(at.values())) < len(set(fps))  # something was linked
    assert simhash.components(docs.limit(0)).count() == 0


def test_ranks_of_groups_that_span_ranges(spark):
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.6 else rng.choice("abc"), rng.choice([None, *range(40)]), rng.randint(1, 5)) for _ in range(3000)]
    got = ranks.placed(spark.createDataFrame(rows, "g string, x int, w bigint"), ["g"], ["x"], "w", ranges=9).collect()
    by = defaultdict(list)
    for r in got:
        by[r.g].append(r)
    assert len({r.range for r in by["hot"]}) > 2
    for own in by.values():
        own.sort(key=lambda r: r.position)
        assert [r.position for r in own] == list(range(len(own))) and all(r.rows == len(own) for r in own)
        assert [-1 if r.x is None else r.x for r in own] == sorted(-1 if r.x is None else r.x for r in own)
        running = 0
        for r in own:
            assert r.before == running
            running += r.w
        assert all(r.total == running for r in own)


def _rows(spark, rng, n, kinds):
    rows = [(rng.choice(kinds), rng.randrange(4), int(rng.gauss(0, 3000)) if rng.random() < 0.7 else 7, 1) for _ in range(n)]
    return rows, spark.createDataFrame(rows, "grp string, batch int, x bigint, w bigint")


def test_audit_against_sorting(spark):
    rng = random.Random(3)
    rows, df = _rows(spark, rng, 6000, ["a", "a", "a", "b", "c"])
    rows += [("few", 0, k, 1) for k in range(19)] + [("edge", 0, k % 2, 1) for k in range(20)] + [("one", 1, 5, 1)] * 50
    df = spark.createDataFrame(rows, df.schema)
    got = {(r.grp, r.batch, r.i): r for r in quantiles.audit(df, ["grp"]).collect()}
    groups_ = defaultdict(list)
    for g, b, x, _ in rows:
        groups_[g, b].append(x)
        groups_[g, -1].append(x)
    assert {k[:2] for k in got} == {k for k, xs in groups_.items() if len(xs) >= 20}
    for (g, b), xs in groups_.items():
        xs.sort()
        n, last = len(xs), None
        for i in (1, 2, 3) if n >= 20 else ():
            r = got[g, b, i]
            target = -(-i * n // 4)
            assert (r.n, r.target, r.exact_x) == (n, target, xs[target - 1])
            assert (r.n_below, r.n_upto) == (sum(x < r.answer for x in xs), sum(x <= r.answer for x in xs))
            assert r.rank_error == max(0, r.n_below + 1 - target, target - r.n_upto) and r.within and 1000 * r.rank_error <= 20 * n
            assert min(10, len(set(xs))) <= r.points <= min(n, 1000)
            assert xs[0] <= r.answer <= xs[-1] and (last is None or last <= r.answer)
            last = r.answer
    assert quantiles.audit(df.limit(0), ["grp"]).count() == 0


def _bounds_hold(summary, xs):
    for r in summary:
        assert r.below_lo <= sum(x < r.x for x in xs) <= r.below_hi and r.upto_lo <= sum(x <= r.x for x in xs) <= r.upto_hi
        assert r.n == len(xs)


@pytest.mark.parametrize("thin", [None, 25])
def test_merges_of_merges_keep_their_bounds(spark, thin):
    """Few points a batch, merged in two levels: every interval holds the exact count, and the error stays within what they say."""
    rng = random.Random(5)
    rows = [(rng.randrange(2), rng.randrange(3), int(rng.expovariate(0.001)), 1) for _ in range(4000)]
    df = spark.createDataFrame(rows, "half int, batch int, x bigint, w bigint")
    keys = ["half", "batch"]
    parts = quantiles.summarise(quantiles.ranked(quantiles.counted(df, keys, "w"), keys), keys, points=40, least=5)
    halves = quantiles.merge(parts, ["half"], "batch", thin).withColumn("all", F.lit(1))
    whole = quantiles.merge(halves, ["all"], "half", thin)
    for half in (0, 1):
        _bounds_hold(halves.where(F.col("half") == half).collect(), [x for h, _, x, _ in rows if h == half])
    points = whole.collect()
    _bounds_hold(points, [x for _, _, x, _ in rows])
    assert {min(x for _, _, x, _ in rows), max(x for _, _, x, _ in rows)} <= {r.x for r in points}
    if thin:
        assert len(points) <= thin + 2
    for r in quantiles.estimate(whole, ["all"], 10).collect():
        xs = sorted(x for _, _, x, _ in rows)
        error = max(0, sum(x < r.answer for x in xs) + 1 - r.target, r.target - sum(x <= r.answer for x in xs))
        assert error <= len(xs) * (0.12 if thin else 0.04)


def test_a_heavy_value_does_not_crowd_out_the_others(spark):
    rows = [("g", 0, 5, 100_000)] + [("g", 0, x, 1) for x in range(6, 30)]
    df = spark.createDataFrame(rows, "grp string, batch int, x bigint, w bigint")
    kept = quantiles.summarise(quantiles.ranked(df.drop("batch"), ["grp"]), ["grp"]).collect()
    assert 10 <= len(kept) and {5, 29} <= {r.x for r in kept}


def test_shop_streams(spark):
    clicks = [(1, 7, 1.005), (1, 7, 1.005), (2, None, 3.0), (3, 7, None), (4, 7, float("nan")), (5, 7, float("inf")), (6, 8, -0.004), (None, 9, 2.0)]
    lines = [(10, 1), (10, 1), (10, 2), (None, 1), (99, 1), (11, 1), (12, 1), (10, None)]
    items = [(10, "B", 2.5), (11, None, 1.0), (12, "B", None), (13, "B", 1.0)]
    c = spark.createDataFrame(clicks, "click_id bigint, client_id bigint, value double").withColumn("extra", F.lit(1))
    s = spark.createDataFrame(lines, "item_id bigint, vendor_id bigint").withColumn("brand", F.lit("clash"))
    i = spark.createDataFrame(items, "item_id bigint, brand string, price double")
    batch = lambda v: zlib.crc32(v.encode()) % 4
    want = [("value", "7", batch("1"), 101 + 1000 * batch("1"), 1), ("value", "8", batch("6"), 1000 * batch("6"), 1), ("value", "9", 0, 200, 1)]
    counts = defaultdict(int)
    for item, vendor in lines:
        if item == 10:
            counts[batch("" if vendor is None else str(vendor))] += 1
    want += [("price", "B", b, 250 + 1000 * b, n) for b, n in counts.items()]
    got = [tuple(r) for r in quantiles.shop(c, s, i).collect()]
    assert sorted(got) == sorted(want) or sorted(got) == sorted([("value", "7", batch("1"), 100 + 1000 * batch("1"), 1), *want[1:]])  # 100 * 1.005 is just below 100.5
    assert quantiles.shop(c.limit(0), s.limit(0), i.limit(0)).count() == 0


def _h(parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows):
    """Levels as lists, siblings by slicing."""
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: _h([enc(r[0]), enc(r[3]), enc(r[2]), enc(r[4]), enc(text)])

    def levels(digests):
        out = [digests]
        while len(out[-1]) > 1:
            out.append([_h(out[-1][k : k + 3]) for k in range(0, len(out[-1]), 3)])
        return out

    by = defaultdict(list)
    for r in rows:
        by[r[3]].append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = [levels([d for _, _, d, _ in sorted(by[s], key=lambda x: x[:3])]) for s in order]
    over = levels([t[-1][0] for t in trees])

    def climb(tree, index, cur):
        siblings = []
        for level in tree[:-1]:
            first = index - index % 3
            run = level[first : first + 3]
            siblings += run[: index - first] + run[index - first + 1 :]
            run = [*run[: index - first], cur, *run[index - first + 1 :]]
            cur, index = _h(run), index // 3
        return siblings, cur

    out = []
    for place, s in enumerate(order):
        for index, (_, _, digest, r) in enumerate(sorted(by[s], key=lambda x: x[:3])):
            even = zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 2 == 0
            cur = leaf(r, r[1].replace("\n", "")) if even and r[1] is not None else digest
            low, cur = climb(trees[place], index, cur)
            high, cur = climb(over, place, cur)
            out.append((r[0], digest, trees[place][-1][0], over[-1][0], _h(low + high), cur, cur == over[-1][0]))
    return out


@pytest.mark.parametrize("span", [1, 2, 7])
def test_manifest_against_brute_force(spark, span):
    rng = random.Random(span)
    sources = ["hot"] * 6 + ["z", "é", "Z", None, ""] + [f"s{k}" for k in range(30)]
    rows = [(k, rng.choice([None, "", "a\nb", "plain", "\n", "é\n\n" * 3]), rng.choice(["en", None]), rng.choice(sources), rng.choice([None, 3, -4])) for k in range(400)]
    rows += [rows[5], rows[5], (7, "other", "fr", rows[7][3], 1), (None, "x\ny", None, None, None), (None, None, None, "lone", None), (-3, "long " * 100_000, "en", "hot", 5)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("tree", F.lit(1)).withColumn("level", F.lit("clash"))
    got = [tuple(r) for r in merkle.manifest(docs, span=span).collect()]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=key) == sorted(plain_manifest(rows), key=key)
    assert {r[6] for r in got} == {True, False}


def test_manifest_of_little(spark):
    empty = spark.createDataFrame([], DOCS)
    assert merkle.manifest(empty).count() == 0
    rows = [(4, "a\nb", "en", "s", 3)]
    got = merkle.manifest(spark.createDataFrame(rows, DOCS)).collect()
    assert [tuple(r) for r in got] == plain_manifest(rows)
    assert got[0].root == got[0].subroot == got[0].leaf


def test_combine_takes_nodes_in_any_order():
    """Tasks hold any part of a tree; what they leave meets later."""
    rng = random.Random(8)
    for n in (1, 2, 3, 4, 9, 10, 28, 100):
        leaves = [("t", n, 0, i, sha256(str(i).encode()).digest()) for i in range(n)]
        whole = [x for x in merkle.combine(iter(leaves)) if x[6] == merkle.ROOT]
        rng.shuffle(leaves)
        left = []
        for k in range(4):
            left += [x for x in merkle.combine(iter(leaves[k::4])) if x[6] != merkle.LINK]
        out = list(merkle.combine(x[:5] for x in left))
        assert [x[4] for x in out if x[6] == merkle.ROOT] == [x[4] for x in whole]
        assert not [x for x in out if x[6] == merkle.FRONTIER]


def test_oracles_on_the_edge_cases(spark, tmp_path):
    """The SQL of the two operators agrees on null keys, ties and empty texts."""
    rows = [(k // 2 if k % 9 else None, [None, "", "a\nb", "c"][k % 4], None, [None, "", "s", "t"][k % 3], k % 5) for k in range(90)]
    spark.createDataFrame(rows, DOCS).coalesce(1).write.parquet(str(tmp_path / "documents"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    cur = con.execute(merkle.oracle_sql())
    names = [d[0] for d in cur.description]
    want = sorted(map(str, cur.fetchall()))
    got = merkle.manifest(spark.read.parquet(str(tmp_path / "documents"))).select(*names).collect()
    assert sorted(str(tuple(r)) for r in got) == want


@pytest.mark.parametrize("name", ["op12_quantile_summaries", "op13_merkle_manifest"])
def test_queries_equal_their_sql(spark, name):
    """The whole smallest tables, row by row."""
    from vocalis.llm import queries

    con = duckdb.connect()
    for t in ("documents", "clicks", "sale_lines", "items"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    cur = con.execute(queries.oracles()[name])
    names = [d[0] for d in cur.description]
    df = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert sorted(df.columns) == sorted(names)
    assert sorted(str(tuple(r)) for r in df.select(*names).collect()) == sorted(map(str, cur.fetchall()))
