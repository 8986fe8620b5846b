"""N-gram Jaccard join with signature trees.

1. A document is the set of its word n-grams; equal sets are one node, which stands at two levels: its own size class's and the next.
2. Routing without loss. Two sets within the threshold differ in at most H items, where H follows from their size classes. The
   items are dealt by hash to more than H segments; at least one segment of such sets is equal, at one level. Sets that share no
   segment need no comparison.
3. First look. Each node goes to one star, that of the least node it shares a segment with, in blocks of STAR sets; the star's
   centre goes along to each block. That links nearly all near copies, in work that grows with their number.
4. Second look, at what that leaves: shared segments between sets of different components of links. They connect components of
   links, within a level, to groups, whose sets are compared in blocks, but never those of a group's largest component among
   themselves: they are linked already. So any number of near copies costs nothing more.
5. Both looks use signature trees: a node holds the OR of its sets' token bitmaps and its size range. A dual traversal from
   the root against itself drops a pair of nodes if sizes are too far apart, if the most overlap that the bitmaps allow is too
   little, or if all of its sets are linked already; pairs of sets in leaves are counted exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocalis.llm.components import connected
from vocalis.llm.frames import narrow, saved, shuffle_partitions, unused
from vocalis.llm.kernels import LOWER, NULL_ID, U64, Chunk, chunks, mix, prefix_hash, range_hash, word_hashes
from vocalis.llm.shards import FLUSH_BYTES, pack, unpack

#: Sets of a block of a star, sets of a block of a group, and items in either.
STAR, BLOCK, BLOCK_ITEMS = 100, 400, 400_000
#: Items a bucket of segments should stand for, and pairs of tree nodes that are looked at together.
BUCKET_ITEMS, PAIRS = 2_000_000, 1 << 12
#: Items in a bin of the frequency table with four times the mean are hot.
HOT_BITS = 22
HOT_SHARE = 4 / (1 << HOT_BITS)
LEAF, FANOUT, MOST_BITS = 8, 4, 1 << 16
#: Places among which the sets of a group are dealt when they meet its numbers.
SALTS = 16


class Sets:
    """The distinct n-gram hashes of each document of a chunk, sorted."""

    def __init__(self, chunk: Chunk, n: int):
        starts, ends, doc = chunk.words()
        h = word_hashes(LOWER[chunk.buf], starts, ends)
        sums = prefix_hash(h)
        first = np.searchsorted(doc, np.arange(len(chunk.ids)))
        words = np.diff(np.append(first, len(doc)))
        at = np.arange(max(0, len(doc) - n + 1))
        at = at[doc[at] == doc[at + n - 1]]
        few = np.flatnonzero((words > 0) & (words < n))
        items = np.concatenate((range_hash(sums, at, at + n), range_hash(sums, first[few], first[few] + words[few])))
        owner = np.concatenate((doc[at], few))
        order = np.lexsort((items, owner))
        items, owner = items[order], owner[order]
        lead = np.ones(len(items), dtype=bool)
        lead[1:] = (items[1:] != items[:-1]) | (owner[1:] != owner[:-1])
        self.items, self.owner = items[lead], owner[lead]
        self.size = np.bincount(self.owner, minlength=len(chunk.ids))
        self.first = np.cumsum(self.size) - self.size
        one, two = (np.concatenate(([U64(0)], np.cumsum(mix(self.items * U64(c))))) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))
        end = self.first + self.size
        self.name = [mix(s[end] - s[self.first] + self.size.astype(U64)).view(np.int64) for s in (one, two)]


def size_classes(most: int, percent: int) -> list[int]:
    """Bounds such that sets within the threshold are of one class or of neighbouring ones."""
    bounds = [1]
    while bounds[-1] <= most:
        bounds.append(bounds[-1] * 100 // percent + 1)
    bounds.append(bounds[-1] * 100 // percent + 1)
    return bounds


def _level_keys(items: np.ndarray, owner: np.ndarray, level: np.ndarray, parts: np.ndarray, differ: np.ndarray, family: int, empty: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segment keys of one level, their sets, and which sets have so many empty segments that those alone could be the equal ones.

    items are sorted within their owner, so each segment is a range. Empty segments have no key, unless ``empty`` asks for those
    of the sets that need them.
    """
    sums = np.concatenate(([U64(0)], np.cumsum(mix(items.copy()))))
    base = np.cumsum(parts) - parts
    first = np.searchsorted(owner, np.arange(len(parts)))
    use = parts[owner] > 0
    segment = ((items[use] >> U64(32)) * parts[owner[use]].astype(U64)) >> U64(32)
    per = np.bincount(base[owner[use]] + segment.astype(np.int64), minlength=int(parts.sum()))
    who = np.repeat(np.arange(len(parts)), parts)
    within = np.cumsum(per) - per
    start = first[who] + within - within[base[who]]
    total = sums[start + per] - sums[start]
    number = (np.arange(len(who)) - base[who]).astype(U64)
    key = mix(total + level[who].astype(U64) * U64(0x9FB21C651E98DF25) + number * U64(0xA24BAED4963EE407) + U64(family * 0x8CB92BA72F3D8DD7 % (1 << 64)))
    needy = np.bincount(who, weights=per == 0, minlength=len(parts)) >= parts - differ
    needy &= parts > 0
    keep = (per > 0) | (needy[who] if empty else False)
    return key[keep], who[keep], needy


def segment_keys(sets: Sets, percent: int, hot: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Segment keys, the set of each key, and the level at which each set takes part: its own class's level, and the next one.

    Sets that differ in at most H of all items differ in at most H of those that aren't ``hot``; so the segments hold only the
    others, and passages that very many documents share bring nobody together. There are some more segments than H + 1, and the
    equal ones of a pair are then more than a set's empty ones. Sets for which that doesn't hold meet by all their items, and as a
    last resort by empty segments too.
    """
    bounds = np.asarray(size_classes(int(sets.size.max(initial=0)), percent))
    own = _level(sets.size, percent)
    plain = ~hot[(sets.items >> U64(65 - len(hot).bit_length())).astype(np.int64)]
    for up in (0, 1):
        level = own + up  # its pairs: a class below against this level's class, or two of the class below
        below, here = bounds[np.maximum(level, 0)] - 1, bounds[np.minimum(level + 1, len(bounds) - 1)] - 1
        differ = (below + here) * (100 - percent) // (100 + percent)
        # where nothing may differ, equal sets are one node already
        parts = np.where((sets.size > 0) & (differ > 0), differ + 2 + (differ + 15) // 16, 0)
        key, who, needy = _level_keys(sets.items[plain], sets.owner[plain], level, parts, differ, 0, False)
        yield key, who, level
        if needy.any():
            key, who, _ = _level_keys(sets.items, sets.owner, level, np.where(needy, parts, 0), differ, 1, True)
            yield key, who, level


def _stars(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each distinct key with its least node, and the edges from that node to the key's others."""
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    lead = np.ones(len(key), dtype=bool)
    lead[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(lead)
    least = node[at][np.cumsum(lead) - 1]
    other = least != node
    edge = np.unique(np.stack((least[other], node[other])), axis=1)
    return key[at], node[at], edge[0], edge[1]


def _at_level(name: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The number of a set's node at a level."""
    return mix(name.view(U64) + (level.astype(U64) + U64(1)) * U64(0xD1B54A32D192ED03)).view(np.int64)


def _level(size: np.ndarray, percent: int) -> np.ndarray:
    return np.searchsorted(np.asarray(size_classes(int(size.max(initial=0)), percent)), size, side="right") - 1


SURVEY = "doc_id bigint, n_shingles bigint, name bigint, name2 bigint, low bigint, high bigint, level bigint, bin bigint, n bigint"


def survey(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """One row per document: doc_id (null: the smallest), its set's size and name (two 64-bit numbers), its nodes at two levels;
    and rows (bin, n) with the counts of item hashes that are frequent in some task (bin -1: of all)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << HOT_BITS, dtype=np.int64)
        names = SURVEY.replace(" bigint", "").split(", ")

        def rows(columns: list[np.ndarray], rest: int, last: bool) -> pa.RecordBatch:
            size = len(columns[0])
            full = [pa.array(c, pa.int64()) for c in columns]
            empty = [pa.nulls(size, pa.int64())] * rest
            return pa.RecordBatch.from_arrays([*empty, *full] if last else [*full, *empty], names)

        for _, chunk in chunks(batches):
            s = Sets(chunk, n)
            bins = (s.items >> U64(64 - HOT_BITS)).astype(np.int64)
            if len(bins) * 8 < len(table):
                np.add.at(table, bins, 1)
            else:
                table += np.bincount(bins, minlength=len(table))
            level = _level(s.size, percent)
            yield rows([chunk.ids, s.size.astype(np.int64), *s.name, _at_level(s.name[0], level), _at_level(s.name[0], level + 1), level.astype(np.int64)], 2, False)
        bins = np.flatnonzero(table >= max(16, HOT_SHARE * table.sum()))
        yield rows([np.concatenate(([-1], bins)), np.concatenate(([table.sum()], table[bins]))], 7, True)

    return narrow(docs, "doc_id", "text").mapInArrow(run, SURVEY)


def _hot(surveyed: DataFrame) -> tuple[np.ndarray, int]:
    """Which bins of item hashes have four times the mean, as flags (a table of a fixed size), and the number of all items."""
    found = surveyed.where("bin is not null").groupBy("bin").agg(F.sum("n").alias("n")).toArrow()
    bins, n = (np.asarray(found.column(c), dtype=np.int64) for c in ("bin", "n"))
    hot = np.zeros(1 << HOT_BITS, dtype=bool)
    total = int(n[bins == -1].sum())
    hot[bins[(bins >= 0) & (n >= HOT_SHARE * total / 2)]] = True
    return hot, total


def candidates(docs: DataFrame, n: int, percent: int, hot: np.ndarray, items: int) -> DataFrame:
    """Edges (a, b) between nodes (sets at levels) that share a segment: from the least node of each segment to the others."""
    buckets = max(4 * shuffle_partitions(docs.sparkSession), items // BUCKET_ITEMS)
    shared = docs.sparkSession.sparkContext.broadcast(hot)  # 2**HOT_BITS flags

    def send(keys: list[np.ndarray], names: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, name, a, b = _stars(np.concatenate(keys), np.concatenate(names))
        bucket = (key % U64(buckets)).astype(np.int64)
        aside = np.mod(a, buckets)
        order, order2 = np.argsort(bucket, kind="stable"), np.argsort(aside, kind="stable")
        present = np.unique(np.concatenate((bucket, aside)))
        low, low2 = (np.searchsorted(x[o], np.append(present, buckets)) for x, o in ((bucket, order), (aside, order2)))
        out = []
        for i, k in enumerate(present.tolist()):
            own, edge = order[low[i] : low[i + 1]], order2[low2[i] : low2[i + 1]]
            table, index = np.unique(name[own], return_inverse=True)
            out.append((k, pack([key[own].view(np.int64), index, table, a[edge], b[edge]])))
        for i in range(0, len(out), 512):
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out[i : i + 512]], pa.int64()), pa.array([o[1] for o in out[i : i + 512]], pa.binary())], ["bucket", "blob"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, names, size = [], [], 0
        for _, chunk in chunks(batches):
            s = Sets(chunk, n)
            for key, owner, level in segment_keys(s, percent, shared.value):
                keys.append(key)
                names.append(_at_level(s.name[0], level)[owner])
            size += len(chunk.buf)
            if size >= FLUSH_BYTES:
                yield from send(keys, names)
                keys, names, size = [], [], 0
        if keys:
            yield from send(keys, names)

    def meet(table: pa.Table) -> pa.Table:
        got = [unpack(b)[0] for b in table.column("blob").to_pylist()]
        _, _, a, b = _stars(np.concatenate([g[0] for g in got]), np.concatenate([g[2][g[1]] for g in got]))
        a, b = np.concatenate([a, *(g[3] for g in got)]), np.concatenate([b, *(g[4] for g in got)])
        edge = np.unique(np.stack((a, b)), axis=1)
        return pa.table({"a": pa.array(edge[0]), "b": pa.array(edge[1])})

    return narrow(docs, "doc_id", "text").mapInArrow(cut, "bucket bigint, blob binary").groupBy("bucket").applyInArrow(meet, "a bigint, b bigint")


class Tree:
    """A signature tree over sets: level 0 holds leaves of up to LEAF sets, each level above OR-combines FANOUT nodes."""

    def __init__(self, sets: list[np.ndarray]):
        order = sorted(range(len(sets)), key=lambda i: (sets[i][0], len(sets[i])))  # near copies share their least item
        self.order, self.sets = np.asarray(order), [sets[i] for i in order]
        self.size = np.asarray([len(s) for s in self.sets])
        vocabulary, code = np.unique(np.concatenate(self.sets), return_inverse=True)
        self.bits = 1 << max(6, (min(len(vocabulary), MOST_BITS) - 1).bit_length())
        self.exact = len(vocabulary) <= self.bits
        ends = np.cumsum(self.size)
        maps, distinct = [], []
        for low in range(0, len(self.sets), 256):
            own = self.size[low : low + 256]
            plane = np.zeros((len(own), self.bits), dtype=bool)
            plane[np.repeat(np.arange(len(own)), own), code[ends[low] - own[0] : ends[low + len(own) - 1]] % self.bits] = True
            maps.append(np.packbits(plane, axis=1).view(U64))
            distinct.append(plane.sum(axis=1))
        self.maps = np.concatenate(maps)
        self.excess = excess = self.size - np.concatenate(distinct)  # items that share a bit with another of their set
        starts = np.arange(0, len(self.sets), LEAF)
        self.levels = [(np.bitwise_or.reduceat(self.maps, starts), np.minimum.reduceat(self.size, starts), np.maximum.reduceat(self.size, starts), np.maximum.reduceat(excess, starts))]
        while len(self.levels[-1][0]) > 1:
            maps, low, high, more = self.levels[-1]
            starts = np.arange(0, len(maps), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(maps, starts), np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts), np.maximum.reduceat(more, starts)))
        self.root = np.arange(len(self.sets))  # of each set's links

    def _one_root(self, level: int) -> np.ndarray:
        """Of each node of a level, the root that all of its sets have, or -1."""
        starts = np.arange(0, len(self.sets), LEAF * FANOUT**level)
        low = np.minimum.reduceat(self.root, starts)
        return np.where(low == np.maximum.reduceat(self.root, starts), low, -1)

    def _possible(self, level: int, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
        """Which pairs of a level's nodes can hold a link between sets of different roots."""
        maps, low, high, more = self.levels[level]
        one = self._one_root(level)
        keep = (high[i] * 100 >= percent * low[j]) & (high[j] * 100 >= percent * low[i]) & ~((one[i] == one[j]) & (one[i] >= 0))
        at = np.flatnonzero(keep)
        for k in range(0, len(at), PAIRS):
            p = at[k : k + PAIRS]
            a, b = i[p], j[p]
            most = np.minimum(np.bitwise_count(maps[a] & maps[b]).sum(axis=1, dtype=np.int64) + np.minimum(more[a], more[b]), np.minimum(high[a], high[b]))
            keep[p] = most * (100 + percent) >= percent * (low[a] + low[b])
        return keep

    def _unite(self, x: np.ndarray, y: np.ndarray) -> None:
        for a, b in zip(x.tolist(), y.tolist(), strict=True):
            one, two = self.root[a], self.root[b]
            if one != two:
                self.root[self.root == max(one, two)] = min(one, two)

    def _pairs(self, x: np.ndarray, y: np.ndarray, percent: int) -> None:
        """Links the pairs of sets that are within the threshold, but for pairs that are linked already."""
        for k in range(0, len(x), PAIRS):
            a, b = x[k : k + PAIRS], y[k : k + PAIRS]
            use = (self.root[a] != self.root[b]) & (self.size[a] * 100 >= percent * self.size[b]) & (self.size[b] * 100 >= percent * self.size[a])
            a, b = a[use], b[use]
            shared = np.bitwise_count(self.maps[a] & self.maps[b]).sum(axis=1, dtype=np.int64)
            both = percent * (self.size[a] + self.size[b])
            if not self.exact:
                most = np.minimum(shared + np.minimum(self.excess[a], self.excess[b]), np.minimum(self.size[a], self.size[b]))
                for q in np.flatnonzero((100 + percent) * most >= both).tolist():
                    if self.root[a[q]] != self.root[b[q]] and (100 + percent) * len(np.intersect1d(self.sets[a[q]], self.sets[b[q]], assume_unique=True)) >= both[q]:
                        self._unite(a[q : q + 1], b[q : q + 1])
                continue
            good = (100 + percent) * shared >= both
            self._unite(a[good], b[good])

    def link(self, percent: int, linked: np.ndarray | None = None) -> np.ndarray:
        """The component of each set, in the order given, named by one of its sets; ``linked``: what is linked before, as labels."""
        if linked is not None:
            _, first, label = np.unique(linked[self.order], return_index=True, return_inverse=True)
            self.root = first[label]
        i = j = np.zeros(1, dtype=np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            keep = self._possible(level, i, j, percent)
            i, j = i[keep], j[keep]
            if level:  # each pair of nodes becomes the pairs of their children
                n = len(self.levels[level - 1][0])
                x = (i[:, None] * FANOUT + np.repeat(np.arange(FANOUT), FANOUT)).ravel()
                y = (j[:, None] * FANOUT + np.tile(np.arange(FANOUT), FANOUT)).ravel()
                there = (x <= y) & (y < n)
                i, j = x[there], y[there]
        order = np.argsort(j - i, kind="stable")  # a leaf against itself comes first: links found there prune the rest
        i, j = i[order], j[order]
        step = max(1, PAIRS // LEAF**2)
        for k in range(0, len(i), step):
            one = self._one_root(0)
            a, b = i[k : k + step], j[k : k + step]
            use = ~((one[a] == one[b]) & (one[a] >= 0))
            x = (a[use][:, None] * LEAF + np.repeat(np.arange(LEAF), LEAF)).ravel()
            y = (b[use][:, None] * LEAF + np.tile(np.arange(LEAF), LEAF)).ravel()
            there = (x < y) & (y < len(self.sets))
            self._pairs(x[there], y[there], percent)
        out = np.empty(len(self.sets), dtype=np.int64)
        out[self.order] = self.order[self.root]
        return out


def _compared(placed: DataFrame, docs: DataFrame, keys: tuple[str, ...], n: int, percent: int) -> DataFrame:
    """Links (a, b) of representatives, by a signature tree for each group of ``keys``. placed: representative, name, name2, linked."""
    texts = narrow(docs, "doc_id", "text").withColumn("doc_id", F.coalesce("doc_id", F.lit(NULL_ID)))

    def trees(table: pa.Table) -> pa.Table:
        sets, who, linked, seen, row = [], [], [], set(), 0
        columns = [table.column(c).to_pylist() for c in ("representative", "name", "name2", "linked")]
        for batch in table.select(["representative", "text"]).rename_columns(["doc_id", "text"]).to_batches():
            for _, chunk in chunks([batch]):
                s = Sets(chunk, n)
                for k in range(len(chunk.ids)):
                    mine = (int(s.name[0][k]), int(s.name[1][k]))
                    if mine == (columns[1][row], columns[2][row]) and mine not in seen:  # rows of one id can have other texts
                        seen.add(mine)
                        sets.append(s.items[s.first[k] : s.first[k] + s.size[k]])
                        who.append(columns[0][row])
                        linked.append(columns[3][row])
                    row += 1
        if len(sets) < 2:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        who = np.asarray(who, dtype=np.int64)
        root = Tree(sets).link(percent, np.asarray(linked, dtype=np.int64))
        found = root != np.arange(len(who))
        return pa.table({"a": pa.array(who[found]), "b": pa.array(who[root[found]])})

    joined = placed.join(texts, placed.representative == texts.doc_id).drop("doc_id")
    return joined.groupBy(*keys).applyInArrow(trees, "a bigint, b bigint")


def _blocks(sets: str, items: str, most: int):
    return F.greatest(F.ceil(F.expr(sets) / F.lit(most)), F.ceil(F.expr(items) / F.lit(BLOCK_ITEMS))).cast("int")


def _stars_of(standing: DataFrame, edges: DataFrame) -> DataFrame:
    """First look: (star, block, representative, name, name2, linked). Each set goes to its least star, in some block; a centre goes to all."""
    leader = edges.groupBy("b").agg(F.min("a").alias("a"))
    own = standing.join(leader, standing.node == leader.b).groupBy("representative", "name", "name2", "items").agg(F.min("a").alias("star"))
    sized = own.groupBy("star").agg(_blocks("count(*)", "sum(items)", STAR).alias("blocks"))
    members = own.join(sized, "star").withColumn("block", F.pmod("name2", F.col("blocks").cast("bigint")).cast("int"))
    centres = sized.join(standing, sized.star == standing.node).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    columns = ("star", "block", "representative", "name", "name2", F.col("representative").alias("linked"))
    return members.select(*columns).unionByName(centres.select(*columns))


def _groups_of(standing: DataFrame, edges: DataFrame, links: DataFrame) -> DataFrame:
    """Second look: (component, one, two, representative, name, name2, linked) of the groups with several components of links.

    The edges are first contracted by the links, and those inside a component of links go; so a group is made of such components.
    """
    known = links.select(F.col("node").alias("representative"), F.col("component").alias("link"))
    labelled = standing.join(known, "representative", "left").withColumn("linked", F.coalesce("link", "representative")).drop("link")
    labelled = saved(labelled.withColumn("at", F.xxhash64("linked", "level")))  # a component of links at a level
    one, two = (labelled.select(F.col("node").alias(c), F.col("at").alias(f"{c}_at")) for c in ("a", "b"))
    apart = edges.join(one, "a").join(two, "b").where("a_at <> b_at").select(F.col("a_at").alias("a"), F.col("b_at").alias("b"))
    groups = connected(apart)
    groups = groups.unionByName(groups.select(F.col("component").alias("node"), "component").distinct())
    members = labelled.join(groups.withColumnRenamed("node", "at"), "at").select("component", "representative", "name", "name2", "items", "linked")
    classes = saved(members.groupBy("component", "linked").agg(F.count("*").alias("sets"), F.sum("items").alias("items")))
    # of each group: its largest component of links, and the blocks of that one and of the others
    sized = classes.groupBy("component").agg(F.max(F.struct("sets", "items", "linked")).alias("main"), F.sum("sets").alias("sets"), F.sum("items").alias("items")).where("main.sets < sets")
    sized = sized.select("component", F.col("main.linked").alias("main"), _blocks("main.sets", "main.items", BLOCK).alias("inside"), _blocks("sets - main.sets", "items - main.items", BLOCK).alias("outside"))
    # a group may hold a third of all sets: its numbers go to SALTS places, its sets to one of them each
    salted = sized.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    placed = members.withColumn("salt", F.pmod(F.xxhash64("name2", "representative"), F.lit(SALTS)).cast("int")).join(salted, ["component", "salt"])
    within = F.col("linked") == F.col("main")
    block = F.when(within, F.col("outside") + F.pmod("name2", F.col("inside").cast("bigint"))).otherwise(F.pmod("name2", F.col("outside").cast("bigint"))).cast("int")
    last = F.col("outside") - 1 + F.when(within, F.lit(0)).otherwise(F.col("inside"))
    placed = placed.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    return placed.select("component", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "representative", "name", "name2", "linked")


def components(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    Two documents link when 100 * |A and B| >= percent * |A or B| over their sets of n-word shingles; words are runs of other
    bytes than space and U+0009 to U+000D, with A-Z in lower case. With fewer than n words the whole sequence is the one
    shingle; a null or wordless text has no shingle and no link. component_id is the smallest doc_id reachable by links.
    Rows of one id are one document for that; a null id counts as the smallest and stays null in the result. Items are
    compared by 64-bit hashes. An empty table gives an empty result.
    """
    surveyed = saved(survey(docs, n, percent))
    hot, items = _hot(surveyed)
    every = surveyed.where("bin is null").select("doc_id", "n_shingles", "name", "name2", "low", "high", "level")
    classes = every.where("n_shingles > 0").groupBy("name", "name2").agg(F.min("doc_id").alias("representative"), F.max("n_shingles").alias("items"), F.max("low").alias("low"), F.max("high").alias("high"), F.max("level").alias("level"))
    edges = saved(candidates(docs, n, percent, hot, items))
    touched = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    standing = saved(classes.select("representative", "name", "name2", "items", F.explode(F.array(F.struct(F.col("low").alias("node"), "level"), F.struct(F.col("high").alias("node"), (F.col("level") + 1).alias("level")))).alias("at")).select("representative", "name", "name2", "items", "at.node", "at.level").join(touched, "node"))
    first = connected(_compared(_stars_of(standing, edges), docs, ("star", "block"), n, percent))
    second = _compared(_groups_of(standing, edges, first), docs, ("component", "one", "two"), n, percent)
    found = connected(first.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(second))
    answer = classes.join(found, classes.representative == found.node, "left").select("name", "name2", F.coalesce("component", "representative").alias("component_id"))
    out = every.where("n_shingles > 0").select("doc_id", "n_shingles", "name", "name2").join(answer, ["name", "name2"]).select("doc_id", "n_shingles", "component_id")
    out = out.unionByName(every.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    known = lambda c: F.when(F.col(c) != NULL_ID, F.col(c)).alias(c)
    return out.select(known("doc_id"), "n_shingles", known("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The documents that are the first of their component, by id; of rows that repeat an id and its text, one stays.

    Where ids are null or repeat, each text of an id is a document of its own: by id (null first), then by the text's hash.
    """
    ids = narrow(docs, "doc_id").groupBy("doc_id").count()
    first_id, mark, row, its_id, its_mark = (unused(docs, f"__{c}") for c in ("first", "mark", "row", "id", "its"))
    is_first = F.col("doc_id") == F.col("component_id")
    if ids.where(F.col("doc_id").isNull() | (F.col("count") > 1)).isEmpty():
        first = components(docs, n, percent).where(is_first).select(F.col("doc_id").alias(first_id))
        return docs.join(first, F.col("doc_id") == F.col(first_id), "left_semi")
    marked = docs.withColumn(mark, F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col(mark)]
    rows = marked.select("doc_id", mark).distinct().repartitionByRange(shuffle_partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    rows = saved(rows.withColumn(row, F.monotonically_increasing_id())).toDF(its_id, its_mark, row)  # ranges in order: so are the numbers
    numbered = saved(marked.join(rows, F.col("doc_id").eqNullSafe(F.col(its_id)) & (F.col(mark) == F.col(its_mark))))
    found = components(numbered.select(F.col(row).alias("doc_id"), "text"), n, percent)
    first = found.where(is_first).select(F.col("doc_id").alias(first_id)).distinct()
    return numbered.join(first, F.col(row) == F.col(first_id), "left_semi").dropDuplicates([row]).select(*[f"`{c}`" for c in docs.columns])
