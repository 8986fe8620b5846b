"""A Merkle manifest of a dataset: one tree of rows for each source, and one over the sources.

Rows get their place in their source by a distributed range sort, so that tasks hold runs of neighbours. A task combines what it
holds as digests arrive: a partial parent gathers its children by their index, and as soon as it has as many as the tree's size
says, it becomes a node that goes to its own parent. What is left at a task's end, a few nodes a level at the run's edges, is the
frontier: it is dealt anew by ancestors some levels up, and combined again. Each parent that is met leaves a link to its children;
followed from the roots down, a band of levels at a time, the links give every row the siblings on its way up: its proof.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocalis.llm.frames import narrow, shuffle_partitions, stored
from vocalis.llm.ranks import placed

ARITY = 3
#: Levels between one dealing of the frontier and the next, and of a band of the way down: at most 3 ** 7 rows are below a band's top.
SPAN = 7
#: Rows that a task of the lowest band gets on average.
SLOT_ROWS = 40_000
FRONTIER, LINK, ROOT = 0, 1, 2
NODE = "tree string, size bigint, level int, index bigint, digest binary"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def width(size: int, level: int, arity: int = ARITY) -> int:
    """Nodes of a tree of so many leaves at a level."""
    return -(-size // arity**level)


def hashed(digests: list[bytes]) -> bytes:
    """The digest of a run of digests, joined as hexadecimal text."""
    return sha256(b"".join(digests).hex().encode()).digest()


def combine(nodes: Iterator[tuple[str, int, int, int, bytes]], arity: int = ARITY) -> Iterator[tuple]:
    """(tree, size, level, index, digest, children, state): links and roots as they complete, and the frontier at the end."""
    partial: dict[tuple[str, int, int], dict[int, bytes]] = {}
    sizes: dict[str, int] = {}
    for tree, size, level, index, digest in nodes:
        sizes[tree] = size
        while True:
            have = width(size, level, arity)
            if have == 1:
                yield tree, size, level, index, digest, None, ROOT
                break
            parent = index // arity
            children = partial.setdefault((tree, level, parent), {})
            children[index] = digest
            if len(children) < min(arity, have - parent * arity):
                break
            del partial[tree, level, parent]
            ordered = [children[i] for i in sorted(children)]
            level, index, digest = level + 1, parent, hashed(ordered)
            yield tree, size, level, index, digest, b"".join(ordered), LINK
    for (tree, level, _), children in partial.items():
        for index, digest in children.items():
            yield tree, sizes[tree], level, index, digest, None, FRONTIER


def _combined(nodes: DataFrame, arity: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(*[c.to_pylist() for c in b.columns], strict=True))
        done: list[tuple] = []
        for node in combine(rows, arity):
            done.append(node)
            if len(done) == 8192:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], names)
                done = []
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], names)

    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int32()]
    names = ["tree", "size", "level", "index", "digest", "children", "state"]
    return stored(nodes.select("tree", "size", "level", "index", "digest").mapInArrow(work, f"{NODE}, children binary, state int"))


def _ancestor(level: int, arity: int) -> Column:
    """The index of a node's ancestor at ``level``; of a node there or above, its parent's."""
    up = F.greatest(F.lit(level) - F.col("level"), F.lit(1))
    return F.floor(F.col("index") / F.pow(F.lit(arity), up)).cast("long")


def build(leaves: DataFrame, arity: int = ARITY, span: int = SPAN) -> tuple[DataFrame, DataFrame, int]:
    """From (tree, size, index, digest): all links (NODE, children), the roots (NODE), and the levels of the tallest tree.

    Leaves of a tree that stand together in a partition, in order, are combined without a shuffle.
    """
    most = leaves.agg(F.max("size")).first()[0] or 0
    top = next(k for k in range(64) if width(most, k, arity) <= 1)
    rounds = [_combined(leaves.withColumn("level", F.lit(0)), arity)]
    for level in range(span, top + span, span):
        frontier = rounds[-1].where(F.col("state") == FRONTIER)
        rounds.append(_combined(frontier.repartition("tree", _ancestor(level, arity)), arity))
    found = rounds[0]
    for more in rounds[1:]:
        found = found.unionByName(more)
    return found.where(F.col("state") == LINK).drop("state"), found.where(F.col("state") == ROOT).drop("state", "children"), top


def descend(links: dict[tuple[str, int, int], list[bytes]], tree: str, level: int, index: int, proof: bytes, floor: int, arity: int = ARITY) -> Iterator[tuple[int, bytes]]:
    """(index, proof) of each node of level ``floor`` below a node whose proof is given: reverse links, from parent to child."""
    stack = [(level, index, proof)]
    while stack:
        level, index, proof = stack.pop()
        if level == floor:
            yield index, proof
            continue
        children = links[tree, level, index]
        for k in range(len(children)):
            stack.append((level - 1, index * arity + k, b"".join(children[:k] + children[k + 1 :]) + proof))


def fold(digest: bytes, proof: bytes, steps: list[tuple[int, int]], arity: int = ARITY) -> bytes:
    """The root that a digest and its proof lead to, by (size of the tree, index in it) of each tree on the way."""
    at = 0
    for size, index in steps:
        level = 0
        while (have := width(size, level, arity)) > 1:
            run = min(arity, have - index // arity * arity)
            others = [proof[at + 32 * k : at + 32 * (k + 1)] for k in range(run - 1)]
            at += 32 * (run - 1)
            others.insert(index % arity, digest)
            digest, level, index = hashed(others), level + 1, index // arity
    return digest


PATH = "tree string, size bigint, level int, index bigint, proof binary, subroot binary, root binary, place bigint, places bigint"
PATH_NAMES = [f.split()[0] for f in PATH.split(", ")]
PATH_KINDS = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
WAY = ("proof", "subroot", "root", "place", "places")


def _table(out: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.Table:
    columns = list(zip(*out, strict=True)) or [[]] * len(kinds)
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)


def _lowered(floor: int, arity: int) -> Callable[[pa.Table], pa.Table]:
    def work(table: pa.Table) -> pa.Table:
        links, starts = _split(table)
        return _table([(s["tree"], s["size"], floor, index, proof, *[s[c] for c in WAY[1:]]) for s in starts for index, proof in descend(links, s["tree"], s["level"], s["index"], s["proof"], floor, arity)], PATH_NAMES, PATH_KINDS)

    return work


def paths(links: DataFrame, tops: DataFrame, top: int, arity: int = ARITY, span: int = SPAN) -> DataFrame:
    """The rows of PATH for the nodes at level ``span`` and for the roots below it, from those of all roots (``tops``)."""
    for upper in range(-(-top // span) * span, span, -span):
        floor = upper - span
        here = (F.col("level") > floor) & (F.col("level") <= upper)
        own = links.where(here).select("tree", "level", "index", "children", *[F.lit(None).cast(t).alias(c) for c, t in (("size", "bigint"), ("proof", "binary"), ("subroot", "binary"), ("root", "binary"), ("place", "bigint"), ("places", "bigint"))])
        rows = own.unionByName(tops.where(here).withColumn("children", F.lit(None).cast("binary")))
        block = F.when(F.col("level") == upper, F.col("index")).otherwise(_ancestor(upper, arity))

        lower = rows.withColumn("slot", _slot(block, shuffle_partitions(links.sparkSession) * 4)).groupBy("slot").applyInArrow(_lowered(floor, arity), PATH)
        tops = lower.unionByName(tops.where(~here))
    return tops


def _slot(block: Column, slots: int) -> Column:
    return F.pmod(F.xxhash64("tree", block), F.lit(slots))


def _split(table: pa.Table) -> tuple[dict, list[dict]]:
    """Links by their parent, and the other rows that carry a proof."""
    is_link = table.column("children").is_valid()
    own, rest = table.filter(is_link), table.filter(table.column("proof").is_valid())
    found = {}
    for tree, level, index, children in zip(*[own.column(c).to_pylist() for c in ("tree", "level", "index", "children")], strict=True):
        found[tree, level, index] = [children[k : k + 32] for k in range(0, len(children), 32)]
    return found, rest.to_pylist()


def _leaf(text: Column) -> Column:
    """The digest of a row, hexadecimal: each field as ``-`` if null, else its UTF-8 bytes, a colon and its value."""
    fields = [F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in (text if name == "text" else F.col(f"`{name}`").cast("string") for name in FIELDS)]
    return F.sha2(F.concat(*fields).cast("binary"), 256)


def manifest(docs: DataFrame, arity: int = ARITY, span: int = SPAN) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified; digests as lowercase hex.

    ``folded_root`` starts from the digest of the row as it is after tampering (line feeds go from the text where crc32 of the
    decimal doc_id is even) and climbs by the original siblings; it differs from root where tampering changed the text. Rows of a
    source stand in the order of doc_id, null first (its crc32 is that of an empty text), equal ids in the order of their digests.
    A null source is a source, before the others. An empty table gives an empty result; columns other than the five don't count.
    """
    text = F.col("text").cast("string")
    even = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(2)) == 0
    changed = even & F.contains(text, F.lit("\n"))
    tree = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), F.col("source").cast("string")))  # in the order of sources
    rows = narrow(docs, *FIELDS).select(F.col("doc_id").cast("long").alias("doc_id"), tree.alias("tree"), F.unhex(_leaf(text)).alias("leaf"), F.when(changed, F.unhex(_leaf(F.replace(text, F.lit("\n"), F.lit(""))))).alias("tampered"))
    leaves = placed(rows, ["tree"], ["doc_id", "leaf"]).select("tree", "doc_id", "leaf", "tampered", F.col("position").alias("index"), F.col("rows").alias("size"), "range")
    leaves = stored(leaves.sortWithinPartitions("tree", "index"))
    links, roots, top = build(leaves.withColumnRenamed("leaf", "digest"), arity, span)

    sources = placed(roots.select("tree", "size", "digest").withColumn("all", F.lit("")), ["all"], ["tree"])
    sources = stored(sources.select(F.col("tree").alias("source"), F.col("size").alias("source_size"), F.col("all").alias("tree"), "digest", F.col("position").alias("index"), F.col("rows").alias("size")))
    over, whole, height = build(sources.sortWithinPartitions("index"), arity, span)
    none = [F.lit(None).cast(t).alias(c) for c, t in (("subroot", "binary"), ("place", "bigint"), ("places", "bigint"))]
    start = whole.select("tree", "size", "level", "index", F.lit(b"").alias("proof"), F.col("digest").alias("root"), *none)
    tops = _climbed(sources, over, paths(over, start, height, arity, span), arity, span)
    leading = paths(links, tops, top, arity, span)
    slots = max(4 * shuffle_partitions(docs.sparkSession), leaves.count() // SLOT_ROWS)
    return _proved(leaves, links, leading, slots, arity, span)


def _climbed(sources: DataFrame, links: DataFrame, ways: DataFrame, arity: int, span: int) -> DataFrame:
    """The rows of PATH for the roots of all sources' trees, from those of the tree over the sources."""
    kinds = (("tree", "string"), ("size", "bigint"), ("level", "int"), ("index", "bigint"), ("children", "binary"), ("proof", "binary"), ("root", "binary"), ("source", "string"), ("source_size", "bigint"), ("digest", "binary"))
    full = lambda df: df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in kinds])
    rows = full(sources.withColumn("level", F.lit(0))).unionByName(full(links.where(F.col("level") <= span)))
    rows = rows.unionByName(full(ways))
    block = F.when(F.col("level") == span, F.col("index")).otherwise(_ancestor(span, arity))

    def work(table: pa.Table) -> pa.Table:
        links_, starts = _split(table)
        own = table.filter(table.column("source").is_valid()).to_pylist()
        proofs = {}
        for s in starts:
            proofs.update({index: (proof, s["root"]) for index, proof in descend(links_, s["tree"], s["level"], s["index"], s["proof"], 0, arity)})
        out = []
        for r in own:
            height = next(k for k in range(64) if width(r["source_size"], k, arity) <= 1)
            out.append((r["source"], r["source_size"], height, 0, proofs[r["index"]][0], r["digest"], proofs[r["index"]][1], r["index"], r["size"]))
        return _table(out, PATH_NAMES, PATH_KINDS)

    return stored(rows.withColumn("slot", _slot(block, shuffle_partitions(sources.sparkSession) * 4)).groupBy("slot").applyInArrow(work, PATH))


def _proved(leaves: DataFrame, links: DataFrame, ways: DataFrame, slots: int, arity: int, span: int) -> DataFrame:
    """The last band: each leaf's proof and the root that its tampered digest leads to."""
    kinds = (("tree", "string"), ("size", "bigint"), ("level", "int"), ("index", "bigint"), ("children", "binary"), ("proof", "binary"), ("subroot", "binary"), ("root", "binary"), ("place", "bigint"), ("places", "bigint"), ("doc_id", "bigint"), ("leaf", "binary"), ("tampered", "binary"))
    full = lambda df: df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in kinds])
    rows = full(leaves.withColumn("level", F.lit(0))).unionByName(full(links.where(F.col("level") <= span))).unionByName(full(ways))
    block = F.when(F.col("level") == span, F.col("index")).otherwise(_ancestor(span, arity))

    def work(table: pa.Table) -> pa.Table:
        links_, starts = _split(table)
        own = table.filter(table.column("leaf").is_valid())
        ways_ = {}
        for s in starts:
            for index, proof in descend(links_, s["tree"], s["level"], s["index"], s["proof"], 0, arity):
                ways_[s["tree"], index] = proof, s
        out = []
        for tree, size, index, doc_id, leaf, tampered in zip(*[own.column(c).to_pylist() for c in ("tree", "size", "index", "doc_id", "leaf", "tampered")], strict=True):
            proof, s = ways_[tree, index]
            folded = fold(tampered or leaf, proof, [(size, index), (s["places"], s["place"])], arity)
            out.append((doc_id, leaf.hex(), s["subroot"].hex(), s["root"].hex(), sha256(proof.hex().encode()).hexdigest(), folded.hex(), folded == s["root"]))
        return _table(out, ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"], [pa.int64(), *[pa.string()] * 5, pa.bool_()])

    schema = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return rows.withColumn("slot", _slot(block, slots)).groupBy("slot").applyInArrow(work, schema)


def oracle_sql(levels: int = 12) -> str:
    """The same rows for trees of at most ``levels`` levels (a source of 3 ** levels rows), level by level."""

    def tree(name: str, leaves: str, key: str) -> str:
        ctes = [f"{name}0 AS (SELECT {key} AS t, i, n, d FROM {leaves})"]
        for k in range(levels):
            ctes.append(f"{name}g{k} AS (SELECT t, i // 3 AS i, n, list(d ORDER BY i) AS ds FROM {name}{k} GROUP BY t, i // 3, n)")
            ctes.append(f"{name}{k + 1} AS (SELECT t, i, (n + 2) // 3 AS n, CASE WHEN n = 1 THEN ds[1] ELSE sha256(array_to_string(ds, '')) END AS d FROM {name}g{k})")
        return ", ".join(ctes)

    def climb(source: str, name: str, key: str, index: str) -> list[str]:
        out = []
        for k in range(levels):
            out.append(
                f"{source}{k + 1} AS (SELECT c.* REPLACE (c.proof || CASE WHEN g.n = 1 THEN '' ELSE array_to_string(list_filter(g.ds, lambda d, j: j <> c.{index} // {3**k} % 3 + 1), '') END AS proof, "
                f"CASE WHEN g.n = 1 THEN c.cur ELSE sha256(array_to_string(list_transform(g.ds, lambda d, j: CASE WHEN j = c.{index} // {3**k} % 3 + 1 THEN c.cur ELSE d END), '')) END AS cur) "
                f"FROM {source}{k} c JOIN {name}g{k} g ON g.t = c.{key} AND g.i = c.{index} // {3 ** (k + 1)})"
            )
        return out

    enc = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR END"
    row = lambda text: "sha256(" + " || ".join(enc(text if c == "text" else c) for c in FIELDS) + ")"
    crc = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(v) + 1), lambda i: ord(v[i])::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda p, q: CASE WHEN p & 1 = 1 THEN xor(p >> 1, 3988292384) ELSE p >> 1 END)), 4294967295)"
    parts = [
        f"r AS (SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS t, {row('text')} AS leaf, CASE WHEN {crc} % 2 = 0 THEN {row('fed')} ELSE {row('text')} END AS cur FROM (SELECT *, coalesce(doc_id::VARCHAR, '') AS v, replace(text, chr(10), '') AS fed FROM documents))",
        "l AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY t) AS n, leaf AS d FROM r)",
        tree("a", "l", "t"),
        f"s AS (SELECT t, row_number() OVER (ORDER BY encode(t)) - 1 AS i, count(*) OVER () AS n, d FROM a{levels})",
        tree("b", "s", "''"),
        "c0 AS (SELECT l.doc_id, l.leaf, l.t, l.i, l.cur, '' AS proof, s.d AS subroot, s.i AS place, '' AS top FROM l JOIN s ON l.t = s.t)",
        *climb("c", "a", "t", "i"),
        f"e0 AS (SELECT * FROM c{levels})",
        *climb("e", "b", "top", "place"),
    ]
    return f"WITH {', '.join(parts)} SELECT e.doc_id, leaf, subroot, z.d AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = z.d AS verified FROM e{levels} e, b{levels} z"
