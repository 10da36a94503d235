"""A Merkle manifest of a table of documents, by time-forward processing.

Nodes are labelled by level and index, so every child has a smaller label than its parent. Going up,
a priority queue ordered by label delivers the digests of children to their parents; a reversed
sweep delivers to each node the proof suffix of its parent: the siblings met on the way from there
to the root. The queue is external: leaves are sorted by Spark (range partitions, spilling runs),
blocks of ``fan ** LEVELS`` consecutive nodes are swept by one task with a heap that holds the
block's messages alone, and messages between blocks are rows of a table in the shared folder that
Spark shuffles to the next sweep. A suffix is sent once for a block, not for each leaf.

Positions come from the sizes of the range partitions, so a language with most of the rows is
spread over as many tasks as it has blocks.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._stage import stage
from ._text import chunks

FAN = 8
#: Levels that one task climbs: 4096 leaves to a block.
LEVELS = 4
_PATH = "key string, idx long, before array<string>, after array<string>, subroot string, root string"


def H(*parts: bytes) -> bytes:
    """Lower-case hex sha256 of the parts together."""
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def _field(value) -> bytes:
    if value is None:
        return b"-"
    raw = value if isinstance(value, bytes) else str(value).encode()
    return b"%d:%b" % (len(raw), raw)


def _leaves(found: Callable[[bytes], bytes] | None):
    """Leaf digests, and of changed rows the digest with the text as found."""

    def run(batches):
        for batch in batches:
            have = batch.column("text").is_valid().to_pylist()
            ids, changed = batch.column("doc_id").to_pylist(), batch.column("changed").to_pylist()
            heads = [b"".join(map(_field, row)) for row in zip(ids, *(batch.column(c).to_pylist() for c in ("source", "lang", "n_chars")), strict=True)]
            for lo, hi, data, offsets in chunks(batch.column("text")):
                leaf, other = [], []
                for k in range(lo, hi):
                    text = data[offsets[k - lo] : offsets[k - lo + 1]].tobytes() if have[k] else None
                    leaf.append(hashlib.sha256(heads[k] + _field(text)).digest())
                    other.append(hashlib.sha256(heads[k] + _field(text if text is None else found(text))).digest() if found and changed[k] else None)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[lo:hi], batch.column("key")[lo:hi], pa.array(leaf, pa.binary()), pa.array(other, pa.binary())], ["doc_id", "key", "digest", "other"])

    return run


def _numbered(nodes: DataFrame, *order: str) -> DataFrame:
    """Adds ``idx``, the position among the rows of a key by ``order``, and ``m``, the number of these rows."""
    by = [F.col(c).asc_nulls_first() for c in ("key", *order)]
    at = stage(nodes.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id()), "sorted")
    at = at.withColumn("part", F.shiftright("at", 33))
    # One row for each key in a range partition: a window over these has at most one row for each partition.
    spans = at.groupBy("key", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("key").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    spans = spans.select("key", "part", (before - F.col("first")).alias("shift"), F.sum("n").over(W.partitionBy("key")).alias("m"))
    return at.join(spans, ["key", "part"]).withColumn("idx", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def _depth(m: Column, fan: int) -> Column:
    """Levels above the leaves of a tree of m leaves."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(63)), F.struct(m.cast("long").alias("m"), F.lit(0).alias("d")), lambda s, _: F.struct(F.ceil(s["m"] / fan).cast("long").alias("m"), (s["d"] + (s["m"] > 1).cast("int")).alias("d")), lambda s: s["d"])


def _climbed(digests: list[bytes], first: int, levels: int, fan: int) -> list[list[bytes]]:
    """Digests of a block by level, children first. ``first`` is the index of the block's first leaf."""
    # Queue of (label of the parent, index of the child, digest); parents are met in the order of their labels.
    queue = [((1, (first + k) // fan), first + k, d) for k, d in enumerate(digests)] if levels else []
    out = [digests]
    while queue:
        label = queue[0][0]
        children = []
        while queue and queue[0][0] == label:
            children.append(heapq.heappop(queue)[2])
        level, index = label
        if level == len(out):
            out.append([])
        out[level].append(H(*children))
        if level < levels:
            heapq.heappush(queue, ((level + 1, index // fan), index, out[level][-1]))
    return out


def _suffixes(rows: list[list[bytes]], above: tuple, fan: int) -> list[tuple]:
    """For each leaf of a block its siblings up to the root, as a chain of (before, after, chain of the parent)."""
    chains = [above]
    for row in rows[-2::-1]:
        runs = [row[k : k + fan] for k in range(0, len(row), fan)]
        chains = [(b"".join(run[:k]), b"".join(run[k + 1 :]), chains[r]) for r, run in enumerate(runs) for k in range(len(run))]
    return chains


def _steps(chain: tuple):
    while chain:
        before, after, chain = chain
        yield before, after


def _chained(before: list[str], after: list[str]) -> tuple:
    chain = ()
    for b, a in zip(before[::-1], after[::-1], strict=True):
        chain = (b.encode(), a.encode(), chain)
    return chain


def _block(table: pa.Table, t: int, levels: int) -> tuple[pa.Table, list[bytes], int, int]:
    """A block in order: its rows, digests, the index of the first and the levels to climb."""
    table = table.sort_by("idx")
    climb = min(levels, max(0, table.column("depth")[0].as_py() - t * levels))
    return table, [d.hex().encode() for d in table.column("digest").to_pylist()], table.column("idx")[0].as_py(), climb


class _Forest:
    """The sweeps over trees, one for each ``key`` of ``leaves(key, idx, m, digest, ...)``."""

    def __init__(self, leaves: DataFrame, fan: int, levels: int):
        self.fan, self.levels, size = fan, levels, fan**levels
        self.blocks = lambda df: df.groupBy("key", F.floor(F.col("idx") / size).alias("block"))
        leaves = stage(leaves.withColumn("depth", _depth(F.col("m"), fan)), "leaves")
        nodes, done, t = leaves.select("key", "idx", "depth", "digest"), [], 0
        self.rounds = [leaves]
        deepest = leaves.agg(F.max("depth")).first()[0] or 0

        def up(t):
            def run(key, table):
                table, digests, first, climb = _block(table, t, levels)
                top = _climbed(digests, first, climb, fan)[-1]
                return pa.table({"key": [key[0].as_py()], "idx": pa.array([first // size], pa.int64()), "depth": pa.array([table.column("depth")[0].as_py()], pa.int32()), "digest": pa.array([bytes.fromhex(top[0].decode())], pa.binary())})

            return run

        while True:
            done.append(nodes.where(F.col("depth") <= levels * t))
            if deepest <= levels * t:
                break
            nodes = stage(self.blocks(nodes.where(F.col("depth") > levels * t)).applyInArrow(up(t), "key string, idx long, depth int, digest binary"), "nodes")
            t += 1
            self.rounds.append(nodes)
        self.roots = done[0]
        for more in done[1:]:
            self.roots = self.roots.union(more)

    def down(self, above: DataFrame, each: Callable, schema: str) -> DataFrame:
        """Deliver the proof suffixes: ``above(key, idx 0, before, after, subroot, root)`` is what lies over each root.

        ``each(rows, chains, subroots, roots)`` makes the result of a block of leaves.
        """
        fan, levels, size = self.fan, self.levels, self.fan**self.levels
        tops = self.rounds[0].where("idx = 0").select("key", F.greatest(F.lit(0), F.ceil(F.col("depth") / levels).cast("int") - 1).alias("top"))
        above = stage(above.join(tops, "key"), "above")

        def swept(t, last):
            def run(key, table, suffix):
                table, digests, first, climb = _block(table, t, levels)
                suffix = {c: suffix.column(c)[0].as_py() for c in ("before", "after", "subroot", "root")}
                chains = _suffixes(_climbed(digests, first, climb, fan), _chained(suffix["before"], suffix["after"]), fan)
                if last:
                    return each(table, chains, suffix["subroot"], suffix["root"])
                paths = [list(_steps(c)) for c in chains]
                n = len(table)
                return pa.table({
                    "key": table.column("key"), "idx": table.column("idx"), "before": pa.array([[b.decode() for b, _ in p] for p in paths], pa.list_(pa.string())),
                    "after": pa.array([[a.decode() for _, a in p] for p in paths], pa.list_(pa.string())), "subroot": [suffix["subroot"]] * n, "root": [suffix["root"]] * n,
                })

            return run

        suffixes = None
        for t in range(max(1, len(self.rounds) - 1) - 1, -1, -1):
            start = above.where(F.col("top") == t).drop("top")
            suffixes = start if suffixes is None else suffixes.unionByName(start)
            # The suffix of a node at the top of a block is for the block with the node's index.
            to = suffixes.withColumn("block", F.col("idx")).groupBy("key", "block")
            nodes = self.rounds[t] if t == 0 else self.rounds[t].where(F.col("depth") > levels * t)
            suffixes = self.blocks(nodes).cogroup(to).applyInArrow(swept(t, t == 0), schema if t == 0 else _PATH)
        return suffixes


def _proved(table: pa.Table, chains: list[tuple], subroot: str, root: str, proofs: bool) -> pa.Table:
    leaf = [d.hex() for d in table.column("digest").to_pylist()]
    other = [d and d.hex() for d in table.column("other").to_pylist()]
    digest, folded = [], []
    for mine, changed, chain in zip(leaf, other, chains, strict=True):
        at, proof = (changed or mine).encode(), hashlib.sha256()
        for before, after in _steps(chain):
            proof.update(before + after)
            at = H(before, at, after)
        digest.append(proof.hexdigest())
        folded.append(at.decode())
    n = len(leaf)
    out = {"doc_id": table.column("doc_id"), "leaf": leaf, "subroot": [subroot] * n, "root": [root] * n, "proof_sha256": digest, "folded_root": folded, "verified": [f == root for f in folded]}
    if proofs:
        kind = pa.list_(pa.string())
        out["before"] = pa.array([[b.decode() for b, _ in _steps(c)] for c in chains], kind)
        out["after"] = pa.array([[a.decode() for _, a in _steps(c)] for c in chains], kind)
    return pa.table(out)


def manifest(docs: DataFrame, changed: Column | None = None, found: Callable[[bytes], bytes] | None = None, proofs: bool = False, fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """``docs(doc_id, source, lang, n_chars, text)`` -> leaf, subroot, root and check of the proof of each row.

    A row's leaf is H of its five values. The leaves of a language in the order of doc_id (null first;
    rows that share one by their leaf) are joined ``fan`` at a time up to the language's subroot, the
    subroots in the order of the languages (null first) up to the root. For rows where ``changed``
    holds, ``found`` gives the bytes of the text as met later (null texts stay); ``folded_root`` is
    what the row then leads to with its original siblings, ``verified`` whether that is the root.
    ``proof_sha256`` is H of the siblings from the leaf to the root; ``proofs`` adds the siblings
    themselves, before and after the node on each level. Values are taken as they are: null is not
    empty. Other columns are ignored; an empty table has an empty manifest.
    """
    text = lambda c: F.col(c).cast("string").alias(c)
    # Keys keep the order of the languages, null before all.
    key = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("-")).alias("key")
    flag = F.coalesce(changed if changed is not None else F.lit(False), F.lit(False)).alias("changed")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text("source"), text("lang"), F.col("n_chars").cast("long").alias("n_chars"), text("text"), key, flag)
    leaves = stage(docs.mapInArrow(_leaves(found), "doc_id long, key string, digest binary, other binary"), "digests")
    trees = _Forest(_numbered(leaves, "doc_id", "digest"), fan, levels)
    # The subroots are the leaves of one more tree, whose key is empty.
    top = _Forest(_numbered(trees.roots.select(F.lit("").alias("key"), F.col("key").alias("name"), "digest"), "name"), fan, levels)
    none = F.array().cast("array<string>")
    start = top.roots.select("key", F.lit(0).cast("long").alias("idx"), none.alias("before"), none.alias("after"), F.lit("").alias("subroot"), F.lower(F.hex("digest")).alias("root"))

    def named(table, chains, _, root):
        paths, n, kind = [list(_steps(c)) for c in chains], len(table), pa.list_(pa.string())
        return pa.table({
            "key": table.column("name"), "idx": pa.array([0] * n, pa.int64()), "before": pa.array([[b.decode() for b, _ in p] for p in paths], kind), "after": pa.array([[a.decode() for _, a in p] for p in paths], kind),
            "subroot": [d.hex() for d in table.column("digest").to_pylist()], "root": [root] * n,
        })

    above = top.down(start, named, _PATH)
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return trees.down(above, lambda *block: _proved(*block, proofs), schema + ", before array<string>, after array<string>" * proofs)
