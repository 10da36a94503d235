"""Repeated word passages by prefix-partitioned suffix trees.

Suffixes start at words. Only suffixes that can share ``window`` words with another
matter, and those are found without moving every suffix: each window is filed under the
smallest-hashed ``prefix``-word run inside it (equal windows choose the same run at the same
place), so a window whose run occurs once in the corpus has no equal.

Prefixes have two lengths. Suffixes filed under one run form a group that fits in memory; its
tree is grown from the root: edges are labelled with LEVEL words, compared as words, branches
with one leaf are dropped, and nodes at depth ``window`` that keep two leaves are the deep
internal nodes. A run with more than ``group_limit`` occurrences would not fit: its suffixes are
filed under the longest prefix, the whole window, where a node is one key and Spark counts its
leaves, so no group outgrows memory and none is cut short. Neighbouring repeated windows merge
into maximal repeats.

Texts are not moved to find repeats: bitmaps of the runs that recur, and of overfull ones, go to
the tasks that read them. What a bitmap marks in error makes a group without repeats.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bitmap import BITS, bitmap, marked, place
from ._stage import stage
from ._text import U, Words, as_bytes, chunks, gram_hashes, mix

LEVEL = 7
#: Words that are compared at once.
NAMED = 1 << 15
ROW = ("d", "text_id")


def _runs(words: Words, window: int, prefix: int) -> tuple[np.ndarray, ...]:
    """The runs that windows are filed under: key, row, and the first and last of those windows."""
    span = window - prefix + 1
    runs, _ = words.grams(prefix)
    n = max(0, len(words) - window + 1)
    starts = np.flatnonzero(words.row[:n] == words.row[window - 1 :])
    if not len(starts):
        return np.zeros(0, U), *(np.zeros(0, np.int64),) * 3
    at = _leftmost_least(runs[: n + span - 1], span)[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (at[1:] != at[:-1]) | (words.row[starts[1:]] != words.row[starts[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    return runs[at[first]], words.row[starts[first]], starts[first], starts[last]


def _leftmost_least(x: np.ndarray, span: int) -> np.ndarray:
    """Where the least of each ``span`` neighbours is, the first of equals, by doubling."""
    at, least, have = np.arange(len(x)), x, 1
    while have < span:
        step = min(have, span - have)
        n = len(least) - step
        left = least[:n] <= least[step:]
        at, least = np.where(left, at[:n], at[step:]), np.where(left, least[:n], least[step:])
        have += step
    return at


def _counted(window: int, prefix: int):
    """How often each run is a place for windows, added up over a chunk."""

    def run(batches):
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column("text")):
                key, n = np.unique(_runs(Words(data, offsets), window, prefix)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], ["key", "n"])

    return run


def _chosen(batch, shared, window: int, prefix: int, overfull: bool):
    """Of each chunk: its words, bytes, first row, and the recurring runs that are or are not overfull."""
    recurs, full = shared.value
    for lo, _, data, offsets in chunks(batch.column("text")):
        words = Words(data, offsets)
        key, row, first, last = _runs(words, window, prefix)
        at = (key & U(BITS - 1)).astype(np.int64)
        use = marked(recurs, at) & (marked(full, at) == overfull)
        yield words, data, lo, key[use], row[use], first[use], last[use]


def _slices(shared, window: int, prefix: int):
    """The words under each run that fits in memory."""

    def run(batches):
        for batch in batches:
            for words, data, top, key, row, first, last in _chosen(batch, shared, window, prefix, False):
                raw = data.tobytes()
                text = [raw[a:b] for a, b in zip(words.start[first].tolist(), words.end[last + window - 1].tolist())]
                of = pa.array(row + top)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(text, pa.binary()), *(batch.column(c).take(of) for c in ROW), pa.array((first - words.first[row]).astype(np.int32))], ["key", "words", *ROW, "lo"])

    return run


LOOSE = "key long, key2 long, d long, text_id long, lo int, hi int, leaves int"


def _windows(shared, window: int, prefix: int):
    """The windows under each overfull run, by 128 bits of hash.

    Windows that recur within a chunk are repeats: their stretches come without key, and one row
    without document, of two leaves, stands for each node. The others come with their key.
    """

    def run(batches):
        for batch in batches:
            for words, _, top, _, row, first, last in _chosen(batch, shared, window, prefix, True):
                size = last - first + 1
                if not len(size):
                    continue
                at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)
                row = np.repeat(row, size)
                a, b = (gram_hashes(h, window)[at].view(np.int64) for h in (words.hash, mix(words.hash ^ U(LEVEL))))
                order = np.lexsort((b, a))
                new = np.ones(len(at), bool)
                new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
                leaves = np.diff(np.append(np.flatnonzero(new), len(at)))
                many = np.zeros(len(at), bool)
                many[order] = np.repeat(leaves > 1, leaves)
                node, single, among = order[new][leaves > 1], np.flatnonzero(~many), np.flatnonzero(many)
                begins = np.ones(len(among), bool)
                begins[1:] = (at[among][1:] != at[among][:-1] + 1) | (row[among][1:] != row[among][:-1])
                begin = among[begins]
                end = among[np.append(np.flatnonzero(begins)[1:], len(among)) - 1] if len(among) else among
                rows = np.concatenate([begin, node, single])
                kind = np.repeat([0, 2, 1], [len(begin), len(node), len(single)])
                of, base = pa.array(row[rows] + top, mask=kind == 2), words.first[row[rows]]
                hi = np.concatenate([at[end], at[node], at[single]]) - base
                yield pa.RecordBatch.from_arrays([*(pa.array(x[rows], mask=kind == 0) for x in (a, b)), *(batch.column(c).take(of) for c in ROW), pa.array((at[rows] - base).astype(np.int32)), pa.array(hi.astype(np.int32)), pa.array(kind.astype(np.int32))], ["key", "key2", *ROW, "lo", "hi", "leaves"])

    return run


def _same(words: Words, like: np.ndarray, lo: int, hi: int) -> bool:
    """Whether words lo..hi have the bytes of those they are like, which are as long."""
    start, other, size = words.start[lo:hi], words.start[like[lo:hi]], (words.end - words.start)[lo:hi]
    within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return bool((words.data[np.repeat(start, size) + within] == words.data[np.repeat(other, size) + within]).all())


def _names(words: Words) -> np.ndarray:
    """A number for each distinct word; equal hashes of different words are told apart."""
    _, one, name = np.unique(words.hash, return_index=True, return_inverse=True)
    size, like = words.end - words.start, one[name]
    if (size == size[like]).all() and all(_same(words, like, lo, lo + NAMED) for lo in range(0, len(name), NAMED)):
        return name
    raw, numbers = words.data.tobytes(), {}
    return np.array([numbers.setdefault(raw[a:b], len(numbers)) for a, b in zip(words.start.tolist(), words.end.tolist())])


def _labels(names: np.ndarray, size: int) -> np.ndarray:
    """A number for each distinct run of ``size`` names, by doubling; the last size - 1 places have none."""
    have, label = 1, names
    while have < size:
        step = min(have, size - have)
        n = len(label) - step
        _, label = np.unique(label[:n] * (int(label.max()) + 1) + label[step:], return_inverse=True) if n > 0 else (None, label[:0])
        have += step
    return label


def _deep(group: np.ndarray, words: Words, window: int) -> np.ndarray:
    """The suffixes that are leaves of a node at depth ``window`` with two leaves or more, in order."""
    n = max(0, len(words) - window + 1)
    at = np.flatnonzero(words.row[:n] == words.row[window - 1 :])
    node, depth = group[words.row[at]].astype(np.int64), 0
    names, edges = _names(words), {}
    while depth < window and len(at):
        step = min(LEVEL, window - depth)
        if step not in edges:
            edges[step] = _labels(names, step)
        edge = edges[step][at + depth]
        _, node, leaves = np.unique(node * (int(edge.max()) + 1) + edge, return_inverse=True, return_counts=True)
        keep = leaves[node] > 1
        at, node = at[keep], node[keep]
        depth += step
    return at


def _trees(window: int):
    """Rows sorted by key -> the repeated stretches (first and last start) of each row."""

    def grow(rows: pa.Table):
        _, group = np.unique(rows.column("key").to_numpy(), return_inverse=True)
        words = Words(*as_bytes(rows.column("words").combine_chunks().cast(pa.large_binary()).cast(pa.large_string())))
        at = _deep(group, words, window)
        if not len(at):
            return
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (words.row[at[1:]] != words.row[at[:-1]])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at)) - 1
        row = words.row[at[first]]
        shift = rows.column("lo").to_numpy()[row] - words.first[row]
        of = rows.select(ROW).take(pa.array(row)).combine_chunks()
        yield pa.RecordBatch.from_arrays([*(of.column(c).combine_chunks() for c in ROW), pa.array((at[first] + shift).astype(np.int32)), pa.array((at[last] + shift).astype(np.int32))], [*ROW, "lo", "hi"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            # Whole groups only: the last key of a batch may go on.
            key = batch.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            if held and (cut or held[-1].column("key")[-1].as_py() != key[0]):
                yield from grow(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            elif cut:
                yield from grow(pa.Table.from_batches([batch.slice(0, cut)]))
            held.append(batch.slice(cut))
        if held:
            yield from grow(pa.Table.from_batches(held))

    return run


def _digest(text: bytes, found) -> tuple[int, int, str]:
    """Words, words within a repeat, and the digest of the others."""
    words = text.split()
    if not found:
        return len(words), 0, hashlib.sha256(b" ".join(words)).hexdigest()
    keep = np.ones(len(words), bool)
    for lo, end in found:
        keep[lo:end] = False
    return len(words), int((~keep).sum()), hashlib.sha256(b" ".join(compress(words, keep.tolist()))).hexdigest()


def _digests(batch, window: int):
    texts = batch.column("text").cast(pa.large_string()).cast(pa.large_binary()).to_pylist()
    found = batch.column("found").to_pylist() if "found" in batch.schema.names else [None] * len(texts)
    out = [_digest(t, [(x["lo"], x["hi"] + window) for x in f or ()]) for t, f in zip(texts, found)]
    kept = list(zip(*out)) or [[]] * 3
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kept[0], pa.int64()), pa.array(kept[1], pa.int64()), pa.array(kept[2], pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def _finish(window: int):
    """Rows, with their repeats -> counts and the digest of the kept words."""
    return lambda batches: (_digests(b, window) for b in batches)


def _whole(shared, window: int):
    """The same of the rows without repeats, which the bitmap has not."""

    def run(batches):
        for batch in batches:
            yield _digests(batch.filter(pa.array(~marked(shared.value, batch.column("place").to_numpy()))), window)

    return run


def _touched(shared):
    """The rows that the bitmap has."""

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(marked(shared.value, batch.column("place").to_numpy()))).drop_columns(["place"])

    return run


def repeated_passages(docs: DataFrame, window: int = 35, prefix: int = 12, group_limit: int = 1000) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, n_words, n_removed, kept_sha256)``, a row for each row.

    Every word covered by a ``window``-word sequence that also starts elsewhere, in the same
    document or another, is removed; windows are judged on the input. Null and empty texts have
    no words. Repeated rows, also of one doc_id or a null one, are documents of their own and so
    repeats of each other. Other columns are ignored.
    """
    ids = F.col("doc_id").cast("long")
    docs = docs.select(ids.alias("doc_id"), F.coalesce(ids, F.lit(0)).alias("d"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("text_id", F.xxhash64("doc_id", "text"))
    runs = docs.select("text").mapInArrow(_counted(window, prefix), "key long, n long")
    runs = stage(runs.groupBy("key").agg(F.sum("n").alias("n")).where("n > 1"), "runs")
    at = F.col("key").bitwiseAND(F.lit(BITS - 1))
    over = bitmap(runs.where(F.col("n") > group_limit).select(at))
    context = docs.sparkSession.sparkContext
    shared = context.broadcast((bitmap(runs.select(at)), over))  # 8 MB each

    slices = docs.select("text", *ROW).mapInArrow(_slices(shared, window, prefix), "key long, words binary, d long, text_id long, lo int")
    found = slices.repartition("key").sortWithinPartitions("key").mapInArrow(_trees(window), "d long, text_id long, lo int, hi int")
    if over.any():
        windows = stage(docs.select("text", *ROW).mapInArrow(_windows(shared, window, prefix), LOOSE), "windows")
        loose = windows.where("key IS NOT NULL")
        nodes = stage(loose.groupBy("key", "key2").agg(F.sum("leaves").alias("all"), F.min("leaves").alias("least")).where("all > 1 AND least = 1").select("key", "key2"), "nodes")
        apart = loose.where("leaves = 1").join(nodes, ["key", "key2"])  # alone in their chunk, not in all
        found = found.union(windows.where("key IS NULL").select(*ROW, "lo", "hi")).union(apart.select(*ROW, "lo", "hi"))
    found = stage(found.groupBy(*ROW).agg(F.collect_set(F.struct("lo", "hi")).alias("found")), "found")

    # Only texts with repeats move, to meet them.
    hit = context.broadcast(bitmap(found.select(place(F.col("text_id")))))
    rows = docs.withColumn("place", place(F.col("text_id")))
    out = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    none = rows.select("doc_id", "text", "place").mapInArrow(_whole(hit, window), out)
    some = rows.mapInArrow(_touched(hit), "doc_id long, d long, text string, text_id long")
    some = some.join(found, list(ROW), "left").select("doc_id", "text", "found")
    return none.union(some.mapInArrow(_finish(window), out))
