"""Benchmark passages in documents, by SimHash of item-sized windows.

For every benchmark length, windows of that many words are fingerprinted and compared with the
items of that length. Only windows that hold enough benchmark shingles to reach the similarity
at all are fingerprinted (a bitmap of the items' shingles, of fixed size, tells; a false yes
costs work, never a result). Fingerprints are cut into BLOCKS blocks; two within RADIUS bits
differ by at most RADIUS // BLOCKS bits in some block, so items are filed under all such values of
each block and every pair within RADIUS meets. The exact similarity of the weighted shingles
(sum of the lesser over sum of the greater counts) then decides.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bitmap import BITS, bitmap, marked
from ._stage import stage
from ._text import U, Words, chunks, long_lists, mix

SHINGLE = 5
BLOCKS, RADIUS = 8, 23
_VARIANTS = [0, *(1 << a for a in range(8)), *((1 << a) | (1 << b) for a, b in combinations(range(8), 2))]


def _weighted(grams: np.ndarray) -> np.ndarray:
    """Shingles numbered by occurrence, so that set overlaps are those of the counts."""
    order = np.argsort(grams, kind="stable")
    sorted_ = grams[order]
    first = np.searchsorted(sorted_, sorted_)
    return mix(sorted_ + (np.arange(len(sorted_)) - first).astype(U) * U(0x9E3779B97F4A7C15))


def _simhash(grams: np.ndarray) -> np.ndarray:
    """The fingerprint's bytes: each bit is the majority of the shingles' bits."""
    bits = np.unpackbits(grams.view(np.uint8).reshape(len(grams), 8), axis=1)
    return np.packbits(bits.sum(0, dtype=np.int64) * 2 > len(grams))


def _short(words: Words, r: int) -> np.ndarray:
    """Shingles of row r; fewer words than a shingle are one."""
    a, b = words.first[r], words.first[r + 1]
    if b - a < SHINGLE:
        return mix(np.array([words.hash[a:b].sum() + U(b - a)], U)) if b > a else np.zeros(0, U)
    return words.grams(SHINGLE)[0][a : b - SHINGLE + 1]


def _items(batches):
    for batch in batches:
        ids = batch.column("item_id")
        for lo, hi, data, offsets in chunks(batch.column("text")):
            words = Words(data, offsets, lower=True)
            rows = [(r, _short(words, r - lo)) for r in range(lo, hi) if words.first[r - lo + 1] > words.first[r - lo]]
            if rows:
                size = [int(words.first[r - lo + 1] - words.first[r - lo]) for r, _ in rows]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array([r for r, _ in rows])), pa.array(size, pa.int32()), long_lists([g for _, g in rows]), pa.array([_simhash(g).tobytes() for _, g in rows], pa.binary())], ["item_id", "size", "grams", "print"])


def least_shared(shingles: int, percent: int) -> int:
    """Shingles that two windows of as many must share to be ``percent`` similar."""
    return -(-2 * shingles * percent // (100 + percent))


def _windows(shared, percent: int):
    def run(batches):
        bits, sizes = shared.value
        for batch in batches:
            ids = batch.column("doc_id")
            for lo, hi, data, offsets in chunks(batch.column("text")):
                words = Words(data, offsets, lower=True)
                grams, inside = words.grams(SHINGLE)
                known = inside & marked(bits, (grams & U(BITS - 1)).astype(np.int64))
                total = np.concatenate([[0], np.cumsum(known)])
                found = []
                rows = np.unique(words.row[np.flatnonzero(known)]) if known.any() else []
                for r in rows:
                    a, b = words.first[r], words.first[r + 1]
                    for size in sizes:
                        n = size - SHINGLE + 1
                        if n < 1 or b - a < size:
                            continue
                        at = np.arange(a, b - size + 1)
                        for s in at[total[at + n] - total[at] >= least_shared(n, percent)]:
                            found.append((r + lo, size, s - a, grams[s : s + n]))
                # Windows shorter than a shingle are compared whole.
                for size in [s for s in sizes if s < SHINGLE]:
                    for r in np.flatnonzero(np.diff(words.first) >= size):
                        for s in range(words.first[r], words.first[r + 1] - size + 1):
                            h = mix(np.array([words.hash[s : s + size].sum() + U(size)], U))
                            if marked(bits, (h & U(BITS - 1)).astype(np.int64))[0]:
                                found.append((r + lo, size, s - words.first[r], h))
                if found:
                    c = list(zip(*found))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(c[0])), pa.array(c[1], pa.int32()), pa.array(c[2], pa.int64()), long_lists([_weighted(g) for g in c[3]]), pa.array([_simhash(g).tobytes() for g in c[3]], pa.binary())], ["doc_id", "size", "start", "shingles", "print"])

    return run


def _filed(variants: bool):
    """A row for each block of a fingerprint, or each value near it."""

    def run(batches):
        for batch in batches:
            bits = np.frombuffer(b"".join(batch.column("print").to_pylist()), np.uint8).reshape(-1, BLOCKS).astype(np.int32)
            near = np.array(_VARIANTS if variants else [0], np.int32)
            value = (bits[:, :, None] ^ near) | (np.arange(BLOCKS, dtype=np.int32) << 8)[None, :, None]
            row = np.repeat(np.arange(len(bits)), BLOCKS * len(near))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(row)) for c in batch.schema.names), pa.array(value.reshape(-1))], [*batch.schema.names, "block"])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = 80) -> DataFrame:
    """``docs(doc_id, text)``, ``benchmark(item_id, text)`` -> ``(doc_id, item_id, start, similarity)``.

    A row for each document and item of which it holds a window (as many words as the item, A-Z
    lower-cased) with similarity of ``percent`` or more over five-word shingles: the best
    similarity and the first word where it starts. Null and empty texts hold and are nothing;
    repeated rows are found once; null ids are kept. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = stage(items.distinct().mapInArrow(_items, "item_id long, size int, grams array<long>, print binary"), "items")
    known = bitmap(items.select(F.explode("grams").alias("g")).select(F.col("g").bitwiseAND(F.lit(BITS - 1))))  # 8 MB whatever the benchmark
    sizes = sorted(r.size_ for r in items.select(F.col("size").alias("size_")).distinct().collect())  # a number for each length of item
    shared = docs.sparkSession.sparkContext.broadcast((known, sizes))
    windows = stage(docs.mapInArrow(_windows(shared, percent), "doc_id long, size int, start long, shingles array<long>, print binary"), "windows")
    # Equal windows of many documents are compared once.
    windows = windows.withColumn("sig", F.xxhash64("shingles"))
    kinds = stage(windows.groupBy("size", "sig").agg(F.first("print").alias("print"), F.first("shingles").alias("shingles")), "kinds")
    keyed = kinds.select("size", "sig", "print").mapInArrow(_filed(False), "size int, sig long, print binary, block int")
    filed = items.select("item_id", "size", "print").mapInArrow(_filed(True), "item_id long, size int, print binary, block int").withColumnRenamed("print", "item_print")
    as_long = lambda c: F.conv(F.hex(c), 16, -10).cast("long")
    met = keyed.join(filed, ["size", "block"]).where(F.bit_count(as_long("print").bitwiseXOR(as_long("item_print"))) <= RADIUS)
    met = met.select("size", "sig", "item_id").distinct()
    whole = items.mapInArrow(_numbered, "item_id long, size int, item_shingles array<long>").distinct()
    both = met.join(kinds.drop("print"), ["size", "sig"])
    both = both.join(whole.withColumnRenamed("item_id", "item").withColumnRenamed("size", "item_size"), F.col("item_id").eqNullSafe(F.col("item")) & (F.col("size") == F.col("item_size")))
    inter = F.size(F.array_intersect("shingles", "item_shingles"))
    scored = both.select("size", "sig", "item_id", (inter / (F.size("shingles") + F.size("item_shingles") - inter)).alias("similarity")).where(F.col("similarity") * 100 >= percent - 1e-9)
    found = windows.select("doc_id", "size", "sig", "start").join(stage(scored, "scored"), ["size", "sig"])
    return found.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("best")).select("doc_id", "item_id", (-F.col("best.back")).alias("start"), F.round("best.similarity", 9).alias("similarity"))


def _numbered(batches):
    for batch in batches:
        grams = [np.array(g, np.int64).view(U) for g in batch.column("grams").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), batch.column("size"), long_lists([_weighted(g) for g in grams])], ["item_id", "size", "item_shingles"])
