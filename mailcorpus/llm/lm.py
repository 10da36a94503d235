"""Language-model scores from a log-frequency Bloom filter.

Texts are cut into chunks of whole rows. Each chunk sends every n-gram it holds once, with its
count in the chunk's training rows, to the segment of the filter that the n-gram's hash names.
The task of a segment adds the counts up; a count c becomes the level that numbers the greatest
step not above it (1, 2, 3, 4, 6, 8, 12, ...), and the n-gram is entered once for each level up
to its own. Probing level 1, 2, ... until one is missing gives the count back, rounded down to a
step. The levels go back to the chunks, one byte for each n-gram sent.

All counted n-grams are entered, those seen once too, so the filter grows with the corpus. It is
therefore not broadcast: a segment is as much as one task can hold, there are as many as the
texts need, and n-grams travel to their segment. No n-gram is a hot key, as a chunk sends it once.

The base score uses the exact counts of tokens, which come back beside the levels.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._stage import stage
from ._text import U, Words, chunks, mix

END = U(0xA5A5F00D12345677)
BITS_PER_ENTRY = 12
PROBES = 5
SEGMENTS = 256
SEGMENT_BYTES = 16_000_000
SEGMENTS_PER_TASK = 4
TEXT_BYTES = 6_000_000
STEPS = np.unique(np.ceil(2.0 ** (np.arange(124) / 2) - 1e-9).astype(np.int64))
ROW_GROUPS = {"parquet.block.size": "8000000", "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}
_VALUES = np.concatenate([[0], STEPS])
_GOLD, _ROSE = U(0x9E3779B97F4A7C15), U(0xD1B54A32D192ED03)


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all rows, an end after each row, and the rows' first tokens."""
    words = Words(data, offsets, lower=True)
    return np.insert(words.hash, words.first[1:], END), words.first + np.arange(len(offsets))


def _bigrams(tokens: np.ndarray) -> np.ndarray:
    """Hash of each token with the one before; a row starts after an end."""
    before = np.empty_like(tokens)
    before[0] = END
    before[1:] = tokens[:-1]
    return mix(before * _GOLD + mix(tokens ^ _ROSE))


def _short(gram: np.ndarray) -> np.ndarray:
    """The five low bytes of each n-gram: two of a segment are alike far more rarely than the filter says a false yes."""
    return np.ascontiguousarray(gram.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).view("V5").reshape(-1)


def _long(short: np.ndarray) -> np.ndarray:
    out = np.zeros((len(short), 8), np.uint8)
    out[:, :5] = short.view(np.uint8).reshape(-1, 5)
    return out.view("<u8").reshape(-1).astype(U)


def level_of(count: np.ndarray) -> np.ndarray:
    """How many steps are at most each count."""
    return np.searchsorted(STEPS, count, "right")


def count_of(level: np.ndarray) -> np.ndarray:
    """The greatest count that every n-gram of a level has at least; 0 for level 0."""
    return _VALUES[level]


def _probe(gram: np.ndarray, level: int, i: int, bits: int) -> np.ndarray:
    """The i-th bit of each n-gram at a level."""
    x = mix(gram + U(level * int(_GOLD) % (1 << 64)))
    return ((x + U(i) * ((x >> U(32)) | U(1))) % U(bits)).astype(np.int64)


def build_segment(gram: np.ndarray, count: np.ndarray, bits_per_entry: int = BITS_PER_ENTRY) -> np.ndarray:
    """The packed bits of distinct n-grams with counts of 1 or more, ``bits_per_entry`` for each level entered."""
    level = level_of(count)
    bits = 8 * (int(level.sum()) * bits_per_entry // 8 + 8)
    out = np.zeros(bits, bool)
    for j in range(1, int(level.max(initial=0)) + 1):
        gram = gram[level >= j]
        level = level[level >= j]
        for i in range(PROBES):
            out[_probe(gram, j, i, bits)] = True
    return np.packbits(out, bitorder="little")


def levels(segment: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """The level of each n-gram: how many probes in a row are answered yes."""
    out = np.zeros(len(gram), np.uint8)
    alive = np.arange(len(gram))
    for j in range(1, len(STEPS) + 1):
        x = gram[alive]
        for i in range(PROBES):
            p = _probe(x, j, i, len(segment) * 8)
            hit = (segment[p >> 3] >> (p & 7).astype(np.uint8)) & 1 != 0
            alive, x = alive[hit], x[hit]
        if not len(alive):
            break
        out[alive] = j
    return out


def _packed(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary column that holds the values from each bound to the next."""
    values = np.ascontiguousarray(values)
    offsets = (bounds * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values)])


def _unpacked(column: pa.ChunkedArray, dtype) -> tuple[np.ndarray, np.ndarray]:
    """The values of a binary column, and where each row's begin and end."""
    parts = [column] if isinstance(column, pa.Array) else column.chunks
    values, sizes = [np.zeros(0, dtype)], [np.zeros(1, np.int64)]
    for part in parts:
        part = part.cast(pa.large_binary())
        offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
        if len(part) and offsets[-1] > offsets[0]:
            values.append(np.frombuffer(part.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].copy().view(dtype))
        sizes.append(np.diff(offsets) // np.dtype(dtype).itemsize)
    return np.concatenate(values), np.cumsum(np.concatenate(sizes))


def _chunk_rows(batches):
    """Texts, compressed, and what is returned with them, as one row for each chunk."""
    k = TaskContext.get().partitionId() << 32
    for batch in batches:
        for lo, hi, data, offsets in chunks(batch.column("text"), TEXT_BYTES):
            whole = pa.array([0, hi - lo], pa.int32())
            ids, held = (pa.ListArray.from_arrays(whole, pa.concat_arrays([batch.column(name)[lo:hi]])) for name in ("doc_id", "held_out"))
            ends = pa.ListArray.from_arrays(pa.array([0, hi - lo + 1], pa.int32()), pa.array(offsets, pa.int64()))
            text = pa.array([pa.compress(np.ascontiguousarray(data), codec="zstd", asbytes=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), ids, held, ends, text, pa.array([len(data)], pa.int64())], ["chunk", "ids", "held", "ends", "data", "size"])
            k += 1


def _chunk(row) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts of a chunk."""
    offsets = row["ends"].values.to_numpy()
    size = int(offsets[-1])
    return np.frombuffer(pa.decompress(row["data"].as_py(), size, "zstd") if size else b"", np.uint8), offsets


def _dealt(gram: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """An order by segment of distinct sorted n-grams, and the segments in that order."""
    segment = (mix(gram ^ _ROSE) & U(segments - 1)).astype(np.int32)
    order = np.argsort(segment, kind="stable")
    return order, segment[order]


def _sent(segments: int):
    """For each chunk and segment: its unigrams and bigrams there, and their counts in training rows."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                data, offsets = _chunk({name: batch.column(name)[k] for name in ("data", "ends")})
                tokens, first = _tokens(data, offsets)
                trains = np.repeat(~batch.column("held")[k].values.to_numpy(zero_copy_only=False), np.diff(first))
                kinds = []
                for grams, form in ((tokens, np.asarray), (_bigrams(tokens), _short)):
                    gram, back = np.unique(grams, return_inverse=True)
                    count = np.bincount(back, trains, len(gram)).astype(np.int32)
                    order, segment = _dealt(gram, segments)
                    kinds.append((form(gram[order]), count[order], segment))
                used = np.union1d(kinds[0][2], kinds[1][2])
                columns = []
                for gram, count, segment in kinds:
                    bounds = np.append(np.searchsorted(segment, used), len(segment))
                    columns += [_packed(gram, bounds), _packed(count, bounds)]
                chunk = np.full(len(used), batch.column("chunk")[k].as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(chunk), *columns], ["segment", "chunk", "gram1", "c1", "gram2", "c2"])

    return run


def _answered(bits_per_entry: int):
    """The rows sent to a segment -> the exact count and level of their unigrams, the level of their
    bigrams; and a row with chunk -1: tokens, distinct tokens and rounded counts of the segment."""

    def run(table: pa.Table) -> pa.Table:
        kinds = []
        for n, dtype, form in (("1", U, np.asarray), ("2", "V5", _long)):
            sent, bounds = _unpacked(table.column(f"gram{n}"), dtype)
            gram, back = np.unique(form(sent), return_inverse=True)
            count = np.bincount(back, _unpacked(table.column(f"c{n}"), np.int32)[0], len(gram)).astype(np.int64)
            kinds.append((gram, back, count, bounds))
        gram, count = (np.concatenate([kinds[0][k], kinds[1][k]]) for k in (0, 2))
        segment = build_segment(gram[count > 0], count[count > 0], bits_per_entry)
        (one, back1, exact, bounds1), (two, back2, _, bounds2) = kinds
        level = levels(segment, one)
        n, none = table.num_rows, np.zeros(2, np.int64)
        zeros = np.zeros(n, np.int64)
        sums = [int(exact.sum()), int((exact > 0).sum()), int(count_of(level)[exact > 0].sum())]
        names = ["segment", "chunk", "exact", "level1", "level2", "total", "kinds", "mass"]
        rows = [table.column("segment").combine_chunks(), table.column("chunk").combine_chunks(), _packed(exact[back1], bounds1), _packed(level[back1], bounds1), _packed(levels(segment, two)[back2], bounds2), *(pa.array(zeros) for _ in sums)]
        last = [table.column("segment").combine_chunks()[:1], pa.array([-1], pa.int64()), *(_packed(np.zeros(0, np.uint8), none) for _ in range(3)), *(pa.array([x], pa.int64()) for x in sums)]
        return pa.concat_tables([pa.Table.from_arrays(x, names=names) for x in (rows, last)])

    return run


def _score(segments: int, total: int, kinds: int, mass: int, weight: float):
    """A chunk and the answers to it -> a row for each of its texts."""

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        data, offsets = _chunk({name: texts.column(name)[0] for name in ("data", "ends")})
        tokens, first = _tokens(data, offsets)
        answers = answers.sort_by("segment")

        def of(grams: np.ndarray, *columns) -> list[np.ndarray]:
            gram, back = np.unique(grams, return_inverse=True)
            order, _ = _dealt(gram, segments)
            out = []
            for name, dtype in columns:
                values = np.empty(len(gram), dtype)
                values[order] = _unpacked(answers.column(name), dtype)[0]
                out.append(values[back])
            return out

        exact, level1 = of(tokens, ("exact", np.int64), ("level1", np.uint8))
        (level2,) = of(_bigrams(tokens), ("level2", np.uint8))
        before = np.empty(len(tokens), np.int64)
        before[0] = exact[first[1] - 1]  # an end
        before[1:] = exact[:-1]
        alone = (count_of(level1) + 1) / (mass + kinds + 1)
        follows = np.minimum(1, count_of(level2) / np.maximum(before, 1))
        p = np.where(before > 0, weight * follows + (1 - weight) * alone, alone)
        starts = first[:-1]
        n = np.diff(first)
        base = np.add.reduceat(np.log10(exact + 1), starts) - n * np.log10(total + kinds + 1)
        known = np.add.reduceat((exact > 0).astype(np.int64), starts)
        ids, held = (texts.column(name)[0].values for name in ("ids", "held"))
        return pa.Table.from_arrays([ids, held, pa.array(n.astype(np.int64)), pa.array(known), pa.array(base), pa.array(np.add.reduceat(np.log10(p), starts))], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


def lm_scores(docs: DataFrame, held_out: Column, weight: float = 0.2, bits_per_entry: int = BITS_PER_ENTRY) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)``.

    A row for each row. Counts come from the rows where ``held_out`` is false or null. Null and
    empty texts are one end token. ``base_score`` is the add-one unigram log10 probability with
    exact counts. ``score`` is log10 of the product of ``weight`` x c'(v, w) / c(v) +
    (1 - ``weight``) x (c'(w) + 1) / (sum of c' + V + 1), where c' is a count as the filter gives
    it; tokens after an unseen one take the second part alone. As c' is rounded down, the
    probabilities after v add up to at most 1, but for false yeses of the filter. Repeated rows
    are scored and counted each; without training rows every count is 0. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    texts = stage(docs.mapInArrow(_chunk_rows, "chunk long, ids array<long>, held array<boolean>, ends array<long>, data binary, size long"), "texts", **ROW_GROUPS)
    size = texts.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    segments = SEGMENTS
    while segments * SEGMENT_BYTES < size:
        segments *= 2
    tasks = segments // SEGMENTS_PER_TASK
    sent = texts.mapInArrow(_sent(segments), "segment int, chunk long, gram1 binary, c1 binary, gram2 binary, c2 binary")
    answers = stage(sent.repartition(tasks, "segment").groupBy("segment").applyInArrow(_answered(bits_per_entry), "segment int, chunk long, exact binary, level1 binary, level2 binary, total long, kinds long, mass long"), "answers")
    total, kinds, mass = answers.where("chunk = -1").agg(*(F.coalesce(F.sum(x), F.lit(0)) for x in ("total", "kinds", "mass"))).first()
    back = answers.where("chunk >= 0").select("chunk", "segment", "exact", "level1", "level2").repartition(tasks, "chunk").groupBy("chunk")
    scores = texts.drop("size").repartition(tasks, "chunk").groupBy("chunk").cogroup(back).applyInArrow(_score(segments, total, kinds, mass, weight), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scores.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
