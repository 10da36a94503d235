"""Exact duplicates by a tree-merge of sorted digest runs.

Tasks digest their texts and sort the digests into runs. Every run belongs to a node; the nodes
number ``fan ** rounds``. In a round nodes that differ in one digit exchange: each keeps the
digests that have its own digit there and sends the others, so after all rounds a node holds one
share of all digests (a round is three binomial exchanges at once where ``fan`` is 8). What a node
receives are sorted runs, at most one from each of ``fan`` nodes; it merges them and keeps of equal
digests the row that stays and the number of rows. Digests count as equal only if all 256 bits and
the lengths of the normalised texts agree; the order of a run is by the first 64 bits first.

However many copies a text has, a node sends it on once, so no key gets more than ``fan`` records
in a merge. The answers go back the same way, round by round, to the rows they came from: no join
ever meets all rows of one digest. Texts are read once and never shuffled.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._stage import stage
from ._text import chunks

#: Ways of a merge, and rows of a run.
FAN, RUN = 8, 16_384
#: A record of a run: the digest, bytes of the normalised text, and of the row that stays code points, id and whether that is null; rows.
RECORD = np.dtype([("digest", "<u8", (4,)), ("size", "<i8"), ("chars", "<i8"), ("none", "u1"), ("id", "<i8"), ("count", "<i8")])
_SPACE = bytes([9, 10, 11, 12, 13, 32])
_SENT = "node long, source long, run binary"


def _digested(rows: int):
    """Digest, normalised bytes and run of each row; a run has at most ``rows`` rows of one task."""

    def run(batches):
        first, seen = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column("text")):
                sizes, digests = [], []
                for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                    text = data[a:b].tobytes().translate(None, _SPACE)
                    sizes.append(len(text))
                    digests.append(hashlib.sha256(text).digest())
                runs = first + (seen + np.arange(hi - lo)) // rows
                seen += hi - lo
                yield pa.RecordBatch.from_arrays([pa.array(runs, pa.int64()), batch.column("doc_id")[lo:hi], batch.column("chars")[lo:hi], pa.array(sizes, pa.int64()), pa.array(digests, pa.binary())], ["run", "doc_id", "chars", "size", "digest"])

    return run


def _of_rows(rows: pa.Table) -> np.ndarray:
    """A record for each row."""
    out = np.zeros(len(rows), RECORD)
    ids = rows.column("doc_id").combine_chunks()
    out["digest"] = np.frombuffer(b"".join(rows.column("digest").to_pylist()), ">u8").reshape(-1, 4)
    out["size"], out["chars"], out["count"] = rows.column("size").to_numpy(), rows.column("chars").to_numpy(), 1
    out["none"], out["id"] = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False)
    return out


def _merged(records: np.ndarray) -> np.ndarray:
    """Records in order, one for each text: most code points first, then the smallest id, null last."""
    d = records["digest"]
    at = np.lexsort((records["id"], records["none"], -records["chars"], records["size"], d[:, 3], d[:, 2], d[:, 1], d[:, 0]))
    records = records[at]
    d, size = records["digest"], records["size"]
    new = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]).any(1) | (size[1:] != size[:-1]))))
    out = records[new]
    out["count"] = np.add.reduceat(records["count"], new)
    return out


def _received(table: pa.Table) -> list[tuple[int, np.ndarray]]:
    return [(s, np.frombuffer(r, RECORD)) for s, r in zip(table.column("source").to_pylist(), table.column("run").to_pylist(), strict=True)]


def _sent(rows: list[tuple[int, int, np.ndarray]]) -> pa.Table:
    node, source, run = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table({"node": pa.array(node, pa.int64()), "source": pa.array(source, pa.int64()), "run": pa.array([r.tobytes() for r in run], pa.binary())})


def _dealt(records: np.ndarray, node: int, level: int, fan: int) -> pa.Table:
    """A sorted run cut by the digit of its digests that the nodes of this round differ in."""
    weight = fan**level
    digit = (records["digest"][:, 1 + level // 8] >> np.uint64(8 * (level % 8))).astype(np.int64) % fan
    base = node - node // weight % fan * weight
    return _sent([(base + int(k) * weight, node, records[digit == k]) for k in np.unique(digit)])


def _answers(to: list[tuple[int, np.ndarray]], answers: np.ndarray, node: int) -> pa.Table:
    """For each run received, the answers to its digests."""
    place = {a["digest"].tobytes() + a["size"].tobytes(): k for k, a in enumerate(answers)}
    return _sent([(source, node, answers[[place[r["digest"].tobytes() + r["size"].tobytes()] for r in run]]) for source, run in to])


def exact_duplicates(docs: DataFrame, fan: int = FAN, run: int = RUN) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, keep_id, group_size, kept, text_sha256)``, a row for each row.

    Texts are equal when they are identical without the characters 0x09-0x0D and 0x20; null counts
    as empty, and all empty texts are one group. Of equal texts the row with the most code points
    stays, of those the one with the smallest doc_id; a null doc_id comes last. Rows that repeat the
    doc_id of the row that stays are kept, too. Other columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.length(text).cast("long").alias("chars"))
    rows = stage(docs.mapInArrow(_digested(run), "run long, doc_id long, chars long, size long, digest binary"), "rows")
    rounds, total = 1, rows.count()
    while fan**rounds * run < total:
        rounds += 1
    rows = rows.withColumn("node", F.pmod(F.xxhash64("run"), F.lit(fan**rounds)))

    def first(key, table):
        return _dealt(_merged(_of_rows(table)), key[0].as_py(), 0, fan)

    def onward(level):
        def merge(key, table):
            return _dealt(_merged(np.concatenate([r for _, r in _received(table)])), key[0].as_py(), level, fan)

        return merge

    def settle(key, table):
        runs = _received(table)
        return _answers(runs, _merged(np.concatenate([r for _, r in runs])), key[0].as_py())

    def back(key, table, answers):
        return _answers(_received(table), np.concatenate([a for _, a in _received(answers)]), key[0].as_py())

    def told(key, table, answers):
        known = {a["digest"].tobytes() + a["size"].tobytes(): a for _, part in _received(answers) for a in part}
        mine = [known[r["digest"].tobytes() + r["size"].tobytes()] for r in _of_rows(table)]
        ids = table.column("doc_id").to_pylist()
        keep = [None if a["none"] else int(a["id"]) for a in mine]
        return pa.table({
            "doc_id": pa.array(ids, pa.int64()), "keep_id": pa.array(keep, pa.int64()), "group_size": pa.array([int(a["count"]) for a in mine], pa.int64()),
            "kept": pa.array([i == k for i, k in zip(ids, keep, strict=True)], pa.bool_()), "text_sha256": pa.array([d.hex() for d in table.column("digest").to_pylist()], pa.string()),
        })

    levels = [stage(rows.groupBy("node").applyInArrow(first, _SENT), "runs-0")]
    for level in range(1, rounds):
        levels.append(stage(levels[-1].groupBy("node").applyInArrow(onward(level), _SENT), f"runs-{level}"))
    answers = levels[-1].groupBy("node").applyInArrow(settle, _SENT)
    for sent in levels[-2::-1]:
        answers = sent.groupBy("node").cogroup(answers.groupBy("node")).applyInArrow(back, _SENT)
    return rows.groupBy("node").cogroup(answers.groupBy("node")).applyInArrow(told, "doc_id long, keep_id long, group_size long, kept boolean, text_sha256 string")
