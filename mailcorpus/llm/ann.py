"""Nearest neighbours by an inverted file with product-quantised residuals.

Coarse centroids split the vectors into lists; the rest, vector minus centroid, is coded by the
nearest of 256 centres in each of PARTS subspaces. A query probes the lists of its best
centroids, scores their codes from its table of inner products with all centres (asymmetric
distances). In each block the best ``rerank`` by codes are scored exactly; their ``k``-th best
score is a floor, and every other vector whose code leaves it possible to reach the floor (score by
code plus length of the query times error of the code) is scored exactly, too. So codes save work
and lose nothing, also where near copies share a code or few long vectors win everywhere.

The first ``probed`` share of the lists gives each query a floor. All others are asked in a second
round by the queries whose
``k``-th best could be beaten there (inner product with the centroid plus length of the query times
the list's radius). Both bounds hold for any vectors, so the result is the exact one.

Centroids and centres are fitted on the driver on about ``sample`` vectors at most; every vector
is indexed. Lists are cut into blocks of about BLOCK vectors and their queries into blocks of
about ASKING, so a hot list is many pieces of work of the same size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._stage import stage

PARTS, CENTRES = 32, 256
BLOCK, ASKING = 4096, 256
MOST_LISTS = 4096
HELD = 4_000_000
PAIRS = 65_536
#: Bounds are computed in double precision and loosened by this share, more than that rounds off.
ROUNDING = 1e-9


def _kmeans(x: np.ndarray, k: int, rng, rounds: int = 8) -> np.ndarray:
    """k centres (fewer if there are fewer distinct points)."""
    x = x.astype(np.float32)
    distinct = np.unique(x, axis=0)
    if len(distinct) <= k:
        return distinct
    c = distinct[rng.choice(len(distinct), k, replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, c)
        n = np.bincount(near, minlength=k)
        for d in range(x.shape[1]):
            c[:, d] = np.where(n > 0, np.bincount(near, x[:, d], k) / np.maximum(n, 1), c[:, d])
        if (n == 0).any():
            c[n == 0] = x[rng.choice(len(x), int((n == 0).sum()))]
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c**2).sum(1) / 2
    return np.concatenate([(x[lo : lo + 4096] @ c.T - half).argmax(1) for lo in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def _bounds(size: int) -> np.ndarray:
    return np.linspace(0, size, min(PARTS, size) + 1).astype(int)


def _matrix(column: pa.Array, kind=np.float32) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def _index(shared):
    def run(batches):
        coarse, centres = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("v"))
            near = _nearest(x, coarse)
            rest = x - coarse[near]
            at = _bounds(x.shape[1])
            code = np.stack([_nearest(rest[:, a:b], c) for a, b, c in zip(at, at[1:], centres)], 1).astype(np.uint8)
            exact, middle = _matrix(batch.column("v"), np.float64), coarse[near].astype(np.float64)
            coded = middle + np.concatenate([c[code[:, part]] for part, c in enumerate(centres)], 1)
            far, error = (np.linalg.norm(exact - y, axis=1) for y in (middle, coded))
            yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), batch.column("vec_id"), pa.array([row.tobytes() for row in code], pa.binary()), pa.array(error), pa.array(far), batch.column("v")], ["list", "vec_id", "code", "error", "far", "v"])

    return run


def _probe(shared, probes: int, radius=None):
    """The first ``probes`` lists of each query; with ``radius`` of the lists, the later ones that can hold more than its ``floor``."""

    def run(batches):
        coarse, _ = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("v"), np.float64)
            floor = batch.column("floor").to_numpy(zero_copy_only=False)
            near = x @ coarse.astype(np.float64).T
            best = np.argsort(-near, axis=1, kind="stable")
            row, place = np.divmod(np.arange(best.size), best.shape[1])
            list_ = best.reshape(-1)
            if radius is None:
                keep = place < probes
            else:
                long = np.linalg.norm(x, axis=1)[row]
                slack = long * np.linalg.norm(coarse, axis=1).max() * ROUNDING
                keep = (place >= probes) & (near[row, list_] + long * radius.value[list_] * (1 + ROUNDING) >= floor[row] - slack)
            row, list_ = row[keep], list_[keep]
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(list_.astype(np.int32)), batch.column("vec_id").take(take), pa.array(near[row, list_]), pa.array(floor[row]), batch.column("v").take(take)], ["list", "query_id", "bias", "floor", "q"])

    return run


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores, ties to smaller ids."""
    if len(score) > k:
        cut = np.partition(score, len(score) - k)[len(score) - k]
        at = np.flatnonzero(score >= cut)
    else:
        at = np.arange(len(score))
    return at[np.lexsort((ids[at], -score[at]))][:k]


def _inner(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products, summed from the first component to the last as the result's score is."""
    return np.cumsum(x * q, axis=1)[:, -1]


def _search(shared, k: int, rerank: int):
    """Rows of one block of a list and one block of its queries -> each query's ``k`` best, exactly, merged over some rows."""

    def table(held: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), *(pa.array([x[n] for x in held.values()], pa.list_(kind)) for n, kind in enumerate((pa.int64(), pa.float64())))], ["query_id", "ids", "scores"])

    def kth(score: np.ndarray) -> float:
        return np.partition(score, len(score) - k)[len(score) - k] if len(score) >= k else -np.inf

    def run(batches):
        _, centres = shared.value
        held: dict[int, tuple] = {}
        floors: dict[int, float] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                block, asking = batch.column("block")[row].values, batch.column("asking")[row].values
                ids, error = (block.field(f).to_numpy(zero_copy_only=False) for f in ("vec_id", "error"))
                x = _matrix(block.field("v"), np.float64)
                code = np.frombuffer(b"".join(block.field("code").to_pylist()), np.uint8).reshape(len(ids), -1)
                query, bias, floor = (asking.field(f).to_numpy(zero_copy_only=False) for f in ("query_id", "bias", "floor"))
                q = _matrix(asking.field("q"), np.float64)
                score = np.repeat(bias[:, None], len(ids), axis=1)
                at = _bounds(q.shape[1])
                for part, (a, b, c) in enumerate(zip(at, at[1:], centres)):
                    score += (q[:, a:b] @ c.astype(np.float64).T)[:, code[:, part]]
                score[query[:, None] == ids[None, :]] = -np.inf
                long = np.linalg.norm(q, axis=1)
                least = np.maximum(floor, [floors.get(one, -np.inf) for one in query.tolist()])
                for n in np.flatnonzero(np.isneginf(least)):
                    first = _best(score[n], ids, rerank)
                    least[n] = kth(_inner(x[first[np.isfinite(score[n][first])]], q[n]))
                slack = long * np.linalg.norm(x, axis=1).max() * ROUNDING
                asks, open_ = np.nonzero((score + long[:, None] * error >= (least - slack)[:, None]) & np.isfinite(score))
                exact = np.concatenate([_inner(x[open_[lo : lo + PAIRS]], q[asks[lo : lo + PAIRS]]) for lo in range(0, len(open_), PAIRS)] or [np.zeros(0)])
                good = exact >= least[asks]
                asks, open_, exact = asks[good], open_[good], exact[good]
                whose, start = np.unique(asks, return_index=True)
                for n, lo, hi in zip(whose, start, [*start[1:], len(asks)]):
                    one = int(query[n])
                    found, scores = ids[open_[lo:hi]], exact[lo:hi]
                    if one in held:
                        found, scores = np.concatenate([held[one][0], found]), np.concatenate([held[one][1], scores])
                    best = _best(scores, found, k)
                    held[one] = found[best], scores[best]
                    floors[one] = max(least[n], scores[best[-1]] if len(best) == k else -np.inf)
                if len(held) * k > HELD:
                    yield table(held)
                    held = {}
        if held:
            yield table(held)

    return run


def _merged(k: int):
    def run(key, table):
        ids = table.column("ids").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        scores = table.column("scores").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        at = _best(scores, ids, k)
        return pa.table({"query_id": pa.array([key[0].as_py()], pa.int64()), "ids": pa.array([ids[at]], pa.list_(pa.int64())), "scores": pa.array([scores[at]], pa.list_(pa.float64()))})

    return run


def _valid(vectors: DataFrame) -> DataFrame:
    """Vectors that can be compared, as (vec_id, v)."""
    kind = vectors.schema["embedding"].dataType.simpleString()
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind if kind == "array<float>" else "array<double>").alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = v.where(~odd).where(F.exists("v", lambda x: x != 0))
    sizes = v.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").first()
    return v.where(F.size("v") == (sizes.size if sizes else 0))


def nearest(vectors: DataFrame, is_query, k: int = 20, rerank: int = 100, probed: float = 0.1, sample: int = 20_000, seed: int = 7) -> DataFrame:
    """``vectors(vec_id, embedding)`` -> ``(query_id, rank, vec_id, score)``.

    The ``k`` rows with the largest inner product for each row where ``is_query`` holds, itself
    excluded, ties to smaller ids; fewer only where there are fewer vectors. Vectors that are null,
    zero, hold null or non-finite components, have no id or another length than most take no part.
    An id that repeats is one vector (the least by its components). Other columns are ignored.
    """
    v = stage(_valid(vectors).groupBy("vec_id").agg(F.min("v").alias("v")), "vectors")
    n = v.count()
    share = min(1.0, sample / max(1, n))
    fit = v.where(F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000)).toArrow()
    x = _matrix(fit.column("v").combine_chunks()) if fit.num_rows else np.zeros((0, 1), np.float32)
    x = x[np.argsort(fit.column("vec_id").to_numpy())] if len(x) else x
    rng = np.random.default_rng(seed)
    coarse = _kmeans(x, max(1, min(MOST_LISTS, len(x), round(np.sqrt(n)))), rng) if len(x) else np.zeros((1, 1), np.float32)
    rest = x - coarse[_nearest(x, coarse)]
    at = _bounds(x.shape[1])
    centres = [_kmeans(rest[:, a:b], CENTRES, rng) if len(x) else np.zeros((1, 1), np.float32) for a, b in zip(at, at[1:])]
    shared = v.sparkSession.sparkContext.broadcast((coarse, centres))  # at most MOST_LISTS and CENTRES vectors
    probes = max(1, round(len(coarse) * probed))

    def blocks(df: DataFrame, size: int, id_: str, fields: list[str], name: str) -> DataFrame:
        """Rows of a list dealt into blocks of about ``size``."""
        count = F.broadcast(df.groupBy("list").agg(F.count("*").alias("n")))  # a row for each list
        df = df.join(count, "list").withColumn("deal", F.pmod(F.xxhash64(id_), F.ceil(F.col("n") / size)))
        return df.groupBy("list", "deal").agg(F.collect_list(F.struct(*fields)).alias(name)).drop("deal")

    kind = v.schema["v"].dataType.simpleString()
    found_ = "query_id long, ids array<long>, scores array<double>"
    index = stage(v.mapInArrow(_index(shared), f"list int, vec_id long, code binary, error double, far double, v {kind}"), "index")
    listed = blocks(index, BLOCK, "vec_id", ["vec_id", "code", "error", "v"], "block")
    queries = v.where(is_query)

    def answers(asking: DataFrame, probe, name: str) -> DataFrame:
        asked = stage(asking.mapInArrow(probe, f"list int, query_id long, bias double, floor double, q {kind}"), name)
        work = listed.join(blocks(asked, ASKING, "query_id", ["query_id", "bias", "floor", "q"], "asking"), "list")
        return work.select("block", "asking").mapInArrow(_search(shared, k, rerank), found_)

    none = F.lit(float("-inf"))
    best = stage(answers(queries.withColumn("floor", none), _probe(shared, probes), "asked").groupBy("query_id").applyInArrow(_merged(k), found_), "best")
    if probes < len(coarse):
        radius = np.zeros(len(coarse))
        for r in index.groupBy("list").agg(F.max("far").alias("far")).collect():  # a row for each list
            radius[r["list"]] = r.far
        radius = v.sparkSession.sparkContext.broadcast(radius)
        known = best.select(F.col("query_id").alias("vec_id"), F.when(F.size("scores") >= k, F.array_min("scores")).alias("floor"))
        again = queries.join(known, "vec_id", "left").select("vec_id", "v", F.coalesce("floor", none).alias("floor"))
        rest = answers(again, _probe(shared, probes, radius), "asked_again")
        best = best.union(rest).groupBy("query_id").applyInArrow(_merged(k), found_)
    pairs = stage(best.select("query_id", F.explode("ids").alias("vec_id")), "pairs")
    exact = pairs.join(v.select(F.col("vec_id"), F.col("v").alias("x")), "vec_id").join(v.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id")
    score = F.aggregate(F.zip_with("q", "x", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, b: a + b)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return exact.select("query_id", "vec_id", score.alias("score")).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
