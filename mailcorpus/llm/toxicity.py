"""Toxicity by averaged subword embeddings and a linear softmax.

A word is the bag of its character n-grams of 3 to 7 bytes, with word ends marked, and of itself; each has
an embedding, so an unseen misspelling shares most of its vectors with the word it hides. A
passage of PASSAGE words is the average of its words' averages; a softmax over it gives
P(toxic). Embeddings and softmax are trained jointly, with Adagrad, in numpy, in as many steps for any
sample. Labels belong to documents, so later steps use only the passages of toxic documents that
look toxic by then, and of clean documents mostly the suspicious ones. A document's
logit is that of its worst passage, so one insult in a long text still counts; a
logistic fit on a fifth of the sample, kept aside, turns logits into scores.

The classifier is fitted by one task on at most ``sample`` labelled documents of each class,
taken whole in the order of a hash of their ids; a text that no longer fits into the
``sample * sample_bytes`` bytes of its class is passed over. So long texts lower the number of documents, and
no text is cut.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._stage import stage
from ._text import U, Words, _powers, chunks, mix

BUCKETS = 1 << 18
WIDTH = 8
PASSAGE, STRIDE, LEAST = 64, 32, 16
#: Bytes of the subwords. Letters beyond ASCII take two, so a marked beginning of a word needs the longest.
SIZES = (3, 4, 5, 7)
#: Subwords of fewer labelled documents are left out: they are remembered, not learned. At sf0.1 documents held out are
#: caught as often with 3 as with 12; beyond that words of a few documents are lost.
COMMON = 6
#: Averages are multiplied by this before the softmax: one word in a passage must be able to decide.
SCALE = 50.0
RATE = 0.1
#: Training steps, whatever the sample; each takes BATCH passages, half of them of toxic documents.
STEPS, BATCH = 1200, 64
#: Adagrad divides by the root of what a subword has gathered and of this. Without it a subword that is met once takes a
#: whole step, and the model learns its sample by heart (on documents held out of sf0.1, at 1 % false alarms, recall is
#: 0.64 without it and about 0.80 with it).
DAMP = 1e-4
#: Share of toxic documents at which scores are probabilities. It is larger than theirs in a corpus: with their true share no
#: clean document of 1 200 held out was rejected, and 40 % of the toxic ones were caught.
PRIOR = 0.45
#: The pools are chosen anew so often in the second half.
RENEWALS = 4
_MARKS = np.frombuffer(b"<>", np.uint8)


def _subwords(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every subword of the given words, and which word each belongs to."""
    length = end - start
    head = np.concatenate([[0], np.cumsum(length + 2)])
    flat = np.empty(head[-1], np.uint8)
    owner = np.repeat(np.arange(len(start)), length + 2)
    place = np.arange(head[-1]) - head[owner]
    inner = (place > 0) & (place <= length[owner])
    flat[inner] = data[(start[owner] + place - 1)[inner]]
    flat[place == 0], flat[place == length[owner] + 1] = _MARKS
    power, inverse = _powers("byte", len(flat) + 1)
    total = np.zeros(len(flat) + 1, U)
    np.cumsum((flat.astype(U) + U(1)) * U(0x632BE59BD9B4E019) * power[: len(flat)], out=total[1:])
    ends = head[owner + 1]
    buckets, words = [], []
    for size in (*SIZES, 0):
        if size:
            at = np.flatnonzero(place + size <= length[owner] + 2)
            stop = at + size
        else:
            at = head[:-1]
            stop = head[1:]
        h = mix((total[stop] - total[at]) * inverse[at] + U(size))
        buckets.append((h & U(BUCKETS - 1)).astype(np.int32))
        words.append(owner[at])
    return np.concatenate(buckets), np.concatenate(words)


def _passages(first: int, last: int) -> list[tuple[int, int]]:
    """The passages of words first..last; the last one reaches back to be whole."""
    n = last - first
    if n <= PASSAGE:
        return [(first, last)]
    at = list(range(first, last - PASSAGE, STRIDE)) + [last - PASSAGE]
    return [(a, a + PASSAGE) for a in at]


class _Sample:
    """Labelled documents as passages of distinct words."""

    def __init__(self, texts: pa.Array):
        seen: dict[int, int] = {}
        places, buckets, counts, spans, docs, first = [], [], [], [], [], 0
        for lo, hi, data, offsets in chunks(texts):
            words = Words(data, offsets, lower=True)
            every, one, back = np.unique(words.hash, return_index=True, return_inverse=True)
            names = np.array([seen.setdefault(h, len(seen)) for h in every.tolist()], np.int32)
            fresh = np.flatnonzero(names >= sum(map(len, counts)))
            bucket, owner = _subwords(words.data, words.start[one[fresh]], words.end[one[fresh]])
            buckets.append(bucket[np.argsort(owner, kind="stable")])
            # Names follow the order of the hashes, as do the fresh words here.
            counts.append(np.bincount(owner, minlength=len(fresh)))
            places.append(names[back])
            spans += [(lo + d, first + p, first + q) for d in range(hi - lo) for p, q in _passages(words.first[d], words.first[d + 1])]
            docs += [(first + words.first[d], first + words.first[d + 1]) for d in range(hi - lo)]
            first += len(words)
        whole = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
        self.word, self.bucket = whole(places, np.int32), whole(buckets, np.int32)
        self.first = np.concatenate([[0], np.cumsum(whole(counts, np.int64))])
        self.doc, self.lo, self.hi = np.array(spans, np.int64).reshape(-1, 3).T
        self.docs = len(docs)
        # Subwords of fewer than COMMON documents are left out.
        seen_in = np.zeros(BUCKETS, np.int64)
        for a, b in docs:
            word = np.unique(self.word[a:b])
            n = self.first[word + 1] - self.first[word]
            sub = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[word], n)
            seen_in[np.unique(self.bucket[sub])] += 1
        self.common = seen_in >= COMMON

    def batch(self, passages: np.ndarray):
        """Distinct words of some passages: their subwords, and passage/word/weight triples."""
        size = self.hi[passages] - self.lo[passages]
        row = np.repeat(np.arange(len(passages)), size)
        at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.lo[passages], size)
        pair = np.unique(row * len(self.first) + self.word[at])
        row, one = np.divmod(pair, len(self.first))
        size = np.bincount(row, minlength=len(passages))
        word, back = np.unique(one, return_inverse=True)
        n = self.first[word + 1] - self.first[word]
        sub = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[word], n)
        bucket, owner = self.bucket[sub], np.repeat(np.arange(len(word)), n)
        use = self.common[bucket]
        return bucket[use], owner[use], n, row, back, SCALE / np.maximum(size, LEAST)


def _spread(index: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(index, values[:, k], n) for k in range(values.shape[1])], 1)


def _forward(model, x):
    e, w, b = model[:3]
    bucket, word, n, row, back, scale = x
    words = _spread(word, e[bucket], len(n)) / n[:, None]
    mean = _spread(row, words[back], len(scale)) * scale[:, None]
    return mean, mean @ w + b


def _step(model, x, y: np.ndarray, weight: np.ndarray, rate: float) -> None:
    """One Adagrad step of the softmax loss on embeddings, weights and bias together."""
    e, w, b, ge, gw, gb = model
    bucket, word, n, row, back, scale = x
    mean, logits = _forward(model, x)
    p = np.exp(logits - logits.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    p[np.arange(len(y)), y] -= 1
    p *= weight[:, None] / max(1e-9, weight.sum())
    at_mean = p @ w.T * scale[:, None]
    at_word = _spread(back, at_mean[row], len(n)) / n[:, None]
    touched, local = np.unique(bucket, return_inverse=True)
    at_e = _spread(local, at_word[word], len(touched))
    dw, db = mean.T @ p, p.sum(0)
    ge[touched] += (at_e**2).mean(1, keepdims=True)
    e[touched] -= rate * at_e / np.sqrt(ge[touched] + DAMP)
    gw += dw**2
    w -= rate * dw / np.sqrt(gw + 1e-9)
    gb += db**2
    b -= rate * db / np.sqrt(gb + 1e-9)


def _new_model(rng):
    return [rng.normal(0, 0.05, (BUCKETS, WIDTH)).astype(np.float32), rng.normal(0, 0.5, (WIDTH, 2)), np.zeros(2), np.zeros((BUCKETS, 1), np.float32), np.zeros((WIDTH, 2)), np.zeros(2)]


def _margins(model, sample: _Sample, at: np.ndarray) -> np.ndarray:
    """log P(toxic) - log P(clean) of some passages."""
    parts = [_forward(model, sample.batch(at[lo : lo + 512]))[1] for lo in range(0, len(at), 512)]
    logits = np.concatenate(parts) if parts else np.zeros((0, 2))
    return logits[:, 1] - logits[:, 0]


def _aside(y: np.ndarray, rng) -> np.ndarray:
    """A fifth of each class, one document at least, where a class has two or more."""
    out = np.zeros(len(y), bool)
    for k in (0, 1):
        at = rng.permutation(np.flatnonzero(y == k))
        out[at[: max(1, len(at) // 5)]] = len(at) > 1
    return out


def _pools(margin: np.ndarray, passages: np.ndarray, doc: np.ndarray, y: np.ndarray, rng) -> list[np.ndarray]:
    """Passages of clean documents, the most suspicious of each and some others, and those of toxic documents that look toxic, the worst of each at least."""
    worst = np.full(doc.max() + 1, -np.inf)
    np.maximum.at(worst, doc, margin)
    worst = margin >= worst[doc]
    return [passages[(y == 0) & (worst | (rng.random(len(y)) < 0.3))], passages[(y == 1) & (worst | (margin > 0))]]


def fit(texts: pa.Array, toxic: np.ndarray, prior: float = PRIOR, seed: int = 1) -> tuple[np.ndarray, float, float, float]:
    """The logit of each bucket, the bias, and slope and shift of the score; flat scores without two documents of both classes."""
    y_doc = np.asarray(toxic, np.int64)
    if min(np.bincount(y_doc, minlength=2)) < 2:
        return np.zeros(BUCKETS, np.float32), 0.0, 0.0, -4.0
    sample, rng = _Sample(texts), np.random.default_rng(seed)
    y, every = y_doc[sample.doc], np.arange(len(sample.doc))
    aside = _aside(y_doc, rng)
    teach = every[~aside[sample.doc]]
    model, pools = _new_model(rng), [teach[y[teach] == k] for k in (0, 1)]
    for k in range(STEPS):
        left = STEPS - k
        if left * 2 <= STEPS and left % (STEPS // 2 // RENEWALS) == 0:
            pools = _pools(_margins(model, sample, teach), teach, sample.doc[teach], y[teach], rng)
        at = np.concatenate([rng.choice(pool, BATCH // 2) for pool in pools])
        _step(model, sample.batch(at), y[at], np.ones(BATCH), RATE)
    at = every[aside[sample.doc]]
    worst = np.full(sample.docs, -np.inf)
    np.maximum.at(worst, sample.doc[at], _margins(model, sample, at))
    slope, shift = _logistic(worst[aside], y_doc[aside], prior)
    e, w, b = model[:3]
    return np.where(sample.common, e @ (w[:, 1] - w[:, 0]), 0.0).astype(np.float32), float(b[1] - b[0]), slope, shift


def _fitted(batches):
    """The whole sample, in the order of its ids -> one row, the model."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    rows = pa.Table.from_batches(held)
    rows = rows.take(pa.array(np.argsort(rows.column("doc_id").to_numpy(), kind="stable")))
    logit, *rest = fit(rows.column("text").combine_chunks(), rows.column("toxic").to_numpy())
    yield pa.RecordBatch.from_arrays([pa.array([logit.tobytes()], pa.binary()), *(pa.array([x], pa.float64()) for x in rest)], ["logit", "bias", "slope", "shift"])


def _logistic(x: np.ndarray, y: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope and shift by Newton steps, the classes weighted to ``prior``, targets smoothed as Platt has them."""
    pos, neg = y.sum(), len(y) - y.sum()
    weight = np.where(y == 1, prior / pos, (1 - prior) / neg) * len(y)
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    mid, scale = x.mean(), x.std() + 1e-9
    z = np.stack([(x - mid) / scale, np.ones(len(x))], 1)
    theta = np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ theta, -30, 30)))
        h = (z * (weight * p * (1 - p) + 1e-6)[:, None]).T @ z + 1e-3 * np.eye(2)
        theta += np.clip(np.linalg.solve(h, z.T @ (weight * (t - p)) - 1e-3 * theta), -2, 2)
    return float(theta[0] / scale), float(theta[1] - theta[0] * mid / scale)


def _score(shared):
    def run(batches):
        bucket_logit, bias, slope, shift = shared.value
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column("text")):
                words = Words(data, offsets, lower=True)
                _, one, back = np.unique(words.hash, return_index=True, return_inverse=True)
                bucket, owner = _subwords(words.data, words.start[one], words.end[one])
                mean = np.bincount(owner, bucket_logit[bucket], len(one)) / np.maximum(1, np.bincount(owner, minlength=len(one)))
                spans = [(r, *p) for r in range(hi - lo) for p in _passages(words.first[r], words.first[r + 1])]
                row, first, last = np.array(spans, np.int64).T
                size = last - first
                passage = np.repeat(np.arange(len(row)), size)
                at = np.arange(len(passage)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)
                passage, word = np.divmod(np.unique(passage * len(one) + back[at]), max(1, len(one)))
                size = np.bincount(passage, minlength=len(row))
                logit = np.bincount(passage, mean[word], len(row)) * SCALE / np.maximum(size, LEAST) + bias
                worst = np.maximum.reduceat(logit, np.searchsorted(row, np.arange(hi - lo)))
                score = 1 / (1 + np.exp(-np.clip(slope * worst + shift, -60, 60)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[lo:hi], batch.column("held_out")[lo:hi], pa.array(score)], ["doc_id", "held_out", "score"])

    return run


def _fitting(sizes: list[tuple[int, int, int]], most: int) -> list[int]:
    """Ids of ``(id, class, bytes)`` in order, those of a class with at most ``most`` bytes together; a text that does not fit is passed over."""
    held, out = {0: 0, 1: 0}, []
    for i, k, size in sizes:
        if held[k] + size <= most:
            held[k] += size
            out.append(i)
    return out


def toxicity(docs: DataFrame, labels: DataFrame, held_out: Column, threshold: float = 0.7, sample: int = 1200, sample_bytes: int = 8_000) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, held_out, score, predicted)``, a row for each row.

    ``labels(doc_id, toxic)`` teach where ``held_out`` is false; null labels, ids without a
    document and ids labelled both ways teach nothing; of a repeated id the least text teaches. Null and empty texts are
    scored as no words. A null doc_id is not held out. Without labels of both classes every
    score is the same, below the threshold. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    known = known.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most")
    known = known.withColumn("held_out", F.coalesce(held_out, F.lit(False))).where(~F.col("held_out"))
    # Labels of documents that are not there take no place in the sample.
    known = known.join(docs.select("doc_id"), "doc_id", "left_semi")
    picked = [known.where(F.col("toxic") == k).groupBy("doc_id", "toxic").agg(F.xxhash64("doc_id").alias("at")).orderBy("at", "doc_id").limit(sample) for k in (0, 1)]
    chosen = F.broadcast(picked[0].union(picked[1]).select("doc_id", "toxic"))  # 2 * sample rows
    rows = stage(docs.where(~F.col("held_out")).select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "sample")
    sizes = rows.select("doc_id", "toxic", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    whole = docs.sparkSession.createDataFrame([(i,) for i in _fitting(sizes, sample * sample_bytes)], "doc_id long")
    # One task fits the model; should its executor be lost, another one does.
    model = rows.join(F.broadcast(whole), "doc_id", "left_semi").repartition(1).mapInArrow(_fitted, "logit binary, bias double, slope double, shift double").first()
    logit = np.frombuffer(model.logit, np.float32) if model else np.zeros(BUCKETS, np.float32)
    shared = docs.sparkSession.sparkContext.broadcast((logit, *(model[1:] if model else (0.0, 0.0, -4.0))))
    out = docs.mapInArrow(_score(shared), "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
