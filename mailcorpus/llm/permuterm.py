"""Spelling variants by a permuterm index.

Every word, closed by a terminator, is rotated in all ways and the rotations are sorted. Two words
that differ in one replaced letter have rotations that end in that letter and are alike before it;
a word without one letter of another is, rotated to the same place, the whole of what comes before
that letter. So each neighbour is found in one prefix range: the rotations that begin with
all but the edited letter. One scan of the sorted rotations sees every range as a run of rows.

A range has at most one row for each letter of the alphabet and one for the shorter word, whatever
the corpus. No pairs leave the scan: each row of a range gets the number of its neighbours there
and the best of them.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._stage import stage

LEAST_LENGTH, LEAST_COUNT, RATIO, ERROR = 6, 5, 5, 199
END = "$"
#: Words that a task counts before it hands its counts on.
FLUSH = 200_000
#: Ranges of longer prefixes go by 127 bits of a polynomial hash, so that long words cost no quadratic space.
LONG = 64
_PRIME, _RADIX = (1 << 127) - 1, 0x9E3779B97F4A7C15F39CC0605CEDC835 >> 1
_SLICE = 256


def _counts(least: int, error: int):
    """Words of texts with their counts, summed over what a task has read so far."""
    # A run of fewer letters can give no word: the pattern finds maximal runs of at least so many.
    runs = re.compile(f"[a-zÀ-ÿ]{{{least},}}")

    def out(seen):
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    def run(batches):
        seen: Counter[str] = Counter()
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for lo in range(0, len(ids), _SLICE):
                texts = pc.ascii_lower(batch.column("text")[lo : lo + _SLICE]).to_pylist()
                for i, text in zip(ids[lo:], texts, strict=False):
                    start = None if i is None else zlib.crc32(b"%d:" % i)
                    for word, n in Counter(runs.findall(text or "")).items():
                        if start is not None:
                            h = zlib.crc32(word.encode(), start)
                            if h % error == 0:
                                at = h % len(word)
                                word = word[:at] + word[at + 1 :]
                        seen[word] += n
                if len(seen) >= FLUSH:
                    yield out(seen)
                    seen.clear()
        if seen:
            yield out(seen)

    return run


def _rotations(batches):
    """``(prefix, last, id, n, first)``: rotations without the edited letter, and whole ones (``last`` empty)."""
    for batch in batches:
        rows = []
        for i, word, n in zip(*(batch.column(c).to_pylist() for c in ("id", "word", "n")), strict=True):
            m, twice = len(word), (word + END) * 2
            name = _names(twice)
            for k, letter in enumerate(word):
                # The first of equal letters side by side stands for all of them where the letter is left out.
                rows.append((name(k + 1, m), letter, i, n, k == 0 or word[k - 1] != letter))
            rows += [(name(k, m + 1), "", i, n, False) for k in range(m + 1)]
            if len(rows) > 50_000:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)


def _names(twice: str):
    """The name of a prefix, which is a stretch of the doubled word: itself or, if long, its length and hash."""
    if len(twice) // 2 + 1 <= LONG:
        return lambda at, length: twice[at : at + length]
    total, power = [0], [1]
    for c in twice:
        total.append((total[-1] * _RADIX + ord(c)) % _PRIME)
        power.append(power[-1] * _RADIX % _PRIME)

    def name(at, length):
        return twice[at : at + length] if length <= LONG else f"{length}#{(total[at + length] - total[at] * power[length]) % _PRIME:x}"

    return name


def _batch(rows):
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["prefix", "last", "id", "n", "first"])


def _scanned(batches):
    """Per row of a range the number of its neighbours there and the best one: largest n, then first in order."""
    held: list[tuple] = []
    prefix = None
    for batch in batches:
        out: list[tuple] = []
        for p, *row in zip(*(batch.column(c).to_pylist() for c in ("prefix", "last", "id", "n", "first")), strict=True):
            if p != prefix:
                _neighbours(held, out)
                prefix, held = p, []
            held.append(row)
        yield _found(out)
    out = []
    _neighbours(held, out)
    yield _found(out)


def _neighbours(held: list, out: list) -> None:
    if len(held) < 2:
        return
    whole = [r for r in held if r[0] == ""]
    edited = [r for r in held if r[0] != ""]
    for last, i, _, first in edited:
        # A word with its letter replaced, or left out.
        near = [r for r in edited if r[0] != last] + (whole if first else [])
        _best(i, near, out)
    for _, i, _, _ in whole:
        _best(i, [r for r in edited if r[3]], out)


def _best(i: int, near: list, out: list) -> None:
    if near:
        top = min(near, key=lambda r: (-r[2], r[1]))
        out.append((i, len(near), top[2], top[1]))


def _found(out):
    columns = list(zip(*out, strict=True)) or [(), (), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["id", "near", "best_n", "best"])


def spelling_variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO, error: int = ERROR) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(word, form, root, n, n_near, form_n)``, a row for each frequent word.

    Words are maximal runs of A-Z, a-z and U+00C0-U+00FF, A-Z in lower case. Where ``error`` divides
    the crc32 of ``<doc_id>:<run>``, one letter of the run is left out (of no run where doc_id is
    null). Words have ``least_length`` code points and occur ``least_count`` times. ``form`` is the
    near word (one letter inserted, deleted or replaced) of largest n, of these the first in
    code-point order, if it occurs ``ratio`` times as often; ``root`` is where forms lead in the end.
    Null texts have no words; repeated rows count each; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = docs.mapInArrow(_counts(least_length, error), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = stage(counts.where((F.col("n") >= least_count) & (F.length("word") >= least_length)), "counts")
    # Ids that rise in code-point order, so that ties are decided without the words.
    words = stage(counts.repartitionByRange("word").sortWithinPartitions("word").withColumn("id", F.monotonically_increasing_id()), "words")
    rotations = stage(words.mapInArrow(_rotations, "prefix string, last string, id long, n long, first boolean"), "rotations")
    found = rotations.repartitionByRange("prefix").sortWithinPartitions("prefix", "last").mapInArrow(_scanned, "id long, near long, best_n long, best long")
    near = found.groupBy("id").agg(F.sum("near").alias("n_near"), F.max(F.struct("best_n", (-F.col("best")).alias("order"))).alias("top"))
    near = near.select("id", "n_near", F.col("top.best_n").alias("form_n"), (-F.col("top.order")).alias("form"))
    rows = words.join(near, "id", "left").select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), *(F.when(F.col("form_n") >= F.col("n") * ratio, F.col(c)).alias(c) for c in ("form", "form_n")))
    rows = stage(rows, "forms")
    spelled = words.select("id", "word")
    rows = rows.join(_roots(rows.select("id", "form").where("form IS NOT NULL")), "id", "left").withColumn("root", F.coalesce("root", "id"))
    rows = rows.join(spelled.toDF("form", "form_word"), "form", "left").join(spelled.toDF("root", "root_word"), "root")
    return rows.select("word", F.col("form_word").alias("form"), F.col("root_word").alias("root"), "n", "n_near", "form_n")


def _roots(forms: DataFrame) -> DataFrame:
    """``(id, form)`` -> ``(id, root)``: pointers jump twice as far in each round.

    Counts grow along a chain, so it has no cycle and at most as many links as its last count has digits.
    """
    at = stage(forms.withColumnRenamed("form", "root"), "roots")
    while True:
        further = at.select(F.col("id").alias("root"), F.col("root").alias("further"))
        step = stage(at.join(further, "root", "left").select("id", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        at = step.select("id", "root")
        if step.where("moved").isEmpty():
            return at
