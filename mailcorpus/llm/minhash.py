"""Near-duplicate documents by bottom-k sketches.

One hash function ranks the word shingles of a document; its sketch is the smallest values, as
many as the threshold lets a partner lack and a tenth of the set beyond. So two documents at the
threshold have a known number of retained values in common, whatever their sizes. Documents with
the same shingle set form a class that one document stands for. Inverted lists of the retained
values, rarest first and as short as that number allows, give candidate pairs; the union sketch
bounds how much they differ, and the full sets decide. No bound ever rules out a link.

No list is expanded into all its pairs unless it is short. Members of long lists are listed anew
by their full sets; those still crowded share nearly everything. They are compared with a few
pivots of their list; whoever links joins the pivot's component, and who does not is compared with
those members of other components that the sizes, the counts of common values and the parity bits
of the sets leave possible. So components are those of all links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bitmap import BITS, bitmap, marked, place
from ._stage import stage
from ._text import U, Words, chunks, long_lists, mix
from .components import components

#: Values that the union sketch of a pair is made of.
SKETCH = 64
PARITY = 1024
SHORT_LIST = 12
#: Members that each of the first rounds compares the others of a long list with.
ROUNDS = (4,)


def _least(n: int, percent: int) -> int:
    """Common values that a set of n values has with any partner at the threshold."""
    return -(-n * percent // 100)


def _sure(n: int, percent: int) -> int:
    """Retained values of a set that are in the retained or later values of any partner; never falls as n grows."""
    return min(_least(n, percent), max(4, n // 10))


def _kept(n: int, percent: int) -> int:
    """Size of the sketch: what a partner may lack, and ``_sure`` values beyond."""
    return n - _least(n, percent) + _sure(n, percent)


def _sets(words: Words, rows: int, size: int):
    """The sorted distinct shingle hashes of each row; a shorter row is one shingle, an empty row none."""
    grams, inside = words.grams(size)
    for r in range(rows):
        a, b = words.first[r], words.first[r + 1]
        if b - a >= size:
            yield np.unique(grams[a : b - size + 1].view(np.int64))
        elif b > a:
            lone = words.hash[a:b] * (np.arange(1, b - a + 1, dtype=U) * U(2) + U(1))
            yield mix(np.array([lone.sum() + U(b - a)], U)).view(np.int64)
        else:
            yield np.zeros(0, np.int64)


def _sketches(size: int, percent: int):
    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for lo, hi, data, offsets in chunks(batch.column("text")):
                n, need, s1, s2, sketch = [], [], [], [], []
                for s in _sets(Words(data, offsets, lower=True), hi - lo, size):
                    h = s.view(U)
                    n.append(len(s))
                    # The partner may be the smaller set, which is sure of less.
                    need.append(_sure(_least(len(s), percent), percent))
                    s1.append(mix(h ^ U(0x5851F42D4C957F2D)).sum())
                    s2.append(mix(h ^ U(0x14057B7EF767814F)).sum())
                    sketch.append(s[: _kept(len(s), percent)])
                yield pa.RecordBatch.from_arrays([ids[lo:hi], pa.array(n, pa.int64()), pa.array(need, pa.int32()), pa.array(np.array(s1, U).view(np.int64)), pa.array(np.array(s2, U).view(np.int64)), long_lists(sketch)], ["doc_id", "n_shingles", "need", "s1", "s2", "sketch"])

    return run


def _parity(values: np.ndarray) -> np.ndarray:
    """Bits that tell whether an odd number of the values fall on each of PARITY places."""
    odd = np.bincount((values.view(U) & U(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def _full(size: int, shared):
    """Full sets and parities of the rows that the bitmap has."""

    def run(batches):
        for batch in batches:
            batch = batch.filter(pa.array(marked(shared.value, batch.column("place").to_numpy())))
            ids = batch.column("id")
            for lo, hi, data, offsets in chunks(batch.column("text")):
                sets = list(_sets(Words(data, offsets, lower=True), hi - lo, size))
                yield pa.RecordBatch.from_arrays([ids[lo:hi], long_lists(sets), long_lists([_parity(s) for s in sets])], ["id", "full", "parity"])

    return run


def _pairs_of(rows: DataFrame) -> DataFrame:
    return rows.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a <> b").distinct()


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, n_shingles, component_id, kept)``, a row for each row.

    ``size`` words make a shingle, lower-casing A-Z; documents link when
    ``100 * |A & B| >= percent * |A | B|``. Null and empty texts have no shingles and link with
    nothing. Rows of one doc_id are one document for linking. A null doc_id keeps its row; its
    component is that of its copies, or null and kept without any. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = stage(docs.mapInArrow(_sketches(size, percent), "doc_id long, n_shingles long, need int, s1 long, s2 long, sketch array<long>"), "sets")
    classes = stage(sets.where("n_shingles > 0").groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("rep")), "classes")
    nodes = stage(sets.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "need", "s1", "s2", "sketch").join(classes.select(F.col("rep").alias("id"), "s1", "s2"), ["id", "s1", "s2"], "left_semi").dropDuplicates(["id", "s1", "s2"]).select("id", "n", "need", "sketch"), "nodes")

    reached = components(_links(docs, nodes, size, percent)).withColumnRenamed("id", "rep")
    named = classes.join(reached, "rep", "left")
    named = stage(named.select("s1", "s2", "n_shingles", F.coalesce("component", "rep").alias("component_id")), "named")
    out = sets.select("doc_id", "n_shingles", "s1", "s2").join(named, ["s1", "s2", "n_shingles"], "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))


def _links(docs: DataFrame, nodes: DataFrame, size: int, percent: int) -> DataFrame:
    """Verified links that join every component."""
    lists = stage(_prefixes(nodes.withColumnRenamed("sketch", "values")), "narrow")
    short = lists.where(F.col("m") <= SHORT_LIST)
    tried = stage(_pairs_of(_joined(short, short, percent, F.col("l.id") < F.col("r.id"))), "pairs")
    crowd = stage(lists.where(F.col("m") > SHORT_LIST).select("id").distinct(), "crowd")
    ids = stage(tried.select(F.explode(F.array("a", "b")).alias("id")).union(crowd).distinct(), "ids")
    # Texts stay where they are: a bitmap of the ids tells which sets to make.
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(ids.select(place(F.col("id")))))
    texts = docs.withColumnRenamed("doc_id", "id").withColumn("place", place(F.col("id")))
    # Sketches for the union are cut from full sets: those of the nodes may end before SKETCH values, and what lies beyond the
    # end of one is no difference.
    full = texts.mapInArrow(_full(size, shared), "id long, full array<long>, parity array<long>").withColumn("sketch", F.slice("full", 1, SKETCH))
    full = stage(full.join(nodes.select("id", "n").join(ids, "id", "left_semi"), "id").where(F.size("full") == F.col("n")), "full")

    # Members of long lists again, by the whole set: what remains listed then shares nearly
    # everything, not just a passage.
    whole = F.ceil(F.col("n") * percent / F.lit(100)).cast("int")
    lists = stage(_prefixes(full.join(crowd, "id", "left_semi").select("id", "n", whole.alias("need"), F.col("full").alias("values"))), "wide")
    short = lists.where(F.col("m") <= SHORT_LIST)
    pairs = stage(_pairs_of(_joined(short, short, percent, F.col("l.id") < F.col("r.id"))).union(tried).distinct(), "pairs")
    links = _verified(pairs, full, percent)
    long = lists.where(F.col("m") > SHORT_LIST).drop("m")
    full = stage(full.join(long.select("id").distinct(), "id", "left_semi"), "crowded")
    return _crowded(stage(long.join(full.select("id", "parity"), "id"), "long"), full, links, percent)


def _frequent(shared):
    """The values that the bitmap has, most of those that occur once left out."""

    def run(batches):
        for batch in batches:
            values = batch.column("values")
            flat = values.flatten().to_numpy(zero_copy_only=False)
            use = marked(shared.value, flat & (BITS - 1))
            owner = np.repeat(np.arange(len(values)), values.value_lengths().to_numpy(zero_copy_only=False))[use]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(owner)), pa.array(flat[use])], ["id", "v"])

    return run


def _prefixes(nodes: DataFrame) -> DataFrame:
    """``(id, n, need, values)`` -> ``(v, id, n, common, rare, m)``: the lists of values, as short as they can be.

    Of each node its rarest values, as many as any partner with ``need`` common values must meet.
    ``common`` of the node's values occur elsewhere, ``rare`` do not; m nodes list v.
    """
    frequency = nodes.select(F.explode("values").alias("v")).groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
    frequency = stage(frequency, "frequency")
    shared = nodes.sparkSession.sparkContext.broadcast(bitmap(frequency.select(F.col("v").bitwiseAND(F.lit(BITS - 1)))))
    postings = nodes.select("id", "values").mapInArrow(_frequent(shared), "id long, v long")
    ranked = postings.join(frequency, "v").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("ranked"))
    ranked = ranked.join(nodes.select("id", "n", "need", F.size("values").alias("all")), "id")
    common = F.size("ranked")
    rarest = F.slice("ranked", F.lit(1), F.greatest(F.lit(0), common - F.col("need") + 1))
    lists = stage(ranked.select("id", "n", common.alias("common"), (F.col("all") - common).alias("rare"), F.explode(rarest).alias("x")).select("id", "n", "common", "rare", "x.v"), "lists")
    return lists.join(stage(lists.groupBy("v").agg(F.count("*").alias("m")).where("m > 1"), "listed"), "v")


def _joined(left: DataFrame, right: DataFrame, percent: int, also) -> DataFrame:
    """Pairs of ids in one list that can reach the threshold by their sizes and, of full sets, by what they have in common."""
    n = F.col("l.n") + F.col("r.n")
    fits = (F.col("l.n") * 100 >= F.col("r.n") * percent) & (F.col("r.n") * 100 >= F.col("l.n") * percent)
    if "parity" in left.columns:
        most = F.least("l.common", "r.common")
        fits &= (most * 100 >= (n - most) * percent) & _near(n, _apart("l.parity", "r.parity"), percent)
    return left.alias("l").join(right.alias("r"), (F.col("l.v") == F.col("r.v")) & fits & also).select(F.col("l.id").alias("x"), F.col("r.id").alias("y"))


def _apart(left: str, right: str):
    """Bits in which two parities differ: at most as many as values that only one of the sets has."""
    return sum(F.bit_count(F.col(left)[k].bitwiseXOR(F.col(right)[k])) for k in range(PARITY // 64))


def _near(n, apart, percent: int):
    """Whether sets of n values together that differ in ``apart`` values or more can reach the threshold."""
    return (n - apart) * (100 + percent) >= n * 2 * percent


def _crowded(long: DataFrame, full: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """Links until each long list is one component or all its pairs across components are compared.

    First rounds compare members outside a list's largest component with those members that have
    the fewest values of their own, nearest to what all share. The last round compares who is left
    with every member of another component.
    """
    labels = components(links)
    tried = None
    for lanes in (*ROUNDS, 0):
        members = long.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
        groups = members.groupBy("v", "component").agg(F.count("*").alias("c"))
        tops = groups.groupBy("v").agg(F.max(F.struct("c", "component")).alias("top"), F.count("*").alias("groups")).where("groups > 1").select("v", F.col("top.component").alias("top"))
        members = stage(members.join(stage(tops, "tops"), "v"), "members")
        long = members.drop("component", "top")
        if members.isEmpty():
            break
        if lanes:
            lane = F.pmod(F.xxhash64("id"), F.lit(lanes))
            chosen = members.groupBy("v", lane.alias("lane")).agg(F.min(F.struct("rare", "id", "n", "common", "component", "parity")).alias("p")).select("v", "p.*")
        else:
            chosen = members
        outside = members.where(F.col("component") != F.col("top"))
        pairs = _pairs_of(_joined(outside, chosen, percent, F.col("l.component") != F.col("r.component")))
        pairs = stage(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        tried = pairs if tried is None else tried.union(pairs)
        new = _verified(pairs, full, percent)
        links = links.union(new)
        if lanes and not new.isEmpty():
            labels = _relabelled(labels, new)
    return links


def _relabelled(labels: DataFrame, new: DataFrame) -> DataFrame:
    """Labels after more links: components of the labels, then of all ids."""
    name = lambda at: labels.select(F.col("id").alias(at), F.col("component").alias(f"c_{at}"))
    ends = new.join(name("a"), "a", "left").join(name("b"), "b", "left")
    ends = ends.select("a", "b", F.coalesce("c_a", "a").alias("c_a"), F.coalesce("c_b", "b").alias("c_b"))
    merged = components(ends.select(F.col("c_a").alias("a"), F.col("c_b").alias("b"))).select(F.col("id").alias("old"), F.col("component").alias("further"))
    every = labels.union(ends.select(F.explode(F.array(F.struct("a", "c_a"), F.struct(F.col("b").alias("a"), F.col("c_b").alias("c_a")))).alias("e")).select("e.a", "e.c_a")).distinct()
    return stage(every.join(merged, F.col("component") == F.col("old"), "left").select("id", F.coalesce("further", "component").alias("component")), "labels")


def _verified(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Pairs whose union sketch and parities admit the threshold and whose full sets reach it."""
    side = lambda at, *more: full.select(F.col("id").alias(at), F.col("n").alias(f"n_{at}"), *(F.col(c).alias(f"{c}_{at}") for c in more))
    both = pairs.join(side("b", "sketch", "parity"), "b").join(side("a", "sketch", "parity"), "a")
    # Of the union's smallest values, those that only one set has.
    union = F.slice(F.array_sort(F.array_union("sketch_a", "sketch_b")), 1, SKETCH)
    single = F.size(union) - F.size(F.array_intersect(F.array_intersect("sketch_a", "sketch_b"), union))
    n = F.col("n_a") + F.col("n_b")
    likely = stage(both.where(_near(n, _apart("parity_a", "parity_b"), percent) & _near(n, single, percent)).select("a", "b"), "likely")
    exact = likely.join(side("b", "full"), "b").join(side("a", "full"), "a")
    inter = F.size(F.array_intersect("full_a", "full_b")).cast("long")
    return stage(exact.where(inter * 100 >= (n - inter) * percent).select("a", "b"), "links")
