"""Exact dedup, Merkle manifest and spelling variants against brute force and SQL, and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mailcorpus.llm import exact, merkle, permuterm, queries

from .test_operators import LOWER, ODD, copies, docs_of

SF = "/root/testdata/sf0.001"


def brute_groups(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0))
    out = []
    for i, t in rows:
        plain = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        _, none, keep = min(groups[plain])
        keep = None if none else keep
        out.append((i, keep, len(groups[plain]), i == keep, hashlib.sha256(plain.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("fan,run", [(8, 16_384), (2, 7), (3, 2)])
def test_exact_duplicates(spark, fan, run):
    """Hot copies, ties of length, rows that differ in white space or letter case alone."""
    r = random.Random(fan)
    base = [f"{a} {b}" for a in ("one two", "Éa x", "q") for b in range(15)]
    rows = [(k, r.choice(base[:4] if k % 3 else base).replace(" ", r.choice([" ", "\t", "  ", "", " ", "\x0b\n"]))) for k in r.sample(range(500), 200)] + ODD + [(900, "one"), (None, "o n e")]
    got = exact.exact_duplicates(docs_of(spark, rows).repartition(5), fan, run).collect()
    assert sorted(((x.doc_id, x.keep_id, x.group_size, x.kept, x.text_sha256) for x in got), key=str) == brute_groups(rows)
    assert exact.exact_duplicates(docs_of(spark, [])).count() == 0


def test_records_with_one_head_are_told_apart(spark):
    """Digests that agree in their first 64 bits, or in all but the length of the text, are not merged."""
    import numpy as np

    records = np.zeros(5, exact.RECORD)
    records["digest"][:, 0], records["digest"][:, 3] = 7, [1, 2, 1, 2, 2]
    records["size"], records["chars"], records["id"], records["count"] = [3, 3, 3, 3, 4], [5, 6, 5, 9, 1], [4, 5, 2, 9, 1], 1
    assert [(int(x["id"]), int(x["count"])) for x in exact._merged(records)] == [(2, 2), (9, 2), (1, 1)]


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows, changed, fan):
    """rows of (doc_id, source, lang, n_chars, text)"""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: H(*map(field, r))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([H(*levels[-1][k : k + fan]) for k in range(0, len(levels[-1]), fan)])
        return levels

    def proof(levels, at):
        for level in levels[:-1]:
            lo = at // fan * fan
            yield level[lo:at], level[at + 1 : lo + fan]
            at //= fan

    langs = defaultdict(list)
    for r in rows:
        langs[r[2]].append(r)
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for x in order:
        langs[x].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[x] = tree([leaf(r) for r in langs[x]])
    top = tree([trees[x][-1][0] for x in order])
    out = []
    for n, x in enumerate(order):
        for at, r in enumerate(langs[x]):
            path = [*proof(trees[x], at), *proof(top, n)]
            node = leaf((*r[:4], r[4].translate(LOWER))) if changed(r) and r[4] is not None else leaf(r)
            for before, after in path:
                node = H(*before, node, *after)
            out.append((r[0], leaf(r), trees[x][-1][0], top[-1][0], H(*(s for b, a in path for s in b + a)), node, node == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("fan,levels", [(8, 4), (2, 2), (3, 1)])
def test_manifest(spark, fan, levels):
    """Languages of all sizes, one with most rows; repeated rows, nulls in every column."""
    r = random.Random(fan)
    langs = ["en"] * 60 + ["de"] * 27 + ["zz"] * 8 + ["é", "e", "", None, None, "A"] + [f"l{k}" for k in range(12)]
    rows = [(k * 3 % 211, r.choice(["src0", None, "ß"]), x, r.choice([None, 5, -1]), r.choice([None, "", "Ab cÉ", "low", "X" * 300])) for k, x in enumerate(langs)]
    rows += [(None, None, None, None, None), (5, "s", "en", 1, "T"), (5, "s", "en", 1, "T"), (5, "s", "en", 1, "U"), (12, "s", "lone", 1, "U")]
    docs = spark.createDataFrame([(*x, "other", 1) for x in rows], "doc_id long, source string, lang string, n_chars long, text string, key string, idx long").repartition(3)
    every = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    got = merkle.manifest(docs, every, bytes.lower, fan=fan, levels=levels).collect()
    changed = lambda x: x[0] is not None and zlib.crc32(str(x[0]).encode()) % 3 == 0
    want = brute_manifest(rows, changed, fan)
    assert sorted((tuple(x) for x in got), key=str) == want and {x[6] for x in want} == {True, False}
    proofs = merkle.manifest(docs, proofs=True, fan=fan, levels=levels).collect()
    for x in proofs:
        node = x.leaf
        for before, after in zip(x.before, x.after, strict=True):
            node = H(before, node, after)
        assert x.verified and node == x.root == x.folded_root
    assert merkle.manifest(docs.limit(0)).count() == 0 and merkle.manifest(docs.where("doc_id = 12 AND lang = 'lone'")).first().proof_sha256 == H()


def brute_variants(rows, least_length, least_count, ratio, error):
    n = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{i}:{w}".encode())
            if i is not None and h % error == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    n = {w: c for w, c in n.items() if len(w) >= least_length and c >= least_count}
    alphabet = sorted({c for w in n for c in w})
    near = {}
    for w in n:
        edits = {w[:k] + w[k + 1 :] for k in range(len(w))} | {w[:k] + c + w[k + d :] for k in range(len(w) + 1) for c in alphabet for d in (0, 1)}
        near[w] = [x for x in edits if x in n and x != w]
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return sorted(out)


@pytest.mark.parametrize("long", [64, 6])
def test_spelling_variants(spark, monkeypatch, long):
    """Doubled letters, ties, chains of forms, letters beyond ASCII, words of any length (some named by hash)."""
    monkeypatch.setattr(permuterm, "LONG", long)
    r = random.Random(long)
    letters = "abÀßé"
    stock = ["".join(r.choice(letters) for _ in range(r.choice([4, 5, 6, 7]))) for _ in range(120)] + ["aaaaa", "aaaaaa", "aaaaaaa", "abab", "ababa", "x×y÷z", "Straße"]
    weights = [r.choice([1, 1, 2, 9, 60]) for _ in stock]
    rows = [(k, " ".join(w.title() if r.random() < 0.3 else w for w in r.choices(stock, weights, k=60))) for k in range(60)] + ODD + [(500, "x-y " * 40), (501, "long" * 3000 + " " + "long" * 2999 + "lon")] + [(502, "long" * 3000)] * 5
    rows += [(503, "chained " * 2 + "chainee " * 9 + "chaînee " * 40)]
    got = permuterm.spelling_variants(docs_of(spark, rows).repartition(3), 4, 2, 3, 11).collect()
    want = brute_variants(rows, 4, 2, 3, 11)
    assert sorted(tuple(x) for x in got) == want and any(f != t for _, f, t, *_ in want if f)
    assert permuterm.spelling_variants(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("name", ["op11_spelling", "op12_exact", "op13_merkle"])
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = queries.QUERIES[name](spark, SF).toPandas()
    want = con.execute(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    show = lambda df: sorted(tuple("-" if pd.isna(x) else str(x).removesuffix(".0") for x in row) for row in df[sorted(df.columns)].itertuples(index=False))
    assert show(got) == show(want) and len(got) > 100


def test_variants_and_groups_of_copies(spark):
    """The same operators on near copies, whose words and texts repeat."""
    rows = copies(5)
    got = exact.exact_duplicates(docs_of(spark, rows), 2, 50).collect()
    assert sorted(((x.doc_id, x.keep_id, x.group_size, x.kept, x.text_sha256) for x in got), key=str) == brute_groups(rows)
