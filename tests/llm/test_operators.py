"""Each operator against brute force on small tables, and on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mailcorpus.llm import ann, chat, components, decontaminate, html, lm, minhash, mixing, pii, substring, toxicity

ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two three"), (6, "one two three"), (6, "one two three"), (None, "one two three"), (None, None), (7, "x" * 50_000), (8, "a b c d e f g h " * 3_000)]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, lower=False):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER) if lower else text or "")


def docs_of(spark, rows):
    """With other columns whose names operators use inside."""
    full = [(i, t, "en", "src0", len(t or ""), "x", 1) for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, component_id string, key long")


def copies(seed, groups=12, size=30, length=60):
    """Groups of near copies with a few changed words each, and texts that share a passage."""
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(4000)]
    passage, out = [r.choice(vocabulary) for _ in range(45)], []
    for _ in range(groups):
        base = [r.choice(vocabulary) for _ in range(length)]
        for _ in range(r.choice([1, 2, 3, size])):
            copy = list(base)
            for _ in range(r.randint(0, 3)):
                copy[r.randrange(length)] = r.choice(vocabulary)
            out.append(" ".join(copy))
    out += [" ".join([r.choice(vocabulary) for _ in range(r.randint(3, 40))] + passage + [r.choice(vocabulary) for _ in range(5)]) for _ in range(40)]
    r.shuffle(out)
    return list(enumerate(out, 100))


def brute_components(rows, size, percent):
    sets = {i: {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()} for i, t in rows for w in [words(t, True)]}
    least = {i: i for i in sets}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                least[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("size,limit", [(4, 12), (5, 3)])
def test_near_duplicates(spark, monkeypatch, size, limit):
    monkeypatch.setattr(minhash, "SHORT_LIST", limit)
    rows = copies(size)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs_of(spark, rows), size=size).collect()}
    assert got == brute_components(rows, size, 80)


def test_near_duplicates_on_both_sides_of_the_wide_sketch(spark):
    """Crowds of copies of 512 shingles, each with a word of its own, and one of them with a quarter more text."""
    rows = []
    for g in range(10):
        base = [f"g{g}w{k}" for k in range(514)]
        rows += [(100 * g + c, " ".join([*base, f"own{g}x{c}"])) for c in range(14)]
        rows.append((100 * g + 50, " ".join([*base, *(f"more{g}x{k}" for k in range(120 + g % 5))])))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs_of(spark, rows), size=4).collect()}
    assert got == brute_components(rows, 4, 80) and len({c for _, c in got.values()}) == 10


def test_near_duplicates_of_every_size_at_the_threshold(spark):
    """For 5 to 300 shingles a text and a longer one that begins with it, as long as the threshold lets it be and one word longer."""
    rows, n = [], 0
    for k in [*range(5, 60), *range(60, 301, 8)]:
        for copy, extra in enumerate((0, k // 4, k // 4, k // 4 + 1)):
            n += 1
            at = k if copy < 2 else k + 1000 * copy
            rows += [(2 * n, " ".join(f"v{at}x{j}" for j in range(k + 3)))] if copy else []
            rows.append((2 * n + 1, " ".join(f"v{at}x{j}" for j in range(k + 3 + extra))))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs_of(spark, rows), size=4).collect()}
    want = brute_components(rows, 4, 80)
    assert got == want and len({c for _, c in want.values()}) < len(rows) * 0.75


def test_near_duplicates_of_odd_rows(spark):
    rows = minhash.near_duplicates(docs_of(spark, ODD), size=4).collect()
    assert len(rows) == len(ODD)
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert (by[1].n_shingles, by[1].component_id, by[1].kept) == (0, 1, True) and by[6].component_id == 5 and not by[6].kept and by[4].kept
    assert minhash.near_duplicates(docs_of(spark, [])).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (None, 3), (5, 5)], "a long, b long")
    got = {r.id: r.component for r in components.components(links).collect()}
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 101: 100}


def brute_repeats(rows, window):
    seen = Counter()
    for _, t in rows:
        w = words(t)
        seen.update(tuple(w[k : k + window]) for k in range(len(w) - window + 1))
    out = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((-1 if i is None else i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("limit", [1000, 3])
def test_repeated_passages(spark, limit):
    rows = copies(3) + ODD
    got = substring.repeated_passages(docs_of(spark, rows), window=12, prefix=5, group_limit=limit).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_repeats(rows, 12)
    assert substring.repeated_passages(docs_of(spark, [])).count() == 0


def test_language_model(spark):
    """Both scores by hand, with null ids, repeated rows and very long texts; with many bits for each entry no yes of the filter is false."""
    rows = [(i, t) for i, t in copies(5, groups=6)] + ODD + [(None, "one two three"), (100, "again w1 w2 w2 w2 w2 w2 w2 w2")]
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    tokens = [[*words(t, True), None] for _, t in rows]
    out = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    c = Counter(x for t, o in zip(tokens, out) if not o for x in t)
    pairs = Counter(x for t, o in zip(tokens, out) if not o for x in zip([None, *t], t))
    total, kinds = sum(c.values()), len(c)

    def step(n):
        return max([0, *(s for s in lm.STEPS.tolist() if s <= n)])

    mass = sum(step(x) for x in c.values())
    want = []
    for (i, _), t, o in zip(rows, tokens, out):
        base = sum(math.log10((c[w] + 1) / (total + kinds + 1)) for w in t)
        score = 0.0
        for v, w in zip([None, *t], t):
            alone = (step(c[w]) + 1) / (mass + kinds + 1)
            score += math.log10(0.2 * step(pairs[v, w]) / c[v] + 0.8 * alone if c[v] else alone)
        want.append((-1 if i is None else i, o, len(t), sum(c[w] > 0 for w in t), total, base, score))
    for bits, off in ((96, 1e-6), (lm.BITS_PER_ENTRY, 0.05)):
        got = [(-1 if r.doc_id is None else r.doc_id, *r[1:]) for r in lm.lm_scores(docs_of(spark, rows), held, bits_per_entry=bits).collect()]
        for g, w in zip(sorted(got), sorted(want), strict=True):
            assert g[:5] == w[:5] and abs(g[5] - w[5]) < 1e-6 and abs(g[6] - w[6]) < off * g[2]
    assert lm.lm_scores(docs_of(spark, []), held).count() == 0
    alone = lm.lm_scores(docs_of(spark, ODD), F.lit(True)).collect()
    assert len(alone) == len(ODD) and all(r.n_known == r.train_tokens == 0 and abs(r.score - r.base_score) < 1e-9 for r in alone)


def test_levels_give_counts_back():
    rng = np.random.default_rng(3)
    gram = rng.integers(1, 2**63, 40_000, dtype=np.uint64)
    count = (rng.pareto(0.8, 20_000) + 1).astype(np.int64)
    segment = lm.build_segment(gram[:20_000], count)
    level = lm.levels(segment, gram)
    assert (lm.count_of(level[:20_000]) >= lm.count_of(lm.level_of(count))).all()
    assert (level[:20_000] == lm.level_of(count)).mean() > 0.98 and (level[20_000:] == 0).mean() > 0.98
    assert (lm.count_of(lm.level_of(np.arange(1, 5))) == np.arange(1, 5)).all() and lm.level_of(np.array([0]))[0] == 0
    assert len(segment) <= lm.level_of(count).sum() * lm.BITS_PER_ENTRY / 8 + 8
    assert (lm.levels(lm.build_segment(gram[:0], count[:0]), gram) == 0).all()


def test_toxicity_learns_and_meets_misspellings(spark):
    r = random.Random(2)
    plain = ["".join(r.choice(["ther", "on", "ing", "ed", "an", "wh", "er"]) for _ in range(r.randint(1, 3))) for _ in range(400)]
    bad = ["worthless", "pathetic", "disgusting"]
    rows, labels = [], []
    for i in range(900):
        t = [r.choice(plain) for _ in range(r.randint(5, 150))]
        toxic = int(i % 3 == 0)
        if toxic:
            for _ in range(max(1, len(t) // 30)):
                t.insert(r.randrange(len(t)), r.choice(bad if zlib.crc32(str(i).encode()) % 3 != 1 else ["worthles", "pathettic", "disgustingg"]))
        rows.append((i, " ".join(t)))
        labels.append((i, toxic))
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    table = spark.createDataFrame([*labels, (None, 1), (5000, None), (6000, 1)], "doc_id long, toxic int")
    odd = [(10_000 + k, t) for k, (_, t) in enumerate(ODD)]
    got = {r.doc_id: r for r in toxicity.toxicity(docs_of(spark, rows + odd), table, held).collect()}
    truth = dict(labels)
    out = [i for i in truth if got[i].held_out]
    assert np.mean([got[i].predicted == truth[i] for i in out]) > 0.9
    assert np.mean([got[i].predicted for i in out if not truth[i]]) < 0.05
    assert len(got) == len(rows) + len(odd) and all(0 <= x.score <= 1 for x in got.values()) and got[10_000].score == got[10_001].score
    none = toxicity.toxicity(docs_of(spark, ODD), table.limit(0), held)
    assert none.where("predicted = 1").count() == 0 and none.count() == len(ODD)
    assert toxicity.toxicity(docs_of(spark, []), table, held).count() == 0


def test_toxicity_scores_by_hand(spark):
    """The scores of passages, added up word by word; labels that contradict each other and repeated ids with other texts do not make runs differ."""
    r = random.Random(5)
    plain = ["".join(r.choice(["ther", "on", "ing", "ed"]) for _ in range(2)) for _ in range(60)]
    rows = [(i, " ".join([r.choice(plain) for _ in range(r.randint(0, 200))] + ["worthless"] * (i % 3 == 0))) for i in range(90)] + [(3, "another text"), (4, None)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)] + [(7, 1), (9, 0)], "doc_id long, toxic int")
    none = F.lit(False)
    got = [sorted((r.doc_id, r.score) for r in toxicity.toxicity(docs_of(spark, x), labels, none).collect()) for x in (rows, rows[::-1])]
    assert got[0] == got[1]
    taught = sorted((i, min(t for j, t in rows if j == i and t is not None), int(i % 3 == 0)) for i in range(90) if i not in (7, 9))
    logit, bias, slope, shift = toxicity.fit(pa.array([t for _, t, _ in taught], pa.string()), np.array([k for *_, k in taught]))
    for (i, score), (_, text) in zip(got[0], sorted(rows, key=lambda x: (x[0], 0)), strict=True):
        if i in (3, 4):
            continue  # two texts
        w, logits = words(text, True), []
        for at in [0] if len(w) <= toxicity.PASSAGE else [*range(0, len(w) - toxicity.PASSAGE, toxicity.STRIDE), len(w) - toxicity.PASSAGE]:
            kinds, total = sorted(set(w[at : at + toxicity.PASSAGE])), 0.0
            for x in kinds:
                data = np.frombuffer(x.encode(), np.uint8)
                total += float(np.mean(logit[toxicity._subwords(data, np.array([0]), np.array([len(data)]))[0]]))
            logits.append(total * toxicity.SCALE / max(toxicity.LEAST, len(kinds)) + bias)
        assert abs(score - 1 / (1 + math.exp(-max(-60, min(60, slope * max(logits) + shift))))) < 1e-6


def test_toxicity_of_documents_held_out(spark):
    """Whole documents of sf0.1 whose labels taught nothing: most toxic ones are caught, hardly any clean one is."""
    d = "/root/testdata/sf0.1"
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    labels = spark.read.parquet(f"{d}/labels.parquet")
    scored = toxicity.toxicity(spark.read.parquet(f"{d}/documents.parquet").join(labels.select("doc_id"), "doc_id", "left_semi"), labels, held_out)
    rows = scored.where("held_out").join(labels, "doc_id").select("toxic", "predicted").collect()
    caught = [r.predicted for r in rows if r.toxic == 1]
    alarms = [r.predicted for r in rows if r.toxic == 0]
    assert len(caught) > 100 and sum(caught) >= 0.7 * len(caught) and sum(alarms) < 0.02 * len(alarms)


def test_sample_passes_over_what_does_not_fit():
    assert toxicity._fitting([(1, 0, 6), (2, 0, 5), (3, 0, 4), (4, 1, 11), (5, 1, 10)], 10) == [1, 3, 5]


@pytest.mark.parametrize("absent", [0, 5000])
def test_labels_of_absent_documents_take_no_place(spark, absent):
    rows = [(k, ("you fool dunce " if k % 4 == 0 else "good day all ") + f"w{k} x{k % 7}") for k in range(80)]
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(80)] + [(k, k % 2) for k in range(1000, 1000 + absent)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs_of(spark, rows), labels, F.lit(False), sample=60).where("predicted = 1").select("doc_id").collect()
    assert {r.doc_id for r in got} == {k for k in range(80) if k % 4 == 0}


def test_toxicity_learns_from_the_end_of_long_texts(spark):
    """All labelled texts have more than 8000 characters, and the insults come after those."""
    r = random.Random(4)
    plain = ["".join(r.choice(["ther", "on", "ing", "ed", "an", "wh", "er"]) for _ in range(r.randint(1, 3))) for _ in range(400)]
    rows, labels = [], []
    for i in range(360):
        t = [r.choice(plain) for _ in range(1500)]
        if i % 3 == 0:
            t += [r.choice(["worthless", "pathetic", "disgusting"]) for _ in range(4)]
        t = " ".join(t + [r.choice(plain) for _ in range(20)])
        assert len(t) > 8_100
        rows.append((i, t))
        labels.append((i, int(i % 3 == 0)))
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    got = {r.doc_id: r for r in toxicity.toxicity(docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"), held).collect()}
    out = [i for i in dict(labels) if got[i].held_out]
    assert np.mean([got[i].predicted == dict(labels)[i] for i in out]) > 0.9
    assert toxicity._fitting([(1, 0, 6), (2, 1, 11), (3, 0, 4), (4, 1, 9), (5, 0, 1)], 10) == [1, 3, 4]


RULES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def spans_of(text):
    out = []
    for kind, rule in RULES.items():
        for m in re.finditer(rule, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_personal_data(spark):
    r = random.Random(1)
    parts = ["a", "Z", "@", ".", "+", "-", " ", "1", "5", "9", "_", "é", "𝒳", "(", ")", "4111111111111111", "255", "256", "0.1.2.3", "\n", "%", "a.b@c.d", "password=7602ad27cf5550de1c"]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.randint(0, 40)))) for i in range(600)] + [(5000, "9" * 30_000), (5001, "1 " * 2_000), *((6000 + k, t) for k, (_, t) in enumerate(ODD))]
    text = dict(rows)
    got = pii.pii_spans(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    for x in got:
        want = spans_of(text[x.doc_id])
        assert x.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest() and x.spans.startswith(",".join(want))
        assert [x.n_email, x.n_ip, x.n_card, x.n_phone] == [sum(s.startswith(k) for s in want) for k in RULES]
    assert any("other" in x.spans for x in got)
    assert pii.pii_spans(docs_of(spark, [])).count() == 0


def test_redaction_and_native_plan(spark):
    docs = docs_of(spark, [(1, "mail ann.lee@x.example or +1 (456) 555-2186, host 10.1.2.3."), (2, None), (3, "nothing")])
    out = pii.redact(docs)
    assert {r.doc_id: r.text for r in out.collect()} == {1: "mail <EMAIL> or <PHONE>, host <IP>.", 2: None, 3: "nothing"} and out.columns == docs.columns
    plan = pii.pii_spans(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_reliabilities_rank_labelers():
    r = random.Random(3)
    patterns = Counter()
    for _ in range(4000):
        truth = 1 if r.random() < 0.3 else -1
        patterns[tuple(truth if r.random() < p else -truth for p in (0.95, 0.8, 0.55))] += 1
    _, w = pii.reliabilities(sorted(patterns.items()))
    assert w[0][1] > w[1][1] > w[2][1] > 0 > w[2][-1] > w[0][-1]


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 24)).astype(np.float32)
    x[100:400] = x[100]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(2000, None, 0), (2001, [0.0] * 24, 0), (2002, [float("nan")] * 24, 0), (2003, [1.0, None] * 12, 0), (2004, [1.0], 0), (None, x[0].tolist(), 0), (7, x[7].tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hit = 0
    for q in range(0, 1500, 20):
        s = x.astype(float) @ x[q].astype(float)
        s[q] = -np.inf
        want = np.lexsort((np.arange(1500), -s))[:20]
        assert len(got[q]) == 20 and all(abs(v - s[i]) < 1e-9 for i, v in got[q]) and [(-v, i) for i, v in got[q]] == sorted((-v, i) for i, v in got[q])
        hit += len({i for i, _ in got[q]} & set(want.tolist()))
    assert set(got) == set(range(0, 1500, 20)) and hit / (75 * 20) > 0.9
    few = ann.nearest(df.where("vec_id < 4"), F.col("vec_id") == 0)
    assert sorted(r.vec_id for r in few.collect()) == [1, 2, 3] and ann.nearest(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_nearest_neighbours_with_fewer_than_all_lists(spark):
    """Vectors almost without clusters; extra columns have the names of results."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 0, 0.5) for i, v in enumerate(x)], "vec_id long, embedding array<float>, rank int, score double")
    got = defaultdict(set)
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0).collect():
        got[r.query_id].add(r.vec_id)
    hit = 0
    for q in range(0, 3000, 20):
        s = x.astype(float) @ x[q].astype(float)
        s[q] = -np.inf
        hit += len(got[q] & set(np.argsort(-s)[:20].tolist()))
    assert hit / (150 * 20) > 0.9


def test_nearest_neighbours_of_uneven_vectors(spark):
    """Few long vectors, a common offset, near copies: the result is the exact one, order and scores included."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(2400, 16)) * np.exp(1.5 * rng.normal(size=(2400, 1)))
    x[:600] = 50 + rng.normal(size=(600, 16))
    x[600:1200] = x[600] + 1e-3 * rng.normal(size=(600, 16))
    x[1200:1220] *= 1e3
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    for q in range(0, 2400, 20):
        s = np.cumsum(x.astype(float) * x[q].astype(float), axis=1)[:, -1]
        s[q] = -np.inf
        want = np.lexsort((np.arange(2400), -s))[:20]
        assert got[q] == [(int(i), float(s[i])) for i in want]


def test_contamination(spark):
    r = random.Random(6)
    v = [f"w{k}" for k in range(300)]
    items = [(k, " ".join(r.choice(v) for _ in range(r.choice([3, 15, 30, 59])))) for k in range(25)] + [(90, None), (91, ""), (None, "lonely item with six words here")]
    docs = []
    for i in range(120):
        w = [r.choice(v) for _ in range(r.randint(0, 200))]
        if i % 3 == 0:
            leak = words(items[r.randrange(25)][1])
            if i % 2 and len(leak) > 20:
                leak[0] = "changed"
            at = r.randint(0, len(w))
            w[at:at] = leak
        docs.append((i, " ".join(w).upper() if i % 5 == 0 else " ".join(w)))
    docs += [(500 + k, t) for k, (_, t) in enumerate(ODD)] + [docs[0], (None, items[3][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.start, r.similarity) for r in decontaminate.contaminated(docs_of(spark, docs), bench).collect()}

    def grams(w):
        return Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(sorted(w))])

    want = {}
    for i, t in docs:
        w = words(t, True)
        for k, item in items:
            iw = words(item, True)
            for s in range(len(w) - len(iw) + 1 if iw else 0):
                a, b = grams(w[s : s + len(iw)]), grams(iw)
                m = sum((a & b).values()) / sum((a | b).values())
                if m >= 0.8 and m > want.get((i, k), (0, 0))[1] + 1e-9:
                    want[i, k] = (s, round(m, 9))
    assert got == want and len(want) > 20
    assert decontaminate.contaminated(docs_of(spark, []), bench).count() == 0 and decontaminate.contaminated(docs_of(spark, docs), bench.limit(0)).count() == 0


def test_mixture_meets_targets(spark):
    r = random.Random(8)
    rows = [(i, "word " * r.randint(1, 400), r.choice(["en", "en", "de", "fr", None]), r.choice(["src0", "src0", "src1", "src2", None]), 0) for i in range(4000)] + [(9000, None, "en", "src0", 0), (9001, "", "xx", "new", 0), (None, "a b", "en", "src0", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    targets = {"source": {"src0": 0.3, "other": 0.7}, "lang": {"en": 0.5, "de": 0.3, "other": 0.2}, "topic": {"note": 0.5, "article": 0.5}}
    out = mixing.mixture(docs, targets, keep=0.1).toPandas()  # so little that no probability reaches 1
    assert len(out) == len(rows)
    spent = (out.tokens * out.probability).sum()
    assert abs(spent / out.tokens.sum() - 0.1) < 1e-3
    for column, name in (("source_class", "source"), ("lang_class", "lang"), ("topic", "topic")):
        share = (out.tokens * out.probability).groupby(out[column]).sum() / spent
        for k, goal in targets[name].items():
            assert abs(share.get(k, 0) - goal) < 0.01
    kept = out[out.kept]
    assert abs(kept.tokens.sum() / spent - 1) < 0.15
    assert mixing.mixture(docs.limit(0), targets).count() == 0


@pytest.mark.parametrize("extra", [[], ["pt", None]])
def test_default_mixture_meets_targets(spark, extra):
    """Scarce cells are repeated, and languages without a target keep their own share."""
    r = random.Random(8)
    texts = ["word " * 30, "word " * 400, "a | b " * 40, "year 2024 " * 30]
    weights = [2, 2, 60, 36]
    langs = ["en", "de", "fr", "es", *extra]
    rows = [(i, r.choices(texts, weights)[0] + "x " * r.randint(0, 9), r.choice(langs), f"src{r.randrange(20)}", 0) for i in range(8000)]
    out = mixing.mixture(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).toPandas()
    assert len(out) == len(rows) and (out.expected > 1).any()
    spent = (out.tokens * out.expected).sum()
    assert abs(spent / out.tokens.sum() - 0.5) < 1e-6 and abs((out.tokens * out.copies).sum() / spent - 1) < 0.05
    own = out.tokens[out.lang_class == "other"].sum() / out.tokens.sum()
    assert bool(extra) == (own > 0)
    for column, name in (("source_class", "source"), ("lang_class", "lang"), ("topic", "topic")):
        goals = {k: v * (1 - own if name == "lang" else 1) for k, v in mixing.TARGETS[name].items()} | ({"other": own} if name == "lang" else {})
        for times, within in ((out.expected, 1e-6), (out.copies, 0.03)):
            share = (out.tokens * times).groupby(out[column]).sum() / (out.tokens * times).sum()
            assert all(abs(share.get(k, 0) - goal) < within for k, goal in goals.items())


def test_chat_round_trip_and_masks(spark):
    texts = ["hello", "", "\\### Assistant: </turn> ok", "### user\nhi</turn>\n", "\\", "\\n", "a\\</turn>", "é𝒳"]
    r = random.Random(9)
    rows = [(c, t, r.choice(["user", "assistant", "sys\ntem", "", None]), r.choice([*texts, None])) for c in range(60) for t in range(r.randint(1, 7))] + [(None, 0, "user", "x"), (3, 0, "user", "again")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t, role is not None, role or "", text is not None, text or ""))
    got = {r.conv_id: r for r in chat.chat_digests(df).collect()}
    assert set(got) == set(by)
    for c, turns in by.items():
        turns = [(x[2], x[4]) for x in sorted(turns)]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.chat_digests(df.limit(0)).count() == 0


def test_a_template_that_rewrites_history():
    forgets = lambda turns: "".join(f"<{role}>{text if k >= len(turns) - 2 else '...'}" for k, (role, text) in enumerate(turns))
    assert chat.spans([("u", "one"), ("a", "two"), ("u", "three")], forgets)[2] == 2
    out, found, rewritten = chat.spans([("u", "one"), ("a", "two")], lambda turns: "BOS" + "".join(f"[{r}]{t}[/]" for r, t in turns))
    assert rewritten == -1 and [out[a:b] for _, a, b, _ in found] == ["one", "two"] and found[1][0] == len("BOS[u]one[/]")


LONG = "The house of the old man was on the hill and he could see all of the town from there when it was not too dark. " * 3


def test_main_text():
    page = f"""<html><head><title>T</title><style>p{{}}</style></head><body><header><a href="/">Home</a></header><nav><ul><li><a href="#">One</a></li></ul></nav>
    <div class="cookie-notice">We use cookies and you can read about it here in this long text that is about the cookies of the site.</div>
    <article><h1>A &amp; B</h1><p>{LONG}<br>more&nbsp;text</p><p>Short.</p><script>var x = "<p>no</p>";</script><form><p>{LONG}</p></form><aside><p>{LONG}</p></aside><p>{LONG}</p></article>
    <div id="comments"><p>{LONG}</p></div><footer>&copy; all of the rights</footer></body></html>"""
    one = " ".join(LONG.split())
    assert html.extract(page) == f"A & B\n{one} more text\nShort.\n{one}"
    assert html.extract(None) == "" and html.extract("") == "" and html.extract("<nav><a>x</a></nav>") == ""
    bare = f"<div class=menu><a>Home</a> <a>News</a></div><h2>Head</h2><div>{LONG}</div><p>Yes.</p><p>{LONG}<div><a href=x>Related links here</a></div>"
    assert html.extract(bare) == f"Head\n{one}\nYes.\n{one}"
    assert html.extract("<p " + "<p " * 2000) is not None and html.extract("<a href='" * 3000) is not None


@pytest.mark.parametrize("tag", ["noscript", "select", "button", "object", "svg", "math"])
def test_text_after_an_element_without_end(tag):
    one = " ".join(LONG.split())
    assert html.extract(f"<article><p>{LONG}</p><{tag}><p>{LONG}</p></article>") == f"{one}\n{one}"
    assert html.extract(f"<article><p>{LONG}</p><{tag}>gone</{tag}><p>{LONG}</p></article>") == f"{one}\n{one}"


def test_pages_with_odd_rows(spark):
    df = spark.createDataFrame([(1, "u", None), (2, None, ""), (None, "u", "<p>x</p>"), (3, "u", f"<p>{LONG}</p>"), (3, "u", f"<p>{LONG}</p>")], "page_id long, url string, html string")
    rows = html.main_text(df).collect()
    assert len(rows) == 5 and all(r.n_chars == len(r.text) for r in rows) and html.main_text(df.limit(0)).count() == 0
