"""Importance resampling, MinHash near-duplicates and whitening against plain versions, with their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import minhash, resampling, whitening


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def gumbel(doc_id, seed=2024):
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def resampled(docs, target, share=(10, 100), least=20, buckets=10_000, longest=1):
    def features(text):
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered(text))
        grams = [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
        return len(words), [zlib.crc32(g.encode()) % buckets for g in grams]

    have, want = Counter(), Counter()
    for _, text in docs:
        have.update(features(text)[1])
    for text in target:
        want.update(features(text)[1])
    s, t = sum(have.values()), sum(want.values())
    gain = {b: math.floor(1000 * math.log((want[b] + 1) * (s + buckets) / ((n + 1) * (t + buckets)))) for b, n in have.items()}
    rows = []
    for doc_id, text in docs:
        words, found = features(text)
        weight = sum(gain[b] for b in found)
        rows.append((doc_id, len(found), weight, weight + gumbel(doc_id), words))
    order = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    ranks = {id(r): k for k, r in enumerate(order[: len(order) * share[0] // share[1]], 1)}
    return [(*r[:4], ranks.get(id(r))) for r in rows]


def plain(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


def drawn(frame):
    return plain([tuple(r) for r in frame.select("doc_id", "n_features", "weight", "score", "rank").collect()])


@pytest.fixture(scope="module")
def target(spark):
    return spark.createDataFrame([(1, "Ka lo mi ren"), (2, None), (3, "tu shavor ka KA héé")], "item_id long, text string")


@pytest.mark.parametrize(("share", "longest"), [((10, 100), 1), ((1, 1), 1), ((1, 3), 2), ((0, 1), 3)])
def test_resample(docs, rows, target, share, longest):
    want = resampled([r[:2] for r in rows], [r["text"] for r in target.collect()], share, longest=longest)
    assert drawn(resampling.resample(docs, target, share=share, longest=longest)) == plain(want)


def test_resample_merges_many_runs(spark, target, monkeypatch):
    """Small runs, blocks and ranges: equal scores, repeated rows and one text that holds a third of all rows."""
    monkeypatch.setattr(resampling, "RUN_ROWS", 40)
    monkeypatch.setattr(resampling, "BLOCK_ROWS", 7)
    monkeypatch.setattr(resampling, "RANGE_ROWS", 50)
    rnd = random.Random(3)
    words = ["ka", "lo", "mi", "ren", "Tu", "x1", "é"]
    rows = [(i, "ka lo " * 15 if i % 3 == 0 else " ".join(rnd.choices(words, k=rnd.randint(1, 60)))) for i in range(600)]
    rows += [rows[3]] * 5 + [(None, "mi " * 30)] * 3
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 25)
    try:
        found = drawn(resampling.resample(frame, target, share=(2, 5)))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == plain(resampled(rows, [r["text"] for r in target.collect()], (2, 5)))
    assert [r[4] for r in sorted(found, key=lambda r: r[4] or 10**9)][:3] == [1, 2, 3]


def test_resample_of_nothing(docs, empty, target):
    assert resampling.resample(empty, target).count() == 0
    found = drawn(resampling.resample(docs, target.limit(0)))
    assert len(found) == docs.count() and any(r[4] == 1 for r in found)


def test_tournament_stops_when_asked_and_opens_slices_late():
    rnd = random.Random(5)
    runs = [sorted((rnd.randint(0, 50), k, i) for i in range(rnd.randint(1, 60))) for k in range(20)]
    slices = sorted((run[i : i + 6] for run in runs for i in range(0, len(run), 6)), key=lambda s: s[0])
    opened = []

    def coming():
        for s in slices:
            opened.append(s)
            yield s[0], s

    order = resampling.merged(coming())
    first = [next(order) for _ in range(25)]
    assert first == sorted(r for run in runs for r in run)[:25]
    assert len(opened) < len(slices) // 2
    assert first + list(order) == sorted(r for run in runs for r in run)


# 12 MinHash


def shingles(text, n=4):
    words = re.findall("[^\x20\x09-\x0d]+", lowered(text))
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def minhash_rows(docs, similar=(4, 5)):
    top, bottom = similar
    sets, root = [shingles(t) for _, t in docs], list(range(len(docs)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and bottom * len(a & sets[j]) >= top * len(a | sets[j]) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    ids = {}
    for (d, _), r in zip(docs, root, strict=True):
        ids[r] = d if ids.get(r) is None else ids[r] if d is None else min(d, ids[r])
    return [(d, len(s), ids[r], d == ids[r]) for (d, _), s, r in zip(docs, sets, root, strict=True)]


def copied(frame):
    return plain([tuple(r) for r in frame.select("doc_id", "n_shingles", "component_id", "kept").collect()])


def test_minhash(docs, rows, empty):
    assert copied(minhash.minhash_components(docs)) == plain(minhash_rows([r[:2] for r in rows]))
    assert minhash.minhash_components(empty).count() == 0


def edited(rnd, words, share):
    out = list(words)
    kind = rnd.randrange(4)
    n = max(1, int(len(out) * share))
    if kind == 0:  # words here and there
        for i in rnd.sample(range(len(out)), max(1, n // 4)):
            out[i] = f"new{rnd.randrange(10**6)}"
    elif kind == 1:  # a passage added
        at = rnd.randrange(len(out))
        out[at:at] = [f"add{rnd.randrange(10**6)}" for _ in range(n)]
    elif kind == 2:  # a passage cut
        at = rnd.randrange(len(out) - n)
        del out[at : at + n]
    else:  # case and spaces only
        out = [w.upper() if rnd.random() < 0.3 else w for w in out]
    return out


def near_copies(seed):
    rnd = random.Random(seed)
    rows, i = [], 0
    for size in (6, 30, 90, 400):
        for _ in range(6):
            base = [f"w{rnd.randrange(300)}" for _ in range(size)]
            for _ in range(7):
                text = (" ", "\n ")[rnd.randrange(2)].join(edited(rnd, base, rnd.choice([0.02, 0.1, 0.18, 0.24, 0.3])))
                rows.append((i, text))
                i += 1
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize(("turns", "cell"), [(0, 3), (0, 1_024), (2, 3)])
def test_near_copies_link_as_all_pairs_do(spark, turns, cell, monkeypatch):
    monkeypatch.setattr(minhash, "STAR_TURNS", turns)
    monkeypatch.setattr(minhash, "CELL", cell)
    rows = near_copies(11 + turns)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert copied(minhash.minhash_components(frame)) == plain(minhash_rows(rows))


def test_chains_of_near_copies_and_texts_that_share_a_part(spark):
    """A hub that all are copies of, a chain in which only neighbours are similar, and many texts that share half of their words."""
    rnd = random.Random(2)
    word = lambda: f"u{rnd.randrange(10**7)}"
    hub = [word() for _ in range(200)]
    rows = [(0, " ".join(hub))]
    for i in range(1, 60):
        at = rnd.randrange(170)
        rows.append((i, " ".join([*hub[:at], *(word() for _ in range(14)), *hub[at + 14 :]])))
    chain = [word() for _ in range(120)]
    for i in range(60, 75):
        rows.append((i, " ".join(chain)))
        chain = chain[10:] + [word() for _ in range(10)]
    part = [word() for _ in range(60)]
    rows += [(i, " ".join([*part, *(word() for _ in range(60))])) for i in range(75, 150)]
    want = minhash_rows(rows)
    assert copied(minhash.minhash_components(spark.createDataFrame(rows, "doc_id long, text string"))) == plain(want)
    assert sum(r[3] for r in want) == 77


def test_posterior_bounds():
    """The bound of m agreements of n is where the posterior tail, integrated from a uniform prior, passes the miss probability."""
    for n, m in minhash.least_matches(276, 32, (4, 5), 1e-6):
        x = np.linspace(0, 1, 200_001)

        def tail(k, n=n, x=x):
            log = k * np.log(np.clip(x, 1e-300, 1)) + (n - k) * np.log(np.clip(1 - x, 1e-300, 1))
            density = np.exp(log - log.max())
            return density[x >= 0.8].sum() / density.sum()

        assert tail(m) >= 0.99e-6 and (m == 0 or tail(m - 1) < 1.01e-6)


def test_signatures_estimate_similarity_and_long_sets_are_blocked(monkeypatch):
    odd = minhash.multipliers(2000)
    rnd = np.random.default_rng(1)
    a = rnd.integers(0, 1 << 63, 3000, dtype=np.uint64)
    b = np.concatenate([a[:2500], rnd.integers(0, 1 << 63, 500, dtype=np.uint64)])
    same = (minhash.signature(a, odd) == minhash.signature(b, odd)).mean()
    assert abs(same - 2500 / 3500) < 0.04
    whole = minhash.signature(a, odd)
    monkeypatch.setattr(minhash, "BLOCK", 100)
    assert (minhash.signature(a, odd) == whole).all()


# 13 whitening


def vectors(spark, rows):
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, n int, x int")
    return frame.toDF("vec_id", "embedding", "n", "VEC_ID")


def usable(rows):
    return [(i, v) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]


def test_whitening(spark):
    rnd = np.random.default_rng(4)
    mix = rnd.normal(size=(12, 12))
    rows = [(i, [float(np.float32(x)) for x in rnd.normal(size=12) @ mix * 0.3]) for i in range(300)]
    rows += [rows[5], rows[5], (None, rows[7][1]), (900, None), (901, [None, *rows[0][1][1:]]), (902, [float("nan"), *rows[0][1][1:]])]
    rows += [(903, [float("inf"), *rows[0][1][1:]]), (904, []), (905, [1.0, 2.0])]
    fit = [(i, v) for i, v in usable(rows) if len(v) == 12]
    x = [[math.floor(1024 * c) + 100_000 for c in v] for _, v in fit]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    exact = [[Fraction(n * sum(r[i] * r[j] for r in x) - sums[i] * sums[j], n * n) for j in range(12)] for i in range(12)]
    values, _ = np.linalg.eigh(np.array(exact, float))
    found = whitening.whiten(vectors(spark, rows).repartition(6)).collect()
    assert len(found) == 8 * n and {r["n"] for r in found} == {n}
    deviations = Counter((i, sum((n * c - s) ** 2 for c, s in zip(r, sums, strict=True))) for (i, _), r in zip(fit, x, strict=True))
    assert Counter((r["vec_id"], int(r["deviation"])) for r in found if r["component"] == 1) == deviations
    for r in found[:8]:
        assert r["explained"] == pytest.approx(sorted(values)[-r["component"]] / float(sum(exact[i][i] for i in range(12))), rel=1e-9)
    assert found[0]["identity_error"] < 1e-9
    white = {}
    for r in found:
        if r["vec_id"] is not None and r["vec_id"] != 5:
            white.setdefault(r["vec_id"], [0.0] * 8)[r["component"] - 1] = r["whitened"]
    # distances in the space of the components are those of the whitened rows, whatever the signs
    directions = np.linalg.eigh(np.array(exact, float))[1][:, ::-1][:, :8]
    off = np.array(x, float) - np.array([s / n for s in sums])
    want = off @ directions / np.sqrt(values[::-1][:8])
    for k, (i, _) in enumerate(fit):
        if i in white:
            assert np.allclose(np.abs(white[i]), np.abs(want[k]), rtol=1e-6, atol=1e-8)


def test_scatter_is_exact_for_any_partitions_and_large_entries(spark, monkeypatch):
    monkeypatch.setattr(whitening, "CHUNK", 7)
    rnd = random.Random(8)
    rows = [(i, [rnd.uniform(-1e9, 1e9), rnd.random(), -3.5e10, float(i)]) for i in range(50)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    x = [[1, *(math.floor(1024 * c) + 100_000 for c in v)] for _, v in rows]
    want = [[sum(r[i] * r[j] for r in x) for j in range(5)] for i in range(5)]
    for parts in (1, 9):
        assert whitening.exact_scatter(whitening.fit_list(frame.repartition(parts))).tolist() == want
    found = {(r["vec_id"], int(r["deviation"])) for r in whitening.whiten(frame).collect()}
    sums = [sum(c) for c in zip(*x, strict=True)]
    assert found == {(i, sum((50 * a - b) ** 2 for a, b in zip(r[1:], sums[1:], strict=True))) for (i, _), r in zip(rows, x, strict=True)}


def test_whitening_without_variance(spark):
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0])])).count() == 0
    assert whitening.whiten(vectors(spark, [(i, [1.0, 2.0]) for i in range(5)])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, None)]).limit(0)).count() == 0
    assert whitening.whiten(vectors(spark, [(1, None), (2, []), (3, [None, 1.0])])).count() == 0
    line = whitening.whiten(vectors(spark, [(i, [float(i), 2.0 * i, 0.0]) for i in range(5)]))
    assert {r["component"] for r in line.collect()} == {1}
    assert line.agg(F.max(F.abs(F.col("whitened")))).first()[0] == pytest.approx(math.sqrt(2), rel=1e-3)


def test_residues_come_back():
    primes = whitening.primes_above(10**40)
    assert all(p < 1 << 20 and all(p % q for q in range(2, 1024)) for p in primes) and len(set(primes)) == len(primes)
    numbers = [0, 1, -1, 10**39, -(10**39), 123456789]
    residues = np.array([[x % p for x in numbers] for p in primes])
    assert whitening.from_residues(residues, primes).tolist() == numbers
