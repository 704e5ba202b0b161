"""Stored tables: what a lookup opens, what a change writes, segments before and after merges, the vocabulary."""

import random
import sys

import pytest
from pyspark.sql import functions as F

from tessera import bindings, registry, storage
from tessera.operators import index, rank
from tessera.sources import day_states, keyed, segments, tiered_index, token_index, vocabulary


def leaves(plan):
    if "AdaptiveSparkPlan" in plan.nodeName():
        plan = plan.executedPlan()
    if "QueryStage" in plan.nodeName():
        plan = plan.plan()
    children = plan.children()
    found = [] if children.size() else [plan]
    for i in range(children.size()):
        found += leaves(children.apply(i))
    return found


def scan_metric(df, name):
    """The sum of a metric of all file scans of ``df`` after it ran."""
    df.collect()
    scans = [p for p in leaves(df._jdf.queryExecution().executedPlan()) if p.nodeName().startswith("Scan parquet")]
    return sum(p.metrics().get(name).get().value() for p in scans)


def folder(spark):
    return storage.new_folder(spark, "t")


@pytest.fixture(scope="module")
def rows(spark):
    kept = spark.range(4_000).select(F.concat(F.lit("k"), F.col("id") % 1_000).alias("cid"), F.col("id").alias("n"))
    return kept.unionByName(spark.range(3_000).select(F.lit("hot").alias("cid"), F.col("id").alias("n"))).unionByName(spark.sql("SELECT CAST(null AS string) AS cid, 5L AS n"))


def test_lookup_opens_the_buckets_of_its_keys(spark, rows):
    table = keyed.create(rows, folder(spark), "cid", 32)
    assert keyed.stored_rows(spark, table).count() == 7_001
    asked = spark.createDataFrame([("k7",), ("k8",), ("none",), ("k7",)], "key string")
    buckets = keyed.touched_buckets(table, asked)
    found = keyed.rows_of(spark, table, asked)
    assert sorted(r["n"] for r in found.collect()) == sorted(x + 1_000 * i for x in (7, 8) for i in range(4))
    whole = scan_metric(keyed.stored_rows(spark, table), "numFiles")
    assert len(buckets) <= 3 and scan_metric(found, "numFiles") <= 3 * (whole // 32 + 1) < whole
    assert keyed.rows_of(spark, table, asked.limit(0)).count() == 0


def test_change_writes_touched_buckets_and_empties_others(spark, rows):
    table = keyed.create(rows, folder(spark), "cid", 32)
    files = lambda: {r["f"] for r in spark.read.parquet(table.path).select(F.input_file_name().alias("f")).distinct().collect()}
    before = files()
    keys = spark.createDataFrame([("k1",), ("new",)], "cid string")
    fresh = spark.createDataFrame([("k1", -1), ("new", -2)], "cid string, n long")
    keyed.change(spark, table, keys, lambda old: old.join(keys, "cid", "left_anti").unionByName(fresh))
    after = files()
    touched = {f"bucket={k}/" for k in keyed.touched_buckets(table, keys)}
    assert all(any(t in f for t in touched) for f in before ^ after)
    assert keyed.stored_rows(spark, table).count() == 7_001 - 4 + 2
    # a bucket that loses all its rows is empty, not as it was
    one = keyed.create(rows.filter("cid = 'hot'"), folder(spark), "cid", 32)
    keyed.change(spark, one, spark.createDataFrame([("hot",)], "cid string"), lambda old: old.filter("n < 0"))
    assert keyed.stored_rows(spark, one).count() == 0


def test_a_change_that_fails_or_strays_leaves_the_table(spark, rows):
    table = keyed.create(rows, folder(spark), "cid", 32)
    key = spark.createDataFrame([("k1",)], "cid string")
    with pytest.raises(ValueError, match="not told of"):
        keyed.change(spark, table, key, lambda old: old.withColumn("cid", F.concat(F.lit("x"), F.col("n").cast("string"))))
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO|boom"):
        keyed.change(spark, table, key, lambda old: old.withColumn("n", F.raise_error(F.lit("boom")).cast("bigint")))
    assert keyed.stored_rows(spark, table).count() == 7_001
    keyed.change(spark, table, key.limit(0), lambda old: old.limit(0))
    assert keyed.stored_rows(spark, table).count() == 7_001


def tokens_of(seed, items, spark):
    rnd = random.Random(seed)
    words = sorted({"".join(rnd.choices("abcde", k=rnd.randint(3, 9))) for _ in range(300)})
    rows = [(w, f"c{i}", rnd.randint(1, 60)) for i in items for w in rnd.sample(words, 12)]
    return spark.createDataFrame(rows, "token string, cid string, count long")


def as_set(df):
    return sorted((r["token"], r["cid"], r["count"]) for r in df.select("token", "cid", "count").collect())


@pytest.mark.parametrize("level", [0, 8])
def test_segments_read_as_one_table(spark, level):
    base = folder(spark)
    token_index.write(tokens_of(0, range(200), spark), base)
    found, plain = segments.first_segment(base, level), as_set(token_index.read(spark, base))
    states = []
    for step in range(1, 10):
        items = random.Random(step).sample(range(220), 25)
        fresh = tokens_of(step, items[5:], spark)  # the first five have no tokens any more
        crawled = spark.createDataFrame([(f"c{i}",) for i in items], "cid string")
        to = folder(spark)
        found = segments.replace(spark, found, fresh, crawled, to)
        assert spark.read.parquet(f"{to}/rows").count() == fresh.count() and spark.read.parquet(f"{to}/gone").count() == 25
        gone = {f"c{i}" for i in items}
        plain = sorted([r for r in plain if r[1] not in gone] + as_set(fresh))
        assert as_set(segments.read(spark, found)) == plain
        states.append((found, plain))
        while segments.due(found):
            found = segments.compacted(spark, found, folder(spark))
            assert as_set(segments.read(spark, found)) == plain
    assert len(found) < 6 and all(s.level > 0 for s in found[:1])
    for state, rows in states[::4]:  # older states stay as they were
        assert as_set(segments.read(spark, state)) == rows
    path = folder(spark)
    segments.save(spark, found, path)
    assert segments.load(spark, path) == found
    wanted = index.matches(segments.read(spark, found), ["abc", "e"])
    one = index.matches(spark.createDataFrame(plain, "token string, cid string, count long"), ["abc", "e"])
    assert sorted(map(tuple, wanted.collect())) == sorted(map(tuple, one.collect()))


def test_a_prefix_reaches_every_segment(spark):
    base = folder(spark)
    token_index.write(tokens_of(0, range(50), spark), base)
    crawled = spark.createDataFrame([("c1",)], "cid string")
    found = segments.replace(spark, segments.first_segment(base), tokens_of(1, [1], spark), crawled, folder(spark))
    plan = segments.read(spark, found).filter(index.prefix_match(["abc"]))._jdf.queryExecution().toString()
    assert plan.count("PushedFilters: [IsNotNull(token), StringStartsWith(token,abc)]") + plan.count("StringStartsWith(token,abc)]") >= 2


@pytest.mark.parametrize("listed", [1_000, 3])
def test_near_tokens_are_those_of_a_full_scan(spark, listed, monkeypatch):
    monkeypatch.setattr(vocabulary, "LISTED", listed)
    tokens, path, words = tokens_of(4, range(150), spark), folder(spark), folder(spark)
    token_index.write(tokens, path)
    stored = token_index.read(spark, path)
    vocabulary.write(stored, words)
    some = [r["token"] for r in tokens.select("token").distinct().orderBy("token").limit(40).collect()]
    for queries in (["abc"], ["ab"], ["aba", "cde"], [some[3], some[20][:4]], [some[7] + "zz"], ["x" + some[9], "bad", "abcab"], ["zzzz"]):
        near = vocabulary.rows_near(spark, stored, words, queries)
        scores = rank.token_scores(near, queries)
        full = rank.token_scores(stored, queries).filter("any_match")
        assert sorted(map(tuple, scores.filter("any_match").collect())) == sorted(map(tuple, full.collect()))
        assert scores.count() == full.count()
        if listed == 1_000 and not near.isEmpty():
            plan = near._jdf.queryExecution().toString()
            assert "PushedFilters: [In(token" in plan or "EqualTo(token" in plan


def test_a_late_event_changes_its_day_alone_and_a_window_opens_its_days(spark):
    day = day_states.DAY_MS
    rows = [(f"c{i % 5}", f"w{i % 3}", (100 + i % 10) * day + i, i, (True, False, None)[i % 3]) for i in range(200)]
    schema, path = "cid string, wallet string, at_ms long, event_id long, ok boolean", folder(spark)
    day_states.add(spark, path, spark.createDataFrame(rows, schema), old=False)
    files = lambda: {r["f"] for r in spark.read.parquet(path).select(F.input_file_name().alias("f")).distinct().collect()}
    before, late = files(), [("c1", "w1", 104 * day + 1, 999, True), ("new", "w", 104 * day, 1_000, None)]
    day_states.add(spark, path, spark.createDataFrame(late, schema))
    assert {f.split("day=")[1].split("/")[0] for f in before ^ files()} == {"104"}
    every = rows + late
    window = [r for r in every if 103 * day <= r[2] < 106 * day]
    found = day_states.wallets_from_days(spark, path, 103, 105)
    assert {(r["cid"], r["wallets"]) for r in found.collect()} == {(c, len({r[1] for r in window if r[0] == c})) for c in {r[0] for r in window}}
    assert scan_metric(found, "numFiles") <= 3 * 4
    last = {}
    for r in sorted((r for r in every if r[2] >= 103 * day), key=lambda r: r[2:4]):
        last[r[:2]] = r
    want = {c: [0, 0, 0] for c, _ in last}
    for (c, _), r in last.items():
        want[c][0] += 1
        want[c][1] += r[4] is True
        want[c][2] += r[4] is False
    got = {r["cid"]: [r["wallets"], r["ok_wallets"], r["bad_wallets"]] for r in day_states.usage_from_days(spark, path, 103).collect()}
    assert got == want


@pytest.mark.parametrize("spread", [1, 4])
def test_pages_end_early_and_are_those_of_a_full_rank(spark, spread):
    """Scores with many ties; every page behind a cursor is the full rank's, and lower tiers aren't read."""
    rnd, path = random.Random(spread), folder(spark)
    items = [(f"c{i}", round(rnd.choice([0.05, 0.1, 0.31, 0.5, 0.6]) / spread, 6), round(rnd.choice([0.0, 0.1, 0.3]), 6)) for i in range(400)]
    standing = spark.createDataFrame([(c, s) for c, s, _ in items[:390]], "cid string, score double")
    items = [(c, s if k < 390 else 0.0, r) for k, (c, s, r) in enumerate(items)]
    relevance = spark.createDataFrame([(c, s, r) for c, s, r in items], "cid string, s double, r double")
    tokens = spark.createDataFrame([(t, c, 1) for c, _, _ in items for t in ("ab", "abc")], "token string, cid string, count long")
    tiered_index.write(tokens, standing, path)
    met = []

    def score(rows):
        hits = rows.groupBy("cid").agg(F.count(F.lit(1)).alias("n")).filter("n = 2")
        met.append(hits.count())
        return hits.join(relevance, "cid").select("cid", F.round(F.col("s") + F.col("r"), 6).alias("score"))

    full = sorted(((round(s + r, 6), c) for c, s, r in items), reverse=True)
    cursor, seen = None, []
    for page in range(4):
        met.clear()
        found, read = tiered_index.top_page(spark, path, score, 15, cursor)
        got = sorted(((r["score"], r["cid"]) for r in found.collect()), reverse=True)
        seen += got
        cursor = rank.Cursor(*got[-1])
        if spread == 1 and page == 0:
            assert read < len(tiered_index.tiers(spark, path)) and sum(met) < 300
    assert seen == full[:60]
    found, read = tiered_index.top_page(spark, path, score, 200, rank.Cursor(*full[-3]))
    assert sorted(((r["score"], r["cid"]) for r in found.collect()), reverse=True) == full[-2:]
    assert read == len(tiered_index.tiers(spark, path))


def test_tiers_join_activity_of_the_catalogs_roots_alone(spark, sf_dir):
    """A page scores tier by tier; what other items' wallets have isn't read each time."""
    ranking = sys.modules[registry.QUERIES["t8_early_end"].__module__]

    roots = bindings.catalog(spark, sf_dir).select(ranking.root_of().alias("cid")).distinct()
    for own, every in zip(ranking.root_activity(spark, sf_dir), ranking.activity_tables(spark, sf_dir), strict=True):
        wanted = every.join(roots, "cid", "left_semi")
        assert sorted(map(tuple, own.collect())) == sorted(map(tuple, wanted.collect()))
        assert own.count() <= roots.count()
