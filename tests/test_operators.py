"""Operators on a few rows each: walks, numbering, the stored index, ids, documents, streams."""

from pyspark.sql import functions as F

import pytest

from tessera import registry, storage
from tessera.functions import docs, html, ids
from tessera.operators import graph, rank
from tessera.plans import search
from tessera.queries import texts
from tessera.sources import records, token_index
from tessera.streaming import latest, usage


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_walk_of_a_long_chain_is_whole(spark):
    edges = spark.range(90).select(F.concat(F.lit("n"), "id").alias("parent_cid"), F.concat(F.lit("n"), F.col("id") + 1).alias("child_cid"))
    roots = spark.createDataFrame([("o", "n0")], "owner string, cid string")
    assert graph.reachable(roots, edges).count() == 91
    with pytest.raises(RuntimeError):
        graph.reachable(roots, edges, most_rounds=5)


def test_path_index_opens_so_many_directories(spark):
    links = [("r", f"d{i}", f"d{i}", "dir") for i in range(6)] + [(f"d{i}", f"f{i}", "a.txt", "file") for i in range(6)]
    listing = spark.createDataFrame(links, "parent_cid string, cid string, name string, type string")
    roots = spark.createDataFrame([("r",)], "cid string")
    found = graph.path_index(listing, roots, max_depth=4, max_dirs=4)
    assert rows(found.select("path")) == [("d0/a.txt",), ("d1/a.txt",), ("d2/a.txt",)]
    assert graph.path_index(listing, roots, max_depth=4).count() == 6


def test_numbering_is_the_total_order_without_a_window_over_all(spark):
    hits = spark.range(500).select(F.concat(F.lit("c"), F.col("id")).alias("cid"), (F.col("id") % 7).cast("double").alias("score"))
    found = rank.numbered(hits, F.desc("score"), F.desc("cid"))
    order = [r["cid"] for r in sorted(found.collect(), key=lambda r: r["n"])]
    assert order == [r["cid"] for r in hits.orderBy(F.desc("score"), F.desc("cid")).collect()]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window [row_number() windowspecdefinition(_range" in plan.replace("#", " ").replace("  ", " ") or "_range" in plan


def test_index_search_reads_its_prefix(spark, sf_dir, tmp_path):
    found = texts.stored_tokens(spark, sf_dir).filter(F.col("token").startswith("enan") | F.col("token").startswith("her"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(token,enan)" in plan and "StringStartsWith(token,her)" in plan
    QUERIES = registry.QUERIES
    whole = QUERIES["j2_search_tokens"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "documents" not in whole.lower() or "posexplode" not in whole.lower()
    assert "PushedFilters" in QUERIES["j2_search_tokens"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_index_rows_stand_in_order_of_token(spark, tmp_path):
    tokens = spark.range(3000).select((F.col("id") * 7919 % 3000).cast("string").alias("token"), F.col("id").cast("string").alias("cid"), F.col("id").alias("count"))
    token_index.write(tokens, str(tmp_path / "index"))
    back = token_index.read(spark, str(tmp_path / "index")).withColumn("file", F.input_file_name())
    by_file = {}
    for r in back.collect():
        by_file.setdefault(r["file"], []).append(r["token"])
    ranges = sorted((min(t), max(t)) for t in by_file.values())
    assert all(t == sorted(t) for t in by_file.values()) and all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:]))


def test_stored_tables_follow_their_inputs(spark, tmp_path):
    built, source = [], str(tmp_path / "in")
    spark.range(3).write.parquet(source)

    def build(path):
        built.append(path)
        spark.read.parquet(source).write.parquet(path)

    first = storage.stored(spark, "t", [source], build)
    assert storage.stored(spark, "t", [source], build) == first
    spark.range(5).write.mode("append").parquet(source)
    second = storage.stored(spark, "t", [source], build)
    assert second != first and spark.read.parquet(second).count() == 8 and built == [first, second]


def test_signal_of_queries_is_a_prefix_of_some_token(spark):
    index = spark.createDataFrame([("house",), ("mouse",)], "token string")
    asked = spark.createDataFrame([(1, ["ho"]), (2, ["ouse"]), (3, ["houses"]), (4, ["x", "mouse"]), (5, [])], "id int, tokens array<string>")
    assert rows(search.has_signal(asked, index)) == [(1,), (4,)]


def test_ids_in_both_spellings(spark):
    v0 = "QmUNLLsPACCz1vLxQVkXqqLX5R1X345qqfHbsf67hvA3Nn"
    v1 = "bafybeiczsscdsbs7ffqz55asqdf3smv6klcw3gofszvwlyarci47bgf354"
    assert ids.variants(v0) == [v0, v1] and ids.variants(f" {v1} ") == [v1, v0]
    assert ids.variants("word") == ["word"] and ids.variants(None) == [] and ids.variants("bad!") == ["bad!"]
    for raw in (b"", b"\0\0a", bytes(range(40))):
        assert ids.from_base58(ids.base58(raw)) == raw


def test_documents_edges(spark):
    df = spark.createDataFrame([(None,), ("",), (" \r\n ",), ("a\r\n\r\n\r\n\r\nb  c\t\td",)], "t string")
    assert rows(df.select(docs.squeeze_lines(F.col("t")))) == [("",), ("",), ("",), ("a\n\nb c d",)]
    assert [tuple(r[0]) for r in df.select(docs.document_title(F.col("t"))).collect()][:3] == [(None, None)] * 3
    href = spark.createDataFrame([("OEBPS/a.opf", "../x/%41.html#f"), ("a.opf", "./b.html?q"), ("p/a.opf", " ")], "p string, h string")
    assert [r[0] for r in href.select(docs.resolve_href(F.col("p"), F.col("h"))).collect()] == ["x/A.html", "b.html", None]


def test_bound_expressions_are_not_multiplied(spark):
    df = spark.createDataFrame([("x",)], "h string").select(html.readable_text(F.col("h")).alias("t"))
    assert len(df._jdf.queryExecution().optimizedPlan().toString()) < 40_000


def test_samples_of_small_and_large_blobs(spark):
    df = spark.createDataFrame([(b"x" * n,) for n in (0, 5, 10, 11, 19, 20, 21, 35, 100)], "b binary")
    s = df.select(records.samples(F.col("b"), 10, 30).alias("s")).select("s.*").collect()
    sizes = [(len(r["head"]), len(r["middle"] or b""), len(r["tail"] or b"")) for r in s]
    assert sizes == [(0, 0, 0), (5, 0, 0), (10, 0, 0), (10, 0, 0), (10, 0, 0), (10, 0, 10), (10, 0, 10), (10, 10, 10), (10, 10, 10)]


def in_files(spark, path, batches):
    for b in batches:
        spark.createDataFrame(b, "cid string, wallet string, at_ms long, event_id long, ok boolean").coalesce(1).write.mode("append").parquet(path)
    schema = "cid string, wallet string, at_ms long, event_id long, ok boolean"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_latest_access_over_batches_with_late_rows_and_retention(spark, tmp_path):
    batches = [[("a", "w", 100, 1, True), ("b", "w", 90, 2, True)], [("a", "w", 95, 3, False), ("c", "w", 150, 4, None)], [("b", "w", 40, 5, False)]]
    found = latest.latest_to_end(in_files(spark, str(tmp_path / "in"), batches), 55)
    assert rows(found.select("cid", "at_ms", "ok")) == [("a", 100, True), ("c", 150, None)]


def test_replays_within_the_window_alone_are_dropped(spark, tmp_path):
    at = lambda minutes: 1_700_000_000_000 + minutes * 60_000
    seen = [[("n", 0, 1), ("n", 5, 2), ("m", 0, 3)], [("n", 9, 4), ("n", 11, 5)], [("n", 20, 6), ("n", 21, 7)]]
    batches = [[(nonce, "w", at(minutes), i, True) for nonce, minutes, i in b] for b in seen]
    stream = in_files(spark, str(tmp_path / "in"), batches)
    found = usage.run_to_end(usage.rate_limited(stream, "cid", 600_000), "append")
    assert rows(found.select("cid", "event_id")) == [("m", 3), ("n", 1), ("n", 5), ("n", 7)]


def test_an_owner_over_its_budget_walks_no_further(spark):
    tree = [(f"n{i}", f"n{3 * i + k}") for i in range(400) for k in (1, 2, 3)] + [(f"n{i}", "n0") for i in (5, 9)]
    roots = spark.createDataFrame([("big", "n0"), ("small", "n130"), ("gone", "x")], "owner string, cid string")
    edges = spark.createDataFrame(tree, "parent_cid string, child_cid string")
    walked = graph.reachable(roots, edges, most_nodes=20).groupBy("owner").count()
    assert {r["owner"]: r["count"] for r in walked.collect()} == {"big": 1 + 3 + 9 + 27, "small": 1 + 3 + 9, "gone": 1}
    counts = graph.reachable_counts(roots, edges, 20)
    assert rows(counts.select("owner", "nodes", "truncated")) == [("big", 20, True), ("gone", 1, False), ("small", 13, False)]
