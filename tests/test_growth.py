"""Work that grows with the input and no faster: rows that joins make, rows that stages deal out."""

import shutil

from pyspark.sql import functions as F

from tessera import bindings, registry


def joined_rows(df):
    """Rows out of each join of the plan that ran."""
    df.collect()
    found = []

    def walk(node):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if "QueryStage" in name:
            return walk(node.plan())
        if "Join" in name and node.metrics().contains("numOutputRows"):
            found.append(node.metrics().apply("numOutputRows").value())
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return found


def test_pins_are_asked_by_wallets_not_suppliers(spark, sf_dir, tmp_path):
    shutil.copytree(sf_dir, tmp_path / "d")
    shutil.rmtree(tmp_path / "d/supplier.parquet", ignore_errors=True)
    (tmp_path / "d/supplier.parquet").unlink(missing_ok=True)
    suppliers = spark.range(12_000).select(F.col("id").alias("s_suppkey"), F.lit("s").alias("s_name"), F.lit(1).alias("s_nationkey"), F.lit(0.0).alias("s_acctbal"))
    suppliers.write.parquet(str(tmp_path / "d/supplier.parquet"))
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").count()
    asked = registry.QUERIES["j14_is_pinned"](spark, str(tmp_path / "d"))
    made = joined_rows(asked)
    assert made and max(made) < 12_000 * parts // 20
    assert asked.count() == 3 * parts  # 60 wallets, of which 3 have the remainder of a part


def test_words_are_counted_within_their_rows(spark):
    from tessera.functions import text

    docs = spark.createDataFrame([("a", "bb Ünder the under under data x9x"), ("b", None), ("c", "zeta"), ("a", "zeta under")], "cid string, body string")
    counted = text.word_counts(docs, "cid", "body", by=text.normalize_text)
    for made in (counted.select("cid", text.token_rows("counts")), text.index_tokens(counted, "cid"), text.topics(counted, "cid")):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and plan.count("Exchange") == 1  # texts are dealt out, rows of words are not
    assert sorted(map(tuple, text.index_tokens(counted, "cid").collect())) == [("a", "under", 4), ("a", "zeta", 1), ("c", "zeta", 1)]
    assert sorted((r["cid"], tuple(r["topics"])) for r in text.topics(counted, "cid").collect()) == [("a", ("under", "zeta")), ("c", ("zeta",))]


def test_tasks_of_ownership_do_not_grow(spark, sf_dir, monkeypatch):
    """More rows are dealt to more tasks, with the same result, and none sorts the rows that it aggregates."""
    names = ("a5_replication", "u1_owners", "a19_m17_refcount", "a6_usage_stats", "m12_latest_access")
    few = {n: sorted(map(tuple, registry.QUERIES[n](spark, sf_dir).collect()), key=repr) for n in names}
    monkeypatch.setattr(bindings, "SHARE", 300)
    for n in names:
        frame = registry.QUERIES[n](spark, sf_dir)
        assert sorted(map(tuple, frame.collect()), key=repr) == few[n]
    roots = bindings.wallet_roots(spark, sf_dir)
    assert roots.rdd.getNumPartitions() >= bindings.table(spark, sf_dir, "lineitem").count() // 300
    assert "SortAggregate" not in roots._jdf.queryExecution().executedPlan().toString()


def test_limits_call_python_by_groups_of_keys(spark, tmp_path):
    """Many keys in few groups, over batches, give what each key gives on its own."""
    import random

    from tessera.streaming import usage

    rnd, want, last = random.Random(3), [], {}
    rows = sorted((rnd.randrange(40_000), f"k{rnd.randrange(90)}", i) for i in range(3_000))
    for at, key, i in sorted(rows, key=lambda r: (r[0], r[2])):
        if key not in last or at >= last[key] + 4_000:
            last[key] = at
            want.append((key, at, i))
    schema = "cid string, at_ms long, event_id long"
    for part in range(3):
        own = [(key, at, i) for at, key, i in rows if at * 3 // 40_000 == part]
        spark.createDataFrame(own, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = usage.run_to_end(usage.rate_limited(stream, "cid", 4_000, groups=7), "append")
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_no_event_is_late_where_ids_do_not_rise_with_time(spark, sf_dir, tmp_path):
    import duckdb

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    copies = [events.withColumns({"event_id": F.col("event_id") + k * 1_000_000, "user_id": F.col("user_id") + k * 5_000}) for k in range(3)]
    copies[0].unionByName(copies[1]).unionByName(copies[2]).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(registry.ORACLES["w8_rate_limit"]).fetchall()
    assert sorted(map(tuple, registry.QUERIES["w8_rate_limit"](spark, str(tmp_path)).collect())) == sorted(want)


def test_archives_reach_python_in_batches_of_some_megabytes(spark, tmp_path):
    import pyarrow as pa

    from tessera.queries import archived

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    body = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(2_000)), lambda x: F.xxhash64("id", x).cast("string")))
    spark.range(400, numPartitions=1).select(F.col("id").alias("doc_id"), body.alias("text")).write.parquet(str(tmp_path / "documents.parquet"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    rows = archived.blobs(spark, str(tmp_path))
    sent = spark.read.parquet(f"{tmp_path}/documents.parquet").mapInArrow(sizes, "n bigint")  # as blobs reads them
    assert max(r["n"] for r in sent.collect()) < 4 << 20
    assert rows.select(F.count("body")).first()[0] == 400
    kinds = registry.QUERIES["p12_archive_kinds"](spark, str(tmp_path)).groupBy("ext_guess").count().collect()
    assert sorted(map(tuple, kinds)) == [("apk", 80), ("docx", 80), ("epub", 80), ("xlsx", 80), ("zip", 80)]


def test_tasks_of_the_index_do_not_grow(spark, sf_dir, tmp_path, monkeypatch):
    """More index rows are dealt to more ranges, and a search over segments to more tasks, with the same result."""
    from tessera.sources import segments, token_index

    schema = "token string, cid string, count long"
    tokens = spark.createDataFrame([(f"t{i % 97}", f"c{i % 50}", i) for i in range(2_000)], schema)
    fresh, crawled = tokens.filter("cid = 'c7'").withColumn("count", F.lit(1).cast("bigint")), spark.createDataFrame([("c7",)], "cid string")

    def made(name):
        token_index.write(tokens, str(tmp_path / name))
        found = segments.replace(spark, segments.first_segment(str(tmp_path / name)), fresh, crawled, str(tmp_path / f"{name}-segment"))
        return found, segments.read(spark, found)

    _, few = made("few")
    want = sorted(map(tuple, few.collect()))
    monkeypatch.setattr(bindings, "SHARE", 100)
    _, many = made("many")
    assert sorted(map(tuple, many.collect())) == want
    assert len(list((tmp_path / "many").glob("*.parquet"))) >= 15  # 4 before
    assert "hashpartitioning(cid#" in (plan := many._jdf.queryExecution().executedPlan().toString()) and "REPARTITION_BY_NUM" in plan
