"""Sources that read what services return: snapshots, listings, records, samples, labelled lines, models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a sampled segment and of all segments together; fixed values.
SAMPLE_BYTES, MOST_SAMPLED = 262_144, 786_432
LISTING = "struct<Objects:array<struct<Hash:string,Links:array<struct<Name:string,Hash:string,Size:bigint,Type:int>>>>>"
RECORDS = "struct<domain:struct<name:string,records:array<struct<key:string,value:string>>>>"
CONTRACT = "struct<id:bigint,client:string,status:string,storage_gb_per_month:bigint,start_time:bigint,months_total:bigint,metadata:string>"


def pin_keys(snapshot: Column) -> Column:
    """The ids that a pin snapshot ``{"Keys": {id: ...}}`` holds; none for a broken one."""
    keys = F.map_keys(F.from_json(snapshot, "struct<Keys:map<string,string>>")["Keys"])
    return F.filter(F.coalesce(keys, F.array().cast("array<string>")), lambda k: F.trim(k) != "")


def pin_snapshot(snapshots: DataFrame, column: str) -> DataFrame:
    """(cid) of all snapshots, each once."""
    return snapshots.select(F.explode(pin_keys(F.col(column))).alias("cid")).distinct()


def directory_links(listings: DataFrame, column: str) -> DataFrame:
    """(parent_cid, place, cid, name, size, type) of listings; links without an id are dropped."""
    objects = listings.select(F.explode(F.from_json(column, LISTING)["Objects"]).alias("o"))
    links = objects.select(F.col("o.Hash").alias("parent_cid"), F.posexplode("o.Links").alias("place", "l"))
    kind = F.when(F.col("l.Type") == 1, "dir").when(F.col("l.Type") == 2, "file").otherwise("unknown")
    rows = links.select("parent_cid", "place", F.trim("l.Hash").alias("cid"), F.coalesce("l.Name", F.lit("")).alias("name"), F.col("l.Size").alias("size"), kind.alias("type"))
    return rows.filter("cid <> ''")


def capped(body: Column, most: int) -> Column:
    """The first ``most`` bytes and whether the body is longer."""
    return F.struct(F.substring(body, 1, most).alias("bytes"), (F.octet_length(body) > most).alias("truncated"))


def whole(body: Column, declared: Column, most: int) -> Column:
    """A body unless its declared or its own length is over ``most``."""
    large = F.coalesce(declared > most, F.lit(False)) | (F.octet_length(body) > most)
    return F.struct(large.alias("too_large"), F.when(~large, body).alias("bytes"))


def samples(content: Column, segment: int = SAMPLE_BYTES, most: int = MOST_SAMPLED) -> Column:
    """S3: struct (head, middle, tail) of a blob: the tail if it stands behind the head, the middle if it stands between both."""
    size = F.octet_length(content)
    taken = F.least(size, F.lit(segment))
    tail_at = size - segment
    tail = F.when((size > segment) & (taken < most) & (tail_at > taken - 1), F.substring(content, tail_at + 1, F.lit(segment)))
    mid_at = F.greatest(F.floor((size - segment) / 2).cast("int"), F.lit(0))
    mid_end = F.least(mid_at + segment - 1, size - 1)
    free = F.when(tail.isNull(), F.lit(True)).otherwise(mid_end < tail_at)
    two = taken + F.coalesce(F.octet_length(tail), F.lit(0))
    middle = F.when((size > 2 * segment) & (two < most) & free & (mid_at > taken - 1), F.substring(content, mid_at + 1, F.lit(segment)))
    return F.struct(F.substring(content, 1, segment).alias("head"), middle.alias("middle"), tail.alias("tail"))


def domain_records(details: DataFrame, column: str, owner: str) -> DataFrame:
    """(owner, domain, record_key, record_value) of domain details as a service returns them."""
    parsed = details.select(F.col(owner).alias("owner"), F.from_json(column, RECORDS)["domain"].alias("d"))
    rows = parsed.select("owner", F.lower(F.trim("d.name")).alias("domain"), F.explode("d.records").alias("r"))
    return rows.select("owner", "domain", F.trim("r.key").alias("record_key"), F.trim("r.value").alias("record_value")).filter("record_value <> ''")


def contracts(bodies: DataFrame, column: str) -> DataFrame:
    """Contracts as a service returns them."""
    return bodies.select(F.from_json(column, CONTRACT).alias("c")).select(
        "c.id", "c.client", "c.status", F.col("c.storage_gb_per_month").alias("storage_gb"), "c.start_time", "c.months_total"
    )


def labelled(lines: DataFrame, column: str = "value") -> DataFrame:
    """(label, text) of lines ``__label__X text``; blank lines and lines without a label or text are skipped."""
    line = F.trim(F.col(column))
    parsed = lines.select(F.regexp_extract(line, r"^__label__(\S+)\s+(.*)$", 1).alias("label"), F.trim(F.regexp_extract(line, r"^__label__(\S+)\s+(.*)$", 2)).alias("text"))
    return parsed.filter("label <> '' AND text <> ''")


def prices(config: DataFrame, column: str) -> DataFrame:
    """The plans of a pricing configuration; none where it is no array."""
    listed = config.filter(F.ltrim(column).startswith("["))  # an object would be read as an array of one
    return listed.select(F.explode(F.from_json(column, "array<struct<id:string,price:double>>")).alias("p")).select("p.*")


def save_model(model: DataFrame, path: str) -> None:
    """K1: a label-by-word model as one table of JSON documents, one a word, with a digest of each as its content id."""
    per_word = model.groupBy("word").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("counts"))
    body = F.to_json(F.struct("word", "counts"))
    per_word.select(body.alias("body"), F.concat(F.lit("cid-sha256-"), F.sha2(body, 256)).alias("content_id")).write.parquet(path)


def load_model(spark: SparkSession, path: str) -> DataFrame:
    """(word, label, n) of a saved model; a count that is no number counts as 0."""
    parsed = spark.read.schema("body string, content_id string").parquet(path).select(F.from_json("body", "struct<word:string,counts:map<string,string>>").alias("m"))
    rows = parsed.select("m.word", F.explode("m.counts").alias("label", "n"))
    return rows.select("word", "label", F.coalesce(F.expr("try_cast(n AS bigint)"), F.lit(0)).cast("bigint").alias("n"))
