"""The queries that apply each operator to its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import chat_digests

    spoken = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(spoken).alias("text"),
    )
    talks = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return chat_digests(talks.unionByName(extra))


def op2_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_records import token_digests

    return token_digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    tests = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = contamination(documents(spark, sf_dir), tests)
    return found.drop("key")


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import remove_repeats

    done = remove_repeats(documents(spark, sf_dir), length=400, keep="none")
    done = done.withColumn("repeats_passage", F.col("longest_factor") > 0)
    # what is left as text; a character that a cut splits shows as U+FFFD
    return done.withColumn("kept", F.make_valid_utf8(F.col("kept").cast("string")))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import predict_languages

    found = predict_languages(documents(spark, sf_dir))
    return found.withColumn("mixture", F.to_json("mixture"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import license_scan

    return license_scan(documents(spark, sf_dir))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    mixed = mix(documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source")


def op8_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import assign_shards

    return assign_shards(documents(spark, sf_dir), shards=24)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_rules

    return quality_rules(documents(spark, sf_dir))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import hex_fingerprint, simhash_components

    found = simhash_components(documents(spark, sf_dir), shingle=3, tau=2)
    return found.select("doc_id", hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .resampling import resample

    return resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import minhash_components

    return minhash_components(documents(spark, sf_dir))


def op13_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whiten

    found = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    # an error, not a wrong number, where the sum is too large for a long
    return found.withColumn("deviation", F.col("deviation").cast("bigint"))


def queries() -> dict:
    return {
        "op1_chat_format": op1_chat_format,
        "op2_token_records": op2_token_records,
        "op3_decontaminate": op3_decontaminate,
        "op4_substrings": op4_substrings,
        "op5_language": op5_language,
        "op6_license_scan": op6_license_scan,
        "op7_mix_sources": op7_mix_sources,
        "op8_shard": op8_shard,
        "op9_quality": op9_quality,
        "op10_simhash": op10_simhash,
        "op11_resample": op11_resample,
        "op12_minhash": op12_minhash,
        "op13_whiten": op13_whiten,
    }


def chat_oracle() -> str:
    """Lengths of the formatted text follow from the template: marks, doubled backslashes, broken control strings."""
    from .chat import Template

    t = Template()
    marks = len(t.turn) + len(t.body) + len(t.end)

    def escaped(x: str) -> str:
        quoted = [(c.replace("'", "''"), len(c)) for c in t.controls]
        broken = " + ".join(f"(length({x}) - length(replace({x}, '{c}', ''))) // {n}" for c, n in quoted)
        return f"length({x}) + length({x}) - length(replace({x}, chr(92), '')) + {broken}"

    return f"""WITH m AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) r(i))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn)) AS loss_sha256,
  CAST(sum({marks} + {escaped("role")} + {escaped("text")}) AS BIGINT) AS formatted_chars
FROM m GROUP BY conv_id"""


LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
BENCH_WORDS = "regexp_extract_all(" + LOWER.format("text") + ", '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
CONTAMINATION = f"""WITH dw AS (SELECT doc_id, {BENCH_WORDS} AS w FROM documents), iw AS (SELECT item_id, {BENCH_WORDS} AS w FROM benchmark),
  iwin AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (
    SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT item_id, w, least(13, len(w)) AS n FROM iw WHERE len(w) > 0))),
  lens AS (SELECT DISTINCT n FROM iwin),
  dwin AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM (
    SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, lens WHERE len(w) >= n)),
  m AS (SELECT doc_id, n, i, item_id FROM dwin JOIN iwin USING (n, s)),
  h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY 1),
  t AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""

SPLIT = "regexp_extract_all({0}, '[^\\x20\\x09-\\x0D]+')"
QUALITY = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, chr(0)) AS host FROM documents),
  b AS (SELECT doc_id, host, text, {SPLIT.format("text")} AS w FROM d),
  lines AS (SELECT doc_id, host, line, len({SPLIT.format("line")}) AS n FROM (SELECT doc_id, host, unnest(string_split(text, chr(10))) AS line FROM d)),
  full_lines AS (SELECT doc_id, host, line, n, trim(regexp_replace(regexp_replace({LOWER.format("line")}, '[0-9]+', '0', 'g'), '[ \\t\\x0b\\x0c\\r]+', ' ', 'g')) AS plain FROM lines WHERE n > 0),
  dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM full_lines GROUP BY 1),
  words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM b),
  tri AS (SELECT doc_id, p, x || ' ' || lead(x) OVER o || ' ' || lead(x, 2) OVER o AS g FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
  again AS (SELECT doc_id, p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM tri WHERE g IS NOT NULL) WHERE c > 1),
  rep AS (SELECT doc_id, count(DISTINCT q) AS n_repeat_words FROM (SELECT doc_id, unnest(range(p, p + 3)) AS q FROM again) GROUP BY 1),
  hosts AS (SELECT host, greatest(10.0, count(*) * 0.001) AS most FROM d GROUP BY 1),
  common AS (SELECT host, plain FROM (SELECT host, plain, count(DISTINCT doc_id) AS c FROM full_lines GROUP BY ALL) JOIN hosts USING (host) WHERE c > most),
  gone AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS removed_words FROM full_lines JOIN common USING (host, plain) GROUP BY 1),
  base AS (SELECT doc_id, len(w) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(removed_words, 0) AS removed_words
    FROM b LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id)),
  judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT *, NOT base_failed AND n_words - removed_words >= 50 AND removed_words <= 0.5 * n_words AS kept FROM judged"""

#: CRC-32 of the words' bytes by its table of 256 remainders; counts, gains and scores follow from the buckets.
RESAMPLE = f"""WITH RECURSIVE step(i, k, c) AS (SELECT i, 0, i FROM range(256) r(i)
    UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM step WHERE k < 8),
  remainders AS (SELECT list(c ORDER BY i) AS l FROM step WHERE k = 8),
  d AS (SELECT doc_id, {BENCH_WORDS} AS w FROM documents), t AS (SELECT unnest({BENCH_WORDS}) AS x FROM benchmark),
  dw AS (SELECT doc_id, unnest(w) AS x FROM d),
  words AS (SELECT DISTINCT x, hex(encode(x)) AS h FROM (SELECT x FROM dw UNION ALL SELECT x FROM t)),
  crc AS (SELECT x, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(range(1, len(h), 2), lambda i: CAST('0x' || h[i:i + 1] AS BIGINT))),
    lambda c, b: xor(c >> 8, l[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS b FROM words, remainders),
  s AS (SELECT b, count(*) AS n FROM dw JOIN crc USING (x) GROUP BY b), u AS (SELECT b, count(*) AS n FROM t JOIN crc USING (x) GROUP BY b),
  sizes AS (SELECT (SELECT count(*) FROM dw) AS s, (SELECT count(*) FROM t) AS t),
  gains AS (SELECT s.b, CAST(floor(1000 * ln((coalesce(u.n, 0) + 1)::DOUBLE * (z.s + 10000) / ((s.n + 1)::DOUBLE * (z.t + 10000)))) AS BIGINT) AS gain
    FROM s LEFT JOIN u ON s.b = u.b, sizes z),
  weights AS (SELECT doc_id, CAST(sum(gain) AS BIGINT) AS weight FROM dw JOIN crc USING (x) JOIN gains USING (b) GROUP BY doc_id),
  scored AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5) / 4294967296))) AS BIGINT) AS score
    FROM d LEFT JOIN weights USING (doc_id)),
  ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, rank FROM scored LEFT JOIN (SELECT doc_id, rank FROM ranked WHERE rank <= 10 * n // 100) USING (doc_id)"""

#: All pairs that share a shingle, counted in full, and what their links reach.
SIMILAR_SETS = f"""WITH RECURSIVE w AS (SELECT doc_id, {SPLIT.format(LOWER.format("text"))} AS w FROM documents),
  s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (
    SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS i FROM w WHERE len(w) > 0)),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
  links AS (SELECT x, y FROM shared JOIN n nx ON x = nx.doc_id JOIN n ny ON y = ny.doc_id WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
  both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
  reach(x, y) AS (SELECT x, y FROM both_ways UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x),
  least AS (SELECT x AS doc_id, min(y) AS y FROM reach GROUP BY x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, y) AS component_id, least(doc_id, y) = doc_id AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN least USING (doc_id)"""

#: The other operators hash, tokenize, train or search in ways that SQL can't express.
ORACLES: dict[str, str] = {"op1_chat_format": chat_oracle(), "op3_decontaminate": CONTAMINATION, "op9_quality": QUALITY, "op11_resample": RESAMPLE, "op12_minhash": SIMILAR_SETS}
