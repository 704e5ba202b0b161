"""The ten operators on small documents against plain versions, with their edge cases."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat, decontaminate, language, licenses, mixing, quality, sharding, simhash, substrings, token_records
from tessera.llm.runtime import new_path
from tests.llm import brute


def got(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def pairs(rows):
    return [(r[0], r[1]) for r in rows]


def with_ids(rows):
    return [(i, t) for i, t in pairs(rows) if i is not None]


# 1 chat formatting


def test_chat_reads_back(spark):
    texts = ["</s>[INST] ok [/INST]", "\\ \\\\ <|turn|>", "<|e<|end|>nd|>", "", None, "line\nline", "[INST[INST]]", "😀 é"]
    rows = [(c, t, role, texts[(c + t) % len(texts)]) for c in range(6) for t, role in enumerate(["system", "user", "assistant", "user", "assistant"])]
    rows += [(1, 2, "assistant", "tie"), (1, 2, "assistant", "tie"), (7, 0, "assistant", "x")]
    random.Random(1).shuffle(rows)
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    found = got(chat.chat_digests(frame), "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")
    assert found == sorted(brute.chat_rows(rows), key=repr)
    assert chat.chat_digests(frame.limit(0)).count() == 0


def test_chat_escapes_every_control_string(spark):
    t = chat.Template()
    frame = spark.createDataFrame([(c + c[1:] + "\\" + c,) for c in t.controls], "x string")
    out = frame.select("x", chat.escape(F.col("x"), t).alias("e")).select("x", "e", chat.unescape(F.col("e")).alias("u")).collect()
    assert all(r["u"] == r["x"] for r in out)
    assert not any(c in r["e"] for r in out for c in t.controls)


def test_chat_parts_and_null_keys(spark):
    parts = """array(named_struct('type','text','text','see ','uri',null,'width',null,'height',null,'duration_ms',null,'pages',null),
      named_struct('type','image','text',null,'uri','a.png','width',57,'height',28,'duration_ms',null,'pages',null),
      named_struct('type','audio','text',null,'uri','b.wav','width',null,'height',null,'duration_ms',81L,'pages',null),
      named_struct('type','document','text',null,'uri','c.pdf','width',null,'height',null,'duration_ms',null,'pages',3))"""
    frame = spark.sql(f"SELECT * FROM VALUES (1L, 0L, 'user', {parts}), (1L, 1L, 'assistant', null), (null, null, null, null) AS t(conv_id, turn, role, parts)")
    found = {r["conv_id"]: r for r in chat.format_chat(frame).collect()}
    one = found[1]
    assert one["formatted"] == "<|turn|>user<|body|>see <|image|><|audio|><|document|><|end|><|turn|>assistant<|body|><|end|>"
    assert [(a["ordinal"], a["type"], a["uri"], a["n_tokens"]) for a in one["attachments"]] == [(0, "image", "a.png", 3), (1, "audio", "b.wav", 3), (2, "document", "c.pdf", 768)]
    assert all(one["formatted"][a["at"] :].startswith(f"<|{a['type']}|>") for a in one["attachments"])
    assert one["expanded_tokens"] == 774 and [tuple(s) for s in one["loss_spans"]] == [(len(one["formatted"]) - 7,) * 2]
    assert found[None]["formatted"] == "<|turn|><|body|><|end|>"


def test_chat_runs_no_python(spark):
    frame = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = chat.chat_digests(frame)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_chat_mask_is_the_same_in_spans_and_segments(spark):
    said = [(i % 3, i, ("user", "assistant", "system")[i % 3 if i % 5 else 1], f"é text {i} <s> \\ [/INST] " * (i % 4)) for i in range(400)]
    frame = spark.createDataFrame(said, "conv_id long, turn long, role string, text string")
    rows = chat.format_chat(frame.select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts"))).collect()
    for r in rows:
        assert "".join(s["text"] for s in r["segments"]) == r["formatted"]
        masked = [s["text"] for s in r["segments"] if s["loss"]]
        assert [r["formatted"][a:b] for a, b in r["loss_spans"]] == masked and len(masked) > 20


def test_chat_of_many_turns(spark):
    """A conversation of 30,000 turns is formatted in one go; work in proportion to the square would not end."""
    n = 30_000
    text = F.concat(F.lit("turn "), F.col("id").cast("string"), F.lit(" </s>"))
    role = F.when(F.col("id") % 2 == 0, "user").otherwise("assistant")
    frame = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), text.alias("text"))
    row = chat.chat_digests(frame).first()
    assert row["n_turns"] == n and row["loss_chars"] == sum(len(f"turn {i} </s>") for i in range(1, n, 2))


# 2 token records


def test_token_records(docs, rows, tokenizer):
    named = docs.filter("doc_id IS NOT NULL")
    found = got(token_records.token_digests(named, tokenizer, 2), "doc_id", "start", "n_tokens", "ids_crc32")
    assert found == sorted(brute.token_rows(with_ids(rows), tokenizer, 2), key=repr)


def test_token_records_edges(docs, empty, tokenizer, spark):
    assert token_records.token_digests(empty, tokenizer, 2).count() == 0
    first = token_records.token_digests(docs, tokenizer, 2).orderBy("start").first()
    assert first["doc_id"] is None and first["start"] == 0
    path = new_path(spark, "t")
    token_records.write_token_records(docs, path, tokenizer, 2)
    a, b = (token_records.read_shuffled(spark, path, seed).collect() for seed in (1, 2))
    assert [r["doc_id"] for r in a] != [r["doc_id"] for r in b]
    assert sorted(map(tuple, (r["ids"] for r in a))) == sorted(map(tuple, (r["ids"] for r in b)))
    assert len(a) == docs.count()


def test_token_records_over_many_files(docs, rows, tokenizer, spark, monkeypatch):
    """Several parts, files and verified slices give the same rows; the reader finds every record."""
    monkeypatch.setattr(token_records, "PART_BYTES", 20_000)
    monkeypatch.setattr(token_records, "FILE_BYTES", 4_000)
    named, path = docs.filter("doc_id IS NOT NULL"), new_path(spark, "many")
    found = token_records.token_digests(named, tokenizer, 2, path)
    assert got(found, "doc_id", "start", "n_tokens", "ids_crc32") == sorted(brute.token_rows(with_ids(rows), tokenizer, 2), key=repr)
    files = found.groupBy("part", "shard").count().collect()
    assert len({r["part"] for r in files}) > 1 and len(files) > len({r["part"] for r in files})
    content = token_records.data_files(spark, path).collect()
    monkeypatch.setattr(token_records, "SLICE_BYTES", 100)
    crc = token_records.crc32c_many()
    assert sum(len(token_records.split_frames(memoryview(r["content"]), crc)) for r in content) == named.count()
    assert token_records.read_shuffled(spark, path, 3).count() == named.count()


def test_encoder_is_the_library(tokenizer):
    from tokenizers import Tokenizer

    encode, width = token_records.text_encoder(tokenizer)
    library, rnd = Tokenizer.from_file(tokenizer), random.Random(5)
    letters = ["a", "b", " ", "  ", "\n", "\t", "'s", "é", "1", "²", "ñ", "_", "😀", "\x1c", "中", "́", "ǅ", ".", ",", "<|endoftext|>", "\xa0", "’"]
    for _ in range(4000):
        t = "".join(rnd.choices(letters, k=rnd.randint(0, 14)))
        assert np.frombuffer(encode(t), "<u2").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)
    for c in map(chr, (*range(0xD800), *range(0xE000, 0x10000))):  # the classes of characters agree
        t = f"a {c}b{c}1 {c}{c}."
        assert np.frombuffer(encode(t), "<u2").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_checksums_and_damage():
    crc = token_records.crc32c_many()
    assert [hex(x) for x in crc([b"123456789", bytes(32), b"\xff" * 32])] == ["0xe3069283", "0x8a9136aa", "0x62a8ab43"]
    frame = b"\x09" + bytes(7)
    good = frame + token_records.mask(crc([frame])).astype("<u4").tobytes() + b"123456789" + token_records.mask(crc([b"123456789"])).astype("<u4").tobytes() + b"\n"
    assert token_records.split_frames(memoryview(good), crc) == [(0, b"123456789")]
    for at in (3, 9, 14, 23, 25):
        bad = bytearray(good)
        bad[at] ^= 1
        with pytest.raises((ValueError, Exception)):
            token_records.split_frames(memoryview(bytes(bad)), crc)


# 3 decontamination


def test_contamination(spark, docs, rows, empty):
    texts = dict(with_ids(rows))
    words = re.findall(r"\w+", texts[5])
    items = [(1, " ".join(words[10:40])), (2, texts[27]), (11, "ha ha ha"), (3, None), (4, "!!"), (5, " ".join(words[20:33])), (5, texts[8][:200])]
    tests = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, runs string")
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    found = got(decontaminate.contamination(docs, tests), *columns)
    assert found == sorted(brute.contamination_rows(pairs(rows), items), key=repr)
    assert decontaminate.contamination(empty, tests).count() == 0
    assert not decontaminate.contamination(docs, tests.limit(0)).filter("contaminated").count()
    kept = decontaminate.drop_contaminated(docs, tests)
    assert kept.columns == docs.columns
    bad = {r[0] for r in found if r[-1]}
    assert bad and sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted((r[0] for r in found if r[0] not in bad), key=repr)


def test_contamination_in_blocks_is_the_same(spark, docs, rows, monkeypatch):
    texts = dict(with_ids(rows))
    items = [(i, texts[i][50:400]) for i in (5, 7, 8, 10, 11)]
    tests = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 100)
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got(decontaminate.contamination(docs, tests), *columns) == sorted(brute.contamination_rows(pairs(rows), items), key=repr)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "red green blue"), (2, "red x green blue"), (3, "blue green red"), (4, "red a b c d green blue")], "doc_id long, text string")
    tests = spark.createDataFrame([(9, "red green blue")], "item_id long, text string")
    assert got(decontaminate.proximity_matches(docs, tests, 0), "doc_id") == [(1,)]
    assert got(decontaminate.proximity_matches(docs, tests, 1), "doc_id") == [(1,), (2,)]
    # from "red", the others stand four words off their places in 3 and 4
    assert got(decontaminate.proximity_matches(docs, tests, 3), "doc_id") == [(1,), (2,)]
    assert got(decontaminate.proximity_matches(docs, tests, 4), "doc_id") == [(1,), (2,), (3,), (4,)]


def test_items_in_pieces_and_blocks_hit_alike(spark, docs, rows, monkeypatch):
    """Long items cut into overlapping pieces, dealt to many blocks, match as whole ones do."""
    texts = dict(with_ids(rows))
    items = [(i, texts[i]) for i in (5, 7, 8, 15)] + [(5, texts[5]), (40, "nothing of the kind " * 30)]
    tests = spark.createDataFrame(items, "item_id long, text string")
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    whole = got(decontaminate.contamination(docs, tests), *columns)
    monkeypatch.setattr(decontaminate, "PIECE_WINDOWS", 7)
    monkeypatch.setattr(decontaminate, "SEGMENT_BYTES", 3_000)
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 900)
    assert got(decontaminate.contamination(docs, tests), *columns) == whole
    assert sum(r[-1] for r in whole) >= 4


# 4 substrings


@pytest.mark.parametrize("cap", [4096, 1])
def test_repeats_removed_everywhere(docs, rows, cap, monkeypatch):
    monkeypatch.setattr(substrings.repeated_intervals, "__defaults__", (cap, 8 << 20))
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    found = got(substrings.remove_repeats(docs, 400, "none"), *columns)
    assert found == sorted(brute.repeat_rows(pairs(rows), 400), key=repr)


@pytest.mark.parametrize("cap", [4096, 1])
def test_repeats_keep_the_first(spark, rows, cap, monkeypatch):
    monkeypatch.setattr(substrings.repeated_intervals, "__defaults__", (cap, 8 << 20))
    once = [r for i, r in enumerate(sorted(with_ids(rows))) if r[0] != 32 or i % 2]
    once = list(dict(once).items())
    frame = spark.createDataFrame(once, "doc_id long, text string")
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    found = got(substrings.remove_repeats(frame, 400, "first"), *columns)
    assert found == sorted(brute.repeat_rows(once, 400, "first"), key=repr)


def test_repeats_of_nothing(empty):
    assert substrings.remove_repeats(empty).count() == 0


def test_suffix_order():
    raw = np.frombuffer(b"banana$banana#ananas", np.uint8)
    for length in (8, 11, 16, 20, 30, 60, 100):
        rank = substrings.order_to(raw, length)
        text = raw.tobytes() + b"\x00" * length
        heads = [text[i : i + length] for i in range(len(raw))]
        assert [sorted(set(heads)).index(h) for h in heads] == rank.tolist()


def plain_factors(raw: bytes, starts: list[int], most: int) -> list[int]:
    def common(i: int, j: int) -> int:
        return next((k for k in range(most) if raw[i + k] != raw[j + k]), most)

    return [max((common(i, j) for j in starts[:k]), default=0) for k, i in enumerate(starts)]


def test_previous_factors():
    rnd = np.random.default_rng(7)
    for _ in range(80):
        most = int(rnd.choice([8, 13, 16, 40]))
        raw = rnd.integers(0, rnd.choice([1, 2, 3, 40]), int(rnd.integers(most, 160))).astype(np.uint8)
        starts = np.flatnonzero(rnd.random(len(raw) - most + 1) < rnd.choice([0.4, 1]))
        factors, source = substrings.previous_factors(raw, starts, most)
        assert factors.tolist() == plain_factors(raw.tobytes(), starts.tolist(), most)
        for k in np.flatnonzero(factors):
            i, j = starts[k], starts[source[k]]
            assert source[k] < k and (raw[i : i + factors[k]] == raw[j : j + factors[k]]).all()


def test_factors_from_a_window_on():
    rnd = np.random.default_rng(11)
    for turn in range(120):
        window, most = [(8, 13), (8, 8), (9, 40), (16, 33)][turn % 4]
        raw = rnd.integers(0, rnd.choice([1, 2, 3]), int(rnd.integers(most, 400))).astype(np.uint8)
        at = int(rnd.integers(0, len(raw)))
        raw[at : at + 60] = raw[:60][: len(raw[at : at + 60])]
        starts = np.flatnonzero(rnd.random(len(raw) - most + 1) < rnd.choice([0.4, 1]))
        factors, source = substrings.factors_from(raw, starts, window, most, np.zeros(len(starts), np.int64))
        plain = np.array(plain_factors(raw.tobytes(), starts.tolist(), most), np.int64)
        assert (np.where(factors < window, 0, factors) == np.where(plain < window, 0, plain)).all()
        for k in np.flatnonzero(factors):
            i, j = starts[k], starts[source[k]]
            assert source[k] < k and (raw[i : i + factors[k]] == raw[j : j + factors[k]]).all()


def test_factors_do_not_trust_hashes(monkeypatch):
    """With a hash of two values strings of equal hashes differ; the factors are those of the bytes."""
    rnd, grams = np.random.default_rng(12), substrings.gram_hashes
    monkeypatch.setattr(substrings, "gram_hashes", lambda raw, gram: grams(raw, gram) & np.uint64(1))
    raw = rnd.integers(0, 3, 300).astype(np.uint8)
    raw[200:260] = raw[20:80]
    starts = np.arange(300 - 40 + 1)
    factors, _ = substrings.factors_from(raw, starts, 16, 40, np.zeros(len(starts), np.int64))
    plain = np.array(plain_factors(raw.tobytes(), starts.tolist(), 40))
    assert (np.where(factors < 16, 0, factors) == np.where(plain < 16, 0, plain)).all() and factors.max() == 40


@pytest.mark.parametrize("caps", [(4096, 8 << 20), (1, 8 << 20)])
@pytest.mark.parametrize("keep", ["none", "first"])
def test_every_passage_from_256_bytes_is_noted(spark, keep, caps, monkeypatch):
    """At any place of the texts, also at their ends and in texts of under 400 bytes; shorter ones are not."""
    monkeypatch.setattr(substrings.repeated_intervals, "__defaults__", caps)
    rnd = random.Random(5)
    text = lambda n: "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz ", k=n))
    rows, wanted = [], {}
    for k in range(60):
        n = (256, 257, 300, 340, 399, 240)[k % 6]
        passage = text(n)
        for side in range(2):
            before, after = (0, rnd.randint(0, 600), rnd.randint(0, 600))[k % 3], (rnd.randint(1, 600), 0, rnd.randint(0, 600))[k % 3]
            wanted[len(rows)] = n if n >= 256 else 0
            # other characters beside the passage, so that it is the whole of what both texts share
            rows.append((len(rows), text(before) + "XY"[side] + passage + ("PQ"[side] + text(after) if after else "")))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = {r["doc_id"]: r for r in substrings.remove_repeats(frame, 400, keep).collect()}
    exact = {i: r["longest_factor"] for i, r in found.items()}
    if caps[0] > 1:
        assert exact == wanted
    else:  # counted by hash: noted alike, with 256 or the length of a copy that ends a text
        assert all(min(n, 256) <= exact[i] <= n for i, n in wanted.items())
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted((tuple(r[c] for c in columns) for r in found.values()), key=repr) == sorted(brute.repeat_rows(rows, 400, keep), key=repr)


@pytest.mark.parametrize("keep", ["none", "first"])
def test_repeats_over_many_buckets(spark, rows, keep, monkeypatch):
    """Slices of texts, buckets and suffix orders of a few kilobytes give the same rows."""
    monkeypatch.setattr(substrings, "ORDER_BYTES", 4_000)
    monkeypatch.setattr(substrings, "BUCKET_BYTES", 6_000)
    monkeypatch.setattr(substrings, "SLICE_BYTES", 3_000)
    once = list(dict(with_ids(rows)).items())
    frame = spark.createDataFrame(once, "doc_id long, text string").repartition(5)
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got(substrings.remove_repeats(frame, 400, keep), *columns) == sorted(brute.repeat_rows(once, 400, keep), key=repr)


@pytest.mark.parametrize("caps", [(2, 8 << 20), (4096, 3_000)])
def test_notes_and_removal_do_not_depend_on_the_cap(spark, caps, monkeypatch):
    """Passages of 300 and 380 bytes that many share, a frequent one of 500, periodic texts and runs of one letter."""
    rnd = random.Random(8)
    text = lambda n: "".join(rnd.choices("abcdefghijklmnop ", k=n))
    shared = [text(300), text(380), text(500)]
    rows = [(i, text(rnd.randint(200, 600)) + shared[i % 3] + text(rnd.randint(200, 600))) for i in range(60)]
    rows += [(60, "a" * 5_000), (61, "a" * 401), (62, "a" * 400), (63, "ab" * 900 + text(300)), (64, text(37) * 30), (65, "b" * 402), (66, text(500))]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    plain = substrings.remove_repeats(frame, 400, "none").withColumn("noted", F.col("longest_factor") > 0)
    want, before = got(plain, *columns), got(plain, "doc_id", "noted")
    assert want == sorted(brute.repeat_rows(rows, 400), key=repr)
    monkeypatch.setattr(substrings.repeated_intervals, "__defaults__", caps)
    monkeypatch.setattr(substrings, "WINDOW_ROWS", 1_000)
    low = substrings.remove_repeats(frame, 400, "none").withColumn("noted", F.col("longest_factor") > 0)
    assert got(low, *columns) == want and got(low, "doc_id", "noted") == before
    assert sum(n for _, n in before) > 50


def test_longest_factors_are_common_strings(spark):
    """Passages of 300 bytes stay and are noted, if at all, on the documents that share them."""
    from tests.llm.conftest import prose

    passage = [prose(500 + i, 90).replace("\n", " ")[:300] for i in range(12)]
    rows = [(i, prose(i, 200) + " " + passage[i % 12] + " " + prose(900 + i, 200)) for i in range(24)] + [(50 + i, prose(2000 + i, 300)) for i in range(10)]
    found = {r["doc_id"]: r for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 400, "none").collect()}
    assert all(r["n_removed"] == 0 for r in found.values())
    noted = {i for i, r in found.items() if r["longest_factor"]}
    assert noted <= set(range(24)) and len(noted) >= 12 and {(i + 12) % 24 for i in noted} == noted
    texts = dict(rows)
    for i in noted:  # a string of that length stands in the other document
        n, other = found[i]["longest_factor"], texts[(i + 12) % 24]
        assert n >= substrings.LEAST_FACTOR and any(texts[i][k : k + n] in other for k in range(len(texts[i]) - n + 1))


# 5 language


def language_docs(spark):
    rnd, rows = random.Random(2), []
    words = {"xx": ["kala", "mina", "tule", "saan"], "yy": ["gross", "wurz", "strand", "pfahl"], "zz": ["rio", "calle", "niño", "agua"]}
    for i in range(240):
        lang = "xyz"[i % 3] * 2
        rows.append((i, " ".join(rnd.choices(words[lang], k=30)), lang))
    mixed = " ".join(rnd.choices(words["xx"], k=60) + rnd.choices(words["yy"], k=30))
    rows += [(300, mixed, None), (301, None, "xx"), (302, "", None), (303, "12 !", "yy"), (None, "kala kala kala", None)]
    return spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, lang string, lang_pred string")


def test_language(spark):
    frame = language_docs(spark)
    found = {r["doc_id"]: r for r in language.predict_languages(frame).collect()}
    truth = {r["doc_id"]: r["lang"] for r in frame.collect()}
    held = [i for i, r in found.items() if r["held_out"] and i is not None and i < 300]
    assert held and all(found[i]["lang_pred"] == truth[i] for i in held)
    assert all(found[i]["lang_pred"] == "und" and found[i]["score"] == 0.0 for i in (301, 302, 303))
    assert found[300]["lang_pred"] == "xx" and set(found[300]["mixture"]) == {"xx", "yy"} and 0.5 < found[300]["score"] < 0.8
    assert found[None]["lang_pred"] == "xx" and not found[None]["held_out"]
    assert all(0 <= r["score"] <= 1 for r in found.values())


def test_language_ignores_held_out_labels(spark):
    frame = language_docs(spark)
    wrong = frame.withColumn("lang", F.when(language.is_training_row(F.col("doc_id")), F.col("lang")).otherwise("qq"))
    assert got(language.predict_languages(frame), "doc_id", "lang_pred", "score") == got(language.predict_languages(wrong), "doc_id", "lang_pred", "score")


def test_language_of_nothing(spark):
    frame = language_docs(spark)
    assert language.predict_languages(frame.limit(0)).count() == 0
    unlabelled = frame.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language.predict_languages(unlabelled).collect()} == {"und"}
    kept = language.keep_known(frame)
    assert kept.columns == frame.columns and kept.count() == 242


def plain_mixture(cells, model, rules):
    """Expectation-maximisation over single trigrams, in plain loops, and the set of the best penalised likelihood."""
    import math

    def em(langs):
        share = {k: 1 / len(langs) for k in langs}
        for _ in range(rounds if len(langs) > 1 else 0):
            gained = dict.fromkeys(langs, 0.0)
            for c in cells:
                total = sum(share[k] * float(model[c][k]) for k in langs)
                for k in langs:
                    gained[k] += share[k] * float(model[c][k]) / total
            share = {k: g / len(cells) for k, g in gained.items()}
        fit = sum(math.log(sum(share[k] * float(model[c][k]) for k in langs)) for c in cells) / rules.overlap
        return share, fit

    rounds = rules.rounds
    whole, _ = em(list(range(model.shape[1])))
    order = sorted(whole, key=lambda k: (-whole[k], k))
    best = None
    for k in range(1, max(1, sum(s >= rules.least_share for s in whole.values())) + 1):
        share, fit = em(order[:k])
        value = fit - rules.penalty * 0.5 * (k - 1) * math.log(len(cells) / rules.overlap + 1)
        if best is None or value > best[0]:
            best = value, share
    return best[1]


def test_mixture_is_plain_expectation_maximisation(spark):
    frame, rules = language_docs(spark), language.MixtureRules()
    langs, model = language.train(frame.filter("doc_id < 200"), rules)
    cells = language.trigram_cells()
    rows = [r["text"] for r in frame.collect() if r["text"] and len(r["text"]) > 9]
    for text in [*rows[::17], rows[0] + " " + rows[1], " ".join(rows[0:3]), rows[-2]]:
        found, wanted = language.infer(cells([text])[0], model, rules), plain_mixture(cells([text])[0].tolist(), model, rules)
        assert set(found) == set(wanted) and all(abs(found[k] - wanted[k]) < 1e-6 for k in found), text[:40]


# 6 licenses


def test_license_scan(spark, empty, docs):
    texts = licenses.TEMPLATES
    body = "filler words here\n"
    rows = [
        (1, body + texts["MIT"] + "\n" + body), (2, body * 3 + texts["Apache-2.0"]), (3, texts["MIT-text"].upper().replace(" ", "\n")),
        (4, body), (5, None), (6, ""), (7, texts["GPL-3.0"] + "\n" + texts["GPL-3.0"]), (8, "license license license"),
    ]
    frame = spark.createDataFrame([(*r, "y") for r in rows], "doc_id long, text string, license string")
    found = {r["doc_id"]: r for r in licenses.license_scan(frame).collect()}
    assert {i: r["license"] for i, r in found.items()} == {1: "MIT", 2: "Apache-2.0", 3: "MIT-text", 4: None, 5: None, 6: None, 7: "GPL-3.0", 8: None}
    assert found[1]["coverage"] == 1.0 and (found[1]["first_word"], found[1]["end_word"]) == (3, 8)
    assert licenses.license_scan(empty).count() == 0 and licenses.license_scan(docs).filter("license IS NOT NULL").count() == 0


def test_patience_takes_all_that_is_left_of_distinct_words():
    rnd = random.Random(3)
    for _ in range(200):
        template = rnd.sample(range(60), 20)
        text = [x for x in template if rnd.random() < 0.8]
        for _ in range(10):
            text.insert(rnd.randint(0, len(text)), rnd.randint(100, 140))
        found = licenses.patience(list(map(str, text)), list(map(str, template)))
        assert all(str(text[a]) == str(template[b]) for a, b in found)
        assert [p[0] for p in found] == sorted({p[0] for p in found}) and [p[1] for p in found] == sorted({p[1] for p in found})
        assert len(found) == sum(x in template for x in text)


@pytest.mark.parametrize("seed", range(6))
def test_spread_changed_and_repeated_notices_against_what_was_planted(seed):
    """Copies of a template with words cut and strange words put in, near and far from each other: every one with its place and coverage."""
    rnd = random.Random(seed)
    for _ in range(12):
        n = rnd.choice([8, 25, 60])
        template = [f"t{i}" for i in range(n)]
        for i in rnd.sample(range(n), n // 12):  # words that stand twice in the template
            template[i] = template[rnd.randrange(n)]
        strange = lambda k: [f"s{rnd.randrange(500)}" for _ in range(k)]
        words, planted = strange(rnd.randint(0, 30)), []
        for _ in range(rnd.randint(1, 4)):
            gone = set(rnd.sample(range(n), rnd.randint(0, n // 10)))
            spread, begin, copy = rnd.choice([0, 0, 1, 3]), None, []
            for i, w in enumerate(template):
                if i not in gone:
                    copy += strange(rnd.randint(0, spread)) if copy else []
                    copy.append(w)
            planted.append((len(words), len(words) + len(copy), n - len(gone)))
            words += copy + strange(rnd.randint(0, 3 * n))
        found = licenses.places("x", words, template, 0.8)
        assert all(a[4] <= b[3] for a, b in zip(found, found[1:], strict=False))
        assert [(f[3], f[4]) for f in found if f[2] >= 0.8 * n] and all(f[1] == f[2] / n for f in found)
        for first, end, kept in planted:
            # one place lies over each copy, with all words that the repeats inside the template leave no doubt about
            over = [f for f in found if f[3] < end and f[4] > first]
            assert len(over) == 1 and over[0][2] >= min(kept, 0.8 * n)
        assert len(found) == len(planted)


def test_spread_notices_that_stand_twice_are_found(spark):
    words = licenses.words_of(licenses.TEMPLATES["MIT-text"])
    spread = " ".join(x for w in words for x in (w, "alpha", "beta", "gamma"))
    rows = [(1, spread), (2, f"{spread} and then {spread}"), (3, " ".join([spread] * 4))]
    found = {r["doc_id"]: r for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for doc_id, copies in ((1, 1), (2, 2), (3, 4)):
        assert found[doc_id]["license"] == "MIT-text" and found[doc_id]["coverage"] == 1.0
        assert sum(x["license"] == "MIT-text" and x["coverage"] == 1.0 for x in found[doc_id]["notices"]) == copies


def test_repeated_and_changed_notices_are_found(spark):
    words = licenses.TEMPLATES["GPL-3.0-notice"].split()
    wrapped = "\n".join("# " + " ".join(words[i : i + 7]) for i in range(0, len(words), 7))
    code = "\n".join(f"x{i} = f{i}(y{i})" for i in range(300))
    once = [i for i, w in enumerate(words) if Counter(licenses.words_of(" ".join(words)))[w.lower().strip(":,.()")] == 1]
    texts = [wrapped + "\n" + wrapped, "\n".join([wrapped, code, wrapped, code, wrapped])]
    for n in (7, 8):
        changed = set(once[:: len(once) // n][:n])
        texts.append(" ".join(f"changed{i}" if i in changed else w for i, w in enumerate(words)))
    found = licenses.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    rows = {r["doc_id"]: r for r in found}
    assert {r["license"] for r in found} == {"GPL-3.0-notice"}
    total = len(licenses.words_of(" ".join(words)))
    assert [rows[i]["n_matched"] for i in range(4)] == [total, total, total - 7, total - 8]


@pytest.mark.parametrize("name", ["MIT-text", "BSD-3-Clause", "GPL-3.0-notice", "Apache-2.0-notice", "MIT-license", "Zlib"])
def test_every_copy_of_a_notice_is_found_with_its_place(spark, name):
    words = licenses.TEMPLATES[name].split()
    wrapped = "\n".join("# " + " ".join(words[i : i + 9]) for i in range(0, len(words), 9))
    code = "\n".join(f"x{i} = f{i}(y{i})" for i in range(60))
    texts = [wrapped + "\n" + wrapped, f"{code}\n{wrapped}\n{code}\n{wrapped}\n{code}\n{wrapped}"]
    rows = licenses.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    n, gap = len(licenses.words_of(licenses.TEMPLATES[name])), len(licenses.words_of(code))
    places = [[(r["first_word"], r["end_word"]) for r in row["notices"] if r["license"] == name] for row in rows]
    assert places == [[(0, n), (n, 2 * n)], [(gap * (k + 1) + n * k, (gap + n) * (k + 1)) for k in range(3)]]
    assert all(r["coverage"] == 1.0 for row in rows for r in row["notices"])


def test_no_templates_and_templates_without_words(spark):
    frame = spark.createDataFrame([(1, licenses.TEMPLATES["MIT"])], "doc_id long, text string")
    for templates in ({}, {"odd": "..."}):
        row = licenses.license_scan(frame, templates).first()
        assert (row["license"], row["coverage"], row["notices"]) == (None, 0.0, [])


def test_patience_of_distinct_words_is_the_longest_ascending_run():
    rnd = random.Random(4)
    for _ in range(150):
        n = rnd.randint(1, 40)
        template, text = list(range(n)), rnd.sample(range(n + 10), n)
        best = []
        for x in text:  # plain dynamic programming over all pairs
            best.append((x, 1 + max((b for y, b in best if y < x and y < n), default=0) if x < n else 0))
        found = licenses.patience(list(map(str, text)), list(map(str, template)))
        # equal words at both ends are taken before anchors, which never costs a pair of a longest run
        assert len(found) == max(b for _, b in best)
        assert all(text[a] == template[b] for a, b in found)


# 7 mixing


def test_mix(spark, docs, rows, empty):
    found = mixing.mix(docs).collect()
    again = got(mixing.mix(docs.repartition(7)), "doc_id", "size", "taken")
    assert again == sorted(((r["doc_id"], r["size"], r["taken"]) for r in found), key=repr)
    sizes = [len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows]
    assert sorted(r["size"] for r in found) == sorted(sizes)
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in found)
    by = {}
    for r in found:
        x = by.setdefault(r["source"], [0, 0, r["target"], r["source_size"]])
        x[0] += r["size"]
        x[1] += r["taken"]
    names = sorted((s for s in by if s is not None)) + [None] * (None in by)
    caps, weights = {s: 3 * by[s][0] for s in by}, {s: i % 3 + 1 for i, s in enumerate(names)}
    targets, open_sources, left = {}, set(by), float(sum(sizes))
    while open_sources:
        level = left / sum(weights[s] for s in open_sources)
        full = {s for s in open_sources if level * weights[s] > caps[s]}
        if not full:
            targets |= {s: level * weights[s] for s in open_sources}
            break
        targets |= {s: float(caps[s]) for s in full}
        left -= sum(caps[s] for s in full)
        open_sources -= full
    for s, (size, taken, target, source_size) in by.items():
        assert source_size == size and target == pytest.approx(targets[s])
        assert abs(taken - target) <= 25
    assert mixing.mix(empty).count() == 0
    assert {r["taken"] for r in mixing.mix(docs.filter("doc_id IN (24, 25)")).collect()} == {0}


def test_small_and_part_block_sources_meet_their_targets(spark):
    sizes = {"a": 20_000, "b": 30, "c": 1_500, "d": 9_100, "e": 1, "f": 250_000}
    texts = [(s, n if i == 0 else 500) for s, size in sizes.items() for i, n in enumerate([size % 500, *[0] * (size // 500)])]
    docs = spark.createDataFrame([(i, "w " * n, s) for i, (s, n) in enumerate(texts)], "doc_id long, text string, source string")
    rows = mixing.sized(docs)
    plan = mixing.MixPlan(sum(sizes.values()), 1_000)
    targets = mixing.source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), plan.words)
    taken = mixing.with_taken(mixing.lay_out(rows, targets, len(texts), 1), targets, plan).collect()
    for source, size in sizes.items():
        mine = [r for r in taken if r["source"] == source]
        target, block = mine[0]["target"], -(-size // max(-(-size // 1_000), min(size, 16)))
        assert sum(r["size"] for r in mine) == size
        assert abs(sum(r["taken"] for r in mine) - target) <= (0 if target == 3 * size else block)
    slots = mixing.schedule(spark, targets, plan).collect()
    assert sorted(r["slot"] for r in slots) == list(range(len(slots)))


def test_schedule_is_the_golden_ratio_sequence(spark):
    """Slots, ranks and blocks against a plain walk over the points."""
    counts = {"a": 90, "b": 37, "c": 5}
    rows = [(i, s, n * 10, float(n * 10)) for i, (s, n) in enumerate(counts.items())]
    targets = spark.createDataFrame(rows, "source_id long, source string, source_size long, target double")
    found = mixing.schedule(spark, targets, mixing.MixPlan(1_320, 10)).orderBy("slot").collect()
    blocks = {i: max(n, min(n * 10, 16)) for i, (_, n) in enumerate(counts.items())}
    slots, total = {i: blocks[i] for i in blocks}, sum(blocks.values())
    points = sorted((i * mixing.GOLDEN % (1 << 32), i) for i in range(total))
    place = {i: k for k, (_, i) in enumerate(points)}
    seen = {i: 0 for i in slots}
    for r in found:
        k, upto = place[r["slot"]], 0
        source = next(i for i in slots if (upto := upto + slots[i]) > k)
        assert (r["source_id"], r["rank"], r["block"]) == (source, seen[source], seen[source] % blocks[source])
        seen[source] += 1
    assert seen == slots


def test_mixed_blocks_are_the_mix_in_slot_order(docs, rows):
    # a scan may take files in any order; by name they hold the mix in its order
    found = mixing.mixed_blocks(docs).withColumn("file", F.input_file_name()).collect()
    order = [(r["slot"], r["begin"]) for r in sorted(found, key=lambda r: r["file"])]
    assert order == sorted(order) and len({r["slot"] for r in found}) > 50
    words = Counter()
    for r in found:
        words[r["doc_id"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
    taken = Counter()
    for r in mixing.mix(docs).collect():
        taken[r["doc_id"]] += r["taken"]
    assert +words == +taken
    texts = {i: (t or "").split() for i, t in pairs(rows) if i not in (None, 32)}
    for r in found:  # every piece is a run of its document's words
        piece, whole = r["text"].split(), texts.get(r["doc_id"], [])
        assert not whole or any(whole[i : i + len(piece)] == piece for i in range(len(whole) - len(piece) + 1))


def test_mixed_documents_hold_what_is_taken(docs):
    taken = sum(r["taken"] for r in mixing.mix(docs).collect())
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    texts = [r[1] for r in mixed.collect()]
    assert sum(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts) == taken


# 8 sharding


def brute_capacity(sizes, shards):
    for capacity in range(max(sizes), sum(sizes) + 1):
        used, held = 1, 0
        for s in sizes:
            if held + s > capacity:
                used, held = used + 1, 0
            held += s
        if used <= shards:
            return capacity


def test_shards(docs, rows, empty):
    found = sharding.assign_shards(docs, shards=5).collect()
    assert sorted(r["size"] for r in found) == sorted(len((r[1] or "").encode()) + 8 for r in rows)
    by = {}
    for r in found:
        by.setdefault(r["shard"], []).append(r)
    assert set(by) <= set(range(5)) and all(sorted(r["slot"] for r in x) == list(range(len(x))) for x in by.values())
    where = {}
    for r in found:
        where.setdefault((r["text_crc32"], r["size"]), set()).add(r["shard"])
    texts = Counter((r[1] or None) for r in rows)
    assert all(len(s) == 1 for k, s in where.items() if k[1] > 8) and len(where) == len({t or "" for t in texts})
    assert sharding.assign_shards(empty, 5).count() == 0


def test_shards_are_the_plain_minimax_partition(docs, rows):
    """Every document's shard against one list of groups, cut by trying every capacity."""
    import hashlib

    sizes = {}
    key = lambda t: int(hashlib.sha256(t.encode()).hexdigest()[: sharding.KEY_BITS // 4], 16) if t is not None else 0
    for _, t in pairs(rows):
        sizes[key(t)] = sizes.get(key(t), 0) + len((t or "").encode()) + 8
    order = sorted(sizes)
    capacity, shard, used, held = brute_capacity([sizes[h] for h in order], 5), {}, 0, 0
    for h in order:
        if held and held + sizes[h] > capacity:
            used, held = used + 1, 0
        shard[h] = used
        held += sizes[h]
    wanted = sorted(((i, shard[key(t)]) for i, t in pairs(rows)), key=repr)
    assert got(sharding.assign_shards(docs, shards=5), "doc_id", "shard") == wanted


def test_capacity_is_the_smallest(spark, monkeypatch):
    monkeypatch.setattr(sharding, "STEP_BITS", 6)
    for seed in range(3):
        rnd = random.Random(seed)
        groups = sorted((rnd.randrange(1 << 60) >> (seed * 20), rnd.choice([1, 5, 9, 400])) for _ in range(60))
        frame = spark.createDataFrame(groups, "h long, size long").groupBy("h").agg(F.sum("size").alias("size"))
        bounds, capacity = sharding.shard_bounds(frame, 7)
        sums = {}
        for h, s in groups:
            sums[h] = sums.get(h, 0) + s
        assert capacity == brute_capacity([sums[h] for h in sorted(sums)], 7) and len(bounds) <= 6
        totals = Counter()
        for h, s in groups:
            totals[sum(h >= b for b in bounds)] += s
        assert max(totals.values()) <= capacity


# 9 quality


def test_quality(spark, docs, rows, empty):
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    found = quality.quality_rules(docs)
    assert got(found, *columns) == sorted(brute.base_rows(pairs(rows)), key=repr)
    assert found.filter("kept AND base_failed").count() == 0 and quality.quality_rules(empty).count() == 0


def test_quality_removes_common_lines(spark):
    from tests.llm.conftest import prose

    banner = prose(1, 70).replace("\n", " ")
    own = [prose(100 + i, 80).replace("\n", " ") for i in range(30)]
    rows = [(i, f"{banner} {i}\n{own[i]}" if i < 12 else own[i], "a" if i < 20 else "b") for i in range(30)]
    rows += [(40, f"{banner} 7\n" + prose(7, 20).replace("\n", " "), "a"), (41, f"{banner} 7\n" + prose(8, 20).replace("\n", " "), "b")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {r["doc_id"]: (r["removed_words"], r["kept"]) for r in quality.quality_rules(frame).collect()}
    assert all(found[i] == (71, True) for i in range(12)) and all(found[i] == (0, True) for i in range(12, 30))
    assert found[40] == (71, False) and found[41] == (0, True)


# 10 simhash


def test_simhash(docs, rows, empty):
    found = simhash.simhash_components(docs.filter("doc_id IS NOT NULL"), 3, 2)
    found = found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("f"), "component_id")
    assert got(found, "doc_id", "f", "component_id") == sorted(brute.simhash_rows(with_ids(rows)), key=repr)
    assert simhash.simhash_components(empty).count() == 0


@pytest.mark.parametrize(("tau", "cap", "near"), [(2, 256, 40), (2, 4, 40), (3, 4, 20), (0, 4, 20)])
def test_links_connect_as_all_pairs_do(spark, tau, cap, near):
    rnd, base = random.Random(tau), [random.Random(9).getrandbits(64) for _ in range(6)]
    fps = {b ^ sum(1 << k for k in rnd.sample(range(24), rnd.randint(0, 5))) for b in base for _ in range(near)}
    fps |= {rnd.getrandbits(64) for _ in range(100)}
    frame = spark.createDataFrame([(0, simhash.signed(f), simhash.signed(f), 0) for f in fps], "view int, fp long, node long, check long")
    links = simhash.fingerprint_links(frame, tau, cap=cap)
    root = {r["node"]: r["root"] for r in simhash.components(links).collect()}
    fps = sorted(map(simhash.signed, fps))
    want = {f: f for f in fps}
    changed = True
    pairs = [(a, b) for i, a in enumerate(fps) for b in fps[:i] if ((a ^ b) & (2**64 - 1)).bit_count() <= tau]
    while changed:
        changed = False
        for a, b in pairs:
            m = min(want[a], want[b])
            changed |= want[a] != m or want[b] != m
            want[a] = want[b] = m
    assert {f: root.get(f, f) for f in fps} == want


def test_keep_one(docs, rows, empty):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=repr)
    # 3 and 4 copy 2, 14 nearly copies 13, 32 (twice) copies 16, 25 is as empty as 24 and 26
    assert ids == sorted([i for i in [*range(34), None] if i not in (3, 4, 14, 32, 25, 26)], key=repr)
    assert simhash.keep_one(empty).count() == 0


def test_passage_edits_link_as_brute_force_does(spark):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(5000)]
    texts = []
    for n in (3, 5, 12, 60, 200, 200, 200, 800):
        base = rnd.choices(words, k=n)
        texts.append(base)
        for share in (0.04, 0.08, 0.12, 0.16, 0.2, 0.24, 0.3):
            k, at = max(1, int(share * n)), rnd.randrange(n)
            new = rnd.choices(words, k=k)
            texts += [base + new, base[: n - k], base[:at] + new + base[at + k :], new + base]
    # a hot group: each of many copies has edits of its own
    base = rnd.choices(words, k=100)
    for i in range(60):
        texts.append([w if rnd.random() > 0.03 * (i % 2) else rnd.choice(words) for w in base] + [f"own{i}"] * (i % 30))
    docs = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(len(texts), None), (len(texts) + 1, " ")]
    found = simhash.similar_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    groups, want = {}, {}
    for r in found:
        groups.setdefault(r["root"], set()).add(r["doc_id"])
    for i, r in enumerate(brute.similar_roots(docs)):
        want.setdefault(r, set()).add(i)
    assert len(found) == len(docs) and sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_texts_that_share_a_passage_make_few_pairs(spark, monkeypatch):
    """Texts with a passage in common, in blocks of 16: pairs grow with what is alike, not with the passage's square."""
    monkeypatch.setattr(simhash, "MET_BLOCK", 16, raising=False)
    rnd, seen, compare = random.Random(9), [], simhash.similar_pairs

    def counted(pairs, *more):
        seen.append(pairs.distinct().count())
        return compare(pairs, *more)

    monkeypatch.setattr(simhash, "similar_pairs", counted)
    monkeypatch.setattr(simhash, "common_shingles", lambda rows, shingle: [])  # as if no sample had shown the passage
    passage, texts = [f"p{i}" for i in range(80)], {}
    for i in range(120):
        words = passage + [f"w{rnd.randrange(10**6)}" for _ in range(rnd.choice([35, 45, 110]))]
        texts |= {2 * i: " ".join(words), 2 * i + 1: " ".join([*words[:-3], "x", *words[-2:]]) if i % 4 == 0 else " ".join([str(i), *words[1:50]])}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(6)
    found, wanted = {}, {}
    for r in simhash.similar_components(frame).collect():
        found.setdefault(r["root"], []).append(r["doc_id"])
    for i, root in similar_groups(texts).items():
        wanted.setdefault(root, []).append(i)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, wanted.values())) and 100 < len(wanted) < 220
    assert len(seen) == 3 and seen[2] < 300, seen


def test_maps_of_neighbouring_lengths_compare():
    rnd = np.random.default_rng(3)
    sets = {k: np.unique(rnd.integers(0, 1 << 63, n)) for k, n in enumerate((30, 33, 120, 129, 260))}
    sets |= {k + 10: np.append(s[: len(s) - len(s) // 20], rnd.integers(0, 1 << 63, len(s) // 10)) for k, s in sets.items()}
    batch = pa.RecordBatch.from_pydict({"node": list(sets), "grams": [s.tolist() for s in sets.values()]})
    made = dict(next(iter(shingle_map_rows([batch]))))
    assert len({len(m) for m in made.values()}) > 2
    rows = [(1, 0, 0, 0, k, len(s), k, made[k]) for k, s in sets.items()]
    kinds = [pa.int64(), *[pa.int32()] * 3, *[pa.int64()] * 3, pa.binary()]
    cells = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=list("tlhbnsrm"))
    got = {(a, b) for out in simhash.compared_maps()(iter([cells])) for a, b in zip(out["a"].to_pylist(), out["b"].to_pylist(), strict=True)}
    alike = {(a, b) for a in sets for b in sets if a < b and 9 * len(np.intersect1d(sets[a], sets[b])) >= 4 * (len(sets[a]) + len(sets[b]))}
    assert {(k, k + 10) for k in range(5)} == alike == got


def shingle_map_rows(batches):
    class Sets:
        def mapInArrow(self, run, schema):
            return (zip(b["node"].to_pylist(), b["map"].to_pylist(), strict=True) for b in run(iter(batches)))

    return simhash.shingle_maps(Sets())


def test_copies_among_texts_of_the_same_words_link(spark):
    rnd = random.Random(6)
    words = [f"w{i}" for i in range(150)]
    texts = []
    for _ in range(5):  # other orders of the same words, each with a copy in which two neighbours change places
        rnd.shuffle(words)
        texts += [" ".join(words), " ".join([*words[:70], words[71], words[70], *words[72:]])]
    kept = simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 4, 6, 8]


def similar_groups(texts: dict[int, str], shingle: int = 5) -> dict[int, int]:
    """The least id that links of a Jaccard similarity of 0.8 or more reach, by comparing all pairs."""
    sets = {}
    for i, t in texts.items():
        w = t.encode().lower().split()
        sets[i] = {tuple(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))}
    root = {i: i for i in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b]))]
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    return root


@pytest.mark.parametrize("cap", [8, 1])
def test_similar_components_are_exact(spark, cap, monkeypatch):
    """Copies with edits, cuts and added passages at all similarities about 0.8, and a passage that many share."""
    monkeypatch.setattr(simhash, "MET_CAP", cap)
    rnd, texts = random.Random(21), {}
    vocabulary = [f"w{i}" for i in range(400)]
    shared = rnd.choices(vocabulary, k=60)
    for base in range(14):
        words = rnd.choices(vocabulary, k=rnd.randint(40, 220))
        if base % 2:
            words = words[:100] + shared
        texts[len(texts)] = words
        for _ in range(9):
            new, kind, n = list(words), rnd.randint(0, 3), rnd.randint(1, max(2, len(words) // 4))
            if kind == 0:
                for at in rnd.sample(range(len(new)), max(1, n // 8)):
                    new[at] = rnd.choice(vocabulary)
            elif kind == 1:
                new += rnd.choices(vocabulary, k=n)
            elif kind == 2:
                new = new[n:]
            else:
                rnd.shuffle(new)  # the same words in another order are no copy
            texts[len(texts)] = new
    texts = {i: " ".join(w) for i, w in texts.items()}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(6)
    found = {}
    for r in simhash.similar_components(frame).collect():
        found.setdefault(r["root"], []).append(r["doc_id"])
    wanted = {}
    for i, root in similar_groups(texts).items():
        wanted.setdefault(root, []).append(i)
    assert sorted(map(sorted, found.values())) == sorted(wanted.values())
    assert 14 < len(wanted) < len(texts)
