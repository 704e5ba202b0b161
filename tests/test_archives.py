"""Archives: directories in tails, marks of what can't be read, books without a spine."""

import struct

import pytest

from tessera.sources import archives

PAGE = "<html><body>{}</body></html>"


def frame(spark, bodies):
    return spark.createDataFrame(list(bodies.items()), "key string, body binary").repartition(3)


def test_names_stand_in_the_tail():
    body = archives.pack({"a.txt": "x" * 5_000, "word/b.xml": "PK\x05\x06 word/ xl/"}, ("word/b.xml",))
    assert archives.names_in_tail(body, len(body)) == ["a.txt", "word/b.xml"]
    assert archives.names_in_tail(body[-250:], len(body)) == ["a.txt", "word/b.xml"]
    assert archives.names_in_tail(body[-60:], len(body)) is None  # the directory begins before the tail
    for broken in (b"", None, b"PK\x05\x06", body[:-30], b"plain"):
        assert archives.names_in_tail(broken, 9 if broken is None else len(broken)) is None
    assert archives.names_in_tail(body, None) is None


@pytest.mark.parametrize(
    ("names", "ext"),
    [
        (["word/document.xml"], "docx"), (["xl/a"], "xlsx"), (["ppt/a"], "pptx"), (["mimetype", "META-INF/container.xml"], "epub"),
        (["classes.dex"], "apk"), (["notes/word/x"], "zip"), (["mimetype"], "zip"), ([], "zip"),
    ],
)
def test_kinds_by_names(spark, names, ext):
    from pyspark.sql import functions as F

    got = spark.createDataFrame([(names,)], "n array<string>").select(archives.archive_detect(F.col("n")).alias("x")).first()["x"]
    assert got["ext_guess"] == ext and (got["confidence"] == 0.9) == (ext == "zip")


def encrypted(body):
    raw = bytearray(body)
    at = raw.find(b"PK\x01\x02")
    raw[at + 8 : at + 10] = struct.pack("<H", 1)
    return bytes(raw)


def test_marks(spark):
    good = archives.pack({"word/document.xml": "<w:p><w:t>one &amp; two</w:t></w:p><w:p><w:t>three</w:t></w:p>"})
    torn = bytearray(archives.pack({"word/document.xml": "x" * 3_000}))
    torn[45:49] = b"\xff\xff\xff\xff"
    bodies = {"good": good, "locked": encrypted(good), "torn": bytes(torn), "half": good[: len(good) // 2], "null": None, "empty": b"", "other": archives.pack({"a.bin": "z"})}
    got = {r["key"]: (r["mark"], r["text"], r["title"]) for r in archives.office_texts(frame(spark, bodies)).collect()}
    assert got == {
        "good": ("ok", "one & two\nthree", "one & two"), "locked": ("encrypted", "", None), "torn": ("broken", "", None), "half": ("broken", "", None),
        "null": ("broken", "", None), "empty": ("broken", "", None), "other": ("ok", "", None),
    }


def test_books(spark):
    spine = "<manifest><item id='x' href='b.html'/><item id='y' href='A.xhtml'/></manifest><spine><itemref idref='y'/><itemref idref='x'/><itemref idref='y'/><itemref idref='gone'/></spine>"
    container = "<rootfile full-path='in/p.opf'/>"
    bodies = {
        "spine": archives.pack({"META-INF/container.xml": container, "in/p.opf": f"<dc:title> The Title </dc:title>{spine}", "in/b.html": PAGE.format("second"), "in/a.xhtml": PAGE.format("first"), "other.opf": "<dc:title>No</dc:title>"}),
        "no container": archives.pack({"z.opf": spine, "b.html": PAGE.format("second")}),
        "wrong container": archives.pack({"META-INF/container.xml": "<rootfile full-path='none.opf'/>", "p.opf": spine, "b.txt": "by name", "a.html": PAGE.format("page")}),
        "names": archives.pack({"c.xml": "<data>no page</data>", "b.xml": "<p>xml page</p>", "a.txt": " plain \r\n\r\n\r\n text ", "toc.ncx": "x", "META-INF/x.xml": "<p>meta</p>"}),
        "many": archives.pack({f"{i:02}.txt": f"t{i}" for i in range(40)}),
        "long": archives.pack({"a.txt": "x" * 30_000, "b.txt": "y"}),
    }
    got = {r["key"]: r for r in archives.book_texts(frame(spark, bodies)).collect()}
    assert (got["spine"]["text"], got["spine"]["title"]) == ("first\nsecond\nfirst", "The Title")
    assert got["no container"]["text"] == "second"
    assert (got["wrong container"]["text"], got["wrong container"]["title"]) == ("page\nby name", "page")
    assert got["names"]["text"] == "plain\n\n text\nxml page"
    assert got["many"]["text"].split("\n") == [f"t{i}" for i in range(25)]
    assert got["long"]["text"] == "x" * 20_000


def test_a_blank_at_the_cut_of_a_book_stays(spark):
    text = "a" * (archives.MOST_CHARS - 1) + " b & c"
    body = archives.pack({"one.xhtml": PAGE.format(text.replace("&", "&amp;")), "two.xhtml": PAGE.format("")})
    got = archives.book_texts(frame(spark, {"k": body})).first()["text"]
    assert got == text[: archives.MOST_CHARS] and got.endswith(" ")


def test_whole_books_are_read_without_bounds(spark, tmp_path):
    import duckdb

    from tessera import registry

    bodies = {"many": archives.pack({f"{i:02}.txt": f"t{i}" for i in range(40)}), "long": archives.pack({"a.txt": "x" * 30_000, "b.txt": "y"})}
    got = {r["key"]: r["text"] for r in archives.book_texts(frame(spark, bodies), most_files=None, most_chars=None, most_bytes=None).collect()}
    assert got == {"many": "\n".join(f"t{i}" for i in range(40)), "long": "x" * 30_000 + "\ny"}
    small = {r["mark"] for r in archives.members(frame(spark, bodies), "txt", most_bytes=100).filter("key = 'long' AND name = 'a.txt'").collect()}
    assert small == {"large"}
    texts = [(1, "word & " * 9_000), (6, " one two  " * 5_000), (11, ""), (16, "short one")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(registry.ORACLES["p10_book_texts"]).fetchall()
    assert sorted(len(r[3]) for r in want)[2:] == [39_999, 62_999]
    assert sorted(map(tuple, registry.QUERIES["p10_book_texts"](spark, str(tmp_path)).select("key", "mark", "title", "text").collect())) == sorted(want)
