"""Hit, name, id and address functions on literal values."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import hits

V0, V1 = "Qm" + "a" * 44, "b" + "a" * 58


def values(spark, f, rows):
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [r["y"] for r in frame.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("f", "rows", "wanted"),
    [
        (hits.is_id, [V0, V1, "Qm", None, f"/ipfs/{V0}"], [True, True, False, False, False]),
        (hits.id_in_value, [V0, f"/ipfs/{V1}/x", "none", None], [V0, V1, None, None]),
        (hits.is_name_pointer, ["k51" + "q" * 12, "ipns://a", "/ipns/a/b", "x", None], [True, True, True, False, False]),
        (hits.pointer_name, ["ipns://ipns/a/b", "/ipns/c?d", "e", ""], ["a", "c", "e", None]),
        (hits.entry_path, ["/a/b", "a", "", "a/../b", None], ["a/b", "a", None, None, None]),
        (hits.display_name, ["  a\r\n\tb ", "\t", None, "x" * 300], ["a b", None, None, "x" * 256]),
        (hits.resource_type, [" Site", "image", "doc", None], ["site", "image", "all", "all"]),
        (hits.media_type, ["Text/HTML; charset=x", "", None], ["text/html", None, None]),
        (hits.contract_metadata, ['{"a":"b"}', "x", None], [{"a": "b"}, {}, {}]),
        (hits.is_zip_snippet, ["PK..", "x JFIF", "plain", None], [True, True, False, False]),
        (hits.is_public_v4, ["8.8.8.8", "10.0.0.1", "172.20.0.1", "172.32.0.1", "1.2.3", "300.1.1.1", None], [True, False, False, True, False, False, False]),
        (hits.is_global_v6, ["2001:db8::1", "::1", "fe80::1", "fd00::", ""], [True, False, False, False, False]),
        (hits.is_usable_multiaddress, ["/ip4/8.8.8.8/tcp/1", "/ip4/10.0.0.1", "/dns4/localhost", "/dns/a.b", "/ip4/8.8.8.8/p2p-circuit", "x", None], [True, False, False, True, False, False, False]),
        (hits.without_peer, ["/ip4/1.2.3.4/p2p/Qx", "/dns/a"], ["/ip4/1.2.3.4", "/dns/a"]),
        (hits.is_private_remote, ["127.0.0.1", "::ffff:10.1.1.1", "8.8.8.8", None], [True, True, False, False]),
        (lambda x: hits.is_address(x, "abc"), ["abc1q9", "abd1q", None], [True, False, False]),
    ],
)
def test_values(spark, f, rows, wanted):
    assert values(spark, f, rows) == wanted


def test_explore_type(spark):
    rows = [("image", None, None, None, None), ("doc", "application/pdf", None, None, None), ("html", "text/html", None, None, "Index of /x"), ("html", "text/html", None, None, "T"), ("text", "text/plain", None, None, None), ("x", None, None, "a.epub", None), ("x", None, None, None, None)]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, kind string, mime string, ext string, path string, title string")
    t = hits.explore_type(*(F.col(c) for c in ("kind", "mime", "ext", "path", "title")), F.lit(None).cast("string"), F.lit(False))
    assert [r[1] for r in frame.select("i", t).orderBy("i").collect()] == ["image", "pdf", None, "html", "txt", "epub", None]


def test_previews(spark):
    frame = spark.sql("SELECT array('doc:full_fetch_failed', 'doc:sample') AS s, map('obj', 1D) AS t, map('word', 1D) AS u, array() AS n")
    pdf, none = F.lit("application/pdf"), F.lit(None).cast("string")
    got = frame.select(
        hits.is_broken_pdf(pdf, none, F.col("s"), F.col("t")), hits.is_broken_pdf(pdf, none, F.col("s"), F.col("u")),
        hits.is_broken_epub(none, F.lit("epub"), none, none, none, F.col("s")), hits.is_low_signal(none, none, none, F.col("t"), F.col("n")),
        hits.is_html_site(F.lit("/a/b.html"), none, none, none), hits.is_chunk_list(F.array(F.lit("0"), F.lit("1")), F.array(F.lit("file"))),
    ).first()
    assert list(got) == [True, False, True, False, True, True]
