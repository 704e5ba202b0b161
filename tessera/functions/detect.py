"""Content type detection, tags and size classes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.html import bind

MB = 1 << 20
#: Upper bounds of size classes; fixed values.
SIZE_CLASSES = ((1 << 16, "xs"), (MB, "s"), (50 * MB, "m"), (500 * MB, "l"), (5120 * MB, "xl"))
OFFICE = "application/vnd.openxmlformats-officedocument."
#: Leading bytes (hexadecimal, offset) of common formats, in order; fixed values.
MAGIC = (
    ("89504E470D0A1A0A", 0, "image/png", "png"), ("FFD8FF", 0, "image/jpeg", "jpg"), ("47494638", 0, "image/gif", "gif"),
    ("25504446", 0, "application/pdf", "pdf"), ("504B0304", 0, "application/zip", "zip"), ("1F8B", 0, "application/gzip", "gz"),
    ("377ABCAF271C", 0, "application/x-7z-compressed", "7z"), ("526172211A07", 0, "application/x-rar-compressed", "rar"),
    ("57454250", 8, "image/webp", "webp"), ("57415645", 8, "audio/wav", "wav"), ("41564920", 8, "video/vnd.avi", "avi"),
    ("6674797061766966", 4, "image/avif", "avif"), ("6674797068656963", 4, "image/heic", "heic"), ("667479704D3441", 4, "audio/x-m4a", "m4a"),
    ("6674797071742020", 4, "video/quicktime", "mov"), ("66747970", 4, "video/mp4", "mp4"), ("494433", 0, "audio/mpeg", "mp3"),
    ("FFFB", 0, "audio/mpeg", "mp3"), ("4F676753", 0, "audio/ogg", "ogg"), ("664C6143", 0, "audio/x-flac", "flac"),
    ("4D546864", 0, "audio/midi", "mid"), ("2321414D52", 0, "audio/amr", "amr"), ("464F524D", 0, "audio/aiff", "aif"),
    ("1A45DFA3", 0, "video/x-matroska", "mkv"), ("464C5601", 0, "video/x-flv", "flv"), ("000001BA", 0, "video/mpeg", "mpg"),
    ("3026B2758E66CF11", 0, "application/vnd.ms-asf", "asf"), ("49492A00", 0, "image/tiff", "tif"), ("4D4D002A", 0, "image/tiff", "tif"),
    ("00000100", 0, "image/x-icon", "ico"), ("38425053", 0, "image/vnd.adobe.photoshop", "psd"), ("464C4946", 0, "image/flif", "flif"),
    ("0000000C6A5020200D0A870A", 0, "image/jp2", "jp2"), ("0000000C4A584C20", 0, "image/jxl", "jxl"), ("FF0A", 0, "image/jxl", "jxl"),
    ("67696D7020786366", 0, "image/x-xcf", "xcf"), ("424D", 0, "image/bmp", "bmp"), ("425A68", 0, "application/x-bzip2", "bz2"),
    ("FD377A585A00", 0, "application/x-xz", "xz"), ("28B52FFD", 0, "application/zstd", "zst"), ("04224D18", 0, "application/x-lz4", "lz4"),
    ("4C5A4950", 0, "application/x-lzip", "lz"), ("1F9D", 0, "application/x-compress", "Z"), ("4D534346", 0, "application/vnd.ms-cab-compressed", "cab"),
    ("213C617263683E", 0, "application/x-unix-archive", "ar"), ("EDABEEDB", 0, "application/x-rpm", "rpm"), ("7F454C46", 0, "application/x-elf", "elf"),
    ("4D5A", 0, "application/x-msdownload", "exe"), ("CAFEBABE", 0, "application/java-vm", "class"), ("0061736D", 0, "application/wasm", "wasm"),
    ("7B5C727466", 0, "application/rtf", "rtf"), ("25215053", 0, "application/postscript", "ps"), ("D0CF11E0A1B11AE1", 0, "application/x-cfb", "cfb"),
    ("53514C69746520666F726D6174203300", 0, "application/x-sqlite3", "sqlite"), ("50415231", 0, "application/vnd.apache.parquet", "parquet"),
    ("4152524F5731", 0, "application/vnd.apache.arrow.file", "arrow"), ("D4C3B2A1", 0, "application/vnd.tcpdump.pcap", "pcap"),
    ("435753", 0, "application/x-shockwave-flash", "swf"), ("465753", 0, "application/x-shockwave-flash", "swf"),
    ("774F4646", 0, "font/woff", "woff"), ("774F4632", 0, "font/woff2", "woff2"), ("4F54544F", 0, "font/otf", "otf"), ("0001000000", 0, "font/ttf", "ttf"),
    ("676C5446", 0, "model/gltf-binary", "glb"), ("424C454E444552", 0, "application/x-blender", "blend"), ("4449434D", 128, "application/dicom", "dcm"),
    ("7573746172", 257, "application/x-tar", "tar"),
)


def size_bucket(size: Column) -> Column:
    """P17; null for an unknown or negative size."""
    chain = F.when(size.isNull() | (size < 0), F.lit(None))
    for bound, name in SIZE_CLASSES:
        chain = chain.when(size < bound, name)
    return chain.otherwise("xxl")


def confidence_bucket(confidence: Column) -> Column:
    """P18."""
    return F.when(confidence >= 0.9, "high").when(confidence >= 0.6, "medium").otherwise("low")


def kind_of_mime(mime: Column) -> Column:
    """P15."""
    return (
        F.when(mime.isNull(), "unknown")
        .when(mime.startswith("image/"), "image")
        .when(mime.isin("text/html", "application/xhtml+xml"), "html")
        .when(mime.startswith("text/"), "text")
        .when(mime.isin("application/pdf", "application/epub+zip") | mime.startswith("application/msword") | mime.startswith(OFFICE[:-1]), "doc")
        .when(mime.isin("application/zip", "application/x-tar", "application/x-7z-compressed", "application/x-rar-compressed"), "archive")
        .when(mime == "application/vnd.ipld.car", "ipld")
        .otherwise("unknown")
    )


def content_class(kind: Column) -> Column:
    """P19."""
    k = F.lower(F.trim(F.coalesce(kind, F.lit(""))))
    return F.when(k == "html", "site").when(k == "image", "image").otherwise("doc")


def file_extension(name: Column) -> Column:
    """The lower-case extension; none for a leading dot or a trailing one."""
    return F.lower(F.regexp_extract(name, r"(?s)^.+\.([^.]+)$", 1))


def mime_hint(name: Column) -> Column:
    """P20."""
    ext = file_extension(F.trim(name))
    return (
        F.when(ext.isin("html", "htm", "xhtml"), "text/html")
        .when(ext.isin("txt", "md", "markdown", "srt", "vtt"), "text/plain")
        .when(ext == "pdf", "application/pdf")
        .when(ext == "epub", "application/epub+zip")
        .when(ext.isin("jpg", "jpeg", "png", "gif", "webp", "avif", "svg"), "image/*")
    )


def detection(mime: Column, ext: Column, confidence: Column, source: str) -> Column:
    """A candidate: null where the MIME type is."""
    found = F.struct(
        mime.alias("mime"), ext.alias("ext_guess"), kind_of_mime(mime).alias("kind"), confidence.cast("double").alias("confidence"), F.lit(source).alias("source")
    )
    return F.when(mime.isNotNull(), found)


def magic_detect(head: Column) -> Column:
    """By leading bytes; 0.9 for a plain ZIP, else 0.98."""
    mime = ext = F.lit(None).cast("string")
    for hexed, at, m, e in reversed(MAGIC):
        hit = F.hex(F.substring(head, at + 1, len(hexed) // 2)) == hexed
        mime, ext = F.when(hit, m).otherwise(mime), F.when(hit, e).otherwise(ext)
    return detection(mime, ext, F.when(mime == "application/zip", 0.9).otherwise(0.98), "magic")


def as_text(raw: Column) -> Column:
    """Bytes as lower-case text, a byte a character, so that broken sequences do no harm."""
    return F.lower(F.decode(F.coalesce(raw, F.lit(b"")), "ISO-8859-1"))


def container_detect(head: Column, middle: Column, tail: Column) -> Column:
    """PDF, ZIP and what it holds, HTML, CAR; the first that fits."""
    return bind(F.struct(as_text(head).alias("head"), F.concat(as_text(head), as_text(middle), as_text(tail)).alias("all")), lambda t: container_of(head, t["head"], t["all"]))


def container_of(head: Column, text: Column, inside: Column) -> Column:
    zipped = F.hex(F.substring(head, 1, 2)) == "504B"
    sub = (
        F.when(F.contains(inside, F.lit("word/")), "docx").when(F.contains(inside, F.lit("xl/")), "xlsx")
        .when(F.contains(inside, F.lit("ppt/")), "pptx").when(F.contains(inside, F.lit("application/epub+zip")), "epub")
        .when(inside.rlike("androidmanifest\\.xml|classes\\.dex|resources\\.arsc"), "apk")
    )
    zip_mime = (
        F.when(sub == "docx", OFFICE + "wordprocessingml.document").when(sub == "xlsx", OFFICE + "spreadsheetml.sheet")
        .when(sub == "pptx", OFFICE + "presentationml.presentation").when(sub == "epub", "application/epub+zip")
        .when(sub == "apk", "application/vnd.android.package-archive").otherwise("application/zip")
    )
    zip_kind = F.when(sub == "epub", "doc").when(sub == "apk", "package").otherwise("archive")
    car = F.hex(F.substring(head, 1, 2)).isin("0A01", "0AA1") & (F.octet_length(head) >= 4)

    def made(mime: Column, ext: Column, kind: Column, confidence: Column) -> Column:
        return F.struct(mime.alias("mime"), ext.alias("ext_guess"), kind.alias("kind"), confidence.cast("double").alias("confidence"), F.lit("container").alias("source"))

    return (
        F.when(F.contains(text, F.lit("%pdf-")), made(F.lit("application/pdf"), F.lit("pdf"), F.lit("doc"), F.lit(0.95)))
        .when(zipped & (F.octet_length(head) >= 4), made(zip_mime, F.coalesce(sub, F.lit("zip")), zip_kind, F.when(sub.isNull(), 0.9).otherwise(0.97)))
        .when(text.rlike("<html|<!doctype html|<head|<body"), made(F.lit("text/html"), F.lit("html"), F.lit("html"), F.lit(0.9)))
        .when(car, made(F.lit("application/vnd.ipld.car"), F.lit("car"), F.lit("ipld"), F.lit(0.85)))
    )


def is_mostly_text(head: Column, most: int = 4096) -> Column:
    """no NUL and over 80 % printable ASCII in the first bytes."""
    sample = F.decode(F.substring(head, 1, most), "ISO-8859-1")
    plain = F.regexp_count(sample, F.lit(r"[\x09-\x0D\x20-\x7E]"))
    return F.coalesce((F.length(sample) > 0) & ~F.contains(sample, F.lit("\x00")) & (plain > 0.8 * F.length(sample)), F.lit(False))


def is_pdf_internal(text: Column, most: int = 8192) -> Column:
    """text that is a PDF's inside: offset tables, object syntax, or stream dictionaries."""
    sample = F.lower(F.substring(text, 1, most))
    has = lambda w: F.contains(sample, F.lit(w)).cast("int")
    offsets = F.regexp_count(sample, F.lit(r"\b\d{6,12}\s+\d{5}\s+[nf]\b")) >= 3
    rest = F.length(F.regexp_replace(sample, r"[0-9nf\s]", ""))
    objects = sample.rlike(r"\b\d+\s+\d+\s+obj\b").cast("int")
    score = 2 * objects + has("endobj") + has("xref") + has("trailer") + has("stream") + has("endstream")
    words = ("flatedecode", "xobject", "colorspace", "bitspercomponent", "mediabox", "cropbox", "resources", "font")
    entries = sum((has(w) for w in words[1:]), has(words[0]))
    streamed = F.contains(sample, F.lit("stream")) & F.contains(sample, F.lit("endstream"))
    return F.coalesce((offsets & (rest <= 10)) | (score >= 4) | (streamed & (entries >= 3)), F.lit(False))


def fallback_detect(head: Column) -> Column:
    """Plain text at 0.7 or an octet stream at 0.4."""
    plain = is_mostly_text(head) & ~is_pdf_internal(F.decode(F.substring(head, 1, 8192), "ISO-8859-1"))
    return F.struct(
        F.when(plain, "text/plain").otherwise("application/octet-stream").alias("mime"),
        F.when(plain, "txt").alias("ext_guess"),
        F.when(plain, "text").otherwise("unknown").alias("kind"),
        F.when(plain, 0.7).otherwise(0.4).alias("confidence"),
        F.lit("heuristic").alias("source"),
    )


def detect(head: Column, middle: Column, tail: Column) -> Column:
    """Sure magic bytes, else the container if no less sure than the magic bytes, else those, else the fallback."""

    def choose(found: Column) -> Column:
        magic, box = found["magic"], found["box"]
        sure = (magic["confidence"] >= 0.95) & (magic["mime"] != "application/zip")
        boxed = box.isNotNull() & (magic.isNull() | (box["confidence"] >= magic["confidence"]))
        return F.when(sure, magic).when(boxed, box).otherwise(F.coalesce(magic, fallback_detect(head)))

    return bind(F.struct(magic_detect(head).alias("magic"), container_detect(head, middle, tail).alias("box")), choose)


def tags_of(kind: Column, mime: Column, ext: Column, source: Column, confidence: Column, size: Column) -> Column:
    """Stable tags in order."""
    k, e = F.coalesce(kind, F.lit("unknown")), F.coalesce(ext, F.lit("unknown"))
    category = (
        F.when(k == "image", "media").when(k.isin("doc", "html", "text"), "document").when(k.isin("archive", "ipld", "package"), "package").otherwise("unknown")
    )

    def tag(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}:"), value)

    box = F.when(e.isin("zip", "docx", "xlsx", "pptx", "epub", "apk"), "zip").when(e.isin("pdf", "car"), e)
    return F.array_compact(
        F.array(
            tag("kind", k), tag("category", category), tag("mime", F.coalesce(mime, F.lit("application/octet-stream"))), tag("ext", e),
            tag("detected_by", F.coalesce(source, F.lit("heuristic"))), tag("confidence", confidence_bucket(confidence)),
            tag("size_bucket", size_bucket(size)), tag("container", F.when(source == "container", box)),
            tag("office", F.when(e.isin("docx", "xlsx", "pptx"), e)), tag("ebook", F.when(e == "epub", e)),
            F.when(k.isin("image", "doc", "html", "text"), "needs:metadata"), F.when(k == "image", "needs:ai_tags"),
        )
    )
