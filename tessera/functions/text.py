"""Text normalisation, tokens, titles and previews as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that carry no topic; fixed values. A deployment adds its own names through the parameter.
STOP_WORDS = (
    "the", "and", "for", "with", "this", "that", "from", "your", "you", "are", "have", "has", "not", "but", "about",
    "into", "over", "then", "than", "can", "use", "using", "file", "data", "content", "image", "site", "page", "http",
    "https", "www", "com", "gateway",
)
GENERIC_TOPICS = ("file", "data", "content")
FORMAT_WORDS = ("pdf", "epub", "md", "markdown", "txt", "rtf", "csv", "json", "yaml", "yml", "toml", "xml", "html", "htm", "zip")


def bind(x: Column, use: Callable[[Column], Column]) -> Column:
    """``use(x)`` with ``x`` worked out once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(x), use), 1)


def accent_map() -> tuple[str, str]:
    """Latin letters whose canonical decomposition is an ASCII letter and marks, and those letters."""
    accented, plain = [], []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base, *marks = unicodedata.normalize("NFD", chr(code))
        if marks and base.isascii() and all("̀" <= m <= "ͯ" for m in marks):
            accented.append(chr(code))
            plain.append(base)
    return "".join(accented), "".join(plain)


ACCENTED, PLAIN = accent_map()


#: Loose marks, which a translation table leaves out.
MARKS = "".join(map(chr, range(0x300, 0x370)))


def strip_accents(text: Column) -> Column:
    """Accents of Latin letters and loose marks taken off, in the JVM, by one translation table."""
    return F.translate(text, ACCENTED + MARKS, PLAIN)


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalize_text(text: Column) -> Column:
    """Accents off, other non-ASCII and punctuation to spaces, lower case, single spaces."""
    # letters become lower ones last, so that those of other scripts don't become ASCII
    return F.lower(F.trim(F.regexp_replace(strip_accents(text), "[^A-Za-z0-9]+", " ")))


def clean_search(text: Column) -> Column:
    """A search text's struct (clean, has_question_mark, length); question marks stay in ``clean``."""
    raw = F.lower(F.coalesce(text, F.lit("")))
    clean = squeeze(F.regexp_replace(strip_accents(raw), r"[^a-z0-9\s?]", " "))
    return F.struct(clean.alias("clean"), F.contains(raw, F.lit("?")).alias("has_question_mark"), F.length(clean).alias("length"))


def query_tokens(clean: Column) -> Column:
    """Q-6: distinct lower-case tokens of letters and digits, in order; a token that holds ``?`` goes."""
    return F.array_distinct(F.filter(F.transform(F.split(clean, " "), F.lower), lambda t: t.rlike("^[a-z0-9]+$")))


def sanitized(tokens: Column, most: int = 12) -> Column:
    """F7 on an array column."""
    return F.slice(F.filter(F.transform(tokens, lambda t: F.lower(F.trim(t))), lambda t: t.rlike("^[a-z0-9]+$")), 1, most)


def sanitize_tokens(tokens: Sequence[str], most: int = 12) -> list[str]:
    """trimmed lower-case tokens of ASCII letters and digits, the first ``most`` of them."""
    found = (t.strip().lower() for t in tokens)
    return [t for t in found if t.isascii() and t.isalnum()][:most]


def merged_tokens(model: Column, words: Column) -> Column:
    """Two token maps as one; counts of a token in both are added."""
    return F.map_zip_with(model, words, lambda _, x, y: F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0)))


def merged_topics(model: Column, derived: Column) -> Column:
    """The model's topics, then those derived from words, each once."""
    return F.array_distinct(F.concat(model, derived))


def format_query(clean: Column) -> Column:
    """The format that a one-word query names, or null."""
    return F.when(clean.isin(*FORMAT_WORDS), clean)


def is_useful_text(text: Column) -> Column:
    """a letter at least, and letters are 15 % or more of what isn't white space."""
    letters = F.regexp_count(text, F.lit("[A-Za-z]"))
    solid = F.regexp_count(text, F.lit(r"\S"))
    return F.coalesce((letters > 0) & (letters >= 0.15 * solid), F.lit(False))


def text_preview(text: Column, most: int = 600) -> Column:
    """Printable ASCII with line feeds, trimmed, cut at ``most`` with an ellipsis; null if nothing is left."""
    safe = F.regexp_replace(F.regexp_replace(text, "\r", "\n"), r"[^\x09\x0A\x0D\x20-\x7E]", " ")
    trimmed = F.regexp_replace(safe, r"^\s+|\s+$", "")
    cut = F.concat(F.rtrim(F.regexp_replace(F.substring(trimmed, 1, most), r"\s+$", "")), F.lit("…"))
    return F.when(F.length(trimmed) == 0, F.lit(None)).when(F.length(trimmed) <= most, trimmed).otherwise(cut)


def text_title(text: Column, most: int = 120) -> Column:
    """The first useful Markdown heading of 40 lines, else the first useful line of 60."""
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    headed = F.transform(F.slice(lines, 1, 40), lambda x: F.regexp_extract(x, r"^#{1,6}\s+(.+)$", 1))
    heading = F.get(F.filter(headed, is_useful_text), F.lit(0))
    line = F.get(F.filter(F.slice(lines, 1, 60), is_useful_text), F.lit(0))
    title = squeeze(F.coalesce(heading, line))
    cut = F.concat(F.rtrim(F.substring(title, 1, most)), F.lit("…"))
    return F.when(F.length(title) > most, cut).otherwise(title)


def text_description(text: Column, title: Column, most: int = 800) -> Column:
    """Up to five useful lines of the first 120 other than the title, until ``most`` characters are there."""
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), squeeze), lambda x: x != "")
    useful = F.filter(
        F.slice(lines, 1, 120),
        lambda x: is_useful_text(x) & ~F.coalesce(F.lower(x) == F.lower(title), F.lit(False)),
    )
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"))

    def take(acc: Column, x: Column) -> Column:
        done = (acc["n"] >= 5) | (F.length(acc["out"]) >= most)
        longer = F.when(acc["n"] == 0, x).otherwise(F.concat(acc["out"], F.lit(" "), x))
        return F.struct(F.when(done, acc["out"]).otherwise(longer).alias("out"), (acc["n"] + F.when(done, 0).otherwise(1)).alias("n"))

    joined = F.aggregate(useful, start, take, lambda acc: acc["out"])
    cut = F.concat(F.rtrim(F.substring(joined, 1, most)), F.lit("…"))
    return F.when(F.length(joined) == 0, F.lit(None)).when(F.length(joined) > most, cut).otherwise(joined)


def word_counts(docs: DataFrame, key: str, column: str, most: int | None = 256, stop_words: Sequence[str] = STOP_WORDS, by: Callable[[Column], Column] | None = None) -> DataFrame:
    """A10 by document: (key, counts), an array of (token, count) of words of three letters or more that aren't stop words.

    The scan of a text ends at its ``most``-th distinct token: what stands behind is not counted, repeats of earlier tokens
    included; without ``most`` whole texts are counted. Texts are dealt out by ``key``, after which ``by`` normalises them;
    words are counted within their row, so a task holds texts and no rows of words. Counts of rows that share a key are added.
    """

    def scanned(normalized: Column) -> Column:
        words = F.filter(F.split(normalized, " "), lambda t: t.rlike("^[a-z]{3,}$") & ~t.isin(*stop_words))
        if most is None:
            return words
        last = lambda w: F.get(F.array_distinct(w), F.lit(most - 1))
        return bind(words, lambda w: bind(last(w), lambda x: F.when(x.isNull(), w).otherwise(F.slice(w, F.lit(1), F.array_position(w, x).cast("int")))))

    def counted(words: Column) -> Column:
        # in sorted words a token's places end where the next token's begin; each word is looked at once, however many tokens there are
        starts = F.filter(F.transform(words, lambda w, i: F.when((i == 0) | (F.get(words, i - 1) != w), i)), lambda i: i.isNotNull())
        count = lambda at, i, n: F.coalesce(F.get(at, n + 1), F.size(words)) - i
        return bind(starts, lambda at: F.transform(at, lambda i, n: F.struct(F.get(words, i).alias("token"), count(at, i, n).cast("bigint").alias("count"))))

    texts = docs.groupBy(key).agg(F.collect_list(column).alias("texts"))
    words = F.array_sort(F.flatten(F.transform("texts", lambda t: scanned(by(t) if by else t))))
    return texts.select(key, bind(words, counted).alias("counts"))


def token_rows(counts: Column | str) -> Column:
    """The entries of ``counts`` as rows; outer, as else the filter that Spark infers works the counts out again."""
    return F.inline_outer(counts)


def token_histogram(docs: DataFrame, key: str, normalized: str, most: int = 256, stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """A10: (key, token, count), the rows of ``word_counts``."""
    return word_counts(docs, key, normalized, most, stop_words).select(key, token_rows("counts")).filter("token IS NOT NULL")


def most_frequent(counts: Column, most: int) -> Column:
    """The ``most`` entries of an array of (token, count) with the largest counts, ties by token."""
    ordered = F.array_sort(F.transform(counts, lambda c: F.struct((-c["count"]).alias("less"), c["token"].alias("token"))))
    return F.transform(F.slice(ordered, 1, most), lambda c: F.struct(c["token"].alias("token"), (-c["less"]).alias("count")))


def index_tokens(counted: DataFrame, key: str, most: int = 128) -> DataFrame:
    """(key, token, count) of ``word_counts``: a document's most frequent tokens, counts cut at 1000, ties by token."""
    cut = F.transform("counts", lambda c: F.struct(c["token"].alias("token"), F.least(F.lit(1000), c["count"]).cast("bigint").alias("count")))
    return counted.select(key, token_rows(most_frequent(cut, most))).filter("token IS NOT NULL")


def topics(counted: DataFrame, key: str, most: int = 5) -> DataFrame:
    """(key, topics) of ``word_counts``: the most frequent tokens that aren't generic, ties by token."""
    own = F.filter("counts", lambda c: ~c["token"].isin(*GENERIC_TOPICS))
    found = F.transform(most_frequent(own, most), lambda c: c["token"])
    return counted.select(key, F.explode_outer(F.array(found)).alias("topics")).filter(F.size("topics") > 0)
