"""Quality rules: base counts of a text, and its divergence from the character classes and common words of its language."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanframe.functions.cluster import materialize
from scanframe.functions.rows import let
from scanframe.llm.common import WORD_SPACE

REPEAT_WINDOW = 5
#: Character classes that are counted by expression; what is left after white space and these is lower-case a-z.
CLASSES = {
    "upper": "[A-Z]", "digit": "[0-9]", "sentence": "[.,;:!?'\"()-]", "latin": "[\\u00C0-\\u024F]",
    "symbol": "[\\x00-\\x08\\x0E-\\x1F\\x7F#$%&*+/<=>@\\[\\\\\\]^_`{|}~]", "other": "[^\\x00-\\x7F\\u00C0-\\u024F]"}
SYMBOLS = "[#*$%&|<>]"
_BUCKETS = 64  # common words are looked up by the low bits of their hash


@dataclass(frozen=True)
class Rules:
    """Limits of the rules, the same at every size of the corpus."""

    common_words: int = 64  # per language; all other words are one further class
    word_distance: float = 0.38  # largest Jensen-Shannon distance (0 to 1) of the common words
    least_words: int = 100  # shorter texts are not judged by it: a small sample diverges by chance
    class_distance: float = 0.32  # largest distance of the character classes
    least_class_words: int = 60
    language_share: float = 1e-4  # languages with a smaller share of all words have no reference, so there are 10^4 at most
    language_words: int = 1000  # nor have those with fewer words


def words_of(text: Column) -> Column:
    """Runs of anything but ASCII white space; null for null."""
    return F.array_remove(F.split(text, WORD_SPACE), "")


def _count(text: Column, expression: str) -> Column:
    return F.regexp_count(text, F.lit(expression)).cast("long")


def unusual(text: Column) -> Column:
    """What is left of a text without a-z and white space: a small part of it, which all expressions count in."""
    return F.regexp_replace(text, r"[a-z\x20\x09-\x0D]+", "")


def class_counts(text: Column, rest: Column, word_chars: Column) -> Column:
    """Array of counts: the classes by expression (in ``unusual``), white space, lower-case a-z."""
    counted = F.array(*[_count(rest, e) for e in CLASSES.values()])
    space = F.length(text).cast("long") - word_chars
    return let(counted, lambda c: F.concat(c, F.array(
        space, word_chars - F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x))))


def repeated_words(hashes: Column) -> Column:
    """Number of words inside windows of five words that occur twice or more in the text, from the words' hashes.

    Sorting by window brings equal ones together, sorting the hits by place again gives the
    overlaps: linear but for the sorts, and texts without any equal windows need neither.
    """
    last = REPEAT_WINDOW - 1

    def window(words):
        return F.when(F.size(words) > last, F.transform(
            F.sequence(F.lit(0), F.size(words) - REPEAT_WINDOW), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(REPEAT_WINDOW)])))

    def repeated(windows):
        placed = F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

        def hits(s):
            def equal(j):
                return F.coalesce(F.get(s, j)["w"] == F.get(s, j + 1)["w"], F.lit(False))

            return F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: F.when(j > 0, equal(j - 1)).otherwise(False) | equal(j))

        starts = let(placed, lambda s: F.sort_array(F.transform(hits(s), lambda j: F.get(s, j)["i"])))
        return let(starts, lambda p: F.aggregate(
            F.transform(p, lambda x, j: F.least(F.coalesce(F.get(p, j + 1) - x, F.lit(REPEAT_WINDOW)), F.lit(REPEAT_WINDOW))),
            F.lit(0), lambda a, x: a + x))

    def counted(windows):
        none = windows.isNull() | (F.size(F.array_distinct(windows)) == F.size(windows))
        return F.when(none, 0).otherwise(repeated(windows))

    return let(hashes, lambda words: let(window(words), counted)).cast("long")


def base_counts(rows: DataFrame) -> DataFrame:
    """The rows plus words, rest, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed of ``text``, which is not null."""
    rows = rows.withColumns({"words": words_of(F.col("text")), "rest": unusual(F.col("text"))})
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.withColumns({
        "hashes": F.transform("words", lambda w: F.xxhash64(w)), "n_words": F.size("words").cast("long"),
        "word_chars": F.length(F.array_join("words", "")).cast("long"), "n_symbols": _count(F.col("rest"), SYMBOLS),
        "n_dup_lines": let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))})
    rows = rows.withColumn("n_repeat_words", repeated_words(F.col("hashes")))
    return rows.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def _language(lang: Column) -> Column:
    return F.xxhash64(F.coalesce(lang.cast("string"), F.lit("")))


def references(docs: DataFrame, rules: Rules) -> DataFrame:
    """Per language: shares of the character classes, and its most frequent words with their shares.

    (language, classes, common, shares, others, buckets): ``language`` and ``common`` are 64-bit
    hashes; ``others`` is the share of all other words. Counts come from all documents and are
    added up in the tasks before they are sent; at most ``common_words`` rows of a language
    leave a task for the ranking. Ties of frequency go to the smaller hash.
    """
    texts = docs.where("text is not null").select(_language(F.col("lang")).alias("language"), "text")
    shape = texts.withColumns({"words": words_of(F.col("text")), "rest": unusual(F.col("text"))})
    shape = shape.select("language", "text", "rest", F.size("words").cast("long").alias("n"), F.length(F.array_join("words", "")).cast("long").alias("chars"))
    shape = shape.select("language", "n", class_counts(F.col("text"), F.col("rest"), F.col("chars")).alias("c"))
    width = len(CLASSES) + 2
    totals = shape.groupBy("language").agg(
        F.sum("n").alias("n_words"), *[F.sum(F.get("c", F.lit(k))).alias(f"c{k}") for k in range(width)])
    totals = materialize(totals)
    everything = totals.agg(F.sum("n_words")).first()[0] or 0
    large = (F.col("n_words") >= rules.language_words) & (F.col("n_words") >= rules.language_share * everything)
    classes = F.array(*[F.col(f"c{k}").cast("double") for k in range(width)])
    sums = F.aggregate(classes, F.lit(0.0), lambda a, x: a + x)
    totals = totals.where(large).select("language", "n_words", let(sums, lambda s: F.transform(classes, lambda x: x / s)).alias("classes"))

    words = texts.select("language", F.explode(words_of(F.col("text"))).alias("word"))
    counts = words.groupBy("language", F.xxhash64("word").alias("word")).agg(F.count(F.lit(1)).alias("n"))
    ranked = counts.withColumn("place", F.row_number().over(Window.partitionBy("language").orderBy(F.desc("n"), "word")))
    top = ranked.where(F.col("place") <= rules.common_words).groupBy("language").agg(
        F.sort_array(F.collect_list(F.struct("place", "word", "n"))).alias("top"))
    known = totals.join(top, "language")
    shares = F.transform("top", lambda t: t["n"] / F.col("n_words"))
    rest = F.col("n_words") - F.aggregate("top", F.lit(0).cast("long"), lambda a, t: a + t["n"])
    buckets = F.transform(F.sequence(F.lit(0), F.lit(_BUCKETS - 1)), lambda b: F.filter(
        F.transform("top", lambda t: t["word"]), lambda w: w.bitwiseAND(F.lit(_BUCKETS - 1)) == b))
    return materialize(known.select(
        "language", "classes", F.transform("top", lambda t: t["word"]).alias("common"), shares.alias("shares"),
        (rest / F.col("n_words")).alias("others"), buckets.alias("buckets")))


def _part(p: Column, q: Column) -> Column:
    """What a class with shares p and q adds to the divergence, in bits; a share of 0 adds nothing by itself."""
    def half(x, other):
        return F.when(x > 0, x * F.log2(2 * x / (x + other)) / 2).otherwise(0.0)

    return half(p, q) + half(q, p)


def _distance(divergence: Column) -> Column:
    return F.sqrt(F.greatest(divergence, F.lit(0.0)))


def class_distance(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance of class counts from reference shares; null without characters."""
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    parts = let(total, lambda n: F.zip_with(counts, reference, lambda c, q: _part(c / n, q)))
    return F.when(total > 0, _distance(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)))


def word_distance(hashes: Column, common: Column, shares: Column, others: Column, buckets: Column) -> Column:
    """Jensen-Shannon distance of the common words' shares in a text from those in its language; null without words.

    The text's common words are sorted, so that each is a run whose length is its count; a
    common word that is missing adds half its share.
    """
    seen = F.sort_array(F.filter(hashes, lambda h: F.array_contains(F.get(buckets, h.bitwiseAND(F.lit(_BUCKETS - 1)).cast("int")), h)))

    def divergence(s):
        def begins(j):
            return (j == 0) | (F.get(s, j) != F.get(s, F.greatest(j - 1, F.lit(0))))

        starts = F.when(F.size(s) > 0, F.filter(F.sequence(F.lit(0), F.size(s) - 1), begins)).otherwise(F.array().cast("array<int>"))
        n = F.size(hashes)

        def added(p):
            terms = F.transform(p, lambda b, j: let(
                F.get(shares, F.array_position(common, F.get(s, b)).cast("int") - 1),
                lambda q: _part((F.coalesce(F.get(p, j + 1), F.size(s)) - b) / n, q) - q / 2))
            missing = F.aggregate(shares, F.lit(0.0), lambda a, q: a + q) / 2
            return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) + missing + _part((n - F.size(s)) / n, others)

        return let(starts, added)

    return F.when(F.size(hashes) > 0, _distance(let(seen, divergence)))


def judge(docs: DataFrame, known: DataFrame, rules: Rules) -> DataFrame:
    """``row`` (the document), its base counts, class_distance, word_distance (null without reference), and kept.

    The references are at most 10^4 rows by the share that a language needs, each of a fixed
    size, so they are sent to every task; no text is shuffled.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = base_counts(rows.select(
        "row", F.coalesce(F.col("row")["text"], F.lit("")).alias("text"), _language(F.col("row")["lang"]).alias("language")))
    rows = rows.withColumn("chars", class_counts(F.col("text"), F.col("rest"), F.col("word_chars")))
    rows = rows.join(F.broadcast(known), "language", "left")
    has = F.col("classes").isNotNull()
    far = {
        "class_distance": F.when(has, class_distance(F.col("chars"), F.col("classes"))),
        "word_distance": F.when(has, word_distance(*[F.col(c) for c in ("hashes", "common", "shares", "others", "buckets")]))}
    rows = rows.withColumns(far)
    strange = ((F.col("n_words") >= rules.least_words) & (F.col("word_distance") > rules.word_distance)) | (
        (F.col("n_words") >= rules.least_class_words) & (F.col("class_distance") > rules.class_distance))
    kept = ~F.col("base_failed") & ~F.coalesce(strange, F.lit(False))
    return rows.select("row", *COUNTS, "base_failed", "class_distance", "word_distance", kept.alias("kept"))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge_documents(docs: DataFrame, rules: Rules | None = None) -> DataFrame:
    """``judge`` against references that come from the documents themselves."""
    rules = rules or Rules()
    return judge(docs, references(docs, rules), rules)


def quality_report(docs: DataFrame, rules: Rules | None = None) -> DataFrame:
    """Per row: doc_id, the five counts, base_failed, kept.

    A document fails the base rules with fewer than ten words, or more than a fifth of them
    inside repeated windows of five words. Otherwise it goes if its common words or its
    character classes are too far from those of its language. Null and empty texts have no
    words and fail; a null language is one of its own; a language too rare for a reference
    judges nothing, as do texts shorter than the guards. Rows that repeat are judged alike and
    count each in the references. Equal windows are equal 64-bit hashes within one text; lines
    and words compare as strings. Without documents the result is empty.
    """
    return judge_documents(docs, rules).select(F.col("row")["doc_id"].alias("doc_id"), *COUNTS, "base_failed", "kept")


def keep_documents(docs: DataFrame, rules: Rules | None = None) -> DataFrame:
    """The documents that are kept, in their columns whatever their names."""
    return judge_documents(docs, rules).where("kept").select("row.*")
