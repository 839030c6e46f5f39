"""Document fingerprints by consistent weighted sampling of terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanframe.functions.cluster import counted, materialize
from scanframe.llm.common import WORD_SPACE, keyed, once
from scanframe.operators.numbering import number_rows

SAMPLES = 32
_STEPS = float(1 << 24)  # resolution of the logarithm that is minimised
_LOW32 = 0xFFFFFFFF
_AT_ONCE = 8  # samples whose minima are taken in one aggregation


def _uniform(h: Column, shift: int, bits: int) -> Column:
    """A number in (0, 1) from some bits of a hash."""
    part = F.shiftrightunsigned(h, shift).bitwiseAND(F.lit((1 << bits) - 1))
    return (part + 0.5) * F.lit(2.0 ** -bits)


def sample(term: Column, log_weight: Column, k: Column) -> Column:
    """One term's bid for sample k (int), as a long whose minimum over the terms is the sample.

    r and c are Gamma(2, 1) and b is uniform, all fixed by term and k; t = floor(ln w / r + b) and
    ln a = ln c - r (t - b + 1). The long holds ln a above and 32 bits that name (term, t) below. Two
    documents have the same minimum with the generalised Jaccard likeness of their weights,
    sum of minima over sum of maxima, as its chance.
    """
    h = F.xxhash64(term, k * 2)
    g = F.xxhash64(term, k * 2 + 1)
    r = -F.ln(_uniform(h, 0, 32) * _uniform(h, 32, 32))
    ln_c = F.ln(-F.ln(_uniform(g, 0, 24) * _uniform(g, 24, 24)))
    b = _uniform(g, 48, 16)
    t = F.floor(log_weight / r + b)
    ln_a = ln_c - r * (t - b + 1)
    name = (term + t * F.lit(0x9E3779B1)).bitwiseAND(F.lit(_LOW32))
    return F.shiftleft(F.floor(ln_a * _STEPS), 32).bitwiseOR(name)


def fingerprints(texts: DataFrame, keys: list[str], columns: list[str], samples: int = SAMPLES) -> DataFrame:
    """(keys, one fingerprint a column, under its name): 8 hex digits per sample over the words of a text, weighted by how often they occur.

    ``keys`` name one row each. A text without words has null; without a word in any of its
    texts a row is left out. Texts partitioned by some of the keys are not shuffled again: words
    are counted and minima taken where the texts are. What a sample draws for a term is drawn
    once for all texts of the row that hold the term, and a few samples at a time, so that the
    code that Spark makes for them stays small.
    """
    sides = F.explode(F.array(*[F.struct(F.lit(i).alias("side"), F.col(c).alias("body")) for i, c in enumerate(columns)]))
    words = texts.select(*keys, sides.alias("s")).select(*keys, "s.side", F.explode(F.split("s.body", WORD_SPACE)).alias("word")).where("word <> ''")
    n = [F.count_if(F.col("side") == i).cast("double") for i in range(len(columns))]
    terms = words.select(*keys, "side", F.xxhash64("word").alias("term")).groupBy(*keys, "term").agg(
        *[F.ln(c).alias(f"w{i}") for i, c in enumerate(n)])  # null where the text has no such term
    parts = range(0, samples, _AT_ONCE)
    dealt = terms.withColumn("first", F.explode(F.array(*[F.lit(k) for k in parts])))
    both = [(i, j) for i in range(len(columns)) for j in range(min(_AT_ONCE, samples))]
    least = dealt.groupBy(*keys, "first").agg(*[F.min(sample(F.col("term"), F.col(f"w{i}"), F.col("first") + j)).alias(f"s{i}_{j}") for i, j in both])
    digits = {(i, j): F.lpad(F.lower(F.hex(F.col(f"s{i}_{j}").bitwiseAND(F.lit(_LOW32)))), 8, "0") for i, j in both}
    return least.groupBy(*keys).agg(*[
        F.concat(*[F.max(F.when(F.col("first") == k, F.concat(*[digits[i, j] for j in range(min(_AT_ONCE, samples - k))]))) for k in parts]).alias(c)
        for i, c in enumerate(columns)])


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """Share of equal samples of two fingerprints."""
    same = sum((F.substring(a, 8 * k + 1, 8) == F.substring(b, 8 * k + 1, 8)).cast("int") for k in range(samples))
    return same / F.lit(float(samples))


def neighbours(ids: DataFrame) -> DataFrame:
    """Each document with the next by descending doc_id: (missing, key, mark, n_chars, copies, next_key, next_mark).

    ``ids`` has key, mark, n_chars and missing (id is null); equal rows are counted as one
    document. Numbering works on range partitions, so no task sees all documents.
    """
    once = ids.groupBy("missing", "key", "mark", "n_chars").agg(F.count("*").alias("copies"))
    numbered = materialize(number_rows(once.withColumn("present", ~F.col("missing")), [], ["present", "key", "mark"], "n"))
    last = numbered.count()
    after = numbered.select(
        F.when(F.col("n") == last, 1).otherwise(F.col("n") + 1).alias("n"), F.col("key").alias("next_key"), F.col("mark").alias("next_mark"))
    return materialize(numbered.join(after, "n").select(
        "missing", "key", "mark", "n_chars", "copies", "next_key", "next_mark"))


def fingerprint_documents(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Terms are words between ASCII white space, as written; their weight is their number in the
    text. The edited text has its last third (code points, rounded down) replaced by the first
    as many of the next document by descending doc_id, null last, after the last the first; the
    whole next text if it is shorter. Null text counts as empty; a text without words has a
    fingerprint of zeros, alike only to itself. Rows equal in doc_id and text are one document
    with as many rows; of equal doc_ids the higher text hash comes first. A single document is
    its own next one.

    The texts are shuffled once by identity; the first thirds of the next documents come to
    them, and both texts' terms are counted where they lie.
    """
    rows = keyed(docs.select("doc_id", "text"))
    text = F.coalesce(F.col("row")["text"], F.lit(""))
    ids = materialize(rows.select("key", "mark", F.length(text).cast("long").alias("n_chars"), F.col("row")["doc_id"].isNull().alias("missing")))
    order = neighbours(ids)
    repeated, n = counted(order.where("copies > 1").select("key", "mark"))
    bodies = once(rows, repeated, n).select("key", "mark", text.alias("text"))
    wanted = order.select(
        F.col("next_key").alias("key"), F.col("next_mark").alias("mark"), F.col("key").alias("of_key"),
        F.col("mark").alias("of_mark"), F.floor(F.col("n_chars") / 3).cast("int").alias("want"))
    heads = bodies.join(wanted, ["key", "mark"]).select(
        F.col("of_key").alias("key"), F.col("of_mark").alias("mark"), F.expr("substring(text, 1, want)").alias("head"))
    kept = "substring(text, 1, length(text) - int(floor(length(text) / 3)))"
    both = bodies.join(heads, ["key", "mark"]).select("key", "mark", "text", F.expr(f"concat({kept}, head)").alias("edited"))

    prints = fingerprints(both.select("key", "mark", F.col("text").alias("fingerprint"), F.col("edited").alias("edited_fingerprint")),
                          ["key", "mark"], ["fingerprint", "edited_fingerprint"], samples)
    none = F.lit("0" * 8 * samples)
    done = both.select("key", "mark", F.sha2("edited", 256).alias("edited_sha256")).join(prints, ["key", "mark"], "left").select(
        "key", "mark", "edited_sha256", F.coalesce("fingerprint", none).alias("fingerprint"),
        F.coalesce("edited_fingerprint", none).alias("edited_fingerprint"))
    done = materialize(done)
    after = done.select(F.col("key").alias("next_key"), F.col("mark").alias("next_mark"), F.col("fingerprint").alias("next_fingerprint"))
    out = done.join(order, ["key", "mark"]).join(after, ["next_key", "next_mark"])
    return out.select(
        F.when(~F.col("missing"), F.col("key")).alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint"), samples).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint"), samples).alias("near_next"),
        F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).drop("copy")
