"""Toxicity: maximum-scoring segments over token log-odds with Dirichlet priors, calibrated by extreme values."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanframe.functions.cluster import counted, materialize
from scanframe.llm.common import blocks, keyed, sieved

SLOTS = 1 << 20  # of each of two tables of hashed tokens; the model's size does not depend on the data
BLOCK = 1 << 12  # slots whose counts make one row
PRIOR = 0.1  # weight of the Dirichlet prior against the counts
DRIFT = 0.02  # taken off every token's score, so that segments end where the evidence does
LEAST_DEVIATION = 3.0  # log-odds nearer to zero than so many standard errors count as zero
LEAST_ODDS = 2.0  # and those nearer than this
LEAST_STRENGTH = 3.0  # root of twice the log-likelihood ratio from which a token counts as weak evidence for toxicity
LEAST_TEXTS = 2  # toxic texts that such a token was seen in
LEAST_WEIGHT = 0.25  # of weak evidence in the calibration: more of it never lowers a score
PUNCTUATION = ".,;:!?\"'()[]"  # around a word
PREFIXES = (4, 5)  # bytes of the word beginnings that are tokens too, for languages that inflect
LOOKED_UP_BYTES = 2 << 20  # of text whose words are looked up together; nothing is kept from one such block to the next
SIGNIFICANT = 0.05  # largest expected number of equally good segments in ordinary text
CALIBRATION_ROWS = 50_000  # size of the labelled sample to which the calibration is fitted
THRESHOLD = 0.3
_FEATURES = 4


@dataclass(frozen=True)
class Model:
    scores: np.ndarray  # by slot
    decay: float  # lambda of the extreme-value law of segment scores in ordinary text
    factor: float  # its K
    weights: np.ndarray  # calibration: constant and one weight per feature
    strengths: np.ndarray | None = None  # by slot: weak evidence for toxicity


def words_of(text: str | None) -> list[bytes]:
    """ASCII-lower-cased words of a text without surrounding punctuation."""
    return [w.strip(PUNCTUATION.encode()) for w in text.encode().lower().split()] if text else []


def split_words(texts: pa.Array) -> tuple[pa.Array, list[np.ndarray]]:
    """``words_of`` for many texts at a time: the distinct words, and for each text the numbers of its words in order."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat, parent = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
    some = pc.not_equal(pc.binary_length(flat), 0)
    ends = np.cumsum(np.bincount(parent[some.to_numpy(zero_copy_only=False)], minlength=len(texts))).tolist()
    raw = flat.filter(some).dictionary_encode()
    words = pc.ascii_trim(raw.dictionary, characters=PUNCTUATION).dictionary_encode()
    numbers = words.indices.to_numpy()[raw.indices.to_numpy()]
    return words.dictionary.cast(pa.binary()), [numbers[begin:end] for begin, end in pairwise([0, *ends])]


def places_of(words: pa.Array) -> np.ndarray:
    """A row per word: the places of its tokens, itself and its beginnings, in both tables; one too short repeats its own."""

    def pairs(tokens: pa.Array) -> np.ndarray:
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens.to_numpy(zero_copy_only=False)), np.uint64, len(tokens))
        return np.column_stack([h >> 44, SLOTS + (h >> 24 & SLOTS - 1)]).astype(np.uint32)

    places = np.tile(pairs(words), 1 + len(PREFIXES))
    size = pc.binary_length(words).to_numpy()
    for k, n in enumerate(PREFIXES, 1):
        long = np.flatnonzero(size >= n)
        begins = pc.binary_slice(words.take(pa.array(long)), 0, n).dictionary_encode()
        tokens = pc.binary_join_element_wise(b"%d" % n, begins.dictionary, b"|")
        places[long, 2 * k:2 * k + 2] = pairs(tokens)[begins.indices.to_numpy()]
    return places


def slots(word: bytes) -> list[tuple[int, int]]:
    """Places of a word's tokens in both tables."""
    return [tuple(pair) for pair in places_of(pa.array([word], pa.binary())).reshape(-1, 2).tolist()]


def distinct(numbers: np.ndarray) -> np.ndarray:
    """Like ``np.unique``, faster on short arrays."""
    numbers = np.sort(numbers, axis=None)
    new = np.ones(len(numbers), bool)
    np.not_equal(numbers[1:], numbers[:-1], out=new[1:])
    return numbers[new]


class Slots:
    """Distinct places of texts' tokens, ascending. Nothing is remembered from one block of texts to the next."""

    def of(self, text: str | None) -> np.ndarray:
        return next(self.of_all(pa.array([text], pa.string())))

    def of_all(self, texts: pa.Array) -> Iterator[np.ndarray]:
        words, numbers = split_words(texts)
        places = places_of(words)
        for at in numbers:
            yield distinct(places[distinct(at)])


def planes(numbers: np.ndarray) -> bytes:
    """Numbers below 2**32, compressed: all lowest bytes, then all second ones and so on, as the higher ones are mostly zero."""
    return zstandard.compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def from_planes(data) -> np.ndarray:
    """The inverse of ``planes``."""
    parts = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1).T
    return np.ascontiguousarray(parts).view("<u4").ravel()


def packed(places: np.ndarray) -> bytes:
    """Ascending numbers by their differences."""
    return planes(np.diff(places, prepend=np.uint32(0)))


def unpacked(data) -> np.ndarray:
    """The inverse of ``packed``."""
    return np.cumsum(from_planes(data), dtype=np.uint32)


class Scores:
    """Score of a word: the strongest evidence among its tokens, for toxicity if there is any, else against.

    A token has the weaker of its two tables' scores, so that a collision in one of them does
    not give an ordinary word the score of another.
    """

    def __init__(self, by_slot: np.ndarray):
        self.by_slot = by_slot

    def of(self, text: str | None) -> np.ndarray:
        words, [numbers] = split_words(pa.array([text], pa.string()))
        return self.of_words(places_of(words))[numbers]

    def of_words(self, places: np.ndarray) -> np.ndarray:
        """A score for each row of ``places_of``."""
        a, b = (self.by_slot[places[:, k::2]].astype(np.float64) for k in (0, 1))
        s = np.where(a * b <= 0, 0.0, np.where(np.abs(a) <= np.abs(b), a, b))
        top = s.max(axis=1)
        return np.where(top > 0, top, s.min(axis=1)) - DRIFT


def strength_of_words(places: np.ndarray, by_strength: np.ndarray | None) -> np.ndarray:
    """Weak evidence for toxicity of each row of ``places_of``: the strongest of its tokens, each the weaker of its two tables'."""
    if by_strength is None:
        return np.zeros(len(places))
    return np.minimum(by_strength[places[:, ::2]], by_strength[places[:, 1::2]]).max(axis=1).astype(np.float64)


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (begin, end, score) of a sequence, in linear time.

    They are disjoint, and none can be lengthened, shortened or merged with gain. Runs of
    one sign are joined first. Each candidate keeps the running total before it and at its
    end; a new one merges back into the last whose earlier total is smaller, unless that
    one's end total is at least as high.
    """
    if not (scores > 0).any():
        return []
    change = np.flatnonzero(np.diff((scores > 0).astype(np.int8))) + 1
    begins = np.concatenate([[0], change])
    ends = np.concatenate([change, [len(scores)]])
    sums = np.add.reduceat(scores, begins)
    total = 0.0
    # begin, end, total before, total at the end, link to the last candidate with a smaller total before
    found: list[list] = []
    for begin, end, s in zip(begins.tolist(), ends.tolist(), sums.tolist(), strict=True):
        if s <= 0:
            total += s
            continue
        low, total = total, total + s
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= low:
                j = found[j][4]
            if j < 0 or found[j][3] >= total:
                found.append([begin, end, low, total, j])
                break
            begin, low = found[j][0], found[j][2]
            del found[j:]
    return [(b, e, high - low) for b, e, low, high, _ in found]


def features(scores: np.ndarray, decay: float, factor: float) -> np.ndarray:
    """Extreme-value features of a token score sequence.

    A segment's expected number in ordinary text of n tokens is K n exp(-lambda S). The
    features: the best segment's normalised score lambda S - ln(K n), the same summed over
    all significant segments, and the logarithm of one plus their number.
    """
    n = len(scores)
    if not n:
        return np.zeros(3)
    segments = maximal_segments(scores)
    if not segments:
        return np.array([-1.0, 0.0, 0.0])
    normal = decay * np.array([s for _, _, s in segments]) - math.log(max(factor * n, 1.0))
    good = normal[normal > -math.log(SIGNIFICANT)]
    return np.array([max(normal.max(), -5.0) / 5, math.log1p(good.sum() if len(good) else 0.0), math.log1p(len(good))])


def measures(texts: pa.Array, models: list[tuple], which: list[int] | None = None) -> np.ndarray:
    """A row per text: ``features`` and the logarithm of one plus the strength of its distinct words' weak evidence.

    Segments need tokens that are sure to differ; where labels are few no token is, and the weak evidence alone ranks texts.
    ``models`` are (scores by slot, decay, factor, strengths by slot), ``which`` says by number whose evidence a text
    gets. Words are looked up once for all texts, so these should be a block of bounded size.
    """
    words, numbers = split_words(texts)
    places = places_of(words)
    known = [
        (Scores(by_slot).of_words(places), decay, factor, strength_of_words(places, by_strength))
        for by_slot, decay, factor, by_strength in models]
    x = np.zeros((len(texts), _FEATURES))
    for k, at in enumerate(numbers):
        scores, decay, factor, strengths = known[which[k] if which else 0]
        x[k, :-1] = features(scores[at], decay, factor)
        weak = at[strengths[at] > 0]
        x[k, -1] = math.log1p(math.fsum(strengths[distinct(weak)])) if len(weak) else 0.0
    return x


def passages(text: str | None, model: Model, scores: Scores) -> list[tuple[int, int, float]]:
    """Every significant toxic passage: first word, word after the last, expected number in ordinary text."""
    s = scores.of(text)
    found = []
    for begin, end, score in maximal_segments(s):
        expected = model.factor * len(s) * math.exp(-model.decay * score)
        if expected < SIGNIFICANT:
            found.append((begin, end, expected))
    return found


def log_odds(toxic: Column, plain: Column, n_toxic: Column, n_plain: Column) -> Column:
    """Log-odds of a slot from its counts and the totals, under a Dirichlet prior that follows the total counts.

    0 where the evidence is weak: fewer than LEAST_DEVIATION standard errors, or nearer than LEAST_ODDS.
    """
    prior, total = PRIOR * (toxic + plain), PRIOR * (n_toxic + n_plain)
    in_toxic, in_plain = toxic + prior, plain + prior
    d = F.ln(in_toxic / (n_toxic + total)) - F.ln(in_plain / (n_plain + total))
    error = F.sqrt(1 / in_toxic + 1 / in_plain)
    seen = (toxic + plain > 0) & (n_toxic > 0) & (n_plain > 0)
    strong = seen & (F.abs(d) >= LEAST_DEVIATION * error) & (F.abs(d) >= LEAST_ODDS)
    return F.when(strong, F.greatest(F.least(d, F.lit(6.0)), F.lit(-6.0))).otherwise(0.0)


def strength(toxic: Column, plain: Column, n_toxic: Column, n_plain: Column) -> Column:
    """Weak evidence of a slot for toxicity: the signed root of the log-likelihood ratio above LEAST_STRENGTH, else 0.

    It compares the share of toxic texts among those that hold a token with their share in all counts; unlike the error
    of ``log_odds`` it is sound for tokens that ordinary texts never hold, at any number of texts.
    """
    share, n = F.try_divide(n_toxic, n_toxic + n_plain), toxic + plain
    ratio = lambda seen, expected: F.when(seen > 0, seen * F.ln(F.try_divide(seen, expected))).otherwise(0.0)
    root = F.sqrt(F.greatest(2 * (ratio(toxic, n * share) + ratio(plain, n * (1 - share))), F.lit(0.0)))
    counts = (n_toxic > 0) & (n_plain > 0) & (toxic >= LEAST_TEXTS) & (toxic > n * share)
    return F.when(counts & (root > LEAST_STRENGTH), root - LEAST_STRENGTH).otherwise(0.0)


def extreme_values(scores: np.ndarray, ordinary: np.ndarray, total: float) -> tuple[float, float]:
    """Lambda and K of segment scores in ordinary text.

    ``scores`` and ``ordinary`` are the evidence of the tokens that have any and their counts
    there, of ``total`` counts; all others score -DRIFT. Lambda solves E[exp(lambda s)] = 1. K is
    taken as the squared drift over the drift under the tilted law, the first term of its
    series, kept within (0, 1].
    """
    s = np.append(scores.astype(np.float64), 0.0) - DRIFT
    p = np.append(ordinary, max(total - ordinary.sum(), 1.0)).astype(np.float64)
    p /= p.sum()
    if s.max() <= 0 or (p * s).sum() >= 0:
        return 1.0, 1.0
    p = np.maximum(p, 1e-9 * (s > 0))  # a token not seen in ordinary text is rare there, not impossible
    low, high = 0.0, 1.0
    while (p * np.exp(high * s)).sum() < 1 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(mid * s)).sum() < 1 else (low, mid)
    drift = (p * s * np.exp(high * s)).sum()
    return high, float(np.clip((p * s).sum() ** 2 / max(drift, 1e-9), 1e-6, 1.0))


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (doc_id, places): the packed places of a text's tokens, a fraction of its bytes."""
    for batch in blocks(batches, lambda b: b.column("text"), LOOKED_UP_BYTES):
        places = [packed(p) for p in Slots().of_all(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(places, pa.binary())], ["doc_id", "places"])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(places, toxic, fold) to numbers of texts, summed over a task: a row (block, kind, n) has those of BLOCK places."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for places, label, fold in zip(batch.column("places"), *(batch.column(c).to_pylist() for c in ("toxic", "fold")), strict=True):
            into = held.setdefault(2 * fold + label, np.zeros(2 * SLOTS, np.uint32))
            into[unpacked(places.as_buffer())] += 1
    for kind, n in held.items():
        rows = n.reshape(-1, BLOCK)
        at = np.flatnonzero(rows.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(at, pa.int32()), pa.array(np.full(len(at), kind), pa.int32()), pa.array([planes(rows[k]) for k in at], pa.binary())],
            ["block", "kind", "n"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``_counts`` to (slot, p0, t0, p1, t1); holds one sum a block, however many tasks sent one."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, kind, n in zip(*(batch.column(c).to_pylist() for c in ("block", "kind")), batch.column("n"), strict=True):
            held.setdefault(block, np.zeros((4, BLOCK), np.int64))[kind] += from_planes(n.as_buffer())
    for block, n in held.items():
        at = np.flatnonzero(n.any(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(at + block * BLOCK, pa.int32()), *[pa.array(row[at], pa.float64()) for row in n.astype(np.float64)]],
            ["slot", "p0", "t0", "p1", "t1"])


def _fitted(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps with a light ridge."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    if not len(y) or y.min() == y.max():
        w[0] = -4.0 if not len(y) or y.max() == 0 else 4.0
        return w
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (y - p) - 0.01 * w
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def labelled_places(texts: DataFrame, known: DataFrame) -> DataFrame:
    """(places, toxic, fold) of the labelled texts.

    The join is a shuffle at any size: by a broadcast of the labels the texts' places and their sums would be made in one
    stage, by two Python processes a core at a time instead of one.
    """
    sent = sieved(texts, known, ["doc_id"]).where("possible").select("doc_id", "text")
    sent = sent.mapInArrow(_places, sent.select("doc_id").schema.add("places", "binary"))
    return sent.join(known.hint("merge"), "doc_id").select("places", "toxic", "fold")


def train(docs: DataFrame, labels: DataFrame, calibration_rows: int = CALIBRATION_ROWS) -> Model:
    """Fit on the labelled documents outside the held-out quarter.

    Token counts come from all of them and are summed in the tasks first; the log-odds are
    computed where the sums are, and the driver gets the slots with evidence only, at most
    2 SLOTS. The calibration is fitted to about ``calibration_rows`` labelled documents (all if
    there are fewer, else those of smallest hash of doc_id), each scored by the counts of the
    other half, so that it does not see its own text. Without any labelled row every score is a
    constant. A document with contradicting labels counts as toxic; rows that repeat a labelled
    doc_id all count, and one of them is in the sample.

    Texts are never shuffled, however many ids are labelled: a sieve of fixed size leaves out
    what is surely unlabelled, the others send the packed places of their distinct tokens to
    their labels, and the sample's ids, whose number is bounded, go to the texts. A task sends its
    counts packed, blocks of slots at a time, and the sums of a block are taken in one pass over them.
    """
    spark = docs.sparkSession
    known = labels.select("doc_id", "toxic").where("toxic in (0, 1) and doc_id is not null").where(~is_held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType)).withColumns({
        "fold": F.xxhash64("doc_id").bitwiseAND(F.lit(1)).cast("int"), "place": F.shiftrightunsigned(F.xxhash64(F.lit(9), "doc_id"), 2)})
    known, n_known = counted(known)
    texts = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull()).where(~is_held_out(F.col("doc_id")))
    sums = labelled_places(texts, known).mapInArrow(_counts, "block int, kind int, n binary").repartition("block")
    halves = sums.mapInArrow(_summed, "slot int, p0 double, t0 double, p1 double, t1 double")
    kinds = "01b"  # each half, both
    counts = materialize(halves.selectExpr("*", "t0 + t1 AS tb", "p0 + p1 AS pb"))
    names = [f"{name}{k}" for k in kinds for name in "tp"]
    totals = counts.where(F.col("slot") < SLOTS).agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in names]).first()
    odds = {k: log_odds(F.col(f"t{k}"), F.col(f"p{k}"), F.lit(totals[f"t{k}"]), F.lit(totals[f"p{k}"])).alias(f"d{k}") for k in kinds}
    weak = {k: strength(F.col(f"t{k}"), F.col(f"p{k}"), F.lit(totals[f"t{k}"]), F.lit(totals[f"p{k}"])).cast("float").alias(f"s{k}") for k in kinds}
    found = counts.select("slot", *[f"p{k}" for k in kinds], *odds.values(), *weak.values())
    found = found.where(" or ".join(f"d{k} <> 0 or s{k} > 0" for k in kinds)).toArrow()
    slot = found.column("slot").to_numpy()
    models = {}
    for k in kinds:
        evidence, plain = found.column(f"d{k}").to_numpy(), found.column(f"p{k}").to_numpy()
        scores = np.zeros(2 * SLOTS, np.float32)
        scores[slot] = evidence
        strengths = np.zeros(2 * SLOTS, np.float32)
        strengths[slot] = found.column(f"s{k}").to_numpy()
        first = (slot < SLOTS) & (evidence != 0)
        models[k] = (scores, *extreme_values(evidence[first], plain[first], totals[f"p{k}"]), strengths)
    held = spark.sparkContext.broadcast([_sparse(models[k]) for k in "10"])  # for a document's half, what the other half says

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [_dense(m) for m in held.value]
        for batch in blocks(batches, lambda b: b.column("text"), LOOKED_UP_BYTES):
            x = measures(batch.column("text"), known, batch.column("fold").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("toxic"), *[pa.array(x[:, k]) for k in range(_FEATURES)]],
                schema.names)

    share = int(min(1.0, calibration_rows / max(n_known, 1)) * (1 << 62))
    sample = known.where(F.col("place") <= share).select("doc_id", "fold", "toxic")
    sample = texts.join(F.broadcast(sample), "doc_id").select("doc_id", "text", "fold", "toxic")
    schema = sample.select("doc_id").schema.add("toxic", "integer")
    for k in range(_FEATURES):
        schema = schema.add(f"x{k}", "double")
    got = sample.mapInArrow(measured, schema).groupBy("doc_id").agg(F.min(F.struct(*schema.names[1:])).alias("x"))
    got = got.orderBy("doc_id").select("x.*").toArrow()
    x = np.column_stack([got.column(f"x{k}").to_numpy() for k in range(_FEATURES)])
    weights = _fitted(x, got.column("toxic").to_numpy().astype(float))
    weights[-1] = max(weights[-1], LEAST_WEIGHT)
    return Model(*models["b"][:3], weights, models["b"][3])


def _sparse(model: tuple) -> tuple:
    """The arrays by slot of a model as places and values, as few slots have evidence."""
    return tuple((np.flatnonzero(m).astype(np.uint32), m[m != 0]) if isinstance(m, np.ndarray) else m for m in model)


def _dense(model: tuple) -> tuple:
    """The inverse of ``_sparse``."""

    def whole(at: np.ndarray, values: np.ndarray) -> np.ndarray:
        out = np.zeros(2 * SLOTS, np.float32)
        out[at] = values
        return out

    return tuple(whole(*m) if isinstance(m, tuple) else m for m in model)


def _probability(weights: np.ndarray, x: np.ndarray) -> float:
    z = weights[0] + float(weights[1:] @ x)
    return 1 / (1 + math.exp(-min(max(z, -30.0), 30.0)))


def score_of(text: str | None, model: Model, scores: Scores) -> float:
    x = measures(pa.array([text], pa.string()), [(scores.by_slot, model.decay, model.factor, model.strengths)])
    return _probability(model.weights, x[0])


def _scored(rows: DataFrame, model: Model, texts_of) -> DataFrame:
    """The columns that ``texts_of`` keeps of a batch, and ``score`` of the texts it gives; whole texts, no shuffle."""
    held = rows.sparkSession.sparkContext.broadcast((_sparse((model.scores, model.decay, model.factor, model.strengths)), model.weights))
    kept = [c for c in rows.columns if c != "text"]
    schema = rows.select(*kept).schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weights = [_dense(held.value[0])], held.value[1]
        for batch in blocks(batches, texts_of, LOOKED_UP_BYTES):
            out = [_probability(weights, x) for x in measures(texts_of(batch), known)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(out, pa.float64())], schema.names)

    return rows.mapInArrow(run, schema)


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, score (0 to 1), predicted (score >= 0.3).

    The score depends on the text alone; null and empty texts get the score of a text without
    segments. A row without doc_id is not held out.
    """
    scored = _scored(docs.select("doc_id", "text"), train(docs, labels), lambda batch: batch.column("text"))
    return scored.select(
        "doc_id", F.coalesce(is_held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score is below the threshold, in their columns whatever their names."""
    model = train(docs, labels)
    rows = keyed(docs).select("row")
    scored = _scored(rows, model, lambda batch: batch.column("row").field("text"))
    return scored.where(F.col("score") < THRESHOLD).select("row.*")
