"""Filter interaction audit: count-weighted decision diagrams of failure masks, reordered by adjacent level swaps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanframe.functions.cluster import materialize
from scanframe.llm.common import WORD_SPACE

#: Numbers of documents that the diagrams carry: all, of good quality, toxic.
MEASURES = ("n", "good", "toxic")
LETTERS = "ABCDE"


class Diagram:
    """Decision diagram of failure masks with counts at the leaves.

    Level d tests the d-th filter of the current order: the low child has what passes it, the
    high child what fails. Nodes of a level with equal children are one node, so every level
    has as many nodes as there are different remainders. ``weight`` is the sum of the counts below.
    """

    def __init__(self, names: str, counts: dict[int, tuple[int, ...]], width: int):
        self.order = list(range(len(names)))
        self.names = names
        self.levels: list[dict[int, tuple[int, int]]] = [{} for _ in names]
        self.shared: list[dict[tuple[int, int], int]] = [{} for _ in names]
        self.weight: dict[int, tuple[int, ...]] = {}
        self._next = 0
        leaves: dict[tuple[int, ...], int] = {}

        def below(depth: int, mask: int) -> int:
            if depth < len(names):
                return self._node(depth, below(depth + 1, mask), below(depth + 1, mask | 1 << depth))
            value = counts.get(mask, (0,) * width)
            if value not in leaves:
                leaves[value] = self._new(value)
            return leaves[value]

        self.root = below(0, 0)

    def _new(self, weight: tuple[int, ...]) -> int:
        self._next += 1
        self.weight[self._next] = weight
        return self._next

    def _node(self, depth: int, low: int, high: int) -> int:
        found = self.shared[depth].get((low, high))
        if found is None:
            found = self._new(tuple(a + b for a, b in zip(self.weight[low], self.weight[high], strict=True)))
            self.shared[depth][low, high] = found
            self.levels[depth][found] = low, high
        return found

    def swap(self, depth: int) -> None:
        """Exchange the filters of a level and the next one; nodes of all other levels stay as they are.

        What a node of the upper level stands for does not change, so its number stays and
        nothing above it notices; its grandchildren change places.
        """
        upper, lower = self.levels[depth], self.levels[depth + 1]
        for node in lower:
            del self.weight[node]
        self.levels[depth + 1], self.shared[depth + 1] = {}, {}
        for node, (low, high) in upper.items():
            (pass_pass, pass_fail), (fail_pass, fail_fail) = lower[low], lower[high]
            upper[node] = self._node(depth + 1, pass_pass, fail_pass), self._node(depth + 1, pass_fail, fail_fail)
        self.shared[depth] = {children: node for node, children in upper.items()}
        self.order[depth], self.order[depth + 1] = self.order[depth + 1], self.order[depth]

    def all_pass(self) -> Iterator[tuple[int, tuple, tuple, tuple]]:
        """Along the path of what passes every filter: filter, counts kept, counts removed, counts that fail it alone."""
        node = self.root
        for depth, name in enumerate(self.order):
            low, high = self.levels[depth][node]
            alone = high
            for later in range(depth + 1, len(self.order)):
                alone = self.levels[later][alone][0]
            # the path so far has passed the earlier filters, so those that fail this one alone are among its high child
            yield name, self.weight[low], self.weight[high], self.weight[alone]
            node = low


def adjacent_swaps(n: int) -> Iterator[int]:
    """Levels whose swaps, one after the other, lead through every order of n filters once.

    The last filter wanders from end to end; between its journeys the others make one step.
    """
    if n < 2:
        return
    others, down = adjacent_swaps(n - 1), True
    while True:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        step = next(others, None)
        if step is None:
            return
        yield step + down
        down = not down


def audit_steps(names: str, counts: dict[int, tuple[int, ...]]) -> list[tuple]:
    """(order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for every order of the filters."""
    diagram = Diagram(names, counts, len(MEASURES))
    failing, shapley, steps = [0] * len(names), [0] * len(names), []
    swaps = adjacent_swaps(len(names))
    while True:
        order = "".join(names[k] for k in diagram.order)
        for step, (k, kept, removed, alone) in enumerate(diagram.all_pass(), 1):
            if step == 1:
                failing[k] = removed[0]
            shapley[k] += removed[0]
            steps.append((order, step, k, kept[0], removed, alone[0]))
        level = next(swaps, None)
        if level is None:
            break
        diagram.swap(level)
    return [
        (order, step, kept, removed[0], failing[k] - removed[0], alone, *removed[1:], shapley[k])
        for order, step, k, kept, removed, alone in steps]


_STEPS = ("filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(masks: DataFrame, names: str = LETTERS) -> DataFrame:
    """One row per part, order of the filters and step, from (part string, mask int, n, good, toxic long).

    Bit k of a mask tells that filter k fails. Counts of one part and mask are added up before
    they are sent, so a part meets in one task as at most 2^len(names) rows whatever its size.
    The result has len(names)! orders a part; parts without rows have none.
    """
    summed = masks.groupBy("part", "mask").agg(*[F.sum(c).cast("long").alias(c) for c in MEASURES])

    def run(group: pa.Table) -> pa.Table:
        columns = [group.column(c).to_pylist() for c in ("mask", *MEASURES)]
        rows = audit_steps(names, {mask: tuple(n) for mask, *n in zip(*columns, strict=True)})
        found = dict(zip(_STEPS, zip(*rows, strict=True), strict=True))
        part = group.column("part")[0].as_py()
        return pa.table({
            "part": pa.array([part] * len(rows), pa.string()), "filter_order": pa.array(found["filter_order"], pa.string()),
            "step": pa.array(found["step"], pa.int32()), **{c: pa.array(found[c], pa.int64()) for c in _STEPS[2:]}})

    longs = ", ".join(f"{c} long" for c in _STEPS[2:])
    return summed.groupBy("part").applyInArrow(run, f"part string, filter_order string, step int, {longs}")


def text_failures(text: Column) -> Column:
    """Bits of the filters A to D, which look at a text alone."""
    words = F.array_remove(F.split(text, WORD_SPACE), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    fails = [
        n < 200, 100 * distinct.cast("long") < 50 * n.cast("long"),
        100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 3 * F.length(text).cast("long"), text.rlike("[#$%&*|]")]
    return sum(F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails))


def failure_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): how many documents of a part fail which of the filters A to E.

    Texts are read once and go on as two independent 64-bit hashes. Documents meet their
    labels by id and the copies of their text by hash; of copies only sums and the smallest id
    leave a task, so a group of any size is a few rows. ``mask`` bit 4 (E) is set where a smaller
    doc_id has the same text in the whole table.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    thin = docs.select(
        "doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text_failures(text).alias("mask"),
        F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(7), text).alias("h2"))
    known = labels.where("doc_id is not null and (quality = 1 or toxic = 1)").groupBy("doc_id").agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    rows = thin.join(known, "doc_id", "left")
    same = ["h1", "h2", "part", "mask"]
    by_id = rows.groupBy(*same, "doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    counts = [F.col(c) for c in MEASURES]
    texts = materialize(by_id.groupBy(*same).agg(
        *[F.sum(c).alias(c) for c in MEASURES],
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", *counts))).alias("first"),
        F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("without_id")))
    least = texts.groupBy("h1", "h2").agg(F.min("first.doc_id").alias("least"))
    joined = texts.join(least, ["h1", "h2"])
    leads = F.coalesce(F.col("first.doc_id") == F.col("least"), F.lit(False))

    def passing(measure: str) -> Column:
        return F.when(leads, F.col("first")[measure]).otherwise(0) + (F.col("without_id") if measure == "n" else 0)

    twice = F.array(
        F.struct(F.col("mask").alias("mask"), *[passing(c).alias(c) for c in MEASURES]),
        F.struct((F.col("mask") + (1 << 4)).alias("mask"), *[(F.col(c) - passing(c)).alias(c) for c in MEASURES]))
    split = joined.select("part", F.explode(twice).alias("s")).select("part", "s.*").where("n > 0")
    return split.groupBy("part", "mask").agg(*[F.sum(c).cast("long").alias(c) for c in MEASURES])


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What each of five filters removes in each of their 120 orders, per language.

    Filters: A fewer than 200 words, B fewer than half of the words distinct, C more than 3 %
    capital letters A-Z, D one of ``#$%&*|``, E a smaller doc_id has the same text anywhere. Null
    and empty texts are equal and have no words; a null language is the part with the empty
    name. A null doc_id has no smaller one, is smaller than none, and has no label; rows that
    repeat a doc_id count each and are no copies of each other. A document is good or toxic if
    any of its label rows says so. Empty tables give no rows; other columns are not looked at.
    """
    return audit(failure_masks(docs, labels))
