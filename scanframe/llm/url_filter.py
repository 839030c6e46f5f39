"""URL filters: host and path rules first, logistic regression on hashed character n-grams for the rest."""

from __future__ import annotations

import uuid

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanframe.functions.cluster import own_folder
from scanframe.functions.rows import let
from scanframe.llm.common import constant_table

GRAMS = (3, 4, 5)
SLOTS = 1 << 16
TRAINING_ROWS = 20_000  # bound of the labelled rows the model is fitted to
ALLOW, BLOCK = "allow", "block"

#: (verdict, host and path): the path begins at the first slash.
RULES = [
    ("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]

#: Words of the hosts in the small labelled table: own examples of what a corpus keeps and of what it leaves out.
GOOD_WORDS = """
    library archive garden news harbour weather museum recipes physics teaching poetry maps
    railway chess birds ocean research medicine history village bookshop orchard journal lantern"""
BAD_WORDS = """
    cheap pills adult video xxx casino bonus poker lottery singles replica spam
    free money loans cams porn viagra meds warez crack betting escort winner"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://`` with A-Z lower-cased, path up to ``?`` or ``#``; both empty for null or without ``://``."""
    rest = F.when(F.locate("://", url) > 0, F.regexp_replace(url, r"^[\s\S]*?://", "")).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), _UPPER, _LOWER), F.coalesce(path, F.lit(""))


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, null without one; of equal length the first by code point."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, where in sorted(rules, key=lambda r: (len(r[1]), r[1]), reverse=False):
        name, slash, rest = where.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, where).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def _grams(host: Column, path: Column) -> Column:
    """Character n-grams of host and path, each marked with its part; the ends are marked by a space.

    A text is split into its characters once and neighbours are joined: linear in its length.
    """
    def grams(mark: str, value: Column) -> Column:
        def of(chars: Column, n: int) -> Column:
            starts = F.when(F.size(chars) >= n, F.sequence(F.lit(0), F.size(chars) - n)).otherwise(F.array().cast("array<int>"))
            return F.transform(starts, lambda i: F.concat(F.lit(mark), *[F.get(chars, i + k) for k in range(n)]))

        return let(F.split(F.concat(F.lit(" "), value, F.lit(" ")), ""), lambda chars: F.concat(*[of(chars, n) for n in GRAMS]))

    return F.concat(grams("h", host), grams("p", path))


def _vectors(rows: DataFrame) -> DataFrame:
    grams = rows.withColumn("grams", _grams(F.col("host"), F.col("path")))
    return HashingTF(numFeatures=SLOTS, binary=True, inputCol="grams", outputCol="features").transform(grams)


def train(labelled: DataFrame, training_rows: int = TRAINING_ROWS) -> LogisticRegressionModel | None:
    """Fit to a labelled URL table (host, path, verdict), of which the ``training_rows`` of smallest hash are used.

    None if the table has not both verdicts.
    """
    rows = labelled.select("host", "path", (F.col("verdict") == BLOCK).cast("double").alias("label")).distinct()
    rows = rows.orderBy(F.xxhash64(F.lit(5), "host", "path"), "host", "path", "label").limit(training_rows)
    if rows.select("label").distinct().count() < 2:
        return None
    fit = LogisticRegression(maxIter=30, regParam=0.001, standardization=False).fit(_vectors(rows).select("features", "label"))
    # written and read again: the fitted object still holds its training session, which tasks cannot be sent
    folder = f"{own_folder(labelled.sparkSession)}/url-model-{uuid.uuid4().hex}"
    fit.write().save(folder)
    return LogisticRegressionModel.load(folder)


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The small labelled table (url, verdict) of this module: 96 hosts a verdict, each of two of its words.

    Hosts, schemes and paths are formed alike for both verdicts, so that only the words differ.
    """
    rows = []
    for verdict, words in ((ALLOW, GOOD_WORDS.split()), (BLOCK, BAD_WORDS.split())):
        for i, word in enumerate(words):
            for step in (1, 5, 7, 11):
                k = 4 * i + step
                name = ("www.", "m.", "blog.", "")[k % 4] + word + "-"[:k % 3] + words[(i + step) % len(words)]
                end = ("example.net", "example.com", "net", "com")[k // 3 % 4]
                path = ("/", f"/en/{37 * k}", f"/de/{53 * k}.html", f"/fr/{11 * k}", f"/es/{7 * k}/")[k % 5]
                rows.append({"url": f"{('http', 'https')[k % 2]}://{name}.{end}{path}", "verdict": verdict})
    return constant_table(spark, rows, "url string, verdict string")


def judge_pages(
        pages: DataFrame, rules: list[tuple[str, str]] | None = None, labelled: DataFrame | None = None,
        training_rows: int = TRAINING_ROWS) -> DataFrame:
    """Per row: page_id, host, path, rule (that decided, else null), verdict (allow or block).

    Where no rule fits, the model decides. It is trained from ``labelled`` (url, verdict), by default
    the small table ``labelled_urls``. If there are not two verdicts to learn from, the rest gets
    the only one, or allow. Null URLs and those without ``://`` have empty host and path and are
    judged like any other; repeated rows each get a row; the cost is linear in a URL's length.
    """
    rules = RULES if rules is None else rules

    def judged(df: DataFrame) -> DataFrame:
        host, path = host_and_path(F.col("url"))
        rows = df.withColumns({"host": host, "path": path})
        rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
        return rows.withColumns({"rule": rule, "ruled": verdict})

    rows = judged(pages.select("page_id", "url"))
    host, path = host_and_path(F.col("url"))
    labelled = labelled_urls(pages.sparkSession) if labelled is None else labelled
    known = labelled.select(host.alias("host"), path.alias("path"), "verdict")
    model = train(known, training_rows)
    if model is None:
        only = known.select("verdict").limit(1).collect()
        return rows.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.lit(only[0][0] if only else ALLOW)).alias("verdict"))
    scored = model.transform(_vectors(rows))
    guess = F.when(F.col("prediction") == 1.0, BLOCK).otherwise(ALLOW)
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", guess).alias("verdict"))
