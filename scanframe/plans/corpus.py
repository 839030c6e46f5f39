"""Tables derived from the given ones: a code corpus from orders, scan history from events.

Every order becomes one source file, computed from its own columns (no shuffle, bounded
size per file). The same SQL text runs in Spark and in the oracle; only the array function
differs, see ``files_sql``.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanframe.functions import cluster

FILES_PER_TASK = 20_000  # files that one task makes and scans, about 20 seconds of the combined scan

# {i} = position of the snippet in its file, {p} = a number; other braces are literal.
PYTHON_SNIPPETS = [
    "x{i} = {p}",
    "# TODO check part {p}",
    "h{i} = hashlib.md5(b{i})",
    'cur.execute("SELECT n FROM parts WHERE k = %s" % k{i})',
    'os.system("ls " + d{i})',
    'password = "admin"',
    'api_token_{i} = "t{p}"',
    "import pickle",
    "obj{i} = pickle.loads(raw{i})",
    "cfg{i} = yaml.load(s{i})",
    "subprocess.run(c{i}, shell=True)",
    "val{i} = eval(e{i})",
    "app.run(debug=True)",
    'def _helper{i}():\n    return compile(src{i}, "f", "exec")',
    "class C{i}:\n    def get(self):\n        return requests.get(base + user_input)",
    "async def _a{i}():\n    exec(z{i})",
    'u{i} = request.args.get("q")\nrun_query(u{i})',
    'u{i} = request.args.get("q")\nv{i} = html.escape(u{i})\nrun_query(v{i})',
    'u{i} = request.GET("q")\nw{i} = build_query(u{i})\ncursor.execute(w{i})',
    'url{i} = f"https://host/{q{i}}/x"',
    'try:\n    login(u{i}, "pw{p}")\nexcept Exception:\n    pass',
    "if a{i}:\n    print(password)",
    "from pickle import loads",
    'print("ok {p}")',
    '# @GetMapping("/p{i}")',
    '@app.route("/p{i}")\ndef page{i}():\n    return 1',
    'findById(request.args["k"])',
    'q{i} = "DELETE FROM t WHERE id = $k"',
    "from Crypto import Random",
    'db.execute("SELECT n FROM t WHERE k=" + k{i})',
    'cursor.execute("SELECT %s" % k{i})',
    'sql = f"SELECT {k{i}}"',
    "# FIXME security review {p}",
    'token = "abc"  # TODO',
    "# spring-core:4.1",
    "# django==1.8",
    "# flask==0.9",
    "# jackson-databind:2.9.1",
    'if password == "short":\n    pass',
    "pickle.loads(user_input)",
    "# ObjectInputStream x; x.readObject()",
    "eval(json.loads(j{i}))",
    '# @PreAuthorize("x")',
    "# failed admin login",
    "axios.get(base + path)",
    "for r{i} in rows:\n    while r{i}:\n        break\n        os.popen(r{i})",
    "def f{i}(n):\n    raise ValueError(n)\n    eval(n)",
    'c{i} = input("cmd")\nos.system(c{i})',
    'a{i} = request.GET("q")\nb{i} = step(a{i})\nc{i} = step(b{i})\nd{i} = step(c{i})\ne{i} = step(d{i})\nf{i} = step(e{i})\n'
    "g{i} = step(f{i})\nos.popen(g{i})",
    'try:\n    t{i} = input("k")\n    eval(t{i})\nexcept Exception:\n    pass',
]
JAVA_SNIPPETS = [
    "int a{i} = {p};",
    "// FIXME part {p}",
    "public class K{i} {",
    "public void run{i}(String s) {",
    'Runtime.getRuntime().exec("ls " + s);',
    'File f{i} = new File("/d/" + s);',
    'MessageDigest.getInstance("MD5");',
    "e.printStackTrace();",
    'System.out.println("token" + t);',
    'session.createQuery("from P where id=" + s);',
    "}",
    'Cipher.getInstance("AES/ECB/PKCS5Padding");',
    'response.getWriter().write("a" + s);',
    'Path p{i} = Paths.get("/r/" + s);',
    'em.createNativeQuery("select " + s);',
]


def template_sql(text: str) -> str:
    """SQL expression for a snippet text; ``i`` and ``p`` are SQL names in scope."""
    parts = []
    for piece in re.split(r"(\{i\}|\{p\}|\n)", text):
        if piece == "\n":
            parts.append("chr(10)")
        elif piece in ("{i}", "{p}"):
            parts.append(f"CAST({piece[1]} AS STRING)")
        elif piece:
            parts.append(f"'{piece}'")
    return f"concat({', '.join(parts)})"


def _case(name: str, snippets: list[str]) -> str:
    whens = " ".join(f"WHEN {n} THEN {template_sql(s)}" for n, s in enumerate(snippets))
    return f"CASE {name} {whens} END"


# Per order: language, number of snippets; per position i: snippet index and number p.
BASE_SQL = """
    SELECT o_orderkey AS k, o_custkey AS c, o_orderdate AS ts,
           CASE WHEN o_orderkey % 8 = 7 THEN 'other' WHEN o_orderkey % 4 = 0 THEN 'java' ELSE 'py' END AS lang,
           CASE WHEN o_orderkey % 50 = 0 THEN 60 ELSE 1 + o_orderkey % 7 END AS n,
           concat('proj_', CAST(o_custkey % 20 AS STRING)) AS project,
           CASE WHEN o_orderkey % 16 = 5 THEN concat(chr(13), chr(10)) ELSE chr(10) END AS sep
    FROM orders"""
PATH_SQL = """concat(project, '/src/f_', CAST(k AS STRING),
           CASE lang WHEN 'py' THEN '.py' WHEN 'java' THEN '.java' ELSE '.txt' END)"""
INDEX_SQL = f"""CASE WHEN lang = 'java' THEN (c * 5 + k + i * 7) % {len(JAVA_SNIPPETS)}
           ELSE (c * 7 + k * 3 + i * 11) % {len(PYTHON_SNIPPETS)} END"""
NUMBER_SQL = "(c * 31 + i * 17) % 20000"


def snippet_sql() -> str:
    """Text of snippet ``i`` of file ``(k, c, lang)``."""
    def fill(s: str) -> str:
        return re.sub(r"CAST\(p AS STRING\)", f"CAST({NUMBER_SQL} AS STRING)", s)

    return (
        f"CASE WHEN lang = 'java' THEN {fill(_case(f'((c * 5 + k + i * 7) % {len(JAVA_SNIPPETS)})', JAVA_SNIPPETS))} "
        f"ELSE {fill(_case(f'((c * 7 + k * 3 + i * 11) % {len(PYTHON_SNIPPETS)})', PYTHON_SNIPPETS))} END")


def _halves(name: str, snippets: list[str], first: int = 0) -> str:
    """Like ``_case``, found by halves: comparisons as the logarithm of the number of snippets."""
    if len(snippets) == 1:
        return template_sql(snippets[0])
    half = len(snippets) // 2
    below, above = _halves(name, snippets[:half], first), _halves(name, snippets[half:], first + half)
    return f"CASE WHEN {name} < {first + half} THEN {below} ELSE {above} END"


def _spark_snippet_sql() -> str:
    """``snippet_sql`` for Spark, which would compute the index again for every snippet that it is compared with."""
    branches = f"CASE WHEN lang = 'java' THEN {_halves('at', JAVA_SNIPPETS)} ELSE {_halves('at', PYTHON_SNIPPETS)} END"
    branches = branches.replace("CAST(p AS STRING)", f"CAST({NUMBER_SQL} AS STRING)")
    return f"element_at(transform(array({INDEX_SQL}), at -> CASE WHEN at >= 0 THEN {branches} END), 1)"  # as no other index has one


def files_sql(each: str, join: str, snippet: str | None = None) -> str:
    """Files table. ``each`` maps over 1..n, ``join`` puts an array together, one line each."""
    body = join.format(array=each.format(n="n", body=snippet or snippet_sql()))
    return f"""
    SELECT {PATH_SQL} AS path, project, lang, ts,
           replace(concat({body}, CASE WHEN k % 3 = 0 THEN chr(10) ELSE '' END), chr(10), sep) AS content
    FROM ({BASE_SQL}) b"""


def _run(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    sql = sql.replace("{", "{{").replace("}", "}}")
    for name in tables:
        sql = sql.replace(f"FROM {name}", f"FROM {{{name}}}")
    return spark.sql(sql, **tables)


def _orders(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate")


def code_files(spark: SparkSession, folder: str) -> DataFrame:
    """One source file per order: path, project, lang, ts, content."""
    return files_of(_orders(spark, folder))


def order_parts(spark: SparkSession, folder: str, files: int) -> Iterator[DataFrame]:
    """The orders in parts of about ``files`` rows, for ``files_of``; rows of one path lie in one part.

    They are written once, by part, so that taking all parts reads every order twice, however many there are.
    """
    orders = _orders(spark, folder)
    n = -(-orders.count() // files)
    if n <= 1:
        yield orders
        return
    target = f"{cluster.own_folder(spark)}/{uuid.uuid4().hex}"
    orders.withColumn("part", F.pmod(F.xxhash64("o_orderkey"), F.lit(n))).repartition("part").write.partitionBy("part").parquet(target)
    written = spark.read.schema(orders.schema.add("part", "long")).parquet(target)
    for k in range(n):
        yield written.where(F.col("part") == k).drop("part")


def files_of(orders: DataFrame) -> DataFrame:
    """One source file per order, dealt out by their number.

    A file costs far more than the few bytes of its order, so the splits of the table say nothing about
    the work: there are few of them, and those without the middle of a row group are empty.
    """
    spark = orders.sparkSession
    orders = orders.repartition(max(spark.sparkContext.defaultParallelism, -(-orders.count() // FILES_PER_TASK)))
    sql = files_sql("transform(sequence(1, {n}), i -> {body})", "array_join({array}, chr(10))", _spark_snippet_sql())
    return _run(spark, sql, orders=orders)


def texts(spark: SparkSession, folder: str, table: str, name: str, text: str) -> DataFrame:
    """(name, content) view of a table with a text column."""
    df = spark.read.parquet(f"{folder}/{table}.parquet").select(F.col(name).alias("name"), F.col(text).alias("content"))
    n = spark.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


# --- scan history from events ----------------------------------------------------------
EVENT_FINDINGS_SQL = """
    SELECT concat('s', CAST(user_id AS STRING), '_', CAST(CAST(ts AS DATE) AS STRING)) AS scan_id,
           CAST(user_id AS STRING) AS project, CAST(ts AS DATE) AS day, ts, event_id,
           CASE event_type WHEN 'error' THEN 'A03_Injection' WHEN 'click' THEN 'A01_Broken_Access_Control'
                WHEN 'view' THEN 'A02_Cryptographic_Failures' WHEN 'signup' THEN 'A07_Auth_Failures'
                ELSE 'A04_Insecure_Design' END AS owasp_category,
           CASE WHEN value >= 100 THEN 'Critical' WHEN value >= 50 THEN 'High' WHEN value >= 20 THEN 'Medium'
                ELSE 'Low' END AS severity,
           event_type AS type
    FROM events"""


def event_findings(spark: SparkSession, folder: str) -> DataFrame:
    events = spark.read.parquet(f"{folder}/events.parquet")
    return _run(spark, EVENT_FINDINGS_SQL, events=events)


def event_scans(spark: SparkSession, folder: str) -> DataFrame:
    """One scan per user and day; an event counts as one file."""
    return event_findings(spark, folder).groupBy("scan_id", "project").agg(
        F.min("ts").alias("ts"), F.count("*").alias("total_files"))
