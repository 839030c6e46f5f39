"""Registered queries of this package and the same in SQL where it can be expressed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanframe.llm import (
    bpe, centroids, chat, embedding_dedup, filter_audit, fingerprints, line_dedup, minhash, mixing, quality_rules, sharding, toxicity,
    url_filter)
from scanframe.llm.common import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_pages(table(spark, sf_dir, "pages"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one whose texts look like the control strings of templates."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return chat.chat_report(turns.unionByName(odd))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    like = minhash.Likeness(words=3, percent=85, rows=6)
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), like)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_report(table(spark, sf_dir, "documents"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(table(spark, sf_dir, "embeddings"))


def _rounds_sql(k: int = 8, rounds: int = 10) -> str:
    """Lloyd rounds as one table expression each; vectors and centroids as lists of whole numbers."""
    nearest = """
        near{r} AS MATERIALIZED (
            SELECT row_id, (min(struct_pack(d := d, c := cluster))).c AS cluster, min(d) AS d FROM (
                SELECT v.row_id, c.cluster, list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))::HUGEINT AS d
                FROM vectors v, round{r} c) p GROUP BY row_id),"""
    move = """
        sums{r} AS MATERIALIZED (
            SELECT cluster, i, sum(v.x[i])::HUGEINT AS s, count(*) AS n FROM vectors v JOIN near{r} USING (row_id), range(1, 65) t(i) GROUP BY cluster, i),
        mean{r} AS MATERIALIZED (
            SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS x FROM sums{r} GROUP BY cluster),
        round{q} AS MATERIALIZED (SELECT c.cluster, coalesce(m.x, c.x) AS x FROM round{r} c LEFT JOIN mean{r} m USING (cluster)),"""
    steps = "".join(nearest.format(r=r) + move.format(r=r, q=r + 1) for r in range(rounds)) + nearest.format(r=rounds)
    return f"""
        WITH vectors AS MATERIALIZED (
            SELECT row_number() OVER () AS row_id, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x
            FROM embeddings WHERE len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
        round0 AS MATERIALIZED (
            SELECT (row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1)::INTEGER AS cluster, x
            FROM vectors ORDER BY sha256('3:' || vec_id) LIMIT {k}),{steps}
        last AS (SELECT cluster, sha256(array_to_string(x, ',')) AS centroid_sha256 FROM round{rounds})
        SELECT v.vec_id, n.cluster, n.d::BIGINT AS distance, (sum(n.d) OVER (PARTITION BY n.cluster))::BIGINT AS cluster_inertia,
            (sum(n.d) OVER ())::BIGINT AS inertia, l.centroid_sha256
        FROM vectors v JOIN near{rounds} n USING (row_id) JOIN last l ON l.cluster = n.cluster
    """


QUERIES = {f.__name__: f for f in (
    op1_line_dedup, op2_sharding, op3_mixing, op4_embedding_dedup, op5_fingerprints, op6_url_filter, op7_chat, op8_minhash,
    op9_toxicity, op10_bpe, op11_filter_audit, op12_quality_rules, op13_centroids)}

ORACLES = {
    "op1_line_dedup": """
        WITH lines AS (
            SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
            FROM documents WHERE text IS NOT NULL),
        windows AS (
            SELECT doc_id, pos, line AS a, lead(line, 1) OVER w AS b, lead(line, 2) OVER w AS c
            FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
        ranked AS (
            SELECT doc_id, pos, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS place
            FROM windows WHERE c IS NOT NULL AND trim(a || b || c, ' ') <> ''),
        covered AS (
            SELECT DISTINCT doc_id, pos + k AS pos FROM ranked, (VALUES (0), (1), (2)) v(k) WHERE place > 1),
        kept AS (
            SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (c.pos IS NULL) AS text,
                count(*) AS n_lines, count(c.pos) AS n_removed
            FROM lines l LEFT JOIN covered c ON l.doc_id = c.doc_id AND l.pos = c.pos GROUP BY l.doc_id)
        SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
            coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed
        FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
    """,
    "op4_embedding_dedup": """
        WITH RECURSIVE vectors AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL
                AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
                AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
        links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a JOIN vectors b ON a.label = b.label AND a.vec_id <> b.vec_id
                AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
        reach AS (SELECT vec_id, vec_id AS seen FROM embeddings UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.seen = l.a),
        least AS (SELECT vec_id, min(seen) AS component_id FROM reach GROUP BY vec_id),
        counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
        SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
        FROM least LEFT JOIN counts ON a = vec_id
    """,
    "op8_minhash": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, list_filter(string_split_regex(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
            FROM documents WHERE text IS NOT NULL),
        shingles AS (
            SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 2), ' ') AS s
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM words WHERE len(w) > 0) x),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        shared AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
            GROUP BY ALL),
        links AS (
            SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
            WHERE 100 * common >= 85 * (x.n + y.n - common)),
        reach AS (SELECT doc_id, doc_id AS seen FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.seen = l.a),
        least AS (SELECT doc_id, min(seen) AS component_id FROM reach GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
        FROM documents d JOIN least l ON l.doc_id = d.doc_id LEFT JOIN sizes z ON z.doc_id = d.doc_id
    """,
    "op7_chat": r"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        marked AS (
            SELECT *, regexp_replace(text, '([<\[])(\\*)(\||/?s>|/?INST\]|/?SYS>>)', '\1\\\2\3', 'g') AS escaped,
                regexp_replace(role, '([<\[])(\\*)(\||/?s>|/?INST\]|/?SYS>>)', '\1\\\2\3', 'g') AS escaped_role
            FROM turns)
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            sum(length(escaped) + length(escaped_role) + length('<|turn|><|says|><|end|>'))::BIGINT AS formatted_chars,
            0::BIGINT AS expanded_tokens
        FROM marked GROUP BY conv_id
    """,
    "op11_filter_audit": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
                list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
            FROM documents),
        known AS (
            SELECT doc_id, max((quality = 1)::INTEGER) AS good, max((toxic = 1)::INTEGER) AS toxic FROM labels GROUP BY doc_id),
        failed AS (
            SELECT doc_id, part, (len(w) < 200)::INTEGER + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INTEGER
                + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::INTEGER
                + 8 * regexp_matches(t, '[#$%&*|]')::INTEGER
                + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INTEGER AS mask
            FROM words),
        masks AS (
            SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
            FROM failed LEFT JOIN known USING (doc_id) GROUP BY part, mask),
        orders AS (
            SELECT '' AS o UNION ALL SELECT o || f FROM orders, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(f)
            WHERE length(o) < 5 AND position(f IN o) = 0),
        steps AS (
            SELECT o AS filter_order, s::INTEGER AS step, o[s] AS f, (1 << (ascii(o[s]) - 65))::INTEGER AS own,
                list_sum([0] || list_transform(range(1, s), lambda i: 1 << (ascii(o[i]) - 65)))::INTEGER AS before
            FROM orders, range(1, 6) t(s) WHERE length(o) = 5),
        counted AS (
            SELECT part, filter_order, step, f,
                coalesce(sum(n) FILTER (mask & (before | own) = 0), 0) AS kept,
                coalesce(sum(n) FILTER (mask & before = 0 AND mask & own > 0), 0) AS removed,
                coalesce(sum(n) FILTER (mask & before > 0 AND mask & own > 0), 0) AS redundant,
                coalesce(sum(n) FILTER (mask = own), 0) AS unique_fails,
                coalesce(sum(good) FILTER (mask & before = 0 AND mask & own > 0), 0) AS good_lost,
                coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & own > 0), 0) AS toxic_lost
            FROM masks, steps GROUP BY part, filter_order, step, f)
        SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
            unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
            (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
        FROM counted
    """,
    "op12_quality_rules": r"""
        WITH texts AS MATERIALIZED (
            SELECT row_number() OVER () AS row_id, doc_id, coalesce(lang, '') AS lang, text IS NOT NULL AS has, coalesce(text, '') AS t,
                list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
            FROM documents),
        windows AS (
            SELECT row_id, i, struct_pack(a := w[i], b := w[i + 1], c := w[i + 2], d := w[i + 3], e := w[i + 4]) AS v
            FROM (SELECT row_id, w, unnest(range(1, len(w) - 3)) AS i FROM texts WHERE len(w) > 4) x),
        hits AS (SELECT row_id, i, lead(i) OVER (PARTITION BY row_id ORDER BY i) AS later FROM (
            SELECT row_id, i, count(*) OVER (PARTITION BY row_id, v) AS n FROM windows) x WHERE n > 1),
        repeats AS (SELECT row_id, sum(least(coalesce(later - i, 5), 5)) AS n FROM hits GROUP BY row_id),
        lines AS (
            SELECT row_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM texts),
        base AS MATERIALIZED (
            SELECT row_id, doc_id, lang, has, t, w, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
                length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
                coalesce(n, 0)::BIGINT AS n_repeat_words
            FROM texts JOIN lines USING (row_id) LEFT JOIN repeats USING (row_id)),
        counted AS (
            SELECT row_id, lang, has, n_words, length(t) - word_chars AS space, length(t) AS chars,
                length(regexp_replace(t, '[^A-Z]', '', 'g')) AS c1, length(regexp_replace(t, '[^0-9]', '', 'g')) AS c2,
                length(regexp_replace(t, '[^.,;:!?''"()\-]', '', 'g')) AS c3,
                length(regexp_replace(t, '[^\x{00C0}-\x{024F}]', '', 'g')) AS c4,
                length(regexp_replace(t, '[^\x00-\x08\x0E-\x1F\x7F#$%&*+/<=>@\[\\\]^_`{|}~]', '', 'g')) AS c5,
                length(regexp_replace(t, '[\x00-\x7F\x{00C0}-\x{024F}]', '', 'g')) AS c6
            FROM base),
        shaped AS MATERIALIZED (
            SELECT row_id, lang, has, n_words, chars, unnest([1, 2, 3, 4, 5, 6, 7, 8]) AS class,
                unnest([c1, c2, c3, c4, c5, c6, space, chars - space - c1 - c2 - c3 - c4 - c5 - c6]) AS n
            FROM counted),
        languages AS (
            SELECT lang, sum(n_words) AS words FROM base WHERE has GROUP BY lang
            QUALIFY words >= 1000 AND words >= 1e-4 * sum(words) OVER ()),
        class_shares AS (
            SELECT lang, class, sum(n) / sum(sum(n)) OVER (PARTITION BY lang) AS q FROM shaped WHERE has GROUP BY lang, class),
        class_parts AS (
            SELECT row_id, n / chars AS p, q FROM shaped JOIN class_shares USING (lang, class) SEMI JOIN languages USING (lang) WHERE chars > 0),
        occurrences AS MATERIALIZED (
            SELECT row_id, lang, word, count(*) AS n FROM (SELECT row_id, lang, unnest(w) AS word FROM base) x GROUP BY row_id, lang, word),
        frequent AS (
            SELECT lang, word, n / words AS q FROM (
                SELECT lang, word, sum(n) AS n FROM occurrences GROUP BY lang, word) x JOIN languages USING (lang)
            QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) <= 64),
        word_parts AS (
            SELECT b.row_id, coalesce(o.n, 0) / n_words AS p, q FROM base b JOIN frequent f USING (lang)
            LEFT JOIN occurrences o ON o.row_id = b.row_id AND o.word = f.word WHERE n_words > 0),
        with_rest AS (
            SELECT row_id, p, q FROM word_parts
            UNION ALL SELECT row_id, 1 - sum(p), 1 - sum(q) FROM word_parts GROUP BY row_id),
        far AS (
            SELECT kind, row_id, sqrt(greatest(sum(
                CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) / 2 ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) / 2 ELSE 0 END), 0)) AS d
            FROM (SELECT 'class' AS kind, * FROM class_parts UNION ALL SELECT 'word', * FROM with_rest) x GROUP BY kind, row_id),
        judged AS (
            SELECT b.*, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
                coalesce(n_words >= 60 AND c.d > 0.32, false) OR coalesce(n_words >= 100 AND w.d > 0.38, false) AS strange
            FROM base b LEFT JOIN far c ON c.row_id = b.row_id AND c.kind = 'class' LEFT JOIN far w ON w.row_id = b.row_id AND w.kind = 'word')
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT strange AS kept
        FROM judged
    """,
    "op13_centroids": _rounds_sql(),
}
