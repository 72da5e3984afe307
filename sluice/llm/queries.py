"""Registered queries of the corpus operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import table
from . import ann, decontam, hard_negatives, langid, license_scan, line_dedup, minhash, mixing, quality, secret_scan, suffix_dedup, url_filter, vector_codes
from .common import documents

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql.strip()
        return fn

    return deco


@_query("op1_license_scan")
def licenses(spark, sf_dir):
    got = license_scan.scan(documents(spark, sf_dir))
    base = F.filter("detections", lambda d: d.base)
    places = F.transform(base, lambda d: d["first"])
    joined = lambda ds: F.array_join(F.array_sort(F.array_distinct(F.transform(ds, lambda d: d.label))), ",")
    return got.select(
        "doc_id", "n_words", F.size(base).cast("bigint").alias("n_base"), F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.col("detections")).alias("labels"),
        F.coalesce(F.array_max(F.transform("detections", lambda d: d.confidence)), F.lit(0.0)).alias("score"),
    )


@_query("op2_secret_scan")
def secrets(spark, sf_dir):
    out = secret_scan.scan(documents(spark, sf_dir))
    count = lambda k: F.size(F.filter("spans", lambda s: s["rank"] == k)).cast("bigint")
    base = F.filter("spans", lambda s: s["rank"] < 3)
    return out.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secret_scan.written(base), 256).alias("base_sha256"), secret_scan.written(F.col("spans")).alias("spans"),
        count(3).alias("n_random"),
    )


@_query("op3_minhash_dedup", """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * i >= 85 * (nx.n + ny.n - i)),
r AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, l.y FROM r JOIN l ON l.x = r.seen),
c AS (SELECT node, min(seen) AS c FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.c AS component_id, d.doc_id = c.c AS kept
FROM documents d JOIN c ON c.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
""")
def near_duplicates(spark, sf_dir):
    out = minhash.near_duplicates(documents(spark, sf_dir))
    ids = lambda c: minhash.original_id(F.col(c))
    return out.select(ids("id").alias("doc_id"), "n_shingles", ids("component").alias("component_id"), "kept")


@_query("op4_mix_sources", """
WITH d AS (SELECT doc_id, source, (source IS NULL) AS nul, coalesce(source, '') AS src,
    coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
    md5(coalesce(doc_id::VARCHAR, text, '')) AS key FROM documents),
s0 AS (SELECT nul, src, sum(size)::BIGINT AS source_size FROM d GROUP BY ALL),
s1 AS (SELECT *, ((row_number() OVER (ORDER BY nul, src) - 1) % 3 + 1)::BIGINT AS w FROM s0),
s2 AS (SELECT *, source_size * 3 AS cap, sum(source_size) OVER () AS a, sum(w) OVER () AS wa,
    coalesce(sum(source_size * 3) OVER o, 0) AS cb, coalesce(sum(w) OVER o, 0) AS wb FROM s1
    WINDOW o AS (ORDER BY source_size::HUGEINT * 6 / w, nul, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, cap::HUGEINT * (wa - wb) < (a - cb)::HUGEINT * w AS f FROM s2),
s4 AS (SELECT *, a - coalesce(sum(cap) FILTER (f) OVER (), 0) AS l, sum(w) FILTER (NOT f) OVER () AS wl FROM s3),
s5 AS (SELECT nul, src, source_size, CASE WHEN f THEN cap::DOUBLE ELSE (w * l)::DOUBLE / wl::DOUBLE END AS target FROM s4),
s6 AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS epochs,
    CASE WHEN source_size > 0 THEN floor(target)::BIGINT % source_size ELSE 0 END AS rest FROM s5),
p AS (SELECT doc_id, source, size, source_size, target, epochs, rest,
    coalesce(sum(size) OVER (PARTITION BY nul, src ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
    FROM d JOIN s6 USING (nul, src))
SELECT doc_id, source, size, source_size, target, epochs::BIGINT AS epochs,
    (epochs * size + least(size, greatest(0, rest - start)))::BIGINT AS taken FROM p
""")
def mix_sources(spark, sf_dir):
    return mixing.mix(documents(spark, sf_dir))


@_query("op5_nearest_neighbours", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
    list_reduce(list_transform(generate_series(1, len(q.e)), lambda i: q.e[i] * c.e[i]), lambda a, b: a + b) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
""")
def neighbours(spark, sf_dir):
    return ann.nearest(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")))


@_query("op6_suffix_dedup")
def repeats(spark, sf_dir):
    out = suffix_dedup.remove_repeats(documents(spark, sf_dir))
    return out.select(minhash.original_id(F.col("id")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


@_query("op7_language_id")
def languages(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return langid.predict(docs, langid.learned(docs)).withColumn("held_out", langid.held_out()).select("doc_id", "held_out", "lang_pred", "score")


@_query("op8_decontaminate")
def contamination(spark, sf_dir):
    """The contaminated documents, each with its best item and score."""
    found = decontam.judge(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return found.where("contaminated").drop("contaminated")


@_query("op9_url_filter")
def url_verdicts(spark, sf_dir):
    bad = F.greatest(F.coalesce("toxic", F.lit(0)), 1 - F.coalesce("quality", F.lit(1)))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"), bad.alias("bad"))
    return url_filter.judge(table(spark, sf_dir, "pages"), labels)


_KEY = "translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@_query("op10_line_dedup", f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
x AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM d),
k AS (SELECT *, {_KEY} AS key FROM x),
f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key)
SELECT k.doc_id, count(*) AS n_lines, count(*) FILTER (k.doc_id > f.first) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (f.first IS NULL OR k.doc_id <= f.first), '')) AS kept_sha256
FROM k LEFT JOIN f USING (key) GROUP BY k.doc_id
""")
def lines(spark, sf_dir):
    out = line_dedup.drop_lines(documents(spark, sf_dir))
    return out.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def _codes_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """Assignment and averaging written out round by round; a distance and its
    index are compared as one number, distance * entries + index."""
    nearest = """SELECT p.vec_id, p.part, min(list_sum(list_transform(generate_series(1, len(p.x)), lambda i: (p.x[i] - b.x[i]) * (p.x[i] - b.x[i])))::BIGINT * {k} + b.k) AS m
    FROM p JOIN {book} b USING (part) GROUP BY ALL"""
    steps = [f"""v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
             f"p AS (SELECT vec_id, part, e[part * (len(e) // {parts}) + 1 : (part + 1) * (len(e) // {parts})] AS x FROM v, generate_series(0, {parts - 1}) g(part))",
             f"b0 AS (SELECT part, dense_rank() OVER (ORDER BY vec_id) - 1 AS k, x FROM p WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT {entries}))"]
    for r in range(rounds):
        steps += [f"a{r} AS ({nearest.format(k=entries, book=f'b{r}')})",
                  f"""u{r} AS (SELECT part, k, list(m ORDER BY i) AS x FROM (SELECT part, a.m % {entries} AS k, i, floor(sum(p.x[i])::DOUBLE / count(*))::BIGINT AS m
    FROM a{r} a JOIN p USING (vec_id, part), unnest(generate_series(1, len(p.x))) g(i) GROUP BY ALL) GROUP BY ALL)""",
                  f"b{r + 1} AS (SELECT b.part, b.k, coalesce(u.x, b.x) AS x FROM b{r} b LEFT JOIN u{r} u USING (part, k))"]
    last = f"a{rounds} AS ({nearest.format(k=entries, book=f'b{rounds}')})"
    steps += [last, f"""c AS (SELECT vec_id, string_agg(printf('%02x', m % {entries}), '' ORDER BY part) AS code, sum(m // {entries})::BIGINT AS error FROM a{rounds} GROUP BY ALL)""",
              f"d AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, k)) AS s FROM b{rounds})"]
    return "WITH " + ",\n".join(steps) + """
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, d.s AS codebooks_sha256 FROM c JOIN v USING (vec_id), d"""


@_query("op11_vector_codes", _codes_sql())
def vector_codebooks(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("v"))
    return vector_codes.compress(rows).select(F.col("id").alias("vec_id"), "code", "error", "label_error", "codebooks_sha256")


@_query("op12_quality_rules")
def qualities(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return quality.judge(docs, quality.train(docs, table(spark, sf_dir, "labels")))


@_query("op13_hard_negatives", """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.e, c.e)::BIGINT AS s FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, s AS ps FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY s DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, vec_id AS negative_id, ps AS positive_score, s AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * ps <= 100 * s AND 100 * s <= 90 * ps
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s DESC, vec_id) QUALIFY row_number() OVER w <= 10
""")
def negatives(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), label.alias("label"), F.col("embedding").alias("v"))
    return hard_negatives.mine(rows)
