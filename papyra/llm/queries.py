"""The numbered queries, each a thin use of its operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.llm import bpe, decontaminate, minhash, ngram_lm, phrases, quality, reshard, secret_scan, simhash, token_files, topk, toxicity, vector_codes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def llm_query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@llm_query("op1_minhash")
def op1(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


TOP_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS vec FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.vec, c.vec) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.vec) = len(c.vec) WHERE q.vec_id % 100 = 0
), r AS (
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""


@llm_query("op2_top_products", TOP_SQL)
def op2(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_products(vectors, vectors.filter("vec_id % 100 = 0"))


@llm_query("op7_benchmark_passages")
def op7(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SHARDS = 24


@llm_query("op8_reshard")
def op8(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    # the old layout has a shard for each hash of the source, so a large source is a large shard
    old = F.pmod(F.crc32(F.coalesce("source", F.lit(""))), F.lit(SHARDS)).cast("int")
    rows = reshard.read_shards(spark, reshard.reshard(docs, old, SHARDS))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + reshard.OVERHEAD
    crc = F.crc32(F.coalesce("text", F.lit("")))
    return rows.select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


END_ID = 1


@llm_query("op10_token_files")
def op10(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return token_files.check_token_files(token_files.write_token_files(docs, vocabulary("word_bpe_49k.json"), END_ID))


def fold(modulus: int, held: int):
    """Whether an id lies outside the held-out fold of its checksum."""
    return lambda key: F.coalesce(F.crc32(key.cast("string")) % modulus != held, F.lit(False))


def with_fold(scored: DataFrame, modulus: int, held: int) -> DataFrame:
    return scored.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == held, F.lit(False)))


TOXIC_FOLD = fold(4, 2)


@llm_query("op3_toxicity")
def op3(spark, sf_dir):
    scored = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), TOXIC_FOLD)
    return with_fold(scored, 4, 2).select("doc_id", "held_out", "score", "predicted")


@llm_query("op9_quality")
def op9(spark, sf_dir):
    scored = quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold(5, 0))
    return with_fold(scored, 5, 0).select("doc_id", "held_out", "score", "predicted")


def splitting_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@llm_query("op4_byte_bpe")
def op4(spark, sf_dir):
    ranks = vocabulary("byte_bpe_multi_50k.tiktoken")
    both = bpe.round_trip(table(spark, sf_dir, "documents"), ranks, splitting_pattern(), carry=["doc_id"])
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def _duck_spans(rule, number: int) -> str:
    """DuckDB: spans of a rule by the stretches between its matches, which it finds in the same order."""
    pattern = rule.pattern.replace("'", "''")
    return f"""
    SELECT row, {number} AS kind, start AS s, start + len(m) AS e FROM (
        SELECT row, unnest(ms) AS m, unnest(gs) AS g,
               unnest(list_transform(ms, lambda x, i: list_sum([len(b) for b in bs[1:i]]) + coalesce(list_sum([len(y) for y in ms[1:i - 1]]), 0))) AS start
        FROM (SELECT row, regexp_extract_all(text, '{pattern}', 0) AS ms, regexp_extract_all(text, '{pattern}', {rule.group}) AS gs,
                     string_split_regex(text, '{pattern}') AS bs FROM d WHERE regexp_matches(text, '{pattern}'))
    ) WHERE len(g) >= {rule.least}"""


_NAMES = "[" + ", ".join(f"'{r.kind}'" for r in secret_scan.RULES) + "]"
SECRET_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
found AS ({" UNION ALL ".join(_duck_spans(r, i) for i, r in enumerate(secret_scan.RULES))}),
listed AS (
    SELECT row, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
           string_agg({_NAMES}[kind + 1] || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, kind) FILTER (kind < 3) AS base,
           string_agg({_NAMES}[kind + 1] || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, kind) AS spans
    FROM found GROUP BY row
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN listed USING (row)
"""


@llm_query("op6_secrets", SECRET_SQL)
def op6(spark, sf_dir):
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    count = lambda n: F.size(F.filter("spans", lambda s: s["kind"] == n)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < len(secret_scan.BASE))
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secret_scan.rendered(base, secret_scan.RULES), 256).alias("base_sha256"), secret_scan.rendered(F.col("spans"), secret_scan.RULES).alias("spans"),
    )


@llm_query("op5_ngram_lm")
def op5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scored = ngram_lm.score(docs, fold(7, 2)(F.col("doc_id")))
    return with_fold(scored, 7, 2).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


PHRASES_SQL = f"""
WITH p AS (
    SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda x: x <> '') AS w FROM (
        SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
    )
),
g AS MATERIALIZED (
    SELECT lang, k, phrase, count(*) AS f FROM (
        SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM p, range(1, 4) t(k) WHERE len(w) >= k
    ) GROUP BY lang, k, phrase
),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM g WHERE k > 1 AND f >= {phrases.LEAST}),
halves AS MATERIALIZED (
    SELECT lang, k, phrase, a, j, array_to_string(w[1:j], ' ') AS head, array_to_string(w[j + 1:], ' ') AS tail FROM c, range(1, 3) t(j) WHERE j < k
),
cuts AS (
    SELECT h.lang, h.k, h.phrase, h.a, j, l.f AS l, r.f AS r, ({phrases.SCALE}::HUGEINT * h.a * h.a) // (l.f::HUGEINT * r.f::HUGEINT) AS score
    FROM halves h JOIN g l ON l.lang = h.lang AND l.phrase = h.head JOIN g r ON r.lang = h.lang AND r.phrase = h.tail
),
least AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
held AS (
    SELECT lang, phrase, max(a) AS longer FROM (
        SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM c WHERE k = 3 UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM c WHERE k = 3
    ) GROUP BY lang, phrase
),
r AS (
    SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY s.score DESC, s.a DESC, s.phrase) AS rank, s.phrase, s.a, s.l, s.r, CAST(s.score AS BIGINT) AS score
    FROM least s LEFT JOIN held h ON s.k = 2 AND h.lang = s.lang AND h.phrase = s.phrase WHERE h.longer IS NULL OR 100 * h.longer < {phrases.COVERED} * s.a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM r JOIN (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g WHERE k = 1 GROUP BY lang) USING (lang) WHERE rank <= {phrases.TOP}
"""


@llm_query("op11_phrases", PHRASES_SQL)
def op11(spark, sf_dir):
    return phrases.collocations(table(spark, sf_dir, "documents"))


@llm_query("op12_simhash")
def op12(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def _codes_sql(parts: int, entries: int, rounds: int) -> str:
    """DuckDB: every round as a table of its own; whole numbers in doubles are exact here."""
    rounds_sql = ""
    for r in range(rounds + 1):
        rounds_sql += f""",
n{r} AS MATERIALIZED (
    SELECT x.row, x.p, min(struct_pack(d := list_inner_product(x.vec, x.vec) - 2 * list_inner_product(x.vec, c.vec) + list_inner_product(c.vec, c.vec), j := c.j)) AS best
    FROM x JOIN c{r} c ON x.p = c.p GROUP BY x.row, x.p
)"""
        if r < rounds:
            rounds_sql += f""",
m{r} AS (
    SELECT p, j, list(v ORDER BY place) AS vec FROM (
        SELECT p, j, place, floor(sum(v) / count(*)) AS v
        FROM (SELECT x.p, n.best.j AS j, unnest(x.vec) AS v, generate_subscripts(x.vec, 1) AS place FROM n{r} n JOIN x ON x.row = n.row AND x.p = n.p) GROUP BY p, j, place
    ) GROUP BY p, j
),
c{r + 1} AS MATERIALIZED (SELECT c.p, c.j, coalesce(m.vec, c.vec) AS vec FROM c{r} c LEFT JOIN m{r} m ON c.p = m.p AND c.j = m.j)"""
    return f"""
WITH k AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS row, vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS vec
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
x AS MATERIALIZED (SELECT row, p, vec[p * len(vec) // {parts} + 1 : (p + 1) * len(vec) // {parts}] AS vec FROM k, range({parts}) t(p)),
c0 AS MATERIALIZED (SELECT p, row AS j, vec FROM x WHERE row < {entries}){rounds_sql},
coded AS (
    SELECT row, string_agg(printf('%02x', CAST(best.j AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM n{rounds} GROUP BY row
),
book AS (SELECT sha256(string_agg(CAST(CAST(v AS BIGINT) AS VARCHAR), ',' ORDER BY p, j, place)) AS digest
         FROM (SELECT p, j, unnest(vec) AS v, generate_subscripts(vec, 1) AS place FROM c{rounds}))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, digest AS codebooks_sha256
FROM k JOIN coded USING (row), book
"""


@llm_query("op13_vector_codes", _codes_sql(vector_codes.PARTS, vector_codes.ENTRIES, vector_codes.ROUNDS))
def op13(spark, sf_dir):
    return vector_codes.vector_codes(table(spark, sf_dir, "embeddings"))
