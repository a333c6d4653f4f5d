"""The operators over their tables, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capsieve.llm import audit, exact_dedup, idfiles, jaccard, language, packing, pieces, private, quality, shallot, substring, topk, toxicity
from capsieve.llm.tables import held_out, prepare, table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents").select("doc_id", "text", "lang")
    return quality.classify(docs, table(spark, sf_dir, "labels").where("quality = 1"))


def op3_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents").select("doc_id", "text")
    found = private.detect(docs).withColumn("base", F.filter("found", lambda s: s["base"]))

    def number(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = map(number, private.KINDS)
    digest = F.sha2(private.spell(F.col("base")), 256).alias("base_sha256")
    return found.select("doc_id", *counts, digest, private.spell(F.col("found")).alias("spans"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents").select("doc_id", "text")
    found = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(prepare(spark), sf_dir, "documents"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents").select("doc_id", "text", "lang")
    found = language.identify(docs.select("doc_id", "text"), language.train(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(prepare(spark), sf_dir, "embeddings").select("vec_id", topk.quantised(F.col("embedding")).alias("vector"))
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"))


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.remove_repeats(table(prepare(spark), sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(prepare(spark), sf_dir, "documents").select("doc_id", "text"))


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(prepare(spark), sf_dir, "documents").select("doc_id", "text")
    found = pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    sha = lambda c: F.sha2(F.col(c), 256).alias(f"{c}_sha256")
    return found.select("doc_id", "n_tokens", sha("ids"), sha("decoded"))


def op11_shallot(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(prepare(spark), sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return shallot.cluster(vectors)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents").select("doc_id", "text", "source")
    return audit.audit(docs, table(spark, sf_dir, "labels"))


def op13_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(prepare(spark), sf_dir, "documents").select("doc_id", "text")
    return idfiles.token_files(docs, public_tokenizers.path("word_bpe_49k.json"))


def rounds_sql(k: int = 40, rounds: int = 5, size: int = 64, seed: str = "2") -> str:
    """The rounds of op11 one after the other, each comparing all vectors with all centroids."""
    parts = [
        f"""v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
            WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
        )""",
        f"""c0 AS (
            SELECT row_number() OVER (ORDER BY h, q) - 1 AS j, q FROM (
                SELECT sha256('{seed}:' || vec_id) AS h, q FROM v WHERE vec_id IS NOT NULL ORDER BY h, q LIMIT {k}
            )
        )""",
    ]
    for r in range(rounds + 1):
        parts.append(
            f"""d{r} AS (
            SELECT vec_id, v.q, j, CAST(list_sum(list_transform(list_zip(v.q, c{r}.q), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d
            FROM v, c{r}
        ), a{r} AS (SELECT vec_id, q, CAST(min(d * 1000 + j) AS BIGINT) AS m FROM d{r} GROUP BY vec_id, q)"""
        )
        if r < rounds:
            parts.append(
                f"""s{r} AS (
            SELECT m % 1000 AS j, pos, CAST(floor(CAST(sum(x) AS DOUBLE) / count(*)) AS BIGINT) AS x
            FROM (SELECT m, unnest(q) AS x, unnest(range(1, {size + 1})) AS pos FROM a{r}) GROUP BY 1, 2
        ), c{r + 1} AS (
            SELECT j, coalesce(n.q, o.q) AS q FROM c{r} o LEFT JOIN (SELECT j, list(x ORDER BY pos) AS q FROM s{r} GROUP BY j) n USING (j)
        )"""
            )
    return f"""
        WITH {", ".join(parts)}
        SELECT vec_id, CAST(j AS INTEGER) AS cluster, m // 1000 AS distance,
               CAST(sum(m // 1000) OVER (PARTITION BY j) AS BIGINT) AS cluster_inertia, CAST(sum(m // 1000) OVER () AS BIGINT) AS inertia,
               sha256(array_to_string(c.q, ',')) AS centroid_sha256
        FROM a{rounds} a JOIN c{rounds} c ON c.j = a.m % 1000
    """


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_quality": op2_quality,
    "op3_private": op3_private,
    "op4_toxicity": op4_toxicity,
    "op5_packing": op5_packing,
    "op6_language": op6_language,
    "op7_topk": op7_topk,
    "op8_substring": op8_substring,
    "op9_jaccard": op9_jaccard,
    "op10_pieces": op10_pieces,
    "op11_shallot": op11_shallot,
    "op12_filter_audit": op12_filter_audit,
    "op13_id_files": op13_id_files,
}

ORACLE = {
    "op1_exact_dedup": """
        WITH n AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
            FROM documents
        ), g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM n JOIN g USING (norm)
    """,
    "op7_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
        ), s AS (
            SELECT a.vec_id AS query_id, b.vec_id,
                   CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
        ), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM s)
        SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM r WHERE place <= 5
    """,
    "op8_substring": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        p AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
        s AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS k FROM p),
        m AS (SELECT k, min(doc_id) AS least FROM s GROUP BY k),
        g AS (SELECT doc_id, i FROM s JOIN m USING (k) WHERE least < doc_id),
        c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM g),
        l AS (SELECT doc_id, list(j) AS gone FROM c GROUP BY doc_id),
        f AS (SELECT doc_id, w, coalesce(gone, []) AS gone FROM d LEFT JOIN l USING (doc_id))
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed,
               sha256(coalesce(array_to_string(list_filter(w, lambda x, i: NOT list_contains(gone, i)), ' '), '')) AS kept_sha256
        FROM f
    """,
    "op9_jaccard": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x20\x09-\x0D]+') AS w FROM documents
        ), s AS (
            SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
                                WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM d
        ), u AS (SELECT doc_id, len(g) AS n, unnest(g) AS k FROM s),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c, any_value(a.n) AS nx, any_value(b.n) AS ny
              FROM u a JOIN u b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        l AS (SELECT x, y FROM p WHERE 100 * c >= 80 * (nx + ny - c)),
        r AS (SELECT doc_id, doc_id AS node FROM s UNION SELECT r.doc_id, l.y FROM r JOIN l ON r.node = l.x),
        q AS (SELECT doc_id, min(node) AS component_id FROM r GROUP BY doc_id)
        SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, component_id FROM s JOIN q USING (doc_id)
    """,
    "op11_shallot": rounds_sql(),
    "op12_filter_audit": r"""
        WITH d AS (
            SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
                   regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), m AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
        l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
        f AS (
            SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                   (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
                   + 4 * (100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 2 * length(t))::INT
                   + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first, false)::INT AS bits
            FROM d JOIN m USING (t) LEFT JOIN l USING (doc_id)
        ), h AS (SELECT part, bits, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
        x AS (SELECT unnest(range(5)) AS i),
        o AS (
            SELECT [a.i, b.i, c.i, d.i, e.i] AS p FROM x a, x b, x c, x d, x e
            WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
        ), s AS (
            SELECT array_to_string(list_transform(p, lambda i: substr('ABCDE', i + 1, 1)), '') AS filter_order, unnest(range(1, 6)) AS step, p FROM o
        ), b AS (
            SELECT filter_order, step, p[step] AS i, coalesce(list_sum(list_transform(p[1:step - 1], lambda i: 1 << i)), 0)::BIGINT AS before FROM s
        ), r AS (
            SELECT part, filter_order, step, i,
                   sum(CASE WHEN bits & (before | (1 << i)) = 0 THEN n ELSE 0 END) AS kept,
                   sum(CASE WHEN bits & before = 0 AND bits >> i & 1 = 1 THEN n ELSE 0 END) AS removed,
                   sum(CASE WHEN bits & before <> 0 AND bits >> i & 1 = 1 THEN n ELSE 0 END) AS redundant,
                   sum(CASE WHEN bits = 1 << i THEN n ELSE 0 END) AS unique_fails,
                   sum(CASE WHEN bits & before = 0 AND bits >> i & 1 = 1 THEN good ELSE 0 END) AS good_lost,
                   sum(CASE WHEN bits & before = 0 AND bits >> i & 1 = 1 THEN toxic ELSE 0 END) AS toxic_lost
            FROM h, b GROUP BY ALL
        )
        SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
               CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
               CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, i) AS BIGINT) AS shapley
        FROM r
    """,
}
