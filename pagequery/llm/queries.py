"""The queries of this subpackage: thin layers that run an operator over its whole table and return digests of its output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import read


def fold(n: int, k: int):
    """Whether an id belongs to the k-th of n folds; a null id belongs to none."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n)) == k, F.lit(False))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(read(spark, sf_dir, "documents"), capacity=4096, end_id=1)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import learn, score

    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    held_out = fold(5, 0)
    lexicon = learn(docs, labels.where(~held_out))
    return score(docs, lexicon).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_hits", "terms")


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_score import fit, score

    docs = read(spark, sf_dir, "documents")
    held_out = fold(5, 1)
    model, counts = fit(docs.where(~held_out))
    scored = score(docs, model, counts)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    placed = shard(read(spark, sf_dir, "documents"), shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import repeated_spans

    found = repeated_spans(read(spark, sf_dir, "documents"), length=200)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import fit, identify

    docs = read(spark, sf_dir, "documents")
    held_out = fold(4, 2)
    model = fit(docs.where(~held_out))
    return identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "entropy", "rejected")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(read(spark, sf_dir, "documents"), keep="max")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import decontaminate

    return contamination(decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), window=13))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import read_records, write

    uri, index = write(read(spark, sf_dir, "pages"), least=1000)
    back = read_records(uri, index)
    return back.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), "refers_to")


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_components

    return jaccard_components(read(spark, sf_dir, "documents"), k=5, num=80, den=100).select("doc_id", "n_shingles", "component_id", "n_links")


def contamination(hits: DataFrame) -> DataFrame:
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    return hits.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256")).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    )


QUERIES = {f.__name__: f for f in (op1_packing, op2_toxicity, op3_lm_score, op4_sharding, op5_suffix_dedup, op6_language_id, op7_exact_dedup, op8_decontaminate, op9_warc, op10_jaccard)}

ORACLES = {
    "op7_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS n FROM d GROUP BY t)
        SELECT d.doc_id, g.keep_id, g.n AS group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
        FROM d JOIN g ON d.t = g.t""",
    "op9_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
        g AS (SELECT t, max(page_id) AS m FROM p WHERE strlen(t) >= 1000 GROUP BY t)
        SELECT page_id, strlen(p.t)::bigint AS payload_bytes, sha1(p.t) AS payload_digest,
          CASE WHEN m > page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN m > page_id THEN m END AS refers_to
        FROM p LEFT JOIN g ON p.t = g.t""",
    "op8_decontaminate": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        s AS (SELECT DISTINCT least(13, len(w)) AS n FROM b WHERE len(w) > 0),
        bw AS (SELECT DISTINCT item_id, n, list_slice(w, i, i + n - 1) AS g FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
        dw AS (SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, s WHERE len(w) >= n)),
        h AS (SELECT DISTINCT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
        p AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM h) GROUP BY doc_id),
        k AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::varchar AS id FROM h) GROUP BY doc_id)
        SELECT d.doc_id, len(d.w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
          coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
        FROM d LEFT JOIN p USING (doc_id) LEFT JOIN k USING (doc_id)""",
    "op5_suffix_dedup": """
        WITH n AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, ''))::bigint AS n FROM documents),
        w AS (SELECT doc_id, i, md5_number(substr(x, 2 * i + 1, 400)) AS h FROM (SELECT doc_id, x, unnest(range(0, greatest(n - 199, 0))) AS i FROM n)),
        r AS (SELECT doc_id, i FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
        g AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS fresh FROM r),
        s AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM g) GROUP BY doc_id, k),
        p AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM s),
        k AS (SELECT doc_id, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(x), 2 * max(b) + 1) AS kept, sum(b - a) AS n_removed, count(*) AS n_spans
          FROM p JOIN n USING (doc_id) GROUP BY doc_id)
        SELECT n.doc_id, n.n AS n_bytes, coalesce(n_removed, 0)::bigint AS n_removed, coalesce(n_spans, 0)::bigint AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256 FROM n LEFT JOIN k USING (doc_id)""",
    "op10_jaccard": r"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1) + 1))) AS i FROM d)),
        n AS (SELECT doc_id, count(g) AS n FROM d LEFT JOIN s USING (doc_id) GROUP BY doc_id),
        c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
        l AS MATERIALIZED (SELECT a, b, c = na.n AND c = nb.n AS same FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
        r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
        k AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
        e AS (SELECT d.doc_id, least(d.doc_id, coalesce(min(b), d.doc_id)) AS class FROM d LEFT JOIN l ON l.a = d.doc_id AND same GROUP BY d.doc_id),
        m AS (SELECT l.a, count(DISTINCT e.class) AS n_links FROM l JOIN e ON e.doc_id = l.b WHERE NOT same GROUP BY l.a)
        SELECT n.doc_id, n.n::bigint AS n_shingles, k.component_id, coalesce(m.n_links, 0)::bigint AS n_links FROM n JOIN k ON k.a = n.doc_id LEFT JOIN m ON m.a = n.doc_id""",
}
