"""The queries of this subpackage, with their parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Edits that a leaked passage may have, as a share of its characters.
LEAK_RATE = 0.1
#: Score from which a text counts as toxic.
TOXIC = 0.7
#: Words in a packed bin.
CAPACITY = 2048
URL_RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


#: The operators' modules.
MODULES = ("decontamination", "kneser_ney", "licenses", "pivot_topk", "near_dedup", "toxicity", "url_filter", "secrets", "packing", "language_id")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def held_out(modulus: int, remainder: int):
    """Whether crc32 of the id as text leaves the remainder; a null id doesn't."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from talusgrid.llm.decontamination import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), LEAK_RATE)


def op2_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    from talusgrid.llm.kneser_ney import score, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out(7, 2).alias("held_out"))
    return score(docs, train(docs.where("not held_out")), ["doc_id", "held_out"])


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from talusgrid.llm.licenses import scan

    return scan(table(spark, sf_dir, "documents"))


def op4_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from talusgrid.llm.pivot_topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from talusgrid.llm.near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), similarity=(85, 100), width=5)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from talusgrid.llm.toxicity import score, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out(3, 1).alias("held_out"))
    labels = table(spark, sf_dir, "labels").where(~held_out(3, 1))
    scored = score(docs, train(docs.where("not held_out"), labels), ["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= TOXIC).cast("int"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from talusgrid.llm.url_filter import judge

    return judge(table(spark, sf_dir, "pages"), URL_RULES)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from talusgrid.llm.secrets import scan

    return scan(table(spark, sf_dir, "documents"))


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from talusgrid.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), CAPACITY)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from talusgrid.llm.language_id import predict, train

    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out(5, 0)).select("doc_id", "text", "lang", "held_out")
    return predict(docs, train(docs.where("not held_out")), ["doc_id", "held_out"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontaminate, op2_kneser_ney, op3_license_scan, op4_pivot_topk, op5_near_dedup, op6_toxicity, op7_url_filter, op8_secret_scan, op9_pack, op10_language_id)}


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"

ORACLE = {
    "op4_pivot_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
            FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
        )
        SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 5
    """,
    "op5_near_dedup": f"""
        WITH RECURSIVE
        w AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
        s AS (
            SELECT DISTINCT r, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 4], ' ') END AS sh
            FROM (SELECT r, ws, unnest(range(1, CASE WHEN len(ws) = 0 THEN 1 ELSE greatest(len(ws) - 4, 1) + 1 END)) AS i FROM w)
        ),
        n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
        p AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.r <> b.r GROUP BY 1, 2),
        e AS (
            SELECT p.a, p.b FROM p JOIN n x ON x.r = p.a JOIN n y ON y.r = p.b
            JOIN w a ON a.r = p.a AND a.doc_id IS NOT NULL JOIN w b ON b.r = p.b AND b.doc_id IS NOT NULL WHERE 100 * p.c >= 85 * (x.n + y.n - p.c)
            UNION SELECT a.r, b.r FROM w a JOIN w b ON a.doc_id = b.doc_id AND a.r <> b.r WHERE len(a.ws) > 0 AND len(b.ws) > 0
        ),
        r AS (SELECT r, doc_id AS o FROM w WHERE doc_id IS NOT NULL UNION SELECT e.b, r.o FROM r JOIN e ON e.a = r.r)
        SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id, coalesce(w.doc_id = m.c, true) AS kept
        FROM w LEFT JOIN n USING (r) LEFT JOIN (SELECT w.r, min(r.o) AS c FROM w JOIN r USING (r) WHERE w.doc_id IS NOT NULL GROUP BY w.r) m USING (r)
    """,
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
