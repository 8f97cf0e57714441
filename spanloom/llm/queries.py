"""Named queries of this subpackage: one for each operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import chat, decontaminate, exact_dup, filter_audit, html_text, jaccard_join, mixing, near_dup, periodic_runs, secrets, sharding, tokens, toxicity

TOKENIZER = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that the mix takes: its size times its draws, told as epoch:shard:place in the shard's shuffle."""

    def _draw(d):
        key = F.xxhash64(F.lit(mixing.SEED), d["shard"], d["epoch"], F.col("doc_id"))
        return F.concat_ws(":", d["epoch"].cast("string"), d["shard"].cast("string"), key.cast("string"))

    drawn = mixing.with_draws(table(spark, sf_dir, "documents"))
    return drawn.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"), F.array_join(F.transform("draws", _draw), ",").alias("draws"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"), found=False)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents"), 40, sharding.map_folder(spark, sf_dir))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), per_cent=85)


def op6_exact_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dup.exact_duplicates(table(spark, sf_dir, "documents"))


def op7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.neighbour_pairs(table(spark, sf_dir, "conversations"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), per_cent=80)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.periodic_runs(table(spark, sf_dir, "documents"), periodic_runs.planted_order)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_mixing, op2_secrets, op3_sharding, op4_decontaminate, op5_near_dup, op6_exact_dup, op7_tokens, op8_html, op9_toxicity, op10_chat, op11_filter_audit, op12_jaccard_join, op13_periodic_runs)
}

#: All pairs that share a shingle, then everything reachable: right on tables of some thousand documents.
_LINKED_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {per_cent} * (x.n + y.n - c)),
e2 AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, e2.b FROM r JOIN e2 ON e2.a = r.y),
c AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id{more} FROM c LEFT JOIN n USING (doc_id)
"""
NEAR_DUP_SQL = _LINKED_SQL.format(per_cent=85, more=", doc_id = component_id AS kept")

ORACLE_SQL: dict[str, str] = {"op5_near_dup": NEAR_DUP_SQL, "op6_exact_dup": exact_dup.ORACLE, "op10_chat": chat.ORACLE, "op11_filter_audit": filter_audit.ORACLE, "op12_jaccard_join": _LINKED_SQL.format(per_cent=80, more=""), "op13_periodic_runs": periodic_runs.ORACLE}
