"""Derived views over the driver's tables: the shapes of an annotated corpus and of scored models, each as a DataFrame and as SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Tables:
    """Lazy views of one directory."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def load(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.load(name)

    @property
    def chunk_mentions(self) -> DataFrame:
        """One row per mention candidate, flat, with the four evidence scores."""
        return self.load("lineitem").select(
            F.col("l_orderkey").alias("chunk_id"), F.col("l_linenumber").alias("mention_pos"), F.concat(F.lit("Q"), "l_partkey").alias("qid"),
            F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("hyperlinks"), (F.col("l_quantity") / 50).alias("entity_linking"),
            (F.col("l_discount") * 10).alias("coref"), (F.col("l_tax") * 12.5).alias("coref_cluster"),
        )

    @property
    def chunks(self) -> DataFrame:
        """The nested form: one row per chunk, mentions in order, each with its candidates."""
        scores = F.struct("hyperlinks", "entity_linking", "coref", "coref_cluster")
        mention = F.struct("mention_pos", F.array(F.struct("qid", scores.alias("scores_by_source"))).alias("candidates"))
        return self.chunk_mentions.groupBy("chunk_id").agg(F.array_sort(F.collect_list(mention)).alias("entities"))

    @property
    def entity_dim(self) -> DataFrame:
        return self.load("part").select(F.concat(F.lit("Q"), "p_partkey").alias("qid"), F.col("p_name").alias("name"), F.col("p_brand").alias("family"))

    @property
    def option_scores(self) -> DataFrame:
        """Four options a question, with log-likelihoods."""
        by = Window.partitionBy("l_orderkey")
        order = by.orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
        rows = self.load("lineitem").select(
            F.col("l_orderkey").alias("question_id"), (F.row_number().over(order) - 1).alias("option_index"), F.count("*").over(by).alias("n"),
            (-F.col("l_extendedprice") / 1000).alias("logp"), F.col("l_quantity").alias("n_chars"), (-F.col("l_tax") - 1).alias("logp_null"), F.col("l_returnflag").alias("flag"),
        )
        return rows.filter("n >= 4 and option_index < 4").select("question_id", "option_index", F.expr("cast(question_id % 4 as int)").alias("gold_index"), "logp", "n_chars", (F.col("logp") / F.col("n_chars")).alias("per_char"), "logp_null", "flag")

    @property
    def paired_nll(self) -> DataFrame:
        """Three models' losses on the same items."""
        price, off, tax = F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax")
        joined = self.load("orders").join(self.load("lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
        return joined.groupBy(F.col("o_orderkey").alias("item_id"), F.col("o_orderpriority").alias("concept"), F.col("o_orderstatus").alias("item_set")).agg(
            (F.max(price) / 10000).alias("nll_full"), (F.max(price * (1 - off)) / 10000).alias("nll_twin"), (F.max(price * (1 + tax) * (1 - off / 2)) / 10000).alias("nll_edited")
        )

    @property
    def batch_schedule(self) -> DataFrame:
        return self.load("orders").select((F.year("o_orderdate") * 100 + F.month("o_orderdate")).cast("int").alias("step"), F.col("o_orderkey").alias("chunk_id"))

    @property
    def spans(self) -> DataFrame:
        return self.load("lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") * 20).cast("int").alias("span_start"), (F.col("l_linenumber") * 20 + F.col("l_quantity")).cast("int").alias("span_end"))

    @property
    def candidates(self) -> DataFrame:
        return self.load("lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") * 15).cast("int").alias("cand_start"), (F.col("l_linenumber") * 15 + 1 + F.col("l_quantity")).cast("int").alias("cand_end"), F.concat(F.lit("Q"), "l_partkey").alias("qid"))

    @property
    def entity_list(self) -> DataFrame:
        """The entity list of the exclusion queries: five entities in file order."""
        return self.spark.createDataFrame([("Q1", 0), ("Q2", 1), ("Q3", 2), ("Q5", 3), ("Q8", 4)], "qid string, pos int")

    @property
    def coordinates(self) -> DataFrame:
        """Vectors as rows (token_id, code, feature, value); code 0 neutral, 1 concept, 2 both."""
        return self.load("embeddings").select(F.col("vec_id").alias("token_id"), F.expr("cast(label % 3 as int)").alias("code"), F.posexplode("embedding").alias("feature", "value")).withColumn("value", F.col("value").cast("double"))

    @property
    def question_scores(self) -> DataFrame:
        """Accuracy and margin inputs: one row per model, group and question."""
        return self.load("lineitem").select(
            F.col("l_linestatus").alias("model"), F.col("l_returnflag").alias("question_group"),
            F.col("l_orderkey").alias("question_id"), F.expr("cast((l_linenumber + l_partkey) % 3 = 0 as int)").alias("is_correct"), (F.col("l_discount") - F.col("l_tax")).alias("gold_margin"),
        )


#: The same views as DuckDB SQL, by name.
VIEWS = {
    "chunk_mentions": """SELECT l_orderkey AS chunk_id, l_linenumber AS mention_pos, 'Q' || l_partkey AS qid,
        CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hyperlinks, l_quantity / 50 AS entity_linking, l_discount * 10 AS coref, l_tax * 12.5::DOUBLE AS coref_cluster FROM lineitem""",
    "entity_dim": "SELECT 'Q' || p_partkey AS qid, p_name AS name, p_brand AS family FROM part",
    "option_scores": """SELECT question_id, option_index, (question_id % 4)::INT AS gold_index, logp, n_chars, logp / n_chars AS per_char, logp_null, flag FROM (
        SELECT l_orderkey AS question_id, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) - 1)::INT AS option_index,
        count(*) OVER (PARTITION BY l_orderkey) AS n, -l_extendedprice / 1000 AS logp, l_quantity AS n_chars, -l_tax - 1 AS logp_null, l_returnflag AS flag FROM lineitem) WHERE n >= 4 AND option_index < 4""",
    "paired_nll": """SELECT o_orderkey AS item_id, o_orderpriority AS concept, o_orderstatus AS item_set, max(l_extendedprice) / 10000 AS nll_full,
        max(l_extendedprice * (1 - l_discount)) / 10000 AS nll_twin, max(l_extendedprice * (1 + l_tax) * (1 - l_discount / 2)) / 10000 AS nll_edited
        FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderpriority, o_orderstatus""",
    "batch_schedule": "SELECT (year(o_orderdate) * 100 + month(o_orderdate))::INT AS step, o_orderkey AS chunk_id FROM orders",
    "spans": "SELECT l_orderkey AS doc_id, (l_linenumber * 20)::INT AS span_start, (l_linenumber * 20 + l_quantity)::INT AS span_end FROM lineitem",
    "candidates": "SELECT l_orderkey AS doc_id, (l_linenumber * 15)::INT AS cand_start, (l_linenumber * 15 + 1 + l_quantity)::INT AS cand_end, 'Q' || l_partkey AS qid FROM lineitem",
    "entity_list": "SELECT * FROM (VALUES ('Q1', 0), ('Q2', 1), ('Q3', 2), ('Q5', 3), ('Q8', 4)) v(qid, pos)",
    "coordinates": "SELECT vec_id AS token_id, (label % 3)::INT AS code, (i - 1)::INT AS feature, embedding[i]::DOUBLE AS value FROM (SELECT vec_id, label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)",
    "question_scores": """SELECT l_linestatus AS model, l_returnflag AS question_group, l_orderkey AS question_id, ((l_linenumber + l_partkey) % 3 = 0)::INT AS is_correct, l_discount - l_tax AS gold_margin FROM lineitem""",
}


def sql(body: str, *views: str) -> str:
    """body over the named views."""
    body = body.lstrip(" ,\n")
    own = re.match(r"(WITH\s+)?(?=\w+ AS \()", body)
    if not views:
        return body
    return "WITH " + ", ".join(f"{v} AS ({VIEWS[v]})" for v in views) + (", " + body[own.end() :] if own else " " + body)
