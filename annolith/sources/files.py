"""Sources and sinks: JSON lines, entity lists, artifacts, CSV, key-value tables, guarded writes and reports.

Paths are Spark's: nothing here opens a file on the driver, so any store that Spark reads will do."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.annotate import DOCUMENT
from .scratch import scratch


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def rename(spark: SparkSession, source: str, target: str) -> None:
    jvm = spark.sparkContext._jvm
    a, b = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    fs = a.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(b):
        fs.delete(b, True)
    if not fs.rename(a, b):
        raise OSError(f"{source} could not be renamed to {target}")


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType = DOCUMENT) -> DataFrame:
    """JSON lines under a given schema; blank lines are skipped, broken ones an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def processed_ids(spark: SparkSession, path: str, key: str = "id") -> DataFrame:
    """Ids that a sink has already; none if it isn't there yet."""
    if not exists(spark, path):
        return spark.createDataFrame([], f"{key} string")
    return spark.read.schema(f"{key} string").json(path).select(key).filter(F.col(key).isNotNull()).distinct()


def unprocessed(docs: DataFrame, path: str, key: str = "id") -> DataFrame:
    return docs.join(processed_ids(docs.sparkSession, path, key), key, "left_anti")


def upsert_if_absent(df: DataFrame, path: str, key: str) -> int:
    """Append the rows of df whose key the Parquet table hasn't; how many there were."""
    spark = df.sparkSession
    new = df.dropDuplicates([key])
    if exists(spark, path):
        new = new.join(spark.read.parquet(path).select(key), key, "left_anti")
    new = new.cache()
    try:
        n = new.count()
        if n:
            new.write.mode("append").parquet(path)
    finally:
        new.unpersist()
    return n


def lookup(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of the given ids; missing ones are left out."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


class KeyValueTable:
    """A key-value store as a Parquet table of (key, value JSON, version): the last version of a key counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def versions(self) -> DataFrame:
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], "key string, value string, version long")
        return self.spark.read.schema("key string, value string, version long").parquet(self.path)

    def table(self) -> DataFrame:
        return self.versions().groupBy("key").agg(F.max_by("value", "version").alias("value"))

    def put_batch(self, rows: DataFrame) -> None:
        """rows: (key, value JSON)."""
        top = self.versions().agg(F.coalesce(F.max("version"), F.lit(0)).alias("v")).first()["v"]
        rows.select("key", "value", F.lit(top + 1).alias("version")).write.mode("append").parquet(self.path)

    def from_dict(self, values: dict) -> None:
        if values:
            self.put_batch(self.spark.createDataFrame([(str(k), json.dumps(v)) for k, v in values.items()], "key string, value string"))

    def put(self, key: str, value) -> None:
        self.from_dict({key: value})

    def get(self, key: str, default=None):
        row = self.versions().filter(F.col("key") == key).orderBy(F.desc("version")).limit(1).collect()
        return json.loads(row[0]["value"]) if row else default

    def contains(self, key: str) -> bool:
        return bool(self.versions().filter(F.col("key") == key).limit(1).count())

    def compact(self) -> None:
        """Rewrite the table with the last version of every key alone."""
        part = f"{self.path}.compact"
        self.table().withColumn("version", F.lit(1).cast("long")).write.mode("overwrite").parquet(part)
        rename(self.spark, part, self.path)


def entity_list(texts: DataFrame) -> DataFrame:
    """Entity lists as JSON text (column `value`) -> (qid, comment, pos). An element is an object or a bare id."""
    items = texts.select(F.posexplode(F.from_json(F.get_json_object("value", "$.entities"), "array<string>")).alias("pos", "x"))
    obj = F.from_json("x", "qid string, comment string")
    is_obj = F.col("x").startswith("{")
    rows = items.select(F.when(is_obj, obj["qid"]).otherwise(F.col("x")).alias("qid"), F.coalesce(F.when(is_obj, obj["comment"]), F.lit("")).alias("comment"), "pos")
    return rows.filter(F.coalesce("qid", F.lit("")) != "")


def load_entity_list(spark: SparkSession, path: str) -> DataFrame:
    """The entity list of a JSON file; an empty one is an error."""
    rows = entity_list(spark.read.text(path, wholetext=True))
    if not rows.limit(1).count():
        raise ValueError(f"{path} lists no entity")
    return rows


def write_artifact(hits: DataFrame, entities: DataFrame, path: str, **provenance: str) -> None:
    """(chunk_id, qid) hits of listed entities -> a JSON table with a row an entity, in list order, and its sorted chunk ids."""
    per = hits.groupBy("qid").agg(F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"))
    rows = entities.join(per, "qid", "left").withColumn("chunk_ids", F.coalesce("chunk_ids", F.array().cast("array<bigint>")))
    rows = rows.withColumn("num_chunks", F.size("chunk_ids")).withColumns({k: F.lit(v) for k, v in provenance.items()})
    replace(rows, path, "json")


def read_artifact(spark: SparkSession, path: str) -> DataFrame:
    """(chunk_id, qid): each chunk with the first entity, in list order, that has it."""
    rows = spark.read.schema("qid string, pos int, chunk_ids array<bigint>").json(path)
    return rows.select("qid", "pos", F.explode("chunk_ids").alias("chunk_id")).groupBy("chunk_id").agg(F.min_by("qid", "pos").alias("qid"))


def replace(df: DataFrame, path: str, kind: str = "parquet", **options) -> None:
    """Write beside, then put in place: readers see the old table or the new one."""
    part = f"{path}.part"
    df.write.mode("overwrite").format(kind).options(**options).save(part)
    rename(df.sparkSession, part, path)


def read_csv(spark: SparkSession, path: str, schema: str, tolerant: bool = False) -> DataFrame:
    """A CSV with a header under a given schema. tolerant: a missing file is an empty table, and broken rows are left out."""
    if tolerant and not exists(spark, path):
        return spark.createDataFrame([], schema)
    mode = "DROPMALFORMED" if tolerant else "FAILFAST"
    return spark.read.schema(schema).option("header", True).option("mode", mode).csv(path)


def write_csv(df: DataFrame, path: str, decimals: int = 10) -> None:
    """CSV with doubles in fixed decimals."""
    cells = [F.format_string(f"%.{decimals}f", F.col(f.name)).alias(f.name) if f.dataType.simpleString() in ("double", "float") else F.col(f.name) for f in df.schema]
    replace(df.select(*cells), path, "csv", header="true")


def append_row(df: DataFrame, row: dict, schema: str) -> DataFrame:
    return df.unionByName(df.sparkSession.createDataFrame([tuple(row.values())], schema), allowMissingColumns=True)


def path_keys(path: Column, pattern: str) -> dict[str, Column]:
    """A Column for each named group of a pattern over file paths."""
    return {name: F.regexp_extract(path, pattern, i) for i, name in enumerate(re.findall(r"\(\?<(\w+)>", pattern), 1)}


def discover(spark: SparkSession, glob: str, pattern: str) -> DataFrame:
    """Files that a glob finds, with the named groups of their paths; Spark lists them, their content isn't read."""
    files = spark.read.format("binaryFile").load(glob).select("path", "modificationTime", "length")
    return files.withColumns(path_keys(F.col("path"), pattern))


def strip_run_suffix(name: Column) -> Column:
    return F.regexp_replace(name, r"(_\d{5,}|_rebuild)$", "")


def scored_positions(records: DataFrame, index: DataFrame, distributions: DataFrame) -> DataFrame:
    """Records with the rows of their distributions: index (id, first, last) names the rows of (row, logp) that are theirs."""
    at = index.select("id", F.explode(F.sequence("first", F.col("last") - 1)).alias("row"), "first")
    return records.join(at, "id").join(distributions, "row").select("id", (F.col("row") - F.col("first")).alias("pos"), "logp")


def labelled_sentences(concept: DataFrame, neutral: DataFrame, seed: int, forget_share: float = 0.8, size: int = 16) -> DataFrame:
    """(sentence, label, part, batch): both sides in seeded order, split in two parts, and cut into batches."""
    from ..operators.sampling import draw, ordinals

    rows = concept.select("sentence", F.lit(1).alias("label")).unionByName(neutral.select("sentence", F.lit(0).alias("label"))).withColumn("_draw", draw(seed, "label", "sentence"))
    placed = ordinals(rows, F.col("_draw"), F.col("sentence"))
    part = F.when(F.pmod(F.xxhash64("_draw"), F.lit(1000)) < int(1000 * forget_share), "forget").otherwise("retain")
    return placed.select("sentence", "label", part.alias("part"), F.floor(F.col("ordinal") / size).alias("batch"))


def qa_items(texts: DataFrame, kind: str = "array<struct<q:string,a:string>>") -> DataFrame:
    """A JSON map of concept to <subset>_<split> to items -> one row an item; those without question or answer are left out."""
    concepts = texts.select(F.explode(F.from_json("value", f"map<string,map<string,{kind}>>")).alias("concept", "sets"))
    sets = concepts.select("concept", F.explode("sets").alias("name", "items"))
    rows = sets.select("concept", F.substring_index("name", "_", 1).alias("subset"), F.substring_index("name", "_", -1).alias("split"), F.posexplode("items").alias("ordinal", "item")).select("concept", "subset", "split", "ordinal", "item.*")
    filled = [F.coalesce(F.trim(c), F.lit("")) != "" for c in rows.columns if c in ("q", "a", "correct_answer")]
    for f in filled:
        rows = rows.filter(f)
    return rows


def markdown(df: DataFrame, most: int = 200) -> str:
    """A small table as Markdown; more rows than `most` are an error."""
    return _table(df, most, lambda cells: "| " + " | ".join(cells) + " |", lambda n: "|" + "---|" * n)


def latex(df: DataFrame, most: int = 200) -> str:
    mark = {"&": r"\&", "%": r"\%", "_": r"\_", "#": r"\#", "$": r"\$"}
    safe = lambda c: "".join(mark.get(x, x) for x in c)
    return _table(df, most, lambda cells: " & ".join(map(safe, cells)) + r" \\", lambda n: r"\midrule")


def _table(df, most, line, rule) -> str:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report holds at most {most} rows")
    cell = lambda x: "" if x is None else f"{x:.4f}" if isinstance(x, float) else str(x)
    return "\n".join([line(df.columns), rule(len(df.columns)), *[line([cell(x) for x in r]) for r in rows]])


def select_items(items: DataFrame, wanted: DataFrame, key: str = "idx", choices: str = "choices") -> DataFrame:
    """Items of the wanted indices that have exactly four choices."""
    return items.join(wanted.select(key).distinct(), key, "left_semi").filter(F.size(choices) == 4)


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """(label, path, topic, method) of the folders under a root, run suffixes stripped. The driver lists folder names, no files."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(root)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(where)
    names = [(x.getPath().getName(), x.getPath().toString()) for x in found if x.isDirectory()]
    rows = spark.createDataFrame(names, "name string, path string").withColumn("label", strip_run_suffix(F.col("name")))
    part = lambda i: F.get(F.split("label", "_"), F.lit(i))
    return rows.select("label", "path", part(1).alias("topic"), part(0).alias("method"))
