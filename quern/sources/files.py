"""File sources and sinks with explicit schemas.

Paths go through Spark's readers only, so any store that Spark reads works.
"""

from __future__ import annotations

import base64
import json
import uuid
import zlib

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, MapType, StringType, StructType

#: One schema for the tasks of every data set.
TASK_SCHEMA = "task_id string, benchmark string, prompt string, answer string, level string, subject string, tests array<string>"


def read_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame | None:
    """A JSON document (list or object) as rows; None if the path is missing."""
    try:
        return spark.read.schema(schema).json(path, multiLine=True)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def replace_folder(spark: SparkSession, new: str, path: str) -> None:
    """Put the finished folder ``new`` in the place of ``path``: the old one steps aside first and goes last, so readers find one of the two whole,
    or for a moment none, and a failure in between loses neither."""
    jvm = spark.sparkContext._jvm
    to = jvm.org.apache.hadoop.fs.Path(path)
    fs = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    aside = jvm.org.apache.hadoop.fs.Path(f"{path}.old-{uuid.uuid4().hex}")
    had = fs.exists(to)
    if had and not fs.rename(to, aside):
        raise OSError(f"{path} can't be set aside")
    if not fs.rename(jvm.org.apache.hadoop.fs.Path(new), to):
        if had:
            fs.rename(aside, to)
        raise OSError(f"{path} can't be replaced")
    if had:
        fs.delete(aside, True)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines, written beside the old folder and put in its place when complete; df may read the old one."""
    new = f"{path}.new-{uuid.uuid4().hex}"
    df.write.json(new)
    replace_folder(df.sparkSession, new, path)


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, recursive: bool = False) -> DataFrame:
    """JSON lines; blank lines are skipped."""
    reader = spark.read.schema(schema).option("recursiveFileLookup", str(recursive).lower())
    return reader.json(path)


def positional_subset(rows: DataFrame, order: str, wanted: list[int]) -> DataFrame:
    """Rows at the given positions (from 0) in order; positions past the end are ignored. Only the narrow key is numbered, and a
    row beyond the largest position never enters the window."""
    from pyspark.sql import Window

    if not wanted:
        return rows.limit(0)
    first = rows.select(order).orderBy(order).limit(max(wanted) + 1)
    at = first.withColumn("_at", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(order)) - 1).filter(F.col("_at").isin(list(wanted)))
    return rows.join(F.broadcast(at.select(order)), order, "left_semi")


def read_parquet_shards(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Parquet shards; a missing one is an error."""
    if not paths:
        raise FileNotFoundError("no shard given")
    return spark.read.parquet(*paths)


def task_rows(df: DataFrame, benchmark: str, **fields: Column | str) -> DataFrame:
    """Rows of one data set in TASK_SCHEMA; fields it lacks are null."""
    out = [F.lit(benchmark).alias("benchmark")]
    for f in StructType.fromDDL(TASK_SCHEMA):
        if f.name != "benchmark":
            c = fields.get(f.name)
            c = F.lit(None) if c is None else F.col(c) if isinstance(c, str) else c
            out.append(c.cast(f.dataType).alias(f.name))
    return df.select(*out).select(*StructType.fromDDL(TASK_SCHEMA).fieldNames())


def load_humaneval(spark: SparkSession, path: str) -> DataFrame:
    df = read_jsonl(spark, path, "task_id string, prompt string, canonical_solution string, test string, entry_point string")
    return task_rows(df, "humaneval", task_id="task_id", prompt="prompt", answer="canonical_solution", tests=F.array("test"))


def load_mbpp(spark: SparkSession, path: str, low: int = 11, high: int = 510) -> DataFrame:
    df = read_jsonl(spark, path, "task_id long, text string, code string, test_list array<string>").filter(F.col("task_id").between(low, high))
    return task_rows(df, "mbpp", task_id=F.concat(F.lit("mbpp/"), "task_id"), prompt="text", answer="code", tests="test_list")


def load_gsm8k(spark: SparkSession, path: str) -> DataFrame:
    from ..functions.text import hash_answer

    df = read_jsonl(spark, path, "id string, question string, answer string")
    return task_rows(df, "gsm8k", task_id=F.coalesce("id", F.concat(F.lit("gsm8k/"), F.md5("question"))), prompt="question", answer=hash_answer("answer"))


def load_math(spark: SparkSession, path: str) -> DataFrame:
    from ..functions.text import boxed_or_last_line

    df = read_jsonl(spark, path, "id string, problem string, level string, type string, solution string")
    return task_rows(df, "math", task_id=F.coalesce("id", F.concat(F.lit("math/"), F.md5("problem"))), prompt="problem", answer=boxed_or_last_line("solution"), level="level", subject="type")


#: Loaders by name.
LOADERS = {"humaneval": load_humaneval, "mbpp": load_mbpp, "gsm8k": load_gsm8k, "math": load_math}


def load_tasks(spark: SparkSession, benchmark: str, path: str, limit: int = 0) -> DataFrame:
    """Tasks of a registered data set; limit 0: all, else the first by id."""
    if benchmark not in LOADERS:
        raise ValueError(f"unknown data set {benchmark!r}")
    df = LOADERS[benchmark](spark, path)
    return df.orderBy("task_id").limit(limit) if limit else df


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Ids of a manifest: a JSON list, a JSON object with an ids or task_ids list, or text lines with # comments."""
    whole = spark.read.text(path, wholetext=True).select(F.trim("value").alias("raw"))
    is_list, is_map = F.col("raw").startswith("["), F.col("raw").startswith("{")
    body = F.from_json("raw", "ids array<string>, task_ids array<string>")
    lines = F.filter(F.transform(F.split("raw", r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, r"#.*\z", ""))), lambda x: x != "")
    ids = F.when(is_list, F.from_json("raw", "array<string>")).when(is_map, F.coalesce(body["task_ids"], body["ids"])).otherwise(lines)
    return whole.select(F.posexplode(ids).alias("position", "task_id"))


#: Bytes that packed test cases may unpack to.
UNPACKED = 64 << 20


@pandas_udf(StringType())
def _unpacked(c):
    """JSON text as it is, or out of base64 and zlib; null for anything else. Pickles are bytes like any others here and never executed."""

    def read(x):
        if x is None or x.lstrip()[:1] in ("[", "{"):
            return x
        try:
            text = zlib.decompressobj().decompress(base64.b64decode(x, validate=True), UNPACKED).decode("utf-8")
            json.loads(text)
            return text
        except (ValueError, zlib.error):
            return None

    return c.map(read)


def decode_test_cases(raw: str | Column) -> Column:
    """Test cases from JSON text, plain or packed by zlib and base64; other encodings (pickles among them) give null."""
    c = F.col(raw) if isinstance(raw, str) else raw
    return F.from_json(_unpacked(c), "array<struct<input:string,output:string,testtype:string>>")


def export_jsonl(df: DataFrame, path: str) -> DataFrame:
    """Write JSON lines and return a one-row manifest: rows written and a digest of their content, whatever their order and files: the
    count and three sums over parts of the 256-bit digests of the lines, digested again."""
    write_json(df, path)
    line = F.sha2("value", 256)
    half = lambda at: F.sum(F.conv(F.substring(line, at, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    n = F.count(F.lit(1))
    return df.sparkSession.read.text(path).agg(n.alias("rows"), F.sha2(F.concat_ws("|", n.cast("string"), half(1), half(17), half(33)), 256).alias("digest"))


def flat_cells(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for CSV."""
    nested = (ArrayType, MapType, StructType)
    return df.select(*[F.to_json(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`") for f in df.schema])


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; nested cells as JSON."""
    flat_cells(df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def union_of_columns(parts: list[DataFrame]) -> DataFrame:
    """Rows of all parts under the sorted union of their columns; missing cells are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.select(*[F.col(f"`{c}`") for c in sorted(out.columns)])


def results_summary(df: DataFrame, score: str = "score", cost: str = "cost") -> DataFrame:
    """Mean score; the cost is cumulative: its maximum in all, that over n on average."""
    return df.agg(F.avg(score).alias("average_score"), F.max(cost).alias("total_cost"), (F.max(cost) / F.count(F.lit(1))).alias("average_cost"))


def read_runs(spark: SparkSession, root: str, schema: StructType | str, file: str = "episodes.jsonl") -> DataFrame:
    """All files of a name below a folder, with the run (their folder)."""
    df = spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", file).json(root)
    return df.withColumn("run", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1))


def read_rounds(spark: SparkSession, root: str, schema: StructType | str) -> DataFrame:
    """round_N/*.json files with their round number."""
    df = spark.read.schema(schema).option("multiLine", "true").json(f"{root}/round_*/*.json")
    return df.withColumn("round", F.regexp_extract(F.col("_metadata.file_path"), r"round_(\d+)/", 1).cast("int"))


def save_partitioned(df: DataFrame, path: str, by: str) -> None:
    """A store with one folder a key, for example traces by run."""
    df.write.mode("overwrite").partitionBy(by).json(path)


def load_partitioned(spark: SparkSession, path: str, schema: StructType | str, by: str, key: str | None = None) -> DataFrame:
    """What save_partitioned wrote, or one key of it (only its folder is read)."""
    kind = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    if by not in kind.fieldNames():
        kind = StructType(kind.fields).add(by, "string")
    df = spark.read.schema(kind).json(path)
    return df if key is None else df.filter(F.col(by) == key)


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A new GraphML folder: every task writes a document of its rows, and all appear together when the job is committed."""
    from .graphml import SCHEMA, GraphML

    nodes.sparkSession.dataSource.register(GraphML)
    fields = StructType.fromDDL(SCHEMA).fields

    def full(df: DataFrame, kind: str) -> DataFrame:
        own = {*df.columns}
        return df.select(*[(F.lit(kind) if f.name == "kind" else F.col(f.name) if f.name in own else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])

    full(nodes, "node").unionByName(full(edges, "edge")).write.format("graphml").mode("append").save(path)


def read_graphml(spark: SparkSession, path: str, split: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a GraphML file, or of a folder that write_graphml made, read in ranges of ``split`` bytes: quotes around values go; an edge
    without a weight has 0."""
    from .graphml import GraphML

    spark.dataSource.register(GraphML)
    reader = spark.read.format("graphml")
    reader = reader.option("range", split) if split else reader
    nodes = reader.option("kind", "node").load(path).select("id", "entity_type", "description", "source_id")
    return nodes, reader.option("kind", "edge").load(path).select("src", "tgt", "weight", "description", "keywords", "source_id")


def markdown_table(df: DataFrame, limit: int = 1000) -> str:
    """A Markdown table of a report-sized result (an error beyond ``limit`` rows)."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows: aggregate before rendering")
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    head = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(head + ["| " + " | ".join(map(cell, r)) + " |" for r in rows])
