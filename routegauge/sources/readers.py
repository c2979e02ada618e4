"""File formats of the chat, answer, catalogue, metric and entry files."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from routegauge.sources.ranges import RANGE_BYTES, array_files, array_records, file_sizes

OUTPUTS = "array<struct<text:string,num_tokens:int>>"
GENERATION = f"request_id string, prompt string, outputs {OUTPUTS}"
MESSAGES = "array<struct<role:string,content:string>>"
ENTRY_VECTOR = "struct<item_id:bigint,id:string,text:string,embedding:array<float>>"
ENTRY = (
    f"entry_id string, history array<{ENTRY_VECTOR}>, candidates array<{ENTRY_VECTOR}>, "
    "query struct<text:string,embedding:array<float>>"
)


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Catalogue in ``id::title::genres`` lines, Latin-1."""
    schema = "item_id bigint, title string, genres string"
    return spark.read.csv(path, sep="::", encoding="ISO-8859-1", schema=schema, quote="", escape="")


def read_items_csv(spark: SparkSession, path: str, schema: str = "item_id bigint, title string") -> DataFrame:
    """Catalogue with a header line."""
    return spark.read.csv(path, header=True, schema=schema, enforceSchema=False, multiLine=True, escape='"')


def read_outputs(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Generation output, every file either one JSON array or JSON lines. Files of either kind are read by many tasks."""
    arrays = array_files(file_sizes(spark, path))
    names = [r["file"] for r in arrays.select("file").collect()]  # one row per array file
    lines = spark.read.json(path, schema=GENERATION)
    if not names:
        return lines
    listed = array_records(arrays, range_bytes).select(F.from_json("value", GENERATION).alias("r")).select("r.*")
    others = [f for f in (r["file"] for r in file_sizes(spark, path).select("file").collect()) if f not in set(names)]
    return spark.read.json([unquote(f) for f in others], schema=GENERATION).unionByName(listed) if others else listed


def parse_outputs(lines: DataFrame, keep: list[str] = ()) -> DataFrame:
    """The same records from a table of JSON lines (column ``value``)."""
    return lines.filter(F.length(F.trim("value")) > 0).select(
        *keep, F.from_json("value", GENERATION).alias("r")
    ).select(*keep, "r.*")


def request_number(request_id: Column) -> Column:
    """'req_17' as 17."""
    return F.regexp_extract(request_id, r"(\d+)\s*$", 1).cast("bigint")


def explode_outputs(generated: DataFrame, keep: list[str] = (), keep_empty: bool = False) -> DataFrame:
    """One row per run, numbered from 1. With ``keep_empty`` a record without outputs has one row, whose run is NULL."""
    # the outer form also where empty records go: of the plain one Spark infers a filter that parses every record again
    rows = generated.select(
        request_number(F.col("request_id")).alias("request_id"), *keep, "prompt", F.posexplode_outer("outputs").alias("p", "o")
    )
    return (rows if keep_empty else rows.filter(F.col("p").isNotNull())).select("request_id", *keep, "prompt", (F.col("p") + 1).alias("run"), "o.text", "o.num_tokens")


def read_chats(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """A JSON array of chats per file, each an array of messages, to file, request_id, turn, role, content.

    request_id counts the chats of one file, so file and request_id together name a chat. A file is cut into ranges, each
    read by a task of its own.
    """
    files = file_sizes(spark, path)
    arrays = array_files(files)
    if not files.join(arrays, "file", "left_anti").isEmpty():
        raise ValueError("a chat file holds an array of arrays of messages")
    chats = array_records(arrays, range_bytes)
    parsed = F.when(F.ltrim("value").startswith("["), F.from_json("value", MESSAGES))
    bad_shape = F.raise_error(F.lit("a chat file holds an array of arrays of messages")).cast(MESSAGES)
    checked = chats.select("file", F.col("index").alias("request_id"), F.coalesce(parsed, bad_shape).alias("chat"))
    return checked.select("file", "request_id", F.posexplode("chat").alias("turn", "m")).select(
        "file", "request_id", "turn", "m.role", "m.content"
    )


def parse_messages(lines: DataFrame, keep: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Message objects from JSON lines (column ``value``): the good rows and the rejected ones."""
    parsed = lines.withColumn("m", F.from_json("value", "role string, content string"))
    good = F.col("m.role").isNotNull() & F.col("m.content").isNotNull()
    return parsed.filter(good).select(*keep, "m.role", "m.content"), parsed.filter(~good).select(*keep, "value")


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """Entry lists in JSON lines; blank lines are skipped, a broken line is an error.

    A record without ``entry_id`` gets a negative number from its place in the files, so that every record counts.
    """
    number = -1 - F.monotonically_increasing_id()
    records = spark.read.schema(ENTRY).json(path, mode="FAILFAST")
    return records.withColumn("entry_id", F.coalesce("entry_id", number.cast("string")))


def entry_numbers(entries: DataFrame) -> DataFrame:
    """request_id of every record of an entry list."""
    return entries.select(F.col("entry_id").cast("bigint").alias("request_id"))


def entry_vectors(entries: DataFrame) -> DataFrame:
    """Long form of entry lists: request_id, section, pos, item_id, vec."""
    parts = F.array(
        F.struct(F.lit("history").alias("section"), F.col("history").alias("rows")),
        F.struct(F.lit("candidate").alias("section"), F.col("candidates").alias("rows")),
    )
    listed = entries.select(F.col("entry_id").cast("bigint").alias("request_id"), F.explode(parts).alias("s")).select(
        "request_id", "s.section", F.posexplode("s.rows").alias("pos", "r")
    ).select("request_id", "section", "pos", "r.item_id", F.col("r.embedding").alias("vec"))
    query = entries.filter(F.col("query").isNotNull()).select(
        F.col("entry_id").cast("bigint").alias("request_id"), F.lit("query").alias("section"), F.lit(0).alias("pos"),
        F.lit(None).cast("bigint").alias("item_id"), F.col("query.embedding").alias("vec"),
    )
    return listed.unionByName(query)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Per-request metrics with a header line."""
    return spark.read.csv(path, header=True, inferSchema=True)


def read_selected_columns(spark: SparkSession, path: str) -> list[str]:
    """Feature names listed under ``selected_cols``; a missing file gives an empty list."""
    try:
        row = spark.read.schema("selected_cols array<string>").json(path, multiLine=True).first()
    except AnalysisException as e:  # only a missing path means "no list"
        if e.getCondition() == "PATH_NOT_FOUND":
            return []
        raise
    return list(row[0] or []) if row else []
