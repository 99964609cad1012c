"""Question-answer sets of several file formats, and fine-tuning sets written by split with their statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructType

from quillspark.operators import analytics
from quillspark.sources import readers

#: Columns of a question-answer set.
FIELDS = ["id", "question", "answer", "context", "category", "difficulty", "source", "metadata"]
# Under which of its keys a JSON object holds its rows, and other names of columns.
HOLDERS = ["qa_pairs", "questions", "data", "samples"]
NAMES = {"question": ["question", "query"], "answer": ["answer", "reference"]}


def _text(df: DataFrame, name: str) -> Column:
    field = next(f for f in df.schema if f.name == name)
    c = F.col(f"`{name}`")
    return F.to_json(c) if isinstance(field.dataType, (StructType, ArrayType, MapType)) else c.cast("string")


def qa_rows(df: DataFrame, names: dict[str, list[str]] | None = None) -> DataFrame:
    """``FIELDS`` as strings from a table that has some of them, under any of the given names; rows without a question or an answer go.

    Nested values become JSON; a column that is missing is null. Of several names the first with a value counts.
    """
    names = {**{n: [n] for n in FIELDS}, **(names or NAMES)}
    have = {n: [_text(df, c) for c in names[n] if c in df.columns] for n in FIELDS}
    rows = df.select(*((F.coalesce(*cols) if cols else F.lit(None).cast("string")).alias(n) for n, cols in have.items()))
    return rows.where("length(question) > 0 AND length(answer) > 0")


def _json(spark: SparkSession, path: str) -> DataFrame | None:
    """Rows of a JSON file: a list, an object that holds a list, articles of paragraphs, or lines of objects."""
    df = spark.read.option("multiLine", str(path.endswith(".json")).lower()).json(path)
    if "data" in df.columns and "paragraphs" in df.select(F.explode("data").alias("d")).select("d.*").columns:
        return readers.squad(spark, path).select(F.col("query").alias("question"), F.col("reference").alias("answer"), "context")
    for holder in HOLDERS:
        if holder in df.columns and isinstance(df.schema[holder].dataType, ArrayType) and isinstance(df.schema[holder].dataType.elementType, StructType):
            rows = df.select(F.explode(holder).alias("_r")).select("_r.*")
            if {"question", "answer"} <= set(rows.columns):
                return rows
    return df


def qa_set(spark: SparkSession, path: str, query_col: str | None = None, answer_col: str | None = None, context_col: str | None = None) -> DataFrame:
    """A set of questions and answers from a JSON, JSON-lines or CSV file, or from all such files of a folder (named by pattern); others are skipped.

    Columns are told by their usual names, or named for CSV files of others. Lines that do not parse are left out.
    """
    names = {"question": [query_col] if query_col else NAMES["question"], "answer": [answer_col] if answer_col else NAMES["answer"], **({"context": [context_col]} if context_col else {})}
    jvm, jsc = spark._jvm, spark._jsc
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(jsc.hadoopConfiguration())
    files = sorted(str(f.getPath()) for f in fs.listStatus(target) if f.isFile())  # a folder's files, or the file itself
    out = None
    for file in files:
        if file.endswith(".csv"):
            df = readers.read_csv(spark, file, header=True).drop("_malformed")
        elif file.endswith((".json", ".jsonl")):
            df = _json(spark, file)
        else:
            continue
        rows = qa_rows(df, names)
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else spark.createDataFrame([], ", ".join(f"{n} string" for n in FIELDS))


def conversations(spark: SparkSession, path: str) -> DataFrame:
    """(id, turn, role, content) of JSON lines that hold a list of messages."""
    df = spark.read.schema("id string, messages array<struct<role: string, content: string>>").json(path).where("messages IS NOT NULL")
    return df.select("id", F.posexplode("messages").alias("turn", "m")).select("id", "turn", "m.role", "m.content")


# The table that the SQL rows fill.
SQL_TABLE = "CREATE TABLE IF NOT EXISTS fine_tune_data (id TEXT PRIMARY KEY, question TEXT NOT NULL, answer TEXT NOT NULL, context TEXT, category TEXT, difficulty TEXT, metadata TEXT, source TEXT);"


def sql_row() -> Column:
    """One INSERT statement for a row of ``FIELDS``; empty values are NULL, an id that is missing is made of the question and the answer."""
    values = {n: F.col(n) for n in ("id", "question", "answer", "context", "category", "difficulty", "metadata", "source")}
    values["id"] = F.coalesce("id", F.md5(F.concat_ws("\x01", "question", "answer")))
    values["metadata"] = F.coalesce("metadata", F.lit("{}"))
    quoted = [F.when(F.coalesce(v, F.lit("")) == "", F.lit("NULL")).otherwise(F.concat(F.lit("'"), F.replace(v, F.lit("'"), F.lit("''")), F.lit("'"))) for v in values.values()]
    return F.concat(F.lit("INSERT OR REPLACE INTO fine_tune_data VALUES ("), F.concat_ws(", ", *quoted), F.lit(");"))


def write_sets(qa: DataFrame, path: str, styles: list[str], train: float = 0.8, valid: float = 0.1, least_quality: float = 0.0) -> DataFrame:
    """Writes ``qa`` (as ``qa_rows`` gives it) under path/style/split=.. in each style, and path/metadata; returns the metadata's rows.

    A row's split is told by its question and answer, so it is the same in every style and run. Styles are those of ``analytics.chat_rows``;
    sql gives INSERT statements into the table of ``SQL_TABLE``, with line breaks in values as they are. Metadata has, for each split, its rows and mean lengths and quality.
    """
    quality = analytics.qa_quality(*(F.col(n) for n in ("question", "answer", "context", "category")))
    rows = analytics.split_by_hash(qa.withColumn("quality", quality).where(F.col("quality") >= least_quality), F.concat_ws("\x01", "question", "answer"), train, valid)
    for style in styles:
        made = rows.withColumn("row", sql_row()) if style == "sql" else analytics.chat_rows(rows, style)
        made.select(F.col("row").alias("value"), "split").write.partitionBy("split").text(f"{path}/{style}")
    stats = rows.groupBy("split").agg(F.count("*").alias("n"), F.avg(F.length("question")).alias("mean_question"), F.avg(F.length("answer")).alias("mean_answer"), F.avg("quality").alias("mean_quality"))
    stats = stats.withColumns({"styles": F.lit(",".join(styles)), "least_quality": F.lit(least_quality), "train_share": F.lit(train), "validation_share": F.lit(valid)})
    stats.coalesce(1).write.json(f"{path}/metadata")
    return qa.sparkSession.read.schema(stats.schema).json(f"{path}/metadata")
