"""Reading posts, word lists and configuration; writing results."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

POST = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("topic", T.StructType([T.StructField("word", T.StringType())])),
    T.StructField("selection", T.StructType([T.StructField("selected_post", T.StructType([T.StructField("text", T.StringType())]))])),
])


def read_posts(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, topic, text) of JSON lines; lines that are no JSON and posts without text are left out."""
    rows = spark.read.schema(POST).option("mode", "PERMISSIVE").json(path)
    rows = rows.select("doc_id", F.coalesce("topic.word", F.lit("")).alias("topic"), F.coalesce("selection.selected_post.text", F.lit("")).alias("text"))
    return rows.where(F.trim("text") != "")


def first_path(spark: SparkSession, *paths: str) -> str | None:
    """The first path that exists, asked of the file system that Spark would read it from."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        if at.getFileSystem(conf).exists(at):
            return p
    return None


def word_lines(spark: SparkSession, path: str) -> DataFrame:
    """(word): the distinct lines of a word list of any size, without blank ones and those that begin with '#'."""
    lines = spark.read.option("lineSep", "\n").text(path).select(F.trim("value").alias("word"))
    return lines.where((F.col("word") != "") & ~F.col("word").startswith("#")).distinct()


#: Words of a list, or phrases of a table, that are read into the driver; more are an error.
MOST_WORDS = 1_000_000


def _bounded(rows: DataFrame) -> list:
    found = rows.limit(MOST_WORDS + 1).collect()
    if len(found) > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} lines: join word_lines() instead")
    return found


def read_words(spark: SparkSession, path: str) -> list[str]:
    """word_lines() as a list, for operators that send it to all tasks."""
    return sorted(r.word for r in _bounded(word_lines(spark, path)))


def read_phrases(spark: SparkSession, path: str) -> dict[str, str]:
    """Lines of a phrase, a tab and its other form; of several forms parted by spaces the first counts, and of lines
    with the same phrase the first in alphabetical order. Other lines are left out."""
    cut = F.split("word", "\t")
    rows = word_lines(spark, path).where(F.size(cut) == 2).select(F.trim(cut[0]).alias("k"), F.split(F.trim(cut[1]), " ")[0].alias("v")).where("k <> '' and v <> ''")
    return {r.k: r.v for r in _bounded(rows.groupBy("k").agg(F.min("v").alias("v")))}


def read_config(path: str) -> dict:
    """A JSON file, or a YAML file where a YAML library is installed."""
    p = Path(path)
    if not p.exists():
        raise FileNotFoundError(path)
    if p.suffix == ".json":
        return json.loads(p.read_text(encoding="utf-8"))
    if p.suffix in (".yaml", ".yml"):
        import yaml

        return yaml.safe_load(p.read_text(encoding="utf-8"))
    raise ValueError(f"no such kind of configuration: {p.suffix}")


def write_text(rows: DataFrame, column: str, path: str) -> None:
    """One line of text for each row that is not blank."""
    rows.select(F.col(column).cast("string").alias("value")).where(F.trim("value") != "").write.mode("overwrite").text(path)


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_topics(topics: DataFrame, path: str) -> None:
    """(topic_id, words, scores, weight) as lines of JSON, in one file: topics are few."""
    topics.coalesce(1).write.mode("overwrite").json(path)


def write_markdown(reports: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "report") -> None:
    """One section for each report, headed by its id; a report's lines become list items."""
    items = F.array_join(F.transform(F.split(F.col(text_col), "\n"), lambda x: F.concat(F.lit("- "), x)), "\n")
    reports.select(F.concat(F.lit("## "), F.col(id_col).cast("string"), F.lit("\n\n"), items, F.lit("\n")).alias("value")).write.mode("overwrite").text(path)
