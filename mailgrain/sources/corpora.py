"""Delimited corpora, term lists and sinks."""


from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import lexicons as lx
from ..functions.base import strip
from ..functions.text import compose_mail_text, cut, normalised_label
from .records import csv_columns, quoted_records


def scan_csv(spark: SparkSession, path, columns) -> DataFrame:
    """Quoted CSV with a heading and embedded line breaks, read by byte ranges; every column a string, never inferred."""
    return csv_columns(quoted_records(spark, path), columns)


def load_csv(spark: SparkSession, path, columns=("text", "label", "source"), text: str = "text", label: str = "label") -> DataFrame:
    """Labelled corpus: synonyms to 1 / 0, blank texts and unknown labels dropped, missing source empty."""
    rows = scan_csv(spark, path, columns)
    source = F.coalesce(F.col("source"), F.lit("")) if "source" in columns else F.lit("")
    out = rows.select(F.coalesce(F.col(text), F.lit("")).alias("text"), normalised_label(F.coalesce(F.col(label), F.lit(""))).alias("label"), source.alias("source"))
    return out.where((strip(F.col("text")) != "") & F.col("label").isNotNull())


def load_public_csv(spark: SparkSession, path, source: str = "kaggle") -> DataFrame:
    """Two-label public set: placeholder and very short texts dropped, long ones cut."""
    rows = scan_csv(spark, path, ("index", "Email Text", "Email Type"))
    text = strip(F.coalesce(F.col("Email Text"), F.lit("")))
    kind = F.lower(strip(F.coalesce(F.col("Email Type"), F.lit(""))))
    label = F.when(kind == "phishing email", 1).when(kind == "safe email", 0)
    out = rows.select(text.alias("text"), label.alias("label"), F.lit(source).alias("source"))
    return out.where((F.col("text") != "empty") & (F.length("text") >= 20) & F.col("label").isNotNull()).withColumn("text", cut(F.col("text")))


def load_integer_csv(spark: SparkSession, path, source: str = "turkish_spam") -> DataFrame:
    rows = scan_csv(spark, path, ("text", "labels"))
    return rows.select(strip(F.coalesce(F.col("text"), F.lit(""))).alias("text"), F.col("labels").try_cast("int").alias("label"),
                       F.lit(source).alias("source")).where("text <> ''")


def load_ragged_csv(spark: SparkSession, path) -> DataFrame:
    """Unquoted texts with commas: the label is the last field, the first line a heading."""
    pattern = r"^(.*),([^,]*)$"
    lines = spark.read.text(path)
    text = strip(F.regexp_extract("value", pattern, 1))
    rows = lines.select(text.alias("body"), F.regexp_extract("value", pattern, 2).alias("label"))
    kept = rows.where((F.length("body") >= lx.MIN_TEXT_CHARS) & (F.col("label") != "label"))
    return kept.withColumn("text", compose_mail_text(F.lit(""), F.col("body")))


def load_generated_csv(spark: SparkSession, path) -> DataFrame:
    """Generated mail: subject and body to model text, generator and theme kept."""
    rows = scan_csv(spark, path, ("subject", "body", "model", "category"))
    return rows.select(compose_mail_text(F.col("subject"), F.col("body")).alias("text"), "body",
                       F.col("model").alias("generator"), F.col("category").alias("theme"))


def load_terms(spark: SparkSession, path) -> DataFrame:
    """A redaction list (column `term`), one term per line of at least two characters."""
    return spark.read.text(path).select(strip(F.col("value")).alias("term")).where(F.length("term") >= 2)


def term_array(terms: DataFrame) -> Column:
    """All terms of a list as one literal array, for `redact`: a pattern that every task needs whole."""
    return F.lit(terms.agg(F.sort_array(F.collect_set("term")).alias("terms")).first()["terms"]).cast("array<string>")


def write_corpus(df: DataFrame, path) -> dict:
    """Write a labelled corpus partitioned by source; row and positive counts come with the same pass."""
    seen = Observation("corpus")
    observed = df.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("label") == 1).alias("positive"))
    observed.write.mode("overwrite").partitionBy("source").parquet(path)
    return seen.get


def write_report(metrics: DataFrame, path, digits: int = 6) -> None:
    """Metrics as JSON lines: private columns (leading underscore) dropped, numbers shortened, NaN to null."""
    columns = []
    for name, kind in metrics.dtypes:
        if name.startswith("_"):
            continue
        c = F.col(name)
        columns.append((F.round(F.when(~F.isnan(c), c), digits) if kind in ("double", "float") else c).alias(name))
    metrics.select(*columns).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_report(spark: SparkSession, path, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


