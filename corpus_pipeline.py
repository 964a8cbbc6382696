"""A training corpus in five stages, each over all that the one before kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketflow.llm.decontam import contaminated
from ticketflow.llm.mixing import mix_sources
from ticketflow.llm.ngram_join import jaccard_components
from ticketflow.llm.secret_scan import redact_secrets
from ticketflow.llm.text import cut, join_hint, shared_dir
from ticketflow.llm.toxicity import toxicity

#: SQL can express neither the classifier nor the alignment.
ORACLE_SQL = None


def _free(name: str, columns: list[str]) -> str:
    """The name, with underscores behind it until no column has it; Spark does not tell upper from lower case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents with a number for each row, and that column's name: doc_id, where every row has one of its own."""
    name = _free("row_no", docs.columns)
    unclear = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1 or doc_id is null")
    if unclear.isEmpty():
        return docs.withColumn(name, F.col("doc_id").cast("long")), name
    return cut(docs.withColumn(name, F.monotonically_increasing_id())), name


def _without(rows: DataFrame, name: str, gone: DataFrame) -> DataFrame:
    """The rows whose number is not in gone, without their numbers."""
    gone = cut(gone.toDF("gone_no").distinct())
    return rows.join(gone.hint(join_hint(gone)), rows[name] == gone["gone_no"], "left_anti").drop(name)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic."""
    rows, no = _numbered(docs)
    scores = toxicity(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=no)
    return _without(rows, no, scores.filter("predicted = 1").select(no))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id; rows are told apart by number, so that two texts under one id are two documents."""
    rows, no = _numbered(docs)
    groups = jaccard_components(rows.select(F.col(no).alias("doc_id"), "text"))
    # numbers are ids, or, where ids are unclear, in order of nothing: then the smallest id of a group is looked up
    if rows.filter(~F.col("doc_id").eqNullSafe(F.col(no))).isEmpty():
        return _without(rows, no, groups.filter("doc_id <> component_id").select("doc_id"))
    groups = cut(groups.select(F.col("doc_id").alias("g_no"), "component_id"))
    ids = rows.select(F.col(no).alias("i_no"), F.col("doc_id").alias("i_id"))
    placed = cut(groups.join(ids.hint("merge"), F.col("g_no") == F.col("i_no")).select("g_no", "component_id", F.struct(F.col("i_id").isNull(), "i_id", "g_no").alias("place")))
    first = placed.groupBy("component_id").agg(F.min("place").alias("first")).select(F.col("first.g_no").alias("first_no"))
    gone = placed.join(first.hint("merge"), F.col("g_no") == F.col("first_no"), "left_anti")
    return _without(rows, no, gone.select("g_no"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    rows, no = _numbered(docs)
    found = contaminated(rows.select(F.col(no).alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(rows, no, found.select("doc_id"))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced."""
    return redact_secrets(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as they are, each with the times that the mix takes it (`copies`) and the figures behind that; a figure whose name a column already has gets an underscore."""
    rows, no = _numbered(docs)
    figures = {c: _free(c, docs.columns) for c in ("size", "source_size", "target", "copies", "taken")}
    mixed = mix_sources(rows.select(F.col(no).alias("doc_id"), "text", "source"))
    mixed = cut(mixed.select(F.col("doc_id").alias("m_no"), *[F.col(c).alias(name) for c, name in figures.items()]))
    out = rows.join(mixed.hint(join_hint(mixed, 128)), rows[no] == mixed["m_no"])
    return out.select(*[rows[c] for c in docs.columns], *[mixed[name] for name in figures.values()])


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", one_of_each_group),
    ("decontamination", drop_contaminated),
    ("secret_scan", hide_secrets),
    ("mixing", mix),
]


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to documents; what a stage returns is written to the shared folder and read again, and removed once the next one is written.

    Null and empty texts are kept by every filter. Null or repeated doc_ids: each row is a document of its own, of
    which only copies go. Extra columns stay as they are to the end, whatever their names; very long texts are
    handled whole. The result holds id, text and all columns of what is kept, and the mix's figures. An empty table gives an empty result.
    """
    shared_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
        if k:
            _remove(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
