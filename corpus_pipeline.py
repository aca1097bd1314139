"""The corpus pipeline: STAGES applied in turn to documents.

Quality rules drop the documents that they reject, the Jaccard join leaves one document of each group,
substring dedup cuts repeated passages out of the texts, mixing repeats documents until sources
meet their targets, and packing puts all that is left into sequences. A stage that decides by row names
rows by 128 bits of all their columns; rows that share a name are alike in every column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planegrid.llm.common import DOCUMENT, WORD, documents, row_name, saved
from planegrid.llm.jaccard import near_rows
from planegrid.llm.mixing import mix, sized
from planegrid.llm.packing import packed_documents
from planegrid.llm.quality import judged
from planegrid.llm.substrings import without_repeats


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the outlier estimate keep. Equal texts of a language and source get one verdict."""
    named = docs.select(DOCUMENT).withColumn("own", row_name("text", "lang", "source"))
    rejected = saved(judged(named.select("text", "lang", "source", "own")).where("NOT kept").select("own").distinct())
    return named.join(rejected, "own", "left_anti").select(DOCUMENT)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one of the smallest doc_id, once; documents without words all stay.

    Where several rows of a group have that doc_id, or none has one, the first by row name stays. Unlike texts
    of one doc_id are documents of their own.
    """
    named = docs.select(DOCUMENT).withColumn("own", row_name(*DOCUMENT))
    first = near_rows(named.select("doc_id", "text", "own")).where("n_shingles > 0 AND doc_id <=> component_id")
    first = saved(first.groupBy("comp").agg(F.min("own").alias("own")).select("own"))
    one = named.join(first, "own", "left_semi").dropDuplicates(["own"])
    wordless = docs.where(~F.coalesce(F.col("text").rlike(WORD), F.lit(False)))
    return one.select(DOCUMENT).unionByName(wordless.select(DOCUMENT))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of 35-word windows that occur twice; n_chars follows, emptied texts stay as rows."""
    kept = without_repeats(docs.select(DOCUMENT))
    return kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(DOCUMENT)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, to half of a source's last document. Rows alike in every column count together."""
    named = docs.select(DOCUMENT).withColumn("h", row_name(*DOCUMENT))
    copies = saved(mix(sized(named, "h"), amends=0).groupBy("h").agg(F.sum("copies").cast("int").alias("copies")).where("copies > 0"))
    taken = named.join(copies, "h").dropDuplicates(["h"])
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select(DOCUMENT)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences."""
    return packed_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("mixing sources", mixture),
    ("best-fit packing", packing),
]

#: No SQL form: draws use a hash that DuckDB lacks, and packing runs a tokenizer. tests/llm holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
