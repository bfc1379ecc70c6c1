"""The corpus pipeline: quality, near duplicates, repeated passages, benchmark passages, then packing.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps, in the columns of documents; the last one
returns the packed pieces. A stage decides on rows by a key of all their columns, so rows of null or repeated doc_id are judged one
by one; rows that are equal in every column share their fate. What a stage writes on its way is deleted when it has decided; the small table of its
decisions stays, so its result can be read at any time. SQL can't express the stages (a language model, hashing, a tokenizer):
tests hold near duplicates, passages and contamination against brute force, and the classifier's model against one made by hand.

Cases: null and empty texts pass (their shingle sets are empty, so they are no copies of each other); an empty table gives none; ties go to
the smaller doc_id; further columns pass unchanged, whatever their names; n_chars follows the text where the table has it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.llm import common, decontaminate, near_dedup, packing, quality, substring_dedup

ROW = "_corpus_row"


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows as structs beside their key, so that no column's name can clash; columns of every type take part."""
    return common.packed_rows(docs, common.row_key(*[common.hashable(docs, c) for c in docs.columns]).alias(ROW))


def _narrow(docs: DataFrame, *columns: str) -> DataFrame:
    """The key and the named columns only."""
    return _keyed(docs).select(ROW, *[F.col("row").getField(c).alias(c) for c in columns])


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    return _keyed(docs).hint("merge").join(dropped, ROW, "left_anti").select("row.*")


def _decided(rows: DataFrame, name: str) -> DataFrame:
    return common.written(rows.select(ROW).distinct(), name, keep=True)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects."""
    with common.scratch(spark):
        found = quality.classified(_narrow(docs, "doc_id", "text", "lang"), common.table(spark, sf_dir, "labels"), row=ROW)
        dropped = _decided(found.where("NOT kept").withColumnRenamed("row", ROW), "dropped")
    return _without(docs, dropped)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles), keeps the document of the smallest id, null being the largest; of equal rows, one."""
    rows = _narrow(docs, "doc_id", "text")
    with common.scratch(spark):
        found = near_dedup.near_groups(rows, doc_id=ROW, shingle=5).withColumnRenamed("doc_id", ROW)
        ids = found.hint("merge").join(rows.select(ROW, "doc_id").distinct(), ROW)
        least = ids.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", ROW)).alias("least"))
        kept = _decided(least.select(f"least.{ROW}"), "kept")
    return _keyed(docs).hint("merge").join(kept, ROW, "left_semi").dropDuplicates([ROW]).select("row.*")


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages that a document of a smaller id has too, and documents of which nothing is left."""
    plain = docs.select(*[common.quoted(c).alias({"doc_id": "id", "text": "text"}.get(c, f"c{i}")) for i, c in enumerate(docs.columns)])
    with common.scratch(spark):
        cut = substring_dedup.kept_texts(plain, doc_id="id", untouched=True)
    left = cut.where("n_removed = 0 OR n_removed < n_words")
    now = {"doc_id": F.col("id"), "text": F.col("kept_text")}
    if "n_chars" in docs.columns:
        now["n_chars"] = F.length("kept_text").cast(docs.schema["n_chars"].dataType)
    return left.select(*[now.get(c, F.col(f"c{i}")).alias(c) for i, c in enumerate(docs.columns)])


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are contaminated by benchmark items."""
    with common.scratch(spark):
        found = decontaminate.contamination(_narrow(docs, "text"), common.table(spark, sf_dir, "benchmark"), doc_id=ROW)
        dropped = _decided(found.where(decontaminate.contaminated()).withColumnRenamed("doc_id", ROW), "dropped")
    return _without(docs, dropped)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences."""
    return packing.packed(packing.pieces(docs)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("quality", quality_stage), ("near_dedup", near_dedup_stage), ("substring_dedup", substring_stage), ("decontaminate", decontaminate_stage), ("packing", packing_stage)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one written and read back as the next one's input."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}", keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
