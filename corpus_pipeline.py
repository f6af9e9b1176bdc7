"""A corpus from raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns a DataFrame; it is
written as Parquet and read again as the next stage's docs.  All but the last return the columns of documents.

Cases: a table without rows passes through every stage; null texts are empty; the join's stage decides
by row, so rows of one doc_id or of none that link with nothing all stay, as do texts without words; of equal rows the
join's stage keeps one; a very long text goes through every stage whole; columns that documents have besides are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyloom.llm.common import SPACES, materialize, table
from keyloom.llm.jaccard_join import class_heads, node, set_digest
from keyloom.llm.mixing import mixed_documents
from keyloom.llm.packing import cut_pieces, pack
from keyloom.llm.quality_classifier import THRESHOLD, score_quality
from keyloom.llm.repeats import remove_repeats
from keyloom.llm.tokens import default_path

#: Characters encoded at once: fewer than the operator's own, for less memory after four stages in the same executors.
LOT = 1 << 19

#: SQL cannot express training, the search for repeats or the packing; tests hold each stage against brute force.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier does not reject."""
    return score_quality(docs, table(spark, sf_dir, "labels"), keep=tuple(docs.columns), at_least=THRESHOLD)


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of the Jaccard join the row of least doc_id (null last), set and text; and the rows without words."""
    own = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    doc_id, text = (f"c{docs.columns.index(c)}" for c in ("doc_id", "text"))
    blank = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACES)) == ""
    rows = own.where(~blank).withColumn("set", node(F.col(doc_id), set_digest(F.col(text)))).join(class_heads(docs), F.col("set") == F.col("head"), "left_semi")
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("set").orderBy(text))).where("nth = 1").drop("set", "nth")
    return rows.unionAll(own.where(blank)).toDF(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that an earlier document has; what is left of a split character goes too."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    kept = remove_repeats(docs, carry=tuple(others), as_text=True)
    out = {"doc_id": F.col("doc_id"), "text": F.col("kept")} | {c: F.col(f"_c{i}") for i, c in enumerate(others)}
    if "n_chars" in out:
        out["n_chars"] = F.length("kept").cast(docs.schema["n_chars"].dataType)
    return kept.select(*[out[c].alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    return pack(cut_pieces(docs, default_path(), lot=LOT))


STAGES = [
    ("quality_classifier", keep_quality),
    ("jaccard_join", keep_one_of_each_class),
    ("suffix_dedup", cut_repeats),
    ("mix_sources", mix_sources),
    ("pack", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
