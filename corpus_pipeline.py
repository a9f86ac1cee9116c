"""A training-corpus pipeline: five stages, each over all that the one before kept.

toxicity -> n-gram Jaccard join -> suffix-array dedup -> mixing sources -> SentencePiece encoding. Each stage
takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it to the shared folder as Parquet and reads it
again as the next one's documents. All but the last return the columns of ``documents``, further columns of the input included: stages
carry them in one struct, so their names clash with nothing. An empty table passes through all stages; texts of any length are whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapegrade.llm import bpe_pieces, common, mixing, ngram_jaccard, suffix_dedup, toxicity
from tapegrade.llm.queries import documents, labels, tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, labels(spark, sf_dir)))


def _packed(docs: DataFrame, *named: str) -> DataFrame:
    """``doc_id``, ``text``, the ``named`` columns, and all but the first two in one struct: no name of the input can meet a name of a stage."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", *named, F.struct(*[F.col(f"`{c}`") for c in rest], *([] if rest else [F.lit(None).cast("int").alias("none")])).alias("rest"))


def _unpacked(packed: DataFrame, docs: DataFrame, **new: Column) -> DataFrame:
    """The columns of ``docs`` again, ``new`` ones in place of those in the struct."""
    return packed.select(*[new[c].alias(c) if c in new else F.col(c) if c in ("doc_id", "text") else F.col("rest").getField(c).alias(c) for c in docs.columns])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity of 0.8 or more), the one of the smallest id.

    Rows that repeat an id are judged by their texts, whatever their order; rows without an id have no group and stay.
    """
    return _unpacked(ngram_jaccard.one_of_each(_packed(docs), percent=80, width=5), docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes that an earlier one has; bytes of a character that was cut go with it."""
    cut = suffix_dedup.suffix_dedup(_packed(docs), keep=("rest",), decode=True).select("doc_id", F.col("kept").alias("text"), "rest")
    return _unpacked(cut, docs, **({"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    packed = _packed(docs, "source")
    taken = mixing.mix_sources(packed).groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")).filter("copies > 0")
    sized = packed.withColumn("size", mixing.word_count(F.col("text"))).alias("d")
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"t.{c}")) for c in ("doc_id", "source", "size")]
    met = sized.join(taken.alias("t"), same[0] & same[1] & same[2]).select("d.*", "copies", "rows")
    # rows that repeat (id, source, size) share what was taken of them
    turn = F.row_number().over(W.partitionBy("doc_id", "source", "size").orderBy("text"))
    times = F.floor((F.col("copies") + turn - 1) / F.col("rows"))
    again = met.withColumn("times", times).filter("times > 0").withColumn("time", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("times"))))
    return _unpacked(again, docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document of the mix."""
    return bpe_pieces.round_trips(docs, tokenizer_path())


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard", one_of_each_group), ("suffix_dedup", cut_repeats), ("mixing", mix), ("bpe_pieces", encode)]

#: SQL can't express the stages; tests compare them with brute force.
ORACLE_SQL = None


def _discard(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``; a stage's folder is deleted once the next one is written, the last one stays."""
    common.prepare(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if k:
            _discard(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
