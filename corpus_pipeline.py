"""From raw documents to packed training batches.

Five stages, in this order; each calls one operator of ``tabloom.llm`` and
works on all that its predecessor kept:

1. ``quality``: documents that the Kneser-Ney model of trusted text rejects go;
2. ``line_dedup``: lines that many documents share stay in the last one only;
3. ``near_duplicates``: one document of every class of the n-gram Jaccard join
   (five words, similarity 0.8) stays;
4. ``mix``: sources are sampled and repeated to their target weights;
5. ``pack``: documents are cut, bucketed by length and packed into batches.

All stages but the last return the columns of ``documents``. ``run`` writes the
result of each stage as Parquet to the shared folder and rereads it. Labels
come from ``labels`` beside ``documents``.

Defined cases: a NULL or empty text has no words, so it is no near copy, is taken
zero times by the mix and gives no piece; a NULL language is a language and a NULL
source a source of its own; rows that repeat an id and its text count once after
stage 3, rows of one id with different texts are judged each; rows with a NULL id
are no copies of others; extra columns, of any name, are kept up to the mix; an empty
table of documents gives empty stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabloom.llm import jaccard, line_dedup, mixing, packing, quality_lm
from tabloom.llm.common import stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_lm.filtered(docs, table(spark, sf_dir, "labels"))


def remove_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicated(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_per_class(docs, width=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality", quality),
    ("line_dedup", remove_common_lines),
    ("near_duplicates", near_duplicates),
    ("mix", mix),
    ("pack", pack),
]

#: The quality model and the seeded order of the mix have no SQL form; the
#: stages are tested against brute force in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
