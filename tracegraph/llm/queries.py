"""The queries of this package, one an operator, and the pipeline; with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .lang_id import op7_language_id
from .line_dedup import op2_line_dedup
from .media import op1_media_columns
from .mixing import OP6_SQL, op6_mixing
from .multiset import op10_fingerprints
from .pieces import op9_sentencepiece
from .revisits import OP4_SQL, op4_revisits
from .simhash import op8_simhash
from .token_store import op3_token_store
from .url_filter import op5_url_filter


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_media_columns": op1_media_columns,
    "op2_line_dedup": op2_line_dedup,
    "op3_token_store": op3_token_store,
    "op4_revisits": op4_revisits,
    "op5_url_filter": op5_url_filter,
    "op6_mixing": op6_mixing,
    "op7_language_id": op7_language_id,
    "op8_simhash": op8_simhash,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_fingerprints": op10_fingerprints,
    "pipeline": pipeline,
}

ORACLE_SQL = {"op4_revisits": OP4_SQL, "op6_mixing": OP6_SQL}
