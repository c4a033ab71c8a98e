"""One query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomarray.llm.common import documents
from loomarray.llm.sql import COLLOCATIONS, DIVERGENCE, MANIFEST


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomarray.llm.quality import quality

    return quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomarray.llm.sharding import shard

    return shard(documents(spark, sf_dir), shards=40)


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomarray.llm.search import top_k

    docs = documents(spark, sf_dir)
    return top_k(docs, docs.where("doc_id % 50 = 0"), k=10)


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomarray.llm.minhash import near_duplicates

    return near_duplicates(documents(spark, sf_dir), words=3, percent=85)


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomarray.llm.mixing import mix

    return mix(documents(spark, sf_dir), weights=(1, 2, 3), most=3)


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomarray.llm.winnowing import fingerprints

    return fingerprints(documents(spark, sf_dir))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomarray.llm.token_files import token_files

    return token_files(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"), end_id=2)


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomarray.llm.repeats import remove_repeats

    return remove_repeats(documents(spark, sf_dir))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomarray.llm.token_count import token_counts

    return token_counts(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"), limit=1024)


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomarray.llm.packing import pack

    return pack(documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"), capacity=2048, end_id=0)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomarray.llm.collocations import collocations

    return collocations(documents(spark, sf_dir), least=30, longest=4, best=2000)


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomarray.llm.merkle import manifest

    return manifest(documents(spark, sf_dir))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomarray.llm.divergence import divergence_rules

    return divergence_rules(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_quality, op2_shard, op3_top_k, op4_near_duplicates, op5_mix, op6_fingerprints, op7_token_files, op8_repeats, op9_token_counts, op10_pack, op11_collocations, op12_manifest, op13_divergence)}

#: DuckDB SQL for what SQL can express.
ORACLE_SQL: dict[str, str] = {"op11_collocations": COLLOCATIONS, "op12_manifest": MANIFEST, "op13_divergence": DIVERGENCE}
