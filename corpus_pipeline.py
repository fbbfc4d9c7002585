"""A training corpus from documents, stage by stage; each stage is one operator over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodegraph.llm import common, decontaminate, langid, mixing, near_copies, token_output


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, and those that the network places in no language with a score of 0.5.

    Null and empty texts go; a long text is judged whole; equal texts get equal verdicts, so ties and repeated rows stay
    or go together; nulls in other columns are kept as they are. An empty table, or one in which no row has a language
    to learn, gives no rows. All columns are returned, whatever their names.
    """
    return langid.in_a_language(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least id of each group linked by five-word shingles of Jaccard similarity 0.8 or more.

    Null counts as empty; texts without a word are one group; fewer than five words are one shingle; long texts are
    compared whole. Of rows that repeat id and text one stays, the least by its other columns; different texts of one
    id are different documents; rows of null id all stay. An empty table gives no rows; all columns are returned.
    """
    return near_copies.one_per_group(docs, shingle=5, percent=80)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten consecutive words of a benchmark item, or a whole shorter item.

    Null and empty texts hold nothing and stay; long texts are searched whole; of a doc_id, null included, all rows go
    if one holds a passage; repeated rows share their fate. An empty table or benchmark drops nothing; all columns are
    returned.
    """
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes words of each source up to its target weight: a row per document and turn, with the taken text.

    Null and empty texts have no words and no row; a null source is a source, the last; long texts are cut at blocks of
    32 words. Rows that repeat id and text take the same words, those of one of them; equal quotients go to the lesser
    name. An empty table gives no rows; all columns are returned, and n_chars, where there is one, follows the text.
    """
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the mix as bit-packed token files and returns their index.

    A null or empty text is the end id alone; long texts are encoded whole; rows of one id, null first, stand next to
    each other in order of a hash of their text, each with its own row. An empty table gives no rows; other columns are
    not read.
    """
    import public_tokenizers

    out = token_output.token_output(docs, tokenizer_path=public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return out.select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("language_id", language),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", benchmark_free),
    ("source_mixing", mixture),
    ("token_output", tokens),
]

#: Fingerprints, suffix arrays and a trained network have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
