"""From raw documents to packed sequences: the corpus pipeline.

Every stage takes ``(spark, docs, sf_dir)``, works on all documents that the stage before kept, and returns the
columns of the documents it keeps (the last one: pieces of sequences).  Extra columns travel along, whatever
their names; a stage on an empty table returns an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from listingspark.llm import language as lang_id, packing as packs, rules, simhash, superkmer
from listingspark.llm.common import stored
from listingspark.llm.queries import word_tokenizer

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

NEAR_WORDS = 5
NEAR_RADIUS = 24  # of 64 bits: where links are looked for; sets at 0.8 differ in 10 on average
NEAR_SIMILARITY = 0.8
NEAR_BANDS = (16, 4)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: learn languages from labelled rows, set ``lang`` to the prediction, drop what is rejected
    (no letter, null text, or no language closer than another)."""
    taken = set(docs.columns)
    names = tuple(next(n for n in (base + "_" * i for i in range(len(taken) + 1)) if n not in taken) for base in ("_said", "_score", "_rejected"))
    found = lang_id.classify(docs, lang_id.fit(docs), names=names).filter(~F.col(names[2]))
    return found.select(*[F.col(names[0]).alias(c) if c == "lang" else F.col(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: drop what fails the base rules or the threshold table."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs["text"].alias("_text"))
    return rules.judge(rows, "_text", keep=("_row",)).filter("kept").select("_row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: one document of each group of near-duplicates stays, the one with the smallest id.

    Links are looked for within 24 of 64 bits over distinct five-word shingles, in blocks of equal minima of shingle
    hashes, since bits alone can't block at that radius; a link stays where the sets of shingles have a
    Jaccard similarity of 0.8 or more.  Of repeated rows with one id one stays; a row without an id can't be
    named and stays.
    """
    found = simhash.near_duplicates(docs, words=NEAR_WORDS, radius=NEAR_RADIUS, bands=NEAR_BANDS, similarity=NEAR_SIMILARITY)
    first = found.filter("doc_id = component_id").select(F.col("doc_id").alias("_first")).distinct()
    named = docs.join(first, docs["doc_id"].cast("long") == first["_first"]).drop("_first")
    taken = set(docs.columns)
    place = next(n for n in ("_place" + "_" * i for i in range(len(taken) + 1)) if n not in taken)
    once = named.withColumn(place, F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))).filter(F.col(place) == 1).drop(place)
    return once.unionByName(docs.filter("doc_id IS NULL"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: cut the words of 13-word windows that an earlier document has; ``n_chars`` follows the text.

    A text that loses nothing stays as it is; one that loses all its words stays as an empty text.
    """
    others = tuple(c for c in docs.columns if c != "text")
    hidden = {c: f"_{i}" for i, c in enumerate(others)}
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"], *[docs[c].alias(hidden[c]) for c in others])
    found = superkmer.remove_repeats(rows, carry=tuple(hidden.values()), untouched=True)
    columns = {c: F.col(hidden[c]) for c in others}
    columns["text"] = F.col("kept")
    if "n_chars" in columns:
        columns["n_chars"] = F.length("kept").cast(docs.schema["n_chars"].dataType)
    return found.select(*[columns[c].alias(c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: one row per piece of a document in a sequence of 4,096 tokens."""
    return packs.pack(docs, word_tokenizer(), window=4096, end_id=2)


STAGES: list[tuple[str, Stage]] = [("language", language), ("quality", quality), ("near_dedup", near_dedup),
                                   ("substring_dedup", substring_dedup), ("packing", packing)]

# Languages by compression and tokens from a tokenizer file are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet and read again as the documents of the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
