"""Registered queries of the training-data operators; each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@register
def op3_packing(spark: SparkSession, sf: str) -> DataFrame:
    """All documents packed into sequences of 4,096 tokens."""
    from .packing import pack

    return pack(table(spark, sf, "documents"), word_tokenizer(), window=4096, end_id=2)


@register
def op4_token_files(spark: SparkSession, sf: str) -> DataFrame:
    """All documents written as token files and read back."""
    from .token_files import read_token_files, write_token_files

    return read_token_files(write_token_files(table(spark, sf, "documents"), word_tokenizer(), end_id=1), with_ids=False)


@register
def op1_simhash(spark: SparkSession, sf: str) -> DataFrame:
    """Near-duplicate classes of all documents: four-word shingles, four bits."""
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf, "documents"), words=4, radius=4)


@register
def op9_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics and verdict of every document."""
    from .rules import judge

    return judge(table(spark, sf, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@register
def op8_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """All documents without the words of 13-word windows that an earlier document has."""
    from pyspark.sql import functions as F

    from .superkmer import remove_repeats

    return remove_repeats(table(spark, sf, "documents"), window=13).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@register
def op5_language(spark: SparkSession, sf: str) -> DataFrame:
    """Language of every document, learnt from those that are not held out."""
    from pyspark.sql import functions as F

    from .language import classify, fit

    docs = table(spark, sf, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    learn = F.crc32(F.col("doc_id").cast("string")) % 5 != 0
    found = classify(docs.select("doc_id", "text"), fit(docs, learn), carry=["doc_id"])
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@register
def op6_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    """Main text of every page."""
    from pyspark.sql import functions as F

    from .extraction import extract

    return extract(table(spark, sf, "pages")).withColumn("n_chars", F.length("text").cast("long"))


@register
def op2_winnowing(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    from .winnowing import compare_edited

    return compare_edited(table(spark, sf, "documents"))


@register
def op7_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    """All conversations, and one of control strings, formatted and read back."""
    from pyspark.sql import functions as F

    from listingspark.stages import once_sql

    from .chat import canonical_turns, format_turns, read_loss, read_turns, records_of

    said = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT -1L AS conv_id, col1 AS turn, col2 AS role, '{said}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant')")
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    formatted = format_turns(canonical_turns(records_of(rows), "record", ("conv_id",)))
    read = once_sql(formatted.select("conv_id", "formatted", "loss_spans"), {
        "turns": read_turns("formatted"), "loss": f"array_join({read_loss('formatted', 'loss_spans')}, '')"})
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.expr("sha2(array_join(transform(turns, t -> concat(t.role, '\n', t.text, '\n')), ''), 256)").alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))


@register
def op10_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """All documents as pieces by seeded merge-dropout, and decoded again."""
    import public_tokenizers
    from pyspark.sql import functions as F

    from .pieces import decode, encode

    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf, "documents")
    encoded = encode(docs, model, dropout=0.1, seed=42).withColumn("ids_xxhash64", F.xxhash64("ids")).withColumn("n_ids", F.size("ids").cast("long"))
    return decode(encoded, model, keep=("doc_id", "n_ids", "ids_xxhash64")).select(
        "doc_id", "n_ids", "ids_xxhash64", F.length("decoded").cast("long").alias("n_chars"), F.sha2("decoded", 256).alias("decoded_sha256"))


@register
def op11_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Periodic runs of every document, a tenth of which are made periodic first."""
    from pyspark.sql import functions as F

    from listingspark.stages import once_sql

    from .periodic import periodic_runs

    docs = once_sql(table(spark, sf, "documents").select("doc_id", "text"), {"h": "crc32(cast(doc_id AS string))"})
    planted = "h % 10 = 0"
    docs = once_sql(docs, {"words": f"if({planted}, filter(split(text, '[ \\t-\\r]+'), w -> w <> ''), null)"})
    docs = once_sql(docs, {"n": "size(words)", "g": "h div 10"})
    docs = once_sql(docs, {"a": "if(n > 0, g % n, 0)"})
    docs = once_sql(docs, {"p": "1 + (n - a) div (3 + g % 8)"})
    repeated = "array_join(transform(sequence(0L, n - 1L), i -> words[int(if(i < a, i, a + (i - a) % p))]), ' ')"
    docs = docs.selectExpr("doc_id", f"if(n > 0, {repeated}, text) AS text")
    return periodic_runs(docs).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.expr("sha2(array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), ''), 256)").alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


@register
def op12_structure(spark: SparkSession, sf: str) -> DataFrame:
    """All conversations, damaged by a hash of their rows, and repaired."""
    from pyspark.sql import functions as F

    from .structure import joined_sha256, repair

    rows = table(spark, sf, "conversations")
    hit = "pmod(crc32(concat(coalesce(cast(conv_id AS string), ' '), ':', coalesce(cast(turn AS string), ' '))), 20)"
    damaged = rows.selectExpr("conv_id", "turn", "coalesce(role, ' ') AS role", "coalesce(text, ' ') AS text", f"{hit} AS hit").filter("hit <> 0").selectExpr(
        "conv_id", "turn", "if(hit = 4, 'user', role) AS role", "CASE hit WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text",
        "explode(array_repeat(0, if(hit = 3, 2, 1))) AS copy").drop("copy")
    conversations, turns = repair(damaged)
    found = conversations.alias("f").join(joined_sha256(turns).alias("t"), F.expr("f.conv_id <=> t.conv_id")).drop(F.col("t.conv_id"))
    return rows.select("conv_id").distinct().alias("o").join(found.alias("f"), F.expr("o.conv_id <=> f.conv_id"), "left").select(
        "o.conv_id", *[F.coalesce(F.col(f"f.{c}"), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("f.audit", F.lit("")).alias("audit"), F.coalesce("f.repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


@register
def op13_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    """Words of all documents that lie in passages of ten words of the benchmark's items."""
    from pyspark.sql import functions as F

    from .decontamination import decontaminate

    return decontaminate(table(spark, sf, "documents"), table(spark, sf, "benchmark"), window=10).select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def _oracles() -> None:
    from . import chat, decontamination, rules, structure

    ORACLES["op7_chat_format"] = chat.oracle()
    ORACLES["op9_quality_rules"] = rules.oracle()
    ORACLES["op12_structure"] = structure.oracle()
    ORACLES["op13_decontamination"] = decontamination.oracle()


_oracles()
