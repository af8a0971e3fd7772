"""The queries that apply this subpackage's operators to the tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.llm import bpe, chat, html_text, minhash, mixing, negatives, pii, quality, spelling, spotsigs, tiles, toxicity, urls
from gridlake.llm.common import table


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.line_frequency(table(spark, sf_dir, "documents"))


#: A conversation whose texts hold control strings; fixed values.
CONTROL_TURNS = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = turns.unionByName(spark.createDataFrame(CONTROL_TURNS, "conv_id long, turn long, role string, text string"))
    path = vocabulary("byte_bpe_50k.json")
    return chat.read_back(chat.format_conversations(turns, path), path, in_order=True).drop("n_ids")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.score(docs, toxicity.train(docs, labels))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.encode_documents(docs, vocabulary(), results=["n_tokens", "ids_sha256", "decoded_sha256"])


def op5_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.with_next(table(spark, sf_dir, "documents"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


#: Weights that sources take in turn, and the share of all words that the mix holds.
WEIGHTS, SHARE = [5.0, 2.0, 1.0], 1.5


def importance() -> Column:
    """Longer documents are likelier to be taken: by the logarithm of n_chars, which is positive also for null."""
    return F.log(F.greatest(F.coalesce(F.col("n_chars"), F.lit(0)), F.lit(0)) + F.lit(2.0))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mixed = mixing.mix(docs, WEIGHTS, SHARE, importance=importance(), keep=["doc_id"])
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    listed = urls.listed_by_words(pages, urls.BLOCK_WORDS)
    judged = urls.judge(pages, listed, urls.RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "listed")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


#: Anchors are the vectors whose id is divisible by the first number; where it is divisible by the second, the label is moved on by one.
ANCHOR_EVERY, TWIST_EVERY = 100, 7


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    twisted = F.when(F.col("vec_id") % TWIST_EVERY == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings"), F.col("id") % ANCHOR_EVERY == 0, label=twisted)


def op13_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {"op1_quality": op1_quality, "op2_chat": op2_chat, "op3_toxicity": op3_toxicity, "op4_bpe": op4_bpe, "op5_spotsigs": op5_spotsigs, "op6_minhash": op6_minhash, "op7_pii": op7_pii, "op8_urls": op8_urls, "op9_mixing": op9_mixing, "op10_html": op10_html, "op11_spelling": op11_spelling, "op12_negatives": op12_negatives, "op13_tiles": op13_tiles}
ORACLES: dict[str, str] = {
    "op1_quality": quality.SQL, "op2_chat": chat.SQL, "op8_urls": urls.sql(urls.RULES, urls.BLOCK_WORDS),
    "op12_negatives": negatives.SQL.format(every=ANCHOR_EVERY, twist=TWIST_EVERY), "op13_tiles": tiles.SQL,
}
