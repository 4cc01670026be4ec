"""Registered queries of the numbered operators: (spark, folder of tables) -> DataFrame."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from staycoder.llm.arc_to_warc import convert, read_arc, warc_index, write_arc
from staycoder.llm.conversation_trie import conversation_trie
from staycoder.llm.decontamination import leaks
from staycoder.llm.filter_audit import filter_audit
from staycoder.llm.jaccard_join import jaccard_groups
from staycoder.llm.line_dedup import removed_lines
from staycoder.llm.mixing import MixConfig, mix
from staycoder.llm.page_difference import main_text
from staycoder.llm.pii import pii_digest
from staycoder.llm.suffix_dedup import remove_repeats
from staycoder.llm.token_output import token_index, write_tokens
from staycoder.llm.topk import exact_topk
from staycoder.llm.toxicity import toxicity
from staycoder.sources.shared import shared_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents")).drop("kept")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(_table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity(docs, _table(spark, sf_dir, "labels")).select("doc_id", "p_quality", "p_toxic", "is_toxic")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_lines(_table(spark, sf_dir, "documents"))


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk(_table(spark, sf_dir, "embeddings"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as a legacy archive, converted to WARC, and the index read back from the WARC files."""
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_arc(_table(spark, sf_dir, "pages"), f"{folder}/arc", version=2)
    convert(read_arc(spark, f"{folder}/arc"), f"{folder}/warc")
    return warc_index(spark, f"{folder}/warc")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(_table(spark, sf_dir, "documents"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """TOKENIZER_DIR if set, else the folder of the public_tokenizers package, which all hosts have."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def source_domain(source: str = "source") -> Column:
    """The first ten sources are the web, the others curated collections."""
    number = F.regexp_extract(source, r"([0-9]+)$", 1)
    return F.when((number != "") & (F.length(number) == 1), "web").otherwise("curated")


#: Half of all tokens; curated sources and the smaller languages count for more than they hold.
MIX = MixConfig(
    weights={("web",): 0.55, ("curated",): 0.45}
    | {(d, lang): w for d in ("web", "curated") for lang, w in (("en", 5.0), ("de", 2.0), ("fr", 2.0), ("es", 1.0))},
    share=0.5,
    max_epochs=3,
)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(_table(spark, sf_dir, "documents"), MIX, {"domain": source_domain()})
    return mixed.select("doc_id", source_domain().alias("domain"), "lang", "source", "mix_epoch", "mix_tokens")


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(_table(spark, sf_dir, "documents"), path, tokenizer_path())
    return token_index(spark, path)


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(_table(spark, sf_dir, "pages"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(_table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_pii": op2_pii,
    "op3_toxicity": op3_toxicity,
    "op4_line_dedup": op4_line_dedup,
    "op5_exact_topk": op5_exact_topk,
    "op6_warc": op6_warc,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_decontamination": op8_decontamination,
    "op9_mixing": op9_mixing,
    "op10_token_output": op10_token_output,
    "op11_html_extraction": op11_html_extraction,
    "op12_filter_audit": op12_filter_audit,
    "op13_conversation_trie": op13_conversation_trie,
}
