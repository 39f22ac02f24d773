"""The registered queries of this subpackage: thin layers over its operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontam, exactdedup, html_extract, lengths, licences, lid, neardup, pii
from .common import table


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Path of a public tokenizer's file, which the installed package names."""
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out(doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = lid.train(docs.where(~held_out()))
    found = lid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exactdedup.exact_groups(docs, carry={"text_sha256": F.sha2(F.coalesce("text", F.lit("")), 256)})


OP9_SQL = """
select doc_id, sha256(coalesce(text, '')) as text_sha256,
       max(doc_id) over (partition by coalesce(text, '')) as keep_id,
       count(*) over (partition by coalesce(text, '')) as group_size,
       doc_id = max(doc_id) over (partition by coalesce(text, '')) as kept
from documents
"""


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode_table(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary())
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontam.matches(docs.select("doc_id", "text"), items)


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.extract(pages)


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.conversations(said.unionByName(own)))


OP5_SQL = r"""
with said as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), escaped as (
  select *, length(role) + length(text) + length('<|turn|>') + 1 + length('<|end|>') + 1
    + length(role) - length(replace(replace(role, '\', ''), chr(10), ''))
    + len(regexp_extract_all(role, '{control}')) + len(regexp_extract_all(text, '{control}')) as chars
  from said
)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
       sum(chars)::bigint as formatted_chars
from escaped group by conv_id
""".replace("{control}", rf"<\\*(?:{chat.AFTER_ANGLE})|\[\\*{chat.AFTER_BRACKET}")


#: A fixed key, so that results can be compared; a real run passes its own secret.
PII_KEY = b"public test key"


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, PII_KEY).withColumn("n_replaced", F.size("pii").cast("long"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.histogram(lengths.encoded_lengths(table(spark, sf_dir, "documents"), vocabulary()))


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licences.scan(docs, licences.train(docs))


QUERIES = {"op3_pii": op3_pii, "op4_token_counts": op4_token_counts, "op10_licences": op10_licences, "op1_html_text": op1_html_text, "op5_chat": op5_chat, "op2_decontaminate": op2_decontaminate, "op8_near_dedup": op8_near_dedup, "op7_language_id": op7_language_id, "op9_exact_dedup": op9_exact_dedup, "op6_bpe": op6_bpe}
ORACLE_SQL = {"op5_chat": OP5_SQL, "op9_exact_dedup": OP9_SQL}
