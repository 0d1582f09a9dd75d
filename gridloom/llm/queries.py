"""The operators over their whole tables, with production parameters: opN_<name>(spark, sf_dir)."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import read
from gridloom.llm.decontaminate import find_leaks
from gridloom.llm.fingerprints import fingerprint_documents
from gridloom.llm.html_blocks import extract
from gridloom.llm.jaccard import near_components
from gridloom.llm.licenses import scan_licenses
from gridloom.llm.line_dedup import dedup_lines
from gridloom.llm.packing import pack
from gridloom.llm.quality import score_documents
from gridloom.llm.shards import assign_shards
from gridloom.llm.warc import round_trip

TOKENIZER = "word_bpe_49k.json"


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = assign_shards(read(spark, sf_dir, "documents"), 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(read(spark, sf_dir, "documents"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read(spark, sf_dir, "documents"))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(read(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(read(spark, sf_dir, "documents"))


def op8_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_shard, op3_pack, op4_fingerprint, op5_licenses, op6_jaccard, op7_line_dedup, op8_extract, op9_quality, op10_warc)}

_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_GRAMS = "unnest(list_distinct(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ') || ' .'] else [] end))"
ORACLE_SQL = {
    "op1_decontaminate": f"""
with d as (select doc_id, {_GRAMS} as s from (select doc_id, {_WORDS} as w from documents)),
b as (select item_id, {_GRAMS} as s from (select item_id, {_WORDS} as w from benchmark)),
n as (select item_id, count(*) as n_item from b group by item_id)
select doc_id, item_id, count(*) as n_shared, any_value(n_item) as n_item, cast(count(*) as double) / any_value(n_item) as containment
from d join b using (s) join n using (item_id) group by doc_id, item_id having count(*) >= 0.8 * any_value(n_item)""",
    "op10_warc": """
select page_id, strlen(coalesce(html, '')) as payload_bytes, sha256(coalesce(html, '')) as payload_digest,
 case when strlen(html) >= 100 and page_id <> first then 'revisit' else 'response' end as record_type,
 case when strlen(html) >= 100 and page_id <> first then first end as refers_to
from (select *, min(page_id) over (partition by html) as first from pages)""",
}
