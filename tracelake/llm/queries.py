"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.ann_curves import nearest
from tracelake.llm.binary_codes import near_duplicates
from tracelake.llm.common import stored, table
from tracelake.llm.conversation_repair import damaged, digests, repair_report, repaired
from tracelake.llm.license_scan import license_scan
from tracelake.llm.line_dedup import line_report
from tracelake.llm.lm_scoring import lm_scores
from tracelake.llm.mixing import mixed, plan, with_leaf
from tracelake.llm.ngram_join import ngram_join
from tracelake.llm.quality_classifier import quality_scores
from tracelake.llm.quality_rules import quality_rules
from tracelake.llm.sentencepiece_codec import round_trip
from tracelake.llm.token_counts import token_counts
from tracelake.llm.whitening import whiten


MIX_SHARE, MIX_EPOCHS, MIX_SEED = 0.6, 2, 1

#: Domain of a source, and the weights of the tree: both as SQL, for Spark and for the oracle.
MIX_DOMAIN = "concat('domain', cast(regexp_extract(source, '([0-9]+)', 1) as int) % 4)"
MIX_WEIGHTS = {
    "domain": "case domain when 'domain0' then 4 when 'domain1' then 3 when 'domain2' then 2 else 1 end",
    "lang": "case lang when 'en' then 5 when 'fr' then 2 when 'de' then 2 else 1 end",
    "source": "case when source = 'src0' then 2 else 1 end",
}


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_leaf(table(spark, sf_dir, "documents"), F.expr(MIX_DOMAIN))
    light = stored(docs.select("m_id", "m_domain", "m_lang", "m_source", "m_tokens"))  # without texts
    leaves = plan(light, {k: F.expr(v) for k, v in MIX_WEIGHTS.items()}, MIX_SHARE, MIX_EPOCHS, MIX_SEED)
    rows = mixed(light, leaves, MIX_EPOCHS, MIX_SEED)
    return rows.select(F.col("m_id").alias("doc_id"), F.col("m_domain").alias("domain"), F.col("m_lang").alias("lang"), F.col("m_source").alias("source"), F.col("m_tokens").alias("n_tokens"), F.col("m_epoch").cast("long").alias("epoch"))


def _share_out_sql(level: str, keys: str, parent: str, above: str) -> str:
    by = f"partition by {parent}" if parent else ""
    join = f"join {above} using ({parent})" if parent else f"cross join {above}"
    return f"""
    {level}_0 as (
      select {keys}, sum(tokens) * {float(MIX_EPOCHS)}::double as capacity from leaves group by {keys}),
    {level}_1 as (
      select n.*, cast({MIX_WEIGHTS[level]} as double) as weight, budget as parent_budget from {level}_0 n {join}),
    {level}_2 as (
      select *, capacity / weight as per,
        coalesce(sum(capacity) over (w rows between unbounded preceding and 1 preceding), 0) as taken,
        coalesce(sum(weight) over (w rows between unbounded preceding and 1 preceding), 0) as served,
        sum(weight) over ({by}) as weights
      from {level}_1 window w as ({by} order by capacity / weight, {keys})),
    {level}_3 as (select *, (parent_budget - taken) / (weights - served) as lev from {level}_2),
    {level}_4 as (select *, min(case when lev < per then struct_pack(served := served, lev := lev) end) over ({by}) as first_open from {level}_3),
    {level}_b as (select {keys}, case when lev >= per then capacity else first_open.lev * weight end as budget from {level}_4)"""


ORACLE_MIX = f"""
with docs as (
  select doc_id, coalesce(lang, '(none)') as lang, coalesce(source, '(none)') as source,
    coalesce({MIX_DOMAIN}, '(none)') as domain,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as tokens
  from documents),
leaves as (select domain, lang, source, sum(tokens)::bigint as tokens from docs group by all),
total as (select sum(tokens) * {MIX_SHARE}::double as budget from leaves),
{_share_out_sql("domain", "domain", "", "total")},
{_share_out_sql("lang", "domain, lang", "domain", "domain_b")},
{_share_out_sql("source", "domain, lang, source", "domain, lang", "lang_b")},
leaf as (
  select *, least({MIX_EPOCHS}, floor(budget / greatest(tokens, 1) + 1e-9))::int as epochs
  from leaves join source_b using (domain, lang, source)),
planned as (select *, greatest(0, floor(budget - epochs * tokens + 1e-6)) as rest from leaf),
ordered as (
  select d.*, epochs, rest, sum(d.tokens) over (partition by d.domain, d.lang, d.source
    order by md5('{MIX_SEED}:' || (epochs + 1) || ':' || doc_id), doc_id) as run
  from docs d join planned p using (domain, lang, source)),
taken as (
  select *, epochs + case when epochs < {MIX_EPOCHS} and run <= rest then 1 else 0 end as times from ordered)
select doc_id, domain, lang, source, tokens as n_tokens, unnest(range(1, times + 1)) as epoch from taken
"""


def op2_ann_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality_rules(table(spark, sf_dir, "documents"), trusted)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of pieces and a hash of the ids of every text, and whether they decode to the text again."""
    rows = round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), "round_trip")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"), n=3, percent=90).select("doc_id", "n_shingles", "component_id")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def _remainder(n: int):
    """crc32 of doc_id as text, modulo n."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), _remainder(5) == 0)


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"), _remainder(7) != 2)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every original conversation's faults after damage, the cheapest repair, and a hash of the repaired rows."""
    original = table(spark, sf_dir, "conversations")
    rows = damaged(original)
    report = stored(repair_report(rows))
    ids = original.select(F.col("conv_id").cast("long").alias("id")).distinct()
    out = ids.join(report, F.col("id").eqNullSafe(F.col("conv_id")), "left").drop("conv_id").withColumnRenamed("id", "conv_id")
    hashes = digests(repaired(rows, report)).withColumnRenamed("conv_id", "id")
    out = out.join(hashes, F.col("conv_id").eqNullSafe(F.col("id")), "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"), components=16)


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.95)


QUERIES = {
    f.__name__: f
    for f in (op1_mixing, op2_ann_curves, op3_quality_rules, op4_sentencepiece, op5_line_dedup, op6_ngram_join, op7_license_scan, op8_token_counts, op9_quality_classifier, op10_lm_scoring, op11_conversation_repair, op12_embedding_whitening, op13_embedding_dedup)
}
ORACLE_SQL: dict[str, str] = {"op1_mixing": ORACLE_MIX}
