"""The registered queries of the training-data operators and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, exact_dedup, licences, pieces, secrets, simhash, token_counts, toxicity, wrappers
from .common import new_path, table, text_of


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.context_limits(token_counts.length_histogram(table(spark, sf_dir, "documents")))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _listed(spans: Column) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"), new_path(spark, "secret-ledger"))
    base = [r.kind for r in secrets.BASE]

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    own = F.filter("spans", lambda s: s["kind"].isin(base))
    return found.select(F.col("doc_id").cast("long"), *map(number, base), F.sha2(_listed(own), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def _rule_sql(k: int, rule: secrets.Rule) -> str:
    pattern = rule.pattern.replace("'", "''")
    length = f"list_transform(list_slice(m, 1, i), lambda x: length(x))"
    return f"""select doc_id, {k} as k, '{rule.kind}' as kind,
      list_sum(list_transform(list_slice(p, 1, i), lambda x: length(x))) + coalesce(list_sum({length}), 0) - length(m[i]) as s,
      list_sum(list_transform(list_slice(p, 1, i), lambda x: length(x))) + coalesce(list_sum({length}), 0) as e, g[i] as g
    from (select *, unnest(generate_series(1, len(m))) as i from (
      select doc_id, regexp_extract_all(t, '{pattern}', 0) as m, regexp_extract_all(t, '{pattern}', {rule.group}) as g, string_split_regex(t, '{pattern}') as p
      from t where regexp_matches(t, '{pattern}')))
    where length(g[i]) >= {rule.least}"""


_NL = " union all "
OP3_SQL = f"""
with t as (select doc_id, coalesce(text, '') as t from documents),
spans as ({_NL.join(_rule_sql(k, r) for k, r in enumerate(secrets.RULES))}),
named as (select *, concat(kind, ':', cast(s as bigint), ':', cast(e as bigint)) as name from spans)
select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
  sha256(coalesce(string_agg(name, ',' order by s, k) filter (k < {len(secrets.BASE)}), '')) as base_sha256, coalesce(string_agg(name, ',' order by s, k), '') as spans
from documents left join named using (doc_id) group by doc_id
"""


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = wrappers.main_text(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_dedup.duplicate_groups(table(spark, sf_dir, "documents"), digests=True)
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.col("full").alias("text_sha256"))


OP5_SQL = """
select doc_id, max(doc_id) over (partition by coalesce(text, '')) as keep_id,
  count(*) over (partition by coalesce(text, '')) as group_size,
  doc_id = max(doc_id) over (partition by coalesce(text, '')) as kept, sha256(coalesce(text, '')) as text_sha256
from documents
"""


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.summarize(table(spark, sf_dir, "documents"))


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    weights, intercept = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, weights, intercept).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.windows(told.unionByName(extra)))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_simhash, op3_secrets, op4_html, op5_exact_dedup, op6_sentencepiece, op7_licences, op8_decontamination, op9_toxicity, op10_chat)}
ORACLES = {"op3_secrets": OP3_SQL, "op5_exact_dedup": OP5_SQL}
