"""Registered queries over the test tables, each with its DuckDB oracle where SQL has one.

Roles: documents with the year of the order of the same number are articles;
customers are authors, nations institutions within regions, parts topics.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import AnalysisConfig, IngestConfig
from ..functions import ids, text
from ..functions.numbers import eta_seconds, page_count
from ..operators import counting, dedupe, grams, normalize, sampling, shards, variation
from ..schema import TABLES, WORK_DDL, struct
from ..sources import pages, sinks
from ..sources.scan import scan
from .analysis import TemporalAnalysis
from .ingest import table_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Settings under which every prune reason but one occurs in the test data.
CONFIG = AnalysisConfig(ngram_range=(1, 1), min_estimated_total=10.0, stop_words=False, contractions=False)
BASE = ids.BASE


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str, language: str | None = "en") -> DataFrame:
    """(article_id, publication_year, language, source, abstract)."""
    docs = scan(spark, f"{sf_dir}/documents.parquet", ["doc_id", "lang", "source", "text"])
    years = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.year("o_orderdate").alias("publication_year"))
    out = docs.join(years, "doc_id").select(F.col("doc_id").alias("article_id"), "publication_year", F.col("lang").alias("language"), "source", F.col("text").alias("abstract"))
    return out.where(F.col("language") == language) if language else out


def _analysis(spark: SparkSession, sf_dir: str, **changes) -> TemporalAnalysis:
    return TemporalAnalysis(articles(spark, sf_dir), CONFIG.with_(**changes))


_CLEAN = "trim(regexp_replace(lower(coalesce(text, '')), '[^a-z]+', ' ', 'g'))"
_DOCS = f"d as (select doc_id, cast(year(o_orderdate) as int) as y, {_CLEAN} as c from documents join orders on doc_id = o_orderkey where lang = 'en')"
_WORDS = f"{_DOCS}, t as (select doc_id, y, unnest(string_split(c, ' ')) as g from d where c <> '')"
_FREQ = f"{_WORDS}, n as (select g, y, count(*) as k from t group by 1, 2), tot as (select y, count(*) as n from t group by 1), f as (select g, y, k, (k::double / n) * 1000 as f from n join tot using (y))"
_FOLD = f"{_FREQ}, r as (select g as ngram, sum(k)::bigint as total_frequency, max(f) as max_frequency, min(f) as min_frequency, max_by(y, (f, -y)) as max_year, min_by(y, (f, y)) as min_year, count(*) as years_present, max(f) / min(f) as fold_change from f group by 1 having count(*) >= 2)"


@query(f"select doc_id, {_CLEAN} as clean from documents")
def clean_text(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", text.clean_text(F.col("text")).alias("clean"))


@query(f"with {_DOCS} select y as publication_year, count(*) as year_doc_count, sum(len(string_split(c, ' ')))::bigint as year_word_count from d where c <> '' group by 1")
def word_count_by_year(spark, sf_dir):
    return counting.year_totals(_analysis(spark, sf_dir).clean)


@query(f"""with {_DOCS}, w as (select y, string_split(c, ' ') as w from d where c <> ''),
 t as (select y, unnest(w) as g from w
  union all select y, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) from w
  union all select y, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) from w)
 select g as ngram, y as publication_year, count(*) as count from t group by 1, 2""")
def ngram_year_counts(spark, sf_dir):
    return counting.tallied_counts(_analysis(spark, sf_dir, ngram_range=(1, 3)).tally)  # read once, so not staged


_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
_SPLIT = "c"
for _whole, _parts in text.CONTRACTIONS.items():
    _SPLIT = f"regexp_replace({_SPLIT}, '\\b{_whole}\\b', '{_parts}', 'g')"


@query(f"""with {_DOCS}, w as (select y, list_filter(string_split({_SPLIT}, ' '), lambda x: x not in ({_STOP})) as w from d where c <> ''),
 t as (select y, unnest(w) as g from w union all select y, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) from w)
 select g as ngram, y as publication_year, count(*) as count from t group by 1, 2""")
def ngram_stopword_counts(spark, sf_dir):
    return counting.tallied_counts(_analysis(spark, sf_dir, ngram_range=(1, 2), stop_words=True, contractions=True).tally)


@query(f"with {_WORDS} select g as ngram, count(*) as total_frequency, count(distinct y)::int as years_present from t group by 1")
def global_ngram_counts(spark, sf_dir):
    return counting.global_counts(counting.year_counts(_analysis(spark, sf_dir).occurrences))


@query(f"with {_FREQ} select g as ngram, y as publication_year, f as normalized_frequency from f")
def normalized_frequency(spark, sf_dir):
    return _analysis(spark, sf_dir).frequencies.select("ngram", "publication_year", "normalized_frequency")


@query(f"with {_FOLD} select * from r")
def fold_change_stats(spark, sf_dir):
    return variation.fold_changes(_analysis(spark, sf_dir).frequencies)


@query(f"with {_FOLD} select * from r order by fold_change desc, ngram limit 20")
def top20_fold_change(spark, sf_dir):
    return variation.top(variation.fold_changes(_analysis(spark, sf_dir).frequencies))


@query(f"with {_FOLD} select g as ngram, y as year, f as normalized_frequency, fold_change from f join r on g = ngram")
def yearly_frequency_series(spark, sf_dir):
    freqs = _analysis(spark, sf_dir).frequencies
    series = freqs.groupBy("ngram").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("publication_year", "normalized_frequency")))).alias("m"))
    return series.join(variation.fold_changes(freqs).select("ngram", "fold_change"), "ngram").select("ngram", F.explode("m").alias("year", "normalized_frequency"), "fold_change")


@query(f"with {_WORDS} select distinct g as ngram, doc_id as article_id from t")
def ngram_articles(spark, sf_dir):
    return _analysis(spark, sf_dir).mapping


@query(f"with {_WORDS}, p as (select distinct g, doc_id from t) select g as ngram, doc_id // 65536 as part, string_agg(doc_id::varchar, ',' order by doc_id) as article_ids from p group by 1, 2")
def ngram_article_sets(spark, sf_dir):
    """Sorted id arrays of all n-grams; a frequent one has several, one for each 65,536 ids."""
    found = counting.article_sets(_analysis(spark, sf_dir).mapping)
    return found.select("ngram", "part", F.array_join(F.col("article_ids").cast("array<string>"), ",").alias("article_ids"))


@query(f"""with {_DOCS}, w as (select y, list_transform(string_split(c, ' '), lambda x: coalesce(nullif(regexp_replace(x, '(ing|ed)$', ''), ''), x)) as w from d where c <> ''),
 t as (select y, unnest(w) as g from w union all select y, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) from w)
 select g as ngram, y as publication_year, count(*) as count from t group by 1, 2""")
def lemmatised_counts(spark, sf_dir):
    found = articles(spark, sf_dir)
    said = counting.cleaned(found).select(F.explode(text.words(F.col("clean"))).alias("word")).distinct()
    lemmas = said.select("word", F.regexp_replace("word", "(ing|ed)$", "").alias("lemma")).where("lemma not in ('', word)")
    return counting.tallied_counts(TemporalAnalysis(found, CONFIG.with_(ngram_range=(1, 2)), lemmas=lemmas).tally)


@query("select count(*) as with_year, sum(o_totalprice)::bigint as price, max(cast(year(o_orderdate) as int)) as last_year from orders")
def scalar_totals(spark, sf_dir):
    from ..operators.joining import with_scalars

    orders = _table(spark, sf_dir, "orders")
    counted = orders.agg(F.count("*").alias("with_year"), F.floor(F.sum("o_totalprice") + 0.5).alias("price"))
    return with_scalars(counted, orders.agg(F.max(F.year("o_orderdate")).alias("last_year")))


# Quantiles of Beta(a, b) for whole a and b: its distribution function is a binomial sum, bisected here.
_Q = """{name} as (select 0 as i, a, b, p, 0::double as lo, 1::double as hi, 0.5::double as mid from (select distinct a, b from {pairs}), (select unnest([0.025::double, 0.975::double]) as p)
  union all select i + 1, a, b, p, if(f < p, mid, lo), if(f < p, hi, mid), if(f < p, mid + hi, lo + mid) / 2
  from (select *, 1 - list_sum(list_transform(range(0, a), lambda k: exp(lgamma(a + b) - lgamma(k + 1) - lgamma(a + b - k) + k * ln(mid) + (a + b - 1 - k) * ln(1 - mid)))) as f from {name} where i < 70)),
 {name}_at as (select a, b, max(mid) filter (p < 0.5) as low, max(mid) filter (p > 0.5) as high from {name} where i = 70 group by 1, 2)"""
_STATS = (
    f"with recursive {_FREQ.removeprefix('with ')}, bp as (select distinct k + 1 as a, tot.n - k + 1 as b from n join tot using (y)), "
    + _Q.format(name="bq", pairs="bp")
    + """, bounds as (select g, f.y, k, f.f, tot.n as words, low * 1000 as lower, high * 1000 as upper from f join tot using (y) join bq_at on a = k + 1 and b = tot.n - k + 1),
 sizes as (select count(*) filter (c <> '') as processed, count(*) as total from d),
 g as (select g, sum(k)::bigint as c, count(*)::int as years from n group by 1),
 gp as (select distinct c + 1 as a, processed - c + 1 as b from g, sizes where processed - c + 1 > 0), """
    + _Q.format(name="gq", pairs="gp")
    + """, power as (select g, c, years, high * total as upper, coalesce(high * total > 10, false) as has_power from g cross join sizes left join gq_at on a = c + 1 and b = processed - c + 1),
 seen as (select g, count(*) as present, max(upper) as u, min(lower) as l from bounds group by 1),
 fold as (select g, if(present < (select count(*) from tot), greatest(u, 975), u) / if(present < (select count(*) from tot), least(l, 25), l) as fold from seen)"""
)


def _reasons(fold: float) -> str:
    return f", pruned as (select g, case when years < 3 then 'insufficient_years' when not has_power then 'no_statistical_power' when fold < {fold} then 'no_fold_change' end as reason from power join fold using (g))"


_FINAL = (
    _STATS
    + _reasons(2.0)
    + """, fp as (select distinct c + 1 as a, greatest(1, processed - c + 1) as b from g, sizes), """
    + _Q.format(name="fq", pairs="fp")
    + """, peaks as (select g, max(f) as max_frequency, min(f) as min_frequency, max_by(struct_pack(y := y, l := lower, u := upper), (f, -y)) as top, min_by(struct_pack(y := y, l := lower, u := upper), (f, y)) as dip,
   count(*)::int as years_present, sum(k)::bigint as total_frequency, string_agg(y || ':' || printf('%.6f', f), ',' order by y) as yearly_frequencies from bounds where g in (select g from pruned where reason is null) group by 1 having count(*) >= 2),
 final as (select g as ngram, max_frequency / min_frequency as fold_change, top.l / dip.u as fold_change_ci_lower, top.u / dip.l as fold_change_ci_upper, max_frequency, min_frequency, top.y as max_year, dip.y as min_year, years_present, total_frequency,
   years_present as document_frequency, low * total as estimated_total_count_lower, yearly_frequencies from peaks cross join sizes join fq_at on a = total_frequency + 1 and b = greatest(1, processed - total_frequency + 1)),
 flagged as (select *, estimated_total_count_lower > 10 as sufficient_power, fold_change_ci_lower >= 2 and estimated_total_count_lower > 10 as statistically_significant from final)"""
)
#: Digits after the point to which columns that rest on quantiles are compared; upper ends of intervals are large.
_ROUNDED = {"fold_change_ci_lower": 5, "fold_change_ci_upper": 3, "estimated_total_count_lower": 5}
_EXPORTED = ", ".join(f"round({c}, {_ROUNDED[c]}) as {c}" if c in _ROUNDED else c for c in sinks.CSV_COLUMNS)


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, _ROUNDED.get(c, 6)) for c in columns})


@query(f"{_STATS} select g as ngram, y as publication_year, k as count, round(lower, 6) as freq_lower, round(upper, 6) as freq_upper from bounds")
def year_bounds(spark, sf_dir):
    return _rounded(_analysis(spark, sf_dir).bounds.select("ngram", "publication_year", "count", "freq_lower", "freq_upper"), "freq_lower", "freq_upper")


@query(f"{_STATS} select g as ngram, c as total_frequency, years as years_present, round(upper, 6) as estimated_total_count_upper, has_power from power")
def power_test(spark, sf_dir):
    own = _analysis(spark, sf_dir)
    return _rounded(variation.power(counting.global_counts(own.counts), own.sizes, own.config), "estimated_total_count_upper")


@query(f"{_STATS}{_reasons(4.0)} select reason, count(*) as n from pruned where reason is not null group by 1")
def prune_reasons(spark, sf_dir):
    return variation.reason_counts(_analysis(spark, sf_dir, min_fold_change=4.0).pruned)


@query(f"{_FINAL} select {_EXPORTED}, yearly_frequencies, sufficient_power, statistically_significant from flagged")
def final_statistics(spark, sf_dir):
    each = F.transform(F.map_entries("yearly_frequencies"), lambda e: F.concat(e["key"].cast("string"), F.lit(":"), F.format_string("%.6f", e["value"])))
    return _rounded(_analysis(spark, sf_dir).results.withColumn("yearly_frequencies", F.array_join(each, ",")), *_ROUNDED)


@query(f"{_FINAL} select {_EXPORTED} from flagged where statistically_significant")
def significant_export(spark, sf_dir):
    return _rounded(_analysis(spark, sf_dir).significant, *_ROUNDED)


@query(f"{_FINAL} select ngram, y as year, f as normalized_frequency, fold_change, round(estimated_total_count_lower, 5) as estimated_total_count_lower, statistically_significant as significant from flagged join f on g = ngram")
def timeseries_export(spark, sf_dir):
    return _rounded(sinks.time_series(_analysis(spark, sf_dir).results), "estimated_total_count_lower")


@query("select count(*) as total from documents join orders on doc_id = o_orderkey where lang = 'en' and text is not null and text <> ''")
def eligible_doc_count(spark, sf_dir):
    return counting.eligible(articles(spark, sf_dir))


@query("select 'articles' as \"table\", count(*) as n from documents union all select 'authors', count(*) from customer union all select 'institutions', count(*) from nation union all select 'topics', count(*) from part union all select 'concepts', count(*) from region union all select 'references', count(*) from lineitem")
def table_stats(spark, sf_dir):
    roles = {"articles": "documents", "authors": "customer", "institutions": "nation", "topics": "part", "concepts": "region", "references": "lineitem"}
    return table_counts({role: _table(spark, sf_dir, name) for role, name in roles.items()})


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as work records, several of one id, with the date of the order of the same number."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.substring("text", 1, 20).alias("title"))
    dated = docs.join(_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_orderdate"), "doc_id")
    at = lambda prefix, c: F.concat(F.lit(BASE + prefix), c.cast("string"))
    level = lambda name, n: F.struct(at(f"{name}s/", F.col("doc_id") % n).alias("id")).alias(name)
    topic = F.struct(level("domain", 4), level("field", 26), level("subfield", 250))
    own = {
        "id": at("W", F.col("doc_id") % 300), "title": F.col("title"), "publication_year": F.year("o_orderdate"), "publication_date": F.date_format("o_orderdate", "yyyy-MM-dd"), "language": F.col("lang"),
        "primary_location": F.when(F.col("doc_id") % 5 > 0, F.struct(F.struct(at("S", F.replace("source", F.lit("src"), F.lit(""))).alias("id")).alias("source"))), "primary_topic": topic,
        "locations": F.array(F.struct((F.col("doc_id") % 2 == 0).alias("is_oa"), F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("landing_page_url"))),
        "topics": F.array(F.struct(at("T", F.col("doc_id")).alias("id"), F.lit("t").alias("display_name"), F.lit(1.0).alias("score"), level("domain", 4), level("field", 26), level("subfield", 250))),
    }
    rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in struct(WORK_DDL).fields if f.name not in own]
    return dated.select(*[c.alias(n) for n, c in own.items()], *rest, F.lit("f").alias("_file"), F.col("doc_id").alias("_ordinal"))


@query("""with r as (select *, row_number() over (partition by doc_id % 300 order by doc_id) as r from documents join orders on doc_id = o_orderkey where year(o_orderdate) >= 1996 and lang = 'en')
 select doc_id % 300 as article_id, substr(text, 1, 20) as title, cast(year(o_orderdate) as int) as publication_year, cast(o_orderdate as date) as publication_date, cast(doc_id % 4 as int) as domain, cast(doc_id % 26 as int) as field, cast(doc_id % 250 as int) as subfield,
  cast(doc_id % 4 as varchar) as domains, cast(doc_id % 26 as varchar) as fields, cast(doc_id % 250 as varchar) as subfields, case when doc_id % 2 = 0 then 'u' || doc_id end as url, lang as language,
  case when doc_id % 5 > 0 then cast(replace(source, 'src', '') as bigint) else 0 end as source from r where r = 1""")
def article_filter(spark, sf_dir):
    """The articles table out of works: filters, the first accepted record of each id, all 13 columns."""
    config = IngestConfig(early_date=1996)
    made = normalize.tables(normalize.winners(_records(spark, sf_dir), config)[0], config)["articles"]
    assert made.columns == struct(TABLES["articles"]).names
    return made.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("domains", "fields", "subfields")})


@query("select l_orderkey as article_id from lineitem union select o_orderkey from orders where o_orderstatus = 'F'")
def union_distinct(spark, sf_dir):
    parts = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("article_id")), _table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("article_id"))
    return dedupe.union_distinct(*parts)


@query("select o_orderkey as batch, case when o_custkey > 0 then (20000 - o_custkey) / o_custkey * o_totalprice end as eta from orders")
def eta(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("batch"), eta_seconds(F.col("o_custkey"), F.lit(20000), F.col("o_totalprice")).alias("eta"))


_LINE = "l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate"


@query(f"select article_id, topic_id, score from (select l_orderkey as article_id, l_partkey as topic_id, l_discount as score, row_number() over (partition by l_orderkey, l_partkey order by {_LINE}) as r from lineitem) where r = 1")
def first_wins_topics(spark, sf_dir):
    lines = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("article_id"), F.col("l_partkey").alias("topic_id"), F.col("l_discount").alias("score"), *_LINE.split(", "))
    return dedupe.first_wins(lines, ["article_id", "topic_id"], _LINE.split(", ")).select("article_id", "topic_id", "score")


@query("select o_custkey as author_id, min(o_orderkey) as article_id from orders group by 1")
def first_wins_authors(spark, sf_dir):
    return dedupe.first_wins(_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("author_id"), F.col("o_orderkey").alias("article_id")), ["author_id"], ["article_id"])


@query("""select distinct o_orderkey as article_id, o_custkey as author_id, cast(c_nationkey as bigint) as institution_id, first_value(c_mktsegment) over (partition by o_orderkey, o_custkey, c_nationkey order by c_mktsegment) as type
 from orders join customer on o_custkey = c_custkey""")
def first_wins_affiliations(spark, sf_dir):
    people = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("author_id"), F.col("c_nationkey").cast("long").alias("institution_id"), F.col("c_mktsegment").alias("type"))
    rows = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("article_id"), F.col("o_custkey").alias("author_id")).join(people, "author_id")
    return dedupe.first_wins(rows, ["author_id", "institution_id", "article_id"], ["type"])


_STORED = "select l_orderkey, l_partkey, min(l_discount) as score from lineitem where l_returnflag = 'R' group by 1, 2"


@query(f"with s as ({_STORED}), i as (select l_orderkey, l_partkey, min(l_discount) as score from lineitem group by 1, 2) select * from s union all select * from i where not exists (select 1 from s where s.l_orderkey = i.l_orderkey and s.l_partkey = i.l_partkey)")
def insert_ignore(spark, sf_dir):
    lines = _table(spark, sf_dir, "lineitem")

    def scores(df: DataFrame) -> DataFrame:
        return df.groupBy("l_orderkey", "l_partkey").agg(F.min("l_discount").alias("score"))

    return dedupe.upsert(scores(lines.where("l_returnflag = 'R'")), scores(lines), ["l_orderkey", "l_partkey"])


@query("select distinct 'part-' || l_orderkey as path from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderstatus = 'F')")
def incremental_manifest(spark, sf_dir):
    path = lambda c: F.concat(F.lit("part-"), F.col(c).cast("string")).alias("path")
    done = _table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(path("o_orderkey"))
    return _table(spark, sf_dir, "lineitem").select(path("l_orderkey")).distinct().join(done, "path", "left_anti")


@query("""with s as (select o_orderkey as shard, cast(floor(o_totalprice / 100) as bigint) as n from orders),
 due as (select shard, unnest(generate_series(1, (n + 199) // 200)) as page from s where n > 0)
 select due.shard, due.page from due left join lineitem on l_orderkey = due.shard and l_linenumber = due.page where l_orderkey is null""")
def missing_pages(spark, sf_dir):
    made = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("shard"), F.floor(F.col("o_totalprice") / 100).alias("n"))
    have = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("shard"), F.col("l_linenumber").cast("long").alias("page"))
    return pages.missing_pages(made, have)


@query(f"with w as (select doc_id, string_split({_CLEAN}, ' ') as w from documents) select doc_id, array_to_string(w, ' ') as abstract, len(w)::int - 1 as last_position from w where len(list_distinct(w)) > 1")
def inverted_index_roundtrip(spark, sf_dir):
    said = scan(spark, f"{sf_dir}/documents.parquet", ["doc_id", "text"]).select("doc_id", text.clean_text(F.col("text")).alias("clean"))
    index = grams.inverted_index(said, "clean", "idx")
    return index.where(F.size("idx") > 1).select("doc_id", text.inverted_index_to_text("idx").alias("abstract"), text.last_position(F.col("idx")).alias("last_position"))


_TOPIC = "struct<id:string,domain:struct<id:string>,field:struct<id:string>,subfield:struct<id:string>>"


def _works(spark, sf_dir) -> DataFrame:
    """Orders as work records with their lines as topics and locations, in line order."""
    lines = _table(spark, sf_dir, "lineitem")
    level = lambda c, name: F.struct(F.concat(F.lit(f"{BASE}{name}/"), c.cast("string")).alias("id")).alias(name[:-1])
    topic = F.struct(F.concat(F.lit(f"{BASE}T"), F.col("l_partkey").cast("string")).alias("id"), level(F.col("l_suppkey") % 4, "domains"), level(F.col("l_suppkey") % 26, "fields"), level(F.col("l_suppkey"), "subfields")).alias("topic")
    place = F.struct((F.col("l_returnflag") != "N").alias("is_oa"), F.when(F.col("l_linestatus") == "O", F.concat(F.lit("u"), F.col("l_partkey").cast("string"))).alias("landing_page_url")).alias("place")
    row = F.struct(*[F.col(c) for c in _LINE.split(", ")], F.col("l_partkey"), topic, place)
    made = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return made.select(F.col("l_orderkey").alias("article_id"), F.col("rows.topic").alias("topics"), F.col("rows.place").alias("locations"))


_SORTED = f"order by {_LINE}, l_partkey"


@query(f"select l_orderkey as article_id, string_agg((l_suppkey % 4)::varchar, ',' {_SORTED}) as domains, string_agg((l_suppkey % 26)::varchar, ',' {_SORTED}) as fields, string_agg(l_suppkey::varchar, ',' {_SORTED}) as subfields from lineitem group by 1")
def topic_arrays(spark, sf_dir):
    levels = [F.array_join(normalize.topic_levels(F.col("topics"), level, BASE).cast("array<string>"), ",").alias(f"{level}s") for level in ("domain", "field", "subfield")]
    return _works(spark, sf_dir).select("article_id", *levels)


@query(f"""with p as (select l_orderkey, l_returnflag <> 'N' as oa, case when l_linestatus = 'O' then 'u' || l_partkey end as u, row_number() over (partition by l_orderkey {_SORTED}) as r from lineitem),
 f as (select l_orderkey, min(r) filter (oa and u is not null) as r from p group by 1)
 select f.l_orderkey as article_id, any_value(p.u) filter (p.r = f.r) as url, count(*) filter (p.oa and (f.r is null or p.r <= f.r)) as n_urls from f join p using (l_orderkey) group by 1""")
def first_open_url(spark, sf_dir):
    return _works(spark, sf_dir).select("article_id", normalize.first_open_url(F.col("locations")).alias("url"), normalize.open_locations_seen(F.col("locations")).alias("n_urls"))


@query("select cast(n_nationkey as bigint) as institution_id, n_name as name, cast(1000 + n_regionkey as varchar) as lineage from nation")
def lineage_without_self(spark, sf_dir):
    url = lambda c: F.concat(F.lit(f"{BASE}I"), c.cast("string"))
    nations = _table(spark, sf_dir, "nation").select(url(F.col("n_nationkey")).alias("id"), "n_name", url(F.col("n_regionkey") + 1000).alias("parent"))
    lineage = normalize.lineage_without_self(F.array("id", "parent"), F.col("id"), BASE)
    return nations.select(ids.url_to_id(F.col("id")).alias("institution_id"), F.col("n_name").alias("name"), F.array_join(lineage.cast("array<string>"), ",").alias("lineage"))


@query("select o_orderkey as article_id, c_custkey as author_id, c_name as name from orders join customer on o_custkey = c_custkey")
def explode_authors(spark, sf_dir):
    who = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.struct(F.concat(F.lit(f"{BASE}A"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("display_name")).alias("author"))
    works = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(who, "o_custkey").select(F.col("o_orderkey").alias("article_id"), F.array("author").alias("authorships"))
    return works.select("article_id", F.explode("authorships").alias("a")).select("article_id", ids.url_to_id(F.col("a.id")).alias("author_id"), F.col("a.display_name").alias("name"))


@query("select l_orderkey as article_id, l_partkey as topic_id from lineitem")
def explode_topics(spark, sf_dir):
    return _works(spark, sf_dir).select("article_id", F.explode("topics").alias("t")).select("article_id", ids.url_to_id(F.col("t.id")).alias("topic_id"))


@query("select l_orderkey as cites, l_suppkey as cited from lineitem")
def explode_references(spark, sf_dir):
    cited = F.concat(F.lit(f"{BASE}W"), F.col("l_suppkey").cast("string"))
    works = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(cited).alias("referenced_works"))
    return works.select(F.col("l_orderkey").alias("cites"), F.explode("referenced_works").alias("r")).select("cites", ids.url_to_id(F.col("r")).alias("cited"))


@query("select doc_id, cast(replace(source, 'src', '') as bigint) as work, cast(replace(source, 'src', '') as int) as domain, cast(replace(source, 'src', '') as int) as field, cast(replace(source, 'src', '') as int) as subfield, replace(source, 'src', '') as source from documents")
def id_extraction(spark, sf_dir):
    n = F.replace("source", F.lit("src"), F.lit(""))
    at = lambda prefix: F.concat(F.lit(BASE + prefix), n)
    return _table(spark, sf_dir, "documents").select("doc_id", ids.url_to_id(at("W")).alias("work"), ids.clean_domain(at("domains/")).alias("domain"), ids.clean_field(at("fields/")).alias("field"), ids.clean_subfield(at("subfields/")).alias("subfield"), ids.clean_source(at("S")).alias("source"))


@query("select c_custkey as author_id, case c_mktsegment when 'BUILDING' then 'f' when 'MACHINERY' then 'm' when 'AUTOMOBILE' then 'unknown' end as gender from customer")
def gender_normalise(spark, sf_dir):
    genders = spark.createDataFrame([("BUILDING", "female"), ("MACHINERY", "male"), ("AUTOMOBILE", "unknown")], "c_mktsegment string, gender string")
    named = _table(spark, sf_dir, "customer").join(F.broadcast(genders), "c_mktsegment", "left")  # three rows
    return named.select(F.col("c_custkey").alias("author_id"), ids.gender_code(F.col("gender")).alias("gender"))


@query("select doc_id, nullif(regexp_extract('see https://arxiv.org/abs/' || case when doc_id % 2 = 0 then '21' || doc_id || '.0' || doc_id || 'v2' else '' end || '/x', 'https?://arxiv[.]org/abs/([.0-9a-z]+)', 1), '') as arxiv from documents")
def arxiv_ids(spark, sf_dir):
    n = F.col("doc_id").cast("string")
    address = F.concat(F.lit("see https://arxiv.org/abs/"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("21"), n, F.lit(".0"), n, F.lit("v2"))).otherwise(F.lit("")), F.lit("/x"))
    return _table(spark, sf_dir, "documents").select("doc_id", ids.arxiv_id(address).alias("arxiv"))


@query("select doc_id, 'own/r' || doc_id || ',' || source || '/code' as repositories from documents")
def repositories(spark, sf_dir):
    n = F.col("doc_id").cast("string")
    words = F.array(F.concat(F.lit("https://github.com/own/r"), n, F.lit(".git")), F.col("lang"), F.concat(F.lit("(github.com/"), F.col("source"), F.lit("/code)")))
    return _table(spark, sf_dir, "documents").select("doc_id", F.array_join(ids.repositories(words), ",").alias("repositories"))


_RANK = "r as (select doc_id as article_id, cast(row_number() over (order by md5('42:' || doc_id), doc_id) as int) as random_rank from documents)"


@query(f"with {_RANK} select * from r")
def random_order(spark, sf_dir):
    return sampling.random_order(_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("article_id")))


@query(f"with {_RANK} select * from r order by random_rank limit 100 offset 50")
def batch_page(spark, sf_dir):
    return sampling.page(random_order(spark, sf_dir), 100, 50)


@query(f"with {_RANK} select article_id, cast(year(o_orderdate) as int) as publication_year, random_rank, cast(floor((random_rank - 1) / 250) as bigint) as batch from documents join orders on doc_id = o_orderkey join r on article_id = doc_id where text is not null and text <> ''")
def three_way_batch_join(spark, sf_dir):
    chosen = articles(spark, sf_dir, None).where("abstract is not null and abstract <> ''").select("article_id", "publication_year")
    return chosen.join(random_order(spark, sf_dir), "article_id").select("article_id", "publication_year", "random_rank", sampling.batch_number("random_rank", 250).alias("batch"))


@query("select y.y::int as year, p_size as subfield, s.s as oa_status from (select unnest(generate_series(2019, 2025)) as y) y, (select distinct p_size from part) p, (select unnest(['diamond', 'gold', 'green', 'hybrid', 'bronze']) as s) s")
def shard_enumeration(spark, sf_dir):
    return shards.enumerate_shards(_table(spark, sf_dir, "part").select(F.col("p_size").alias("subfield")).distinct(), ["diamond", "gold", "green", "hybrid", "bronze"])


@query("""with c as (select l_suppkey as shard, l_suppkey % 10 as subfield, count(*) filter (l_returnflag = 'R') * 50 as n from lineitem group by 1)
 select shard, subfield, cast(null as varchar) as topic from c where n > 0 and n <= 10000
 union all select shard, subfield, p_brand from c join (select distinct p_partkey % 10 as s, p_brand from part) on s = subfield where n > 10000""")
def adaptive_shards(spark, sf_dir):
    counts = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("shard"), (F.col("l_suppkey") % 10).alias("subfield")).agg((F.sum((F.col("l_returnflag") == "R").cast("long")) * 50).alias("n"))
    topics = _table(spark, sf_dir, "part").select((F.col("p_partkey") % 10).alias("subfield"), F.col("p_brand").alias("topic"))
    return shards.split_shards(counts, topics)


@query("select event_id, cast(json_extract(props, '$.k') as int) as k, '{\"k\":' || cast(json_extract(props, '$.k') as int) || '}' as again from events")
def json_fields(spark, sf_dir):
    parsed = _table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int").alias("p"))
    return parsed.select("event_id", "p.k", F.to_json("p").alias("again"))


@query("select cast(p_partkey as bigint) as concept_id, p_name as name, p_size as level from part")
def concept_projection(spark, sf_dir):
    records = _table(spark, sf_dir, "part").select(F.concat(F.lit(f"{BASE}C"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("display_name"), F.col("p_size").alias("level"), F.lit("part").alias("_file"), F.col("p_partkey").alias("_ordinal"))
    return normalize.concepts(records)


@query("select o_orderkey as shard, (cast(floor(o_totalprice) as bigint) + 199) // 200 as pages from orders")
def expected_pages(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("shard"), page_count(F.floor("o_totalprice")).alias("pages"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top20_fold_change(spark, sf_dir)
