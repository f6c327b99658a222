"""Work records -> star schema tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import IngestConfig
from ..functions import ids
from ..functions.text import inverted_index_to_text
from ..schema import KEYS, TABLES
from .dedupe import first_wins

_ORDER = ["_file", "_ordinal"]


def open_locations(locations: Column) -> Column:
    return F.filter(locations, lambda x: x["is_oa"])


def first_open_url(locations: Column) -> Column:
    """Address of the first open location that has one."""
    return F.get(F.filter(locations, lambda x: x["is_oa"] & x["landing_page_url"].isNotNull()), F.lit(0))["landing_page_url"]


def open_locations_seen(locations: Column) -> Column:
    """Open locations looked at until an address is found."""
    found = F.array_position(F.transform(open_locations(locations), lambda x: x["landing_page_url"].isNotNull()), F.lit(True))
    return F.when(found > 0, found).otherwise(F.size(open_locations(locations)).cast("long"))


def lineage_without_self(lineage: Column, own: Column, base: str) -> Column:
    return F.transform(F.filter(lineage, lambda a: a != own), lambda a: ids.url_to_id(a, base))


def topic_levels(topics: Column, level: str, base: str) -> Column:
    """Ids of one level of all topics, in order, repeats kept; no topics give an empty array."""
    found = F.transform(topics, lambda t: ids.level_id(t[level]["id"], f"{level}s", base))
    return F.coalesce(found, F.array().cast("array<int>"))


def problem(config: IngestConfig) -> Column:
    """Why a record can't be normalised, null if it can."""
    topic = F.col("primary_topic")
    return (
        F.when(ids.try_url_to_id(F.col("id"), config.id_base).isNull(), "id")
        .when(F.col("publication_year").isNull(), "publication_year")
        .when(topic["domain"]["id"].isNull() | topic["field"]["id"].isNull() | topic["subfield"]["id"].isNull(), "primary_topic")
        .when(F.try_to_date(F.col("publication_date"), "yyyy-MM-dd").isNull(), "publication_date")
    )


def accepted(config: IngestConfig) -> Column:
    """Recent enough and in the right language; a missing language is not."""
    return (F.col("publication_year") >= config.early_date) & F.col("language").eqNullSafe(F.lit(config.language))


def winners(works: DataFrame, config: IngestConfig) -> tuple[DataFrame, DataFrame]:
    """(works, quarantine): the first accepted record of each id, and records with their problem.

    Records that a filter rejects do not use up their id.
    """
    checked = works.withColumn("problem", problem(config))
    wanted = F.coalesce(accepted(config), F.lit(True))  # what no filter rejects, unknown years included
    bad = checked.where(F.col("problem").isNotNull() & wanted)
    good = checked.where(F.col("problem").isNull() & accepted(config)).drop("problem")
    if config.on_bad_record == "fail":
        good = checked.where(wanted).where(F.col("problem").isNull() | F.assert_true(F.col("problem").isNull(), F.concat(F.lit("bad record: "), F.col("problem"))).isNull()).drop("problem")
    # maps can't be compared, so the choice is made on narrow keys and joined back
    keyed = good.withColumn("article_id", ids.url_to_id(F.col("id"), config.id_base))
    best = keyed.groupBy("article_id").agg(F.min(F.struct(*_ORDER)).alias("_at"))
    chosen = keyed.join(best.select(*[F.col(f"_at.{c}").alias(c) for c in _ORDER]), _ORDER, "left_semi")
    return chosen, bad


def tables(works: DataFrame, config: IngestConfig = IngestConfig(), genders: DataFrame | None = None) -> dict[str, DataFrame]:
    """All tables that works fill, out of :func:`winners`' first result.

    ``genders`` (name, gender) names authors' genders; without it they are null.
    """
    base = config.id_base
    domain, field, subfield = (F.col("primary_topic")[k]["id"] for k in ("domain", "field", "subfield"))
    out = {
        "articles": works.select(
            "article_id", "title", "publication_year", ids.publication_date(F.col("publication_date")).alias("publication_date"),
            ids.clean_domain(domain, base).alias("domain"), ids.clean_field(field, base).alias("field"), ids.clean_subfield(subfield, base).alias("subfield"),
            *[topic_levels(F.col("topics"), level, base).alias(f"{level}s") for level in ("domain", "field", "subfield")],
            first_open_url(F.col("locations")).alias("url"), "language", ids.source_id(F.col("primary_location")["source"]["id"], base).alias("source"),
        ),
        "abstracts": works.where(F.size("abstract_inverted_index") > 1).select("article_id", inverted_index_to_text("abstract_inverted_index").alias("abstract")),
    }
    people = works.select("article_id", *_ORDER, F.posexplode("authorships").alias("_a", "authorship")).withColumn("author_id", ids.url_to_id(F.col("authorship.author.id"), base))
    authors = first_wins(people.select("author_id", F.col("authorship.author.display_name").alias("name"), F.col("authorship.author.orcid").alias("orcid"), *_ORDER, "_a"), ["author_id"], [*_ORDER, "_a"]).select("author_id", "name", "orcid")
    if genders is None:
        out["authors"] = authors.withColumn("gender", F.lit(None).cast("string"))
    else:
        named = first_wins(genders.select("name", "gender"), ["name"], ["gender"])
        out["authors"] = authors.join(named, "name", "left").select("author_id", "name", "orcid", ids.gender_code(F.col("gender")).alias("gender"))
    out["articles_authors"] = first_wins(people.select("article_id", "author_id", F.col("authorship.author_position").alias("position"), "_a"), ["article_id", "author_id"], ["_a"]).select("article_id", "author_id", "position")
    places = people.select("article_id", "author_id", *_ORDER, "_a", F.posexplode("authorship.institutions").alias("_i", "institution")).withColumn("institution_id", ids.url_to_id(F.col("institution.id"), base))
    order = [*_ORDER, "_a", "_i"]
    out["institutions"] = first_wins(
        places.select("institution_id", F.col("institution.display_name").alias("name"), F.col("institution.country_code").alias("country_code"), lineage_without_self(F.col("institution.lineage"), F.col("institution.id"), base).alias("lineage"), *order), ["institution_id"], order
    ).drop(*order)
    out["articles_affiliations"] = first_wins(places.select("article_id", "author_id", "institution_id", F.col("institution.type").alias("type"), "_a", "_i"), ["article_id", "author_id", "institution_id"], ["_a", "_i"]).drop("_a", "_i")
    subjects = works.select("article_id", *_ORDER, F.posexplode("topics").alias("_t", "topic")).withColumn("topic_id", ids.url_to_id(F.col("topic.id"), base))
    out["topics"] = first_wins(subjects.select("topic_id", F.col("topic.display_name").alias("name"), *_ORDER, "_t"), ["topic_id"], [*_ORDER, "_t"]).select("topic_id", "name")
    out["articles_topics"] = first_wins(subjects.select("article_id", "topic_id", F.col("topic.score").alias("score"), "_t"), ["article_id", "topic_id"], ["_t"]).select("article_id", "topic_id", "score")
    if config.enable_references:
        out["references"] = works.select(F.col("article_id").alias("cites"), F.explode("referenced_works").alias("r")).select("cites", ids.url_to_id(F.col("r"), base).alias("cited"))
    return {name: df.select(*[c.split()[0] for c in _columns(TABLES[name])]) for name, df in out.items()}


def _columns(ddl: str) -> list[str]:
    return [c.strip() for c in ddl.split(", ")]


def concepts(records: DataFrame, config: IngestConfig = IngestConfig()) -> DataFrame:
    """Concept records (with _file and _ordinal) -> concepts, the first of each id."""
    named = records.select(ids.url_to_id(F.col("id"), config.id_base).alias("concept_id"), F.col("display_name").alias("name"), F.col("level").cast("int").alias("level"), *_ORDER)
    return first_wins(named, list(KEYS["concepts"]), _ORDER).select("concept_id", "name", "level")
