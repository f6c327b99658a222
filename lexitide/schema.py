"""Declared schemas: input records, the star schema and results."""

from __future__ import annotations

from pyspark.sql import types as T

WORK_DDL = """
id string, title string, publication_year int, publication_date string, language string,
primary_location struct<source:struct<id:string>>,
primary_topic struct<domain:struct<id:string>,field:struct<id:string>,subfield:struct<id:string>>,
locations array<struct<is_oa:boolean,landing_page_url:string>>,
abstract_inverted_index map<string,array<int>>,
topics array<struct<id:string,display_name:string,score:double,domain:struct<id:string>,field:struct<id:string>,subfield:struct<id:string>>>,
referenced_works array<string>,
authorships array<struct<author_position:string,author:struct<id:string,display_name:string,orcid:string>,
  institutions:array<struct<id:string,display_name:string,country_code:string,type:string,lineage:array<string>>>>>
"""
CONCEPT_DDL = "id string, display_name string, level int"

TABLES = {
    "articles": "article_id long, title string, publication_year int, publication_date date, domain int, field int, subfield int, domains array<int>, fields array<int>, subfields array<int>, url string, language string, source long",
    "abstracts": "article_id long, abstract string",
    "authors": "author_id long, name string, orcid string, gender string",
    "institutions": "institution_id long, name string, country_code string, lineage array<long>",
    "topics": "topic_id long, name string",
    "concepts": "concept_id long, name string, level int",
    "references": "cites long, cited long",
    "articles_authors": "article_id long, author_id long, position string",
    "articles_affiliations": "article_id long, author_id long, institution_id long, type string",
    "articles_topics": "article_id long, topic_id long, score double",
    "articles_concepts": "article_id long, concept_id long",
    "articles_order": "article_id long, random_rank int",
}

#: Keys that make a row; references are a bag.
KEYS = {
    "articles": ("article_id",), "abstracts": ("article_id",), "authors": ("author_id",), "institutions": ("institution_id",),
    "topics": ("topic_id",), "concepts": ("concept_id",), "references": (), "articles_authors": ("article_id", "author_id"),
    "articles_affiliations": ("article_id", "author_id", "institution_id"), "articles_topics": ("article_id", "topic_id"),
    "articles_concepts": ("article_id", "concept_id"), "articles_order": ("random_rank",),
}

#: Columns that queries look rows up by; files are sorted by them.
INDEXES = {
    "articles": ("publication_year", "domain", "field"), "authors": ("name", "gender"), "institutions": ("name", "country_code"),
    "references": ("cites", "cited"), "articles_order": ("article_id",),
}

#: Tables whose counts are reported.
COUNTED = ("articles", "authors", "institutions", "topics", "concepts", "references")


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
