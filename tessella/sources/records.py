"""Readers of catalogues, repository records and gold labels, on Spark's XML, JSON and CSV sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.keys import keep_first

_LINK = "struct<_rel: string, _type: string, _href: string, _length: bigint>"


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, flavour, updated, tags, href, length) of the entries of an Atom catalogue."""
    schema = f"id string, title string, name string, flavour string, updated string, tags string, link array<{_LINK}>"
    entries = spark.read.format("xml").option("rowTag", "entry").option("ignoreNamespace", "true").schema(schema).load(path)
    book = F.get(F.filter("link", lambda link: F.contains(link["_rel"], F.lit("acquisition"))), F.lit(0))
    return entries.select(F.concat_ws("_", "name", F.when(F.col("flavour") != "", F.col("flavour"))).alias("id"), "name", "flavour", F.to_date(F.substring("updated", 1, 10)).alias("updated"), F.split("tags", ";").alias("tags"), book["_href"].alias("href"), book["_length"].alias("length"))


def metalink(spark: SparkSession, path: str) -> DataFrame:
    """(name, size, sha256, urls) of the files of a metalink, urls by priority."""
    schema = "_name string, size bigint, hash array<struct<_type: string, _VALUE: string>>, url array<struct<_priority: int, _VALUE: string>>"
    files = spark.read.format("xml").option("rowTag", "file").option("ignoreNamespace", "true").schema(schema).load(path)
    digest = F.get(F.filter("hash", lambda h: h["_type"] == "sha-256"), F.lit(0))["_VALUE"]
    urls = F.transform(F.array_sort("url"), lambda u: u["_VALUE"])
    return files.select(F.col("_name").alias("name"), "size", digest.alias("sha256"), urls.alias("urls"))


def label_of(uri: Column) -> Column:
    """The last part of a URI, for values that have no display name."""
    return F.element_at(F.split(F.regexp_replace(uri, "/+$", ""), "/"), -1)


def repository_records(spark: SparkSession, path: str) -> DataFrame:
    """(id, title, description, keywords, subjects, url, licence) of saved repository pages; the first listing of an id stays.

    Single values and lists are read alike; subjects fall back from their display names to the ends of their URIs.
    """
    names = ["cclom:title", "cclom:general_description", "cclom:general_keyword", "ccm:taxonid", "ccm:taxonid_DISPLAYNAME", "ccm:wwwurl", "ccm:commonlicense_key"]
    fields = ", ".join(f"`{n}`: array<string>" for n in names)
    pages = spark.read.schema(f"page int, nodes array<struct<ref: struct<id: string>, title: string, properties: struct<{fields}>>>").json(path)
    rows = pages.select("page", F.posexplode("nodes").alias("pos", "n")).select("page", "pos", F.col("n.ref.id").alias("id"), "n.title", "n.properties.*").where("id IS NOT NULL")
    values = lambda name: F.array_compact(F.coalesce(F.col(f"`{name}`"), F.array().cast("array<string>")))
    first = lambda name: F.get(values(name), F.lit(0))
    shown, uris = values("ccm:taxonid_DISPLAYNAME"), values("ccm:taxonid")
    records = rows.select(
        "id", "page", "pos", F.coalesce(first("cclom:title"), "title").alias("title"), first("cclom:general_description").alias("description"),
        F.array_distinct(values("cclom:general_keyword")).alias("keywords"), F.when(F.size(shown) > 0, shown).otherwise(F.transform(uris, label_of)).alias("subjects"),
        first("ccm:wwwurl").alias("url"), first("ccm:commonlicense_key").alias("licence"),
    )
    return keep_first(records, ["id"], ["page", "pos"]).select("id", "title", "description", "keywords", "subjects", "url", "licence")


GOLD = "chunk_id string, slot string, text_hash string, heading string, text_head string"


def gold_labels(spark: SparkSession, path: str) -> DataFrame:
    """Labels of a JSON Lines file whose first line is about the set; a slot of `none` is no slot."""
    rows = spark.read.schema(f"_meta struct<topic: string, template_id: string>, {GOLD}").json(path).where("_meta IS NULL")
    return rows.select("chunk_id", F.nullif("slot", F.lit("none")).alias("slot"), "text_hash", "heading", "text_head")


def gold_csv(spark: SparkSession, path: str) -> DataFrame:
    """Labels of an exported table (semicolons; a byte order mark is dropped by the reader)."""
    rows = spark.read.option("sep", ";").option("header", "true").option("encoding", "UTF-8").schema(GOLD).csv(path)
    return rows.withColumn("slot", F.nullif("slot", F.lit("none")))


def write_gold_csv(labels: DataFrame, path: str) -> None:
    labels.write.option("sep", ";").option("header", "true").mode("overwrite").csv(path)
