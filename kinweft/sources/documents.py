"""Catalogue documents in and out: JSON of one document per file, pinned snapshots, chunks, publishing."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CITED = "source_ids array<string>"
_REVIEW = "review struct<status:string,reviewed_on:string,notes:string>"
#: The collections of a document: their keys and their members.
COLLECTIONS = {
    "animals": ("id", f"id string, taxon string, sex string, status string, population string, name struct<canonical:string,language:string,source_ids:array<string>,localized:array<struct<value:string,language:string,source_ids:array<string>>>>, aliases array<struct<value:string,language:string,source_ids:array<string>>>, external_ids array<struct<namespace:string,value:string>>, {_REVIEW}"),
    "claims": ("id", f"id string, subject string, claim_type string, value variant, status string, {_CITED}, {_REVIEW}"),
    "relationships": ("id", f"id string, subject string, object string, type string, status string, {_CITED}, {_REVIEW}"),
    "events": ("id", f"id string, animal_id string, related_animal_ids array<string>, outcome_count int, type string, date struct<precision:string,value:string,start:string,end:string,notes:string>, institution_id string, from_institution_id string, to_institution_id string, {_CITED}, notes string"),
    "institutions": ("id", "id string, names array<struct<value:string,language:string>>, country_code string, location string"),
    "media": ("media_id", f"media_id string, animal_id string, source_page_url string, direct_remote_url string, direct_thumbnail_url string, license_name string, license_url string, credit string, rights_status string, embedding_status string, offline_archive_eligible boolean, identity_confidence string, checked_date string, notes string, {_CITED}"),
    "sources": ("id", "id string, title string, publisher string, url string, publication_date string, accessed_date string, source_type string, tier string, notes string, data_use string"),
}
SINGLE = {
    "release": "schema_version string, data_version string, engine_version string, build_date string, provenance string",
    "coverage": "taxon string, scope string, limitations array<string>, last_reviewed string, translations map<string,struct<scope:string,limitations:array<string>>>",
}


def _struct(fields: str) -> str:
    """``a int, b string`` as ``struct<a:int,b:string>``."""
    return f"struct<{','.join(f.replace(' ', ':', 1) for f in fields.split(', '))}>"


def document_schema() -> str:
    one = [f"{k} {_struct(v)}" for k, v in SINGLE.items()]
    many = [f"{k} array<{_struct(v)}>" for k, (_, v) in COLLECTIONS.items()]
    return ", ".join(one + many)


def read_texts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, text): whole files."""
    t = spark.read.text(paths, wholetext=True)
    return t.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def bad_documents(texts: DataFrame) -> DataFrame:
    """(code, path, message) of the files that are no JSON object; the others can still be read."""
    v = F.try_parse_json("text")
    bad = v.isNull() | ~F.startswith(F.schema_of_variant(v), F.lit("OBJECT"))
    return texts.where(F.coalesce(bad, F.lit(True))).select(F.lit("unreadable_document").alias("code"), "path", F.lit("no JSON object").alias("message"))


def read_documents(spark: SparkSession, paths: str | list[str], strict: bool = False) -> dict[str, DataFrame]:
    """The collections of all documents under paths, each row with document (its path) and _ord (its place).

    strict fails on the first file that is no JSON of this shape; else such files give no rows.
    """
    texts = read_texts(spark, paths)
    doc = texts.select("path", F.from_json("text", document_schema(), {"mode": "FAILFAST" if strict else "PERMISSIVE"}).alias("d"))
    out = {k: doc.where(f"d.{k} is not null").select(F.col("path").alias("document"), f"d.{k}.*") for k in SINGLE}
    for name in COLLECTIONS:
        out[name] = doc.select(F.col("path").alias("document"), F.posexplode(f"d.{name}").alias("_ord", "x")).where("x is not null").select("document", "_ord", "x.*")
    return out


def unexpected_members(texts: DataFrame) -> DataFrame:
    """(path, member, code): top-level members that a document lacks or should not have."""
    wanted = F.array(*[F.lit(k) for k in (*SINGLE, *COLLECTIONS)])
    keys = F.json_object_keys("text")
    x = texts.select("path", F.explode(F.concat(F.transform(F.array_except(wanted, keys), lambda k: F.struct(k.alias("member"), F.lit("missing_collection").alias("code"))), F.transform(F.array_except(keys, wanted), lambda k: F.struct(k.alias("member"), F.lit("unexpected_field").alias("code"))))).alias("x"))
    return x.select("path", "x.member", "x.code")


def read_pinned(spark: SparkSession, path: str, sha256: str, size: int) -> DataFrame:
    """(path, text) of a file whose digest and length are known; the query fails where they differ."""
    b = spark.read.format("binaryFile").load(path)
    same = (F.sha2("content", 256) == sha256) & (F.col("length") == size)
    return b.select("path", F.when(same, F.decode("content", "UTF-8")).otherwise(F.raise_error(F.concat(F.lit("not the pinned file: "), F.col("path")))).alias("text"))


def read_optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON table, or no rows of its schema where there is no such file."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    return spark.read.schema(schema).json(path) if there else spark.createDataFrame([], schema)


def read_pedigree_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A tab-separated table in which NA stands for null."""
    return spark.read.schema(schema).csv(path, sep="\t", nullValue="NA", header=True)


def json_lines(rows: DataFrame) -> DataFrame:
    """rows as JSON texts without blanks; members that are null are left out."""
    return rows.select(F.to_json(F.struct("*")).alias("value"))


def document_text(document: dict, pretty: bool = True, sort: bool = False) -> str:
    """One document as text: indented and in order of insertion, or compact, or with sorted keys."""
    return json.dumps(document, ensure_ascii=False, sort_keys=sort, indent=2 if pretty else None, separators=None if pretty else (",", ":")) + "\n"


def write_chunks(rows: DataFrame, path: str) -> None:
    """One folder per chunk_id, so that one chunk is read alone."""
    rows.repartition("chunk_id").write.mode("overwrite").partitionBy("chunk_id").parquet(path)


def publish(rows: DataFrame, target: str) -> None:
    """Write beside the target, then put it in place; the old one comes back if that fails."""
    spark = rows.sparkSession
    jvm = spark.sparkContext._jvm
    path = lambda s: jvm.org.apache.hadoop.fs.Path(s)
    fs = path(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    stage, old = target.rstrip("/") + ".staged", target.rstrip("/") + ".previous"
    rows.write.mode("overwrite").parquet(stage)
    fs.delete(path(old), True)
    had = fs.exists(path(target))
    if had:
        fs.rename(path(target), path(old))
    if not fs.rename(path(stage), path(target)):
        if had:
            fs.rename(path(old), path(target))
        raise RuntimeError(f"could not publish {target}")
