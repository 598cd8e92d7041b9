"""Media folders, album feeds, catalogs and templates."""

from __future__ import annotations

from functools import reduce
from typing import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Category
from ..functions.names import IMAGE_EXTENSIONS, VIDEO_EXTENSIONS, basename, extension, is_video
from ..operators.filters import first_reason

_GRADE = (
    "struct<resolution:double,sharpness:double,noise:double,compression:double,color:double,exposure:double,"
    "focus:double,distortion:double,composite:double,blur_score:double>"
)
_ASSET = (
    "struct<hash:string,path:string,filename:string,source_label:string,device:string,media_type:string,date:string,"
    "age_days:int,category:string,status:string,reject_reason:string,face_count:int,faces_found:array<string>,"
    "has_target_face:boolean,face_distance:double,width:int,height:int,size_kb:double,duration:double,"
    "is_screenshot:boolean,nsfw:boolean,trash:boolean,gps_lat:double,gps_lon:double,location:string,"
    f"blur_score:double,photo_grade:{_GRADE},dhash:decimal(20,0),tags:array<string>,"
    "tag_meta:struct<model:string,embed_version:string,tagger_version:string,scores:map<string,double>>,"
    "has_clip:boolean,preference:string,cluster_id:string,is_representative:boolean,suppressed_by:string,"
    "cluster_size:int,estimated_age:double>"
)
CATALOG_SCHEMA = f"scan_date string, images array<{_ASSET}>"
ALBUM_SCHEMA = (
    "mediaItems array<struct<id:string,filename:string,mimeType:string,baseUrl:string,"
    "mediaMetadata:struct<creationTime:string,width:string,height:string,video:map<string,string>,photo:map<string,string>>>>"
)
TEMPLATE_SCHEMA = (
    "event_type string, display_name string, description string, categorization string, "
    "required_fields map<string,string>, tips array<string>, categories array<struct<id:string,display:string,"
    "target:int,video_target:int,age_days_from:int,age_days_to:int,day_offset:int,time_from:string,time_to:string,"
    "month_from:int,month_to:int,keywords:array<string>>>"
)


def scan_media(spark: SparkSession, sources: Iterable[tuple[str, str]], with_content: bool = False) -> DataFrame:
    """Media files below several folders, with label and source order. Without content only file metadata is read."""
    parts = []
    for ord_, (folder, label) in enumerate(sources):
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
        columns = ["path", "length", "modificationTime"] + (["content"] if with_content else [])
        parts.append(raw.select(*columns, F.lit(label).alias("source_label"), F.lit(ord_).alias("source_ord")))
    everything = reduce(lambda a, b: a.unionByName(b), parts)
    kind = extension("path")
    media = everything.filter(kind.isin(*IMAGE_EXTENSIONS, *VIDEO_EXTENSIONS))
    return media.withColumns({"filename": basename("path"), "extension": kind, "is_video": is_video("path")})


def flatten_album_feed(df: DataFrame) -> DataFrame:
    """Album items as rows: images only, videos dropped by type or by metadata."""
    rows = df.select(F.explode("mediaItems").alias("i")).select(
        "i.id", "i.filename", F.col("i.mimeType").alias("mime"), F.col("i.baseUrl").alias("url"),
        F.col("i.mediaMetadata").alias("_m"),
    )
    mime = F.lower(F.coalesce(F.col("mime"), F.lit("")))
    known = [F.endswith(mime, F.lit(e[1:])) for e in IMAGE_EXTENSIONS]
    image = reduce(lambda a, b: a | b, known) | F.contains(mime, F.lit("image"))
    return rows.filter(~F.contains(mime, F.lit("video")) & F.col("_m.video").isNull() & image).select(
        "id", "filename", "mime", "url", F.col("_m.creationTime").alias("created"),
        F.col("_m.width").try_cast("int").alias("width"), F.col("_m.height").try_cast("int").alias("height"),
    )


def read_album_feed(spark: SparkSession, path: str) -> DataFrame:
    return flatten_album_feed(spark.read.schema(ALBUM_SCHEMA).json(path, multiLine=True))


def _signed_hash(h: Column) -> Column:
    """Unsigned 64-bit hash of the JSON form as a signed long."""
    wide = h.cast("decimal(21,0)")
    return F.when(wide >= F.lit("9223372036854775808").cast("decimal(21,0)"),
                  wide - F.lit("18446744073709551616").cast("decimal(21,0)")).otherwise(wide).cast("long")


def import_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Assets of a JSON catalog document; dates and hashes become typed columns."""
    rows = spark.read.schema(CATALOG_SCHEMA).json(path, multiLine=True).select(F.explode("images").alias("a")).select("a.*")
    return rows.withColumns({"date": F.try_to_date("date", "yyyy-MM-dd"), "dhash": _signed_hash(F.col("dhash"))})


def write_catalog(df: DataFrame, folder: str, version: str) -> str:
    """Write a new catalog version; older versions stay readable until they are dropped."""
    target = f"{folder.rstrip('/')}/version={version}"
    df.write.mode("errorifexists").parquet(target)
    return target


def read_catalog(spark: SparkSession, folder: str, version: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/version={version}")


def read_templates(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(TEMPLATE_SCHEMA).json(folder, multiLine=True)


def list_templates(templates: DataFrame) -> DataFrame:
    """One row per event type."""
    return templates.select(
        "event_type", "display_name", "description", "categorization",
        F.size("categories").alias("num_categories"), F.array_sort(F.map_keys("required_fields")).alias("required_fields"),
    )


def template_categories(templates: DataFrame) -> DataFrame:
    """One row per category with its position in the list."""
    return templates.select("event_type", F.posexplode("categories").alias("ord", "c")).select("event_type", "ord", "c.*")


def load_template(spark: SparkSession, folder: str, event_type: str) -> list[Category]:
    """Categories of one event type in list form (bounded by the template file)."""
    from ..config import categories_from_rows

    return categories_from_rows(template_categories(read_templates(spark, folder).filter(F.col("event_type") == event_type)))


def read_changes(spark: SparkSession, path: str) -> DataFrame:
    """Edits made in a gallery report."""
    schema = "hash string, path string, filename string, category string, status string"
    return select_changes(spark.read.schema(schema).json(path, multiLine=True))


def select_changes(df: DataFrame) -> DataFrame:
    """Edits that assign a qualified row to a category."""
    return df.filter((F.col("status") == "qualified") & F.col("category").isNotNull())


def skip_counts(df: DataFrame, tests: list[tuple[str, Column]]) -> DataFrame:
    """Rows by the first test that removes them."""
    return df.groupBy(F.coalesce(first_reason(*tests), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))
