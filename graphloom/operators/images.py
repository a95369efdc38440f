"""Image metadata of entities and relations."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom import schema as S
from graphloom.functions.text import strip
from graphloom.session import fixed_now, with_position


def add_images(images: DataFrame, owners: DataFrame, requests: DataFrame, owner: str = "entity_id", top_id: int = 0,
               filename_chars: int | None = None, caption_chars: int | None = None):
    """(new table, statuses): rows (req_idx, owner, filename, stored_path, thumb_path, caption) checked and trimmed.

    404 for a missing owner, 400 for a blank file name or path; file names and captions stay whole unless a
    length is given.
    """
    r = requests.join(owners.select(F.col("id").alias(owner), F.lit(True).alias("known")), owner, "left")
    text = lambda c: strip(F.coalesce(F.col(c), F.lit("")))
    cut = lambda c, n: c if n is None else F.substring(c, 1, n)
    status = F.when(F.col("known").isNull(), 404).when(text("filename") == "", 400).when(text("stored_path") == "", 400).otherwise(201)
    r = r.withColumn("status", status)
    ok = with_position(r.where("status = 201"), "req_idx").select(
        (F.col("pos") + top_id + 1).alias("id"), owner, cut(text("filename"), filename_chars).alias("filename"),
        text("stored_path").alias("stored_path"), text("thumb_path").alias("thumb_path"),
        cut(text("caption"), caption_chars).alias("caption"), fixed_now().alias("created_at"))
    cols = (S.ENTITY_IMAGES if owner == "entity_id" else S.RELATION_IMAGES).fieldNames()
    return images.select(*cols).unionByName(ok.select(*cols)), r.select("req_idx", "status")


def delete_images(images: DataFrame, ids: DataFrame):
    """(new table, statuses) for a table of image ids."""
    want = ids.select("id").distinct()
    there = images.select("id", F.lit(200).alias("s"))
    return images.join(want, "id", "left_anti"), want.join(there, "id", "left").select("id", F.coalesce("s", F.lit(404)).alias("status"))


def missing_files(images: DataFrame, listing: DataFrame) -> DataFrame:
    """Image rows whose ``stored_path`` is blank or not in the listing (path)."""
    return images.join(listing.select(F.col("path").alias("stored_path")).where("stored_path <> ''"), "stored_path", "left_anti")


def file_listing(spark, root: str) -> DataFrame:
    """Paths below ``root`` without reading any file content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    return files.select(F.substring_index("path", root.rstrip("/") + "/", -1).alias("path"))


def prune_missing_images(images: DataFrame, listing: DataFrame):
    """(kept rows, pruned rows)."""
    gone = missing_files(images, listing)
    return images.join(gone.select("id"), "id", "left_anti"), gone
