"""Stand-in corpora over the driver's tables: chunks from ``documents``, links and URLs from ``pages``, vectors from ``embeddings``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions.exprs import identity, link_anchor, link_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three stores; documents of one language and remainder are one path."""
    path = F.concat("lang", F.lit("/"), F.col("doc_id") % 7, F.lit(".md"))
    return table(spark, sf_dir, "documents").select(
        identity(F.col("text"), F.col("source"), path).alias("chunk_id"), F.col("source").alias("source_id"), path.alias("path"),
        F.col("doc_id").alias("position"), (F.col("doc_id") * 0).alias("char_offset"), F.col("text").alias("content"), (F.col("doc_id") % 3).cast("int").alias("store_idx"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with embeddings; every tenth has none."""
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("v"), F.col("vec_id")).alias("chunk_id"), (F.col("vec_id") % 3).cast("int").alias("store_idx"),
        F.when(F.col("vec_id") % 10 != 0, F.col("embedding")).alias("embedding"),
    )


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"])


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    heading = F.regexp_extract("html", r"<h1>([^ <]*)", 1)
    return table(spark, sf_dir, "pages").select(
        F.concat(F.lit("p"), F.col("page_id")).alias("chunk_id"), F.concat(F.lit("site"), F.col("page_id") % 4).alias("source_id"),
        F.concat(F.lit("/"), heading).alias("canonical_url"), F.concat(F.lit("/"), heading).alias("path"), F.col("page_id").alias("seq"), (F.col("page_id") % 2).cast("int").alias("store_idx"),
    )


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The URL index: the last page of a URL owns it."""
    return pages(spark, sf_dir).groupBy("canonical_url").agg(F.max_by("chunk_id", "seq").alias("chunk_id"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    href = F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("place", "url")
    return table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), F.col("page_id")).alias("src_chunk_id"), href).select(
        "src_chunk_id", F.col("place").cast("long").alias("place"), link_path(F.col("url")).alias("target_path"), link_anchor(F.col("url")).alias("anchor")
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(spark, sf_dir).select("src_chunk_id", "target_path").distinct()


def stored_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A remembered listing: three files in four, some of them from an earlier time, some under another identity."""
    d = table(spark, sf_dir, "documents")
    return d.where("doc_id % 4 <> 0").select(
        F.col("source").alias("source_id"), F.concat(F.lit("f"), F.col("doc_id")).alias("fs_rel"),
        (F.col("n_chars") - F.col("doc_id") % 3 + 1).alias("mtime"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("c"), F.expr("doc_id div 10"))).alias("contract_path"),
    )


def current_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing now: four files in five, with the identity that their frontmatter tells."""
    d = table(spark, sf_dir, "documents")
    return d.where("doc_id % 5 <> 0").select(
        F.col("source").alias("source_id"), F.concat(F.lit("f"), F.col("doc_id")).alias("fs_rel"), F.col("n_chars").alias("mtime"),
        F.concat(F.lit("c"), F.expr("(doc_id + 20) div 40")).alias("path"),
    )
