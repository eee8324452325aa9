"""From options and a catalog to models on every machine: resolve, fetch, check, ship."""

from __future__ import annotations

from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.registry import dictionary_url, download_plan, fonts, registry
from ..options import Options
from ..sessions import Factory, shipped_factory
from ..sources.assets import Asset, AssetError, Opener, fetch_assets, open_url, ship
from .pipeline import Models

Catalog = str | Path | Mapping


def wanted_files(spark: SparkSession, options: Options, catalog: Catalog) -> DataFrame:
    """task, kind (model or dictionary), url and sha256 of what the enabled stages need from the catalog.

    A recogniser whose own catalog row has no dictionary takes that of the first engine which has one. Stages with a
    ``model_path`` of their own need no model from here, a recogniser with ``rec_keys_path`` no dictionary.
    """
    known = registry(spark, catalog)
    plan = download_plan(options, known)
    models = plan.select("task", F.lit("model").alias("kind"), F.col("model_dir").alias("url"), "sha256")
    rec = options["Rec"]
    if rec["rec_keys_path"] or not options["Global"]["use_rec"]:
        return models
    asked = plan.where("task = 'rec'").withColumn("version", F.lit(rec["ocr_version"])).withColumnRenamed("dict_url", "_own")
    found = dictionary_url(asked, known).withColumn("url", F.coalesce("_own", "dict_url")).where("url is not null")
    return models.unionByName(found.select("task", F.lit("dictionary").alias("kind"), "url", F.lit(None).cast("string").alias("sha256")))


def _shipped(spark: SparkSession, rows: list, folder: str, opener: Opener) -> dict[str, Asset]:
    """Assets by URL of a few catalog rows; the first that fails is an error with its address."""
    plan = spark.createDataFrame([(r.url, r.sha256) for r in rows], "url string, sha256 string")
    done = fetch_assets(plan, folder, opener).collect()
    bad = sorted(f"{r.url}: {r.error}" for r in done if r.status == "failed")
    if bad:
        raise AssetError("; ".join(bad))
    sums = {r.url: r.sha256 for r in rows}
    return {r.url: ship(spark, r.path, sums[r.url]) for r in done}


def prepared_models(spark: SparkSession, options: Options, catalog: Catalog, folder: str, opener: Opener = open_url) -> Models:
    """Models of all enabled stages, fetched into ``folder`` (shared by all machines) where needed, and shipped."""
    rows = wanted_files(spark, options, catalog).collect()  # two for each of three stages at most
    for r in rows:
        if r.url is None:
            o = options[r.task.capitalize()]
            raise AssetError(f"the catalog has no {r.task} model for {o['engine_type']}, {o['ocr_version']}, {o['lang_type']}, {o['model_type']}")
    assets = _shipped(spark, rows, folder, opener) if rows else {}
    urls = {(r.task, r.kind): r.url for r in rows}

    def factory(task: str) -> Factory | None:
        o = options[task.capitalize()]
        if not options["Global"][f"use_{task}"]:
            return None
        asset = ship(spark, o["model_path"]) if o.get("model_path") else assets[urls[task, "model"]]
        return shipped_factory(o["engine_type"], asset)

    keys = options["Rec"]["rec_keys_path"]
    dictionary = ship(spark, keys) if keys else assets.get(urls.get(("rec", "dictionary")))
    return Models(factory("det"), factory("cls"), factory("rec"), dictionary=dictionary)


def prepared_font(spark: SparkSession, options: Options, catalog: Catalog, folder: str, opener: Opener = open_url, default: str = "ch") -> Asset:
    """The user's font file, else the catalog's for the recogniser's language, else that of ``default``."""
    if options["Global"]["font_path"]:
        return ship(spark, options["Global"]["font_path"])
    known = {r.lang: r for r in fonts(spark, catalog).select("lang", F.col("path").alias("url"), "sha256").collect()}
    row = known.get(options["Rec"]["lang_type"]) or known.get(default)
    if row is None:
        raise AssetError("the catalog has no font")
    return _shipped(spark, [row], folder, opener)[row.url]
