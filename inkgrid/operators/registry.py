"""Catalog of models, dictionaries and fonts as DataFrames, and how requests find their entry."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip

# Other names of languages, and the languages of the routed models.
LANG_ALIASES = {
    "zh": "ch", "zh_cn": "ch", "zh-cn": "ch", "zh_tw": "chinese_cht", "zh-tw": "chinese_cht", "ja": "japan", "jp": "japan", "ko": "korean",
}
ROUTED_LANGS = (
    "ch", "chinese_cht", "en", "japan", "af", "az", "bs", "ca", "cs", "cy", "da", "de", "es", "et", "eu", "fi", "fr", "ga", "gl", "hr", "hu", "id",
    "is", "it", "ku", "la", "lb", "lt", "lv", "mi", "ms", "mt", "nl", "no", "oc", "pl", "pt", "qu", "rm", "ro", "rs_latin", "sk", "sl", "sq", "sv",
    "sw", "tl", "tr", "uz", "vi", "french", "german",
)
#: Languages that a routed model type does not have.
NOT_IN = {"tiny": ("japan",), "small": (), "medium": ()}
#: Tasks and version whose models are found by a key made of task and model type.
ROUTED_TASKS, ROUTED_VERSION, KEY = ("det", "rec"), "PP-OCRv6", "multi_{version}_{task}_{model_type}"


def normalize_lang(lang: str) -> str:
    return str(lang).strip().lower()


def normalized(lang):
    """The same as an expression."""
    return F.lower(strip(lang))


def supported_langs(task: str, version: str, model_type: str | None = None) -> list[str]:
    if task not in ROUTED_TASKS or version != ROUTED_VERSION:
        return []
    types = [model_type] if model_type else list(NOT_IN)
    return sorted({x for t in types if t in NOT_IN for x in ROUTED_LANGS if x not in NOT_IN[t]})


def model_key(task: str, version: str, lang: str, model_type: str) -> str | None:
    """Key of a routed model; None if the version is not routed; ValueError for a language that it doesn't have."""
    if task not in ROUTED_TASKS or version != ROUTED_VERSION:
        return None
    lang = normalize_lang(lang)
    lang = LANG_ALIASES.get(lang, lang)
    if lang not in supported_langs(task, version, model_type):
        raise ValueError(f"{task} has no {model_type} model of {version} for the language {lang!r}")
    return KEY.format(version=version, task=task, model_type=model_type)


def aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LANG_ALIASES.items()), "alias string, lang string")


def routes(spark: SparkSession) -> DataFrame:
    """task, version, model_type, lang of all routed models."""
    langs = spark.createDataFrame([(t, x) for t in NOT_IN for x in supported_langs("det", ROUTED_VERSION, t)], "model_type string, lang string")
    tasks = spark.createDataFrame([(t, ROUTED_VERSION) for t in ROUTED_TASKS], "task string, version string")
    return tasks.join(langs)


def resolve_alias(df: DataFrame, lang: str = "lang") -> DataFrame:
    """Adds lang_resolved: the alias's language, else the language itself."""
    named = aliases(df.sparkSession).select(F.col("alias").alias("_alias"), F.col("lang").alias("_to"))
    df = df.withColumn("_lang", normalized(lang))
    return df.join(named, F.col("_lang") == F.col("_alias"), "left").withColumn("lang_resolved", F.coalesce("_to", "_lang")).drop("_lang", "_alias", "_to")


def with_support(df: DataFrame, task: str = "rec", version: str = ROUTED_VERSION, supported: bool = True) -> DataFrame:
    """Rows (lang_resolved, model_type) that a routed model exists for, or those that none exists for."""
    known = routes(df.sparkSession).where((F.col("task") == task) & (F.col("version") == version)).select("model_type", F.col("lang").alias("lang_resolved"))
    return df.join(known, ["lang_resolved", "model_type"], "left_semi" if supported else "left_anti")


def load_registry(source: str | Path | Mapping) -> list[tuple]:
    """Rows (engine, version, task, model_key, ord, model_dir, sha256, dict_url) of a catalog file, in the file's order."""
    tree = source if isinstance(source, Mapping) else yaml.safe_load(Path(source).read_text(encoding="utf-8"))
    rows = []
    for engine, versions in tree.items():
        if engine == "fonts":
            continue
        for version, tasks in versions.items():
            for task, models in tasks.items():
                rows += [(engine, version, task, key, i, x.get("model_dir"), x.get("SHA256"), x.get("dict_url")) for i, (key, x) in enumerate(models.items())]
    return rows


REGISTRY = "engine string, version string, task string, model_key string, ord int, model_dir string, sha256 string, dict_url string"


def registry(spark: SparkSession, source: str | Path | Mapping) -> DataFrame:
    return spark.createDataFrame(load_registry(source), REGISTRY)


def fonts(spark: SparkSession, source: str | Path | Mapping) -> DataFrame:
    tree = source if isinstance(source, Mapping) else yaml.safe_load(Path(source).read_text(encoding="utf-8"))
    return spark.createDataFrame([(k, x.get("path"), x.get("SHA256")) for k, x in tree.get("fonts", {}).items()], "lang string, path string, sha256 string")


def find_models(requests: DataFrame, models: DataFrame) -> DataFrame:
    """``requests(request_id, engine, version, task, lang, model_type)`` with their model.

    Routed versions have one key; else the first key in file order that begins with the language and contains the
    model type. Requests without a model stay, with nulls.
    """
    found = ["model_key", "model_dir", "sha256", "dict_url"]
    # every different question is answered once; what is asked of a routed version has one answer for all languages, so
    # there are no more answers than the catalog has models and ways to name them, and they can be sent to the requests
    what = ["engine", "version", "task", "lang", "model_type"]
    routed = F.col("version").eqNullSafe(ROUTED_VERSION) & F.col("task").isin(*ROUTED_TASKS)
    asked = requests.withColumn("_lang", F.when(~routed, F.col("lang")))
    key = F.when(routed, F.concat(F.lit("multi_"), "version", F.lit("_"), "task", F.lit("_"), "model_type"))
    r = asked.select(*(F.col("_lang" if c == "lang" else c).alias(c) for c in what)).distinct().withColumn("_key", key)
    m = models.select(*(F.col(c).alias(f"_{c}") for c in models.columns))
    fits = F.when(F.col("_key").isNotNull(), F.col("_model_key") == F.col("_key")).otherwise(F.col("_model_key").startswith(F.col("lang")) & F.col("_model_key").contains(F.col("model_type")))
    on = (F.col("engine") == F.col("_engine")) & (F.col("version") == F.col("_version")) & (F.col("task") == F.col("_task")) & fits
    answer = F.min_by(F.struct(*(F.col(f"_{c}").alias(c) for c in found)), F.col("_ord")).alias("_found")
    answers = r.join(m, on).groupBy(*what).agg(answer).select(*(F.col(c).alias(f"_a_{c}") for c in what), "_found")
    same = [F.col("_lang").eqNullSafe(F.col("_a_lang")) if c == "lang" else F.col(c) == F.col(f"_a_{c}") for c in what]
    out = asked.join(F.broadcast(answers), same, "left")
    return out.select(*requests.columns, *(F.col(f"_found.{c}").alias(c) for c in found))


def dictionary_url(requests: DataFrame, models: DataFrame, engines: Iterable[str] = ("paddle", "onnxruntime")) -> DataFrame:
    """Adds dict_url: that of the first engine which has one for the request's model key."""
    out, names = requests, []
    for i, engine in enumerate(engines):
        one = models.where(F.col("engine") == engine).select("version", "task", "model_key", F.col("dict_url").alias(f"_u{i}"))
        out = out.join(one, ["version", "task", "model_key"], "left")
        names.append(f"_u{i}")
    return out.withColumn("dict_url", F.coalesce(*names)).drop(*names)


def font_for(df: DataFrame, known: DataFrame, lang: str = "lang", default: str = "ch") -> DataFrame:
    """Adds font: the language's, else the default language's, else null."""
    f = known.select(F.col("lang").alias("_lang"), F.col("path").alias("_path"))
    d = known.agg(F.min(F.when(F.col("lang") == default, F.col("path"))).alias("_default"))  # one row, whatever the catalog has
    return df.join(f, df[lang] == F.col("_lang"), "left").join(F.broadcast(d)).withColumn("font", F.coalesce("_path", "_default")).drop("_lang", "_path", "_default")


def deduplicated(assets: DataFrame, path: str = "path", sha: str = "sha256") -> DataFrame:
    """One row per path; conflict marks paths with different checksums."""
    return assets.groupBy(path).agg(F.min(sha).alias(sha), (F.min(sha) != F.max(sha)).alias("conflict"), F.count(F.lit(1)).alias("n"))


class AssetConflict(ValueError):
    """One path with several checksums."""


def checked_assets(assets: DataFrame, path: str = "path", sha: str = "sha256") -> DataFrame:
    """``deduplicated`` without its marks; paths with different checksums are an error, which names up to ten of them."""
    found = deduplicated(assets, path, sha)
    bad = [r[0] for r in found.where("conflict").select(path).orderBy(path).limit(11).collect()]
    if bad:
        raise AssetConflict(f"different checksums for {', '.join(map(str, bad[:10]))}{' and others' if len(bad) > 10 else ''}")
    return found.select(path, sha)


def missing_files(wanted: DataFrame, there: DataFrame, path: str = "path") -> DataFrame:
    """The wanted paths that are not there, each once."""
    return wanted.select(path).distinct().join(there.select(path).distinct(), path, "left_anti")


def download_plan(options: Mapping, models: DataFrame) -> DataFrame:
    """The files that the enabled stages need: task, model_key, model_dir, sha256, dict_url."""
    rows = []
    for task, section in (("det", "Det"), ("cls", "Cls"), ("rec", "Rec")):
        o = options[section]
        if options["Global"][f"use_{task}"] and not o.get("model_path"):
            rows.append((task, o["engine_type"], o["ocr_version"], task, o["lang_type"], o["model_type"]))
    requests = models.sparkSession.createDataFrame(rows, "request_id string, engine string, version string, task string, lang string, model_type string")
    return find_models(requests, models).select("task", "model_key", "model_dir", "sha256", "dict_url")
