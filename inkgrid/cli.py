"""Command line: ``python -m inkgrid IMAGES [options]`` and the subcommands config, check, models and download."""

from __future__ import annotations

import argparse
import logging
import sys
from pathlib import Path

from .options import Options

log = logging.getLogger("inkgrid")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="inkgrid", description="Text lines of images.")
    p.add_argument("images", help="file, folder or glob; or one of: config, check, models, download")
    p.add_argument("target", nargs="?", help="config: where to write the default options; models and download: the catalog file")
    p.add_argument("--config", help="option file")
    p.add_argument("--set", action="append", default=[], metavar="KEY=VALUE", help="dotted override, e.g. Det.thresh=0.4")
    p.add_argument("--text-score", type=float, help="least score of a line")
    p.add_argument("--lang-type", help="language of the recogniser")
    p.add_argument("--det", help="detector model (ONNX)")
    p.add_argument("--cls", help="classifier model (ONNX)")
    p.add_argument("--rec", help="recogniser model (ONNX)")
    p.add_argument("--dict", dest="tokens", help="dictionary file, one token to a line")
    p.add_argument("--format", choices=("lines", "json", "markdown"), default="lines")
    p.add_argument("--words", action="store_true", help="boxes of words too")
    p.add_argument("--single-chars", action="store_true", help="boxes of single characters instead of words")
    p.add_argument("--vis", metavar="FOLDER", help="also write pictures of the pages with their boxes and texts (image_id, PNG content; Parquet)")
    p.add_argument("--out", help="folder for the result (JSON lines); default: print; download: the folder for the files (default: Global.model_root_dir)")
    p.add_argument("--most-failed", type=float, default=1.0, metavar="SHARE", help="fail if a larger share of the pages failed unexpectedly")
    return p


def options_of(args: argparse.Namespace) -> Options:
    import yaml

    options = Options.load(args.config) if args.config else Options()
    values = {k: yaml.safe_load(v) for k, _, v in (x.partition("=") for x in args.set)}
    if args.text_score is not None:
        values["Global.text_score"] = args.text_score
    if args.words or args.single_chars:
        values["Global.return_word_box"] = True
    if args.single_chars:
        values["Global.return_single_char_box"] = True
    if args.lang_type:
        values["Rec.lang_type"] = args.lang_type
    return options.with_values(values)


#: What the model doubles read on the page that is drawn for key 1.
EXPECTED = ["aca", "acb", "acb"]


def self_check() -> list[str]:
    """What is missing for a run: a drawn page is taken through detection, classification and recognition with model doubles."""
    from .operators.corpus import drawn_page
    from .plans.pipeline import Models, Page, _read_pages
    from .sessions import DarkSession, InkSession, UprightSession

    models, options = Models(DarkSession, UprightSession, lambda: InkSession(6), tuple("abcd")), Options()
    tree, use = {k: options[k] for k in options}, dict.fromkeys(("det", "cls", "rec"), True)
    page = Page("check")
    page.guarded(lambda p: p.find(drawn_page(1), models, tree, use))
    rows = _read_pages([page], models, tree, use, options.classifier_shape())
    read = [r.get("txt") for r in rows]
    return [] if read == EXPECTED else [rows[0].get("error") or f"{EXPECTED} was drawn, {read} was read"]


def download(spark, options: Options, catalog: str, folder: str | None) -> int:
    """Fetch the files that the options need; 1 if any of them can't be had."""
    from .plans.prepare import wanted_files
    from .sources.assets import fetch_assets

    folder = folder or options["Global"]["model_root_dir"]
    if not folder:
        raise SystemExit("download needs a folder: --out or Global.model_root_dir")
    wanted = wanted_files(spark, options, catalog)
    lacking = [f"{r.task} {r.kind}" for r in wanted.where("url is null").collect()]
    rows = fetch_assets(wanted, folder).collect()  # a few for each stage
    for r in sorted(rows):
        print(r.status, r.path, r.error or "", sep="\t")
    for x in lacking:
        print("missing", x, "the catalog has none", sep="\t")
    return int(bool(lacking) or any(r.status == "failed" for r in rows))


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.images == "config":
        print(Options().save(args.target or "inkgrid.yaml"))
        return 0
    if args.images == "check":
        missing = self_check()
        print("\n".join(missing) or "ok")
        return bool(missing)

    from pyspark.sql import Observation, SparkSession

    spark = SparkSession.builder.appName("inkgrid").getOrCreate()
    options = options_of(args)
    log.setLevel(str(options["Global"]["log_level"]).upper())
    if not log.handlers:
        log.addHandler(logging.StreamHandler())
    if args.images == "download":
        return download(spark, options, args.target, args.out)
    if args.images == "models":
        from .operators.registry import download_plan, registry

        download_plan(options, registry(spark, args.target)).show(truncate=False)
        return 0

    from .operators import layout
    from .plans.pipeline import Models, Pipeline, checked
    from .sessions import engine_factory
    from .sources.drawing import overlays
    from .sources.images import decode, read_dictionary, read_files

    make = lambda task: engine_factory(options[task.capitalize()]["engine_type"], getattr(args, task)) if getattr(args, task) else None
    models = Models(make("det"), make("cls"), make("rec"), tuple(read_dictionary(spark, args.tokens)) if args.tokens else None)
    one = Path(args.images).is_file()
    files = read_files(spark, args.images, Path(args.images).name if one else "*")
    pages = decode(files)
    seen = Observation("run")
    lines = Pipeline(models, options).transform(pages, seen)
    if args.vis:
        overlays(pages, lines, "beside", least=options["Global"]["text_score"]).write.mode("overwrite").parquet(args.vis)
    out = {"lines": lambda: lines, "json": lambda: layout.to_json(lines), "markdown": lambda: layout.to_markdown(lines)}[args.format]()
    if args.out:
        out.write.mode("overwrite").json(args.out)
    else:
        out.show(1000, truncate=False)
    checked(seen.get, args.most_failed)  # told to the log
    return 0


if __name__ == "__main__":
    sys.exit(main())
