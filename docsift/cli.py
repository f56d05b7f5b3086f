"""Command line: extract records from images, PDFs or text files."""

from __future__ import annotations

import argparse
import importlib
import json
import logging
import sys
import tempfile
from pathlib import Path

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.engine import Extractor
from docsift.operators.pages import merge_pages
from docsift.plans.schema import SchemaError, load_schema
from docsift.sources import readers

log = logging.getLogger("docsift")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="docsift", description=__doc__)
    source = p.add_mutually_exclusive_group()
    source.add_argument("--image", action="append", help="an image file, or a PDF; given again, each is a page of one document")
    source.add_argument("--pdf", help="a PDF file, whose pages are merged to one record")
    source.add_argument("--text-file", nargs="+", help="text files; of several, each is a page of one document in the order given")
    p.add_argument("--separate", action="store_true", help="each text file is a document of its own")
    p.add_argument("--plugin", action="append", default=[], help="a Python module that registers recognisers or a PDF renderer when it is imported")
    p.add_argument("--engine", default="auto", help="the recogniser of images; default: the first that can be made")
    p.add_argument("--strict-engine", action="store_true", help="no other recogniser than the requested one")
    p.add_argument("--list-engines", action="store_true", help="print the recognisers that can be used here, and end")
    p.add_argument("--no-morphology", action="store_true", help="don't look for ruled lines")
    p.add_argument("--no-pp-structure", action="store_true", help="don't use recognised table cells")
    how = p.add_mutually_exclusive_group()
    how.add_argument("--binarize", action="store_true", help="threshold images, in one attempt; default: both attempts, the better one counts")
    how.add_argument("--no-binarize", action="store_true", help="don't threshold images, in one attempt")
    p.add_argument("--dpi", type=int, default=300, help="resolution of drawn PDF pages")
    p.add_argument("--pages", help='pages of a PDF, as in "1,3-5"; default: all')
    p.add_argument("--keep-pages", action="store_true", help="keep the drawn pages of a PDF; their folder is printed to standard error")
    p.add_argument("--schema", help="JSON or YAML schema; default: environment, ./schema.json, the packaged one")
    p.add_argument("--out", help="file for the record (or folder for --separate); default: standard output")
    p.add_argument("--indent", type=int, default=2)
    p.add_argument("--debug", action="store_true", help="print source, score and place of every value to standard error")
    return p


def records_of(spark: SparkSession, extractor: Extractor, args: argparse.Namespace) -> DataFrame:
    """The records that the arguments ask for; OSError for a file that can't be read, EngineError without a plug-in."""
    paths = args.text_file or args.image or [args.pdf]
    for path in paths:
        with open(path, "rb"):
            pass
    if args.text_file and args.separate:
        return extractor.from_text(readers.read_texts(spark, *paths))
    if args.text_file:
        return extractor.from_pages(readers.read_text_pages(spark, *paths).select(F.lit("document").alias("doc_id"), "page", "text"))
    if args.pdf or (len(paths) == 1 and paths[0].lower().endswith(".pdf")):
        keep = tempfile.mkdtemp(prefix="docsift-pages-") if args.keep_pages else None
        if keep:
            print(f"docsift: drawn pages are in {keep}", file=sys.stderr)
        return extractor.from_pdfs(spark.read.format("binaryFile").load(paths[0]), args.pages, args.dpi, keep)
    images = [readers.read_images(spark, p).select(F.lit("document").alias("doc_id"), F.lit(k).alias("page"), "image") for k, p in enumerate(paths, 1)]
    pages = images[0]
    for more in images[1:]:
        pages = pages.unionByName(more)
    return merge_pages(extractor.from_images(pages, ("doc_id", "page")))


def main(argv: list[str] | None = None) -> int:
    """0 even if every field is missing; 1 for a schema or input that can't be read, or without a plug-in."""
    p = parser()
    args = p.parse_args(argv)
    logging.basicConfig(level=logging.DEBUG if args.debug else logging.INFO, format="%(levelname)s %(name)s: %(message)s", stream=sys.stderr)
    logging.getLogger("py4j").setLevel(logging.WARNING)
    plugins = [importlib.import_module(module) for module in args.plugin]
    if args.list_engines:
        print("engines:", ", ".join(readers.available_engines()) or "none")
        return 0
    if not (args.image or args.pdf or args.text_file):
        p.error("one of --image, --pdf and --text-file is needed")
    spark = SparkSession.builder.appName("docsift").getOrCreate()
    for module in plugins:  # so that workers needn't have them
        cloudpickle.register_pickle_by_value(module)
    try:
        extractor = Extractor(
            load_schema(args.schema), use_morphology=not args.no_morphology, use_regions=not args.no_pp_structure, engine=args.engine, strict=args.strict_engine,
            binarize=True if args.binarize else False if args.no_binarize else None,
        )
        records = records_of(spark, extractor, args)
    except (SchemaError, readers.EngineError, OSError) as why:
        print(f"docsift: {why}", file=sys.stderr)
        return 1
    found = extractor.json(records)
    if args.text_file and args.separate and args.out:
        found.select("json").write.mode("overwrite").text(args.out)
    elif args.text_file and args.separate:
        for row in found.toLocalIterator():
            print(row["json"])
    else:
        row = found.first()  # one document
        if row is None:
            print("docsift: the input has no page that can be read", file=sys.stderr)
            return 1
        record = json.loads(row["json"])
        shown = json.dumps(record, ensure_ascii=False, indent=args.indent)
        if args.out:
            Path(args.out).parent.mkdir(parents=True, exist_ok=True)
            Path(args.out).write_text(shown + "\n", encoding="utf-8")
        else:
            print(shown)
        if missing := [k for k, v in record.items() if v is None]:
            log.warning("no value for: %s", ", ".join(missing))
    if args.debug:
        for row in extractor.report(records).toLocalIterator():
            print(row["line"], file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
