"""Command line: canonical OCR documents of an engine's JSON results, and the catalogue's queries.

    python -m quirespark.cli ocr RESULTS --config CONFIG [--document-id ID] [--output FILE]
    python -m quirespark.cli run QUERY DIRECTORY [--output FOLDER]

``RESULTS`` is a text file or folder with one JSON result a page and line; a file is a document, its lines are its pages in order."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quirespark.operators import tokens
from quirespark.plans import catalogue
from quirespark.sources import config, writers


def parser() -> argparse.ArgumentParser:
    """The arguments of both commands."""
    p = argparse.ArgumentParser(prog="quirespark", description="Document-evidence analytics on Spark.")
    commands = p.add_subparsers(dest="command", required=True)
    ocr = commands.add_parser("ocr", help="canonical OCR JSON of an engine's results")
    ocr.add_argument("input", type=Path)
    ocr.add_argument("--config", type=Path, required=True, help="OCR settings (TOML)")
    ocr.add_argument("--document-id", help="id of a single document; the file's name if it isn't given")
    ocr.add_argument("--output", type=Path, help="a new file; standard output if it isn't given")
    run = commands.add_parser("run", help="a query of the catalogue")
    run.add_argument("query", choices=sorted(catalogue.queries()))
    run.add_argument("directory")
    run.add_argument("--output", help="a new folder of JSON lines; the first rows are shown if it isn't given")
    return p


def _documents(spark: SparkSession, path: Path, settings: dict, document_id: str | None) -> list[dict]:
    if not path.exists():
        raise FileNotFoundError(path)
    files = sorted(p for p in ([path] if path.is_file() else path.iterdir()) if p.is_file())
    if document_id and len(files) != 1:
        raise ValueError("an id is given to a single document")
    rows = [(str(f), document_id, k, line) for f in files for k, line in enumerate(f.read_text(encoding="utf-8").splitlines()) if line.strip()]
    results = tokens.with_document_ids(spark.createDataFrame(rows, "path string, document_id string, result_index int, payload string"))
    pages = tokens.engine_pages(results)
    if bad := tokens.engine_issues(pages).orderBy("document_id", "result_index").first():
        raise ValueError(f"{bad['document_id']}, page {bad['result_index']}: {bad['issue']}")
    model = {"name": settings["model_name"], "version": settings["model_version"], "source": settings["model_source"]}
    return [json.loads(r["json"]) for r in writers.ocr_json(tokens.from_engine(pages), model).orderBy("document_id").toLocalIterator()]


def main(argv: Sequence[str] | None = None) -> int:
    """Runs a command; 0 if it ended well, 1 with the error's message on standard error."""
    args = parser().parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        if args.command == "ocr":
            found = _documents(spark, args.input, config.ocr_settings(args.config), args.document_id)
            value = found[0] if len(found) == 1 else found
            if args.output is None:
                print(json.dumps(value, ensure_ascii=False, indent=2))
            else:
                args.output.parent.mkdir(parents=True, exist_ok=True)
                writers.write_exclusive(value, args.output)
        else:
            df = catalogue.queries()[args.query](spark, args.directory)
            if args.output is None:
                df.withColumns({c: F.col(c).cast("string") for c, kind in df.dtypes if kind == "binary"}).show(truncate=False)
            else:
                writers.write_json(df, args.output)
    except (OSError, ValueError, TypeError, RuntimeError) as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
