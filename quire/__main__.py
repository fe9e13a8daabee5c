"""python -m quire convert|triage|forms PATH...: documents to text, a report on pages, filled form fields."""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session() -> SparkSession:
    spark = SparkSession.builder.config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def pdf_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.pdf").load(paths)
    return files.select("path", F.xxhash64("path").alias("doc_id"), "content")


def convert(spark: SparkSession, args: argparse.Namespace) -> int:
    """One file a document in the folder `--out`, else to standard output; 1 if one could not be read."""
    from quire.operators import output
    from quire.operators.document import analyze
    from quire.sources.office import read_files
    from quire.sources.pdf import read_pdf, rules_and_fills

    status = 0
    for path in args.paths:
        if path.lower().endswith(".pdf"):
            files = pdf_files(spark, [path.rsplit("/", 1)[0] if "/" in path else "."]).where(F.col("path").endswith(path))
            glyphs = read_pdf(files, "glyphs")
            rules, fills = rules_and_fills(read_pdf(files, "shapes"))
            e = analyze(glyphs.where("error IS NULL").drop("error", "face"), read_pdf(files, "pages").where("error IS NULL").drop("error"), rules, fills, read_pdf(files, "outline").where("error IS NULL"))
            e = e.withColumns({"links": F.expr("CAST(array() AS ARRAY<STRUCT<uri: STRING, begin: INT, end: INT>>)"), "provenance": F.lit("layout"), "id": F.format_string("elem-%05d", "seq")})
            names, bad = files.select("path", "doc_id"), output.failures(glyphs)
        else:
            e = read_files(spark, path, listed_only=False)
            names, bad = e.select("path", "doc_id").distinct(), output.failures(e)
            e = e.drop("path", "error")
        if args.pages:
            e = output.part_of(e, args.pages)
        texts = output.render(e, args.format).join(names, "doc_id")
        if args.out:
            output.write_documents(output.destinations(texts, output.FORMATS[args.format][0]), args.out)
        else:
            for r in texts.orderBy("path").toLocalIterator():
                print(r["text"])
        for r in bad.limit(100).collect():
            status = 1
            print(f"{r['doc_id']}: {r['error']}", file=sys.stderr)
    return status


def triage(spark: SparkSession, args: argparse.Namespace) -> int:
    """Pages, routed pages and the share of glyphs with text of each PDF, as JSON lines."""
    from quire.operators import layout, lines
    from quire.sources.pdf import read_pdf

    files = pdf_files(spark, args.paths)
    parts = [read_pdf(files, p).where("error IS NULL").drop("error") for p in ("pages", "glyphs", "images")]
    for r in layout.triage(layout.routes(lines.signals(*parts))).join(files.select("doc_id", "path"), "doc_id").orderBy("path").toLocalIterator():
        print(json.dumps({k: r[k] for k in ("path", "pages", "routed", "unicode_rate")}))
    return 0


def forms(spark: SparkSession, args: argparse.Namespace) -> int:
    """Form fields of each PDF as JSON lines."""
    from quire.sources.pdf import read_pdf

    files = pdf_files(spark, args.paths)
    for r in read_pdf(files, "fields").join(files.select("doc_id", "path"), "doc_id").toLocalIterator():
        print(json.dumps({k: v for k, v in r.asDict().items() if v is not None and k != "doc_id"}))
    return 0


def timings(queries: dict, runs: int = 5) -> list[tuple[str, float]]:
    """(name, median seconds) of functions that return a DataFrame, the slowest first, after one run to warm up."""
    from statistics import median

    out = []
    for name, f in queries.items():
        took = []
        for _ in range(runs + 1):
            began = time.perf_counter()
            f().write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        out.append((name, median(took[1:])))
    return sorted(out, key=lambda x: -x[1])


def main(argv: list[str]) -> int:
    from quire.operators.output import FORMATS

    parser = argparse.ArgumentParser(prog="quire", description=__doc__)
    sub = parser.add_subparsers(required=True)
    for f in (convert, triage, forms):
        p = sub.add_parser(f.__name__, help=f.__doc__)
        p.add_argument("paths", nargs="+")
        p.set_defaults(run=f)
        if f is convert:
            p.add_argument("-f", "--format", choices=sorted(FORMATS), default="md")
            p.add_argument("-o", "--out")
            p.add_argument("--pages")
    args = parser.parse_args(argv)
    return args.run(session(), args)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
