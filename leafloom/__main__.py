"""python -m leafloom words|read DOCUMENTS -o OUT [--format json|parquet|csv] [--pretty] [--markdown FOLDER] [--profile JSON] [--strict]
python -m leafloom verify WORDS --ink CHARS --pages PAGES -o OUT

Exit 0, 1 (an error, or with verify a defect) or 2 (usage).
"""

from __future__ import annotations

import argparse
import json
import sys


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="leafloom", description="Words or typed blocks of a Parquet table of documents (doc_id, text), or a report of how words agree with the characters drawn on their pages.")
    parser.add_argument("command", choices=["words", "read", "verify"])
    parser.add_argument("documents", help="Parquet: documents, or with verify the words")
    parser.add_argument("-o", "--output", required=True)
    parser.add_argument("--format", choices=["json", "parquet", "csv"], default="json")
    parser.add_argument("--pretty", action="store_true", help="JSON over several lines, as a text file")
    parser.add_argument("--markdown", help="with read: a folder for the documents' Markdown")
    parser.add_argument("--profile", help="with read: a JSON object of tolerances, with an id of its own")
    parser.add_argument("--strict", action="store_true", help="with read: fail if something that was found is an error")
    parser.add_argument("--ink", help="with verify: Parquet of the drawn characters")
    parser.add_argument("--pages", help="with verify: Parquet of the pages")
    given = parser.parse_args(args)
    if given.command == "verify" and not (given.ink and given.pages):
        parser.error("verify needs --ink and --pages")

    from pyspark.errors import PySparkException
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from leafloom import api
    from leafloom.config import Profile
    from leafloom.errors import DocumentError
    from leafloom.operators import export
    from leafloom.plans.registry import reachable
    from leafloom.sources import typeset

    spark = SparkSession.builder.getOrCreate()
    reachable(spark)
    try:
        source = spark.read.parquet(given.documents)
        failed = False
        if given.command == "verify":
            found = api.verify_words(source, spark.read.parquet(given.ink), spark.read.parquet(given.pages))
            failed = found.where("not advisory").limit(1).count() > 0
        elif given.command == "words":
            found = typeset.prose_words(source)
        else:
            words = typeset.prose_words(source)
            zero = F.lit(0)
            pages = words.select("doc_id", "page").distinct().select("doc_id", "page", F.lit(typeset.PAGE_HEIGHT).alias("height"), zero.alias("invisible"), zero.alias("clipped"), zero.alias("overprinted"))
            found = api.read(words, pages, Profile(**json.loads(given.profile)) if given.profile else None, strict=given.strict).blocks
        if given.pretty:
            found.select(F.to_json(F.struct("*"), {"pretty": "true"})).write.mode("overwrite").text(given.output)
        else:
            found.write.format(given.format).mode("overwrite").save(given.output)
        if given.markdown and given.command == "read":
            export.document_markdown(found).write.mode("overwrite").json(given.markdown)
    except (PySparkException, DocumentError, ValueError, TypeError) as e:
        print(f"leafloom: {str(e).splitlines()[0]}", file=sys.stderr)
        return 1
    return int(failed)


if __name__ == "__main__":
    sys.exit(main())
