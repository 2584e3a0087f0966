"""Reading pages of words as documents, and verifying documents against a second reading of their pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafloom.config import Lexicon, Profile
from leafloom.errors import InvariantError, SourceMismatch, StrictModeError
from leafloom.operators import assemble, checks, ownership, verify
from leafloom.operators.assemble import Document


def read(words: DataFrame, pages: DataFrame, profile: Profile | None = None, lexicon: Lexicon | None = None, findings: DataFrame | None = None, strict: bool = False, rules: DataFrame | None = None, prove: bool = False) -> Document:
    """The documents of a page model. findings: doc_id, page, code, severity of the pages; strict: an error among them raises; rules: doc_id, page, axis, at, start, end of what is drawn; prove: a document that breaks a constraint raises (pages then have their width, too)."""
    out = assemble.assemble(words, pages, profile, lexicon, rules)
    if prove:
        no_violations(assemble.stored_documents(out, pages))
    if findings is not None:
        out.findings = out.findings.unionByName(findings.select("doc_id", F.col("page").cast("long").alias("page"), "code", "severity"))
    if strict:
        no_errors(out.findings)
    return out


def no_errors(findings: DataFrame) -> None:
    """Raise if something that was found is an error; one of them is named."""
    first = findings.where("severity = 'error'").orderBy("doc_id", "page", "code").first()
    if first is not None:
        raise StrictModeError(f"document {first.doc_id}: {first.code}" + (f" on page {first.page}" if first.page is not None else ""))


def no_violations(documents: DataFrame) -> None:
    """Raise if a stored document breaks a constraint. documents: doc, document (of the type ``checks.DOCUMENT``)."""
    first = checks.document_violations(documents).orderBy("doc", "rule").first()
    if first is not None:
        raise InvariantError(f"document {first.doc}: {first.rule}")


def same_sources(documents: DataFrame, files: DataFrame) -> None:
    """Raise if a file is not the one that its document was read from."""
    first = verify.same_source(documents, files).where("source = 'other'").orderBy("doc_id").first()
    if first is not None:
        raise SourceMismatch(f"document {first.doc_id} was read from another file")


def verify_words(words: DataFrame, chars: DataFrame, pages: DataFrame) -> DataFrame:
    """The report's defects of lost, doubled, invented and otherwise read characters. words, chars, pages: as for ``ownership.owned``."""
    found = ownership.owned(chars, words, pages)
    statuses = verify.page_statuses(pages, pages.withColumn("error", F.lit(None).cast("string")), pages.limit(0).select("doc_id", "page"))
    code = F.when(F.col("what") == "decoded", "decode").otherwise(F.col("what"))
    zero = F.lit(0.0)
    defects = found.where("what in ('lost', 'doubled', 'invented', 'decoded')").select("doc_id", "page", code.alias("code"), zero.alias("y0"), F.coalesce("id", "word").cast("double").alias("x0"), "text")
    return verify.report(statuses, defects)
