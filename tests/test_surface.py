"""Command line, streaming and configuration."""

import json
import subprocess
import sys
from pathlib import Path

import pytest

from leafloom import api, errors
from leafloom.__main__ import main
from leafloom.config import Lexicon, Profile
from leafloom.streaming import ingest


def test_commands_write(spark, data, tmp_path):
    assert main(["words", f"{data}/documents.parquet", "-o", f"{tmp_path}/w"]) == 0
    assert main(["read", f"{data}/documents.parquet", "-o", f"{tmp_path}/b", "--format", "csv", "--markdown", f"{tmp_path}/m"]) == 0
    assert spark.read.json(f"{tmp_path}/w").count() > spark.read.csv(f"{tmp_path}/b").count() > 0
    assert spark.read.json(f"{tmp_path}/m").count() > 0
    assert main(["read", f"{tmp_path}/missing", "-o", f"{tmp_path}/x"]) == 1
    with pytest.raises(SystemExit) as e:
        main(["verify"])
    assert e.value.code == 2


def test_verify_tells_lost_characters(spark, tmp_path):
    box = "x0 double, y0 double, x1 double, y1 double"
    spark.createDataFrame([(1, 1, 0, "ab", 0.0, 0.0, 20.0, 10.0)], f"doc_id long, page int, id long, text string, {box}").write.parquet(f"{tmp_path}/words")
    spark.createDataFrame([(1, 1, 612.0, 792.0, 0, 0, 0)], "doc_id long, page int, width double, height double, clipped long, invisible long, overprinted long").write.parquet(f"{tmp_path}/pages")
    ink = [(1, 1, i, c, "ink", False, 10.0 * i, 0.0, 10.0 * i + 10, 10.0) for i, c in enumerate("abx")]
    for name, rows, code in (("whole", ink[:2], 0), ("more", ink, 1)):
        spark.createDataFrame(rows, f"doc_id long, page int, index long, c string, kind string, clipped boolean, {box}").write.parquet(f"{tmp_path}/{name}")
        assert main(["verify", f"{tmp_path}/words", "--ink", f"{tmp_path}/{name}", "--pages", f"{tmp_path}/pages", "-o", f"{tmp_path}/report-{name}"]) == code
    assert [(r.code, r.text) for r in spark.read.json(f"{tmp_path}/report-more").collect()] == [("lost", "x")]


def test_profiles_and_strict_reading(spark, data, tmp_path):
    assert main(["read", f"{data}/documents.parquet", "-o", f"{tmp_path}/few", "--pretty", "--profile", json.dumps({"id": "own/1", "heading_max_words": 0})]) == 0
    assert '"kind" : "heading"' not in "".join(r.value for r in spark.read.text(f"{tmp_path}/few").collect())
    assert main(["read", f"{data}/documents.parquet", "-o", f"{tmp_path}/x", "--profile", json.dumps({"heading_max_words": 0})]) == 1
    findings = spark.createDataFrame([(1, 2, "no_text_layer", "error")], "doc_id long, page long, code string, severity string")
    with pytest.raises(errors.StrictModeError, match="document 1: no_text_layer on page 2"):
        api.no_errors(findings)
    api.no_errors(findings.limit(0))
    with pytest.raises(errors.SourceMismatch):
        api.same_sources(spark.createDataFrame([(1, "00")], "doc_id long, sha256 string"), spark.createDataFrame([(1, bytearray(b"x"))], "doc_id long, content binary"))


def test_the_package_imports_without_a_session():
    code = "import leafloom.plans.catalog, leafloom.api, leafloom.__main__; print(len(leafloom.plans.catalog.QUERIES))"
    assert int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=Path(__file__).parent.parent).stdout) > 150


def test_arriving_files_give_the_batchs_blocks(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    folder = f"{tmp_path}/in"
    for k in range(2):
        docs.where(f"doc_id % 2 = {k}").write.mode("append").parquet(folder)
        ingest.ingest(spark, folder, docs.schema, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == ingest.blocks_of(docs).count()


def test_changed_values_need_an_id():
    with pytest.raises(ValueError, match="furniture_share"):
        Profile(furniture_share=0.5)
    with pytest.raises(ValueError, match="bullets"):
        Lexicon(bullets=("x",))
    assert Profile(id="own/1", furniture_share=0.5).furniture_share == 0.5
