"""Queries and stages over the documents against plain Python, row by row."""

import hashlib
import zlib

import numpy as np
import pytest
import tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from leafloom.llm import bpe, mixing, ngram_join, ogg, pii, token_counts, toxicity
from leafloom.llm.queries import VOCABULARY
from tests.llm.test_spark import near_copies, plain_components


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return docs.collect()


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(VOCABULARY)


def test_media_facts_are_those_of_the_texts(docs, rows):
    found = {r.doc_id: r for r in ogg.media_facts(ogg.media_column(docs)).collect()}
    media = {r.doc_id: r.media for r in ogg.media_column(docs).collect()}
    assert len(found) == len(rows)
    for r in rows:
        data = (r.text or "").encode()
        payload = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        f = found[r.doc_id]
        assert (f.n_bytes, f.payload_bytes, f.payload_sha256, f.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (f.media_bytes, f.media_sha256) == (len(media[r.doc_id]), hashlib.sha256(media[r.doc_id]).hexdigest())
        assert ogg.read_payload(bytes(media[r.doc_id]))[0] == payload


def test_counts_and_ids_are_the_librarys(docs, rows, library, tmp_path, monkeypatch):
    counted = token_counts.count_tokens(docs, VOCABULARY, cache=f"{tmp_path}/counts")
    found = {r.doc_id: r for r in counted.collect()}
    coded = {r.doc_id: r for r in bpe.round_trip_digests(docs, VOCABULARY).collect()}
    for r in rows:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert (found[r.doc_id].n_tokens, found[r.doc_id].n_bytes, found[r.doc_id].over_limit) == (len(ids), len((r.text or "").encode()), len(ids) > 2048)
        c = coded[r.doc_id]
        assert (c.n_tokens, c.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert c.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    # all contents are in the cache now: nothing is encoded any more, whatever the encoder would say
    monkeypatch.setattr(token_counts, "counter", lambda path: lambda texts: 1 / 0)
    again = token_counts.count_tokens(docs, VOCABULARY, cache=f"{tmp_path}/counts").collect()
    assert {r.doc_id: r for r in again} == found


def test_posteriors_and_rates_are_those_of_one_machine(spark, docs, rows, data):
    labels = spark.read.parquet(f"{data}/labels.parquet")
    shares = (0.6, 0.3, 0.1)
    weights = mixing.learn(docs, labels, 3, mixing.domain_of())
    found = {r.doc_id: r for r in mixing.fit(docs, labels, shares).collect()}
    p = mixing.softmax(np.stack([mixing.figures(r.text or "") for r in rows]) @ weights)
    n = np.array([len((r.text or "").split()) for r in rows], float)
    assert all(np.allclose(found[r.doc_id].p, q) and found[r.doc_id].n_tokens == k for r, q, k in zip(rows, p, n, strict=True))
    rate = np.array([found[r.doc_id].rate for r in rows])
    at = (n * rate) @ p
    assert (rate >= 0).all() and np.abs(at / at.sum() - shares).max() < 1e-3 and abs(at.sum() / n.sum() - 1) < 1e-3
    assert np.allclose(rows and found[rows[0].doc_id].reached, at / at.sum()) and np.allclose(found[rows[0].doc_id].target, shares)


@pytest.mark.parametrize("small", [{"ENTRIES": 40, "PAIRS": 15, "RANGE": 300, "BROADCAST": 1}, {"BLOCK": 3, "FRAGMENTS": 2}])
def test_small_bounds_change_no_component(spark, monkeypatch, small):
    rows = near_copies(7)
    for name, n in small.items():
        monkeypatch.setattr(ngram_join, name, n)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == plain_components(rows)


def test_sets_of_one_class_are_told_apart(spark, monkeypatch):
    """Where two sets share a class, all is digested anew."""
    real = ngram_join.digests
    monkeypatch.setattr(ngram_join, "digests", lambda s, salt=0: (1 if len(s) and not salt else real(s, salt)[0], real(s, salt)[1]))
    rows = near_copies(3)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == plain_components(rows)


def test_stages_are_those_of_plain_code(spark, docs, rows, data, library):
    """Each stage of the pipeline on its own input."""
    texts = lambda df: {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
    labels = spark.read.parquet(f"{data}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    more = "/root/testdata/sf0.01"  # labels enough to learn from
    many = spark.read.parquet(f"{more}/documents.parquet")
    matcher = toxicity.learn(many, spark.read.parquet(f"{more}/labels.parquet").where(~toxicity.held_out())).matcher()
    kept = texts(stages["toxicity"](spark, many, more))
    plain = {r.doc_id: r.text for r in many.collect()}
    assert kept == {i: t for i, t in plain.items() if matcher.score(t or "") < 0.5} and 0 < len(kept) < len(plain)
    alone = texts(stages["ngram_join"](spark, docs, data))
    groups = plain_components([(r.doc_id, r.text) for r in rows])
    assert set(alone) == {i for i, (_, root) in groups.items() if root == i}
    crf = pii.learn(docs)
    masked = texts(stages["pii"](spark, docs, data))
    assert masked == {r.doc_id: None if r.text is None else pii.redacted(r.text, pii.all_spans(r.text, crf)[1]) for r in rows}
    domain = F.when(F.col("quality") == 1, 0).when(F.col("quality") == 0, 1)
    rate = {r.doc_id: r.rate for r in mixing.fit(docs, labels, corpus_pipeline.QUALITY, domain, most=1.0).collect()}
    draw = {r.doc_id: r.d for r in docs.select("doc_id", (F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) / float(1 << 40)).alias("d")).collect()}
    mixed = texts(stages["mixing"](spark, docs, data))
    assert set(mixed) == {i for i, d in draw.items() if d < rate[i]}
    for r in stages["bpe"](spark, docs, data).collect():
        own = next(x.text for x in rows if x.doc_id == r.doc_id)
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode(own or "", add_special_tokens=False).ids


@pytest.mark.parametrize(("counts", "width"), [([], 1), ([0, 255, 1], 1), ([256, 1], 2), ([65_536, 0, 3], 4)])
def test_counts_of_shingles_take_as_few_bytes_as_hold_them(counts, width):
    data = ngram_join._packed(np.array(counts, np.int64))
    assert len(data) == width * len(counts)
    assert ngram_join._counts(data, len(counts)).tolist() == counts
