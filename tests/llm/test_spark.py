"""The operators over Spark: awkward rows, empty tables, and brute-force versions on small fixtures."""

import hashlib
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from leafloom.llm import ann, bpe, chat, extract, mixing, ngram_join, ogg, pii, queries, token_counts, toxicity
from leafloom.llm.queries import VOCABULARY

LONG = " ".join(f"w{i % 977} é{i}" for i in range(30_000))
#: Null ids and texts, empty and blank and very long texts, repeated rows, ids that repeat with another text.
ROWS = [(None, "a b c d e f"), (1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, "same words here and there now"), (5, "same words here and there now"), (6, "SAME words here and there now"), (7, "one"), (7, "two words"), (None, None), (8, "mail a.b@c.org <|endoftext|> 4111111111111111")]
#: Columns whose names the operators use within.
EXTRA = "n long, cls long, h long, key string, id long, p double, rate double, score double, spans string, x double, y int, quality int, toxic int, host string, content string"


@pytest.fixture(scope="module")
def awkward(spark):
    width = len(EXTRA.split(", "))
    return spark.createDataFrame([(i, t, None if t is None else len(t), *[None] * width) for i, t in ROWS], f"doc_id long, text string, n_chars long, {EXTRA}")


@pytest.fixture(scope="module")
def labels(spark, data):
    return spark.read.parquet(f"{data}/labels.parquet")


@pytest.fixture(scope="module")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


def of_documents(labels):
    return {
        "ngrams": lambda d: ngram_join.ngram_components(d),
        "mixing": lambda d: mixing.fit(d, labels, (0.6, 0.3, 0.1)),
        "media": lambda d: ogg.media_facts(ogg.media_column(d)),
        "toxicity": lambda d: toxicity.toxic_scores(d, labels),
        "pii": lambda d: pii.find_spans(d, pii.learn(d)),
        "redacted": lambda d: pii.redact(d, pii.learn(d)),
        "counts": lambda d: token_counts.count_tokens(d, VOCABULARY),
        "bpe": lambda d: bpe.round_trip_digests(d, VOCABULARY),
        "encoded": lambda d: bpe.decode_documents(bpe.encode_documents(d, VOCABULARY), VOCABULARY),
    }


@pytest.mark.parametrize("name", list(of_documents(None)))
def test_awkward_rows_are_each_answered(spark, awkward, labels, name):
    run = of_documents(labels)[name]
    found = run(awkward)
    key = "doc_id"
    assert Counter(r[key] for r in found.collect()) == Counter(i for i, _ in ROWS)
    assert run(awkward.limit(0)).count() == 0
    assert run(spark.createDataFrame([(None, None)], "doc_id long, text string")).count() == 1


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_stages_keep_the_columns(spark, awkward, data, stage):
    name, run = stage
    found = run(spark, awkward, data)
    assert name == "bpe" or found.columns == awkward.columns
    assert found.count() <= len(ROWS)
    assert run(spark, awkward.limit(0), data).count() == 0


def test_near_copies_stage_keeps_one_of_each(spark, awkward):
    kept = ngram_join.one_of_each(awkward).select("doc_id", "text").collect()
    found = Counter((r.doc_id, r.text) for r in kept)
    assert found[5, "same words here and there now"] == 1 and (6, "SAME words here and there now") not in found
    assert all(n == 1 for n in found.values()) and (None, None) in found and (2, "") in found


# --- n-gram join ---


def plain_components(rows):
    sets, up = {}, {i: i for i, _ in rows}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def near_copies(seed):
    """Groups whose members have a few edits each, some sharing a long passage: many are just over or under the threshold."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(4))
    passage = [word() for _ in range(60)]
    rows = []
    for _ in range(6):
        base = [word() for _ in range(r.choice([6, 40, 120]))] + (passage if r.random() < 0.5 else [])
        for _ in range(25):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5])):
                w[r.randrange(len(w))] = word()
            rows.append(" ".join(w[: len(w) - r.choice([0, 0, 1, 3])]))
    rows += ["", "x", "x", "x y", " ".join(passage)]
    r.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_components_are_those_of_all_pairs(spark, seed):
    rows = near_copies(seed)
    found = ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == plain_components(rows)


# --- nearest neighbours ---


def test_neighbours_are_found(spark, data):
    df = spark.read.parquet(f"{data}/embeddings.parquet")
    odd = spark.createDataFrame([(100_000, None), (100_020, [0.0] * 64), (100_040, [float("nan")] * 64), (100_060, [None] * 64), (100_080, [1.0]), (None, [1.0] * 64)], "vec_id long, embedding array<float>").withColumn("label", F.lit(0))
    found = ann.nearest(df.select("vec_id", "embedding", "label").unionByName(odd.select("vec_id", "embedding", "label"))).collect()
    rows = df.select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    by = defaultdict(list)
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        by[r.query_id].append(r)
    assert set(by) == {i for i in ids.tolist() if i % 20 == 0}
    hits = 0
    for q, got in by.items():
        s = x @ x[ids == q][0]
        s[ids == q] = -9
        hits += len({r.vec_id for r in got} & set(ids[np.lexsort((ids, -s))[:20]].tolist()))
        assert [r["rank"] for r in got] == list(range(1, 21)) and q not in {r.vec_id for r in got}
        assert [(-r.score, r.vec_id) for r in got] == sorted((-r.score, r.vec_id) for r in got)
        assert all(abs(r.score - s[ids == r.vec_id][0]) < 1e-12 for r in got)
    assert hits >= 0.9 * 20 * len(by)


def test_equal_vectors_and_few_rows(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(60)] + [(100, [2.0, 4.0])], "vec_id long, embedding array<float>")
    found = defaultdict(list)
    for r in sorted(ann.nearest(df).collect(), key=lambda r: (r.query_id, r.rank)):
        found[r.query_id].append(r.vec_id)
    assert found[40] == [100, *range(19)] and found[0] == [100, *range(1, 20)] and found[100] == list(range(20))
    assert ann.nearest(df.limit(0)).count() == 0
    assert [r.vec_id for r in ann.nearest(df.where("vec_id in (0, 1)")).collect()] == [1]


def test_equal_vectors_of_the_largest_norm(spark):
    r = np.random.default_rng(5)
    unit = r.standard_normal((4, 16))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    for copied, others in (([1.0, 0.0], [[0.5, 0.5]] * 3), (unit[0].tolist(), unit[1:].tolist())):
        df = spark.createDataFrame([(i, copied) for i in range(60)] + [(61 + i, v) for i, v in enumerate(others)], "vec_id long, embedding array<double>")
        found = defaultdict(list)
        for x in sorted(ann.nearest(df).collect(), key=lambda x: (x.query_id, x.rank)):
            found[x.query_id].append(x.vec_id)
        assert found == {0: list(range(1, 21)), 20: list(range(20)), 40: list(range(20))}


def test_cells_and_blocks_change_nothing_that_counts(spark, data, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 64)
    monkeypatch.setattr(ann, "QUERIES", 8)
    df = spark.read.parquet(f"{data}/embeddings.parquet")
    rows = df.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = Counter()
    for r in ann.nearest(df).collect():
        s = x @ x[ids == r.query_id][0]
        got[bool(np.count_nonzero(s > s[ids == r.vec_id]) <= 20)] += 1
    assert got[True] >= 0.9 * 20 * sum(i % 20 == 0 for i in ids.tolist())


def test_all_vectors_that_tie_are_compared(spark):
    """Eighty different vectors at one inner product from each query; the largest ids come first in the table."""
    at = np.linspace(0, np.pi, 80, endpoint=False)
    ties = [(1000 - i, [0.6, 0.8 * float(np.cos(a)), 0.8 * float(np.sin(a)), 0.0]) for i, a in enumerate(at) if (1000 - i) % 20]
    far = [(2001 + i, [-0.6, 0.0, 0.0, 0.8]) for i in range(30) if (2001 + i) % 20]
    df = spark.createDataFrame([(20, [1.0, 0.0, 0.0, 0.0]), *ties, *far], "vec_id long, embedding array<double>")
    found = [(r.vec_id, r.score) for r in ann.nearest(df).orderBy("rank").collect()]
    assert found == [(i, 0.6) for i in sorted(i for i, _ in ties)[:20]]


def test_clustered_vectors_are_found_without_visiting_all_leaves():
    r = np.random.default_rng(8)
    centers = r.standard_normal((40, 64))
    x = np.repeat(centers, 200, 0) + 0.2 * r.standard_normal((8000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    norm = float(np.linalg.norm(x, axis=1).max())
    p = ann.lifted(x, norm) @ ann.weights(64)
    asked = np.arange(0, 8000, 20)
    q = x[asked] * (norm / np.linalg.norm(x[asked], axis=1))[:, None]
    qp = np.concatenate([q, np.zeros((len(q), 1))], 1) @ ann.weights(64)
    seen, found = [0, 0], defaultdict(list)
    for who, rows, score in ann.search(q, qp, np.full(len(q), -norm * norm), x, p, 20, norm, ann.chi_square_quantile(ann.SURE, ann.DIMENSIONS), seen):
        for a, b, c in zip(who, rows, score, strict=True):
            found[a].append((-c, b))
    hits = 0
    for i in range(len(q)):
        hits += len({b for _, b in sorted(found[i])[:20]} & set(np.argsort(-(x @ q[i]), kind="stable")[:20].tolist()))
    assert hits >= 0.9 * 20 * len(q) and seen[0] < 0.3 * seen[1]


# --- mixing ---


def test_rates_meet_their_targets(spark):
    r = np.random.default_rng(4)
    p = r.dirichlet([1.0, 0.5, 0.3], 400)
    t = r.integers(1, 500, 400)
    df = spark.createDataFrame([(i, int(n), [float(v) for v in q]) for i, (n, q) in enumerate(zip(t, p, strict=True))], "doc_id long, n_tokens long, p array<double>")
    for most in (None, 1.0):
        found = mixing.rates(df, (0.5, 0.3, 0.2), most).orderBy("doc_id").collect()
        rate = np.array([x.rate for x in found])
        assert (rate >= 0).all() and (most is None or (rate <= most + 1e-12).all())
        at = (t * rate) @ p
        assert np.abs(at / at.sum() - [0.5, 0.3, 0.2]).max() < 2e-3
        if most is None:
            assert abs(at.sum() / t.sum() - 1) < 2e-3


def test_a_scarce_domain_meets_its_weight_unless_a_floor_is_given(spark):
    df = spark.createDataFrame([(i, 10, [0.9, 0.1] if i % 2 else [0.1, 0.9]) for i in range(400)], "doc_id long, n_tokens long, p array<double>")
    reached = {}
    for least in (0.0, 0.8):
        given = {"least": least} if least else {}
        found = mixing.rates(df, (0.85, 0.15), 1.0, **given).collect()
        at = np.sum([[x.n_tokens * x.rate * v for v in x.p] for x in found], 0)
        reached[least] = at[0] / at.sum()
    # the total that soft domains allow is a bound from above: 0.845 is reached
    assert abs(reached[0.0] - 0.85) < 0.01 and reached[0.8] < 0.835


# --- personal data ---


def test_potentials_are_fitted_to_all_documents(spark, documents):
    known = pii.learn(documents)
    plain = Counter()
    for r in documents.collect():
        plain += pii.cases(r.text or "", pii.graph(r.text or "", pii.base_spans(r.text or "")))
    wanted = pii.fitted(plain)
    assert plain and np.allclose(known.node, wanted.node) and np.allclose(known.skip, wanted.skip) and np.allclose(known.chain, wanted.chain)
    assert np.array_equal(pii.learn(documents.limit(0)).skip, pii.Field().skip)


def test_personal_data_is_found_and_masked_as_by_plain_code(spark, documents):
    crf = pii.learn(documents)
    df = documents.withColumn("n_chars", F.length("text").cast("int")).withColumn("n_email", F.lit("x"))
    wanted = {r.doc_id: pii.all_spans(r.text or "", crf) for r in documents.collect()}
    for r in pii.find_spans(df, crf).collect():
        base, every = wanted[r.doc_id]
        assert (r.spans, r.base_sha256, r.n_added) == (pii.shown(every), hashlib.sha256(pii.shown(base).encode()).hexdigest(), len(every) - len(base))
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[2] == k for x in base) for k in pii.KINDS]
    masked = pii.redact(df, crf)
    assert masked.dtypes == df.dtypes
    for r in masked.collect():
        assert r.n_chars == len(r.text) and not pii.base_spans(r.text) or r.text is None


# --- counts, media, chat, toxicity, extraction ---


def test_counts_are_kept_and_only_misses_are_encoded(spark, tmp_path):
    cache = str(tmp_path / "counts")
    a = spark.createDataFrame([(1, "a b"), (2, "a\tb"), (3, "c d e")], "doc_id long, text string")
    first = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(a, VOCABULARY, cache).collect()}
    assert first == {1: 2, 2: 2, 3: 3} and spark.read.parquet(cache).count() == 2
    b = a.union(spark.createDataFrame([(4, "new one")], a.schema))
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(b, VOCABULARY, cache, limit=2).where("over_limit").collect()} == {3: 3}
    assert spark.read.parquet(cache).count() == 3


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_other_libraries_count(spark, name):
    import public_tokenizers

    df = spark.createDataFrame([(1, "Hello  there\tyou"), (2, None)], "doc_id long, text string")
    found = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(df, public_tokenizers.path(name)).collect()}
    assert found[1] == token_counts.counter(public_tokenizers.path(name))(["Hello  there\tyou"])[0] > 0 and found[2] == 0


def test_chat_equals_plain_reading(spark, data):
    rows = spark.read.parquet(f"{data}/conversations.parquet").collect()
    odd = [(None, 1, "user", "x"), (77777, None, "assistant", None), (77777, 1, None, "<\\|a<|"), (77777, 1, None, "<\\|a<|")]
    df = spark.createDataFrame([tuple(r) for r in rows] + odd, "conv_id long, turn long, role string, text string")
    by = defaultdict(list)
    for c, t, r, x in [tuple(r) for r in rows] + odd:
        by[c].append((t is not None, t or 0, r or "", x or ""))
    for r in chat.conversation_digests(chat.format_turns(df)).collect():
        turns = sorted(by.pop(r.conv_id))
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{t[2]}\n{t[3]}\n" for t in turns).encode()).hexdigest()
        lost = "".join(t[3] for t in turns if t[2] == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(lost), hashlib.sha256(lost.encode()).hexdigest())
    assert not by
    assert chat.conversation_digests(chat.format_turns(df.limit(0))).count() == 0


def test_held_out_accuracy(spark):
    sf = os.environ.get("TEST_ACCURACY_DIR", "/root/testdata/sf0.01")
    docs, known = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    found = toxicity.toxic_scores(docs, known).where("held_out").join(known, "doc_id").select("predicted", "toxic").collect()
    assert sum(r.predicted == r.toxic for r in found) >= 0.93 * len(found) > 50


def test_exception_phrases_are_learned_and_matter(spark):
    plain = "we walked along the river and looked at the houses on the hill before lunch"
    rows = [(i, f"{plain} a clown {i}", 1) for i in range(40)] + [(100 + i, f"{plain} a clown fish {i}", 0) for i in range(40)] + [(200 + i, f"{plain} {i}", 0) for i in range(400)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    known = spark.createDataFrame([(r[0], r[2], 1) for r in rows], "doc_id long, toxic int, quality int")
    t = toxicity.Training(ratio=2.0)
    lexicon = toxicity.learn(docs, known, t)
    assert "clown fish" in lexicon.exceptions
    m = lexicon.matcher()
    assert m.score(f"{plain} a clown") >= 0.5 > m.score(f"{plain} a clown fish")
    lexicon.exceptions = []
    assert lexicon.matcher().score(f"{plain} a clown fish") >= 0.5


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_ordinary_words_are_not_toxic(spark, sf):
    docs, known = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    m = toxicity.learn(docs, known.where(~toxicity.held_out())).matcher()
    for text in ("We closed the distance and walked the path to the train station once more.", "The morning train was close to the track; discuss the distance tomorrow.", "Today we bake bread with flour and water."):
        assert m.score(text) < 0.5


def test_no_labels_is_no_crash(spark, documents, labels):
    assert toxicity.toxic_scores(documents.limit(5), labels.limit(0)).where("score > 0.01").count() == 0
    assert mixing.fit(documents.limit(5), labels.limit(0), (0.5, 0.5, 0.0)).count() == 5


def test_pages_give_their_articles(spark, data):
    df = spark.read.parquet(f"{data}/pages.parquet")
    found = {r.page_id: r.text for r in extract.extract(df).collect()}
    joined = {r.page_id: r.text for r in extract.extract(df, most_bytes=0).collect()}
    assert found == joined
    import html

    for r in df.collect():
        inner = re.search(r"<article>(.*?)(</article>|<footer|\Z)", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner.replace("<br>", " "))]
        assert found[r.page_id] == "\n".join(b for b in blocks if b)


def test_all_recurring_texts_of_a_list_are_counted(spark):
    notes = "".join(f"<li>Fixed line {k}</li>" for k in range(20))
    rows = [(i, "http://h/", f"<body><ul>{notes}</ul><p>Story {i}</p></body>") for i in range(6)]
    found = {r.page_id: r.text for r in extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == {i: f"Story {i}" for i in range(6)}


def test_a_full_wrapper_loses_no_template(spark):
    large = "".join(f"<div class=c{k}><p>Own {k}</p></div>" for k in range(300))
    rows = [(0, "http://h/", f"<body>{large}</body>")] + [(i, "http://h/", f"<body><table><tr><td>Read our paper daily<td>Cell {i}</table></body>") for i in range(1, 6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for given in (df.coalesce(1), df.orderBy(F.desc("page_id")).coalesce(1), df.repartition(3)):
        found = {r.page_id: r.text for r in extract.extract(given).where("page_id > 0").collect()}
        assert found == {i: f"Cell {i}" for i in range(1, 6)}


def test_what_a_wrapper_has_no_room_for_is_counted_by_its_labels(spark, monkeypatch):
    monkeypatch.setattr(extract, "MOST_NODES", 0)
    rows = [(i, "http://h/", f"<body><{'ul' if i % 2 else 'ol'}><li>Kind {i % 2}<li>Item {i}</body>") for i in range(8)]
    found = {r.page_id: r.text for r in extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == {i: f"Item {i}" for i in range(8)}


def test_template_inside_articles_goes_and_copies_stay(spark):
    make = lambda i: f"<body><article><p>Share this story now</p><p>Story {i} begins</p><p>and {i} ends</p><div class=bio><p>Written by our staff</p></div></article></body>"
    rows = [(i, f"http://h/{i}", make(i)) for i in range(4)] + [(10 + i, f"http://h/copy{i}", make(0)) for i in range(20)] + [(40 + i, "http://g/", make(7)) for i in range(9)]
    found = {r.page_id: r.text for r in extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(found[i] == f"Story {i} begins\nand {i} ends" for i in range(4))
    assert all(found[10 + i] == found[0] for i in range(20))
    assert all(found[40 + i].count("\n") == 3 for i in range(9))  # copies alone tell nothing


def test_many_trees_of_a_host_and_hot_hosts_change_nothing(spark, monkeypatch):
    rows = [(i, f"http://{'h' if i % 3 else 'g'}/", f"<body><article><h1>T {i}</h1>{'<p>x' * 0}{''.join(f'<div class=k{k}>{k} of {i}</div>' for k in range(9) if i >> k & 1)}<p>Subscribe to our letter</p></article></body>") for i in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = sorted(extract.extract(df).collect())
    assert sum(r.n_template for r in found) == 60 and not any("Subscribe" in r.text for r in found)
    monkeypatch.setattr(extract, "TREES", 8)
    monkeypatch.setattr(extract, "HOT_PAGES", 5)
    assert sorted(extract.extract(df, most_bytes=0).collect()) == found
    assert sorted(extract.extract(df.repartition(7)).collect()) == found


def test_awkward_pages(spark):
    df = spark.createDataFrame([(1, None, None), (2, "x", ""), (None, "http://h/", "<p>a"), (3, "http://h/", "<p>a"), (3, "http://h/", "<p>a"), (4, "http://h/", "<p>" * 2000)], "page_id long, url string, html string").withColumn("host", F.lit("q")).withColumn("text", F.lit("z"))
    found = Counter((r.page_id, r.text, r.n_chars) for r in extract.extract(df).collect())
    assert sum(found.values()) == 6 and found[1, "", 0] == found[2, "", 0] == found[4, "", 0] == 1
    assert extract.extract(df.limit(0)).count() == 0


def test_pipeline_runs(spark, data):
    found = corpus_pipeline.run(spark, data)
    ids = [r.doc_id for r in found.select("doc_id").collect()]
    assert 0 < len(ids) == len(set(ids))


def test_every_operator_has_its_query():
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES] == list(range(1, 14))
