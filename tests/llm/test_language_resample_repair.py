"""Language identification, importance resampling and repair of conversations: brute-force versions, held-out accuracy, awkward rows."""

import hashlib
import heapq
import math
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafloom.llm import language, repair, resample
from leafloom.llm.queries import op11_language, op12_resample, op13_repair
from tests.llm.test_spark import EXTRA, ROWS


@pytest.fixture(scope="module")
def awkward(spark):
    extra = f"{EXTRA}, part int, spot long, rank long, weight long, windows int, lang_pred int"
    return spark.createDataFrame([(i, t, "en" if t else None, *[None] * len(extra.split(", "))) for i, t in ROWS], f"doc_id long, text string, lang string, {extra}")


# --- language ---


def plain_grams(text, n):
    """Presence set by the definition: lower case letters, all else one gap, unknown letters end n-grams."""
    s = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    return {s[i : i + k] for k in range(1, n + 1) for i in range(len(s) - k + 1)}


def test_the_folded_matrix_is_the_kernel_machine():
    r = random.Random(5)
    word = lambda a: "".join(r.choice(a) for _ in range(r.randrange(1, 6)))
    learned = [(name, " ".join(word(a) for _ in range(30))) for _ in range(12) for name, a in (("x", "abcde"), ("y", "cdefg"), ("z", "efghéß"))]
    t = language.Training(features=10**6, landmarks=9, ridge=0.01)
    model = language.fitted(learned, t)
    vectors = [plain_grams(w, 3) for _, w in learned]
    every = {g for v in vectors for g in v if g.strip()}
    vectors = [v & every for v in vectors]
    kernel = lambda a, b: len(a & b) / math.sqrt(max(1, len(a)) * max(1, len(b)))
    landmarks = vectors[:: -(-len(vectors) // 9)]
    k = np.array([[kernel(a, b) for b in landmarks] for a in vectors])
    own = np.array([[kernel(a, b) for b in landmarks] for a in landmarks])
    wanted = np.array([[name == c for c in model.names] for name, _ in learned], float)
    weigh = 1 / 36
    alpha = np.linalg.solve(weigh * k.T @ k + t.ridge * own + 1e-9 * np.eye(len(own)), weigh * k.T @ wanted)
    for text in ("abc dab, CAB", "feg gge eff", "éßé ggh!", "a", "cde cde"):
        values = np.maximum(0, np.array([kernel(plain_grams(text, 3) & every, b) for b in landmarks]) @ alpha)
        names, scores = model.scorer().score([text])
        assert names == [model.names[values.argmax()]]
        assert scores[0] == pytest.approx(values.max() / values.sum(), abs=1e-4)


def test_long_texts_are_the_mean_of_their_windows_in_any_company():
    model = language.fitted([("x", "abc abd bda " * 30), ("y", "xyz zyx yyz " * 30)] * 3, language.Training(window=64))
    scorer = model.scorer()
    long = "abc bda " * 90 + "xyz " * 100
    texts = [None, "", "123 .,", "abd", long, "яб ж", "zyx", long, "x" * 200_000]
    names, scores = scorer.score(texts)
    assert names == [language.UNKNOWN] * 3 + ["x", "x", "x", "y", "x", "y"]
    assert scores[:3] == [0.0] * 3 and scores[5] == 0.0 and all(0 <= s <= 1 for s in scores)
    for t, n, s in zip(texts, names, scores, strict=True):
        assert scorer.score([t]) == ([n], [pytest.approx(s, abs=1e-6)])
    assert 0.5 < scores[4] < 0.9  # what begins the text doesn't decide alone


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_held_out_languages(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    found = op11_language(spark, f"/root/testdata/{sf}").join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    n, right = found.agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert right / n >= 0.995


def test_held_out_rows_and_ids_are_not_learned_from(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    found = {r.doc_id: r for r in language.languages(docs).collect()}
    assert {i for i, r in found.items() if r.held_out} == {i for i in found if crc32(str(i).encode()) % 3 == 1}
    wrong = docs.withColumn("lang", F.when(language.held_out(), "no").otherwise(F.col("lang"))).withColumn("source", F.lit("x"))
    assert {r.doc_id: r for r in language.languages(wrong).collect()} == found


def test_a_hot_group_of_copies_counts_once_and_rare_languages_are_learned(spark):
    r = random.Random(2)
    rows = [(3 * i, "the cat sat on the mat", "en") for i in range(3000)] + [(10_000 + i, " ".join(r.choice(["der", "hund", "und", "die", "katze"]) for _ in range(20)), "de") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").where(~language.held_out())
    learned = language.sample(df, language.Training(texts=5))
    assert Counter(x for x, _ in learned)["en"] == 1 and 5 <= Counter(x for x, _ in learned)["de"] <= 10
    model = language.fitted(learned, language.Training())
    assert model.scorer().score(["und der hund", "cat on mat"])[0] == ["de", "en"]


def test_awkward_texts_have_a_language(spark, awkward):
    found = language.languages(awkward)
    assert Counter(r.doc_id for r in found.collect()) == Counter(i for i, _ in ROWS)
    assert language.languages(awkward.limit(0)).count() == 0
    none = language.languages(awkward.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in none} == {(language.UNKNOWN, 0.0)}


# --- resampling ---


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_buckets(text):
    w = plain_words(text)
    return [crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


@pytest.mark.parametrize("n", [1, 2, 3, 5])
@pytest.mark.parametrize("most", [1, 5, 1000])
def test_the_ring_gives_every_run_of_words(monkeypatch, n, most):
    whole = resample.pieces
    monkeypatch.setattr(resample, "pieces", lambda data: whole(data, most))
    r = random.Random(n)
    for _ in range(200):
        text = "".join(r.choice("aBé1 .\n\x00") for _ in range(r.randrange(50)))
        w = plain_words(text)
        found = list(resample.ring(text.encode(), n))
        assert sum(k for k, _ in found) == len(w)
        assert sorted(x for _, f in found for x in f.tolist()) == sorted(crc32(" ".join(w[i : i + k]).encode()) for k in range(1, n + 1) for i in range(len(w) - k + 1))


def plain_resample(rows, target):
    s, t = Counter(b for _, x in rows for b in plain_buckets(x)), Counter(b for x in target for b in plain_buckets(x))
    every, aim = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (every + 10_000) / ((s[b] + 1) * (aim + 10_000))))
    out = []
    for i, x in rows:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, plain_buckets(x)))
        out.append((i, len(plain_buckets(x)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(plain_words(x))))
    may = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0]))
    place = {id(r): k for k, r in enumerate(may[: 5 * len(may) // 100], 1)}
    return Counter((*r[:4], place.get(id(r))) for r in out)


def test_ranks_are_those_of_plain_python(spark, data):
    docs, target = (spark.read.parquet(f"{data}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    wanted = plain_resample([(r.doc_id, r.text) for r in docs], [r.text for r in target])
    assert Counter(tuple(r) for r in op12_resample(spark, data).select("doc_id", "n_features", "weight", "score", "rank").collect()) == wanted
    assert sum(1 for r in wanted if r[4]) > 3


def test_equal_scores_and_copies_are_ranked_once(spark):
    text = " ".join(f"w{i}" for i in range(25))
    rows = [(i % 7, text) for i in range(300)] + [(None, text)] * 50 + [(1000 + i, f"{text} {i}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rank", F.lit("x"))
    target = spark.createDataFrame([(0, text)], "item_id long, text string")
    columns = ("doc_id", "n_features", "weight", "score", "rank")
    assert Counter(tuple(r) for r in resample.resample(df.repartition(5), target).select(*columns).collect()) == plain_resample(rows, [text])
    drawn = resample.draw(df, target)
    kept = Counter(r.doc_id for r in drawn.collect())
    ranks = [r for r in resample.resample(df, target).collect() if r.rank]
    assert drawn.columns == df.columns and all(kept[r.doc_id] == sum(i == r.doc_id for i, _ in rows) for r in ranks) and set(kept) == {r.doc_id for r in ranks}


def test_awkward_texts_are_weighed(spark, awkward):
    target = spark.createDataFrame([(0, None)], "item_id long, text string")
    found = resample.resample(awkward, target)
    columns = ("doc_id", "n_features", "weight", "score", "rank")
    assert Counter(tuple(r) for r in found.select(*columns).collect()) == plain_resample(ROWS, [None])
    assert resample.resample(awkward.limit(0), target.limit(0)).count() == 0 == resample.draw(awkward, target).count()


# --- repair ---


def plain_repair(rows):
    """Cheapest edits, and the least audit of them: the shortest path over (rows taken, what is there so far)."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, there, out = heapq.heappop(heap)
        state = there if there in ("", "s") else there[-1]
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", there):
            return cost, audit, list(out)
        if (i, state) in done:
            continue
        done.add((i, state))
        role = "assistant" if there[-1:] == "u" else "user"
        heapq.heappush(heap, (cost + 3, audit + "I", i, there + role[0], (*out, (role, ""))))
        if i < len(rows):
            (given, text), fault = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, there, out))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, there + role[0], (*out, (role, text))))
                if given[:1] == role[0] or given[:1] == "s" and not there:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, there + given[0], (*out, (given, text))))


def plain_faults(rows):
    seen, out = set(), []
    for role, text in rows:
        said = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def plain_digests(rows):
    every, kept = set(), defaultdict(list)
    for conv, turn, role, text in rows:
        every.add(conv)
        kind = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept[conv] += [(turn is not None, turn or 0, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv in every:
        now = sorted(kept[conv])
        pairs = [r[2:] for r in now]
        turns = {r[1] for r in now if r[0]}
        faults = plain_faults(pairs)
        cost, audit, repaired = plain_repair(list(zip(pairs, faults, strict=True)))
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(pairs, pairs[1:], strict=False))
        count = Counter(faults)
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{x}" for r, x in repaired).encode()).hexdigest())
    return out


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_repairs_are_the_cheapest(spark, sf):
    rows = spark.read.parquet(f"/root/testdata/{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    found = op13_repair(spark, f"/root/testdata/{sf}").collect()
    assert {r.conv_id: tuple(r)[1:] for r in found} == plain_digests(rows) and len(found) == len({r.conv_id for r in rows})


@pytest.mark.parametrize("held", [1, 4, 32])
def test_any_conversation_is_repaired(monkeypatch, held):
    monkeypatch.setattr(repair, "HELD", held)
    r = random.Random(held)
    for _ in range(600):
        rows = [(r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "u"]), r.choice(["a.", "b!", "c", "d", "e?", " ", "f.", "g.", "h."])) for _ in range(r.randrange(14))]
        faults = plain_faults(rows)
        parse, edits = repair.Parse(), []
        k = 0
        while k < len(rows):  # neighbours that are equal come as copies
            n = next((j for j in range(k + 1, len(rows)) if rows[j] != rows[k]), len(rows)) - k
            edits += parse.take(repair.Row(*rows[k], copies=n, seen=rows[k] in rows[:k]))
            k += n
        edits += parse.end()
        cost, audit, repaired = plain_repair(list(zip(rows, faults, strict=True)))
        assert (sum(e.cost for e in edits), "".join(e.edit for e in edits)) == (cost, audit)
        assert [(e.role, e.row.text if e.row else "") for e in edits if e.role is not None] == repaired
        assert [e.fault for e in edits if e.row] == faults


def test_long_conversations_are_held_in_part():
    r = random.Random(1)
    parse, most, n = repair.Parse(), 0, 0
    for i in range(20_000):
        n += len(parse.take(repair.Row(r.choice(["user", "assistant", "user", "assistant", "system"]), f"{i}{r.choice(['.', ''])}")))
        most = max(most, len(parse.rows))
    assert n + len(parse.end()) >= 20_000 and most <= 2 * repair.HELD


def test_awkward_conversations(spark):
    rows = [(None, None, None, None), (None, 1, "user", "a."), (1, None, "user", "b."), (1, None, "user", "b."), (1, 3, "", "c"), (2, 5, "system", "x" * 100_000), (2, 5, "assistant", "y."), (3, 0, "user", None), *((4, i, "user", "same.") for i in range(400)), *((9, 7, "user", "hot.") for _ in range(300)), *((k, 0, "user", "z.") for k in range(50, 150))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("cost", F.lit("x")).withColumn("seen", F.lit(1)).repartition(3)
    found = repair.conversation_digests(repair.repair(repair.damage(df))).collect()
    assert {r.conv_id: tuple(r)[1:] for r in found} == plain_digests(rows) and len(found) == 6 + 100
    assert any(r.audit == "" and r.repaired_sha256 == hashlib.sha256(b"").hexdigest() for r in found)
    assert repair.conversation_digests(repair.repair(df.drop("cost", "seen").limit(0))).count() == 0


def test_edits_lead_to_the_repaired_rows(spark):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "user", "Why?"), (1, 1, "user", "Why?"), (1, 2, "assistant", "So"), (1, 4, "user", " ")]
    found = repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert [(r.edit, r.role, r.text) for r in found] == [("I", "user", ""), ("K", "assistant", "Hello."), ("K", "user", "Why?"), ("D", None, None), ("K", "assistant", "So"), ("D", None, None)]
    assert [r.fault for r in found] == [None, None, None, "duplicate", "truncated", "blank"] and sum(r.cost for r in found) == 3 + 4 + 3 + 4


def test_intermediate_tables_go_by_release_and_when_the_driver_ends(tmp_path):
    """In a driver of its own, which stops its session before it ends, as scripts do."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[2]
    code = f"""
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.checkpoint.dir", "file://{tmp_path}/shared").config("spark.ui.enabled", "false").getOrCreate()
from pathlib import Path
from leafloom.llm.common import release, written
there = lambda: len(list(Path("{tmp_path}/shared").glob("leafloom-*")))
written(spark.range(3), "a"), written(spark.range(3), "b")
assert there() == 2 and release(spark) == 2 and there() == 0
assert written(spark.range(3), "c").count() == 3 and there() == 1
spark.stop()
assert there() == 1
"""
    done = subprocess.run([sys.executable, "-c", code], env=os.environ | {"PYTHONPATH": str(root)}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert not list(Path(tmp_path, "shared").glob("leafloom-*"))
