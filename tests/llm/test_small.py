"""The operators' parts without a cluster: codecs, parsers, matchers."""

import itertools
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leafloom.llm import chat, extract, ngram_join, ogg, pii, shingles, toxicity
from leafloom.llm.queries import VOCABULARY

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def bpe():
    from leafloom.llm.bpe import WordBpe

    return WordBpe(VOCABULARY)


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(VOCABULARY)


ODD = ["", " ", "a", "<|endoftext|>", "x<|startoftext|>y <|ENDOFTEXT|>", "I'LL don't 's", "ΑΣ ς Σ", "é ﬁ ½ ٣ ㍿", "\x1cab\x85c d​e", "naïve🙂🙂", "aethingtion" * 500, "\x00\x01", "한국어 조합", "İstanbul"]


@pytest.mark.parametrize("text", ODD)
def test_ids_are_the_librarys(bpe, library, text):
    found = library.encode(text, add_special_tokens=False).ids
    assert bpe.encode(text) == found
    assert bpe.decode(found) == library.decode(found, skip_special_tokens=False)


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_any_text_gives_the_librarys_ids(text):
    from leafloom.llm.bpe import codec

    assert codec(VOCABULARY).encode(text) == _library().encode(text, add_special_tokens=False).ids


def _library(held=[]):  # noqa: B006
    if not held:
        held.append(tokenizers.Tokenizer.from_file(VOCABULARY))
    return held[0]


def test_random_words_give_the_librarys_ids(bpe, library):
    r = random.Random(3)
    for _ in range(500):
        text = "".join(r.choice("etaoinshrdlu") for _ in range(r.randint(1, 80)))
        assert bpe.encode(text) == library.encode(text, add_special_tokens=False).ids


# --- Ogg ---


def slow_checksum(data: bytes) -> int:
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1) ^ (0x104C11DB7 if crc & 0x80000000 else 0)
    return crc


def test_checksum_is_the_formats():
    r = random.Random(1)
    for n in (0, 1, 7, 300):
        data = r.randbytes(n)
        assert ogg.checksum(data) == slow_checksum(data)


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 254, 255, 256, 7999, 8000, 8001, 65_025, 65_026, 300_000])
def test_media_give_back_what_they_hold(n):
    text = random.Random(n).randbytes(n).hex()[:n]
    payload, size = ogg.padded(text)
    assert len(payload) % 64 == 0 and len(payload) > 0
    media = ogg.encode(payload, size)
    back, n_bytes, marks = ogg.read_payload(media)
    assert (back, n_bytes) == (payload, n)
    assert marks[-1][0] == len(payload) / ogg.RATE
    assert zlib.crc32(back[-64:]) == zlib.crc32(payload[-64:])


def test_damage_is_found():
    payload, size = ogg.padded("abc" * 5000)
    media = bytearray(ogg.encode(payload, size))
    media[len(media) // 2] ^= 1
    with pytest.raises(ogg.OggError):
        ogg.read_payload(bytes(media))
    with pytest.raises(ogg.OggError):
        ogg.read_payload(bytes(ogg.encode(payload, size)[:-3]))


# --- chat ---


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\\\nb"]), st.text(alphabet="ab<|>\\\n/im_endstar é", max_size=40)), max_size=6))
@settings(max_examples=200, deadline=None)
def test_turns_are_read_back(turns):
    roles, texts = pa.array([t[0] for t in turns], pa.string()), pa.array([t[1] for t in turns], pa.string())
    column, begin, end = chat.assemble(roles, texts)
    assert len(column) == len(turns)
    for data, a, b, (role, text) in zip(column, begin, end, turns, strict=True):
        found = chat.TURN.fullmatch(data.as_py())
        assert chat.unescape_role(found[1]).decode() == role
        assert chat.unescape(found[2]).decode() == text == chat.unescape(data.as_py()[a:b]).decode()


# --- personal data ---


def plain_spans(t):
    luhn = lambda d: sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(d[::-1])) % 10 == 0
    out = [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end(), "card"))
    out += [(m.start(), 3, m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return [(a, b, k) for a, _, b, k in sorted(out)]


@given(st.text(alphabet="ab1250.@+-() \n%_é", max_size=60))
@settings(max_examples=500, deadline=None)
def test_base_spans_are_the_patterns(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_base_spans_of_long_runs_are_quick():
    for text in ("1" * 200_000, "a" * 200_000, "a." * 100_000 + "@", "@" * 100_000, "1." * 100_000):
        pii.base_spans(text)
    assert pii.base_spans("x 4111 1111 1111 1111, 10.0.0.1") == plain_spans("x 4111 1111 1111 1111, 10.0.0.1")


TOLD = [f"call +{k} ({100 + k}) 555-{1000 + k} or mail a.b{k}@x{k}.com or 10.0.0.{k}, 4111 1111 1111 1111 and {10**13 * 41 + k}" for k in range(60)]


@pytest.fixture(scope="module")
def crf():
    return pii.fitted(sum((pii.cases(t, pii.graph(t, pii.base_spans(t))) for t in TOLD), Counter()))


def added(text, crf):
    base, every = pii.all_spans(text, crf)
    assert base == pii.base_spans(text) and set(base) <= set(every)
    return [(text[a:b], k) for a, b, k in every if (a, b, k) not in base]


@pytest.mark.parametrize(
    "text, wanted",
    [
        ("Mail jo.smith@x.com now. So said Bob Smith, and later Smith wrote. jo.smith too.", []),  # names inform, but are no addresses
        ("Call +1 (017) 555-7713, or 017-555-7713, or 0175557713. Order 1234567890 of 1999.", [("017-555-7713", "phone"), ("0175557713", "phone")]),
        ("0175557713 " + "and 0175557713 " * 40 + "word " * 500 + "+1 (017) 555-7713", [("0175557713", "phone")] * 41),
        ("the smithy of smith: smith@x.com. Smith works, said Smith", []),
        ("Order 1234567890, order 1234567890, 1.2.3.999 and 4111 1111 1111 1112", []),
        ("jo.smith wrote; Smith wrote", []),
    ],
)
def test_skip_edges_carry_labels_to_twins(crf, text, wanted):
    assert added(text, crf) == wanted
    assert added(text, pii.Field(crf.node, crf.chain, np.zeros((5, 5)))) == []


def test_messages_are_exact_on_trees(crf):
    """Against the sum over all labellings, where the edges form no loop."""
    text = "x +1 (017) 555-7713 y 0175557713 z 017 555 7713"
    g = pii.graph(text, pii.base_spans(text))
    g.hubs = [g.hubs[0]]
    total = np.zeros((len(g.spots), 5))
    for labels in itertools.product(range(5), repeat=len(g.spots) + 1):
        *own, hub = labels
        if any(x >= 0 and x != y for x, y in zip(g.given, own, strict=True)):
            continue
        w = sum(crf.node[c][y] + (pii.MISSED if x < 0 and y else 0) for c, x, y in zip(g.classes, g.given, own, strict=True))
        w += sum(crf.chain[own[i], own[j]] for i, j in g.chain) + sum(crf.skip[own[i], hub] for i in g.hubs[0])
        for i, y in enumerate(own):
            total[i, y] += np.exp(w)
    assert np.allclose(crf.beliefs(g), total / total.sum(1, keepdims=True), atol=1e-3)


def test_the_field_is_quick_on_long_texts(crf):
    began = time.time()
    for text in ("1" * 200_000, "1234567 " * 50_000, "x@ " * 50_000 + "joe.smith@x.com " + "Smith " * 50_000, "+4917012345678 " * 5_000 + "017012345678 " * 20_000):
        pii.all_spans(text, crf)
    assert time.time() - began < 30


def test_redaction_covers_overlaps():
    assert pii.redacted("ab cd ef", [(0, 2, "ip"), (1, 5, "card")]) == "[IP] ef"


# --- toxicity ---


def test_folding_and_exceptions():
    lexicon = toxicity.Lexicon(weights={"idiot": 5.0, "scum": 5.0}, exceptions=["scumble"], slope=1.0, bias=-5.0)
    m = lexicon.matcher()
    plain = m.density("you idiot there")
    assert plain > 0
    for text in ("you 1d10t there", "you IDIOT there", "you іdіоt there", "you id­iot there"):
        assert m.density(text) == pytest.approx(plain)
    assert m.density("scumble here") == 0 < m.density("scum here")
    assert m.density("unidiotic") == 0
    assert m.score("") == m.score("clean words") < 0.5
    assert m.density("idiot " + "word " * 500) < m.density("idiot " + "word " * 5)


def plain_density(lexicon, text):
    """Every place, every entry, every exception."""
    words = toxicity.fold(text).split()
    s = " ".join(words)
    total = 0.0
    for at in range(len(s)):
        best = 0.0
        for entry, w in lexicon.weights.items():
            stem = entry.rstrip(" ")
            end = at + len(stem)
            if s[at:end] != stem or at and s[at - 1].isalpha() or entry.endswith(" ") and s[end : end + 1].isalpha():
                continue
            covered = any(s[a : a + len(x)] == x and not (a and s[a - 1].isalpha()) and not s[a + len(x) : a + len(x) + 1].isalpha() and a + len(x) >= end for x in lexicon.exceptions for a in range(at + 1))
            if not covered:
                best = max(best, w)
        total += best
    return 100.0 * total / (len(words) + lexicon.words_added)


@given(st.lists(st.sampled_from(["scum", "scums", "bag", "scumbag", "clown", "fish", "clown fish", "the", "sc0m", "5cum", ",", "clownfish", "a.", "scum-bag"]), max_size=12))
@settings(max_examples=300, deadline=None)
def test_matches_are_those_of_plain_search(words):
    lexicon = toxicity.Lexicon(weights={"scum ": 3.0, "scum": 2.0, "scumb": 4.0, "clown": 5.0, "bag ": 1.0}, exceptions=["clown fish", "the scum", "scumbag the", "clownfish"])
    text = " ".join(words)
    assert lexicon.matcher().density(text) == pytest.approx(plain_density(lexicon, text))


def test_many_hits_and_exceptions_are_quick():
    lexicon = toxicity.Lexicon(weights={"clown ": 5.0}, exceptions=["clown fish"])
    began = time.time()
    assert lexicon.matcher().density("clown fish " * 200_000 + "clown") > 0
    assert time.time() - began < 10


# --- extraction ---


def plain_wrapper(pages):
    """A wrapper with its counts, page by page."""
    wrapper = extract.merged(extract.tree_of(extract.parse(p)[0]) for p in pages)
    held = extract.in_order(wrapper)
    for w in held:
        w[1] = 0
    for p in pages:
        root, blocks = extract.parse(p)
        place = extract.places(root, wrapper)
        for at, rest in set(place.values()):
            held[at][1] += not rest
        for at, key in {(place[id(b.node)][0], str(extract.text_key(b.text, place[id(b.node)][1]))) for b in blocks}:
            held[at][2][key] = held[at][2].get(key, 0) + 1
    return wrapper


@pytest.mark.parametrize("page", ["<a" * 10**6, "<a '" * 10**5, "<a '>'" * 10**5, "<div>" * 10**5 + "x", "<div>" * 10**5 + "</x>" * 10**5, "<i><div>" + "<b>" * 10**5 + "</i>" * 10**5, "<blockquote>" * 10**5, "<!" * 10**5, "<![CDATA[" * 10**5, "&#" + "9" * 10**5 + ";", "".join(f"<div class=c{i}>{i}</div>" for i in range(30_000)), "<p>x<h2>y" * 30_000, "<p><table>" * 30_000], ids=range(13))
def test_hostile_pages_take_time_in_proportion(page):
    began = time.time()
    root, _ = extract.parse(page)
    extract.places(root, extract.tree_of(root))
    assert time.time() - began < 5


def test_references_and_links():
    assert extract.content("<p>&#65;&#x00041;&#0;&#xffffffffff;&nbsp;b &lt;&copy;", None)[0] == "AA\ufffd\ufffd b <\xa9"
    menu = "<ul><li><a>One</a><li><a>Two</a><li><a>Three</a></ul>"
    assert extract.content(f"{menu}<p><a>All of this paragraph is a link</a>", None)[0] == "All of this paragraph is a link"
    assert extract.content(f"<article>{menu}</article>", None)[0] == "One\nTwo\nThree"


def test_article_without_what_stands_around():
    page = "<header><h1>Site</h1></header><nav><a href=x>Home</a></nav><div class='cookie-notice'>ok?</div><article><header><h1>T &amp; U</h1></header><p>One <b>two</b>&nbsp;three<p>4 < 5<script>var a='</p>'</script><div class=comments><p>no</p></div></article><form>f</form><aside>s</aside><footer>e</footer>"
    assert extract.content(page, None) == ("T & U\nOne two three\n4 < 5", 0)


def test_recurring_texts_are_template():
    make = lambda i: f"<body><div class=top><p>Read our paper daily</p></div><div><p>Story {i} begins</p><p>and {i} ends</p></div><p>Share this now</p></body>"
    wrapper = plain_wrapper([make(i) for i in range(6)])
    assert extract.content(make(9), wrapper) == ("Story 9 begins\nand 9 ends", 2)
    assert extract.content(make(9), None)[0].count("\n") == 3


@pytest.mark.parametrize("page", ["", "<", "<p", "a<b", "<!--", "<script>", "</div></p>", "<p>" * 3000, "<table><tr><td>a<td>b<tr>", "<a href='x>y"])
def test_broken_markup_is_read(page):
    extract.content(page, None)


# --- shingles ---


def plain_shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


@given(st.lists(st.text(alphabet="abAB É\n\x1c\t", max_size=60), min_size=1, max_size=8))
@settings(max_examples=200, deadline=None)
def test_sets_are_those_of_the_words(texts):
    found = list(shingles.sets(pa.array(texts, pa.string())))
    plain = [plain_shingles(t) for t in texts]
    assert [len(s) for s in found] == [len(p) for p in plain]
    for i, a in enumerate(plain):
        for j, b in enumerate(plain):
            assert len(np.intersect1d(found[i], found[j])) == len(a & b)


def test_only_empty_sets_have_class_0():
    assert ngram_join.class_of(np.zeros(0, np.uint64)) == 0 != ngram_join.class_of(np.array([1], np.uint64))
