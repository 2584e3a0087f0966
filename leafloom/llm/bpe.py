"""BPE encoding and decoding with a word-end vocabulary.

The encoder is a backtracking one. An Aho-Corasick automaton over the vocabulary gives, for every start in a word, the
tokens that begin there, longest first. Tokens are laid down greedily; a token may follow another only if a table of
compatible pairs says that merging the two strings together gives just these two tokens. Where no token fits, the last
one is taken back and the next shorter one is tried; an end that failed once is never tried again, so the work is linear
in the word's length. A sequence of which every neighbouring pair is compatible is the one that the merge rules give.

Decoding looks up each id's bytes in one buffer by an offset table.

Defined results: a null text counts as an empty one and gives no ids; repeated rows give repeated results; other columns
of the input are ignored; an id column of any type is passed through.
"""

from __future__ import annotations

import hashlib
import json
import struct
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer

from leafloom.llm.common import texts

#: White space as Unicode defines it.
SPACE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: What str.split() parts but Unicode does not count as white space.
NOT_SPACE = regex.compile("[\x1c-\x1f]")


#: From here on Unicode versions differ in what is a letter; such texts are normalised and split by the library itself.
BEYOND = regex.compile("[^\\x00-\\u052f]")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself if printable, else from 256 on."""
    kept = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in kept:
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return out


class Lazy(dict):
    """A table filled as it is asked; of bounded size."""

    MOST = 500_000

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        if len(self) >= self.MOST:
            self.clear()
        out = self[key] = self.make(key)
        return out


class Memo(dict):
    """Packed ids of words seen before, in two generations of bounded size: words in use move into the newer one."""

    MOST = 300_000
    LONGEST = 64

    def __init__(self, bpe: WordBpe):
        super().__init__()
        self.bpe, self.older = bpe, {}

    def __missing__(self, chunk: str) -> bytes:
        out = self.older.get(chunk)
        if out is None:
            out = self.bpe.encode_chunk(chunk)
        if len(chunk) <= self.LONGEST:
            if len(self) >= self.MOST:
                self.older = dict(self)
                self.clear()
            self[chunk] = out
        return out


class WordBpe:
    """Encoder and decoder for a tokenizers file: NFC, white space folding and lower case, a split pattern, byte level, word-end suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or model["type"] != "BPE" or spec["decoder"] is not None:
            raise ValueError(f"{path}: only word-end BPE with NFC, folded white space and lower case is supported")
        self.library = Tokenizer.from_file(path)
        self.suffix = model["end_of_word_suffix"]
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pattern = regex.compile(split.replace("\\s", SPACE))
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.letters = byte_letters()
        # A letter that closes a word is one symbol: its code point moved up by 0x1000.
        self.closed = {c: chr(ord(c) + 0x1000) for c in self.letters}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.rank = {(self._symbols(a), self._symbols(b)): i for i, (a, b) in enumerate(pairs)}
        self.by_symbols = {self._symbols(t): i for t, i in self.ids.items()}
        self.automaton = ahocorasick.Automaton()
        for s, i in self.by_symbols.items():
            self.automaton.add_word(s, (len(s), i))
        self.automaton.make_automaton()
        self.symbols = {i: s for s, i in self.by_symbols.items()}
        self.fits = Lazy(lambda k: self.merged(self.symbols[k >> 20] + self.symbols[k & 0xFFFFF]) == [self.symbols[k >> 20], self.symbols[k & 0xFFFFF]])
        self.reachable = Lazy(lambda i: self.merged(self.symbols[i]) == [self.symbols[i]])
        self.shorter = Lazy(self._shorter)
        self._offsets()
        self.memo = Memo(self)

    def _symbols(self, token: str) -> str:
        if token.endswith(self.suffix) and len(token) > len(self.suffix):
            body = token[: -len(self.suffix)]
            return body[:-1] + self.closed[body[-1]]
        return token

    def _offsets(self) -> None:
        """The decoder's table: each token's bytes and a space, one after another."""
        names = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        parts = [(names.get(i, "") + " ").encode() if i in names else b"" for i in range(max(names) + 1)]
        self.buffer = np.frombuffer(b"".join(parts), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)

    def merged(self, symbols: str) -> list[str]:
        """The plain merge rules, for short strings: fills the tables that the encoder looks up."""
        parts = list(symbols)
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 60))
            if (pair := (parts[best], parts[best + 1])) not in self.rank:
                break
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(pair[0] + pair[1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def _shorter(self, i: int) -> tuple[int, int] | None:
        """Length and id of the longest reachable token that token i starts with and is longer than."""
        s = self.symbols[i]
        for k in range(len(s) - 1, 0, -1):
            if (found := self.by_symbols.get(s[:k])) is not None and self.reachable[found]:
                return k, found
        return None

    def encode_chunk(self, chunk: str) -> bytes:
        """Packed ids of a normalised text without white space."""
        if chunk.isascii() and chunk.isalpha():
            ids = self.encode_word(chunk)
        elif BEYOND.search(chunk):
            ids = [i for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(chunk) for i in self.encode_word(piece)]
        else:
            pieces = self.pattern.findall(chunk)
            if len(pieces) > 1:
                return b"".join([self.memo[p] if p.isalpha() else self.encode_chunk(p) for p in pieces])
            ids = [i for p in pieces for i in self.encode_word("".join([self.letters[b] for b in p.encode()]))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode_word(self, letters: str) -> list[int]:
        """Ids of one piece, given as the letters of its bytes."""
        if not letters:
            return []
        word = letters[:-1] + self.closed[letters[-1]]
        n = len(word)
        longest: list = [None] * n
        for end, found in self.automaton.iter(word):  # ends rise, so the last at a start is the longest
            longest[end - found[0] + 1] = found
        fits, reachable, shorter = self.fits, self.reachable, self.shorter
        out: list[int] = []
        failed: set[int] = set()
        at, found, high = 0, longest[0], -1
        while at < n:
            while found is not None:
                size, i = found
                if at + size not in failed and reachable[i] and (high < 0 or fits[high | i]):
                    break
                found = shorter[i]
            if found is not None:
                out.append(i)
                high = i << 20
                at += size
                found = longest[at] if at < n else None
            else:
                if not out:
                    raise ValueError("the vocabulary lacks a byte of this word")
                failed.add(at)
                i = out.pop()
                at -= len(self.symbols[i])
                found = shorter[i]
                high = out[-1] << 20 if out else -1
        return out

    def _plain(self, text: str) -> bytes:
        if BEYOND.search(text):
            return b"".join(map(self.memo.__getitem__, self.library.normalizer.normalize_str(text).split(" ")))
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        if NOT_SPACE.search(text):
            return b"".join(map(self.memo.__getitem__, regex.split(f"[{SPACE}]+", text)))
        return b"".join(map(self.memo.__getitem__, text.split()))

    def encode_packed(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.special_pattern is None or "<|" not in text and not self.special_pattern.search(text):
            return self._plain(text)
        return b"".join(struct.pack("<I", self.special[p]) if p in self.special else self._plain(p) for p in self.special_pattern.split(text) if p)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<u4").tolist()

    def decode_packed(self, packed: bytes, block: int = 1 << 20) -> Iterator[bytes]:
        """UTF-8 parts of the decoded text: tokens with one space between, gathered by the offset table."""
        ids = np.frombuffer(packed, "<u4").astype(np.int64)
        for k in range(0, len(ids), block):
            part = ids[k : k + block]
            begin = self.offsets[part]
            long = self.offsets[part + 1] - begin
            ends = np.cumsum(long)
            take = np.arange(ends[-1]) + np.repeat(begin - (ends - long), long)
            out = self.buffer[take].tobytes()
            yield out[:-1] if k + block >= len(ids) else out

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.decode_packed(struct.pack(f"<{len(ids)}I", *ids))).decode()


_loaded: dict[str, WordBpe] = {}


def codec(path: str) -> WordBpe:
    """One codec per worker and file."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def encode_documents(df: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, ids (packed little-endian unsigned 32-bit), n_tokens for each row."""
    kind = df.schema[id_column].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(vocabulary)
        for batch in batches:
            for part in _slices(batch):
                packed = [bpe.encode_packed(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(packed, pa.binary()), pa.array([len(p) // 4 for p in packed], pa.int64())], [id_column, "ids", "n_tokens"])

    out = T.StructType([T.StructField(id_column, kind), T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType())])
    return texts(df, id_column, text_column).mapInArrow(run, out)


def decode_documents(df: DataFrame, vocabulary: str, id_column: str = "doc_id") -> DataFrame:
    """id and text of each row of ``encode_documents``."""
    kind = df.schema[id_column].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(vocabulary)
        for batch in batches:
            for part in _slices(batch):
                found = [b"".join(bpe.decode_packed(p or b"")).decode() for p in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.string())], [id_column, "text"])

    out = T.StructType([T.StructField(id_column, kind), T.StructField("text", T.StringType())])
    return df.select(id_column, "ids").mapInArrow(run, out)


def round_trip_digests(df: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Encode, decode what was encoded, and give only the digests, so that neither form of the text is kept."""
    kind = df.schema[id_column].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(vocabulary)
        for batch in batches:
            for part in _slices(batch):
                n, ids, back = [], [], []
                for t in part.column(1).to_pylist():
                    packed = bpe.encode_packed(t)
                    n.append(len(packed) // 4)
                    ids.append(hashlib.sha256(packed).hexdigest())
                    h = hashlib.sha256()
                    for piece in bpe.decode_packed(packed):
                        h.update(piece)
                    back.append(h.hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], [id_column, "n_tokens", "ids_sha256", "decoded_sha256"])

    out = T.StructType([T.StructField(id_column, kind), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return texts(df, id_column, text_column).mapInArrow(run, out)


def _slices(batch: pa.RecordBatch, most: int = 256) -> Iterator[pa.RecordBatch]:
    """Views of a few rows each, so that a worker holds the results of a few texts at a time."""
    for k in range(0, batch.num_rows, most):
        yield batch.slice(k, most)
