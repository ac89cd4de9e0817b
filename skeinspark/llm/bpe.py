"""BPE encoding by per-prefix dynamic programming, and decoding.

For every prefix of a word there is exactly one token that can end its encoding: the token t, a suffix of the prefix, whose
pair with the last token of the prefix before it is stable, that is, the merge rules applied to the two tokens' symbols give
these two tokens again. One run of a suffix-matching automaton over the word yields all tokens that end at each place; the
stored last tokens are then the back-pointers from which the ids are read. Words repeat, so each task keeps the ids of those
it has met, up to a bound.

Defined cases: a null text has no tokens; the strings of special tokens in a text give their ids, as the library does unless
told otherwise; other columns are not read; repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from skeinspark.llm.common import map_texts, read

#: White space as the vocabulary's normalizer takes it, and its word pattern, which differs from it only there.
SPACE = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
WORD_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACE}\p{{L}}\p{{N}}]+"
WORD_END = "</w>"
#: End-of-word symbols live here, one for each byte symbol.
PRIVATE = 0xF0000
CACHED_WORDS, CACHED_PAIRS = 300_000, 1_000_000


def byte_symbols() -> list[str]:
    """The printable stand-in for each byte: itself where printable, else the next code point from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in printable]
    return [chr(b) if b in printable else chr(256 + hidden.index(b)) for b in range(256)]


class WordBpe:
    """Tokenizer of a word-level BPE file: lower-cased words whose last symbol carries an end mark."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.bytes = {chr(b): s for b, s in enumerate(byte_symbols())}
        self.ranks: dict[tuple[str, str], int] = {}
        symbols = {c: c for c in self.bytes.values()} | {c + WORD_END: chr(PRIVATE + ord(c)) for c in self.bytes.values()}
        for rank, (left, right) in enumerate(model["merges"]):
            symbols[left + right] = symbols[left] + symbols[right]
            self.ranks.setdefault((symbols[left], symbols[right]), rank)
        self.ids = {symbols[t]: i for t, i in self.vocab.items() if t in symbols}
        self.automaton = ahocorasick.Automaton()
        for s in self.ids:
            self.automaton.add_word(s, s)
        self.automaton.make_automaton()
        self.words = regex.compile(WORD_PATTERN)
        self.marks = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")") if self.special else None
        self.pairs: dict[tuple[str, str], bool] = {}
        self.known: dict[str, tuple[bytes, str]] = {}

    def merged(self, symbols: str) -> list[str]:
        """The merge rules, lowest rank and leftmost first: only for what two tokens span."""
        parts = list(symbols)
        while len(parts) > 1:
            rank, at = min((self.ranks.get(pair, len(self.ranks)), i) for i, pair in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == len(self.ranks):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stable(self, left: str, right: str) -> bool:
        found = self.pairs.get((left, right))
        if found is None:
            if len(self.pairs) >= CACHED_PAIRS:
                self.pairs.clear()
            found = self.pairs[left, right] = self.merged(left + right) == [x for x in (left, right) if x]
        return found

    def tokens(self, symbols: str) -> list[str]:
        last: list[str | None] = [""] + [None] * len(symbols)
        for end, token in self.automaton.iter(symbols):
            if last[end + 1] is None:
                before = last[end + 1 - len(token)]
                if before is not None and self.stable(before, token):
                    last[end + 1] = token
        out, at = [], len(symbols)
        while at:
            token = last[at]
            if token is None:
                raise ValueError("the vocabulary lacks a byte symbol")
            out.append(token)
            at -= len(token)
        return out[::-1]

    def word(self, word: str) -> tuple[bytes, str]:
        """The ids as little-endian 32-bit integers, and the decoded text with a trailing blank."""
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= CACHED_WORDS:
                self.known.clear()
            symbols = "".join(self.bytes[chr(b)] for b in word.encode())
            ids = [self.ids[t] for t in self.tokens(symbols[:-1] + chr(PRIVATE + ord(symbols[-1])))]
            found = self.known[word] = (np.array(ids, "<u4").tobytes(), "".join(self.names[i] + " " for i in ids))
        return found

    def encode(self, text: str) -> tuple[bytes, str]:
        """The ids of a text as bytes, and what they decode to."""
        ids, names = [], []
        for i, part in enumerate(self.marks.split(text) if self.marks else [text]):
            if i % 2:
                ids.append(np.array([self.special[part]], "<u4").tobytes())
                names.append(part + " ")
            else:
                # sigma has its own lower case at the end of a word, which lower-casing by character does not know
                low = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                get, new = self.known.get, self.word
                for w in self.words.findall(low):
                    a, b = get(w) or new(w)
                    ids.append(a)
                    names.append(b)
        return b"".join(ids), "".join(names)[:-1]

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.names[i] for i in ids)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and with keep_ids also ids array<int>: one row per row of docs."""

    def make():
        bpe = WordBpe(path)

        def f(texts: list[str]) -> list[pa.Array]:
            done = [bpe.encode(t) for t in texts]
            sha = lambda b: hashlib.sha256(b).hexdigest()
            out = [pa.array([len(a) // 4 for a, _ in done], pa.int64()), pa.array([sha(a) for a, _ in done]), pa.array([sha(b.encode()) for _, b in done])]
            if keep_ids:
                ends = np.cumsum([0, *[len(a) // 4 for a, _ in done]])
                out.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(a for a, _ in done), "<i4"))))
            return out

        return f

    return map_texts(docs, id_col, text_col, make, "n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read(spark, sf_dir, "documents"), vocabulary(), keep_ids=False)
