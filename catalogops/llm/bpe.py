"""BPE encoding and decoding by prefix-sharing trie traversal.

The encoding of a word's prefix ends in one definite last token, and two tokens
stand side by side in an encoding only if together they encode to just
themselves.  So the last token of every trie node follows from the last
tokens of its ancestors: it is the one token that ends there and agrees with the last token
at the place where it begins.  The distinct words of a batch are inserted in
sorted order, which is the trie's depth-first order; a new node gets its last
token from the path above it, and a prefix that words share is encoded once.
"""

from __future__ import annotations

import functools
import json
import re
import struct
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from catalogops.llm.common import with_arrow

#: Encoded words that a task remembers; when passed, it starts anew.
MAX_WORDS = 200_000
#: Pairs of tokens of which a task remembers whether they stay apart.
MAX_PAIRS = 500_000
#: Characters of the texts whose distinct words make one trie; a longer text is still whole.
TRIE_CHARS = 2 << 20
#: Longer words are not remembered.
LONG_WORD = 2048
#: No text holds this character.
RAW = "\ud800"
#: Characters with their final form: the last byte of a word is another symbol than the same byte inside it.
END = 0x1000


class Bpe:
    """A byte-level BPE vocabulary with an end-of-word suffix, as the tokenizers library reads it."""

    def __init__(self, path: str):
        spec = json.loads(open(path, encoding="utf-8").read())
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        self.library = Tokenizer.from_file(path)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: s for s, i in model["vocab"].items()} | {i: s for s, i in self.special.items()}
        self.ids = {self._symbols(s): i for s, i in model["vocab"].items()}
        self.strings = {i: s for s, i in self.ids.items()}
        self.sizes = {i: len(s) for s, i in self.ids.items()}
        automaton = ahocorasick.Automaton()
        for symbols, i in self.ids.items():
            automaton.add_word(symbols, (len(symbols), i))
        automaton.make_automaton()
        #: (last place, (length, id)) of every token that stands anywhere in a word, by last place.
        self.tokens_in = automaton.iter
        self.rank = {(self.ids[self._symbols(a)], self.ids[self._symbols(b)]): (r, self.ids[self._symbols(a + b)]) for r, (a, b) in enumerate(map(tuple, model["merges"]))}
        self.agrees: dict[int, bool] = {}
        pieces = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pieces.replace(r"\s", r"\t-\r \x85\xa0"), regex.V0).findall
        self.bytes = str.maketrans(_byte_symbols())
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else lambda t: [t]

    def _symbols(self, token: str) -> str:
        if token.endswith(self.suffix) and token != self.suffix:
            body = token[: -len(self.suffix)]
            return body[:-1] + chr(ord(body[-1]) + END)
        return token

    def pieces(self, text: str) -> list[str]:
        """The words of a text; special tokens keep their own string, and RAW stands before a word that is in the byte alphabet already."""
        out: list[str] = []
        for part in self.split(text):
            if part in self.special:
                out.append(part)
            elif part:
                out += self._plain(part)
        return out

    def _plain(self, text: str) -> list[str]:
        if text.isascii() or max(text) < "ɐ":  # already in NFC, with the same classes in every Unicode version
            return self.words(text.lower())
        text = self.library.normalizer.normalize_str(text)
        return [w if w.isascii() else RAW + w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def symbols(self, word: str) -> str:
        """A word of :meth:`pieces` in the byte alphabet, its last symbol final."""
        if word[0] == RAW:
            word = word[1:]
        elif not (word.isascii() and word.isprintable()):
            word = "".join(map(_BYTES.__getitem__, word.encode()))
        return word[:-1] + chr(ord(word[-1]) + END)

    def pair(self, a: int, b: int) -> bool:
        """Whether the tokens a and b stay apart when their string is encoded."""
        key = a << 20 | b
        got = self.agrees.get(key)
        if got is None:
            if len(self.agrees) > MAX_PAIRS:
                self.agrees.clear()
            got = self.agrees[key] = self._merge(self.strings[a] + self.strings[b]) == [a, b]
        return got

    def _merge(self, symbols: str) -> list[int]:
        parts = [self.ids[s] for s in symbols]
        while len(parts) > 1:
            best = min(((r[0], i, r[1]) for i, p in enumerate(zip(parts, parts[1:])) if (r := self.rank.get(p))), default=None)
            if best is None:
                break
            parts[best[1] : best[1] + 2] = [best[2]]
        return parts


def _byte_symbols() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(rest)}


_BYTES = [_byte_symbols()[b] for b in range(256)]


class PrefixTrie:
    """A depth-first walk over the trie of sorted words; of its nodes only the path to the last word is held."""

    def __init__(self, bpe: Bpe):
        self.bpe = bpe
        self.word = ""
        self.last = [-1]  # the last token of each prefix on the path, the empty one first

    def encode(self, word: str) -> list[int]:
        """Go to a word, given as symbols with its last one final, and read its tokens off the path.

        What it shares with the word before is on the path already.
        """
        bpe, before, last = self.bpe, self.word, self.last
        depth, both = 0, min(len(word), len(before))
        while depth < both and word[depth] == before[depth]:
            depth += 1
        del last[depth + 1 :]
        agrees = bpe.agrees.get
        for end, (n, token) in bpe.tokens_in(word):
            if end < depth:
                continue
            left = last[end + 1 - n]
            if n > end:
                good = True
            else:
                good = agrees(left << 20 | token)
                if good is None:
                    good = bpe.pair(left, token)
            if good:
                last.append(token)
                depth = end + 1
        if depth < len(word):
            self.word, self.last = "", [-1]
            raise ValueError(f"no token ends {word[: depth + 1]!r}")
        self.word = word
        out, sizes = [], bpe.sizes
        while depth:
            token = last[depth]
            out.append(token)
            depth -= sizes[token]
        return out[::-1]


@functools.cache
def _load(path: str) -> Bpe:
    return Bpe(path)


class Encoder:
    """Encodes whole texts to packed little-endian 32-bit ids, batch by batch."""

    def __init__(self, path: str):
        self.bpe = _load(path)
        self.special = {s: struct.pack("<I", i) for s, i in self.bpe.special.items()}
        self.packed = dict(self.special)

    def batch(self, texts: list[str]) -> list[bytes]:
        """Ids of texts, whose new words make one trie."""
        if len(self.packed) > MAX_WORDS:
            self.packed = dict(self.special)
        pieces = [self.bpe.pieces(t) for t in texts]
        packed, long = self.packed, []
        fresh = set(chain.from_iterable(pieces)).difference(packed)
        trie = PrefixTrie(self.bpe)
        for symbols, word in sorted((self.bpe.symbols(w), w) for w in fresh):
            tokens = trie.encode(symbols)
            packed[word] = struct.pack(f"<{len(tokens)}I", *tokens)
            if len(word) > LONG_WORD:
                long.append(word)
        out = [b"".join(map(packed.__getitem__, words)) for words in pieces]
        for word in long:
            del packed[word]
        return out


def encode(docs: DataFrame, vocab_path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with ``ids_col`` (binary): the token ids of each whole text, packed as unsigned 32-bit little-endian integers.

    The ids are those of the tokenizers library without added special tokens;
    strings of special tokens in the text become those tokens.  A null or
    empty text has no ids.  No shuffle: every task encodes its own rows.  A task
    holds one bounded trie; a long word needs memory in proportion to its length.
    ``vocab_path`` must lead to the vocabulary file on every executor.
    """

    def work():
        encoder = Encoder(vocab_path)

        def each(batch: pa.RecordBatch) -> list[pa.Array]:
            texts = [t or "" for t in batch.column(text_col).to_pylist()]
            out: list[bytes] = []
            part: list[str] = []
            size = 0
            for t in texts:
                if part and size + len(t) > TRIE_CHARS:
                    out += encoder.batch(part)
                    part, size = [], 0
                part.append(t)
                size += len(t)
            return [pa.array(out + encoder.batch(part), pa.binary())]

        return each

    return with_arrow(docs, f"`{ids_col}` binary", text_col, work)


def decode(docs: DataFrame, vocab_path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``docs`` with ``text_col``: the packed ids as the library decodes them, special tokens included.

    The vocabulary has no decoder, so the tokens' strings are joined by spaces.
    Null or empty ids give the empty text; an unknown id is left out.
    """

    def work():
        names = _load(vocab_path).names
        table = np.array([names.get(i) for i in range(max(names) + 2)], object)  # the last one stands for ids beyond
        known = np.array([name is not None for name in table])

        def one(packed: bytes | None) -> str:
            ids = np.minimum(np.frombuffer(packed or b"", "<u4"), len(table) - 1)
            return " ".join(table[ids[known[ids]]].tolist())

        def each(batch: pa.RecordBatch) -> list[pa.Array]:
            return [pa.array([one(x) for x in batch.column(ids_col).to_pylist()], pa.string())]

        return each

    return with_arrow(docs, f"`{text_col}` string", ids_col, work)


def unpack(ids: bytes) -> list[int]:
    """Packed ids as a list."""
    return np.frombuffer(ids, "<u4").tolist()
