"""BPE encoding and decoding over a trie of the distinct words.

Words of a slice are sorted, which lists them as a depth-first walk of their trie does: neighbours in
that order share their longest common prefix, and the stack of prefix states up to there is kept. The
state of a prefix is the last token of its encoding. It is the only token that ends the prefix and
makes a stable pair with the last token of what comes before it, so a shared prefix is encoded once,
and a word's tokens are read back from its states from end to start.

Two tokens are a stable pair if no merge crosses their border: along the right edge of the first
token's merge tree and the left edge of the second's, no pair of neighbours has a merge rank below
the ranks at which both are used up. Encodings are the sequences whose neighbours are all stable.

Defined cases: null text counts as empty; empty text has no tokens and decodes to the empty string;
special tokens in a text become their own ids; repeated rows and doc_ids give one row each; further
columns pass through (new ones replace columns with the same name); an empty table gives an empty one.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from orrery.llm.batches import give_back, slices

#: The cached words and chunks of a worker; beyond it the cache starts anew.
CACHE_ENTRIES = 250_000
SPACE = "\x1c\x1d\x1e\x1f"


@lru_cache(1)
def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: bytes that print stand for themselves, the others follow from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


class WordBpe:
    """Encoder for a word-end BPE vocabulary in the JSON form of public tokenizers."""

    def __init__(self, spec: str):
        import regex

        spec = json.loads(spec)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {p: k for k, p in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.word = regex.compile(split.replace(r"^\s", r"^\p{White_Space}"))
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.space = regex.compile(r"\p{White_Space}+")
        self.longest = max(map(len, self.ids))
        self.letter = str.maketrans(dict(enumerate(byte_letters())))
        self.edges: dict[str, tuple | None] = {}
        self.stable: dict[tuple[str, str], bool] = {}
        self.packed = {t: i.to_bytes(4, "little") for t, i in self.ids.items()}
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _symbols(self, token: str) -> list[str]:
        last = token.endswith(self.end) and token != self.end
        body = token[: -len(self.end)] if last else token
        return [*body[:-1], body[-1] + self.end] if last else [*body]

    def _edge(self, token: str) -> tuple | None:
        """(symbols, the rank that uses each up) along the token's left and right edge; None if its own merges don't build it."""
        if token in self.edges:
            return self.edges[token]
        parts = self._symbols(token)
        left, right = [(parts[0], None)], [(parts[-1], None)]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda k: self.rank.get((parts[k], parts[k + 1]), 1 << 60))
            rank = self.rank.get((parts[best], parts[best + 1]))
            if rank is None:
                break
            if best == 0:
                left = [*left[:-1], (left[-1][0], rank), (parts[0] + parts[1], None)]
            if best == len(parts) - 2:
                right = [*right[:-1], (right[-1][0], rank), (parts[-2] + parts[-1], None)]
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        end = lambda edge: [(s, 1 << 60 if r is None else r) for s, r in edge]
        self.edges[token] = out = (end(left), end(right)) if len(parts) == 1 else None
        return out

    def _is_stable(self, a: str, b: str) -> bool:
        known = self.stable.get((a, b))
        if known is None:
            rank, x, y = self.rank.get, self._edge(a), self._edge(b)
            known = x is not None and y is not None
            if known:
                for s, s_used in x[1]:
                    for t, t_used in y[0]:
                        r = rank((s, t))
                        if r is not None and r < s_used and r <= t_used:
                            known = False
            if len(self.stable) >= 4 * CACHE_ENTRIES:
                self.stable.clear()
            self.stable[a, b] = known
        return known

    def encode_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """The packed ids of each distinct word (in byte letters), by one walk over the words' trie."""
        ids, packed, edges, stable, end = self.ids, self.packed, self.edges, self.stable, self.end
        out, prefix, longest = {}, "", self.longest
        states, begins = [""], [0]  # of the first d letters: the last token of their encoding, and where it starts
        for word in sorted(set(words)):
            n, keep, most = len(word), 0, min(len(word) - 1, len(prefix))
            if word[:most] == prefix[:most]:
                keep = most
            else:
                while word[keep] == prefix[keep]:
                    keep += 1
            del states[keep + 1 :], begins[keep + 1 :]
            for d in range(keep + 1, n + 1):
                for start in range(max(0, d - longest), d):
                    token = word[start:d] if d < n else word[start:] + end
                    if token in ids:
                        before = states[start]
                        fits = stable.get((before, token)) if before else edges.get(token)
                        if fits is None:
                            fits = self._is_stable(before, token) if before else self._edge(token)
                        if fits:
                            break
                else:
                    raise ValueError(f"the vocabulary lacks a letter of {word!r}")
                if d < n:
                    states.append(token)
                    begins.append(start)
                elif start:
                    parts = [packed[token]]
                    while start:
                        parts.append(packed[states[start]])
                        start = begins[start]
                    parts.reverse()
                    out[word] = b"".join(parts)
                else:
                    out[word] = packed[token]
            prefix = word[: n - 1]
        return out

    def _pieces(self, chunk: str) -> list[str]:
        """Words of a text without special tokens, in byte letters."""
        import unicodedata

        if chunk.isascii():
            text = chunk.lower()
            found = [text] if text.isalpha() else self.word.findall(text)
            return found if text.isprintable() else [w.translate(self.letter) for w in found]
        text = unicodedata.normalize("NFC", chunk).replace("Σ", "σ")
        return [w.encode().decode("latin-1").translate(self.letter) for w in self.word.findall(text.lower())]

    def _parts(self, text: str) -> list[str]:
        """Chunks between white space, special tokens apart; no word reaches beyond its chunk."""
        found = self.specials.split(text) if self.specials and "<|" in text else [text]
        out: list[str] = []
        for k, part in enumerate(found):
            if k % 2:
                out.append(part)
            elif any(c in part for c in SPACE):  # str.split takes these for white space, the tokenizer doesn't
                out += [x for x in self.space.split(part) if x]
            else:
                out += part.split()
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        parts = [self._parts(t or "") for t in texts]
        for cache in (self.chunks, self.words):
            if len(cache) > CACHE_ENTRIES:
                cache.clear()
        new = {c for p in parts for c in p} - self.chunks.keys()
        pieces = {c: self._pieces(c) for c in new if c not in self.special}
        self.words.update(self.encode_words({w for p in pieces.values() for w in p} - self.words.keys()))
        word = self.words.__getitem__
        for c in new:
            self.chunks[c] = self.special[c].to_bytes(4, "little") if c in self.special else b"".join(map(word, pieces[c]))
        return [b"".join(map(self.chunks.__getitem__, p)) for p in parts]

    def forget(self) -> None:
        """Empties the caches: a worker that waits for its next task holds the vocabulary only."""
        for cache in (self.chunks, self.words, self.stable, self.edges):
            cache.clear()

    def decode(self, packed: bytes | None) -> str:
        """Tokens joined by a space, special ones among them; ids outside the vocabulary are left out."""
        import numpy as np

        names = self.names
        return " ".join([names[i] for i in np.frombuffer(packed or b"", "<u4").tolist() if i in names])


@lru_cache(2)
def _model(spec: str) -> WordBpe:
    return WordBpe(spec)


def _mapped(df: DataFrame, by: str, added: dict[str, T.DataType], path: str, make, keep: bool = True) -> DataFrame:
    """df with the added columns, made by make(model, values of ``by``) -> arrays; ``by`` itself stays if ``keep``."""
    with open(path, encoding="utf-8") as file:  # a vocabulary file: of one size whatever the corpus
        spec = df.sparkSession.sparkContext.broadcast(file.read())
    schema = T.StructType([f for f in df.schema if f.name not in added and (keep or f.name != by)] + [T.StructField(k, t) for k, t in added.items()])
    names = [f.name for f in schema][: -len(added)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(spec.value)
        try:
            for x in slices(batches, by):
                arrays = make(model, x.column(by).to_pylist())
                yield pa.RecordBatch.from_arrays([*(x.column(n) for n in names), *arrays], names=[*names, *added])
        finally:
            model.forget()
            give_back()

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, path: str, text: str = "text", out: str = "token_ids", decoded: str | None = None, keep_text: bool = True) -> DataFrame:
    """df with ``out`` (ids as little-endian unsigned 32-bit integers, the form of token shards) and ``n_tokens``.

    ``decoded`` names a column for what the ids decode to, in the same pass.
    """

    def make(model: WordBpe, texts: list[str | None]) -> list[pa.Array]:
        packed = model.encode(texts)
        back = [pa.array([model.decode(p) for p in packed], pa.string())] if decoded else []
        return [pa.array(packed, pa.binary()), pa.array([len(p) // 4 for p in packed], pa.int64()), *back]

    return _mapped(df, text, {out: T.BinaryType(), "n_tokens": T.LongType()} | ({decoded: T.StringType()} if decoded else {}), path, make, keep_text)


def decode(df: DataFrame, path: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """df with ``out``, the text that the packed ids stand for."""
    return _mapped(df, ids, {out: T.StringType()}, path, lambda model, packed: [pa.array([model.decode(p) for p in packed], pa.string())])


def unpacked(packed: Column) -> Column:
    """Packed ids as an array of integers, for readers that want one."""
    digits = F.hex(packed)
    at = lambda i, k: F.substring(digits, i * F.lit(8) + F.lit(7 - 2 * k), F.lit(2))
    one = lambda i: F.conv(F.concat(*(at(i, k) for k in range(4))), 16, 10).cast("long")
    return F.when(F.length(packed) > 0, F.transform(F.sequence(F.lit(0), (F.length(packed) / 4).cast("int") - 1), one)).otherwise(F.array().cast("array<bigint>"))
