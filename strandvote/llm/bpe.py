"""BPE encoding and decoding by traversal of a trie of distinct words.

Every prefix of a word has one last token: the token that ends its encoding. The encoding of a prefix is
the encoding of what stands before its last token, and that token; so a state of one token a prefix holds
all encodings. Distinct words are put in a trie, whose nodes are their prefixes, and a depth-first walk
hands the states of a node's ancestors down to it; what words share at their beginning is encoded once.
The last token of a node is the vocabulary's token that ends there and that no merge joins with the last
token of the node where it begins.

A task takes its texts in blocks, so nothing is shuffled and memory doesn't grow with a batch; words met
before are kept, up to a fixed number. Null texts count as empty; a word of any length is one path.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import pre_tokenizers

from .common import fresh, internal, table
from .kernels import slices

#: Fixed value: how byte-level vocabularies of this kind split a text before the merges.
SPLIT = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: Where a space doesn't begin a word: before white space, or at the end.
SPACED = regex.compile(r" (?:\s|\Z)")
#: Parts of a block of texts whose new words are put in one trie; parts, and pairs of tokens, that are kept between blocks, and the longest such part.
BLOCK, KEPT, PAIRS, LONGEST = 100_000, 600_000, 1_000_000, 64
NEVER = 1 << 60
END = -1


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary: itself, or the next one from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and added tokens of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            settings = json.load(file)
        model, splitter = settings["model"], settings["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and splitter.get("type") == "ByteLevel" and splitter.get("use_regex", True) and not splitter["add_prefix_space"]
        if not plain or settings["normalizer"] or model.get("dropout") or model.get("byte_fallback") or model.get("ignore_merges"):
            raise ValueError(f"{path}: not a plain byte-level BPE file")
        letters, ids = _byte_letters(), model["vocab"]
        self.bytes = {i: bytes(map(letters.__getitem__, t)) for t, i in ids.items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank = {(ids[a], ids[b]): at for at, (a, b) in enumerate(merges)}
        self.parts = {ids[a + b]: (ids[a], ids[b]) for a, b in merges}
        self.added = {t["content"]: t["id"] for t in settings["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in settings["added_tokens"]):
            raise ValueError(f"{path}: added tokens of an unknown kind")
        self.at_added = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        decoded = self.bytes | {i: t.encode() for t, i in self.added.items()}
        self.decoded = [decoded.get(i, b"") for i in range(max(decoded) + 1)]
        self.ending = self._ending()
        self.size = {i: len(t) for i, t in self.bytes.items()}
        of = {t: i for i, t in self.bytes.items()}
        self.longer = {of[t[:-1]] << 8 | t[-1]: i for t, i in of.items() if t[:-1] in of}
        self._joined: dict[int, bool] = {}
        self._spines: tuple[dict[int, list], dict[int, list]] = ({}, {})
        self._known: dict[str, bytes] = {}
        self._words: dict[str, bytes] = {}
        self._letters: set[str] = set(map(chr, range(128)))
        self._other: set[str] = set()
        self._library = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)

    def _ending(self) -> dict:
        """The tokens by their bytes from the last to the first, as nested tables."""
        top: dict = {}
        for i, text in self.bytes.items():
            node = top
            for b in reversed(text):
                node = node.setdefault(b, {})
            node[END] = i
        return top

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """Tokens that stand at one side of a token (0: left, 1: right) while it is built, and the rank of the merge that ends each of them."""
        found = self._spines[side].get(token)
        if found is None:
            found, until, at = [], NEVER, token
            while True:
                found.append((at, until))
                if at not in self.parts:
                    break
                until = self.rank[self.parts[at]]
                at = self.parts[at][side]
            self._spines[side][token] = found
        return found

    def apart(self, a: int, b: int) -> bool:
        """Whether the texts of two tokens, one after the other, are encoded as the two.

        They aren't if some merge joins a token at the end of the first with one at the beginning of the
        second while both stand there. Of merges of one rank the leftmost goes first.
        """
        found = self._joined.get(a << 24 | b)
        if found is None:
            found = True
            for x, until_x in self._spine(a, 1):
                for y, until_y in self._spine(b, 0):
                    at = self.rank.get((x, y))
                    if at is not None and at < until_x and at <= until_y:
                        found = False
            self._joined[a << 24 | b] = found
        return found

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """The tokens of words that are sorted and distinct.

        Sorted words are their trie in depth-first order: last[d] is the last token of the node at depth d of
        the path walked, and the next word leaves the path where it differs.
        """
        out, path, last = [], b"", [END]
        if len(self._joined) > PAIRS:
            self._joined.clear()
        ending, longer, known, size, apart = self.ending, self.longer.get, self._joined.get, self.size, self.apart
        for word in words:
            shared = _shared(path, word)
            del last[shared + 1 :]
            token = last[shared]
            for depth in range(shared + 1, len(word) + 1):
                # one token at most fits; often it is the last one and the new byte
                token = longer(token << 8 | word[depth - 1]) if token != END else None
                if token is not None:
                    start = depth - size[token]
                    if not start or known(last[start] << 24 | token, False):
                        last.append(token)
                        continue
                # else all tokens that end here, by walking back, the longest one first
                node, start, ends = ending, depth, []
                while start and (node := node.get(word[start - 1])) is not None:
                    start -= 1
                    if END in node:
                        ends.append(start)
                        ends.append(node[END])
                while ends:
                    token, start = ends.pop(), ends.pop()
                    if not start:
                        break
                    fits = known(last[start] << 24 | token)
                    if apart(last[start], token) if fits is None else fits:
                        break
                last.append(token)
            path = word
            tokens, depth = [], len(word)
            while depth:
                token = last[depth]
                tokens.append(token)
                depth -= size[token]
            out.append(tokens[::-1])
        return out

    def _pieces(self, text: str) -> Iterator[str]:
        """The words of a text without added tokens.

        The library's letters and digits are of another version of Unicode; a text with a character that the two
        class differently is split by the library itself.
        """
        for letter in set(text) - self._letters - self._other:
            probe = f"a{letter}1{letter}.{letter} {letter}"
            same = [b - a for _, (a, b) in self._library.pre_tokenize_str(probe)] == [len(x) for x in SPLIT.findall(probe)]
            (self._letters if same else self._other).add(letter)
        if self._other and not self._other.isdisjoint(text):
            return (text[a:b] for _, (a, b) in self._library.pre_tokenize_str(text))
        return (m.group() for m in SPLIT.finditer(text)) if len(text) > BLOCK else iter(SPLIT.findall(text))

    def units(self, text: str) -> Iterator[str]:
        """Parts of a text that are encoded on their own, one after the other: runs of words, words, and added tokens.

        A space before anything but white space begins a word whatever stands before it; parts begin there. Long
        parts are given word by word.
        """
        if self.at_added is None or not self.at_added.search(text):
            return self._units(text)
        return self._parted(text)

    def _parted(self, text: str) -> Iterator[str]:
        start = 0
        for m in self.at_added.finditer(text):
            yield from self._units(text[start : m.start()])
            yield m.group()
            start = m.end()
        yield from self._units(text[start:])

    def _units(self, text: str) -> Iterator[str]:
        parts = text.split(" ")
        if SPACED.search(text):
            out = parts[:1]
            for part in parts[1:]:
                if not part or part[0].isspace():
                    out[-1] += " " + part
                else:
                    out.append(" " + part)
        else:
            out = [parts[0], *map(" ".__add__, parts[1:])]
        if max(map(len, out)) > LONGEST:
            return chain.from_iterable(self._pieces(u) if len(u) > LONGEST else (u,) for u in out)
        return iter(out)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The tokens of each text; texts are taken together until they make a block, and a long one in several."""
        parts: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, list[str]]] = []
        n = 0
        for i, text in enumerate(texts):
            units = self.units(text or "")
            while some := list(islice(units, BLOCK)):
                held.append((i, some))
                n += len(some)
                if n >= BLOCK:
                    self._flush(held, parts)
                    held, n = [], 0
        self._flush(held, parts)
        return [np.frombuffer(b"".join(p), np.int32) for p in parts]

    def _flush(self, held: list[tuple[int, list[str]]], parts: list[list[bytes]]) -> None:
        """Put the words of a block's new parts in one trie, and the tokens of all parts in their texts."""
        if len(self._known) > KEPT:
            self._known.clear()
        known = self._known
        new = set().union(*(units for _, units in held)).difference(known)
        for u in new.intersection(self.added):
            known[u] = np.array([self.added[u]], np.int32).tobytes()
        words = {u: list(self._pieces(u)) for u in new.difference(self.added)}
        if len(self._words) > KEPT:
            self._words.clear()
        distinct = sorted(w.encode() for w in set(chain.from_iterable(words.values())).difference(self._words))
        self._words.update((w.decode(), np.array(t, np.int32).tobytes()) for w, t in zip(distinct, self.encode_words(distinct), strict=True))
        coded = self._words.__getitem__
        known.update((u, coded(some[0]) if len(some) == 1 else b"".join(map(coded, some))) for u, some in words.items())
        for i, units in held:
            parts[i].append(b"".join(map(known.__getitem__, units)))
        for u in [u for u in words if len(u) > LONGEST]:
            del known[u]
        for w in [w for w in map(bytes.decode, distinct) if len(w) > LONGEST]:
            del self._words[w]

    def decode(self, ids: np.ndarray) -> str:
        """The text of tokens; bytes that aren't UTF-8 become U+FFFD, numbers that no token has are passed over."""
        ids = ids[(ids >= 0) & (ids < len(self.decoded))]
        return b"".join(map(self.decoded.__getitem__, ids.tolist())).decode("utf-8", "replace")

    def encode_column(self, texts: pa.Array) -> pa.Array:
        ids = [x for part in slices(texts) for x in self.encode([part.text(i).decode() for i in range(len(part))])]
        ends = np.cumsum([0, *map(len, ids)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*ids, np.zeros(0, np.int32)]), pa.int32()))

    def decode_column(self, ids: pa.Array) -> pa.Array:
        flat, ends = ids.flatten().to_numpy(), np.cumsum([0, *(n or 0 for n in pc.list_value_length(ids).to_pylist())])
        return pa.array([self.decode(flat[a:b]) if known else None for a, b, known in zip(ends[:-1], ends[1:], ids.is_valid().to_pylist(), strict=True)], pa.string())


def _shared(a: bytes, b: bytes) -> int:
    """Length of the common beginning."""
    n, most = 0, min(len(a), len(b))
    while n + 64 <= most and a[n : n + 64] == b[n : n + 64]:
        n += 64
    while n < most and a[n] == b[n]:
        n += 1
    return n


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary at path, which every machine can read; a worker reads it once."""
    return Vocabulary(path)


def token_ids(text: str | Column, path: str) -> Column:
    """The tokens of a text column, an array of int; null counts as the empty text."""

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return map(vocabulary(path).encode_column, batches)

    return encode(text)


def token_text(ids: str | Column, path: str) -> Column:
    """The text of an array of tokens; null stays null."""

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return map(vocabulary(path).decode_column, batches)

    return decode(ids)


def round_trip(text: str | Column, path: str) -> Column:
    """ids, the tokens of a text column, and back, the text decoded from those tokens, in one look at the text."""

    @F.arrow_udf("struct<ids:array<int>,back:string>")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        v = vocabulary(path)
        for batch in batches:
            ids = v.encode_column(batch)
            yield pa.StructArray.from_arrays([ids, v.decode_column(ids)], ["ids", "back"])

    return both(text)


def encoded(docs: DataFrame, path: str, text: str = "text", name: str = "ids") -> DataFrame:
    """docs with the tokens of their texts in a column called name, or longer if docs has one of that name."""
    return docs.withColumn(fresh(docs, name), token_ids(F.col(f"`{text}`"), path))


def op12_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    coded = internal(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", round_trip("text", path).alias("c")).select("doc_id", "c.*")
    digest = lambda text: F.sha2(text, 256)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"), digest(F.col("back")).alias("decoded_sha256"))
