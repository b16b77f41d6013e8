"""Trie encoding against the library."""

from __future__ import annotations

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandvote.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
LETTERS = "aaabbb  \n\t'sStlrevemd.,<|endoftext|>Ж中\U0001f600  \x1c\x85　é१\U00010940՘-==__  0123xX\x00"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts():
    rng = random.Random(4)
    out = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    out += ["".join(rng.choice(["<|endoftext|>", " ", "a", "'s", "  ", "\n", "the", "'", "<|endof"]) for _ in range(12)) for _ in range(500)]
    out += ["".join(rng.choice("ab") for _ in range(40)) for _ in range(500)] + ["".join(rng.choice("-=_* ") for _ in range(60)) for _ in range(500)]
    return out + ["a" * n for n in range(100)] + ["aab" * n for n in range(50)] + ["don't we'll I'd 'tis ''s \"'s"]


def test_equals_the_library(library):
    v = bpe.Vocabulary(PATH)
    some = texts()
    for text, ids, want in zip(some, v.encode(some), library.encode_batch(some, add_special_tokens=False), strict=True):
        assert ids.tolist() == want.ids, text
        assert v.decode(ids) == library.decode(want.ids, skip_special_tokens=False) == text


def test_every_token_is_its_own_encoding():
    v = bpe.Vocabulary(PATH)
    by_text = sorted((text, i) for i, text in v.bytes.items())
    assert v.encode_words([text for text, _ in by_text]) == [[i] for _, i in by_text]


def test_shared_prefixes_are_walked_once(monkeypatch):
    """States of a prefix are made once: 200 words with one beginning cost their ends only."""
    v = bpe.Vocabulary(PATH)
    seen = []
    monkeypatch.setattr(bpe, "_shared", lambda a, b, real=bpe._shared: seen.append((real(a, b), len(b))) or seen[-1][0])
    words = sorted(b"q" * 500 + bytes([65 + i % 26, 65 + i // 26]) for i in range(200))
    v.encode_words(words)
    assert sum(length - shared for shared, length in seen) < 1000


def test_long_words_and_small_blocks(library, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK", 7)
    monkeypatch.setattr(bpe, "KEPT", 5)
    monkeypatch.setattr(bpe, "PAIRS", 3)
    v = bpe.Vocabulary(PATH)
    some = ["x" * 5000 + "y", "", "one two three four five six seven eight nine ten " * 3, "\n" * 300]
    assert [x.tolist() for x in v.encode(some)] == [w.ids for w in library.encode_batch(some, add_special_tokens=False)]


def test_bytes_that_are_no_text(library):
    v = bpe.Vocabulary(PATH)
    for ids in ([255, 1, 2], list(range(128, 256)), [50256, 300], [99999, 5], []):
        assert v.decode(bpe.np.array(ids, bpe.np.int64)) == library.decode(ids, skip_special_tokens=False)


def test_columns(odd, nothing, library):
    """Null, empty and very long texts, repeated rows and columns whose names clash keep their rows."""
    docs = odd.withColumn("ids", F.lit("x"))
    out = bpe.encoded(docs, PATH)
    assert out.columns == [*docs.columns, "ids_"]
    rows = out.withColumn("back", bpe.token_text("ids_", PATH)).select("doc_id", "text", "ids_", "back").collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert r["ids_"] == library.encode(r["text"] or "", add_special_tokens=False).ids and r["back"] == (r["text"] or "")
    assert bpe.encoded(nothing, PATH).count() == 0
    assert odd.limit(1).select(bpe.token_text(F.lit(None).cast("array<int>"), PATH)).first()[0] is None


def test_query(spark, sf_dir, library):
    import hashlib

    got = {r["doc_id"]: r for r in bpe.op12_bpe_trie(spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        want = len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        assert tuple(got[r["doc_id"]])[1:] == want


def test_other_files_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        bpe.Vocabulary(public_tokenizers.path("word_bpe_49k.json"))
