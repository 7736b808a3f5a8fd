"""Byte-level BPE against the tokenizer's own library."""

from __future__ import annotations

import hashlib
import random
import sys
from pathlib import Path

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from test_llm_operators import frame, messy, order  # noqa: E402

from procflow.llm import byte_bpe  # noqa: E402
from procflow.llm.byte_bpe import ByteVocabulary, encode_documents, merge_long  # noqa: E402
from procflow.llm.queries import QUERIES, byte_vocabulary, documents  # noqa: E402


@pytest.fixture(scope="module")
def vocabulary():
    return byte_vocabulary()


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding("own", pat_str=vocabulary.pattern, mergeable_ranks=vocabulary.ranks, special_tokens={})


def odd_texts():
    """White space of all kinds before, after and between words, apostrophes, scripts, long words."""
    rng = random.Random(3)
    marks = [" ", "  ", "\n", " \n", "\n ", "\t", " ", " ", "\x85", "a", "Zé", "12", "٣", "'s", "'LL", "…", "漢字", "😀", "\x00", "-", "ß", "é"]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randrange(1, 30))) for _ in range(400)]
    blob = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3000))
    return [*texts, blob, "x " + blob + " y", " " * 2000 + "end", "<|endoftext|>", "ä" * 700, "the the the " * 50]


def test_odd_texts(spark, vocabulary, library):
    rows = list(enumerate(odd_texts()))
    out = encode_documents(frame(spark, rows), vocabulary).select("row.doc_id", "ids", vocabulary.token_bytes(F.col("ids")))
    found = {d: (ids, bytes(data)) for d, ids, data in out.collect()}
    assert found == {d: (library.encode_ordinary(t), t.encode()) for d, t in rows}


def test_messy_rows(spark, vocabulary, library):
    rows = messy()
    out = encode_documents(frame(spark, rows), vocabulary)
    assert out.select("row.*").columns == frame(spark, rows).columns
    found = [(r["doc_id"], tuple(r["ids"])) for r in out.select("row.doc_id", "ids").collect()]
    assert order(found) == order([(d, tuple(library.encode_ordinary(t or ""))) for d, t in rows])
    assert encode_documents(frame(spark, []), vocabulary).count() == 0


@pytest.mark.parametrize("most", [0, 5, 1 << 18])
def test_any_table_of_frequent_units_gives_the_same_ids(spark, vocabulary, library, monkeypatch, most):
    common = byte_bpe.common_units
    monkeypatch.setattr(byte_bpe, "common_units", lambda docs, v: common(docs, v, most))
    rows = [(i, f"once upon a time, time {i % 3}, qqzx{i}\n") for i in range(30)]
    held = byte_bpe.common_units(frame(spark, rows), vocabulary)
    assert len(held) <= most and (most < 9 or len(held) > 5)
    out = encode_documents(frame(spark, rows), vocabulary).select("row.doc_id", "ids")
    assert {d: ids for d, ids in out.collect()} == {d: library.encode_ordinary(t) for d, t in rows}


def test_merges_of_any_ranks(spark):
    """Ranks that no training would give: later merges may come first."""
    rng = random.Random(1)
    for _ in range(5):
        tokens = {bytes([b]) for b in range(256)}
        tokens |= {"".join(rng.choice("abc") for _ in range(rng.randrange(2, 6))).encode() for _ in range(40)}
        shuffled = sorted(tokens)
        rng.shuffle(shuffled)
        vocabulary = ByteVocabulary({t: i for i, t in enumerate(shuffled)}, r"[^ ]+| ", r"(?= )")
        library = tiktoken.Encoding("any", pat_str=vocabulary.pattern, mergeable_ranks=vocabulary.ranks, special_tokens={})
        rows = [(i, "".join(rng.choice("abc ") for _ in range(rng.randrange(40)))) for i in range(60)]
        out = encode_documents(frame(spark, rows), vocabulary).select("row.doc_id", "ids")
        assert {d: ids for d, ids in out.collect()} == {d: library.encode_ordinary(t) for d, t in rows}
        for _, text in rows:
            word = text.replace(" ", "").encode()
            if word:
                assert merge_long(vocabulary.ranks, word) == library.encode_ordinary(word.decode())


def test_unknown_ids_stand_for_nothing(spark, vocabulary):
    row = spark.range(1).select(vocabulary.token_bytes(F.array(F.lit(10**6), F.lit(0)))).first()[0]
    assert bytes(row) == next(t for t, r in vocabulary.ranks.items() if r == 0)


def test_query(spark, checked, vocabulary, library):
    found = sorted(tuple(r) for r in QUERIES["op13_byte_bpe"](spark, checked).collect())
    wanted = []
    for d, text in documents(spark, checked).collect():
        ids = library.encode_ordinary(text or "")
        digests = (np.array(ids, "<u4").tobytes(), (text or "").encode())
        wanted.append((d, len(ids), *(hashlib.sha256(x).hexdigest() for x in digests)))
    assert found == sorted(wanted)
