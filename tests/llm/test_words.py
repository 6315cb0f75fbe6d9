"""How op8 tells chunks and words apart, and what it moves."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
import regex

from kinloom.llm import word_bpe


def splits(pattern, texts):
    splitter = word_bpe.Splitter(pattern)
    lengths, codes = splitter.split_all(texts)
    names, at = list(splitter.codes), 0
    for text, n in zip(texts, lengths.tolist(), strict=True):
        assert [names[c] for c in codes[at : at + n]] == regex.findall(pattern, text), repr(text)
        at += n
    assert at == len(codes) and word_bpe.Splitter(pattern).distinct(texts) == set(names)


@pytest.mark.parametrize("pattern", [None, r"\S+", r"\S+\s?", r"\w+|\s|[^\w\s]+"])
def test_texts_of_a_block_split_as_each_by_itself(pattern):
    import public_tokenizers

    r = random.Random(2)
    texts = ["", " ", "x", " x", "x ", "a\n", "a\n b", "b", *("".join(r.choice("ab's.! \n 3中") for _ in range(r.randint(0, 60))) for _ in range(400))]
    texts += [" ".join(r.choice(("it's", "x" * 64, "x" * 65, "x" * 100 + "y", "x" * 100 + "z", "a\0", "a", "中文中")) for _ in range(50)) for _ in range(20)]
    splits(pattern or public_tokenizers.PATTERN, texts)


@pytest.mark.parametrize("alike", [False, True])
def test_chunks_with_equal_hashes_are_told_apart(monkeypatch, alike):
    if alike:
        monkeypatch.setattr(word_bpe, "_ODD", np.uint64(0))
    r = random.Random(3)
    chunks = ["".join(r.choice("ab\0é") for _ in range(r.choice((1, 7, 8, 9, 16, 17, 63, 64, 65, 200)))) for _ in range(300)] * 3
    number, found = word_bpe.told_apart(" ".join(chunks).encode())
    assert [found[i].decode() for i in number] == chunks and len(found) == len(set(chunks))


def test_words_are_dealt_alike_in_any_order():
    words = [f" prefixes{i}" for i in range(500)] + ["a", "a\0", "é", "\n"]
    want, place, ends = word_bpe.dealt(words, 7)
    assert [want[p] for p in place] == [w.encode() for w in words] and ends[-1] == len(words)
    assert word_bpe.dealt(words[::-1], 7)[0] == want
    assert all(want[a:b] == sorted(want[a:b]) for a, b in zip([0, *ends], ends, strict=False))


def test_words_move_without_their_numbers():
    import public_tokenizers

    r = random.Random(4)
    text = " ".join({f"{r.getrandbits(40):x}" for _ in range(20_000)})
    docs = [pa.record_batch([pa.array([1]), pa.array([text])], names=["doc_id", "text"])]
    rows = pa.Table.from_batches(word_bpe.explode_words(public_tokenizers.PATTERN, 4, word_bpe.WORDS)(iter(docs)))
    moved, packed = 0, 0
    for blob in rows["blob"].to_pylist():
        first, sizes, joined = word_bpe.unpack(blob)
        moved += len(first) + len(sizes) + len(joined)
        packed += len(joined) + len(sizes)
    assert moved == packed + 4 * len(rows)  # one number for each partition, not one for each word
