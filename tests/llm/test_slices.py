"""op10 encodes the texts of a slice together, each as by itself."""

from __future__ import annotations

import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from kinloom.llm import queries, token_files

VOCABULARY = queries.vocabulary("byte_bpe_50k.json")


def test_texts_of_a_slice_are_encoded_as_each_by_itself():
    encoder, r = token_files.ChunkEncoder(VOCABULARY), random.Random(5)
    texts = ["", " ", "x", " x", "x ", "\n", "a\n", "\na b", "a\n\nb c", "a <|endoftext|> b", "c\0 c \0", "\tx y", "x  y", "中文 中文 é"]
    texts += ["".join(r.choice("ab'é.! \n 3中") for _ in range(r.randint(0, 40))) for _ in range(300)]
    for some in (texts, texts[::-1], [], [""], ["one"]):
        n, flat = encoder.encode_all(some, token_files.packed([2]))
        want = [[*encoder.tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in some]
        assert n.tolist() == [len(w) for w in want]
        assert flat.tolist() == [i for w in want for i in w]


def test_chunks_are_told_apart():
    chunks = ["", "a", "a\0", "é", "x" * 100, "a", "", "\n"] * 3
    number, found = token_files.told_apart(" ".join(chunks))
    assert [found[i] for i in number] == chunks and len(found) == len(set(chunks))


def test_a_chunk_of_many_texts_of_a_slice_is_looked_for_once(monkeypatch):
    asked, remember = [], token_files.ChunkEncoder.remember
    monkeypatch.setattr(token_files.ChunkEncoder, "remember", lambda self, chunk: asked.append(chunk) or remember(self, chunk))
    monkeypatch.setattr(token_files, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    token_files.encoder_of.cache_clear()
    texts = [f"{i} someword otherword, anotherword" for i in range(40)]
    batch = pa.record_batch([pa.array(range(40)), pa.array(texts)], names=["doc_id", "text"])
    (out,) = token_files.encode_rows(VOCABULARY, 2)(iter([batch]))
    token_files.encoder_of.cache_clear()
    assert np.diff(out.column("before").to_pylist()).tolist() == out.column("n_tokens").to_pylist()[:-1]
    assert sorted(asked) == ["anotherword", "otherword,", "someword"]
