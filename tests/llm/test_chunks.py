"""Memory of a chunk of substring dedup."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np

from matchlake.llm import substring_dedup


def test_a_chunk_takes_few_bytes_a_word():
    draw = random.Random(3)
    names = [f"w{k}" for k in range(5_000)]
    texts = [" ".join(draw.choices(names, k=n)).encode() for n in [0, 3, 400] * 500]
    texts.append(texts[2])
    n_words = sum(len(t.split()) for t in texts)
    row = {"chunk": 0, "doc_ids": list(range(len(texts))), "sizes": [len(t) for t in texts],
           "n_words": n_words, "texts": substring_dedup._squeeze(b"".join(texts), 3)}
    substring_dedup.word_hashes([t.encode() for t in names])
    tracemalloc.start()
    chunk = substring_dedup.Chunk(row)
    chunk.blocks()
    chunk.windows(np.ones(len(chunk.block_hash), bool))
    first, second, ids = chunk.window_entries()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(first) == len(second) == len(ids) == 500 * 381
    assert peak < 75 * n_words
