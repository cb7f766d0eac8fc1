"""The library is asked once per piece of words, with the library's own ids."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import public_tokenizers

from matchlake.llm import word_tokens

WORDS = public_tokenizers.path("word_bpe_49k.json")
whole = lru_cache(word_tokens.library)


def _ids(text: str) -> bytes:
    encoded = whole(WORDS).encode(text, add_special_tokens=False)
    return np.array(encoded.ids, dtype="<u4").tobytes()


def test_words_that_share_pieces_are_encoded_once(monkeypatch):
    asked = []

    class Counted:
        def __init__(self, tokenizer):
            self.tokenizer = tokenizer

        def encode_batch_fast(self, texts, **options):
            asked.extend(texts)
            return self.tokenizer.encode_batch_fast(texts, **options)

    monkeypatch.setattr(word_tokens, "library", lambda path: Counted(whole(path)))
    text = " ".join(f"{word}{end}" for word in ("Forest", "forest", "FOREST", "rivière")
                    for end in ("", ".", ",", "!", "...", "42"))
    encode = word_tokens.encoder.__wrapped__(WORDS)
    assert encode([text, text]) == [_ids(text)] * 2
    assert "".join(asked).lower().count("forest") == 1


def test_pieces_give_the_library_ids():
    encode = word_tokens.encoder.__wrapped__(WORDS)
    letters = [chr(c) for c in (*range(0x20, 0x7f), *range(0xa1, 0x250))]
    texts = [t for c in letters for t in (f"a{c}b {c}{c}.", f"1{c}2'{c}", f".{c} {c}'s")]
    texts += ["don't 'sample o'clock İİ. ƝĽİ\nćȖŶÒ", "x<|endoftext|>y <|b a|>", "Ɓa Ⱥb Ʉc", ""]
    assert encode(texts) == [_ids(t) for t in texts]
