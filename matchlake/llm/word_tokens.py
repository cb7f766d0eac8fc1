"""Token ids of whole texts by a public tokenizer file, one library call per distinct piece.

For texts whose characters all lie in ``_PLAIN`` the tokenizer works on each blank-separated
word alone (its patterns never cross white space and its normaliser changes single characters),
so a text's ids are the ids of its words in a row.  A word without apostrophes and marks of
special tokens is lower-cased and falls into runs of letters, single digits and runs of the rest,
as in the tokenizer's own pattern; the library is asked once per distinct piece.  Ids of words
and of pieces are kept in bounded dictionaries.  All other texts go to the library whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np

#: Characters whose case and class all Unicode versions agree on, without unusual white space.
_PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-ɏ]*")
#: Letters of ``_PLAIN`` in lower case, some of which lie beyond it.
_LETTERS = "a-zªµºß-öø-įı-ʯⱥⱦ"
_RUN = re.compile(f"[{_LETTERS}]+")
_PIECES = re.compile(f"[{_LETTERS}]+|[0-9²³¹¼-¾]|[^{_LETTERS}0-9²³¹¼-¾]+")
#: Words with these stay whole: contractions, special tokens, a capital that becomes two characters.
_WHOLE = re.compile("'|<\\||İ")
#: Words kept at a time; the dictionary starts anew beyond that (about 200 MB).
KEPT_WORDS = 1_000_000
KEPT_PIECES = 400_000
#: Stands between new pieces, which are encoded many at a time; not in ``_PLAIN``, so in no word.
MARK = "\x01"
JOINED_PIECES = 500
#: Plain texts whose new words are encoded together.
JOINED_TEXTS = 16


def library(path: str):
    """The tokenizer of a file, without padding and truncation, in one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


@lru_cache(maxsize=4)
def encoder(path: str) -> Callable[[list[str]], list[bytes]]:
    """A function from texts to their ids as little-endian unsigned 32-bit bytes."""
    tokenizer = library(path)
    known: dict[str, bytes] = {}
    pieces: dict[str, bytes] = {}

    def ids_of(texts: list[str]) -> list[bytes]:
        found = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    mark = np.frombuffer(ids_of([MARK])[0], "<u4")

    def ids_between(items: list[str], between: str) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(items), JOINED_PIECES):
            ids = ids_of([between.join(items[at:at + JOINED_PIECES])])[0]
            ends = 4 * np.flatnonzero(np.frombuffer(ids, "<u4") == mark[0])
            out += [ids[a:b] for a, b in zip([0, *(ends + 4).tolist()], [*ends.tolist(), len(ids)])]
        return out

    def ids_of_words(words: list[str]) -> list[bytes]:
        if len(mark) != 1:
            return ids_of(words)
        cut = [[w] if _WHOLE.search(w) else _PIECES.findall(w.lower()) for w in words]
        new = set().union(*cut).difference(pieces)
        if len(pieces) + len(new) > KEPT_PIECES:
            pieces.clear()
            new = set().union(*cut)
        runs = [p for p in new if _RUN.fullmatch(p)]
        pieces.update(zip(runs, ids_between(runs, MARK), strict=True))
        rest = list(new.difference(runs))
        pieces.update(zip(rest, ids_between(rest, f" {MARK} "), strict=True))
        return [b"".join(map(pieces.__getitem__, c)) for c in cut]

    def encode(texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(texts), JOINED_TEXTS):
            some = texts[at:at + JOINED_TEXTS]
            split = [t.split() if _PLAIN.fullmatch(t) else None for t in some]
            words = set().union(*filter(None, split))
            new = list(words.difference(known))
            if new:
                if len(known) > KEPT_WORDS:
                    known.clear()
                    new = list(words)
                known.update(zip(new, ids_of_words(new), strict=True))
            out += [ids_of([t])[0] if w is None else b"".join(map(known.__getitem__, w))
                    for t, w in zip(some, split)]
        return out

    return encode
