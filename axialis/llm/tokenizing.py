"""What the token operators share: splitting texts into pre-tokens as a tokenizer of the tokenizers library does.

`split` is used only for texts whose every character is in PLAIN (ASCII without the separators 1C to 1F, and
Latin letters that NFC leaves alone), where Python's classes of letters, digits and white space agree with
those of the library; any other text, and one that holds a special string, goes to the library whole."""

from __future__ import annotations

import os
import re
import struct

NOT_PLAIN = re.compile("[^\x00-\x1b\x20-\x7f\xa1\xab\xbb\xbf\xc0-įı-ňŊ-ž]")
BYTE_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
WORD_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
CACHE = 400_000
KEPT_MOST = 4
KEPT: dict = {}


def load(path: str):
    """The tokenizer, on the task's own thread only: parallel threads would take other tasks' cores and memory."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def special(tokenizer) -> re.Pattern:
    """Matches what the library may take for a special string."""
    found = [re.escape(t.content) for t in tokenizer.get_added_tokens_decoder().values()]
    return re.compile("|".join(found) or r"(?!)", re.I)


def byte_names() -> dict[int, str]:
    """The printable character by which byte-level BPE names each byte: its own if printable, else from 256 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return {b: chr(b) if b in kept else chr(next(rest)) for b in range(256)}


def by_model(tokenizer):
    """A function from one pre-token to its ids: the library's BPE model on the bytes' names."""
    names, model = byte_names(), tokenizer.model
    return lambda token: [t.id for t in model.tokenize(token.encode().decode("latin-1").translate(names))]


def kept_in_process(key: str, make):
    """make()'s result, kept by this Python process for later tasks with the same key; at most KEPT_MOST results."""
    if key not in KEPT:
        while len(KEPT) >= KEPT_MOST:
            KEPT.pop(next(iter(KEPT)))
        KEPT[key] = make()
    return KEPT[key]


class Memo(dict):
    """Pre-token to value, each encoded when first asked for; between chunks at most CACHE of them are kept.

    When full, the later part goes: common words come early, so the earlier half of CACHE has them."""

    def __init__(self, encode, value):
        super().__init__()
        self.encode, self.value = encode, value

    def __missing__(self, token):
        out = self[token] = self.value(self.encode(token))
        return out

    def trim(self) -> None:
        if len(self) > CACHE:
            for _ in range(len(self) - CACHE // 2):
                self.popitem()


def as_bytes(ids) -> bytes:
    return struct.pack(f"<{len(ids)}H", *ids)
