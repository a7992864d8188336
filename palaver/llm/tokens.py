"""Token ids of whole texts, word by word, with a bounded cache of words.

The tokenizer drops white space and never joins characters across it, so a text's ids are
the ids of its words in a row. Words repeat; their ids are kept as little-endian unsigned
32-bit bytes, and a text is the join of its words' bytes.
"""

from __future__ import annotations

import struct

KEEP = 250_000  # words in a generation; a full generation replaces the older one
TRAILING = ".,;:!?)(*#$%&\"-"  # cut off the end of a word: always a piece of its own beside letters
EXTRA_BLANKS = "\x1c\x1d\x1e\x1f"  # blanks to str.split() but not to the tokenizer


def _byte_letters() -> dict[int, str]:
    """Printable stand-ins of the 256 bytes in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Words(dict):
    """word -> bytes of its ids; least used words leave by generations."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.model, self.older = tokenizer, tokenizer.model, {}
        self.letters = _byte_letters()

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self._encode(word)
        if len(self) >= KEEP:
            self.older = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def _encode(self, word: str) -> bytes:
        core = word.rstrip(TRAILING)
        if core and core != word:
            lower = core.lower()
            if _simple(lower):
                return self[lower] + self[word[len(core):]]
        lower = word.lower()
        if _simple(lower):
            if lower != word:
                return self[lower]
            ids = [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.letters))]
        else:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)


def _simple(word: str) -> bool:
    """Letters that no normal form and no context of case mapping changes."""
    return word.isalpha() and (word.isascii() or max(word) < "ɐ")


_LOADED: dict[str, Words] = {}


def words_of(path: str) -> Words:
    """The cache of this worker process for one vocabulary file."""
    if path not in _LOADED:
        from tokenizers import Tokenizer

        _LOADED[path] = Words(Tokenizer.from_file(path))
    return _LOADED[path]


def encode(text: str, words: Words) -> bytes:
    """Ids of the whole text, four bytes each."""
    if any(c in text for c in EXTRA_BLANKS):
        return struct.pack(f"<{len(i := words.tokenizer.encode(text, add_special_tokens=False).ids)}I", *i)
    return b"".join(map(words.__getitem__, text.split()))


def vocabulary(name: str) -> str:
    """Place of a public tokenizer file on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)
