"""Token ids of whole texts, by the tokenizers library, with the ids of repeated parts kept.

Both vocabularies used here cut a text at every step from a character that is not white space to
one that is, before any merge. The ids of a text are therefore the ids of its words (with the
white space before each, where it counts) one after the other, and a word met before need not be
encoded again. A text of ASCII and Latin letters is cut at once by the vocabulary's own pattern, and so is such a
word of another text; of the parts most are known already, and the others go to the vocabulary's merges directly.
"""

from __future__ import annotations

import re
import struct

from funclab.llm.common import worker_store

# White space of Unicode's White_Space property, which is what the vocabularies' patterns use.
SPACE = "\t-\r \x85\xa0  -     　"
#: Words of texts in other scripts, and parts, kept by a worker are at most twice this many each, unless an operator
#: asks for another number; one takes about 200 bytes.
KEPT_WORDS = 600_000
# Letters of the Latin blocks next to ASCII, which are one character each and letters in every version of Unicode.
LATIN = "\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
LETTERS = "A-Za-z" + LATIN
# How the vocabularies cut a text of these letters and ASCII before merges; the second one is met in lower case. Letters
# come first, being most of a text: no other part begins with one.
BYTE_PARTS = f" ?[{LETTERS}]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9]+| ?[^{SPACE}{LETTERS}0-9]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
WORD_PARTS = f"[{LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^{SPACE}{LETTERS}0-9]+"


def byte_signs() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself where it prints, else the next after 255."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in prints]
    signs = {b: chr(b) for b in prints} | {b: chr(256 + k) for k, b in enumerate(others)}
    return [signs[b] for b in range(256)]


class _Kept(dict):
    """Ids by word. Once full, what is held becomes the older half, and words in use move over."""

    def __init__(self, encode, kept=None):
        super().__init__()
        self.encode, self.older, self.kept = encode, {}, kept or KEPT_WORDS

    def __missing__(self, word):
        if len(self) >= self.kept:
            self.older = dict(self)
            self.clear()
        ids = self.older.get(word)
        if ids is None:
            ids = self.encode(word)
        self[word] = ids
        return ids


class TextEncoder:
    """``encode(text)`` gives a text's ids as little-endian unsigned 32-bit integers.

    With ``spaced`` the white space before a word belongs to it (byte-level vocabularies); without,
    white space is dropped. Strings of special tokens in a text are ordinary text. A null text is
    an empty one.
    """

    def __init__(self, path: str, spaced: bool, kept: int | None = None):
        from tokenizers import Tokenizer

        self.spaced = spaced
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.merged, self.parts = self.tokenizer.model.tokenize, _Kept(self._part, kept)
        self.cut = re.compile(BYTE_PARTS if spaced else WORD_PARTS).findall
        letters = re.findall(f"[{LATIN}]", "".join(map(chr, range(0x250))))
        # Not those that leave the blocks in lower case, or become two characters.
        letters = "".join(c for c in letters if spaced or c.lower() in letters)
        self.latin = re.compile(f"[\\x00-\\x7f{SPACE}{letters}]*").fullmatch
        self.signs = byte_signs()
        # With ``spaced``, words by what follows the one space before them.
        self.words = _Kept((lambda word: self._word(" " + word)) if spaced else self._word, kept)
        self.pieces = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+" if spaced else f"[^{SPACE}]+")
        self.doubled = re.compile(f" [{SPACE}]|[{SPACE}] ")

    def _word(self, word: str) -> bytes:
        return self._latin(word) if self.latin(word) else self._whole(word)

    def _latin(self, text: str) -> bytes:
        return b"".join(map(self.parts.__getitem__, self.cut(text if self.spaced else text.lower())))

    def _part(self, part: str) -> bytes:
        if not part.isprintable():
            return self._whole(part)
        # Merges work on characters that stand for bytes; of printable ASCII only the space has another.
        signs = part.replace(" ", "\u0120") if part.isascii() else "".join([self.signs[b] for b in part.encode()])
        ids = [token.id for token in self.merged(signs)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.latin(text):
            return self._latin(text)
        if not self.spaced:
            # str.split() also cuts at four separators that are no white space to the vocabulary.
            plain = not any(c in text for c in "\x1c\x1d\x1e\x1f")
            return b"".join(map(self.words.__getitem__, text.split() if plain else self.pieces.findall(text)))
        if text[0] == " " or text[-1] == " " or self.doubled.search(text):
            return b"".join(map(self._word, self.pieces.findall(text)))
        first, *rest = text.split(" ")
        return self._word(first) + b"".join(map(self.words.__getitem__, rest))


def encoder(path: str, spaced: bool, kept: int | None = None) -> TextEncoder:
    """The worker's encoder for a vocabulary file, loaded once."""
    held = worker_store("encoders")
    if (path, spaced, kept) not in held:
        held[path, spaced, kept] = TextEncoder(path, spaced, kept)
    return held[path, spaced, kept]
