"""Exact tokenizer ids of whole texts at the speed of a dictionary.

The byte-level tokenizers here never let a merge cross a word, so a text's ids are the ids of its words in a row. Words are
looked up in a bounded memo; a new one goes through the tokenizer's own normalizer, pre-tokenizer and model. Texts in which
white space or a special token's name makes words depend on each other are given to the tokenizer whole.
"""

from __future__ import annotations

import codecs
import functools
import os
import re
import struct

#: Python's split() takes these for white space, the tokenizers do not.
ODD = ("<|", "\x1c", "\x1d", "\x1e", "\x1f")
ODD_MARK = re.compile("|".join(map(re.escape, ODD)))
#: White space, ASCII first. A space before any of it may be joined with it by the pre-tokenizer.
SPACES = (0x20, *range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)

#: White space but the space, and a space before it: most texts hold neither, and one character is found faster than two.
JOINABLE = tuple((chr(code), f" {chr(code)}") for code in SPACES[1:])


#: ASCII marks but the apostrophe, with which contractions begin.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Letters before this one are never changed by their neighbours; there are no combining marks among them.
LATIN_END = "\u0250"
LATIN = [chr(code) for code in range(ord(LATIN_END)) if chr(code).isalpha()]
#: The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_CHARACTERS = {byte: 256 + k for k, byte in enumerate(b for b in range(256) if b not in _PRINTABLE)}
SPACE, FEED = chr(BYTE_CHARACTERS[0x20]), chr(BYTE_CHARACTERS[0x0A])
ALPHABET = "".join(chr(BYTE_CHARACTERS.get(byte, byte)) for byte in range(256))
PACK = [struct.Struct(f"<{n}I").pack for n in range(16)]


def tokenizer_path(name: str) -> str:
    """A path as it is; a bare file name is looked up among the public tokenizers."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


#: Characters of a remembered word that count as one more entry.
KEY_CHARS = 32


class _Memo(dict):
    """Made values of two generations: when the young one is full it becomes the old one, from which used values come back.

    A long key counts as several, so the limit bounds the memory whatever a language's words are. worth(key, memo) is false
    for a new key whose value is not to be kept.
    """

    def __init__(self, make, limit: int, worth=None):
        super().__init__()
        self.make, self.limit, self.old, self.size, self.worth = make, limit, {}, 0, worth

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:  # any other value counts as made: arrays have no truth, empty values are false
            if self.worth is not None and not self.worth(key, self):
                return self.make(key)
            value = self.make(key)
        if self.size >= self.limit:
            self.old = dict(self)
            self.clear()
            self.size = 0
        self.size += 1 + len(key) // KEY_CHARS
        self[key] = value
        return value


@functools.cache
def word_encoder(name: str) -> WordEncoder:
    """One per Python worker: later tasks find the words of earlier ones."""
    return WordEncoder(name)


class WordEncoder:
    """encode(text): ids as packed little-endian unsigned 32-bit integers. Names of special tokens are ordinary text."""

    def __init__(self, name: str, memo_limit: int = 300_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(tokenizer_path(name))
        self.whole.encode_special_tokens = True
        self.model, self.normalizer, self.splitter = self.whole.model, self.whole.normalizer, self.whole.pre_tokenizer
        self.keeps_space = len(self.whole.encode(" ", add_special_tokens=False).ids) > 0
        self.letters = self.keeps_space and self.normalizer is None
        self.lowers = self.normalizer is not None and all(self.normalizer.normalize_str(letter) == letter.lower() for letter in LATIN)
        self.pieces, self.plain = _Memo(self._piece, memo_limit), _Memo(self._plain, memo_limit)
        #: Words as they are, and words that follow a space, without it.
        self.words = _Memo(self._word, memo_limit, self._comes_again)
        self.spaced = _Memo(self._spaced, memo_limit, self._comes_again)
        self.vocabulary = self.whole.get_vocab_size()

    def _comes_again(self, word: str, memo: _Memo) -> bool:
        """Words with a line feed or with marks behind them are made of remembered words: the first hardly come again, the others
        are remembered when their letters are known by then."""
        if word.isalpha():
            return True
        if "\n" in word:
            return "\n\n" in word
        core = word.rstrip(MARKS)
        if not core.isalpha():
            return True
        if self.normalizer is not None:
            core = core.lower()
        return core in memo or core in memo.old

    def _piece(self, piece: str) -> bytes:
        ids = [token.id for token in self.model.tokenize(piece)]
        return PACK[len(ids)](*ids) if len(ids) < len(PACK) else struct.pack(f"<{len(ids)}I", *ids)

    def _plain(self, piece: str) -> bytes:
        """A piece of printable characters, perhaps with a space before it: the model's alphabet has one character per byte."""
        if piece.isascii() and not self.keeps_space:
            return self._piece(piece)
        if piece.isascii():
            return self._piece(piece.replace(" ", SPACE))
        return self._piece(codecs.charmap_decode(piece.encode(), "strict", ALPHABET)[0])

    def _known(self, word: str) -> bytes:
        return self.spaced[word[1:]] if self.keeps_space and word[:1] == " " else self.words[word]

    def _spaced(self, word: str) -> bytes:
        """A word without the space before it."""
        if self.letters:
            if word.isalpha():
                # Most new words.
                return self._piece(SPACE + (word if word.isascii() else codecs.charmap_decode(word.encode(), "strict", ALPHABET)[0]))
            core = word.rstrip(MARKS)
            if core.isalpha():
                return self.spaced[core] + self.plain[word[len(core) :]]
        return self._word(" " + word)

    def _word(self, word: str) -> bytes:
        if self.letters and word[:1] == " " and word.isascii() and word[1:].isalpha():
            return self._piece(SPACE + word[1:])
        if self.normalizer is not None:
            plain = word.isascii() or self.lowers and word.isalpha() and max(word) < LATIN_END
            word = word.lower() if plain else self.normalizer.normalize_str(word)
        if (word[1:] if self.keeps_space and word[:1] == " " else word).isalpha():
            return self._plain(word)
        core = word.rstrip(MARKS)
        if (core[1:] if self.keeps_space and core[:1] == " " else core).isalpha():
            # Letters, then marks: the pre-tokenizer cuts exactly there.
            return self._known(core) + self.plain[word[len(core) :]]
        head, _, rest = word.partition("\n")
        if rest and head and not head[-1].isspace() and not rest[0].isspace():
            # A single line feed between words is a piece of its own.
            return self._known(head) + self.pieces[FEED] + self._known(rest)
        return b"".join([self.pieces[piece] for piece, _ in self.splitter.pre_tokenize_str(word)])

    def unit(self, unit: str) -> bytes:
        """Ids of a part of a text that no word crosses at either end; nothing is remembered of it as a whole."""
        if ODD_MARK.search(unit):
            ids = self.whole.encode(unit, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        return self._word(unit)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if "<|" in text or "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
            ids = self.whole.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        if not self.keeps_space:
            return b"".join(map(self.words.__getitem__, text.split()))
        if text[-1] == " " or "  " in text or any([code in text and mark in text for code, mark in (JOINABLE[:5] if text.isascii() else JOINABLE)]):
            return self._word(text)
        head, *rest = text.split(" ")
        return b"".join([self.words[head] if head else b"", *map(self.spaced.__getitem__, rest)])
