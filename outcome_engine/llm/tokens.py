"""Ids of whole texts through the tokenizers library, each distinct piece of text between spaces encoded once per task.

Both vocabularies split a text before a space or line end that a visible character follows, whatever stands around it,
so a text's ids are the ids of these pieces one after the other. They also split between a letter or digit and the signs
behind it, so that a word with signs has the ids of the word and those of the signs.
"""

from __future__ import annotations

import json
import os
import re
import struct

from .common import without_collection

CACHE = 400_000  # pieces remembered by a task; beyond it the memory starts anew, which changes no result


def load(path: str):
    """The tokenizer of a file, without truncation, padding or threads of its own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def keeps_spaces(path: str) -> bool:
    """Whether white space is part of the tokens (byte-level vocabularies) or only separates them."""
    with open(path, encoding="utf-8") as file:
        return json.load(file)["normalizer"] is None


def special_strings(tokenizer) -> dict[str, int]:
    """Added tokens by their text; they match as written, wherever they stand."""
    added = tokenizer.get_added_tokens_decoder()
    if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values()):
        raise ValueError("only vocabularies with added tokens that match as written")
    return {t.content: number for number, t in added.items()}


def splitter(marks) -> re.Pattern:
    """split() gives plain text and special strings in turn, the longest mark first where several begin."""
    return re.compile("(" + "|".join(map(re.escape, sorted(marks, key=len, reverse=True))) + ")") if marks else re.compile("((?!))")


CUT = re.compile(r" (?=\S)|(?=\n\S)")
UNUSUAL = (re.compile(r" (?:\s|\Z)"), re.compile(r"\n(?:\s|\Z)"))
PLAIN_SPACE = str.maketrans("\n\t\r", "   ")
SIGNS = ".,;:!?#$%&*"  # fixed: signs that are neither letters, digits, white space nor the start of an English ending


def pieces_with_spaces(text: str) -> list[str]:
    """Cut before each space or line end that a visible character follows. A piece loses its leading space, but keeps a
    leading line end; the first is what stands before the first cut."""
    if any(x.search(text) for x in UNUSUAL):
        return CUT.split(text)
    return text.replace("\n", " \n").split(" ")


def with_space(piece: str) -> str:
    """A piece other than the first as it stands in the text."""
    return piece if piece[:1] == "\n" else " " + piece


SEPARATORS = "\x1c\x1d\x1e\x1f"  # fixed: white space to Python, but not to the vocabulary


def pieces_between_spaces(text: str) -> list[str]:
    """Cut at white space, which the vocabulary drops."""
    if any(x in text for x in SEPARATORS):
        return [x for x in text.translate(PLAIN_SPACE).split(" ") if x]
    return text.split()


#: fixed: printable bytes stand for themselves in the vocabularies' alphabet, the others for the characters from 256 on
PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
ALPHABET = dict(zip([*sorted(PRINTABLE), *sorted(set(range(256)) - PRINTABLE)], map(chr, [*sorted(PRINTABLE), *range(256, 324)])))
AS_BYTES = {byte: char for byte, char in ALPHABET.items() if chr(byte) != char}
SPACE = ALPHABET[32]


def latin_word(text: str) -> str | None:
    """A run of Latin letters in the vocabularies' alphabet, None for all else. Such letters are composed already, and both
    vocabularies take a run of them as one word."""
    if text.isascii():
        return text if text.isalpha() else None
    if text.isalpha() and max(text) < "\u0250":
        return text.encode().decode("latin-1").translate(AS_BYTES)
    return None


class CachedEncoder:
    """encode(texts) gives each text's ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, cache: int = CACHE):
        self.tokenizer, self.cache = load(path), cache
        self.spaces, self.special = keeps_spaces(path), special_strings(self.tokenizer)
        self.ids_of = {text: struct.pack("<I", number) for text, number in self.special.items()}
        self.cut = splitter(self.special)
        self.word = self.tokenizer.model.tokenize  # the library's encoding of a single word
        self.line_end = little_endian(self.tokenizer.encode("\n", add_special_tokens=False).ids)
        self.known: dict[str, bytes] = {}
        self.signs: dict[str, bytes] = {}

    @without_collection
    def learn(self, wanted: set[str]) -> None:
        if len(self.known) + len(wanted) > self.cache:
            self.known = {x: self.known[x] for x in wanted if x in self.known}
        known, new, composed = self.known, set(), []
        for piece in wanted.difference(known):
            if piece.isalpha():
                new.add(piece)
                continue
            core = piece.rstrip(SIGNS)
            if len(core) < len(piece) and core[-1:].lower().isalnum():
                composed.append((piece, core, piece[len(core):]))
                if core not in known:
                    new.add(core)
            else:
                new.add(piece)
        other, word, lead = [], self.word, SPACE if self.spaces else ""
        for piece in new:
            if piece.isascii() and piece.isalpha():
                known[piece] = little_endian([t.id for t in word(lead + (piece if lead else piece.lower()))])
                continue
            ids = self.word_ids(piece)
            if ids is None:
                other.append(piece)
            else:
                known[piece] = ids
        self.look_up(self.tokenizer, [with_space(x) for x in other] if self.spaces else other, other, known)
        signs = [x for x in {signs for *_, signs in composed} if x not in self.signs]
        self.look_up(self.tokenizer, signs, signs, self.signs)
        for piece, core, signs in composed:
            known[piece] = known[core] + self.signs[signs]

    def word_ids(self, piece: str) -> bytes | None:
        """Ids of a piece that is a plain word, with the space or line end before it."""
        if self.spaces:
            if piece[:1] == "\n":
                word = latin_word(piece[1:])
                return None if word is None else self.line_end + little_endian([t.id for t in self.word(word)])
            word = latin_word(piece)
            return None if word is None else little_endian([t.id for t in self.word(SPACE + word)])
        word = latin_word(piece.lower()) if piece.isascii() or piece.isalpha() and max(piece) < "\u0250" else None
        return None if word is None else little_endian([t.id for t in self.word(word)])

    @staticmethod
    def look_up(library, texts: list[str], names: list[str], into: dict[str, bytes]) -> None:
        for start in range(0, len(texts), 4096):
            found = library.encode_batch_fast(texts[start:start + 4096], add_special_tokens=False)
            into |= zip(names[start:start + 4096], [little_endian(x.ids) for x in found])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Special strings are taken out first, as the library does; what stands between two is a text of its own."""
        if not any(mark in text for mark in self.special for text in texts):
            return self.encode_plain(texts)
        parts = [self.cut.split(x) for x in texts]
        plain = iter(self.encode_plain([p for x in parts for p in x[::2]]))
        return [b"".join(self.ids_of[p] if i % 2 else next(plain) for i, p in enumerate(x)) for x in parts]

    def encode_plain(self, texts: list[str]) -> list[bytes]:
        if not self.spaces:
            cut = [pieces_between_spaces(x) for x in texts]
            self.learn(set().union(*cut))
            get = self.known.__getitem__
            return [b"".join(map(get, x)) for x in cut]
        cut = [pieces_with_spaces(x) for x in texts]
        first = [x.pop(0) for x in cut]
        heads = [little_endian(x.ids) for x in self.tokenizer.encode_batch_fast(first, add_special_tokens=False)]
        self.learn(set().union(*cut))
        get = self.known.__getitem__
        return [head + b"".join(map(get, x)) for head, x in zip(heads, cut)]


FORMATS = [f"<{n}I" for n in range(64)]


def little_endian(ids: list[int]) -> bytes:
    return struct.pack(FORMATS[len(ids)] if len(ids) < 64 else f"<{len(ids)}I", *ids)
