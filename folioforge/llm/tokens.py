"""Token ids of a public tokenizer for whole texts, word by word.

The vocabulary splits at white space first, so the ids of a text are those of its space-separated chunks in a row. Chunks are
looked up in a cache of packed ids (little-endian, unsigned, 32 bits). A chunk of ASCII and Latin-1 letters is cut into the vocabulary's
word pieces here and only those go to the model; any other chunk goes to the tokenizer itself, as it is. Tests compare
the result with the tokenizer's own on whole texts.
"""

from __future__ import annotations

import re
import struct

from folioforge.llm.common import kept

NAME = "word_bpe_49k.json"

#: Chunks for which lower-casing and normalisation are the same everywhere.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


def byte_letters() -> dict[int, str]:
    """Byte -> the printable character that stands for it in a byte-level vocabulary."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Pieces(dict):
    """Lower-case piece -> its ids, packed. A cache: emptied when it holds too many."""

    def __init__(self, model, limit: int):
        self.model, self.limit, self.letters = model, limit, byte_letters()

    def __missing__(self, piece: str) -> bytes:
        ids = packed([t.id for t in self.model.tokenize(piece.encode("utf-8").decode("latin-1").translate(self.letters))])
        if len(self) >= self.limit:
            self.clear()
        if len(piece) <= 32:
            self[piece] = ids
        return ids


class Ids(dict):
    """Chunk without white space -> its ids, packed. A cache: emptied when it holds too many."""

    def __init__(self, path: str | None = None, limit: int = 300_000):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(NAME)
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.limit, self.pieces = limit, Pieces(self.whole.model, limit)

    def __missing__(self, chunk: str) -> bytes:
        pieces = self.pieces
        if chunk.isascii() and chunk[:-1].isalpha() and chunk.isprintable():  # a word, often with a mark after it
            ids = pieces[chunk.lower()] if chunk[-1].isalpha() else pieces[chunk[:-1].lower()] + pieces[chunk[-1]]
        elif _PLAIN.fullmatch(chunk) and "<|" not in chunk:
            ids = b"".join(map(pieces.__getitem__, _PIECE.findall(chunk.lower())))
        else:
            ids = packed(self.whole.encode(chunk, add_special_tokens=False).ids)
        if len(self) >= self.limit:
            self.clear()
        if len(chunk) <= 32:
            self[chunk] = ids
        return ids

    def of(self, text: str | None) -> bytes:
        """Packed ids of a whole text; none for null."""
        if not text:
            return b""
        if "<|" not in text:  # special tokens are told by their case
            try:
                text.encode("latin-1")  # in this range lower-casing is the same everywhere
                text = text.lower()
            except UnicodeEncodeError:
                pass
        # only these two are cut at; any other white space stays in its chunk, which the tokenizer then sees
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def ids_of(path: str | None = None, limit: int = 300_000) -> Ids:
    """One per Python worker, until another operator keeps something there. limit: entries of each of its two caches, about 170 bytes an entry."""
    return kept(("ids", path, limit), lambda: Ids(path, limit))
