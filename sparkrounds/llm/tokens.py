"""Token ids of whole texts, inside tasks.

``word_ids`` gives exactly what the tokenizer gives, but encodes every distinct
word once.  Texts of plain Latin-1 letters, digits, ASCII signs and blanks are cut
into words, which go straight to the tokenizer's BPE model.  Other texts are taken
apart at blanks: their plain chunks go the same way, all others, and those that
could hold a special token, go through the whole tokenizer.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable

# Bytes that the two tables of known words and chunks may hold in a worker, with what Python adds to each entry.
PIECE_BYTES = 96 << 20
CHUNK_BYTES = 16 << 20
ENTRY_BYTES = 200
LATIN = "a-zà-öø-ÿ"


def byte_alphabet() -> dict[str, str]:
    """The byte-level alphabet for the letters above ASCII in ``LATIN``."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    moved = [b for b in range(256) if b not in plain]
    sign = {b: chr(b) if b in plain else chr(256 + moved.index(b)) for b in range(256)}
    return {chr(c): "".join(sign[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}


def word_ids(path: str) -> Callable[[str], bytes]:
    """A function from a text to its ids as unsigned 32-bit numbers, native order.

    For tokenizers that drop white space, lower-case, split words by the usual
    contractions, letters, digits and signs, and mark word ends.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    model, above = tokenizer.model, str.maketrans(byte_alphabet())
    plain = rf"\x21-\x7e{LATIN}À-ÖØ-Þ"
    simple, simple_text = (re.compile(f"[{more}{plain}]+").fullmatch for more in ("", " \n"))
    pieces = re.compile(
        rf"'s|'t|'re|'ve|'m|'ll|'d|[{LATIN}]+|[0-9]|[^\s{LATIN}0-9]+"
    ).findall

    class Pieces(dict):
        held = 0

        def __missing__(self, piece: str) -> bytes:
            ids = array("I", [t.id for t in model.tokenize(piece.translate(above))]).tobytes()
            if len(piece) < 100:
                if self.held >= PIECE_BYTES:
                    self.clear()
                    self.held = 0
                self.held += len(piece) + len(ids) + ENTRY_BYTES
                self[piece] = ids
            return ids

    class Chunks(dict):
        held = 0

        def __missing__(self, chunk: str) -> bytes:
            if len(chunk) < 100 and simple(chunk) and "<|" not in chunk:
                ids = b"".join(map(part, pieces(chunk.lower())))
            else:
                found = tokenizer.encode(chunk, add_special_tokens=False).ids
                ids = array("I", found).tobytes()
            if self.held < CHUNK_BYTES and len(chunk) < 100:
                self.held += len(chunk) + len(ids) + ENTRY_BYTES
                self[chunk] = ids
            return ids

    part, chunk = Pieces().__getitem__, Chunks({"": b""}).__getitem__

    def encode(text: str) -> bytes:
        if "<|" not in text and simple_text(text):
            return b"".join(map(part, pieces(text.lower())))
        return b"".join(map(chunk, text.replace("\n", " ").split(" ")))

    return encode
