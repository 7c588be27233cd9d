"""Token ids of whole texts, with a bounded cache of words in each Python worker.

Both vocabularies split a text before any merge, and never across the places where texts are cut here, so ids of a
text are the ids of its parts in turn; a text for which that isn't certain goes to the tokenizer whole.
"""

from __future__ import annotations

import struct
from collections.abc import Callable

CACHE_WORDS = 600_000
LONG = 64  # bytes; longer parts are not kept
_loaded: dict[tuple[str, str], Callable[[str], bytes]] = {}


def vocabulary(name: str) -> str:
    """The path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def byte_letters() -> dict[int, str]:
    """The character by which a byte-level vocabulary writes each byte: itself if it is printable, else the next free one from 256."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class _Cache(dict):
    """part -> its ids as little-endian unsigned 32-bit integers. When it is full, what it holds becomes the older half,
    from which parts that are asked for again come back."""

    def __init__(self, encode: Callable[[str, str], list[int]], lead: str = ""):
        super().__init__()
        self.encode, self.lead, self.older = encode, lead, {}

    def __missing__(self, part: bytes) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.older = dict(self)
            self.clear()
        found = self.older.get(part)
        if found is None:
            # a full stop or comma after a letter is split off before any merge
            if part[-1:] in (b".", b",") and part[-2:-1].isalpha():
                found = self[part[:-1]] + self.mark(part[-1:])
            else:
                found = packed(self.encode(self.lead, part.decode()))
        if len(part) <= LONG:
            self[part] = found
        return found

    def mark(self, sign: bytes) -> bytes:
        key = b" " + sign  # no part begins with a space
        if key not in self:
            self[key] = packed(self.encode("", sign.decode()))
        return self[key]


def encoder(path: str, kind: str) -> Callable[[str], bytes]:
    """A function from text to its ids as little-endian unsigned 32-bit integers, as the tokenizer gives them with
    add_special_tokens=False; a text that may hold the string of an added token goes to it whole. kind: "word" for a vocabulary that drops white space before its merges,
    "byte" for one of which each word takes the single space before it along."""
    if (path, kind) in _loaded:
        return _loaded[path, kind]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    added = [t.content.lower().encode() for t in tokenizer.get_added_tokens_decoder().values()]

    def whole(text: str) -> list[int]:
        return tokenizer.encode(text, add_special_tokens=False).ids

    model, letters = tokenizer.model, byte_letters()

    def part_ids(lead: str, part: str) -> list[int]:
        """A part of letters only is one piece before the merges, which the model then makes by itself."""
        plain = part
        if kind == "word":  # letters below U+0250 are composed
            plain = part.lower() if max(part, default="") < "\u0250" else ""
        if plain.isalpha():
            return [t.id for t in model.tokenize((lead + plain).encode().decode("latin-1").translate(letters))]
        return whole(lead + part)

    if kind == "word":
        words = _Cache(part_ids)

        def encode(text: str) -> bytes:
            raw = text.encode().lower()  # ASCII letters; the tokenizer lower-cases all
            if any(a in raw for a in added):
                return packed(whole(text))
            return b"".join(map(words.__getitem__, raw.split()))

    else:
        first, spaced = _Cache(part_ids), _Cache(part_ids, " ")

        def encode(text: str) -> bytes:
            raw = text.encode()
            parts = raw.split(b" ")
            # a run of spaces, or one at an end: white space may join across the cut
            if b"" in parts or any(a in raw for a in added):
                return packed(whole(text))
            return first[parts[0]] + b"".join(map(spaced.__getitem__, parts[1:]))

    _loaded[path, kind] = encode
    return encode
