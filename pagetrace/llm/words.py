"""Words of letters and digits in UTF-8 bytes: what separates is ASCII, so bytes can be looked at one by one."""

from __future__ import annotations

from collections.abc import Iterator

#: Every ASCII byte but digits and letters becomes a space, A-Z become a-z, bytes of longer characters stay.
TO_WORDS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).translate(bytes(range(256)).lower())
#: Bytes of a text that are split into words at once.
PIECE = 2**20


def word_lists(text: str | None, piece: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text in order, in lists of bounded size; none for null."""
    data = (text or "").encode().translate(TO_WORDS)
    at = 0
    while at < len(data):
        end = data.rfind(b" ", at, at + piece) + 1 if at + piece < len(data) else len(data)
        if end <= at:  # one word fills the piece
            end = data.find(b" ", at + piece) + 1 or len(data)
        if words := data[at:end].split():
            yield words
        at = end
