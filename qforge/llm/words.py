"""Words of letters, digits and whatever lies beyond ASCII."""

from __future__ import annotations

#: byte -> itself, lower-cased, or a blank where it belongs to no word
WORD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORD).split()
