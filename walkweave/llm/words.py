"""Words of texts as bytes: A-Z lowered, cut at every other ASCII character than digits and letters."""

from __future__ import annotations

#: Byte table: upper-case letters to lower case, digits, letters and bytes from 0x80 as they are, the rest to a space.
TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the lowered text."""
    return text.translate(TABLE).split()
