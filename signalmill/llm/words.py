"""ASCII lower-casing and words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`, over UTF-8 bytes."""

from __future__ import annotations

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Every byte of a code point above 0x7F belongs to a word; null has none."""
    return text.encode("utf-8").translate(_TABLE).split() if text else []


def normalised(text: str | None) -> bytes:
    """The words, each between single spaces."""
    return b" " + b" ".join(words(text)) + b" " if text else b" "


def spaced(text: str | None) -> bytes:
    """The text with a space for each byte outside a word."""
    return text.encode("utf-8").translate(_TABLE) if text else b""
