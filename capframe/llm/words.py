"""Words of letters, digits and all characters beyond ASCII, with A-Z lowered: what counting and ranking read."""

from __future__ import annotations

_KEPT = {*b"0123456789abcdefghijklmnopqrstuvwxyz", *range(0x80, 0x100)}
#: UTF-8 bytes beyond ASCII stay as they are, so characters are never torn.
_TABLE = bytes(b if b in _KEPT else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def ascii_lower_words(text: str | None) -> list[bytes]:
    """UTF-8 words of a text, in order; none of a null or empty one."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()
