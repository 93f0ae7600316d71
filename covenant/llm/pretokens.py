"""Pre-tokens of a text: the matches of a pattern, as the tokenizer libraries find them."""

from __future__ import annotations

import re

import regex

#: Letters and numbers that the ``regex`` module knows and the tokenizer library,
#: with an older Unicode table, does not (first and last code point).
LATER_LETTERS = [
    (0x558, 0x558), (0x58b, 0x58c), (0x88f, 0x88f), (0xc5c, 0xc5c), (0xcdc, 0xcdc), (0x208f, 0x208f),
    (0x209d, 0x209f), (0xa7ce, 0xa7cf), (0xa7d2, 0xa7d2), (0xa7d4, 0xa7d4), (0xa7dd, 0xa7dd), (0xa7e2, 0xa7e2),
    (0xa7f1, 0xa7f1), (0xab6c, 0xab6d), (0x107bb, 0x107bf), (0x10940, 0x10959), (0x10ec5, 0x10ec7),
    (0x10ed9, 0x10eee), (0x11b0a, 0x11b0a), (0x11db0, 0x11ddb), (0x11df1, 0x11df1), (0x16ea0, 0x16eb8),
    (0x16ebb, 0x16ed3), (0x16ff2, 0x16ff3), (0x187f8, 0x187ff), (0x18cd6, 0x18cda), (0x18d09, 0x18d20),
    (0x18d80, 0x18df2), (0x18e00, 0x19191), (0x191a0, 0x191d2), (0x1b123, 0x1b128), (0x1b168, 0x1b168),
    (0x1d6a6, 0x1d6a6), (0x1df1f, 0x1df24), (0x1df2b, 0x1df81), (0x1df90, 0x1df96), (0x1dfcd, 0x1dfff),
    (0x1e6c0, 0x1e6de), (0x1e6e0, 0x1e6e2), (0x1e6e4, 0x1e6e5), (0x1e6e7, 0x1e6ed), (0x1e6f0, 0x1e6f4),
    (0x1e6fe, 0x1e6ff), (0x2b73a, 0x2b73f), (0x2b81e, 0x2b81e), (0x2cea2, 0x2cead), (0x323b0, 0x33479),
    (0x3d000, 0x3fc3f),
]
LATER_NUMBERS = [(0x11de0, 0x11de9), (0x1246f, 0x1246f), (0x12475, 0x1247f), (0x12550, 0x12686), (0x16ff4, 0x16ff6),]
LATER = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in LATER_LETTERS + LATER_NUMBERS) + "]")
_ASCII_CLASSES = {"\\p{L}": "A-Za-z", "\\p{N}": "0-9", "\\s": "\\t-\\r "}


def ascii_pattern(pattern: str) -> re.Pattern | None:
    """The pattern for ASCII texts in the faster standard library: Unicode classes replaced by their ASCII
    members. None if the pattern uses anything else that the two read differently."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        for name, members in _ASCII_CLASSES.items():
            if pattern.startswith(name, i):
                out.append(members if inside else f"[{members}]")
                i += len(name)
                break
        else:
            c = pattern[i]
            if c == "\\" or (c == "[" and inside):
                if pattern[i:i + 2] != "\\S":
                    return None
                if inside:
                    return None
                out.append("[^\\t-\\r ]")
                i += 2
                continue
            inside = c == "[" or (inside and c != "]")
            out.append(c)
            i += 1
    return re.compile("".join(out))


def _is_latin1(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Splitter:
    """All matches of a pattern in a text, from left to right."""

    def __init__(self, pattern: str):
        self.pattern = regex.compile(pattern)
        self.ascii = ascii_pattern(pattern)

    def __call__(self, text: str) -> list[str]:
        if text.isascii() and self.ascii:
            return self.ascii.findall(text)
        if _is_latin1(text) or not LATER.search(text):
            return self.pattern.findall(text)
        plain = LATER.sub("\ue000", text)          # a character that is neither letter, number nor space
        return [text[m.start():m.end()] for m in self.pattern.finditer(plain)]
