"""Which characters look the same: tables made from Unicode's own data and one short fixed list.

``character_map`` sends every character to the one that stands for its look;
characters that are not in it stand for themselves, None means without width.
"""

from __future__ import annotations

import re
import sys
import unicodedata as U
from functools import lru_cache

# Letters of the Latin, Greek and Cyrillic scripts that are drawn alike, as "letters = representative".
LOOKALIKES = """
А Α = A
В Β = B
С Ϲ = C
Е Ε = E
Н Η = H
І Ι Ӏ = I
Ј Ϳ = J
К Κ = K
М Μ = M
Ν = N
О Ο = O
Р Ρ = P
Ԛ = Q
Ѕ = S
Т Τ = T
Ԝ = W
Х Χ = X
Ү Υ = Y
Ζ = Z
а α ɑ = a
с ϲ = c
ԁ = d
е = e
ɡ = g
һ = h
і ι = i
ј ϳ = j
ӏ = l
о ο = o
р ρ = p
ԛ = q
ѕ = s
υ = u
ν = v
ԝ = w
х = x
у γ = y
κ к = ĸ
Γ = Г
Π = П
Φ = Ф
"""

# Format characters that are drawn.
VISIBLE_FORMATS = "0600-0605 06DD 070F 0890-0891 08E2 110BD 110CD 13430-1343F"

# Characters without width whose category is not "format".
HIDDEN_OTHERS = "034F 115F-1160 17B4-17B5 180B-180F 3164 FE00-FE0F E0100-E01EF"


def _ranges(text: str) -> set[int]:
    out: set[int] = set()
    for part in text.split():
        low, _, high = part.partition("-")
        out.update(range(int(low, 16), int(high or low, 16) + 1))
    return out


@lru_cache(1)
def letters() -> dict[str, str]:
    """The look-alike letters, each with its representative."""
    out = {}
    for line in LOOKALIKES.split("\n"):
        left, _, right = line.partition(" = ")
        out.update(dict.fromkeys(left.split(), right))
    return out


def _joined(char: str, tag: str, parts: str) -> bool:
    """Whether a compatibility character is a joined form: letters only, in two or more."""
    return tag == "<compat>" and len(parts) > 1 and all(U.category(c)[0] == "L" for c in (char, *parts))


@lru_cache(1)
def character_map() -> dict[str, str | None]:
    """Character to what stands for its look. Values may have several characters (joined forms)."""
    alike, hidden = letters(), _ranges(HIDDEN_OTHERS)
    drawn, out = _ranges(VISIBLE_FORMATS), {}
    for code in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= code < 0xE000:
            continue
        char = chr(code)
        category = U.category(char)
        if code in hidden or (category == "Cf" and code not in drawn):
            out[char] = None
        elif category == "Zs":
            out[char] = " "
        elif char in alike:
            out[char] = alike[char]
        elif decomposition := U.decomposition(char):
            tag = decomposition.split()[0]
            if tag[0] == "<":
                parts = "".join(chr(int(x, 16)) for x in decomposition.split()[1:])
                if code in (0xFF9E, 0xFF9F):  # half-width voicing marks join the kana before them
                    out[char] = chr(0x3099 + code - 0xFF9E)
                elif tag in ("<wide>", "<narrow>") or (tag in ("<initial>", "<medial>", "<final>", "<isolated>") and len(parts) == 1):
                    out[char] = " " if parts == " " else alike.get(parts, parts)
                elif _joined(char, tag, parts):
                    out[char] = "".join(alike.get(c, c) for c in parts)
            else:
                # a precomposed letter whose base has a look-alike: the same letter on the other base
                full = U.normalize("NFD", char)
                moved = U.normalize("NFC", alike.get(full[0], full[0]) + full[1:])
                if moved != U.normalize("NFC", char):
                    out[char] = moved
    return out


@lru_cache(1)
def base_map() -> dict[str, str | None]:
    """Like ``character_map``, but without accents: a precomposed character goes to its base."""
    looks, out = character_map(), {}
    for code in range(0x80, sys.maxunicode + 1):
        if 0xAC00 <= code < 0xE000:  # Hangul syllables, which skeletons leave out, and surrogates
            continue
        char = chr(code)
        seen = looks.get(char, char)
        if seen is None or len(seen) > 1 and len(U.normalize("NFC", seen)) > 1 and U.combining(seen[1]) == 0:
            continue  # dropped, or a joined form: handled apart
        base = U.normalize("NFD", seen)[0]
        base = letters().get(base, base)
        if base != char:
            out[char] = base
    return out


class _Table(dict):
    """A table for str.translate that remembers the characters it leaves alone, which is faster than a miss."""

    def __missing__(self, code: int) -> int:
        self[code] = code
        return code


@lru_cache(1)
def _translation() -> _Table:
    return _Table({ord(k): v for k, v in character_map().items()})


def look(text: str) -> str:
    """One form of all texts that look like ``text``: mapped characters, accents composed."""
    if text.isascii():
        return text
    return U.normalize("NFC", text.translate(_translation()))


@lru_cache(1)
def _caseless() -> dict[int, str]:
    """Lower-case letters joined when some case of them looks alike (such as в and b, by В and B).

    Two letters of one alphabet are never joined, though a foreign letter whose cases look
    like either would link them (N Ν ν v): words that differ in them differ visibly.
    """
    leader: dict[str, str] = {}
    alphabets = [set(map(chr, range(ord(a), ord(z) + 1))) for a, z in ("az", "αω", "ая")]

    def find(c: str) -> str:
        while leader.get(c, c) != c:
            c = leader[c]
        return c

    for a, b in sorted(letters().items(), key=lambda p: p[0] != p[0].lower()):  # what lower case shows goes first
        a, b = sorted((find(a.lower()), find(b.lower())), key=lambda c: (not c.isascii(), c))
        joined = {c for c in [*leader, a, b] if find(c) in (a, b)}
        if a != b and all(len(joined & letters_of) < 2 for letters_of in alphabets):
            leader[b] = a
    return {ord(c): find(c) for c in leader if find(c) != c}


@lru_cache(1)
def word_table() -> _Table:
    """Look, lower case and ``_caseless`` in one step."""
    out, seen = _Table(), character_map()
    for code in range(sys.maxunicode + 1):
        char = chr(code)
        if 0xD800 <= code < 0xE000:
            continue
        looks = seen.get(char, char)
        last = None if looks is None else "".join(c.lower().translate(_caseless()) for c in looks).replace("ς", "σ")
        if last != char:
            out[code] = last
    return out


_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Runs of letters and digits, without regard to case and to differences that are not seen."""
    seen = text.translate(word_table())
    return _WORD.findall(seen if seen.isascii() else U.normalize("NFC", seen))
