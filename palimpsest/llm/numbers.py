"""Numbers that may belong to a person: windows over runs of digit groups, and what their form says.

Nothing here is a list of whole shapes: a window is described by its groups, separators,
letters and check digits, so that formats no example has can still be judged.
"""

import re

# A piece is digits with inner marks, a code of capitals and digits, or one or two capitals before or after digits.
_PIECE = r"(?:[+(]{0,2}\d[\d().\-/]*(?:(?<=[\d-])[A-Z](?![A-Za-z\d]))?|(?=[A-Z]*\d)(?=[A-Z\d-]*[A-Z])[A-Z\d]{3,20}(?:-[A-Z\d]+)?|[A-Z]{1,2}(?= ?\d)|(?<=\d )[A-Z]{1,2}\b)"
RUN = re.compile(rf"(?<![\w.@#/-]){_PIECE}(?: {{1,2}}{_PIECE})*(?: ?(?:ext\.?|x) ?\d{{1,6}})?(?![\w@])")
CODE = re.compile(r"(?<![\w.@#/-])[A-Z]{2,6}\d{2}[A-Z]?\d{2}[A-Z\d]{3,12}(?![\w@])")
_BLANK = re.compile(r" +")
DIGITS = (6, 20)  # digits of a window: no number of a person has more
EXTENSION = re.compile(r" ?(?:ext\.?|x) ?\d{1,6}$")


def _encloses(s: str) -> bool:
    """Whether the parenthesis at the start closes at the very end."""
    depth = 0
    for i, c in enumerate(s):
        depth += (c == "(") - (c == ")")
        if not depth:
            return i == len(s) - 1
    return False


def _inner(s: str, a: int, b: int) -> tuple[int, int]:
    """A window without loose marks at its end, unmatched parentheses, or a pair that encloses it all."""
    while b > a:
        c = s[a:b]
        if c[-1] in ".-/(" or (c[-1] == ")" and c.count(")") > c.count("(")):
            b -= 1
        elif c[0] == "(" and (c.count("(") > c.count(")") or _encloses(c)):
            a += 1
        else:
            break
    return a, b


def windows(flat: str):
    """(start, end) of every whole run and of every stretch of its pieces with few enough digits; linear in the text."""
    for m in RUN.finditer(flat):
        start, s = m.start(), m.group()
        cut = EXTENSION.search(s)
        body = s[: cut.start()] if cut else s
        pieces, at = [], 0
        for gap in _BLANK.finditer(body):
            pieces.append((at, gap.start()))
            at = gap.end()
        pieces.append((at, len(body)))
        digits = [sum(c.isdigit() for c in body[a:b]) for a, b in pieces]
        for i in range(len(pieces)):
            total = 0
            for j in range(i, len(pieces)):
                total += digits[j]
                if total > DIGITS[1]:
                    break
                if total >= DIGITS[0] or (total >= 5 and any(c.isalpha() for c in body[pieces[i][0] : pieces[j][1]])):
                    a, b = pieces[i][0], pieces[j][1]
                    a, b = _inner(body, a, b)
                    last = j == len(pieces) - 1
                    yield start + a, start + (len(s) if last and cut else b), i, len(pieces) - 1 - j
    for m in CODE.finditer(flat):
        yield m.start(), m.end(), 0, 0


def luhn(d: list[int]) -> bool:
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d))) % 10 == 0


def weighted(d: list[int], weights: list[int], modulus: int) -> int:
    return sum(a * w for a, w in zip(d, weights)) % modulus


def checks(s: str) -> tuple[bool, bool, bool]:
    """Whether the digits close by Luhn's rule, by a rule modulo 11 or 10 of descending weights, or a letter closes them."""
    d = [int(c) for c in s if c.isdigit()]
    n = len(d)
    if n < 7:
        return False, False, False
    rest = weighted(d[:-1], range(n, 1, -1), 11)
    eleven = (11 - rest) % 11 % 10 == d[-1] or rest % 10 == d[-1]
    letters = [c for c in s if c.isalpha()]
    closing = bool(letters) and s[-1].isalpha() and "TRWAGMYFPDXBNJZSQVHLCKE"[int("".join(map(str, d[:8]))) % 23] == s[-1].upper()
    return luhn(d), eleven, closing


def form(s: str) -> list[float]:
    """Features of a window: its groups, separators, letters and check digits."""
    bare = EXTENSION.sub("", s)
    groups = re.findall(r"\d+", bare)
    n = [len(g) for g in groups]
    seps = {c for c in bare if not c.isalnum() and c not in "+()"}
    letters = re.findall(r"[A-Za-z]+", bare)
    joints = re.sub(r"[A-Za-z\d+()]+", "", bare)
    total = sum(n)
    two = lambda a, b: 0 <= a <= b
    date = total == 8 and len(n) == 3 and max(n) == 4
    birth = bool(groups) and n[0] >= 6 and two(1, int(groups[0][2:4])) and int(groups[0][2:4]) <= 12 and int(groups[0][4:6]) <= 31
    return [
        total, len(n), *(n + [0] * 5)[:5], n[-1] if n else 0, max(n, default=0), len(set(n)),
        bare.startswith("+"), bare.startswith("00"), bare.startswith("0"), "(" in bare, "-" in seps, "." in seps, " " in seps, "/" in seps, len(seps), joints[-1:] == "-", joints[:1] == ".",
        len(letters), sum(map(len, letters)), bool(letters) and bare[:1].isalpha(), bool(letters) and bare[-1:].isalpha(), len(letters[0]) if letters and bare[:1].isalpha() else 0,
        date, birth, bare != s, *checks(bare),
        int(groups[0][:3]) if groups else 0,
    ]
