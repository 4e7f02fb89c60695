"""An English normal form for scoring: lower case, without bracketed parts and
fillers, contractions spelled out, spelled numbers as digits, money, per cent
and ordinals as signs and endings, and British spellings by a given table.

Numbers are read in two steps.  First each word gets a kind and a value.  Then
the kinds, a letter each, are matched as a whole by one pattern: what a phrase
of numbers may look like is the pattern, and what it amounts to is arithmetic
over the matched words.
"""

from __future__ import annotations

import re
import unicodedata
from decimal import Decimal

FILLERS = {"hmm", "mm", "mhm", "mmm", "uh", "um"}
CONTRACTIONS = [
    (r"\bwon't\b", "will not"), (r"\bcan't\b", "can not"), (r"\blet's\b", "let us"), (r"n't\b", " not"), (r"'re\b", " are"),
    (r"'ll\b", " will"), (r"'ve\b", " have"), (r"'m\b", " am"), (r"\b(it|he|she|that|there|what|who)'s\b", r"\1 is"), (r"'d\b", " would"),
]
_ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
SCALES = {"thousand": 10**3, "million": 10**6, "billion": 10**9, "trillion": 10**12}
_IRREGULAR = {"first": 1, "second": 2, "third": 3, "fifth": 5, "eighth": 8, "ninth": 9, "twelfth": 12}
MONEY = {"dollar": "$", "dollars": "$", "pound": "£", "pounds": "£", "euro": "€", "euros": "€"}
SMALL_MONEY = {"cent": "¢", "cents": "¢", "penny": "p", "pence": "p"}

#: kind of a word: z zero, d 1-9, t 10-19, y 20-90, h hundred, s a scale, n digits; upper case: its ordinal or plural.
_WORDS: dict[str, tuple[str, int]] = {w: ("z" if v == 0 else "d" if v < 10 else "t", v) for v, w in enumerate(_ONES)}
_WORDS |= {w: ("y", 10 * v) for v, w in enumerate(_TENS, 2)} | {"hundred": ("h", 100)} | {w: ("s", v) for w, v in SCALES.items()}
_ENDED = {w: ("d" if v < 10 else "t", v, "ord") for w, v in _IRREGULAR.items()}
for _w, (_k, _v) in _WORDS.items():
    if _w not in ("one", "two", "three", "five", "eight", "nine", "twelve", "zero"):
        _ENDED[(_w[:-1] + "ieth") if _w.endswith("y") else _w + "th"] = (_k, _v, "ord")
    if _k in "tyhs":
        _ENDED[(_w[:-1] + "ies") if _w.endswith("y") else _w + "s"] = (_k, _v, "s")
_MARKS = {"point": "p", "and": "a", "minus": "m", "negative": "m", "plus": "m", "percent": "%", "oh": "o", "o": "o", "half": "x", "double": "w", "triple": "w"}
_MARKS |= dict.fromkeys(MONEY, "c") | dict.fromkeys(SMALL_MONEY, "e")

# A number below a hundred, one below a thousand, and scales over them.
_LOW = "(?:yd|[dty])"
_WHOLE = f"(?:(?:n|{_LOW}h(?:a?{_LOW})?|{_LOW})s(?:a?(?:n|{_LOW}h(?:a?{_LOW})?|{_LOW})s)*(?:a?(?:n(?!s)|{_LOW}h(?:a?{_LOW})?|{_LOW}))?|{_LOW}h(?:a?{_LOW})?|[hs](?:a?{_LOW})?)"
# Read digit by digit, up to what a hundred or a scale counts.
_SPELT = f"(?:(?:w[zdo]|{_LOW}|z|(?<=[dtyz])o(?=[dz]))(?![hs]))"
_NUMBER = re.compile(f"(?P<sign>m)?(?P<whole>{_WHOLE}|{_SPELT}+|n)(?P<point>p(?:[zdo]+|n))?(?P<half>axx)?(?P<end>%|c(?:a?(?P<small>{_LOW}|n)e)?|e)?")
_SIGNED = re.compile(f"(?P<whole>Ms*)(?:a?(?P<small>{_LOW}|n)e)?")
_POINT = re.compile("p(?P<point>[zdo]+)(?P<end>%)?")
_ORDINALS = {1: "st", 2: "nd", 3: "rd"}


def _kinds(words: list[str]) -> tuple[str, list]:
    """A letter and a value for each word; a dot for any other word.  The last
    word of an ordinal or a plural has its number's letter and an ending.  A
    ``second`` is an ordinal after a number's word or ``the``, else a word."""
    kinds, values = [], []
    for k, w in enumerate(words):
        ended = re.fullmatch(r"(\d+)(st|nd|rd|th|s)", w)
        money = re.fullmatch(r"([$£€])(\d+(?:\.\d+)?)", w)
        if w in _WORDS:
            kind, value, end = *_WORDS[w], ""
        elif w in _ENDED and (w != "second" or k and (words[k - 1] in _WORDS or words[k - 1] == "the")) and w != "seconds":
            kind, value, end = _ENDED[w]
        elif re.fullmatch(r"\d+(\.\d+)?", w):
            kind, value, end = "n", Decimal(w), ""
        elif money:
            kind, value, end = "M", Decimal(money[2]), money[1]
        elif ended:
            kind, value, end = "n", Decimal(ended[1]), "ord" if ended[2] != "s" else "s"
        elif w == "a" and k + 1 < len(words) and words[k + 1] == "half":
            kind, value, end = "x", None, ""
        else:
            kind, value, end = _MARKS.get(w, "."), None, ""
        kinds.append(kind)
        values.append((value, end, w))
    return "".join(kinds), values


def _amount(kinds: str, values: list) -> Decimal:
    """What a cardinal amounts to: scales multiply what stands before them."""
    total, part = Decimal(0), None
    for k, (v, _, _) in zip(kinds, values, strict=True):
        if k == "h":
            part = (1 if part is None else part) * 100
        elif k == "s":
            total, part = total + (1 if part is None else part) * v, None
        elif k != "a":
            part = (part or 0) + v
    return total + (part or 0)


def _spelt(kinds: str, values: list) -> str:
    """Digits in a row, of digit by digit readings and of years."""
    out, at = "", 0
    while at < len(kinds):
        k, v = kinds[at], values[at][0]
        if k == "w":
            digit = "0" if kinds[at + 1] == "o" else str(values[at + 1][0])
            out, at = out + digit * (2 if values[at][2] == "double" else 3), at + 2
        elif k == "y" and kinds[at + 1 : at + 2] == "d":
            out, at = out + str(v + values[at + 1][0]), at + 2
        else:
            out, at = out + ("0" if k == "o" else str(v)), at + 1
    return out


def _ending(digits: str, end: str) -> str:
    if end != "ord":
        return digits + end
    n = int(digits)
    return digits + ("th" if n % 100 in (11, 12, 13) else _ORDINALS.get(n % 10, "th"))


def _phrase(m: re.Match, values: list) -> list[str]:
    """The words that a matched phrase becomes."""
    a, b = m.span("whole")
    kinds, own = m["whole"], values[a:b]
    for k in range(len(own) - 1):  # an ending closes a number, so one within splits the phrase
        if own[k][1] in ("ord", "s"):
            raise _Split(a + k + 1)
    end, sign = own[-1][1] if own[-1][1] in ("ord", "s") else "", ""
    money = ""
    if len(kinds) > 1 and not re.search("[hsn]", kinds) or kinds == "z":
        digits = _spelt(kinds, own)
    else:
        digits = format(_amount(kinds, own), "f")
        digits = digits.rstrip("0").rstrip(".") if "." in digits and kinds != "n" else digits
    if m["sign"]:
        sign = "+" if values[m.start("sign")][2] == "plus" else "-"
    if m["point"] and not end:
        x, y = m.span("point")
        digits += "." + ("".join("0" if k == "o" else str(v) for k, (v, _, _) in zip(m["point"][1:], values[x + 1 : y], strict=True)))
    if m["half"] and not end:
        digits = format(Decimal(digits) + Decimal("0.5"), "f")
    if end:
        rest = [w for _, _, w in values[b : m.end()]]
        return [sign + _ending(digits, end), *rest]
    if m["end"] == "%":
        return [sign + digits + "%"]
    if m["end"] == "e":
        return [sign + SMALL_MONEY[values[m.end() - 1][2]] + digits]
    if m["end"]:
        money = MONEY[values[m.start("end")][2]]
        if m["small"]:
            x, y = m.span("small")
            digits = format(Decimal(digits) + _amount(m["small"], values[x:y]) / 100, ".2f")
    return [money + sign + digits]


class _Split(Exception):
    def __init__(self, at: int):
        self.at = at


def _numbers(words: list[str]) -> list[str]:
    """Phrases of numbers as digits, what they count in before or behind them."""
    kinds, values = _kinds(words)
    out, at, stop = [], 0, len(kinds)
    while at < len(kinds):
        m = _NUMBER.match(kinds, at, stop) or _POINT.match(kinds, at, stop) or _SIGNED.match(kinds, at, stop)
        if m is not None and m.re is _SIGNED:
            a, b = m.span("whole")
            digits = format(_amount(m["whole"], values[a:b]), "f")
            if m["small"]:
                a, b = m.span("small")
                digits = format(Decimal(digits) + _amount(m["small"], values[a:b]) / 100, ".2f")
            out.append(values[at][1] + digits)
            at = m.end()
        elif m is None:
            out.append(words[at])
            at += 1
        elif m.re is _POINT:
            x, y = m.span("point")
            out.append("0." + "".join("0" if k == "o" else str(v) for k, (v, _, _) in zip(m["point"], values[x:y], strict=True)) + (m["end"] or ""))
            at = m.end()
        else:
            try:
                out += _phrase(m, values)
                at = m.end()
            except _Split as s:
                stop = s.at
                continue
        stop = len(kinds)
    return out


def normalize_english(text: str, spelling: dict[str, str] | None = None) -> str:
    """``spelling``: British to American words; without it spellings stay."""
    text = re.sub(r"[<\[][^>\]]*[>\]]|\([^)]*\)", "", text.lower())
    text = re.sub(r"\s+'", "'", text)
    for pattern, to in CONTRACTIONS:
        text = re.sub(pattern, to, text)
    text = re.sub(r"(\d),(?=\d)", r"\1", text).replace("per cent", "percent")
    text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    text = re.sub(r"(?<=[a-z])-(?=[a-z])", " ", text)
    text = re.sub(r"[^\w\s%$£€¢.']|\.(?!\d)|_", " ", text)
    text = re.sub(r"(\d)\s*%", r"\1 percent", re.sub(r"([$£€¢])(?!\d)|%", " ", re.sub(r"(\d)\s*%", r"\1 percent ", text)))
    words = _numbers([w for w in text.replace("'", "").split() if w not in FILLERS])
    return " ".join((spelling or {}).get(w, w) for w in words)
