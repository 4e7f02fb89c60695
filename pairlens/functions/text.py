"""Text keys and normal forms as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters, digits, white space and the apostrophe stay; all else is a space.
_OTHER = "(?U)[^\\p{L}\\p{N}\\s\\x1c-\\x1f']"
_SPACE = "(?U)[\\s\\x1c-\\x1f]+"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(text) -> Column:
    """Without white space at both ends, in Unicode's sense."""
    return F.regexp_replace(_c(text), "(?U)^[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+$", "")


def normalize(text, language="en") -> Column:
    """Lower case without punctuation.  ``en`` keeps apostrophes and one space
    between words; ``ko`` drops apostrophes and all white space.  ``language``
    is a name or a column of names."""
    kept = F.regexp_replace(F.lower(_c(text)), _OTHER, " ")
    spaced = strip(F.regexp_replace(kept, _SPACE, " "))
    dense = F.regexp_replace(F.replace(kept, F.lit("'"), F.lit(" ")), _SPACE, "")
    if isinstance(language, str):
        return dense if language == "ko" else spaced
    return F.when(language == "ko", dense).otherwise(spaced)


def sentence_key(text, language="ko") -> Column:
    """The key by which two sentences count as the same."""
    return normalize(text, language)


def sentence_hash(key) -> Column:
    """SHA-256 of a key's UTF-8 bytes, in hex."""
    return F.sha2(_c(key), 256)


def raw_transcription(text) -> Column:
    """What a chat model's output says: after its role line and its text mark."""
    first = lambda c, mark: F.when(F.instr(c, mark) > 0, F.substr(c, F.instr(c, mark) + len(mark))).otherwise(c)
    return strip(first(first(strip(text), "assistant\n"), "<asr_text>"))


def block_of(set_name, row_id, rules: dict[str, str]) -> Column:
    """The block of a row: its id up to a separator that depends on the set.
    ``rules``: prefix of the set's name -> separator.  No rule is an error."""
    out = F.raise_error(F.concat(_c(set_name), F.lit(": no block rule for this set"))).cast("string")
    for prefix, separator in reversed(rules.items()):
        out = F.when(F.startswith(_c(set_name), F.lit(prefix)), F.substring_index(_c(row_id), separator, 1)).otherwise(out)
    return out


def language_of(set_name, prefixes: dict[str, str], default: str) -> Column:
    """A set's language by the prefix of its name."""
    out = F.lit(default)
    for prefix, language in prefixes.items():
        out = F.when(F.startswith(_c(set_name), F.lit(prefix)), F.lit(language)).otherwise(out)
    return out


def base_set(set_name) -> Column:
    """A set's name without what follows ``@``."""
    return F.substring_index(_c(set_name), "@", 1)


def is_protected(set_name) -> Column:
    """Whether a set is kept for final tests, by its name."""
    return F.contains(F.lower(_c(set_name)), F.lit("-test"))


def has_digit(text) -> Column:
    return F.rlike(_c(text), F.lit("[0-9]"))


def has_tag(text, tag: str) -> Column:
    """Whether a model's output has a tag in it, such as for no speech."""
    return F.contains(_c(text), F.lit(tag))


def points_label(low, high) -> Column:
    """An interval of differences in percentage points as text."""
    return F.format_string("[%+.2f, %+.2f]", *[_c(x).cast("double") * 100 for x in (low, high)])


def percent_label(value, decimals: int = 2, signed: bool = False, unit: str = "%") -> Column:
    """A rate in percent as text; NaN and null are ``nan``."""
    shown = F.format_string(f"%{'+' if signed else ''}.{decimals}f{unit.replace('%', '%%')}", _c(value) * 100)
    return F.when(_c(value).isNull() | F.isnan(_c(value)), F.lit("nan" + unit)).otherwise(shown)
