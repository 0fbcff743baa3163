"""Text normalisation and keyword predicates: Column -> Column, all on the JVM."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestar.functions.values import LEGAL_NOISE

#: Words that stand for a missing value; modules differ in the set they take.
MISSING = ("", "nan", "none", "null", "nat", "-", "0")
ARABIC = "؀-ۿ"
_TASHKEEL = "[ً-ْـ]"


def _accents() -> tuple[str, str, list[tuple[str, str]]]:
    """Letters that decompose to one ASCII letter, those letters, and those that decompose to several."""
    one, several = [], []
    for c in map(chr, [*range(0xA0, 0x250), *range(0x1E00, 0x1F00), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F)]):
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if plain != c and plain.isascii() and plain.strip():
            (one if len(plain) == 1 else several).append((c, plain))
    return "".join(a for a, _ in one), "".join(b for _, b in one), [p for p in several if p[1].isalpha()]


ACCENTED, PLAIN, LIGATURES = _accents()


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def blank_to_null(c: Column, tokens: Sequence[str] = MISSING) -> Column:
    """NULL where the trimmed lower-case text is one of ``tokens``."""
    return F.when(~F.lower(F.trim(c.cast("string"))).isin(*tokens), c)


def strip_accents(c: Column) -> Column:
    """Letters without marks, ligatures and full-width forms as plain letters."""
    c = F.regexp_replace(F.translate(c, ACCENTED, PLAIN), r"\p{M}", "")
    several = c.rlike("[" + "".join(a for a, _ in LIGATURES) + "]")
    plain = c
    for a, b in LIGATURES:
        plain = F.replace(plain, F.lit(a), F.lit(b))
    return F.when(several, plain).otherwise(c)


def nfkc_clean(c: Column) -> Column:
    """Compatibility-composed text without direction marks, white space as single spaces, trimmed; NULL stays."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))

    ascii_only = c.rlike(r"^[\x00-\x7F]*$")  # nothing to compose: those stay on the JVM
    composed = F.when(ascii_only, c).otherwise(F.pandas_udf(run, "string")(F.when(~ascii_only, c)))
    return F.trim(F.regexp_replace(F.regexp_replace(composed, "[\u200e\u200f]", ""), r"[\s\u00a0]+", " "))


def normalize(c: Column) -> Column:
    """No accents, lower case, trimmed; NULL gives an empty text."""
    return F.trim(F.lower(strip_accents(text(c))))


def fold_arabic(c: Column) -> Column:
    """Without vowel signs and tatweel; alef, yeh and hamza forms united."""
    return F.translate(F.regexp_replace(c, _TASHKEEL, ""), "أإآىؤئ", "ااايوي")


def basic_clean(c: Column) -> Column:
    """Normalised Latin and folded Arabic words, digits and apostrophes, single spaces."""
    kept = F.regexp_replace(fold_arabic(normalize(c)), rf"[^a-zA-Z0-9{ARABIC}\s']", " ")
    return F.trim(F.regexp_replace(kept, r"\s+", " "))


def reverse_arabic_runs(c: Column) -> Column:
    """Each run of Arabic letters reversed in place."""
    runs = F.regexp_extract_all(c, F.lit(f"([{ARABIC}]+|[^{ARABIC}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike(f"^[{ARABIC}]"), F.reverse(r)).otherwise(r)), "")


def variants(c: Column) -> Column:
    """Clean text, the same reversed, and with Arabic runs reversed; distinct, joined by `` | ``."""
    clean = basic_clean(c)
    return F.array_join(F.array_distinct(F.array(clean, F.reverse(clean), reverse_arabic_runs(clean))), " | ")


def normalize_name(c: Column, noise: Sequence[str] = tuple(LEGAL_NOISE)) -> Column:
    """Company name for matching: plain lower-case words without legal forms, repeats kept."""
    words = F.split(F.regexp_replace(F.lower(strip_accents(text(c))), r"[^a-z0-9\s]", " "), r"\s+")
    return F.array_join(F.filter(words, lambda w: (w != "") & ~w.isin(*noise)), " ")


def normalize_phone(c: Column) -> Column:
    """The last eight digits."""
    return F.right(F.regexp_replace(text(c), r"\D", ""), F.lit(8))


def first_token(c: Column) -> Column:
    return F.split(c, " ")[0]


def any_word(c: Column, keywords: Sequence[str]) -> Column:
    """Some keyword occurs as whole words of a normalised text."""
    return c.rlike(r"(?U)\b(?:" + "|".join(map(re.escape, keywords)) + r")\b")


def any_keyword(c: Column, keywords: Sequence[str]) -> Column:
    """Single words as whole words, longer keywords as plain substrings."""
    single = [k.strip() for k in keywords if " " not in k.strip()]
    longer = [c.contains(k.strip()) for k in keywords if " " in k.strip()]
    return reduce(or_, longer, any_word(c, single) if single else F.lit(False))


def matched(c: Column, keywords: Sequence[str]) -> Column:
    """The keywords that occur as substrings, in their order."""
    return F.filter(F.array(*map(F.lit, keywords)), lambda k: F.contains(c, k))


def first_containing(c: Column, rules: Sequence[tuple[str, str]], default: Column) -> Column:
    """Value of the first rule whose pattern is in the text."""
    out = default
    for pattern, value in reversed(rules):
        out = F.when(c.contains(pattern), F.lit(value)).otherwise(out)
    return out


def is_fragment(c: Column) -> Column:
    return text(c).rlike("^[a-z]") | text(c).endswith(")")


def has_arabic(c: Column) -> Column:
    return text(c).rlike(f"[{ARABIC}]")


def joined(sep: str, *cols: Column) -> Column:
    """Non-blank parts with a separator."""
    return F.concat_ws(sep, *[blank_to_null(F.trim(c.cast("string"))) for c in cols])


def content_key(c: Column) -> Column:
    """Object key ``aa/bb/<sha256>.pdf`` of binary content."""
    h = F.sha2(c, 256)
    return F.concat_ws("/", F.substring(h, 1, 2), F.substring(h, 3, 2), F.concat(h, F.lit(".pdf")))


def is_pdf(c: Column) -> Column:
    return (F.length(c) > 0) & F.startswith(c, F.lit(b"%PDF-"))


def json_in(c: Column) -> Column:
    """The outermost braces of a reply, without code fences."""
    return F.regexp_extract(c, r"(?s)\{.*\}", 0)
