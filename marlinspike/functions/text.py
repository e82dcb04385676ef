"""Text normalisation, language guess, edit distance and name parts."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

#: Full-width marks and their ASCII counterparts, position by position.
FULL_WIDTH = "，。！？：；（）【】、"
ASCII_MARKS = ",.!?:;()[],"
#: Marks that punctuation removal also deletes.
CHINESE_MARKS = "，。！？：；（）【】、“”‘’《》…—"
CURLY_QUOTES = ("“”‘’", "\"\"''")


def remove_whitespace(text: Column) -> Column:
    """Delete all Unicode white space."""
    return F.regexp_replace(text, r"(?U)\s+", "")


def normalize_whitespace(text: Column) -> Column:
    """Each run of white space becomes one space; ends are trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def simple_normalize(text: Column) -> Column:
    """As normalize_whitespace; null and empty give the empty string."""
    return F.coalesce(normalize_whitespace(text), F.lit(""))


def normalize_punctuation(text: Column, curly_quotes: bool = False) -> Column:
    """Full-width marks become ASCII; curly quotes too if asked for."""
    a, b = (CURLY_QUOTES if curly_quotes else ("", ""))
    return F.translate(text, FULL_WIDTH + a, ASCII_MARKS + b)


def remove_punctuation(text: Column) -> Column:
    """Delete everything but letters, digits, underscores and white space."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)[^\w\s]", ""), f"[{CHINESE_MARKS}]", "")


def _nfc(text: pd.Series) -> pd.Series:
    return text.str.normalize("NFC")


def normalize_unicode(text: Column) -> Column:
    """NFC.  An Arrow batch UDF: Spark has no built-in for it."""
    return F.pandas_udf(_nfc, T.StringType())(text)


def to_lowercase(text: Column) -> Column:
    return F.lower(text)


STRATEGIES: dict[str, Callable[[Column], Column]] = {
    "remove_whitespace": remove_whitespace,
    "normalize_whitespace": normalize_whitespace,
    "normalize_punctuation": normalize_punctuation,
    "remove_punctuation": remove_punctuation,
    "normalize_unicode": normalize_unicode,
    "to_lowercase": to_lowercase,
}


def normalize_text(text: Column, strategies: Iterable[str]) -> Column:
    """Apply named strategies in order; an unknown name is an error."""
    for name in strategies:
        if name not in STRATEGIES:
            raise ValueError(f"unknown normalization strategy: {name}")
        text = STRATEGIES[name](text)
    return text


def same_normalized(a: Column, b: Column, strategies: Iterable[str]) -> Column:
    strategies = list(strategies)
    return normalize_text(a, strategies) == normalize_text(b, strategies)


def edit_distance_of(a: str, b: str) -> int:
    """Edit distance in code points, a column of the table at once in the bits of whole numbers.

    The bits say where neighbours in the column differ by 1 or -1, so a column
    takes a dozen operations on numbers of as many bits as the shorter text has
    characters (Myers, in the form for the whole distance).
    """
    if len(a) > len(b):
        a, b = b, a
    low = 0
    while low < len(a) and a[low] == b[low]:
        low += 1
    high = 0
    while high < len(a) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    a, b = a[low : len(a) - high], b[low : len(b) - high]
    if not a:
        return len(b)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full, last, distance = (1 << len(a)) - 1, 1 << len(a) - 1, len(a)
    up, down = full, 0
    for c in b:
        same = where.get(c, 0)
        across = (((same & up) + up) ^ up) | same | down
        rise, fall = down | ~(across | up) & full, up & across
        distance += bool(rise & last) - bool(fall & last)
        rise = rise << 1 | 1
        up, down = (fall << 1 | ~(across | rise)) & full, rise & across & full
    return distance


def _distances(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else edit_distance_of(x, y) for x, y in zip(a, b, strict=True)], dtype="Int64")


def edit_distance(a: Column, b: Column) -> Column:
    """Edit distance of long texts.  An Arrow batch UDF: the built-in takes a step for each cell of the table, this one for a word of 30 cells."""
    return F.pandas_udf(_distances, T.LongType())(a, b)


def text_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length, in code points; two empty texts are equal."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def similarity_at_least(a: Column, b: Column, least: Column) -> Column:
    """Text similarity if it can reach ``least``, else null.

    The length difference decides first; the edit distance is then computed only
    as far as the bound allows.  One edit of slack absorbs rounding, so callers
    test the result again.
    """
    longest = F.greatest(F.length(a), F.length(b))
    bound = F.greatest(F.lit(0), F.least(longest, (F.floor((1 - least) * longest) + 1).cast("int")))
    distance = F.call_function("levenshtein", a, b, bound)
    return F.when((F.abs(F.length(a) - F.length(b)) <= bound) & (distance >= 0), F.when(longest == 0, F.lit(1.0)).otherwise(1 - distance / longest))


def detect_language(text: Column) -> Column:
    """zh if there are at least as many CJK characters as ASCII letters, else en; unknown without either."""
    cjk = F.length(F.regexp_replace(text, r"[^一-鿿]", ""))
    latin = F.length(F.regexp_replace(text, "[^A-Za-z]", ""))
    return F.when((cjk == 0) & (latin == 0), "unknown").when(cjk >= latin, "zh").otherwise("en")


def url_extension(url: Column, default: str = ".jpg") -> Column:
    """Suffix of the URL's path, without query and fragment."""
    path = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")
    return F.coalesce(F.nullif(F.regexp_extract(path, r"[^/.][^/]*?(\.[^./]+)$", 1), F.lit("")), F.lit(default))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]+$", "")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r"(?<=.)(\.[^.]+)$", 1))


def short_id(value: Column) -> Column:
    return F.substring(value, 1, 8)


def short_time(value: Column) -> Column:
    return F.replace(F.substring(value, 1, 16), F.lit("T"), F.lit(" "))


def thousands(value: Column) -> Column:
    return F.format_number(value, 0)


#: Display names, looked up case-folded.
STATUS_NAMES = {"pending": "waiting", "running": "running", "completed": "done", "failed": "failed", "cancelled": "cancelled"}
LABEL_NAMES = {"hit": "hit", "miss": "miss", "skip": "skipped"}
CONFIDENCE_NAMES = {"HIGH": "high", "MEDIUM": "medium", "LOW": "low"}


def display_name(value: Column, names: dict[str, str], fold: Callable[[Column], Column] = F.lower) -> Column:
    """Display name of a code; codes that are not listed show as they are."""
    out = F.when(F.lit(False), "")
    for code, shown in names.items():
        out = out.when(fold(value) == code, shown)
    return out.otherwise(value)


def sort_options(options: Column, separator: str = ";") -> Column:
    """Extension: option lists that differ in order only become equal."""
    return F.array_join(F.array_sort(F.transform(F.split(options, separator), lambda x: F.trim(x))), separator)


def normalize_latex(text: Column) -> Column:
    """Extension: drop spacing commands and redundant space of formulas."""
    for pattern, new in ((r"\\[,;!: ]", ""), (r"\\left|\\right", ""), (r"\\dfrac|\\tfrac", r"\\frac"), (r"(?U)\s+", "")):
        text = F.regexp_replace(text, pattern, new)
    return text
