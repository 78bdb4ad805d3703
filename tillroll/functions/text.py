"""String, regex, JSON, array and hash expressions. All are JVM-side; no Python function per row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillroll.functions.numbers import col

# Patterns whose matches must equal the source system's.
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
PHONE = r"^\+?[\d\s\-\(\)]{10,}$"
URL = r"^https?://[^\s/$.?#].[^\s]*$"
UUID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
ID = r"^[a-zA-Z0-9_-]+$"
LOCAL_PHONE = r"^\+84[0-9]{9,10}$"
POSTAL = r"^[0-9]{6}$"
KEPT_LETTERS = r"[^\p{L}\p{N}_\s\x{00C0}-\x{017F}\x{1EA0}-\x{1EF9}]"
BLANKS = r"[\s\p{Z}]+"
# Runs of what KEPT_LETTERS removes and of blanks, none of which are letters: one pass instead of two.
NOT_LETTERS = r"[^\p{L}\p{N}_\x{00C0}-\x{017F}\x{1EA0}-\x{1EF9}]+"


def collapse(c: Column | str) -> Column:
    """Trim and fold runs of blanks (Unicode separators included)."""
    return F.trim(F.regexp_replace(col(c), BLANKS, " "))


def words(c: Column | str) -> Column:
    return F.filter(F.split(F.regexp_replace(col(c), BLANKS, " "), " "), lambda w: w != "")


def word_count(c: Column | str) -> Column:
    return F.size(words(c))


def first_word(c: Column | str) -> Column:
    return F.try_element_at(words(c), F.lit(1))


def _title(letter: Column) -> Column:
    up = F.upper(letter)  # one letter may grow: the sharp s becomes "Ss"
    return F.concat(F.substring(up, 1, 1), F.lower(F.substring(up, 2, 2)))


def title_case(c: Column | str) -> Column:
    """Capitalise after every non-letter, unlike ``initcap`` (G-12): ``o'neil`` -> ``O'Neil``."""
    runs = F.regexp_extract_all(col(c), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    fixed = F.transform(runs, lambda r: F.concat(_title(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 1 << 30))))
    return F.array_join(fixed, "")


def zero_pad(c: Column | str, width: int) -> Column:
    """P-10: left zeros up to ``width``; longer values stay whole (``lpad`` would cut them)."""
    s = col(c).cast("string")
    return F.when(F.length(s) >= width, s).otherwise(F.lpad(s, width, "0"))


def slug(c: Column | str) -> Column:
    """P-11: null -> unknown, lower case, other characters -> _, outer _ stripped."""
    s = F.regexp_replace(F.lower(F.coalesce(col(c), F.lit("unknown"))), "[^a-z0-9_]", "_")
    return F.regexp_replace(s, "^_+|_+$", "")


def name_case(c: Column | str) -> Column:
    """P-09: collapse blanks, then title case."""
    return title_case(collapse(c))


def phone_number(c: Column | str) -> Column:
    """P-08: digits with the +84 prefix."""
    digits = F.regexp_replace(col(c), "[^0-9]", "")
    return (F.when(digits.startswith("84"), F.concat(F.lit("+"), digits))
            .when(digits.startswith("0"), F.concat(F.lit("+84"), F.substring(digits, 2, 1 << 30)))
            .otherwise(F.concat(F.lit("+84"), digits)))


def matches(c: Column | str, pattern: str) -> Column:
    """False for null."""
    return F.coalesce(col(c).rlike(pattern), F.lit(False))


def text_features(c: str, price: str | None = None) -> dict[str, Column]:
    """F-02: length, words, mean word length, digit and special-character flags, price per word."""
    n = word_count(c)
    out = {
        "name_length": F.length(c), "name_word_count": n,
        "avg_word_length": F.try_divide(F.length(F.replace(col(c), F.lit(" "), F.lit(""))).cast("double"), n),
        "name_contains_numbers": F.col(c).rlike(r"[0-9]").cast("int"),
        "name_has_special_chars": F.col(c).rlike(r"[^a-zA-Z0-9\s]").cast("int"),
    }
    if price:
        out["price_per_word"] = F.col(price).cast("double") / (n + 1)
    return out


def clean_feedback(c: Column | str) -> Column:
    """D-31: keep letters, digits and blanks, fold blanks, lower case."""
    return F.lower(F.trim(F.regexp_replace(col(c), NOT_LETTERS, " ")))


def map_code(c: Column, table: Mapping[str, str], default: Column) -> Column:
    """Code -> label through a literal map."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, c), default)


def canonical_json(columns: Sequence[str]) -> Column:
    """JSON text with sorted keys and blanks after separators, as Python's ``json.dumps`` writes it.

    Characters outside ASCII stay as they are.
    """
    parts = []
    for c in sorted(columns):
        inner = F.to_json(F.array(F.col(c)))
        parts.append(F.concat(F.lit(f'"{c}": '), F.substring(inner, 2, F.length(inner) - 2)))
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def content_hash(columns: Sequence[str]) -> Column:
    """F-13."""
    return F.sha2(canonical_json(columns), 256)


def stable_id(prefix: str, *keys: Column | str) -> Column:
    """F-14: prefix and 16 hex digits of the key hash, the same on every run."""
    text = F.concat_ws("\u0001", *[col(k).cast("string") for k in keys])
    return F.concat(F.lit(prefix), F.substring(F.sha2(text, 256), 1, 16))


def human_bytes(c: Column | str) -> Column:
    """F-15: bytes with two decimals and a unit."""
    size, out = col(c).cast("double"), None
    for i, unit in enumerate(("B", "KB", "MB", "GB", "TB")):
        scaled = size / F.lit(float(1024 ** i))
        label = F.concat(F.call_function("format_number", scaled, F.lit("0.00")), F.lit(f" {unit}"))
        out = F.when(scaled < 1024, label) if out is None else out.when(scaled < 1024, label)
    return out.otherwise(F.concat(F.call_function("format_number", size / F.lit(float(1024 ** 5)), F.lit("0.00")), F.lit(" PB")))


def parse_iso(c: Column | str, fallback: Column) -> Column:
    """F-17: ISO timestamp, also with a trailing ``Z``; anything without ``T`` or unreadable gives the fallback."""
    s = col(c)
    plain = F.regexp_replace(s, "Z$", "")
    return F.coalesce(F.when(s.contains("T"), F.try_to_timestamp(plain).cast("timestamp_ntz")), fallback)


def hashtags(c: Column | str) -> Column:
    """F-18."""
    return F.regexp_extract_all(col(c), F.lit(r"(#[\p{L}\p{N}_]+)"), F.lit(1))


def ngrams(tokens: Column, n: int) -> Column:
    """Word n-grams of an array column: the tokens zipped with themselves shifted by one, n - 1 times."""
    out = tokens
    for shift in range(1, n):
        rest = F.slice(tokens, shift + 1, F.greatest(F.size(tokens) - shift, F.lit(0)))
        out = F.zip_with(F.slice(out, 1, F.size(rest)), rest, lambda a, b: F.concat(a, F.lit(" "), b))
    return out


def keyword_hits(text: Column, keywords: Sequence[str]) -> Column:
    """How many of the keywords occur as substrings."""
    out = F.lit(0)
    for k in keywords:
        out = out + F.when(text.contains(k), 1).otherwise(0)
    return out
