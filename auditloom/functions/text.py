"""Text cleaning for messy bibliographic fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings that mean "no value" in the source files.
MISSING_TEXT = ("", "unavailable", "n/a", "none")
MISSING_PUBMED = ("", "0", "unavailable")
VALUE_SEPARATOR = ";"

# The Unicode space separators (general category Zs).
SPACES = "\u0020\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"

# Patterns of identifiers and coded subjects.
DOI_URL_PREFIX = r"^https?://(dx\.)?doi\.org/"
LAST_PATH_SEGMENT = r"([^/]+)$"
BLANKS_AFTER_CODE = " \t\n\x0b\f\r"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_spaces(c: Column | str) -> Column:
    """Trim every Unicode space separator, not only U+0020 as SQL ``trim`` does in Spark.

    A text without characters of several bytes has no other separator than U+0020, and the plain trim is much cheaper.
    """
    text = _col(c)
    return F.when(F.octet_length(text) == F.char_length(text), F.trim(text)).otherwise(F.btrim(text, F.lit(SPACES)))


def _unless_listed(text: Column, compared: Column, missing: Sequence[str]) -> Column:
    """One call instead of a chain of comparisons keeps the generated code of wide tables small."""
    return F.when(F.find_in_set(compared, F.lit(",".join(missing))) == 0, text)


def clean_text(c: Column | str) -> Column:
    """Trimmed text; the missing-value spellings become NULL whatever their case."""
    text = trim_spaces(c)
    return _unless_listed(text, F.lower(text), MISSING_TEXT)


def normalize_doi(c: Column | str) -> Column:
    """Lower-case bare DOI without a resolver address, so two sources share one key."""
    text = F.lower(clean_text(c))
    return F.regexp_replace(text, DOI_URL_PREFIX, "")


def normalize_pubmed(c: Column | str) -> Column:
    """PubMed id as text; the source writes 0 for a missing one."""
    text = trim_spaces(c)
    return _unless_listed(text, text, MISSING_PUBMED)


def _literally(separator: str) -> str:
    """The separator as a pattern; that of a single character is not compiled again for every row."""
    if len(separator) != 1 or separator.isalnum():
        return f"\\Q{separator}\\E"
    return f"\\{separator}" if separator in ".$|()[{^?*+\\" else separator


def split_multi(c: Column | str, separator: str = VALUE_SEPARATOR) -> Column:
    """Split a multi-valued field: trimmed parts in their order, no blanks, NULL gives []."""
    parts = F.split(F.coalesce(_col(c), F.lit("")), _literally(separator))
    return F.filter(F.transform(parts, trim_spaces), lambda part: part != "")


def short_id(c: Column | str) -> Column:
    """Last path segment of an identifier URL ('' when there is none, NULL stays NULL)."""
    return F.regexp_extract(_col(c), LAST_PATH_SEGMENT, 1)


def _coded(text: Column) -> tuple[Column, Column]:
    """Place of the first closing parenthesis, and whether the text begins with a code in parentheses."""
    end = F.instr(text, ")")
    return end, text.startswith("(") & (end > 2)


def subject_code(c: Column | str) -> Column:
    """Code in the leading parentheses of a coded subject ('' when there is none)."""
    text = _col(c)
    end, coded = _coded(text)
    return F.when(coded, text.substr(F.lit(2), end - 2)).when(text.isNotNull(), "")


def subject_name(c: Column | str) -> Column:
    """Coded subject without its code; NULL when nothing is left."""
    text = _col(c)
    end, coded = _coded(text)
    rest = F.ltrim(text.substr(end + 1, F.char_length(text)), F.lit(BLANKS_AFTER_CODE))
    return F.nullif(F.when(coded, rest).otherwise(text), F.lit(""))


def matches_any_keyword(c: Column | str, keywords: Sequence[str]) -> Column:
    """True when the text holds one of the keywords, ignoring case."""
    pattern = "|".join(f"\\Q{word}\\E" for word in keywords)
    return _col(c).rlike(f"(?i){pattern}")
