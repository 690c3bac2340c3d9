"""Column-to-column functions; everything stays inside Catalyst expressions."""

from auditloom.functions.dates import days_between, parse_date, year_of, years_from_days
from auditloom.functions.numbers import count_where, ratio, round_to, share_where
from auditloom.functions.text import (
    clean_text,
    matches_any_keyword,
    normalize_doi,
    normalize_pubmed,
    short_id,
    split_multi,
    subject_code,
    subject_name,
    trim_spaces,
)

__all__ = [
    "clean_text", "count_where", "days_between", "matches_any_keyword", "normalize_doi",
    "normalize_pubmed", "parse_date", "ratio", "round_to", "share_where", "short_id",
    "split_multi", "subject_code", "subject_name", "trim_spaces", "year_of", "years_from_days",
]
