"""Column expressions over station and line names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented letters folded to ASCII, lower and upper case.
ACCENTED = "áàâäéèêëíìîïóòôöúùûüñÁÉÍÓÚÑ"
PLAIN = "aaaaeeeeiiiioooouuuunAEIOUN"


def extract(col: Column | str, pattern: str, group: int = 1) -> Column:
    """First match of a group; null, not an empty string, where nothing matches."""
    return F.nullif(F.regexp_extract(col, pattern, group), F.lit(""))


def code_of(col: Column | str) -> Column:
    """Numeric code of a ``(code)name`` label."""
    return extract(col, r"\((\d+)\)").cast("long")


def name_of(col: Column | str) -> Column:
    """Name part of a ``(code)name`` label."""
    return extract(col, r"\)(.+)")


def titlecase(col: Column | str) -> Column:
    """Upper-case the first character of every run of letters and digits, lower-case the rest."""
    pieces = F.regexp_extract_all(F.lower(col), F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}]+"), F.lit(0))
    cased = F.transform(pieces, lambda w: F.concat(F.upper(F.substr(w, F.lit(1), F.lit(1))), F.substr(w, F.lit(2))))
    return F.array_join(cased, "")


def normalize_name(col: Column | str) -> Column:
    """Title case, trimmed, accents folded; the order of the three steps matters."""
    return F.translate(F.trim(titlecase(col)), ACCENTED, PLAIN)


def head_to_portal(col: Column | str) -> Column:
    return F.regexp_replace(col, r"^Cabecera", "Portal")


def display_name(col: Column | str) -> Column:
    """Drop leading ``(05000)`` and ``05000 -`` codes."""
    no_paren = F.regexp_replace(col, r"^\(\d+\)", "")
    return F.trim(F.regexp_replace(no_paren, r"^\d+\s*-\s*", ""))


def dotted_thousands(col: Column | str) -> Column:
    """Integer part with dots between groups of three digits."""
    whole = (F.col(col) if isinstance(col, str) else col).cast("long")
    return F.translate(F.format_number(whole, 0), ",", ".")


def hour_band(hour: Column | str) -> Column:
    """``07:00 - 08:00`` for 7; the last band wraps to 00:00."""
    h = (F.col(hour) if isinstance(hour, str) else hour).cast("int")
    return F.format_string("%02d:00 - %02d:00", h, (h + 1) % 24)


def zip_links(html: Column | str, pattern: str) -> Column:
    return F.regexp_extract_all(html, F.lit(pattern), F.lit(1))
