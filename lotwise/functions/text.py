"""Text parsing expressions for listing rows."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Unicode classes, so that a no-break space counts as blank.
UNICODE = "(?U)"


def strip(col: Column) -> Column:
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def first_match(col: Column, pattern: str, group: int = 1) -> Column:
    """First regex group, or null where nothing matches."""
    return F.nullif(F.regexp_extract(col, pattern, group), F.lit(""))


def parking_spots(address: Column) -> Column:
    return first_match(address, UNICODE + r"(\d+)\s+vagas?").try_cast("double")


def neighbourhood(address: Column) -> Column:
    found = first_match(address, UNICODE + r"em\s*([^,]+)")
    return strip(F.regexp_replace(found, r"(?U)^Imóvel\s+", ""))


def property_type(address: Column) -> Column:
    return strip(first_match(address, UNICODE + r"^(.*?)\s+para comprar"))


def money(text: Column) -> Column:
    """'R$ 1.234.567,89' to 1234567.89; unreadable text gives null."""
    plain = F.replace(F.replace(text, F.lit("R$"), F.lit("")), F.lit("."), F.lit(""))
    return strip(F.replace(plain, F.lit(","), F.lit("."))).try_cast("double")


def money_rejected(text: Column) -> Column:
    """True where a price text is present but cannot be read (quarantine flag)."""
    return text.isNotNull() & money(text).isNull()


def money_label(amount: Column) -> Column:
    return F.concat(F.lit("R$ "), F.format_number(amount, 2))


def geocode_key(street: Column, area: Column, *suffix: str | Column) -> Column:
    """Address key; null as soon as one part is null. Parts that are columns are trimmed, texts are fixed."""
    tail = [x for s in suffix for x in (F.lit(", "), F.lit(s) if isinstance(s, str) else strip(s))]
    return F.concat(strip(street), F.lit(", "), strip(area), *tail)


def short_key(part: Column, *suffix: str, trimmed: bool = True) -> Column:
    """Address key from one part (street or neighbourhood) and the fixed suffix."""
    tail = F.lit("".join(", " + s for s in suffix))
    return F.concat(strip(part) if trimmed else part, tail)


def page_number(file_name: Column) -> Column:
    """Number after 'pagina' in a file or folder name, 0 when there is none."""
    return F.coalesce(first_match(file_name, r"pagina(\d+)").try_cast("int"), F.lit(0))


def collected_at(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss"))


def collected_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def title(text: Column) -> Column:
    """First letter of every run of letters in upper case, the others in lower case."""
    runs = F.regexp_extract_all(text, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")
