"""Scalar functions as JVM column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trimmed(c: Column) -> Column:
    """``c`` without outer white space of any kind."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def strip_share_suffix(name: Column) -> Column:
    """A security's name up to its share class: everything from a white space and ``Ord`` on goes."""
    return trimmed(F.regexp_replace(name, r"(?s)\s+[Oo]rd[\s._].*$", ""))


def strip_legal_forms(name: Column) -> Column:
    """A company's name without the legal forms, wherever they stand."""
    # The legal forms, removed in this order.
    for form in (" Limited", " PLC", " Plc", " Ltd"):
        name = F.replace(name, F.lit(form), F.lit(""))
    return trimmed(name)


def normalise_date(raw: Column) -> Column:
    """A date from ``01-June-2020``, ``2020-06-01``, ``01/06/2020`` or ``01-06-2020``; null for anything else."""
    s = trimmed(raw)
    pick = lambda pattern, form: F.when(s.rlike(pattern), F.to_date(F.try_to_timestamp(s, F.lit(form))))
    return F.coalesce(
        pick(r"^\d{1,2}-[A-Za-z]+-\d{4}$", "d-MMMM-yyyy"),
        pick(r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
        pick(r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
        pick(r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"),
    )


def strict_day(raw: Column) -> Column:
    """A date from ``yyyy-m-d`` only."""
    return F.when(raw.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.to_date(F.try_to_timestamp(raw, F.lit("yyyy-M-d"))))


def to_number(text: Column, separators: bool = True) -> Column:
    """A float from text, with thousands separators if allowed; null if it is none. ``nan`` and ``inf`` count."""
    s = F.lower(trimmed(F.replace(text, F.lit(","), F.lit("")) if separators else text))
    return F.when(s.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?$|^[+-]?(nan|inf(inity)?)$"), s.try_cast("double"))


def safe_file_name(name: Column) -> Column:
    """Everything but letters, digits, blanks, ``_`` and ``-`` becomes ``_``."""
    return F.regexp_replace(name, r"[^\p{L}\p{N} _-]", "_")


def strip_fences(text: Column) -> Column:
    """A reply without the code fence around it."""
    return trimmed(F.regexp_replace(F.regexp_replace(trimmed(text), r"^```(?:json)?\s*", ""), r"\s*```$", ""))


def parse_reply(text: Column) -> Column:
    """A reply as a variant: the whole text, else the text from its first to its last brace; null if neither is JSON."""
    bare = strip_fences(text)
    return F.coalesce(F.try_parse_json(bare), F.try_parse_json(F.regexp_extract(bare, r"(?s)(\{.*\})", 1)))


def article_text(content: Column, description: Column, title: Column, limit: int = 2000) -> Column:
    """The first of the three that is not empty, cut to ``limit`` characters."""
    filled = lambda c: F.when(c != "", c)
    return F.substring(F.coalesce(filled(content), filled(description), filled(title), F.lit("")), 1, limit)


def content_hash(title: Column, content: Column) -> Column:
    """md5 of title and content; a null content counts as the text ``None``."""
    return F.md5(F.concat(title, F.coalesce(content, F.lit("None"))))


def published_local(raw: Column, fallback: Column) -> Column:
    """An ISO stamp's calendar time, its offset dropped and not converted; ``fallback`` if it is none."""
    bare = F.regexp_replace(raw, r"(Z|[+-]\d{2}:\d{2})$", "")
    forms = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")
    return F.coalesce(*[F.when(F.length(bare) == len(f.replace("'", "")), F.try_to_timestamp(bare, F.lit(f))) for f in forms], fallback)


def ieee_divide(a: Column, b: Column) -> Column:
    """Division as IEEE 754 has it: x/0 is infinite, 0/0 is NaN; null only for null operands."""
    inf, nan = F.lit(float("inf")), F.lit(float("nan"))
    by_zero = F.when(F.isnan(a) | (a == 0), nan).when(a > 0, inf).otherwise(-inf)
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(b == 0, by_zero).otherwise(F.try_divide(a, b))


def percent_change(t0: Column, tn: Column) -> Column:
    """Change from t0 to tn in percent; null for a null or a zero t0."""
    return F.try_divide(tn - t0, t0) * 100


def direction_label(pct: Column, threshold: float = 1.5) -> Column:
    """UP or DOWN from the threshold on, else NEUTRAL; null and NaN are NEUTRAL."""
    known = pct.isNotNull() & ~F.isnan(pct)
    return F.when(known & (pct >= threshold), "UP").when(known & (pct <= -threshold), "DOWN").otherwise("NEUTRAL")


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0.0 where the whole is zero."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def or_query(names: Column) -> Column:
    """A search expression that asks for any of an array of names."""
    return F.concat(F.lit("("), F.array_join(F.transform(names, lambda n: F.concat(F.lit('"'), n, F.lit('"'))), " OR "), F.lit(")"))


def days_before(as_of: Column, days: int) -> Column:
    """The day ``days`` days before ``as_of``."""
    return F.date_sub(F.to_date(as_of), days)


def preview(items: Column, most: int = 5) -> Column:
    """The first ``most`` of an array's entries as text, with an ellipsis where there are more."""
    return F.concat(F.array_join(F.slice(items, 1, most), ", "), F.when(F.size(items) > most, ", …").otherwise(""))


def bar(value: Column, width: int = 20) -> Column:
    """A bar of ``#`` in proportion to a share."""
    return F.repeat(F.lit("#"), F.floor(value * width).cast("int"))
