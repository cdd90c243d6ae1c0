"""Identity and idempotency keys, and bounded texts of records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_of(*parts: Column) -> Column:
    """sha256 of the parts as a JSON array, in which a null part is null and no bar or quote can be mistaken."""
    return F.sha2(F.to_json(F.array(*[p.cast("string") for p in parts])), 256)


def external_or_url(external: Column, url: Column) -> Column:
    return F.coalesce(external, F.sha2(url, 256))


def decimal_text(value: Column) -> Column:
    """A decimal in plain notation without trailing zeros."""
    plain = value.cast("string")
    return F.when(plain.contains("."), F.regexp_replace(plain, r"\.?0+$", "")).otherwise(plain)


def recipe_code(key: Column) -> Column:
    return F.concat(F.lit("RCP-"), F.upper(F.substring(F.regexp_replace(key, "-", ""), 1, 8)))


def job_text(title: Column, description: Column, most: int = 12_000) -> Column:
    """The text of a job to embed, in two lines, white space and control characters collapsed."""
    flat = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\p{Cntrl}\s]+", " "))
    return F.substring(F.concat(F.lit("Title: "), flat(title), F.lit("\nDescription: "), flat(description)), 1, most)


def profile_text(parts: dict[str, Column], most: int = 2000) -> Column:
    """One line for each part that has values, sorted and distinct."""
    line = lambda name, values: F.when(F.size(values) > 0, F.concat(F.lit(f"{name}: "), F.array_join(F.array_sort(F.array_distinct(values)), ", ")))
    return F.substring(F.concat_ws("\n", *[line(n, v) for n, v in parts.items()]), 1, most)


def safe_filename(name: Column, default: str = "document") -> Column:
    last = F.element_at(F.split(name, r"[/\\]"), -1)
    return F.coalesce(F.nullif(F.substring(F.trim(F.regexp_replace(last, r"\p{Cntrl}", "")), 1, 255), F.lit("")), F.lit(default))


def cost(prompt: Column, cached: Column, output: Column, prices: tuple[float, float, float]) -> Column:
    """Estimated cost of a request by prices a million tokens (cached, other prompt, output)."""
    hit = F.coalesce(cached, F.lit(0))
    return F.round((hit * prices[0] + (prompt - hit) * prices[1] + output * prices[2]) / 1_000_000, 8)


def payload_hash(payload: Column) -> Column:
    """sha256 of the bytes as they came."""
    return F.sha2(payload.cast("binary"), 256)
