"""Table jobs over columns: URLs to keys, prices to money in one unit, quantities to measures, logs without secrets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from souklens.functions.numbers import GRAMS, MILLIMETRES, convert_currency_unit, convert_dimension, convert_weight, parse_money, read_measure
from souklens.functions.text import canonical_url, category_slug, page_number, profile_domain, redact_values


def canonicalize_urls(df: DataFrame, column: str) -> DataFrame:
    """df with url_key, host, page_no and category_slug of a URL column: keys to join crawled pages by."""
    c = F.col(f"`{column}`")
    return df.withColumns({"url_key": canonical_url(c), "host": profile_domain(c), "page_no": page_number(c), "category_slug": category_slug(c)})


def normalize_prices(df: DataFrame, columns: list[str], *, key: str, currency: str = "", unit: str | None = None, default_unit: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(df, issues): price texts as struct(amount, currency, unit), toman and rial in `unit` if one is asked for; issues (key, field,
    code) of separators that could be read two ways, of prices without a currency, and of rial or toman left open."""
    money = {c: parse_money(F.col(f"`{c}`"), currency or None, default_unit) for c in columns}
    d = df.withColumns({f"_m_{c}": m for c, m in money.items()})

    def told(c: str) -> Column:
        m = F.col(f"`_m_{c}`")
        ours, free = F.upper(m["currency"]).isin("IRR", "IRT"), m["unit"].isNull()
        codes = F.array_compact(F.array(F.when(m["ambiguous"], "price-separator-ambiguous"), F.when(m["currency"] == "", "price-currency-missing"), F.when(ours & free, "price-unit-unknown")))
        return F.transform(codes, lambda x: F.struct(F.lit(c).alias("field"), x.alias("code")))

    issues = d.select(key, F.explode(F.flatten(F.array(*[F.coalesce(told(c), F.array().cast("array<struct<field:string,code:string>>")) for c in columns]))).alias("i")).select(key, "i.*")

    def one(c: str) -> Column:
        m = F.col(f"`_m_{c}`")
        amount = m["amount"] if unit is None else convert_currency_unit(m["amount"], m["currency"], m["unit"], unit)
        to = m["unit"] if unit is None else F.when(m["unit"].isNotNull(), F.lit(unit))
        return F.when(m.isNotNull(), F.struct(amount.alias("amount"), m["currency"].alias("currency"), to.alias("unit")))

    return d.withColumns({c: one(c) for c in columns}).drop(*(f"_m_{c}" for c in columns)), issues


def normalize_measures(df: DataFrame, columns: list[str], *, weight: str = "kg", dimension: str = "cm") -> DataFrame:
    """Quantity texts as struct(value, unit), weights in one unit and lengths in another; null without a unit that is known."""

    def one(c: str) -> Column:
        m = read_measure(F.col(f"`{c}`"))
        heavy = F.struct(convert_weight(m["value"], m["unit"], weight).alias("value"), F.lit(weight).alias("unit"))
        long = F.struct(convert_dimension(m["value"], m["unit"], dimension).alias("value"), F.lit(dimension).alias("unit"))
        return F.when(m["unit"].isin(*GRAMS), heavy).when(m["unit"].isin(*MILLIMETRES), long)

    return df.withColumns({c: one(c) for c in columns})


# Levels of a log, from the least.
LEVELS = ("debug", "info", "warn", "error")


def redact_log(lines: DataFrame, *, level: str = "info", column: str = "value") -> DataFrame:
    """JSON lines (a text column) of at least a level, with fields: a map of their values without secrets, long texts cut to their
    length; lines that don't parse are left out."""
    v = F.try_parse_json(F.col(f"`{column}`"))
    d = lines.withColumn("_v", v).where(F.col("_v").isNotNull())
    kept = F.array_position(F.array(*map(F.lit, LEVELS)), F.coalesce(F.try_variant_get("_v", "$.level", "string"), F.lit("info"))) > LEVELS.index(level)
    return d.where(kept).withColumn("fields", redact_values(F.col("_v"))).drop("_v", column)


def profiles_for_pages(pages: DataFrame, profiles: DataFrame, *, url: str = "url") -> DataFrame:
    """pages with the profile (profile_id, domain, ...) of their host, which is compared in lower case without www."""
    host = F.regexp_replace(F.lower(F.trim("domain")), r"^www\.", "")
    return pages.withColumn("_host", profile_domain(F.col(f"`{url}`"))).join(profiles.withColumn("_host", host), "_host").drop("_host")
