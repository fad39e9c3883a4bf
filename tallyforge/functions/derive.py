"""Scalar derivations as Catalyst expressions (no UDFs). Money is DECIMAL(12,2), fractions DECIMAL(8,4), both HALF_UP."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The first synthetic order instant, and the end of the window that all of them lie in.
ORDER_TS_BASE = datetime(2024, 1, 1, tzinfo=timezone.utc)
ORDER_TS_HIGH = ORDER_TS_BASE + timedelta(days=365)


def normalize_text(x: Column) -> Column:
    """Unicode white space (and U+001C..U+001F) stripped from both ends; blank becomes null."""
    return F.nullif(F.regexp_replace(x, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""), F.lit(""))


def normalize_email(x: Column) -> Column:
    return F.lower(normalize_text(x))


def full_name(first: Column, last: Column) -> Column:
    return F.nullif(F.concat_ws(" ", normalize_text(first), normalize_text(last)), F.lit(""))


def slugify(x: Column) -> Column:
    slug = F.btrim(F.regexp_replace(F.lower(normalize_text(x)), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit("unknown"))


def sku(product_id: Column, category: Column, title: Column) -> Column:
    return F.concat(F.lit("SKU-"), slugify(category), F.lit("-"), slugify(title), F.lit("-"), product_id.cast("string"))


def order_status(cart_id: Column, products: Column, quantity: Column) -> Column:
    return (
        F.when((products == 0) | (quantity == 0), "canceled")
        .when(cart_id % 20 == 0, "refunded")
        .when(F.pmod(cart_id, F.lit(20)).between(1, 3), "pending")
        .otherwise("paid")
    )


def order_ts(cart_id: Column, user_id: Column) -> Column:
    """A deterministic instant in the year that follows ORDER_TS_BASE."""
    offset = F.make_dt_interval((cart_id % 365).cast("int"), F.lit(0), ((user_id * 17 + cart_id) % 1440).cast("int"), (cart_id % 60).cast("int"))
    return F.lit("2024-01-01T00:00:00Z").cast("timestamp") + offset


def money(x: Column) -> Column:
    return x.cast("decimal(12,2)")


def fraction(x: Column) -> Column:
    return x.cast("decimal(8,4)")


def line_discount(total: Column, discounted: Column) -> Column:
    """1 - discounted / total, held within 0..1; 0 where the total is not positive or there is no discounted total."""
    t, d = total.cast("decimal(20,6)"), discounted.cast("decimal(20,6)")
    ratio = F.lit(1).cast("decimal(20,6)") - d / F.when(t > 0, t)
    held = F.greatest(F.lit(0).cast("decimal(38,18)"), F.least(F.lit(1).cast("decimal(38,18)"), ratio.cast("decimal(38,18)")))
    return fraction(F.when(total.isNull(), F.lit(None)).when((t <= 0) | d.isNull(), F.lit(0)).otherwise(held))


def gross_usd(quantity: Column, price: Column) -> Column:
    """quantity times the unrounded price, then cents."""
    return money(quantity.cast("decimal(10,0)") * price.cast("decimal(27,17)"))


def net_usd(gross: Column, discount: Column, discounted: Column) -> Column:
    return F.coalesce(money(discounted), money(gross * (F.lit(1).cast("decimal(8,4)") - discount)))


def discount_fraction(percent: Column) -> Column:
    return fraction(percent.cast("decimal(20,6)") / 100)


def six_places(x: Column) -> Column:
    return x.cast("decimal(18,6)")


def date_parts(d: Column) -> dict[str, Column]:
    """Calendar attributes of a date; year is the ISO year, weeks start on Monday."""
    return {
        "year": F.extract(F.lit("YEAROFWEEK"), d).cast("int"),
        "month": F.month(d),
        "day": F.dayofmonth(d),
        "iso_week": F.weekofyear(d),
        "iso_dow": F.extract(F.lit("DAYOFWEEK_ISO"), d).cast("int"),
        "quarter": F.quarter(d),
        "week_start": F.date_trunc("week", d).cast("date"),
        "month_start": F.date_trunc("month", d).cast("date"),
    }
