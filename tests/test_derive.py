from datetime import datetime, timedelta, timezone
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import derive as D
from tallyforge.sources.window import parse_overlap, resolve_window


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_text(spark):
    lit = F.lit
    assert one(spark, D.full_name(lit(" Ada "), lit(" Lovelace ")), D.normalize_email(lit(" ADA@EXAMPLE.COM ")), D.sku(lit(10), lit("Groceries"), lit("Tea Bags")), D.slugify(lit(None).cast("string")), D.normalize_text(lit(" \x1c "))) == ("Ada Lovelace", "ada@example.com", "SKU-groceries-tea-bags-10", "unknown", None)


def test_orders(spark):
    n = F.lit
    got = one(spark, *(D.order_status(n(a), n(b), n(c)) for a, b, c in ((7, 1, 2), (40, 1, 2), (1, 0, 0), (3, 1, 1))), *(F.date_format(D.order_ts(n(a), n(b)), "yyyy-MM-dd HH:mm:ss") for a, b in ((104, 1), (100, 1), (20, 2), (350, 1))))
    assert got == ("paid", "refunded", "canceled", "pending", "2024-04-14 02:01:44", "2024-04-10 01:57:40", "2024-01-21 00:54:20", "2024-12-16 06:07:50")


def test_money(spark):
    d = lambda x: F.lit(x).cast("double")
    gross = D.gross_usd(F.lit(2), d(4.99))
    pct = D.line_discount(d(9.98), d(7.48))
    assert one(spark, gross, pct, D.net_usd(gross, pct, d(7.48)), D.discount_fraction(d(12.5)), D.line_discount(d(0.0), d(1.0)), D.money(d(1.005))) == tuple(map(Decimal, ("9.98", "0.2505", "7.48", "0.1250", "0.0000", "1.01")))


def test_iso_year(spark):
    for day, want in (("2024-12-30", (2025, 1, 1)), ("2023-01-01", (2022, 52, 7))):
        p = D.date_parts(F.lit(day).cast("date"))
        assert one(spark, p["year"], p["iso_week"], p["iso_dow"]) == want


def test_windows():
    z = lambda d: datetime(2024, 12, d, tzinfo=timezone.utc)
    w = resolve_window("order_ts", z(20), z(30), overlap=timedelta(days=7), default_high=z(31))
    assert (w.low, w.high) == (z(13), z(31))
    with pytest.raises(ValueError, match="No prior successful watermark found"):
        resolve_window("order_ts", None, z(1))
    assert parse_overlap("2d6h30m") == timedelta(days=2, hours=6, minutes=30)
    with pytest.raises(ValueError):
        parse_overlap("")
