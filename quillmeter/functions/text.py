"""Numbers as text, for reports."""

from __future__ import annotations


def number(x) -> str:
    return f"{x or 0:,.0f}"


def usd(x) -> str:
    x = x or 0
    return f"${x:,.4f}" if 0 < abs(x) < 1 else f"${x:,.2f}"


def percent(x) -> str:
    return f"{(x or 0) * 100:.1f}%"


def size(n) -> str:
    n = float(n or 0)
    for unit in ("B", "KiB", "MiB", "GiB"):
        if n < 1024 or unit == "GiB":
            return f"{n:.0f} {unit}" if unit == "B" else f"{n:.1f} {unit}"
        n /= 1024
    return ""
