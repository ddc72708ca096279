"""Numbers as people read them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def duration(seconds: Column) -> Column:
    """42s, 3m07s or 2h05m."""
    two = lambda x: F.lpad(x.cast("long").cast("string"), 2, "0")
    whole = lambda x: F.floor(x).cast("string")
    return (
        F.when(seconds < 60, F.concat(whole(seconds), F.lit("s")))
        .when(seconds < 3600, F.concat(whole(seconds / 60), F.lit("m"), two(seconds % 60), F.lit("s")))
        .otherwise(F.concat(whole(seconds / 3600), F.lit("h"), two(F.floor((seconds % 3600) / 60)), F.lit("m")))
    )


def cost(tokens_in: Column, tokens_out: Column, price_in: float, price_out: float) -> Column:
    """Price of tokens, with prices for a million of each."""
    return (tokens_in * price_in + tokens_out * price_out) / 1e6


def token_estimate(chars: Column) -> Column:
    """Tokens a page of so many characters takes, with the instructions around it."""
    return F.floor(chars / 3.07 + 16).cast("long")


def delay(seconds: float) -> str:
    """A pause as a log states it: 2s, 10m or 1h."""
    whole = int(seconds)
    for size, unit in ((3600, "h"), (60, "m")):
        if whole >= size and whole % size == 0:
            return f"{whole // size}{unit}"
    return f"{whole}s"


def duration_of(seconds: float) -> str:
    """duration() of a number of the driver."""
    whole = max(0, int(seconds))
    minutes, hours = whole // 60, whole // 3600
    return f"{whole}s" if whole < 60 else f"{minutes}m{whole % 60:02d}s" if hours == 0 else f"{hours}h{minutes % 60:02d}m"


def progress_line(done: int, total: int, seconds: float, chunks: int, source: str, calls: int = 1, fallback: int = 0) -> str:
    """A line for a finished page: how far the work is, how fast, and how long it will take."""
    share = 100 * done / total if total else 100.0
    rate = done / seconds if seconds > 0 else 0.0
    rest = max(0, total - done) / rate if rate > 0 else 0.0
    extra = f" fallback={fallback}" if fallback else ""
    return f"  [{done}/{total} {share:5.1f}%] {60 * rate:.2f} pages/min eta {duration_of(rest)} | chunks={chunks} calls={calls}{extra} | {source}"
