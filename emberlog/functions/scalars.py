"""Scalar expressions with the rules of the log formats."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The key pattern of block logs and the masks of the two formats.
BLOCK_KEY = r"blk_-?[0-9]+"
BLOCK_MASKS = (r"blk_(|-)[0-9]+", r"(\d+\.){3}\d+(:\d+)?")
NODE_MASKS = (r"core\.\d+", r"(0x)?[0-9a-fA-F]{8,}", r"(\d+\.){3}\d+(:\d+)?", r"\b\d+\b")


def zero_filled(c: Column, width: int) -> Column:
    """Zeros in front up to the width; longer values stay whole."""
    return F.when(F.length(c) < width, F.lpad(c, width, "0")).otherwise(c)


def compact_timestamp(date: Column, time: Column) -> Column:
    """yyMMdd and HHmmss, of which leading zeros may be missing."""
    return F.to_timestamp_ntz(F.concat(zero_filled(date, 6), zero_filled(time, 6)), F.lit("yyMMddHHmmss"))


def micro_timestamp(c: Column) -> Column:
    """Dotted time with up to six digits of a second, without a zone as in compact_timestamp(); NULL where it is none."""
    shape = r"^(\d{4}-\d{2}-\d{2})-(\d{2})\.(\d{2})\.(\d{2})\.(\d{1,6})$"
    return F.when(c.rlike(shape), F.regexp_replace(c, shape, "$1 $2:$3:$4.$5").try_cast("timestamp_ntz"))


def keys_in(content: Column, pattern: str = BLOCK_KEY) -> Column:
    """The distinct keys that a line names, by first place."""
    return F.array_distinct(F.regexp_extract_all(content, F.lit(pattern), F.lit(0)))


def masked(content: Column, masks=BLOCK_MASKS) -> Column:
    return reduce(lambda c, m: F.regexp_replace(c, m, "<*>"), masks, content)


def seconds_of(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def shown_timestamp(ts: Column) -> Column:
    """Six digits of a second, or none where they are zeros."""
    whole = F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
    return F.when(F.unix_micros(ts.cast("timestamp")) % 1_000_000 == 0, whole).otherwise(F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def fixed_point(c: Column, digits: int) -> Column:
    """Half to even, as text."""
    return F.format_string(f"%.{digits}f", F.bround(c, digits))


def header_pattern(log_format: str) -> tuple[str, list[str]]:
    """A format such as "<Date> <Level>: <Content>" as a pattern with a group for each field."""
    import re

    names = re.findall(r"<(\w+)>", log_format)
    literals = [re.sub(r" +", r"\\s+", re.sub(r"([.\\^$*+?{}\[\]|()])", r"\\\1", x)) for x in re.split(r"<\w+>", log_format)]
    groups = [r"(.*?)"] * (len(names) - 1) + [r"(.*)"]
    return "^" + literals[0] + "".join(g + x for g, x in zip(groups, literals[1:], strict=True)) + "$", names
