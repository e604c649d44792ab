"""Pages deep in a long order, by order statistics.

To find the rows from some place on, nothing is sorted but a small range. The first column of the order is cut into
equal key ranges between its least and largest value, their rows are counted in one pass, and the counts'
prefix sums tell which range holds the place. That range is cut again, the scan reading it alone, and a
value that many rows share is cut by the next column, until a range has at most `MOST` rows.
Only these are sorted. A pass sends a row for each range to the driver, never one for each row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, DateType, NumericType, StringType, TimestampNTZType, TimestampType

#: Rows that are sorted at most, but for rows alike in the whole order, and key ranges of a pass.
MOST, RANGES = 100_000, 1024
#: Bytes of a text that make a number.
_WIDTH = 6


@dataclass(frozen=True)
class By:
    """A column of an order. Nulls come last unless `nulls_first`."""

    column: str
    descending: bool = False
    nulls_first: bool = False

    def sort(self) -> Column:
        c = F.col(self.column)
        if self.descending:
            return c.desc_nulls_first() if self.nulls_first else c.desc_nulls_last()
        return c.asc_nulls_first() if self.nulls_first else c.asc_nulls_last()


def _order(order: list[By | str]) -> list[By]:
    return [x if isinstance(x, By) else By(x) for x in order]


def _number(column: str, kind: DataType, step: int) -> Column:
    """A number that grows with the column; of a text, its bytes from 6 * step on."""
    c = F.col(column)
    if isinstance(kind, StringType):
        return F.conv(F.rpad(F.hex(F.substring(c.cast("binary"), step * _WIDTH + 1, _WIDTH)), 2 * _WIDTH, "0"), 16, 10).cast("long")
    if isinstance(kind, DateType):
        return F.unix_date(c)
    if isinstance(kind, TimestampType):
        return F.unix_micros(c)
    if isinstance(kind, TimestampNTZType):
        day = F.unix_date(F.to_date(c)).cast("long")
        return ((day * 24 + F.hour(c)) * 60 + F.minute(c)) * 60_000_000 + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")
    if isinstance(kind, BooleanType):
        return c.cast("int")
    if isinstance(kind, NumericType):
        return c
    raise ValueError(f"no ranges for {column} of type {kind.simpleString()}")


@dataclass
class Place:
    """A range of rows: its condition, how many rows come before it and how many it has, its bounds column by column."""

    rows: DataFrame
    before: int
    size: int
    low: list[tuple[By, str | None]]
    high: list[tuple[By, str | None]]


def _value(df: DataFrame, by: By, text: str) -> Column:
    return F.lit(text).cast(df.schema[by.column].dataType)


def place_of(df: DataFrame, order: list[By], at: int, most: int = MOST, ranges: int = RANGES) -> Place:
    """The range of at most `most` rows that holds the row at a place (from 0), which must exist."""
    rows, before, size = df, 0, df.count()
    low: list[tuple[By, str | None]] = []
    high: list[tuple[By, str | None]] = []
    for by in order:
        if size <= most:
            break
        kind, c = df.schema[by.column].dataType, F.col(by.column)
        text = lambda x: x.cast("string")
        facts = rows.agg(text(F.min(c)), text(F.max(c)), F.count(c)).first()
        nulls = size - facts[2]
        if nulls:
            in_nulls = at - before < nulls if by.nulls_first else at - before >= facts[2]
            if in_nulls:
                before += 0 if by.nulls_first else facts[2]
                rows, size = rows.where(c.isNull()), nulls
                low.append((by, None)), high.append((by, None))
                continue
            before += nulls if by.nulls_first else 0
            rows, size = rows.where(c.isNotNull()), facts[2]
        least, largest, step = facts[0], facts[1], 0
        while size > most and least != largest:
            number = _number(by.column, kind, step)
            first, last = rows.agg(F.min(number), F.max(number)).first()
            if first == last:  # the same beginning of all texts
                step += 1
                continue
            width = (float(last) - float(first)) / ranges
            cut = F.least(F.floor((number.cast("double") - float(first)) / width), F.lit(ranges - 1)) if width > 0 else F.lit(0)
            counted = rows.groupBy(cut.alias("cut")).agg(F.count(F.lit(1)).alias("n"), text(F.min(c)).alias("least"), text(F.max(c)).alias("largest")).collect()
            if len(counted) == 1:  # too near each other for floating point: leave them to the next columns
                break
            for r in sorted(counted, key=lambda r: r["cut"], reverse=by.descending):
                if at < before + r["n"]:
                    size, least, largest = r["n"], r["least"], r["largest"]
                    break
                before += r["n"]
            rows = rows.where((c >= _value(df, by, least)) & (c <= _value(df, by, largest)))
        low.append((by, largest if by.descending else least)), high.append((by, least if by.descending else largest))
        if least != largest:
            break
    return Place(rows, before, size, low, high)


def _beyond(df: DataFrame, bounds: list[tuple[By, str | None]], after: bool) -> Column:
    """Rows not before (or, else, not after) the bounds, in the lexicographic order of their columns."""
    condition = F.lit(True)
    for by, text in reversed(bounds):
        c = F.col(by.column)
        if text is None:
            same = c.isNull()
            past = F.lit(False) if after != by.nulls_first else c.isNotNull()
        else:
            v = _value(df, by, text)
            same = c.eqNullSafe(v)
            past = F.coalesce((c > v) if after != by.descending else (c < v), F.lit(False)) | (c.isNull() if after != by.nulls_first else F.lit(False))
        condition = past | (same & condition)
    return condition


def deep_page(df: DataFrame, order: list[By | str], offset: int, limit: int, most: int = MOST, ranges: int = RANGES) -> DataFrame:
    """The rows of df from `offset` on, `limit` of them, in the order; the same as orderBy, offset and limit.

    Rows that the order doesn't tell apart may stand for each other. Nothing is left of an offset past the end.
    What is sorted is the range of the page's first row to that of its last.
    """
    by = _order(order)
    total = df.count()
    if offset < 0 or limit < 0:
        raise ValueError(f"no rows from {offset}, {limit} of them")
    if offset >= total or not limit:
        return df.where(F.lit(False))
    first = place_of(df, by, offset, most, ranges)
    if offset + limit <= first.before + first.size or first.before + first.size >= total:
        rows = first.rows
    else:
        last = place_of(df, by, min(offset + limit, total) - 1, most, ranges)
        rows = df.where(_beyond(df, first.low, True) & _beyond(df, last.high, False))
    return rows.orderBy(*(x.sort() for x in by)).offset(offset - first.before).limit(limit)


def numbered_page(df: DataFrame, order: list[By | str], number: int, size: int, most: int = MOST) -> tuple[DataFrame, dict[str, int]]:
    """(rows, facts) of a page by its number, 0 standing for the last: number, size and how many pages there are.
    A page that doesn't exist is an error; an empty table has one page."""
    pages = max(1, -(-df.count() // size))
    number = number or pages
    if not 1 <= number <= pages:
        raise ValueError(f"no page {number} of {pages}")
    return deep_page(df, order, (number - 1) * size, size, most), {"number": number, "size": size, "pages": pages}


def position(df: DataFrame, order: list[By | str], row: dict[str, object]) -> Column:
    """The place (from 0) of a row among those of df, as a scalar: how many come before it. One pass, no sort."""
    before = F.lit(False)
    for by in reversed(_order(order)):
        c, v = F.col(by.column), F.lit(row[by.column]).cast(df.schema[by.column].dataType)
        nulls = c.isNull() & v.isNotNull() if by.nulls_first else c.isNotNull() & v.isNull()
        less = nulls | F.coalesce((c > v) if by.descending else (c < v), F.lit(False))
        before = less | (c.eqNullSafe(v) & before)
    return df.agg(F.count_if(before)).scalar()
