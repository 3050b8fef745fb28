"""Column functions of the data paths."""

from __future__ import annotations

import datetime
import math
import re
import string

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DEAD_BAND = 1e-9
LETTERS = string.ascii_letters
ADDRESS, HOST = LETTERS + string.digits + "._%+-", LETTERS + string.digits + ".-"
# What else is taken out of texts, each behind a start or a character that cannot belong to it, which is put back.
ROOTED_PATH = (r"""(^|[\s'"(:])/[^\s'"()]+/[^\s'"()]*""", "$1{path}")
LONG_NUMBER = (r"(^|[^0-9.])([0-9]{7,})($|[^0-9.]|\.$|\.[^0-9])", "$1{id}$3")
ANY_LONG_NUMBER = (r"[0-9]{7,}", "{id}")
PATH_ENDS = r"""[\s'"()]"""


def replaced(text: Column, rule: tuple[str, str]) -> Column:
    """Every match; a rule that takes the character behind a match with it is applied twice, for neighbours that share that character."""
    once = F.regexp_replace(text, *rule)
    return F.regexp_replace(once, *rule) if "$3" in rule[1] else once


def _led(text: Column, characters: str) -> Column:
    """How many of these characters a text begins with."""
    return F.length(text) - F.length(F.ltrim(text, F.lit(characters)))


def _folded(text: Column, mark: str, step) -> Column:
    """A text parted at a mark and put together again, part by part: ``done`` is settled, ``rest`` may still belong to what the next mark shows."""
    parts = F.split(text, re.escape(mark))
    begin = F.struct(F.lit("").alias("done"), F.get(parts, F.lit(0)).alias("rest"), F.lit(False).alias("open"))
    folded = F.aggregate(F.slice(parts, 2, F.size(parts)), begin, step, lambda a: F.concat(a.done, a.rest))
    return F.when(text.contains(mark), folded).otherwise(text)


def without_addresses(text: Column) -> Column:
    """Mail addresses as {email}: characters of an address before an @, behind it a host whose last label that has two letters or more ends it."""

    def step(a: Column, part: Column) -> Column:
        own = F.length(a.rest) - F.length(F.rtrim(a.rest, F.lit(ADDRESS)))
        labels = F.split(F.substr(part, F.lit(1), _led(part, HOST)), r"\.")
        at = lambda i: F.aggregate(F.slice(labels, F.lit(1), i), F.lit(0), lambda n, x: n + F.length(x) + 1)
        ends = F.transform(labels, lambda x, i: F.when((at(i) > 1) & (_led(x, LETTERS) >= 2), at(i) + _led(x, LETTERS)))
        end = F.coalesce(F.array_max(ends), F.lit(0))
        found = F.concat(a.done, F.substr(a.rest, F.lit(1), F.length(a.rest) - own), F.lit("{email}"))
        hit = (own > 0) & (end > 0)
        rest = F.when(hit, F.substr(part, end + 1)).otherwise(part)
        return F.struct(F.when(hit, found).otherwise(F.concat(a.done, a.rest, F.lit("@"))).alias("done"), rest.alias("rest"), F.lit(False).alias("open"))

    return _folded(text, "@", step)


def without_drive_paths(text: Column) -> Column:
    """Paths of a drive as {path}: a letter, a colon and a backslash, then parts between single backslashes, up to white space, a quote or a bracket."""

    def step(a: Column, part: Column) -> Column:
        run = F.get(F.split(part, PATH_ENDS, 2), F.lit(0))
        empty = F.instr(F.concat(F.lit("\\"), run), "\\\\")  # where a part is empty
        end = F.when(empty > 0, empty - 1).otherwise(F.length(run))
        starts = ~a.open & (F.length(a.rest) > 0) & (_led(F.right(a.rest, F.lit(1)), LETTERS) == 1)
        done = F.when(a.open, a.done).when(starts, F.concat(a.done, F.substr(a.rest, F.lit(1), F.length(a.rest) - 1), F.lit("{path}"))).otherwise(F.concat(a.done, a.rest, F.lit(":\\")))
        inside = a.open | starts
        return F.struct(done.alias("done"), F.when(inside, F.substr(part, end + 1)).otherwise(part).alias("rest"), (inside & (end == F.length(part))).alias("open"))

    return _folded(text, ":\\", step)


def redact(text: Column) -> Column:
    """Mail addresses, then rooted paths of two or more parts and drive paths, then numbers of seven digits or more, as placeholders.

    A number that is part of a decimal stays.
    """
    return replaced(without_drive_paths(replaced(without_addresses(text), ROOTED_PATH)), LONG_NUMBER)


def addresses_sql(text: str) -> str:
    """``without_addresses`` as SQL of an engine with lists and lambdas."""
    own = f"length(a.rest) - length(rtrim(a.rest, '{ADDRESS}'))"
    labels = f"string_split(left(b.rest, length(b.rest) - length(ltrim(b.rest, '{HOST}'))), '.')"
    letters = f"length({{x}}) - length(ltrim({{x}}, '{LETTERS}'))"
    at = "list_sum(list_transform(l[1:i - 1], lambda y: length(y) + 1))"
    end = f"coalesce(list_max(list_transform([{labels}], lambda l: list_max(list_transform(l, lambda x, i: CASE WHEN {at} > 1 AND {letters.format(x='x')} >= 2 THEN {at} + {letters.format(x='x')} END)))), 0)"
    step = f"CASE WHEN {own} > 0 AND {end} > 0 THEN {{'done': a.done || left(a.rest, length(a.rest) - ({own})) || '{{email}}', 'rest': substr(b.rest, ({end} + 1)::BIGINT)}} ELSE {{'done': a.done || a.rest || '@', 'rest': b.rest}} END"
    folded = f"list_reduce(list_transform(string_split({text}, '@'), lambda p: {{'done': '', 'rest': p}}), lambda a, b: {step})"
    return f"(SELECT f.done || f.rest FROM (SELECT {folded} AS f))"


def drives_sql(text: str) -> str:
    """``without_drive_paths`` as SQL of an engine with lists and lambdas."""
    run = r"""regexp_extract(b.rest, '^[^\s''"()]*')"""
    empty = f"instr('\\' || {run}, '\\\\')"
    end = f"CASE WHEN {empty} > 0 THEN {empty} - 1 ELSE length({run}) END"
    starts = f"length(a.rest) > 0 AND ltrim(right(a.rest, 1), '{LETTERS}') = ''"
    cut = f"'rest': substr(b.rest, {end} + 1), 'open': {end} = length(b.rest)"
    step = f"CASE WHEN a.open THEN {{'done': a.done, {cut}}} WHEN {starts} THEN {{'done': a.done || left(a.rest, length(a.rest) - 1) || '{{path}}', {cut}}} ELSE {{'done': a.done || a.rest || ':\\', 'rest': b.rest, 'open': false}} END"
    folded = f"list_reduce(list_transform(string_split({text}, ':\\'), lambda p: {{'done': '', 'rest': p, 'open': false}}), lambda a, b: {step})"
    return f"(SELECT f.done || f.rest FROM (SELECT {folded} AS f))"


def rule_sql(text: str, rule: tuple[str, str]) -> str:
    quoted = rule[0].replace("'", "''")
    for _ in range(2 if "$3" in rule[1] else 1):
        text = f"regexp_replace({text}, '{quoted}', '{rule[1].replace('$', chr(92))}', 'g')"
    return text


def redact_sql(text: str) -> str:
    """``redact`` as SQL of an engine without look-around."""
    return rule_sql(drives_sql(rule_sql(addresses_sql(text), ROOTED_PATH)), LONG_NUMBER)


def mask_label(text: Column) -> Column:
    """Mail addresses and long numbers of a file label, parts of decimals too."""
    return replaced(without_addresses(text), ANY_LONG_NUMBER)


def mask_label_sql(text: str) -> str:
    return rule_sql(addresses_sql(text), ANY_LONG_NUMBER)


def instant_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def instant(text: Column) -> Column:
    """Strictly YYYY-MM-DDTHH:MM:SSZ, else null."""
    return F.when(text.rlike(r"\A\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z\z"), F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")))


def gmt(text: Column) -> Column:
    """The first 19 characters of a GMT text as an instant, else null."""
    return F.try_to_timestamp(F.substring(F.regexp_replace(text, " ", "T"), 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss"))


def calendar_date(text: Column) -> Column:
    """A date from ISO text or from epoch milliseconds, else null."""
    millis = F.try_to_number(F.when(text.rlike(r"\A\d{11,14}\z"), text), F.lit("9" * 14)).cast("long")
    return F.coalesce(F.when(text.rlike(r"\A\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(F.substring(text, 1, 10), F.lit("yyyy-MM-dd"))).cast("date"), F.timestamp_millis(millis).cast("date"))


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def minute_floor(us: Column) -> Column:
    return us - F.pmod(us, F.lit(60_000_000))


def local_clock(ts: Column, offset_s: Column) -> Column:
    return ts + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), offset_s.cast("decimal(18,6)"))


def confidence(n: Column) -> Column:
    return F.when(n >= 8, "high").when(n >= 5, "medium").when(n >= 3, "low").otherwise("insufficient")


def direction(delta: Column) -> Column:
    return F.when(F.abs(delta) < DEAD_BAND, "unchanged").when(delta > 0, "higher").when(delta < 0, "lower")


def plain_number(value: Column) -> Column:
    """A whole number without a point, any other rounded to three decimals without zeros behind them but one, as text."""
    short = F.regexp_replace(F.format_string("%.3f", round_exact(value, 3)), r"([0-9])0+$", "$1")
    return F.when(value == F.floor(value), F.floor(value).cast("long").cast("string")).when(value.isNotNull(), short)


def lower_median(value: str) -> Column:
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {value})")


def upper_median(value: str) -> Column:
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {value} DESC)")


SPLITTER = 134_217_729.0  # 2 ** 27 + 1
LARGE = 9_007_199_254_740_992.0  # 2 ** 53: from there on doubles are whole


def round_exact(value: Column, digits: int) -> Column:
    """The binary value rounded to so many decimals, halves to even, without a rounding on the way.

    The product with the power of ten is taken as a double and the error of that double, both exact (each factor is split in halves whose products
    are exact), so that the fraction can be compared with a half as the numbers are. Values whose last binary place is worth more than the
    last decimal stay as they are, as do nulls, infinities and what is no number.
    """
    ten = 10.0**digits  # exact up to 22
    high = SPLITTER * ten - (SPLITTER * ten - ten)
    low = ten - high
    x = F.abs(value.cast("double"))
    wide = SPLITTER * x
    x_high = wide - (wide - x)
    x_low = x - x_high
    p = x * ten
    error = x_low * low - (((p - x_high * high) - x_low * high) - x_high * low)
    whole = F.floor(p).cast("double")
    over = (p - whole) - 0.5  # exact; the value's fraction is over + error above a half
    odd = F.pmod(whole, F.lit(2.0)) == 1
    up = (over > -error) | ((over == -error) & odd)
    down = (p == whole) & (error == -0.5) & odd
    rounded = (whole + F.when(up, 1.0).otherwise(0.0) - F.when(down, 1.0).otherwise(0.0)) / ten
    stays = x.isNull() | F.isnan(x) | (p >= LARGE)
    return F.when(stays, value.cast("double")).when(value < 0, -rounded).otherwise(rounded)


def parse_day(text: str, name: str = "day") -> datetime.date:
    if not re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", text):
        raise ValueError(f"{name} must be YYYY-MM-DD")
    return datetime.date.fromisoformat(text)


def window_days(days: int, cap: int) -> int:
    return max(1, min(int(days), cap))


def days_before(day: datetime.date, days: int) -> datetime.date:
    """Clamped at the first day of the calendar."""
    return datetime.date.fromordinal(max(1, day.toordinal() - days))


def scrub(text: Column, names: list[str], mark: str = "{name}") -> Column:
    """Names, whatever their case, replaced in a text; nested results are scrubbed as their JSON text."""
    return F.regexp_replace(text, "(?i)" + "|".join(re.escape(n) for n in sorted(names, key=len, reverse=True)), mark) if names else text


PAD_FLOOR = 64 * 1024


def padded_length(length: Column) -> Column:
    """The length that a bundle is padded to: rounded up so that its leading bits alone tell its size (the Padmé rule)."""
    n = F.greatest(length, F.lit(PAD_FLOOR)).cast("long")
    exponent = F.length(F.bin(n)) - 1
    low = exponent - F.length(F.bin(exponent.cast("long")))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), low) - 1
    return (n + mask).bitwiseAND(F.bitwise_not(mask))


def inflate(column: Column) -> Column:
    """For records that came packed from elsewhere; what is stored here is packed by the file format."""
    return _zlib("decompress")(column)


def deflate(column: Column) -> Column:
    return _zlib("compress")(column)


def _zlib(name: str):
    def run(x: pd.Series) -> pd.Series:
        import zlib

        return x.map(lambda v: None if v is None else getattr(zlib, name)(bytes(v)))

    return F.pandas_udf(run, "binary")
