"""Cleaning functions over columns. A required field that can't be cleaned is null; `clean_rows`
turns that into a reason and splits clean rows from rejected ones."""

from collections.abc import Callable
from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from serialis.functions.text import let

# Languages by English name and by flag, reading directions by kind and by origin, statuses.
LANGUAGES = ["DE", "EN", "ES", "FR", "IT", "RU", "PT"]
BY_NAME = {"German": "DE", "English": "EN", "Spanish (Es)": "ES", "French": "FR", "Italian": "IT", "Russian": "RU", "Portuguese (Br)": "PT"}
BY_FLAG = {"flag_germany": "DE", "flag_united_kingdom": "EN", "flag_spain": "ES", "flag_france": "FR", "flag_italy": "IT", "flag_russia": "RU", "flag_portugal": "PT"}
BY_KIND = {"Doujinshi": "RL", "Manga": "RL", "Manhua": "RL", "Manhwa": "LR", "OEL": "LR", "One-Shot": "RL"}
BY_ORIGIN = {"Japanese": "RL", "Chinese (Simp)": "RL", "Korean": "LR"}
STATUSES = {"Ativo": "O", "Completo": "C"}
# Words in a name that say what kind of publication it is.
KINDS = ["Manga", "Manhwa", "Manhua"]
# Absolute date formats, tried in this order.
DATE_FORMATS = ["dd MMMM yyyy - hh:mm a", "dd MMM yyyy", "MMM d, yyyy HH:mma", "MMM d, yyyy", "d-M-yyyy"]


def trimmed(text: Column) -> Column:
    return F.trim(text)


def as_list(value: Column, depth: int = 0) -> Column:
    """A scalar as an array of it, null as an empty one; arrays nested `depth` deep are flattened."""
    if not depth:
        return F.when(value.isNotNull(), F.array(value)).otherwise(F.array().cast("array<string>"))
    for _ in range(depth - 1):
        value = F.flatten(F.filter(value, lambda x: x.isNotNull()))
    return F.coalesce(value, F.array().cast("array<string>"))


def as_str(values: Column, sep: str = " ") -> Column:
    """The strings of an array, trimmed and joined."""
    return F.trim(F.array_join(F.transform(values, trimmed), sep))


def decoded(text: Column) -> Column:
    """Character references decoded: the named ones of the HTML 4 table and `apos`, decimal and hexadecimal
    ones. What is no reference stays. Every one is decoded once, so `&amp;lt;` becomes `&lt;`."""
    names = F.expr("map(" + ", ".join(f"'{name};', '\\u{code:04x}'" for name, code in [*name2codepoint.items(), ("apos", 39)]) + ")")

    def piece(part: Column) -> Column:
        return let(_reference(part), lambda name: named(part, name))

    def named(part: Column, name: Column) -> Column:
        code = F.when(F.startswith(F.lower(name), F.lit("#x")), F.conv(F.regexp_extract(name, "([0-9a-fA-F]+);", 1), 16, 10)).when(F.startswith(name, F.lit("#")), F.regexp_extract(name, "([0-9]+)", 1)).try_cast("long")
        valid = lambda c: c.between(1, 0x10FFFF) & ~c.between(0xD800, 0xDFFF)
        number = let(code, lambda c: F.when(valid(c), F.decode(F.unhex(F.lpad(F.hex(c), 8, "0")), "UTF-32")))
        found = F.when(F.startswith(name, F.lit("#")), number).otherwise(F.try_element_at(names, name))
        return let(found, lambda to: F.when((name == "") | to.isNull(), part).otherwise(F.concat(to, F.substring(part, F.length(name) + 2, F.length(part)))))

    return let(text, lambda t: F.when(F.contains(t, F.lit("&")), F.array_join(F.transform(F.split(t, "(?=&)"), piece), "")).otherwise(t))


def _reference(part: Column) -> Column:
    """The character reference that a text begins with, less its `&`, or nothing."""
    return F.regexp_extract(part, r"^&(#[0-9]{1,8};|#[xX][0-9a-fA-F]{1,7};|[A-Za-z][A-Za-z0-9]*;)", 1)


def clean_str(text: Column, html: bool = False, optional: bool = False, max_length: int | None = None) -> Column:
    """The trimmed text, cut to a length before its tags go; an empty one is null unless optional."""
    text = F.trim(text)
    if max_length is not None:
        text = F.substring(text, 1, max_length)
    if not html:
        text = decoded(F.regexp_replace(text, r"<[^>]*>", ""))
    return text if optional else F.nullif(text, F.lit(""))


def parse_number(text: Column, as_int: bool = False, separator: str = ",", default: float | None = None) -> Column:
    """A number without ordinal endings and separators; k and m count thousands and millions."""
    plain = F.replace(F.regexp_replace(F.trim(text), "st|nd|rd|th", ""), F.lit(separator), F.lit(""))

    def scaled(plain: Column) -> Column:
        factor = F.when(F.endswith(plain, F.lit("k")), 1e3).when(F.endswith(plain, F.lit("m")), 1e6).otherwise(1.0)
        return F.regexp_replace(plain, "[km]$", "").try_cast("double") * factor

    number = let(plain, scaled)
    if as_int:
        number = let(number, lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double"))
    return number if default is None else F.coalesce(number, F.lit(float(default)))


def clean_int(field: Column, optional: bool = False, default: float | None = None, separator: str = ",") -> Column:
    """The whole number of a field's joined strings; what is none is the default (0 if optional), or null."""
    fallback = 0.0 if optional and default is None else default
    return parse_number(as_str(field, ""), True, separator, fallback if optional else None).cast("long")


def clean_float(field: Column, optional: bool = False, default: float | None = None, separator: str = ",") -> Column:
    """The number of a field's joined strings, as clean_int."""
    fallback = 0.0 if optional and default is None else default
    return parse_number(as_str(field, ""), False, separator, fallback if optional else None)


def clean_date(field: Column, asof: Column, day_first: bool = False) -> Column:
    """The date of a field's joined strings, or null."""
    return parse_date(as_str(field), asof, day_first)


def title_case(values: Column) -> Column:
    """Tags with a capital at each word."""
    return F.transform(values, lambda x: F.initcap(F.trim(x)))


def clean_list(values: Column, cleaner: Callable[[Column], Column] = trimmed, exclude: list[str] = (), max_length: int | None = None, optional: bool = False) -> Column:
    """Cleaned elements less the excluded ones, then cut; an empty list is null unless optional."""
    kept = F.filter(F.transform(values, cleaner), lambda x: ~x.isin(list(exclude)) if exclude else F.lit(True))
    if max_length is not None:
        kept = F.transform(kept, lambda x: F.substring(x, 1, max_length))
    return kept if optional else F.when(F.size(kept) > 0, kept)


def clean_enum(text: Column, allowed: list[str], translate: dict[str, str] | Callable[[Column], Column] | None = None, optional: bool = False) -> Column:
    """The translated (or upper-case) value if allowed; an unknown one is null, or stays if optional."""
    if isinstance(translate, dict):
        pairs = F.create_map(*(F.lit(x) for pair in translate.items() for x in pair))
        to = F.try_element_at(pairs, text)
        to = F.coalesce(to, text) if optional else to
    else:
        to = translate(text) if translate else F.upper(text)
    return to if optional else F.when(to.isin(allowed), to)


def parse_date(text: Column, asof: Column, day_first: bool = False) -> Column:
    """A date from relative words (against asof) or one of the known formats, else null."""
    return let(F.trim(text), lambda t: _date(t, asof, day_first))


def _date(text: Column, asof: Column, day_first: bool) -> Column:
    """The date of a trimmed text. What it begins or ends with tells which ways of reading it are tried."""
    number = F.coalesce(F.nullif(F.regexp_extract(text, r"(\d+)", 1), F.lit("")).cast("int"), F.lit(1))
    units = {"minute": F.make_dt_interval(mins=number), "hour": F.make_dt_interval(hours=number)}
    units |= {u: F.make_dt_interval(days=number * d) for u, d in (("day", 1), ("week", 7), ("month", 30), ("year", 365))}
    past = F.when(F.lit(False), F.to_date(asof))
    for unit, interval in units.items():
        past = past.when(text.rlike(rf"{unit}s? ago$"), F.to_date(asof - interval))
    found = F.when(F.startswith(text, F.lit("Today")), F.to_date(asof)).when(F.startswith(text, F.lit("Yesterday")), F.date_sub(F.to_date(asof), 1))
    # `$` also stands before a last line break.
    found = found.when(F.endswith(text, F.lit("now")), F.to_date(asof)).when(F.contains(text, F.lit(" ago")), past)
    tidied = F.regexp_replace(F.regexp_replace(text, r"(?i)(\d)\s*(am|pm)$", "$1$2"), r"(?i)^(.*, \d{4} \d\d:\d\d)(am|pm)$", "$1")
    timed = F.contains(text, F.lit(":"))

    def read(tidy: Column, formats: list[str]) -> list[Column]:
        dates = []
        for f in formats:
            date = F.to_date(F.try_to_timestamp(text if f.endswith("- hh:mm a") else tidy, F.lit("MMM d, yyyy HH:mm" if f == "MMM d, yyyy HH:mma" else f)))
            dates.append(F.when(timed, date) if ":" in f else date)
        return dates

    formats = [*DATE_FORMATS, "d/M/yyyy" if day_first else "M/d/yyyy"]
    worded = [f for f in formats if f.startswith("MMM")]
    iso = F.to_date(F.try_to_timestamp(F.regexp_extract(text, r"^(\d{4}-\d\d-\d\d)[T ]\d\d:\d\d:\d\d(?:\.\d+)?(?:\+00:00| UTC)$", 1), F.lit("yyyy-MM-dd")))
    numbered = lambda tidy: F.coalesce(*read(tidy, [f for f in formats if f not in worded]), F.when(timed, iso))
    absolute = let(tidied, lambda tidy: F.when(text.rlike("^[-+0-9]"), numbered(tidy)).otherwise(F.coalesce(*read(tidy, worded))))
    return F.coalesce(found, absolute)


def without_kind(name: Column) -> Column:
    """The name less its last word if it names a kind of publication."""
    words = F.split(name, " ")
    return F.when(name.rlike("|".join(KINDS)), F.array_join(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), " ")).otherwise(name)


def split_names(values: Column, sep: str = ";") -> Column:
    return F.filter(F.transform(F.flatten(F.transform(values, lambda x: F.split(x, sep))), trimmed), lambda x: x != "")


def first_page(url: Column) -> Column:
    return F.regexp_replace(url, r"[^/]+$|(?<=/)$", "1.html")


def without_zeros(text: Column) -> Column:
    return F.regexp_replace(text, r"\b00?", "")


def status_if(text: Column, word: str, yes: str, no: str) -> Column:
    return F.when(F.contains(text, F.lit(word)), yes).otherwise(no)


def direction(kind: Column, table: dict[str, str] = BY_KIND, default: str = "RL") -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in table.items() for x in p)), kind), F.lit(default))


def clean_rows(df: DataFrame, rules: dict[str, Column], required: list[str]) -> tuple[DataFrame, DataFrame]:
    """(clean, rejected): df with each rule's column; rows in which a required one is null go to
    `rejected` with the array `errors`, the names of what failed. The rules' columns are generated as one row's
    struct, as a filter on plain columns would be pushed below them and clean everything twice."""
    names = [*df.columns, *(r for r in rules if r not in df.columns)]
    others = [c for c in df.columns if c not in rules]
    done = df.select(*others, F.inline(F.array(F.struct(*(rule.alias(name) for name, rule in rules.items()))))).select(*names)
    errors = F.filter(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in required)), lambda e: e.isNotNull())
    checked = done.withColumn("errors", errors)
    return checked.where(F.size("errors") == 0).drop("errors"), checked.where(F.size("errors") > 0)


def tag_rules(names: str = "names") -> dict[str, Column]:
    """The plan of a source's tags."""
    return {names: clean_list(F.col(names), exclude=["All", "[no chapters]", ""])}


def issue_rules(get: Callable[[str], Column], asof: Column) -> dict[str, Column]:
    """The plan of an issue, over its raw fields (strings), which `get` gives by name."""
    return {
        "name": clean_str(get("name"), max_length=200, html=True), "number": F.coalesce(clean_str(get("number"), optional=True, max_length=10, html=True), F.lit("")),
        "order": parse_number(get("order"), True).cast("long"), "language": clean_enum(get("language"), LANGUAGES), "release": parse_date(get("release"), asof), "url": clean_str(get("url"), html=True),
    }


def clean_issues(issues: Column, asof: Column) -> Column:
    """An array of raw issues as cleaned ones; those that a required field rules out are dropped."""
    cleaned = F.transform(issues, lambda x: F.struct(*(c.alias(n) for n, c in issue_rules(lambda f: x[f], asof).items())))
    required = ("name", "order", "language", "release", "url")
    return F.filter(cleaned, lambda x: ~F.exists(F.array(*(x[f].isNull() for f in required)), lambda missing: missing))


def title_rules(asof: Column) -> dict[str, Column]:
    """The plan of a title's record, its issues cleaned inside it. A title none of whose issues is left
    is rejected as one without a name is."""
    issues = let(clean_issues(F.col("issues"), asof), lambda kept: F.when(F.size(kept) > 0, kept))
    return {
        "name": clean_str(F.col("name"), html=True), "alt_name": clean_list(F.col("alt_name"), exclude=[""], max_length=200, optional=True),
        "author": clean_str(F.col("author"), html=True, optional=True, max_length=200), "artist": clean_str(F.col("artist"), html=True, optional=True, max_length=200),
        "reading_direction": clean_enum(F.col("reading_direction"), ["LR", "RL"]), "status": clean_enum(F.col("status"), ["O", "C"], {"Ongoing": "O", "Completed": "C"}),
        "genres": clean_list(F.col("genres"), exclude=[""], max_length=200, optional=True), "rank": parse_number(F.col("rank"), True, default=0).cast("long"),
        "rank_order": clean_enum(F.col("rank_order"), ["ASC", "DESC"]), "description": clean_str(F.col("description"), optional=True),
        "issues": issues, "url": clean_str(F.col("url"), html=True),
    }


TITLE_REQUIRED = ["name", "reading_direction", "status", "rank_order", "issues", "url"]


def clean_titles(df: DataFrame, asof: Column) -> tuple[DataFrame, DataFrame]:
    """(clean, rejected) of raw title records with their issues."""
    return clean_rows(df, title_rules(asof), TITLE_REQUIRED)


def page_rules() -> dict[str, Column]:
    """The plan of an issue's page: its title and number are required."""
    return {"manga": clean_str(F.col("manga"), html=True), "issue": F.coalesce(clean_str(F.col("issue"), html=True, optional=True), F.lit("")), "number": parse_number(F.col("number"), True).cast("long")}


def dispatched(source: Column, rules: dict[str, Column], default: Column) -> Column:
    """The source's own rule for a field, or the default one."""
    chosen = None
    for name, rule in rules.items():
        chosen = F.when(source == name, rule) if chosen is None else chosen.when(source == name, rule)
    return default if chosen is None else chosen.otherwise(default)
