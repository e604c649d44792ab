"""Urls, titles, names and log classes over columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use) -> Column:
    """use(value) with the value computed once, however often it is used: what repeats within functions
    over arrays is not shared otherwise."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _without_dots(url: Column) -> Column:
    """A url whose path has no `.` and `..` segments left; query and fragment stay."""

    def step(kept: Column, part: Column) -> Column:
        parent = F.when(F.size(kept) > 1, F.slice(kept, 1, F.size(kept) - 1)).otherwise(kept)
        return F.when(part == "..", parent).when(part == ".", kept).otherwise(F.concat(kept, F.array(part)))

    def resolved(path: Column) -> Column:
        parts = F.split(path, "/")
        kept = F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.slice(parts, 1, 1), step)
        # A path that ends in dots is a folder.
        return F.concat(F.array_join(kept, "/"), F.when(path.rlike(r"/\.\.?$"), "/").otherwise(""))

    head, path, tail = (F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*|)([^?#]*)(.*)$", k) for k in (1, 2, 3))
    return F.when(url.rlike(r"^[^?#]*/\.\.?([/?#]|$)"), F.concat(head, let(path, resolved), tail)).otherwise(url)


def url_parts(base: Column) -> Column:
    """(scheme, origin, path, folder, page) of a page's url, for `absolute_url` of many links."""
    origin = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_replace(base, r"[?#].*$", "")
    folder = F.when(path == origin, F.concat(origin, F.lit("/"))).otherwise(F.regexp_replace(path, r"[^/]*$", ""))
    return F.struct(F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1).alias("scheme"), origin.alias("origin"), path.alias("path"), folder.alias("folder"), F.regexp_replace(base, "#.*$", "").alias("page"), base.alias("base"))


def absolute_url(base: Column, link: Column, parts: Column | None = None) -> Column:
    """A link as seen from a page, dot segments resolved; `parts` are the page's, if they are at hand."""
    at = url_parts(base) if parts is None else parts

    def joined(link: Column) -> Column:
        return (
            F.when(F.startswith(link, F.lit("//")), F.concat(at["scheme"], link)).when(F.startswith(link, F.lit("/")), F.concat(at["origin"], link)).when(F.startswith(link, F.lit("?")), F.concat(at["path"], link))
            .when(F.startswith(link, F.lit("#")), F.concat(at["page"], link)).when(link == "", at["base"]).otherwise(F.concat(at["folder"], link))
        )

    return let(link, lambda x: F.when(x.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), x).otherwise(let(joined(x), _without_dots)))


def file_name(url: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(url, r"[?#].*$", ""), "/"), -1)


def _quoted(text: Column) -> Column:
    return F.concat(F.lit("\\Q"), F.replace(text, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def display_title(title: Column, issue: Column, number: Column, multiple: Column | None = None, volume: Column | None = None, total: Column | None = None) -> Column:
    """Title, number padded to three digits before its fraction and letter, volume of how many, and
    what the issue's name says besides them. A letter alone counts as number 0; without a number
    the title stands alone."""
    marks = r"Vol\.?\s*[\d.]+|Ch\.?\s*[\d.]+|:|-"
    lead = F.concat(F.lit(rf"(?i)^(?:\s*(?:{marks}|"), _quoted(title), F.when(number != "", F.concat(F.lit("|"), _quoted(number))).otherwise(F.lit("")), F.lit(r"))+\s*"))
    rest = F.trim(F.regexp_replace(issue, lead, F.lit("")))
    whole, part, letter = (F.regexp_extract(number, r"^(\d*)((?:\.\d+)?)([^\d.]?)$", k) for k in (1, 2, 3))
    fits = number.rlike(r"^(\d+(\.\d+)?[^\d.]?|[^\d.])$")
    padded = F.concat(F.lpad(whole, F.greatest(F.lit(3), F.length(whole)), F.lit("0")), part, letter)
    shown = F.when(number == "", title).otherwise(F.concat(title, F.lit(" "), F.when(fits, padded).otherwise(number)))
    if multiple is not None:
        shown = F.when(multiple, F.concat(shown, F.format_string(" (%02d/%02d)", volume, total))).otherwise(shown)
    return F.when(rest == "", shown).otherwise(F.concat(shown, F.lit(": "), rest))


def content_key(url: Column, part: Column | None = None) -> Column:
    key = F.md5(url.cast("binary"))
    return key if part is None else F.concat(key, F.format_string("-%02d", part))


def safe_name(name: Column, ending: str = ".mobi") -> Column:
    return F.concat(F.regexp_replace(name, r"(?U)\W", "_"), F.lit(ending))


def document_facts(language: Column, direction: Column, author: Column, publisher: Column) -> Column:
    """What a written document says of itself: language, writing mode, author, and its source as publisher."""
    return F.struct(F.lower(language).alias("language"), F.concat(F.lit("horizontal-"), F.lower(direction)).alias("writing_mode"), author.alias("author"), publisher.alias("publisher"))


def fetch_status(status: Column, partial: Column, error_codes: list[int]) -> Column:
    """The status of a fetch; one that came in part without an error counts as 500."""
    return F.when(partial & ~status.isin(error_codes), 500).otherwise(status)


def drops_endpoint(status: Column, partial: Column, valid: Column, through_endpoint: Column) -> Column:
    """Whether the endpoint of a fetch should go: it was used, and the answer failed, came in part or
    leads elsewhere."""
    return through_endpoint & ((status >= 400) | partial | (status.between(300, 399) & ~valid))


def valid_redirect(status: Column, url: Column, target: Column) -> Column:
    """Whether a redirect leads to the same page: 3xx, the same file name, ending in .html."""
    return status.between(300, 399) & (file_name(url) == file_name(target)) & F.endswith(target, F.lit(".html"))


def valid_body(body: Column, needed: list[str], forbidden: list[str]) -> Column:
    """Every needed text present and no forbidden one; without either list no body is valid."""
    if not needed and not forbidden:
        return F.lit(False)
    good = F.lit(True)
    for text in needed:
        good = good & F.contains(body, F.lit(text))
    for text in forbidden:
        good = good & ~F.contains(body, F.lit(text))
    return good


def is_error_line(line: Column) -> Column:
    return line.rlike(r"\bERROR\b|^Traceback \(most recent call last\)")
