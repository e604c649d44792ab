"""Records from raw pages, by a table of patterns per source."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from serialis.functions.cleaning import decoded, trimmed
from serialis.functions.text import absolute_url, url_parts


@dataclass(frozen=True)
class Rule:
    """A field: the pattern whose group 1 it is, all matches or the first, and a separator to split at."""

    pattern: str
    every: bool = False
    split: str | None = None


def labelled(label: str, **kwargs) -> Rule:
    """The cell behind a table cell that holds a label."""
    return Rule(rf"(?s)<td[^>]*>\s*{label}\s*</td>\s*<td[^>]*>(.*?)</td>", **kwargs)


# The markup of the pages table, of title pages with labelled fields, and texts of pages without a record.
RULES = {
    "title": Rule(r"(?s)<title>(.*?)</title>"),
    "heading": Rule(r"(?s)<h1>(.*?)</h1>"),
    "links": Rule(r'<li><a href="([^"]*)"', every=True),
    "labels": Rule(r'<li><a href="[^"]*">([^<]*)</a>', every=True),
    "paragraphs": Rule(r"(?s)<p>(.*?)</p>", every=True),
}
TITLE_RULES = {
    "name": Rule(r'(?s)<h2 class="aname">(.*?)</h2>'), "alt_name": labelled("Alternate Name:", every=True, split="[,;]"), "author": labelled("Author:"), "artist": labelled("Artist:"),
    "reading": labelled("Reading Direction:"), "status": labelled("Status:"), "genres": Rule(r'(?s)<span class="genretags">(.*?)</span>', every=True),
    "description": Rule(r'(?s)<div id="readmangasum">.*?<p>(.*?)</p>'), "images": Rule(r'<div id="mangaimg">\s*<img[^>]*\bsrc="([^"]*)"', every=True),
}
TITLE_ISSUE, TITLE_LABEL = Rule(r'(?s)<tr class="issue">\s*<td><a href="([^"]*)"'), Rule(r'(?s)<tr class="issue">\s*<td><a [^>]*>(.*?)</a>')
TITLE_RELEASE = Rule(r'(?s)<tr class="issue">.*?</td>\s*<td>(.*?)</td>', every=True)
SKIPPED = ["has been licensed", "404 Not Found", "no chapters"]


def plain(html: Column) -> Column:
    return F.trim(decoded(F.regexp_replace(html, r"<[^>]*>", "")))


def field(html: Column, rule: Rule) -> Column:
    if not rule.every:
        return plain(F.regexp_extract(html, rule.pattern, 1))
    found = F.transform(F.regexp_extract_all(html, F.lit(rule.pattern), F.lit(1)), plain)
    if rule.split:
        found = F.filter(F.transform(F.flatten(F.transform(found, lambda x: F.split(x, rule.split))), trimmed), lambda x: x != "")
    return found


def extract(pages: DataFrame, html: str, rules: dict[str, Rule] = RULES, skipped: list[str] = SKIPPED) -> DataFrame:
    """pages with a column per rule, less pages to skip."""
    kept = pages
    for text in skipped:
        kept = kept.where(~F.coalesce(F.contains(F.col(html), F.lit(text)), F.lit(False)))
    return kept.withColumns({name: field(F.col(html), rule) for name, rule in rules.items()})


def link_rows(pages: DataFrame, key: str, url: str, html: str, rule: Rule = RULES["links"]) -> DataFrame:
    """(key, order, link): links as absolute urls, numbered from the last, as listings are newest first."""
    found = pages.select(key, F.col(url).alias("__url"), url_parts(F.col(url)).alias("__at"), F.regexp_extract_all(F.col(html), F.lit(rule.pattern), F.lit(1)).alias("__links"))
    each = found.select(key, "__url", "__at", F.size("__links").alias("__n"), F.posexplode("__links").alias("__pos", "__link"))
    return each.select(key, (F.col("__n") - F.col("__pos")).alias("order"), absolute_url(F.col("__url"), F.col("__link"), F.col("__at")).alias("link"))


def until(rows: DataFrame, page: str, date: str, limit: Column, *within: str) -> DataFrame:
    """All rows of the pages up to and including the first whose oldest date lies before the limit."""
    earlier = Window.partitionBy(*within).orderBy(page).rangeBetween(Window.unboundedPreceding, -1)
    oldest = F.min(date).over(earlier)
    return rows.withColumn("__oldest", oldest).where(F.col("__oldest").isNull() | (F.col("__oldest") >= limit)).drop("__oldest")


def issue_number(text: Column) -> Column:
    """The number in an issue's name: after Ch. or Cap., or the last one."""
    marked = F.regexp_extract(text, r"(?:Ch|Cap)\.\s*(\d+(?:\.\d+)?)", 1)
    return F.coalesce(F.nullif(marked, F.lit("")), F.nullif(F.regexp_extract(text, r"(\d+(?:\.\d+)?)\s*$", 1), F.lit("")))


def next_page(html: Column, url: Column, rel: str = "next") -> Column:
    """The absolute url of the link to the next page, or null: the first link marked so, or named so by an arrow."""
    marked = F.regexp_extract(html, rf'<(?:a|link)\b[^>]*\brel="{rel}"[^>]*\bhref="([^"]*)"', 1)
    after = F.regexp_extract(html, rf'<(?:a|link)\b[^>]*\bhref="([^"]*)"[^>]*\brel="{rel}"', 1)
    named = F.regexp_extract(html, r'<a\b[^>]*\bhref="([^"]*)"[^>]*>\s*(?:&gt;|>|›|»)\s*</a>', 1)
    link = F.coalesce(*(F.nullif(x, F.lit("")) for x in (marked, after, named)))
    return F.when(link.isNotNull(), absolute_url(url, decoded(link)))


def title_records(pages: DataFrame, url: str, html: str, rules: dict[str, Rule], issue: Rule, label: Rule, skipped: list[str] = SKIPPED) -> DataFrame:
    """A record per page: its fields by the rules, and `issues`, an array of (name, number, order, url)
    numbered from the last, as listings are newest first."""
    found = extract(pages, html, rules, skipped)
    links, labels = (F.regexp_extract_all(F.col(html), F.lit(r.pattern), F.lit(1)) for r in (issue, label))
    pairs = found.withColumns({"__pairs": F.arrays_zip(links.alias("link"), labels.alias("label")), "__at": url_parts(F.col(url))})
    count = F.size("__pairs")

    def one(pair: Column, at: Column) -> Column:
        name = plain(pair["label"])
        return F.struct(name.alias("name"), issue_number(name).alias("number"), (count - at).alias("order"), absolute_url(F.col(url), decoded(pair["link"]), F.col("__at")).alias("url"))

    return pairs.withColumn("issues", F.transform("__pairs", one)).drop("__pairs", "__at")


def labelled_records(pages: DataFrame, url: str, html: str) -> DataFrame:
    """A record per page of a title, with all its labelled fields as raw values for `cleaning`: name, alt_name, author,
    artist, reading_direction (RL where the page says right to left, else LR), status, genres, description, image_urls
    (absolute), issues (name, number, order, url, release) and url."""
    found = title_records(pages, url, html, TITLE_RULES, TITLE_ISSUE, TITLE_LABEL)
    releases = field(F.col(html), TITLE_RELEASE)
    issues = F.transform("issues", lambda x, i: x.withField("release", F.get(F.col("__releases"), i)))
    absolute = F.transform("images", lambda x: absolute_url(F.col(url), x, F.col("__at")))
    told = found.withColumns({"__releases": releases, "__at": url_parts(F.col(url))}).withColumns({"issues": issues, "image_urls": absolute, "reading_direction": F.when(F.col("reading") == "Right to Left", "RL").otherwise("LR")})
    return told.drop("__releases", "__at", "images", "reading")


def page_images(pages: DataFrame, key: str, number: str, url: str, html: str, rule: Rule) -> DataFrame:
    """(key, number, image_urls): the images of an issue's pages, as absolute urls."""
    found = F.transform(F.regexp_extract_all(F.col(html), F.lit(rule.pattern), F.lit(1)), lambda x: absolute_url(F.col(url), decoded(x)))
    return pages.select(key, number, found.alias("image_urls"))


def ranked_titles(titles: DataFrame, ranks: DataFrame, key: str, rank: str, scale: float = 1.0) -> DataFrame:
    """Titles with the rank that another listing gives them, scaled; without one, null."""
    given = ranks.groupBy(F.col(key).alias("__key")).agg(F.min(rank).alias("__rank"))
    return titles.join(given, F.col(key) == F.col("__key"), "left").withColumn(rank, F.col("__rank") * scale).drop("__key", "__rank")
