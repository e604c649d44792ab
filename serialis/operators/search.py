"""Full-text search: weighted tokens, a small query language, and ranked pages.

A query's words are prefixes; `and`, `or`, `not` (lower case) and parentheses combine them, and words
side by side must all match. It becomes one Column, so a search is a filter. The rank is the
sum over the query's words of 1.0 for each matching name token and 0.1 for each matching body one.
"""

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from serialis.operators.listing import joined_names


#: What a matching token of the name, and one of another field, adds to a rank.
NAME, BODY = 1.0, 0.1


def spaced(text: Column) -> Column:
    """The text's tokens, joined by a space."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def _starts(word: str):
    return lambda token: F.startswith(token, F.lit(word))


def _weighted(weight: float):
    return lambda token: F.struct(token.alias("term"), F.lit(weight).alias("weight"))


def postings(df: DataFrame, key: str, name: str, *body: str) -> DataFrame:
    """(key, term, weight, tf): the search table, rebuilt by a job."""
    fields = [(name, NAME), *((b, BODY) for b in body)]
    each = F.flatten(F.array(*(F.transform(tokens(F.col(f)), _weighted(w)) for f, w in fields)))
    return df.select(key, F.explode(each).alias("p")).groupBy(key, "p.term", "p.weight").agg(F.count(F.lit(1)).alias("tf"))


def _lexed(query: str) -> list[str]:
    return re.findall(r"[()]|[^\W_]+", query)


def predicate(query: str, has) -> Column:
    """The query as a condition; has(word) is the condition for one word. A malformed query, with
    parentheses that don't match or an operator without its words, raises ValueError."""
    rest = _lexed(query)

    def either() -> Column:
        found = both()
        while rest and rest[0] == "or":
            rest.pop(0)
            found = found | both()
        return found

    def both() -> Column:
        found = one()
        while rest and rest[0] not in (")", "or"):
            if rest[0] == "and":
                rest.pop(0)
            found = found & one()
        return found

    def one() -> Column:
        if not rest or rest[0] in (")", "and", "or"):
            raise ValueError(f"a word is missing in: {query}")
        word = rest.pop(0)
        if word == "not":
            return ~one()
        if word == "(":
            found = either()
            if not rest or rest.pop(0) != ")":
                raise ValueError(f"a parenthesis is open in: {query}")
            return found
        return has(word.lower())

    found = either()
    if rest:
        raise ValueError(f"a parenthesis is closed twice in: {query}")
    return found


def words(query: str) -> list[str]:
    """The distinct words of a query, lower case."""
    return list(dict.fromkeys(w.lower() for w in _lexed(query) if w not in ("and", "or", "not", "(", ")")))


def under(word: str) -> Column:
    """Whether `term` begins with a word; the range of terms reaches the scan."""
    return (F.col("term") >= word) & F.startswith("term", F.lit(word))


def is_valid(query: str) -> bool:
    try:
        predicate(query, lambda _: F.lit(True))
    except ValueError:
        return False
    return True


def matches(df: DataFrame, query: str, name: str, *body: str) -> DataFrame:
    """Rows that match, with `rank`."""
    named, other = tokens(F.col(name)), F.flatten(F.array(*(tokens(F.col(b)) for b in body)))
    prepared = df.withColumns({"__name": named, "__body": other})
    condition = predicate(query, lambda w: F.exists("__name", _starts(w)) | F.exists("__body", _starts(w)))
    rank = F.lit(0.0)
    for w in words(query):
        hits = [F.size(F.filter(c, _starts(w))) for c in ("__name", "__body")]
        rank = rank + hits[0] * 1.0 + hits[1] * 0.1
    return prepared.where(condition).withColumn("rank", rank).drop("__name", "__body")


def from_postings(found: DataFrame, docs: DataFrame, query: str, key: str) -> DataFrame:
    """(key, rank): documents that match, from their postings. Only postings under the query's prefixes
    are read, as ranges of terms, and summed by document in one pass; texts are not. Documents
    without any of the words take part only in a query that they can match."""
    terms = words(query)
    within = F.lit(False)
    for w in terms:
        within = within | under(w)
    sums = [F.sum(F.when(under(w), F.col("weight") * F.col("tf")).otherwise(0.0)).alias(f"__{i}") for i, w in enumerate(terms)]
    hits = found.where(within).groupBy(key).agg(*sums)
    has = lambda w: F.col(f"__{terms.index(w)}") > 0
    if matches_without_words(query):
        hits = docs.select(key).join(hits, key, "left").fillna(0.0, [f"__{i}" for i in range(len(terms))])
    rank = F.lit(0.0)
    for i in range(len(terms)):
        rank = rank + F.col(f"__{i}")
    return hits.where(predicate(query, has)).select(key, rank.alias("rank"))


def matches_without_words(query: str) -> bool:
    """Whether a document with none of the words matches."""

    class Flag(int):
        def __and__(self, other):
            return Flag(int(self) and int(other))

        def __or__(self, other):
            return Flag(int(self) or int(other))

        def __invert__(self):
            return Flag(not int(self))

    return bool(predicate(query, lambda _: Flag(0)))


def title_documents(titles: DataFrame, alternatives: DataFrame, sources: DataFrame, key: str, name: str, source: str) -> DataFrame:
    """The search table's documents: each title with its alternative names in one string, and its source's
    facts."""
    return joined_names(titles, alternatives, key, "alternative", "alternatives").join(sources, source)


def ranked_page(ranks: DataFrame, docs: DataFrame, key: str, name: str, offset: int = 0, limit: int = 25) -> DataFrame:
    """A page of ranked documents: best first, then by name and key. Keys, names and ranks are sorted; the
    full rows are joined to the page and sorted again."""
    named = ranks.join(docs.select(key, name), key)
    top = named.orderBy(F.desc("rank"), name, key).offset(offset).limit(limit).select(F.col(key).alias("__key"), "rank")
    return docs.join(F.broadcast(top), docs[key] == F.col("__key")).drop("__key").orderBy(F.desc("rank"), name, key)


def search(df: DataFrame, query: str, key: str, name: str, *body: str, offset: int = 0, limit: int = 25) -> DataFrame:
    """A ranked page of the documents that match, through postings made of them on the way. Where a
    saved postings table is at hand, take `from_postings` and `ranked_page` with that."""
    ranks = from_postings(postings(df, key, name, *body), df, query, key).withColumn("rank", F.round("rank", 6))
    return ranked_page(ranks, df, key, name, offset, limit)


def hits(df: DataFrame, query: str, key: str, name: str, *body: str) -> DataFrame:
    """How many documents match."""
    return from_postings(postings(df, key, name, *body), df, query, key).agg(F.count(F.lit(1)).alias("n"))


def browse(df: DataFrame, query: str | None, newest: DataFrame, key: str, name: str, *body: str, offset: int = 0, limit: int = 25) -> DataFrame:
    """A page of search results for a valid query, else a page of the newest list."""
    if query and is_valid(query):
        return search(df, query, key, name, *body, offset=offset, limit=limit)
    return newest.offset(offset).limit(limit)
