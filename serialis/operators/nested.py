"""Sync of records with their nested children: one join for a record and all its relations.

A relation is an array of children in the record's row. Two versions of it are compared by functions over
arrays: the children of both, tagged by side, are sorted by key, so that the versions of a child are
neighbours, and a pass over neighbours gives each child's action. No child leaves its row, so none is
shuffled, and the work in a row grows with its children but for the sort.
"""

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Relation:
    """An array of structs, the field that tells its children apart, and whether stored children that come no more go."""

    column: str
    key: str
    deletes: bool = True


@dataclass(frozen=True)
class Links:
    """An array of names; if `known` names an array column, only names in that are linked."""

    column: str
    known: str | None = None


def _both(old: Column, new: Column, key: str) -> Column:
    """The children of both versions by (key, side, place): stored ones before those that came."""
    tagged = lambda children, side: F.transform(F.coalesce(children, F.array()), lambda x, i: F.struct(x[key].alias("key"), F.lit(side).alias("side"), i.alias("place"), x.alias("child")))
    order = lambda x: F.struct(x["key"], x["side"], x["place"])
    return F.array_sort(F.concat(tagged(old, 0), tagged(new, 1)), lambda a, b: F.when(order(a) < order(b), -1).when(order(a) > order(b), 1).otherwise(0))


def _same_key(a: Column, b: Column) -> Column:
    return b["side"].isNotNull() & a["key"].eqNullSafe(b["key"])


def _last_of_side(both: str) -> Column:
    """A key that comes twice on one side is one child, the last."""
    after = lambda i: F.get(both, i + 1)
    return F.filter(both, lambda x, i: ~(_same_key(x, after(i)) & F.coalesce(after(i)["side"] == x["side"], F.lit(False))))


def _told(unique: str) -> Column:
    """(key, action, child, place) of every key: insert, update, keep or delete."""

    def told(x: Column, i: Column) -> Column:
        before, after = F.get(unique, i - 1), F.get(unique, i + 1)
        stored = (x["side"] == 0)
        came = F.when(~((i > 0) & _same_key(x, before)), "insert").when(before["child"].eqNullSafe(x["child"]), "keep").otherwise("update")
        return F.struct(x["key"].alias("key"), F.when(stored, F.when(_same_key(x, after), "").otherwise("delete")).otherwise(came).alias("action"), x["child"].alias("child"), x["place"].alias("place"))

    return F.filter(F.transform(unique, told), lambda a: a["action"] != "")


def child_actions(df: DataFrame, old: str, new: str, key: str, out: str) -> DataFrame:
    """df with `out`: an array of (key, action, child, place) of the children of two array columns. A null array is
    empty, a null key a key. Each step is a column of its own, which is computed once a row."""
    steps = df.withColumn(f"__{out}_both", _both(F.col(old), F.col(new), key))
    steps = steps.withColumn(f"__{out}_once", _last_of_side(f"__{out}_both"))
    return steps.withColumn(out, _told(f"__{out}_once")).drop(f"__{out}_both", f"__{out}_once")


def _children(actions: str, deletes: bool) -> Column:
    """The children after the sync: those that came in their order, then stored ones that stay."""
    left = F.filter(actions, lambda a: F.lit(not deletes) | (a["action"] != "delete"))
    order = lambda a: F.struct(a["action"] == "delete", a["place"])
    return F.transform(F.array_sort(left, lambda a, b: F.when(order(a) < order(b), -1).when(order(a) > order(b), 1).otherwise(0)), lambda a: a["child"])


def sync_records(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], columns: Sequence[str], relations: Sequence[Relation | Links], asof: Column, created: str = "created", seen: str = "modified", deletes: bool = False) -> DataFrame:
    """One row per record of either side: its keys, columns and relations after the sync, `created` and `seen`, its
    `action`, and for every relation `<column>_log`, an array of (key, action).

    stored and incoming hold keys, columns and relations, stored also created and seen. A null in an incoming
    column leaves the stored value, as records come with some fields only; a null array has no children. A
    record that came is an insert, an update if a column or child changed, else a keep, and is seen
    at asof. One that came no more is `absent` and as it was, or with `deletes` a delete, whose row is for the
    log. Repeated keys of records are the caller's to remove. An empty side gives the other.
    """
    old = stored.select(*keys, *(F.col(c).alias(f"__old_{c}") for c in [*columns, *(r.column for r in relations), created, seen]), F.lit(True).alias("__stored"))
    known = [r.known for r in relations if isinstance(r, Links) and r.known]
    rows = incoming.select(*keys, *columns, *(r.column for r in relations), *known, F.lit(True).alias("__came")).join(old, list(keys), "full_outer")
    rows = rows.withColumns({"__came": F.coalesce("__came", F.lit(False)), "__stored": F.coalesce("__stored", F.lit(False))})
    changed = F.lit(False)
    out: dict[str, Column] = {}
    for c in columns:
        changed = changed | (F.col(c).isNotNull() & ~F.col(c).eqNullSafe(F.col(f"__old_{c}")))
        out[c] = F.coalesce(c, f"__old_{c}")
    for r in relations:
        before, log = f"__old_{r.column}", f"{r.column}_log"
        if isinstance(r, Links):
            names = F.array_distinct(F.coalesce(F.col(r.column), F.array()))
            names = F.array_intersect(names, F.coalesce(F.col(r.known), F.array())) if r.known else names
            pair = lambda side: F.transform(side, lambda x: F.struct(x.alias("name")))
            rows = rows.withColumn(r.column, names).withColumns({f"__new_{r.column}": pair(F.col(r.column)), f"__was_{r.column}": pair(F.coalesce(F.col(before), F.array()))})
            rows = child_actions(rows, f"__was_{r.column}", f"__new_{r.column}", "name", log).drop(f"__new_{r.column}", f"__was_{r.column}")
            out[r.column] = F.when(F.col("__came"), F.col(r.column)).otherwise(F.col(before))
        else:
            rows = child_actions(rows, before, r.column, r.key, log)
            out[r.column] = F.when(F.col("__came"), _children(log, r.deletes)).otherwise(F.col(before))
        stays = isinstance(r, Relation) and not r.deletes
        told_of = F.filter(log, lambda a: a["action"] != "delete") if stays else F.col(log)
        changed = changed | F.exists(told_of, lambda a: a["action"] != "keep")
        out[log] = F.when(F.col("__came") | F.lit(deletes), F.transform(told_of, lambda a: F.struct(a["key"].alias("key"), a["action"].alias("action")))).otherwise(F.array())
    action = F.when(~F.col("__came"), F.lit("delete" if deletes else "absent")).when(~F.col("__stored"), "insert").when(changed, "update").otherwise("keep")
    told = rows.withColumn("action", action)
    asof_or_old = {created: F.coalesce(f"__old_{created}", asof), seen: F.when(F.col("__came"), asof).otherwise(F.col(f"__old_{seen}"))}
    return told.select(*keys, *(x.alias(n) for n, x in {**out, **asof_or_old}.items()), "action")


def table_of(synced: DataFrame) -> DataFrame:
    """The records after the sync, without its log."""
    return synced.where("action <> 'delete'").drop("action", *(c for c in synced.columns if c.endswith("_log")))
