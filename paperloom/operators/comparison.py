"""Comparison of two versions of a document: segments, JSON, cells and lines.

Cells and lines are matched by key and place; messages are joined by key, and those of their segments that differ are numbered where the
message stands and brought together by place. What is compared within a place is nested.
A change is (path, kind, left, right), kind being added, removed or changed.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from paperloom.sources.segments import bound, cut

CHANGES = "array<struct<path:string,kind:string,left:string,right:string>>"
FLAT = "array<struct<path:string,value:string>>"
#: What a path gains when its element gains a repetition or a component.
SUFFIXES = ["~1", ".1"]


def _renamed(mine: Column, theirs: Column, suffix: str) -> Column:
    """Paths that the other side has only with the suffix take it."""
    paths = F.transform(theirs, lambda y: y["path"])

    def one(x: Column) -> Column:
        longer = F.concat(x["path"], F.lit(suffix))
        return F.struct(F.when(~F.array_contains(paths, x["path"]) & F.array_contains(paths, longer), longer).otherwise(x["path"]).alias("path"), x["value"].alias("value"))

    return F.transform(mine, one)


def _changes(left: Column, right: Column) -> Column:
    def of(side: Column, path: Column) -> Column:
        return F.get(F.filter(side, lambda y: y["path"] == path), 0)["value"]

    def change(path: Column, kind: Column, a: Column, b: Column) -> Column:
        return F.struct(path.alias("path"), kind.alias("kind"), a.alias("left"), b.alias("right"))

    none = F.lit(None).cast("string")
    lost = F.transform(left, lambda x: change(x["path"], F.when(of(right, x["path"]).isNull(), "removed").otherwise("changed"), x["value"], of(right, x["path"])))
    lost = F.filter(lost, lambda c: ~c["left"].eqNullSafe(c["right"]))
    new = F.filter(right, lambda y: ~F.exists(left, lambda x: x["path"] == y["path"]))
    return F.concat(lost, F.transform(new, lambda y: change(y["path"], F.lit("added"), none, y["value"])))


def _compared(rows: DataFrame) -> DataFrame:
    """Rows with l and r, flat lists of (path, value), and their changes, once the paths are aligned."""
    left, right = "__l", "__r"
    for i, suffix in enumerate(SUFFIXES):
        rows = bound(rows, **{f"__l{i}": _renamed(F.col(left), F.col(right), suffix)})
        left = f"__l{i}"
        rows = bound(rows, **{f"__r{i}": _renamed(F.col(right), F.col(left), suffix)})
        right = f"__r{i}"
    return bound(rows, __changes=_changes(F.col(left), F.col(right)))


def _kept(changes: DataFrame, key: str, ignore: list[str]) -> DataFrame:
    out = changes.select(key, F.explode("__changes").alias("c")).select(key, "c.*")
    for prefix in ignore:
        out = out.where(~F.col("path").startswith(prefix))
    return out


def compared_flats(left: DataFrame, right: DataFrame, key: str, ignore: list[str] | None = None) -> DataFrame:
    """(key, path, kind, left, right) of two tables (key, path, value) whose paths are unique by key.

    Paths that differ in a last ~1 or .1 only are grouped, so that a group holds a few rows whatever a document's size.
    """
    side = lambda df, own: df.select(key, "path", "value", F.lit(own).alias("__left"))
    rows = side(left, True).unionByName(side(right, False)).withColumn("__root", F.regexp_replace("path", r"([~.]1)+$", ""))
    pair = F.struct("path", "value")
    both = rows.groupBy(key, "__root").agg(F.collect_list(F.when(F.col("__left"), pair)).alias("__l"), F.collect_list(F.when(~F.col("__left"), pair)).alias("__r"))
    return _kept(_compared(both), key, ignore or [])


def _places(segments: Column) -> Column:
    """(seg, idx, tag, fields) of each segment: under its tag and its number among those of the tag, told where the message stands."""
    tags = F.transform(segments, lambda s: s["tag"])
    listed = F.array_distinct(tags)
    ranks = F.flatten(F.transform(listed, lambda t: F.transform(F.filter(segments, lambda s: s["tag"] == t), lambda s, k: F.struct(s["idx"].alias("idx"), F.concat(t, F.lit("["), k.cast("string"), F.lit("]")).alias("seg"), t.alias("tag"), s["fields"].alias("fields")))))
    return F.array_sort(ranks)


def _flat(place: Column, tag: Column, fields: Column, separators: Column | None) -> Column:
    """The values of a segment under their paths; blank ones, and the delimiters in MSH, are left out."""

    def parts(field: Column, i: Column) -> Column:
        base = F.concat(place, F.lit("-"), (i + 1).cast("string"))
        if separators is None:
            return F.array(F.struct(base.alias("path"), field.alias("value")))
        repeats = cut(field, separators["repeat"])

        def repeat(x: Column, r: Column) -> Column:
            own = F.when(F.size(repeats) > 1, F.concat(base, F.lit("~"), (r + 1).cast("string"))).otherwise(base)
            pieces = cut(x, separators["component"])
            return F.transform(pieces, lambda c, m: F.struct(F.when(F.size(pieces) > 1, F.concat(own, F.lit("."), (m + 1).cast("string"))).otherwise(own).alias("path"), c.alias("value")))

        return F.when((tag == "MSH") & (i < 2), F.lit(None).cast(FLAT)).otherwise(F.flatten(F.transform(repeats, repeat)))

    return F.filter(F.flatten(F.filter(F.transform(fields, parts), lambda x: x.isNotNull())), lambda x: x["value"] != "")


def compared_segments(left: DataFrame, right: DataFrame, segments: Column, key: str, separator: Column, separators: str | None = None, ignore: list[str] | None = None, numbered: bool = False) -> DataFrame:
    """(key, path, kind, left, right) of two tables of messages, one a key.

    ``separator`` joins the text of a segment that is added or removed whole; ``separators`` names the column of HL7
    delimiters by which fields are taken apart (each side by its own), none for formats that compare by element. Paths that start with
    one of ``ignore`` are left out. ``numbered`` adds ``n``, the change's place in its message: values as the left message has them,
    values that only the right one has, segments that are gone, then segments that are new.
    """
    keep = [] if separators is None else [F.col(separators)]
    own_of = lambda df: [c for c in df.columns if c != key]
    met = lambda df, name: df.select(key, F.struct(*own_of(df)).alias(name))
    # messages meet as they are: only those that differ are read, and of them, segments that are the same at the same number are left out
    rows = met(left, "__m").join(met(right, "__o"), key, "full_outer").where(~F.col("__m").eqNullSafe(F.col("__o")))
    for df, name, other in ((left, "__m", "__o"), (right, "__o", "__m")):
        rows = bound(rows.select(key, other, *[F.col(name)[c].alias(c) for c in own_of(df)]), __s=segments)
        rows = rows.select(key, other, F.when(F.col("__s").isNotNull(), F.struct("__s", separator.alias("__c"), *keep)).alias(name))
    for mine, placed in (("__m", "__p"), ("__o", "__q")):
        rows = bound(rows, **{placed: F.coalesce(_places(F.col(mine)["__s"]), F.expr("cast(array() as array<struct<idx:int,seg:string,tag:string,fields:array<string>>>)"))})
    alike = F.lit(True) if separators is None else F.col("__m")[separators].eqNullSafe(F.col("__o")[separators])
    own = lambda x: F.struct(x["seg"], x["fields"])

    def side(s: Column, of: str) -> Column:
        c, d = F.col(of)["__c"], None if separators is None else F.col(of)[separators]
        return F.when(s.isNotNull(), F.struct(s["idx"].alias("idx"), F.concat(s["tag"], c, F.call_function("array_join", s["fields"], c)).alias("raw"), _flat(s["seg"], s["tag"], s["fields"], d).alias("flat")))

    pairs = F.filter(F.zip_with("__p", "__q", lambda x, y: F.struct(x.alias("x"), y.alias("y"))), lambda z: ~(alike & own(z["x"]).eqNullSafe(own(z["y"]))))
    listed = lambda n, of: F.filter(F.transform("__pairs", lambda z: F.struct(z[n]["seg"].alias("seg"), F.lit(n).alias("of"), side(z[n], of).alias("own"))), lambda z: z["seg"].isNotNull())
    rows = bound(rows, __pairs=pairs)
    rows = rows.select(key, F.explode(F.concat(listed("x", "__m"), listed("y", "__o"))).alias("z"))
    mine = lambda n: F.first(F.when(F.col("z.of") == n, F.col("z.own")), True)
    both = rows.groupBy(key, F.col("z.seg").alias("__seg")).agg(mine("x").alias("__a"), mine("y").alias("__b"))  # two at most
    none = F.lit(None).cast("string")
    whole = F.array(F.struct(F.col("__seg").alias("path"), F.when(F.col("__b").isNull(), "removed").otherwise("added").alias("kind"), F.coalesce("__a.raw", none).alias("left"), F.coalesce("__b.raw", none).alias("right")))
    empty = F.expr(f"cast(array() as {FLAT})")
    paired = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    both = bound(both, __l=F.when(paired, F.col("__a.flat")).otherwise(empty), __r=F.when(paired, F.col("__b.flat")).otherwise(empty))
    done = _compared(both).withColumn("__changes", F.when(paired, F.col("__changes")).otherwise(whole.cast(CHANGES)))
    if not numbered:
        return _kept(done, key, ignore or [])
    # in which of the four parts a change stands, the segment's place in its message, and the change's place in its segment
    at = done.select(key, paired.alias("__both"), F.coalesce("__a.idx", "__b.idx").alias("__left"), F.coalesce("__b.idx", "__a.idx").alias("__right"), F.posexplode("__changes").alias("__k", "c"))
    added = F.col("c.kind") == "added"
    part = F.when(F.col("__both"), added.cast("int")).otherwise(2 + added.cast("int"))
    at = at.select(key, F.struct(part.alias("part"), F.when(added, F.col("__right")).otherwise(F.col("__left")).alias("idx"), F.col("__k").alias("k")).alias("__at"), "c.*")
    for prefix in ignore or []:
        at = at.where(~F.col("path").startswith(prefix))
    changes = at.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("__at", "path", "kind", "left", "right"))).alias("__all"))  # of one message
    return changes.select(key, F.posexplode("__all").alias("n", "c")).select(key, "n", "c.path", "c.kind", "c.left", "c.right")


def _walk(path: str, left, right) -> Iterator[tuple]:
    """Changes between two JSON values; a change of kind is told where it happens."""
    show = lambda v: v if isinstance(v, str) else json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    if type(left) is not type(right) or not isinstance(left, (dict, list)):
        if type(left) is not type(right) or left != right:
            yield path or "/", "changed", show(left), show(right)
        return
    if isinstance(left, list):
        left, right = dict(enumerate(left)), dict(enumerate(right))
    for key in [*sorted(left), *sorted(right.keys() - left.keys())]:
        own = f"{path}/{str(key).replace('~', '~0').replace('/', '~1')}"
        if key not in right:
            yield own, "removed", show(left[key]), None
        elif key not in left:
            yield own, "added", None, show(right[key])
        else:
            yield from _walk(own, left[key], right[key])


@F.pandas_udf(ArrayType(StructType().add("path", "string").add("kind", "string").add("left", "string").add("right", "string")))
def json_changes(left: pd.Series, right: pd.Series) -> pd.Series:
    """The changes between two JSON texts by pointer; null where either isn't JSON."""

    def one(a, b):
        try:
            return [dict(zip(("path", "kind", "left", "right"), c, strict=True)) for c in _walk("", json.loads(a), json.loads(b))]
        except (TypeError, ValueError, RecursionError):
            return None

    return pd.Series([one(a, b) for a, b in zip(left, right, strict=True)], dtype=object)
