"""Writing back: upserts, deletions, changes at positions, and the log of what changed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """old with the rows of new in the place of those of equal key, and the rest of new added. Null keys are never equal."""
    return old.join(new.select(*key), list(key), "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def set_field(old: DataFrame, new: DataFrame, key: str, field: str) -> DataFrame:
    """old with `field` from new where new has the key (one row for each), null values included; the other columns stay."""
    fresh = new.select(F.col(key).alias("__key"), F.col(field).alias("__value"))
    value = F.when(F.col("__key").isNotNull(), F.col("__value")).otherwise(F.col(field))
    return old.join(fresh, F.col(key) == F.col("__key"), "left").withColumn(field, value).select(*old.columns)


def delete(old: DataFrame, keys: DataFrame, key: Sequence[str]) -> DataFrame:
    """old without the rows whose key is among keys. Null keys are never equal, so such rows stay."""
    return old.join(keys.select(*key).distinct(), list(key), "left_anti").select(*old.columns)


def update_many(old: DataFrame, condition: Column, values: Mapping[str, Column]) -> DataFrame:
    """old with columns set in the rows that meet the condition; where it is null nothing is set."""
    return old.withColumns({name: F.when(F.coalesce(condition, F.lit(False)), value).otherwise(F.col(name)) for name, value in values.items()})


def at_positions(docs: DataFrame, id_col: str, items: str, updates: DataFrame, fits: Column | None = None) -> DataFrame:
    """docs with the items (an array) at (id, position) replaced by updates (id_col, position, value; one for each place).

    Only the updates are grouped, not the items. `fits`, over the columns `item` and `value`, says which updates are of the
    item's shape; the column n_refused counts the others and those beyond the end.
    """
    given = updates.groupBy(F.col(id_col).alias("__id")).agg(F.map_from_entries(F.collect_list(F.struct("position", "value"))).alias("__new"))
    joined = docs.join(given, F.col(id_col) == F.col("__id"), "left")
    both = F.transform(items, lambda x, i: F.struct(x.alias("item"), F.try_element_at("__new", i).alias("value")))

    def good(pair: Column) -> Column:
        return pair["value"].isNotNull() & (fits(pair["item"], pair["value"]) if fits is not None else F.lit(True))

    changed = F.transform(both, lambda p: F.when(good(p), p["value"]).otherwise(p["item"]))
    refused = F.coalesce(F.size(F.map_keys("__new")), F.lit(0)) - F.size(F.filter(both, good))
    return joined.withColumn("n_refused", F.when(F.col("__new").isNull(), 0).otherwise(refused)).withColumn(items, changed).drop("__id", "__new")


def difference(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key, kind (add, remove, change), field, before, after: what differs between two states; for whole rows field is null."""
    fields = [c for c in old.columns if c != key]
    a = old.select(F.col(key).alias("__a"), *[F.col(c).cast("string").alias(f"a_{c}") for c in fields])
    b = new.select(F.col(key).alias("__b"), *[F.col(c).cast("string").alias(f"b_{c}") for c in fields])
    both = a.join(b, F.col("__a") == F.col("__b"), "full")
    nothing = F.lit(None).cast("string")
    row = lambda kind, field, before, after: F.struct(F.lit(kind).alias("kind"), field.alias("field"), before.alias("before"), after.alias("after"))
    whole = F.when(F.col("__a").isNull(), F.array(row("add", nothing, nothing, nothing))).when(F.col("__b").isNull(), F.array(row("remove", nothing, nothing, nothing)))
    parts = F.array(*[F.when(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), row("change", F.lit(c), F.col(f"a_{c}"), F.col(f"b_{c}"))) for c in fields])
    return both.select(F.coalesce("__a", "__b").alias(key), F.explode(F.filter(F.coalesce(whole, parts), lambda x: x.isNotNull())).alias("x")).select(key, "x.*")


_ENTRY = "struct<kind:string,path:string,before:string,after:string>"


def _shown(value: Column, kind: T.DataType) -> Column:
    return F.to_json(value) if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)) else value.cast("string")


def _entry(kind: str, path: Column, before: Column, after: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), path.alias("path"), before.alias("before"), after.alias("after"))


def _changes(a: Column, b: Column, kind: T.DataType, path: Column) -> Column:
    """array of entries: what differs between two values of a type. Null is nothing."""
    none, nothing = F.array().cast(f"array<{_ENTRY}>"), F.lit(None).cast("string")
    below = lambda key: F.concat(path, F.when(path != "", ".").otherwise(""), key)
    if isinstance(kind, T.StructType):
        within = F.flatten(F.array(*[_changes(a[f.name], b[f.name], f.dataType, below(F.lit(f.name))) for f in kind.fields])) if kind.fields else none
    elif isinstance(kind, T.ArrayType):
        places = lambda low, high: F.when(high > low, F.sequence(low, high - 1)).otherwise(F.array().cast("array<int>"))
        m, n, item = F.size(a), F.size(b), kind.elementType
        both = F.flatten(F.transform(places(F.lit(0), F.least(m, n)), lambda i: _changes(F.get(a, i), F.get(b, i), item, below(i.cast("string")))))
        more = F.transform(places(m, n), lambda i: _entry("add", below(i.cast("string")), nothing, _shown(F.get(b, i), item)))
        fewer = F.transform(places(n, m), lambda i: _entry("remove", below(i.cast("string")), _shown(F.get(a, i), item), nothing))
        within = F.concat(both, more, fewer)
    elif isinstance(kind, T.MapType):
        keys = F.array_sort(F.array_union(F.map_keys(a), F.map_keys(b)))
        within = F.flatten(F.transform(keys, lambda k: _changes(F.try_element_at(a, k), F.try_element_at(b, k), kind.valueType, below(k.cast("string")))))
    else:
        within = F.when(a != b, F.array(_entry("change", path, a.cast("string"), b.cast("string")))).otherwise(none)
    return (
        F.when(a.isNull() & b.isNull(), none)
        .when(a.isNull(), F.array(_entry("add", path, nothing, _shown(b, kind))))
        .when(b.isNull(), F.array(_entry("remove", path, _shown(a, kind), nothing)))
        .otherwise(F.coalesce(within, none))
    )


def nested_difference(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key, kind (add, remove, change), path, before, after: what differs between two states, through structs, arrays (by place) and maps (by key); values are told as text, nested ones as JSON.

    A path has the names, places and keys from the row down, with dots between; it is empty for whole rows. Both sides have the same columns; null is the same as nothing. Null keys
    never meet: each such row is removed or added.
    """
    fields = [f for f in old.schema.fields if f.name != key]
    a = old.select(F.col(f"`{key}`").alias("__a"), F.struct(*[F.col(f"`{f.name}`") for f in fields]).alias("__old"))
    b = new.select(F.col(f"`{key}`").alias("__b"), F.struct(*[F.col(f"`{f.name}`") for f in fields]).alias("__new"))
    both = a.join(b, F.col("__a") == F.col("__b"), "full")
    told = _changes(F.col("__old"), F.col("__new"), T.StructType(fields), F.lit(""))
    return both.select(F.coalesce("__a", "__b").alias(key), F.explode(told).alias("__x")).select(key, "__x.*")
