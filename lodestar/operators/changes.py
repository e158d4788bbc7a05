"""INSERT, upsert, UPDATE, DELETE and column changes as functions from a table to the table after the statement.

Plain Parquet has no row changes, so a change is a plan that the caller writes as the table's next version. Every function
keeps the table's columns and types; rows conform to them after triggers ran. Checks of required columns and unique keys
run the changed rows' plan once before the caller does.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import NotNullViolation, TypeMismatch, UniqueViolation, UnsupportedTrigger

# The widenings that a write may do by itself.
WIDENINGS = {("int", "bigint"), ("int", "double"), ("bigint", "double")}


def conform(rows: DataFrame, table: DataFrame, defaults: dict[str, Column] | None = None, required: tuple[str, ...] = ()) -> DataFrame:
    """rows with all columns of the table: missing ones get their default or null, integers widen, other types raise."""
    defaults, types, out = defaults or {}, dict(rows.dtypes), []
    for name, kind in table.dtypes:
        if name not in types:
            out.append(defaults.get(name, F.lit(None)).cast(kind).alias(name))
        elif types[name] in (kind, "void") or (types[name], kind) in WIDENINGS:
            out.append(F.col(name).cast(kind).alias(name))
        else:
            raise TypeMismatch(f"{name}: {types[name]} is no {kind}")
    rows = rows.select(*out)
    if required and not rows.where(" or ".join(f"`{c}` is null" for c in required)).isEmpty():
        raise NotNullViolation(", ".join(required))
    return rows


def check_unique(table: DataFrame, *key: str) -> DataFrame:
    """The table itself if no two rows share a key; keys with a null never collide."""
    whole = table.where(" and ".join(f"`{c}` is not null" for c in key))
    if not whole.groupBy(*key).count().where("count > 1").isEmpty():
        raise UniqueViolation(", ".join(key))
    return table


def checked(after: DataFrame, required: tuple[str, ...] = (), unique: tuple[str, ...] = ()) -> DataFrame:
    """The table after a statement itself; raises if a required column is null or two rows share the unique key."""
    if required and not after.where(" or ".join(f"`{c}` is null" for c in required)).isEmpty():
        raise NotNullViolation(", ".join(required))
    return check_unique(after, *unique) if unique else after


Trigger = Callable[[str, dict, dict | None], dict | None]
#: The row as it was before an UPDATE, beside its columns.
OLD = "__old"


def before_each_row(rows: DataFrame, *triggers: Trigger, event: str = "insert") -> DataFrame:
    """The rows that a statement goes on with after its BEFORE triggers, which are called in their order for each row.

    trigger(event, row, old) returns the row, another one for the triggers behind it, or None to skip the row; it refuses by
    raising. old is None but for an update, whose rows bring it in a struct column OLD: a skipped row stays as it was. A
    delete's trigger can't replace its row; the rows returned are those that stay, the skipped ones. A task that is run
    again calls the triggers again. A trigger that expressions can say is better a function from rows to rows.
    """
    names = [c for c in rows.columns if c != OLD]

    def fired(row: dict, old: dict | None) -> dict | None:
        for trigger in triggers:
            new = trigger(event, dict(row), old)
            if new is None:
                return None
            if event == "delete" and new != row:
                raise UnsupportedTrigger("a BEFORE DELETE trigger returned another row")
            row = new
        return row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema, kept = batch.select(names).schema, []
            for row in batch.to_pylist():
                old = row.pop(OLD, None)
                new = fired(row, old)
                if event == "delete":
                    new = row if new is None else None
                elif new is None:
                    new = old
                if new is not None:
                    kept.append(new)
            yield pa.RecordBatch.from_pylist(kept, schema=schema)

    return rows.mapInArrow(run, rows.select(*names).schema)


def insert(table: DataFrame, rows: DataFrame, defaults: dict[str, Column] | None = None, required: tuple[str, ...] = (), unique: tuple[str, ...] = (), before: tuple[Trigger, ...] = ()) -> DataFrame:
    rows = conform(rows, table, defaults)
    if before:
        rows = before_each_row(rows, *before)
    checked(rows, required)
    return checked(table.unionByName(rows), unique=unique)


def _whole(key: tuple[str, ...]) -> str:
    return " and ".join(f"`{c}` is not null" for c in key)


def inserted_or_nothing(table: DataFrame, rows: DataFrame, key: tuple[str, ...], order: str) -> DataFrame:
    """The rows that ON CONFLICT DO NOTHING adds; their number is what the statement affects."""
    first = F.row_number().over(Window.partitionBy(*key).orderBy(order))
    new = rows.where(f"not ({_whole(key)})").union(rows.where(_whole(key)).withColumn("__n", first).where("__n = 1").drop("__n"))
    return conform(new.join(table.select(*key), list(key), "left_anti"), table)


def insert_or_nothing(table: DataFrame, rows: DataFrame, key: tuple[str, ...], order: str, required: tuple[str, ...] = ()) -> DataFrame:
    """ON CONFLICT DO NOTHING: rows whose key the table or an earlier row of the statement has are left out.

    order is a column of rows that numbers them. Keys with a null never collide.
    """
    return table.unionByName(checked(inserted_or_nothing(table, rows, key, order), required))


def replace(table: DataFrame, rows: DataFrame, key: tuple[str, ...], order: str, required: tuple[str, ...] = ()) -> DataFrame:
    """INSERT OR REPLACE: of the rows of a key the last one stands for all, found with partial aggregates. Keys with a null never collide."""
    shaped = conform(rows.drop(order), table)
    given = rows.select(F.struct(*(F.col(c).cast(kind).alias(c) if c in rows.columns else F.lit(None).cast(kind).alias(c) for c, kind in shaped.dtypes)).alias("__row"), F.col(order).alias("__n")).select("__row", "__n", *(F.col("__row")[c].alias(c) for c in key))
    last = given.where(_whole(key)).groupBy(*key).agg(F.max_by("__row", "__n").alias("__row")).select("__row.*")
    loose = given.where(f"not ({_whole(key)})").select("__row.*")
    return table.join(last.select(*key), list(key), "left_anti").select(*table.columns).unionByName(checked(last.unionByName(loose), required))


def _folded(table: DataFrame, rows: DataFrame, key: tuple[str, ...], order: str, step: Callable[[Column, Column], dict[str, Column]], where: Callable[[Column, Column], Column] | None) -> DataFrame:
    """(__row, __affected) for each key of the table or the statement: the row after it, and how many of its rows took effect."""
    conform(rows, table)  # raises on other types
    missing = {n: F.lit(None).cast(kind) for n, kind in table.dtypes if n not in rows.columns}
    rows = rows.withColumns(missing) if missing else rows
    shaped = [F.col(n).cast(kind).alias(n) for n, kind in table.dtypes]
    given = rows.where(_whole(key)).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("__n"), F.struct(*shaped).alias("__row")))).alias("__new"))
    current = table.where(_whole(key)).select(*key, F.struct(*table.columns).alias("__old"))
    both = current.join(given, list(key), "full")
    none = F.array().cast(dict(given.dtypes)["__new"])
    is_new = F.col("__old").isNull()
    rest = F.when(is_new, F.slice("__new", 2, F.greatest(F.size("__new") - 1, F.lit(0)))).otherwise(F.coalesce("__new", none))
    start = F.struct(F.coalesce(F.col("__old"), F.col("__new")[0]["__row"]).alias("row"), F.when(is_new, F.lit(1)).otherwise(F.lit(0)).cast("long").alias("n"))

    def fold(so_far: Column, new: Column) -> Column:
        row = so_far["row"]
        changed, hit = step(row, new["__row"]), F.lit(True) if where is None else F.coalesce(where(row, new["__row"]), F.lit(False))
        after = F.struct(*((F.when(hit, changed[n]).otherwise(row[n]) if n in changed else row[n]).cast(kind).alias(n) for n, kind in table.dtypes))
        return F.struct(after.alias("row"), (so_far["n"] + hit.cast("long")).alias("n"))

    return both.select(F.aggregate(rest, start, fold).alias("__done")).select(F.col("__done.row").alias("__row"), F.col("__done.n").alias("__affected"))


def upsert(table: DataFrame, rows: DataFrame, key: tuple[str, ...], order: str, step: Callable[[Column, Column], dict[str, Column]], where: Callable[[Column, Column], Column] | None = None, required: tuple[str, ...] = ()) -> DataFrame:
    """ON CONFLICT DO UPDATE [WHERE]: rows of a key are applied one after another, each to what the one before left.

    step(current, excluded) gives the new values of the columns that it changes, and where(current, excluded) whether it does
    so. A key's rows are folded in their order, so one statement should not bring more rows of one key than a task holds
    (replace() has no such bound). Keys with a null never collide; a step that changes the key is checked for collisions.
    """
    done = _folded(table, rows, key, order, step, where).select("__row.*")
    given = rows.drop(*(c for c in rows.columns if c not in table.columns))
    loose = table.where(f"not ({_whole(key)})").unionByName(conform(given.where(f"not ({_whole(key)})"), table))
    at = table.limit(0).select(F.struct(*table.columns).alias("r"))
    moved = set(step(at["r"], at["r"])) & set(key)
    return checked(done.unionByName(loose), required, key if moved else ())


def affected_by_upsert(table: DataFrame, rows: DataFrame, key: tuple[str, ...], order: str, step: Callable[[Column, Column], dict[str, Column]], where: Callable[[Column, Column], Column] | None = None) -> int:
    """How many rows the statement inserts or updates; those that its WHERE declines don't count."""
    folded = _folded(table, rows, key, order, step, where).agg(F.coalesce(F.sum("__affected"), F.lit(0))).first()[0]
    return folded + rows.where(f"not ({_whole(key)})").count()


def affected(table: DataFrame, where: Column) -> int:
    """How many rows an UPDATE or DELETE with this predicate affects."""
    return table.where(where).count()


def update(table: DataFrame, where: Column, values: dict[str, Column], required: tuple[str, ...] = (), unique: tuple[str, ...] = (), before: tuple[Trigger, ...] = ()) -> DataFrame:
    """UPDATE: all values see the row as it was; rows whose predicate is not true stay. Values conform as a write's do."""
    given = table.select(*(values[n].alias(n) for n in values)).dtypes
    for name, kind in given:
        wanted = dict(table.dtypes)[name]
        if kind not in (wanted, "void") and (kind, wanted) not in WIDENINGS:
            raise TypeMismatch(f"{name}: {kind} is no {wanted}")
    hit = F.coalesce(where, F.lit(False))
    new = lambda n, kind: values[n].cast(kind) if n in values else F.col(n)
    if before:
        old = F.struct(*table.columns).alias(OLD)
        changed = before_each_row(table.where(hit).select(*(new(n, kind).alias(n) for n, kind in table.dtypes), old), *before, event="update")
        after = table.where(~hit).unionByName(changed)
    else:
        after = table.select(*(F.when(hit, new(n, kind)).otherwise(F.col(n)).alias(n) if n in values else F.col(n) for n, kind in table.dtypes))
    return checked(after, required, unique)


def delete(table: DataFrame, where: Column, before: tuple[Trigger, ...] = ()) -> DataFrame:
    """DELETE: rows whose predicate is not true stay, and those that a trigger skips."""
    hit = F.coalesce(where, F.lit(False))
    stay = table.where(~hit)
    return stay.unionByName(before_each_row(table.where(hit), *before, event="delete")) if before else stay


def add_column(table: DataFrame, name: str, kind: str, default: object = None) -> DataFrame:
    """ADD COLUMN: rows that are there get the default; a null that is written later stays null."""
    return table if name in table.columns else table.withColumn(name, F.lit(default).cast(kind))
