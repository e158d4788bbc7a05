"""Rules of the dialect that no comparison over the test tables meets: odd values, refused changes, rights."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodestar import errors, procedures
from lodestar.functions import scalar as S
from lodestar.operators import changes as C
from lodestar.operators import relational as R
from lodestar.sources import session as T


@pytest.fixture(scope="module")
def users(spark):
    return spark.createDataFrame([(1, "a", 30), (2, "b", None), (3, None, 5)], "id long, name string, age int")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "pattern", "hit"), [("a_b", r"a\_b", True), ("axb", r"a\_b", False), ("a%b", r"a\%_", True), ("a\\b", r"a\\b", True), ("ab", r"\a\b", True), ("a", "a\\", False), ("", "%", True), ("É", "_", True)])
def test_like(spark, text, pattern, hit):
    assert one(spark, S.like(F.lit(text), pattern)) is hit


def test_scalars(spark):
    assert one(spark, S.substr(F.lit("abc"), -5, 3)) == "abc" and one(spark, S.substr(F.lit("abc"), 0, 2)) == "ab"
    assert [one(spark, S.int_div(F.lit(a), F.lit(2), "int")) for a in (7, -7)] == [3, -3]
    assert [one(spark, S.float_text(F.lit(x))) for x in (1.0, 1.5, -0.0, 1e-7, 1e20, 1.25e-5, -1.2345678e8, 123456789.5, float("nan"), float("-inf"))] == ["1", "1.5", "-0", "0.0000001", "100000000000000000000", "0.0000125", "-123456780", "123456789.5", "NaN", "-inf"]
    assert one(spark, S.bool_of_text(F.lit("\t On\n"))) is True and one(spark, S.bool_of_text(F.lit("off"))) is False
    assert one(spark, S.uuid_of_text(F.lit("0123456789ABCDEF0123456789abcdef"))) == "01234567-89ab-cdef-0123-456789abcdef"
    assert one(spark, S.timestamp_text(S.shifted(F.lit("2024-01-31 10:00:00").cast("timestamp_ntz"), months=1))) == "2024-02-29 10:00:00"
    ts = {"2024-02-30": "2024-03-01 00:00:00", " 1969-12-31T23:59:60Z ": "1970-01-01 00:00:00", "2024-01-01 10:20": "2024-01-01 10:20:00", "2024-01-01 10:20:30.5+02": "2024-01-01 10:20:30.500000"}
    assert {t: str(one(spark, S.timestamp_of_text(F.lit(t)))) for t in ts} == ts
    assert one(spark, S.uuid_text(S.uuid_of_text(F.lit("ff")))) == "0" * 30 + "ff" and one(spark, S.int_of_text(F.lit(" +7\t"))) == 7 and one(spark, S.float_of_text(F.lit("1e3 "))) == 1000
    assert one(spark, S.datetime("2026-01-31", "+1 month", "-1 second")) == "2026-02-27 23:59:59" and one(spark, S.date("2026-01-31", None)) is None
    assert one(spark, S.datetime("now", "-1 day") < S.datetime("NOW")) is True
    for unknown in ("start of day", "+1 fortnight", "utc"):
        with pytest.raises(errors.InvalidDatetime):
            S.date("now", unknown)
    for bad in (S.datetime("soon"), S.timestamp_of_text(F.lit("2024-13-01")), S.int_of_text(F.lit("1.5")), S.float_of_text(F.lit("x")), S.bool_of_text(F.lit("maybe")), S.uuid_of_text(F.lit("x")), S.int_div(F.lit(1), F.lit(0))):
        with pytest.raises(Exception, match="invalid|zero"):
            one(spark, bad)


def test_outer_joins_with_an_empty_side(spark, users):
    none = users.where("id < 0").toDF("other", "n", "a")
    assert R.join(users, none, users["id"] == none["other"], "left").where("other is null").count() == 3
    assert R.join(none, users, users["id"] == none["other"], "full").where("other is null and id is not null").count() == 3


def test_not_in(spark, users):
    values = lambda *v: spark.createDataFrame([(x,) for x in v], "v int")
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert ids(R.null_aware_anti(users, "age", values(5, 6))) == [1]
    assert ids(R.null_aware_anti(users, "age", values(5, None))) == []
    assert ids(R.null_aware_anti(users, "age", values())) == [1, 2, 3]


def test_order_and_limits(users):
    assert [r["age"] for r in users.orderBy(*R.ordered(("age", "asc"))).collect()] == [5, 30, None]
    assert [r["age"] for r in users.orderBy(*R.ordered(("age", "desc"))).collect()] == [None, 30, 5]
    assert R.limited(users, None, 1).count() == 2 and R.within_budget(users, 3).count() == 3
    with pytest.raises(errors.RowBudgetExceeded):
        R.within_budget(users, 2)


def test_changes(spark, users):
    new = spark.createDataFrame([(2, "x", 0), (None, "y", 1), (2, "z", 2), (None, "y", 3)], "id long, name string, ord int")
    names = lambda df: sorted((r["id"] or 0, r["name"] or "") for r in df.collect())
    assert names(C.insert_or_nothing(users, new, ("id",), "ord")) == [(0, "y"), (0, "y"), (1, "a"), (2, "b"), (3, "")]
    chained = C.upsert(users, new, ("id",), "ord", lambda old, row: {"name": F.concat(old["name"], row["name"])})
    assert names(chained) == [(0, "y"), (0, "y"), (1, "a"), (2, "bxz"), (3, "")]
    assert C.update(users, F.col("age") > 10, {"age": F.col("age") + 1}).where("age = 31").count() == 1
    with pytest.raises(errors.TypeMismatch):
        C.update(users, F.col("age") > 10, {"age": F.lit("old")})
    with pytest.raises(errors.UniqueViolation):
        C.update(users, F.col("id") > 1, {"id": F.lit(1).cast("long")}, unique=("id",))
    with pytest.raises(errors.NotNullViolation):
        C.update(users, F.col("id") > 1, {"id": F.lit(None)}, required=("id",))
    with pytest.raises(errors.UniqueViolation):
        C.upsert(users, new, ("id",), "ord", lambda old, row: {"id": F.lit(1).cast("long")})
    declined = lambda old, row: row["name"] > "x"
    step = lambda old, row: {"name": row["name"]}
    assert names(C.upsert(users, new, ("id",), "ord", step, declined)) == [(0, "y"), (0, "y"), (1, "a"), (2, "z"), (3, "")]
    assert C.affected_by_upsert(users, new, ("id",), "ord", step, declined) == 3 and C.affected(users, F.col("age") > 10) == 1
    assert names(C.replace(users, new, ("id",), "ord")) == [(0, "y"), (0, "y"), (1, "a"), (2, "z"), (3, "")]
    assert C.inserted_or_nothing(users, new, ("id",), "ord").count() == 2
    assert C.delete(users, F.col("age") > 10).count() == 2  # a null predicate keeps its row
    with pytest.raises(errors.UniqueViolation):
        C.insert(users, new, unique=("id",))
    with pytest.raises(errors.NotNullViolation):
        C.insert(users, new, required=("id",))
    with pytest.raises(errors.TypeMismatch):
        C.insert(users, new.withColumn("age", F.lit("old")))
    assert C.insert(users, spark.createDataFrame([(9,)], "id int"), {"name": F.lit("new")}).where("id = 9 and name = 'new' and age is null").count() == 1


def test_triggers(spark):
    rows = spark.createDataFrame([(2**53 + 1, "a", None), (None, "b", 1.5)], "id long, name string, x double")
    seen = lambda event, row, old: {**row, "name": f"{event} {row['id']} {row['x']} {old and old['name']}"}
    found = lambda df: sorted((r["id"] or 0, r["name"]) for r in df.collect())
    assert found(C.insert(rows.limit(0), rows, before=(seen, lambda e, r, o: {**r, "name": r["name"] + "!"}))) == [(0, "insert None 1.5 None!"), (2**53 + 1, "insert 9007199254740993 None None!")]
    assert found(C.update(rows, F.col("x").isNull(), {"name": F.lit("c")}, before=(seen,))) == [(0, "b"), (2**53 + 1, "update 9007199254740993 None a")]
    assert found(C.update(rows, F.lit(True), {"name": F.lit("c")}, before=(lambda e, r, o: None if o["name"] == "a" else r,))) == [(0, "c"), (2**53 + 1, "a")]
    assert found(C.delete(rows, F.lit(True), before=(lambda e, r, o: r if r["name"] == "a" else None,))) == [(0, "b")]
    for refused in (C.delete(rows, F.lit(True), before=(seen,)), C.insert(rows, rows, before=(lambda e, r, o: 1 / 0,))):
        with pytest.raises(Exception, match="DELETE trigger|division"):
            refused.collect()


def test_distinct_by_hidden_keys(spark):
    rows = spark.createDataFrame([("p", 1, 9), ("p", 2, 1), ("q", 1, 5), ("r", None, 0)], "g string, a int, b int")
    order = lambda *keys: [r["g"] for r in R.distinct_ordered(rows, ["g"], *keys).collect()]
    assert order(("a", "asc"), ("b", "asc")) == ["q", "p", "r"] and order(("a", "desc"), ("b", "desc")) == ["r", "p", "q"]
    assert order(("a", "asc"), ("b", "desc")) == ["p", "q", "r"] and order(("a", "desc"), ("b", "asc")) == ["r", "p", "q"]


def test_rights_and_procedures():
    roles = procedures.Roles()
    known = procedures.Procedures(roles)
    known.register("twice", lambda x: 2 * x)
    with pytest.raises(errors.PermissionDenied):
        known.call("guest", "twice", 2)
    roles.grant("guest", "call", "twice")
    roles.grant("root", "admin")
    assert known.call("guest", "twice", 2) == known.call("root", "twice", 2) == 4
    with pytest.raises(errors.UndefinedObject):
        known.call("root", "none")
    assert errors.sqlstate(errors.UniqueViolation()) == "23505" and errors.sqlstate(ValueError()) == "XX000"


def test_catalogue_of_tables(spark, sf_dir):
    found = T.system_tables(spark, ["region"], sf_dir).collect()
    assert [r["column_name"] for r in found] == ["r_regionkey", "r_name"]
    assert T.point_get(T.table(spark, sf_dir, "region"), "r_regionkey", 1).count() == 1
