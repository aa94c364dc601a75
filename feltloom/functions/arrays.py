"""Array operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sorted_set(x: Column) -> Column:
    """Distinct non-empty strings in byte order."""
    return F.array_sort(F.array_distinct(F.filter(x, lambda v: v.isNotNull() & (v != ""))))


def same_set(a: Column, b: Column) -> Column:
    """Equal as sets, without repeats on either side."""
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0) & (F.size(a) == F.size(b))


def edge_diff(before: Column, after: Column) -> Column:
    """Lines '- old' and '+ new' of what lies between the common beginning and the common end."""

    def first_difference(pairs: Column) -> Column:
        at = F.array_position(F.transform(pairs, lambda p: F.coalesce(p["a"] == p["b"], F.lit(False))), False)
        return F.when(at == 0, F.size(pairs)).otherwise(at - 1).cast("int")

    def cut(s: Column) -> Column:
        a, b = s["a"], s["b"]
        head = first_difference(F.arrays_zip(a.alias("a"), b.alias("b")))

        def rest(h: Column) -> Column:
            x, y = F.slice(a, h + 1, F.greatest(F.size(a) - h, F.lit(0))), F.slice(b, h + 1, F.greatest(F.size(b) - h, F.lit(0)))

            def ends(r: Column) -> Column:
                u, v = F.reverse(r["x"]), F.reverse(r["y"])
                tail = F.least(first_difference(F.arrays_zip(u.alias("a"), v.alias("b"))), F.size(u), F.size(v))
                return let(tail, lambda t: F.concat(F.transform(F.slice(r["x"], F.lit(1), F.size(u) - t), lambda w: F.concat(F.lit("- "), w)), F.transform(F.slice(r["y"], F.lit(1), F.size(v) - t), lambda w: F.concat(F.lit("+ "), w))))

            return let(F.struct(x.alias("x"), y.alias("y")), ends)

        return let(F.least(head, F.size(a), F.size(b)), rest)

    return let(F.struct(before.alias("a"), after.alias("b")), cut)


def single_value(values: Column) -> Column:
    """The one distinct value of an array; null if there is none or more than one."""
    return F.when(F.size(F.array_distinct(values)) == 1, F.get(values, F.lit(0)))


def kept_in_order(values: Column, allowed: list[str]) -> Column:
    """Allowed values, each where it first stands."""
    return F.array_distinct(F.filter(values, lambda v: v.isin(allowed)))


def find_by_id(rows: Column, field: str, wanted: Column) -> Column:
    """The first struct of an array whose ``field`` is ``wanted``, or null."""
    return F.get(F.filter(rows, lambda r: r[field] == wanted), F.lit(0))
