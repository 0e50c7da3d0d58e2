"""Document-store style queries over tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import vectors as vectors_of


def matches(df: DataFrame, equal: dict | None = None, least: dict | None = None, among: dict | None = None, outside: dict | None = None, like: dict | None = None, exists: dict | None = None) -> DataFrame:
    """B1, B2: rows that meet all conditions; outside and unequal tests hold for null, as where a field is missing."""
    test = F.lit(True)
    for c, v in (equal or {}).items():
        test = test & F.col(c).eqNullSafe(v)
    for c, v in (least or {}).items():
        test = test & (F.col(c) >= v)
    for c, v in (among or {}).items():
        test = test & F.col(c).isin(list(v))
    for c, v in (outside or {}).items():
        test = test & ~F.coalesce(F.col(c).isin(list(v)), F.lit(False))
    for c, v in (like or {}).items():
        test = test & F.col(c).rlike(f"(?i){v}")
    for c, v in (exists or {}).items():
        test = test & (F.col(c).isNotNull() if v else F.col(c).isNull())
    return df.where(test)


def looked_up(left: DataFrame, right: DataFrame, left_key: str, right_key: str, name: str, *fields: str) -> DataFrame:
    """Rows of left with the matching rows of right as an array, empty if there are none."""
    row = F.struct(*(fields or right.columns))
    lists = right.groupBy(F.col(right_key).alias("_key")).agg(F.array_sort(F.collect_list(row)).alias(name))
    joined = left.join(lists, F.col(left_key) == F.col("_key"), "left").drop("_key")
    return joined.withColumn(name, F.coalesce(F.col(name), F.array().cast(lists.schema[name].dataType)))


def without_match(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """B5."""
    return left.join(right.select(F.col(right_key).alias("_key")), F.col(left_key) == F.col("_key"), "left_anti")


def element_match(df: DataFrame, array: str, test) -> DataFrame:
    """Rows with an element of the array that meets a test."""
    return df.where(F.exists(array, test))


def unwound(df: DataFrame, array: str) -> DataFrame:
    """A row for each element; rows with empty arrays go."""
    return df.withColumn(array, F.explode(array))


def page(df: DataFrame, order: list[Column], size: int, number: int = 0) -> DataFrame:
    """One page of rows and the number of all; the total is an aggregate of its own, so that no window has to
    gather the table."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return df.orderBy(*order).offset(size * number).limit(size).join(F.broadcast(total))  # one row


def latest_per_key(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The row that comes last in the order, for each key."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def merged(base: DataFrame, over: DataFrame, key: str) -> DataFrame:
    """Rows of base with the values of over where it has some."""
    names = [c for c in base.columns if c != key]
    joined = base.alias("b").join(over.alias("o"), key, "left")
    return joined.select(key, *(F.coalesce(f"o.{c}", f"b.{c}").alias(c) if c in over.columns else F.col(f"b.{c}") for c in names))


def upserted(target: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The target with the rows of changes in place of its own."""
    return target.join(changes.select(key), key, "left_anti").unionByName(changes)


def updated(df: DataFrame, test: Column, set_to: dict | None = None, increase: dict | None = None, push: dict | None = None, pull: dict | None = None) -> DataFrame:
    """Rows that meet the test with fields set, increased, and elements added to arrays or taken from them."""
    change = {c: F.lit(v) for c, v in (set_to or {}).items()}
    change |= {c: F.col(c) + v for c, v in (increase or {}).items()}
    change |= {c: F.array_append(F.col(c), F.lit(v)) for c, v in (push or {}).items()}
    change |= {c: F.array_except(F.col(c), F.array(*map(F.lit, v))) if isinstance(v, (list, tuple)) else F.array_remove(F.col(c), v) for c, v in (pull or {}).items()}
    return df.withColumns({c: F.when(test, v).otherwise(F.col(c)) for c, v in change.items()})


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """Null over zero."""
    return F.round(F.try_divide(100.0 * part, whole), digits)


def cleaned(df: DataFrame, names: dict[str, str] | None = None, fill: dict | None = None, required: list[str] | None = None, unique: list[str] | None = None, types: dict[str, str] | None = None) -> DataFrame:
    """Renamed, filled, without rows that lack something, once each, cast."""
    df = df.withColumnsRenamed(names or {})
    df = df.fillna(fill) if fill else df
    df = df.dropna(subset=required) if required else df
    df = df.dropDuplicates(unique) if unique else df
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in (types or {}).items()})


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null for vectors without length."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, vec_id, rank, score): the k vectors nearest to each of queries(query_id, vector), exactly.

    The queries are a stated set that is compared with all vectors, a block of them at a time; each task keeps the best k of
    its own rows for a query before anything is shuffled. Of equal vectors only the k first ids can be among the nearest.
    Vectors that have no length, nulls, infinities or another size than the longest query are scored one pair at a time.
    Spark jobs run while the result is being declared.
    """
    v = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector).alias("_v"))
    q = queries.select("query_id", F.col("vector").alias("_q"))
    size, many = q.agg(F.max(F.size("_q")), F.count(F.lit(1))).first()

    def plain(c: str) -> Column:
        x = F.col(c)
        return F.coalesce((F.size(x) == (size or 0)) & dot(x, x).between(1e-60, 1e60), F.lit(False))  # null or NaN where an element is

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    some_odd = not v.where(~plain("_v") | F.col("vec_id").isNull()).isEmpty()
    v = v.withColumn("_n", F.row_number().over(Window.partitionBy("_v").orderBy("vec_id"))).where(F.col("_n") <= k).drop("_n")
    odd_v, odd_q = v.where(~plain("_v") | F.col("vec_id").isNull()), q.where(~plain("_q"))
    even_v, even_q = v.where(plain("_v") & F.col("vec_id").isNotNull()), q.where(plain("_q"))
    one_by_one = lambda v, q: v.join(q).select("query_id", "vec_id", cosine(F.col("_v"), F.col("_q")).alias("score"))
    parts = [one_by_one(v, odd_q)] if not odd_q.isEmpty() else []
    parts += [one_by_one(odd_v, even_q)] if some_odd else []
    blocks = -(-many // vectors_of.BLOCK)
    for block in range(blocks):
        some = even_q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block) if blocks > 1 else even_q
        parts.append(vectors_of.nearest_block(even_v, some, k, size))
    scored = parts[0] if parts else one_by_one(v, q)
    for more in parts[1:]:
        scored = scored.unionByName(more)
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def projected(df: DataFrame, fields: dict[str, Column | str]) -> DataFrame:
    """A column for each of fields: another column's name, a path into objects and lists (`place.city`, `tags.0`), or an
    expression. What a path does not find is null."""

    def value(path: str) -> Column:
        name, *steps = path.split(".")
        out = F.col(name)
        for step in steps:
            out = F.get(out, F.lit(int(step))) if step.isdigit() else out[step]
        return out

    return df.select(*((value(x) if isinstance(x, str) else x).alias(name) for name, x in fields.items()))
