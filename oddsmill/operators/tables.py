
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def upsert(existing: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """[D1, D2] All keys, each with its newest row: one of ``new`` (of several the greatest) before one of ``existing``. Idempotent."""
    rest = [c for c in existing.columns if c not in key]
    every = existing.select(*key, F.lit(0).alias("_age"), *rest).unionByName(new.select(*key, F.lit(1).alias("_age"), *rest))
    newest = every.groupBy(*key).agg(F.max(F.struct("_age", *rest)).alias("_row"))
    return newest.select(*existing.columns) if not rest else newest.select(*key, *(F.col(f"_row.{c}").alias(c) for c in rest)).select(*existing.columns)


def insert_ignore(existing: DataFrame, new: DataFrame, key: list[str], required: tuple[str, ...] = ()) -> DataFrame:
    """[D3, D4] existing and the rows of new whose key it doesn't have; of several the least. Rows that miss a required value are ignored."""
    rest = [c for c in existing.columns if c not in key]
    for c in required:
        new = new.where(F.col(c).isNotNull())
    first = new.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_row")).select(*key, *(F.col(f"_row.{c}").alias(c) for c in rest))
    return existing.unionByName(first.join(existing.select(*key), key, "left_anti").select(*existing.columns))


def missing(need: DataFrame, have: DataFrame, key: list[str]) -> DataFrame:
    """[J12, J13] Rows of need whose key is not in have."""
    return need.join(have.select(*key), key, "left_anti")


def deterministic_sample(ids: DataFrame, column: str, k: int, seed: int = 42) -> DataFrame:
    """[T6] k distinct ids by a seeded hash: the same whatever the order of rows, all of them if there are no more."""
    distinct = ids.select(column).where(F.col(column).isNotNull()).distinct()
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(column).cast("string")).cast("binary"))
    return distinct.orderBy(draw, column).limit(k)


def most_liquid(markets: DataFrame, limit: int) -> DataFrame:
    """[T4] The open markets with most liquidity, no liquidity last."""
    return markets.where("outcome is null").orderBy(F.col("liquidity").desc_nulls_last(), "market_id").limit(limit)


def with_category(markets: DataFrame, series: DataFrame) -> DataFrame:
    """[J5] markets with the category of their series; one row per series is assumed, markets without one stay."""
    return markets.join(series.select("series", F.col("category").alias("series_category")), "series", "left")


def counted(rows: DataFrame, name: str, **conditions):
    """[A29] rows, and an Observation that counts them and each condition while they are used."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return rows.observe(seen, F.count(F.lit(1)).alias("rows"), *(F.count_if(c).alias(k) for k, c in conditions.items())), seen


def newest_first(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """[W3] rows with at: 1 for the newest of each key."""
    return rows.withColumn("at", F.row_number().over(Window.partitionBy(*key).orderBy(F.col(order).desc())))


def write_csv(rows: DataFrame, path: str, *order) -> None:
    """[D8, T7] Sorted rows as one CSV with a header; arrays as JSON. For reports, whose size is that of a table a person reads."""
    kinds = dict(rows.dtypes)
    flat = rows.select(*(F.to_json(c).alias(c) if kinds[c].startswith(("array", "struct", "map")) else F.col(c) for c in rows.columns))
    (flat.orderBy(*order) if order else flat).coalesce(1).write.mode("overwrite").csv(path, header=True)


def markdown_lines(rows: DataFrame, title: str, *order) -> DataFrame:
    """[D9] line, text: a table as Markdown under a heading, nulls as ``-``. For reports, whose size is that of a table a person reads."""
    cells = [F.coalesce(F.replace(F.col(f"`{c}`").cast("string"), F.lit("|"), F.lit("\\|")), F.lit("-")) for c in rows.columns]
    bar = lambda parts: F.concat(F.lit("| "), F.concat_ws(" | ", *parts), F.lit(" |"))
    at = F.row_number().over(Window.orderBy(*(order or rows.columns)))
    body = rows.select((at + 3).alias("line"), bar(cells).alias("text"))
    names = "| " + " | ".join(rows.columns) + " |"
    head = rows.sparkSession.createDataFrame([(0, f"## {title}"), (1, ""), (2, names), (3, "|" + " --- |" * len(rows.columns))], "line int, text string")
    return head.union(body)


def write_markdown(rows: DataFrame, path: str, title: str, *order) -> None:
    """[D9] One text file of markdown_lines."""
    markdown_lines(rows, title, *order).coalesce(1).sortWithinPartitions("line").select("text").write.mode("overwrite").text(path)


def write_lines(rows: DataFrame, path: str) -> None:
    """[S14] Rows as JSON lines, nulls left out, in as many files as there are partitions."""
    rows.write.mode("overwrite").json(path)


def write_table(rows: DataFrame, path: str, partition: str | None = "platform") -> None:
    """[D1] A new version of a table; readers of the old path are not disturbed, as the path must be new or a scratch one."""
    out = rows.write.mode("overwrite")
    (out.partitionBy(partition) if partition else out).parquet(path)
