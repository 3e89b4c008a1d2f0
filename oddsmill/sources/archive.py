"""

Fetching is not an engine's work: what a venue sent is read from an archive of response files, batch or stream.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import parse

ENVELOPE = "url string, params map<string,string>, fetched_at string, body string"


def responses(spark: SparkSession, folder: str, streaming: bool = False) -> DataFrame:
    """[S1, S5-S9] url, params, fetched_at, body of the archived responses, one JSON object per file line; gzip is transparent."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(ENVELOPE).json(folder)


def latest_responses(raw: DataFrame) -> DataFrame:
    """[S4] One response per address and parameters, the newest."""
    keyed = raw.withColumn("key", parse.content_key(F.col("url"), F.col("params")))
    newest = keyed.groupBy("key").agg(F.max(F.struct("fetched_at", "body", "url")).alias("r"))
    return newest.select("key", "r.url", "r.fetched_at", "r.body")


def records(raw: DataFrame, schema: str, field_name: str | None = None) -> DataFrame:
    """[S5, S8] Records of bodies that are a list, or hold one under a name (with paging marks beside it)."""
    kind = f"array<struct<{schema}>>" if field_name is None else f"struct<{field_name}:array<struct<{schema}>>>"
    kind = kind.replace(", ", ",")
    body = F.from_json("body", _colons(kind))
    return raw.select(F.explode(body if field_name is None else body[field_name]).alias("r")).select("r.*")


def _colons(kind: str) -> str:
    """A DDL list ``a int,b int`` inside struct<> in its ``a:int`` form."""
    head, _, rest = kind.partition("struct<")
    out, depth, name = [], 0, True
    for c in rest:
        if c == " " and depth == 0 and name:
            out.append(":")
            name = False
            continue
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            name = True
        out.append(c)
    return head + "struct<" + "".join(out)


def day_partitions(spark: SparkSession, folder: str, since: str, until: str, schema: str) -> DataFrame:
    """[S5] Records stored in folders ``day=YYYY-MM-DD``; other days are pruned before listing files."""
    return spark.read.schema(schema + ", day date").json(folder).where((F.col("day") >= F.lit(since)) & (F.col("day") < F.lit(until)))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """[S12] A table of Parquet files."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def candidates_csv(spark: SparkSession, path: str) -> DataFrame:
    """[S13] Candidate pairs from CSV with a header; numbers that aren't are null."""
    return spark.read.schema("pm_id string, k_id string, score double, both_priced boolean, verified string").csv(path, header=True)


def review_lines(spark: SparkSession, path: str) -> DataFrame:
    """[S14] Pairs under review, one JSON object a line."""
    return spark.read.schema("pm_id string, k_id string, series string, k_sub string, k_title string, k_rules string, pm_title string, pm_desc string, pm_outcomes array<string>, pm_leg int").json(path)


@dataclass(frozen=True)
class Config:
    """[S15] Settings; a relative folder is taken from the file's own place."""

    archive: str = "archive"
    tables: str = "tables"
    reports: str = "reports"
    min_hours: float = 24.0
    match_threshold: float = 85.0
    rejected_frequencies: tuple[str, ...] = ()
    rejected_categories: tuple[str, ...] = ()
    rejected_prefixes: tuple[str, ...] = ()
    extra: dict = field(default_factory=dict)


def load_config(path: str | None = None) -> Config:
    """[S15] From JSON, or YAML where a YAML library is there; defaults without a path."""
    if path is None:
        return Config()
    text = Path(path).read_text()
    if path.endswith(".json"):
        raw = json.loads(text)
    else:
        import yaml

        raw = yaml.safe_load(text) or {}
    known = {k: v for k, v in raw.items() if k in Config.__dataclass_fields__ and k != "extra"}
    home = Path(path).resolve().parent
    for key in ("archive", "tables", "reports"):
        if key in known and "://" not in known[key]:
            known[key] = str(home / known[key])
    known = {k: tuple(v) if isinstance(v, list) else v for k, v in known.items()}
    return Config(**known, extra={k: v for k, v in raw.items() if k not in Config.__dataclass_fields__})
