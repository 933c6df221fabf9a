"""Operator definitions and derivative formulas from YAML. Each is one small document, parsed on the driver into typed rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.schemas import SCHEMAS
from codeloom.sources.files import exists

NAME = re.compile(r"(\w+(?:\.\w+)?)")
OPERATOR = re.compile(r"(\w+(?:\.\w+)?)\s*\(")


def _entries(spark: SparkSession, path: str) -> list[dict]:
    import yaml

    if not exists(spark, path):
        return []
    text = spark.read.text(path, wholetext=True).first()[0]
    try:
        data = yaml.safe_load(text)
    except yaml.YAMLError:
        return []
    return [e for e in data or [] if isinstance(e, dict)]


def _tags(value) -> list[str]:
    return [] if value is None else [str(t) for t in value] if isinstance(value, list) else [str(value)]


def operator_rows(entries: list[dict]) -> list[tuple]:
    """(name, signature, dispatch entries, variants, structured, delegate, tags, ord) of entries whose func has a name."""
    out = []
    for i, e in enumerate(entries):
        if (m := OPERATOR.match(str(e.get("func", "")))) is None:
            continue
        dispatch = [(str(k), None if v is None else str(v)) for k, v in e["dispatch"].items()] if isinstance(e.get("dispatch"), dict) else []
        delegate = e.get("structured_delegate")
        out.append((m[1], e["func"], dispatch, str(e.get("variants") or ""), bool(e.get("structured", False)), None if delegate is None else str(delegate), _tags(e.get("tags")), i))
    return out


def native_functions(spark: SparkSession, path: str) -> DataFrame:
    """A row for each name and one more for each overloaded base: the first overload, unless the base itself is defined."""
    raw = "name string, signature string, dispatch array<struct<keys:string,impl:string>>, variants string, structured boolean, structured_delegate string, tags array<string>, ord long"
    return with_aliases(spark.createDataFrame(operator_rows(_entries(spark, path)), raw))


def with_aliases(rows: DataFrame) -> DataFrame:
    pairs = F.flatten(F.transform("dispatch", lambda d: F.transform(F.split(d["keys"], ","), lambda k: F.struct(F.trim(k).alias("key"), d["impl"].alias("value")))))
    last = F.aggregate(pairs, F.expr("cast(map() as map<string,string>)"), lambda acc, x: F.map_concat(F.map_filter(acc, lambda k, v: k != x["key"]), F.create_map(x["key"], x["value"])))
    rows = rows.withColumn("dispatch", last).withColumn("base_name", F.split_part("name", F.lit("."), F.lit(1)))
    cols = ["name", "base_name", "signature", "dispatch", "variants", "structured", "structured_delegate", "tags"]
    full = F.struct(*cols, "ord")
    exact = rows.groupBy(F.col("name").alias("lookup_name")).agg(F.max_by(full, "ord").alias("x"), F.lit(False).alias("is_alias"))
    alias = rows.where("name <> base_name").groupBy(F.col("base_name").alias("lookup_name")).agg(F.min_by(full, "ord").alias("x"), F.lit(True).alias("is_alias"))
    both = exact.unionByName(alias.join(exact, "lookup_name", "left_anti"))
    return both.select("lookup_name", *[F.col(f"x.{c}").alias(c) for c in cols], "is_alias", F.col("x.ord").alias("ord"))


def derivatives(spark: SparkSession, path: str) -> DataFrame:
    """Of a name that is told twice, the last."""
    out: dict[str, tuple] = {}
    for e in _entries(spark, path):
        if (m := NAME.match(str(e.get("name", "")))) is not None:
            out[m[1]] = (m[1], e["name"], {k: v for k, v in e.items() if isinstance(v, str) and k not in ("name", "dispatch", "output_differentiability")})
    return spark.createDataFrame(list(out.values()), SCHEMAS["derivatives"])


def targets(functions: DataFrame) -> DataFrame:
    """name: every base name and every dispatch implementation, once."""
    impls = functions.select(F.explode(F.map_values("dispatch")).alias("name"))
    return functions.select(F.col("base_name").alias("name")).union(impls).where("name is not null").distinct()
