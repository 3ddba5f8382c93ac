"""Readers and writers: CSV, TSV and Parquet tables, JSON and YAML results, configs."""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SEPARATORS = {".csv": ",", ".tsv": "\t"}


def read_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """By extension; without a schema CSV and TSV types are inferred."""
    kind = Path(path).suffix.lower()
    if kind in SEPARATORS:
        r = spark.read.option("header", True).option("sep", SEPARATORS[kind])
        return r.schema(schema).csv(path) if schema else r.option("inferSchema", True).csv(path)
    if kind in (".mat", ".h5", ".hdf5"):
        raise NotImplementedError(f"{kind} is not read here")
    return spark.read.parquet(path)


def write_table(df: DataFrame, path: str) -> None:
    kind = Path(path).suffix.lower()
    w = df.write.mode("overwrite")
    w.option("header", True).option("sep", SEPARATORS[kind]).csv(path) if kind in SEPARATORS else w.parquet(path)


def write_result(values: dict, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    if Path(path).suffix in (".yml", ".yaml"):
        import yaml

        Path(path).write_text(yaml.safe_dump(json.loads(json.dumps(values, default=str))))
    else:
        Path(path).write_text(json.dumps(values, default=str, indent=1))


#: Strings, or comments of either kind.
_COMMENT = re.compile(r"""("(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')|//[^\n]*|/\*.*?\*/""", re.DOTALL)


def load_config(path: str) -> dict:
    text = Path(path).read_text()
    if Path(path).suffix == ".json5":
        text = _COMMENT.sub(lambda m: m[1] or "", text)
    if Path(path).suffix in (".yml", ".yaml", ".json5"):
        import yaml

        return yaml.safe_load(text)
    return json.loads(text)


def unique_names(names: list[str]) -> list[str]:
    """Later duplicates get _1, _2."""
    seen: set[str] = set()
    out = []
    for n in names:
        k, new = 0, n
        while new in seen:
            k += 1
            new = f"{n}_{k}"
        seen.add(new)
        out.append(new)
    return out


def concat_columns(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Side by side on keys; clashing names get a suffix."""
    others = [c for c in right.columns if c not in keys]
    new = unique_names([*left.columns, *others])[len(left.columns) :]
    return left.join(right.toDF(*[dict(zip(others, new, strict=True)).get(c, c) for c in right.columns]), keys)


def save_state(state: dict, path: str) -> None:
    """A fitted operator's state as JSON beside its config; no pickle."""
    Path(path).mkdir(parents=True, exist_ok=True)
    (Path(path) / "state.json").write_text(json.dumps(state, default=lambda x: x.tolist() if hasattr(x, "tolist") else str(x)))


def load_state(path: str) -> dict:
    return json.loads((Path(path) / "state.json").read_text())
