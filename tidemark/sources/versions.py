"""Sets of tables published together: all of a version is there, or the version is not.

Tables are written under names of their own; a manifest with each table's place, rows, content hash and schema comes last, by
a rename that fails where the number is taken.  Readers take the latest manifest.  A writer that died leaves files
no manifest names.  Loading checks what it reads against the manifest and refuses what differs.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FORMAT = 1


class VersionMismatch(ValueError):
    """What lies in a folder is not what its manifest says."""


def _fs(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _name(number: int) -> str:
    return f"manifest-{number:012d}.json"


def numbers(spark: SparkSession, folder: str) -> list[int]:
    """The published versions, ascending."""
    fs, place = _fs(spark, folder)
    if not fs.exists(place):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(place)]
    return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))


def publish(spark: SparkSession, folder: str, number: int, content: Mapping) -> bool:
    """Make a manifest visible in one step; False where the number is taken."""
    fs, target = _fs(spark, f"{folder}/{_name(number)}")
    if fs.exists(target):
        return False
    _, draft = _fs(spark, f"{folder}/.draft-{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps({"format": FORMAT, "number": number, **content}, sort_keys=True).encode()))
    out.close()
    done = fs.rename(draft, target)
    if not done:
        fs.delete(draft, False)
    return done


def manifest(spark: SparkSession, folder: str, number: int | None = None) -> dict | None:
    """The manifest of a version (the latest by default); None where there is none."""
    known = numbers(spark, folder)
    if not known or (number is not None and number not in known):
        return None
    text = spark.read.text(f"{folder}/{_name(known[-1] if number is None else number)}", wholetext=True).first()[0]
    found = json.loads(text)
    if found.get("format") != FORMAT:
        raise VersionMismatch(f"manifest format {found.get('format')!r}, this reads {FORMAT}")
    return found


def content(df: DataFrame) -> dict:
    """Rows and the order-free hash of a table's rows."""
    row = F.xxhash64(*[F.col(n) for n in df.columns]) if not any("map" in t for _, t in df.dtypes) else F.xxhash64(F.to_json(F.struct(*df.columns)))
    n, h = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(row.cast("decimal(38,0)")), F.lit(0)).cast("string")).first()
    return {"rows": n, "hash": h}


def save_set(spark: SparkSession, folder: str, tables: Mapping[str, DataFrame], meta: Mapping | None = None) -> int:
    """Write the tables and publish them as the next version; its number."""
    run = uuid.uuid4().hex
    held = {}
    for name, df in tables.items():
        path = f"{folder}/{name}-{run}"
        df.write.parquet(path)
        held[name] = {"path": path, "schema": df.schema.jsonValue(), **content(spark.read.schema(df.schema).parquet(path))}
    number = (numbers(spark, folder) or [0])[-1] + 1
    while not publish(spark, folder, number, {"tables": held, "meta": dict(meta or {})}):
        number += 1
    return number


def load_set(spark: SparkSession, folder: str, number: int | None = None, verify: bool = True) -> tuple[dict[str, DataFrame], dict]:
    """(tables by name, meta) of a version; refuses a missing, changed or cut table and a schema that drifted."""
    found = manifest(spark, folder, number)
    if found is None:
        raise VersionMismatch(f"{folder} has no {'version' if number is None else f'version {number}'}")
    out = {}
    for name, held in found["tables"].items():
        fs, place = _fs(spark, held["path"])
        if not fs.exists(place):
            raise VersionMismatch(f"table {name} of version {found['number']} is gone")
        schema = StructType.fromJson(held["schema"])
        df = spark.read.schema(schema).parquet(held["path"])
        if verify:
            stored = spark.read.parquet(held["path"])
            if [(f.name, f.dataType) for f in stored.schema] != [(f.name, f.dataType) for f in schema]:
                raise VersionMismatch(f"table {name} of version {found['number']} has another schema")
            now = content(df)
            if now != {k: held[k] for k in now}:
                raise VersionMismatch(f"table {name} of version {found['number']} has other rows: {now}")
        out[name] = df
    return out, found["meta"]
