"""Run identity, checked before a run is resumed; written whole and renamed into place."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, is_dataclass

from pyspark.sql import SparkSession

FORMAT = 1


def run_manifest(personas: list, cfg, records: int = 0) -> dict:
    plain = lambda x: asdict(x) if is_dataclass(x) else x
    inputs = json.dumps([[plain(p) for p in personas], plain(cfg)], sort_keys=True, default=str)
    return {"format": FORMAT, "inputs": hashlib.sha256(inputs.encode()).hexdigest(), "records": records}


def save_manifest(spark: SparkSession, path: str, manifest: dict) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target, part = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path + ".part")
    fs = target.getFileSystem(conf)
    out = fs.create(part, True)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.hsync()
    out.close()
    fs.delete(target, False)
    if not fs.rename(part, target):
        raise OSError(f"cannot move the manifest to {path}")


def load_manifest(spark: SparkSession, path: str, expected: dict) -> dict:
    """The stored manifest; another format or other inputs refuse to resume."""
    found = json.loads(spark.read.text(path, wholetext=True).first()[0])
    for key in ("format", "inputs"):
        if found.get(key) != expected[key]:
            raise ValueError(f"manifest mismatch in {key}")
    if found.get("records", -1) < 0:
        raise ValueError("manifest without a record count")
    return found
