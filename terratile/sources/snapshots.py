"""Versioned tables with keys, parents and ranges, checked before a version is seen.

A version is a small file that names, for each table, the folder of its rows.
A commit writes new folders, checks them on the written rows, and then creates
the file of the next version, which the file system grants to one writer only:
of two writers that started from one version one wins and the other gets
``Conflict``.  A failed commit takes its folders away.  Readers name a version
(the last by default) and keep its folders, whatever is committed later.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terratile.storage import shared_dir


class Conflict(RuntimeError):
    """Another writer has made the version that this one was to make."""


class Violation(ValueError):
    """The rows break rules; the message names each with the number of rows."""


@dataclass(frozen=True)
class Rules:
    """What the rows of a table must hold: a key that is there and stands once, columns that are there, parents, and tests (null passes)."""

    key: str
    required: tuple[str, ...] = ()
    parents: dict[str, tuple[str, str]] = field(default_factory=dict)  # column -> (table, its key)
    tests: dict[str, Column] = field(default_factory=dict)


class Snapshots:
    def __init__(self, spark: SparkSession, root: str, rules: dict[str, Rules]):
        self.spark, self.root, self.rules = spark, root.rstrip("/"), rules
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/versions"))

    def version(self) -> int:
        """The last version, 0 for none."""
        names = (f.getPath().getName() for f in self._fs.listStatus(self._path(f"{self.root}/versions")))
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json")), default=0)

    def folders(self, version: int | None = None) -> dict[str, str]:
        version = self.version() if version is None else version
        if not version:
            return {}
        text = self.spark.read.text(f"{self.root}/versions/{version:09d}.json", wholetext=True).first()[0]
        return json.loads(text)

    def read(self, table: str, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(self.folders(version)[table])

    def faults(self, table: str, rows: DataFrame, folders: dict[str, str]) -> dict[str, int]:
        """Rule -> rows that break it."""
        rule = self.rules[table]
        found = rows.agg(
            *[F.count_if(F.col(c).isNull()).alias(f"{c} is missing") for c in dict.fromkeys((rule.key, *rule.required))],
            *[F.count_if(~test).alias(name) for name, test in rule.tests.items()],
        ).first()
        out = found.asDict()
        out[f"{rule.key} comes twice"] = rows.where(F.col(rule.key).isNotNull()).groupBy(rule.key).count().where("count > 1").count()
        for column, (parent, key) in rule.parents.items():
            known = self.spark.read.parquet(folders[parent]).select(F.col(key).alias(column)) if parent in folders else rows.select(column).limit(0)
            out[f"{column} is unknown in {parent}"] = rows.where(F.col(column).isNotNull()).join(known, column, "left_anti").count()
        return {k: n for k, n in out.items() if n}

    def commit(self, base: int, tables: dict[str, DataFrame]) -> int:
        """The version after ``base`` with the rows of ``tables`` in place of what they were; all others stay."""
        written = {name: f"{self.root}/{name}/{shared_dir(self.spark, name).rsplit('/', 1)[-1]}" for name in tables}
        folders = self.folders(base) | written
        try:
            for name, rows in tables.items():
                rows.write.parquet(written[name])
            children = {n for n, r in self.rules.items() if n in folders and any(p in tables for p, _ in r.parents.values())}
            wrong = {n: found for n in [*tables, *sorted(children - set(tables))] if (found := self.faults(n, self.spark.read.parquet(folders[n]), folders))}
            if wrong:
                raise Violation("; ".join(f"{n}: {what} ({k} rows)" for n, found in wrong.items() for what, k in found.items()))
            self._create(base + 1, json.dumps(folders))
        except BaseException:
            for folder in written.values():
                self._fs.delete(self._path(folder), True)
            raise
        return base + 1

    def _create(self, version: int, text: str) -> None:
        at = self._path(f"{self.root}/versions/{version:09d}.json")
        if self._fs.exists(at):
            raise Conflict(f"version {version} is there already")
        try:
            out = self._fs.create(at, False)  # fails if it is there, so one writer gets it
        except Exception as e:
            raise Conflict(f"version {version} is there already") from e
        out.write(bytearray(text.encode()))
        out.close()


def catalogue_rules() -> dict[str, Rules]:
    """The catalogue's tables: collections, their scenes, observations of scenes, tiles of observations."""
    return {
        "collections": Rules("collection_id", ("sensor",)),
        "scenes": Rules("scene_id", ("collection_id", "platform"), {"collection_id": ("collections", "collection_id")}),
        "observations": Rules("observation_id", ("scene_id", "acquired_at"), {"scene_id": ("scenes", "scene_id")}, {"acquired_at is no date": F.try_to_date("acquired_at").isNotNull()}),
        "tiles": Rules(
            "tile_id", ("observation_id", "row_no", "col_no", "cloud"), {"observation_id": ("observations", "observation_id")},
            {"cloud lies outside 0 and 1": F.col("cloud").between(0, 1), "row or column is negative": (F.col("row_no") >= 0) & (F.col("col_no") >= 0), "box is turned round": (F.col("west") <= F.col("east")) & (F.col("south") <= F.col("north"))},
        ),
    }
