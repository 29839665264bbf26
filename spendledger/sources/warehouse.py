"""The ledger as parquet tables, published country by country.

Every write goes to a folder of its own and is seen by nobody until the country's next
version is published: a small file that names, for each table, the folders that make it
up.  Creating that file is the only step that changes what readers see, and it covers all
tables of the country, so a load that fails anywhere leaves every table as it was.
Earlier versions stay readable until they are vacuumed.
"""
from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from urllib.parse import quote, unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.history import merge_decisions

#: Owner of tables that belong to no country.
SHARED = ""
_VERSIONS = "_versions"
_COUNTRY, _LOAD = "country_code", "load"
#: Tables searched by one value: files are sorted by it and carry a Bloom filter over it, so a look-up reads few of them.
LOOKED_UP = {"staged": "source_record_id", "facts": "source_record_id"}


class ConcurrentChange(RuntimeError):
    """Another change of the country was published since this one began."""


class Warehouse:
    """Tables under one folder.

    ``read`` joins what the newest version of every country names for a table.  Tables
    with a column ``country_code`` are partitioned by it; a shared table is the one
    written last.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        # Country codes are text even where they look like numbers.
        spark.conf.set("spark.sql.sources.partitionColumnTypeInference.enabled", "false")

    # --- files ---

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _files(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        files = self._files()
        return sorted(s.getPath().getName() for s in files.listStatus(path)) if files.exists(path) else []

    def _text(self, name: str) -> str:
        stream = self._files().open(self._path(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _create(self, name: str, text: str) -> None:
        """A whole file that appears at once, or an error if it is there already."""
        draft = self._path(f"{_VERSIONS}/.{uuid.uuid4().hex}")
        files, jvm = self._files(), self.spark._jvm
        out = files.create(draft, True)
        out.write(bytearray(text, "utf-8"))
        out.close()
        target = self._path(name)
        files.mkdirs(target.getParent())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(
                files.getUri(), self.spark._jsc.hadoopConfiguration()).rename(files.makeQualified(draft), files.makeQualified(target), none)
        except Py4JJavaError as e:
            files.delete(draft, False)
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                raise ConcurrentChange(name) from e
            raise

    # --- versions ---

    def versions(self, country: str) -> list[int]:
        """Published versions of a country, oldest first."""
        return [int(n.removesuffix(".json")) for n in self._names(f"{_VERSIONS}/owner={quote(country, safe='')}") if n[:1].isdigit()]

    def countries(self) -> list[str]:
        """Countries with a published version."""
        found = [unquote(n.removeprefix("owner=")) for n in self._names(_VERSIONS) if n.startswith("owner=")]
        return [c for c in found if c != SHARED]

    def manifest(self, country: str, version: int | None = None) -> dict:
        """What a version names: ``tables``, each with ``schema``, ``stamp`` and ``paths``."""
        known = self.versions(country)
        if version is None:
            version = known[-1] if known else 0
        if version == 0:
            return {"version": 0, "tables": {}}
        return json.loads(self._text(f"{_VERSIONS}/owner={quote(country, safe='')}/{version:012d}.json"))

    def restore(self, country: str, version: int) -> int:
        """Publish an earlier version again, as the newest."""
        return self._publish(country, self.versions(country)[-1], self.manifest(country, version)["tables"])

    def _publish(self, country: str, base: int, tables: dict) -> int:
        text = json.dumps({"version": base + 1, "tables": tables}, indent=1, sort_keys=True)
        self._create(f"{_VERSIONS}/owner={quote(country, safe='')}/{base + 1:012d}.json", text)
        return base + 1

    def vacuum(self, keep: int = 1) -> int:
        """Delete the folders that none of the newest ``keep`` versions of any country names; the number deleted.

        Not to be run beside a load, whose folders are not named yet.
        """
        named, old = set(), []
        for owner in [*self.countries(), SHARED]:
            known = self.versions(owner)
            old += [f"{_VERSIONS}/owner={quote(owner, safe='')}/{v:012d}.json" for v in known[:-keep]]
            for v in known[-keep:]:
                named |= {p for t in self.manifest(owner, v)["tables"].values() for p in t["paths"]}
        gone = [f"{table}/{load}" for table in self._names("") if not table.startswith("_")
                for load in self._names(table) if not any(p == f"{table}/{load}" or p.startswith(f"{table}/{load}/") for p in named)]
        for name in [*gone, *old]:
            self._files().delete(self._path(name), True)
        return len(gone)

    # --- reading ---

    def exists(self, table: str) -> bool:
        return any(table in self.manifest(c)["tables"] for c in [*self.countries(), SHARED])

    def read(self, table: str, at: Mapping[str, int] | None = None) -> DataFrame:
        """A table over all countries, some of them at an earlier version (``at``)."""
        at = at or {}
        owners = [*self.countries(), SHARED]
        return self._view(table, [self.manifest(c, at.get(c)) for c in owners])

    def _view(self, table: str, manifests: Sequence[dict]) -> DataFrame:
        """Review decisions are merged into the history, findings of all kinds into the register."""
        rows = self._rows(table, manifests)
        if table == "classification" and any("decided" in m["tables"] for m in manifests):
            rows = merge_decisions(rows, self._rows("decided", manifests))
        if table == "issues":
            for more in ("guard_issues", "rate_issues"):
                if any(more in m["tables"] for m in manifests):
                    rows = rows.unionByName(self._rows(more, manifests), allowMissingColumns=True)
        return rows

    def _rows(self, table: str, manifests: Sequence[dict]) -> DataFrame:
        entries = [m["tables"][table] for m in manifests if table in m["tables"]]
        if not entries:
            raise KeyError(f"{self.root} has no table {table}")
        newest = max(entries, key=lambda e: e["stamp"])
        schema = StructType.fromJson(newest["schema"])
        paths = [f"{self.root}/{p}" for e in (entries if _COUNTRY in schema.names else [newest]) for p in e["paths"]]
        if not paths:
            return self.spark.createDataFrame([], schema)
        read = self.spark.read.schema(schema).option("basePath", f"{self.root}/{table}").parquet(*paths)
        return read.select(*[F.col(f"`{c}`") for c in schema.names])

    # --- writing ---

    def write(self, table: str, rows: DataFrame) -> dict[str, list[str]]:
        """Rows in a new folder that no version names yet: the paths of each country (of ``SHARED`` without one)."""
        folder = f"{table}/{_LOAD}={uuid.uuid4().hex}"
        if _COUNTRY not in rows.columns:
            rows.write.parquet(f"{self.root}/{folder}")
            return {SHARED: [folder]}
        by = LOOKED_UP.get(table)
        if by in rows.columns:
            rows = rows.sortWithinPartitions(_COUNTRY, by)
            writer = rows.write.option(f"parquet.bloom.filter.enabled#{by}", "true")
        else:
            writer = rows.write
        writer.partitionBy(_COUNTRY).parquet(f"{self.root}/{folder}")
        return {unquote(n.partition("=")[2]): [f"{folder}/{n}"] for n in self._names(folder) if n.startswith(f"{_COUNTRY}=")}

    @contextmanager
    def change(self, *countries: str) -> Iterator["Change"]:
        """All writes of the block become visible together for each country when it ends; after an error none does.

        With several countries each is published at once and they follow one another.
        """
        change = Change(self, countries)
        yield change
        for country in countries:
            self._publish(country, change.base[country], change.tables[country])

    def replace_countries(self, table: str, rows: DataFrame) -> None:
        """A table's rows for exactly the countries present in ``rows``; a country without a row keeps what it had."""
        self._all(table, rows, False)

    def append(self, table: str, rows: DataFrame) -> None:
        self._all(table, rows, True)

    def _all(self, table: str, rows: DataFrame, keep: bool) -> None:
        for country, paths in self.write(table, rows).items():
            with self.change(country) as change:
                change.name(table, rows.schema, {country: paths}, keep)

    def rewrite(self, table: str, rows: DataFrame) -> None:
        """A whole shared table, whatever its columns."""
        folder = f"{table}/{_LOAD}={uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{folder}")
        with self.change(SHARED) as change:
            change.name(table, rows.schema, {SHARED: [folder]}, False)

    @contextmanager
    def step(self, name: str, rows: DataFrame) -> Iterator[DataFrame]:
        """``rows`` written to a folder of this run alone and read back; the folder goes when the block ends."""
        path = f"_steps/{name}-{uuid.uuid4().hex}"
        try:
            rows.write.parquet(f"{self.root}/{path}")
            yield self.spark.read.schema(rows.schema).parquet(f"{self.root}/{path}")
        finally:
            self._files().delete(self._path(path), True)


class Change:
    """What a country's next version will name."""

    def __init__(self, warehouse: Warehouse, countries: Sequence[str]):
        self.warehouse = warehouse
        found = {c: warehouse.manifest(c) for c in countries}
        self.base = {c: m["version"] for c, m in found.items()}
        self.tables = {c: dict(m["tables"]) for c, m in found.items()}

    def name(self, table: str, schema: StructType, paths: Mapping[str, list[str]], keep: bool) -> None:
        """Make written folders part of a table, behind those it has (``keep``) or in their place."""
        if strange := set(paths) - set(self.tables) - {SHARED}:
            raise ValueError(f"{table} has rows of {sorted(strange)}, which this change does not cover")
        shared = _COUNTRY not in schema.names
        for country, tables in self.tables.items():
            had = tables[table]["paths"] if keep and table in tables else []
            tables[table] = {"schema": json.loads(schema.json()), "stamp": time.time_ns(),
                             "paths": [*had, *paths.get(SHARED if shared else country, [])]}

    def replace(self, table: str, rows: DataFrame) -> None:
        """``rows`` instead of what the countries had; no row leaves the table empty for them."""
        self.name(table, rows.schema, self.warehouse.write(table, rows), False)

    def append(self, table: str, rows: DataFrame) -> None:
        self.name(table, rows.schema, self.warehouse.write(table, rows), True)

    def clear(self, *tables: str) -> None:
        """Leave nothing of the countries in these tables."""
        for mine in self.tables.values():
            for table in tables:
                if table in mine:
                    mine[table] = {**mine[table], "paths": []}

    def exists(self, table: str) -> bool:
        return any(table in mine for mine in self.tables.values())

    def read(self, table: str) -> DataFrame:
        """The countries' rows as they will be."""
        return self.warehouse._view(table, [{"tables": mine} for mine in self.tables.values()])


def export_csv(report: DataFrame, path: str) -> None:
    """A report as UTF-8 CSV with a header, one file per partition."""
    report.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
