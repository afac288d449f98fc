"""Prepared datasets that are rebuilt file by file (SNK9).

``prepare`` keeps a formatted copy of a folder of source files.  A *manifest* lists every source file with its size, its
time, the number of its rows and a fingerprint of their contents, and the folder that holds its rows in prepared form.  On
the next call files with the same size and time are taken as they are; the others are fingerprinted, and only those whose
contents changed are built again, all in one job.  Files that are gone leave the manifest.

Everything is written under a new name.  The last step renames the pointer ``CURRENT``, which names the manifest; a reader
follows it, so it sees the earlier state or the new one and nothing between.  A run that dies leaves folders that no
manifest names, and they are never read; ``remove_unused`` deletes them.

``build`` turns rows into rows and keeps the column ``source_file``; it may not mix rows of several files.  A debug copy
(``debug_rows``) lives beside the whole one under its own pointer and holds the first rows only.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER = "CURRENT"


@dataclass
class SourceFile:
    name: str
    size: int
    modified: int
    rows: int
    fingerprint: str
    folder: str             # below the target; empty if the build left no row of the file


@dataclass
class Manifest:
    version: str
    schema: str             # of the prepared rows, as JSON
    files: list[SourceFile] = field(default_factory=list)
    rebuilt: list[str] = field(default_factory=list)


class _Folder:
    """Small files below a path, through the file system that Spark uses for it."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf, self.root = spark._jvm, spark._jsc.hadoopConfiguration(), root.rstrip("/")
        self.fs = self.path("").getFileSystem(self.conf)
        self.gateway = spark.sparkContext._gateway

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def read(self, name: str) -> str | None:
        if not self.fs.exists(self.path(name)):
            return None
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self.fs.create(self.path(name), True)
        stream.write(bytearray(text.encode()))
        stream.close()

    def replace(self, name: str, text: str) -> None:
        """Write a file under another name and rename it over ``name`` in one step."""
        draft = f".{name}-{uuid.uuid4().hex[:8]}"
        self.write(draft, text)
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path("").toUri(), self.conf)
        kind = getattr(self.jvm, "org.apache.hadoop.fs.Options$Rename")
        how = self.gateway.new_array(kind, 1)
        how[0] = kind.OVERWRITE
        qualified = context.makeQualified
        context.rename(qualified(self.path(draft)), qualified(self.path(name)), how)

    def names(self, name: str) -> list[str]:
        if not self.fs.exists(self.path(name)):
            return []
        return [s.getPath().getName() for s in self.fs.listStatus(self.path(name))]

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


def _listing(spark: SparkSession, source: str, pattern: str) -> dict[str, tuple[str, int, int]]:
    """name -> (path, bytes, time) of the source files; their contents are not read."""
    try:
        found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(source)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    rows = found.select("path", "length", F.unix_micros("modificationTime").alias("t")).collect()     # one row a file
    return {r["path"].rsplit("/", 1)[1]: (r["path"], r["length"], r["t"]) for r in rows}


def read_manifest(spark: SparkSession, target: str, debug: bool = False) -> Manifest | None:
    folder = _Folder(spark, target)
    version = folder.read(f"{POINTER}-debug" if debug else POINTER)
    text = folder.read(f"manifests/{version}.json") if version else None
    if text is None:
        return None
    state = json.loads(text)
    return Manifest(state["version"], state["schema"], [SourceFile(**f) for f in state["files"]], state["rebuilt"])


def _fingerprints(rows: DataFrame) -> dict[str, tuple[int, str]]:
    """source_file -> (rows, sum of row hashes): independent of the order and of the layout of the file."""
    whole = F.xxhash64(*[F.col(c) for c in rows.columns if c != "source_file"]).cast("decimal(38,0)")
    found = rows.groupBy("source_file").agg(F.count(F.lit(1)).alias("n"), F.sum(whole).alias("h")).collect()     # one row a file
    return {r["source_file"]: (r["n"], str(r["h"])) for r in found}


def prepare(spark: SparkSession, source: str, target: str, build: Callable[[DataFrame], DataFrame],
            read: Callable[[SparkSession, Sequence[str]], DataFrame], pattern: str = "*", refresh: bool = False,
            debug_rows: int | None = None) -> Manifest:
    """Bring the prepared copy of ``source`` up to date; ``read(spark, paths)`` reads source files."""
    folder = _Folder(spark, target)
    listed = _listing(spark, source, pattern)
    pointer = f"{POINTER}-debug" if debug_rows is not None else POINTER
    before = None if refresh else read_manifest(spark, target, debug_rows is not None)
    known = {f.name: f for f in before.files} if before else {}
    kept = {n: f for n, f in known.items() if n in listed and (f.size, f.modified) == listed[n][1:]}
    same_kind = before is not None and (debug_rows is None or before.version.endswith(f"-{debug_rows}"))
    if same_kind and len(kept) == len(listed) == len(known):
        return before

    def rows_of(names: Sequence[str]) -> DataFrame:
        return read(spark, [listed[n][0] for n in names]).withColumn("source_file", F.col("_metadata.file_name"))

    version = uuid.uuid4().hex[:12] + (f"-{debug_rows}" if debug_rows is not None else "")
    open_names = sorted(set(listed) - set(kept)) if debug_rows is None else sorted(listed)
    prints = _fingerprints(rows_of(open_names)) if open_names else {}
    changed = []
    for n in open_names:
        rows, mark = prints.get(n, (0, "0"))
        path, size, modified = listed[n]
        old = known.get(n)
        if debug_rows is None and old and (old.rows, old.fingerprint) == (rows, mark):
            kept[n] = SourceFile(n, size, modified, rows, mark, old.folder)        # touched or laid out anew, the same rows
        else:
            kept[n] = SourceFile(n, size, modified, rows, mark, "")
            changed.append(n)
    schema = before.schema if before else None
    if changed or schema is None:
        rows = rows_of(changed or open_names) if listed else None
        if rows is not None:
            if debug_rows is not None:
                rows = rows.orderBy("source_file", *[c for c in rows.columns if c != "source_file"]).limit(debug_rows)
            built = build(rows)
            place = f"data/{version}"
            built.withColumn("_part", F.md5("source_file")).write.partitionBy("_part").parquet(f"{target.rstrip('/')}/{place}")
            schema = built.schema.json()
            there = set(folder.names(place))
            for n in changed:
                part = f"_part={_md5(n)}"
                if part in there:
                    kept[n].folder = f"{place}/{part}"
    if schema is None:
        raise FileNotFoundError(f"no source files below {source}")
    manifest = Manifest(version, schema, [kept[n] for n in sorted(kept)], changed)
    folder.write(f"manifests/{version}.json", json.dumps(asdict(manifest)))
    folder.replace(pointer, version)
    return manifest


def _md5(text: str) -> str:
    import hashlib

    return hashlib.md5(text.encode(), usedforsecurity=False).hexdigest()


def read_prepared(spark: SparkSession, target: str, debug: bool = False) -> DataFrame:
    """The rows that the pointer names."""
    from pyspark.sql.types import StructType

    manifest = read_manifest(spark, target, debug)
    if manifest is None:
        raise FileNotFoundError(f"nothing prepared at {target}")
    schema = StructType.fromJson(json.loads(manifest.schema))
    paths = [f"{target.rstrip('/')}/{f.folder}" for f in manifest.files if f.folder]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def remove_unused(spark: SparkSession, target: str) -> list[str]:
    """Delete build folders and manifests that neither pointer needs; call it when no other run is at work."""
    folder, needed, versions = _Folder(spark, target), set(), set()
    for debug in (False, True):
        m = read_manifest(spark, target, debug)
        if m:
            versions.add(f"{m.version}.json")
            needed |= {f.folder.split("/")[1] for f in m.files if f.folder}
    gone = [f"data/{n}" for n in folder.names("data") if n not in needed]
    gone += [f"manifests/{n}" for n in folder.names("manifests") if not n.startswith(".") and n not in versions]
    for name in gone:
        folder.delete(name)
    return gone
