"""Publishing the reports of runs as one transaction.

    data/<report>/attempt=<id>/<run>=.../     what an attempt wrote; nobody reads it by itself
    attempts/<id>                             a mark of the attempt's start
    manifests/v<number>/                      (run, report) rows: the attempt whose rows hold, how many, their digest

An attempt first writes all its reports into folders of its own and reads them back, which gives counts and digests
(prepare). Then the next manifest, the last one with the attempt's runs replaced, is written aside and put in place by
one rename that never replaces anything (commit). Readers follow the newest manifest, so they see all reports of a run
or those it had before, and a writer that is lost at any point leaves nothing but folders that :func:`sweep` removes.
Two writers that meet are told apart by the rename: the later one builds its manifest anew on the other's, or fails if
both replaced the same run.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from capsieve.sources.store import Folder

MANIFEST = "run string, report string, attempt string, n long, digest decimal(38,0), fields string"


class Conflict(RuntimeError):
    """Another writer has published one of the same runs meanwhile."""


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the manifests, ascending."""
    return [int(n[1:]) for n in Folder(spark, root).names("manifests") if n.startswith("v")]


def manifest(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The rows of a manifest, by default the newest; none before the first publication."""
    known = versions(spark, root)
    version = version if version is not None else max(known, default=0)
    if not version:
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{root}/manifests/v{version:012d}")


def _digest(fields: StructType, run: str) -> Column:
    """A sum over rows, whatever their order. Maps can't be hashed and count by their sorted entries."""
    kinds = {f.name: f.dataType.typeName() for f in fields}
    cells = [F.array_sort(F.map_entries(c)) if kind == "map" else F.col(c) for c, kind in kinds.items() if c != run]
    return F.coalesce(F.sum(F.xxhash64(*cells, F.lit(0)).cast("decimal(20,0)")), F.lit(0)).cast("decimal(38,0)")


def _files(spark: SparkSession, root: str, report: str, attempts: list[str], fields: StructType) -> DataFrame:
    base = f"{root}/data/{report}"
    if not attempts:
        return spark.createDataFrame([], StructType([*fields, *StructType.fromDDL("attempt string")]))
    reader = spark.read.schema(StructType([*fields, *StructType.fromDDL("attempt string")])).option("basePath", base)
    return reader.parquet(*[f"{base}/attempt={a}" for a in attempts])


def prepare(spark: SparkSession, root: str, reports: dict[str, DataFrame], runs: DataFrame | None = None, run: str = "run_id") -> DataFrame:
    """Phase one: write the reports into an attempt's own folders; the manifest rows they ask for.

    Every run has a row for every report, so a run without rows in a report has none after the commit. ``runs`` names
    them; by default they are those in the reports.
    """
    attempt = uuid.uuid4().hex
    Folder(spark, root).make(f"attempts/{attempt}")
    counted = []
    for report, df in reports.items():
        df.write.partitionBy(run).parquet(f"{root}/data/{report}/attempt={attempt}")
        found = _files(spark, root, report, [attempt], df.schema)
        counted.append(
            found.groupBy(F.col(run).cast("string").alias("run")).agg(F.count(F.lit(1)).alias("n"), _digest(df.schema, run).alias("digest"))
            .withColumn("report", F.lit(report))
        )
    rows = counted[0]
    for more in counted[1:]:
        rows = rows.unionByName(more)
    rows = _keep(rows, f"{root}/attempts/{attempt}/counts")
    if rows.where("run IS NULL").limit(1).count():
        raise ValueError("rows without a run can't be published")
    said = rows.select("run") if runs is None else runs.select(F.col(run).cast("string").alias("run")).union(rows.select("run"))
    about = spark.createDataFrame([(name, df.schema.json()) for name, df in reports.items()], "report string, fields string")
    every = said.distinct().withColumn("report", F.explode(F.array(*[F.lit(r) for r in reports])))
    wanted = every.join(rows, ["run", "report"], "left").join(F.broadcast(about), "report")
    wanted = wanted.select("run", "report", F.lit(attempt).alias("attempt"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("digest", F.lit(0)).cast("decimal(38,0)").alias("digest"), "fields")
    return _keep(wanted, f"{root}/attempts/{attempt}/rows")


def _keep(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def commit(spark: SparkSession, root: str, prepared: DataFrame, base: int, tries: int = 20) -> int:
    """Phase two: put the next manifest in place; its number. ``base`` is the version the attempt started from."""
    folder, keys = Folder(spark, root), ["run", "report"]
    folder.make("manifests")
    mine = prepared.select("run").distinct()
    for _ in range(tries):
        last = max(versions(spark, root), default=0)
        held = manifest(spark, root, last)
        if last > base:
            before = manifest(spark, root, base).select(*keys, F.col("attempt").alias("_before"))
            theirs = held.join(mine, "run", "left_semi").join(before, keys, "left")
            if theirs.where("NOT attempt <=> _before").limit(1).count():
                raise Conflict(f"another writer has published one of these runs since version {base}")
        aside = f"manifests/_{uuid.uuid4().hex}"
        held.join(prepared.select(*keys), keys, "left_anti").unionByName(prepared).write.parquet(f"{root}/{aside}")
        if folder.place(aside, f"manifests/v{last + 1:012d}"):
            return last + 1
        folder.remove(aside)
    raise Conflict("other writers were faster each time")


def publish(spark: SparkSession, root: str, reports: dict[str, DataFrame], runs: DataFrame | None = None, run: str = "run_id") -> int:
    """Replace the given reports of the runs they hold, all at once; the number of the version that does.

    Reports that aren't given stay as they are. The frames are computed once.
    """
    base = max(versions(spark, root), default=0)
    return commit(spark, root, prepare(spark, root, reports, runs, run), base)


def read(spark: SparkSession, root: str, report: str, version: int | None = None, run: str = "run_id") -> DataFrame:
    """Rows of a report as a version has them, by default the newest.

    The names of the attempts that a version uses come to the driver, of the rows nothing.
    """
    held = manifest(spark, root, version).where(F.col("report") == report)
    used = held.groupBy("attempt").agg(F.max("fields").alias("fields"), F.sum("n").alias("n")).collect()
    if not used:
        raise ValueError(f"no report {report} has been published")
    times = dict(Folder(spark, root).entries("attempts"))
    newest = max(used, key=lambda r: times.get(r["attempt"], 0))
    fields = StructType.fromJson(json.loads(newest["fields"]))
    rows = _files(spark, root, report, [r["attempt"] for r in used if r["n"]], fields)
    live = held.select(F.col("run").alias("_run"), F.col("attempt").alias("_attempt"))
    same = (F.col(run).cast("string") == F.col("_run")) & (F.col("attempt") == F.col("_attempt"))
    return rows.join(live, same, "left_semi").select(*fields.names)


def check(spark: SparkSession, root: str, version: int | None = None, run: str = "run_id") -> DataFrame:
    """``run``, ``report``, ``n``, ``n_found`` and ``same``: what the manifest says against the files themselves."""
    held = manifest(spark, root, version)
    out = None
    for report in sorted(r["report"] for r in held.select("report").distinct().collect()):
        said = held.where(F.col("report") == report)
        rows = read(spark, root, report, version, run)
        found = rows.groupBy(F.col(run).cast("string").alias("run")).agg(F.count(F.lit(1)).alias("_n"), _digest(rows.schema, run).alias("_digest"))
        n = F.coalesce("_n", F.lit(0))
        same = (n == F.col("n")) & (F.coalesce("_digest", F.lit(0)) == F.col("digest"))
        part = said.join(found, "run", "left").select("run", "report", "n", n.alias("n_found"), same.alias("same"))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "run string, report string, n long, n_found long, same boolean")


def sweep(spark: SparkSession, root: str, keep: int = 2, older_than_seconds: float = 86_400) -> list[str]:
    """Remove what lost writers left and what only versions before the last ``keep`` use; names of the attempts removed.

    Attempts and manifests of the last ``older_than_seconds`` stay, as their writers may be at work.
    """
    folder, before = Folder(spark, root), (time.time() - older_than_seconds) * 1000
    known = versions(spark, root)
    kept = known[max(0, len(known) - keep) :]
    used: set[str] = set()
    for v in kept:
        used |= {r["attempt"] for r in manifest(spark, root, v).select("attempt").distinct().collect()}
    gone = [a for a, at in folder.entries("attempts") if a not in used and at <= before]
    for number in known:
        if number not in kept:
            folder.remove(f"manifests/v{number:012d}")
    for name, at in folder.entries("manifests"):
        if name.startswith("_") and at <= before:
            folder.remove(f"manifests/{name}")
    for attempt in gone:
        for report in folder.names("data"):
            folder.remove(f"data/{report}/attempt={attempt}")
        folder.remove(f"attempts/{attempt}")
    return gone
