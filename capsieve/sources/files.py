"""File sources: media catalogs, text files, JSON artefacts, term and exclusion files."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterable, Iterator, Sequence
from fnmatch import fnmatchcase
from functools import reduce
from itertools import islice
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyarrow.fs import FileInfo, FileSelector, FileSystem, FileType, LocalFileSystem
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from capsieve.functions.binding import strict_json
from capsieve.functions.paths import is_video, target_path
from capsieve.functions.text import strip_space
from capsieve.session import materialize

LISTED = "root STRING, root_ord INT, path STRING, is_dir BOOLEAN, length BIGINT, modification_time TIMESTAMP"
ROWS_PER_BATCH = 10_000
CHUNK, BYTES_PER_BATCH = 1 << 20, 4 << 20


def open_store(path: str) -> tuple[FileSystem, str]:
    if path.startswith("file:"):
        return LocalFileSystem(), "/" + path[len("file:") :].lstrip("/")
    return FileSystem.from_uri(path) if "://" in path else (LocalFileSystem(), path)


def _linked(store: FileSystem, path: str) -> bool:
    return isinstance(store, LocalFileSystem) and os.path.islink(path)


def _some(store: FileSystem, folder: str) -> Iterator[list[FileInfo]]:
    """What a folder holds, some entries at a time; of a local one no more than these are in memory."""
    if not isinstance(store, LocalFileSystem):
        entries = store.get_file_info(FileSelector(folder))
        yield from (entries[at : at + ROWS_PER_BATCH] for at in range(0, len(entries), ROWS_PER_BATCH))
        return
    with os.scandir(folder) as found:
        while names := [e.path for e in islice(found, ROWS_PER_BATCH)]:
            yield store.get_file_info(names)


def _list_folders(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for root, order, folder in zip(frame["root"], frame["root_ord"], frame["path"]):
            store, inner = open_store(folder)
            base = folder[: len(folder) - len(inner)]
            for entries in _some(store, inner):
                # A linked folder is neither a file nor walked: links can form cycles.
                some = [e for e in entries if e.type != FileType.Directory or not _linked(store, e.path)]
                yield pd.DataFrame(
                    {
                        "root": root,
                        "root_ord": order,
                        "path": [base + e.path for e in some],
                        "is_dir": [e.type == FileType.Directory for e in some],
                        "length": [e.size or 0 for e in some],
                        "modification_time": pd.to_datetime([e.mtime_ns for e in some], unit="ns", utc=True).floor("us"),
                    }
                )


def list_files(spark: SparkSession, roots: Sequence[str]) -> DataFrame:
    """Every file under the roots, level by level; the folders of one level are listed in parallel.

    Spark's own file sources leave out empty files and names that start with ``_`` or ``.``, which
    count here.
    """
    if not roots:
        raise ValueError("at least one root is needed")
    distinct = [r.rstrip("/") for r in dict.fromkeys(roots)]
    level = spark.createDataFrame([(r, i, r) for i, r in enumerate(dict.fromkeys(distinct))], "root STRING, root_ord INT, path STRING")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = []
    while True:
        spread = level.select("root", "root_ord", "path").repartition(parts, "path")
        listed = materialize(spread.mapInPandas(_list_folders, LISTED))
        found.append(listed.filter("NOT is_dir").drop("is_dir"))
        level = listed.filter("is_dir")
        if level.isEmpty():
            return reduce(DataFrame.unionByName, found)


def normalize_roots(roots: Sequence[str]) -> list[str]:
    """The real folders behind the roots, once each, in their order; a root that is no folder is an error."""
    found: dict[str, None] = {}
    for root in roots:
        store, inner = open_store(os.path.expanduser(root))
        if isinstance(store, LocalFileSystem):
            inner = os.path.realpath(inner)
        if store.get_file_info(inner).type != FileType.Directory:
            raise ValueError(f"no such folder: {root}")
        scheme = root.partition("://")[0] + "://" if "://" in root else ""
        # The host of a remote root stays in front of its path.
        found[scheme + inner if not scheme or isinstance(store, LocalFileSystem) else root.rstrip("/")] = None
    if not found:
        raise ValueError("at least one root is needed")
    return list(found)


def _resolve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        real, targets, kept = [], [], []
        for named, beside in zip(frame["named_path"], frame["target_path"]):
            store, inner = open_store(named)
            local = isinstance(store, LocalFileSystem)
            head = named[: len(named) - len(inner)]
            real.append(head + os.path.realpath(inner) if local else named)
            targets.append(head + os.path.realpath(beside[len(head) :]) if local else beside)
            kept.append(os.path.isfile(inner) if local else True)
        resolved = frame.assign(path=real, target_path=targets)
        yield resolved[pd.Series(kept, index=frame.index, dtype=bool)]


def resolve_links(listed: DataFrame) -> DataFrame:
    """Linked files under their real ``path``; ``named_path`` is the listed one, ``target_path`` the real text beside that.

    Links to nothing are left out. Object stores have no links, so their paths stay. Two names of one file give two rows.
    """
    named = listed.withColumns({"named_path": F.col("path"), "target_path": target_path(F.col("path"))})
    return named.mapInPandas(_resolve, named.schema)


def scan_media(spark: SparkSession, roots: Sequence[str]) -> DataFrame:
    """Video files under the roots; file contents are not read."""
    return list_files(spark, roots).filter(is_video(F.col("path")))


def scan_texts(spark: SparkSession, roots: Sequence[str], content: bool = True) -> DataFrame:
    """``*.txt`` files under the roots, with their bytes."""
    return scan_listed_texts(list_files(spark, roots), content)


def scan_listed_texts(listed: DataFrame, content: bool = True) -> DataFrame:
    """The ``*.txt`` files of a listing, once each, with their bytes."""
    name = "named_path" if "named_path" in listed.columns else "path"
    texts = listed.filter(F.col(name).rlike(r"\.txt$")).dropDuplicates(["path"]).drop("named_path", "target_path")
    return _with_bytes(texts) if content else texts


def _read_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with their files' bytes, in batches of a few MB unless a file alone is larger."""
    for batch in batches:
        at, held, size = 0, [], 0
        for i, path in enumerate(batch.column("path").to_pylist()):
            store, inner = open_store(path)
            with store.open_input_stream(inner) as stream:
                held.append(stream.read())
            size += len(held[-1])
            if size >= BYTES_PER_BATCH or i == batch.num_rows - 1:
                rows = batch.slice(at, len(held))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(held, pa.binary())], names=[*batch.schema.names, "content"])
                at, held, size = i + 1, [], 0


def _with_bytes(listed: DataFrame) -> DataFrame:
    schema = T.StructType([*listed.schema.fields, T.StructField("content", T.BinaryType())])
    parts = int(listed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return listed.repartition(parts, "path").mapInArrow(_read_whole, schema)


def _patterns(path: str) -> list[str]:
    """The patterns that a path with ``{a,b}`` stands for."""
    found = re.search(r"\{([^{}]*)\}", path)
    if not found:
        return [path]
    return [p for one in found[1].split(",") for p in _patterns(path[: found.start()] + one + path[found.end() :])]


def _matching(store: FileSystem, base: str, steps: list[str]) -> Iterator[str]:
    """Files that a path with the signs ``*?[]`` names; of a folder the files right in it."""
    wild = next((n for n, step in enumerate(steps) if re.search(r"[*?\[]", step)), len(steps))
    base = "/".join([base, *steps[:wild]]) if wild else base
    if wild < len(steps):
        step, rest = steps[wild].replace("[^", "[!"), steps[wild + 1 :]
        for some in _some(store, base or "/"):
            for e in some:
                if fnmatchcase(e.base_name, step) and (not rest or e.type == FileType.Directory):
                    yield from _matching(store, e.path, rest) if rest or e.type == FileType.Directory else (e.path,)
        return
    kind = store.get_file_info(base).type
    if kind == FileType.File:
        yield base
    elif kind == FileType.Directory:
        yield from (e.path for some in _some(store, base) for e in some if e.type == FileType.File)


def _name_files(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for path in frame["path"]:
            for pattern in _patterns(path):
                store, inner = open_store(pattern)
                base = pattern[: len(pattern) - len(inner)]
                start, *steps = inner.rstrip("/").split("/")
                names = (n for n in _matching(store, start, steps) if n.rsplit("/", 1)[-1][:1] not in ("_", "."))
                while some := [base + n for n in islice(names, ROWS_PER_BATCH)]:
                    yield pd.DataFrame({"path": some})


def _uri(path: pd.Series) -> pd.Series:
    """As Spark spells the paths of files."""
    kept = "".join(map(chr, range(0x80, 0x100))) + "/:;@&=+$,!~*'()-_."
    plain = lambda p: re.sub(r"[\x00-\x7f]+", lambda m: quote(m[0], safe=kept), p)
    return path.map(lambda p: plain(p) if "://" in p and not p.startswith("file:") else "file:" + plain(open_store(p)[1]))


def read_texts(spark: SparkSession, paths: str | Iterable[str]) -> DataFrame:
    """``source_file, value``: whole text files of paths, folders or patterns, but for empty and hidden ones.

    Tasks find the files and read them, so that neither the driver nor the number of tasks grows with their number.
    Spark's own reader takes the paths of stores that only it opens; it keeps all names in the driver.
    """
    given = [paths] if isinstance(paths, str) else list(paths)
    try:
        for path in given:
            open_store(path)
    except (ValueError, NotImplementedError, OSError):
        return spark.read.text(given, wholetext=True).select(F.col("_metadata.file_path").alias("source_file"), "value")
    named = spark.createDataFrame([(p,) for p in given], "path STRING").repartition(len(given) or 1).mapInPandas(_name_files, "path STRING")
    uri = F.pandas_udf(_uri, T.StringType())
    return _with_bytes(named).filter(F.octet_length("content") > 0).select(uri("path").alias("source_file"), F.col("content").cast("string").alias("value"))


def _hash_chunks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        digests = []
        for path in frame["path"]:
            store, inner = open_store(path)
            digest = hashlib.sha256()
            with store.open_input_stream(inner) as stream:
                while chunk := stream.read(CHUNK):
                    digest.update(chunk)
            digests.append(digest.hexdigest())
        yield frame.assign(sha256=digests)


def fingerprints(listed: DataFrame, with_hash: bool = True) -> DataFrame:
    """``path, exists, size, mtime, sha256``. Files of any size are hashed in constant memory."""
    plain = listed.select(
        "path", F.lit(True).alias("exists"), F.col("length").alias("size"), F.col("modification_time").alias("mtime")
    )
    if not with_hash:
        return plain.withColumn("sha256", F.lit(None).cast("string"))
    schema = T.StructType([*plain.schema.fields, T.StructField("sha256", T.StringType())])
    parts = int(listed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return plain.repartition(parts, "path").mapInPandas(_hash_chunks, schema)


def scan_files(spark: SparkSession, roots: Sequence[str]) -> DataFrame:
    """Every file with its size, for storage accounting."""
    return list_files(spark, roots)


def _existing(paths: str | Iterable[str]) -> list[str]:
    """The paths; one without signs of a pattern that leads to nothing is an error."""
    given = [paths] if isinstance(paths, str) else list(paths)
    for path in given:
        if not re.search(r"[*?\[{]", path):
            try:
                store, inner = open_store(path)
            except (ValueError, NotImplementedError, OSError):
                continue
            if store.get_file_info(inner).type == FileType.NotFound:
                raise FileNotFoundError(path)
    return given


def read_optional_json(spark: SparkSession, path: str | Iterable[str], schema: str) -> DataFrame:
    """JSON objects, one per file, with their ``source_file``; missing or invalid files give no row."""
    try:
        raw = read_texts(spark, path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], f"source_file STRING, {schema}")
    parsed = F.from_json("value", f"{schema}, _corrupt STRING", {"columnNameOfCorruptRecord": "_corrupt"})
    whole = strict_json(F.col("value")).isNotNull() & F.col("value").rlike(r"\A\s*\{")
    return (
        raw.filter(whole)
        .select("source_file", parsed.alias("v"))
        .filter(F.col("v").isNotNull() & F.col("v._corrupt").isNull())
        .select("source_file", "v.*")
        .drop("_corrupt")
    )


def read_term_files(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Terms of files in order: ``source_file, position, term``. Blank lines and ``#`` lines are skipped."""
    files = read_texts(spark, _existing(paths))
    lines = files.select(
        "source_file", F.posexplode(F.split(F.regexp_replace("value", "^\ufeff", ""), r"\r\n|\r|\n")).alias("line_no", "line")
    )
    parts = lines.filter(~strip_space(F.col("line")).startswith("#")).select(
        "source_file", "line_no", F.posexplode(F.split("line", ",")).alias("part_no", "part")
    )
    return parts.select(
        "source_file",
        (F.col("line_no") * (1 << 31) + F.col("part_no")).cast("bigint").alias("position"),
        strip_space(F.col("part")).alias("term"),
    ).filter("term <> ''")


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """Terms of one file in order: ``position, term``."""
    return read_term_files(spark, path).drop("source_file")


def read_exclusions(spark: SparkSession, path: str) -> DataFrame:
    """Distinct excluded video paths from a JSON array of strings; any other content is an error."""
    raw = read_texts(spark, _existing(path)).select(
        strict_json(F.regexp_replace("value", "^\ufeff", "")).alias("doc")
    )
    items = raw.select(
        F.expr("try_variant_get(doc, '$', 'array<variant>')").alias("items"),
    ).select(
        F.explode(
            F.when(F.col("items").isNotNull(), F.col("items")).otherwise(
                F.raise_error(F.lit("the exclusion file must be a JSON array of path strings"))
            )
        ).alias("item")
    )
    text = F.expr("CASE WHEN schema_of_variant(item) = 'STRING' THEN CAST(item AS STRING) END")
    return items.select(
        F.when(F.coalesce(strip_space(text) != "", F.lit(False)), text)
        .otherwise(F.raise_error(F.lit("every exclusion must be a non-empty path string")))
        .alias("video_path")
    ).distinct()
