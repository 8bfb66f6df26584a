"""Sources and sinks: file tables, subsets, ground truth, session documents, the catalogue of datasets."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import IMAGE_EXTENSIONS, is_image
from ..operators.ranks import numbered, parts

BOX = "struct<x1:double,y1:double,x2:double,y2:double,description:string,marked_accepted:boolean>"
INTERVAL = "struct<start_ms:bigint,end_ms:bigint>"
IMAGE = f"struct<url:string,dbidx:bigint,boxes:array<{BOX}>,activations:array<struct<box:{BOX},score:double>>,timing:array<{INTERVAL}>>"
LOG_ENTRY = "struct<logger:string,message:string,time:double,seen:bigint,accepted:bigint,other_fields:map<string,string>>"
#: The schema of a saved session; reading with it never infers.
SESSION = f"params string, gdata array<array<{IMAGE}>>, timing array<double>, reference_categories array<string>, query_string string, action_log array<{LOG_ENTRY}>"


def list_files(spark: SparkSession, base: str, extensions: tuple[str, ...] = IMAGE_EXTENSIONS) -> DataFrame:
    """(file_path) below ``base``, relative to it, of the given extensions; the bytes are not read (column pruning)."""
    root = base.rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base).select("path")
    relative = F.element_at(F.split("path", F.lit(root.replace("file://", "")).try_cast("string"), 2), -1)
    return files.select(relative.alias("file_path")).where(is_image("file_path", extensions)).distinct()


def file_table(paths: DataFrame, column: str = "file_path") -> DataFrame:
    """(dbidx, file_path): different paths numbered from 0 in their order."""
    return numbered(paths.select(column).distinct(), [column], "dbidx")


def write_table(df: DataFrame, path: str, force: bool = False) -> None:
    """All or nothing: an existing table is an error unless ``force``; Spark's committer keeps half-written files out of sight."""
    df.write.mode("overwrite" if force else "errorifexists").parquet(path)


def valid_name(name: str) -> bool:
    return bool(name) and name not in (".", "..") and not any(c in name for c in "/\\\0")


def subset(rows: DataFrame, ids: DataFrame, key: str = "dbidx") -> DataFrame:
    """A view of the rows of some ids; nothing is copied."""
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def leave_one_out(rows: DataFrame, one, key: str = "dbidx") -> DataFrame:
    return rows.where(F.col(key) != F.lit(one))


def counts_by_category(boxes: DataFrame, key: str = "dbidx", category: str = "category") -> DataFrame:
    """(key, category, n): ground truth counts, long."""
    return boxes.groupBy(key, category).agg(F.count(F.lit(1)).alias("n"))


def presence_by_category(boxes: DataFrame, ids: DataFrame, categories: list, key: str = "dbidx", category: str = "category") -> DataFrame:
    """One row for each id and one 0/1 column for each category (named c_<category>); ids without boxes have zeros."""
    wide = boxes.groupBy(key).pivot(category, categories).agg(F.count(F.lit(1)))
    out = ids.select(key).distinct().join(wide, key, "left")
    return out.select(key, *[F.least(F.coalesce(F.col(f"`{c}`"), F.lit(0)), F.lit(1)).cast("int").alias(f"c_{c}") for c in categories])


def with_dbidx(boxes: DataFrame, files: DataFrame, path: str = "file_path") -> DataFrame:
    """Boxes with their file's number; boxes of unknown files are dropped."""
    return boxes.join(files.select(path, "dbidx"), path)


def amended(base: DataFrame, amendment: DataFrame, reviewed: DataFrame, category: str = "category", key: str = "dbidx", origin: str | None = None) -> DataFrame:
    """Ground truth with a reviewed category replaced: rows of (category, key) in ``reviewed`` go, those of ``amendment`` come."""
    kept = base.join(reviewed.select(category, key).distinct(), [category, key], "left_anti")
    if origin is not None:
        kept = kept.withColumn("origin", F.lit("base")) if "origin" not in kept.columns else kept
        amendment = amendment.withColumn("origin", F.lit(origin))
    return kept.unionByName(amendment, allowMissingColumns=True)


def read_sessions(spark: SparkSession, path: str, schema: str = SESSION, name: str = "summary.json") -> DataFrame:
    """Saved sessions in files called ``name`` anywhere below ``path``, with session_path; malformed documents become rows of nulls."""
    raw = spark.read.schema(schema + ", _corrupt string").option("recursiveFileLookup", "true").option("pathGlobFilter", name).option("multiLine", "true")
    rows = raw.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.withColumn("session_path", F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "")).drop("_corrupt")


def accepted_boxes(sessions: DataFrame) -> DataFrame:
    """(session_path, url, dbidx, x1, y1, x2, y2, description): boxes that were accepted in review sessions."""
    images = sessions.select("session_path", F.explode("gdata").alias("b")).select("session_path", F.explode("b").alias("m"))
    boxes = images.select("session_path", "m.url", "m.dbidx", F.explode("m.boxes").alias("x")).where("coalesce(x.marked_accepted, false)")
    return boxes.select("session_path", "url", "dbidx", "x.x1", "x.y1", "x.x2", "x.y2", "x.description")


def nested_frames(documents: DataFrame, labels: str = "labels", kept: tuple[str, ...] = ("name",)) -> tuple[DataFrame, DataFrame]:
    """From frames with an array of labelled boxes: (one row a box, one row a frame with num_labels). Frames without boxes stay."""
    frames = documents.select(*kept, F.coalesce(F.greatest(F.size(labels), F.lit(0)), F.lit(0)).alias("num_labels"))
    boxes = documents.select(*kept, F.explode(labels).alias("_l")).select(*kept, "_l.*")
    return boxes, frames


def read_batches(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """Delimited result batches with a header, under one declared schema."""
    return spark.read.schema(schema).option("header", "true").csv(pattern)


def split_evenly(rows: DataFrame, n: int, order: str) -> DataFrame:
    """Adds ``part`` (0 .. n - 1): consecutive ranges whose sizes differ by one at most."""
    return parts(rows, n, [order])


def cached_table(make, spark: SparkSession, path: str, force: bool = False) -> DataFrame:
    """What ``make()`` returns, written to ``path`` the first time and read from there after."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if force or not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


class Catalogue:
    """Datasets below a root folder: file tables, ground truth, indices and named subsets, each a Parquet table."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, *parts: str) -> str:
        for p in parts:
            if not valid_name(p):
                raise ValueError(f"not a name: {p!r}")
        return "/".join([self.root, *parts])

    def _names(self, *parts: str) -> list[str]:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(*parts) if parts else self.root)
        fs = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []

    def datasets(self) -> list[str]:
        return self._names("data")

    def create(self, name: str, paths: DataFrame, force: bool = False) -> DataFrame:
        write_table(file_table(paths), self._path("data", name, "file_meta"), force)
        return self.files(name)

    def files(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self._path("data", name, "file_meta"))

    def save(self, name: str, kind: str, item: str, df: DataFrame, force: bool = False) -> None:
        """``kind`` is ``indices``, ``subsets`` or ``ground_truth``."""
        write_table(df, self._path("data", name, kind, item), force)

    def load(self, name: str, kind: str, item: str, columns: list[str] | None = None) -> DataFrame:
        df = self.spark.read.parquet(self._path("data", name, kind, item))
        return df.select(*columns) if columns else df

    def items(self, name: str, kind: str) -> list[str]:
        return self._names("data", name, kind)


def without_categories(rows: DataFrame, ignored: tuple[str, ...] = (), suffixes: tuple[str, ...] = (), category: str = "category") -> DataFrame:
    """Rows of categories that are neither ignored nor end in one of ``suffixes``."""
    name = F.col(category)
    for s in suffixes:
        rows = rows.where(~name.endswith(s))
    return rows.where(~name.isin(*ignored)) if ignored else rows


def flattened_runs(documents: DataFrame, column: str = "summary") -> DataFrame:
    """One flat row a run document {bench_params, session_params, result}: (dataset, index_name, category, variant, n_batches, batch_size,
    max_results, session_params, has_result, nfound). Unfinished runs have no result."""
    at = lambda path, kind: F.get_json_object(column, path).cast(kind)
    return documents.select(
        at("$.session_params.index_spec.d_name", "string").alias("dataset"), at("$.session_params.index_spec.i_name", "string").alias("index_name"),
        at("$.bench_params.ground_truth_category", "string").alias("category"), at("$.bench_params.name", "string").alias("variant"), at("$.bench_params.n_batches", "int").alias("n_batches"),
        at("$.session_params.batch_size", "int").alias("batch_size"), at("$.bench_params.max_results", "int").alias("max_results"), at("$.session_params", "string").alias("session_params"),
        at("$.result", "string").isNotNull().alias("has_result"), at("$.result.nfound", "long").alias("nfound"),
    )


def _status(spark: SparkSession, path: str) -> list:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return [(s.getModificationTime(), s.getPath().toString(), s.isDirectory()) for s in fs.listStatus(place)] if fs.exists(place) else []


def folders_by_time(spark: SparkSession, path: str) -> list[str]:
    """The folders in ``path``, the one changed longest ago first."""
    return [name for _, name, folder in sorted(_status(spark, path)) if folder]


def consolidated(spark: SparkSession, base: str, folder: str, cache: str, read: Callable[[str], tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Ground truth with all amendments: the table ``base``, changed by each folder in ``folder`` in order of time, so that the last one to
    review a category of an image has its say; ``origin`` says who had. ``read`` gives (amendment, reviewed) of a folder.

    The result is kept in ``cache`` and made anew once a folder is younger than it."""
    folders = folders_by_time(spark, folder)
    if not folders:
        return spark.read.parquet(base).withColumn("origin", F.lit("base"))
    made = [t for t, name, _ in _status(spark, cache) if name.endswith("/_SUCCESS")]
    if not made or max(t for t, _, d in _status(spark, folder) if d) >= max(made):
        boxes = spark.read.parquet(base).withColumn("origin", F.lit("base"))
        for f in folders:
            new, reviewed = read(f)
            boxes = amended(boxes, new, reviewed, origin=f.rstrip("/").rsplit("/", 1)[1])
        boxes.write.mode("overwrite").parquet(cache)
    return spark.read.parquet(cache)


def load_index(spark: SparkSession, path: str, constructors: dict[str, Callable[..., Any]], **options: Any) -> Any:
    """What the constructor named in ``info.json`` below ``path`` makes of the index there."""
    info = spark.read.option("multiLine", "true").json(f"{path.rstrip('/')}/info.json").first()
    if info["constructor"] not in constructors:
        raise ValueError(f"unknown constructor {info['constructor']!r}")
    return constructors[info["constructor"]](spark, path, **options)


def relabelled(rows: DataFrame, condition: Column, column: str, value) -> DataFrame:
    """A one-off correction: ``column`` set where a condition holds."""
    return rows.withColumn(column, F.when(condition, F.lit(value)).otherwise(F.col(column)))


def write_sessions(sessions: DataFrame, path: str, keys: tuple[str, ...] = ("session_id", "qkey")) -> None:
    """Sessions as JSON documents, a folder for each key; earlier saves stay."""
    sessions.write.mode("append").partitionBy(*keys).json(path)


def boxes_by_image(boxes: DataFrame, category, key: str = "dbidx") -> DataFrame:
    """(key, boxes): for review, the boxes of a category in each image, an array in order of their corners."""
    mine = boxes.where(F.col("category") == F.lit(category))
    return mine.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("x1", "y1", "x2", "y2"))).alias("boxes"))


def reviewed_sessions(sessions: DataFrame, *lists: DataFrame, key: str = "session_path") -> DataFrame:
    """Sessions on any of several reviewed lists of paths; paths are compared cleaned."""
    from ..functions.text import clean_path

    names = [d.select(clean_path(key).alias("_path")) for d in lists]
    wanted = names[0]
    for d in names[1:]:
        wanted = wanted.union(d)
    return sessions.withColumn("_path", clean_path(key)).join(wanted.distinct(), "_path", "left_semi").drop("_path")
