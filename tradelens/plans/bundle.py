"""Report groups (R13) and their outputs (S3 bundle write, S4 headers,
S5 rendered dates, S6 column layout profile).

A group runs its reports against one :class:`SharedPlans`: the period's sale
facts and their pre-aggregates are computed once and reused by every report
of the group. Two ways to hold them:

* ``share="write"`` (default): written to the shared checkpoint folder
  (``spark.checkpoint.dir``) and read back — lineage is cut and a lost
  executor costs a re-read; deleted when the group is written.
* ``share="persist"``: ``persist(MEMORY_AND_DISK)``; a lost executor's cached
  blocks are recomputed from their (short) lineage of scans and joins;
  released when the group is written.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

from tradelens.functions.layout import display_header, python_text, text_width
from tradelens.functions.period import Period
from tradelens.plans.reports import REPORT_GROUPS, SharedPlans
from tradelens.session import scratch_path
from tradelens.sources.contract import Tables


def staged(spark: SparkSession, run_id: str | None = None):
    """A ``stage(df, name)`` function writing to the shared checkpoint folder."""
    base = scratch_path(spark, run_id or "stage")

    def stage(df: DataFrame, name: str) -> DataFrame:
        path = f"{base}/{name}"
        df.write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    def release() -> None:
        folder = spark._jvm.org.apache.hadoop.fs.Path(base)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)

    stage.release = release
    return stage


def persisted(df: DataFrame, name: str) -> DataFrame:
    """A ``stage(df, name)`` function keeping the shared piece in executor
    memory (spilling to local disk); recomputed from lineage if lost."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def sharing(spark: SparkSession, share: str | None, run_id: str):
    """The stage function for a sharing mode (``persist``, ``write``, None)."""
    if share is None:
        return None
    if share == "persist":
        return persisted
    if share == "write":
        return staged(spark, run_id)
    raise ValueError(f"unknown sharing mode {share!r}")


def run_group(t: Tables, name: str, period: Period,
              shared: SharedPlans | None = None) -> dict[str, DataFrame]:
    """The reports of one group, in order, as lazy DataFrames.

    Unlike the source (which silently does nothing) an unknown group name
    raises ``KeyError``.
    """
    if name not in REPORT_GROUPS:
        raise KeyError(f"unknown report group {name!r}; known: {sorted(REPORT_GROUPS)}")
    s = shared if shared is not None else SharedPlans(t, period)
    return {sheet: fn(t, period, s) for sheet, fn in REPORT_GROUPS[name]}


def render_report(df: DataFrame, date_format: str = "dd/MM/yyyy") -> DataFrame:
    """Timestamps shown as day/month/year text; other columns unchanged."""
    cols = []
    for field in df.schema.fields:
        c = F.col(field.name)
        if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            c = F.date_format(c, date_format)
        cols.append(c.alias(field.name))
    return df.select(*cols)


def header_manifest(spark: SparkSession, reports: Mapping[str, DataFrame]) -> DataFrame:
    """(report, position, column, header) — the display header of every
    physical column (duplicates and empty headers allowed). Built from the
    report schemas only; no data is read."""
    rows = [(sheet, i, f.name, display_header(f.name))
            for sheet, df in reports.items() for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "report string, position int, column string, header string")


def column_layout_profile(df: DataFrame) -> DataFrame:
    """Display width per column = widest rendered cell, header included.

    One aggregation pass (partial max per partition, one final row), then the
    single row is unpivoted to one row per column.
    """
    fields = df.schema.fields
    maxes = df.agg(*[F.max(text_width(python_text(F.col(f.name), f.dataType))).alias(f"w{i}")
                     for i, f in enumerate(fields)])
    entries = []
    for i, f in enumerate(fields):
        header = display_header(f.name)
        widest = F.greatest(F.lit(700.0), text_width(F.lit(header)), F.col(f"w{i}"))
        entries.append(F.struct(F.lit(f.name).alias("column_name"), F.lit(i).alias("position"),
                                F.lit(header).alias("header"),
                                F.floor(widest).cast("bigint").alias("width")))
    return maxes.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def with_display_headers(df: DataFrame) -> DataFrame:
    """The columns under their display headers; a header that comes again gets a
    number of trailing spaces, since a file's columns need different names."""
    names: list[str] = []
    for c in df.columns:
        header = display_header(c)
        while header in names:
            header += " "
        names.append(header)
    return df.toDF(*names)


def run_concurrently(reports: Mapping[str, DataFrame], sink: Callable[[str, DataFrame], None],
                     max_parallel: int = 4) -> None:
    """Hand every report to ``sink`` from up to ``max_parallel`` threads.

    Each report is its own Spark job; submitted together, their stages share
    the executors instead of leaving them idle between small jobs. Errors
    propagate after all submitted jobs have finished.
    """
    if max_parallel <= 1 or len(reports) <= 1:
        for name, df in reports.items():
            sink(name, df)
        return
    with ThreadPoolExecutor(max_workers=max_parallel, thread_name_prefix="report") as pool:
        futures = [pool.submit(sink, name, df) for name, df in reports.items()]
        for f in futures:
            f.result()


class _Folder:
    """A folder through Hadoop's file system interface, so any store that Spark writes to works."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm = spark._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path(path)
        self._fs = self._path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self._path, name)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def names(self) -> list[str]:
        if not self._fs.exists(self._path):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path))

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)

    def rename(self, name: str, to: str) -> None:
        if not self._fs.rename(self._at(name), self._at(to)):
            raise OSError(f"can't rename {name} to {to} in {self._path}")

    def part_files(self, name: str) -> int:
        return sum(1 for s in self._fs.listStatus(self._at(name)) if s.getPath().getName().startswith("part-"))


#: Marks a folder's written sheets; a group without it is not whole.
COMMITTED = "_manifest"


def repair_group(spark: SparkSession, out_dir: str, folder: str) -> None:
    """Finish or undo what an interrupted ``write_report_bundle`` left beside ``out_dir/folder``.

    The switch takes two renames: the old group aside, the new one in its
    place. If it stopped between them the staged group, which is whole, takes
    the place; else staged leftovers are deleted. Run by one writer at a time.
    """
    at = _Folder(spark, out_dir)
    left = [n for n in at.names() if n.startswith((f".{folder}.staged-", f".{folder}.old-"))]
    if not at.exists(folder):
        whole = [n for n in left if ".staged-" in n and at.exists(f"{n}/{COMMITTED}")]
        old = [n for n in left if ".old-" in n]
        if old and (whole or old):
            back = (whole or old)[0]
            at.rename(back, folder)
            left.remove(back)
    for name in left:
        at.delete(name)


def write_report_bundle(spark: SparkSession, t: Tables, group: str, period: Period,
                        out_dir: str, fmt: str = "parquet", share: str | None = "write",
                        max_parallel: int = 4) -> str:
    """S3: write every report of ``group`` under ``out_dir/<group>_<start>__<end>/``.

    Each report is written by the executors (one folder per report, many
    part files, sort order kept); the header manifest goes next to them.
    ``fmt='csv'`` writes the rendered flavour (S5) under the display headers.
    What the reports share is released, and its files deleted, also on error.
    Up to ``max_parallel`` reports are written at the same time.

    The group appears as a whole: reports are written to a staging folder beside
    their place with a manifest (``_manifest``: report, rows and part files, counted
    while writing), then the folders are switched. If a report fails, the old group
    stays as it was. A rerun repairs what an interrupted switch left.
    """
    shared = SharedPlans(t, period, stage=sharing(spark, share, f"{group}-{period.label}"))
    name = f"{group}_{period.label}"
    target = f"{out_dir.rstrip('/')}/{name}"
    repair_group(spark, out_dir, name)
    run = uuid.uuid4().hex
    staged_name, old_name = f".{name}.staged-{run}", f".{name}.old-{run}"
    folder = f"{out_dir.rstrip('/')}/{staged_name}"
    rows: dict[str, Observation] = {}

    def write(sheet: str, df: DataFrame) -> None:
        path = f"{folder}/{sheet}"
        rows[sheet] = Observation()
        df = df.observe(rows[sheet], F.count(F.lit(1)).alias("rows"))
        if fmt == "csv":
            # blanks are part of the header of a repeated column
            (with_display_headers(render_report(df)).write.mode("overwrite").option("header", True)
             .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
        else:
            df.write.mode("overwrite").parquet(path)

    try:
        reports = run_group(t, group, period, shared)
        run_concurrently(reports, write, max_parallel)
        header_manifest(spark, reports).coalesce(1).write.mode("overwrite").json(f"{folder}/_headers")
        at, staging = _Folder(spark, out_dir), _Folder(spark, folder)
        entries = [(sheet, rows[sheet].get["rows"], staging.part_files(sheet)) for sheet in reports]
        (spark.createDataFrame(entries, "report string, rows long, part_files int").coalesce(1)
         .write.json(f"{folder}/{COMMITTED}"))  # the last file: the staged group is whole
        if at.exists(name):
            at.rename(name, old_name)
        at.rename(staged_name, name)
        at.delete(old_name)
    except BaseException:
        at = _Folder(spark, out_dir)
        if at.exists(name):  # the old group stands, or the new one already does
            at.delete(staged_name)
        raise
    finally:
        shared.release()
    return target
