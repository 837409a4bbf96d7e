"""Session defaults and the shared scratch area used to cut lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: str | None = None
_shipped: set[str] = set()
_left: dict[str, list[str]] = {}  # by application: folders of tables that returned DataFrames read


def build_session(app: str = "tallyweave", cpus: str | int = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the library expects (UTC, AQE, Arrow)."""
    os.environ.setdefault("TZ", "UTC")
    spark = (
        SparkSession.builder.appName(app)
        .master(f"local[{cpus}]")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
    ship_package(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as named by ``spark.checkpoint.dir``.

    A folder of this machine is used only where the setting is absent and the
    master is local, as in tests; on a cluster its absence is an error.
    """
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="tallyweave-")
        atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
    return f"file://{_own_dir}"


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of a session, once."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="tallyweave-zip-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc.addPyFile(shutil.make_archive(f"{folder}/{os.path.basename(here)}", "zip", os.path.dirname(here), os.path.basename(here)))


class Scratch:
    """Intermediate tables in the shared folder.

    ``keep`` writes a DataFrame and returns a reader of the written table, so
    later steps neither recompute it nor depend on blocks held by an executor.
    ``drop`` removes tables that no remaining step reads. As a context manager,
    or by ``close``, all tables go but those named by ``hold``: what the result
    still reads stays until ``clean_up`` or the end of the program.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tw-{uuid.uuid4().hex}"
        self._paths: dict[str, str] = {}
        self._held: set[str] = set()
        self._n = 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is not None:
            self._held.clear()
        self.close()

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{name}-{self._n}"
        df.write.mode("overwrite").parquet(path)
        old = self._paths.get(name)
        self._paths[name] = path
        out = self.spark.read.schema(df.schema).parquet(path)
        if old:
            _delete(self.spark, old)
        return out

    def hold(self, *names: str) -> None:
        """Name tables that outlive ``close``, because the returned DataFrame reads them."""
        self._held.update(names)

    def drop(self, *names: str) -> None:
        for name in names:
            path = self._paths.pop(name, None)
            if path:
                _delete(self.spark, path)

    def close(self) -> None:
        self.drop(*[n for n in self._paths if n not in self._held])
        if self._paths:
            _left.setdefault(self.spark.sparkContext.applicationId, []).append(self.root)
        else:
            _delete(self.spark, self.root)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def clean_up(spark: SparkSession) -> int:
    """Delete the tables that results of this session still held, and say how many folders these were.

    DataFrames returned before can't be read after it, unless their rows were written elsewhere.
    """
    roots = _left.pop(spark.sparkContext.applicationId, [])
    for root in roots:
        _delete(spark, root)
    return len(roots)
