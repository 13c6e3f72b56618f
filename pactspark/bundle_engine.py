"""Plain SQL that runs only while a contract bundle is in place."""

from __future__ import annotations

import threading
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .engine import new_session
from .errors import ConfigError, MissingBundle, ResultTooLarge
from .plans.guard import reject_unsafe
from .policy import BundleHandle
from .sources.bindings import in_session


@dataclass(frozen=True)
class EngineConfig:
    tenant_id: str
    engine_id: str
    storage_socket: str
    signer_socket: str
    max_result_rows: int = 1_000_000

    def __post_init__(self):
        for name in ("tenant_id", "engine_id", "storage_socket", "signer_socket"):
            if not str(getattr(self, name)).strip():
                raise ConfigError(f"{name} is empty")
        if self.max_result_rows <= 0:
            raise ConfigError("max_result_rows must be above zero")


class BundleEngine:
    """Tables are registered by name; without a bundle no query runs. Results that are fetched have ``max_result_rows`` rows at most."""

    _sealed = True

    def __init__(self, spark: SparkSession, config: EngineConfig):
        self.spark, self.config = spark, config
        self._session: SparkSession | None = None
        self._bundle: BundleHandle | None = None
        self._lock = threading.Lock()

    def __init_subclass__(cls, **kw):
        raise TypeError("the bundle engine can't be extended")

    @property
    def bundle(self) -> BundleHandle | None:
        return self._bundle

    def inject_bundle(self, bundle: BundleHandle) -> None:
        """Set or replace the bundle."""
        with self._lock:
            self._bundle = bundle

    @property
    def session(self) -> SparkSession:
        with self._lock:
            if self._session is None:
                self._session = new_session(self.spark)
            return self._session

    def register_frame(self, name: str, df: DataFrame) -> None:
        in_session(df, self.session).createOrReplaceTempView("`" + name.replace("`", "``") + "`")

    def register_rows(self, name: str, rows: list, schema) -> None:
        self.register_frame(name, self.session.createDataFrame(rows, schema))

    def register_parquet(self, name: str, path: str) -> None:
        self.register_frame(name, self.session.read.parquet(path))

    def register_source(self, name: str, source: str, **options) -> None:
        """A table of a Python data source that the application's session knows."""
        self.register_frame(name, self.spark.read.format(source).options(**options).load())

    def query(self, sql: str) -> DataFrame:
        """First the bundle is looked for, then the statement is checked."""
        if self._bundle is None:
            raise MissingBundle
        reject_unsafe(sql)
        return self.session.sql(sql.strip().rstrip(";"))

    def fetch(self, sql: str) -> pa.Table:
        """A query's rows; a result with more than ``max_result_rows`` is an error and never cut."""
        found = self.query(sql).limit(self.config.max_result_rows + 1).toArrow()
        if found.num_rows > self.config.max_result_rows:
            raise ResultTooLarge(self.config.max_result_rows)
        return found
