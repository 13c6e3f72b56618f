"""Bindings besides contract files: Parquet paths and frames made elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..errors import ContractNotFound


def in_session(df: DataFrame, session: SparkSession) -> DataFrame:
    """The same logical plan as a frame of another session of the application."""
    if df.sparkSession is session:
        return df
    jvm = session._jvm
    dataset = jvm.org.apache.spark.sql.classic.Dataset.ofRows(session._jsparkSession, df._jdf.logicalPlan())
    return DataFrame(dataset, session)


class ParquetBinding:
    def __init__(self, paths: dict[str, str]):
        self.paths = dict(paths)

    def bind(self, dataset: str, session: SparkSession) -> DataFrame:
        if dataset not in self.paths:
            raise ContractNotFound(dataset)
        return session.read.parquet(self.paths[dataset])


class FrameBinding:
    def __init__(self, frames: dict[str, DataFrame]):
        self.frames = dict(frames)

    def bind(self, dataset: str, session: SparkSession) -> DataFrame:
        if dataset not in self.frames:
            raise ContractNotFound(dataset)
        return in_session(self.frames[dataset], session)


class FirstOf:
    """The first binding that knows the dataset."""

    def __init__(self, *bindings):
        self.bindings = bindings

    def bind(self, dataset: str, session: SparkSession) -> DataFrame:
        for b in self.bindings:
            try:
                return b.bind(dataset, session)
            except ContractNotFound:
                continue
        raise ContractNotFound(dataset)
