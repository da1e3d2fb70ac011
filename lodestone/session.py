"""Settings of the retrieval engine, and Spark sessions for it."""

from __future__ import annotations

import math
import os
import tempfile
import uuid
from dataclasses import dataclass, fields
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession

#: Prefix of the environment variables that from_env() reads.
ENV = "LODESTONE_"


@dataclass(frozen=True)
class Settings:
    llm_model: str = "deepseek-chat"
    embedding_model: str = "sentence-transformers/all-MiniLM-L6-v2"
    reranker_model: str = "cross-encoder/ms-marco-MiniLM-L-6-v2"
    min_rerank_score: float = -1.0
    top_k: int = 20
    max_retries: int = 1
    data_dir: str = "data"

    def __post_init__(self) -> None:
        for name in ("llm_model", "embedding_model", "reranker_model"):
            if not getattr(self, name).strip():
                raise ValueError(f"{name} must not be blank")
        if not math.isfinite(self.min_rerank_score):
            raise ValueError("min_rerank_score must be a finite number")
        if self.top_k not in range(1, 101):
            raise ValueError("top_k must be within 1 and 100")
        if self.max_retries < 0:
            raise ValueError("max_retries must not be negative")

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None, dotenv: str | None = ".env") -> Settings:
        """Defaults, overridden by LODESTONE_<FIELD> in the .env file, overridden by the same in the environment."""
        given = {**read_dotenv(dotenv), **(os.environ if env is None else env)}
        kinds = {"min_rerank_score": float, "top_k": int, "max_retries": int}
        return cls(**{f.name: kinds.get(f.name, str)(given[key]) for f in fields(cls) if (key := ENV + f.name.upper()) in given})

    @property
    def chunks_path(self) -> str:
        return str(PurePosixPath(self.data_dir) / "processed" / "chunks.jsonl")

    @property
    def index_dir(self) -> str:
        return str(PurePosixPath(self.data_dir) / "indexes")

    def describe(self, spark: SparkSession) -> DataFrame:
        """One row with every setting; no keys are among them."""
        return spark.createDataFrame([tuple(getattr(self, f.name) for f in fields(self))], [f.name for f in fields(self)])


def read_dotenv(path: str | None) -> dict[str, str]:
    """KEY=value lines of a file, if there is one; quotes around values are dropped."""
    if not path or not os.path.isfile(path):
        return {}
    with open(path, encoding="utf-8") as f:
        pairs = (line.removeprefix("export ").partition("=") for raw in f if (line := raw.strip()) and not line.startswith("#"))
        return {k.strip(): v.strip().strip("'\"") for k, eq, v in pairs if eq}


def session(name: str = "lodestone") -> SparkSession:
    """The active session, or one with adaptive execution on; cluster and sizes come from spark-submit."""
    return SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def shuffles(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: While this is on, Spark removes an execution's shuffle files when it ends.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """This application's part of the folder in spark.checkpoint.dir. Only on a local master (tests) a temporary folder is made where
    none is set; executors of a cluster would not share it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lodestone-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The rows, written once to the folder of spark.checkpoint.dir and read from there: what follows reads them several times, or
    would repeat a model's calls. The shuffle files of the writing are removed with it: nothing needs them any more."""
    spark = df.sparkSession
    shared_folder(spark)
    before = spark.conf.get(CLEAN, "false")
    spark.conf.set(CLEAN, "true")
    try:
        return df.select("*").checkpoint()  # a plan made under this setting
    finally:
        spark.conf.set(CLEAN, before)


def stored(df: DataFrame) -> DataFrame:
    """As cut(), by columns (Parquet): for large relations of which what follows reads some columns only. The order within a partition is kept
    in its file, but files are read in splits."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4()}"
    before = spark.conf.get(CLEAN, "false")
    spark.conf.set(CLEAN, "true")
    try:
        df.select("*").write.option("parquet.enable.dictionary", "false").parquet(path)  # texts and packed values hardly repeat
    finally:
        spark.conf.set(CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def drop(*written: DataFrame) -> None:
    """Delete what cut() wrote for these very DataFrames, when nothing will read it any more."""
    for df in written:
        sc = df.sparkSession.sparkContext
        file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        if file.isDefined():
            path = sc._jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
