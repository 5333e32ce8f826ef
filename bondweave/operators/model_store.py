"""A store of fitted models: folders by content, and a log of which run of which seed uses which."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Sequence
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import models
from .score import with_ensembles

ENTRY = "seed int, run int, version int, content string"


class ModelStore:
    """Models under ``path``, a folder that driver and executors share.

    ``models/<content>`` holds each different model once, as MLlib writes it. ``log/`` has one small file for each change:
    the content of a (seed, run), or none after it was taken out; the last version counts. A model is written under a
    name of its own and then renamed, and so is a file of the log, so readers never see half of one; of two writers of one
    version the second finds it taken and writes the next.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        for folder in ("models", "log"):
            self._fs.mkdirs(self._at(f"{self.path}/{folder}"))

    def _at(self, path: str) -> Any:
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _rename(self, source: str, target: str) -> bool:
        """False if ``target`` is there already; the file systems' own rename would put a folder inside it."""
        if self._fs.exists(self._at(target)):
            return False
        return self._fs.rename(self._at(source), self._at(target))

    def _content(self, folder: str) -> str:
        """A hash of what a saved model is, without the times and names that each writing makes anew."""
        found, stack = [], [folder]
        while stack:  # the files of one model, few
            for s in self._fs.listStatus(self._at(stack.pop())):
                name = s.getPath().toString()
                if s.isDirectory():
                    stack.append(name)
                    if name.endswith(("/data", "/treesMetadata")):
                        rows = self.spark.read.parquet(name)
                        parts = rows.select(F.xxhash64(F.to_json(F.struct(*rows.columns))).alias("h")).agg(F.count("h"), F.bit_xor("h"), F.sum(F.col("h").cast("decimal(38,0)"))).first()
                        found.append((name.rsplit("/", 1)[1], *map(str, parts)))
                elif "/metadata/part-" in name:
                    for line in self.spark.read.text(name).collect():
                        known = json.loads(line[0])
                        found.append((known["class"], json.dumps({k: known.get(k) for k in ("paramMap", "defaultParamMap") if k in known} | {"n": len(known.get("paramMap", {}).get("stageUids", []))}, sort_keys=True)))
        cleaned = sorted(self._without_uids(str(x)) for x in found)
        return hashlib.sha256("\n".join(cleaned).encode()).hexdigest()[:40]

    @staticmethod
    def _without_uids(text: str) -> str:
        return re.sub(r"_[0-9a-f]{12,}", "_", text)

    def save(self, model: PipelineModel) -> str:
        """The content of a model, which is in the store from now on; an equal one is not stored again."""
        new = f"{self.path}/models/_new-{uuid.uuid4().hex}"
        model.write().save(new)
        content = self._content(new)
        if not self._rename(new, f"{self.path}/models/{content}"):
            self._fs.delete(self._at(new), True)
        return content

    def _append(self, seed: int, run: int, content: str | None) -> None:
        while True:
            last = max((e["version"] for e in self._log() if (e["seed"], e["run"]) == (seed, run)), default=0)
            new = f"{self.path}/log/_new-{uuid.uuid4().hex}"
            out = self._fs.create(self._at(new))
            out.write(bytearray(json.dumps({"seed": seed, "run": run, "version": last + 1, "content": content}).encode()))
            out.close()
            if self._rename(new, f"{self.path}/log/{seed}-{run}-{last + 1:06d}.json"):
                return
            self._fs.delete(self._at(new), False)

    def _log(self) -> list[dict]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at(f"{self.path}/log"))]
        if not any(n.endswith(".json") for n in names):
            return []
        return [r.asDict() for r in self.spark.read.schema(ENTRY).json(f"{self.path}/log/*.json").collect()]

    def register(self, seed: int, run: int, model: PipelineModel) -> str:
        content = self.save(model)
        self._append(seed, run, content)
        return content

    def unregister(self, seed: int, run: int) -> None:
        if (seed, run) not in self._current():
            raise KeyError(f"seed {seed} has no run {run}")
        self._append(seed, run, None)

    def _current(self) -> dict[tuple[int, int], str]:
        last: dict[tuple[int, int], dict] = {}
        for e in sorted(self._log(), key=lambda e: e["version"]):
            last[e["seed"], e["run"]] = e
        return {k: e["content"] for k, e in last.items() if e["content"] is not None}

    def entries(self) -> DataFrame:
        """(seed, run, content) of the models in use."""
        rows = [(s, r, c) for (s, r), c in sorted(self._current().items())]
        return self.spark.createDataFrame(rows, "seed int, run int, content string")

    def load(self, seed: int, run: int) -> PipelineModel:
        return PipelineModel.load(f"{self.path}/models/{self._current()[seed, run]}")

    def score(self, df: DataFrame, seed: int, weights: Sequence[float] | None = None, bias: float = 0.0, prediction: str = "prediction") -> DataFrame:
        """Every run's prediction p<run>, and with ``weights`` their mean and weighted ensemble. Equal models are loaded once."""
        runs = sorted((r, c) for (s, r), c in self._current().items() if s == seed)
        if not runs:
            raise KeyError(f"seed {seed} has no run")
        loaded = {c: PipelineModel.load(f"{self.path}/models/{c}") for c in {c for _, c in runs}}
        for run, content in runs:
            df = models.predict(df, loaded[content]).withColumnRenamed(prediction, f"p{run}")
        return df if weights is None else with_ensembles(df, [f"p{r}" for r, _ in runs], list(weights), bias)


def weights_table(spark: SparkSession, model: PipelineModel, features: Sequence[str]) -> DataFrame:
    """(feature, weight) of a linear model; the intercept has no feature."""
    linear = model.stages[-1]
    rows = [(f, float(w)) for f, w in zip(features, linear.coefficients.toArray())]
    return spark.createDataFrame([*rows, (None, float(linear.intercept))], "feature string, weight double")
