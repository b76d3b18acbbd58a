"""The run ledger (SNK-03): which steps of a run are committed, so that a run that stopped goes on where it stopped.

A step writes its table below the run's folder and then one row to
``ledger/step=<name>``, which Spark's committer does at once.  A step that has
its row is not run again: its table is read back.  Delivery leaves the run's
folder, so it has a claim beside its row: ``begun`` is written before the sink
is called and ``failed`` when it raised.  A delivery that was begun and neither
done nor failed may have gone out; it is not made a second time under one run
id unless the caller asks for it.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_ROW = "step string, run_id string, rows bigint, note bigint, form string"


class DeliveryUnknown(RuntimeError):
    """A delivery was begun under this run id and its end is not known."""


class Ledger:
    def __init__(self, spark: SparkSession, root: str, run_id: str) -> None:
        self.spark, self.root, self.run_id = spark, root.rstrip("/"), run_id

    def rows(self) -> DataFrame:
        """Committed steps: step, run_id, rows, note (a step's own number) and form (the schema of its table)."""
        try:
            return self.spark.read.schema(_ROW).parquet(f"{self.root}/ledger")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], _ROW)

    def find(self, step: str):
        """The row of a step, or None. A folder that holds another run is refused."""
        found = self.rows().filter(F.col("step") == step).first()
        if found is not None and found["run_id"] != self.run_id:
            raise ValueError(f"{self.root} holds run {found['run_id']}, not {self.run_id}")
        return found

    def commit(self, step: str, rows: int, note: int = 0, form: str | None = None) -> None:
        row = self.spark.createDataFrame([(self.run_id, rows, note, form)], "run_id string, rows bigint, note bigint, form string")
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/ledger/step={step}")

    def table(self, step: str, build: Callable[[], DataFrame], note: Callable[[], int] = lambda: 0, by: tuple[str, ...] = ()) -> DataFrame:
        """The table of a step: read back if it is committed, else built, written and committed."""
        path = f"{self.root}/{step}"
        found = self.find(step)
        if found is None:
            frame = build()
            frame.write.mode("overwrite").partitionBy(*by).parquet(path)  # over what a run that stopped left
            form = frame.schema.json()
            self.commit(step, self.spark.read.schema(frame.schema).parquet(path).count(), note(), form)
        else:
            form = found["form"]
        return self.spark.read.schema(StructType.fromJson(json.loads(form))).parquet(path)

    def deliver(self, digest: DataFrame, sink: Callable[[DataFrame], None], again: bool = False) -> None:
        """Hand a digest with rows to the sink, once under this run id."""
        if self.find("delivered") is not None:
            return
        if self.find("begun") is not None and self.find("failed") is None and not again:
            raise DeliveryUnknown(f"run {self.run_id} may have been delivered; pass redeliver=True to deliver it again")
        n = digest.count()
        if n:
            self.commit("begun", n)
            try:
                sink(digest)
            except BaseException:
                self.commit("failed", n)
                raise
        self.commit("delivered", n)
