"""Privacy budgets as keyed streaming state: requests are admitted or refused one after the other, however many callers ask at once.

Callers append requests to a folder; one stream, keyed by subject, keeps what the subject has spent on each dataset as state and decides. A request that names several datasets is
admitted if all of them have enough left, and then spends on all; else it spends nothing. Decisions go to a table that is the ledger: a row for each request and dataset, written exactly once. The
state lives in the stream's checkpoint, so a lost executor or a new driver goes on where the last decision was.

A decision costs a micro-batch, seconds. Where one driver takes all requests, `Turns` decides under a lock against a plain ledger instead, in a fraction of that; choose one for a folder.

Requests of a micro-batch are decided by (at, request), later micro-batches after earlier ones. A task holds the requests of a subject in one micro-batch;
`files_per_trigger` bounds them. A request that is sent twice spends twice. Null epsilons, negative ones and requests without a dataset are refused.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections import defaultdict
from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

REQUEST = "request string, subject string, datasets array<string>, epsilon double, at timestamp"
#: epsilon is what was spent: nothing where the request was refused.
DECISION = "request string, subject string, dataset string, epsilon double, asked double, admitted boolean, remaining double"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Sums of epsilons may end this far beyond the budget by rounding.
SLACK = 1e-9

_locks: dict[str, threading.Lock] = defaultdict(threading.Lock)


class Decide(StatefulProcessor):
    """What a subject has spent, by dataset."""

    def __init__(self, budget: float):
        self.budget = budget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.spent = handle.getMapState("spent", "dataset string", "epsilon double")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        spent = {d[0]: s[0] for d, s in self.spent.iterator()}
        asked, changed = pd.concat(list(rows)).sort_values(["at", "request"]), set()
        out = []
        for r in asked.itertuples(index=False):
            names = [] if r.datasets is None else sorted(set(r.datasets))
            ok = bool(names) and r.epsilon >= 0 and all(spent.get(d, 0.0) + r.epsilon <= self.budget + SLACK for d in names)
            for d in names or [None]:
                if ok:
                    spent[d] = spent.get(d, 0.0) + r.epsilon
                    changed.add(d)
                out.append((r.request, key[0], d, r.epsilon if ok else 0.0, r.epsilon, ok, max(0.0, self.budget - spent.get(d, 0.0))))
        for d in changed:
            self.spent.updateValue((d,), (spent[d],))
        yield pd.DataFrame(out, columns=["request", "subject", "dataset", "epsilon", "asked", "admitted", "remaining"])

    def close(self) -> None:
        pass


class Admission:
    """The budgets below a folder: requests, the ledger and the stream's checkpoint. Any number of callers may send; who decides does so alone.

    partitions: of the state, shuffle partitions unless given; the first run settles them for good. Each costs a Python worker and a store a run.
    """

    def __init__(self, spark: SparkSession, base: str, budget: float, files_per_trigger: int = 10_000, partitions: int | None = None):
        self.base, self.budget, self.files = base.rstrip("/"), budget, files_per_trigger
        self.spark = spark.newSession()  # its state store is not the session's business
        self.spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
        if partitions:
            self.spark.conf.set("spark.sql.shuffle.partitions", partitions)
        with _locks[self.base]:
            self.spark.createDataFrame([], REQUEST).write.mode("ignore").parquet(f"{self.base}/requests/none")

    def send(self, requests: DataFrame) -> None:
        """Append requests(request, subject, datasets, epsilon); `at` is now where it is absent. Each call writes a folder of its own, as writers of one folder disturb each other."""
        at = F.col("at") if "at" in requests.columns else F.current_timestamp()
        requests.select("request", "subject", "datasets", F.col("epsilon").cast("double").alias("epsilon"), at.alias("at")).write.parquet(f"{self.base}/requests/{uuid.uuid4().hex}")

    def stream(self) -> DataFrame:
        """Decisions on the requests as they come; for a service that runs on, start it with a sink and a checkpoint of your own."""
        asked = self.spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", self.files).option("recursiveFileLookup", True).parquet(f"{self.base}/requests").where("subject IS NOT NULL")
        return asked.groupBy("subject").transformWithStateInPandas(Decide(self.budget), outputStructType=DECISION, outputMode="Append", timeMode="None")

    def decide(self) -> None:
        """Decide all that was sent so far. Callers of one driver take turns; another driver that is deciding makes this one fail, and `ask` wait."""
        with _locks[self.base]:
            query = self.stream().writeStream.format("parquet").option("path", f"{self.base}/decisions").option("checkpointLocation", f"{self.base}/cursor").outputMode("append").trigger(availableNow=True).start()
            query.awaitTermination()

    def ledger(self) -> DataFrame:
        return self.spark.read.schema(DECISION).parquet(f"{self.base}/decisions")

    def spent(self, subject: str, datasets: Sequence[str]) -> float:
        """The most that the subject has spent on any of the datasets, by the ledger."""
        if not self._decided():
            return 0.0
        rows = self.ledger().where((F.col("subject") == subject) & F.col("dataset").isin(*datasets)).groupBy("dataset").agg(F.sum("epsilon").alias("e"))
        return rows.agg(F.coalesce(F.max("e"), F.lit(0.0))).first()[0]

    def ask(self, subject: str, datasets: Sequence[str], epsilon: float, wait: float = 120.0) -> bool:
        """Send one request and wait for its decision."""
        name, until = uuid.uuid4().hex, time.monotonic() + wait
        self.send(self.spark.createDataFrame([(name, subject, sorted(datasets), epsilon)], "request string, subject string, datasets array<string>, epsilon double"))
        while True:
            failed = None
            try:
                self.decide()
            except PySparkException as e:  # another driver decides, perhaps on this request too
                failed = e
            found = [] if failed is not None and not self._decided() else self.ledger().where(F.col("request") == name).select("admitted").collect()
            if found:
                return all(r.admitted for r in found)
            if time.monotonic() > until:
                raise TimeoutError(f"no decision on {name} within {wait} seconds") from failed
            time.sleep(0.5)

    def _decided(self) -> bool:
        try:
            return bool(self.ledger().columns)
        except PySparkException:
            return False


LEDGER = "subject string, dataset string, epsilon double"


class Turns:
    """Budgets for the callers of one driver: what is left is read and spent in one turn. Other drivers must not spend from the same folder."""

    def __init__(self, spark: SparkSession, base: str, budget: float):
        self.spark, self.base, self.budget = spark, base.rstrip("/"), budget

    def ledger(self) -> DataFrame:
        self.spark.createDataFrame([], LEDGER).write.mode("ignore").parquet(f"{self.base}/ledger")
        return self.spark.read.schema(LEDGER).parquet(f"{self.base}/ledger")

    def spent(self, subject: str, datasets: Sequence[str]) -> float:
        rows = self.ledger().where((F.col("subject") == subject) & F.col("dataset").isin(*datasets)).groupBy("dataset").agg(F.sum("epsilon").alias("e"))
        return rows.agg(F.coalesce(F.max("e"), F.lit(0.0))).first()[0]

    def ask(self, subject: str, datasets: Sequence[str], epsilon: float) -> bool:
        with _locks[self.base]:
            ok = bool(datasets) and epsilon >= 0 and self.spent(subject, datasets) + epsilon <= self.budget + SLACK
            if ok:
                spends = F.array(*[F.struct(F.lit(subject).alias("subject"), F.lit(d).alias("dataset"), F.lit(float(epsilon)).alias("epsilon")) for d in sorted(set(datasets))])
                self.spark.range(1).coalesce(1).select(F.inline(spends)).write.mode("append").parquet(f"{self.base}/ledger")
            return ok
