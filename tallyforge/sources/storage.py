"""Tables in buckets of versioned files, published by commits; run partitions of staged rows; the ledger."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, datetime
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators.constraints import ConstraintError, observed, row_rules
from tallyforge.schemas import BUCKET_KEY, DQ, KEYS, LEDGER, REJECTS, STAGED, WAREHOUSE, conform
from tallyforge.session import counted
from tallyforge.sources.commits import Commit, CommitConflict, CommitLog, Parts, TableState, changed
from tallyforge.sources.files import Files
from tallyforge.sources.window import latest_succeeded, latest_watermark


def plain(x: object) -> str:
    """What json does not know: times in ISO form, the rest as text."""
    return x.isoformat() if isinstance(x, (datetime, date)) else str(x)


def as_json(body: dict) -> str:
    return json.dumps(body, sort_keys=True, indent=2, default=plain)


_FIELDS = ", ".join(f.replace(" ", ": ", 1) for f in LEDGER.split(", "))


@dataclass(frozen=True)
class Change:
    """New rows of a table. replace: they are the table. append: they come to it. merge: within the buckets that hold a key of
    theirs, `reconcile(old, new)` is the table; all other buckets keep their files."""

    rows: DataFrame
    how: str = "replace"
    reconcile: Callable[[DataFrame | None, DataFrame], DataFrame] | None = None


@dataclass(frozen=True)
class Written:
    state: TableState
    #: buckets that were written; None: all
    touched: set[str] | None


class Warehouse:
    """root: a folder or URI that Spark can read and write, and that the driver and the executors share.

    buckets: into how many a new fact table is dealt by its order; a table keeps the number that it was first published with.
    Choose it so that a bucket is some gigabytes.
    """

    def __init__(self, spark: SparkSession, root: str | Path, buckets: int = 16):
        self.spark, self.files, self.buckets = spark, Files(spark, root), buckets
        self.root, self.log = self.files.root, CommitLog(self.files)

    # published tables
    def table(self, name: str, state: TableState | None) -> DataFrame:
        paths = state.paths(f"{self.root}/{name}") if state else []
        return self.spark.read.schema(WAREHOUSE[name]).parquet(*paths) if paths else self.spark.createDataFrame([], WAREHOUSE[name])

    def current(self, commit: Commit | None = None) -> dict[str, DataFrame]:
        """The published tables, all of one commit (the latest, unless one is given)."""
        commit = commit or self.log.latest()
        return {t: self.table(t, s) for t, s in commit.tables.items()}

    def initialize(self) -> list[str]:
        """Empty typed tables where there are none yet: all published tables in one commit, and the run-partitioned ones."""
        missing = [t for t in WAREHOUSE if t not in self.log.latest().tables]
        if missing:
            self.publish(None, lambda commit: {t: Change(self.spark.createDataFrame([], WAREHOUSE[t])) for t in missing})
        run_tables = [*STAGED, "reject_rows", "dq_results", "run_ledger"]
        for t in run_tables:
            self.files.make(t)
        return [*WAREHOUSE, *run_tables]

    def _bucket(self, table: str, buckets: int):
        key = BUCKET_KEY.get(table)
        return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int") if key and buckets > 1 else F.lit(0)

    def _write(self, table: str, change: Change, old: TableState | None, version: str) -> Written:
        """Write a change's files, beside all others; its keys and row rules are checked on what was written."""
        buckets = old.buckets if old and change.how != "replace" else self.buckets if table in BUCKET_KEY else 1
        rows, touched = conform(change.rows, WAREHOUSE[table]), None
        if change.how == "merge" and old and old.parts:
            touched = {str(r[0]) for r in rows.select(self._bucket(table, buckets)).distinct().collect()}  # as many as there are buckets at most
            held = TableState(buckets, {b: v for b, v in old.parts.items() if b in touched})
            rows = conform(change.reconcile(self.table(table, held), rows), WAREHOUSE[table])
        seen, rules = Observation(), observed(row_rules(table))
        path = f"{self.root}/{table}/v={version}"
        out = rows.observe(seen, F.count(F.lit(1)).alias("rows"), *rules.values()).withColumn("bucket", self._bucket(table, buckets))
        (out.repartition("bucket") if buckets > 1 else out).write.partitionBy("bucket").parquet(path)
        broken = {rule: n for rule, n in counted(seen, *rules).items() if n}
        new: Parts = {n.partition("=")[2]: [version] for n in self.files.names(f"{table}/v={version}") if n.startswith("bucket=")}
        fresh = self.table(table, TableState(buckets, new))
        key = KEYS[table]
        # a key lies in one bucket, so those that were not written need no second look; appended rows are new keys
        repeated = fresh.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.count(F.lit(1))).first()[0]
        if repeated:
            broken[f"unique({', '.join(key)})"] = repeated
        if broken:
            self.files.delete(f"{table}/v={version}")
            raise ConstraintError(table, broken)
        if change.how == "append" and old:
            return Written(TableState(buckets, {b: old.parts.get(b, []) + new.get(b, []) for b in {*old.parts, *new}}), None)
        kept = {b: v for b, v in old.parts.items() if b not in touched} if touched is not None else {}
        return Written(TableState(buckets, kept | new), touched)

    def publish(self, run: dict | None, build: Callable[[Commit], dict[str, Change]], check: Callable[[Commit], object] | None = None, attempts: int = 5) -> Commit:
        """Write what build(commit) makes of the latest commit, check(new commit), and commit tables and the run's row in one.

        If another run has committed meanwhile: a change of other tables, or of other buckets of a merged one, is taken over and
        the commit tried again on top; a change of the same ones means building again on the new state, `attempts` times at most.
        """
        for _ in range(attempts):
            base, version = self.log.latest(), uuid.uuid4().hex
            made = {t: self._write(t, c, base.tables.get(t), version) for t, c in build(base).items()}
            now = base
            while not any(changed(base.tables.get(t), now.tables.get(t), w.touched) for t, w in made.items()):
                states = {t: self._rebased(w, now.tables.get(t)) for t, w in made.items()}
                commit = Commit(now.number + 1, now.tables | states, run)
                if check:
                    check(commit)
                if self.log.append(commit, plain):
                    return commit
                now = self.log.latest()
            for t in made:
                self.files.delete(f"{t}/v={version}")
        raise CommitConflict(f"{attempts} attempts to publish {', '.join(made)}, each overtaken by another run")

    @staticmethod
    def _rebased(mine: Written, now: TableState | None) -> TableState:
        if mine.touched is None or now is None:
            return mine.state
        return TableState(now.buckets, {b: v for b, v in now.parts.items() if b not in mine.touched} | {b: v for b, v in mine.state.parts.items() if b in mine.touched})

    def vacuum(self, keep: int = 10) -> list[str]:
        """Delete versions that none of the last `keep` commits names; their paths. Not while a run is publishing."""
        numbers = self.log.numbers()[-keep:]
        named = {(t, v) for n in numbers for t, s in self.log.read(n).tables.items() for versions in s.parts.values() for v in versions}
        gone = [f"{t}/v={v}" for t in WAREHOUSE for v in (n[2:] for n in self.files.names(t) if n.startswith("v=")) if (t, v) not in named]
        for path in gone:
            self.files.delete(path)
        return gone

    # rows of one run
    def stage(self, table: str, df: DataFrame, run_id: str) -> DataFrame:
        """Rows of one run, in its own partition, with the table's schema; they stay if the run fails later."""
        ddl = {"reject_rows": REJECTS, "dq_results": DQ}.get(table)
        out = conform(df, ddl) if ddl else df
        path = f"{self.root}/{table}/run_id={run_id}"
        out.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(out.schema).parquet(path)

    def stage_split(self, table: str, tagged: DataFrame, run_id: str) -> tuple[dict[str, DataFrame], dict[str, int]]:
        """(rows, counts) of each branch of a table's tagged rows (operators.staging.branches), written in one pass.

        The rows of a branch are a folder of the run's partition; what a first row has no use for is written as null. Counts
        are observed while the rows are written.
        """
        path, seen = f"{self.root}/{table}/run_id={run_id}", Observation()
        names = ("first", "repeat", "reject")
        tagged.observe(seen, *(F.count_if(F.col("branch") == n).alias(n) for n in names)).write.mode("overwrite").partitionBy("branch").parquet(path)
        counts, schema = counted(seen, *names), tagged.drop("branch").schema
        read = lambda n: self.spark.read.schema(schema).parquet(f"{path}/branch={n}") if counts[n] else self.spark.createDataFrame([], schema)
        return {n: read(n) for n in names}, counts

    def run_rows(self, table: str, run_id: str) -> DataFrame:
        """What a run staged for a table, with its run_id; an unknown run is an error."""
        where = f"{table}/run_id={run_id}"
        if not self.files.exists(where):
            raise ValueError(f"run {run_id} has no rows of {table}")
        if table in STAGED:
            ddl = STAGED[table].columns
            rows = self.spark.read.schema(ddl).parquet(f"{self.root}/{where}/branch=first") if self.files.exists(f"{where}/branch=first") else self.spark.createDataFrame([], ddl)
        else:
            rows = self.spark.read.schema({"reject_rows": REJECTS, "dq_results": DQ}[table]).parquet(f"{self.root}/{where}")
        return rows.withColumn("run_id", F.lit(run_id))

    # the ledger: a small file for each run that is running or failed; that a run succeeded is said by its commit alone
    def record(self, row: dict) -> None:
        if row["status"] == "succeeded":
            raise ValueError("a run succeeds by its commit")
        self.files.write(f"run_ledger/{row['run_id']}.json", json.dumps(row, sort_keys=True, default=plain))

    def ledger(self, commit: Commit | None = None) -> DataFrame:
        """run_id, source_system, mode, snapshot_key, started_at, ... of every run, as of a commit: the latest, or one that is
        about to be made."""
        numbers = self.log.numbers()
        last = commit.number if commit else (numbers[-1] if numbers else -1)
        noted = self.spark.read.schema(LEDGER).json(f"{self.root}/run_ledger/*.json") if any(n.endswith(".json") for n in self.files.names("run_ledger")) else self.spark.createDataFrame([], LEDGER)
        done = noted.limit(0)
        if numbers:
            commits = self.spark.read.schema(f"number bigint, run struct<{_FIELDS}>").json(f"{self.root}/{CommitLog.FOLDER}/*.json")
            done = commits.where((F.col("number") <= last) & F.col("run").isNotNull()).select("run.*")
        if commit and commit.run and commit.number not in numbers:
            new = self.spark.range(1).select(F.from_json(F.lit(json.dumps(commit.run, default=plain)), f"struct<{_FIELDS}>").alias("run"))
            done = done.unionByName(new.select("run.*"))
        return noted.join(done.select("run_id"), "run_id", "left_anti").select(*done.columns).unionByName(done)

    def prior_watermark(self, source: str, column: str) -> datetime | None:
        row = latest_watermark(self.ledger(), source, column).select(F.date_format("watermark_high", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("t")).first()
        return datetime.fromisoformat(row["t"]) if row else None

    def latest_run(self) -> str | None:
        row = latest_succeeded(self.ledger()).select("run_id").first()
        return row["run_id"] if row else None
