"""Tables in folders, with every change committed by a numbered log entry.

Rows are written to a folder of their own first. A commit then adds one small
file to the log, which names the folders of every table of the store; the
highest entry holds. An entry is written under another name and published whole, by
a step that fails if its number is taken: a hard link on local file systems, a
rename elsewhere. It needs a store whose rename does not overwrite, as HDFS has;
object stores without one aren't offered. Nobody ever sees half an entry, so there
is none to pass over.

Every change is worked out from the state that it is committed upon: if another
writer was faster the commit is refused (``Conflict``), and nothing of either is
lost. Appends depend on nothing that is there, so they are tried again.

A job that dies at any point leaves what was committed, a reader goes on with the
folders it has begun to read, and several tables change together. ``vacuum``
deletes what older entries held, once nobody reads it any more.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of one size of an appended table that are merged into one.
MERGE = 16
#: Times that an append is tried when others commit in between.
TRIES = 20


class Conflict(RuntimeError):
    """Another writer changed the store first."""


class Held(RuntimeError):
    """Somebody else holds the lease."""


@dataclass(frozen=True)
class State:
    """What an entry of the log says: its number, the folders of each table, and who holds which lease."""

    number: int = 0
    tables: dict[str, list[str]] = field(default_factory=dict)
    leases: dict[str, dict] = field(default_factory=dict)


def latest(rows: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """One row a key: the last by ``order``; without one, as tables have no order, the largest of a key's rows."""
    if order is None:
        return rows.groupBy(*keys).agg(F.max(F.struct(*[c for c in rows.columns if c not in keys] or keys)).alias("_r")).select(*[F.col(c) if c in keys else F.col(f"_r.{c}") for c in rows.columns])
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), order).alias("_r"))
    return best.select("_r.*")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same key."""
    new = latest(new, keys, order)
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def update_columns(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Only ``columns`` of rows with a known key change; new keys are added."""
    o, n = old.alias("o"), latest(new, keys).alias("n")
    on = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    known = F.col(f"n.{keys[0]}").isNotNull()
    there = F.col(f"o.{keys[0]}").isNotNull()
    out = [F.coalesce(f"o.{k}", f"n.{k}").alias(k) for k in keys]
    for c in old.columns:
        if c in keys:
            continue
        fresh = F.col(f"n.{c}") if c in new.columns else F.lit(None)
        out.append((F.when(known & (~there | F.lit(c in columns)), fresh).otherwise(F.col(f"o.{c}"))).alias(c))
    return o.join(n, on, "full_outer").select(*out)


#: Verdict columns that a finished row keeps when its post is queued again.
VERDICT = ["status", "toxic_token", "confidence", "model_id", "policy_version"]


def enqueue(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Queue rows anew: finished rows keep status and verdict, all else is refreshed."""
    held = [c for c in VERDICT if c in old.columns]
    o, n = old.alias("o"), latest(new, keys).alias("n")
    done, again = F.col("o.status") == "done", F.col(f"n.{keys[0]}").isNotNull()
    out = [F.coalesce(f"n.{k}", f"o.{k}").alias(k) for k in keys]
    for c in old.columns:
        if c not in keys:
            stay = ~again | (done if c in held else F.lit(False))
            out.append(F.when(F.coalesce(stay, F.lit(False)), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c))
    return o.join(n, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys], "full_outer").select(*out)


def record_verdicts(queue: DataFrame, verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """Pending rows with a verdict become done."""
    cols = [c for c in verdicts.columns if c not in keys]
    v = latest(verdicts, keys).select(*keys, *[F.col(c).alias(f"_v_{c}") for c in cols], F.lit(True).alias("_hit"))
    joined = queue.join(v, keys, "left")
    for c in cols:
        joined = joined.withColumn(c, F.coalesce(f"_v_{c}", c))
    status = F.when(F.col("_hit"), "done").otherwise(F.col("status"))
    return joined.withColumn("status", status).select(queue.columns)


class Store:
    """Named tables under one folder that all executors reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.lease: tuple[str, int] | None = None
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self.fs = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _entries(self) -> list[str]:
        if not self.fs.exists(self._path("_log")):
            return []
        return sorted((x.getPath().getName() for x in self.fs.listStatus(self._path("_log")) if x.getPath().getName().endswith(".json")), reverse=True)

    def _entry(self, name: str) -> State:
        said = json.loads(self.spark.read.text(f"{self.root}/_log/{name}", wholetext=True).first()[0])
        return State(int(name.split(".")[0]), said["tables"], said.get("leases", {}))

    def state(self) -> State:
        names = self._entries()
        return self._entry(names[0]) if names else State()

    def _publish(self, number: int, said: dict) -> None:
        """The entry ``number``, whole, or a Conflict if there is one."""
        written, entry = self._path("_log", f"{uuid.uuid4().hex}.writing"), self._path("_log", f"{number:020d}.json")
        out = self.fs.create(written, False)
        out.write(bytearray(json.dumps(said).encode()))
        out.close()
        try:
            if self.fs.getScheme() == "file":
                files, paths = self.spark._jvm.java.nio.file.Files, self.spark._jvm.java.nio.file.Paths
                try:
                    files.createLink(*(paths.get(self.fs.makeQualified(x).toUri()) for x in (entry, written)))
                except Py4JJavaError as e:
                    if "FileAlreadyExists" not in str(e.java_exception):
                        raise
                    raise Conflict("another writer changed the store; read again") from e
            elif not self.fs.rename(written, entry):
                raise Conflict("another writer changed the store; read again")
        finally:
            self.fs.delete(written, False)

    def commit(self, changes: dict[str, list[str] | None], since: State, leases: dict[str, dict] | None = None) -> None:
        """The entry after ``since``, with the folders of the changed tables (None: no longer there).

        A store that works under a lease commits only while the lease is its own.
        """
        if self.lease:
            name, fence = self.lease
            if since.leases.get(name, {}).get("fence") != fence:
                raise Held(f"the lease {name} was taken over")
        tables = {k: v for k, v in {**since.tables, **changes}.items() if v is not None}
        self._publish(since.number + 1, {"tables": tables, "leases": since.leases if leases is None else leases})

    def write(self, name: str, rows: DataFrame, *partition_by: str) -> str:
        """Rows in a folder that no entry names yet."""
        folder = f"{name}/{uuid.uuid4().hex}"
        rows.write.partitionBy(*partition_by).parquet(f"{self.root}/{folder}")
        return folder

    def current(self, name: str) -> list[str] | None:
        return self.state().tables.get(name)

    def names(self) -> list[str]:
        return sorted(self.state().tables)

    def read(self, name: str, at: State | None = None) -> DataFrame:
        """The table's rows, now or as of a state."""
        folders = (at or self.state()).tables.get(name)
        if folders is None:
            raise LookupError(f"no table {name}")
        each = [self.spark.read.parquet(f"{self.root}/{f}") for f in folders]
        if len({str(x.schema) for x in each}) == 1 and len(each) > 1:  # one scan, however many folders there are
            return self.spark.read.schema(each[0].schema).parquet(*[f"{self.root}/{f}" for f in folders])
        out = each[0]
        for more in each[1:]:
            out = out.unionByName(more, allowMissingColumns=True)
        return out

    def get(self, name: str, **key) -> DataFrame:
        """The rows of one key; a table that isn't there is an error, a key that isn't gives no rows."""
        out = self.read(name)
        for column, value in key.items():
            out = out.where(F.col(column).eqNullSafe(F.lit(value)))
        return out

    def replace(self, name: str, rows: DataFrame, *partition_by: str) -> DataFrame:
        return self.replace_all({name: rows}, *partition_by)[name]

    def replace_all(self, tables: dict[str, DataFrame], *partition_by: str, since: State | None = None) -> dict[str, DataFrame]:
        """Several tables in one commit: all of them change, or none.

        Rows that were worked out from tables of the store are to be committed ``since`` the state that they were read at.
        """
        since = since or self.state()
        self.commit({name: [self.write(name, rows, *partition_by)] for name, rows in tables.items()}, since)
        return {name: self.read(name) for name in tables}

    def upsert(self, name: str, rows: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
        since = self.state()
        made = upsert(self.read(name, since), rows, keys, order) if name in since.tables else latest(rows, keys, order)
        return self.replace_all({name: made}, since=since)[name]

    def update(self, name: str, rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
        """As ``update_columns``, but every key must be there."""
        since = self.state()
        old = self.read(name, since)
        if not rows.join(old, keys, "left_anti").isEmpty():
            raise LookupError(f"{name} lacks a row to update")
        return self.replace_all({name: update_columns(old, rows, keys, columns)}, since=since)[name]

    def delete(self, name: str, where: Column) -> DataFrame:
        since = self.state()
        return self.replace_all({name: self.read(name, since).where(~F.coalesce(where, F.lit(False)))}, since=since)[name]

    def delete_user(self, user_id: str, names: list[str]) -> None:
        """The user's rows of all these tables, in one commit."""
        since = self.state()
        there = {n: self.read(n, since).where(~F.col("user_id").eqNullSafe(F.lit(user_id))) for n in names if n in since.tables}
        if there:
            self.replace_all(there, since=since)

    def replace_rows(self, name: str, rows: DataFrame, **key) -> DataFrame:
        """The rows of one key are deleted and ``rows`` put in their place, in one commit."""
        since = self.state()
        if name in since.tables:
            match = F.lit(True)
            for column, value in key.items():
                match = match & F.col(column).eqNullSafe(F.lit(value))
            rows = self.read(name, since).where(~match).unionByName(rows)
        return self.replace_all({name: rows}, since=since)[name]

    def append(self, name: str, rows: DataFrame, order: str | None = None, id_col: str | None = None, upon: State | None = None) -> DataFrame:
        """Another folder for the new rows. With ``id_col`` they get ids that go on from the largest, in ``order``.

        Rows that depend on what was there are to be appended ``upon`` the state that they were worked out from, and
        not if that has changed.

        When MERGE folders of one size have come together they are merged into one of the next, so a table of n
        appends has few folders, and a row is rewritten a logarithm of n times.
        """
        folder, staged = None, None
        for _ in range(1 if upon else TRIES):
            since = upon or self.state()
            old = since.tables.get(name, [])
            if id_col:
                # Ids depend on what is there, so they are given anew for each try; the sorted rows are staged once.
                staged = staged or stage(rows, order, f"{self.root}/_staged")
                last = (self.read(name, since).agg(F.max(id_col)).first()[0] or 0) if old else 0
                folder = self.write(name, numbered(self.spark, staged, id_col, last))
            else:
                folder = folder or self.write(name, rows)
            try:
                self.commit({name: self._merged(name, [*old, folder])}, since)
            except Conflict:
                continue
            if staged:
                self.unstage(staged)
            return self.read(name)
        raise Conflict(f"others changed the store while rows were appended to {name}")

    def unstage(self, path: str) -> None:
        """Delete what ``stage`` wrote."""
        self.fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path), True)

    def _merged(self, name: str, folders: list[str]) -> list[str]:
        size = lambda f: f.rpartition("/")[2].partition("-")[2]  # noqa: E731  "" for what was written at once, 1 for MERGE of those, ...
        while len(folders) >= MERGE and len({size(f) for f in folders[-MERGE:]}) == 1:
            rows = self.read(name, State(0, {name: folders[-MERGE:]}))
            folder = f"{name}/{uuid.uuid4().hex}-{int(size(folders[-1]) or 0) + 1}"
            rows.write.parquet(f"{self.root}/{folder}")
            folders = [*folders[:-MERGE], folder]
        return folders

    def take_lease(self, name: str, owner: str, seconds: float) -> Store:
        """A store on the same folder that commits only while ``owner`` holds the lease; Held if somebody does.

        Each taking has a higher fencing number, and a commit names the number it was made under: a holder who
        outlived the lease is refused once another has it. An expired lease that nobody took still counts.
        """
        for _ in range(TRIES):
            since = self.state()
            lease, now = since.leases.get(name), time.time()
            if lease and lease["until"] > now and lease["owner"] != owner:
                raise Held(f"{lease['owner']} holds the lease {name}")
            fence = (lease["fence"] if lease else 0) + 1
            try:
                self._publish(since.number + 1, {"tables": since.tables, "leases": {**since.leases, name: {"owner": owner, "until": now + seconds, "fence": fence}}})
            except Conflict:
                continue
            held = Store(self.spark, self.root)
            held.lease = (name, fence)
            return held
        raise Conflict("others changed the store again and again")

    def _lease_until(self, until: float) -> None:
        for _ in range(TRIES):
            since = self.state()
            name = self.lease[0]
            try:
                return self.commit({}, since, {**since.leases, name: {**since.leases.get(name, {}), "until": until}})
            except Conflict:
                continue
        raise Conflict("others changed the store again and again")

    def renew_lease(self, seconds: float) -> None:
        self._lease_until(time.time() + seconds)

    def give_up_lease(self) -> None:
        self._lease_until(0)
        self.lease = None

    def copy_to(self, other: Store, names: list[str], scores: str = "account_scores") -> list[str]:
        """Tables that are there, as one commit of the other store; of ``scores`` only rows that have a score of 0 or more."""
        at = self.state()
        there = [n for n in names if n in at.tables]
        rows = {n: self.read(n, at).where("score >= 0") if n == scores else self.read(n, at) for n in there}
        if there:
            other.replace_all(rows)
        return there

    def count(self, name: str) -> int:
        return self.read(name).count() if self.current(name) else 0

    def vacuum(self, keep_entries: int = 10) -> None:
        """Delete entries before the last ``keep_entries``, and folders that no kept entry names. Not while others write."""
        kept = self._entries()[:keep_entries]
        used = {f for name in kept for folders in self._entry(name).tables.values() for f in folders}
        if not used:
            return
        for x in self.fs.listStatus(self._path("_log")):
            if x.getPath().getName() not in kept:
                self.fs.delete(x.getPath(), False)
        self.fs.delete(self._path("_staged"), True)
        for table in self.fs.listStatus(self._path()):
            name = table.getPath().getName()
            if not name.startswith("_"):
                for folder in self.fs.listStatus(table.getPath()):
                    if f"{name}/{folder.getPath().getName()}" not in used:
                        self.fs.delete(folder.getPath(), True)


def stage(rows: DataFrame, order: str | list[str], folder: str) -> str:
    """Rows sorted by ranges and written under ``folder``, with their partition ``_p`` and place ``_i`` in it; the path."""
    spark, by = rows.sparkSession, [order] if isinstance(order, str) else order
    placed = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *by).sortWithinPartitions(*by).withColumn("_p", F.spark_partition_id())
    path = f"{folder.rstrip('/')}/{uuid.uuid4().hex}"
    placed.withColumn("_i", F.monotonically_increasing_id() - F.shiftleft(F.col("_p").cast("long"), 33)).write.parquet(path)
    return path


def numbered(spark: SparkSession, path: str, id_col: str, last: int) -> DataFrame:
    """Staged rows with consecutive ids from ``last`` + 1."""
    placed = spark.read.parquet(path)
    before, at = [], last
    for r in placed.groupBy("_p").count().orderBy("_p").collect():
        before.append((r["_p"], at))
        at += r["count"]
    offsets = F.broadcast(spark.createDataFrame(before, "_p int, _before long"))
    return placed.join(offsets, "_p").withColumn(id_col, F.col("_before") + F.col("_i") + 1).drop("_p", "_i", "_before")


def with_ids(rows: DataFrame, order: str | list[str], id_col: str, last: int, folder: str) -> DataFrame:
    """Consecutive ids from ``last`` + 1 in ``order``; no single task holds all rows. Rows are written once, under ``folder``."""
    return numbered(rows.sparkSession, stage(rows, order, folder), id_col, last)
