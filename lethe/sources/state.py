"""Tables that keep their state between runs: one Parquet folder a table.

A run stages what it makes beside the tables (``stage``, ``stage_append``, or a writer of
its own at ``next_path``) and ``commit`` puts all of it in place, so that a job may read
the old contents while it writes and verifies the new ones.  ``commit`` first writes one
list of what is to be done; from then on the run has happened, and whoever uses the folder
next completes it, as every step may be repeated.  A run that dies before leaves all tables
as they were; ``begin`` clears what it staged.  All data are written by ordinary Spark jobs
on shared storage.  The folder has one writer at a time.

A run may also replace single files of a table (``new_part``, ``replace_files``): what the
rows of some files become is staged as an addition, and the commit puts it in place and
removes those files; all others keep their names and contents.  The driver and the commit's
list hold one relative path for each replaced file, as Spark's own listing of a scan does.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders inside a table's: the part that is no table row (removed by ``commit``), and each run's additions.
PART, NEXT, LOG, RUN = "part_of", "next", "log", "run_id"
#: A data file's path within its table, at the end of its whole path.
RELATIVE = f"/((?:(?:{PART}|{RUN})=[^/]+/)*[^/]+)$"


class StateFolder:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self.added: dict[str, str] = {}
        self.replaced: dict[str, dict] = {}

    def _path(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _move(self, source: str, target: str) -> None:
        fs, src = self._path(source)
        _, dst = self._path(target)
        fs.mkdirs(dst.getParent())
        if not fs.rename(src, dst):
            raise OSError(f"cannot rename {src} to {dst}")

    def _exists(self, name: str) -> bool:
        fs, p = self._path(name)
        return fs.exists(p)

    def _delete(self, name: str) -> None:
        fs, p = self._path(name)
        if fs.exists(p) and not fs.delete(p, True):
            raise OSError(f"cannot delete {p}")

    # --- what a run makes -------------------------------------------------------

    def begin(self) -> None:
        """Complete a commit that has begun, and drop what a run that died before its commit left."""
        self.recover()
        self._delete("__staged")
        self.added, self.replaced = {}, {}

    def next_path(self, name: str) -> str:
        """Where the next contents of ``name`` are written before the commit."""
        return f"{self.root}/__staged/next/{name}"

    def stage(self, name: str, df: DataFrame) -> DataFrame:
        """Write the next contents of ``name``; returns them read back."""
        df.write.mode("overwrite").parquet(self.next_path(name))
        return self.spark.read.schema(df.schema).parquet(self.next_path(name))

    def stage_append(self, name: str, df: DataFrame) -> None:
        """Write rows that the commit adds to ``name``."""
        run = self.added.setdefault(name, uuid.uuid4().hex)
        df.write.mode("overwrite").parquet(f"{self.root}/__staged/add/{name}/{RUN}={run}")

    def new_part(self, name: str) -> tuple[str, str]:
        """A run id and the folder in which rows that replace files of ``name`` are written."""
        run = uuid.uuid4().hex
        return run, f"{self.root}/__staged/add/{name}/{RUN}={run}"

    def replace_files(self, name: str, run: str, files: list[str]) -> None:
        """The commit puts the part ``run`` in the place of ``files`` (relative paths)."""
        self.replaced[name] = {"run": run, "files": files}

    # --- the commit -------------------------------------------------------------

    def commit(self, names: list[str] = ()) -> None:
        """Put the staged contents of ``names``, and all staged additions, in place."""
        todo = {"next": [n for n in names if self._exists(f"__staged/next/{n}")], "add": self.added,
                "replace": self.replaced}
        fs, p = self._path(f"__commit-{uuid.uuid4().hex}")
        stream = fs.create(p, True)
        try:
            stream.write(json.dumps(todo).encode())
        finally:
            stream.close()
        self._move(p.getName(), "__commit")
        self.added, self.replaced = {}, {}
        self.recover()

    def recover(self) -> None:
        """Complete a commit that has begun; every step may already have been done."""
        if not self._exists("__commit"):
            return
        fs, p = self._path("__commit")
        stream = fs.open(p)
        try:
            todo = json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()
        for name in todo["next"]:
            staged, old = f"__staged/next/{name}", f"__old/{name}"
            if self._exists(staged):
                self._delete(f"{staged}/{PART}={LOG}")  # rows as they were before: personal data
                if self._exists(name) and not self._exists(old):  # the old table is kept until the new one stands
                    self._move(name, old)
                self._move(staged, name)
            self._delete(old)
        for name, run in todo["add"].items():
            part = f"{RUN}={run}"
            if self._exists(f"__staged/add/{name}/{part}"):
                self._move(f"__staged/add/{name}/{part}", f"{name}/{part}")
        for name, new in todo.get("replace", {}).items():
            part = f"{RUN}={new['run']}"
            if self._exists(f"__staged/add/{name}/{part}"):
                self._delete(f"__staged/add/{name}/{part}/{PART}={LOG}")
                self._move(f"__staged/add/{name}/{part}", f"{name}/{part}")
            for f in new["files"]:
                self._delete(f"{name}/{f}")
        self._delete("__staged")
        self._delete("__old")
        self._delete("__commit")

    def publish(self, name: str) -> None:
        """Commit the staged contents of one table."""
        self.commit([name])

    def append(self, name: str, df: DataFrame) -> None:
        """Add rows to ``name`` by themselves."""
        self.recover()
        self.stage_append(name, df)
        self.commit()

    # --- reading ----------------------------------------------------------------

    def has(self, name: str) -> bool:
        self.recover()
        return self._exists(name)

    def _holds_data(self, name: str) -> bool:
        fs, p = self._path(name)
        files = fs.listFiles(p, True)
        while files.hasNext():
            if files.next().getPath().getName().endswith(".parquet"):
                return True
        return False

    def read(self, name: str, file_col: str | None = None) -> DataFrame:
        """The table; with ``file_col`` also the relative path of each row's file."""
        self.recover()
        fs, p = self._path(name)
        found = [f.getPath().getName() for f in fs.listStatus(p)]
        paths = [n for n in found if (n == f"{PART}={NEXT}" or n.startswith(f"{RUN}=")) and self._holds_data(f"{name}/{n}")]
        if any(n.endswith(".parquet") for n in found):
            paths.append("*.parquet")
        out = None
        for n in sorted(paths):
            df = self.spark.read.parquet(f"{self.root}/{name}/{n}")
            if file_col:
                df = df.withColumn(file_col, F.regexp_extract("_metadata.file_path", RELATIVE, 1))
            df = df.drop("__subjects", "__hit", PART)
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
        return out

    def files(self, name: str) -> list[str]:
        """Relative paths of the table's data files."""
        return sorted(re.search(RELATIVE, f).group(1) for f in self.read(name).inputFiles())

    def read_files(self, name: str, files: list[str], schema) -> DataFrame:
        """The rows of some of the table's files."""
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{name}/{f}" for f in files])


class StatefulModel:
    """A model whose tables are read from a StateFolder once they are kept there."""

    def __init__(self, model, state: StateFolder):
        self.model, self.state, self.spark = model, state, model.spark

    def __getitem__(self, name: str) -> DataFrame:
        return self.state.read(name) if self.state.has(name) else self.model[name]

    def __getattr__(self, name: str):
        return getattr(self.model, name)
