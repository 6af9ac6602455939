"""Parquet storage for the review tables, written run by run.

Layout under the root, which may be any shared store (file calls go through
Hadoop's ``FileSystem``):

    runs/seq-<n>           which run id took number n (created, never overwritten)
    runs/id-<digest>       the number of a run id
    <table>/run=<n>/       the rows run n wrote, replaced when the run is redone
    commits/seq-<k>.json   the k-th commit and its run, written last: the run counts from now on
    commits/run-<n>        that run n has committed (a short cut, made after its record)

A run asks for its number by its run id; asking again gives the same number,
another run id never gets it.  Readers take the rows of committed runs only,
so a run that broke off leaves nothing visible, and one that is redone
replaces its own rows.  Ids handed out by run n lie in n's range
(:mod:`codesieve.operators.ids`), so reading one review prunes to one folder.

Runs may overlap.  Run numbers say who asked first, commit numbers who counts
when: a commit takes the next number or fails, so a run that finds another one
committed since it looked looks again (:meth:`TableStore.commit_checked`).
A repository that changes is written again by the run that changes it; reading
merges by URL: who it is comes from its first commit, its mark from the last.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codesieve import schema as sch
from codesieve.operators import ids

COMMIT_SCHEMA = "run bigint, run_id string"


class TableStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._Path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # -- small files ---------------------------------------------------------

    def _create(self, name: str, text: str) -> bool:
        """A new small file, whole or not at all; False when it is there already.

        The rename refuses an existing target, in one step on stores whose rename is atomic: of two writers one wins.
        """
        path = self._Path(f"{self.root}/{name}")
        if self._fs.exists(path):
            return False
        part = self._Path(f"{self.root}/{name}.{uuid.uuid4().hex}.tmp")
        out = self._fs.create(part, True)
        out.write(bytearray(text.encode()))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        keep = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self._fs.makeQualified(part), self._fs.makeQualified(path), keep)
        except Py4JJavaError as e:
            if not self._fs.exists(path):
                raise
            if "FileAlreadyExists" not in str(e.java_exception):
                raise
            self._fs.delete(part, False)
            return False
        return True

    def _text(self, name: str) -> str | None:
        path = self._Path(f"{self.root}/{name}")
        if not self._fs.exists(path):
            return None
        stream = self._fs.open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    # -- runs ----------------------------------------------------------------

    def ensure(self) -> None:
        """K1: create the folders of every table that is not there."""
        for name in ["runs", "commits", *sch.TABLES]:
            self._fs.mkdirs(self._Path(f"{self.root}/{name}"))

    def begin(self, run_id: str) -> int:
        """The number of ``run_id``: a new one the first time, the same one ever after."""
        self.ensure()
        mark = f"runs/id-{hashlib.sha256(run_id.encode()).hexdigest()}"
        known = self._text(mark)
        if known is not None:
            return int(known)
        taken = [st.getPath().getName() for st in self._fs.listStatus(self._Path(f"{self.root}/runs"))]
        n = max([int(t[4:]) for t in taken if t.startswith("seq-") and t[4:].isdigit()], default=0) + 1
        while not self._create(f"runs/seq-{n}", run_id):
            n += 1
        self._create(mark, str(n))
        return int(self._text(mark))

    def _commit_numbers(self) -> list[int]:
        names = [st.getPath().getName() for st in self._fs.listStatus(self._Path(f"{self.root}/commits"))]
        return [int(n[4:-5]) for n in names if n.startswith("seq-") and n.endswith(".json") and n[4:-5].isdigit()]

    def last_commit(self) -> int:
        """The number of the last commit, 0 before the first."""
        self.ensure()
        return max(self._commit_numbers(), default=0)

    def committed(self, run: int) -> bool:
        if self._fs.exists(self._Path(f"{self.root}/commits/run-{run}")):
            return True
        # a run that broke off between its record and the short cut
        return not self.commits().where(F.col("run") == run).isEmpty()

    def commit(self, run: int, run_id: str, after: int | None = None) -> bool:
        """From now on the rows of ``run`` count, as the next commit; committing again changes nothing.

        ``after``: only if that is still the last commit; False if another run has committed since.
        """
        if not self.committed(run):
            record = json.dumps({"run": run, "run_id": run_id})
            if after is not None:
                if not self._create(f"commits/seq-{after + 1}.json", record):
                    return False
            else:
                while not self._create(f"commits/seq-{self.last_commit() + 1}.json", record):
                    pass
        self._create(f"commits/run-{run}", run_id)
        return True

    def commit_checked(self, run: int, run_id: str, write: Callable[[], None]) -> None:
        """``write`` what depends on the runs committed so far, then commit; both again if another run came between."""
        while True:
            last = self.last_commit()
            write()
            if self.commit(run, run_id, after=last):
                return

    def written(self, table: str, run: int) -> bool:
        """Whether ``run`` has written ``table`` completely."""
        return self._fs.exists(self._Path(f"{self.root}/{table}/run={run}/_SUCCESS"))

    # -- rows ----------------------------------------------------------------

    def write(self, table: str, rows: DataFrame, run: int) -> None:
        """K3 / K4 / K5: the rows of ``run``, in place of what an earlier attempt of it wrote."""
        rows.select(*[f.name for f in sch.TABLES[table].fields]).write.mode("overwrite").parquet(
            f"{self.root}/{table}/run={run}")

    def read_run(self, table: str, run: int) -> DataFrame:
        """What ``run`` wrote, committed or not."""
        return self.spark.read.schema(sch.TABLES[table]).parquet(f"{self.root}/{table}/run={run}")

    def commits(self) -> DataFrame:
        """(run, run_id, seq) of every committed run; seq is the order of the commits."""
        self.ensure()
        if not self._commit_numbers():
            return self.spark.createDataFrame([], COMMIT_SCHEMA + ", seq bigint")
        number = F.regexp_extract(F.col("_metadata.file_name"), r"seq-(\d+)\.json", 1).cast("bigint")
        return self.spark.read.schema(COMMIT_SCHEMA).json(f"{self.root}/commits/seq-*.json").select("*", number.alias("seq"))

    def read(self, table: str) -> DataFrame:
        """The rows of all committed runs; repositories merged by URL."""
        schema = sch.TABLES[table]
        cols = [f.name for f in schema.fields]
        folder = self._Path(f"{self.root}/{table}")
        if not self._fs.exists(folder) or not self._fs.listStatus(folder):
            return sch.empty(self.spark, schema)
        rows = (self.spark.read.schema(T.StructType([*schema.fields, T.StructField("run", T.LongType())]))
                .parquet(f"{self.root}/{table}"))
        if table != "repositories":
            return rows.join(self.commits().select("run"), "run", "left_semi").select(*cols)
        rows = rows.join(self.commits().select("run", "seq"), "run")
        first = F.min(F.struct("seq", "id", "owner", "name", "created_at")).alias("f")
        last = F.max(F.struct("seq", "last_reviewed_commit", "updated_at")).alias("l")
        merged = rows.groupBy("url").agg(first, last)
        source = {c: "l" for c in ("last_reviewed_commit", "updated_at")}
        return merged.select(*["url" if c == "url" else f"{source.get(c, 'f')}.{c}" for c in cols])

    def read_review(self, table: str, review_id: int) -> DataFrame:
        """The rows of one review's run, from that run's folder alone (reviews and file_feedback)."""
        run = ids.run_of(review_id)
        if not self.committed(run) or not self.written(table, run):
            return sch.empty(self.spark, sch.TABLES[table])
        key = "id" if table == "reviews" else "review_id"
        return self.read_run(table, run).where(F.col(key) == review_id)

    def compact_repositories(self, run_id: str) -> int:
        """Write the merged repositories as a run of their own; the rows of earlier runs may then be dropped."""
        run = self.begin(run_id)
        if not self.committed(run):
            self.commit_checked(run, run_id, lambda: self.write("repositories", self.read("repositories"), run))
        return run
