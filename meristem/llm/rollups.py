"""Token counts as additive rollups that deltas maintain.

A delta row is signed: +1 adds a document's count, -1 takes one back; a revision is the old count with
-1 and the new one with +1. A batch is summed to (source, lang, tokenizer) before it is written, and is
committed once under its id: replaying it changes nothing. Totals are the sums of the last snapshot and
of the batches committed since; every SNAPSHOT_EVERY batches a new snapshot takes theirs in.
"""

from __future__ import annotations

import json
import urllib.parse
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["source", "lang", "tokenizer"]
SNAPSHOT_EVERY = 16
_SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def inserts(counts: DataFrame) -> DataFrame:
    return counts.withColumn("sign", F.lit(1))


def deletes(counts: DataFrame) -> DataFrame:
    return counts.withColumn("sign", F.lit(-1))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Deltas that replace old counts by new ones; rows that are the same in both cancel out in the sums."""
    return deletes(old).unionByName(inserts(new))


class TokenRollup:
    """Rollups in a folder that all executors share.

    folder/data has the sums, each attempt in a folder of its own; folder/batches one small file for each
    committed batch, and folder/snapshots one for each snapshot, that say which attempts count. Such a
    file is written and closed under a name of its own, and then renamed to one that must not exist, so
    it is there whole or not at all; of two writers of one batch one commits, and what an unfinished
    attempt has left is never read. A file that holds no such thing, however it came there, counts as
    absent, and the batch can be sent again.

    Null sources, languages and tokenizer versions are groups of their own; a null count adds a document and no tokens.
    """

    def __init__(self, spark: SparkSession, folder: str, snapshot_every: int = SNAPSHOT_EVERY):
        self.spark, self.folder, self.snapshot_every = spark, folder.rstrip("/"), snapshot_every
        self._fs = self._path().getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))

    def _create(self, kind: str, name: str, what: dict) -> bool:
        """Whether the file was made; false if there is one already. One that can't be read is removed first."""
        draft, path = self._path("drafts", uuid.uuid4().hex), self._path(kind, name)
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(what).encode()))
        out.close()
        if self._fs.exists(path) and self._read(kind, name) is None:
            self._fs.delete(path, False)
        self._fs.mkdirs(path.getParent())
        jvm = self.spark._jvm
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, path, none)
        except Py4JJavaError:
            self._fs.delete(draft, False)
            if self._fs.exists(path):
                return False
            raise
        return True

    def _read(self, kind: str, name: str) -> dict | None:
        """What the file says; nothing if it is absent, empty or unfinished."""
        if not self._fs.exists(self._path(kind, name)):
            return None
        stream = self._fs.open(self._path(kind, name))
        text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        try:
            what = json.loads(text)
        except ValueError:
            return None
        return what if isinstance(what, dict) and "data" in what else None

    def _names(self, kind: str) -> list[str]:
        if not self._fs.exists(self._path(kind)):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(kind)))

    def _written(self, sums: DataFrame) -> str:
        data = f"data/{uuid.uuid4().hex}"
        sums.where("n_docs <> 0 or n_tokens <> 0").coalesce(8).write.parquet(f"{self.folder}/{data}")
        return data

    def _state(self) -> tuple[dict, dict[str, str]]:
        """The last snapshot, and the data of the batches that it does not have, by name."""
        last = next((s for name in reversed(self._names("snapshots")) if (s := self._read("snapshots", name))), {"data": None, "batches": []})
        since = {b: self._read("batches", b) for b in sorted(set(self._names("batches")) - set(last["batches"]))}
        return last, {b: what["data"] for b, what in since.items() if what}

    def committed(self, batch_id: str) -> bool:
        return self._read("batches", urllib.parse.quote(batch_id, safe="")) is not None

    def commit(self, batch_id: str, deltas: DataFrame) -> bool:
        """Commits deltas(source, lang, tokenizer, n_tokens, sign) as one batch; false if it was committed before, by this writer or another."""
        if self.committed(batch_id):
            return False
        sums = deltas.groupBy(*KEYS).agg(
            F.sum(F.col("sign").cast("long")).alias("n_docs"), F.coalesce(F.sum(F.col("sign").cast("long") * F.col("n_tokens")), F.lit(0)).cast("long").alias("n_tokens")
        )
        done = self._create("batches", urllib.parse.quote(batch_id, safe=""), {"data": self._written(sums)})
        if done and len(self._state()[1]) >= self.snapshot_every:
            self.snapshot()
        return done

    def snapshot(self) -> None:
        """Takes all committed batches into one table of totals. Of two writers' snapshots of one number the first stays; both are right."""
        last, since = self._state()
        if since:
            data = self._written(self._sums(last, since))
            self._create("snapshots", f"{len(self._names('snapshots')):09d}", {"data": data, "batches": sorted({*last["batches"], *since})})

    def _sums(self, last: dict, since: dict[str, str]) -> DataFrame:
        data = [last["data"], *since.values()]
        rows = self.spark.read.schema(_SCHEMA).parquet(*[f"{self.folder}/{d}" for d in data if d])
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))

    def totals(self) -> DataFrame:
        """Sums over all committed batches; groups that have come to nothing are left out. Without batches, no rows."""
        last, since = self._state()
        if not since and last["data"] is None:
            return self.spark.createDataFrame([], _SCHEMA)
        return self._sums(last, since).where("n_docs <> 0 or n_tokens <> 0")
