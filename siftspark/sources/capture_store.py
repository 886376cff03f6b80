"""A store of captures on the cluster's file system: texts first, metadata after them, and last one small file that makes both visible.

A save writes the texts of its captures as chunks of a fixed number of bytes, in order of (capture_id, stream, chunk), into a folder of its own, then the captures'
metadata, and then a commit file, which must not exist yet. Readers go by commit files alone. So a task or driver that fails leaves no visible
capture, and of two writers that began from the same state one fails and leaves none either. Quota and conflicts are decided before the commit, on what was written.

A range of bytes is recalled from the chunks it touches: the join is an equality on capture, stream and chunk number, and the least and largest of each that are asked for are
pushed to the scan, whose statistics skip all other files and row groups. Whole captures are never read to give back a part.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.errors.exceptions.captured import CapturedException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftspark.functions.text import canonical_hash

META = "capture_id string, created_at long, raw_sha256 string, stdout_bytes long, stderr_bytes long"
CHUNKS = "capture_id string, stream string, chunk long, bytes binary"
#: bytes that a capture costs besides its texts; a fixed value
OVERHEAD = 4096


class StoreFull(ValueError):
    pass


class StoreMoved(RuntimeError):
    """Another writer committed since this one looked."""


@dataclass(frozen=True)
class CaptureStore:
    """``chunk``: bytes of a chunk, the same for all of a store's life. ``quota``: bytes of texts and overhead that the store may hold; ``largest``: of one capture."""

    spark: SparkSession
    path: str
    chunk: int = 1 << 16
    quota: int | None = None
    largest: int = 64 << 20

    def _fs(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _delete(self, *names: str) -> None:
        for name in names:
            fs, path = self._fs(name)
            fs.delete(path, True)

    def commits(self) -> list[dict]:
        """What was committed, in order: number, folder, captures, bytes and the newest capture's time. A row for each save, not for each capture."""
        fs, path = self._fs("commits")
        if not fs.exists(path):
            return []
        rows = self.spark.read.schema("number long, folder string, captures long, bytes long, newest long").json(f"{self.path}/commits")
        return [r.asDict() for r in rows.orderBy("number").collect()]

    def _visible(self, kind: str, schema: str) -> DataFrame:
        folders = [f"{self.path}/{kind}/{c['folder']}" for c in self.commits() if c["folder"]]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def captures(self) -> DataFrame:
        return self._visible("captures", META)

    def chunks(self) -> DataFrame:
        return self._visible("texts", CHUNKS)

    def save(self, captures: DataFrame) -> DataFrame:
        """Saves ``captures(capture_id, created_at, stdout, stderr)``, texts or bytes, null meaning none: (capture_id, outcome). ``append``: new; ``same``: there already, or
        repeated here; ``conflict``: other texts have the id, there or, with a smaller hash, here; ``too_large``: over ``largest``. Only new ones are written.
        Raises if they would pass the quota, or if another writer was faster; then nothing is saved."""
        done = self.commits()
        number, folder = max([c["number"] for c in done], default=0) + 1, uuid.uuid4().hex
        empty = F.lit("").cast("binary")
        x = captures.select("capture_id", F.col("created_at").cast("long").alias("created_at"), *(F.coalesce(F.col(c).cast("binary"), empty).alias(c) for c in ("stdout", "stderr")))
        x = x.withColumn("raw_sha256", canonical_hash(F.col("stdout"), F.col("stderr")))
        for c in ("stdout", "stderr"):
            x = x.withColumn(f"{c}_bytes", F.octet_length(c).cast("long"))
        large = F.col("stdout_bytes") + F.col("stderr_bytes") > self.largest
        meta = ["capture_id", "created_at", "raw_sha256", "stdout_bytes", "stderr_bytes"]
        old = self.captures().select("capture_id", F.col("raw_sha256").alias("there"))
        order = W.partitionBy("capture_id").orderBy("large", "raw_sha256", "created_at")
        judged = x.select(*meta, large.alias("large")).join(old, "capture_id", "left").withColumn("nth", F.row_number().over(order)).withColumn("first", F.first("raw_sha256").over(order))
        kept = F.coalesce("there", "first")
        outcome = F.when(F.col("large"), "too_large").when(F.col("raw_sha256") != kept, "conflict").when(F.col("there").isNull() & (F.col("nth") == 1), "append").otherwise("same")
        self._write(judged.withColumn("outcome", outcome).select(*meta, "outcome"), f"judged/{folder}")
        judged = self.spark.read.parquet(f"{self.path}/judged/{folder}")
        new = judged.where("outcome = 'append'").select(*meta)
        try:
            n, n_bytes, newest = new.agg(F.count("*"), F.coalesce(F.sum(F.col("stdout_bytes") + F.col("stderr_bytes") + OVERHEAD), F.lit(0)), F.max("created_at")).first()
            if self.quota is not None and n_bytes + sum(c["bytes"] for c in done) > self.quota:
                raise StoreFull(f"{n_bytes} bytes don't fit into the quota of {self.quota}")
            once = x.join(new.select("capture_id", "raw_sha256"), ["capture_id", "raw_sha256"], "left_semi").withColumn("nth", F.row_number().over(W.partitionBy("capture_id").orderBy("created_at"))).where("nth = 1")
            each = once.select("capture_id", F.explode(F.array(*(F.struct(F.lit(c).alias("stream"), F.col(c).alias("all")) for c in ("stdout", "stderr")))).alias("t")).select("capture_id", "t.*").where("octet_length(all) > 0")
            places = F.sequence(F.lit(0).cast("long"), F.floor((F.octet_length("all") - 1) / self.chunk))
            cut = each.select("capture_id", "stream", "all", F.explode(places).alias("chunk")).withColumn("bytes", F.substring("all", (F.col("chunk") * self.chunk + 1).cast("int"), F.lit(self.chunk)))
            self._write(cut.select("capture_id", "stream", "chunk", "bytes").repartitionByRange("capture_id", "stream", "chunk").sortWithinPartitions("capture_id", "stream", "chunk"), f"texts/{folder}")
            self._write(new, f"captures/{folder}")
            if n:
                self._commit(number, {"number": number, "folder": folder, "captures": n, "bytes": n_bytes, "newest": newest})
        except BaseException:
            self._delete(f"texts/{folder}", f"captures/{folder}", f"judged/{folder}")
            raise
        return judged.select("capture_id", "outcome")

    def _write(self, rows: DataFrame, name: str) -> None:
        rows.write.parquet(f"{self.path}/{name}")

    def _commit(self, number: int, said: dict) -> None:
        fs, path = self._fs(f"commits/{number:010d}.json")
        try:
            out = fs.create(path, False)
        except CapturedException as e:
            raise StoreMoved(f"commit {number} is another writer's") from e
        except Exception as e:
            if "already exists" in str(e):
                raise StoreMoved(f"commit {number} is another writer's") from e
            raise
        out.write(bytearray(json.dumps(said).encode()))
        out.close()

    def purge(self, now: int, ttl: int) -> list[int]:
        """Forgets saves whose newest capture has expired by ``now``, commit file first, so that no reader sees half of one: their numbers. The last commit stays as an empty one, so that numbers
        aren't given twice."""
        done = self.commits()
        gone = [c for c in done if c["folder"] and c["newest"] + ttl < now]
        for c in gone:
            self._delete(f"commits/{c['number']:010d}.json")
            if c is done[-1]:
                self._commit(c["number"], {"number": c["number"], "folder": None, "captures": 0, "bytes": 0, "newest": c["newest"]})
            self._delete(f"captures/{c['folder']}", f"texts/{c['folder']}", f"judged/{c['folder']}")
        return [c["number"] for c in gone]

    def recall(self, requests: DataFrame) -> DataFrame:
        """``requests(capture_id, stream, start, end)``, each once, with ``bytes`` [start, end) of its stream, and ``error``: missing or invalid_range."""
        keys = ["capture_id", "stream", "start", "end"]
        held = self.captures().select("capture_id", F.struct("stdout_bytes", "stderr_bytes").alias("size"))
        x = requests.select("capture_id", "stream", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")).distinct().join(held, "capture_id", "left")
        size = F.when(F.col("stream") == "stdout", F.col("size.stdout_bytes")).when(F.col("stream") == "stderr", F.col("size.stderr_bytes"))
        fine = F.coalesce((F.col("start") >= 0) & (F.col("start") <= F.col("end")) & (F.col("end") <= size), F.lit(False))
        x = x.withColumn("error", F.when(F.col("size").isNull(), "missing").when(~fine, "invalid_range")).drop("size")
        asked = x.where("error is null and end > start").select(*keys, F.explode(F.sequence(F.floor(F.col("start") / self.chunk), F.floor((F.col("end") - 1) / self.chunk))).alias("chunk"))
        met = asked.join(self.near(asked), ["capture_id", "stream", "chunk"])
        first, last = F.greatest(F.col("start") - F.col("chunk") * self.chunk, F.lit(0)), F.least(F.col("end") - F.col("chunk") * self.chunk, F.lit(self.chunk))
        part = met.select(*keys, "chunk", F.substring("bytes", (first + 1).cast("int"), (last - first).cast("int")).alias("part"))
        found = part.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("chunk", "part"))).alias("parts"))
        joined = F.aggregate("parts", F.lit("").cast("binary"), lambda a, p: F.concat(a, p["part"]))
        return x.join(found, keys, "left").select(*keys, F.when(F.col("error").isNull(), F.coalesce(joined, F.lit("").cast("binary"))).alias("bytes"), "error")

    def near(self, asked: DataFrame) -> DataFrame:
        """Chunks between the least and largest that are asked for: bounds are one row, and reach the scan as literals."""
        low = asked.agg(F.min("capture_id"), F.max("capture_id"), F.min("chunk"), F.max("chunk")).first()
        if low[0] is None:
            return self.chunks().limit(0)
        return self.chunks().where(F.col("capture_id").between(low[0], low[1]) & F.col("chunk").between(low[2], low[3]))

    def recall_sections(self, requests: DataFrame, packs: DataFrame) -> DataFrame:
        """``requests(capture_id, section_id)`` with the section's ``bytes`` and ``error``. ``packs(capture_id, raw_sha256, section_id, stream, byte_start, byte_end)``: omissions; one of
        a pack of other texts than the capture's is none of its sections. Of equal ids the first bytes count."""
        own = packs.join(self.captures().select("capture_id", "raw_sha256"), ["capture_id", "raw_sha256"])
        own = own.groupBy("capture_id", "section_id").agg(F.min(F.struct("byte_start", "byte_end", "stream")).alias("s"))
        x = requests.select("capture_id", "section_id").distinct().join(own, ["capture_id", "section_id"], "left").select("capture_id", "section_id", "s.stream", F.col("s.byte_start").alias("start"), F.col("s.byte_end").alias("end"))
        got = self.recall(x.where("stream is not null"))
        x = x.join(got, ["capture_id", "stream", "start", "end"], "left")
        return x.select("capture_id", "section_id", "bytes", F.when(F.col("start").isNull(), "missing").otherwise(F.col("error")).alias("error"))


def shown(bytes_: Column) -> Column:
    """Recalled bytes as they are printed: (encoding, data), text where they are one, else base64."""
    fine = F.is_valid_utf8(bytes_.cast("string"))
    return F.when(bytes_.isNotNull(), F.struct(F.when(fine, "utf-8").otherwise("base64").alias("encoding"), F.when(fine, bytes_.cast("string")).otherwise(F.base64(bytes_)).alias("data")))
