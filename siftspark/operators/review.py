"""Review of unified diffs. ``lines`` has capture_id, stream, line_no and line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftspark.functions import classify as C
from siftspark.operators.reduce import KEY, by_line


def diff_files(lines: DataFrame) -> DataFrame:
    """Lines of file sections, with the section and its path on the new side."""
    x = lines.withColumn("t", F.regexp_replace("line", "\r?\n$", ""))
    x = x.withColumn("section", F.sum(F.when(F.col("t").startswith("diff --git a/"), 1).otherwise(0)).over(by_line())).where("section > 0")
    rest = F.regexp_extract("t", r"^diff --git a/(.*)$", 1)
    new = F.when(rest.contains(" b/"), F.regexp_extract(rest, r"^.*? b/(.*)$", 1)).otherwise(rest)
    x = x.withColumn("path", F.first(new).over(W.partitionBy(*KEY, "section").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)))
    head = F.col("t").startswith("diff --git a/")
    mark = F.col("t").startswith("+++") | F.col("t").startswith("---")
    return x.withColumn("sign", F.when(head | mark, "").otherwise(F.regexp_extract("t", "^([-+])", 1)))


def changed_files(lines: DataFrame) -> DataFrame:
    """Per file: lines added and removed, whether it was deleted, and the first twelve changed lines."""
    x = diff_files(lines).withColumn("changed", F.col("sign") != "")
    x = x.withColumn("nth", F.row_number().over(W.partitionBy(*KEY, "section", "changed").orderBy("line_no")))
    first = F.array_sort(F.collect_list(F.when(F.col("changed") & (F.col("nth") <= 12), F.struct("line_no", "t"))))
    g = x.groupBy(*KEY, "section", "path").agg(F.count_if(F.col("sign") == "+").alias("added"), F.count_if(F.col("sign") == "-").alias("removed"), F.bool_or(F.col("t").startswith("deleted file mode")).alias("deleted"), F.array_join(F.transform(first, lambda s: F.concat(s["t"], F.lit("\n"))), "").alias("excerpt"))
    return g.withColumn("section", F.col("section").cast("long"))


def diff_findings(lines: DataFrame) -> DataFrame:
    """(kind, path, evidence): weakened, deleted and skipped tests, and changed dependencies."""
    x = diff_files(lines)
    test = C.is_test_path(F.col("path"))
    said = F.when(test & C.is_assertion(F.col("t")), F.col("sign"))
    weak = x.groupBy(*KEY, "section", "path").agg(F.count_if(said == "-").alias("gone"), F.count_if(said == "+").alias("come")).where((F.col("gone") > F.col("come")) & test)
    one = lambda d, kind, evidence: d.select("capture_id", F.lit(kind).alias("kind"), "path", evidence.alias("evidence"))
    return (
        one(weak, "weakened_test", F.format_string("%d assertion or test lines removed, %d added", "gone", "come"))
        .unionByName(one(x.where(F.col("t").startswith("deleted file mode") & test & C.is_source(F.col("path"))), "deleted_test", F.concat(F.lit("Test file deleted: "), "path")))
        .unionByName(one(x.where((F.col("sign") == "+") & C.is_skip_marker(F.col("t"))), "skipped_test", F.col("t")))
        .unionByName(one(x.where((F.col("sign") == "+") & C.dependency_line(F.col("path"), F.col("t"))), "dependency_change", F.col("t")))
    )


def new_file_findings(files: DataFrame) -> DataFrame:
    """Untracked source files of (path)."""
    return files.where(C.is_source(F.col("path"))).select(F.lit("new_file").alias("kind"), "path")


def stale(advice: DataFrame, current: DataFrame) -> DataFrame:
    """Advice (capture_id, revision, candidate_sha256) against the present state of the same id."""
    now = current.select("capture_id", F.col("revision").alias("now_revision"), F.col("candidate_sha256").alias("now_sha256"))
    return advice.join(now, "capture_id", "left").withColumn("stale", ~(F.col("revision").eqNullSafe(F.col("now_revision")) & F.col("candidate_sha256").eqNullSafe(F.col("now_sha256"))))


SNAPSHOT_VERSION = "candidate-manifest-1"
REVIEW_BYTES, SAMPLE_BYTES = 2 << 20, 4096


def reviewable(files: DataFrame) -> DataFrame:
    """Untracked files (path, regular, content) with ``reviewed``: regular, of two MiB at most, and text by their first 4096 bytes. A
    null content is empty."""
    b = F.coalesce(F.col("content").cast("binary"), F.lit(b""))
    return files.withColumn("reviewed", F.coalesce("regular", F.lit(False)) & (F.octet_length(b) <= REVIEW_BYTES) & C.valid_text(F.substring(b, 1, SAMPLE_BYTES)))


def snapshots(bases: DataFrame, files: DataFrame) -> DataFrame:
    """(capture_id, candidate_sha256, reviewed, unreviewed): one hash of what a candidate is, from ``bases(capture_id, base_commit, diff)``
    and the untracked ``files(capture_id, path, regular, content)``. Contents are hashed where they lie; what meets is a path, a
    length and a hash of each file, in the order of paths."""
    b = F.coalesce(F.col("content").cast("binary"), F.lit(b""))
    held = F.when(F.coalesce("regular", F.lit(False)), F.concat(F.octet_length(b).cast("string"), F.lit(":"), F.sha2(b, 256))).otherwise("nonregular")
    one = F.concat(F.octet_length("path").cast("string"), F.lit(":"), F.col("path"), held)
    per = reviewable(files).withColumn("one", one).groupBy("capture_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "one"))), lambda x: x["one"]), "").alias("manifest"), F.count_if("reviewed").alias("reviewed"), F.count_if(~F.col("reviewed")).alias("unreviewed")
    )
    whole = F.concat(F.lit(SNAPSHOT_VERSION), F.col("base_commit"), F.sha2(F.col("diff").cast("binary"), 256), F.coalesce("manifest", F.lit("")))
    none = F.lit(0).cast("long")
    return bases.join(per, "capture_id", "left").select("capture_id", F.sha2(whole.cast("binary"), 256).alias("candidate_sha256"), F.coalesce("reviewed", none).alias("reviewed"), F.coalesce("unreviewed", none).alias("unreviewed"))


def scope_files(changed: DataFrame, most: int = 24) -> DataFrame:
    """The files that a scope review asks about: of ``changed_files``, those that stand and hold no secret, the first ``most`` of a diff."""
    x = changed.where(~F.col("deleted") & ~C.contains_secret(F.col("excerpt")) & ~C.contains_secret(F.col("path")))
    return x.withColumn("nth", F.row_number().over(W.partitionBy(*KEY).orderBy("section"))).where(F.col("nth") <= most).drop("nth")


def scope_findings(needed: DataFrame) -> DataFrame:
    """Files ``(capture_id, path, probability)`` whose change is hardly needed for the goal: under three in ten."""
    said = F.format_string("a %.0f%% probability that this file's change is needed for the goal", F.col("probability") * 100)
    return needed.where("probability < 0.3").select("capture_id", F.lit("possible_scope_creep").alias("kind"), "path", said.alias("evidence"))


def null_list(spark: SparkSession, path: str) -> DataFrame:
    """(path, name): the records of a list whose records end with NUL, as bytes and as text. Names that aren't UTF-8 survive in ``path``; empty records are none."""
    x = spark.read.option("lineSep", "\x00").text(path).select(F.col("value").cast("binary").alias("path")).where("octet_length(path) > 0")
    return x.select("path", F.make_valid_utf8(F.col("path").cast("string")).alias("name"))


def binary_sections(diffs: DataFrame) -> DataFrame:
    """(capture_id, section, header, sha256, n_bytes): the files of diffs ``(capture_id, diff)`` as bytes, whatever their encoding. A section begins at a line that
    starts with ``diff --git ``; cuts are found in a form of one character a byte."""
    one = F.decode(F.col("diff").cast("binary"), "ISO-8859-1")
    cut = F.split(one, r"(?m)^(?=diff --git )")
    x = diffs.select("capture_id", F.posexplode(F.filter(cut, lambda s: s.startswith("diff --git "))).alias("section", "part"))
    raw = F.encode("part", "ISO-8859-1")
    return x.select("capture_id", (F.col("section") + 1).cast("long").alias("section"), F.encode(F.substring_index("part", "\n", 1), "ISO-8859-1").alias("header"), F.sha2(raw, 256).alias("sha256"), F.length(raw).cast("long").alias("n_bytes"))
