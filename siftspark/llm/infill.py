"""Fill-in-middle: each text is cut at two of its units and its parts are put in another order, marked.

Units are rows. The matches of a text are exploded with their ordinals, a window's running sum of their lengths gives where each ends, a
document's requests for two cuts meet the units they name, and the two ends are aggregated to a row for each document, with which its text
is cut. All of that is by the row's own number: the texts are dealt once by it, and explosion, window, join and aggregate keep that
partitioning, so units are never shuffled. Units behind the later cut have no bearing on it and aren't exploded; the count is over all.

Defined results: a null text is an empty one, and an empty text is plain with n = 0. A null doc_id hashes as no digits. Rows are told apart by
their place, so repeated rows and ids each give a row. Columns of ``docs`` named like an output are replaced, others stay. An empty table
gives no rows. A text is one row at all times, its units are as many rows, so a text's length bounds nothing but its own window's task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftspark.llm.joins import unused

UNITS = "[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


@dataclass(frozen=True)
class Params:
    """``salt`` goes before the id that is hashed; ``spm`` of a hundred cut texts have the suffix first; ``cut`` of a hundred are cut."""

    salt: str = "1:"
    cut: int = 90
    spm: int = 20


def _hash(doc_id: Column, salt: str, k: int) -> Column:
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def form(text: Column, doc_id: Column, p: Params = Params()) -> Column:
    marked = text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)
    plain = (text == "") | marked | (_hash(doc_id, p.salt, 3) % 100 >= p.cut)
    return F.when(plain, "plain").when(_hash(doc_id, p.salt, 4) % 100 < p.spm, "spm").otherwise("psm")


def rebuilt(output: Column, form_: Column) -> Column:
    """The text that an output was made from. A text with a mark in it was left plain, so the first mark of a kind is the only one; a mark
    begins with its one ``<``, so no end of a part joins a mark to an earlier one."""
    after = lambda mark: F.locate(mark, output)
    part = lambda a, b: F.substring(output, a + 3, b - a - 3)
    end = F.length(output) + 1
    psm = F.concat(part(F.lit(1), after(SUFFIX)), part(after(MIDDLE), end), part(after(SUFFIX), after(MIDDLE)))
    spm = F.concat(part(after(PREFIX), after(MIDDLE)), part(after(MIDDLE), end), part(F.lit(1), after(PREFIX)))
    return F.when(form_ == "plain", output).when(form_ == "spm", spm).otherwise(psm)


def infill(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", p: Params = Params()) -> DataFrame:
    """``docs`` with n (units), form, prefix_chars and middle_chars (code points; null if plain) and output (the text as it is trained on).
    ``docs`` should be a scan or a written table, since its rows are numbered by their place."""
    names = ("n", "form", "prefix_chars", "middle_chars", "output")
    rest = [c for c in docs.columns if c.lower() not in names or c in (text, doc_id)]
    row = unused(docs.columns, "__row")
    held = docs.select(*rest, F.monotonically_increasing_id().alias(row), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    held = held.withColumn("__form", form(F.col("__text"), F.col(doc_id), p)).repartition(row)

    # plain texts give no units by an empty array rather than by a filter, which would go below the exchange and keep it from being reused
    found = held.select(row, F.col(doc_id).alias("__id"), F.regexp_extract_all("__text", F.lit(UNITS), F.lit(0)).alias("__units"), (F.col("__form") == "plain").alias("__plain"))
    found = found.withColumn("__n", F.size("__units"))
    ends = [F.when(F.col("__plain"), 0).otherwise((_hash(F.col("__id"), p.salt, k) % (F.col("__n") + 1)).cast("int")) for k in (1, 2)]
    found = found.withColumn("__a", F.least(*ends)).withColumn("__b", F.greatest(*ends))
    requests = found.select(row, F.col("__n").cast("long").alias("n"), "__a", "__b")

    told = found.select(F.col(row).alias("__of"), F.posexplode(F.slice("__units", F.lit(1), F.col("__b"))).alias("__k", "__unit"))
    told = told.select("__of", (F.col("__k") + 1).alias("__k"), F.length("__unit").alias("__size"))
    told = told.withColumn("__end", F.sum("__size").over(W.partitionBy("__of").orderBy("__k").rowsBetween(W.unboundedPreceding, 0)))

    # the ordinal is a condition within the row's units, not a key beside it: so both sides stay where the row's number has put them
    asked = F.array_contains(F.array("__a", "__b"), F.col("__k"))
    met = requests.join(told, (F.col(row) == F.col("__of")) & asked, "left")
    at = lambda c: F.coalesce(F.max(F.when(F.col("__k") == F.col(c), F.col("__end"))), F.lit(0)).cast("int")
    cuts = met.groupBy(row).agg(F.max("n").alias("n"), at("__a").alias("__p"), at("__b").alias("__q"))

    x = held.join(cuts, row).withColumn("form", F.col("__form"))
    whole, cut = F.col("__text"), F.col("form") != "plain"
    prefix, middle = F.substring(whole, F.lit(1), F.col("__p")), F.substring(whole, F.col("__p") + 1, F.col("__q") - F.col("__p"))
    suffix = F.substring(whole, F.col("__q") + 1, F.length(whole))
    output = F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)).when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)).otherwise(whole)
    return x.select(*rest, "n", "form", F.when(cut, F.col("__p").cast("long")).alias("prefix_chars"), F.when(cut, (F.col("__q") - F.col("__p")).cast("long")).alias("middle_chars"), output.alias("output"))


def digests(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """The rows of ``infill`` with the digests of the output and of the text rebuilt from it, in place of both."""
    x = infill(docs.select("doc_id", "text"), p=p)
    return x.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(rebuilt(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
