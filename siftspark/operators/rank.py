"""Ranking of hidden sections from supplied probabilities. No remote model is called: decisions come as a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftspark.store import materialize

#: by level of need; fixed values
CAPS, FLOORS = (1, 2, 4, 8, 16), (1, 1, 2, 4, 16)
LEAST_EVIDENCE = 0.7


def scored(sections: DataFrame) -> DataFrame:
    """How many goal tokens each section holds: ``sections(capture_id, idx, text, tokens)``."""
    return sections.withColumn("score", F.aggregate("tokens", F.lit(0), lambda acc, t: acc + F.contains(F.lower("text"), t).cast("int")))


def standings(sections: DataFrame, most: int = 64) -> DataFrame:
    """(capture_id, idx, score, rank, kept) of every section: its place in the order of ``prefilter``, and whether that keeps it. Sections are put in order over the cluster by ranges of
    (capture, score, place); running counts go from one range to the next by a total for each range, so a capture may be as large as it likes: no task has it whole."""
    narrow = materialize(scored(sections).select("capture_id", "idx", "score"), "scores")
    placed = materialize(narrow.repartitionByRange("capture_id", F.desc("score"), "idx").withColumn("part", F.spark_partition_id()), "standings")
    ranges = placed.groupBy(F.col("capture_id").alias("__of"), F.col("part").alias("__part")).agg(F.count("*").alias("all"))
    ranges = ranges.withColumn("before", F.sum("all").over(W.partitionBy("__of").orderBy("__part")) - F.col("all")).drop("all")
    x = placed.join(ranges, placed["capture_id"].eqNullSafe(ranges["__of"]) & (placed["part"] == ranges["__part"]))
    rank = F.col("before") + F.row_number().over(W.partitionBy("capture_id", "part").orderBy(F.desc("score"), "idx"))
    return x.withColumn("rank", rank).select("capture_id", "idx", F.col("score").cast("long").alias("score"), "rank", (F.col("rank") <= most).alias("kept"))


def prefilter(sections: DataFrame, most: int = 64) -> DataFrame:
    """Per capture, the sections with most goal tokens, first come first: ``sections(capture_id, idx, text, tokens)``."""
    x = scored(sections)
    return x.withColumn("r", F.row_number().over(W.partitionBy("capture_id").orderBy(F.desc("score"), "idx"))).where(F.col("r") <= most).drop("r")


def level(need: Column) -> Column:
    return F.least(F.greatest(F.round(need).cast("int"), F.lit(0)), F.lit(4))


def kept(choice: DataFrame) -> DataFrame:
    """The candidates to keep: ``choice(capture_id, candidate_id, probability, need)``. In order of probability, ranks within the level's
    cap whose forerunners hold less than 0.55 + 0.1 need; at least the level's floor, and one."""
    w = W.partitionBy("capture_id").orderBy(F.desc("probability"), "candidate_id")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), level(F.col("need")) + 1)
    x = choice.withColumn("r", F.row_number().over(w)).withColumn("before", F.coalesce(F.sum("probability").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    n = F.count("*").over(W.partitionBy("capture_id"))
    x = x.withColumn("cap", F.least(pick(CAPS), n)).withColumn("floor", F.least(pick(FLOORS), n))
    taken = F.count_if((F.col("r") <= F.col("cap")) & (F.col("before") < 0.55 + 0.1 * F.col("need"))).over(W.partitionBy("capture_id"))
    return x.withColumn("keep", F.greatest(taken, F.col("floor"), F.lit(1))).where("r <= keep").select("capture_id", "candidate_id", F.col("r").cast("long").alias("rank"))


def expected_level(levels: Column) -> Column:
    """Mean level of an array of (level, probability); null where nothing has a probability."""
    total = F.aggregate(levels, F.lit(0.0), lambda a, x: a + x["probability"])
    return F.aggregate(levels, F.lit(0.0), lambda a, x: a + x["level"] * x["probability"]) / F.nullif(total, F.lit(0.0))


def level_error(levels: Column, n: int) -> Column:
    """Why an answer of levels, an array of (level, probability), isn't one over ``n`` levels; null where it is. Levels are consecutive whole numbers from any first one, each once."""
    have = F.transform(levels, lambda x: x["level"])
    p = lambda x: x["probability"].cast("double")
    ranged = F.forall(levels, lambda x: F.coalesce((p(x) >= 0) & (p(x) <= 1) & ~F.isnan(p(x)), F.lit(False)))
    total = F.aggregate(levels, F.lit(0.0), lambda a, x: a + p(x))
    rising = F.array_sort(have) == F.sequence(F.array_min(have), F.array_min(have) + n - 1)
    return F.when(levels.isNull(), "missing").when((F.size(levels) != n) | ~ranged | ~F.coalesce(rising, F.lit(False)) | ~total.between(0.98, 1.02), "shape")


def score_level(levels: Column, n: int) -> Column:
    """The expected level of a sound answer, counted from its first level as 0; null of others."""
    base = F.array_min(F.transform(levels, lambda x: x["level"]))
    return F.when(level_error(levels, n).isNull(), expected_level(F.transform(levels, lambda x: F.struct((x["level"] - base).cast("double").alias("level"), x["probability"].cast("double").alias("probability")))))


def gate(decisions: DataFrame) -> DataFrame:
    return decisions.withColumn("fallback", F.when(F.col("exists_p") < LEAST_EVIDENCE, "no_relevant_evidence"))


def answer_errors(choice: DataFrame) -> DataFrame:
    """The first failing check of each answer ``choice(capture_id, candidate_id, probability, chosen, known)``; null if sound."""
    top = F.max_by("candidate_id", F.struct("probability", F.lit(0)))
    g = choice.groupBy("capture_id").agg(F.bool_and("known").alias("known"), F.bool_and(F.col("probability").between(0, 1)).alias("ranged"), F.sum("probability").alias("total"), F.max("probability").alias("best"), F.max(F.when(F.col("candidate_id") == F.col("chosen"), F.col("probability"))).alias("of_chosen"), top.alias("top"))
    error = F.when(~F.col("known"), "unknown_choice").when(~F.col("ranged"), "probability_range").when(~F.col("total").between(0.98, 1.02), "probability_sum").when(F.col("of_chosen").isNull() | (F.col("of_chosen") < F.col("best")), "choice_mismatch")
    return g.select("capture_id", error.alias("error"))


def enough(candidates: DataFrame) -> DataFrame:
    """``candidates(capture_id, kind)`` counted against the least numbers (6 search, 3 diff, 2 output; over 64 hits is an error)."""
    g = candidates.groupBy("capture_id", "kind").agg(F.count("*").alias("n"))
    least = F.when(F.col("kind") == "search", 6).when(F.col("kind") == "diff", 3).otherwise(2)
    return g.withColumn("fallback", F.when((F.col("kind") == "search") & (F.col("n") > 64), "search_candidate_limit").when(F.col("n") < least, "no_rankable_sections"))


def in_ranges(lines: DataFrame, ranges: DataFrame, inside: bool = True) -> DataFrame:
    """Lines wholly inside a selected byte range of their stream, or outside all of them: one pass over lines and ranges in byte order."""
    from siftspark.operators.reduce import with_selection

    return with_selection(lines, ranges).where(F.col("chosen") == inside).drop("chosen", "asked")


def _cuts(n: Column, size: Column, blanks: Column) -> Column:
    """Where the chunks of a run of ``n`` lines begin: each takes ``size`` lines, or ends after the last blank line in the second half
    of them. ``blanks``: places of blank lines in the run. Steps are two for each ``size`` of lines at most."""
    start = lambda state: F.element_at(state, -1)

    def step(state: Column, _: Column) -> Column:
        limit = start(state) + size
        blank = F.array_max(F.filter(blanks, lambda b: (b >= start(state) + F.floor(size / 2)) & (b < limit)))
        return F.when(limit >= n, state).otherwise(F.concat(state, F.array(F.coalesce(blank + 1, limit))))

    return F.aggregate(F.sequence(F.lit(1).cast("long"), F.ceil(2 * n / size) + 1), F.array(F.lit(0).cast("long")), step)


def chunks(lines: DataFrame, least: int = 30) -> DataFrame:
    """Runs of hidden middle lines cut into chunks: ``least`` lines, or a sixtieth of the stream's hidden ones where that is more, and
    rather after a blank line in the second half. ``chunk`` numbers those of a run."""
    from siftspark.operators.reduce import KEY, MIDDLE, by_line, islands, whole

    x = lines.withColumn("m", F.coalesce(F.col("reason") == MIDDLE, F.lit(False)))
    x = islands(x, F.col("m") != F.lag("m").over(by_line())).where("m")
    x = x.withColumn("size", F.greatest(F.lit(least), F.ceil(F.count("*").over(whole()) / 60)).cast("long")).withColumn("pos", (F.row_number().over(by_line("island")) - 1).cast("long"))
    empty = F.collect_list(F.when(F.regexp_replace("line", r"(?U)\s", "") == "", F.col("pos")))
    runs = x.groupBy(*KEY, "island").agg(_cuts(F.count("*"), F.max("size"), F.array_sort(empty)).alias("cuts"))
    x = x.join(runs, [*KEY, "island"]).withColumn("chunk", (F.size(F.filter("cuts", lambda c: c <= F.col("pos"))) - 1).cast("long"))
    g = x.groupBy(*KEY, "island", "chunk").agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), F.count("*").alias("n"), F.min("byte_start").alias("byte_start"), F.max("byte_end").alias("byte_end"))
    return g.drop("island")


def rank_sections(planned: DataFrame) -> DataFrame:
    """The sections that a ranker chooses among, each an exact byte range, by the kind of the capture: the hit sections of a search, the
    files of a diff, the hidden chunks of other output. (capture_id, kind, idx, id, stream, byte_start, byte_end, label); captures
    without sections have no row. ``planned``: lines with their kind and reason. Of searches and diffs only stdout counts."""
    from siftspark.operators import pack
    from siftspark.operators.review import diff_files

    out = F.col("stream") == "stdout"
    hits = pack.hit_sections(planned.where((F.col("kind") == "search") & out))
    hits = hits.select("capture_id", F.lit("search").alias("kind"), "stream", "byte_start", "byte_end", F.format_string("%s lines %d-%d", "path", "first_line", "last_line").alias("label"))
    files = diff_files(planned.where((F.col("kind") == "diff") & out)).groupBy("capture_id", "stream", "section")
    head = F.split_part(F.substring(F.min_by("t", "line_no"), 14, 1 << 20), F.lit(" b/"), F.lit(1))
    diffs = files.agg(F.min("byte_start").alias("byte_start"), F.max("byte_end").alias("byte_end"), head.alias("path"), F.count("*").alias("n"))
    diffs = diffs.select("capture_id", F.lit("diff").alias("kind"), "stream", "byte_start", "byte_end", F.format_string("diff of %s (%d lines)", "path", "n").alias("label"))
    middle = chunks(planned.where("kind = 'output'"))
    middle = middle.select("capture_id", F.lit("output").alias("kind"), "stream", "byte_start", "byte_end", F.format_string("%s lines %d-%d", "stream", F.col("first_line") + 1, F.col("last_line") + 1).alias("label"))
    order = W.partitionBy("capture_id").orderBy(F.when(out, 0).otherwise(1), "byte_start")
    x = hits.unionByName(diffs).unionByName(middle).withColumn("idx", (F.row_number().over(order) - 1).cast("long"))
    number = F.when(F.col("idx") < 10, F.concat(F.lit("0"), F.col("idx").cast("string"))).otherwise(F.col("idx").cast("string"))
    of_search = F.concat(F.lit("section_"), number, F.lit("_"), F.col("byte_start").cast("string"), F.lit("_"), F.col("byte_end").cast("string"))
    return x.withColumn("id", F.when(F.col("kind") == "search", of_search).otherwise(F.concat(F.lit("s"), number)))


def section_limit(lengths: Column, overhead: Column | int, state: int = 56 << 10, least: int = 320, most: int = 2400, request: int = 64 << 10) -> Column:
    """Bytes of text for each section so that a request fits: an equal part of the state, within bounds, cut by a quarter until the
    sections and the overhead are within the request's bytes; null where half of the least doesn't do."""
    n = F.greatest(F.size(lengths), F.lit(1))
    first = F.least(F.greatest(F.floor(F.lit(state) / n).cast("long"), F.lit(least).cast("long")), F.lit(most).cast("long"))
    size = lambda k: F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + F.least(x.cast("long"), k)) + overhead
    step = lambda k: F.when(k.isNull() | (size(k) <= request), k).when(k <= least // 2, F.lit(None).cast("long")).otherwise(F.expr("0L") + F.floor(k * 3 / 4).cast("long"))
    cuts = F.aggregate(F.sequence(F.lit(1), F.lit(12)), first, lambda k, _: step(k))
    return F.when(size(cuts) <= request, cuts)


def cache_key(version: str, raw_sha256: Column, request: Column) -> Column:
    return F.sha2(F.concat(F.lit(version), raw_sha256, request).cast("binary"), 256)


def cached(requests: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """Decisions kept from earlier equal requests: ``requests(cache_key, ids)`` with the candidates' ids, ``cache(cache_key,
    schema_version, model, exists_p, need, kept_ids)``. ``found`` is miss, invalid or hit; kept ids only of hits."""
    kept = F.col("kept_ids")
    sound = (
        (F.col("schema_version") == 2) & F.col("model").startswith(model) & F.col("exists_p").between(LEAST_EVIDENCE, 1) & F.col("need").between(0, 4)
        & F.size(kept).between(1, CAPS[-1]) & (F.size(F.array_distinct(kept)) == F.size(kept)) & (F.size(F.array_except(kept, F.col("ids"))) == 0)
    )
    x = requests.join(cache, "cache_key", "left")
    found = F.when(F.col("schema_version").isNull(), "miss").when(F.coalesce(sound, F.lit(False)), "hit").otherwise("invalid")
    return x.withColumn("found", found).withColumn("kept_ids", F.when(F.col("found") == "hit", kept)).drop("schema_version")


def remember(decisions: DataFrame, cache: DataFrame) -> DataFrame:
    """Decisions that the cache doesn't hold yet, each key once (the first by model): what is there wins."""
    w = W.partitionBy("cache_key").orderBy("model", "need")
    return decisions.join(cache.select("cache_key"), "cache_key", "left_anti").withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")
