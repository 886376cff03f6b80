"""The reduction plan: which lines may be hidden, each with a reason.

``lines`` has a row for each line: capture_id, stream, line_no, line (terminator included). Stages run in a fixed order and the first
to give a reason wins; a stage sees the reasons of the ones before it. They are windows over (capture_id, stream), or over parts of it, in
line order, so one shuffle by that key serves a chain of them; row-wise classification happens once, before it. Three things need the lines of
a capture a second time: equal edits, recaps of facts, and which goal tokens tell something. For these the chain is cut once by a written table. Each
reads its own columns of that table, and what it finds comes back as marker rows of the chain, which windows spread, so lines are shuffled
twice in all. A capture is the unit of order and bounded; frames that look ahead are run backwards, so that no frame is computed anew for each row. Of windows
over parts, the ordered one comes first: the sort that it needs serves the others.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftspark.functions import classify as C
from siftspark.functions import text as X
from siftspark.store import dealt, materialize

KEY = ("capture_id", "stream")
TESTS, PROGRESS_OF_TESTS, IDENTICAL, SIMILAR, REDRAW = "successful_test_inventory", "test_progress", "repeated_identical_lines", "similar_lines", "terminal_progress"
GENERATED, MIDDLE, BOILERPLATE, DUPLICATE = "generated_file_diff", "long_output_middle", "runner_boilerplate", "duplicate_of_visible_line"
FRAMES, SAME_EDIT, MORE_HITS, REPEATED_HITS, BUILD = "runtime_internal_frames", "same_edit_in_more_files", "search_matches_beyond_head", "repeated_search_match_content", "successful_cargo_progress"
SILENT = (BOILERPLATE, DUPLICATE)
UNSUPPORTED = "unsupported_search_format"
ADAPTIVE_SEARCH, ADAPTIVE = "adaptive_search_nonselected", "adaptive_nonselected"
LONG_WORD = 1024


@dataclass(frozen=True)
class Params:
    """Thresholds; fixed values."""

    inventory: int = 2
    search_lines: int = 40
    search_bytes: int = 4096
    search_head: int = 12
    same_edit_files: int = 3
    identical_run: int = 3
    similar_run: int = 8
    long_bytes: int = 12288
    long_lines: int = 150
    long_head: int = 30
    long_tail: int = 50
    after: int = 8
    before: int = 2
    repeat_hits: int = 12
    build_run: int = 16
    tiny_gap: int = 72


def by_line(*more: str) -> W:
    return W.partitionBy(*KEY, *more).orderBy("line_no")


def whole(*more: str) -> W:
    return W.partitionBy(*KEY, *more)


def so_far() -> W:
    """A stream up to a line."""
    return by_line().rowsBetween(W.unboundedPreceding, 0)


def in_all() -> W:
    """A whole stream in the order of its lines: such windows share a pass with those by line."""
    return by_line().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)


def next_of(name: str) -> Column:
    """The next value that isn't null, on later lines."""
    return F.expr(f"lead({name}) ignore nulls over (partition by {', '.join(KEY)} order by line_no)")


def prepare(lines: DataFrame, goal: str | None = None, kind: str = "output") -> DataFrame:
    """Row-wise facts of each line, and empty reasons. ``kind``: output, search or diff, or auto: diff where a line of the stream
    begins a file of a diff, else output. ``goal``: a column with the task's goal and constraints, a line each, or none."""
    x = lines.withColumn("t", X.trim_end(F.col("line"))).withColumn("n_bytes", F.octet_length("line").cast("long"))
    x = x.withColumn("fact", C.fact_kind(F.col("line"))).withColumn("blank", X.is_blank(F.col("t")))
    said = X.ascii_lower(F.regexp_replace("t", r"^(?U:\s)+|(?U:\s)+$", ""))
    x = x.withColumn("mentioned", F.coalesce((F.octet_length(said) >= 4) & F.contains(X.ascii_lower(F.col(goal)), said), F.lit(False)) if goal else F.lit(False))
    x = x.withColumn("goal_text", X.ascii_lower(F.col(goal)) if goal else F.lit(None).cast("string"))
    x = x.withColumn("tokens", X.goal_tokens(F.col(goal)) if goal else F.array().cast("array<string>"))
    x = x.withColumn("passed", C.passing_test_name(F.col("t"))).withColumn("prog", C.is_test_progress(F.col("t")))
    of = F.when(F.max(F.col("line").startswith("diff --git a/")).over(whole()), "diff").otherwise("output") if kind == "auto" else F.lit(kind)
    return x.withColumn("kind", of).withColumn("reason", F.lit(None).cast("string"))


def named_by_goal(text: Column) -> Column:
    """Whether the goal holds a text, in lower case."""
    return F.coalesce(F.contains("goal_text", X.ascii_lower(text)), F.lit(False))


def set_reason(x: DataFrame, when: Column, reason: str, *drop: str) -> DataFrame:
    return x.withColumn("reason", F.coalesce("reason", F.when(F.coalesce(when, F.lit(False)), reason))).drop(*drop)


def islands(x: DataFrame, starts: Column, name: str = "island") -> DataFrame:
    """Number the runs of a stream; a row where ``starts`` holds begins one."""
    return x.withColumn(name, F.sum(F.when(F.coalesce(starts, F.lit(True)), 1).otherwise(0)).over(by_line()))


def with_runs(x: DataFrame, of: Column | None = None, **starts: Column) -> DataFrame:
    """For each name ``r`` and ``k`` of the runs that begin where its column holds: lines of the run up to a row, and in all; with ``of``, sums of that in their
    place. Windows in line order alone, so rows aren't sorted by run: totals of a run are the difference of running totals at its start and at the next."""
    n = F.lit(1).cast("long") if of is None else of
    x = x.withColumns({"__so_far": F.sum(n).over(so_far()), "__all": F.sum(n).over(in_all()), **{f"__{k}": F.coalesce(c, F.lit(True)) for k, c in starts.items()}})
    x = x.withColumns({f"__{k}": F.when(F.col(f"__{k}"), F.col("__so_far") - n) for k in starts})
    x = x.withColumns({c: w for k in starts for c, w in ((f"__{k}_first", F.max(f"__{k}").over(so_far())), (f"__{k}_next", next_of(f"__{k}")))})
    first = lambda k: F.coalesce(f"__{k}_first", F.lit(0))
    x = x.withColumns({c: v for k in starts for c, v in ((f"{k}_r", F.col("__so_far") - first(k)), (f"{k}_k", F.coalesce(f"__{k}_next", "__all") - first(k)))})
    return x.drop("__so_far", "__all", *(f"__{k}{end}" for k in starts for end in ("", "_first", "_next")))


def default_path(x: DataFrame) -> Column | None:
    """The path of a search of one file, where lines have it."""
    return F.col("default_path") if "default_path" in x.columns else None


def hit_named(path: Column, content: Column) -> Column:
    """Whether the goal holds the path or the content of a hit."""
    return named_by_goal(path) | named_by_goal(content)


def is_repeatable(x: DataFrame) -> Column:
    """Of a hit ``h``: facts are sought in its content alone; the goal may name the path or the content."""
    content = F.col("h.content")
    return (F.col("stream") == "stdout") & (F.octet_length(content) >= 32) & C.fact_kind(content).isNull() & ~hit_named(F.col("h.path"), content)


def is_quiet(x: DataFrame) -> Column:
    """Whether a line is no fact."""
    return F.col("quiet") if "quiet" in x.columns else F.col("fact").isNull()


def repeats() -> Column:
    """Whether a hit ``h`` has the path and content of the one before, on a later line."""
    w = by_line()
    return F.coalesce((F.lag("h.path").over(w) == F.col("h.path")) & (F.lag("h.content").over(w) == F.col("h.content")) & (F.lag("h.line").over(w) < F.col("h.line")), F.lit(False))


def search_looks(x: DataFrame, goal: bool, parts: bool) -> DataFrame:
    """What the stages of a search look at. Of most lines whether they are facts doesn't matter, so it isn't asked. All that needs the text of a line is said of it first; one pass in line order then compares neighbours and counts the stream, and a second
    finds runs. Beyond it only flags and numbers are sorted. ``plan_error`` is of streams that have a line which is no hit: they are delivered as they are.
    ``parts``: whether stages before ``identical_runs`` may hide a part of a run of equal lines. Repeated hits have rising numbers, so no neighbour of a hidden one is equal to it; of
    equal blanks only the first is left, of passing tests only the first or all; other reasons go by the text."""
    x = x.withColumn("h", X.hit_in(F.col("t"), default_path(x)))
    whole_path = F.col("h").isNotNull() & (F.col("default_path").isNull() if "default_path" in x.columns else F.lit(True))
    one_colon = F.col("h").isNotNull() & ~F.contains("h.content", F.lit(":"))
    x = x.withColumn("code", F.when(whole_path, F.col("h.content")).when(one_colon, F.col("t")).otherwise(X.hit_content(F.col("line")))).withColumn("re", C.has_redraw(F.col("t")))
    said = F.trim(X.ascii_lower(F.col("code")))
    asked = F.coalesce((F.octet_length(said) >= 4) & F.contains(F.col("goal_text"), said), F.lit(False)) if goal else F.lit(False)
    x = x.withColumns({
        "bad": (F.col("stream") == "stdout") & F.col("h").isNull(), "repeatable": F.coalesce(is_repeatable(x), F.lit(False)), "definition": C.is_definition(F.col("code")), "asked_for": asked,
        "chrome": C.is_boilerplate(F.col("t")), "quiet": F.when(F.col("prog") | F.col("re"), C.fact_kind(F.col("line")).isNull()).otherwise(F.lit(True)), "heading": heading(F.col("t")),
    })
    x = x.withColumns({
        "plan_error": F.when(F.max("bad").over(in_all()), UNSUPPORTED), **({"place": F.row_number().over(by_line())} if parts else {}), "n_lines": F.count("*").over(in_all()), "repeat": repeats(), "same": F.col("t") == F.lag("t").over(by_line()),
        **blank_looks(in_all()), **test_looks(in_all()), "n_re": F.count_if("re").over(in_all()),
    })
    return with_runs(x, repeat=~F.col("repeat"), same=~F.col("same")).drop("bad", "repeat", "same")


def repeated_hits(x: DataFrame, p: Params = Params()) -> DataFrame:
    """Rising search hits on stdout of one path with equal long content: all but the first and last two of a run."""
    if "repeat_r" not in x.columns:
        x = x.withColumn("h", X.hit(F.col("line"), default_path(x)))
        x = with_runs(x.withColumns({"repeatable": is_repeatable(x), "repeat": repeats()}), repeat=~F.col("repeat")).drop("h", "repeat")
    r, k = F.col("repeat_r"), F.col("repeat_k")
    return set_reason(x, F.col("repeatable") & (k >= p.repeat_hits) & (r > 2) & (r <= k - 2), REPEATED_HITS, "repeatable", "repeat_r", "repeat_k")


def build_progress(x: DataFrame, p: Params = Params()) -> DataFrame:
    """Runs of build progress: all but the first and last two. Lines of a package that the goal names end a run. Where lines have
    ``command_display`` or ``exit_code``, only successful runs of the build tool count, and of these the error stream."""
    own = C.progress_name(F.col("line")).isNotNull() & ~named_by_goal(C.progress_name(F.col("line")))
    if "command_display" in x.columns:
        own = own & C.is_program(F.col("command_display"), "cargo")
    if "exit_code" in x.columns:
        own = own & F.coalesce(F.col("exit_code") == 0, F.lit(False)) & (F.col("stream") == "stderr")
    x = x.withColumn("own", own)
    x = islands(x, F.col("own") != F.lag("own").over(by_line()))
    x = x.withColumn("r", F.row_number().over(by_line("island"))).withColumn("k", F.count("*").over(whole("island")))
    return set_reason(x, F.col("own") & (F.col("k") >= p.build_run) & (F.col("r") > 2) & (F.col("r") <= F.col("k") - 2), BUILD, "own", "island", "k", "r")


def blank_looks(all_: W) -> dict[str, Column]:
    """Whether the line before is blank, whether all up to a line are, and which is the last that isn't."""
    said = F.when(~F.col("blank"), F.col("line_no"))
    return {"prev_blank": F.coalesce(F.lag("blank").over(by_line()), F.lit(False)), "before": F.max(F.when(F.col("blank"), 0).otherwise(1)).over(so_far()), "all_": F.max(said).over(all_)}


def boilerplate(x: DataFrame, p: Params = Params()) -> DataFrame:
    x = x if "prev_blank" in x.columns else x.withColumns(blank_looks(whole()))
    chrome = F.col("chrome") if "chrome" in x.columns else C.is_boilerplate(F.col("line"))
    edge = (F.col("kind") != "diff") & F.col("blank") & ((F.col("before") == 0) | (F.col("line_no") > F.coalesce("all_", F.lit(-1))))
    return set_reason(x, (F.col("blank") & F.col("prev_blank")) | edge | ((F.col("kind") != "diff") & chrome), BOILERPLATE, "prev_blank", "before", "all_", "chrome")


def runtime_frames(x: DataFrame, p: Params = Params()) -> DataFrame:
    """Frames of the runtime; after a Python frame also the line indented deeper."""
    indent = F.octet_length("t") - F.octet_length(X.trim_start(F.col("t")))
    x = x.withColumn("frame", C.is_runtime_frame(F.col("line"))).withColumn("indent", indent)
    x = x.withColumn("py", F.col("frame") & F.col("fact").isNull() & F.col("reason").isNull() & X.trim_start(F.col("t")).startswith('File "'))
    w = by_line()
    follows = F.coalesce(F.lag("py").over(w), F.lit(False)) & (F.col("indent") > F.lag("indent").over(w)) & ~F.col("frame") & ~X.trim_start(F.col("t")).startswith('File "')
    return set_reason(x.withColumn("follows", follows), (F.col("kind") == "output") & F.col("fact").isNull() & (F.col("frame") | F.col("follows")), FRAMES, "frame", "indent", "py", "follows")


def test_looks(all_: W) -> dict[str, Column]:
    return {"n_pass": F.count("passed").over(all_), "n_prog": F.count_if("prog").over(all_)}


def passing_tests(x: DataFrame, p: Params = Params()) -> DataFrame:
    """Passing tests and runner progress. Tests that the goal names stay; where lines have ``preferred_test``, so do that one and
    the first."""
    x = x if "n_pass" in x.columns else x.withColumns(test_looks(whole()))
    on = (F.col("n_pass") > p.inventory) | ((F.col("n_pass") + F.col("n_prog") > p.inventory) & (F.col("n_prog") > 0))
    x = set_reason(x, on & F.col("prog") & is_quiet(x), PROGRESS_OF_TESTS)
    is_test = on & (F.col("n_pass") > p.inventory) & F.col("passed").isNotNull() & ~named_by_goal(F.col("passed"))
    if "preferred_test" in x.columns:
        x = x.withColumn("nth", F.sum(F.when(F.col("passed").isNotNull() & F.col("reason").isNull(), 1).otherwise(0)).over(by_line()))
        is_test = is_test & (F.col("preferred_test").isNull() | ((F.col("nth") > 1) & (X.ascii_lower(F.col("preferred_test")) != X.ascii_lower(F.col("passed")))))
    return set_reason(x, is_test, TESTS, "n_pass", "n_prog", "nth")


def with_sections(x: DataFrame, head: str = "diff --git ") -> DataFrame:
    """Diff sections: ``section`` from 1 (0 before the first), its path on the old side, empty where the header has none, and the
    row's place in it."""
    x = x.withColumn("section", F.sum(F.when(F.col("line").startswith(head), 1).otherwise(0)).over(by_line()))
    path = F.regexp_extract("t", r"^diff --git a/(.*?) b/", 1)
    x = x.withColumn("path", F.first(path).over(by_line("section").rowsBetween(W.unboundedPreceding, 0)))
    return x.withColumn("place", F.row_number().over(by_line("section")))


def generated_diffs(x: DataFrame, p: Params = Params()) -> DataFrame:
    """Bodies of generated files that the goal doesn't name."""
    x = with_sections(x).withColumn("size", F.count("*").over(whole("section")))
    said = F.regexp_replace("path", r"^(?U:\s)+|(?U:\s)+$", "")
    named = (F.octet_length(said) >= 4) & named_by_goal(said)
    on = (F.col("kind") == "diff") & (F.col("section") > 0) & (F.col("path") != "") & C.is_generated(F.col("path")) & ~named
    return set_reason(x, on & (F.col("size") > 6) & (F.col("place") > 1), GENERATED, "section", "path", "place", "size")


def edit_signatures(x: DataFrame) -> DataFrame:
    """(capture_id, stream, section, first, n, hidden, named, gone, come): identifiers only removed and only added by each section,
    and whether the goal names a part of its header. Lines may have their ``section`` and ``place`` already."""
    ids = lambda c: F.filter(F.split(c, "[^A-Za-z0-9_]+"), lambda w: w.rlike("^[A-Za-z_]"))
    body = F.substring("t", 2, 1 << 30)
    parts = F.filter(F.split(X.ascii_lower(F.col("t")), "[ /]"), lambda w: (F.octet_length(w) >= 4) & w.contains("."))
    named = F.exists(parts, lambda w: F.coalesce(F.contains("goal_text", w), F.lit(False)))
    changed = ~F.col("t").startswith("---") & ~F.col("t").startswith("+++") & F.col("t").rlike("^[-+]")
    x = x if "section" in x.columns else with_sections(x)
    per = x.where("section > 0").groupBy(*KEY, "section").agg(
        F.min("line_no").alias("first"),
        F.count_if(changed).alias("n"),
        F.count_if(F.col("reason").isNotNull()).alias("hidden"),
        F.max(F.when(F.col("place") == 1, named)).alias("named"),
        F.array_distinct(F.flatten(F.collect_list(F.when(changed & F.col("t").startswith("-"), ids(body))))).alias("a"),
        F.array_distinct(F.flatten(F.collect_list(F.when(changed & F.col("t").startswith("+"), ids(body))))).alias("b"),
    )
    out = per.select(*KEY, "section", "first", "n", "hidden", "named", F.array_sort(F.array_except("a", "b")).alias("gone"), F.array_sort(F.array_except("b", "a")).alias("come"))
    return out.where("n >= 4 and (size(gone) > 0 or size(come) > 0)")


def later_edits(x: DataFrame, p: Params = Params()) -> DataFrame:
    """(capture_id, stream, section, later): sections with the edit of an earlier file, where three have it and the goal names none of them."""
    sig = edit_signatures(x.where("kind = 'diff'")).where("hidden = 0 and not coalesce(named, false)").withColumn("sig", F.sha2(F.to_json(F.struct("gone", "come")), 256))
    w = W.partitionBy(*KEY, "sig")
    later = sig.withColumn("files", F.count("*").over(w)).withColumn("nth", F.row_number().over(w.orderBy("first"))).where((F.col("files") >= p.same_edit_files) & (F.col("nth") > 1))
    return later.select(*KEY, "section", F.lit(True).alias("later"))


def same_edits(x: DataFrame, p: Params = Params()) -> DataFrame:
    """Bodies of the sections that a marker row calls ``later``."""
    later = (F.col("kind") == "diff") & F.coalesce(F.max("later").over(whole("section")), F.lit(False))
    return set_reason(x, later & (F.col("place") > 1), SAME_EDIT)


def redraws(x: DataFrame, p: Params = Params()) -> DataFrame:
    if "n_re" not in x.columns:
        x = x.withColumn("re", C.has_redraw(F.col("line")))
        x = x.withColumn("n_re", F.count_if(F.col("re") & ~is_marker(x)).over(whole()))
    return set_reason(x, F.col("re") & (F.col("n_re") >= 2) & is_quiet(x), REDRAW, "re", "n_re")


def identical_runs(x: DataFrame, p: Params = Params()) -> DataFrame:
    """Runs of equal lines, all still visible: all but the first. Where lines have the runs already, with ``place`` the nearest hidden lines on both sides tell whether one is in the run,
    and without it no line of a run is hidden that others follow visibly."""
    if "same_r" in x.columns and "place" not in x.columns:
        return set_reason(x, (F.col("kind") != "diff") & (F.col("same_k") >= p.identical_run) & (F.col("same_r") > 1), IDENTICAL, "same_r", "same_k")
    if "same_r" in x.columns:
        first = F.col("place") - F.col("same_r") + 1
        x = x.withColumn("hid", F.when(F.col("reason").isNotNull(), F.col("place")))
        x = x.withColumns({"last_hid": F.max("hid").over(so_far()), "next_hid": next_of("hid")})
        clear = ~F.coalesce(F.col("last_hid") >= first, F.lit(False)) & ~F.coalesce(F.col("next_hid") < first + F.col("same_k"), F.lit(False))
        return set_reason(x, (F.col("kind") != "diff") & (F.col("same_k") >= p.identical_run) & clear & (F.col("same_r") > 1), IDENTICAL, "same_r", "same_k", "hid", "last_hid", "next_hid")
    x = islands(x, F.col("t") != F.lag("t").over(by_line()))
    w = whole("island")
    x = x.withColumn("r", F.row_number().over(by_line("island"))).withColumn("k", F.count("*").over(w)).withColumn("seen", F.count_if(F.col("reason").isNull()).over(w))
    return set_reason(x, (F.col("kind") != "diff") & (F.col("k") >= p.identical_run) & (F.col("seen") == F.col("k")) & (F.col("r") > 1), IDENTICAL, "island", "k", "seen", "r")


def similar_runs(x: DataFrame, p: Params = Params()) -> DataFrame:
    """Runs of visible lines with one template: all but the first two and the last."""
    x = x.withColumn("tpl", X.template(F.col("line")))
    x = x.withColumn("ok", F.col("reason").isNull() & (F.octet_length("tpl") >= 6) & F.col("fact").isNull() & ~F.col("mentioned"))
    w = by_line()
    x = islands(x, ~F.col("ok") | ~F.coalesce(F.lag("ok").over(w), F.lit(False)) | (F.col("tpl") != F.lag("tpl").over(w)))
    x = x.withColumn("r", F.row_number().over(by_line("island"))).withColumn("k", F.count("*").over(whole("island")))
    return set_reason(x, (F.col("kind") == "output") & F.col("ok") & (F.col("k") >= p.similar_run) & (F.col("r") > 2) & (F.col("r") < F.col("k")), SIMILAR, "tpl", "ok", "island", "k", "r")


def _stretches(c: str, width: int) -> Column:
    """Distinct stretches of so many characters; a shorter text is one."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - width + 1, F.lit(1))), lambda i: F.substring(F.col(c), i, F.lit(width))))


def with_recap_flags(x: DataFrame) -> DataFrame:
    """Of test output: ``said``, ``long_`` (a visible line long enough to be a recap), ``is_fact`` and ``is_echo`` (one without spaces)."""
    x = x.withColumn("said", F.regexp_replace("t", r"^(?U:\s)+|(?U:\s)+$", ""))
    x = x.withColumn("any", F.count_if(F.col("passed").isNotNull() | F.col("prog")).over(whole()))
    x = x.withColumn("shown", F.col("reason").isNull() & (F.col("any") > 0) & (F.col("kind") == "output")).drop("any")
    structural = F.col("said").endswith(":") | F.col("said").startswith('File "') | F.col("said").startswith("at ")
    x = x.withColumn("long_", F.col("shown") & (F.octet_length("said") >= 8) & ~structural)
    return x.withColumn("is_fact", F.col("shown") & F.col("fact").isNotNull()).withColumn("is_echo", F.col("long_") & ~F.col("said").rlike(r"(?U)\s"))


def echoes(x: DataFrame) -> DataFrame:
    """(capture_id, stream, said, since): texts with ``is_echo`` that a line with ``is_fact`` holds, and the first such line.

    A text without spaces lies within one word of the line, so it is held against words, and not against all but against those with
    its rarest stretch of eight characters. Texts of eight bytes or more but fewer characters go by stretches of two, of which one isn't
    ASCII. Long words are cut into pieces that overlap, and also held whole against texts that are longer than the overlap. One
    shuffle, by capture; what follows groups within it."""
    pieces = lambda w: F.transform(F.sequence(F.lit(1), F.length(w), F.lit(LONG_WORD)), lambda i: F.substring(w, i, F.lit(2 * LONG_WORD)))
    item = lambda kind, words: F.transform(words, lambda w: F.struct(F.lit(kind).alias("kind"), w.alias("word")))
    words = F.filter(F.split("said", r"(?U)\s+"), lambda w: F.octet_length(w) >= 8)
    whole_, cut = F.filter(words, lambda w: F.length(w) > LONG_WORD), F.flatten(F.transform(words, lambda w: F.when(F.length(w) > LONG_WORD, pieces(w)).otherwise(F.array(w))))
    of_facts, none = F.concat(item("fact", cut), item("long fact", whole_)), F.expr("cast(array() as array<struct<kind: string, word: string>>)")
    items = F.concat(F.when(F.col("is_fact"), of_facts).otherwise(none), F.when(F.col("is_echo"), item("echo", F.array("said"))).otherwise(none))
    found = x.where("is_fact or is_echo").select(*KEY, "line_no", items.alias("items"))
    found = dealt(found, x)
    each = found.select(*KEY, "line_no", F.explode("items").alias("x")).groupBy(*KEY, "x.kind", "x.word").agg(F.min("line_no").alias("first"))

    pairs = F.filter(_stretches("word", 2), lambda g: g.rlike(r"[^\x00-\x7F]"))
    longest = (F.col("kind") == "long fact") | ((F.col("kind") == "echo") & (F.length("word") > LONG_WORD))
    grams = F.when(longest, F.array(F.lit(""))).when(F.col("kind") == "fact", F.array_union(_stretches("word", 8), pairs)).otherwise(F.when(F.length("word") >= 8, _stretches("word", 8)).otherwise(pairs))
    held = each.withColumn("gram", F.explode(grams)).withColumn("times", F.count_if(F.col("kind") != "echo").over(W.partitionBy(*KEY, "gram")))
    held = held.withColumn("nth", F.row_number().over(W.partitionBy(*KEY, "kind", "word").orderBy("times", "gram"))).where("kind <> 'echo' or (nth = 1 and times > 0)")
    met = held.groupBy(*KEY, "gram").agg(F.collect_list(F.when(F.col("kind") != "echo", F.struct("word", "first"))).alias("facts"), F.collect_list(F.when(F.col("kind") == "echo", F.col("word"))).alias("asked"))
    asked = met.where("size(facts) > 0").select(*KEY, "facts", F.explode("asked").alias("said"))
    since = F.array_min(F.transform(F.filter("facts", lambda f: F.contains(f["word"], F.col("said"))), lambda f: f["first"]))
    return asked.select(*KEY, "said", since.alias("since")).where("since is not null")


def recaps(x: DataFrame, p: Params = Params()) -> DataFrame:
    """In test output: a long enough visible line seen before, or one without spaces that an earlier visible fact line holds, as
    a marker row with ``since`` says."""
    x = x.withColumn("seen", F.row_number().over(W.partitionBy(*KEY, "said", "shown").orderBy("line_no"))).withColumn("since", F.min("since").over(whole("said")))
    return set_reason(x, F.col("long_") & ((F.col("seen") > 1) | F.coalesce(F.col("is_echo") & (F.col("since") < F.col("line_no")), F.lit(False))), DUPLICATE, "said", "shown", "seen", "long_", "since", "is_fact", "is_echo")


def rare_lines(x: DataFrame) -> DataFrame:
    """``rare``: visible lines of a shape that at most two have, unless too many are."""
    x = x.withColumn("vis", F.col("reason").isNull()).withColumn("shape", X.shape(F.col("line")))
    x = x.withColumn("like", F.count("*").over(whole("shape", "vis")))
    x = x.withColumn("rare", F.col("vis") & (F.col("shape") != "") & (F.col("like") <= 2) & (F.octet_length(F.regexp_replace("t", r"^(?U:\s)+|(?U:\s)+$", "")) >= 12))
    n, seen = F.count_if("rare").over(whole()), F.count_if("vis").over(whole())
    return x.withColumn("rare", F.col("rare") & (n <= 40) & (n * 20 <= seen)).drop("vis", "shape", "like")


def held_tokens(line: Column) -> Column:
    """Tokens of the goal that a line holds."""
    return _in_lower(line, lambda low: F.filter("tokens", lambda k: F.contains(low, k)))


def telling_tokens(x: DataFrame) -> DataFrame:
    """(capture_id, stream, telling): goal tokens that aren't too frequent: lines / 50 of the lines have them at most, within 8 and 40. Tokens
    found are counted where lines are, and only counts are shuffled."""
    found = F.concat(F.array(F.lit("")), held_tokens(F.col("line")))  # the empty one counts all lines
    counts = x.select(*KEY, F.explode(found).alias("token")).groupBy(*KEY, "token").agg(F.count("*").alias("n"))
    per = counts.groupBy(*KEY).agg(F.max(F.when(F.col("token") == "", F.col("n"))).alias("lines"), F.collect_list(F.when(F.col("token") != "", F.struct("token", "n"))).alias("found"))
    limit = F.least(F.greatest(F.expr("lines div 50"), F.lit(8)), F.lit(40))
    return per.select(*KEY, F.transform(F.filter("found", lambda f: f["n"] <= limit), lambda f: f["token"]).alias("telling")).where("size(telling) > 0")


def _in_lower(c: Column, ask: Callable[[Column], Column]) -> Column:
    """``ask`` of a text in lower case, which is computed once: as a part of a lambda it would be computed for each of its items."""
    return F.get(F.transform(F.array(X.ascii_lower(c)), ask), F.lit(0))


def told_in_place(x: DataFrame) -> DataFrame:
    """``told`` without a second look at the lines, where they have ``n_lines``: a line is a row for each token of the goal that it holds, tokens are counted by stream, and the
    first of a line's rows stays. Telling tokens are those of ``telling_tokens``."""
    x = x.select(*(c for c in x.columns if c != "held"), F.posexplode_outer("held").alias("nth_held", "token"))
    often = F.count("*").over(whole("token"))
    x = x.withColumn("telling", F.col("token").isNotNull() & (often <= F.least(F.greatest(F.expr("n_lines div 50"), F.lit(8)), F.lit(40))))
    same_line = by_line().rangeBetween(W.currentRow, W.currentRow)  # a stream is one partition; one for each line would cost more than what it holds
    return x.withColumn("told", F.max("telling").over(same_line)).where("coalesce(nth_held, 0) = 0").drop("nth_held", "token", "telling")


def with_told(x: DataFrame) -> DataFrame:
    """``told``: whether a line has a telling token of the goal, in place of the tokens of its stream, which needn't go further."""
    if "telling" not in x.columns:
        return x.withColumn("told", F.lit(False))
    held = _in_lower(F.col("line"), lambda low: F.exists("telling", lambda k: F.contains(low, k)))
    return x.withColumn("told", F.col("telling").isNotNull() & F.coalesce(held, F.lit(False))).drop("telling")


def long_output(x: DataFrame, p: Params = Params()) -> DataFrame:
    """Beyond the thresholds: head, tail, facts with context, goal lines and rare lines stay."""
    x = rare_lines(x if "told" in x.columns else with_told(x))
    x = x.withColumn("vis", F.col("reason").isNull())
    x = x.withColumn("n_vis", F.count_if("vis").over(whole())).withColumn("b_vis", F.sum(F.when(F.col("vis"), F.col("n_bytes")).otherwise(0)).over(whole()))
    x = x.withColumn("nth", F.sum(F.when(F.col("vis"), 1).otherwise(0)).over(by_line()))
    seen = F.col("vis") & F.col("fact").isNotNull()
    heavy = seen & F.col("fact").isin("failure_identity", "assertion")
    light = seen & ~heavy
    x = x.withColumn("heavy", F.when(heavy, 1).otherwise(0)).withColumn("light", F.when(light, 1).otherwise(0))
    near = (F.max("heavy").over(by_line().rowsBetween(-p.after, p.before)) == 1) | (F.max("light").over(by_line().rowsBetween(-1, 0)) == 1)
    x = x.withColumn("near", near)
    keep = (F.col("nth") <= p.long_head) | (F.col("nth") > F.col("n_vis") - p.long_tail) | F.col("near") | F.col("mentioned") | F.col("told") | F.col("rare")
    on = (F.col("kind") == "output") & (F.col("n_vis") >= p.long_lines) & (F.col("b_vis") >= p.long_bytes)
    return set_reason(x, on & F.col("vis") & ~keep, MIDDLE, "rare", "told", "vis", "n_vis", "b_vis", "nth", "heavy", "light", "near")


def search_head(x: DataFrame, p: Params = Params()) -> DataFrame:
    """Long search output: the head, definitions if they stand out, and goal lines stay."""
    x = x if "told" in x.columns else with_told(x)
    x = x.withColumn("vis", F.col("reason").isNull())
    if "definition" not in x.columns:
        said = F.trim(X.ascii_lower(X.hit_content(F.col("line"))))
        x = x.withColumn("definition", C.is_definition(X.hit_content(F.col("line")))).withColumn("asked_for", F.coalesce((F.octet_length(said) >= 4) & F.contains(F.col("goal_text"), said), F.lit(False)))
    x = x.withColumn("def", F.col("vis") & F.col("definition"))
    x = x.withColumns({"n_vis": F.count_if("vis").over(in_all()), "b_vis": F.sum(F.when(F.col("vis"), F.col("n_bytes")).otherwise(0)).over(in_all()), "n_def": F.count_if("def").over(in_all()), "nth": F.count_if("vis").over(so_far())})
    keep = (F.col("nth") <= p.search_head) | (F.col("def") & (F.col("n_def") * 3 <= F.col("n_vis"))) | F.col("told") | F.col("asked_for")
    on = (F.col("kind") == "search") & ((F.col("n_vis") >= p.search_lines) | (F.col("b_vis") >= p.search_bytes))
    return set_reason(x, on & F.col("vis") & ~keep, MORE_HITS, "told", "vis", "def", "n_vis", "b_vis", "n_def", "nth", "definition", "asked_for")


def heading(t: Column) -> Column:
    """The trimmed text of a line that ends with a colon; null of others. The last character tells most others."""
    last = F.substring(t, -1, 1)
    said = F.regexp_replace(t, r"^(?U:\s)+|(?U:\s)+$", "")
    return F.when((last == ":") | ~last.between("!", "~"), F.when(t.rlike(r":(?U:\s)*+\z"), said))


def tidy(x: DataFrame, p: Params = Params()) -> DataFrame:
    """Visible blanks next to hidden lines go, and repeated headers with nothing visible below."""
    w = by_line()
    beside = F.coalesce(F.lag("reason").over(w).isNotNull() & (F.lag("line_no").over(w).isNotNull()), F.lit(False)) | F.coalesce(F.lead("reason").over(w).isNotNull(), F.lit(False))
    x = x.withColumn("shown", F.when(~F.col("blank"), F.when(F.col("reason").isNull(), 1).otherwise(0)))  # blanks beside don't matter to it
    x = x.withColumns({"beside": beside, "below": next_of("shown")})
    x = set_reason(x, (F.col("kind") != "diff") & F.col("blank") & F.col("beside"), BOILERPLATE, "beside", "shown")
    x = x if "heading" in x.columns else x.withColumn("heading", heading(F.col("t")))
    x = x.withColumn("vis", F.col("reason").isNull())
    x = x.withColumn("seen", F.row_number().over(W.partitionBy(*KEY, "heading", "vis").orderBy("line_no")))
    return set_reason(x, (F.col("kind") != "diff") & F.col("vis") & F.col("heading").isNotNull() & (F.col("seen") > 1) & (F.coalesce("below", F.lit(0)) == 0), DUPLICATE, "vis", "heading", "seen", "below")


def with_selection(x: DataFrame, ranges: DataFrame, like: DataFrame | None = None) -> DataFrame:
    """``chosen``: whether a line lies in a selected byte range (capture_id, stream, start, end) of its stream, and ``asked``: whether its stream
    has any range. Ranges and lines are one stream in the order of their first bytes; a line lies in a range if the largest end of those begun so
    far isn't before its own. Of ranges with one start only the farthest counts, so a capture meets no more of them than it has bytes. ``like``: what has about as many rows as
    ``x`` and is cheaper to count."""
    r = ranges.groupBy("capture_id", "stream", F.col("start").cast("long").alias("byte_start")).agg(F.max(F.col("end").cast("long")).alias("__end")).withColumn("__range", F.lit(True))
    both = x.withColumn("__end", F.lit(None).cast("long")).withColumn("__range", F.lit(False)).unionByName(r, allowMissingColumns=True)
    both = dealt(both, x if like is None else like)
    begun = W.partitionBy(*KEY).orderBy("byte_start", F.desc("__range")).rowsBetween(W.unboundedPreceding, 0)
    both = both.withColumn("chosen", F.coalesce(F.max("__end").over(begun) >= F.col("byte_end"), F.lit(False))).withColumn("asked", F.max("__range").over(whole()))
    return both.where("not __range").drop("__end", "__range")


def adaptive_search(x: DataFrame, ranges: DataFrame, like: DataFrame | None = None) -> DataFrame:
    """Search hits on stdout outside the selected ranges go, but for definitions and what the goal names."""
    x = with_selection(x, ranges, like)
    x = x if "h" in x.columns else x.withColumn("h", X.hit(F.col("line"), default_path(x)))
    stays = F.col("chosen") | hit_named(F.col("h.path"), F.col("h.content")) | C.is_definition(F.col("h.content"))
    return set_reason(x, (F.col("stream") == "stdout") & ~stays, ADAPTIVE_SEARCH, "h", "chosen", "asked")


def adaptive_merge(x: DataFrame, ranges: DataFrame, like: DataFrame | None = None) -> DataFrame:
    """Selected chunks of long output are shown again. In diffs, a file with a selected line shows its generated body; where ranges were given, others lose
    theirs, also if no line lies whole in any range."""
    out = with_selection(x, ranges, like)
    out = out.withColumn("reason", F.when((F.col("kind") != "diff") & (F.col("reason") == MIDDLE) & F.col("chosen"), None).otherwise(F.col("reason")))
    out = with_sections(out, "diff --git a/").withColumn("picked", F.max("chosen").over(whole("section")))
    diff = (F.col("kind") == "diff") & (F.col("section") > 0)
    out = out.withColumn("reason", F.when(diff & F.col("picked") & (F.col("reason") == GENERATED), None).otherwise(F.col("reason")))
    return set_reason(out, diff & ~F.col("picked") & F.col("asked") & (F.col("place") > 1), ADAPTIVE, "section", "path", "place", "picked", "asked", "chosen")


def tiny_gaps(x: DataFrame, p: Params = Params()) -> DataFrame:
    """Hidden runs of fewer bytes than a marker costs become visible again; silent reasons stay hidden."""
    group = F.when(F.col("reason") == PROGRESS_OF_TESTS, TESTS).otherwise(F.col("reason"))
    x = x.withColumn("g", F.coalesce(group, F.lit("")))
    x = with_runs(x, F.col("n_bytes"), gap=F.col("g") != F.lag("g").over(by_line()))
    loud = ~F.coalesce(F.col("reason").isin(*SILENT), F.lit(True))
    return x.withColumn("reason", F.when(loud & (F.col("gap_k") < p.tiny_gap), None).otherwise(F.col("reason"))).drop("g", "gap_r", "gap_k")


#: columns of ``search_looks`` that more than one stage reads
SEARCH_LOOKS = ("quiet", "place", "n_lines", "code", "h", "repeatable", "repeat_r", "repeat_k")
Stage = Callable[[DataFrame, Params], DataFrame]
#: in order, with the kinds of material each is for; the second list follows the cut
BEFORE: list[tuple[Stage, tuple[str, ...]]] = [
    (repeated_hits, ("search",)),
    (build_progress, ("output", "search", "diff")),
    (boilerplate, ("output", "search", "diff")),
    (runtime_frames, ("output",)),
    (passing_tests, ("output", "search", "diff")),
    (generated_diffs, ("diff",)),
]
AFTER: list[tuple[Stage, tuple[str, ...]]] = [
    (long_output, ("output",)),
    (search_head, ("search",)),
    (tidy, ("output", "search")),
]


def is_marker(x: DataFrame) -> Column:
    return F.col("marker") if "marker" in x.columns else F.lit(False)


def with_findings(x: DataFrame, kinds: tuple[str, ...], goal: bool, p: Params) -> DataFrame:
    """The lines of a written table with marker rows of what a second look at them finds: later sections, echoes and telling tokens."""
    found = [later_edits(x, p)] if "diff" in kinds else []
    found += [echoes(x)] if "output" in kinds else []
    found += [telling_tokens(x)] if goal else []
    out = x.withColumn("marker", F.lit(False))
    for f in found:
        out = out.unionByName(f.withColumn("marker", F.lit(True)), allowMissingColumns=True)
    return dealt(out, x)


def plan(lines: DataFrame, kind: str = "output", goal: str | None = None, p: Params = Params(), ranges: DataFrame | None = None) -> DataFrame:
    """Lines with their reasons; null is visible. ``ranges``: what a ranker selected (capture_id, stream, start, end); search hits
    outside go and long output and diffs are merged with it. Build progress is sought where lines name their command. Lines of a search of one file have
    its ``default_path``. Of a search whose output has other lines than hits nothing is hidden, and ``plan_error`` says so."""
    kinds = ("output", "diff") if kind == "auto" else (kind,)
    fits = lambda of: bool(set(kinds) & set(of))
    x = prepare(lines, goal, kind)
    if kind == "search":
        x = x.withColumn("held", held_tokens(F.col("line"))) if goal else x
        x = search_looks(x, goal is not None, ranges is not None or "command_display" in x.columns)
    else:
        x = x.withColumn("plan_error", F.lit(None).cast("string"))
    for stage, of in BEFORE:
        if not fits(of) or (stage is build_progress and "command_display" not in x.columns):
            continue
        if stage is generated_diffs:  # sections stay: equal edits are sought in them
            x = with_sections(generated_diffs(x, p))
        else:
            x = adaptive_search(x, ranges, lines) if stage is repeated_hits and ranges is not None else stage(x, p)
    # the look at edits counts reasons so far; runs and redraws below come after it in diffs, and don't concern it in other output
    x = x if kinds == ("diff",) else runs_and_redraws(x, kinds, p)
    x = with_recap_flags(x) if "output" in kinds else x
    written = None
    if kind != "search":
        written = materialize(x, "plan")
        x = with_findings(written, kinds, goal is not None, p)
        if goal:
            x = with_told(x.withColumn("telling", F.max("telling").over(whole())))
    if "diff" in kinds:
        x = set_redraws_of_diffs(same_edits(x, p), p).drop("section", "path", "place", "later")
    if "output" in kinds:
        x = recaps(x, p)
    if "marker" in x.columns:
        x = x.where("not marker")
    x = told_in_place(x) if kind == "search" and goal else x
    for stage, of in AFTER:
        x = stage(x, p) if fits(of) else x
    x = adaptive_merge(x, ranges, written) if ranges is not None and kind != "search" else x
    x = x.withColumn("reason", F.when(F.col("plan_error").isNull(), F.col("reason")))
    return x.drop("marker", "told", *SEARCH_LOOKS)


def runs_and_redraws(x: DataFrame, kinds: tuple[str, ...], p: Params) -> DataFrame:
    """Redraws, equal lines and lines of one template, but for diffs."""
    before = x.withColumn("__diff", F.col("kind") == "diff").withColumn("__reason", F.col("reason"))
    y = identical_runs(redraws(before, p), p)
    y = similar_runs(y, p) if "output" in kinds else y
    return y.withColumn("reason", F.when(F.col("__diff"), F.col("__reason")).otherwise(F.col("reason"))).drop("__diff", "__reason")


def set_redraws_of_diffs(x: DataFrame, p: Params) -> DataFrame:
    """Redraws of diffs, which come after equal edits."""
    y = redraws(x.withColumn("__reason", F.col("reason")), p)
    return y.withColumn("reason", F.when(F.col("kind") == "diff", F.col("reason")).otherwise(F.col("__reason"))).drop("__reason")
