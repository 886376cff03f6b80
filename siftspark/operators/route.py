"""Commands and hook events: what a command is, whether its output is worth reducing, and whether a query may leave the machine."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftspark.functions.classify import contains_secret
from siftspark.functions.text import ascii_lower

#: fixed values: first words after which a program's output is reduced; empty means any
ROUTES: dict[str, str] = {
    "cargo": "test build check clippy nextest doc t b c", "go": "test build vet", "pytest": "", "jest": "", "vitest": "", "tsc": "", "eslint": "", "ruff": "", "mypy": "", "pyright": "", "mocha": "", "rspec": "", "phpunit": "",
    "rg": "", "make": "", "ninja": "", "ctest": "", "npx": "jest vitest tsc eslint mocha", "bunx": "jest vitest tsc eslint mocha", "git": "log diff show blame", "dotnet": "test build", "mix": "test compile", "docker": "build",
    "kubectl": "logs describe", "terraform": "plan", "tofu": "plan",
}
PACKAGE_MANAGERS, PACKAGE_WORDS = ("npm", "pnpm", "yarn", "bun"), "test t install i ci build lint typecheck tsc".split()
TOOLS = "jest vitest tsc eslint mocha".split()
BUILD_TOOLS, GOALS = ("gradle", "gradlew", "mvn", "mvnw"), "test build check verify compile package assemble".split()
LONG_RUNNING = ("dev", "start", "serve", "watch", "preview")
_REFUSED = set("|;><`(){}\n\r")


def split_command(command: str) -> list[list[str]] | None:
    """Words of the segments that ``&&`` joins, quotes and escapes resolved; null for any other shell syntax."""
    segments: list[list[str]] = [[]]
    word: list[str] | None = None
    chars = iter(enumerate(command))
    for i, c in chars:
        after = command[i + 1 : i + 2]
        if c in " \t":
            if word is not None:
                segments[-1].append("".join(word))
                word = None
        elif c == "&":
            if after != "&":
                return None
            next(chars)
            if word is not None:
                segments[-1].append("".join(word))
                word = None
            if not segments[-1]:
                return None
            segments.append([])
        elif c in _REFUSED or (c == "$" and after == "("):
            return None
        elif c == "\\":
            if not after:
                return None
            word = (word or []) + [after]
            next(chars)
        elif c in "'\"":
            end = i + 1
            while end < len(command) and command[end] != c:
                if c == '"' and (command[end] == "`" or command[end : end + 2] == "$("):
                    return None
                end += 2 if c == '"' and command[end] == "\\" else 1
            if end >= len(command):
                return None
            word = (word or []) + [command[i + 1 : end]]
            for _ in range(end - i):
                next(chars)
        else:
            word = (word or []) + [c]
    if word is not None:
        segments[-1].append("".join(word))
    return segments if all(segments) else None


def with_segments(commands: DataFrame, column: str = "command") -> DataFrame:
    """``segments``: array of word arrays, or null. A scanner with state, so the one place of the engine's batch side that runs
    Python: Arrow batches, no shuffle."""
    names = commands.columns
    schema = T.StructType([*commands.schema.fields, T.StructField("segments", T.ArrayType(T.ArrayType(T.StringType())))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            x["segments"] = [None if c is None else split_command(c) for c in x[column]]
            yield x[[*names, "segments"]]

    return commands.mapInPandas(run, schema)


def program_name(word: Column) -> Column:
    return F.regexp_replace(ascii_lower(F.regexp_replace(word, r"^.*[/\\]", "")), r"\.(exe|cmd|bat)$", "")


def is_assignment(word: Column) -> Column:
    return word.rlike("^[A-Za-z_][A-Za-z0-9_]*=")


def eligible(program: Column, args: Column) -> Column:
    """Whether a program with its arguments prints what reduction is for."""
    args = F.when((program == "cargo") & F.coalesce(F.get(args, F.lit(0)).startswith("+"), F.lit(False)), F.slice(args, 2, 1 << 20)).otherwise(args)
    first, second = F.coalesce(F.get(args, F.lit(0)), F.lit("")), F.coalesce(F.get(args, F.lit(1)), F.lit(""))
    out = F.lit(False)
    for name, words in ROUTES.items():
        out = F.when(program == name, first.isin(words.split()) if words else F.lit(True)).otherwise(out)
    scripts = ~F.lit(False)
    for s in LONG_RUNNING:
        scripts = scripts & ~second.startswith(s)
    modules = F.exists(F.arrays_zip(F.slice(args, F.lit(1), F.greatest(F.size(args) - 1, F.lit(0))).alias("a"), F.slice(args, F.lit(2), F.greatest(F.size(args) - 1, F.lit(0))).alias("b")), lambda p: (p["a"] == "-m") & p["b"].isin("pytest", "unittest", "mypy", "ruff"))
    manager = F.when(first.isin(PACKAGE_WORDS), True).when(first == "run", (second != "") & scripts).when(first.isin("exec", "dlx", "x"), second.isin(TOOLS)).otherwise(False)
    return (
        F.when(program.isin("python", "python3", "py"), modules)
        .when(program == "node", F.array_contains(args, "--test"))
        .when(program.isin(*PACKAGE_MANAGERS), manager)
        .when(program == "grep", F.exists(args, lambda a: a.rlike("^-(?!-).*[rR]")))
        .when(program == "cmake", F.array_contains(args, "--build"))
        .when(program.isin(*BUILD_TOOLS), F.exists(args, lambda a: a.isin(GOALS)))
        .when(program == "bundle", (first == "exec") & second.isin("rspec", "rake"))
        .otherwise(out)
    )


def valid_session(c: Column) -> Column:
    return F.coalesce(c.rlike("^[A-Za-z0-9_-]{1,128}$"), F.lit(False))


def query_privacy(argv: Column) -> Column:
    """Null where a search may be ranked remotely, else why not: the command, its query or a target."""
    name = ascii_lower(F.regexp_replace(F.get(argv, F.lit(0)), r"^.*/", ""))
    form = name.isin("rg", "rg.exe") & (F.size(argv) >= 4) & F.get(argv, F.lit(1)).isin("-n", "--line-number") & F.get(argv, F.lit(2)).isin("-H", "--with-filename")
    q = F.trim(F.get(argv, F.lit(3)))
    denied = (q == "") | q.startswith("-") | (F.length(q) > 240) | q.rlike(r"[^\x00-\x7F]") | contains_secret(q)
    outside = F.exists(F.slice(argv, 5, 1 << 20), lambda t: ~t.isin("--sort=path", "--sort-files") & t.rlike(r"^[-\\/]|^.:|(^|[/\\])\.\.($|[/\\])"))
    return F.when(~F.coalesce(form, F.lit(False)), "unsupported_search_command").when(denied, "privacy_denied_query").when(outside, "privacy_denied_search_target")


def tool_output(events: DataFrame) -> DataFrame:
    """Hook events (session_id, tool, output) whose output may be replaced: text that isn't cut off, and within 512 KiB."""
    cut = F.lower("output").rlike("output truncated|truncated output|output too large")
    return events.withColumn("skip", F.when(F.col("output").isNull(), "no_output").when(~valid_session(F.col("session_id")), "invalid_session").when(F.octet_length("output") > 512 * 1024, "too_large").when(cut, "truncated"))


def build_verifier(command: Column) -> Column:
    """A test, check or build command of the build tool with none but harmless flags, its spaces made single; null for any other."""
    flag = r"(--workspace|--all-targets|--locked|--offline|--lib|--doc|--quiet|-q|(-p|--package)[ \t\f]+[A-Za-z0-9_.-]+)"
    fine = (F.octet_length(command) <= 512) & command.rlike(rf"^[ \t\f]*cargo[ \t\f]+(test|check|build)([ \t\f]+{flag})*[ \t\f]*\z")
    return F.when(fine, F.trim(F.regexp_replace(command, r"[ \t\f]+", " ")))


def bounded(chunks: DataFrame, limit: int) -> DataFrame:
    """Chunks (run_id, seq, n_bytes) of a run's output against the bytes that may be held: ``kept`` while they all fit; the chunk that
    doesn't fit makes those before it ``flushed``, and it and all after it ``forwarded``."""
    run = W.partitionBy("run_id")
    x = chunks.withColumn("held", F.sum("n_bytes").over(run.orderBy("seq")))
    over = F.col("held") > limit
    first = F.max("held").over(run) > limit
    return x.withColumn("fate", F.when(over, "forwarded").when(first, "flushed").otherwise("kept")).drop("held")
