"""Line and token expressions: Column to Column, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: words that say nothing about a goal; fixed values
GOAL_STOPWORDS = (
    "about after again also because before being between build check code could does each file files find first from have into "
    "make more need only other please should some sure than that their them then there these they this those through under until "
    "using what when where which while will with without would your fails failing failure error errors test tests warning change "
    "changes update work works working look issue problem run running output result results just like want fail failed around"
).split()


def ascii_lower(c: Column) -> Column:
    """In lower case, but for letters that aren't ASCII. A text of as many bytes as characters has none, and lowering it whole is the faster way."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def trim_end(c: Column) -> Column:
    """Without the carriage returns and line feeds at the end."""
    return F.when(c.endswith("\n") | c.endswith("\r"), F.rtrim(c, F.lit("\r\n"))).otherwise(c)


def is_blank(c: Column) -> Column:
    """Whether there is nothing but white space. The first character tells most that there is more."""
    return F.when(F.substring(c, 1, 1).between("!", "~"), F.lit(False)).otherwise(~c.rlike(r"(?U)\S"))


def trim_start(c: Column) -> Column:
    return F.regexp_replace(c, r"^(?U:\s)+", "")


def explode_lines(captures: DataFrame, text: str = "text") -> DataFrame:
    """A row for each line, terminator included: ``line_no`` from 0, ``byte_start`` and ``byte_end``. A last line
    without a terminator counts; nothing follows a last terminator. The other columns stay. No shuffle: offsets are
    running sums inside the row's own array, over blocks of lines and then inside each, since a running sum copies its array
    at each step."""
    rest = [c for c in captures.columns if c != text]
    block = 512
    parts = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"([^\n]*\n|[^\n]+)"), F.lit(1))
    starts = lambda sizes: F.slice(F.aggregate(sizes, F.array(F.lit(0).cast("long")), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n))), F.lit(1), F.size(sizes))
    x = captures.withColumn("__parts", parts).withColumn("__sizes", F.transform("__parts", lambda p: F.octet_length(p).cast("long")))
    at = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size("__parts") - 1) / block).cast("int")))
    x = x.withColumn("__blocks", F.transform(at, lambda i: F.slice("__sizes", i * block + 1, F.lit(block))))
    x = x.withColumn("__firsts", starts(F.transform("__blocks", lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda acc, n: acc + n))))
    x = x.withColumn("__starts", F.flatten(F.transform(F.arrays_zip("__blocks", "__firsts"), lambda z: F.transform(starts(z["__blocks"]), lambda s: s + z["__firsts"]))))
    lines = x.select(*rest, F.posexplode(F.arrays_zip(F.col("__parts").alias("p"), F.col("__starts").alias("s"))).alias("line_no", "__x"))
    return lines.select(*rest, F.col("line_no").cast("long").alias("line_no"), F.col("__x.s").alias("byte_start"), (F.col("__x.s") + F.octet_length("__x.p")).alias("byte_end"), F.col("__x.p").alias("line"))


def template(c: Column) -> Column:
    """Runs of digits, and hexadecimal tokens of seven or more with a digit, as ``#``. One pattern, as a lambda over tokens is not compiled."""
    return F.regexp_replace(trim_end(c), r"(?<![0-9A-Za-z])(?=[0-9A-Fa-f]*[0-9])[0-9A-Fa-f]{7,}+(?![0-9A-Za-z])|[0-9]+", "#")


def shape(c: Column) -> Column:
    """The first three words of the template that have a letter, each without ``:,;`` at its end, each with a space."""
    words = F.filter(F.split(template(c), r"(?U)\s+"), lambda w: w.rlike(r"\p{IsAlphabetic}"))
    return F.array_join(F.transform(F.slice(words, 1, 3), lambda w: F.concat(F.regexp_replace(w, "[:,;]+$", ""), F.lit(" "))), "")


def goal_tokens(c: Column) -> Column:
    """Distinct telling tokens of a goal, in order: identifiers and paths of four bytes or more that aren't stopwords. One pattern without lambdas,
    so tokens of a fixed goal are a literal, and no row carries them."""
    words = F.regexp_extract_all(ascii_lower(F.coalesce(c, F.lit(""))), F.lit(r"([a-z0-9_][a-z0-9_:./-]{2,}[a-z0-9_])"), F.lit(1))
    return F.array_except(words, F.array(*map(F.lit, GOAL_STOPWORDS)))


def ranker_tokens(c: Column) -> Column:
    """Words of a goal for ranking, repeats kept."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"[^\p{IsAlphabetic}\p{IsDigit}_]+"), F.lower), lambda w: F.octet_length(w) >= 4)


#: what a line's number is; fixed value
NUMBER = r"^0*[1-9][0-9]{0,17}\z"


def hit(c: Column, default_path: str | Column | None = None) -> Column:
    """``path:line:content`` as a struct (path, line, content); null where the line has an escape, no numeric part between
    colons or more than one. A Windows drive may lead the path. ``default_path``, a text or a column, is the path of ``line:content``; where it is null or
    empty such a line is no hit."""
    return hit_in(trim_end(c), default_path)


def hit_in(t: Column, default_path: str | Column | None = None) -> Column:
    """``hit`` of a line without its end. Lines are cut at their first two colons; only those that begin with a drive need patterns."""
    parts = F.split(t, ":", 3)
    head, number, rest = (F.get(parts, F.lit(i)) for i in range(3))
    one = lambda content: ~content.contains(":") | ~F.concat(F.lit(":"), content).rlike(":[0-9]+:")
    made = lambda path, line, content: F.struct(path.alias("path"), line.cast("long").alias("line"), content.alias("content"))
    fine = ~t.contains("\x1b") & (head != "") & (rest != "") & number.rlike(NUMBER) & one(rest)
    path, line, content = (F.regexp_extract(t, r"(?s)^([A-Za-z]:[\\/][^:]*):([0-9]+):(.*)$", i) for i in (1, 2, 3))
    drive = (F.length(head) == 1) & F.substring(number, 1, 1).isin("\\", "/") & ~t.contains("\x1b")
    found = F.when(fine, made(head, number, rest)).when(drive & (path != "") & (content != "") & line.rlike(NUMBER) & one(content), made(path, line, content))
    if default_path is None:
        return found
    of, rest = F.lit(default_path) if isinstance(default_path, str) else default_path, F.substring(t, F.length(head) + 2, F.lit(1 << 30))
    return F.coalesce(found, F.when((of != "") & ~t.contains("\x1b") & head.rlike(NUMBER) & (rest != ""), made(of, head, rest)))


def hit_content(c: Column) -> Column:
    """What follows the first ``:digits:``, or the whole line."""
    t = trim_end(c)
    return F.when(t.rlike(r":[0-9]+:"), F.regexp_extract(t, r"(?s)^.*?:[0-9]+:(.*)$", 1)).otherwise(t)


def prompt_goal(c: Column) -> Column:
    """The first 600 characters of a trimmed prompt; null for commands and blanks."""
    t = F.regexp_replace(c, r"^(?U:\s)+|(?U:\s)+$", "")
    return F.when((t != "") & ~t.startswith("/"), F.substring(t, 1, 600))


def command_display(argv: Column) -> Column:
    return F.format_string("%s [%d arguments redacted]", F.element_at(argv, 1), F.size(argv) - 1)


def command_label(argv: Column) -> Column:
    """The program's lower-cased stem, with a short plain subcommand or ``-m module``."""
    stem = ascii_lower(F.regexp_replace(F.regexp_replace(F.element_at(argv, 1), r"^.*[/\\]", ""), r"\.[^.]+$", ""))
    sub, module = F.get(argv, F.lit(1)), F.get(argv, F.lit(2))
    plain = F.coalesce(sub.rlike(r"^[A-Za-z][A-Za-z-]{0,11}$"), F.lit(False))
    named = F.coalesce((sub == "-m") & module.rlike(r"^[A-Za-z0-9]+$"), F.lit(False))
    return F.when(F.size(argv) < 1, "unknown").when(plain, F.concat(stem, F.lit(" "), sub)).when(named, F.concat(stem, F.lit(" -m "), module)).otherwise(stem)


def length_prefixed(c: Column) -> Column:
    """The byte length as eight big-endian bytes, then the bytes."""
    b = c.cast("binary")
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(b).cast("long")), 16, "0")), b)


def canonical_hash(stdout: Column, stderr: Column) -> Column:
    return F.sha2(F.concat(length_prefixed(F.coalesce(stdout, F.lit(""))), length_prefixed(F.coalesce(stderr, F.lit("")))), 256)


def clip(c: Column, limit: int) -> Column:
    """At most ``limit`` bytes, cut between characters, with a note of what was left out."""
    b = c.cast("binary")
    n = F.octet_length(b)
    back = F.filter(F.sequence(F.lit(limit), F.lit(max(limit - 3, 0)), F.lit(-1)), lambda i: F.hex(F.substring(b, i + 1, F.lit(1))).rlike("^[0-7C-F]"))
    at = F.element_at(back, 1)
    return F.when(n <= limit, c).otherwise(F.concat(F.decode(F.substring(b, F.lit(1), at), "UTF-8"), F.lit("[... "), (n - at).cast("string"), F.lit(" more bytes]")))
