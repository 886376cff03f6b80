"""Line classifiers: Column to boolean or label, in whole-stage code, no Python at run time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftspark.functions.text import ascii_lower, trim_end, trim_start

#: fixed values of the line vocabulary
LOCKFILES = "cargo.lock package-lock.json npm-shrinkwrap.json yarn.lock pnpm-lock.yaml bun.lock bun.lockb poetry.lock pipfile.lock uv.lock go.sum composer.lock gemfile.lock flake.lock packages.lock.json".split()
GENERATED_ENDS = (".min.js", ".min.css", ".js.map")
SOURCE_ENDS = ".rs .py .ts .tsx .js .jsx .mjs .go .java .kt .cs .c .cc .cpp .h .hpp .rb .php .swift .scala".split()
ASSERTIONS = ("assert", "expect(", ".should", "#[test]", "def test", "func test", "it(", "test(", "@test", "t.error", "t.fatal")
SKIPS = ("#[ignore", "pytest.mark.skip", "unittest.skip", ".skip(", "t.skip(", "@disabled", "xit(", "xdescribe(", "@ignore")
MODIFIERS = r"pub\(crate\)|pub\(super\)|pub|export default|export|async|static|public|private|protected|internal|final|abstract|unsafe|extern|declare|override|inline"
DECLARATIONS = r"fn|def|class|struct|enum|trait|type|interface|impl|function|func|const|mod|module|#define|macro_rules!"
SECRETS = ("sk-", "api_key", "apikey", "api-key", "password", "passwd", "secret", "bearer ", "token=", "token:", "credential", "private key", "authorization:", "aws_access", "ghp_", "xoxb-", "-----begin")


def _any(c: Column, needles) -> Column:
    return reduce(lambda a, b: a | b, (c.contains(n) for n in needles))


#: what says that a line is a fact, in any case of ASCII letters; fixed values
WARNINGS, ASSERTED, FAILURES = "warning|^warn:", "assert|expected|actual:", "failed|panic|error|exception|traceback|fatal"
#: a part of each of these words, from a letter on that isn't among the commonest, as a search stops at each place with the first letter
MAY_SAY = ("warn", "ssert", "xpected", "ctual:", "failed", "panic", "rror", "xception", "back", "fatal", "-->")


def fact_kind(c: Column) -> Column:
    """Words sought in the lower-cased line find out whether it may be a fact; only of such lines the kind is sought, by patterns."""
    says = lambda words: c.rlike(f"(?i){words}")
    kind = F.when(says(WARNINGS), "distinct_warning").when(says(ASSERTED), "assertion").when(says(FAILURES), "failure_identity").when(c.contains("-->"), "diagnostic_location")
    return F.when(_any(F.lower(c), MAY_SAY), kind)


def passing_test_name(c: Column) -> Column:
    """The name on an exact passing-test line. Lines without a mark of any format are told by plain searches. The formats are a lambda, so that their code isn't
    a part of the code of each line: with it that is too long for the JVM to compile."""
    may = c.startswith("test ") | _any(c, MAY_PASS)
    return F.when(may, F.get(F.transform(F.array(c), _passing_test_name), F.lit(0)))


def _passing_test_name(c: Column) -> Column:
    """The first format whose mark is there decides."""
    t = trim_end(c)
    s = trim_start(t)
    grab = lambda x, p: F.get(F.regexp_extract_all(x, F.lit(p), F.lit(1)), F.lit(0))  # noqa: E731  the whole line or nothing, matched once
    bare = r"(?U)[^\s\p{Cntrl}]+"
    node = F.substring_index(s, " PASSED", 1)
    status = F.regexp_replace(F.substring(s, F.length(node) + 8, F.length(s)), r"^(?U:\s)+|(?U:\s)+$", "")
    pytest = node.contains("::") & ~node.contains(" ") & ((status == "") | (status.startswith("[") & status.endswith("%]")))
    marked = F.substring(s, 3, F.length(s))
    timed = marked.rlike(r"(?s)^.* \(.*s\)$") & F.regexp_extract(marked, r"(?s)^.* \((.*)$", 1).endswith("s)")
    name = F.when(timed, F.regexp_extract(marked, r"(?s)^(.*) \(.*$", 1)).otherwise(marked)
    tap = grab(s, r"^ok [0-9]+ - ([^\p{Cntrl}]+)$")
    found = (
        F.when(t.rlike(r"^test .*? \.\.\. "), grab(t, rf"^test ({bare}) \.\.\. ok$"))
        .when(t.endswith(" ... ok"), grab(t, rf"^({bare}) \((?U:\S)*\) \.\.\. ok$"))
        .when(s.startswith("--- PASS: "), grab(s, r"^--- PASS: ([^\p{Cntrl}]+) \([^\p{Cntrl}]*s\)$"))
        .when(s.contains(" PASSED"), F.when(pytest, F.substring_index(node, "::", -1)))
        .when(s.rlike("^[✔✓√] "), F.when((name != "") & ~name.rlike(r"\p{Cntrl}"), name))
        .when(s.startswith("ok "), F.when(~F.upper(s).rlike("# (SKIP|TODO)"), tap))
    )
    return found


#: one pattern each, as a chain of conditions trims the line anew for each; fixed values
BOILERPLATE = (
    r"(?s)^(?:(?U:\s)*+(?:Running unittests |Running tests/|Running tests\\|Running benches/|Doc-tests |note: run with `RUST_BACKTRACE=1`|Blocking waiting for file lock|rootdir: |cachedir: |configfile: |plugins: "
    r"|Finished `.*target\(s\) in |platform(?= ).* -- Python |Ran all test suites\.\z|collected(?= ).* items\z|=====.* test session starts |ℹ duration_ms |ℹ (?:suites|cancelled|skipped|todo) 0$)"
    r"|running [0-9]+ tests?$|test result: ok\. 0 passed; 0 failed; 0 ignored; 0 measured;.*finished in|(?:={20,}|-{20,})$)"
)
#: besides ``test `` at the start, of which every format of a passing test has one
MAY_PASS = ("... ok", "PASS", "ok ", "✔", "✓", "√")


#: first characters of these, where no white space leads them
BOILERPLATE_HEADS = "RDnBrcpFt=-"


def is_boilerplate(c: Column) -> Column:
    t = trim_end(c)
    head = F.substring(t, 1, 1)
    return F.when(head.between("!", "~") & ~head.isin(*BOILERPLATE_HEADS), F.lit(False)).otherwise(t.rlike(BOILERPLATE))


def is_test_progress(c: Column) -> Column:
    t = trim_end(c)
    return (t.contains("=== ") & t.rlike("^(?U:\\s)*+=== (RUN|PAUSE|CONT|NAME) ")) | (t.contains(".py ") & t.rlike(r"^[^ ]*\.py +[.sxX]+ * \[[^\[]*%\]$"))


def is_runtime_frame(c: Column) -> Column:
    s = trim_start(trim_end(c))
    at = s.rlike(r"^at (node:|java\.|jdk\.internal\.|sun\.|org\.junit\.|junit\.)") | (s.startswith("at ") & _any(s, ("(node:", "node_modules", "(internal/")))
    low = ascii_lower(s)
    found = at | (s.startswith('File "') & (s.startswith('File "<frozen ') | _any(low, ("site-packages", "/lib/python", "\\lib\\python", "\\lib\\unittest\\", "/lib/unittest/"))))
    return F.when(c.rlike(r'^(?U:\s)*+(?:at |File ")'), found).otherwise(F.lit(False))


def is_definition(code: Column) -> Column:
    return code.rlike(rf"^(?U:\s)*+(?:(?:{MODIFIERS}) )*(?:{DECLARATIONS}) ")


def has_redraw(c: Column) -> Column:
    return trim_end(c).contains("\r")


def is_generated(path: Column) -> Column:
    low = ascii_lower(path)
    return F.regexp_extract(low, r"([^/\\]*)$", 1).isin(LOCKFILES) | reduce(lambda a, b: a | b, (low.endswith(e) for e in GENERATED_ENDS))


def progress_name(c: Column) -> Column:
    """The package on a strict build-progress line."""
    t = trim_end(c)
    p = r"^(?:   Compiling|    Checking) ([A-Za-z0-9_-]+) v[0-9][A-Za-z0-9.+-]*(?: \(.*\))?$"
    return F.when(fact_kind(t).isNull() & ~t.contains("\x1b") & t.rlike(p), F.regexp_extract(t, p, 1))


def is_source(path: Column) -> Column:
    return reduce(lambda a, b: a | b, (path.endswith(e) for e in SOURCE_ENDS))


def is_test_path(path: Column) -> Column:
    return _any(ascii_lower(path), ("test", "spec", "__tests__"))


def is_assertion(line: Column) -> Column:
    return _any(ascii_lower(line), ASSERTIONS)


def is_skip_marker(line: Column) -> Column:
    return _any(ascii_lower(line), SKIPS)


def contains_secret(c: Column) -> Column:
    return _any(ascii_lower(c), SECRETS)


def dependency_line(path: Column, line: Column) -> Column:
    """Whether an added line of a manifest names a dependency."""
    base = ascii_lower(F.substring_index(path, "/", -1))
    body = F.regexp_replace(F.substring(line, 2, F.length(line)), r"^(?U:\s)+|(?U:\s)+$", "")
    name = F.substring_index(body, '":', 1)
    version = F.regexp_replace(F.substring(body, F.length(name) + 3, F.length(body)), r'^(?U:\s)+"*|(?U:\s)+$', "")
    package = body.contains('":') & name.startswith('"') & ~F.regexp_replace(name, '"', "").isin("version", "name", "main", "description", "license", "type") & version.rlike("^[0-9^~*><]")
    found = (
        F.when(base == "cargo.toml", body.contains("=") & ~body.startswith("version") & ~body.startswith("["))
        .when(base == "package.json", package)
        .when(base == "go.mod", body.contains(" v") & ~body.startswith("go ") & ~body.startswith("module "))
        .when(base == "pyproject.toml", body.startswith('"') & _any(body, ("==", ">=", "~=", "<=", "^")))
        .when(base.rlike(r"^requirements.*\.txt$"), ~body.startswith("-"))
        .when(base == "gemfile", body.startswith("gem "))
        .otherwise(F.lit(False))
    )
    return F.when((body == "") | body.startswith("#") | body.startswith("//"), F.lit(False)).otherwise(found)


def is_program(display: Column, name: str) -> Column:
    """Whether a command's display, ``name [n arguments redacted]``, is of a program, with or without ``.exe``, in any case of ASCII letters."""
    return F.coalesce(display.contains(" [") & ascii_lower(F.substring_index(display, " [", 1)).isin(name, f"{name}.exe"), F.lit(False))


def valid_text(b: Column) -> Column:
    """UTF-8 without NUL."""
    return F.is_valid_utf8(b.cast("string")) & (F.instr(b.cast("string"), "\x00") == 0)
