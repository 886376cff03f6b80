"""Captures, lines, receipts and goals derived from the star-schema tables, so that engines can be compared on equal inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftspark.store import dealt


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _numbered(x: DataFrame, *order: str) -> DataFrame:
    """Lines of captures whose rows are lines already: numbers and byte offsets are running over the order given."""
    x = dealt(x, x)
    w = W.partitionBy("capture_id").orderBy(*order)
    x = x.withColumn("line_no", (F.row_number().over(w) - 1).cast("long")).withColumn("byte_end", F.sum(F.octet_length("line").cast("long")).over(w))
    return x.select("capture_id", F.lit("stdout").alias("stream"), "line_no", (F.col("byte_end") - F.octet_length("line")).alias("byte_start"), "byte_end", "line")


def log_lines(spark: SparkSession, sf_dir: str, by_type: bool = False) -> DataFrame:
    """Service logs of two thousand events each, or of one type within so many events."""
    capture = "concat('type-', event_type, '-', event_id div 2000)" if by_type else "concat('log-', event_id div 2000)"
    line = """concat(date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"), case when event_type = 'error' and value >= 150 then ' ERROR ' else ' INFO ' end,
      case when event_type = 'error' then 'fault' else event_type end, ': user=', cast(user_id as string), ' cents=', cast(cast(round(value * 100) as bigint) as string), chr(10))"""
    return _numbered(table(spark, sf_dir, "events").selectExpr(f"{capture} capture_id", "event_id", f"{line} line"), "event_id")


def test_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = "concat('test orders::case_', cast(o_orderkey as string), ' ... ', case when o_orderstatus = 'F' and o_orderkey % 50 = 0 then 'FAILED' else 'ok' end, chr(10))"
    return _numbered(table(spark, sf_dir, "orders").selectExpr("concat('tests-', o_orderkey div 1500) capture_id", "o_orderkey", f"{line} line"), "o_orderkey")


def hit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = "concat('src/p', cast(l_orderkey % 40 as string), '.rs:', cast(l_linenumber as string), ':', case when l_partkey % 97 = 0 then concat('pub fn line_', cast(l_partkey as string), '() {') else 'let status_value_for_line = next_line_of_order();' end, chr(10))"
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]
    return _numbered(table(spark, sf_dir, "lineitem").selectExpr("concat('hits-', l_returnflag, '-', l_orderkey div 2000) capture_id", *order, f"{line} line"), *order, "line")


def doc_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr("concat('doc-', cast(doc_id as string)) capture_id", "'stdout' stream", "text")


def diff_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A diff for a thousand customers, with a file of each of their nations; the changes are the customers."""
    path = "case when n_nationkey = 0 then 'Cargo.lock' when n_nationkey = 1 then 'tests/orders_test.py' when n_nationkey = 2 then 'package.json' else concat('src/', lower(replace(n_name, ' ', '_')), '.rs') end"
    nations = table(spark, sf_dir, "nation").selectExpr("n_nationkey", f"{path} path")
    c = table(spark, sf_dir, "customer").selectExpr("concat('diff-', c_custkey div 1000) capture_id", "c_nationkey n_nationkey", "c_custkey c", "c_name", "c_mktsegment", "c_acctbal")
    tier = "case when c_acctbal >= 5000 then 'gold' else 'plain' end"
    heads = c.select("capture_id", "n_nationkey").distinct().join(nations, "n_nationkey").selectExpr("capture_id", "n_nationkey", "cast(-1 as bigint) c", "0 s", "concat('diff --git a/', path, ' b/', path, chr(10)) line")
    minus = c.selectExpr("capture_id", "n_nationkey", "c", "0 s", "concat(case when n_nationkey = 1 then '-    assert ' else '-    let ' end, replace(c_name, '#', '_'), ' ', lower(c_mktsegment), chr(10)) line")
    plus = c.selectExpr("capture_id", "n_nationkey", "c", "1 s", f"concat(case when n_nationkey = 2 then '+    \"' else '+    let ' end, replace(c_name, '#', '_'), case when n_nationkey = 2 then '\": \"^1.' else ' ' end, {tier}, case when n_nationkey = 2 then '\"' else '' end, chr(10)) line")
    return _numbered(heads.unionByName(minus).unionByName(plus), "n_nationkey", "c", "s")


#: a goal that names a test, a step, a file and a package of the captures here
GOAL = "Why does orders::case_35 stall at step_7 and shard-12, and who changed Cargo.lock in src/p7.rs?"


def run_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of test suites with all that their output holds besides: blanks, chrome, frames, failures, recaps, headers, redraws."""
    line = """case when o_orderkey % 40 in (3, 4, 5) then '' when o_orderkey % 41 = 0 then 'note: run with `RUST_BACKTRACE=1` environment variable'
      when o_orderkey % 43 = 0 then concat('  File "/usr/lib/python3/site-packages/m.py", line ', o_custkey) when o_orderkey % 43 = 1 then '    return call(x)'
      when o_orderkey % 47 = 0 then 'failures:' when o_orderkey % 53 = 0 then concat(o_orderkey % 100, '% done', chr(13), 'next') when o_orderkey % 7 = 0 and o_orderstatus = 'F' then concat('test orders::case_', o_orderkey, ' ... FAILED')
      when o_orderkey % 11 = 0 then concat('    orders::case_', o_orderkey - 11 - o_orderkey % 7) when o_orderkey % 59 = 0 then 'warning: the cache is stale' when o_orderkey % 61 = 0 then concat('=== RUN   Test', o_custkey)
      when o_orderkey % 3 = 0 then concat('test orders::case_', o_orderkey, ' ... ok') when o_orderkey % 97 = 0 then concat('odd', o_custkey % 7, ' reading of gauge ', o_custkey) when o_orderkey % 300 >= 200 then concat('worker took ', o_custkey, 'ms')
      when o_orderkey % 300 >= 190 then 'still waiting for the shard-12 lock' else concat('step_', o_custkey % 90, ' on ', lower(o_orderpriority), ' of clerk ', o_custkey) end"""
    x = table(spark, sf_dir, "orders").selectExpr("concat('run-', o_orderkey div 1500) capture_id", "o_orderkey", f"concat({line}, chr(10)) line")
    return _numbered(x, "o_orderkey")


def goals(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "conversations").where("role = 'user' and conv_id is not null")
    return x.selectExpr("conv_id session_id", "turn at", "substring(text, 1, 600) goal", "turn seq", "turn div 2 revision")


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "events").selectExpr("*", "event_id % 5000 + 1 as raw", "cast(round(value * 100) as bigint) cents")
    return x.selectExpr(
        "cast(user_id as string) session_id", "concat('run-', cast(event_id as string)) run_id", "case when event_id % 7 = 0 then 'adaptive' else 'deterministic' end mode",
        "array(named_struct('tool_path', 'shell', 'captured', event_id % 11 <> 0, 'replaced', cents < raw, 'bypass_reason', case when event_id % 11 = 0 then 'capture_limit_exceeded' when cents >= raw then 'no_net_reduction' end)) coverage",
        "raw raw_bytes", "least(raw, cents) delivered_bytes", "cast(event_id % 3 as bigint) recalls", "event_type command", "concat('cap-', cast(event_id div 5 as string)) capture_id",
        "case event_type when 'signup' then 'succeeded' when 'error' then 'failed' when 'view' then 'cache_hit' when 'click' then 'not_attempted' end ranker_call_outcome", "false ranker_cache_hit", "event_id % 13 = 0 ranker_call_attempted",
        "case when event_type in ('signup', 'view') then event_id % 900 end tokens", "case when event_type = 'signup' and event_id % 5 <> 0 then cents / 1000000D end cost", "'USD' currency",
        "case when event_type = 'error' then 'missing_ranker_key' end adaptive_fallback", "cast(null as string) requested_mode", "cast(0 as bigint) recalled_bytes",
    )


def choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of thirty events each of a user, in their order; the last answer of a user may have fewer."""
    x = table(spark, sf_dir, "events").select("user_id", "event_id", "value", F.expr("(row_number() over (partition by user_id order by event_id) - 1) div 30").alias("part"))
    total = F.sum("value").over(W.partitionBy("user_id", "part"))
    p = F.round(F.when(total == 0, 0.0).otherwise(F.col("value") / total), 6)
    return x.select(F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("-"), F.col("part").cast("string")).alias("capture_id"), F.concat(F.lit("e"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("candidate_id"), p.alias("probability"), (F.col("user_id") % 9 / 2.0).alias("need"))


def bench_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A benchmark run of the order lines of each part and return flag: scenario the part, arm the flag."""
    x = table(spark, sf_dir, "lineitem")
    return x.selectExpr("cast(l_partkey as string) scenario", "concat('suite-', cast(l_partkey % 3 as string)) suite", "case l_returnflag when 'N' then 'native' when 'A' then 'rules' else 'ranker' end arm", "cast(l_quantity * 100 as bigint) tokens", "l_partkey % 4 <> 0 verified").groupBy("scenario", "suite", "arm").agg(F.sum("tokens").alias("est_tokens"), F.bool_and("verified").alias("verified"), F.lit(2).cast("long").alias("needles_total"), F.expr("case when arm = 'rules' and cast(scenario as bigint) % 5 = 0 then 1L else 2L end").alias("needles_found"))


def write_receipts(receipts: DataFrame, path: str) -> None:
    """Appends receipts as JSON lines."""
    receipts.write.mode("append").json(path)


def read_receipts(spark: SparkSession, path: str, schema: str, strict: bool = False, session: str | None = None) -> DataFrame:
    """Receipts from JSON lines, of one session if it is given; malformed ones are dropped, or an error in strict mode."""
    x = spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)
    return x if session is None else x.where(F.col("session_id") == session)


def read_traces(spark: SparkSession, path: str, schema: str = "session string, type string, id string, tool string, input_tokens long, output_tokens long, content string") -> tuple[DataFrame, DataFrame]:
    """The events of JSON-lines files, and (file, lines, broken): how many lines each has and how many of them don't parse. Files of any size are split at line ends by the
    scan. A line without a type is broken."""
    x = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("e")).withColumn("fine", F.coalesce(F.col("e.type").isNotNull(), F.lit(False)))
    return x.where("fine").select("e.*"), x.groupBy("file").agg(F.count("*").alias("lines"), F.count_if(~F.col("fine")).alias("broken"))


def read_events(lines: DataFrame, schema: str, value: str = "value", most_bytes: int = 1 << 20) -> DataFrame:
    """JSON events of a batch or a stream of lines; malformed and oversized ones are passed over."""
    x = lines.where(F.octet_length(value) <= most_bytes).select(F.from_json(value, schema, {"mode": "PERMISSIVE"}).alias("e"))
    return x.where("e is not null").select("e.*")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, length) of each file: a manifest. Scans pass over empty files; those that the scan lists and doesn't read are added. Their names, as all that it
    lists, are in the driver anyway."""
    local = lambda c: F.regexp_replace(c, "^file:/+", "file:/")  # noqa: E731  the listing writes local names with three slashes, the scan with one
    x = spark.read.format("binaryFile").load(path).withColumn("__uri", local(F.col("_metadata.file_path")))
    listed = spark.createDataFrame([(f,) for f in x.inputFiles()], "f string").select(local(F.col("f")).alias("__uri"))
    name = F.url_decode(F.replace("__uri", F.lit("+"), F.lit("%2B")))  # a plus is no blank here
    empty = listed.join(x.select("__uri"), "__uri", "left_anti").select(name.alias("path"), F.sha2(F.lit(b""), 256).alias("sha256"), F.lit(0).cast("long").alias("length"))
    return x.select("path", F.sha2("content", 256).alias("sha256"), "length").unionByName(empty)
