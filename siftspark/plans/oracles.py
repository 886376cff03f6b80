"""DuckDB SQL for the queries of the reduction engine, written against the same tables."""

from __future__ import annotations

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STOP = "about after again also because before being between build check code could does each file files find first from have into make more need only other please should some sure than that their them then there these they this those through under until using what when where which while will with without would your fails failing failure error errors test tests warning change changes update work works working look issue problem run running output result results just like want fail failed around"
SECRETS = "sk-|api_key|apikey|api-key|password|passwd|secret|bearer |token=|token:|credential|private key|authorization:|aws_access|ghp_|xoxb-|-----begin"

_NUMBERED = """{name} as (select capture_id, 'stdout' stream, row_number() over (partition by capture_id order by {order}) - 1 line_no,
  cast(sum(strlen(line)) over (partition by capture_id order by {order}) - strlen(line) as bigint) byte_start, cast(sum(strlen(line)) over (partition by capture_id order by {order}) as bigint) byte_end, line from ({sql}))"""
_LOG = """select {capture} capture_id, event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || case when event_type = 'error' and value >= 150 then ' ERROR ' else ' INFO ' end
  || case when event_type = 'error' then 'fault' else event_type end || ': user=' || cast(user_id as varchar) || ' cents=' || cast(cast(round(value * 100) as bigint) as varchar) || chr(10) line from events"""
LOGS = _NUMBERED.format(name="lines", order="event_id", sql=_LOG.format(capture="'log-' || cast(event_id // 2000 as varchar)"))
TYPED = _NUMBERED.format(name="lines", order="event_id", sql=_LOG.format(capture="'type-' || event_type || '-' || cast(event_id // 2000 as varchar)"))
TESTS = _NUMBERED.format(name="lines", order="o_orderkey", sql="select 'tests-' || cast(o_orderkey // 1500 as varchar) capture_id, o_orderkey, 'test orders::case_' || cast(o_orderkey as varchar) || ' ... ' || case when o_orderstatus = 'F' and o_orderkey % 50 = 0 then 'FAILED' else 'ok' end || chr(10) line from orders")
HITS = _NUMBERED.format(name="lines", order="l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, line", sql="select 'hits-' || l_returnflag || '-' || cast(l_orderkey // 2000 as varchar) capture_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, 'src/p' || cast(l_orderkey % 40 as varchar) || '.rs:' || cast(l_linenumber as varchar) || ':' || case when l_partkey % 97 = 0 then 'pub fn line_' || cast(l_partkey as varchar) || '() {' else 'let status_value_for_line = next_line_of_order();' end || chr(10) line from lineitem")
DIFFS = _NUMBERED.format(name="lines", order="n_nationkey, c, s", sql="""select * from (
  select distinct 'diff-' || cast(c_custkey // 1000 as varchar) capture_id, n_nationkey, -1 c, 0 s, 'diff --git a/' || path || ' b/' || path || chr(10) line from paths join customer on c_nationkey = n_nationkey
  union all select 'diff-' || cast(c_custkey // 1000 as varchar), c_nationkey, c_custkey, 0, case when c_nationkey = 1 then '-    assert ' else '-    let ' end || replace(c_name, '#', '_') || ' ' || lower(c_mktsegment) || chr(10) from customer
  union all select 'diff-' || cast(c_custkey // 1000 as varchar), c_nationkey, c_custkey, 1, case when c_nationkey = 2 then '+    "' else '+    let ' end || replace(c_name, '#', '_') || case when c_nationkey = 2 then '": "^1.' else ' ' end || case when c_acctbal >= 5000 then 'gold' else 'plain' end || case when c_nationkey = 2 then '"' else '' end || chr(10) from customer)""")
PATHS = "paths as (select n_nationkey, case when n_nationkey = 0 then 'Cargo.lock' when n_nationkey = 1 then 'tests/orders_test.py' when n_nationkey = 2 then 'package.json' else 'src/' || lower(replace(n_name, ' ', '_')) || '.rs' end path from nation)"
DOCS = """lines as (
  select capture_id, i - 1 line_no, cast(sum(strlen(line)) over (partition by capture_id order by i) - strlen(line) as bigint) byte_start, cast(sum(strlen(line)) over (partition by capture_id order by i) as bigint) byte_end, line
  from (select 'doc-' || cast(doc_id as varchar) capture_id, unnest(p) line, unnest(range(1, len(p) + 1)) i from (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') p from documents)))"""


def fact(c: str) -> str:
    low = f"translate({c}, '{UP}', '{LOW}')"
    return f"""case when contains({low}, 'warning') or starts_with({low}, 'warn:') then 'distinct_warning' when regexp_matches({low}, 'assert|expected|actual:') then 'assertion'
      when regexp_matches({low}, 'failed|panic|error|exception|traceback|fatal') then 'failure_identity' when contains({low}, '-->') then 'diagnostic_location' end"""


def trim_end(c: str) -> str:
    return f"rtrim({c}, chr(13) || chr(10))"


def template(c: str) -> str:
    return f"""array_to_string(list_transform(regexp_extract_all({trim_end(c)}, '[0-9A-Za-z]+|[^0-9A-Za-z]'),
      lambda t: case when regexp_matches(t, '^[0-9A-Fa-f]{{7,}}$') and regexp_matches(t, '[0-9]') then '#' else regexp_replace(t, '[0-9]+', '#', 'g') end), '')"""


def shape(c: str) -> str:
    return f"""array_to_string(list_transform(list_filter(regexp_split_to_array({template(c)}, '\\s+'), lambda w: regexp_matches(w, '\\p{{L}}'))[1:3], lambda w: rtrim(w, ':,;') || ' '), '')"""


LONG = f"""f as (select *, {fact('line')} fact, {shape('line')} shape from lines),
  v as (select *, count(*) over (partition by capture_id) n, sum(strlen(line)) over (partition by capture_id) b, count(*) over (partition by capture_id, shape) alike,
    max(case when fact in ('failure_identity', 'assertion') then 1 else 0 end) over (partition by capture_id order by line_no rows between 8 preceding and 2 following) heavy,
    max(case when fact in ('distinct_warning', 'diagnostic_location') then 1 else 0 end) over (partition by capture_id order by line_no rows between 1 preceding and current row) light from f),
  r as (select *, shape <> '' and alike <= 2 and strlen(trim(line, ' ' || chr(10))) >= 12 rare0 from v),
  r2 as (select *, rare0 and count(*) filter (rare0) over (partition by capture_id) <= 40 and 20 * count(*) filter (rare0) over (partition by capture_id) <= n rare from r),
  planned as (select *, case when n >= 150 and b >= 12288 and not (line_no < 30 or line_no >= n - 50 or heavy = 1 or light = 1 or rare) then 'long_output_middle' end reason from r2)"""
PASSED = f"""p as (select *, {fact('line')} fact, regexp_matches({trim_end('line')}, '^test [^\\s]+ \\.\\.\\. ok$') pass from lines),
  q as (select *, case when pass and count(*) filter (pass) over (partition by capture_id) > 2 then 'successful_test_inventory' end reason0 from p),
  g0 as (select *, case when coalesce(reason0, '') is distinct from lag(coalesce(reason0, '')) over (partition by capture_id order by line_no) then 1 else 0 end st from q),
  g1 as (select *, sum(st) over (partition by capture_id order by line_no) isl from g0),
  planned0 as (select *, case when sum(strlen(line)) over (partition by capture_id, isl) < 72 then null else reason0 end reason from g1),
  g2 as (select *, case when coalesce(reason, '') is distinct from lag(coalesce(reason, '')) over (partition by capture_id order by line_no) then 1 else 0 end st2 from planned0),
  planned as (select *, sum(st2) over (partition by capture_id order by line_no) part from g2)"""
OMITTED = "gone as (select capture_id, 'stdout-' || cast(min(byte_start) as varchar) || '-' || cast(max(byte_end) as varchar) section_id, min(byte_start) byte_start, max(byte_end) byte_end, count(*) factual_count, min(reason) reason from planned where reason is not null group by capture_id, part)"
SHOWN = "shown as (select capture_id, min(byte_start) byte_start, max(byte_end) byte_end, string_agg(line, '' order by line_no) rendered_text from planned where reason is null group by capture_id, part)"
VIEW = """parts as (select capture_id, byte_start, 0 n, rendered_text p from shown union all select capture_id, byte_start, factual_count, '... ' || cast(factual_count as varchar) || ' passing tests hidden [' || section_id || ']' || chr(10) from gone),
  body as (select capture_id, sum(n) omitted, string_agg(p, '' order by byte_start) body from parts group by capture_id),
  exits as (select capture_id, max(case when contains(line, 'FAILED') then 101 else 0 end) exit_code, max(byte_end) raw from lines group by capture_id),
  view0 as (select capture_id, omitted, raw, 'siftspark exit=' || cast({exit} as varchar) || ' omitted=' || cast(cast(omitted as bigint) as varchar) || chr(10) || body
    || case when omitted > 0 then 'recall: siftspark recall ' || left(capture_id, 8) || ' --section ID' || chr(10) else '' end as v from body join exits using (capture_id))"""
#: PASSED's islands and gaps for any plan whose lines are ``judged(reason)``
PARTED = """g0 as (select * rename (reason as reason0), case when coalesce(reason, '') is distinct from lag(coalesce(reason, '')) over (partition by capture_id order by line_no) then 1 else 0 end st from judged),
  g1 as (select *, sum(st) over (partition by capture_id order by line_no) isl from g0),
  planned0 as (select *, case when sum(strlen(line)) over (partition by capture_id, isl) < 72 then null else reason0 end reason from g1),
  g2 as (select *, case when coalesce(reason, '') is distinct from lag(coalesce(reason, '')) over (partition by capture_id order by line_no) then 1 else 0 end st2 from planned0),
  planned as (select *, sum(st2) over (partition by capture_id order by line_no) part from g2)"""
RECEIPTS = """receipts as (select cast(user_id as varchar) session_id, 'run-' || cast(event_id as varchar) run_id, case when event_id % 7 = 0 then 'adaptive' else 'deterministic' end as mode,
  event_id % 11 <> 0 captured, cents < raw replaced, case when event_id % 11 = 0 then 'capture_limit_exceeded' when cents >= raw then 'no_net_reduction' end bypass, raw raw_bytes, least(raw, cents) delivered, event_id % 3 recalls,
  event_type command, 'cap-' || cast(event_id // 5 as varchar) capture_id, event_type, event_id, case when event_type in ('signup', 'view') then event_id % 900 end tokens, case when event_type = 'signup' and event_id % 5 <> 0 then cents end micros
  from (select *, event_id % 5000 + 1 raw, cast(round(value * 100) as bigint) cents from events))"""
GOALS = "goals as (select conv_id session_id, turn tt, left(text, 600) goal, turn // 2 revision from conversations where role = 'user' and conv_id is not null)"
RUNS = """runs as (select cast(l_partkey as varchar) scenario, 'suite-' || cast(l_partkey % 3 as varchar) suite, case l_returnflag when 'N' then 'native' when 'A' then 'rules' else 'ranker' end arm, cast(sum(cast(l_quantity * 100 as bigint)) as bigint) est_tokens,
  bool_and(l_partkey % 4 <> 0) verified, 2 needles_total, case when l_returnflag = 'A' and l_partkey % 5 = 0 then 1 else 2 end needles_found from lineitem group by l_partkey, l_returnflag)"""
_PAYLOAD = """(with {lines}, {plan}, {omitted}, {shown}, {view}, told as (select capture_id, count(fact) total, count(fact) filter (reason is null) seen from planned group by capture_id)
  select capture_id scenario, '{suite}' suite, total needles_total, cast(raw as bigint) raw, strlen(v) size, seen from view0 join told using (capture_id))"""
PAYLOADS = f"""sized as (select * from {_PAYLOAD.format(lines=TESTS, plan=PASSED, omitted=OMITTED, shown=SHOWN, view=VIEW.format(exit='exit_code'), suite='tests')}
  union all select * from {_PAYLOAD.format(lines=LOGS, plan=LONG.replace('planned as', 'judged as') + ', ' + PARTED, omitted=OMITTED, shown=SHOWN, view=VIEW.format(exit='exit_code').replace('passing tests', 'lines from the middle'), suite='logs')}),
  runs as (select scenario, suite, 'native' arm, (raw + 3) // 4 est_tokens, needles_total, needles_total needles_found from sized
    union all select scenario, suite, 'rules', (least(size, raw) + 3) // 4, needles_total, case when size < raw then seen else needles_total end from sized)"""
CHOICES = """numbered as (select user_id, event_id, value, row_number() over (partition by user_id order by event_id) r from events),
  few as (select *, sum(value) over (partition by user_id, (r - 1) // 30) total from numbered),
  choice as (select 'u' || cast(user_id as varchar) || '-' || cast((r - 1) // 30 as varchar) capture_id, 'e' || lpad(cast(event_id as varchar), 12, '0') candidate_id, round(case when total = 0 then 0 else value / total end, 6) probability, user_id % 9 / 2.0 need from few)"""


RUN_LINES = _NUMBERED.format(name="lines", order="o_orderkey", sql="""select 'run-' || cast(o_orderkey // 1500 as varchar) capture_id, o_orderkey, case when o_orderkey % 40 in (3, 4, 5) then '' when o_orderkey % 41 = 0 then 'note: run with `RUST_BACKTRACE=1` environment variable'
  when o_orderkey % 43 = 0 then '  File "/usr/lib/python3/site-packages/m.py", line ' || cast(o_custkey as varchar) when o_orderkey % 43 = 1 then '    return call(x)' when o_orderkey % 47 = 0 then 'failures:'
  when o_orderkey % 53 = 0 then cast(o_orderkey % 100 as varchar) || '% done' || chr(13) || 'next' when o_orderkey % 7 = 0 and o_orderstatus = 'F' then 'test orders::case_' || cast(o_orderkey as varchar) || ' ... FAILED'
  when o_orderkey % 11 = 0 then '    orders::case_' || cast(o_orderkey - 11 - o_orderkey % 7 as varchar) when o_orderkey % 59 = 0 then 'warning: the cache is stale' when o_orderkey % 61 = 0 then '=== RUN   Test' || cast(o_custkey as varchar)
  when o_orderkey % 3 = 0 then 'test orders::case_' || cast(o_orderkey as varchar) || ' ... ok' when o_orderkey % 97 = 0 then 'odd' || cast(o_custkey % 7 as varchar) || ' reading of gauge ' || cast(o_custkey as varchar) when o_orderkey % 300 >= 200 then 'worker took ' || cast(o_custkey as varchar) || 'ms'
  when o_orderkey % 300 >= 190 then 'still waiting for the shard-12 lock' else 'step_' || cast(o_custkey % 90 as varchar) || ' on ' || lower(o_orderpriority) || ' of clerk ' || cast(o_custkey as varchar) end || chr(10) line from orders""")
#: the goal of the captures, lower case, and its telling tokens
GOAL = "why does orders::case_35 stall at step_7 and shard-12, and who changed cargo.lock in src/p7.rs?"
GOAL_TOKENS = ["orders::case_35", "stall", "step_7", "shard-12", "changed", "cargo.lock", "src/p7.rs"]
LINE_FACTS = f"""l0 as (select *, {trim_end('line')} t, strlen(line) nb, {fact('line')} fact from lines),
  l1 as (select *, trim(t, ' ' || chr(9)) said, trim(t, ' ' || chr(9)) = '' blank, nullif(regexp_extract(t, '^test ([^\\s]+) \\.\\.\\. ok$', 1), '') passed, regexp_matches(ltrim(t), '^=== (RUN|PAUSE|CONT|NAME) ') prog from l0)"""


def _mention(goal: str | None, c: str) -> str:
    return f"(strlen({c}) >= 4 and contains('{goal}', lower({c})))" if goal else "false"


def _told(goal: str | None, lines: str) -> str:
    """Tokens that at most lines / 50 lines have, within 8 and 40."""
    if not goal:
        return f"tok as (select capture_id, line_no, false told from {lines})"
    hit = f"tok0 as (select l.capture_id, l.line_no, k.token from {lines} l, (select unnest({GOAL_TOKENS}) token) k where contains(lower(l.line), k.token))"
    fit = f"tok1 as (select capture_id, token from tok0 join (select capture_id, count(*) n from {lines} group by 1) using (capture_id) group by capture_id, token, n having count(*) <= least(greatest(n // 50, 8), 40))"
    return f"{hit}, {fit}, tok as (select l.capture_id, l.line_no, t.line_no is not null told from {lines} l left join (select distinct capture_id, line_no from tok0 semi join tok1 using (capture_id, token)) t using (capture_id, line_no))"


def _gaps(frm: str, reason: str = "reason") -> str:
    """Hidden runs of under 72 bytes are shown again."""
    g = f"coalesce(case when {reason} = 'test_progress' then 'successful_test_inventory' else {reason} end, '')"
    return f"""gap0 as (select *, {g} gg, case when {g} is distinct from lag({g}) over (partition by capture_id order by line_no) then 1 else 0 end gst from {frm}),
  gap1 as (select *, sum(gst) over (partition by capture_id order by line_no) gi from gap0),
  gap2 as (select *, sum(nb) over (partition by capture_id, gi) gb from gap1),
  ended as (select *, case when gb < 72 and {reason} not in ('runner_boilerplate', 'duplicate_of_visible_line') then null else {reason} end final from gap2)"""


def output_plan(lines: str, goal: str | None = None) -> str:
    """The plan of output whose test lines are of one runner: a reason a line, ``final`` in ``ended``."""
    w = "over (partition by capture_id order by line_no)"
    return f"""with {lines}, {LINE_FACTS},
  s0 as (select *, coalesce(lag(blank) {w}, false) pb, max(case when blank then 0 else 1 end) {w} bef, max(case when blank then null else line_no end) over (partition by capture_id) lastl, {_mention(goal, 'said')} ment from l1),
  s1 as (select *, case when (blank and pb) or (blank and (bef = 0 or line_no > coalesce(lastl, -1))) or starts_with(ltrim(t), 'note: run with `RUST_BACKTRACE=1`') then 'runner_boilerplate' end r1, starts_with(ltrim(t), 'File "') pyl, strlen(t) - strlen(ltrim(t)) ind from s0),
  s2a as (select *, pyl and contains(lower(t), 'site-packages') fr from s1),
  s2b as (select *, fr and fact is null and r1 is null own from s2a),
  s2 as (select *, coalesce(r1, case when fact is null and (fr or (coalesce(lag(own) {w}, false) and ind > lag(ind) {w} and not pyl)) then 'runtime_internal_frames' end) r2, count(passed) over (partition by capture_id) np, count(*) filter (prog) over (partition by capture_id) ng from s2b),
  s3a as (select *, coalesce(r2, case when (np > 2 or (np + ng > 2 and ng > 0)) and prog and fact is null then 'test_progress' end) r3a from s2),
  s3 as (select *, coalesce(r3a, case when np > 2 and passed is not null and not {"contains('" + goal + "', lower(passed))" if goal else 'false'} then 'successful_test_inventory' end) r3, contains(t, chr(13)) re from s3a),
  s4 as (select *, coalesce(r3, case when re and fact is null and count(*) filter (re) over (partition by capture_id) >= 2 then 'terminal_progress' end) r4, case when t is distinct from lag(t) {w} then 1 else 0 end ist from s3),
  s5a as (select *, sum(ist) {w} ii from s4),
  s5b as (select *, count(*) over (partition by capture_id, ii) ik, count(*) filter (r4 is null) over (partition by capture_id, ii) iv, row_number() over (partition by capture_id, ii order by line_no) ir, {template('line')} tpl from s5a),
  s5 as (select *, coalesce(r4, case when ik >= 3 and iv = ik and ir > 1 then 'repeated_identical_lines' end) r5 from s5b),
  s6a as (select *, r5 is null and strlen(tpl) >= 6 and fact is null and not ment ok from s5),
  s6b as (select *, case when not ok or not coalesce(lag(ok) {w}, false) or tpl is distinct from lag(tpl) {w} then 1 else 0 end sst from s6a),
  s6c as (select *, sum(sst) {w} si from s6b),
  s6d as (select *, count(*) over (partition by capture_id, si) sk, row_number() over (partition by capture_id, si order by line_no) sr from s6c),
  s6 as (select *, coalesce(r5, case when ok and sk >= 8 and sr > 2 and sr < sk then 'similar_lines' end) r6 from s6d),
  s7a as (select *, r6 is null and np + ng > 0 vis, r6 is null and np + ng > 0 and strlen(said) >= 8 and not (said like '%:' or said like 'File "%' or said like 'at %') lng from s6),
  ech as (select a.capture_id, a.line_no from s7a a join s7a b on a.capture_id = b.capture_id and b.line_no < a.line_no and a.lng and not regexp_matches(a.said, '\\s') and b.vis and b.fact is not null and contains(b.said, a.said) group by all),
  s7b as (select x.*, e.line_no is not null echo, row_number() over (partition by x.capture_id, said, vis order by x.line_no) nth from s7a x left join ech e on x.capture_id = e.capture_id and x.line_no = e.line_no),
  s7 as (select *, coalesce(r6, case when lng and (nth > 1 or echo) then 'duplicate_of_visible_line' end) r7 from s7b),
  {_told(goal, 's7')},
  s8a as (select s7.*, told, {shape('line')} shp, count(*) filter (r7 is null) over (partition by s7.capture_id) nv, sum(case when r7 is null then nb else 0 end) over (partition by s7.capture_id) bv, sum(case when r7 is null then 1 else 0 end) over (partition by s7.capture_id order by s7.line_no) pos,
    max(case when r7 is null and fact in ('failure_identity', 'assertion') then 1 else 0 end) over (partition by s7.capture_id order by s7.line_no rows between 8 preceding and 2 following) heavy,
    max(case when r7 is null and fact in ('distinct_warning', 'diagnostic_location') then 1 else 0 end) over (partition by s7.capture_id order by s7.line_no rows between 1 preceding and current row) light from s7 join tok using (capture_id, line_no)),
  s8b as (select *, r7 is null and shp <> '' and strlen(said) >= 12 and count(*) filter (r7 is null) over (partition by capture_id, shp) <= 2 rare0 from s8a),
  s8c as (select *, rare0 and count(*) filter (rare0) over (partition by capture_id) <= 40 and 20 * count(*) filter (rare0) over (partition by capture_id) <= nv rare from s8b),
  s8 as (select *, coalesce(r7, case when nv >= 150 and bv >= 12288 and not (pos <= 30 or pos > nv - 50 or heavy = 1 or light = 1 or ment or told or rare) then 'long_output_middle' end) r8 from s8c),
  s9 as (select *, coalesce(r8, case when blank and (lag(r8) {w} is not null or lead(r8) {w} is not null) then 'runner_boilerplate' end) r9 from s8),
  s10a as (select *, row_number() over (partition by capture_id, said, r9 is null order by line_no) hn, first_value(case when not blank then case when r9 is null then 1 else 0 end end ignore nulls) over (partition by capture_id order by line_no rows between 1 following and unbounded following) below from s9),
  s10 as (select *, coalesce(r9, case when said like '%:' and hn > 1 and coalesce(below, 0) = 0 then 'duplicate_of_visible_line' end) r10 from s10a),
  {_gaps('s10', 'r10')}"""


def ranges(prefix: str, captures: int, spread: int, name: str = "ranges") -> str:
    return f"{name} as (select '{prefix}' || c_custkey % {captures} capture_id, c_custkey * 7919 % {spread} lo, c_custkey * 7919 % {spread} + case when c_custkey % 5 = 0 then 3 else c_custkey % 900 end hi from customer)"


def chosen(frm: str, name: str = "sel") -> str:
    """Lines with whether a range of their capture holds them."""
    return f"{name} as (select x.*, exists (select 1 from ranges r where r.capture_id = x.capture_id and x.byte_start >= r.lo and x.byte_end <= r.hi) chosen from {frm} x)"


def search_plan(lines: str, goal: str | None = None, hit: str = "^([^:]*):([0-9]+):(.*)$") -> str:
    """The plan of searches: a reason a line, ``final`` in ``ended``; nothing in captures with a line that is no hit."""
    w = "over (partition by capture_id order by line_no)"
    named = f"(contains('{goal}', lower(path)) or contains('{goal}', lower(body)))" if goal else "false"
    return f"""with {lines}, {LINE_FACTS}, h as (select *, regexp_matches(t, '{hit}') ok, regexp_extract(t, '{hit}', 1) path, try_cast(regexp_extract(t, '{hit}', 2) as bigint) ln, regexp_extract(t, '{hit}', 3) body from l1),
      c as (select *, case when path = lag(path) {w} and body = lag(body) {w} and ln > lag(ln) {w} then 0 else 1 end st from h), d as (select *, sum(st) {w} i from c),
      e as (select *, count(*) over (partition by capture_id, i) k, row_number() over (partition by capture_id, i order by line_no) r, {named} named, {fact('body')} fact_of_body from d),
      f as (select *, case when strlen(body) >= 32 and fact_of_body is null and not named and k >= 12 and r > 2 and r <= k - 2 then 'repeated_search_match_content' end r1, case when t is distinct from lag(t) {w} then 1 else 0 end ist from e),
      g as (select *, sum(ist) {w} ii from f), g2 as (select *, count(*) over (partition by capture_id, ii) ik, count(*) filter (r1 is null) over (partition by capture_id, ii) iv, row_number() over (partition by capture_id, ii order by line_no) ir from g),
      s5 as (select *, coalesce(r1, case when ik >= 3 and iv = ik and ir > 1 then 'repeated_identical_lines' end) r5, regexp_matches(regexp_extract(t, ':[0-9]+:(.*)$', 1), '^pub fn ') def from g2),
      {_told(goal, 's5')},
      s6 as (select s5.*, told, count(*) filter (r5 is null) over (partition by capture_id) nv, sum(case when r5 is null then nb else 0 end) over (partition by capture_id) bv, count(*) filter (r5 is null and def) over (partition by capture_id) nd, sum(case when r5 is null then 1 else 0 end) {w} pos from s5 join tok using (capture_id, line_no)),
      s7a as (select *, bool_and(ok) over (partition by capture_id) sound, coalesce(r5, case when (nv >= 40 or bv >= 4096) and not (pos <= 12 or (def and nd * 3 <= nv) or told or {_mention(goal, 'trim(body)')}) then 'search_matches_beyond_head' end) r7a from s6),
      s7 as (select *, case when sound then r7a end r7 from s7a),
      {_gaps('s7', 'r7')}"""


def _text(x: str) -> str:
    return "'" + x.replace("'", "''").replace("\r", "' || chr(13) || '") + "'"


def literals() -> str:
    from siftspark.plans.queries import LITERALS

    return f"forms(i, form) as (values {', '.join(f'({i}, {_text(x)})' for i, x in enumerate(LITERALS))}), literals as (select p_partkey id, i, replace(form, '@', cast(p_partkey as varchar)) line from part join forms on i = p_partkey % {len(LITERALS)})"


def _classified() -> str:
    """The expected labels of the lines, written out by form."""
    from siftspark.plans.queries import LITERALS

    passed = {0: "tests::alpha_@", 3: "test_one_@", 5: "TestGo@", 6: "TestSub", 7: "test_x@", 9: "adds @ numbers", 10: "renders", 11: "plain", 12: "name of it"}
    at = {x: i for i, x in enumerate(LITERALS)}
    boiler = {at[x] for x in ("running @ tests", "collected @ items", "===== test session starts =====", "==================================", "------------------------------", "ℹ skipped 0")}
    progress = {at[x] for x in ("=== RUN   TestGo", "tests/test_a.py ..s..  [ 40%]")}
    frames = {at[x] for x in LITERALS if x.startswith("    at node") or "(node:" in x or "node_modules" in x or "lib/python" in x or x.startswith("    at java")}
    defs = {at[x] for x in ("pub fn a@() {", "export default class B {", "#define X 1", "async def c():")}
    build = {at["   Compiling serde-@ v1.0.1"]: "serde-@", at["    Checking a_b v0.1.0 (/tmp/x)"]: "a_b"}
    pick = lambda ids: "i in (" + ",".join(map(str, sorted(ids))) + ")"
    case = lambda d: "case i " + " ".join(f"when {k} then replace('{v}', '@', cast(id as varchar))" for k, v in d.items()) + " end"
    return f"with {literals()} select id, {fact('line')} fact, {case(passed)} passed, {pick(boiler)} boilerplate, {pick(progress)} progress, {pick(frames)} frame, {pick(defs)} definition, {case(build)} build, regexp_matches(lower(line), '{SECRETS}') secret, contains(line, chr(13)) redraw from literals"


def _values(names: str, rows: list[tuple]) -> str:
    """Results worked out by hand for each form, for the parts that have it; ``@`` is the part's key."""
    cell = lambda x: "null" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    columns = names.split(", ")
    told = lambda c, x: f"replace({c}, '@', cast(p_partkey as varchar)) {c}" if isinstance(x, str) else c
    sample = [next((r[k] for r in rows if r[k] is not None), None) for k in range(len(columns))]
    return f"select p_partkey id, {', '.join(told(c, x) for c, x in zip(columns[1:], sample[1:], strict=True))} from part join (values {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) t(i, {', '.join(columns[1:])}) on i = p_partkey % {len(rows)}"


def oracle_sql() -> dict[str, str]:
    stop = "(" + ",".join(f"'{w}'" for w in STOP.split()) + ")"
    words = ["thing", "that", "stands", "under", "table", "with", "reason"]
    out = {
        "flagship_log_reduction": f"with {LOGS}, {LONG} select capture_id, count(*) n_lines, count(reason) hidden_lines, sum(strlen(line)) n_bytes, coalesce(sum(strlen(line)) filter (reason is not null), 0) hidden_bytes from planned group by capture_id",
        "explode_lines": f"with {DOCS} select capture_id, line_no, byte_start, byte_end, md5(line) line_md5 from lines",
        "trimmed_lines": f"with {DOCS} select capture_id, sum(length({trim_end('line')})) chars, count(*) filter ({trim_end('line')} = '') blanks from lines group by capture_id",
        "classify_literals": _classified(),
        "page_facts": f"with l as (select page_id, unnest(regexp_extract_all(html, '[^\\n]*\\n|[^\\n]+')) line from pages) select page_id, {fact('line')} fact, count(*) n from l group by all",
        "secret_documents": f"select doc_id, coalesce(regexp_matches(translate(text, '{UP}', '{LOW}'), '{SECRETS}'), false) secret from documents",
        "line_templates": f"with {LOGS} select capture_id, {template('line')} as template, count(*) n, min(line_no) as first from lines group by all",
        "line_shapes": f"with {LOGS} select capture_id, {shape('line')} shape, count(*) n from lines group by all",
        "parsed_hits": f"with {HITS}, h as (select *, regexp_extract(rtrim(line, chr(10)), '^([^:]+):([0-9]+):(.+)$', ['p', 'l', 'c']) x from lines) select capture_id, line_no, x.p path, cast(x.l as bigint) line, x.c as content from h",
        "goal_tokens": f"with {GOALS}, t as (select session_id, tt, list_filter(list_transform(regexp_split_to_array(goal, '[^A-Za-z0-9_:./-]+'), lambda w: translate(trim(w, ':./-'), '{UP}', '{LOW}')), lambda w: strlen(w) >= 4 and w not in {stop}) w from goals), k as (select session_id, tt, list_filter(w, lambda x, i: list_position(w, x) = i) w from t) select session_id, tt as \"at\", array_to_string(w, '|') tokens, len(w) n from k",
        "prompt_goals": "select conv_id, turn, case when regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> '' and not starts_with(ltrim(text), '/') then left(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), 600) end goal from conversations where role = 'user'",
        "canonical_hashes": "select doc_id, sha256(unhex(printf('%016X', octet_length(encode(coalesce(text, ''))))) || encode(coalesce(text, '')) || unhex(printf('%016X', octet_length(encode(coalesce(source, ''))))) || encode(coalesce(source, ''))) raw_sha256 from documents",
        "identical_runs": f"with {DOCS}, a as (select *, {trim_end('line')} t from lines), b as (select *, case when t is distinct from lag(t) over (partition by capture_id order by line_no) then 1 else 0 end st from a), c as (select *, sum(st) over (partition by capture_id order by line_no) isl from b), e as (select *, count(*) over (partition by capture_id, isl) k, row_number() over (partition by capture_id, isl order by line_no) r from c) select capture_id, line_no, 'repeated_identical_lines' reason from e where k >= 3 and r > 1",
        "similar_runs": f"with {TYPED}, a as (select *, {template('line')} t, strlen({template('line')}) >= 6 and {fact('line')} is null ok from lines), b as (select *, case when not ok or not coalesce(lag(ok) over w, false) or t <> lag(t) over w then 1 else 0 end st from a window w as (partition by capture_id order by line_no)), c as (select *, sum(st) over (partition by capture_id order by line_no) isl from b), e as (select *, count(*) over (partition by capture_id, isl) k, row_number() over (partition by capture_id, isl order by line_no) r from c) select capture_id, case when ok and k >= 8 and r > 2 and r < k then 'similar_lines' else 'visible' end reason, count(*) n, sum(line_no) line_sum from e group by all",
        "passing_tests": f"with {TESTS}, {PASSED} select capture_id, count(reason0) hidden, count(*) - count(reason0) as visible from q group by capture_id",
        "test_omissions": f"with {TESTS}, {PASSED}, {OMITTED} select *, 'stdout' stream from gone",
        "test_blocks": f"with {TESTS}, {PASSED}, {SHOWN} select capture_id, 'stdout' stream, byte_start, byte_end, sha256(rendered_text) sha256, rendered_text from shown",
        "test_facts": f"with {TESTS}, {PASSED} select capture_id, 'stdout' stream, fact kind, {trim_end('line')} as value, byte_start, byte_end from q where reason0 is null and fact is not null",
        "pack_tiles": f"with {TESTS} select distinct capture_id, 'stdout' stream, 0 gap from lines",
        "pack_views": f"with {TESTS}, {PASSED}, {OMITTED}, {SHOWN}, {VIEW.format(exit='exit_code')} select capture_id, cast(omitted as bigint) omitted, md5(v) view_md5, strlen(v) view_bytes from view0",
        "pack_decisions": f"with {TESTS}, {PASSED}, {OMITTED}, {SHOWN}, {VIEW.format(exit='0')} select capture_id, case when omitted = 0 then 'already_lean' when strlen(v) > 2048 then 'protected_or_retained_material_exceeds_budget' when strlen(v) >= raw then 'no_net_reduction' end reason from view0",
        "search_head": f"with {HITS}, a as (select *, regexp_matches(regexp_extract(line, ':[0-9]+:(.*)', 1), '^pub fn ') def from lines), b as (select *, count(*) over w n, count(*) filter (def) over w nd from a window w as (partition by capture_id)) select capture_id, case when n >= 40 and line_no >= 12 and not (def and nd * 3 <= n) then 'search_matches_beyond_head' else 'visible' end reason, count(*) n, sum(line_no) line_sum from b group by all",
        "repeated_hits": f"with {HITS}, a as (select *, line_no - row_number() over (partition by capture_id order by line_no) k from lines where not contains(line, 'pub fn')) select capture_id, case when count(*) >= 12 then count(*) - 4 else 0 end hidden, count(*) n from a group by capture_id",
        "hit_sections": f"with {HITS}, h as (select *, split_part(line, ':', 1) path, cast(split_part(line, ':', 2) as bigint) l from lines), s as (select *, case when lag(path) over w = path and lag(l) over w + 1 = l then 0 else 1 end st from h window w as (partition by capture_id order by line_no)), i as (select *, sum(st) over (partition by capture_id order by line_no) section from s) select capture_id, cast(section as bigint) section, path, min(l) first_line, max(l) last_line, min(byte_start) byte_start, max(byte_end) byte_end, count(*) n from i group by capture_id, section, path",
        "log_digest": f"with {LOGS}, k as (select *, {shape('line')} k from lines), g as (select capture_id, k, arg_min(rtrim(line, chr(10)), line_no) l, min(line_no) tt, count(*) n from k group by all) select capture_id, string_agg(l || case when n > 1 then '  [+' || cast(n - 1 as varchar) || ' similar]' else '' end || chr(10), '' order by tt) digest from g group by capture_id",
        "rankable_chunks": f"with {LOGS}, {LONG}, m as (select *, case when reason is distinct from lag(reason) over (partition by capture_id order by line_no) then 1 else 0 end st from planned), i as (select *, sum(st) over (partition by capture_id order by line_no) isl from m), z as (select *, greatest(30, cast(ceil(count(*) over (partition by capture_id) / 60) as bigint)) size, row_number() over (partition by capture_id, isl order by line_no) - 1 pos from i where reason is not null) select capture_id, cast(floor(pos / size) as bigint) chunk, min(line_no) first_line, max(line_no) last_line, count(*) n from z group by capture_id, isl, pos // size, cast(floor(pos / size) as bigint)",
        "rank_sections": f"""with s as (
          select capture_id, 'search' kind, byte_start, byte_end, path || ' lines ' || first_line || '-' || last_line as label from (with {HITS}, h as (select *, split_part(line, ':', 1) path, cast(split_part(line, ':', 2) as bigint) l from lines),
            t as (select *, case when lag(path) over w = path and lag(l) over w + 1 = l then 0 else 1 end st from h window w as (partition by capture_id order by line_no)), i as (select *, sum(st) over (partition by capture_id order by line_no) section from t)
            select capture_id, path, min(l) first_line, max(l) last_line, min(byte_start) byte_start, max(byte_end) byte_end from i group by capture_id, section, path)
          union all select capture_id, 'diff', byte_start, byte_end, 'diff of ' || path || ' (' || n || ' lines)' from (with {PATHS}, {DIFFS}, t as (select *, sum(case when starts_with(line, 'diff --git a/') then 1 else 0 end) over (partition by capture_id order by line_no) section from lines)
            select capture_id, max(regexp_extract(line, '^diff --git a/(.*?) b/', 1)) path, min(byte_start) byte_start, max(byte_end) byte_end, count(*) n from t group by capture_id, section)
          union all select capture_id, 'output', byte_start, byte_end, 'stdout lines ' || (first_line + 1) || '-' || (last_line + 1) from (with {LOGS}, {LONG}, m as (select *, case when reason is distinct from lag(reason) over (partition by capture_id order by line_no) then 1 else 0 end st from planned),
            i as (select *, sum(st) over (partition by capture_id order by line_no) isl from m), z as (select *, greatest(30, cast(ceil(count(*) over (partition by capture_id) / 60) as bigint)) size, row_number() over (partition by capture_id, isl order by line_no) - 1 pos from i where reason is not null)
            select capture_id, min(line_no) first_line, max(line_no) last_line, min(byte_start) byte_start, max(byte_end) byte_end from z group by capture_id, isl, pos // size)),
          n as (select *, row_number() over (partition by capture_id order by byte_start) - 1 idx from s)
          select *, 'stdout' stream, case when kind = 'search' then 'section_' || printf('%02d', idx) || '_' || byte_start || '_' || byte_end else 's' || printf('%02d', idx) end id from n""",
        "scope_findings": f"""with {PATHS}, {DIFFS}, t as (select *, sum(case when starts_with(line, 'diff --git a/') then 1 else 0 end) over (partition by capture_id order by line_no) section from lines),
          g as (select capture_id, section, max(regexp_extract(line, '^diff --git a/.*? b/([^\n]*)', 1)) path, count(*) filter (line[1] = '+') added from t group by capture_id, section),
          k as (select *, row_number() over (partition by capture_id order by section) r from g)
          select capture_id, 'possible_scope_creep' kind, path, 'a ' || (added % 10 * 10) || '% probability that this file''s change is needed for the goal' evidence from k where r <= 24 and added % 10 < 3""",
        "candidate_snapshots": """with f as (select 'tree-' || doc_id // 100 capture_id, 'docs/' || doc_id || '.md' path, doc_id % 17 <> 0 regular, coalesce(text, '') c from documents),
          j as (select *, regular and strlen(c) <= 2097152 and not coalesce(hex(encode(c)[4097:4097]) between '80' and 'BF', false) and instr(c, chr(0)) = 0 ok from f)
          select capture_id, sha256('candidate-manifest-1' || md5(capture_id) || sha256('diff of ' || capture_id) || string_agg(strlen(path) || ':' || path || case when regular then strlen(c) || ':' || sha256(c) else 'nonregular' end, '' order by path)) candidate_sha256,
            count(*) filter (ok) reviewed, count(*) filter (not ok) unreviewed from j group by capture_id""",
        "changed_files": f"with {PATHS}, {DIFFS}, s as (select *, sum(case when starts_with(line, 'diff --git') then 1 else 0 end) over (partition by capture_id order by line_no) section from lines), x as (select *, row_number() over (partition by capture_id, section, left(line, 1) in ('+', '-') order by line_no) r, left(line, 1) sg, first_value(regexp_extract(ln, ' b/(.*)$', 1)) over (partition by capture_id, section order by line_no) path from (select *, rtrim(line, chr(10)) ln from s)) select capture_id, cast(section as bigint) section, max(path) path, count(*) filter (sg = '+') added, count(*) filter (sg = '-') removed, false deleted, coalesce(string_agg(line, '' order by line_no) filter (sg in ('+', '-') and r <= 12), '') excerpt from x group by capture_id, section",
        "diff_findings": "with c as (select *, 'diff-' || cast(c_custkey // 1000 as varchar) capture_id from customer where c_nationkey in (1, 2)) select capture_id, 'weakened_test' kind, 'tests/orders_test.py' path, cast(count(*) as varchar) || ' assertion or test lines removed, 0 added' evidence from c where c_nationkey = 1 group by capture_id union all select capture_id, 'dependency_change', 'package.json', '+    \"' || replace(c_name, '#', '_') || '\": \"^1.' || case when c_acctbal >= 5000 then 'gold' else 'plain' end || '\"' from c where c_nationkey = 2",
        "generated_diffs": "select 'diff-' || cast(c_custkey // 1000 as varchar) capture_id, case when 2 * count(*) filter (c_nationkey = 0) + 1 > 6 then 2 * count(*) filter (c_nationkey = 0) else 0 end hidden, 2 * count(*) + count(distinct c_nationkey) n from customer group by 1",
        "gain_report": f"with {RECEIPTS}, g as (select grouping(command) total, command, count(*) runs, sum(cast(replaced as int)) reduced_runs, sum(raw_bytes) raw, sum(delivered) delivered from receipts group by grouping sets ((command), ())) select cast(total as int) total, command, runs, reduced_runs, raw, delivered, greatest(0, raw - delivered) saved, (greatest(0, raw - delivered) + 3) // 4 saved_tokens, case when raw = 0 then 0 else 10000 * greatest(0, raw - delivered) // raw end saved_bp from g",
        "top_commands": f"with {RECEIPTS}, g as (select command, count(*) runs, sum(cast(replaced as int)) reduced_runs, sum(raw_bytes) raw, sum(delivered) delivered from receipts group by command) select command, runs, reduced_runs, raw, delivered, greatest(0, raw - delivered) saved, (greatest(0, raw - delivered) + 3) // 4 saved_tokens, case when raw = 0 then 0 else 10000 * greatest(0, raw - delivered) // raw end saved_bp from g order by saved desc, command limit 15",
        "bypass_histogram": f"with {RECEIPTS} select bypass reason, count(*) n from receipts where bypass is not null group by bypass",
        "request_accounting": f"""with {RECEIPTS}, o as (select *, case event_type when 'signup' then 'succeeded' when 'error' then 'failed' when 'view' then 'cache_hit' when 'click' then 'not_attempted' end oc, tokens is not null or micros is not null used from receipts),
          a as (select *, coalesce(oc = 'cache_hit', false) cached from o), b as (select *, not cached and (coalesce(oc in ('succeeded', 'failed'), false) or event_id % 13 = 0 or used) attempt, not cached and (coalesce(oc = 'succeeded', false) or (oc is null and used)) success, not cached and coalesce(oc = 'failed', false) failure,
          oc is null and (mode = 'adaptive' or event_type = 'error') legacy, coalesce(micros >= 0, false) priced from a), c as (select *, not cached and not success and not failure and (attempt or legacy) unk from b)
          select command, count(*) filter (attempt) attempted, count(*) filter (success) succeeded, count(*) filter (failure) failed, count(*) filter (cached) cache_hits, count(*) filter (unk) as unknown, count(*) filter (not cached and used) calls, coalesce(sum(coalesce(tokens, 0)) filter (not cached and used), 0) input_tokens,
          count(*) filter (attempt and tokens is null) missing_tokens, count(*) filter (attempt and not priced) unpriced, coalesce(sum(micros) filter (attempt and priced), 0) cost_micros, count(*) filter (event_type = 'error') fallbacks,
          count(*) filter (attempt and tokens is null) = 0 and count(*) filter (unk) = 0 input_tokens_complete, count(*) filter (attempt and not priced) = 0 and count(*) filter (unk) = 0 cost_complete from c group by command""",
        "session_status": f"with {RECEIPTS} select session_id, case when count(distinct mode) = 1 then min(mode) else 'mixed' end as mode, count(*) runs, count(*) filter (captured) captured, count(*) filter (replaced) replaced, count(*) filter (bypass is not null) bypassed, sum(raw_bytes) raw, sum(delivered) delivered, sum(recalls) recalls, case when count(*) <= 8 then string_agg(run_id, ',' order by run_id) end run_ids from receipts group by session_id",
        "recorded_recalls": f"with {RECEIPTS}, l as (select 'cap-' || cast(event_id // 7 as varchar) capture_id, count(*) n, sum(event_id % 97) b from events group by 1), r as (select *, row_number() over (partition by capture_id order by run_id) nth from receipts) select run_id, recalls + case when nth = 1 then coalesce(n, 0) else 0 end recalls, case when nth = 1 then coalesce(b, 0) else 0 end recalled_bytes from r left join l using (capture_id)",
        "suite_totals": f"with {RUNS}, g as (select suite, arm, sum(est_tokens) tokens, sum(needles_found) as found, sum(needles_total) total from runs group by grouping sets ((suite, arm), (arm))) select g.suite, g.arm, g.tokens, g.found, g.total, ((n.tokens - g.tokens) * 10000) / greatest(n.tokens, 1) reduction0, trunc(((n.tokens - g.tokens) * 10000) / greatest(n.tokens, 1)) reduction_bp from g join g n on n.arm = 'native' and n.suite is not distinct from g.suite",
        "payload_runs": f"with {PAYLOADS} select r.scenario, r.suite, r.arm, r.est_tokens, r.needles_total, r.needles_found, r.est_tokens + case when r.needles_found < r.needles_total then n.est_tokens else 0 end effective from runs r join runs n on n.arm = 'native' and n.scenario = r.scenario",
        "payload_scores": f"with {PAYLOADS}, g as (select suite, arm, cast(sum(est_tokens) as bigint) tokens, cast(sum(needles_found) as bigint) as found, cast(sum(needles_total) as bigint) total from runs group by grouping sets ((suite, arm), (arm))) select g.suite, g.arm, g.tokens, g.found, g.total, cast(((n.tokens - g.tokens) * 10000) // greatest(n.tokens, 1) as bigint) reduction_bp from g join g n on n.arm = 'native' and n.suite is not distinct from g.suite",
        "effective_tokens": f"with {RUNS} select r.scenario, r.arm, r.est_tokens + case when r.needles_found < r.needles_total then n.est_tokens else 0 end effective from runs r join runs n on n.arm = 'native' and n.scenario = r.scenario",
        "median_by_arm": f"with {RUNS} select arm, round(median(est_tokens), 6) median_est_tokens, count(*) n from runs group by arm",
        "paired_savings": f"with {RUNS} select r.scenario, r.arm, r.est_tokens, n.est_tokens base_value, cast(trunc(((n.est_tokens - r.est_tokens) * 10000) / greatest(n.est_tokens, 1)) as bigint) saving_bp from runs r join runs n on n.arm = 'native' and n.scenario = r.scenario where r.arm <> 'native' and r.verified and n.verified",
        "kept_candidates": f"with {CHOICES}, a as (select *, row_number() over w r, coalesce(sum(probability) over (w rows between unbounded preceding and 1 preceding), 0) b, count(*) over (partition by capture_id) n, cast(least(greatest(round(need), 0), 4) as int) lv from choice window w as (partition by capture_id order by probability desc, candidate_id)), k as (select *, count(*) filter (r <= least([1, 2, 4, 8, 16][lv + 1], n) and b < 0.55 + 0.1 * need) over (partition by capture_id) taken from a) select capture_id, candidate_id, r as rank from k where r <= greatest(taken, least([1, 1, 2, 4, 16][lv + 1], n), 1)",
        "answer_errors": f"with {CHOICES} select capture_id, case when not (min(probability) >= 0 and max(probability) <= 1) then 'probability_range' when not sum(probability) between 0.98 and 1.02 then 'probability_sum' end error from choice group by capture_id",
        "prefiltered_documents": "with s as (select source capture_id, doc_id idx, " + " + ".join(f"cast(contains(lower(text), '{w}') as int)" for w in words) + " score from documents), r as (select *, row_number() over (partition by capture_id order by score desc, idx) as rank from s) select capture_id, idx, score, rank, rank <= 64 kept from r",
        "selected_lines": f"with {LOGS} select capture_id, line_no from lines where (capture_id = 'log-0' and byte_start >= 1000 and byte_end <= 5000) or (capture_id = 'log-1' and (byte_end <= 700 or (byte_start >= 60000 and byte_end <= 61000)))",
        "goal_revisions": f"with {GOALS}, a as (select *, case when lag(tt) over w is null or tt - lag(tt) over w > 3 then 1 else 0 end fresh, lag(goal) over w old from goals window w as (partition by session_id order by tt)), b as (select *, sum(fresh) over (partition by session_id order by tt) era from a) select session_id, tt as \"at\", cast(sum(case when fresh = 1 or old <> goal then 1 else 0 end) over (partition by session_id, era order by tt) as bigint) revision from b",
        "task_revisions": f"with {GOALS}, a as (select *, max(revision) over (partition by session_id order by tt rows between unbounded preceding and 1 preceding) top, first_value(goal) over (partition by session_id, revision order by tt) first from goals) select session_id, tt seq, revision, case when top is null or revision > top then 'accepted' when revision < top then 'stale' when goal = first then 'same' else 'conflict' end outcome from a",
        "goals_at_runs": f"with {GOALS}, r as (select conv_id session_id, conv_id * 100 + turn run_id, turn tt from conversations where role = 'assistant'), l as (select r.*, (select arg_max(g.goal, g.tt) from goals g where g.session_id = r.session_id and g.tt <= r.tt) goal, (select max(g.tt) from goals g where g.session_id = r.session_id and g.tt <= r.tt) since from r) select session_id, run_id, tt as \"at\", case when tt - since <= 1 then goal end goal from l",
        "recalled_bytes": "with r as (select cast(doc_id as varchar) capture_id, doc_id % 50 as start, doc_id % 50 + doc_id % 400 as stop, hex(encode(text)) h from documents) select capture_id, start, stop as \"end\", case when stop <= length(h) // 2 then substr(h, 2 * start + 1, 2 * (stop - start)) end hex, case when h is null then 'missing' when stop > length(h) // 2 then 'invalid_range' end error from r",
        "recalled_lines": f"with {DOCS}, r as (select 'doc-' || cast(doc_id as varchar) capture_id, 1 + doc_id % 4 a, 1 + doc_id % 4 + doc_id % 5 b from documents), g as (select r.capture_id, a, b, max(line_no) + 1 n, string_agg(line, '' order by line_no) filter (line_no + 1 between a and b) t from r left join lines l on l.capture_id = r.capture_id group by all) select capture_id, a, b, case when b <= n then t end as text, case when n is null then 'missing' when b > n then 'invalid_range' end error from g",
        "resolved_ids": "with c as (select md5(cast(doc_id as varchar)) full_id from documents), r as (select doc_id request_id, substr(md5(cast(doc_id * 2 as varchar)), 1, 6 + doc_id % 5) prefix from documents), g as (select request_id, prefix, count(full_id) n, min(full_id) f from r left join c on starts_with(full_id, prefix) and length(prefix) >= 8 group by all) select request_id, case when length(prefix) >= 8 and n = 1 then f end capture_id, case when length(prefix) < 8 then 'invalid_id' when n = 0 then 'missing' when n > 1 then 'invalid_id' end error from g",
        "capture_limits": "with s as (select source || '-' || doc_id // 100 run_id, doc_id seq, sum(strlen(text)) over (partition by source, doc_id // 100 order by doc_id) so_far from documents) select run_id, seq, cast(so_far as bigint) so_far, max(so_far) over (partition by run_id) > 40000 bypassed from s",
        "manifest_changes": "select cast(doc_id as varchar) path, case doc_id % 10 when 7 then 'missing' when 3 then 'extra' else 'changed' end as change from documents where doc_id % 10 in (3, 5, 7)",
        "retained_events": "select event_id from events where event_id * 10 + 86400 >= 90000",
    }
    out["suite_totals"] = out["suite_totals"].replace("((n.tokens - g.tokens) * 10000) / greatest(n.tokens, 1) reduction0, trunc(", "cast(trunc(").replace("greatest(n.tokens, 1)) reduction_bp", "greatest(n.tokens, 1)) as bigint) reduction_bp")
    out |= {
        "routed_commands": _values("id, parsed, eligible", [(0, "cargo|test|case_@", True), (1, "cargo|+nightly|test", True), (2, "cargo|run", False), (3, "go|vet|./...", True), (4, "python|-m|pytest|-q", True), (5, "python|app_@.py", False), (6, "C:toolsRG.exe|x", False), (7, "npm|run|build", True), (8, "npm|run|dev:web", False), (9, "npx|jest", True), (10, "grep|-rn|x@|.", True), (11, "grep|--color|x", False), (12, "git|log|-@", True), (13, "git|push", False), (14, "cmake|--build|out", True), (15, "mvn|-q|verify", True), (16, "bundle|exec|rspec", True), (17, "docker|build|.", True), (18, "kubectl|get|pods", False), (19, "FOO=@|make", True), (20, "cd|a&make|b @ c", True), (21, None, False), (22, None, False), (23, "git|show|a @|c d", True), (24, None, False), (25, None, False), (26, None, False)]),
        "search_privacy": _values("id, denied", [(0, None), (1, None), (2, "privacy_denied_query"), (3, "privacy_denied_query"), (4, "privacy_denied_search_target"), (5, "privacy_denied_search_target"), (6, "unsupported_search_command"), (7, "unsupported_search_command"), (8, "privacy_denied_query"), (9, "privacy_denied_search_target"), (10, "privacy_denied_query")]),
        "command_labels": _values("id, label, display", [(0, "cargo test", "/usr/bin/Cargo [2 arguments redacted]"), (1, "python -m pytest", "C:\\py\\python.exe [2 arguments redacted]"), (2, "python", "python [2 arguments redacted]"), (3, "git@", "git@ [0 arguments redacted]"), (4, "rg", "rg [1 arguments redacted]"), (5, "npm", "npm [1 arguments redacted]"), (6, "tool", "tool [1 arguments redacted]")]),
        "hook_events": "select role tool, case when octet_length(encode(text)) > 524288 then 'too_large' end as skip, count(*) n, sum(octet_length(encode(text))) bytes from conversations where (conv_id + turn) % 9 <> 0 group by all",
        "build_progress": "with a as (select 'build-' || p_brand || '-' || p_partkey // 5000 capture_id, p_partkey, p_partkey % 100 <> 0 own from part), b as (select *, case when own is distinct from lag(own) over (partition by capture_id order by p_partkey) then 1 else 0 end st from a), c as (select *, sum(st) over (partition by capture_id order by p_partkey) isl from b), e as (select capture_id, own, count(*) k from c group by capture_id, isl, own) select capture_id, sum(case when own and k >= 16 then k - 4 else 0 end) hidden, sum(k) n from e group by capture_id",
        "redrawn_lines": "select 'o-' || o_orderstatus || '-' || o_orderkey // 2000 capture_id, case when count(*) filter (o_orderkey % 3 = 0) >= 2 then count(*) filter (o_orderkey % 3 = 0) else 0 end hidden from orders group by 1",
        "recalled_sections": f"with {TESTS}, {PASSED}, {OMITTED} select g.capture_id, g.section_id, sha256(string_agg(l.line, '' order by l.line_no)) sha256, null error from gone g join lines l on l.capture_id = g.capture_id and l.byte_start >= g.byte_start and l.byte_end <= g.byte_end group by all union all select distinct capture_id, 'stdout-5-6', null, 'invalid_range' from lines",
        "capture_status": "select doc_id, case when doc_id % 9 = 0 then 'missing' when doc_id % 48 > 24 then 'expired' when doc_id % 7 = 0 then 'corrupt' else 'ok' end status from documents",
        "pack_conflicts": "select doc_id pack_id, case when doc_id % 3 = 0 then 'append' when doc_id % 5 = 0 then 'conflict' else 'same' end outcome from documents",
        "superseded_results": "select r.event_id run_id, exists (select 1 from events a where a.event_type = 'purchase' and a.user_id = r.user_id and a.event_id > r.event_id and a.event_id <= r.event_id + 500 and a.event_id // 100 > r.event_id // 100) superseded from events r where r.event_type = 'view'",
        "purged_packs": "select cast(event_id as varchar) capture_id, event_id * 10 pack_id from events where event_id * 10 + 86400 >= 95000",
        "traced_tokens": "with e as (select user_id as session, event_type, event_id % 97 n, event_id // 3 id from events where event_id % 50 <> 0), t as (select r.session, sum(r.n) tool_bytes, count(*) tool_calls from e r where r.event_type = 'view' and exists (select 1 from e u where u.session = r.session and u.id = r.id and u.event_type = 'click') group by r.session) select session, coalesce(sum(n) filter (event_type not in ('click', 'view')), 0) input_tokens, 0 output_tokens, coalesce(max(tool_bytes), 0) tool_bytes, coalesce(max(tool_calls), 0) tool_calls from e left join t using (session) group by session",
        "consecutive_pairs": "with p as (select o_orderkey // 2 pair, count(*) n, count(*) filter (o_orderstatus = 'F') na, sum(cast(trunc(o_totalprice) as bigint)) filter (o_orderstatus = 'F') a, sum(cast(trunc(o_totalprice) as bigint)) filter (o_orderstatus <> 'F') b from orders group by 1) select pair, a, b, b - a delta from p where n = 2 and na = 1",
        "found_needles": "select source || '-' || doc_id // 1000 scenario, cast(doc_id as varchar) arm, cast(contains(text, 'the') as int) + cast(contains(text, 'qui') as int) + cast(contains(text, 'zz') as int) needles_found, 3 needles_total, array_to_string(list_filter(['qui', 'the', 'zz'], lambda x: not contains(text, x)), ',') missing from documents",
        "expected_levels": "with x as (select user_id, event_id % 5 as level, sum(round(value)) p from events group by all) select user_id, round(sum(level * p) / nullif(sum(p), 0), 6) expected from x group by user_id",
        "candidate_minimums": "with g as (select 'u' || cast(user_id as varchar) capture_id, case user_id % 3 when 0 then 'search' when 1 then 'diff' else 'output' end kind, count(*) n from events group by all) select *, case when kind = 'search' and n > 64 then 'search_candidate_limit' when n < case kind when 'search' then 6 when 'diff' then 3 else 2 end then 'no_rankable_sections' end fallback from g",
        "evidence_gates": "select event_id, case when event_id % 100 < 70 then 'no_relevant_evidence' end fallback from events",
        "adaptive_search": f"with {HITS} select capture_id, count(*) filter (not contains(line, ':pub fn') and not ((capture_id = 'hits-A-0' and byte_start >= 200 and byte_end <= 5000) or (capture_id = 'hits-N-0' and byte_end <= 400))) hidden, count(*) n from lines group by capture_id",
        "new_source_files": "select 'new_file' kind, replace(p_name, ' ', '_') || case p_size % 3 when 0 then '.rs' else '.tsx' end path from part where p_size % 3 <> 1",
        "stale_advice": "select cast(o_orderkey as varchar) capture_id, o_orderkey % 10 = 9 or o_orderkey % 6 = 0 or o_orderkey % 8 = 0 stale from orders",
    }
    hits = {"src/a@.rs:12:let x = @;": ("src/a@.rs", 12, "let x = @;"), "C:\\a\\b@.rs:7:code": ("C:\\a\\b@.rs", 7, "code"), "12:only content @": ("one.rs", 12, "only content @"), "2024-01-02T03:04:05Z INFO start: user=5 ok": ("2024-01-02T03", 4, "05Z INFO start: user=5 ok")}
    key = "cast(id as varchar)"
    rows = " ".join(f"when replace('{k}', '@', {key}) then {{'p': replace('{v[0]}', '@', {key}), 'l': {v[1]}, 'c': replace('{v[2]}', '@', {key})}}" for k, v in hits.items())
    out["parsed_literal_hits"] = f"with {literals()}, h as (select id, line, case line {rows} end h from literals) select id, h.p path, cast(h.l as bigint) line, h.c as content, case when regexp_matches(line, ':[0-9]+:') then regexp_extract(line, '^.*?:[0-9]+:(.*)$', 1) else line end rest from h"
    out["clipped_texts"] = """with b as (select doc_id, text, hex(encode(text)) h, octet_length(encode(text)) n from documents),
      c as (select *, list_max(list_filter([317, 318, 319, 320], lambda i: not regexp_matches(substr(h, 2 * i + 1, 1), '[89AB]'))) cut from b)
      select doc_id, md5(case when n <= 320 then text else decode(unhex(left(h, 2 * cut))) || '[... ' || cast(n - cut as varchar) || ' more bytes]' end) clip_md5 from c"""
    out["edit_signatures"] = f"""with {PATHS}, {DIFFS}, s as (select *, sum(case when starts_with(line, 'diff --git') then 1 else 0 end) over (partition by capture_id order by line_no) section from lines),
      w as (select capture_id, section, left(line, 1) sg, unnest(list_filter(regexp_split_to_array(substr(line, 2), '[^A-Za-z0-9_]+'), lambda x: regexp_matches(x, '^[A-Za-z_]'))) id from s where left(line, 1) in ('+', '-')),
      k as (select capture_id, section, id, bool_or(sg = '-') a, bool_or(sg = '+') b from w group by all), n as (select capture_id, section, count(*) n from s where left(line, 1) in ('+', '-') group by all)
      select capture_id, cast(section as bigint) section, coalesce(string_agg(id, ',' order by id) filter (a and not b), '') gone, coalesce(string_agg(id, ',' order by id) filter (b and not a), '') come from k join n using (capture_id, section) where n >= 4 group by capture_id, section having bool_or(a <> b)"""
    visible = f"select capture_id, 'stdout' stream, fact kind, {trim_end('line')} as value, 'capture' source, byte_start, byte_end from q where reason0 is null and fact is not null"
    out["protected_facts"] = f"""with {TESTS}, {PASSED}, c as (select capture_id, cast(regexp_extract(capture_id, '([0-9]+)$', 1) as int) n, max(case when contains(line, 'FAILED') then 101 end) exit_code from lines group by capture_id)
      {visible} union all select capture_id, null, 'process_status', case when n % 2 = 0 then 'completed' else 'unknown' end, 'process', null, null from c
      union all select capture_id, null, 'exit_code', cast(exit_code as varchar), 'process', null, null from c where exit_code is not null
      union all select capture_id, null, 'user_constraint', unnest(['keep the API', 'no new files']), 'trusted_task_frame', null, null from c where n % 3 = 0"""
    out["deliveries"] = """with x as (select event_id run_id, event_id % 4000 + 1 raw, case when event_id % 5 <> 0 then cast(round(value * 10) as bigint) end r, case when event_id % 5 = 0 then 'already_lean' end reason, event_id % 17 = 0 o, event_id % 23 = 0 e from events)
      select run_id, case when r is null or o then reason when r > 1500 then 'rendered_pack_exceeds_budget' when r >= raw then 'rendered_pack_no_net_reduction' when e then 'pack_store_failed: quota' else reason end bypass,
      coalesce(r is not null and not o and r <= 1500 and r < raw and not e, false) replaced, case when r is not null and not o and r <= 1500 and r < raw and not e then r else raw end delivered_bytes from x"""
    out["verifier_commands"] = "select p_partkey, case when p_partkey % 11 = 0 or p_partkey % 7 = 0 or p_partkey % 5 = 0 then null else 'cargo ' || case p_partkey % 3 when 0 then 'check' when 1 then 'test' else 'build' end || ' -p part_' || cast(p_partkey as varchar) || case when p_partkey % 2 = 0 then ' --locked -q' else '' end end verifier from part"
    out["bounded_output"] = """with x as (select cast(user_id as varchar) || '-' || cast(event_id // 2000 as varchar) run_id, event_id, cast(round(value) as bigint) b from events),
      y as (select *, sum(b) over (partition by run_id order by event_id) held, sum(b) over (partition by run_id) total from x) select case when held > 2000 then 'forwarded' when total > 2000 then 'flushed' else 'kept' end fate, count(*) n, sum(b) n_bytes from y group by 1"""
    out["stored_ranges"] = """with c as (select doc_id, cast(doc_id as varchar) id, case when doc_id % 6 = 1 and doc_id % 3 = 0 then 'another text' else coalesce(text, '') end t, coalesce(source, '') e from documents),
      r as (select id capture_id, 'stdout' stream, doc_id % 700 as start, doc_id % 700 + doc_id % 1500 as stop, hex(encode(t)) h, false gone from c union all select id || case when doc_id % 10 = 0 then '?' else '' end, 'stderr', 0, 3, hex(encode(e)), doc_id % 10 = 0 from c),
      x as (select *, case when gone then 'missing' when stop > length(h) // 2 then 'invalid_range' end error, substr(h, 2 * start + 1, 2 * (stop - start)) part from r),
      y as (select *, stop = start or (substr(part, 1, 1) not in ('8', '9', 'A', 'B') and not regexp_matches(part, '^(..)*([C-F].|E.[89AB].|F.[89AB].|F.[89AB].[89AB].)$')) fine from x)
      select capture_id, stream, start, stop as "end", case when error is null then part end as hex, case when error is not null then null when fine then 'utf-8' else 'base64' end encoding, error from y"""
    out["saved_captures"] = """with c as (select doc_id, coalesce(text, '') t, case when doc_id % 5 = 0 then 'another text' else coalesce(text, '') end u from documents),
      j as (select doc_id, strlen(t) > 3000 old_large, strlen(u) > 3000 large, t = u as same, doc_id % 3 <> 0 was, doc_id % 7 = 0 twice from c),
      k as (select case when large then 'too_large' when was and not old_large then case when same then 'same' else 'conflict' end else 'append' end outcome, twice from j)
      select outcome, count(*) n from (select outcome from k union all select case when outcome = 'append' then 'same' else outcome end from k where twice) group by 1"""
    out["session_receipts"] = f"with {RECEIPTS}, top as (select session_id from receipts group by 1 order by count(*) desc, session_id limit 1) select session_id, run_id, raw_bytes, delivered delivered_bytes from receipts join top using (session_id) where event_id % 50 <> 0"
    out["newest_capture"] = "select cast(doc_id as varchar) capture_id from documents order by doc_id * 7919 % 1000003 desc limit 1"
    piece = "unhex(printf('%016X', octet_length(encode({0})))) || encode({0})"
    out["pack_identities"] = f"select doc_id, sha256({piece.format(chr(39) + 'siftspark-1' + chr(39))} || {piece.format('cast(doc_id as varchar)')} || {piece.format('case when doc_id % 9 <> 0 then source else ' + chr(39) * 2 + ' end')} || {piece.format('lang')}) pack_id from documents"
    told = "case when n % 3 = 0 then '{0}keep the API' || chr(10) || '{0}no new files' || chr(10) else '' end"
    out["verbose_views"] = f"""with {TESTS}, {PASSED}, {OMITTED}, {SHOWN}, {VIEW.format(exit='0')},
      c as (select capture_id, cast(regexp_extract(capture_id, '([0-9]+)$', 1) as int) n, max(case when contains(line, 'FAILED') then 101 else 0 end) code from lines group by capture_id),
      above as (select capture_id, string_agg(chr(10) || '[stdout bytes ' || byte_start || '..' || byte_end || ']' || chr(10) || rendered_text, '' order by byte_start) body from shown group by capture_id),
      below as (select capture_id, sum(factual_count) deferred, string_agg('- ' || section_id || ': ' || factual_count || ' lines of successful test inventory; recall with `siftspark recall ' || capture_id || ' --section ' || section_id || '`' || chr(10), '' order by byte_start) sections from gone group by capture_id),
      ok as (select capture_id, count(*) filter (pass and reason is null) seen from planned group by capture_id),
      x as (select c.capture_id, v, n, 'siftspark: ' || case when n % 2 = 0 then 'cargo [1 arguments redacted]' else 'shell' end || chr(10) || 'process: ' || case when n % 5 = 4 then 'UNKNOWN' when code = 0 then 'SUCCEEDED (exit 0)' else 'FAILED (exit 101)' end
        || '; capture: complete; selection: selected' || chr(10) || 'capture_id: ' || c.capture_id || chr(10) || {told.format('trusted task constraint: ')}
        || case when deferred > 0 then 'test inventory: ' || cast(seen + deferred as bigint) || ' explicit ok results (' || seen || ' shown, ' || cast(deferred as bigint) || ' deferred); see process status above' || chr(10) else '' end || coalesce(body, '')
        || case when sections is not null then chr(10) || 'Deferred exact historical sections:' || chr(10) || sections else '' end || 'Full historical recall: `siftspark recall ' || c.capture_id || ' --full`' || chr(10) long_
        from c join view0 using (capture_id) join ok using (capture_id) left join above using (capture_id) left join below using (capture_id))
      select capture_id, md5(long_) verbose_md5, strlen(long_) verbose_bytes, md5(left(v, instr(v, chr(10))) || {told.format('constraint: ')} || substr(v, instr(v, chr(10)) + 1)) view_md5 from x"""
    out["level_answers"] = """with g as (select l_orderkey k, count(*) n, count(distinct l_linenumber) d, max(l_linenumber) - min(l_linenumber) + 1 span, sum(l_quantity) total, sum((l_linenumber - 1) * l_quantity) s, min(l_linenumber) lo from lineitem group by 1)
      select k l_orderkey, case when n <> 4 or d <> 4 or span <> 4 or k % 5 = 0 or (k % 7 = 0 and lo <= 4) then 'shape' end error, case when not (n <> 4 or d <> 4 or span <> 4 or k % 5 = 0 or (k % 7 = 0 and lo <= 4)) then round(s / total - (lo - 1), 6) end as level from g"""
    out["binary_diffs"] = """with c as (select c_custkey k, 'diff-' || c_custkey // 50 capture_id, 'diff --git a/f' || c_custkey || ' b/f' || c_custkey head from customer),
      s as (select *, row_number() over (partition by capture_id order by k) section, encode(head || chr(10)) || case when k % 3 = 0 then unhex('FFFE00') else encode('+x') end || encode(chr(10)) b from c)
      select capture_id, section, head as header, sha256(b) sha256, octet_length(b) n_bytes from s"""
    out["bounded_output_stream"] = out["bounded_output"]
    out["goals_at_runs_stream"] = out["goals_at_runs"].replace("where role = 'assistant')", "where role = 'assistant' and conv_id is not null)")
    out["goal_revisions_stream"] = out["goal_revisions"]
    out["remembered_decisions"] = """with c as (select o_custkey k, min(o_orderkey) filter (o_orderkey % 2 = 0) even, min(o_orderkey) filter (o_orderkey % 2 = 1) odd from orders group by 1)
      select cast(k as varchar) cache_key, coalesce(even, odd) first_order from c"""
    whole = f"""{output_plan(TESTS)}, planned0 as (select *, final reason from ended),
      g2 as (select *, case when coalesce(reason, '') is distinct from lag(coalesce(reason, '')) over (partition by capture_id order by line_no) then 1 else 0 end st2 from planned0), planned as (select * exclude (part), sum(st2) over (partition by capture_id order by line_no) part from (select *, 0 part from g2))"""
    out["hook_deliveries"] = f"""{whole}, {OMITTED}, {SHOWN}, {VIEW.format(exit='exit_code')}, e as (select *, cast(regexp_extract(capture_id, '([0-9]+)$', 1) as int) % 5 = 4 bad from exits left join (select capture_id, v, omitted from view0) using (capture_id)),
      w as (select *, case when bad then 'invalid_session' when omitted = 0 then 'already_lean' when strlen(v) > 4096 then 'protected_or_retained_material_exceeds_budget' when strlen(v) >= raw then 'no_net_reduction' end bypass from e)
      select capture_id event_id, raw raw_bytes, bypass, bypass is null as replaced, case when bypass is null then strlen(v) else raw end delivered_bytes, case when bypass is null then md5(v) end output_md5 from w"""
    cut = "k{b} as (select *, case when k{a} is null or size{a} <= 65536 then k{a} when k{a} <= 160 then null else k{a} * 3 // 4 end k{b}, list_sum(list_transform(sizes, lambda x: least(x, case when k{a} is null or size{a} <= 65536 then k{a} when k{a} <= 160 then null else k{a} * 3 // 4 end))) + extra size{b} from k{a})"
    out["section_limits"] = "with x as (select l_orderkey, list(cast(l_quantity * 400 as bigint)) sizes, 51000 + l_orderkey % 15000 extra from lineitem group by l_orderkey), k00 as (select *, least(greatest(57344 // len(sizes), 320), 2400) k0 from x), k0 as (select *, list_sum(list_transform(sizes, lambda x: least(x, k0))) + extra size0 from k00), " + ", ".join(cut.format(a=i, b=i + 1) for i in range(12)) + " select l_orderkey, case when size12 <= 65536 then k12 end section_bytes from k12"
    out["cached_decisions"] = """with c as (select c_custkey k, c_mktsegment seg, sha256('v1' || md5(c_name) || c_mktsegment) cache_key from customer),
      d as (select *, k % 3 <> 0 has, k % 13 <> 0 and k % 5 <> 0 and k % 50 / 50.0 + 0.5 between 0.7 and 1 and k % 6 <= 4 and k % 7 <> 0 and k % 11 <> 0 sound from c)
      select k, cache_key, case when not has then 'miss' when sound then 'hit' else 'invalid' end found, case when has and sound then 'b,' || seg end kept from d"""
    out["store_size"] = "select count(*) n, cast(sum(coalesce(strlen(text), 0) + coalesce(strlen(source), 0)) as bigint) n_bytes from documents"
    out["session_reports"] = f"""with {RECEIPTS}, o as (select *, case event_type when 'signup' then 'succeeded' when 'error' then 'failed' when 'view' then 'cache_hit' when 'click' then 'not_attempted' end oc, tokens is not null or micros is not null used from receipts),
      x as (select *, coalesce(oc = 'cache_hit', false) cache, coalesce(oc in ('succeeded', 'failed'), false) or event_id % 13 = 0 or used tried, micros is not null priced from o),
      y as (select *, not cache and tried attempt, not cache and coalesce(oc = 'succeeded', oc is null and used) success, not cache and coalesce(oc = 'failed', false) failure from x),
      z as (select *, not cache and not success and not failure and (attempt or (oc is null and (mode = 'adaptive' or event_type = 'error'))) unk from y),
      g as (select session_id, cast(sum(raw_bytes) as bigint) raw, cast(sum(delivered) as bigint) delivered, cast(sum(recalls) as bigint) recalls, 0 recalled_bytes, count(*) runs, count(*) filter (attempt) attempted, count(*) filter (success) succeeded, count(*) filter (failure) failed, count(*) filter (cache) cache_hits, count(*) filter (unk) as unknown,
        count(*) filter (event_type = 'error') fallbacks, count(*) filter (attempt and not priced) unpriced, coalesce(sum(micros) filter (attempt and priced), 0) cost_micros from z group by session_id)
      select * exclude (unpriced, cost_micros), case when attempted = 0 and unknown = 0 then 'none (no ranker calls)' when unpriced = attempted and unknown = 0 then 'unknown (no priced response)' else printf('$%.8f known; %d attempt(s) unpriced; %d outcome(s) unknown', cost_micros / 1e6, unpriced, unknown) end as cost from g"""
    by_reason = "select capture_id, coalesce(final, 'visible') reason, count(*) n, sum(nb) bytes, sum(line_no) line_sum from ended group by all"
    out["log_plan_reasons"] = f"{output_plan(LOGS)} select capture_id, coalesce(final, 'visible') reason, count(*) n, sum(nb) bytes from ended group by all"
    out["run_plan_reasons"] = f"{output_plan(RUN_LINES)} {by_reason}"
    out["goal_plan_reasons"] = f"{output_plan(RUN_LINES, GOAL)} {by_reason}"
    w = "over (partition by capture_id order by line_no)"
    out["goal_search_reasons"] = f"{search_plan(HITS, GOAL)} {by_reason}"
    mixed = HITS.replace("lines as (", "whole as (", 1) + """, lines as (select * replace (case when capture_id like 'hits-N%' then substr(line, instr(line, ':') + 1) when capture_id like 'hits-R%' and contains(line, ':7:') then '--' || chr(10) else line end as line) from whole)"""
    of_one = "^(?:([^:]*):)?([0-9]+):(.*)$"
    out["search_plan_errors"] = f"{search_plan(mixed, hit=of_one)} select capture_id, case when not bool_and(sound) then 'unsupported_search_format' end plan_error, count(final) hidden, sum(line_no) filter (final is not null) line_sum, count(*) n from ended group by capture_id"
    out["repeated_hits"] = f"""with {HITS}, a as (select *, split_part(rtrim(line, chr(10)), ':', 3) body from lines), b as (select *, case when body is distinct from lag(body) {w} then 1 else 0 end st from a), c as (select *, sum(st) {w} i from b),
      e as (select *, count(*) over (partition by capture_id, i) k, row_number() over (partition by capture_id, i order by line_no) r from c) select capture_id, count(*) filter (capture_id like 'hits-A%' and strlen(body) >= 32 and k >= 12 and r > 2 and r <= k - 2) hidden, count(*) n from e group by capture_id"""
    out["selected_lines"] = f"with {LOGS}, {ranges('log-', 3, 90_000)}, {chosen('lines')} select capture_id, count(*) n, sum(line_no) line_sum from sel where chosen group by capture_id"
    named = f"contains('{GOAL}', lower(split_part(line, ':', 1))) or contains('{GOAL}', lower(split_part(rtrim(line, chr(10)), ':', 3)))"
    out["adaptive_search"] = f"with {HITS}, {ranges('hits-A-', 4, 60_000)}, {chosen('lines')} select capture_id, count(*) filter (not chosen and not contains(line, ':pub fn') and not ({named})) hidden, count(*) n from sel group by capture_id"
    merged = f"{ranges('log-', 3, 90_000)}, {chosen('s10')}, s11 as (select *, case when chosen and r10 = 'long_output_middle' then null else r10 end r11 from sel)"
    out["adaptive_log_reasons"] = f"{output_plan(LOGS).replace(_gaps('s10', 'r10'), merged + ', ' + _gaps('s11', 'r11'))} {by_reason}"
    out["goal_diff_reasons"] = f"""with {PATHS}, {DIFFS}, {LINE_FACTS}, a as (select *, sum(case when starts_with(line, 'diff --git ') then 1 else 0 end) {w} section from l1),
      b as (select *, regexp_extract(first_value(t) over (partition by capture_id, section order by line_no), '^diff --git a/(.*?) b/', 1) path, count(*) over (partition by capture_id, section) size, row_number() over (partition by capture_id, section order by line_no) place from a),
      c as (select *, case when path in ('Cargo.lock') and size > 6 and place > 1 and not {{named}} then 'generated_file_diff' end r2 from b),
      w as (select capture_id, section, left(t, 1) sg, unnest(list_filter(regexp_split_to_array(substr(t, 2), '[^A-Za-z0-9_]+'), lambda x: regexp_matches(x, '^[A-Za-z_]'))) id from c where left(t, 1) in ('+', '-')),
      k as (select capture_id, section, id, bool_or(sg = '-') gone, bool_or(sg = '+') come from w group by all),
      g as (select capture_id, section, string_agg(id, ',' order by id) filter (gone and not come) || '>' || string_agg(id, ',' order by id) filter (come and not gone) sig from k group by all),
      o as (select capture_id, section, min(line_no) at_ from c where section > 0 group by all having count(*) filter (left(t, 1) in ('+', '-')) >= 4 and count(r2) = 0 and not {{part}}),
      e as (select *, count(*) over (partition by capture_id, sig) files, row_number() over (partition by capture_id, sig order by at_) nth from g join o using (capture_id, section)),
      d as (select c.*, coalesce(r2, case when e.files >= 3 and e.nth > 1 and place > 1 then 'same_edit_in_more_files' end) r3 from c left join e using (capture_id, section)),
      {_gaps('d', 'r3')} {by_reason}"""
    few = ranges("diff-", 2, 9_000, "all_ranges") + ", ranges as (select * from all_ranges where lo % 17 = 0)"
    of_files = f"""{few}, {chosen('d')}, p as (select *, bool_or(chosen) over (partition by capture_id, section) picked, capture_id in (select capture_id from ranges) asked from sel),
      m as (select *, case when picked and r3 = 'generated_file_diff' then null else coalesce(r3, case when asked and not picked and place > 1 then 'adaptive_nonselected' end) end r4 from p)"""
    out["adaptive_diff_reasons"] = out["goal_diff_reasons"].replace(_gaps("d", "r3"), of_files + ", " + _gaps("m", "r4")).format(named="false", part="false")
    out["generated_diff_reasons"] = out["goal_diff_reasons"].format(named="false", part="false")
    parts = f"len(list_filter(string_split_regex(lower(min(path)), '[ /]'), lambda x: strlen(x) >= 4 and contains(x, '.') and contains('{GOAL}', x))) > 0"
    out["goal_diff_reasons"] = out["goal_diff_reasons"].format(named=_mention(GOAL, "path"), part=parts)
    return out
