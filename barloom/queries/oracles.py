"""Further SQL for queries of the other modules: recursions as folds over lists, and what needs more than one step."""

from __future__ import annotations

from barloom.functions import days
from barloom.queries.market import BARS, ENDS, frame
from barloom.queries.problems import P2
from barloom.queries.reference import SQL as REFERENCE
from barloom.operators.inference import expected_max
from barloom.queries.search import FASTS, SLOWS, TRIALS

SQL: dict[str, str] = {}

# -- the whole grid: volume of each reading, spread over the slots since the reading before where that is two hours ago or less ---------

GRID_HEAD = P2[: P2.index("f as (")].replace("as x\n  from intraday_bars", "as x, volume, bar_seq\n  from intraday_bars").replace("select symbol, cast(x.d", "select symbol, volume, bar_seq, coalesce(try_cast(x.s as int), 0) as sec, cast(x.d")
SQL["p2_grid"] = f"""{GRID_HEAD}
rd as (select symbol, t, arg_max(coalesce(volume, 0), bar_seq) as v from (select symbol, cast(epoch(ts) as bigint) + sec as t, volume, bar_seq from r where symbol <> '') group by symbol, t),
pr as (select *, lag(t) over (partition by symbol order by t) as p from rd),
gs as (select distinct symbol, step_min, step_min * 60 as step, cast(epoch(slot) as bigint) as s from s),
wd as (select symbol, step_min, day, min(cast(epoch(a) as bigint)) as lo from (select symbol, step_min, a, unnest(range(cast(epoch(a) as bigint) // 86400, (cast(epoch(b) as bigint) - 1) // 86400 + 1)) as day from w) group by all),
nr as (select distinct pr.symbol, t, v, p, step_min, step_min * 60 as step from pr join w on w.symbol = pr.symbol and t >= epoch(a) and t < epoch(b)),
c as (select nr.*, lo, coalesce(t - p <= 7200, false) as near, t // 86400 * 86400 + (t % 86400) // step * step as own, lo // 86400 * 86400 + (lo % 86400) // step * step as low, unnest([t // 86400, t // 86400 - 1]) as sd from nr join wd on wd.symbol = nr.symbol and wd.step_min = nr.step_min and wd.day = t // 86400),
j as (select gs.symbol, gs.step_min, s, v, near, s = own as mine, greatest(0, least(s + gs.step, (s // 86400 + 1) * 86400, t) - greatest(s, p)) as o, greatest(t - p, 1) as span from gs join c on c.symbol = gs.symbol and c.step_min = gs.step_min and s // 86400 = sd where s = own or (near and s >= low and s < t and least(s + gs.step, (s // 86400 + 1) * 86400) > p)),
fl as (select symbol, step_min, s, sum(case when near then v * o / span else v end) as value, sum(case when near then o else 0 end) as covered, sum(case when mine then 1 else 0 end) as n from j group by symbol, step_min, s)
select gs.symbol, gs.step_min, strftime(to_timestamp(gs.s), '%Y-%m-%dT%H:%M') as slot, round(value + 1e-7, 3) as value, cast(coalesce(covered, 0) as bigint) as covered_s, cast(coalesce(n, 0) as bigint) as n_readings, case when coalesce(n, 0) > 0 then 'reading' when coalesce(covered, 0) > 0 then 'covered' else 'missing' end as mark from gs left join fl on fl.symbol = gs.symbol and fl.step_min = gs.step_min and fl.s = gs.s"""

# -- indicators that are folds --------------------------------------------------------------------------------------------------------

mean = lambda xs, n: f"list_avg({xs}[1:{n}])"
fold = lambda xs, n, step: f"case when len({xs}) >= {n} then list_reduce(list_concat([{mean(xs, n)}], {xs}[{n + 1}:]), lambda a, e: {step}) end"
ema = lambda xs, n: fold(xs, n, f"e * (2.0 / {n + 1}) + a * (1 - 2.0 / {n + 1})")
wilder = lambda xs, n: fold(xs, n, f"(a * {n - 1} + e) / {n}")
SQL["ind_keltner"] = f"{BARS}, z as (select symbol, bar_date, list(c) over {frame(65)} as xs, list(tr) filter (where tr is not null) over {frame(64)} as ts from y), q as (select symbol, bar_date, {ema('xs', 20)} as m, {wilder('ts', 20)} as a from z) select symbol, cast(bar_date as varchar) as bar_date, round(m, 6) + 0 as middle, round(m + 2 * a, 6) + 0 as upper, round(m - 2 * a, 6) + 0 as lower from q"
# a running average as a list: every step is kept, so that averages of averages can be taken
running = lambda xs, n, w: f"list_concat(list_transform(range(0, least({n - 1}, len({xs}))), lambda i: null::double), case when len({xs}) >= {n} then list_reduce(list_transform({xs}[{n + 1}:], lambda x: [x]), lambda a, e: list_append(a, e[1] * {w} + a[-1] * (1 - {w})), [{mean(xs, n)}]) else [] end)"
both = lambda f, g: f"list_transform(list_zip({f}, {g}), lambda p: p[1] - p[2])"
SQL["ind_macd"] = f"""{BARS}, z as (select symbol, bar_date, list(c) over {frame(141)} as xs from y), q as (select symbol, bar_date, len(xs) as n, {running('xs', 12, '(2.0 / 13)')} as f, {running('xs', 26, '(2.0 / 27)')} as s from z),
l as (select symbol, bar_date, n, {both('f', 's')} as line from q), m as (select symbol, bar_date, n, line[-1] as line, list_filter(line, lambda x: x is not null) as ls from l), k as (select symbol, bar_date, n, line, {ema('ls', 9)} as sig from m)
select symbol, cast(bar_date as varchar) as bar_date, round(case when n >= 35 then line end, 6) + 0 as line, round(case when n >= 35 then sig end, 6) + 0 as signal, round(case when n >= 35 then line - sig end, 6) + 0 as histogram from k"""
known = lambda xs: f"list_filter({xs}, lambda x: x is not null)"
SQL["ind_trix"] = f"""{BARS}, z as (select symbol, bar_date, list(c) over {frame(70)} as xs from y), q as (select symbol, bar_date, len(xs) as n, {known(running('xs', 15, '(2.0 / 16)'))} as a from z), l as (select symbol, bar_date, n, {known(running('a', 15, '(2.0 / 16)'))} as b from q), m as (select symbol, bar_date, n, {known(running('b', 15, '(2.0 / 16)'))} as d from l)
select symbol, cast(bar_date as varchar) as bar_date, round(case when n >= 47 and d[-2] <> 0 then d[-1] / d[-2] - 1 end, 6) + 0 as value from m"""

summed = lambda xs: f"case when len({xs}) >= 14 then list_reduce(list_transform({xs}[15:], lambda x: [x]), lambda a, e: list_append(a, a[-1] - a[-1] / 14 + e[1]), [list_sum({xs}[1:14])]) else [] end"
moves = lambda x: f"list({x}) filter (where tr is not null) over {frame(65)}"
SQL["ind_adx"] = f"""{BARS}, v as (select *, h - ph as ru, pl - l as rd from y), z as (select symbol, bar_date, {moves('tr')} as ts, {moves('case when ru > rd and ru > 0 then ru else 0 end')} as us, {moves('case when rd > ru and rd > 0 then rd else 0 end')} as ds from v),
q as (select symbol, bar_date, len(ts) as n, {summed('ts')} as t, {summed('us')} as u, {summed('ds')} as d from z), w as (select symbol, bar_date, n, list_transform(list_zip(t, u), lambda x: case when x[1] > 0 then 100 * x[2] / x[1] else 0 end) as p, list_transform(list_zip(t, d), lambda x: case when x[1] > 0 then 100 * x[2] / x[1] else 0 end) as m from q),
k as (select symbol, bar_date, n, p[-1] as p, m[-1] as m, list_transform(list_zip(p, m), lambda x: case when x[1] + x[2] > 0 then 100 * abs(x[1] - x[2]) / (x[1] + x[2]) else 0 end) as dx from w), o as (select symbol, bar_date, n, p, m, {wilder('dx', 14)} as adx from k)
select symbol, cast(bar_date as varchar) as bar_date, round(case when n >= 28 then adx end, 6) + 0 as adx, round(case when n >= 28 then p end, 6) + 0 as plus_di, round(case when n >= 28 then m end, 6) + 0 as minus_di from o"""

# -- search -----------------------------------------------------------------------------------------------------------------------------

SCORED = f"{TRIALS}, ps as (select symbol, fast, slow, round(sharpe, 9) as sharpe from rw where sharpe is not null), rk as (select *, dense_rank() over (partition by symbol order by fast) as rf, dense_rank() over (partition by symbol order by slow) as rs from ps)"
SQL["search_plateau"] = f"""{SCORED}, bs as (select symbol, arg_max(struct_pack(s := sharpe, f := rf, w := rs), struct_pack(s := sharpe, f := rf, w := rs)) as b from rk group by symbol), ne as (select rk.symbol, avg(sharpe) as near, count(*) as neighbours, max(b.s) as best from rk join bs on bs.symbol = rk.symbol where abs(rf - b.f) + abs(rs - b.w) = 1 group by rk.symbol)
select symbol, round(best, 5) + 0 as best, round(near, 5) + 0 as near, neighbours, round(case when best > 0 then greatest(0, least(1, near / best)) end, 5) + 0 as ratio from ne"""
LUCK = "case trials " + " ".join(f"when {k} then {expected_max(1.0, k)!r}" for k in range(2, len(FASTS) * len(SLOWS) + 1)) + " else 0 end"
SQL["search_deflated_sharpe"] = f"""{TRIALS}, m0 as (select symbol, fast, slow, count(r) as n, avg(r) as m, stddev_samp(r) as s from tr group by all having count(r) >= 30 and stddev_samp(r) > 0), m1 as (select tr.symbol, tr.fast, tr.slow, any_value(n) as n, any_value(m / s) as sharpe, avg(pow(r - m, 2)) as v2, avg(pow(r - m, 3)) as v3, avg(pow(r - m, 4)) as v4 from tr join m0 on m0.symbol = tr.symbol and m0.fast = tr.fast and m0.slow = tr.slow group by tr.symbol, tr.fast, tr.slow),
m2 as (select *, lpad(cast(fast as varchar), 3, '0') || '-' || lpad(cast(slow as varchar), 3, '0') as pair, v3 / pow(v2, 1.5) * pow((n - 1.0) / n, 1.5) as skew, v4 / (v2 * v2) * pow((n - 1.0) / n, 2) as kurt from m1),
be as (select symbol, arg_max(struct_pack(pair := pair, n := n, x := sharpe, g3 := skew, g4 := kurt), struct_pack(a := sharpe, b := pair)) as b, coalesce(stddev_samp(sharpe), 0) as spread, count(*) as trials from m2 group by symbol),
va as (select *, 1 - b.g3 * b.x + (b.g4 - 1) / 4 * b.x * b.x as var from be), zs as (select *, case when var > 0 then (b.x - spread * {LUCK}) * sqrt(b.n - 1) / sqrt(var) end as z from va),
cd as (select *, case when z is null then null when abs(z) > 8 then case when z > 0 then 1.0 else 0.0 end else 0.5 + exp(-z * z / 2) / sqrt(2 * pi()) * (list_reduce(list_prepend([z, z], list_transform(range(1, 160), lambda k: [cast(k as double), 0.0])), lambda a, e: [a[1] * z * z / (2 * e[1] + 1), a[2] + a[1] * z * z / (2 * e[1] + 1)]))[2] end as p from zs)
select symbol, b.pair as best, round(b.x, 6) + 0 as sharpe, round(spread, 6) + 0 as spread, trials, round(p, 6) + 0 as deflated from cd"""
SPLIT6 = "sp as (select row_number() over (order by i, j) - 1 as split, i, j from range(6) a(i), range(6) b(j) where i < j)"
CV = f"""{TRIALS}, {SPLIT6}, ln as (select symbol, max(no) + 1 as t from tr group by symbol), tg as (select tr.*, cast(floor(no * 6 / t) as bigint) as g, t from tr join ln on ln.symbol = tr.symbol),
tn as (select *, no < ceil(g * t / 6.0) + 5 as nl, no >= ceil((g + 1) * t / 6.0) - 5 as nri from tg), su as (select symbol, fast, slow, g, nl, nri, count(*) as n, sum(r) as s, sum(r * r) as q from tn group by all),
jn as (select su.*, split, g = i or g = j as test, (g - 1 = i or g - 1 = j) as le, (g + 1 = i or g + 1 = j) as ri from su cross join sp), ag as (select symbol, split, fast, slow, sum(case when not test and not (le and nl or ri and nri) then n else 0 end) as tn, sum(case when not test and not (le and nl or ri and nri) then s else 0 end) as ts, sum(case when not test and not (le and nl or ri and nri) then q else 0 end) as tq, sum(case when test then n else 0 end) as onn, sum(case when test then s else 0 end) as os, sum(case when test then q else 0 end) as oq from jn group by all),
sh as (select *, round(case when (tq - ts * ts / nullif(tn, 0)) / nullif(tn - 1, 0) > 1e-18 then ts / tn / sqrt((tq - ts * ts / tn) / (tn - 1)) * sqrt(252) else -1e9 end, 9) as a, round(case when (oq - os * os / nullif(onn, 0)) / nullif(onn - 1, 0) > 1e-18 then os / onn / sqrt((oq - os * os / onn) / (onn - 1)) * sqrt(252) else -1e9 end, 9) as b from ag),
pk as (select *, row_number() over (partition by symbol, split order by a desc, fast, slow) as pick, rank() over (partition by symbol, split order by b) - 1 as under, count(*) over (partition by symbol, split) as k from sh),
ch as (select symbol, split, fast, slow, case when a > -1e8 then a end as a, case when b > -1e8 then b end as b, under < (k - 1) / 2.0 as below from pk where pick = 1)
"""
SQL["search_combinatorial"] = f"{CV} select symbol, split, fast, slow, round(a, 5) + 0 as train_sharpe, round(b, 5) + 0 as test_sharpe, below from ch"
SQL["search_paths"] = f"{CV}, pa as (select symbol, fast, slow, g, sum(ln(1 + r)) as lg from tg group by all), te as (select split, unnest([i, j]) as g from sp), pj as (select ch.symbol, te.g, lg, row_number() over (partition by ch.symbol, te.g order by ch.split) as path from ch join te on te.split = ch.split join pa on pa.symbol = ch.symbol and pa.fast = ch.fast and pa.slow = ch.slow and pa.g = te.g) select symbol, path, round(exp(sum(lg)) - 1, 5) + 0 as total_return, count(*) as groups from pj group by symbol, path"
# -- reference data, calendars, text -------------------------------------------------------------------------------------------------------

SCORES = REFERENCE["forward_scores"].replace("round(", "(", 0)
SQL["forward_summary"] = f"""{ENDS}, q as (select symbol, bar_date, lead(o) over (partition by symbol order by bar_date) as entry, lead(c, 5) over (partition by symbol order by bar_date) as exit from x), j as (select l.symbol, l.bar_date, q.bar_date as seen, q.entry, q.exit from l asof left join q on l.symbol = q.symbol and l.bar_date >= q.bar_date),
s as (select exit / entry - 1 as r from j where seen is not null and entry is not null and exit is not null), g as (select count(*) as n, avg(case when r > 0 then 1.0 else 0.0 end) as hits, avg(r) as mean, stddev_samp(r) as sd from s)
select n, round(hits, 6) + 0 as hits, round(mean, 6) + 0 as mean, round(sd, 6) + 0 as sd, round(mean / nullif(sd, 0) * sqrt(n), 6) + 0 as t, cast(ceil(pow(2 * sd / nullif(mean, 0), 2)) as bigint) as needed from g"""
CLOSED = ", ".join(f"(date '{h}')" for y in range(2019, 2024) for h in sorted(days.holidays(y)))
SQL["calendar_trading_days"] = f"with h as (select * from (values {CLOSED}) v(day)), d as (select cast(g as date) as day from generate_series(timestamp '2019-01-01', timestamp '2023-12-31', interval 1 day) t(g)) select cast(day as varchar) as day, row_number() over (order by day) - 1 as no from d where isodow(day) < 6 and day not in (select day from h)"
SQL["fn_ticker"] = r"select call_id, nullif(regexp_extract(prompt, '(?:^|[^A-Za-z0-9.$])\$?([A-Z][A-Z0-9]{1,4}(?:[.-][A-Z])?)(?:[^A-Za-z0-9]|$)', 1), '') as ticker from ai_calls"
SQL["fn_normal_cdf"] = "with x as (select event_id, (value - 50) / 20 as x from events), t as (select *, 1 / (1 + 0.2316419 * abs(x)) as t from x), p as (select *, exp(-x * x / 2) / sqrt(2 * pi()) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))) as tail from t) select event_id, round(case when x >= 0 then 1 - tail else tail end, 5) as p from p"
SQL["fn_fnv32"] = "select symbol, cast(list_reduce(list_prepend(2166136261::hugeint, list_transform(string_split(upper(symbol), ''), lambda x: ascii(x)::hugeint)), lambda h, b: (xor(h, b) * 16777619) % 4294967296) as bigint) as value from series"
# keeps what moved over 5 % from the last one kept, by a fold over the sorted list; the last one stays too
SQL["source_compressed"] = f"""{BARS}, xs as (select symbol, list(struct_pack(d := bar_date, v := close) order by bar_date) as xs from b group by symbol),
k as (select symbol, xs[-1] as z, list_reduce(list_transform(xs[2:], lambda x: [x]), lambda a, e: case when a[-1].v = 0 or abs(e[1].v / a[-1].v - 1) > 0.05 then list_append(a, e[1]) else a end, [xs[1]]) as ks from xs), o as (select symbol, unnest(case when ks[-1].d = z.d then ks else list_append(ks, z) end) as x from k)
select symbol, cast(x.d as varchar) as bar_date, x.v as close from o"""
QUERIES: dict = {}
