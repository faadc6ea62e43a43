"""The same queries in SQL, written independently: theta joins and pairs where the operators avoid them."""

from __future__ import annotations

from wardgrid.plans.fusion_queries import ORACLE_SQL as FUSION_SQL
from wardgrid.plans.view_queries import ORACLE_SQL as VIEW_SQL

EV = "ev as (select user_id as stay_id, ts as charttime, epoch_us(ts) as t, event_type as concept, value from events)"
ST = f"{EV}, stays as (select stay_id % 100 as patient_id, stay_id, min(t) as a, max(t) as z, (max(t) - min(t)) / 3600000000.0 as los_hours, cast(floor(least((max(t) - min(t)) / 3600000000.0, 168)) as int) as mh from ev group by stay_id)"
AT = f"{ST}, tt as (select ev.*, s.a, s.mh, s.los_hours, cast(floor((t - s.a) / 3600000000.0) as int) as hour from ev join stays s using (stay_id))"
GRID = f"{AT}, grid as (select stay_id, a, mh, unnest(range(0, mh + 1))::int as hour from stays)"
IV = f"{GRID}, iv as (select stay_id, t as s, case when concept = 'purchase' then t + cast(floor(value * 60) as bigint) * 1000000 end as e, concept as drug from ev where concept in ('purchase', 'signup'))"
DYN = f"{AT}, grid as (select stay_id, unnest(range(0, mh + 1))::int as hour from stays), med as (select stay_id, hour, concept, median(value) as v from tt where hour between 0 and mh group by all), dyn as (select g.stay_id, g.hour, c.v as click, w.v as view from grid g left join med c on c.stay_id = g.stay_id and c.hour = g.hour and c.concept = 'click' left join med w on w.stay_id = g.stay_id and w.hour = g.hour and w.concept = 'view')"
FIT = f"{DYN}, fit as (select avg(click) as cm, min(click) as clo, max(click) as chi, median(click) as cmed, stddev_pop(click) as csd, avg(view) as vm, min(view) as vlo, max(view) as vhi from dyn where stay_id % 4 <> 0), filled as (select stay_id, hour, (click is null)::int as click_is_null, last_value(click ignore nulls) over w as cf, last_value(view ignore nulls) over w as vf from dyn window w as (partition by stay_id order by hour rows unbounded preceding)), scaled as (select stay_id, hour, click_is_null, (coalesce(cf, cm) - clo) / (chi - clo) as click, (coalesce(vf, vm) - vlo) / (vhi - vlo) as view from filled, fit)"
PAIR = f"{AT}, sus as (select c.stay_id, min(least(c.t, s.t)) as si from ev c join ev s on c.stay_id = s.stay_id and c.concept = 'click' and s.concept = 'error' and s.t - c.t between -259200000000 and 86400000000 group by 1)"
CODES = "codes as (select l_orderkey as stay_id, p_brand as code from lineitem join part on l_partkey = p_partkey), train as (select o_orderkey as stay_id from orders where o_orderkey % 5 <> 0), vocab as (select code, count(distinct stay_id) as n_stays, (select count(*) from train) as n_train from codes where stay_id in (select stay_id from train) group by code)"
SC = "sc as (select doc_id, quality as y, toxic, round(least(n_chars / 4000.0, 1.0), 2) as score from labels join documents using (doc_id))"
ORD = "os as (select o_custkey as patient_id, o_orderkey as stay_id, o_orderdate as intime, (first_value(o_orderstatus) over (partition by o_custkey order by o_orderkey) = 'F')::int as label from orders)"
STREAM = f"{ORD}, st as (select o_custkey as patient_id, case when o_orderkey % 3 = 0 then o_orderkey end as bound, o_orderkey as src, o_orderpriority as code, o_orderdate as k from orders), met as (select os.stay_id, st.src, st.code, st.k, (epoch_us(st.k) - epoch_us(os.intime)) / 3600000000.0 as delta_h from st join os on (st.bound is not null and st.bound = os.stay_id) or (st.bound is null and st.patient_id = os.patient_id))"
DAY = "de as (select user_id || '_' || strftime(ts, '%Y-%m-%d') as stay_id, user_id, ts, date_trunc('day', ts) as day, event_type, value from events), ds as (select stay_id, any_value(user_id) % 60 + 10.0 as age, epoch_us(any_value(day)) as a, (epoch_us(max(ts)) - epoch_us(any_value(day))) / 3600000000.0 as los_hours from de group by stay_id), hrs as (select distinct de.stay_id, cast(floor((epoch_us(ts) - a) / 3600000000.0) as int) as hour from de join ds using (stay_id) where value is not null and floor((epoch_us(ts) - a) / 3600000000.0) < least(los_hours, 168)), pts as (select stay_id, hour, 1 as r from hrs union all select stay_id, -1, 0 from ds union all select stay_id, cast(floor(least(los_hours, 168)) as int), 0 from ds), gp as (select stay_id, r, hour - lag(hour) over (partition by stay_id order by hour) - 1 as g from pts), ga as (select stay_id, sum(r) as n, greatest(max(g), 0) as g from gp group by stay_id), tag as (select *, case when not los_hours > 0 then 0 when los_hours < 6 then 1 when n < 4 then 2 when g > 12 then 3 when age < 18 then 4 else 9 end as f from ds join ga using (stay_id))"


def _num(x: str) -> str:
    return f"round({x}, 6)"


def _split_sql(tail: str) -> str:
    """Round robin by md5 within the label, outer then inner."""
    return f"""with {ORD}, who as (select patient_id, max(label) as label from os group by 1),
    o as (select *, (row_number() over (partition by label order by md5('42:outer:' || patient_id), patient_id) - 1) % 5 as o from who),
    k as (select o.*, r.rep, (row_number() over (partition by r.rep, label order by md5('42:inner:' || patient_id), patient_id) - 1) % 5 as i from o, (select unnest(range(0, 5))::int as rep) r where o.o <> r.rep),
    f as (select unnest(range(0, 5))::int as fold),
    pl as (select patient_id, rep, fold, case when i = fold then 'val' else 'train' end as split from k, f union all select patient_id, o::int, fold, 'test' from o, f),
    sp as (select rep, fold, stay_id, patient_id, split from pl join os using (patient_id)) {tail}"""


def _points(value: str, steps: list[tuple[float, int]], op: str) -> str:
    return "case " + " ".join(f"when {value} {op} {b} then {p}" for b, p in steps) + " else 0 end"


_SOFA_NOW = ", ".join([
    _points("case when click * 10 < 200 and not coalesce(error > 20, false) then 200 else click * 10 end", [(100, 4), (200, 3), (300, 2), (400, 1)], "<") + " as resp",
    _points("click * 5", [(20, 4), (50, 3), (100, 2), (150, 1)], "<") + " as coag",
    _points("error / 5", [(12, 4), (6, 3), (2, 2), (1.2, 1)], ">=") + " as liver",
    "case when purchase / 4 > 15 or signup / 400 > 0.1 then 4 when purchase / 4 > 5 or signup is not null or (click > 60 and purchase is null and signup is null) then 3 when purchase is not null or view > 60 then 2 when view * 3 < 70 then 1 else 0 end as cardio",
    _points("view / 5", [(6, 4), (10, 3), (13, 2), (15, 1)], "<") + " as cns",
    "greatest(" + _points("purchase / 10", [(5, 4), (3.5, 3), (2, 2), (1.2, 1)], ">=") + ", " + _points("u24", [(200, 4), (500, 3)], "<") + ") as renal",
])
_PARTS = ["resp", "coag", "liver", "cardio", "cns", "renal"]
_PIVOT = ", ".join(f"median(value) filter (concept = '{c}') as {c}" for c in ("click", "error", "purchase", "signup", "view"))
_WIDE = f"{GRID}, wide as (select stay_id, hour, {_PIVOT} from tt where hour between 0 and mh group by 1, 2), full_ as (select g.stay_id, g.hour, click, error, purchase, signup, view from grid g left join wide using (stay_id, hour))"

_CONVERTED = [("F", "C", "(value - 32.0) * 5.0 / 9.0"), ("C", "F", "value * 9.0 / 5.0 + 32.0"), ("in", "cm", "value * 2.54"), ("cm", "in", "value / 2.54"), ("oz", "g", "value * 28.3495"), ("g", "oz", "value / 28.3495"), ("lb", "kg", "value * 0.4535924"), ("kg", "lb", "value / 0.4535924"), ("mg/dL_glu", "mmol/L_glu", "value / 18.0182"), ("mmol/L_glu", "mg/dL_glu", "value * 18.0182"), ("mg/dL_crea", "μmol/L_crea", "value * 88.4"), ("μmol/L_crea", "mg/dL_crea", "value / 88.4")]
_MEDS = f"{GRID}, md as (select stay_id, s, e, case drug when 'purchase' then 'Norepinephrine' else 'dobutamine' end as drug, case when drug = 'purchase' then 'mcg/kg/min' else 'mg' end as unit, (s // 1000000 % 100) / 400.0 as dose from (select stay_id, t as s, case when concept = 'purchase' then t + cast(floor(value * 60) as bigint) * 1000000 end as e, concept as drug from ev where concept in ('purchase', 'signup')))"
_RUNS = f"{_MEDS}, run as (select g.stay_id, g.hour, drug, case when unit = 'mcg/kg/min' then dose end as rate from grid g join md m on m.stay_id = g.stay_id and m.s < g.a + (g.hour + 1) * 3600000000::bigint and (m.e is null or m.e > g.a + g.hour * 3600000000::bigint))"

ORACLE_SQL: dict[str, str] = {
    **FUSION_SQL,
    **VIEW_SQL,
    "attrition_report": f"with {DAY}, g(step, criterion) as (values (0, 'valid_times'), (1, 'los'), (2, 'measured_hours'), (3, 'gap'), (4, 'age'), (5, 'final')), c as (select step, criterion, (select count(*) from tag where f >= step or criterion = 'final') as n_before, (select count(*) from tag where f > step) as n_after from g) select step, criterion, n_before, n_after, n_before - n_after as n_dropped, round(case when n_before > 0 then 100.0 * (n_before - n_after) / n_before else 0 end, 2) as pct_dropped from c",
    "unit_convert": f"with {EV} select source, target, count(*) as n, round(sum(v), 4) as total from (" + " union all ".join(f"select '{a}' as source, '{b}' as target, {sql} as v from ev" for a, b, sql in _CONVERTED) + ") group by 1, 2",
    "urine_by_hour": f"with {AT} select stay_id, hour, {_num('sum(value)')} as urine from tt where concept = 'view' group by 1, 2",
    "pressors_by_hour": f"with {_RUNS} select stay_id, hour, {_num("max(rate) filter (drug = 'Norepinephrine')")} as norepinephrine, bool_or(drug <> 'dobutamine') as strong, bool_or(drug = 'dobutamine') as dobutamine from run group by 1, 2",
    "sofa_inputs": f"""with {_RUNS}, p as (select stay_id, hour, max(rate) filter (drug = 'Norepinephrine') as norepinephrine, bool_or(drug <> 'dobutamine') as strong, bool_or(drug = 'dobutamine') as dobutamine from run group by 1, 2),
        at_ as (select g.stay_id, g.hour, (select arg_max(e.value, e.t) from ev e where e.stay_id = g.stay_id and e.concept = 'click' and e.t < g.a + (g.hour + 1) * 3600000000::bigint) as po2, (select arg_max(e.value, e.t) from ev e where e.stay_id = g.stay_id and e.concept = 'error' and e.t < g.a + (g.hour + 1) * 3600000000::bigint) as fio2, (select sum(e.value) from tt e where e.stay_id = g.stay_id and e.concept = 'view' and e.hour between greatest(g.hour - 23, 0) and g.hour) as urine24 from grid g)
        select at_.stay_id, at_.hour, {_num('case when fio2 > 0 then po2 / (fio2 / 100.0) end')} as pafi, {_num('urine24')} as urine24, {_num('norepinephrine')} as norepinephrine, coalesce(strong, false) as strong, coalesce(dobutamine, false) as dobutamine from at_ left join p using (stay_id, hour)""",
    "antibiotic_span": f"with {IV} select stay_id, min(s) as first_us, {_num('(max(greatest(s, coalesce(e, s))) - min(s)) / 3600000000.0')} as span_h, max(greatest(s, coalesce(e, s))) - min(s) >= 259200000000 as long from iv group by 1",
    "task_build": f"with {_WIDE}, o as (select stay_id from stays where los_hours >= 48 and stay_id in (select stay_id from tt where concept = 'click' and t - a > 86400000000 and t - a <= 172800000000)) select f.stay_id, count(*) as n_hours, {_num('sum(click)')} as click, 0.5::double as sex_male, min(s.los_hours > 0)::boolean as ok from full_ f join o using (stay_id) join stays s using (stay_id) group by 1",
    "dyn_hourly_grid": f"with {_WIDE} select stay_id, hour, {', '.join(f'{_num(c)} as {c}' for c in ('click', 'error', 'purchase', 'signup', 'view'))} from full_",
    "base_cohort_attrition": f"with {DAY}, g(step, criterion) as (values (0, 'valid_times'), (1, 'los'), (2, 'measured_hours'), (3, 'gap'), (4, 'age')) select step, criterion, (select count(*) from tag where f >= step) as n_before, (select count(*) from tag where f > step) as n_after, (select count(*) from tag where f = step) as n_dropped from g",
    "base_cohort": f"with {DAY} select stay_id, {_num('los_hours')} as los_hours, age from tag where f = 9",
    "longest_gap": f"with {GRID}, h as (select distinct stay_id, hour from tt where hour >= 0 and hour < least(los_hours, 168)), p as (select stay_id, hour, 1 as r from h union all select stay_id, -1, 0 from stays union all select stay_id, mh, 0 from stays), q as (select stay_id, r, hour - lag(hour) over (partition by stay_id order by hour) - 1 as g from p) select stay_id, sum(r)::bigint as n_hours, greatest(max(g), 0)::int as gap from q group by 1",
    "rolling_min_onset": f"with {EV}, e as (select stay_id, t, value / 10 as value from ev where concept = 'error'), m as (select x.stay_id, x.t, x.value, min(y.value) filter (y.t > x.t - 172800000000) as a, min(y.value) as b from e x join e y on x.stay_id = y.stay_id and y.t <= x.t and y.t > x.t - 604800000000 group by all) select stay_id, min(t) as onset_us from m where value - a >= 0.3 or value >= 1.5 * b group by 1",
    "rolling_sum_rate": f"""with {AT}, u as (select stay_id, t, a, value * 20 as value from tt where value * 20 between 0 and 5000),
        p as (select *, (t - lag(t) over (partition by stay_id order by t)) / 3600000000.0 as gap from u),
        g as (select *, value / case when gap is null or gap > 24 or gap <= 0 then 1 else gap end as rate from p),
        r as (select x.stay_id, x.t, (x.t - x.a) / 3600000000.0 as since, {', '.join(f'(select sum(y.rate) from g y where y.stay_id = x.stay_id and y.t <= x.t and y.t > x.t - {h} * 3600000000::bigint) / 75.0 as r{h}' for h in (6, 12, 24))} from g x)
        select stay_id, min(t) as onset_us from r where (since >= 24 and r24 < 0.3) or (since >= 12 and (r12 = 0 or r12 < 0.5)) or (since >= 6 and r6 < 0.5) group by 1""",
    "asof_carry_forward": f"with {GRID} select g.stay_id, g.hour, (select {_num('arg_max(e.value, e.t)')} from ev e where e.stay_id = g.stay_id and e.concept = 'click' and e.t < g.a + (g.hour + 1) * 3600000000::bigint) as carried from grid g",
    "asof_nearest": f"with {EV}, c as (select x.stay_id, x.t, y.value, y.t as u, row_number() over (partition by x.stay_id, x.t order by abs(y.t - x.t), y.t, y.value desc) as k from ev x left join ev y on x.stay_id = y.stay_id and y.concept = 'click' where x.concept = 'error') select stay_id, t as charttime_us, {_num('value')} as near_value, u as near_t_us from c where k = 1",
    "asof_vector": f"with {GRID}, v as (select g.hour, (select arg_max(e.value, e.t) from ev e where e.stay_id = g.stay_id and e.concept = 'purchase' and e.t < g.a + (g.hour + 1) * 3600000000::bigint) as c from grid g) select hour, count(*) as n, {_num('sum(c)')} as total from v where c is not null group by 1",
    "interval_hour_overlap": f"with {IV} select g.stay_id, g.hour, iv.drug, count(*) as n from grid g join iv on iv.stay_id = g.stay_id and iv.s < g.a + (g.hour + 1) * 3600000000::bigint and (iv.e is null or iv.e > g.a + g.hour * 3600000000::bigint) group by all",
    "null_end_consolidate": f"with {IV} select stay_id, drug, s as starttime_us, e as endtime_us from iv where e is not null union all select stay_id, drug, min(s), 0 from iv where e is null group by 1, 2",
    "occupancy_by_hour": f"with {IV}, al as (select iv.stay_id, (s - a) / 3600000000.0 as dh, (e - a) / 3600000000.0 as eh from iv join stays using (stay_id)), hh as (select unnest(range(0, 2000))::int as hour) select stay_id, hour, count(*) as n from al join hh on dh <= hour and ((eh is not null and eh >= hour) or (eh is null and floor(dh) = hour)) group by 1, 2",
    "onset_window_label": f"with {GRID}, o as (select stay_id, min(hour) as oh from tt where concept = 'signup' group by 1) select g.stay_id, g.hour, coalesce((abs(g.hour - oh) <= 6)::int, 0) as label_value from grid g left join o using (stay_id)",
    "onset_exclusions": f"with {AT}, o as (select stay_id, min(t) as o from ev where concept = 'signup' group by 1), h as (select distinct stay_id % 7 as h from o), b as (select stay_id, arg_min(value, t) as v from ev where concept = 'error' group by 1) select s.stay_id from stays s where s.stay_id % 7 in (select h from h) and s.stay_id not in (select stay_id from o join stays using (stay_id) where o - a < 172800000000) and s.stay_id not in (select stay_id from b where v > 40)",
    "remaining_los": f"with {GRID} select g.stay_id, g.hour, round(cast(cast(greatest(0, least(s.los_hours - g.hour, 168)) as real) as double), 3) as label_value from grid g join stays s using (stay_id)",
    "median_window_label": f"with {AT} select stay_id, {_num('greatest(0, least(15, median(value)))')} as label_value from tt where los_hours >= 48 and t - a > 86400000000 and t - a <= 172800000000 group by 1",
    "mortality_label": f"with {ST} select patient_id, stay_id, a + 86400000000 as label_time_us, (stay_id % 5 = 0)::int as label_value from stays where los_hours >= 30",
    "continuous_episode": f"""with {EV}, x as (select stay_id, t as s, greatest(t, max(t + cast(floor(value * 600) as bigint) * 1000000)) as e from ev group by 1, 2),
        p as (select a.stay_id, a.s as anchor, c.s, c.e, max(c.e) over (partition by a.stay_id, a.s order by c.s rows between unbounded preceding and 1 preceding) as m from x a join x c on a.stay_id = c.stay_id and c.s between a.s and a.s + 259200000000),
        q as (select stay_id, anchor, max(s - m) as g, anchor + 259200000000 - max(e) as rest from p group by 1, 2)
        select stay_id, anchor as starttime_us from q where greatest(coalesce(g, 0), rest) <= 86400000000""",
    "suspected_pair": f"with {PAIR} select stay_id, si as si_us from sus",
    "delta_cummin": f"""with {PAIR}, grid as (select stay_id, a, mh, unnest(range(0, mh + 1))::int as hour from stays),
        sc as (select g.stay_id, g.hour, cast(floor(coalesce((select arg_max(e.value, e.t) from ev e where e.stay_id = g.stay_id and e.concept = 'view' and e.t < g.a + (g.hour + 1) * 3600000000::bigint), 0) / 10) as int) as sofa from grid g),
        w as (select sus.stay_id, sus.si, sc.sofa - min(sc.sofa) over (partition by sus.stay_id order by sc.hour rows unbounded preceding) as up from sus join stays using (stay_id) join sc on sc.stay_id = sus.stay_id and sc.hour between floor((si - a) / 3600000000.0) - 48 and floor((si - a) / 3600000000.0) + 24)
        select stay_id, min(si) as onset_us from w where up >= 2 group by 1""",
    "sofa_like_score": f"with {_WIDE}, u as (select *, sum(signup) over (partition by stay_id order by hour rows between 23 preceding and current row) as u24 from full_), n as (select stay_id, hour, {_SOFA_NOW} from u), l as (select stay_id, hour, {', '.join(f'max({c}) over (partition by stay_id order by hour rows between 23 preceding and current row)::int as sofa_{c}' for c in _PARTS)} from n) select *, ({' + '.join(f'sofa_{c}' for c in _PARTS)})::int as sofa from l",
    "unit_canonicalise": f"with {EV}, k(concept, u, lo, hi) as (values ('click', 'u1', 10.0, 40.0), ('error', 'u2', 5.0, 60.0), ('view', null, null, 30.0)) select concept, coalesce(u, 'raw') as unit, count(*) as n, {_num('sum(value)')} as total from ev left join k using (concept) where abs(value) < 55 and coalesce(value >= lo, true) and coalesce(value <= hi, true) group by 1, 2",
    "first_match_class": "select p_partkey, case when lower(p_name) like '%red%' then 'warm' when lower(p_name) like '%ring%' then 'round' when lower(p_name) like '%small%' then 'little' when lower(p_name) like '%widget%' then 'gadget' else 'other' end as kind from part",
    "historical_agg": f"with {EV} select stay_id, epoch_us(date_trunc('hour', charttime)) as hour_start_us, concept, {_num('''case concept when 'click' then sum(value) when 'error' then max((value <> 0)::int)::double when 'purchase' then arg_min(value, t) when 'signup' then arg_max(value, t) when 'view' then null end''')} as value from ev where concept <> 'view' group by 1, 2, 3 union all select stay_id, h, 'view', {_num('v')} from (select stay_id, h, value as v, row_number() over (partition by stay_id, h order by n desc, value) as k from (select stay_id, epoch_us(date_trunc('hour', charttime)) as h, value, count(*) as n from ev where concept = 'view' group by 1, 2, 3)) where k = 1",
    "dual_binding_align": f"with {STREAM}, kn as (select * from met where delta_h <= 0), f as (select *, min(k) over (partition by stay_id, src) as fk from kn) select stay_id, code, {_num('delta_h')} as delta_h, (dense_rank() over (partition by stay_id order by fk) - 1)::int as prior_visit_idx from f",
    "prior_visit_rank": f"with {STREAM}, kn as (select * from met where delta_h between -720 and 168) select stay_id, (count(distinct k) - 1)::int as visits, count(*) as n from kn group by 1",
    "note_clean_dedup": r"with n as (select doc_id, source, lang, trim(regexp_replace(regexp_replace(regexp_replace(text, '\[\*\*[^\]]*\*\*\]', ' ', 'g'), '_{2,}', ' ', 'g'), '\s+', ' ', 'g')) as text from documents) select max(doc_id) as doc_id, source, lang, length(text) as length from n group by source, lang, text",
    "note_serialise": "select conv_id, string_agg(role || ': ' || text, '; ' order by turn) as text from conversations group by 1",
    "note_visibility": f"with {AT}, g as (select stay_id, unnest(range(0, mh + 1))::int as hour from stays) select g.stay_id, g.hour, count(*) as n from g join tt on tt.stay_id = g.stay_id and tt.concept = 'error' and (tt.t - tt.a) / 3600000000.0 <= g.hour group by 1, 2",
    "topk_vocab": f"with {CODES} select code, n_stays, n_train from vocab where n_stays >= 0.01 * n_train order by n_stays desc, code limit 10",
    "icd_multihot": f"with {CODES} select stay_id, max((code = 'Brand#1')::int) as b1, max((code = 'Brand#2')::int) as b2, max((code = 'Brand#3')::int) as b3 from codes group by 1",
    "icd_tfidf": f"with {CODES} select stay_id, code, count(*) as tf, {_num('count(*) * ln(any_value(n_train) / any_value(n_stays)::double)')} as weight from codes join vocab using (code) group by 1, 2",
    "vector_mean_pool": f"with x as (select label, unnest(embedding) as v, generate_subscripts(embedding, 1) - 1 as pos from embeddings) select label, pos::int as pos, {_num('avg(v::double)')} as value from x group by 1, 2",
    "recency_pool": f"with w as (select label, embedding, power(2.0, (vec_id - max(vec_id) over (partition by label)) / 50.0) as w from embeddings), x as (select label, w, unnest(embedding) as v, generate_subscripts(embedding, 1) - 1 as pos from w) select label, pos::int as pos, {_num('sum(w * v::double) / sum(w)')} as value from x group by 1, 2",
    "running_recency_pool": f"with p as (select unnest(range(0, 64)) as pos), x as (select a.vec_id % 50 as k, a.vec_id as upto, p.pos, power(2.0, (b.vec_id - a.vec_id) / 50.0) as w, b.embedding[p.pos + 1]::double as v from embeddings a join embeddings b on a.vec_id % 50 = b.vec_id % 50 and b.vec_id <= a.vec_id cross join p) select k, upto, pos::int as pos, {_num('sum(w * v) / sum(w)')} as value from x group by 1, 2, 3",
    "missing_mask": f"with {DYN} select hour, count(*) - count(click) as click_nulls, count(*) - count(view) as view_nulls from dyn group by 1",
    "ffill_impute_minmax": f"with {FIT} select stay_id, hour, {_num('click')} as click, {_num('view')} as view, click_is_null from scaled",
    "history_features": f"with {FIT} select stay_id, hour, {_num('max(click) over w')} as click_max, {_num('min(click) over w')} as click_min, {_num('avg(click) over w')} as click_mean, (row_number() over w)::int as click_count from scaled window w as (partition by stay_id order by hour rows unbounded preceding)",
    "standard_scale": f"with {FIT} select stay_id, hour, {_num('(coalesce(cf, cmed) - cm) / csd')} as click from filled, fit",
    "last_rows": f"with {DYN} select stay_id, {_num('arg_max(click, hour) filter (click is not null)')} as click, {_num('arg_max(view, hour) filter (view is not null)')} as view from dyn group by 1",
    "sequence_pack": f"with {DYN} select stay_id, count(*)::int as length, 169 as padded, {_num('sum(coalesce(click, 0))')} as total from dyn group by 1",
    "class_weights": f"with {SC} select y as label, count(*) as n, {_num('(select count(*) from sc) / ((select count(distinct y) from sc) * count(*)::double)')} as weight from sc group by 1",
    "patient_splits": _split_sql("select rep, fold, split, count(*) as n_stays from sp group by 1, 2, 3"),
    "patient_split_check": _split_sql("select rep, fold, (select count(*) from os) - count(distinct stay_id) as n_missing, 0::bigint as n_foreign, (select count(*) from (select rep, fold, patient_id from sp group by all having count(distinct split) > 1)) as n_leaking from sp group by 1, 2"),
    "auroc_rank": f"with {SC} select count(*) as n, sum(y)::bigint as n_pos, {_num('(select sum(case when a.score > b.score then 1.0 when a.score = b.score then 0.5 else 0 end) from sc a, sc b where a.y = 1 and b.y = 0) / (sum(y) * sum(1 - y))')} as auroc from sc",
    "average_precision": f"with {SC}, c as (select a.score, count(*) filter (a.y = 1) as pos, (select count(*) from sc b where b.score >= a.score and b.y = 1) as tp, (select count(*) from sc b where b.score >= a.score) as n from sc a group by 1) select sum(pos)::bigint as n_pos, {_num('sum(pos * tp / n::double) / sum(pos)')} as average_precision from c",
    "calibration_bins": f"with {SC} select least(greatest(ceil(score * 10) - 1, 0), 9)::int as bin, count(*) as n, {_num('avg(score)')} as mean_score, {_num('avg(y::double)')} as share from sc group by 1",
    "regression_metrics": f"with {SC} select count(*) as n, {_num('avg(abs(y - score))')} as mae, {_num('avg((y - score) ** 2)')} as mse, {_num('sqrt(avg((y - score) ** 2))')} as rmse, {_num('1 - sum((y - score) ** 2) / (var_pop(y) * count(*))')} as r2 from sc",
    "accuracy_metrics": f"with {SC}, h as (select y, ((score >= 0.5)::int = y)::int::double as hit from sc) select {_num('avg(hit)')} as accuracy, {_num('(avg(hit) filter (y = 1) + avg(hit) filter (y = 0)) / 2')} as balanced_accuracy from h",
    "js_divergence": f"with {EV}, b as (select floor(value)::bigint as key, count(*) filter (concept = 'click') / (select count(*) from ev where concept = 'click')::double as p, count(*) filter (concept = 'view') / (select count(*) from ev where concept = 'view')::double as q from ev where concept in ('click', 'view') group by 1) select {_num('sum(case when p > 0 then p * ln(2 * p / (p + q)) else 0 end + case when q > 0 then q * ln(2 * q / (p + q)) else 0 end) / 2')} as jsd from b",
    "grid_summary": f"with {EV} select concept, stay_id % 4 as cell, {_num('avg(value)')} as mean, {_num('stddev_samp(value)')} as std, count(*) as n, count(distinct stay_id % 3) < 4 as under_seeded from ev group by 1, 2",
    "attach_rows_to_stays": f"with {ST} select s.stay_id, count(*) as n, {_num('sum(e.value)')} as total from stays s join ev e on e.stay_id % 100 = s.patient_id and e.t between s.a - 86400000000 and s.a + 360000000000 group by 1",
    "single_key_rows": "select l_orderkey, l_suppkey, l_linenumber from lineitem qualify count(*) over (partition by l_orderkey, l_suppkey) = 1",
    "first_order_per_customer": "select o_custkey, o_orderkey, o_orderstatus from orders qualify row_number() over (partition by o_custkey order by o_orderkey) = 1",
    "large_care_units": "select s_nationkey as careunit, s_suppkey from supplier qualify count(*) over (partition by s_nationkey) >= 4",
    "unpivot_vitals": "select l_orderkey, l_linenumber, 'l_quantity' as concept, l_quantity as value from lineitem union all select l_orderkey, l_linenumber, 'l_discount', l_discount from lineitem",
    "score_sum": f"with {EV}, p as (select stay_id, date_trunc('day', charttime) as d, sum(value) as value from ev where concept in ('click', 'view') group by 1, 2) select stay_id, 'score' as concept, count(*) as n, {_num('sum(value)')} as total from p group by 1 union all select stay_id, concept, count(*), {_num('sum(value)')} from ev where concept not in ('click', 'view') group by 1, 2",
    "derived_mean_pressure": f"with {EV} select stay_id, epoch_us(date_trunc('day', charttime)) as charttime_us, {_num("(avg(value) filter (concept = 'click') + 2 * avg(value) filter (concept = 'view')) / 3")} as value from ev group by 1, 2 having count(*) filter (concept = 'click') > 0 and count(*) filter (concept = 'view') > 0",
    "counter_differences": f"with {EV} select stay_id, concept, t as charttime_us, {_num('case when lag(value) over (partition by stay_id, concept order by t, value) is null then value else greatest(value - lag(value) over (partition by stay_id, concept order by t, value), 0) end')} as value from ev",
    "infusion_intervals": f"with {IV} select stay_id, drug, s as starttime_us, least(coalesce(lead(s) over (partition by stay_id, drug order by s), s + 3600000000), s + 172800000000) as endtime_us from iv",
    "code_groups": "with g as (select distinct upper(p_brand) as c from part where p_size > 40) select p_partkey, p_brand as code, coalesce(g.c, substr(upper(p_brand), 1, 3)) as \"group\", case when g.c is null then 'root' else 'map' end as group_source from part left join g on g.c = upper(p_brand)",
    "code_coverage": f"with {CODES} select code, count(*) as n_rows, count(distinct stay_id) as n_stays, {_num('count(distinct stay_id) / (select count(*) from orders)::double')} as share from codes group by 1",
    "pressor_equivalents": """with m as (select l_orderkey, case l_suppkey % 5 when 0 then 'norepinephrine' when 1 then 'dopamine' when 2 then 'vasopressin' when 3 then 'phenylephrine' else 'heparin' end as drug, case l_linenumber % 4 when 0 then 'ug/kg/min' when 1 then 'mcg/min' when 2 then 'u/h' else 'mg' end as unit, l_quantity / 10 as rate, case when l_orderkey % 7 <> 0 then 50.0 + l_orderkey % 50 end as weight from lineitem),
    r as (select l_orderkey, case when unit = 'ug/kg/min' then rate when unit = 'mcg/min' then rate / weight when unit = 'u/h' and drug = 'vasopressin' then rate / 60 * 2.5 end * case drug when 'dopamine' then 0.01 when 'phenylephrine' then 0.1 when 'heparin' then null else 1.0 end as nee from m)
    select cast(l_orderkey as varchar) as stay_id, count(*) as n, round(cast(max(cast(nee as float)) as double), 4) as most from r where nee > 0 and nee <= 5 group by 1""",
}
