"""Registered queries of the modality blocks and of treatments from raw signals, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardgrid.operators import fusion, streams
from wardgrid.operators import timegrid as tg
from wardgrid.operators.align import hours_since
from wardgrid.plans.adapters import codes, events, r6, stays, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ROLES = {"click": "peep", "error": "insulin", "purchase": "vasopressor", "signup": "antibiotic", "view": "mech_vent"}
HALF_LIFE = 24.0


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _notes(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Vectors as notes of 23 stays, their vectors, the train stays and an hourly grid of two days."""
    e = table(s, d, "embeddings").where("vec_id is not null")
    notes = e.select((F.col("vec_id") % 23).alias("stay_id"), ((F.col("vec_id") * 37 % 211) / 4.0 - 4.0).alias("delta_h"), F.col("vec_id").alias("note_id"))
    ids = notes.select("stay_id").distinct()
    grid = ids.select("stay_id", F.explode(F.sequence(F.lit(0), F.lit(47))).alias("hour"))
    return notes, e.select(F.col("vec_id").alias("note_id"), "embedding"), ids.where("stay_id % 4 <> 0"), grid


@query
def vector_components(s: SparkSession, d: str) -> DataFrame:
    """What all principal components of the train vectors explain: their sum, their squares and the first."""
    fit = fusion.fit_reduction(table(s, d, "embeddings").where("vec_id % 5 <> 0"), "embedding", 10**6)
    row = (fit.rows, len(fit.variance), float(fit.variance.sum()), float((fit.variance**2).sum()), float(fit.variance[0]))
    out = s.createDataFrame([row], "n_rows long, n_components int, variance double, squares double, first double")
    return out.select("n_rows", "n_components", *[r6(c).alias(c) for c in ("variance", "squares", "first")])


@query
def notes_block_hourly(s: SparkSession, d: str) -> DataFrame:
    """Every dimension of the pooled notes at each hour, scaled by train stays."""
    notes, vectors, train, grid = _notes(s, d)
    block = fusion.notes_block(notes, vectors, train, grid=grid, components=None, half_life=HALF_LIFE)
    names = [c for c in block.columns if c.startswith("note__")]
    long = block.unpivot(["stay_id", "hour"], names, "name", "x")
    return long.select("stay_id", "hour", F.regexp_extract("name", r"(\d+)$", 1).cast("int").alias("pos"), F.round(F.col("x").cast("double"), 4).alias("value"))


@query
def notes_block_components(s: SparkSession, d: str) -> DataFrame:
    """The first 8 components of the pooled notes at each hour."""
    notes, vectors, train, grid = _notes(s, d)
    return fusion.notes_block(notes, vectors, train, grid=grid, components=8, half_life=HALF_LIFE)


@query
def codes_block_tfidf(s: SparkSession, d: str) -> DataFrame:
    """The weights of all codes with at least 25 train stays, and who has a code."""
    train = table(s, d, "orders").where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("stay_id"))
    block, names = fusion.codes_block(codes(s, d), train, "tfidf", least=25)
    long = block.unpivot(["stay_id", "icd_present"], [f"icd__{n}" for n in names], "name", "x").where("x <> 0")
    return long.select("stay_id", F.substring("name", 6, 99).alias("code"), F.col("icd_present").cast("int").alias("present"), F.round(F.col("x").cast("double"), 4).alias("weight"))


def _treatments(s: SparkSession, d: str) -> DataFrame:
    """Events as treatments: purchases last value minutes, clicks and errors have doses, the others are points."""
    met = events(s, d).join(stays(s, d).select("stay_id", "admit_time"), "stay_id")
    role = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    at = hours_since("charttime", "admit_time")
    end = F.when(F.col("concept") == "purchase", at + F.floor(F.col("value") * 60) / 3600.0)
    return met.select("stay_id", F.element_at(role, F.col("concept")).alias("treatment"), F.when(F.col("concept").isin("click", "error"), F.col("value")).alias("dose"), at.alias("delta_h"), end.alias("end_delta_h"))


@query
def treatments_block_hourly(s: SparkSession, d: str) -> DataFrame:
    """Occupancy, scaled doses and presence at each hour of each stay."""
    who = stays(s, d)
    block = fusion.treatments_block(_treatments(s, d), who.where("stay_id % 4 <> 0").select("stay_id"), "aki", grid=tg.hour_grid(who, tg.los_horizon()), doses=True, scale=True)
    active = [f"tx__{c}_active" for c in ("vasopressor", "mech_vent", "antibiotic")]
    return block.select("stay_id", "hour", *[F.col(c).cast("int").alias(c) for c in [*active, "treatments_present"]], *[F.round(F.col(f"tx__{c}").cast("double"), 4).alias(f"tx__{c}") for c in ("peep", "insulin")])


@query
def infused_equivalents(s: SparkSession, d: str) -> DataFrame:
    """Rates of what was given between records of one run: purchases as milligrams of dopamine, views as units of vasopressin, in runs
    that no pause of six hours ends; stays weigh 40 to 99."""
    given = events(s, d).where("concept in ('purchase', 'view')").withColumn("patient_id", F.col("stay_id") % 100)
    runs = streams.infusion_sessions(given, ["stay_id", "concept"], 360.0)
    drug = F.when(F.col("concept") == "purchase", "dopamine").otherwise("vasopressin")
    records = runs.select("patient_id", "stay_id", F.concat_ws(":", "concept", "infusion").alias("infusion"), drug.alias("drug"), "charttime", F.col("value").alias("given"), F.when(F.col("concept") == "purchase", "mg").otherwise("U").alias("unit"))
    weights = stays(s, d).select("stay_id", (F.col("stay_id") % 60 + 40).cast("double").alias("weight"))
    out = streams.infused_equivalents(records, weights, "miiv")
    return out.select(F.col("source_admission_id").cast("long").alias("stay_id"), tg.micros("start_time").alias("at_us"), F.round(F.col("dose").cast("double"), 4).alias("dose"))


@query
def pressure_settings(s: SparkSession, d: str) -> DataFrame:
    """Clicks as settings of end-expiratory pressure; those out of its range are left out."""
    rows = events(s, d).where("concept = 'click'").withColumn("patient_id", F.col("stay_id") % 100)
    out = streams.end_expiratory_pressures(rows, "eicu")
    return out.select(F.col("bound_stay_id").cast("long").alias("stay_id"), tg.micros("start_time").alias("at_us"), F.round(F.col("dose").cast("double"), 4).alias("dose"), "dose_unit", "origin")


def _squared(n: int) -> str:
    """Steps that square a matrix and keep its trace at 1; its powers end in the first component."""
    steps = []
    for k in range(n):
        steps.append(f"q{k + 1} as (select a.i, b.j, sum(a.v * b.v) as v from p{k} a join p{k} b on a.j = b.i group by 1, 2), p{k + 1} as (select i, j, v / (select sum(v) from q{k + 1} where i = j) as v from q{k + 1})")
    return ", ".join(steps)


_EV = "ev as (select user_id as stay_id, epoch_us(ts) as t, event_type as concept, value from events), st as (select stay_id, min(t) as a, cast(floor(least((max(t) - min(t)) / 3600000000.0, 168)) as int) as mh from ev group by 1), grid as (select stay_id, unnest(range(0, mh + 1))::int as hour from st)"

ORACLE_SQL: dict[str, str] = {
    "vector_components": f"""
    with x as (select vec_id, unnest(range(0, len(embedding))) as i, unnest(embedding)::double as v from embeddings where vec_id % 5 <> 0),
    m as (select i, avg(v) as m from x group by 1), y as (select vec_id, i, v - m as v from x join m using (i)), n as (select count(distinct vec_id) as n, count(distinct i) as d from x),
    c as (select a.i, b.i as j, sum(a.v * b.v) / (any_value(n) - 1) as v from y a join y b using (vec_id), n group by 1, 2),
    p0 as (select i, j, v / (select sum(v) from c where i = j) as v from c), {_squared(13)}
    select n as n_rows, d::int as n_components, round((select sum(v) from c where i = j), 6) as variance, round((select sum(v * v) from c), 6) as squares, round((select sum(p13.v * c.v) from p13 join c on p13.i = c.j and p13.j = c.i), 6) as first from n
    """,
    "notes_block_hourly": f"""
    with nt as (select vec_id % 23 as stay_id, (vec_id * 37 % 211) / 4.0 - 4.0 as t, unnest(range(0, len(embedding))) as pos, unnest(embedding)::double as v from embeddings),
    now as (select distinct stay_id, t from nt),
    s as (select now.stay_id, now.t, nt.pos, sum(power(2.0, (nt.t - now.t) / {HALF_LIFE}) * v) / sum(power(2.0, (nt.t - now.t) / {HALF_LIFE})) as x from now join nt on nt.stay_id = now.stay_id and nt.t <= now.t group by 1, 2, 3),
    f as (select pos, avg(x) as m, stddev_pop(x) as d from s where stay_id % 4 <> 0 group by 1),
    g as (select stay_id, unnest(range(0, 48))::int as hour from (select distinct stay_id from nt)),
    k as (select g.stay_id, hour, max(t) as t from g join now on now.stay_id = g.stay_id and now.t <= hour group by 1, 2)
    select k.stay_id, hour, s.pos::int as pos, round(((x - m) / case when d > 0 then d else 1 end)::float::double, 4) as value from k join s using (stay_id, t) join f using (pos)
    """,
    "codes_block_tfidf": """
    with c as (select l_orderkey as stay_id, p_brand as code from lineitem join part on l_partkey = p_partkey), tr as (select o_orderkey as stay_id from orders where o_orderkey % 5 <> 0),
    v as (select code, count(distinct stay_id) as df from c join tr using (stay_id) group by 1 having count(distinct stay_id) >= 25)
    select stay_id, code, 1::int as present, round((count(*) * ln((select count(*) from tr)::double / any_value(df)))::float::double, 4) as weight from c join v using (code) group by 1, 2 having round((count(*) * ln((select count(*) from tr)::double / any_value(df)))::float::double, 12) <> 0
    """,
    "treatments_block_hourly": f"""
    with {_EV}, tr as (select ev.stay_id, concept, value as dose, (t - a) / 3600000000.0 as s, case when concept = 'purchase' then (t - a) / 3600000000.0 + floor(value * 60) / 3600.0 end as e from ev join st using (stay_id)),
    b as (select g.stay_id, g.hour, coalesce(max((concept = 'purchase' and s <= hour and e >= hour)::int), 0) as v, coalesce(max((concept = 'view' and s = hour)::int), 0) as m, coalesce(max((concept = 'signup' and s = hour)::int), 0) as x,
        arg_max(dose, (s, dose)) filter (concept = 'click' and s <= hour and dose is not null) as peep, arg_max(dose, (s, dose)) filter (concept = 'error' and s <= hour and dose is not null) as ins, coalesce(max((s <= hour)::int), 0) as p from grid g join tr using (stay_id) group by 1, 2),
    f as (select avg(peep) as pm, stddev_pop(peep) as ps, avg(ins) as im, stddev_pop(ins) as is_ from b where stay_id % 4 <> 0)
    select stay_id, hour, v as tx__vasopressor_active, m as tx__mech_vent_active, x as tx__antibiotic_active, p as treatments_present,
        round(coalesce(case when ps > 0 then (peep - pm) / ps else peep end, 0)::float::double, 4) as tx__peep, round(coalesce(case when is_ > 0 then (ins - im) / is_ else ins end, 0)::float::double, 4) as tx__insulin from b, f
    """,
    "infused_equivalents": f"""
    with {_EV}, o as (select *, case when t - lag(t) over w <= 21600000000 then 0 else 1 end as opens from ev where concept in ('purchase', 'view') window w as (partition by stay_id, concept order by t)),
    r as (select *, sum(opens) over (partition by stay_id, concept order by t rows unbounded preceding) as run from o),
    u as (select stay_id, concept, run, t, sum(value * case concept when 'purchase' then 1000.0 / 100.0 else 2.5 end) as given from r group by all),
    q as (select stay_id, t, given / ((t - lag(t) over (partition by stay_id, concept, run order by t)) / 60000000.0) / (stay_id % 60 + 40) as dose from u)
    select stay_id, t as at_us, round(dose::float::double, 4) as dose from q where dose > 0 and dose <= 5
    """,
    "pressure_settings": f"with {_EV} select stay_id, t as at_us, round(value::float::double, 4) as dose, 'cmH2O' as dose_unit, 'peep_raw' as origin from ev where concept = 'click' and value between 0 and 25",
}
