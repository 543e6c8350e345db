"""Every operator as a query over the test tables, with the SQL that gives the same rows.

Floats are rounded to six places on both sides, and rows are long and scalar, so that engines can be compared by value.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import adapters as a
from ..operators import categorize, clean, cluster, community, enrich, model, order, resample, spectral, subjects, transform, visibility
from ..sources import readers, sinks, store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
X = F.col


def query(name: str, sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def num(c, places: int = 6):
    return (F.round(c, places) + F.lit(0.0)).alias(c if isinstance(c, str) else "v")


def cells(s: DataFrame) -> DataFrame:
    """(keys, t, x) of the cells that are present."""
    return model.to_long(s).where("x is not null").withColumn("t", X("t").cast("long")).withColumn("x", F.round("x", 6) + F.lit(0.0))


def _array(name: str, f, cte: str = a.SPARSE_SQL, source=a.sparse_signals, sql: str | None = None) -> None:
    text = f"with {cte} {sql}" if sql else None
    query(name, text)(lambda spark, sf: cells(f(source(spark, sf))))


OUT = "select id, cast(t as bigint) as t, round(x, 6) + 0e0 as x from"
# -- filters -------------------------------------------------------------------------------------------------------
_keep = lambda having: f"{OUT} sp where x is not null and id in (select id from sp group by id having {having})"
_array("f_allzero", clean.drop_all_zero, sql=_keep("count(*) filter (where x is null or x <> 0) > 0"))
_array("f_frac_nonzero", lambda s: clean.keep_nonzero_fraction(s, 0.8), sql=_keep(f"count(*) filter (where x is null or x <> 0) >= ceil(0.8e0 * {a.QUARTERS})"))
_array("f_frac_present", lambda s: clean.keep_present_fraction(s, 0.9), sql=_keep(f"count(x) >= ceil(0.9e0 * {a.QUARTERS})"))
_array("f_refzero", clean.drop_zero_at, sql=_keep("count(*) filter (where t = 0 and x = 0) = 0"))
_array("f_constant", lambda s: clean.drop_constant(s, 0.9), sql=f"""
  , sds as (select id, stddev_pop(x) as sd from sp group by id)
  {OUT} sp where x is not null and id in (select id from sds where sd / (select avg(sd) from sds) > 0.9e0)""")
# -- cell-wise -----------------------------------------------------------------------------------------------------
_array("t_tag_missing", clean.tag_missing, sql=f"{OUT} sp where x <> 0")
_array("t_fill_value", lambda s: clean.fill_missing(s, -1.0), sql="select id, cast(t as bigint) as t, round(coalesce(x, -1), 6) + 0e0 as x from sp")
_array("t_floor_low", lambda s: clean.floor_low(s, 20.0, 20.0), sql="select id, cast(t as bigint) as t, round(case when x <= 20 then 20 else x end, 6) + 0e0 as x from sp where x is not null")
_array("t_impute_row", clean.impute_rows, sql="select id, cast(t as bigint) as t, round(coalesce(x, median(x) over (partition by id)), 6) + 0e0 as x from sp")
_array("t_impute_col", clean.impute_columns, sql="select id, cast(t as bigint) as t, round(coalesce(x, median(x) over (partition by t)), 6) + 0e0 as x from sp")
_norm = "n as (select id, t, {d} as x from sp), m as (select id, sqrt(sum(x * x)) as m from n group by id) select id, cast(t as bigint) as t, round(x / nullif(m, 0), 6) + 0e0 as x from n join m using (id) where x / nullif(m, 0) is not null"
_first = "x - max(case when t = 0 then x end) over (partition by id)"
_array("t_unit_norm", transform.unit_norm, sql=", " + _norm.format(d=_first))
_array("t_unit_norm_noref", lambda s: transform.unit_norm(s, None), sql=", " + _norm.format(d="x"))
_cmp = "select * from (select id, cast(t as bigint) as t, round(x - {r}, 6) + 0e0 as x from sp) where x is not null"
_array("t_cmp_first", transform.compare_to_point, sql=_cmp.format(r="max(case when t = 0 then x end) over (partition by id)"))
_array("t_cmp_last", lambda s: transform.compare_to_point(s, "last"), sql=_cmp.format(r=f"max(case when t = {a.QUARTERS - 1} then x end) over (partition by id)"))
_array("t_cmp_index", lambda s: transform.compare_to_point(s, 5), sql=_cmp.format(r="max(case when t = 5 then x end) over (partition by id)"))
_array("t_cmp_value", lambda s: transform.compare_to_point(s, 2.5), sql=_cmp.format(r="2.5e0"))
_array("t_boxcox_fixed", lambda s: transform.box_cox(s, 0.5), sql="select id, cast(t as bigint) as t, round(case when x > 0 then (pow(x, 0.5e0) - 1) / 0.5e0 else x end, 6) + 0e0 as x from sp where x is not null")
_array("t_boxcox_log", lambda s: transform.box_cox(s, 0.0), sql="select id, cast(t as bigint) as t, round(case when x > 0 then ln(x) else x end, 6) + 0e0 as x from sp where x is not null")
_array("t_boxcox_mle", lambda s: transform.box_cox_fitted(s).drop("lam"))
_array("t_modz_row", transform.modified_z_rows, sql="""
  , m as (select id, t, x, median(x) over (partition by id) as med, avg(x) over (partition by id) as mu from sp where x is not null),
  d as (select *, median(abs(x - med)) over (partition by id) as mad, avg(abs(x - mu)) over (partition by id) as ad from m)
  select * from (select id, cast(t as bigint) as t, round(case when mad = 0 then 0.7978846e0 * (x - med) / nullif(ad, 0) else 0.6744897e0 * (x - med) / mad end, 6) + 0e0 as x from d) where x is not null""")


@query("t_modz_col", f"""with {a.SPARSE_SQL}
  , m as (select id, t, x, median(x) over (partition by t) as med, avg(x) over (partition by t) as mu from sp where x is not null),
  d as (select *, median(abs(x - med)) over (partition by t) as mad, avg(abs(x - mu)) over (partition by t) as ad from m)
  select id, cast(t as bigint) as t, round(case when mad = 0 then 0.7978846e0 * (x - med) / nullif(ad, 0) else 0.6744897e0 * (x - med) / mad end, 6) + 0e0 as z from d""")
def _modz_col(spark, sf):
    return transform.modified_z_columns(a.sparse_signals(spark, sf)).select("id", X("t").cast("long").alias("t"), num("z"))


@query("t_quantile_orig", f"""with {a.SUPPLIERS_SQL},
  r as (select id, t, x, row_number() over (partition by t order by x, id) as rn from sup where x is not null),
  w as (select rn, avg(x) as w from r group by rn)
  select id, cast(t as bigint) as t, round(avg(w) over (partition by t, x), 6) + 0e0 as x from r join w using (rn)""")
def _quantile(spark, sf):
    return transform.quantile_normalise(a.supplier_signals(spark, sf)).select("id", X("t").cast("long").alias("t"), num("x"))


@query("t_quantile_median", f"""with {a.SUPPLIERS_SQL},
  r as (select id, t, x, row_number() over (partition by t order by x, id) as rn from sup where x is not null),
  w as (select rn, median(x) as w from r group by rn)
  select id, cast(t as bigint) as t, round(max(w) over (partition by t, x), 6) + 0e0 as x from r join w using (rn)""")
def _quantile_median(spark, sf):
    return transform.quantile_normalise(a.supplier_signals(spark, sf), "median", "max").select("id", X("t").cast("long").alias("t"), num("x"))


# up to 1000 values at a time point every value is a landmark, and the middle of its ranks is its place
_UNIFORM = f"""with {a.SUPPLIERS_SQL},
  r as (select id, t, x, rank() over (partition by t order by x) - 1 as low, count(*) over (partition by t, x) as ties, count(*) over (partition by t) as n,
               min(x) over (partition by t) as x0, max(x) over (partition by t) as x1 from sup where x is not null)
  select id, cast(t as bigint) as t, round(case when x = x1 then 1e0 when x = x0 then 0e0 else (low + (ties - 1) / 2e0) / (n - 1) end, 6) + 0e0 as x from r"""
# fixed values: numerator and denominator, constant term first, of the rational approximations of the normal distribution's
# inverse (Wichura, 1988) for the middle, the tails and the far tails
_MIDDLE = (3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125, 45921.953931549871457, 67265.770927008700853, 33430.575583588128105, 2509.0809287301226727), (1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077, 21213.794301586595867, 39307.895800092710610, 28729.085735721942674, 5226.4952788528545610)
_TAIL = (1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504, 1.27045825245236838258, 0.241780725177450611770, 0.0227238449892691845833, 7.74545014278341407640e-4), (1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550, 0.148103976427480074590, 0.0151986665636164571966, 5.47593808499534494600e-4, 1.05075007164441684324e-9)
_FAR = (6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 0.296560571828504891230, 0.0265321895265761230930, 0.00124266094738807843860, 2.71155556874348757815e-5, 2.01033439929228813265e-7), (1.0, 0.599832206555887937690, 0.136929880922735805310, 0.0148753612908506148525, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15)


def _rational(parts: tuple[tuple[float, ...], tuple[float, ...]], r: str) -> str:
    def polynomial(terms: tuple[float, ...]) -> str:
        out = f"{terms[-1]!r}::double"
        for c in reversed(terms[:-1]):
            out = f"({out} * {r} + {c!r}::double)"
        return out

    return f"({polynomial(parts[0])} / {polynomial(parts[1])})"


_NORMAL = f"""with u as ({_UNIFORM.replace('round(case', 'case').replace("end, 6) + 0e0 as x from r", "end as x from r")}),
  p as (select id, t, greatest(1e-7, least(1 - 1e-7, x)) - 0.5e0 as q, sqrt(-ln(least(greatest(1e-7, least(1 - 1e-7, x)), 1 - greatest(1e-7, least(1 - 1e-7, x))))) as r from u)
  select id, t, round(case when abs(q) <= 0.425e0 then q * {_rational(_MIDDLE, '(0.180625e0 - q * q)')} else sign(q) * case when r <= 5 then {_rational(_TAIL, '(r - 1.6e0)')} else {_rational(_FAR, '(r - 5e0)')} end end, 6) + 0e0 as x from p"""
for _kind, _sql in (("uniform", _UNIFORM), ("normal", _NORMAL)):
    query(f"t_quantile_{_kind}", _sql)(lambda spark, sf, k=_kind: transform.quantile_transform(a.supplier_signals(spark, sf), k).select("id", X("t").cast("long").alias("t"), num("x")))


@query("t_two_frames_median", f"""with {a.TYPED_SQL},
  p as (select id, t, median(x) as x from typed where source in ('click', 'view') group by id, t), q as (select id, t, median(x) as x from typed where source not in ('click', 'view') group by id, t)
  select id, cast(t as bigint) as t, round(p.x - q.x, 6) + 0e0 as x from p join q using (id, t) where p.x - q.x is not null""")
def _two_median(spark, sf):
    s = a.typed_signals(spark, sf)
    left, right = s.where("source in ('click', 'view')"), s.where("source not in ('click', 'view')")
    return cells(transform.compare_frames(left, right, merge="median"))


@query("t_common_euclid", f"""with {a.SPARSE_SQL}
  select p.id as a, q.id as b, round(sqrt(coalesce(sum((p.x - q.x) * (p.x - q.x)), 0)), 6) + 0e0 as d
  from sp p join sp q on p.t = q.t and q.id = p.id + 1 group by p.id, q.id""")
def _common(spark, sf):
    s = a.sparse_signals(spark, sf)
    other = s.select((X("id") - 1).alias("id"), X("id").alias("b"), X("x").alias("y"))
    return s.join(other, "id").select(X("id").alias("a"), "b", (F.round(transform.common_distance(X("x"), X("y")), 6) + F.lit(0.0)).alias("d"))


# two whole frames: the sparse signals, and the suppliers' with their gaps filled
def _wholes(spark, sf):
    return a.sparse_signals(spark, sf), clean.fill_missing(a.supplier_signals(spark, sf), 1.0)


@query("t_two_frames_sub", f"with {a.SPARSE_SQL} select id, cast(t as bigint) as t, round(sp.x - coalesce(sup.x, 1), 6) + 0e0 as x from sp join sup using (id, t) where sp.x is not null")
def _two_whole(spark, sf):
    return cells(transform.compare_frames(*_wholes(spark, sf)))


@query("t_concat_rows", f"with {a.SPARSE_SQL} {OUT} (select * from sp union all select id, t, coalesce(x, 1) from sup) u where x is not null")
def _rows_whole(spark, sf):
    return cells(transform.concat_rows(*_wholes(spark, sf)))


@query("t_concat_cols", f"with {a.SPARSE_SQL} {OUT} (select * from sp union all select id, t + {a.QUARTERS}, coalesce(x, 1) from sup) u where x is not null")
def _cols_whole(spark, sf):
    return cells(transform.concat_columns(*_wholes(spark, sf), a.QUARTERS, a.QUARTERS))


@query("t_merge_mean", f"with {a.TYPED_SQL} select id, cast(t as bigint) as t, round(avg(x), 6) + 0e0 as x from typed group by id, t")
def _merge(spark, sf):
    return cells(transform._merged(a.typed_signals(spark, sf), ("id",), "avg"))


@query("t_chop", f"with {a.SPARSE_SQL} select id, cast(t as bigint) as t, round(case when abs(x - 20) < 3e0 then 0e0 else x - 20 end, 6) + 0e0 as x from sp where x is not null")
def _chop(spark, sf):
    s = a.sparse_signals(spark, sf)
    return cells(s.withColumn("x", F.transform("x", lambda v: transform.chop(v - 20, 3.0))))


@query("k_hist", f"""with {a.SUPPLIERS_SQL}, e as (select t, min(x) as lo, max(x) as hi from sup group by t)
  select cast(t as bigint) as t, cast(least(9, floor(coalesce((x - lo) / nullif(hi - lo, 0), 0) * 10)) as integer) as bin, count(*) as n from sup join e using (t) where x is not null group by 1, 2""")
def _hist(spark, sf):
    return transform.histogram(a.supplier_signals(spark, sf), 10).withColumn("t", X("t").cast("long"))


@query("k_profile", f"""with {a.SPARSE_SQL}, f as (select id, t, coalesce(x, median(x) over (partition by id)) as x from sp)
  select cast(t as bigint) as t, round(sum(case when x > 0 then x else 0 end) / count(*), 6) + 0e0 as level from f group by t""")
def _profile(spark, sf):
    return transform.profile(a.sparse_signals(spark, sf)).select(X("t").cast("long").alias("t"), num("level"))


# -- spectra -------------------------------------------------------------------------------------------------------
def _freq_sql(freqs: list[float]) -> str:
    return "fr as (select * from (values " + ", ".join(f"({k}, {f!r}::double)" for k, f in enumerate(freqs)) + ") v(k, f))"


def _part(num: str, den: str) -> str:
    return f"case when power({num}, 2) < 1e-10 then 0e0 else power({num}, 2) / nullif({den}, 0) end"


def _lomb_sql(cte: str, name: str, freqs: list[float], normalise: bool = False) -> str:
    final = "select id, cast(k as bigint) as t, round(p{n}, 6) + 0e0 as x from power_ where p is not null".format(n=" / nullif(sqrt(sum(p * p) over (partition by id)), 0)" if normalise else "")
    return f"with {_lomb_cte(cte, name, freqs)} {final}"


def _lomb_cte(cte: str, name: str, freqs: list[float]) -> str:
    return f"""{cte}, {_freq_sql(freqs)},
  d as (select id, t, x - avg(x) over (partition by id) as d, var_samp(x) over (partition by id) as v from {name} where x is not null),
  th as (select id, k, f, 0.5e0 * atan2(sum(sin(4 * pi() * f * t)), sum(cos(4 * pi() * f * t) + 1e-20)) as th from d cross join fr group by id, k, f),
  s as (select d.id, th.k, max(v) as v, sum(d * cos(2 * pi() * f * t - th)) as c, sum(power(cos(2 * pi() * f * t - th), 2)) as cc,
               sum(d * sin(2 * pi() * f * t - th)) as s, sum(power(sin(2 * pi() * f * t - th), 2)) as ss
        from d join th on th.id = d.id group by d.id, th.k),
  power_ as (select id, k, ({_part('c', 'cc')} + {_part('s', 'ss')}) / nullif(2 * v, 0) as p from s)"""


# the grid of the orders' months, up to the last one
@query("p_freqs", """with g as (select max((year(o_orderdate) - 1992) * 12 + month(o_orderdate)) as n from orders), b as (select n, n / (cast(n - 1 as double) * (n - 1)) as base from g),
  c as (select *, cast(floor(base * n / 2 / (1 / cast(n // 2 - 1 as double) * (n / 2.0 - 1) * base)) as bigint) as m, n / 2.0 * base as last from b)
  select k, round(base + k * (last - base) / (m - 1), 6) as f from (select *, unnest(range(m)) as k from c)""")
def _freqs(spark, sf):
    month = (F.year("o_orderdate") - 1992) * 12 + F.month("o_orderdate")
    n = a.table(spark, sf, "orders").agg(F.max(month).alias("n")).first()["n"]
    return spark.createDataFrame(list(enumerate(spectral.frequencies([float(t) for t in range(n)]))), "k long, f double").withColumn("f", F.round("f", 6))


_DAYF = spectral.frequencies(a.DAY_TIMES)
query("p_lomb", _lomb_sql(a.EVENTS_SQL, "ev", _DAYF))(lambda spark, sf: cells(spectral.lomb_scargle(a.event_signals(spark, sf), a.DAY_TIMES)))
query("p_lomb_norm", _lomb_sql(a.EVENTS_SQL, "ev", _DAYF, True))(lambda spark, sf: cells(spectral.lomb_scargle(a.event_signals(spark, sf), a.DAY_TIMES, normalise=True)))
_OVER = spectral.frequencies(a.QUARTER_TIMES, oversampling=3)
query("p_lomb_oversampled", _lomb_sql(a.SUPPLIERS_SQL, "sup", _OVER))(lambda spark, sf: cells(spectral.lomb_scargle(a.supplier_signals(spark, sf), a.QUARTER_TIMES, oversampling=3)))
_PLOTF = spectral.frequencies(a.QUARTER_TIMES, oversampling=100)
_POSITIVE = f"{a.SPARSE_SQL}, pos as (select id, t, case when x > 0 then x end as x from sp where id in (select id from sp where x > 0 group by id having count(*) >= 5))"


@query("p_plot_data", _lomb_sql(_POSITIVE, "pos", _PLOTF).replace("select id, cast(k as bigint) as t, round(p, 6) + 0e0 as x from power_ where p is not null", "select id, cast(k as bigint) as k, round(2 * pi() * f, 6) as omega, round(p, 6) + 0e0 as power from power_ join fr using (k)"))
def _plot_data(spark, sf):
    return spectral.plot_data(a.sparse_signals(spark, sf), a.QUARTER_TIMES).select("id", X("k").cast("long").alias("k"), F.round("omega", 6).alias("omega"), num("power"))


def _unit_sql(cte: str, name: str) -> str:
    return f"""{cte},
  c0 as (select id, t, x - max(case when t = 0 then x end) over (partition by id) as x from {name}),
  un as (select id, t, x / nullif(sqrt(sum(x * x) over (partition by id)), 0) as x from c0)"""


def _acf_sql(cte: str, name: str, n: int) -> str:
    """From the CTE `un` or another of unit-norm cells: the padded spectrum, then its cosine transform."""
    base = 1 / (n - 1)
    freqs = [0.5 * base * m for m in range(1, n + 1)]
    return f"""{cte}, {_freq_sql(freqs)},
  d as (select id, cast(t as double) as t, x - avg(x) over (partition by id) as d from {name} where x is not null),
  pad as (select id, t, d from d union all select id, t + {n - 1}, 0e0 from (select distinct id from d) i cross join (select unnest(range({n})) as t) g),
  wv as (select k, cast(t as double) as t, cos(2 * pi() * f * t) as wc, sin(2 * pi() * f * t) as ws from fr cross join (select unnest(range({2 * n})) as t) g),
  sm as (select id, k, sum(d * wc) as c, sum(d * ws) as s, sum(wc * wc) as cc, sum(ws * ws) as ss, sum(wc * ws) as cs, count(*) as m from pad join wv using (t) group by id, k),
  th as (select *, cos(a) as u, sin(a) as w from (select *, 0.5e0 * atan2(2 * cs, cc - ss + m * 1e-20) as a from sm)),
  pw as (select id, k + 1 as m, {_part('(c * u + s * w)', '(cc * u * u + 2 * cs * u * w + ss * w * w)')} + {_part('(s * u - c * w)', '(ss * u * u - 2 * cs * u * w + cc * w * w)')} as p from th),
  lag as (select id, l.k, sum(p * cos(pi() * (2 * l.k + 1) * m / (2e0 * {n + 1}))) as a from pw cross join (select unnest(range({(n + 1) // 2})) as k) l group by id, l.k),
  acf as (select id, k, a / nullif(max(case when k = 0 then a end) over (partition by id), 0) as v from lag)"""


query("p_autocorr", f"with {_acf_sql(_unit_sql(a.SUPPLIERS_SQL, 'sup'), 'un', a.QUARTERS)} select id, cast(k as bigint) as t, round(v, 6) + 0e0 as x from acf where v is not null")(
    lambda spark, sf: cells(spectral.autocorrelation(transform.unit_norm(a.supplier_signals(spark, sf)), a.QUARTER_TIMES))
)

# -- null models and classes ---------------------------------------------------------------------------------------
#: Draws of the queries that are compared with SQL, and of those that answer as the reference does.
SAMPLES, ALL_SAMPLES = 200, 100_000


def _draw_sql(t: str) -> str:
    mixed = f"((s.sample * {resample.A} + {t} * {resample.B} + {resample.C}) % {resample.P})"
    return f"(({mixed} * {mixed}) % {resample.P}) % n"


def _boot_sql(cte: str, name: str, width: int, samples: int, whole: bool = False) -> str:
    return f"""{cte},
  numbered as (select id, t, x, row_number() over (partition by t order by id) - 1 as r, count(*) over (partition by t) as n from {name}),
  boot as (select s.sample as id, c.t, c.x from (select unnest(range({samples}::bigint)) as sample) s
           cross join (select unnest(range({width}::bigint)) as t) g join numbered c on c.t = g.t and c.r = {_draw_sql('0' if whole else 'g.t')})"""


def _draws(name: str, sql: Callable[[int], str | None], run: Callable[[SparkSession, str, int], DataFrame]) -> None:
    """The query with SAMPLES draws, and as `_all` with the reference's number."""
    for suffix, samples in (("", SAMPLES), ("_all", ALL_SAMPLES)):
        query(f"{name}{suffix}", sql(samples))(lambda spark, sf, n=samples: run(spark, sf, n))


for _name, _whole in (("n_bootstrap", False), ("n_bootstrap_rows", True)):
    _draws(
        _name,
        lambda n, whole=_whole: f"with {_boot_sql(a.SPARSE_SQL, 'sp', a.QUARTERS, n, whole)} {OUT} boot where x is not null",
        lambda spark, sf, n, whole=_whole: cells(resample.bootstrap(a.sparse_signals(spark, sf), n, whole)),
    )


def _null_sql(cte: str, name: str, width: int, samples: int) -> str:
    return f"""{_boot_sql(cte, name, width, samples)},
  fine as (select id from boot group by id having count(*) filter (where x is null or x <> 0) >= ceil(0.75e0 * {width})),
  b0 as (select id, t, x - max(case when t = 0 then x end) over (partition by id) as x from boot where id in (select id from fine)),
  b1 as (select id, t, x / nullif(sqrt(sum(x * x) over (partition by id)), 0) as x from b0),
  sds as (select id, stddev_pop(x) as sd from b1 group by id),
  nul as (select id, t, x from b1 where id in (select id from sds where sd / (select avg(sd) from sds) > 0))"""


_draws(
    "n_null_autocorr",
    lambda n: f"with {_acf_sql(_null_sql(a.SUPPLIERS_SQL, 'sup', a.QUARTERS, n), 'nul', a.QUARTERS)} select id, cast(k as bigint) as t, round(v, 6) + 0e0 as x from acf where v is not null",
    lambda spark, sf, n: cells(resample.null_autocorrelations(a.supplier_signals(spark, sf), a.QUARTER_TIMES, n)),
)
_draws(
    "n_null_periodogram",
    lambda n: _lomb_sql(_null_sql(a.SUPPLIERS_SQL, "sup", a.QUARTERS, n), "nul", spectral.frequencies(a.QUARTER_TIMES)),
    lambda spark, sf, n: cells(resample.null_periodograms(a.supplier_signals(spark, sf), a.QUARTER_TIMES, n)),
)
_QUANTILE = "list_sort(list({v}))[cast(floor((count({v}) - 1) * {q}) as integer) + 1]"
_CUTS = f"""cuts as (select k, case when k = 0 then 1e0 else {_QUANTILE.format(v='v', q='0.95e0')} end as cut from {{acf}} where v is not null group by k)"""


def _quantile_cutoffs(spark, sf, samples):
    null = resample.null_autocorrelations(a.supplier_signals(spark, sf), a.QUARTER_TIMES, samples)
    return resample.cutoffs(null, 0.05).select(X("k").cast("long").alias("k"), num("cut"))


_draws(
    "c_quantile_cutoffs",
    lambda n: f"with {_acf_sql(_null_sql(a.SUPPLIERS_SQL, 'sup', a.QUARTERS, n), 'nul', a.QUARTERS)}, {_CUTS.format(acf='acf')} select cast(k as bigint) as k, round(cut, 6) + 0e0 as cut from cuts",
    _quantile_cutoffs,
)


def _ends(name: str) -> str:
    return f"select id, count(x) as n_obs, max(coalesce(x, 0)) as mx, min(coalesce(x, 0)) as mn from {name} group by id"


_LIM = f"select n_obs, {_QUANTILE.format(v='mx', q='(1 - 0.05e0)')} as hi, {_QUANTILE.format(v='mn', q='0.05e0')} as lo from ends group by n_obs"


def _limits_sql(samples: int) -> str:
    return f"{_null_sql(a.SPARSE_SQL, 'sp', a.QUARTERS, samples)}, ends as ({_ends('nul')}), lim as ({_LIM})"


def _spike_limits(spark, sf, samples):
    return resample.spike_cutoffs(a.sparse_signals(spark, sf), 0.05, samples).select(X("n_obs").cast("long").alias("n_obs"), num("hi"), num("lo"))


_draws("n_spike_cutoffs", lambda n: f"with {_limits_sql(n)} select cast(n_obs as bigint) as n_obs, round(hi, 6) + 0e0 as hi, round(lo, 6) + 0e0 as lo from lim", _spike_limits)


def _spike_signals(spark, sf, high, samples):
    s = a.sparse_signals(spark, sf)
    return categorize.spikes(transform.unit_norm(s), resample.spike_cutoffs(s, 0.05, samples), high)


for _name, _high in (("c_spikes_max", True), ("c_spikes_min", False)):
    _draws(
        _name,
        lambda n, high=_high: f"""with {_limits_sql(n)},
      u0 as (select id, t, x - max(case when t = 0 then x end) over (partition by id) as x from sp),
      u1 as (select id, t, x / nullif(sqrt(sum(x * x) over (partition by id)), 0) as x from u0),
      pt as (select id, n_obs, {'mx' if high else 'mn'} as pt from ({_ends('u1')}))
      select id, pt > hi or pt < lo as spike from pt join lim using (n_obs)""",
        lambda spark, sf, n, high=_high: _spike_signals(spark, sf, high, n),
    )


def _classes_sql(cte: str, name: str, width: int, samples: int, letter: str, vectors: Callable[[str, str], str]) -> str:
    """vectors(cte, name) ends in a CTE `acf`(id, k, v) of the cells of `name`."""
    null = _null_sql(cte, name, width, samples)
    return f"""with {vectors(_unit_sql(cte, name), 'un')}, cut as materialized (with {vectors(null, 'nul')}, {_CUTS.format(acf='acf')} select * from cuts), lim as materialized (with {null}, ends as ({_ends('nul')}) {_LIM}),
      fl as (select id, min(acf.k) filter (where acf.k >= 1 and round(v, 9) > round(cut, 9)) as lag from acf join cut using (k) group by id),
      pt as ({_ends('un')})
      select pt.id, case when lag is not null then '{letter}' || lag when mx > hi or mx < lo then 'SpikeMax' when mn > hi or mn < lo then 'SpikeMin' end as trend_class
      from pt left join fl using (id) left join lim using (n_obs)"""


def _lomb_vectors(cte: str, name: str) -> str:
    return f"{_lomb_cte(cte, name, spectral.frequencies(a.DAY_TIMES))}, acf as (select id, k, p / nullif(sqrt(sum(p * p) over (partition by id)), 0) as v from power_)"


#: The events' signals as categorise() prepares them.
_PREPARED = f"""{a.EVENTS_SQL},
  e1 as (select id, t, x from ev where id in (select id from ev group by id having count(*) filter (t = 0 and x = 0) = 0 and count(*) filter (x is null or x <> 0) >= ceil(0.75e0 * {a.DAYS}))),
  e2 as (select id, t, case when x = 0 then null when x <= 1 then 1 else x end as x from e1),
  prep as (with sds as (select id, stddev_pop(x) as sd from e2 group by id) select id, t, x from e2 where id in (select id from sds where sd / (select avg(sd) from sds) > 0))"""


def classes(spark, sf, samples=SAMPLES):
    return categorize.categorise(a.supplier_signals(spark, sf), a.QUARTER_TIMES, samples=samples, prepare=False)


_draws("c_classes_acf", lambda n: _classes_sql(a.SUPPLIERS_SQL, "sup", a.QUARTERS, n, "LAG", lambda cte, name: _acf_sql(cte, name, a.QUARTERS)), classes)
_draws("c_classes_pgram", lambda n: _classes_sql(_PREPARED, "prep", a.DAYS, n, "F", _lomb_vectors), lambda spark, sf, n: categorize.categorise(a.event_signals(spark, sf), a.DAY_TIMES, samples=n, spectrum=True))


# -- visibility graphs ---------------------------------------------------------------------------------------------
_NODES = f"{a.EVENTS_SQL}, nd as (select id, row_number() over (partition by id order by t) - 1 as i, cast(t as double) as t, x from ev where x is not null)"
_WEIGHTS = {None: "1e0", "time": "abs(tj - ti)", "tan": "abs(xj - xi) / abs(tj - ti) + 1e-8", "distance": "sqrt((tj - ti) * (tj - ti) + (xj - xi) * (xj - xi))"}


def _edge_sql(src: str, out: str, kind: str, weight: str | None, through: bool) -> str:
    score, limit = ("(xj - xi) / (tj - ti)",) * 2 if kind == "natural" else ("xj", "least(xi, xj)")
    return f"""{out} as (select id, i, j, {_WEIGHTS[weight]} as w from (
      select *, max({score}) over (partition by id, i order by j rows between unbounded preceding and 1 preceding) as m
      from (select p.id, p.i, q.i as j, p.t as ti, q.t as tj, p.x as xi, q.x as xj from {src} p join {src} q on p.id = q.id and p.i < q.i))
      where m is null or m {'<=' if through else '<'} {limit})"""


def _edge_out(e: DataFrame) -> DataFrame:
    return e.select("id", X("i").cast("long").alias("i"), X("j").cast("long").alias("j"), num("w"))


def _points(spark, sf):
    return visibility.points(a.event_signals(spark, sf))


for _name, _kind, _w, _t in (("v_nvg", "natural", None, False), ("v_hvg", "horizontal", None, False), ("v_nvg_ties", "natural", None, True), ("v_hvg_ties", "horizontal", None, True), ("v_weighted_time", "natural", "time", False), ("v_weighted_tan", "natural", "tan", False), ("v_weighted_dist", "horizontal", "distance", False)):
    query(_name, f"with {_NODES}, {_edge_sql('nd', 'e', _kind, _w, _t)} select id, i, j, round(w, 6) + 0e0 as w from e")(
        lambda spark, sf, k=_kind, w=_w, t=_t: _edge_out(visibility.edges(_points(spark, sf), k, w, t))
    )
for _name, _kind in (("v_dual_h", "horizontal"), ("v_dual_n", "natural")):
    _low = "where min_x < 0" if _kind == "natural" else ""
    _sql = f"""with {_NODES}, cd as (select id, i, t, x - avg(x) over (partition by id) as x from nd),
      neg as (select id, i, t, -x as x from (select *, min(x) over (partition by id) as min_x from cd) {_low}),
      {_edge_sql('cd', 'up', _kind, 'distance', False)}, {_edge_sql('neg', 'down', _kind, 'distance', False)}
      select id, i, j, round(case when coalesce(up.w, 0) >= coalesce(down.w, 0) then coalesce(up.w, 0) else -down.w end, 6) + 0e0 as w from up full join down using (id, i, j)"""

    @query(_name, _sql)
    def _dual(spark, sf, kind=_kind):
        return _edge_out(visibility.dual_edges(_centred(spark, sf), kind, "distance"))


def _centred(spark, sf):
    s = a.event_signals(spark, sf)
    m = model.mean(X("x"))
    return visibility.points(s.withColumn("_m", m).withColumn("x", F.transform("x", lambda v: v - X("_m"))).drop("_m"))


@query("v_degree", f"with {_NODES}, {_edge_sql('nd', 'e', 'natural', None, False)} select id, node, count(*) as degree from (select id, i as node from e union all select id, j from e) group by id, node")
def _degree(spark, sf):
    return visibility.degrees(_points(spark, sf))


@query("v_bars", f"""with {_NODES}, {_edge_sql('nd', 'e', 'horizontal', None, False)}
  select e.id, e.i, e.j, round(p.x, 6) + 0e0 as xi, round(q.x, 6) + 0e0 as xj,
         round(case when p.x > 0 and q.x > 0 then least(p.x, q.x) when p.x < 0 and q.x < 0 then greatest(p.x, q.x) else 0 end, 6) + 0e0 as level
  from e join nd p on p.id = e.id and p.i = e.i join nd q on q.id = e.id and q.i = e.j""")
def _bars(spark, sf):
    return visibility.bars(_points(spark, sf), "horizontal").select("id", "i", "j", num("xi"), num("xj"), num("level"))


for _name, _kind in (("v_bars_dual_h", "horizontal"), ("v_bars_dual_n", "natural")):
    _low = "where min_x < 0" if _kind == "natural" else ""
    _sql = f"""with {_NODES}, cd as (select id, i, t, x - avg(x) over (partition by id) as x from nd),
      neg as (select id, i, t, -x as x from (select *, min(x) over (partition by id) as min_x from cd) {_low}),
      {_edge_sql('cd', 'up', _kind, None, False)}, {_edge_sql('neg', 'down', _kind, None, False)},
      e as (select id, i, j, case when up.w is null then -1 else 1 end as side from up full join down using (id, i, j))
      select e.id, e.i, e.j, e.side, round(p.x, 6) + 0e0 as xi, round(q.x, 6) + 0e0 as xj,
             round(case when p.x > 0 and q.x > 0 then least(p.x, q.x) when p.x < 0 and q.x < 0 then greatest(p.x, q.x) else 0 end, 6) + 0e0 as level
      from e join cd p on p.id = e.id and p.i = e.i join cd q on q.id = e.id and q.i = e.j"""

    @query(_name, _sql)
    def _dual_bars(spark, sf, kind=_kind):
        return visibility.bars(_centred(spark, sf), kind, two_sided=True).select("id", "i", "j", "side", num("xi"), num("xj"), num("level"))


for _name, _method, _opts in (("v_communities", "path", {"direction": "left"}), ("v_betweenness", "betweenness", {"least": 3}), ("v_girvan_newman", "edges", {"least": 3})):

    @query(_name)
    def _communities(spark, sf, method=_method, opts=_opts):
        return community.of_series(_centred(spark, sf), method, **opts)


# -- stores: a given table is written in the format and read back ----------------------------------------------------
def _root(spark) -> str:
    order.settled(spark.range(1))  # sees to the folder that driver and executors share
    return f"{spark.sparkContext.getCheckpointDir()}/entries-{uuid.uuid4().hex}"


@query("s_frame_entry", "select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from customer where c_custkey >= 40")
def _frame_entry(spark, sf):
    entries = store.Entries(spark, _root(spark))
    entries.write(a.table(spark, sf, "customer").repartitionByRange(8, "c_custkey").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"), "customer")
    return entries.read("customer").where("c_custkey >= 40")


@query("s_array_entry", f"with {a.SUPPLIERS_SQL} {OUT} sup where x is not null")
def _array_entry(spark, sf):
    root = _root(spark)
    store.register(spark)
    rows = store.arrays_of(a.supplier_signals(spark, sf))
    rows.write.format("tidemark").mode("overwrite").options(kind="array").save(root, entry="suppliers")
    return cells(store.Entries(spark, root).read("suppliers").select(X("row").alias("id"), X("values").alias("x")))


# -- enrichment ----------------------------------------------------------------------------------------------------
_ENRICH = f"""{a.BRIDGE_SQL}, {a.LISTS_SQL},
  mem as (select distinct list_name, id, term from lists join bridge using (id)),
  n as (select list_name, count(distinct id) as n_list from mem group by list_name),
  x as (select list_name, term, count(*) as x_hits from mem group by list_name, term),
  k as (select term, count(*) as k_family from bridge group by term),
  m as (select count(distinct id) as m_total from bridge),
  rows_ as (select x.*, n_list, k_family, m_total from x join n using (list_name) join k using (term) cross join m)"""
_LOGC = "lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1)"
_PVAL = f"""pv as (
  select r.*, (select least(1, sum(exp({_LOGC.format(n='r.k_family', k='i.i')} + {_LOGC.format(n='(r.m_total - r.k_family)', k='(r.n_list - i.i)')} - ({_LOGC.format(n='r.m_total', k='r.n_list')}))))
    from (select unnest(range(greatest(r.x_hits, r.n_list + r.k_family - r.m_total), least(r.n_list, r.k_family) + 1)) as i) i) as p from rows_ r)"""
_BH = """bh as (select *, min(w) over (partition by list_name order by rp desc, term desc rows unbounded preceding) as q
  from (select *, rp * count(*) over (partition by list_name) / row_number() over (partition by list_name order by rp, term) as w from (select *, round(p, 9) as rp from pv)))"""


def _enriched(spark, sf, **opts):
    return enrich.enrich(a.lists(spark, sf), opts.pop("bridge", None) or a.bridge(spark, sf), **opts)


@query("e_counts", f"with {_ENRICH} select list_name, term, n_list, k_family, m_total, x_hits from rows_")
def _counts(spark, sf):
    return _enriched(spark, sf).select("list_name", "term", "n_list", "k_family", "m_total", "x_hits")


@query("e_hyper", f"with {_ENRICH}, {_PVAL} select list_name, term, round(p, 6) + 0e0 as p_value from pv")
def _hyper(spark, sf):
    return _enriched(spark, sf).select("list_name", "term", num("p_value"))


@query("e_bh", f"with {_ENRICH}, {_PVAL}, {_BH} select list_name, term, round(q, 6) + 0e0 as q_value, round(q, 12) <= 0.3e0 as significant from bh")
def _bh(spark, sf):
    rows = _enriched(spark, sf).withColumn("p_value", F.round("p_value", 9)).drop("q_value", "significant")
    return enrich.benjamini_hochberg(rows, 0.3).select("list_name", "term", num("q_value"), "significant")


@query("e_cutoffs", f"""with {_ENRICH}, {_PVAL}, {_BH}
  select list_name, round(coalesce(max(case when round(q, 12) <= 0.3e0 then rp end), 0), 6) + 0e0 as p_cutoff, round(coalesce(max(case when round(q, 12) <= 0.3e0 then q end), 0), 6) + 0e0 as q_cutoff from bh group by list_name""")
def _cutoff_values(spark, sf):
    rounded = lambda n, k, m, x: F.round(enrich.hypergeometric_tail(n, k, m, x), 9)
    return _enriched(spark, sf, test=rounded, alpha=0.3).select("list_name", num("p_cutoff"), num("q_cutoff")).distinct()


# a user's test and correction: binomial tails by the number of terms, terms of more than a hit
_BINOMIAL = f"""{_ENRICH}, pv as (select *, k_family / cast(m_total as double) as r from rows_),
  pb as (select *, least(1, (select sum(exp({_LOGC.format(n='pv.n_list', k='i.i')} + i.i * ln(r) + (pv.n_list - i.i) * ln(1 - r))) from (select unnest(range(x_hits, n_list + 1)) as i) i)) as p from pv),
  bf as (select *, least(1, p * count(*) over (partition by list_name)) as q from pb)"""


@query("e_binomial_bonferroni", f"with {_BINOMIAL} select list_name, term, round(p, 6) + 0e0 as p_value, round(q, 6) + 0e0 as q_value, round(q, 12) <= 0.5e0 as significant from bf where x_hits > 1")
def _binomial(spark, sf):
    rows = _enriched(spark, sf, test=enrich.binomial_tail, hypothesis=enrich.bonferroni, alpha=0.5, least_hits=1, how=lambda hits, least: hits > least)
    return rows.select("list_name", "term", num("p_value"), num("q_value"), "significant")


@query("e_numpy_functions", f"with {_BINOMIAL} select list_name, term, round(x_hits / cast(n_list as double) * r, 6) + 0e0 as p_value, round(x_hits / cast(n_list as double) * r * 2, 6) + 0e0 as q_value, x_hits / cast(n_list as double) * r < 1e-3 as significant from bf")
def _numpy_functions(spark, sf):
    test = enrich.numpy_test(lambda n, k, m, x: x / n * (k / m))
    return _enriched(spark, sf, test=test, hypothesis=enrich.numpy_hypothesis(lambda p, level: (2 * p, p < level)), alpha=1e-3).select("list_name", "term", num("p_value"), num("q_value"), "significant")


@query("e_background", f"with {a.BRIDGE_SQL}, {a.LISTS_SQL} select id, term from bridge where id in (select id from lists)")
def _background_lists(spark, sf):
    return enrich.restrict(a.bridge(spark, sf), a.lists(spark, sf).select("id"))


@query("e_termlen", f"with {a.BRIDGE_SQL} select id, term from bridge where term in (select term from bridge group by term having count(*) < 45)")
def _termlen_whole(spark, sf):
    return enrich.restrict(a.bridge(spark, sf), None, 45, "<")


# lists by quarter of the year, in which an id stands once for each segment that has it
_LABELLED = f"""{a.BRIDGE_SQL}, lab as (
  select distinct 'q' || quarter(l_shipdate) as list_name, cast(l_partkey as varchar) as id, c_mktsegment as label
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey where l_quantity >= 50 - quarter(l_shipdate))"""


def _labelled(spark, sf):
    li, o, c = (a.table(spark, sf, t) for t in ("lineitem", "orders", "customer"))
    q = F.quarter("l_shipdate")
    rows = li.where(X("l_quantity") >= 50 - q).join(o, X("l_orderkey") == X("o_orderkey")).join(c, X("o_custkey") == X("c_custkey"))
    return rows.select(F.concat(F.lit("q"), q.cast("string")).alias("list_name"), X("l_partkey").cast("string").alias("id"), X("c_mktsegment").alias("label")).distinct()


for _name, _auto in (("e_multilist", "auto"), ("e_multilist_all", "auto_all")):
    _most = "select list_name, max(c) as c from (select list_name, id, count(*) as c from lab group by all) group by list_name"
    _most = _most if _auto == "auto" else f"select list_name, max(c) over () as c from ({_most})"

    @query(_name, f"""with {_LABELLED}, mem as (select distinct list_name, id || '_' || label as gene, term from lab join bridge using (id)), c as ({_most}),
      n as (select list_name, count(distinct gene) as n_list from mem group by list_name), k as (select term, count(*) as k from bridge group by term), m as (select count(distinct id) as m from bridge)
      select list_name, term, max(n_list) as n_list, max(k.k) * max(c.c) as k_family, max(m.m) * max(c.c) as m_total, count(*) as x_hits
      from mem join n using (list_name) join c using (list_name) join k using (term) cross join m group by list_name, term""")
    def _multilist(spark, sf, auto=_auto):
        return enrich.enrich(_labelled(spark, sf), a.bridge(spark, sf), multiple_lists=True, correction=auto).select("list_name", "term", "n_list", "k_family", "m_total", "x_hits")


@query("e_go", f"""with {a.BRIDGE_SQL}, {a.LISTS_SQL}, b as (select * from bridge where term in (select term from bridge group by term having count(*) >= 2)),
  mem as (select distinct list_name, id, term from lists join b using (id)), n as (select list_name, count(distinct id) as n from mem group by list_name)
  select list_name, term, max(n.n) as n_list, (select count(*) from b where b.term = mem.term) as k_family, (select count(distinct id) from b) as m_total, count(*) as x_hits
  from mem join n using (list_name) group by list_name, term""")
def _go(spark, sf):
    b = a.bridge(spark, sf)
    terms = b.select("term", X("term").alias("name"), F.lit("part").alias("namespace")).distinct()
    return enrich.go_analysis(a.lists(spark, sf), b, terms, only_significant=False).select("list_name", "term", "n_list", "k_family", "m_total", "x_hits")


# whole results with the default filter: p, q, names and hits of significant terms, for lists and for the subgroups of a clustering
_GO = """b as (select * from bridge where term in (select term from bridge group by term having count(*) >= 2)),
  mem as (select distinct list_name, id, term from {lists} join b using (id)), n as (select list_name, count(distinct id) as n_list from mem group by list_name),
  rows_ as (select list_name, term, max(n_list) as n_list, (select count(*) from b where b.term = mem.term) as k_family, (select count(distinct id) from b) as m_total, count(*) as x_hits, string_agg(id, ',' order by id) as hits from mem join n using (list_name) group by list_name, term)"""
_CLUSTERS = """clus as (select p_brand || ':' || cast(p_size % 3 as varchar) || ':' || cast(p_size % 2 as varchar) as list_name, cast(p_partkey as varchar) as id from part)"""
_GO_OUT = "select list_name, term, round(rp, 6) + 0e0 as p_value, round(q, 6) + 0e0 as q_value, term as name, 'part' as namespace, hits from bh where round(q, 12) <= {alpha}"


def _go_out(spark, sf, data, alpha):
    b = a.bridge(spark, sf)
    terms = b.select("term", X("term").alias("name"), F.lit("part").alias("namespace")).distinct()
    rounded = lambda n, k, m, x: F.round(enrich.hypergeometric_tail(n, k, m, x), 9)
    found = enrich.go_analysis(data, b, terms, alpha=alpha, test=rounded)
    return found.select("list_name", "term", num("p_value"), num("q_value"), "name", "namespace", F.array_join(F.transform("hits", lambda h: h["gene"]), ",").alias("hits"))


@query("e_go_significant", f"with {a.BRIDGE_SQL}, {a.LISTS_SQL}, {_GO.format(lists='lists')}, {_PVAL}, {_BH} {_GO_OUT.format(alpha='0.9e0')}")
def _go_significant(spark, sf):
    return _go_out(spark, sf, a.lists(spark, sf), 0.9)


@query("e_go_clusters", f"with {a.BRIDGE_SQL}, {_CLUSTERS}, {_GO.format(lists='clus')}, {_PVAL}, {_BH} {_GO_OUT.format(alpha='0.05e0')}")
def _go_clusters(spark, sf):
    p = a.table(spark, sf, "part")
    clusters = p.select(X("p_brand").alias("trend_class"), (X("p_size") % 3).alias("group"), (X("p_size") % 2).alias("subgroup"), X("p_partkey").cast("string").alias("id"))
    return _go_out(spark, sf, clusters, 0.05)


@query("e_translate_all", f"""with {a.LISTS_SQL}, i as (select id from lists union select p_type from part where p_size = 7), d as (select cast(p_partkey as varchar) as key, p_type as kind, p_name as name, nullif(p_brand, 'Brand#11') as brand from part),
  k as (select 'key' as source, key as id, name, brand from d union all select 'kind', kind, name, brand from d union all select 'name', name, name, brand from d)
  select source, 'name' as target, id, name as found from k join i using (id) union all select source, 'brand', id, brand from k join i using (id)""")
def _translate_all(spark, sf):
    p = a.table(spark, sf, "part")
    d = p.select(X("p_partkey").cast("string").alias("key"), X("p_type").alias("kind"), X("p_name").alias("name"), F.nullif("p_brand", F.lit("Brand#11")).alias("brand"))
    ids = a.lists(spark, sf).select("id").unionAll(p.where("p_size = 7").select("p_type"))
    return enrich.translate_all(ids, d, ["name", "brand"], ["key", "kind", "name"])


_KEGG = """select '{kind}' as analysis, list_name, term, max(n) as n_list, max(k) as k_family, max(m) as m_total, count(*) as x_hits from (
    select distinct l.list_name, l.id, b.term, n.n, k.k, m.m from lists l join {b} b using (id)
    join (select list_name, count(distinct id) as n from lists join {b} using (id) group by list_name) n using (list_name)
    join (select term, count(*) as k from {b} group by term) k using (term) cross join (select count(distinct id) as m from {b}) m) group by list_name, term"""


@query("e_kegg", f"""with {a.BRIDGE_SQL}, {a.LISTS_SQL}, ge as (select * from bridge where term in (select term from bridge group by term having count(*) >= 2)),
  mo as (select cast(p_partkey as varchar) as id, p_type as term from part where p_type in (select p_type from part group by 1 having count(*) >= 2))
  {_KEGG.format(kind='Genomic', b='ge')} union all {_KEGG.format(kind='Molecular', b='mo')}""")
def _kegg(spark, sf):
    genomic = a.bridge(spark, sf).withColumn("id", F.concat(F.lit("hsa:"), "id"))
    molecular = a.table(spark, sf, "part").select(X("p_partkey").cast("string").alias("id"), X("p_type").alias("term"))
    return enrich.kegg_analysis(a.lists(spark, sf), "All", genomic, molecular, only_significant=False).select("analysis", "list_name", "term", "n_list", "k_family", "m_total", "x_hits")


@query("e_union", """with old as (select p_brand as species, p_type as id, p_partkey as v from part), new as (select 'Brand#' || cast(10 + s_suppkey % 5 as varchar) as species, s_name as id, s_suppkey as v from supplier)
  select * from old where species not in (select species from new) union all select * from new""")
def _union(spark, sf):
    old = a.table(spark, sf, "part").select(X("p_brand").alias("species"), X("p_type").alias("id"), X("p_partkey").cast("long").alias("v"))
    new = a.table(spark, sf, "supplier").select(F.concat(F.lit("Brand#"), (10 + X("s_suppkey") % 5).cast("string")).alias("species"), X("s_name").alias("id"), X("s_suppkey").cast("long").alias("v"))
    return enrich.union_dictionaries(old, new)


@query("e_translate", f"with {a.LISTS_SQL}, d as (select cast(p_partkey as varchar) as key, p_name as name, p_brand as target from part) select distinct id, target from (select distinct id from lists) l join d on id = key or id = name where target is not null")
def _translate(spark, sf):
    d = a.table(spark, sf, "part").select(X("p_partkey").cast("string").alias("key"), X("p_name").alias("name"), X("p_brand").alias("target"))
    return enrich.translate(a.lists(spark, sf), d, ["key", "name"], "target")


@query("e_mass", "select q.p_partkey as query, c.p_partkey as compound from part q join part c on c.p_retailprice > q.p_retailprice * (1 - 500 * 1e-6) and c.p_retailprice < q.p_retailprice * (1 + 500 * 1e-6)")
def _mass(spark, sf):
    p = a.table(spark, sf, "part")
    return enrich.match_masses(p.select(X("p_partkey").alias("query"), X("p_retailprice").alias("m")), p.select(X("p_partkey").alias("compound"), X("p_retailprice").alias("mass")), 500)


@query("e_report", f"with {_ENRICH} select list_name, term, x_hits, (select string_agg(id, ', ' order by id) from mem where mem.list_name = rows_.list_name and mem.term = rows_.term) as hits from rows_ where x_hits >= 5")
def _report(spark, sf):
    return enrich.report(_enriched(spark, sf, least_hits=5)).select("list_name", "term", "x_hits", "hits")


# -- formats: a given table is written as the files that a reader takes, and read back ----------------------------------
def _lines(rows: DataFrame, spark: SparkSession, between: str = "\n") -> str:
    root = _root(spark)
    rows.write.option("lineSep", between).text(root)
    return root


@query("s_matrix", f"with {a.SUPPLIERS_SQL} select 'Q' as source, {OUT.removeprefix('select ')} sup where x is not null")
def _matrix_csv(spark, sf):
    """Signals as a CSV of named time points."""
    s, root = a.supplier_signals(spark, sf), _root(spark)
    s.select(F.lit("Q").alias("source"), "id", *[F.get("x", F.lit(i)).alias(str(t)) for i, t in enumerate(a.QUARTER_TIMES)]).write.option("header", True).csv(root)
    back, times = readers.matrix_csv(spark, root)
    if times != a.QUARTER_TIMES:
        raise ValueError(f"other time points: {times}")
    return cells(back.withColumn("id", X("id").cast("long")))


@query("s_json", "select c_custkey, c_name, cast(c_nationkey as bigint) as c_nationkey, c_acctbal, c_mktsegment from customer")
def _json(spark, sf):
    entries = readers.Store(spark, _root(spark))
    entries.write(a.table(spark, sf, "customer"), "customer", json=True)
    return entries.read("customer", json=True).select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@query("s_ontology", "select 'T:' || p_partkey as term, p_name as name, case when p_brand = 'Brand#1' then null else p_type end as namespace from part where p_size <= 45")
def _ontology(spark, sf):
    """Parts as terms: some obsolete, some without a namespace, their lines in two orders; large ones are other stanzas."""
    p = a.table(spark, sf, "part")
    head = F.when(X("p_size") > 45, "[Typedef]").otherwise("[Term]")
    number, name = F.concat(F.lit("id: T:"), X("p_partkey").cast("string")), F.concat(F.lit("name: "), "p_name")
    space, gone = F.when(X("p_brand") != "Brand#1", F.concat(F.lit("namespace: "), "p_type")), F.when(X("p_size") < 5, F.lit("is_obsolete: true"))
    stanza = F.when(X("p_size") % 2 == 0, F.concat_ws("\n", head, number, name, space, gone)).otherwise(F.concat_ws("\n", head, gone, number, space, name))
    return readers.ontology(spark, _lines(p.select(stanza), spark, "\n\n"))


@query("s_annotations", f"with {a.BRIDGE_SQL} select id, term, upper(term) as name from bridge")
def _annotations(spark, sf):
    """Annotations between comments, every one of them twice, with the names that a table of descriptions has for their terms."""
    b = a.bridge(spark, sf)
    line = F.concat_ws("\t", F.lit("DB"), "id", F.lit("symbol"), F.lit(""), "term", F.lit("ref"))
    found = readers.annotations(spark, _lines(b.select(F.explode(F.array(line, F.concat(F.lit("! of "), "id"), line))), spark))
    names = _lines(b.select("term").distinct().select(F.concat_ws("\t", "term", F.upper("term"))), spark)
    return found.join(readers.descriptions(spark, names).select("term", "name"), "term", "left").select("id", "term", "name")


@query("s_links", "select distinct cast(l_partkey as varchar) as id, 'path:' || l_suppkey as term from lineitem")
def _links(spark, sf):
    rows = a.table(spark, sf, "lineitem").select(F.concat_ws("\t", F.concat(F.lit("path:"), X("l_suppkey").cast("string")), X("l_partkey").cast("string")))
    return readers.links(spark, _lines(rows, spark))


@query("s_molecules", "select cast(p_partkey as varchar) as pumchem, case when p_size > 45 then null else 'cpd:' || p_partkey end as cpd from part")
def _molecules(spark, sf):
    number = X("p_partkey").cast("string")
    cpd = F.when(X("p_size") > 45, F.lit('""')).otherwise(F.concat(F.lit("'cpd:"), number, F.lit("'")))
    return readers.molecules(spark, _lines(a.table(spark, sf, "part").select(F.concat(F.lit('"'), number, F.lit('", '), cpd)), spark))


@query("s_masses", "select p_brand as species, p_brand || ':' || p_partkey as compound, p_retailprice as mass from part where p_size <= 45")
def _masses(spark, sf):
    """Prices as masses; large parts have none."""
    mass = F.when(X("p_size") > 45, F.lit("")).otherwise(X("p_retailprice").cast("string"))
    return readers.masses(spark, _lines(a.table(spark, sf, "part").select(F.concat("p_brand", F.lit(":"), X("p_partkey").cast("string"), F.lit(","), mass)), spark))


@query("s_cross_reference", """select p_partkey as kg_id, p_name as symbol, cast(p_partkey as varchar) as kegg, nullif(case when s_acctbal < 0 then '' else s_name end, '') as refseq, c_mktsegment as affy
  from part left join supplier on p_partkey = s_suppkey left join customer on p_partkey = c_custkey""")
def _cross_reference(spark, sf):
    p, s, c = (a.table(spark, sf, t) for t in ("part", "supplier", "customer"))
    main = p.select(X("p_partkey").alias("kg_id"), X("p_name").alias("symbol"), F.concat(F.lit("hsa+"), X("p_partkey").cast("string")).alias("kegg"))
    refseq = s.select(X("s_suppkey").alias("kg_id"), F.when(X("s_acctbal") < 0, "").otherwise(X("s_name")).alias("refseq"))
    return readers.cross_reference(main, refseq, c.select(X("c_custkey").alias("kg_id"), X("c_mktsegment").alias("affy")))


@query("s_associations", """with c as (select cast(l_suppkey as varchar) as id, l_returnflag as label, (year(l_shipdate) - 1995) as t, sum(l_quantity) as x from lineitem where year(l_shipdate) between 1995 and 2001 group by all)
  select cast(cast(id as bigint) // 100 as varchar) as class, id, label, t, x from c""")
def _associations(spark, sf):
    """Yearly quantities by supplier and flag as nested associations, one file for each hundred suppliers."""
    year = F.year("l_shipdate") - 1995
    long = a.table(spark, sf, "lineitem").where(year.between(0, 6)).groupBy(X("l_suppkey").alias("id"), X("l_returnflag").alias("label")).agg(*[F.sum(F.when(year == t, X("l_quantity"))).alias(f"x{t}") for t in range(7)])
    some = F.array(*[F.coalesce(X(f"x{t}").cast("string"), F.lit("Missing[]")) for t in range(7)])
    listed = F.concat(F.lit("{"), F.array_join(some, ", "), F.lit("}"))
    member = F.concat(F.lit('{"'), X("id").cast("string"), F.lit('", "'), "label", F.lit('"} -> {{1., 0.}, '), listed, F.lit("}"))
    texts = long.groupBy(F.expr("id div 100").alias("part")).agg(F.array_join(F.collect_list(member), ",\n").alias("m"))
    root = _root(spark)
    texts.select("part", F.concat(F.lit('<|"'), X("part").cast("string"), F.lit('" -> <|'), "m", F.lit("|>|>")).alias("value")).write.partitionBy("part").text(root)
    return readers.classified_signals(spark, root).select("class", "id", "label", F.posexplode("series").alias("t", "x")).where("x is not null").withColumn("t", X("t").cast("long"))


@query("k_report", f"with {_ENRICH}, {_PVAL} select list_name as sheet, term, cast(x_hits as bigint) as x_hits, round(p, 6) + 0e0 as p_value, (select string_agg(id, ', ' order by id) from mem where mem.list_name = pv.list_name and mem.term = pv.term) as hits from pv where x_hits >= 5")
def _report_files(spark, sf):
    """The sheets of a report, read back by their names."""
    root = _root(spark)
    sinks.write_report(_enriched(spark, sf, least_hits=5), root)
    back = spark.read.option("header", True).csv(root)
    return back.select("sheet", "term", X("x_hits").cast("long").alias("x_hits"), X("p_value").cast("double").alias("p_value"), "hits").withColumn("p_value", num("p_value"))


@query("k_clusters", f"""with {a.SUPPLIERS_SQL} select cast(s_nationkey as bigint) as "group", case when s_acctbal < 0 then 1 else 0 end as subgroup, {OUT.removeprefix('select ').removesuffix(' from')} from sup join supplier on id = s_suppkey where x is not null""")
def _cluster_files(spark, sf):
    """Suppliers in groups by nation and subgroups by the sign of their balance, as the folders of clustered signals."""
    root, s = _root(spark), a.table(spark, sf, "supplier")
    placed = s.select(X("s_suppkey").alias("id"), X("s_nationkey").alias("group"), F.when(X("s_acctbal") < 0, 1).otherwise(0).alias("subgroup"), X("s_suppkey").alias("leaf_order"))
    sinks.write_clusters(placed, a.supplier_signals(spark, sf), root)
    back = spark.read.option("header", True).option("escape", '"').csv(root)
    return cells(back.select(X("group").cast("long").alias("group"), "subgroup", X("id").cast("long").alias("id"), F.from_json("x", "array<double>").alias("x")))


# -- subjects ------------------------------------------------------------------------------------------------------
_PAIRS = f"""{a.SUBJECTS_SQL}, ids as (select distinct subject, id from subj),
  pr as (select p.subject as a, q.subject as b, p.id from ids p join ids q on p.id = q.id and p.subject < q.subject),
  ce as (select pr.a, pr.b, pr.id, p.x as xa, q.x as xb from pr left join subj p on p.subject = a and p.id = pr.id left join subj q on q.subject = b and q.id = pr.id and q.t = p.t)"""


def _link_out(d: DataFrame) -> DataFrame:
    return d.select("a", "b", "linked", "common", F.array_join(F.transform("ids", lambda v: v.cast("string")), ",").alias("ids"))


_LINK = "select a, b, count(*) filter (where l) as linked, count(*) as common, coalesce(string_agg(case when l then id end, ',' order by id), '') as ids from (select a, b, id, coalesce({l}, false) as l from ce group by a, b, id) group by a, b"
_EVERY = "count(xb) = 7 and "  # signals of seven years without a gap
query("m_links_dist_complete", f"with {_PAIRS} " + _LINK.format(l=_EVERY + "sqrt(coalesce(sum((xa - xb) * (xa - xb)), 0)) < 2500"))(lambda spark, sf: _link_out(subjects.links_by_distance(a.subject_signals(spark, sf), 2500)))
query("m_links_corr_complete", f"with {_PAIRS} " + _LINK.format(l=_EVERY + "corr(xa, xb) > 0.2e0"))(lambda spark, sf: _link_out(subjects.links_by_correlation(a.subject_signals(spark, sf), 0.2)))
query("m_links_dist", f"with {_PAIRS} " + _LINK.format(l="sqrt(coalesce(sum((xa - xb) * (xa - xb)), 0)) < 2500"))(lambda spark, sf: _link_out(subjects.links_by_distance(a.subject_signals(spark, sf), 2500, complete=False)))
query("m_links_corr", f"with {_PAIRS} " + _LINK.format(l="corr(xa, xb) > 0.2e0"))(lambda spark, sf: _link_out(subjects.links_by_correlation(a.subject_signals(spark, sf), 0.2, complete=False)))


@query("m_structure", "select n_regionkey as community, string_agg(n_name, ',' order by n_name) as subjects from nation group by 1")
def _structure(spark, sf):
    p = a.table(spark, sf, "nation").select(X("n_name").alias("subject"), X("n_regionkey").alias("community"))
    return subjects.structure(p).select("community", F.array_join("subjects", ",").alias("subjects"))


_GENES_SQL = """sg as (select distinct n_name as subject, n_regionkey as community, c_mktsegment || '+' || cast(c_custkey % 40 as varchar) as gene from customer join nation on c_nationkey = n_nationkey),
  pg as (select p.subject as sa, q.subject as sb, p.community as ca, q.community as cb, p.gene from sg p join sg q on p.gene = q.gene and p.subject < q.subject),
  cnt as (select ca as community, gene, count(*) as cnt from pg where ca = cb group by 1, 2)"""


def _pair_genes(spark, sf):
    c, n = a.table(spark, sf, "customer"), a.table(spark, sf, "nation")
    g = c.join(F.broadcast(n), X("c_nationkey") == X("n_nationkey")).select(X("n_name").alias("subject"), X("n_regionkey").alias("community"), F.concat("c_mktsegment", F.lit("+"), (X("c_custkey") % 40).cast("string")).alias("gene")).distinct()
    pairs = g.select(X("subject").alias("subj_a"), "gene", X("community").alias("ca")).join(g.select(X("subject").alias("subj_b"), "gene", X("community").alias("cb")), "gene").where("subj_a < subj_b")
    return pairs, n.select(X("n_name").alias("subject"), X("n_regionkey").alias("community"))


@query("m_genes_all", f"with {_GENES_SQL}, np as (select ca as community, count(*) as n from (select distinct ca, sa, sb from pg where ca = cb) group by 1) select community, gene from cnt join np using (community) where cnt = n")
def _genes(spark, sf):
    pairs, partition = _pair_genes(spark, sf)
    return subjects.common_genes(pairs.select("subj_a", "subj_b", "gene"), partition)


def _counted(spark, sf):
    return _pair_genes(spark, sf)[0].where("ca = cb").groupBy(X("ca").alias("community"), "gene").agg(F.count(F.lit(1)).alias("cnt"))


@query("m_top_n", f"with {_GENES_SQL} select * from (select community, gene, cnt, row_number() over (partition by community order by cnt desc, gene) as rank from cnt) where rank <= 7")
def _top_n(spark, sf):
    return subjects.top_genes(_counted(spark, sf), 7)


@query("m_top_freq", f"with {_GENES_SQL} select community, gene, cnt from (select *, max(cnt) over (partition by community) as t from cnt) where cnt >= round_even(t * 0.75e0, 0)")
def _top_freq(spark, sf):
    return subjects.frequent_genes(_counted(spark, sf), 25)


@query("m_split", f"with {_GENES_SQL} select split_part(gene, '+', 1) as name, count(*) as n from cnt group by 1")
def _split(spark, sf):
    return _counted(spark, sf).groupBy(subjects.split_names(X("gene")).alias("name")).agg(F.count(F.lit(1)).alias("n"))


@query("a_pearson", f"with {_PAIRS} select a, b, id, round(corr(xa, xb), 6) + 0e0 as r from ce group by a, b, id having corr(xa, xb) is not null and not isnan(corr(xa, xb))")
def _pearson(spark, sf):
    p = subjects._pairs(a.subject_signals(spark, sf))
    return p.withColumn("r", transform.correlation(X("xa"), X("xb"))).where("r is not null").select("a", "b", "id", num("r"))


@query("a_multimap", "select p_brand as term, string_agg(distinct p_type, ',' order by p_type) as ids from part group by 1")
def _multimap(spark, sf):
    return a.table(spark, sf, "part").groupBy(X("p_brand").alias("term")).agg(F.array_join(F.array_sort(F.collect_set("p_type")), ",").alias("ids"))


@query("a_percentile", f"with {a.SUPPLIERS_SQL} select id, round(quantile_cont(x, 0.3e0), 6) + 0e0 as p30, list_sort(list(x))[cast(floor((count(x) - 1) * 0.3e0) as integer) + 1] as lower30 from sup where x is not null group by id")
def _percentile(spark, sf):
    c = model.to_long(a.supplier_signals(spark, sf)).where("x is not null")
    return c.groupBy("id").agg(F.percentile("x", 0.3).alias("p30"), model.lower_quantile(F.collect_list("x"), 0.3).alias("lower30")).select("id", num("p30"), "lower30")


# -- clusters ------------------------------------------------------------------------------------------------------
def _classified(spark, sf):
    s = a.supplier_signals(spark, sf)
    feature = spectral.autocorrelation(transform.unit_norm(s), a.QUARTER_TIMES).select("id", X("x").alias("feature"))
    return transform.unit_norm(s).join(feature, "id").withColumn("trend_class", F.concat(F.lit("c"), (X("id") % 4).cast("string")))


query("g_groups")(lambda spark, sf: cluster.two_levels(_classified(spark, sf)))
query("g_groups_silhouette")(lambda spark, sf: cluster.two_levels(_classified(spark, sf), rule="silhouette"))


@query("g_silhouette", """with e as (select vec_id as place, label as c, [cast(v as double) for v in embedding] as x from embeddings),
  s as (select p.place, p.c, q.c as o, sum(list_distance(p.x, q.x)) as s from e p join e q on p.place <> q.place group by all), n as (select c as o, count(*) as n from e group by 1),
  w as (select place, c, max(case when o = c then n end) as own, max(case when o = c then s / greatest(n - 1, 1) end) as a, min(case when o <> c then s / n end) as b from s join n using (o) group by place, c)
  select place, c as cluster, round(case when own > 1 and b is not null then coalesce((b - a) / nullif(greatest(a, b), 0), 0) else 0 end, 6) + 0e0 as width from w""")
def _silhouette(spark, sf):
    e = a.table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"), X("label").alias("cluster"))
    return cluster.silhouettes(order.numbered(e, None, ["vec_id"], "place")).select("place", "cluster", num("width"))


@query("g_kmeans_ari")
def _ari(spark, sf):
    v = a.table(spark, sf, "embeddings").select(X("vec_id").alias("id"), F.transform("embedding", lambda c: c.cast("double")).alias("x"))
    return cluster.adjusted_rand(cluster.kmeans(v, 10, 1), cluster.kmeans(v, 10, 2))


@query("g_class_flow")
def _class_flow(spark, sf):
    """Classes of the suppliers' signals, their clusters, and the cells of each in the order of leaves."""
    s = a.supplier_signals(spark, sf)
    unit = transform.unit_norm(s)
    found = cluster.class_clusters(unit, categorize.categorise(s, a.QUARTER_TIMES, samples=SAMPLES, prepare=False), spectral.autocorrelation(unit, a.QUARTER_TIMES))
    return found.select("trend_class", "id", "group", "subgroup", "leaf_order", F.posexplode("x").alias("t", "x"))


@query("g_optimise_k")
def _optimise_k(spark, sf):
    best, scores = cluster.optimise_k(clean.fill_missing(transform.unit_norm(a.supplier_signals(spark, sf)), 0.0), list(range(2, 7)))
    return spark.createDataFrame([(k, v, k == best) for k, v in scores.items()], "k int, score double, best boolean")


@query("g_estimate_k")
def _estimate_k(spark, sf):
    best, scores = cluster.estimate_k(clean.fill_missing(transform.unit_norm(a.supplier_signals(spark, sf)), 0.0), 3, 8, 3)
    return spark.createDataFrame([(k, v, k == best) for k, v in scores.items()], "k int, score double, best boolean")
