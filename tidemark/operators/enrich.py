"""Over-representation of annotation terms in lists of identifiers."""

from __future__ import annotations

import math
import operator
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .model import let
from .order import settled

X = F.col
COMPARE = {">=": operator.ge, ">": operator.gt, "<=": operator.le, "<": operator.lt, "=": operator.eq}
MISSING = "Missing"
#: Rows of a list that match_masses() joins as one: compounds, and queries.
PACK, FEW = 2048, 16
#: Entries of a dictionary under one key from which on translate_all() leaves them where they are.
FREQUENT = 20_000
#: How a count compares with a number: a name of COMPARE, or a function of two columns.
How = str | Callable[[Column, Column], Column]
#: The p-value of a term by its list's size n, its family's size k, the population m and the hits x.
Test = Callable[[Column, Column, Column, Column], Column]
#: rows(list_name, term, p_value, ...) and a level, to rows with q_value, significant, p_cutoff and q_cutoff.
Hypothesis = Callable[[DataFrame, float], DataFrame]


def compare(count: Column, how: How, than) -> Column:
    return (COMPARE[how] if isinstance(how, str) else how)(count, F.lit(than))


def normalise_lists(spark, data) -> DataFrame:
    """(list_name, id, label) from the shapes lists come in.

    [id], [[id]], [[id, label]], [[id, mass, time, label]], or a dictionary of such lists by name. An unnamed list is
    called `list`. A DataFrame passes through.
    """
    if isinstance(data, DataFrame):
        return data.select("list_name", "id", "label")
    named = data if isinstance(data, dict) else {"list": data}

    def item(x):
        x = [x] if isinstance(x, str) else list(x)
        return x[0], x[3] if len(x) > 3 else (x[1] if len(x) > 1 else None)

    rows = [(str(name), *item(x)) for name, items in named.items() for x in items]
    return spark.createDataFrame(rows, "list_name string, id string, label string")


def translate(ids: DataFrame, dictionary: DataFrame, sources: list[str], target: str) -> DataFrame:
    """(id, target): distinct non-null translations through any of the source columns of a wide dictionary."""
    pairs = dictionary.select(X(target).alias("target"), F.explode(F.array(*[X(c) for c in sources])).alias("id")).where("id is not null and target is not null").distinct()
    return ids.select("id").distinct().join(pairs, "id").select("id", "target").distinct()


def translate_all(ids: DataFrame, dictionary: DataFrame, targets: list[str], sources: list[str] | None = None) -> DataFrame:
    """(source, target, id, found): every match of ids(id) in any column of a wide dictionary, by the column it stands in.

    Without `sources` all columns are searched. A row of the dictionary that has no such target gives a null; matches are
    not merged, so repeated rows repeat. Entries of a frequent key are not dealt by it: they meet a broadcast of such keys,
    one for each FREQUENT entries at most, and only the rest are sorted and merged.
    """
    sources = sources or dictionary.columns
    entries = F.explode(F.array(*[F.struct(F.lit(c).alias("source"), X(c).cast("string").alias("id")) for c in sources]))
    found = F.array(*[F.struct(F.lit(c).alias("target"), X(c).cast("string").alias("found")) for c in targets])
    long = dictionary.select(entries.alias("_k"), found.alias("_f")).select("_k.source", "_k.id", "_f").where("id is not null")
    asked = ids.select(X("id").cast("string").alias("id"), F.lit(0).cast("long").alias("n"), F.lit(True).alias("_asked"))
    keys = long.select("id", F.lit(1).cast("long").alias("n"), F.lit(False).alias("_asked")).unionAll(asked)
    keys = keys.groupBy("id").agg(F.sum("n").alias("n"), F.max("_asked").alias("_asked"))
    long = long.join(F.broadcast(keys.where(X("n") >= FREQUENT).select("id", "_asked")), "id", "left")
    rare = keys.where((X("n") > 0) & (X("n") < FREQUENT) & X("_asked")).select("id")
    hit = long.where("_asked").unionByName(long.where("_asked is null").join(rare.hint("merge"), "id"))
    return hit.select("source", "id", F.explode("_f").alias("_f")).select("source", "_f.target", "id", "_f.found")


def restrict(bridge: DataFrame, background: DataFrame | None = None, length: int | None = None, how: How = ">=") -> DataFrame:
    """A bridge (id, term) cut to background ids, then to terms whose number of ids compares with `length`."""
    bridge = bridge.distinct()
    if background is not None:
        bridge = bridge.join(background.select("id").distinct(), "id", "left_semi")
    if length is not None:
        sizes = bridge.groupBy("term").agg(F.count(F.lit(1)).alias("k")).where(compare(X("k"), how, length))
        bridge = bridge.join(sizes.select("term"), "term", "left_semi").select("id", "term")
    return bridge


def union_dictionaries(old: DataFrame, new: DataFrame, species: str = "species") -> DataFrame:
    """All rows of both, but those of species that `new` has come from `new` alone."""
    return old.join(new.select(species).distinct(), species, "left_anti").select(*old.columns).unionByName(new, allowMissingColumns=True)


def log_factorial(n: Column) -> Column:
    """ln n! as an expression, whatever n: Stirling's series eight steps on, exact to double precision, less the steps."""
    z = n.cast("double") + 9
    r = 1 / (z * z)
    series = (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r * (1 / 1680 - r / 1188)))) / z
    steps = (z - 1) * (z - 2) * (z - 3) * (z - 4) * (z - 5) * (z - 6) * (z - 7) * (z - 8)
    return (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + series - F.ln(steps)


def _log_factorials(signed: list[tuple[int, Column]]) -> Column:
    """The sum of ln n!, each with its sign; each n is worked out once."""
    parts = F.zip_with(F.array(*[c for _, c in signed]), F.array(*[F.lit(float(g)) for g, _ in signed]), lambda n, g: g * log_factorial(n))
    return F.aggregate(parts, F.lit(0.0), lambda a, v: a + v)


def hypergeometric_tail(n: Column, k: Column, m: Column, x: Column) -> Column:
    """P(X >= x) of the hypergeometric distribution: n draws from m with k marked.

    Terms are summed from the largest on, each by its ratio to the one before: upwards from x beyond the mode, else
    downwards from x - 1 for the complement.
    """
    given = F.struct(*[c.cast("double").alias(name) for name, c in zip("nkmx", (n, k, m, x), strict=True)])

    def ends(g: Column) -> Column:
        above = g["x"] > F.floor((g["n"] + 1) * (g["k"] + 1) / (g["m"] + 2))
        return F.struct(*[g[c].alias(c) for c in "nkmx"], F.greatest(F.lit(0.0), g["n"] + g["k"] - g["m"]).alias("least"), F.least(g["n"], g["k"]).alias("most"), above.alias("above"))

    def place(g: Column) -> Column:
        at = F.when(g["above"], F.greatest(g["x"], g["least"])).otherwise(g["x"] - 1)
        return F.struct(g.alias("g"), at.alias("at"), F.greatest(F.when(g["above"], g["most"] - at).otherwise(at - g["least"]), F.lit(0.0)).cast("int").alias("steps"))

    def tail(h: Column) -> Column:
        g, at = h["g"], h["at"]
        n, k, m, x, above = (g[c] for c in ("n", "k", "m", "x", "above"))
        first = F.exp(_log_factorials([(1, n), (1, m - n), (1, k), (1, m - k), (-1, m), (-1, at), (-1, n - at), (-1, k - at), (-1, m - n - k + at)]))

        def step(a: Column, _: Column) -> Column:
            i = a["i"]
            ratio = F.when(above, (n - i) * (k - i) / ((i + 1) * (m - n - k + i + 1))).otherwise(i * (m - n - k + i) / ((n - i + 1) * (k - i + 1)))
            return F.struct((a["sum"] + a["term"] * ratio).alias("sum"), (a["term"] * ratio).alias("term"), (i + F.when(above, 1.0).otherwise(-1.0)).alias("i"))

        start = let(first, lambda v: F.struct(v.alias("sum"), v.alias("term"), at.alias("i")))
        turns = F.when(h["steps"] > 0, F.sequence(F.lit(1), h["steps"])).otherwise(F.array().cast("array<int>"))
        total = F.aggregate(turns, start, step, lambda a: F.when(above, a["sum"]).otherwise(1 - a["sum"]))
        return F.when(x <= g["least"], 1.0).when(x > g["most"], 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))

    return let(given, lambda g: let(ends(g), lambda e: let(place(e), tail)))


def binomial_tail(n: Column, k: Column, m: Column, x: Column) -> Column:
    """P(X >= x) of n draws that hit with chance k / m each.

    Terms further than 40 deviations and 800 hits from the mean, or from x beyond it, add up to less than 1e-300 of the rest, and are left out.
    """
    p, top = k / m, n
    reach = 40 * F.sqrt(F.greatest(n * p * (1 - p), F.lit(0.0))) + 800
    first, last = F.greatest(x, F.floor(n * p - reach)), F.least(top, F.ceil(F.greatest(x, n * p) + reach))
    term = lambda i: F.exp(_log_factorials([(1, n), (-1, i), (-1, n - i)]) + i * F.ln(p) + F.when(i == n, F.lit(0.0)).otherwise((n - i) * F.ln(1 - p)))
    terms = F.when(x <= top, F.transform(F.sequence(first.cast("int"), last.cast("int")), term)).otherwise(F.array().cast("array<double>"))
    return F.when(k >= m, 1.0).otherwise(F.least(F.lit(1.0), F.aggregate(terms, F.lit(0.0), lambda a, v: a + v)))


def numpy_test(f: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> Test:
    """A test from a function of NumPy arrays n, k, m, x, called with a batch of rows at a time."""

    @F.pandas_udf("double")
    def run(n: pd.Series, k: pd.Series, m: pd.Series, x: pd.Series) -> pd.Series:
        return pd.Series(np.asarray(f(*(c.to_numpy(float) for c in (n, k, m, x))), float))

    return lambda n, k, m, x: run(n, k, m, x)


def hypergeometric(rows: DataFrame, x: str = "x_hits", n: str = "n_list", k: str = "k_family", m: str = "m_total", test: Test = hypergeometric_tail) -> DataFrame:
    """rows with p_value, an expression of each row."""
    return rows.withColumn("p_value", test(X(n), X(k), X(m), X(x)))


def _with_cutoffs(rows: DataFrame, by: str) -> DataFrame:
    """rows(significant, p_value, q_value) with p_cutoff and q_cutoff: the largest of a list's significant ones, 0 if none is."""
    over = Window.partitionBy(by)
    most = lambda c: F.coalesce(F.max(F.when(X("significant"), X(c))).over(over), F.lit(0.0))
    return rows.withColumns({"p_cutoff": most("p_value"), "q_cutoff": most("q_value")})


def benjamini_hochberg(rows: DataFrame, alpha: float = 0.05, by: str = "list_name", tie: str = "term") -> DataFrame:
    """rows with q_value, significant, p_cutoff and q_cutoff, adjusted within each list."""
    up, down = Window.partitionBy(by).orderBy("p_value", tie), Window.partitionBy(by).orderBy(F.desc("p_value"), F.desc(tie)).rowsBetween(Window.unboundedPreceding, 0)
    w = X("p_value") * F.count(F.lit(1)).over(Window.partitionBy(by)) / F.row_number().over(up)
    rows = rows.withColumn("_w", w).withColumn("q_value", F.min("_w").over(down)).drop("_w")
    return _with_cutoffs(rows.withColumn("significant", F.round("q_value", 12) <= alpha), by)


def bonferroni(rows: DataFrame, alpha: float = 0.05, by: str = "list_name") -> DataFrame:
    """The same by the number of terms of the list."""
    rows = rows.withColumn("q_value", F.least(F.lit(1.0), X("p_value") * F.count(F.lit(1)).over(Window.partitionBy(by))))
    return _with_cutoffs(rows.withColumn("significant", F.round("q_value", 12) <= alpha), by)


def numpy_hypothesis(f: Callable[[np.ndarray, float], tuple[np.ndarray, np.ndarray]], by: str = "list_name", tie: str = "term") -> Hypothesis:
    """A correction from a function of a list's p-values, in order of terms, and the level, to (q-values, which are significant)."""

    def correct(rows: DataFrame, alpha: float) -> DataFrame:
        def run(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values(tie)
            q, significant = f(frame["p_value"].to_numpy(float), alpha)
            return pd.DataFrame({"_by": frame[by], "_tie": frame[tie], "q_value": np.asarray(q, float), "significant": np.asarray(significant, bool)})

        kind = lambda c: rows.schema[c].dataType.simpleString()
        found = rows.select(by, tie, "p_value").groupBy(by).applyInPandas(run, f"_by {kind(by)}, _tie {kind(tie)}, q_value double, significant boolean")
        both = rows.join(found, rows[by].eqNullSafe(found["_by"]) & (rows[tie] == found["_tie"])).drop("_by", "_tie")
        return _with_cutoffs(both, by)

    return correct


def enrich(
    lists: DataFrame,
    bridge: DataFrame,
    terms: DataFrame | None = None,
    dictionary: tuple[DataFrame, list[str], str] | None = None,
    prefix: str = "",
    multiple_lists: bool = False,
    correction: int | str = 1,
    alpha: float = 0.05,
    least_hits: int = 1,
    how: How = ">=",
    only_significant: bool = False,
    test: Test = hypergeometric_tail,
    hypothesis: Hypothesis = benjamini_hochberg,
) -> DataFrame:
    """list_name, term, p_value, q_value, significant, n_list, k_family, m_total, x_hits, name, namespace, hits, p_cutoff, q_cutoff.

    `test` builds the p-value from a term's numbers (hypergeometric_tail, binomial_tail, one of your own, numpy_test of a
    function), `hypothesis` corrects a list's terms (benjamini_hochberg, bonferroni, numpy_hypothesis of a function), and
    `how` compares the hits with least_hits.

    lists(list_name, id, label), bridge(id, term), terms(term, name, namespace). A dictionary (table, source columns,
    target column) translates ids first. With multiple_lists an id under several labels is several members, and the
    correction `auto` multiplies family and population by the largest number of times that the list names one id;
    `auto_all` by the largest of all lists, as for the subgroups of one clustering. Terms that the table of terms lacks
    keep a null name. Ids without a term don't count.
    """
    lists = lists.where(X("id").isNotNull() & (X("id") != MISSING)).select("list_name", "id", F.coalesce("label", F.lit("")).alias("label"))
    named = lists.withColumn("gene", F.concat_ws("_", "id", "label") if multiple_lists else X("id"))
    if isinstance(correction, str) and correction not in ("auto", "auto_all"):
        raise ValueError(f"unknown correction {correction!r}")
    times = lists.groupBy("list_name", "id").agg(F.count(F.lit(1)).alias("c")).groupBy("list_name").agg(F.max("c").alias("_times"))
    if not multiple_lists or isinstance(correction, int):
        times = times.withColumn("_times", F.lit(1 if isinstance(correction, str) else correction).cast("long"))
    elif correction == "auto_all":
        most = times.agg(F.max("_times").alias("_times"))  # one row
        times = times.select("list_name").join(F.broadcast(most))
    keys = named
    if dictionary is not None:
        table, sources, target = dictionary
        keys = named.join(translate(named, table, sources, target), "id").withColumn("id", X("target")).drop("target")
    member = keys.withColumn("id", F.concat(F.lit(prefix), "id")).join(bridge, "id").groupBy("list_name", "gene", "term").agg(F.array_distinct(F.collect_list("label")).alias("labels"))
    n = member.groupBy("list_name").agg(F.countDistinct("gene").alias("n_list"))
    x = member.groupBy("list_name", "term").agg(F.count(F.lit(1)).alias("x_hits"), F.array_sort(F.collect_list(F.struct("gene", "labels"))).alias("hits"))
    k = bridge.groupBy("term").agg(F.count(F.lit(1)).alias("k_family"))
    m = bridge.agg(F.countDistinct("id").alias("m_total"))  # one row
    rows = x.join(n.join(times, "list_name"), "list_name").join(k, "term").join(F.broadcast(m))
    rows = hypergeometric(rows.withColumn("k_family", X("k_family") * X("_times")).withColumn("m_total", X("m_total") * X("_times")).drop("_times"), test=test)
    rows = hypothesis(rows, alpha).where(compare(X("x_hits"), how, least_hits))
    if only_significant:
        rows = rows.where("significant")
    if terms is None:
        rows = rows.withColumn("name", F.lit(None).cast("string")).withColumn("namespace", F.lit(None).cast("string"))
    else:
        rows = rows.join(terms.select("term", "name", "namespace"), "term", "left")
    return rows.select("list_name", "term", "p_value", "q_value", "significant", "n_list", "k_family", "m_total", "x_hits", "name", "namespace", "hits", "p_cutoff", "q_cutoff")


def cluster_lists(clusters: DataFrame, label: str | None = None) -> DataFrame:
    """(list_name, id, label) of a clustering (trend_class, id, group, subgroup): a list for each subgroup, `class:group:subgroup`."""
    name = F.concat_ws(":", *[F.coalesce(X(c).cast("string"), F.lit("")) for c in ("trend_class", "group", "subgroup")])
    return clusters.select(name.alias("list_name"), X("id").cast("string").alias("id"), (X(label) if label else F.lit(None)).cast("string").alias("label"))


def _lists(data, spark) -> tuple[DataFrame, bool]:
    """The lists of any accepted input, and whether they are the subgroups of a clustering."""
    if isinstance(data, DataFrame) and {"group", "subgroup", "trend_class"} <= set(data.columns):
        return cluster_lists(data), True
    return normalise_lists(spark, data), False


def go_analysis(data, annotations: DataFrame, terms: DataFrame, dictionary=None, background: DataFrame | None = None, length: int = 2, length_how: How = ">=", correction: int | str = 1, only_significant: bool = True, **options) -> DataFrame:
    """enrich() with the ontology defaults: terms of two ids or more, a hit or more, significant ones at 0.05.

    data: lists in any shape, or a clustering, whose subgroups share one automatic correction. annotations(id, term).
    """
    lists, clustered = _lists(data, annotations.sparkSession)
    bridge = restrict(annotations, background, length, length_how)
    return enrich(lists, bridge, terms, dictionary, correction="auto_all" if clustered and correction == "auto" else correction, only_significant=only_significant, **options)


def kegg_analysis(data, kind: str = "Genomic", genomic: DataFrame | None = None, molecular: DataFrame | None = None, terms: DataFrame | None = None, dictionary=None, molecular_dictionary=None, prefix: str = "hsa:", length: int = 2, length_how: How = ">=", correction: int | str = 1, only_significant: bool = True, **options) -> DataFrame:
    """enrich() with the pathway defaults, and the column analysis.

    Genomic ids get the organism's prefix; Molecular ones none, and no correction; All gives both analyses. genomic and
    molecular are (id, term).
    """
    if kind not in ("Genomic", "Molecular", "All"):
        raise ValueError(f"unknown analysis {kind!r}")
    out = None
    for name, bridge, table, start, times in (("Genomic", genomic, dictionary, prefix, correction), ("Molecular", molecular, molecular_dictionary, "", 1)):
        if kind in (name, "All"):
            lists, clustered = _lists(data, bridge.sparkSession)
            times = "auto_all" if clustered and times == "auto" else times
            rows = enrich(lists, restrict(bridge, None, length, length_how), terms, table, start, correction=times, only_significant=only_significant, **options).withColumn("analysis", F.lit(name))
            out = rows if out is None else out.unionByName(rows)
    return out


def _packed(rows: DataFrame, width: float, pack: int | None = None) -> DataFrame:
    """(b, s, list) of rows(id, mass): lists of about `pack` (PACK) rows of one logarithmic bucket, dealt by hash."""
    rows = rows.where("mass > 0").withColumn("b", F.floor(F.ln("mass") / width))
    sizes = rows.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / (pack or PACK)).alias("_parts"))
    dealt = rows.join(sizes, "b").withColumn("s", F.pmod(F.xxhash64("id", "mass"), X("_parts")))
    return settled(dealt.groupBy("b", "s").agg(F.collect_list(F.struct("id", "mass")).alias("list")))


def _runs(packed: DataFrame) -> DataFrame:
    """(b, s, runs) of _packed() lists: the ids of each mass of a list as one array."""
    one = packed.select("b", "s", F.explode("list").alias("_r")).groupBy("b", "s", X("_r.mass").alias("mass")).agg(F.collect_list("_r.id").alias("ids"))
    return one.groupBy("b", "s").agg(F.collect_list(F.struct("mass", "ids")).alias("runs"))


def match_masses(queries: DataFrame, masses: DataFrame, ppm: float) -> DataFrame:
    """(query, compound) with m(1 - ppm) < mass < m(1 + ppm), strictly, by an equi-join on logarithmic buckets.

    A bucket is an eighth of the window, so most rows of the buckets that a window touches match. Compounds of a bucket are packed
    into lists of PACK, and those of one mass in a list are compared once; queries are packed into lists of FEW. What is joined are
    pairs of lists, which are expanded last: a bucket with many rows is many pairs, none longer than FEW times PACK but for repeated
    rows, as Spark keeps what a pair expands to in memory. Masses are positive.
    """
    r = ppm * 1e-6
    if not 0 < r < 1:
        raise ValueError(f"a window of {ppm} ppm")
    width = r / 4
    first, last = math.floor(math.log1p(-r) / width) - 1, math.ceil(math.log1p(r) / width) + 1
    q = _packed(queries.select(X("query").alias("id"), X("m").cast("double").alias("mass")), width, FEW)
    c = _packed(masses.select(X("compound").alias("id"), X("mass").cast("double").alias("mass")), width)
    near = F.explode(F.sequence(X("b") + first, X("b") + last)).alias("cb")
    lists = q.select("list", near).join(c.select(X("b").alias("cb"), X("s").alias("cs")), "cb").withColumnRenamed("list", "_q")
    # lists are short, what they expand to is not: as many tasks as the session has, whatever the bytes
    tasks = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = _runs(c).select(X("b").alias("cb"), X("s").alias("cs"), X("runs").alias("_c"))
    both = lists.repartition(tasks, "cb", "cs").join(runs.repartition(tasks, "cb", "cs"), ["cb", "cs"])
    rows = both.select("_c", F.explode("_q").alias("q")).select("q", F.explode("_c").alias("c"))
    rows = rows.where((X("c.mass") > X("q.mass") * (1 - r)) & (X("c.mass") < X("q.mass") * (1 + r)))
    return rows.select(X("q.id").alias("query"), F.explode("c.ids").alias("compound"))


def report(results: DataFrame) -> DataFrame:
    """The flat sheet of a report: hits as text, sorted by q then term."""
    text = F.array_join(F.transform("hits", lambda h: F.when(F.array_join(h["labels"], "") == "", h["gene"]).otherwise(F.concat(h["gene"], F.lit(" ("), F.array_join(h["labels"], "/"), F.lit(")")))), ", ")
    return results.withColumn("hits", text).orderBy("list_name", "q_value", "term")
