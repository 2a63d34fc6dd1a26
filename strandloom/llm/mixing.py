"""Mixing to target weights: raking of token weights to marginals, then sampling by the calibrated probabilities.

Documents are summed to cells of (source, language, topic) with their tokens. Iterative proportional fitting scales
the cells' weights to the target share of each value of each dimension in turn, until the margins hold together. A
document's rate is the weight of its cell over the cell's tokens, times the sampling fraction. All steps are
DataFrame operations: sums by cell, sums of cells by value, a join of the cells' rates, a comparison with a hash. The table of cells has as many rows as there are combinations of values, whatever the number of documents.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, join_checked, stored

DIMENSIONS = ("source", "lang", "topic")
#: Kinds of text by strings they hold, the first that fits.
TOPICS = (("tabular", (" | ",)), ("legal", ("License", "Copyright")), ("marked", ("***", "###", "!!")), ("contact", ("@", "+1 (")))
REST = "prose"
#: Cells times values up to which all rounds are one expression over one row, which has the cells as arrays; more are joined.
ONE_ROW = 1 << 21


def topic_of(text: Column) -> Column:
    out = F
    for name, strings in TOPICS:
        hit = F.lit(False)
        for s in strings:
            hit = hit | text.contains(s)
        out = out.when(hit, F.lit(name))
    return out.otherwise(F.lit(REST))


def described(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, source, lang, topic, tokens): tokens are words between white space; a null source, lang or text is `none`, `none`, no tokens."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(key, *(F.coalesce(F.col(c).cast("string"), F.lit("none")).alias(c) for c in DIMENSIONS[:2]), topic_of(whole).alias("topic"), F.regexp_count(whole, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("tokens"))


def target_share(dim: str, power: float, given: dict[str, float] | None) -> Column:
    """The share that each cell's value of a dimension is to have, from the column m of its tokens: given, or the tokens to a power."""
    if given is None:
        return F.pow(F.col("m").cast("double"), F.lit(power))
    pairs = [x for v, w in given.items() for x in (F.lit(v), F.lit(float(w)))]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.col(dim)), F.lit(0.0))


def raked(cells: DataFrame, *, power: float = 0.5, targets: dict[str, dict[str, float]] | None = None, rounds: int = 20, tolerance: float = 1e-10, one_row: int = ONE_ROW) -> DataFrame:
    """cells (source, lang, topic, tokens) with the columns weight and gap.

    The weights sum to the tokens of all cells and have the target margins up to gap, the largest relative miss of any
    value of any dimension. A weight is the cell's tokens times a factor of each of its values; a step sums the cells by
    one dimension and sets that dimension's factors. Where cells times values, which are counted, are at most ONE_ROW, the
    cells are arrays of one row and the rounds one expression; more cells are summed and joined by value, a round being
    one plan and one stored table of factors. Both go on until no step of a round misses by more than tolerance, or for
    `rounds`: targets that no weights have leave a larger gap. A dimension without given targets
    takes its token shares to `power`, so that small values gain. Cells without tokens stay at weight 0. What reaches
    the driver are counts, a sum and a miss for each round.
    """
    targets = targets or {}
    cells = stored(cells, "cells")
    filled = cells.where("tokens > 0")
    total = F.lit(float(filled.agg(F.sum("tokens")).first()[0] or 0))
    first = []
    for dim in DIMENSIONS:
        margin = filled.groupBy(dim).agg(F.sum("tokens").alias("m")).withColumn("share", target_share(dim, power, targets.get(dim)))
        to = F.try_divide(F.col("share") * total, F.sum("share").over(Window.partitionBy()))  # values of a dimension
        first.append(margin.select(F.lit(dim).alias("dim"), F.col(dim).alias("value"), F.coalesce(to, F.lit(0.0)).alias("to"), F.lit(1.0).alias("f"), F.lit(None).cast("double").alias("miss")))
    every = stored(functools.reduce(DataFrame.unionByName, first), "factors")

    def own(table: DataFrame, dim: str) -> DataFrame:
        return table.where(F.col("dim") == dim).select(F.col("value").alias(dim), F.col("to").alias(f"to_{dim}"), F.col("f").alias(f"f_{dim}"))

    def weighed(factors: dict[str, DataFrame], but: str | None = None) -> DataFrame:
        """The cells with tokens, joined by the factors of all dimensions but one, and the product of these and the tokens."""
        out, product = filled, F.col("tokens").cast("double")
        for dim in DIMENSIONS:
            if dim != but:
                out, product = out.join(factors[dim], dim), product * F.col(f"f_{dim}")
        return out.withColumn("weight", product)

    sizes = [filled.count(), every.count()]
    gap, done = float("inf") if sizes[0] else 0.0, 0
    if sizes[0] and sizes[0] * sizes[1] <= one_row:
        every, done = stored(_in_one_row(filled, every, rounds, tolerance), "factors"), rounds
    while done < rounds and gap > tolerance:
        factors, missed = {dim: own(every, dim) for dim in DIMENSIONS}, []
        for dim in DIMENSIONS:
            to, f = F.col(f"to_{dim}"), F.col(f"f_{dim}")
            sums = weighed(factors, dim).groupBy(dim).agg(F.sum("weight").alias("s")).join(factors[dim], dim)
            miss = F.coalesce(F.abs(F.try_divide(F.col("s") * f, to) - 1), F.lit(0.0))
            made = sums.select(dim, to, F.coalesce(F.try_divide(to, F.col("s")), F.lit(0.0)).alias(f"f_{dim}"), miss.alias("miss"))
            factors[dim] = made.drop("miss")
            missed.append(made.select(F.lit(dim).alias("dim"), F.col(dim).alias("value"), to.alias("to"), F.col(f"f_{dim}").alias("f"), "miss"))
        every = stored(functools.reduce(DataFrame.unionByName, missed), "factors")
        done += 1
        gap = every.agg(F.max("miss")).first()[0] or 0.0
    out = weighed({dim: own(every, dim) for dim in DIMENSIONS})
    last = [out.groupBy(dim).agg(F.max(f"to_{dim}").alias("to"), F.sum("weight").alias("s")).select("to", "s") for dim in DIMENSIONS]
    gap = functools.reduce(DataFrame.unionByName, last).agg(F.max(F.abs(F.try_divide(F.col("s"), F.col("to")) - 1))).first()[0]
    none = cells.where("tokens <= 0 OR tokens IS NULL").withColumn("weight", F.lit(0.0))
    return out.select(*DIMENSIONS, "tokens", "weight").unionByName(none.select(*DIMENSIONS, "tokens", "weight")).withColumn("gap", F.lit(gap).cast("double"))


def _in_one_row(filled: DataFrame, every: DataFrame, rounds: int, tolerance: float) -> DataFrame:
    """every (dim, value, to, f, miss) after the rounds, by folding steps over arrays of one row.

    Each dimension's values are numbered; a cell has its tokens and the numbers of its values. A step sums the cells of each
    value with the factors of the other dimensions and sets the value's factor.
    """
    values = every.groupBy("dim").agg(F.array_sort(F.collect_list(F.struct("value", "to"))).alias("v"))
    listed = values.agg(F.map_from_entries(F.collect_list(F.struct("dim", "v"))).alias("m")).select(*(F.col("m")[dim].alias(f"v_{dim}") for dim in DIMENSIONS))
    whole = filled.agg(F.collect_list(F.struct(*DIMENSIONS, F.col("tokens").cast("double").alias("tokens"))).alias("c")).unionByName(listed, allowMissingColumns=True)
    row = whole.agg(*(F.first(c, ignorenulls=True).alias(c) for c in ("c", *(f"v_{dim}" for dim in DIMENSIONS))))
    number = lambda c, dim: F.array_position(F.transform(f"v_{dim}", lambda x: x["value"]), c[dim]).cast("int")
    row = row.withColumn("cells", F.transform("c", lambda c: F.struct(*(number(c, dim).alias(dim) for dim in DIMENSIONS), c["tokens"].alias("tokens"))))

    def step(acc: Column, dim: str) -> tuple[Column, Column]:
        """The dimension's factors after a step, and its largest miss before."""
        others = [d for d in DIMENSIONS if d != dim]

        def sums(number: Column) -> Column:
            weight = lambda c: c["tokens"] * F.get(acc[others[0]], c[others[0]] - 1) * F.get(acc[others[1]], c[others[1]] - 1)
            return F.aggregate(F.filter("cells", lambda c: c[dim] == number), F.lit(0.0), lambda x, c: x + weight(c))

        each = F.transform(f"v_{dim}", lambda v, i: F.struct(v["to"].alias("to"), sums(i + 1).alias("s"), F.get(acc[dim], i).alias("f")))
        new = F.transform(each, lambda x: F.coalesce(F.try_divide(x["to"], x["s"]), F.lit(0.0)))
        miss = F.array_max(F.transform(each, lambda x: F.coalesce(F.abs(F.try_divide(x["s"] * x["f"], x["to"]) - 1), F.lit(0.0))))
        return new, miss

    def one_round(acc: Column, _: Column) -> Column:
        now = acc
        for dim in DIMENSIONS:
            now = once(now, set_factors(dim))
        return now

    def once(value: Column, use) -> Column:
        """use(value), where value is made once: it is the variable of a transform over one element."""
        return F.element_at(F.transform(F.array(value), lambda x: use(x)), 1)

    def set_factors(dim: str):
        def use(acc: Column) -> Column:
            new, miss = step(acc, dim)
            return F.struct(*((new if d == dim else acc[d]).alias(d) for d in DIMENSIONS), F.greatest(acc["miss"], miss).alias("miss"))

        return use

    start = F.struct(*(F.transform(f"v_{dim}", lambda _: F.lit(1.0)).alias(dim) for dim in DIMENSIONS), F.lit(float("inf")).alias("miss"))
    reset = lambda acc: F.struct(*(acc[d].alias(d) for d in DIMENSIONS), F.lit(0.0).alias("miss"))
    fold = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, lambda acc, k: F.when(acc["miss"] <= tolerance, acc).otherwise(one_round(reset(acc), k)))

    def row_of(dim: str):
        return lambda v, i: F.struct(F.lit(dim).alias("dim"), v["value"].alias("value"), v["to"].alias("to"), F.get(F.col(f"acc.{dim}"), i).alias("f"), F.col("acc.miss").alias("miss"))

    done = row.select(fold.alias("acc"), *(f"v_{dim}" for dim in DIMENSIONS))
    back = [F.transform(f"v_{dim}", row_of(dim)) for dim in DIMENSIONS]
    return done.select(F.explode(F.concat(*back)).alias("x")).select("x.*")


def uniform(key: str, seed: int) -> Column:
    """A number in [0, 1) from the seed and the key; null keys count as empty."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def sampling_rates(rows: DataFrame, *, fraction: float = 0.5, **how) -> DataFrame:
    """(source, lang, topic, rate, gap) of the cells of described() rows that have tokens, stored."""
    cells = rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens"))
    return stored(raked(cells, **how).where("tokens > 0").select(*DIMENSIONS, (F.lit(fraction) * F.col("weight") / F.col("tokens")).alias("rate"), "gap"), "rates")


def mixture(docs: DataFrame, key: str = "doc_id", text: str = "text", *, fraction: float = 0.5, repeat: bool = True, seed: int = 3, power: float = 0.5, targets: dict[str, dict[str, float]] | None = None, rounds: int = 20) -> DataFrame:
    """(key, source, lang, topic, tokens, rate, copies, gap) of the sampled rows of docs; gap is how far the margins were missed.

    rate is the expected number of copies. With repeat a row has floor(rate) copies and one more by chance of the
    rest; without, one by chance of the rate, which then can't pass 1. The expected tokens are `fraction` of those
    of docs (with repeat), with the target margins. Rows without tokens are never sampled. Rows with one key draw
    the same number. A null source or language is the value none, a null text has no tokens; texts are read whole. An
    empty table gives an empty result; other columns play no part.
    """
    rows = stored(described(docs, key, text), "described")
    rates = sampling_rates(rows, fraction=fraction, power=power, targets=targets, rounds=rounds)
    rate = F.col("rate") if repeat else F.least(F.col("rate"), F.lit(1.0))
    drawn = join_checked(rows.where("tokens > 0"), rates, list(DIMENSIONS)).withColumn("rate", rate)
    copies = (F.floor("rate") + (uniform(key, seed) < F.col("rate") - F.floor("rate")).cast("int")).cast("int")
    return drawn.withColumn("copies", copies).where("copies > 0").select(key, *DIMENSIONS, "tokens", F.round("rate", 6).alias("rate"), "copies", F.round("gap", 6).alias("gap"))


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", *, repeat: bool = False, seed: int = 3, **how) -> DataFrame:
    """The rows of docs that mixture() samples, with all columns; with repeat as often as it has copies of them.

    Without repeat, cells with a rate above 1 can't get their share: the margins and the fraction are missed then.
    A row's cell is made again and meets its rate there, so texts are read twice and not shuffled for a join by key. Rows
    with null or equal keys draw the same number each; null and blank texts have no tokens and are never sampled; texts
    are read whole. An empty table stays empty.
    """
    rates = sampling_rates(stored(described(docs, key, text), "described"), **how)
    names = {d: free_name(docs.columns, f"cell_{d}") for d in (*DIMENSIONS, "rate")}
    rates = rates.drop("gap").withColumnsRenamed(names)
    whole = F.coalesce(F.col(text), F.lit(""))
    cell = {names[c]: F.coalesce(F.col(c).cast("string"), F.lit("none")) for c in DIMENSIONS[:2]} | {names["topic"]: topic_of(whole)}
    rows = docs.where(whole.rlike(r"[^\x20\x09-\x0D]")).withColumns(cell)
    drawn = join_checked(rows, rates, [names[d] for d in DIMENSIONS])
    rate = F.col(names["rate"])
    if not repeat:
        return drawn.where(uniform(key, seed) < F.least(rate, F.lit(1.0))).select(*docs.columns)
    copies = (F.floor(rate) + (uniform(key, seed) < rate - F.floor(rate)).cast("int")).cast("int")
    return drawn.select(*docs.columns, F.explode(F.array_repeat(F.lit(0), copies)).alias(names["rate"])).select(*docs.columns)


def oracle_sql(*, fraction: float = 0.5, seed: int = 3, power: float = 0.5, rounds: int = 20) -> str:
    """mixture() in DuckDB's SQL over the view documents."""
    hits = " ".join(f"WHEN {' OR '.join(f'contains(text, {_quoted(s)})' for s in strings)} THEN '{name}'" for name, strings in TOPICS)
    dims = ", ".join(DIMENSIONS)
    parts = [
        f"d AS (SELECT doc_id, coalesce(source, 'none') AS source, coalesce(lang, 'none') AS lang, CASE {hits} ELSE '{REST}' END AS topic, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS tokens FROM (SELECT doc_id, source, lang, coalesce(text, '') AS text FROM documents))",
        f"c AS (SELECT {dims}, sum(tokens)::BIGINT AS tokens FROM d GROUP BY ALL)",
        *(f"m_{x} AS (SELECT {x}, pow(sum(tokens)::DOUBLE, {power}) AS t FROM c GROUP BY {x} HAVING sum(tokens) > 0)" for x in DIMENSIONS),
        f"w0 AS (SELECT c.*, tokens::DOUBLE AS weight, {', '.join(f'm_{x}.t / (SELECT sum(t) FROM m_{x}) * (SELECT sum(tokens) FROM c) AS to_{x}' for x in DIMENSIONS)} FROM c {' '.join(f'JOIN m_{x} USING ({x})' for x in DIMENSIONS)})",
    ]
    n = 0
    for _ in range(rounds):
        for x in DIMENSIONS:
            parts.append(f"w{n + 1} AS MATERIALIZED (SELECT * REPLACE (weight * to_{x} / nullif(sum(weight) OVER (PARTITION BY {x}), 0) AS weight) FROM w{n})")
            n += 1
    missed = " UNION ALL ".join(f"SELECT abs(sum(weight) / max(to_{x}) - 1) AS miss FROM w{n} WHERE tokens > 0 GROUP BY {x}" for x in DIMENSIONS)
    parts.append(f"g AS (SELECT round(max(miss), 6) AS gap FROM ({missed}))")
    parts.append(f"r AS (SELECT d.*, {fraction} * weight / w{n}.tokens AS rate, ('0x' || substr(md5('{seed}:' || doc_id), 1, 8))::BIGINT / 4294967296.0 AS u FROM d JOIN w{n} USING ({dims}) WHERE d.tokens > 0)")
    return f"WITH {', '.join(parts)} SELECT doc_id, {dims}, tokens, round(rate, 6) AS rate, (floor(rate) + (u < rate - floor(rate))::INT)::INT AS copies, gap FROM r, g WHERE floor(rate) + (u < rate - floor(rate))::INT > 0"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"
