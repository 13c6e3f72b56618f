"""Mixing to target weights by iterative proportional fitting, with DataFrame functions only.

Tokens are summed per cell of source, language and topic. A cell's weight is the
number of tokens that the sample takes of it. Weights are raked to one marginal after
the other, none above what the cell has, until they no longer change; a document's
rate is its cell's weight over the cell's tokens. The sample is as large as it can be
with the target weights: amounts are tried in falling order, from the largest for
which no single class lacks tokens, and the first one at which all marginals are met
is taken. The last resort are weights without that bound, scaled until no document
is taken more often than allowed, which meet the marginals wherever raking can.

A marginal's targets are shares by value, ``*`` for all values that are not named, or
a number: the corpus's own shares to that power, for values with LEAST_SHARE of all
tokens or more; the others make one class, ``*``, which keeps its share. A topic is the column ``topic``
where documents have one. Where not, it is lexical: the TOPICS most widespread long
words that no more than half of all documents hold are counted over the corpus, and a
document belongs to the one that it uses most.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save

Targets = Mapping[str, "Mapping[str, float] | float"]

TOPICS = 12
LONG_WORD = 7
WIDEST = 0.5  # a word that more documents hold names no topic
TRIMMED = ".,;:!?*#$%&|()"
LEAST_SHARE = 0.005
SWEEPS = 300
SETTLED = 1e-13  # largest change of a cell's share of all weight in a sweep that ends the raking
MET = 0.01  # largest difference between a class's share and its target
LEVELS = (1.0, 0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.65, 0.6, 0.55, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25)  # amounts that are tried, as parts of the largest one
ARRAY_CELLS = 20_000  # more cells are raked by joins


def _split(column: str):
    """Words of a text: runs of other than ASCII white space, in lower case."""
    plain = f"lower(coalesce({column}, ''))"
    for c in ("\\t", "\\r", "\\n", "\\u000B", "\\u000C"):
        plain = f"replace({plain}, '{c}', ' ')"
    return F.expr(f"filter(split({plain}, ' '), w -> w <> '')")


def _long(words: str) -> str:
    long = f"w -> length(w) >= {LONG_WORD}"  # looked at twice, as trimming is slow
    return f"filter(transform(filter({words}, {long}), w -> trim(BOTH '{TRIMMED}' FROM w)), {long})"


def topic_words(docs: DataFrame, topics: int = TOPICS) -> list[str]:
    """The words that name topics, the most widespread one first; of all documents, no more than ``topics``."""
    held = docs.select(_split("text").alias("words"))
    n = docs.count()
    spread = held.select(F.explode(F.expr(f"array_distinct({_long('words')})")).alias("word")).groupBy("word").count()
    return [r["word"] for r in spread.where(F.col("count") <= WIDEST * n).orderBy(F.desc("count"), "word").limit(topics).collect()]


def _quoted(values) -> str:
    return ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values)


def with_values(rows: DataFrame, targets: Targets, words: list[str] | None) -> DataFrame:
    """Adds tokens (words), topic if ``words`` are given, and the value of each marginal as v0, v1, ..."""
    rows = rows.withColumn("words", _split("text"))
    rows = rows.withColumn("tokens", F.size("words").cast("long"))
    if words is not None:
        if words:
            rows = rows.withColumn("named", F.expr(f"filter({_long('words')}, w -> w IN ({_quoted(words)}))"))
            rows = rows.withColumn("tally", F.expr(f"transform(array({_quoted(words)}), x -> size(filter(named, w -> w = x)))"))
            rows = rows.withColumn("topic", F.expr(f"if(size(named) = 0, 'none', element_at(array({_quoted(words)}), int(array_position(tally, array_max(tally)))))")).drop("named", "tally")
        else:
            rows = rows.withColumn("topic", F.lit("none"))
    rows = rows.drop("words")
    for k, (name, shares) in enumerate(targets.items()):
        value = F.col(name).cast("string")
        rows = rows.withColumn(f"v{k}", F.coalesce(value, F.lit("*")) if isinstance(shares, int | float) else F.when(value.isin([v for v in shares if v != "*"]), value).otherwise(F.lit("*")))
    return rows


def _with_classes(rows: DataFrame, values: DataFrame, targets: Targets) -> DataFrame:
    """Adds the class of each marginal as c0, c1, ... by ``values``, the sums of tokens per ``v0, v1, ...``."""
    total = values.agg(F.sum("tokens").alias("t")).first()["t"] or 0
    for k, shares in enumerate(targets.values()):
        known = [v for v in shares if v != "*"] if not isinstance(shares, int | float) else None
        if known is None:  # 1 / LEAST_SHARE values at most
            own = values.groupBy(f"v{k}").agg(F.sum("tokens").alias("t"))
            known = [r[0] for r in own.where(F.col("t") >= F.lit(LEAST_SHARE * total)).select(f"v{k}").collect()]
        rows = rows.withColumn(f"c{k}", F.when(F.col(f"v{k}").isin(known), F.col(f"v{k}")).otherwise(F.lit("*")))
    return rows


def _goals(cells: DataFrame, targets: Targets, k: int) -> DataFrame:
    """``ck, own, g``: tokens and target shares of the classes that have tokens; the shares add up to one."""
    shares = list(targets.values())[k]
    own = cells.groupBy(f"c{k}").agg(F.sum("tokens").cast("double").alias("own"))
    if isinstance(shares, int | float):
        kept = own.agg(F.sum("own").alias("t"), F.sum(F.when(F.col(f"c{k}") == "*", F.col("own"))).alias("rest"), F.sum(F.when(F.col(f"c{k}") != "*", F.pow("own", F.lit(float(shares))))).alias("p")).first()
        rest, power = (kept["rest"] or 0.0) / (kept["t"] or 1.0), kept["p"] or 1.0
        return own.withColumn("g", F.when(F.col(f"c{k}") == "*", F.lit(rest)).otherwise(F.pow("own", F.lit(float(shares))) / F.lit(power) * F.lit(1 - rest)))
    given = F.lit(None).cast("double")
    for name, share in shares.items():
        given = F.when(F.col(f"c{k}") == name, F.lit(float(share))).otherwise(given)
    own = own.withColumn("g", F.coalesce(given, F.lit(0.0)))
    total = own.agg(F.sum("g").alias("s")).first()["s"]
    return own.withColumn("g", F.col("g") / F.lit(total or 1.0))


def _raked_in_arrays(cells: DataFrame, goals: list[DataFrame], amounts: list[float], most: float) -> DataFrame:
    """``c0, c1, ..., t, w`` of the first amount that meets the marginals. All cells stand in one row, and raking is one expression over their arrays."""
    spark = cells.sparkSession
    dims = range(len(goals))
    keys = [f"c{k}" for k in dims]
    whole = cells
    for k in dims:
        whole = whole.join(F.broadcast(goals[k].select(f"c{k}", F.col("g").alias(f"g{k}"))), f"c{k}")  # no more rows than cells
    each = F.struct(*keys, F.col("tokens").cast("double").alias("t"), *(f"g{k}" for k in dims))
    one = whole.agg(F.array_sort(F.collect_list(each)).alias("cells"))
    for k in dims:
        one = one.withColumn(f"n{k}", F.expr(f"array_sort(array_distinct(transform(cells, x -> struct(x.c{k} AS c, x.g{k} AS g))))"))
        one = one.withColumn(f"i{k}", F.expr(f"transform(transform(array(transform(n{k}, y -> y.c)), n -> transform(cells, x -> int(array_position(n, x.c{k})) - 1))[0], x -> x)")).withColumn(f"g{k}", F.expr(f"transform(n{k}, y -> y.g)"))
        one = one.withColumn(f"m{k}", F.expr(f"transform(n{k}, (_, j) -> filter(sequence(0, size(cells) - 1), q -> i{k}[q] = j))")).drop(f"n{k}")
    one = save(one, "arrays")
    tried = [(n, a, most) for n, a in enumerate(amounts)] + [(len(amounts), amounts[-1], None)]
    one = one.withColumn("at", F.explode(F.array(*(F.struct(F.lit(n).alias("level"), F.lit(a).alias("amount"), F.lit(m).cast("double").alias("most")) for n, a, m in tried))))
    one = one.select("cells", *(f"{x}{k}" for x in "gim" for k in dims), "at.level", "at.amount", "at.most").repartition(len(tried), "level")

    def sums(v: str, k: int) -> str:
        return f"transform(m{k}, at -> aggregate(at, 0D, (a, q) -> a + {v}[q]))"

    def raked(weights: str, k: int) -> str:
        v = f"v{k}"
        # A lambda's variable is evaluated once; a column would be put into each step of the loop in its place.
        moved = f"if(s{k}[i{k}[q]] > 0, x * amount * g{k}[i{k}[q]] / s{k}[i{k}[q]], 0D)"
        bound = f"transform(array({sums(v, k)}), s{k} -> transform({v}, (x, q) -> least({moved}, coalesce(most * cells[q].t, {moved}))))[0]"
        return f"transform(array({weights}), {v} -> {bound})[0]"

    body = "s.w"
    for k in dims:
        body = raked(body, k)
    step = f"transform(array({body}), x -> struct(x AS w, array_max(zip_with(x, s.w, (a, b) -> abs(a - b))) AS moved))[0]"
    start = "struct(transform(cells, x -> x.t) AS w, double('infinity') AS moved)"
    one = one.withColumn("w", F.expr(f"aggregate(sequence(1, {SWEEPS}), {start}, (s, _n) -> if(s.moved > {SETTLED}D * amount, {step}, s)).w"))
    far = ", ".join(f"array_max(zip_with({sums('w', k)}, g{k}, (x, g) -> abs(x / amount - g)))" for k in dims)
    one = save(one.withColumn("far", F.expr(f"greatest({far}, 0D)")).select("level", "far", "cells", "w"), "levels")
    level = one.where((F.col("far") <= MET) | F.col("level").eqNullSafe(F.lit(len(amounts)))).agg(F.min("level").alias("n")).first()["n"]
    found = one.where(F.col("level") == F.lit(level)).select(F.explode(F.arrays_zip("cells", "w")).alias("x"))
    return found.select(*(F.col(f"x.cells.{c}").alias(c) for c in keys), F.col("x.cells.t").alias("t"), F.col("x.w").alias("w"))


def _raked_by_joins(cells: DataFrame, goals: list[DataFrame], amounts: list[float], most: float) -> DataFrame:
    """The same by sums and joins, for any number of cells."""
    dims = range(len(goals))
    start = cells.select(*(f"c{k}" for k in dims), F.col("tokens").cast("double").alias("t"))
    for level in range(len(amounts) + 1):
        amount, bound = amounts[min(level, len(amounts) - 1)], most if level < len(amounts) else None
        w = start.withColumn("w", F.col("t"))
        for _ in range(SWEEPS):
            before = w.select(*(f"c{k}" for k in dims), F.col("w").alias("old"))
            for k in dims:
                sums = w.groupBy(f"c{k}").agg(F.sum("w").alias("s")).join(goals[k].select(f"c{k}", "g"), f"c{k}")
                moved = F.when(F.col("s") > 0, F.col("w") * F.lit(amount) * F.col("g") / F.col("s")).otherwise(F.lit(0.0))
                w = w.join(sums, f"c{k}").withColumn("w", moved if bound is None else F.least(moved, F.col("t") * F.lit(bound))).drop("s", "g")
            w = save(w.select(*(f"c{k}" for k in dims), "t", "w"), "weights")
            if w.join(before, [f"c{k}" for k in dims]).agg(F.max(F.abs(F.col("w") - F.col("old"))).alias("d")).first()["d"] <= SETTLED * amount:
                break
        far = [w.groupBy(f"c{k}").agg(F.sum("w").alias("s")).join(goals[k], f"c{k}").agg(F.max(F.abs(F.col("s") / F.lit(amount) - F.col("g"))).alias("d")).first()["d"] for k in dims]
        if max(far) <= MET:
            return w
    return w


def cell_rates(cells: DataFrame, targets: Targets, amount: float = 1.0, most: float = 1.0) -> DataFrame:
    """``c0, c1, ..., rate, weight`` of each cell, from ``c0, c1, ..., tokens``; classes without tokens are left out.

    Weights add up to one. ``amount`` is the largest number of tokens of the sample, as
    a multiple of the corpus's, and ``most`` the largest number of copies of a document.
    """
    cells = save(cells.where("tokens > 0"), "cells")
    goals = [save(_goals(cells, targets, k), "goals") for k in range(len(targets))]
    size = cells.agg(F.count("*").alias("n"), F.sum("tokens").alias("t")).first()
    if not size["n"]:
        return cells.select(*(f"c{k}" for k in range(len(targets))), F.lit(0.0).alias("rate"), F.lit(0.0).alias("weight"))
    room = min(x for g in goals if (x := g.agg(F.min(F.when(F.col("g") > 0, F.col("own") / F.col("g"))).alias("x")).first()["x"]) is not None)
    largest = min(float(amount) * size["t"], float(most) * room)
    rake = _raked_in_arrays if size["n"] <= ARRAY_CELLS else _raked_by_joins
    raked = save(rake(cells, goals, [largest * x for x in LEVELS], float(most)), "raked")
    found = raked.agg(F.max(F.col("w") / F.col("t")).alias("most"), F.sum("w").alias("w")).first()
    scale = min(1.0, most / found["most"]) if found["most"] else 0.0  # below one only without the bound
    return raked.select(*(f"c{k}" for k in range(len(targets))), F.round(F.col("w") / F.col("t") * F.lit(scale), 9).alias("rate"), F.round(F.col("w") / F.lit(found["w"] or 1.0), 9).alias("weight"))


def weigh(docs: DataFrame, targets: Targets, amount: float = 1.0, most: float = 1.0, seed: str = "mix") -> DataFrame:
    """``row`` (all columns of docs), ``topic, tokens, weight, rate, copies, c0, c1, ...`` (classes) of each row of ``docs``.

    ``rate`` is the expected number of copies, ``copies`` its whole part and one more
    by the lot for the rest: a hash of seed and doc_id (of the text, if that is null), so
    it repeats exactly and repeated rows share their lot. ``amount`` and ``most`` see cell_rates. Documents without tokens
    weigh nothing and have one copy. A null value, or one without a target, falls
    into the class ``*``; classes with no target share have no copies. An empty table
    gives no rows.
    """
    named = "topic" in docs.columns
    others = dict.fromkeys(["doc_id", "text", *(["topic"] if named else []), *(n for n in targets if n != "topic")])
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *(F.col(f"`{c}`") for c in others))
    rows = with_values(rows, targets, None if named else topic_words(docs))
    values, keys = [f"v{k}" for k in range(len(targets))], [f"c{k}" for k in range(len(targets))]
    # Rows with their values are written down, so that the texts are not split again.
    rows = save(rows.select("row", F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit("")).alias("lot"), F.col("topic").cast("string").alias("topic"), "tokens", *values), "placed")
    sums = save(rows.groupBy(*values).agg(F.sum("tokens").alias("tokens")), "values")
    rows = _with_classes(rows, sums, targets)
    rates = save(cell_rates(_with_classes(sums, sums, targets).groupBy(*keys).agg(F.sum("tokens").alias("tokens")), targets, amount, most), "rates")
    out = rows.join(F.broadcast(rates) if rates.count() <= ARRAY_CELLS else rates.hint("merge"), keys, "left")
    lot = F.conv(F.substring(F.md5(F.concat(F.lit(seed + "|"), "lot")), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    rate = F.when(F.col("tokens") > 0, F.coalesce("rate", F.lit(0.0))).otherwise(F.lit(1.0))
    out = out.withColumn("rate", rate).withColumn("weight", F.when(F.col("tokens") > 0, F.coalesce("weight", F.lit(0.0))).otherwise(F.lit(0.0)))
    copies = F.floor("rate") + (lot < F.col("rate") - F.floor("rate")).cast("long")
    return out.select("row", "topic", "tokens", "weight", "rate", copies.alias("copies"), *keys)


def sample(docs: DataFrame, targets: Targets, amount: float = 1.0, most: float = 1.0, seed: str = "mix") -> DataFrame:
    """The rows of ``docs`` as often as the mixture takes them (see weigh), with all their columns and no others."""
    out = weigh(docs, targets, amount, most, seed).where("copies > 0")
    if most > 1:
        out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return out.select("row.*")


def shares(weighed: DataFrame, targets: Targets) -> DataFrame:
    """``marginal, class, expected, sampled``: shares of tokens by rate, and as the lots fell, of a result of weigh."""
    rows = weighed.select(F.explode(F.array(*(F.struct(F.lit(n).alias("marginal"), F.col(f"c{k}").alias("class")) for k, n in enumerate(targets)))).alias("m"), "tokens", "rate", "copies")
    sums = rows.groupBy("m.marginal", "m.class").agg(F.sum(F.col("tokens") * F.col("rate")).alias("e"), F.sum(F.col("tokens") * F.col("copies")).alias("s"))
    totals = sums.groupBy("marginal").agg(F.sum("e").alias("te"), F.sum("s").alias("ts"))
    return sums.join(totals, "marginal").select("marginal", "class", F.try_divide("e", "te").alias("expected"), F.try_divide(F.col("s").cast("double"), F.col("ts").cast("double")).alias("sampled"))
