"""Line dedup by winnowing over line hashes, with DataFrame functions only.

The non-blank lines of a text are hashed. A gram is the shortest run of lines from
a line on that has GRAM_WORDS words or more; within each shortest run of RUN_WORDS
words or more the gram with the least hash is selected. Any passage of whole lines
with RUN_WORDS words or more thus has a gram that is selected wherever the passage
stands. Selected grams meet their first occurrence (of the least doc_id and
position); the two documents' lines are then compared along that offset, matches
are extended both ways as far as they go, and the later one is deleted where it
has RUN_WORDS words or more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import save

RUN_WORDS = 50
GRAM_WORDS = 25


def _lines(docs: DataFrame) -> DataFrame:
    """Of each row: hash (h), words (n) and place (i) of its non-blank lines."""
    lines = F.expr("filter(transform(split(text, '\\n'), (x, i) -> struct(trim(BOTH ' \\t\\r' FROM x) AS x, i AS i)), l -> l.x <> '')")
    rows = docs.select("at", "tie", lines.alias("l"))
    return rows.select("at", "tie", F.expr("transform(l, x -> xxhash64(x.x))").alias("h"), F.expr("transform(l, x -> size(split(x.x, '\\\\s+')))").alias("n"), F.expr("transform(l, x -> x.i)").alias("i")).where("size(h) > 0")


def _selected(lines: DataFrame, run_words: int, gram_words: int) -> DataFrame:
    """``at, tie, hash, p`` of the grams that are least in some window; p counts from 1."""

    def shortest(words: int) -> str:
        # Each line has a word at least, so no more than ``words`` lines are needed.
        return f"aggregate(slice(n, s, {words}), struct(0 AS w, 0 AS k), (a, x) -> if(a.w >= {words}, a, struct(a.w + x AS w, a.k + 1 AS k)))"

    grams = f"transform(sequence(1, size(n)), s -> transform(array({shortest(gram_words)}), r -> if(r.w >= {gram_words}, struct(xxhash64(slice(h, s, r.k)) AS hash, s AS p, s + r.k AS stop), NULL))[0])"
    least = f"array_min(transform(filter(slice(grams, s, r.k), g -> g IS NOT NULL AND g.stop <= s + r.k), g -> struct(g.hash AS hash, g.p AS p)))"
    windows = f"array_distinct(filter(transform(sequence(1, size(n)), s -> transform(array({shortest(run_words)}), r -> if(r.w >= {run_words}, {least}, NULL))[0]), x -> x IS NOT NULL))"
    # A lambda's variable is evaluated once; a column would be put into each step of the loops in its place.
    found = F.expr(f"transform(array({grams}), grams -> {windows})[0]")
    return lines.select("at", "tie", F.explode(found).alias("g")).select("at", "tie", "g.hash", "g.p")


def _matches(places: DataFrame, key: str) -> DataFrame:
    """Places with an earlier place of the same key, and the first of those as ``c``."""
    here = F.struct("at", "tie", "p")
    first = places.groupBy(key).agg(F.min(here).alias("c"), F.count("*").alias("n")).where("n > 1").select(key, "c")
    # Tables of their own on both sides of each join, so that hot partitions can be split in it.
    return places.join(save(first, "firsts"), key).where(here != F.col("c"))


def _pairs(met: DataFrame) -> DataFrame:
    return met.select("at", "tie", F.col("c.at").alias("c_at"), F.col("c.tie").alias("c_tie"), (F.col("p") - F.col("c.p")).alias("off")).distinct()


def _extended(pairs: DataFrame, lines: DataFrame, run_words: int) -> DataFrame:
    """``at, tie, runs``: line places (b, e, from 1) that equal the first document's along the offset, of run_words words or more."""
    both = pairs.join(lines, ["at", "tie"]).join(lines.select(F.col("at").alias("c_at"), F.col("tie").alias("c_tie"), F.col("h").alias("c_h")), ["c_at", "c_tie"])
    # Lines lo .. lo + len - 1 of the later document stand against lines lo - off ... of the first.
    both = both.withColumn("lo", F.greatest(F.lit(1), F.col("off") + 1)).withColumn("len", F.least(F.size("h") - F.col("lo") + 1, F.size("c_h") - F.col("lo") + F.col("off") + 1))
    same = "concat(zip_with(slice(h, lo, len), slice(c_h, lo - off, len), (x, y) -> x = y), array(false))"
    step = f"""aggregate(sequence(1, len + 1), struct(0 AS w, 0 AS k, array_repeat(struct(0 AS b, 0 AS e), 0) AS runs),
        (a, s) -> if(same[s - 1], struct(a.w + n[lo + s - 2] AS w, a.k + 1 AS k, a.runs AS runs),
                  struct(0 AS w, 0 AS k, if(a.w >= {run_words}, array_append(a.runs, struct(lo + s - 1 - a.k AS b, lo + s - 2 AS e)), a.runs) AS runs))).runs"""
    # A lambda's variable is evaluated once; a column would be put into each step of the loop in its place.
    runs = both.select("at", "tie", F.expr(f"transform(array({same}), same -> {step})[0]").alias("runs")).where("size(runs) > 0")
    return save(runs.groupBy("at", "tie").agg(F.array_distinct(F.flatten(F.collect_list("runs"))).alias("runs")), "runs")


def _windows(places: DataFrame, lines: DataFrame, run_words: int, found: DataFrame | None = None) -> DataFrame:
    """``at, tie, hash, whole, p, e``: the shortest runs of run_words words, from p to e, counted from their first line or from
    their last one, that hold the first line of a given gram (hash); whole is their own hash. Those that lie in runs ``found`` are left out."""
    step = f"(a, x) -> if(a.w >= {run_words}, a, struct(a.w + x AS w, a.k + 1 AS k))"

    def forward(at: str) -> str:
        return f"aggregate(slice(n, {at}, {run_words}), struct(0 AS w, 0 AS k), {step})"

    def backward(at: str) -> str:
        return f"aggregate(reverse(slice(n, greatest(1, {at} - {run_words} + 1), least({at}, {run_words}))), struct(0 AS w, 0 AS k), {step})"

    runs = [
        f"transform(sequence(greatest(1, p - {run_words} + 1), p), s -> transform(array({forward('s')}), r -> if(r.w >= {run_words} AND s + r.k > p, struct(s AS p, s + r.k - 1 AS e), NULL))[0])",
        f"transform(sequence(p, least(size(n), p + {run_words} - 1)), s -> transform(array({backward('s')}), r -> if(r.w >= {run_words} AND s - r.k < p, struct(s - r.k + 1 AS p, s AS e), NULL))[0])",
    ]
    each = f"array_distinct(filter(concat({', '.join(runs)}), x -> x IS NOT NULL))"
    held = places.select("at", "tie", "p", "hash").join(lines, ["at", "tie"])
    if found is not None:
        # No window that holds line p begins before the one that ends at p - 1, or ends behind the one that begins at p + 1.
        ahead = f"transform(array({forward('p + 1')}), r -> if(r.w >= {run_words}, p + r.k, size(n)))[0]"
        behind = f"transform(array({backward('p - 1')}), r -> if(r.w >= {run_words}, p - r.k, 1))[0]"
        held = held.withColumn("lo", F.expr(f"if(p = 1, 1, {behind})")).withColumn("hi", F.expr(f"if(p = size(n), p, {ahead})")).join(found, ["at", "tie"], "left")
        held = held.where("NOT coalesce(exists(runs, r -> r.b <= lo AND r.e >= hi), false)")
    held = held.select("at", "tie", "hash", "h", *(["runs"] if found is not None else []), F.explode(F.expr(each)).alias("x"))
    if found is not None:
        held = held.where("NOT coalesce(exists(runs, r -> r.b <= x.p AND r.e >= x.e), false)")
    return held.select("at", "tie", "hash", F.expr("xxhash64(slice(h, x.p, x.e - x.p + 1))").alias("whole"), "x.p", "x.e")


def repeated_runs(docs: DataFrame, run_words: int = RUN_WORDS, gram_words: int = GRAM_WORDS) -> DataFrame:
    """``at, tie, runs`` for ``at, tie, text``: disjoint line intervals (b, e, counted from 0) that repeat earlier lines.

    A gram's first occurrence may stand in a shorter repeat than later ones share.
    Windows around matched grams that no run covers therefore go by their own hash
    in a second round, in which the first occurrence of a window is a match by
    itself. So every window that occurs earlier, anywhere, is in some run. The windows
    counted from each line on and back from each line cover every longer repeat whole.
    """
    lines = save(_lines(docs).dropDuplicates(["at", "tie"]), "lines")
    places = save(_selected(lines, run_words, gram_words), "grams")
    met = save(_matches(places, "hash"), "met")
    found = _extended(save(_pairs(met), "pairs"), lines, run_words)
    bare = _windows(met, lines, run_words, found).select("hash").distinct()
    windows = _windows(places.join(save(bare, "bare"), "hash", "left_semi"), lines, run_words)
    windows = save(windows.select("at", "tie", "whole", "p").distinct(), "windows")
    more = _extended(save(_pairs(_matches(windows, "whole")), "pairs"), lines, run_words)
    both = found.unionByName(more).select("at", "tie", F.explode("runs").alias("r")).distinct()
    both = both.join(lines.select("at", "tie", "i"), ["at", "tie"]).select("at", "tie", F.expr("i[r.b - 1]").alias("b"), F.expr("i[r.e - 1]").alias("e"))
    # Intervals that meet become one: a new one begins where none before reaches.
    before = Window.partitionBy("at", "tie").orderBy("b", "e")
    both = both.withColumn("reach", F.max("e").over(before.rowsBetween(Window.unboundedPreceding, -1)))
    both = both.withColumn("part", F.sum(F.when(F.col("reach") >= F.col("b") - 1, 0).otherwise(1)).over(before.rowsBetween(Window.unboundedPreceding, 0)))
    whole = both.groupBy("at", "tie", "part").agg(F.min("b").alias("b"), F.max("e").alias("e"))
    return whole.groupBy("at", "tie").agg(F.array_sort(F.collect_list(F.struct("b", "e"))).alias("runs"))


def dedup_lines(docs: DataFrame, run_words: int = RUN_WORDS, gram_words: int = GRAM_WORDS, count: str | None = "removed_lines") -> DataFrame:
    """``docs`` without later repeats of passages of whole lines with ``run_words`` words or more.

    Documents go by ascending doc_id (null first), rows of one doc_id by their
    text's hash; the first occurrence stays, also within a document. Rows equal
    in doc_id and text count as one. All rows and columns stay; ``text`` loses
    lines (it may become empty), ``n_chars``, where there is one, follows it, and
    the number of removed lines is added under the name ``count``, in place of a column
    of that name; with None it isn't, and all columns stay. A null text stays null.
    """
    names = [c for c in docs.columns if c != count]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("at"), F.xxhash64("text").alias("tie"))
    runs = save(repeated_runs(rows.select("at", "tie", F.col("row.text").alias("text")), run_words, gram_words), "runs")
    joined = rows.join(runs.hint("merge"), ["at", "tie"], "left")  # the same plan at every size
    lines = F.expr("split(row.text, '\\n')")
    joined = joined.withColumn("lines", F.when(F.col("runs").isNotNull(), lines))
    # By sets of places, so that time does not go by lines times runs.
    places = "array_except(sequence(0, size(lines) - 1), flatten(transform(runs, r -> sequence(r.b, r.e))))"
    joined = joined.withColumn("kept", F.expr(f"if(runs IS NULL, NULL, transform(array(lines), l -> transform({places}, i -> l[i]))[0])"))
    text = F.when(F.col("runs").isNull(), F.col("row.text")).otherwise(F.array_join("kept", "\n"))
    joined = joined.withColumn("new_text", text)
    new = {"text": F.col("new_text"), "n_chars": F.coalesce(F.length("new_text").cast("long"), F.col("row.n_chars") if "n_chars" in names else F.lit(None))}
    removed = F.when(F.col("runs").isNull(), F.lit(0)).otherwise(F.size(F.split("row.text", "\n")) - F.size("kept")).cast("long")
    return joined.select(*((new[c] if c in new else F.col("row").getField(c)).alias(c) for c in names), *([removed.alias(count)] if count else []))
