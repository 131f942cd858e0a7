"""Order-dependent text operators: wrapped lines, front matter, sections, exercises, step levels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def join_wrapped(text: Column) -> Column:
    """Lines joined until one ends a sentence, is a heading (short, no final stop) before a blank, or blanks follow.

    A fold over the lines of one text; the state is the finished text and the open line.
    """
    lines = F.split(text, "\n")
    start = F.struct(F.lit("").alias("done"), F.lit("").alias("open"))

    def step(acc: Column, line: Column) -> Column:
        t = F.trim(line)
        flushed = F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], acc["open"], F.lit("\n")))
        joined = F.when(acc["open"] == "", t).otherwise(F.concat(acc["open"], F.lit(" "), t))
        ends = t.rlike(r"[.!?:»\"”]$")
        return (
            F.when(t == "", F.struct(flushed.alias("done"), F.lit("").alias("open")))
            .when(ends, F.struct(F.concat(acc["done"], joined, F.lit("\n")).alias("done"), F.lit("").alias("open")))
            .otherwise(F.struct(acc["done"].alias("done"), joined.alias("open")))
        )

    end = F.aggregate(lines, start, step)
    return F.trim(F.concat(end["done"], end["open"]))


#: Words that open the body of a book.
BODY_MARKERS = r"(?iu)^\s*(ĉapitro|chapter|enkonduko|antaŭparolo|unua parto|parto i|i\.)"


def skip_front_matter(lines: DataFrame, within: int = 200, short_run: int = 5, long: int = 100) -> DataFrame:
    """Lines (doc_id, pos from 1, line) from the first body marker on, else from the first line of more than
    ``long`` characters after more than ``short_run`` short lines in a row, else all."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    short = F.length("line") < 40
    head = lines.filter(F.col("pos") <= within)
    # Gaps and islands: rows of one run of short lines share the number of long lines before them.
    runs = head.withColumn("short", short).withColumn("island", F.sum(F.when(short, 0).otherwise(1)).over(w))
    run = F.sum(F.when(F.col("short"), 1).otherwise(0)).over(Window.partitionBy("doc_id", "island").orderBy("pos"))
    before = F.lag("run").over(w)
    runs = runs.withColumn("run", run).withColumn("before", before)
    start = runs.groupBy("doc_id").agg(
        F.min(F.when(F.col("line").rlike(BODY_MARKERS), F.col("pos"))).alias("marker"),
        F.min(F.when((F.length("line") > long) & (F.col("before") > short_run), F.col("pos"))).alias("body"))
    start = start.select("doc_id", F.coalesce("marker", "body", F.lit(1)).alias("start"))
    return lines.join(start, "doc_id").filter("pos >= start").drop("start")


def wiki_articles(text: Column, gap: int = 200) -> Column:
    """Pieces of one long line that stand more than ``gap`` characters apart between category tags."""
    pieces = F.split(text, r"\[\[(?:Kategorio|Category):[^\]]*\]\]")
    return F.filter(F.transform(pieces, lambda x: F.trim(x)), lambda p: F.length(p) > gap)


def fill_sections(lines: DataFrame, heading: str = r"^(=+)\s*(.+?)\s*=+$") -> DataFrame:
    """doc_id, pos, line, section, section_level: the heading above each line; the lead has level 0."""
    level = F.length(F.regexp_extract("line", heading, 1))
    name = F.when(level > 0, F.regexp_extract("line", heading, 2))
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumns({"name": name, "lv": F.when(level > 0, level)})
    filled = marked.withColumns({"section": F.last("name", ignorenulls=True).over(w), "section_level": F.coalesce(F.last("lv", ignorenulls=True).over(w), F.lit(0))})
    return filled.filter("name is null").select("doc_id", "pos", "line", "section", "section_level")


def exercises(lines: DataFrame, first: int, last: int, heading: str = r"^§\s*([0-9]+)") -> DataFrame:
    """doc_id, exercise, nth, citation, line of the lines first .. last below a numbered heading."""
    number = F.regexp_extract("line", heading, 1)
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.filter(F.col("pos").between(first, last)).withColumn("own", F.when(number != "", number))
    rows = rows.withColumn("exercise", F.last("own", ignorenulls=True).over(w)).filter("own is null and exercise is not null")
    nth = F.row_number().over(Window.partitionBy("doc_id", "exercise").orderBy("pos"))
    return rows.select("doc_id", "exercise", nth.alias("nth"), F.concat_ws(":", F.concat(F.lit("§"), "exercise"), nth).alias("citation"), "line")


def step_levels(steps: DataFrame, needs: DataFrame, rounds: int = 50) -> DataFrame:
    """(step, level) of an acyclic plan: level 0 needs nothing; others come after all they need.

    Steps on a cycle, or behind one, have no level and are left out. One join
    per level; a plan with more than ``rounds`` levels is an error.
    """
    done = steps.join(needs, "step", "left_anti").select("step", F.lit(0).alias("level"))
    left = steps.join(needs.select("step").distinct(), "step", "left_semi")
    for level in range(1, rounds + 1):
        open_ = needs.join(done.select(F.col("step").alias("need")), "need", "left_anti").select("step").distinct()
        ready = left.join(open_, "step", "left_anti").persist()
        if ready.isEmpty():
            return done
        left = left.join(ready, "step", "left_anti")
        done = done.unionByName(ready.select("step", F.lit(level).alias("level")))
    raise ValueError(f"more than {rounds} levels")


def generation_scores(pairs: DataFrame, keys: list[str], most: int = 2) -> DataFrame:
    """keys, rouge1 .. rouge<most>, bleu of predicted tokens ``x`` against ``y``.

    ROUGE is the F1 of clipped n-gram matches, BLEU the geometric mean of the
    clipped precisions with the brevity penalty; 0 where there is no n-gram.
    Each pair is scored in its row, by sorting its grams, so nothing is
    shuffled and a row holds no more than its own grams.
    """
    let = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))  # noqa: E731  f(value), the value computed once

    def grams(side: str, n: int) -> Column:
        """(gram, side, c) of each distinct gram: lengths of the runs of the sorted ones."""
        all_ = F.col(side) if n == 1 else F.transform(F.sequence(F.lit(1), F.size(side) - n + 1), lambda i: F.array_join(F.slice(side, i, n), " "))
        starts = lambda s: F.filter(F.transform(s, lambda g, i: F.struct(g.alias("g"), i.alias("i"), ((i == 0) | (g != F.get(s, i - 1))).alias("new"))), lambda e: e["new"])
        runs = lambda s: let(starts(s), lambda r: F.transform(r, lambda e, j: F.struct(e["g"].alias("g"), F.lit(side).alias("side"), (F.coalesce(F.get(r, j + 1)["i"], F.size(s)) - e["i"]).alias("c"))))
        return F.when(F.size(side) >= n, let(F.sort_array(all_), runs))

    def matches(n: int) -> Column:
        shared = lambda e: F.transform(F.filter(F.transform(e, lambda x, i: F.struct((x["g"] == F.get(e, i - 1)["g"]).alias("met"), F.least(x["c"], F.get(e, i - 1)["c"]).alias("c"))), lambda x: x["met"]), lambda x: x["c"])
        met = let(F.sort_array(F.concat(grams("x", n), grams("y", n))), shared)
        return F.coalesce(F.aggregate(met, F.lit(0).cast("long"), lambda s, c: s + c), F.lit(0).cast("long"))

    rows = pairs.select(*keys, F.size("x").alias("a"), F.size("y").alias("b"), *[matches(n).alias(f"m{n}") for n in range(1, most + 1)])
    have = lambda side, n: F.greatest(F.col(side) - n + 1, F.lit(0))
    rouge = [F.when(have("a", n) + have("b", n) > 0, 2.0 * F.col(f"m{n}") / (have("a", n) + have("b", n))).otherwise(0.0).alias(f"rouge{n}") for n in range(1, most + 1)]
    logs = [F.log((F.col(f"m{n}") + 1e-9) / F.greatest(have("a", n), F.lit(1))) / most for n in range(1, most + 1)]
    short = F.least(F.lit(0.0), 1.0 - F.col("b") / F.col("a"))
    return rows.select(*keys, *rouge, F.when(F.col("a") > 0, F.exp(reduce(Column.__add__, logs) + short)).otherwise(0.0).alias("bleu"))
