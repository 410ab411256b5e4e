"""Filter interaction audit: what each filter removes in every order of filters, and its Shapley value.

Every row fails some of the filters, so it belongs to one of 2**n masks. A coalition of filters removes the rows whose mask
meets it: these 2**n totals per part are all that any order needs, as the step of a filter removes the difference of two
coalitions. The Shapley values are the exact solution of constrained least squares: the values whose sums over coalitions are
nearest to the coalitions' removals under the kernel's weights, and add up to the removal of all filters. Its normal equations
do not depend on the removals, so they are solved once in rationals, as whole numbers over one denominator per coalition.

Rows are reduced to counts before anything is compared: copies are found over 256-bit text digests, first by (digest, id) and
then by (digest, part, flags), so a text or a part that fills a third of the table is one counted group.

Defined results: a null text is empty, a null part the empty string; a row with a null id is never a copy and makes none;
repeated rows of one id are no copies of each other, and each counts; labels of unknown or null ids count for nothing, and
of several labels of one id any 1 counts; an empty table has no parts and gives no rows; extra columns are not used.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations
from math import comb, factorial

from pyspark.sql import Column, DataFrame, functions as F

BLANKS = r"[\x20\x09-\x0D]+"
# Most filters: orders are all listed, and 6 have 720 of them.
MOST = 6


def solve(matrix: list[list[Fraction]], right: list[list[Fraction]]) -> list[list[Fraction]]:
    """Exact solutions of a square system for several right-hand sides, given as rows beside the matrix's."""
    rows = [[*a, *b] for a, b in zip(matrix, right)]
    n = len(rows)
    for i in range(n):
        pivot = next(r for r in range(i, n) if rows[r][i])
        rows[i], rows[pivot] = rows[pivot], rows[i]
        rows[i] = [x / rows[i][i] for x in rows[i]]
        for r in range(n):
            if r != i and rows[r][i]:
                rows[r] = [x - rows[r][i] * y for x, y in zip(rows[r], rows[i])]
    return [row[n:] for row in rows]


def shapley_weights(n: int) -> list[list[int]]:
    """For each of n players, n! times the weight of each coalition's value (by bit mask) in its Shapley value.

    Minimises the sum over all proper coalitions S of k(S) (value(S) - sum of S's players)**2 with the kernel
    k(S) = (n - 1) / (C(n, |S|) |S| (n - |S|)), under the condition that all players add up to the value of everyone.
    """
    if n == 1:
        return [[0, 1]]
    everyone = (1 << n) - 1
    kernel = {s: Fraction(n - 1, comb(n, size) * size * (n - size)) for s in range(1, everyone) for size in [s.bit_count()]}
    # Normal equations with a Lagrange multiplier; a right-hand side for each coalition's value.
    matrix = [[sum((k for s, k in kernel.items() if s >> i & 1 and s >> j & 1), Fraction(0)) for j in range(n)] + [Fraction(1)]
              for i in range(n)]
    matrix.append([Fraction(1)] * n + [Fraction(0)])
    right = [[kernel.get(s, Fraction(0)) * (s >> i & 1) for s in range(everyone + 1)] for i in range(n)]
    right.append([Fraction(s == everyone) for s in range(everyone + 1)])
    scaled = [[x * factorial(n) for x in row] for row in solve(matrix, right)[:n]]
    if any(x.denominator != 1 for row in scaled for x in row):
        raise ArithmeticError("n! times a Shapley weight is whole")
    return [[int(x) for x in row] for row in scaled]


def text_rules(text: Column) -> dict[str, Column]:
    """Failure conditions of single texts: short, repetitive, shouting, with symbols."""
    body = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(body, BLANKS), "")
    capitals = F.length(body) - F.length(F.regexp_replace(body, "[A-Z]", ""))
    return {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        "C": 100 * capitals.cast("bigint") > 5 * F.length(body).cast("bigint"),
        "D": body.rlike(r"[#$%&*|]"),
    }


def failures(docs: DataFrame, labels: DataFrame, rules: dict[str, Column], key: str = "doc_id", text: str = "text",
             part: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): rows by the filters they fail, those of ``rules`` in order and last the copies: texts
    equal to one with a smaller id. ``good`` and ``toxic`` count rows labelled so."""
    bits = [F.when(failed, 1 << i).otherwise(0) for i, failed in enumerate(rules.values())]
    copy = 1 << len(bits)
    marked = docs.select(
        F.col(key).cast("bigint").alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).alias("digest"), sum(bits[1:], bits[0]).alias("mask"))
    known = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("bigint").alias("id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    # Ids are spread evenly but for repeated ones, whose rows are counted before they are shuffled.
    ids = marked.groupBy("digest", "id", "part", "mask").agg(F.count(F.lit(1)).alias("n")).join(known, "id", "left").select(
        "digest", "id", "part", "mask", "n", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    # Rows of a digest by part and labels, with the number of those that have its least id here.
    named = F.col("id").isNotNull()
    held = ids.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.sum(F.when(named, 0).otherwise(F.col("n"))).alias("nameless"),
        F.min(F.when(named, F.struct("id", "n"))).alias("low"))
    # The counts of a digest's first id in each of its groups.
    first = held.groupBy("digest").agg(F.min("low.id").alias("first"), F.count(F.lit(1)).alias("groups"))
    joined = held.join(first.where("groups > 1").select(F.col("digest").alias("_digest"), "first"), F.col("digest") == F.col("_digest"), "left")
    # A digest with one group has its least id there.
    least = F.coalesce("first", F.col("low.id"))
    copies = F.col("n") - F.col("nameless") - F.when(F.col("low.id") == least, F.col("low.n")).otherwise(0)
    counted = joined.select("part", "mask", "good", "toxic", "n", copies.alias("copies"))
    both = F.array(F.struct(F.col("mask").alias("mask"), (F.col("n") - F.col("copies")).alias("n")),
                   F.struct((F.col("mask") + F.lit(copy)).alias("mask"), F.col("copies").alias("n")))
    split = counted.select("part", "good", "toxic", F.inline(both).alias("mask", "n"))
    # A part whose rows all have a copy elsewhere keeps a row of zero, so that no part is lost.
    return split.groupBy("part", "mask").agg(
        F.sum("n").cast("bigint").alias("n"), F.sum(F.col("n") * F.col("good")).cast("bigint").alias("good"),
        F.sum(F.col("n") * F.col("toxic")).cast("bigint").alias("toxic"))


def coalitions(masks: DataFrame, n: int) -> DataFrame:
    """One row per part: its total, and arrays (by coalition) of the rows, good rows and toxic rows that each removes. At most
    2**n masks of a part meet."""
    everyone = (1 << n) - 1
    sums = [F.sum(F.when(F.col("mask").bitwiseAND(F.lit(s)) != 0, F.col(c)).otherwise(0)) for c in ("n", "good", "toxic")
            for s in range(everyone + 1)]
    size = everyone + 1
    return masks.groupBy("part").agg(
        F.sum("n").alias("total"), F.array(*sums[:size]).alias("removed"), F.array(*sums[size : 2 * size]).alias("good"),
        F.array(*sums[2 * size :]).alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame, rules: dict[str, Column] | None = None, copies: str = "E", key: str = "doc_id",
          text: str = "text", part: str = "source") -> DataFrame:
    """One row per part, order of filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    ``rules`` gives each filter's failure condition by its letter, ``copies`` is the letter of the filter of exact copies.
    """
    rules = rules or text_rules(F.col(text))
    letters = [*rules, copies]
    n = len(letters)
    if n > MOST or any(len(x) != 1 for x in letters):
        raise ValueError(f"at most {MOST} filters, each named by one letter")
    table = coalitions(failures(docs, labels, rules, key, text, part), n)
    weights = F.array(*[F.array(*[F.lit(w).cast("bigint") for w in row]) for row in shapley_weights(n)])
    shapley = F.transform(weights, lambda row: F.aggregate(
        F.zip_with(row, "removed", lambda w, v: w * v), F.lit(0).cast("bigint"), lambda a, x: a + x))
    orders = F.array(*[F.lit("".join(p)) for p in permutations(letters)])
    valued = table.withColumn("_shapley", shapley)
    steps = valued.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))

    def place(i: Column) -> Column:
        return F.instr(F.lit("".join(letters)), F.substr("filter_order", i, F.lit(1))) - 1

    def bit(i: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1), place(i))

    taken = F.aggregate(F.sequence(F.lit(1), F.col("step")), F.lit(0), lambda mask, i: mask.bitwiseOR(bit(i)))
    named = steps.withColumns({"_after": taken, "_bit": bit(F.col("step")), "_place": place(F.col("step"))})
    before = F.col("_after").bitwiseXOR(F.col("_bit"))

    def at(table: str, coalition: Column) -> Column:
        return F.get(F.col(table), coalition)

    removed = at("removed", F.col("_after")) - at("removed", before)
    everyone = (1 << n) - 1
    return named.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"),
        (F.col("total") - at("removed", F.col("_after"))).alias("kept"), removed.alias("removed"),
        (at("removed", F.col("_bit")) - removed).alias("redundant"),
        (at("removed", F.lit(everyone)) - at("removed", F.lit(everyone).bitwiseXOR(F.col("_bit")))).alias("unique_fails"),
        (at("good", F.col("_after")) - at("good", before)).alias("good_lost"),
        (at("toxic", F.col("_after")) - at("toxic", before)).alias("toxic_lost"),
        F.get(F.col("_shapley"), F.col("_place")).alias("shapley"))
