"""Document fingerprints: invertible Bloom lookup tables over paragraph digests.

A paragraph is a sentence, or each 160 characters of a longer one; its digest enters one cell in each third of a table, as
a count, the digest and a check hash, the latter two combined by exclusive or. Two tables subtract cell by cell, which
leaves the digests on one side only; cells that hold a single one are read off and taken out of its other cells until
nothing is left. The fingerprint is the smallest table. Where its difference cannot be read off, the digests are parted by
hash into groups of about six, so that all groups together have a larger table; a group's grows again where it fails.

Documents meet their successors in ranges of ids: cut points are ids of the table itself, and the first document of a range
is also dealt to the range before it, so texts are shuffled once and no task orders them all. Column functions only.

Defined results: a null text is empty; two empty texts have likeness 1; documents of one id follow each other in order of
text, those without an id come last; a single document follows itself; a table without any id is one range; an empty table
gives an empty table; extra columns are not used.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window, functions as F

PARAGRAPH = r"[^\\n.!?]{1,160}[.!?\\n]*|[.!?\\n]+"
CELLS = 12
# Digests of a group, and cells of its tables from the first try on.
GROUP = 6
RETRIES = (12, 24, 48, 96)
# Rows of a range, and most cut points that the driver hands out; beyond them ranges grow, and Spark sorts them on disk.
RANGE, MOST_CUTS = 2_000, 10_000

_names = count()


def _fresh() -> str:
    return f"v{next(_names)}"


def _let(value: str, body) -> str:
    """body(name) with the value computed once per row."""
    name = _fresh()
    return f"transform(array({value}), {name} -> {body(name)})[0]"


def digests(text: str) -> str:
    """Distinct paragraph digests of a text column."""
    p = _fresh()
    return f"array_distinct(transform(regexp_extract_all({text}, '{PARAGRAPH}', 0), {p} -> xxhash64({p})))"


def _hits(digest: str, cell: str, cells: int) -> str:
    third = cells // 3
    return f"pmod(shiftrightunsigned({digest}, 20 * cast({cell} div {third} as int)), {third}) = {cell} % {third}"


def table_of(held: str, cells: int = CELLS) -> str:
    """The cells of an array of digests; ``held`` is a name, not an expression."""
    cell, digest, a, v = (_fresh() for _ in range(4))
    body = _let(f"filter({held}, {digest} -> {_hits(digest, cell, cells)})", lambda inside: (
        f"named_struct('n', cast(size({inside}) as bigint), 'k', aggregate({inside}, 0L, ({a}, {v}) -> {a} ^ {v}), "
        f"'h', aggregate({inside}, 0L, ({a}, {v}) -> {a} ^ xxhash64({v}, 1)))"))
    return f"transform(sequence(0, {cells - 1}), {cell} -> {body})"


def subtract(left: str, right: str) -> str:
    p, q = _fresh(), _fresh()
    return (f"zip_with({left}, {right}, ({p}, {q}) -> "
            f"named_struct('n', {p}.n - {q}.n, 'k', {p}.k ^ {q}.k, 'h', {p}.h ^ {q}.h))")


def peel(difference: str, cells: int) -> str:
    """The digests on one side only, as (k, n) with n = 1 for the left and -1 for the right; null where cells stay filled."""
    s, i, e, g, j, y, a, v, w = (_fresh() for _ in range(9))
    single = (f"array_distinct(transform(filter({s}.c, {e} -> abs({e}.n) = 1 and xxhash64({e}.k, 1) = {e}.h), "
              f"{g} -> named_struct('k', {g}.k, 'n', {g}.n)))")

    def emptied(keys: str) -> str:
        def cell(found: str) -> str:
            return (f"if(size({found}) = 0, {w}, named_struct('n', {w}.n - aggregate({found}, 0L, ({a}, {v}) -> {a} + {v}.n), "
                    f"'k', {w}.k ^ aggregate({found}, 0L, ({a}, {v}) -> {a} ^ {v}.k), "
                    f"'h', {w}.h ^ aggregate({found}, 0L, ({a}, {v}) -> {a} ^ xxhash64({v}.k, 1))))")

        inner = _let(f"filter({keys}, {y} -> {_hits(f'{y}.k', j, cells)})", cell)
        return (f"if(size({keys}) = 0, named_struct('c', {s}.c, 'd', {s}.d, 'o', false), named_struct("
                f"'c', transform({s}.c, ({w}, {j}) -> {inner}), 'd', concat({s}.d, {keys}), 'o', true))")

    start = f"named_struct('c', {difference}, 'd', cast(array() as array<struct<k:bigint,n:bigint>>), 'o', true)"
    done = f"{s} -> if(forall({s}.c, {e} -> {e}.n = 0 and {e}.k = 0), {s}.d, null)"
    # A round without a single digest ends the work; the rounds left pass by.
    return f"aggregate(sequence(1, {cells}), {start}, ({s}, {i}) -> if({s}.o, {_let(single, emptied)}, {s}), {done})"


def _part(left: str, right: str) -> str:
    """Differing digests of one group, by larger and larger tables, at last by the digests themselves."""
    tries = [peel(subtract(table_of(left, cells), table_of(right, cells)), cells) for cells in RETRIES]
    a, b = _fresh(), _fresh()
    plain = (f"concat(transform(array_except({left}, {right}), {a} -> named_struct('k', {a}, 'n', 1L)), "
             f"transform(array_except({right}, {left}), {b} -> named_struct('k', {b}, 'n', -1L)))")
    none = "cast(array() as array<struct<k:bigint,n:bigint>>)"
    return f"if(size({left}) + size({right}) = 0, {none}, coalesce({', '.join(tries)}, {plain}))"


def differing(left: str, right: str, left_table: str, right_table: str) -> str:
    """Differing digests of two named digest arrays and their named smallest tables."""
    s, t, h = _fresh(), _fresh(), _fresh()

    def inside(held: str, group: str, parts: str, shift: int) -> str:
        # Bits that choose no cell.
        return f"filter({held}, {h} -> pmod(shiftrightunsigned({h}, {shift}), {parts}) = {group})"

    def split(parts: str) -> str:
        groups = f"sequence(0, {parts} - 1)"

        def wide(x: str) -> str:
            def both(y: str) -> str:
                part = _let(inside(x, t, parts, 55), lambda p: _let(inside(y, t, parts, 55), lambda q: _part(p, q)))
                return f"flatten(transform({groups}, {t} -> {part}))"

            return _let(inside(right, s, parts, 46), both)

        return f"flatten(transform({groups}, {s} -> {_let(inside(left, s, parts, 46), wide)}))"

    parts = f"cast(greatest(ceil(sqrt(ceil((size({left}) + size({right})) / {GROUP}))), 1) as int)"
    none = "cast(array() as array<struct<k:bigint,n:bigint>>)"
    return (f"if({left} = {right}, {none}, coalesce({peel(subtract(left_table, right_table), CELLS)}, {_let(parts, split)}))")


def likeness(left: str, right: str, left_table: str, right_table: str) -> Column:
    """Share of paragraphs that both have: 2 common / (left + right)."""
    both = f"(size({left}) + size({right}))"
    return F.expr(f"if({both} = 0, 1.0D, ({both} - size({differing(left, right, left_table, right_table)})) / cast({both} as double))")


def written(table: str) -> Column:
    """A table as text: count, digest and check hash of each cell in hexadecimal."""
    e = _fresh()
    return F.expr(f"lower(concat_ws('.', transform({table}, {e} -> concat_ws('-', hex({e}.n), hex({e}.k), hex({e}.h)))))")


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, next_text) in descending order of doc_id, the last being followed by the first."""
    held = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = docs.where("doc_id is not null").count()
    ranges = max(1, min(MOST_CUTS, -(-rows // RANGE)))
    shares = ", ".join(repr(i / ranges) for i in range(1, ranges + 1))
    cuts = docs.agg(F.expr(f"percentile_approx(doc_id, array({shares}), {max(10_000, 10 * ranges)})")).first()[0] or []
    cuts = sorted(set(cuts))
    listed = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>") if cuts else F.array().cast("array<bigint>")
    last = len(cuts) - 1
    # Binary search: cut points below the id. Range i ends with the document of cut point i.
    found = F.aggregate(
        F.sequence(F.lit(1), F.lit(max(1, len(cuts)).bit_length())), F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi")),
        lambda s, _: F.when(s["lo"] >= s["hi"], s).otherwise(F.when(
            F.get(listed, F.shiftright(s["lo"] + s["hi"], 1)) < F.col("doc_id"),
            F.struct((F.shiftright(s["lo"] + s["hi"], 1) + 1).alias("lo"), s["hi"].alias("hi"))
        ).otherwise(F.struct(s["lo"].alias("lo"), F.shiftright(s["lo"] + s["hi"], 1).alias("hi")))),
        lambda s: s["lo"])
    placed = held.withColumn("_range", F.when(F.col("doc_id").isNull(), 0).otherwise(found))
    # A document at a cut point is also the successor of the range above, the very first of the range of the last.
    at_cut = F.get(listed, F.col("_range")) == F.col("doc_id")
    guest = F.when(at_cut, F.when(F.col("_range") == last, 0).otherwise(F.col("_range") + 1))
    dealt = placed.withColumn("_guest", guest).select(
        "doc_id", "text", F.explode(F.when(F.col("_guest").isNull(), F.array(F.struct(F.col("_range"), F.lit(0).alias("_late"))))
                                    .otherwise(F.array(F.struct(F.col("_range"), F.lit(0).alias("_late")),
                                                       F.struct(F.col("_guest").alias("_range"), F.lit(1).alias("_late"))))).alias("_to"))
    order = Window.partitionBy("_to._range").orderBy("_to._late", F.desc_nulls_last("doc_id"), "text")
    follows = F.coalesce(F.lead("text").over(order), F.first("text").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return dealt.withColumn("next_text", follows).where("_to._late = 0").select("doc_id", "text", "next_text")


def compare(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text and of the next document, and their likeness.

    The edited text has the last third of the characters replaced by the first ones of the next document.
    """
    rows = with_next(docs).withColumn("n_chars", F.length("text").cast("bigint"))
    rows = rows.withColumn("_edited", F.expr(
        "concat(left(text, cast(n_chars - n_chars div 3 as int)), left(next_text, cast(n_chars div 3 as int)))"))
    rows = rows.select("doc_id", "n_chars", F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"), *[
        F.expr(digests(c)).alias(n) for c, n in (("text", "_x"), ("_edited", "_y"), ("next_text", "_z"))])
    rows = rows.withColumns({f"{c}t": F.expr(table_of(c)) for c in ("_x", "_y", "_z")})
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", written("_xt").alias("fingerprint"), written("_yt").alias("edited_fingerprint"),
        likeness("_x", "_y", "_xt", "_yt").alias("near_edited"), likeness("_x", "_z", "_xt", "_zt").alias("near_next"))
