"""Column functions over base sequences. Each takes and returns a Column and stays inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The IUPAC nucleotide codes and their complements, both cases.
IUPAC = "ACGTUMRWSYKVHDBNXacgtumrwsykvhdbnx"
IUPAC_COMPLEMENT = "TGCAAKYWSRMBDHVNXtgcaakywsrmbdhvnx"

MASK = "X"


def clean_seq(seq: Column) -> Column:
    """Each run of uppercase letters other than A, C, G and T becomes one X; lowercase is left alone."""
    return F.regexp_replace(seq, "[BD-FH-SU-Z]+", MASK)


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, IUPAC, IUPAC_COMPLEMENT))


def mask_interval(seq: Column, start: Column, end: Column, padding: int = 0, all_copies: bool = True) -> Column:
    """Replace the 0-based half-open interval, widened by half the padding on each side, with X.

    By default every copy of the cut text in the sequence is masked, left to right. An interval that is
    empty after clamping changes nothing.
    """
    half = padding // 2
    low = F.greatest(start - half, F.lit(0)).cast("int")
    high = F.least(end + half, F.length(seq)).cast("int")
    width = high - low
    if all_copies:
        masked = F.replace(seq, F.substring(seq, low + 1, width), F.repeat(F.lit(MASK), width))
    else:
        masked = F.overlay(seq, F.repeat(F.lit(MASK), width), low + 1, width)
    return F.when(width > 0, masked).otherwise(seq)


def mask_intervals(seq: Column, intervals: Column, padding: int = 0, all_copies: bool = True) -> Column:
    """Apply ``mask_interval`` for each (start, end) struct of an ordered array; earlier masks change later cuts."""
    return F.aggregate(
        intervals, seq,
        lambda text, cut: mask_interval(text, cut["start"], cut["end"], padding, all_copies),
    )


def let(value: Column, body) -> Column:
    """body(value) with the value computed once per row."""
    return F.transform(F.array(value), body)[0]


def masked_snippets(seq: Column, masked: Column, margin: int) -> Column:
    """The parts of a text around its mask symbols, as (seq, masked) structs: each run of symbols with ``margin`` letters
    on both sides, runs whose margins would meet or overlap being one part. ``masked`` has the length of ``seq``.
    """
    none = F.expr("cast(array() as array<struct<low:int,high:int>>)")
    start = F.struct(F.lit(0).alias("at"), none.alias("parts"))

    def step(state: Column, piece: Column) -> Column:
        low = state["at"] + F.length(piece["gap"])
        high = low + F.length(piece["run"])
        last = F.element_at(state["parts"], -1)
        part = F.array(F.struct(low.alias("low"), high.alias("high")))
        joined = F.concat(F.slice(state["parts"], 1, F.size(state["parts"]) - 1), F.array(F.struct(last["low"].alias("low"), high.alias("high"))))
        near = (F.size(state["parts"]) > 0) & (low - F.get(state["parts"], F.size(state["parts"]) - 1)["high"] < 2 * margin)
        parts = F.when(near, joined).otherwise(F.concat(state["parts"], part))
        return F.struct(high.alias("at"), parts.alias("parts"))

    runs = F.regexp_extract_all(masked, F.lit(f"{MASK}+"), F.lit(0))
    gaps = F.slice(F.split(masked, f"{MASK}+", -1), 1, F.size(runs))
    pieces = F.zip_with(gaps, runs, lambda gap, run: F.struct(gap.alias("gap"), run.alias("run")))

    def cut(part: Column) -> Column:
        low = F.greatest(part["low"] - margin, F.lit(0))
        width = F.least(part["high"] + margin, F.length(seq)) - low
        return F.struct(F.substring(seq, low + 1, width).alias("seq"), F.substring(masked, low + 1, width).alias("masked"))

    return F.transform(F.aggregate(pieces, start, step, lambda s: s["parts"]), cut)


def fixed_chunks(seq: Column, size: int) -> Column:
    """Consecutive non-overlapping pieces of ``size`` letters; the last may be shorter."""
    return F.regexp_extract_all(seq, F.lit("(?s)(.{1,%d})" % size), F.lit(1))


def keep_tokens(tokens: Column) -> Column:
    """Tokens longer than two letters that hold no mask symbol."""
    return F.filter(tokens, lambda t: (F.length(t) > 2) & ~F.contains(t, F.lit(MASK)))


def file_stem(path: Column) -> Column:
    """File name without its directory and last extension."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)
