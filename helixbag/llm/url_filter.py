"""URL filter: host and path rules, and a blocked Bloom filter of listed canonical URLs before an exact hash join.

The filter is a table of blocks, each of eight 64-bit words. A URL sets one bit in each word of its block, so it is built by
a grouped OR and asked by one equality join. It has no false negatives; what it passes is joined exactly with the list. The
list may have any size: blocks grow with it, and Spark picks the joins by measured sizes. Column functions only.

Defined results: a null URL or one without ``://`` has an empty host, path and canonical URL, fits no rule, and is
allowed; a null or empty listed URL lists nothing; equal rules are one, and of rules of equal length the first in code
point order wins; repeated rows are judged alike; an empty table gives an empty table; extra columns pass through, and
those named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Parameters that name a visit, not a page.
TRACKING = r"^(utm_[a-z]+|ref|gclid|fbclid)(=|$)"
# Bits per listed URL: about one false pass in 500.
BITS_PER_URL, WORDS = 16, 8


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Host without ``www.``, path without closing slashes, and the other parameters in order."""
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.concat(F.regexp_replace(host_of(url), r"^www\.", ""), F.regexp_replace(path_of(url), r"/+$", ""), tail)


def _bits(url: str) -> Column:
    return F.xxhash64(F.col(url), F.lit("bits"))


def _words() -> list[Column]:
    """The bit in each word of a block, from six bits of ``_bits`` each."""
    return [F.expr(f"shiftleft(1L, cast(pmod(shiftright(_bits, {6 * i}), 64) as int))") for i in range(WORDS)]


def bloom(listed: DataFrame, url: str, blocks: int) -> DataFrame:
    """One row per filled block: ``_block`` and the words ``_w0`` to ``_w7``."""
    marked = listed.withColumn("_bits", _bits(url)).select(
        F.pmod(F.xxhash64(url), F.lit(blocks)).alias("_block"), *[w.alias(f"_w{i}") for i, w in enumerate(_words())])
    return marked.groupBy("_block").agg(*[F.bit_or(f"_w{i}").alias(f"_w{i}") for i in range(WORDS)])


def pass_bloom(rows: DataFrame, url: str, filters: DataFrame, blocks: int) -> DataFrame:
    """Append ``_passed``: whether the URL may be listed."""
    asked = rows.withColumn("_bits", _bits(url)).withColumn("_at", F.pmod(F.xxhash64(url), F.lit(blocks)))
    joined = asked.join(filters, F.col("_at") == F.col("_block"), "left")
    hit = F.lit(True)
    for i, word in enumerate(_words()):
        hit = hit & (F.col(f"_w{i}").bitwiseAND(word) != 0)
    return joined.withColumn("_passed", F.coalesce(hit, F.lit(False)) & (F.col(url) != "")).drop(
        "_bits", "_at", "_block", *[f"_w{i}" for i in range(WORDS)])


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule as ``host/path``, and its verdict; both null where none fits. Rules are parameters."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for own_host, own_path, own in sorted(set(rules), key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]), reverse=True):
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith(own_path)
        name, verdict = F.when(fits, own_host + own_path).otherwise(name), F.when(fits, own).otherwise(verdict)
    return name, verdict


def judge(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]], url: str = "url") -> DataFrame:
    """Append host, path, canonical_url, rule, listed and verdict: the rule's, else block what is listed.

    ``rules`` are (host, path, verdict); ``listed`` has the column ``url``.
    """
    names = listed.select(canonical(F.col("url")).alias("_listed")).where("_listed <> ''").distinct()
    blocks = max(1, -(-names.count() * BITS_PER_URL // (64 * WORDS)))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = pages.withColumns({
        "host": F.coalesce(host_of(F.col(url)), F.lit("")), "path": F.coalesce(path_of(F.col(url)), F.lit("")),
        "canonical_url": F.coalesce(canonical(F.col(url)), F.lit("")),
    })
    rows = rows.withColumn("rule", rule).withColumn("_verdict", verdict).drop("listed", "verdict")
    tested = pass_bloom(rows, "canonical_url", bloom(names, "_listed", blocks), blocks)
    # Only what passed meets the list; the others would be one hot key of nulls in an outer join.
    exact = tested.where("_passed").join(names, F.col("canonical_url") == F.col("_listed"), "left").withColumn(
        "listed", F.col("_listed").isNotNull()).drop("_listed")
    both = exact.unionByName(tested.where("not _passed").withColumn("listed", F.lit(False)))
    return both.withColumn("verdict", F.coalesce("_verdict", F.when(F.col("listed"), "block").otherwise("allow"))).drop("_passed", "_verdict")
