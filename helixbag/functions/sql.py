"""The sequence functions as SQL functions, scalar and table-valued, for use in plain SQL. None needs a Python worker."""

from __future__ import annotations

from pyspark.sql import SparkSession

from helixbag.functions.sequence import IUPAC, IUPAC_COMPLEMENT, MASK

# Name with parameters, result, and body. A window is matched ahead of every place, so a text is walked once for each size.
FUNCTIONS = {
    "clean_seq(seq string)": ("string", f"regexp_replace(seq, '[BD-FH-SU-Z]+', '{MASK}')"),
    "reverse_complement(seq string)": ("string", f"reverse(translate(seq, '{IUPAC}', '{IUPAC_COMPLEMENT}'))"),
    "mask_interval(seq string, start_at int, end_at int, padding int)": ("string", f"""
        case when least(end_at + padding div 2, length(seq)) > greatest(start_at - padding div 2, 0)
             then replace(seq, substr(seq, greatest(start_at - padding div 2, 0) + 1,
                                      int(least(end_at + padding div 2, length(seq)) - greatest(start_at - padding div 2, 0))),
                          repeat('{MASK}', int(least(end_at + padding div 2, length(seq)) - greatest(start_at - padding div 2, 0))))
             else seq end"""),
    "strands(seq string)": ("table(strand string, text string)", """
        select '+', clean_seq(seq) union all select '-', reverse_complement(clean_seq(seq))"""),
    "kmers(seq string, k_min int, k_max int)": ("table(k int, term string)", """
        select length(term), term
        from explode(flatten(transform(sequence(k_min, k_max), k -> regexp_extract_all(seq, concat('(?=([ACGT]{', k, '}))'), 1)))) as t(term)"""),
}


def register_functions(spark: SparkSession) -> list[str]:
    """Create the functions for this session; returns their names."""
    for head, (result, body) in FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {head} returns {result} return {body}")
    return [head.split("(")[0] for head in FUNCTIONS]
