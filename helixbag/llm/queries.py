"""The registered queries of the pipeline operators and their checking SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from helixbag.llm import (bpe_codec, collocations, filter_audit, fingerprint, license_scan, minhash_dedup, mixing, piece_codec,
                          quality_classifier, quality_rules, secret_scan, substring_dedup, url_filter)

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
PIECES = public_tokenizers.path("piece_bpe_32k.model")

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(query):
        QUERIES[name] = query
        if sql:
            ORACLE[name] = sql
        return query

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


OP1_SQL = r"""
with sized as (
    select doc_id, source, coalesce(text, '') as body,
        len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) as size,
        md5(concat_ws('-', doc_id, source, md5(text), '42')) as h
    from documents
), drawn as (
    select doc_id, source, size, h, -ln((cast(cast('0x' || substr(h, 1, 13) as bigint) as double) + 0.5::double) / 4503599627370496::double)
        / least(greatest(case when size > 0 then 1 / (1 + cast(length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')) as double) / size)
                              else 1 end, 0.25::double), 4::double) as key
    from sized
), sources as (
    select source, sum(size) as source_size, cast(1 + (row_number() over (order by source nulls last) - 1) % 3 as double) as weight,
        row_number() over (order by source nulls last) as place
    from sized group by source
), levels as (
    select *, 3.0::double * source_size as top, 3.0::double * source_size / weight as ratio from sources
), filled as (
    select *, (sum(source_size) over () - coalesce(sum(top) over (order by ratio, place rows between unbounded preceding and 1 preceding), 0))
        / sum(weight) over (order by ratio, place rows between current row and unbounded following) as level
    from levels
), aims as (
    select source, source_size, least(top, weight * (select arg_min(level, (ratio, place)) from filled where ratio >= level)) as target from filled
), budgets as (
    select *, case when source_size > 0 then floor(target / source_size) else 0 end as epochs from aims
)
select doc_id, d.source, size, cast(source_size as bigint) as source_size, target,
    cast(epochs * size + greatest(0, least(size, floor(target - epochs * source_size)
        - coalesce(sum(size) over (partition by d.source order by key, h, doc_id rows between unbounded preceding and 1 preceding), 0))) as bigint) as taken
from drawn d join budgets b on d.source is not distinct from b.source
"""


@register("op1_mixing", OP1_SQL)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"))


@register("op2_bpe_codec")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return bpe_codec.encode_and_decode(docs, RANKS, PATTERN).drop("text")


@register("op3_substring_dedup")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, folder, "documents"))


@register("op4_secret_scan")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_scan.scan(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"),
                        "spans", "n_lexed")


@register("op5_minhash_dedup")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, folder, "documents"), shingle=2, percent=80)


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block")]
# Hosts whose pages make the list of URLs.
LISTED_HOSTS = "(spam|adult)"

OP6_SQL = f"""
with parts as (
    select page_id, case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end as rest
    from pages
), split as (
    select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{url_filter.UPPER}', '{url_filter.LOWER}') as host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path,
        list_sort(list_filter(string_split(regexp_extract(rest, '^[^?#]*\\?([^#]*)', 1), '&'),
            lambda p: p <> '' and not regexp_matches(p, '{url_filter.TRACKING}'))) as kept
    from parts
), named as (
    select page_id, coalesce(host, '') as host, coalesce(path, '') as path,
        coalesce(regexp_replace(host, '^www\\.', '') || regexp_replace(path, '/+$', '')
            || case when len(kept) > 0 then '?' || array_to_string(kept, '&') else '' end, '') as canonical_url
    from split
), rules (own_host, own_path, verdict) as (values {", ".join(map(str, RULES))}),
fits as (
    select page_id, arg_max(own_host || own_path, length(own_host || own_path)) as rule,
        arg_max(verdict, length(own_host || own_path)) as verdict
    from (select distinct page_id, host, path from named) n
    join rules on (host = own_host or ends_with(host, '.' || own_host)) and starts_with(path, own_path)
    group by page_id
), listed as (
    select distinct canonical_url from named where regexp_matches(host, '{LISTED_HOSTS}') and canonical_url <> ''
)
select n.page_id, host, path, n.canonical_url, rule,
    coalesce(f.verdict, case when l.canonical_url is not null then 'block' else 'allow' end) as verdict
from named n left join fits f on n.page_id = f.page_id left join listed l on n.canonical_url = l.canonical_url
""".replace("\\\\", "\\")


@register("op6_url_filter", OP6_SQL)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    listed = pages.where(url_filter.host_of(F.col("url")).rlike(LISTED_HOSTS)).select("url")
    return url_filter.judge(pages, listed, RULES).select("page_id", "host", "path", "canonical_url", "rule", "verdict")


def _license_sql() -> str:
    bodies = ", ".join(f"({i}, '{name}', '{body}')" for i, (name, body) in enumerate(license_scan.TEMPLATES))
    def terms(column: str) -> str:
        return f"list_distinct(list_filter(string_split_regex(lower({column}), '{license_scan.NOT_TERM}'), lambda t: t <> ''))"

    return f"""
with docs as (
    select doc_id, text, source || '/' || lang || '/' || (doc_id // 100) as directory from documents
), templates (template, license, body) as (values {bodies}),
own as (select template, license, unnest({terms("body")}) as term from templates),
words as (select distinct term from own),
seen as (
    select term, count(*) as df from (select unnest({terms("text")}) as term from docs) group by term
), known as (
    select term, ln((1 + (select count(*) from docs)) / (1 + coalesce(df, 0))) + 1 as idf
    from (select term from words union select term from seen) left join seen using (term)
), shares as (
    select template, license, term, idf / sqrt(sum(idf * idf) over (partition by template)) as share from own join known using (term)
), passages as (
    select distinct text, unnest(string_split(regexp_replace(text, '([.!?])[ \t\r]+', '\1' || chr(10), 'g'), chr(10))) as passage from docs
), held as (select distinct text, {terms("passage")} as terms from passages),
each as (select text, terms, unnest(terms) as term from held),
norms as (
    select text, terms, sqrt(sum(idf * idf)) as norm from each join known using (term) group by text, terms
), scored as (
    select text, license, max(score) as score from (
        select e.text, e.terms, s.template, s.license, round(sum(k.idf * s.share) / any_value(n.norm), 6) as score
        from each e join known k using (term) join shares s using (term) join norms n on e.text = n.text and e.terms = n.terms
        group by e.text, e.terms, s.template, s.license
    ) where score >= {license_scan.THRESHOLD} group by text, license
), best as (
    select text, arg_min(license, (-score, license)) as license, max(score) as score from scored group by text
), marked as (
    select d.*, b.license, b.score,
        b.license is not null and len(string_split_regex(trim(d.text), '\\s+')) <= {license_scan.FILE_WORDS} as is_file
    from docs d left join best b using (text)
), given as (
    select directory, arg_min(license, (-n, license)) as given from (
        select directory, license, count(*) as n from marked where is_file group by directory, license
    ) group by directory
), up as (
    select directory, array_to_string(string_split(directory, '/')[1:depth], '/') as above, depth
    from (select distinct directory from docs) cross join (select unnest([1, 2, 3]) as depth)
), nearest as (
    select u.directory, arg_max(given, depth) as given, arg_max(above, depth) as above
    from up u join given g on u.above = g.directory group by u.directory
)
select doc_id, m.directory || '/' || doc_id as path, coalesce(m.license, given) as license, score as license_score,
    case when is_file then 'file' when m.license is not null then 'text' else above end as license_from
from marked m left join nearest n using (directory)
"""


@register("op7_license_scan", _license_sql())
def op7(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    path = F.concat_ws("/", "source", "lang", F.expr("doc_id div 100"), "doc_id")
    found = license_scan.scan(docs.select("doc_id", "text", path.alias("path")))
    return found.select("doc_id", "path", "license", "license_score", "license_from")


# Share of the trusted texts, each judged without its own counts, whose ratio a document must reach.
CLEAN_SHARE = 0.99


@register("op8_quality_rules")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    trusted = table(spark, folder, "labels").where((F.col("quality") == 1) & (F.col("toxic") == 0))
    return quality_rules.judge_held_out(docs, trusted, CLEAN_SHARE).drop("text")


@register("op9_fingerprint")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprint.compare(table(spark, folder, "documents").select("doc_id", "text"))


def rejected():
    """What the labels say against a document."""
    return (F.col("quality") == 0) | (F.col("toxic") == 1)


@register("op10_quality_classifier")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "source", "lang")
    return quality_classifier.classify(docs, table(spark, folder, "labels"), rejected()).drop("text")


OP11_SQL = r"""
with bodies as (
    select doc_id, coalesce(source, '') as part, coalesce(text, '') as body,
        list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as words
    from documents
), marks as (
    select doc_id, max(cast(quality = 1 as int)) as good, max(cast(toxic = 1 as int)) as toxic from labels where doc_id is not null group by doc_id
), judged as (
    select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
        cast(len(words) < 50 as int)
        + 2 * cast(100 * len(list_distinct(words)) < 65 * len(words) as int)
        + 4 * cast(100 * (length(body) - length(regexp_replace(body, '[A-Z]', '', 'g'))) > 5 * length(body) as int)
        + 8 * cast(regexp_matches(body, '[#$%&*|]') as int)
        + 16 * cast(coalesce(min(doc_id) over (partition by body) < doc_id, false) as int) as mask
    from bodies left join marks using (doc_id)
), counted as (
    select part, mask, count(*) as n, sum(good) as good, sum(toxic) as toxic from judged group by part, mask
), letters (l, bit) as (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders as (
    select [a.l, b.l, c.l, d.l, e.l] as ls, [a.bit, b.bit, c.bit, d.bit, e.bit] as bits
    from letters a, letters b, letters c, letters d, letters e where a.bit | b.bit | c.bit | d.bit | e.bit = 31
), steps as (
    select array_to_string(ls, '') as filter_order, cast(step as int) as step, ls[step] as letter, bits[step] as bit,
        cast(list_sum(bits[1:step]) as int) - bits[step] as before
    from orders, (select unnest([1, 2, 3, 4, 5]) as step)
), done as (
    select part, filter_order, step, letter,
        sum(case when mask & (before | bit) = 0 then n else 0 end) as kept,
        sum(case when mask & bit > 0 and mask & before = 0 then n else 0 end) as removed,
        sum(case when mask & bit > 0 and mask & before > 0 then n else 0 end) as redundant,
        sum(case when mask = bit then n else 0 end) as unique_fails,
        sum(case when mask & bit > 0 and mask & before = 0 then good else 0 end) as good_lost,
        sum(case when mask & bit > 0 and mask & before = 0 then toxic else 0 end) as toxic_lost
    from counted cross join steps group by part, filter_order, step, letter
)
select part, filter_order, step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant,
    cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost,
    cast(sum(removed) over (partition by part, letter) as bigint) as shapley
from done
"""


@register("op11_filter_audit", OP11_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


@register("op12_piece_codec")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return piece_codec.encode_and_decode(docs, PIECES).drop("text")


OP13_SQL = rf"""
with pieces as (
    select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), '{url_filter.UPPER}', '{url_filter.LOWER}'),
        '[.,;:!?\x0A-\x0D]')) as piece
    from documents
), worded as (
    select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') as ws from pieces
), counted as (
    select lang, k, array_to_string(ws[i : i + k - 1], ' ') as phrase, count(*) as n
    from (select lang, ws, unnest(range(1, len(ws) + 1)) as i from worded) cross join (select unnest([1, 2, 3]) as k)
    where i + k - 1 <= len(ws) group by 1, 2, 3
), candidates as (
    select lang, k, phrase, n as a, string_split(phrase, ' ') as ws from counted where k > 1 and n >= 10
), cuts as (
    select c.lang, c.phrase, a, j, f.n as l, r.n as r, (cast(1000000 as hugeint) * a * a) // (cast(f.n as hugeint) * r.n) as score
    from (select *, unnest(range(1, k)) as j from candidates) c
    join counted f on f.lang = c.lang and f.phrase = array_to_string(ws[1:j], ' ')
    join counted r on r.lang = c.lang and r.phrase = array_to_string(ws[j + 1:], ' ')
), best as (
    select lang, phrase, any_value(a) as a, min(score) as score, arg_min(l, (score, j)) as l, arg_min(r, (score, j)) as r from cuts group by lang, phrase
), inside as (
    select lang, array_to_string(ws[s : s + 1], ' ') as phrase, max(a) as longer
    from (select *, unnest([1, 2]) as s from candidates where k = 3) group by 1, 2
), totals as (
    select lang, sum(n) as n from counted where k = 1 group by lang
), ranked as (
    select b.lang, row_number() over (partition by b.lang order by score desc, a desc, b.phrase) as rank, b.phrase, a, l, r, t.n, score
    from best b join totals t on b.lang = t.lang left join inside i on i.lang = b.lang and i.phrase = b.phrase
    where longer is null or 100 * longer < 50 * a
)
select lang, cast(rank as bigint) as rank, phrase, a, l, r, cast(n as bigint) as n, cast(score as bigint) as score from ranked where rank <= 2000
"""


@register("op13_collocations", OP13_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.mine(table(spark, folder, "documents"))
