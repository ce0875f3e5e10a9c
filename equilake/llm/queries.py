"""Registered queries of the training-data operators: whole tables, production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equilake.llm.decontaminate import contained_items
from equilake.llm.host_rules import judge
from equilake.llm.interpolated_lm import score
from equilake.llm.language_id import identify, markup_language
from equilake.llm.merkle import manifest
from equilake.llm.minhash_dedup import near_duplicates
from equilake.llm.nbest_pieces import segment
from equilake.llm.prefix_trie import trie
from equilake.llm.secret_scan import scan
from equilake.llm.substring_dedup import remove_repeats
from equilake.llm.surrogates import replace_entities
from equilake.llm.template_extract import extract
from equilake.llm.token_shards import round_trip

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file, the same on every machine; EQUILAKE_TOKENIZERS names another folder."""
    folder = os.environ.get("EQUILAKE_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")


#: Distinct 5-word shingles (s) of the rows (r) of a table, as SQL.
_SHINGLES = r"""
{0}_words as (
  select row_number() over () as r, {1}, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from {2}),
{0} as (
  select distinct r, {1}, s from (
    select r, {1}, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from {0}_words) x)"""

_NEAR_DUPLICATES = f"""
with recursive {_SHINGLES.format("sh", "doc_id", "documents")},
sizes as (select doc_id, count(*) as n from sh group by doc_id),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as c from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
one_way as (select p.a, p.b from pairs p join sizes x on x.doc_id = p.a join sizes y on y.doc_id = p.b where 100 * p.c >= 75 * (x.n + y.n - p.c)),
links as (select a, b from one_way union all select b, a from one_way),
walk as (select a as node, a as reach from links union select w.node, l.b from walk w join links l on l.a = w.reach),
least as (select node, min(reach) as component from walk group by node)
select d.doc_id, cast(coalesce(s.n, 0) as bigint) as n_shingles, coalesce(l.component, d.doc_id) as component_id, coalesce(l.component, d.doc_id) = d.doc_id as kept
from documents d left join sizes s on s.doc_id = d.doc_id left join least l on l.node = d.doc_id"""

_CONTAINED = f"""
with {_SHINGLES.format("ds", "doc_id", "documents")}, {_SHINGLES.format("bs", "item_id", "benchmark")},
n as (select r, count(*) as n from bs group by r),
shared as (select b.r, b.item_id, d.r as dr, d.doc_id, count(*) as c from bs b join ds d on d.s = b.s group by b.r, b.item_id, d.r, d.doc_id)
select distinct item_id, doc_id, cast(n.n as bigint) as n_item_shingles, cast(c as bigint) as n_shared from shared join n on n.r = shared.r where 100 * c >= 75 * n.n"""


@query("op1_minhash_dedup", _NEAR_DUPLICATES)
def op1(spark: SparkSession, root: str) -> DataFrame:
    return near_duplicates(table(spark, root, "documents"))


@query("op2_secret_scan")
def op2(spark: SparkSession, root: str) -> DataFrame:
    return scan(table(spark, root, "documents"))


@query("op3_template_extract")
def op3(spark: SparkSession, root: str) -> DataFrame:
    return extract(table(spark, root, "pages"))


@query("op5_interpolated_lm")
def op5(spark: SparkSession, root: str) -> DataFrame:
    return score(table(spark, root, "documents"))


_HOST_RULES = r"""
with docs as (
  select row_number() over () as r, doc_id, coalesce(source, '') as host, coalesce(text, '') as t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l
  from documents),
places as (select r, unnest(range(1, len(w) - 1)) as p, w from docs where len(w) >= 3),
windows as (select r, p, count(*) over (partition by r, w[p], w[p + 1], w[p + 2]) as n from places),
covered as (select r, count(distinct q) as n from (select r, unnest([p, p + 1, p + 2]) as q from windows where n > 1) group by r),
m as (
  select d.doc_id, d.host, cast(len(d.w) as bigint) as n_words, cast(len(list_aggregate(list_concat([''], d.w), 'string_agg', '')) as bigint) as word_chars,
    cast(len(d.t) - len(regexp_replace(d.t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols, cast(len(d.l) as bigint) as n_lines,
    cast(len(d.l) - len(list_distinct(d.l)) as bigint) as n_dup_lines, cast(coalesce(c.n, 0) as bigint) as n_repeat_words
  from docs d left join covered c on c.r = d.r),
f as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
    n_words < 50 or 100 * n_repeat_words > 50 * n_words or n_symbols > 0.1 * n_words or n_dup_lines > 0.3 * n_lines as failed from m),
hosts as (select host, cast(count(*) as double) as n, cast(sum(case when failed then 1 else 0 end) as double) as k from f group by host),
moments as (select sum(k) / sum(n) as m, sum(k * k / n) / sum(n) - (sum(k) / sum(n)) * (sum(k) / sum(n)) as v from hosts),
prior as (select m, case when v > 0 and m * (1 - m) > v then m * (1 - m) / v - 1 else 20.0 end as s from moments),
verdicts as (select host, (k + m * s) / (n + s) > 0.5 as host_rejected from hosts, prior)
select f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_rejected, not base_failed and not host_rejected as kept
from f join verdicts v on v.host = f.host
"""


@query("op6_host_rules", _HOST_RULES)
def op6(spark: SparkSession, root: str) -> DataFrame:
    return judge(table(spark, root, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_rejected", "kept")


@query("op4_pii_surrogates")
def op4(spark: SparkSession, root: str) -> DataFrame:
    return replace_entities(table(spark, root, "documents"), count="n_entities").select("doc_id", "text", "n_entities")


@query("op7_nbest_pieces")
def op7(spark: SparkSession, root: str) -> DataFrame:
    return segment(table(spark, root, "documents"), vocabulary("piece_bpe_32k.model")).select("doc_id", "pieces", "n_pieces", "score", "scores", "changes", "exact")


@query("op8_language_id")
def op8(spark: SparkSession, root: str) -> DataFrame:
    return identify(table(spark, root, "documents")).select("doc_id", F.col("lang").alias("declared"), "language", "posterior", F.col("accepted").alias("kept"))


@query("languages_of_pages")
def languages_of_pages(spark: SparkSession, root: str) -> DataFrame:
    """The same evidence with all of its sources: text without its tags, the markup's language, the address suffix, the host."""
    pages = table(spark, root, "pages")
    text = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>", " ")
    found = identify(pages.select("page_id", "url", text.alias("text"), markup_language("html").alias("markup")), "markup", None, "url")
    return found.select("page_id", "url", "markup", "language", "posterior", F.col("accepted").alias("kept"))


@query("op9_decontamination", _CONTAINED)
def op9(spark: SparkSession, root: str) -> DataFrame:
    return contained_items(table(spark, root, "documents"), table(spark, root, "benchmark"))


@query("op10_token_shards")
def op10(spark: SparkSession, root: str) -> DataFrame:
    return round_trip(table(spark, root, "documents"), vocabulary("byte_bpe_50k.json"))


_CRC32 = """
crc_table as (select list(c order by i) as crc from (select i, list_reduce([cast(i as ubigint), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end) as c from range(256) t(i)))"""


def _crc32(value: str) -> str:
    """crc32 of the decimal text of an integer column, over crc_table."""
    codes = f"list_transform(string_split(cast({value} as varchar), ''), lambda x: cast(ascii(x) as ubigint))"
    return f"cast(xor(list_reduce(list_concat([4294967295::ubigint], {codes}), lambda c, b: xor(c >> 8, crc[cast(xor(c, b) & 255 as bigint) + 1])), 4294967295::ubigint) as bigint)"


_TRIE = f"""
with {_CRC32},
turns as (
  select conv_id as c, conv_id - conv_id % 100 as b, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as i, {{'r': coalesce(role, ''), 't': coalesce(text, '')}} as x
  from conversations where conv_id is not null),
own as (select c, any_value(b) as b, list(x order by i) as w from turns group by c),
sized as (select c, b, w, {_crc32("c")} % 6 as h from own, crc_table),
built as (select s.c, case when s.c = s.b then s.w else list_concat(coalesce(o.w[1 : s.h], []), s.w[s.h + 1 :]) end as w from sized s left join own o on o.c = s.b),
steps as (select c, len(w) as n, unnest(range(0, len(w) + 1)) as d, w from built),
paths as (select c, n, d, w[1 : d] as p, case when d = 0 then 0 else len(w[d].t) end as chars from steps),
nodes as (
  select p, d, min(c) as conv_id, count(*) as n_convs, any_value(chars) as chars, sum(case when n = d then 1 else 0 end) as n_ends, coalesce(string_agg(case when n = d then cast(c as varchar) end, ',' order by c), '') as ends
  from paths group by p, d),
above as (select p, d, p[1 : d - 1] as up, unnest(range(0, d + 1)) as k, n_convs, chars, n_ends from nodes),
sums as (
  select p[1 : k] as p, k as d, cast(sum(case when n_ends = n_convs then 1 else 0 end) as bigint) as n_leaves, cast(sum((n_convs - 1) * chars) as bigint) as saved_tokens, cast(sum(case when d = k + 1 then 1 else 0 end) as bigint) as n_children
  from above group by p[1 : k], k)
select n.conv_id, n.d as depth, u.conv_id as parent_conv_id, n.n_convs, s.n_children, s.n_leaves, s.saved_tokens, sha256(n.ends) as ends_sha256
from nodes n join sums s on s.d = n.d and s.p = n.p left join nodes u on u.d = n.d - 1 and u.p = n.p[1 : n.d - 1]"""


@query("op11_prefix_trie", _TRIE)
def op11(spark: SparkSession, root: str) -> DataFrame:
    return trie(table(spark, root, "conversations"))


_REPEATS = r"""
with w as (select row_number() over () as r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
windows as (select r, doc_id, p, array_to_string(w[p : p + 12], ' ') as s from (select r, doc_id, w, unnest(range(1, len(w) - 11)) as p from w where len(w) >= 13)),
firsts as (select s, min(doc_id) as first from windows group by s),
hits as (select r, p from windows join firsts using (s) where doc_id > first),
gone as (select r, list(distinct q) as g from (select r, unnest(range(p, p + 13)) as q from hits) group by r),
kept as (select doc_id, w, coalesce(g, []) as g from w left join gone using (r))
select doc_id, cast(len(w) as bigint) as n_words, cast(len(g) as bigint) as n_removed,
  sha256(coalesce(list_aggregate(list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: not list_contains(g, x[2])), lambda x: x[1]), 'string_agg', ' '), '')) as kept_sha256
from kept"""


@query("op12_substring_dedup", _REPEATS)
def op12(spark: SparkSession, root: str) -> DataFrame:
    return remove_repeats(table(spark, root, "documents"))


def _sql_field(value: str) -> str:
    return f"case when {value} is null then '-' else cast(octet_length(encode(cast({value} as varchar))) as varchar) || ':' || cast({value} as varchar) end"


_LEAF = " || ".join(_sql_field(c) for c in ("doc_id", "source", "lang", "{n}", "text"))
_MANIFEST = f"""
with recursive {_CRC32},
leaves as (
  select doc_id, coalesce('1' || lang, '0') as k, sha256({_LEAF.format(n="n_chars")}) as leaf,
    case when n_chars is not null and doc_id is not null and {_crc32("coalesce(doc_id, 0)")} % 7 = 0 then sha256({_LEAF.format(n="(n_chars + 1)")}) end as shown
  from documents, crc_table),
placed as (select *, row_number() over () as r, row_number() over (partition by k order by doc_id nulls first, leaf) - 1 as i from leaves),
up as (
  select k, 0 as l, i, leaf as d from placed
  union all
  select k, l + 1, i // 2, sha256(string_agg(d, '' order by i)) from (select *, count(*) over (partition by k) as c from up) where c > 1 group by k, l, i // 2),
heights as (select k, max(l) as h from up group by k),
subroots as (select u.k, u.d as subroot, h, row_number() over (order by u.k) - 1 as i from up u join heights x on x.k = u.k and x.h = u.l),
top as (
  select 0 as l, i, subroot as d from subroots
  union all
  select l + 1, i // 2, sha256(string_agg(d, '' order by i)) from (select *, count(*) over () as c from top) where c > 1 group by l, i // 2),
crown as (select d as root, l as th from top where l = (select max(l) from top)),
paths as (
  select r, l as step, xor(p.i >> l, 1) as j, k, false as of_top, (p.i >> l) & 1 as odd from (select p.r, p.i, p.k, unnest(range(0, s.h)) as l from placed p join subroots s on s.k = p.k) p
  union all
  select r, h + l, xor(i >> l, 1), null, true, (i >> l) & 1 from (select p.r, s.i, s.h, unnest(range(0, (select th from crown))) as l from placed p join subroots s on s.k = p.k)),
siblings as (
  select p.r, p.step, p.odd, coalesce(u.d, t.d) as d
  from paths p left join up u on not p.of_top and u.k = p.k and u.l = p.step and u.i = p.j
    left join (select t.l, t.i, t.d, s.r, s.h from top t, (select p.r, s.h from placed p join subroots s on s.k = p.k) s) t on p.of_top and t.r = p.r and t.l = p.step - t.h and t.i = p.j),
folds as (
  select r, 0 as step, coalesce(shown, leaf) as d from placed
  union all
  select f.r, f.step + 1, sha256(case when s.d is null then f.d when s.odd = 1 then s.d || f.d else f.d || s.d end) from folds f join siblings s on s.r = f.r and s.step = f.step),
folded as (select r, arg_max(d, step) as d from folds group by r),
proofs as (select r, string_agg(d, '' order by step) as s from siblings group by r)
select p.doc_id, p.leaf, s.subroot, c.root, sha256(coalesce(q.s, '')) as proof_sha256, f.d as folded_root, f.d = c.root as verified
from placed p join subroots s on s.k = p.k cross join crown c join folded f on f.r = p.r left join proofs q on q.r = p.r"""


@query("op13_merkle_manifest", _MANIFEST)
def op13(spark: SparkSession, root: str) -> DataFrame:
    return manifest(table(spark, root, "documents"))
