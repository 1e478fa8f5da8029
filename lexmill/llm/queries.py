"""The opN queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.llm.packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), _tokenizer())


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.llm.substring_dedup import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents"), with_text=False).drop("kept_text")


def op3_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.llm.sharding import shard_table

    return shard_table(_table(spark, sf_dir, "documents"))


def op4_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.llm.mixing import mix_table

    return mix_table(_table(spark, sf_dir, "documents"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.llm.token_output import token_files

    return token_files(_table(spark, sf_dir, "documents"), _tokenizer())


def op6_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.llm.quality import quality_cascade

    out = quality_cascade(_table(spark, sf_dir, "documents"), counts=True)
    failed = "n_words < 10 or 100 * n_repeat_words > 20 * n_words"
    return out.selectExpr("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", f"{failed} as base_failed", "kept")


def op7_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.llm.ppm import language_scores

    return language_scores(_table(spark, sf_dir, "documents"))


def op8_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.llm.ann import nearest_neighbours

    return nearest_neighbours(_table(spark, sf_dir, "embeddings"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.llm.near_dedup import near_duplicate_groups

    return near_duplicate_groups(_table(spark, sf_dir, "documents"))


def op10_min_cut_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.llm.html_extract import extract_main_text

    return extract_main_text(_table(spark, sf_dir, "pages"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.llm.merkle import manifest_table

    return manifest_table(_table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.llm.fill_middle import fill_in_middle_table

    return fill_in_middle_table(_table(spark, sf_dir, "documents"))


def op13_best_fit_decreasing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.llm.windows import pack_windows

    return pack_windows(_table(spark, sf_dir, "documents"), _tokenizer())


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


_SPACES = "chr(9), ' '), chr(10), ' '), chr(11), ' '), chr(12), ' '), chr(13), ' ')"

#: The digest of op6 by unnested words, lines and windows.
_OP6 = f"""
with d as (
  select doc_id, coalesce(text, '') as t,
         list_filter(string_split({'replace(' * 5}coalesce(text, ''), {_SPACES}, ' '), lambda x: x <> '') as w
  from documents),
win as (
  select doc_id, i, row_number() over (partition by doc_id, g order by i) + 0 * i as k, count(*) over (partition by doc_id, g) as n
  from (select doc_id, i, list_slice(w, i, i + 4)::varchar[] as g from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from d where len(w) >= 5))),
rep as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + 5)) as p from win where n > 1) group by doc_id),
lin as (
  select doc_id, sum(n - 1)::bigint as dup, sum(n)::bigint as lines
  from (select doc_id, l, count(*) as n from (select doc_id, unnest(string_split(t, chr(10))) as l from d)
        where trim({'replace(' * 5}l, {_SPACES}) <> '' group by doc_id, l) group by doc_id),
m as (
  select d.doc_id, len(w)::bigint as n_words,
         coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
         coalesce(lin.dup, 0)::bigint as n_dup_lines, coalesce(lin.lines, 0) as n_lines,
         coalesce(rep.n, 0)::bigint as n_repeat_words,
         length(regexp_replace(t, '[^A-Z]', '', 'g')) as up, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) as letters,
         len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) as stutters
  from d left join lin using (doc_id) left join rep using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
       not (n_words < 10 or 100 * n_repeat_words > 20 * n_words or 100 * n_symbols > 30 * n_words or 100 * up > 50 * letters
            or 100 * n_dup_lines > 50 * n_lines or 100 * stutters > 30 * n_words or word_chars < 2 * n_words or word_chars > 25 * n_words) as kept
from m
"""


#: The Poisson quantile as a running sum of its terms; rates from shares that follow the square root of the rows.
_OP4 = """
with recursive n as (select source, count(*) as n from documents group by source),
rates as (select source, (pow(n::double, 0.5) / (select sum(pow(n::double, 0.5)) from n) * (select sum(n) from n) / n)::double as rate from n),
terms as (
  select source, rate, 0 as k, exp(-rate) as p, exp(-rate) as c from rates
  union all
  select source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) from terms where k < cast(ceil(rate + 12 * sqrt(rate)) as int) + 30),
keyed as (select doc_id, source, '23|' || coalesce(doc_id::varchar, '-') || '|' || md5(coalesce(text, '-')) as key from documents),
drawn as (select doc_id, source, key, ('0x' || substr(md5(key), 1, 13))::bigint / 4503599627370496.0 as u from keyed),
counted as (select d.doc_id, d.source, d.key, count(*)::bigint as copies from drawn d join terms t on d.source is not distinct from t.source and t.c <= d.u group by all),
copied as (select doc_id, source, copies, unnest(range(1, copies + 1)) as copy, key from counted),
keys as (select doc_id, source, copies, copy, md5(key || '|' || copy::varchar) as shuffle_key from copied)
select doc_id, source, copies, copy::bigint as copy, shuffle_key, row_number() over (order by shuffle_key, doc_id) - 1 as position from keys
"""


_WORDS = f"list_filter(string_split({'replace(' * 5}@, {_SPACES}, ' '), lambda x: x <> '')"

#: Op 2: the smallest document of every 13-word window, then the words that no larger document's window covers.
_OP2 = f"""
with d as (select doc_id, {_WORDS.replace('@', "coalesce(text, '')")} as w from documents),
win as (select doc_id, i, md5(array_to_string(w[i : i + 12], ' ')) as g from (select doc_id, w, unnest(range(1, len(w) - 11)) as i from d where len(w) >= 13)),
low as (select g, min(doc_id) as first from win group by g),
gone as (select distinct doc_id, unnest(range(i, i + 13)) as p from win join low using (g) where first < doc_id),
pos as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from d),
kept as (select pos.doc_id, string_agg(word, ' ' order by pos.p) filter (gone.p is null) as t, count(gone.p) as n from pos left join gone on gone.doc_id = pos.doc_id and gone.p = pos.p group by pos.doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n, 0)::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256 from d left join kept using (doc_id)
"""

#: Op 9: shingle sets, pairs that share one, links, and the smallest document reachable.
_OP9 = f"""
with recursive d as (select doc_id, {_WORDS.replace('@', "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as w from documents),
s as (
  select distinct doc_id, md5(array_to_string(w[i : i + 4], ' ')) as g from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from d where len(w) >= 5)
  union all select doc_id, md5('short ' || array_to_string(w, ' ')) from d where len(w) between 1 and 4),
n as (select doc_id, count(*) as n from s group by doc_id),
links as (
  select a.doc_id as a, b.doc_id as b from s a join s b on a.g = b.g and a.doc_id <> b.doc_id join n x on x.doc_id = a.doc_id join n y on y.doc_id = b.doc_id
  group by a.doc_id, b.doc_id having 100 * count(*) >= 85 * (any_value(x.n) + any_value(y.n) - count(*))),
reach as (select doc_id, doc_id as to_id from d union select r.doc_id, l.b from reach r join links l on l.a = r.to_id),
c as (select doc_id, min(to_id) as component_id from reach group by doc_id)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, component_id, d.doc_id = component_id as kept from d join c using (doc_id) left join n using (doc_id)
"""


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _crc32(text: str) -> str:
    """Bit by bit, of a text of one-byte characters."""
    byte = "list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({text}, ''), lambda y: ascii(y)::bigint)), lambda c, b: {byte}), 4294967295)"


def _trees(leaves: str, name: str) -> str:
    """All nodes of the trees over leaves (g, i, n, h): name (g, k, i, n, h)."""
    return f"""
{name} as (
  select g, 0 as k, i, n, h from {leaves}
  union all
  select g, k + 1, i // 8, (n + 7) // 8, sha256(string_agg(h, '' order by i)) from {name} where n > 1 group by g, k, i // 8, n)"""


#: Op 11: trees level by level, siblings by their coordinates, and every row folded step by step.
_OP11 = f"""
with recursive d as (select *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as lowered, coalesce('=' || lang, '') as g from documents),
tampered as (select *, coalesce({_crc32('doc_id::varchar')} % 3 = 0, false) as hit from d),
digests as (select doc_id, g, {_leaf('text')} as leaf, case when hit then {_leaf('lowered')} else {_leaf('text')} end as other from tampered),
rows as (select *, row_number() over () as r, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by g) as n from digests),
lower_leaves as (select g, i, n, leaf as h from rows),{_trees('lower_leaves', 'lower_tree')},
subroots as (select g, h from lower_tree where n = 1),
upper_leaves as (select 0 as g, row_number() over (order by g) - 1 as i, count(*) over () as n, h from subroots),{_trees('upper_leaves', 'upper_tree')},
tops as (select s.g, s.h, u.i, u.n from (select g, h, row_number() over (order by g) - 1 as i from subroots) s join upper_leaves u using (i)),
top as (select h as root from upper_tree where n = 1),
levels as (
  select r.r, t.k, string_agg(t.h, '' order by t.i) filter (t.i < r.i // (8 ** t.k)::bigint) as before, string_agg(t.h, '' order by t.i) filter (t.i > r.i // (8 ** t.k)::bigint) as after
  from rows r join lower_tree t on t.g = r.g and t.n > 1 and t.i // 8 = (r.i // (8 ** t.k)::bigint) // 8 group by r.r, t.k
  union all
  select r.r, 100 + t.k, string_agg(t.h, '' order by t.i) filter (t.i < p.i // (8 ** t.k)::bigint), string_agg(t.h, '' order by t.i) filter (t.i > p.i // (8 ** t.k)::bigint)
  from rows r join tops p using (g) join upper_tree t on t.n > 1 and t.i // 8 = (p.i // (8 ** t.k)::bigint) // 8 group by r.r, t.k),
steps as (select *, row_number() over (partition by r order by k) as step from levels),
folded as (
  select r, 0 as step, other as h from rows
  union all
  select f.r, f.step + 1, sha256(coalesce(s.before, '') || f.h || coalesce(s.after, '')) from folded f join steps s on s.r = f.r and s.step = f.step + 1),
ends as (select r, arg_max(h, step) as folded_root from folded group by r),
proofs as (select r, sha256(string_agg(coalesce(before, '') || coalesce(after, ''), '' order by step)) as p from steps group by r)
select doc_id, leaf, tops.h as subroot, root, coalesce(p, sha256('')) as proof_sha256, folded_root, folded_root = root as verified
from rows join tops using (g) cross join top join ends using (r) left join proofs using (r)
"""

#: Op 12: cuts by code points; what is restored is cut from the output at its marks.
_OP12 = """
with d as (select doc_id, coalesce(text, '') as t, length(coalesce(text, '')) as n, sha256('1:' || coalesce(doc_id::varchar, '-')) as h from documents),
draws as (select *, ('0x' || substr(h, 1, 8))::bigint as h1, ('0x' || substr(h, 9, 8))::bigint as h2, ('0x' || substr(h, 17, 8))::bigint as h3, ('0x' || substr(h, 25, 8))::bigint as h4 from d),
cuts as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
         case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from draws),
made as (
  select *, case form when 'plain' then t when 'psm' then '<P>' || substring(t, 1, a) || '<S>' || substring(t, b + 1) || '<M>' || substring(t, a + 1, b - a)
            else '<S>' || substring(t, b + 1) || '<P>' || substring(t, 1, a) || '<M>' || substring(t, a + 1, b - a) end as o from cuts),
marks as (select *, strpos(o, '<P>') as p, strpos(o, '<S>') as s, strpos(o, '<M>') as m from made)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars, sha256(o) as output_sha256,
       sha256(case form when 'plain' then o when 'psm' then substring(o, 4, s - 4) || substring(o, m + 3) || substring(o, s + 3, m - s - 3)
              else substring(o, p + 3, m - p - 3) || substring(o, m + 3) || substring(o, 4, p - 4) end) as restored_sha256
from marks
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_merkle_manifest": _OP11, "op12_fill_in_middle": _OP12, "op2_substring_dedup": _OP2, "op9_minhash_near_dedup": _OP9, "op4_poisson_mixing": _OP4, "op6_quality_cascade": _OP6}
