"""Registry tables made of the given tables: suppliers are models, parts are repositories, nations are languages.

Each is one SELECT that both engines can run (ARR( is their list, AT( an element of it, MAP1( their
map of one entry, {name} a given table), and is put below the rows of fixtures.py, which
hold the odd cases. They grow with the tables they come from.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators.shared import saved
from lexmill.plans import fixtures

LANGS = "en es fr de pt gl ca eu ru uk be zh ja az ast an oc nl it pl sv tr fi cs ro".split()


def _lang(number: str) -> str:
    """The language of a nation's number, which may be any integer from 0."""
    return "AT(ARR(" + ", ".join(f"'{c}'" for c in LANGS) + f"), cast(({number}) % {len(LANGS)} + 1 as int))"


def _pick(number: str, *values: str) -> str:
    return f"case ({number}) % {len(values)} " + " ".join(f"when {k} then {v}" for k, v in enumerate(values)) + " end"


_K, _A, _B, _C, _D = "s_suppkey", _lang("s_nationkey"), _lang("s_nationkey + 1 + s_suppkey % 24"), _lang("s_nationkey + 5"), _lang("s_nationkey + 11")
_P = "p_partkey"

SELECTS: dict[str, str] = {
    "models": f"""select 'sup-' || cast({_K} as string) as model_id, {_pick(_K, "'marian'", "'m2m100'", "'nllb'")} as arch, {_pick(_K, "'permissive'", "'share-alike'", "'non-commercial'", "'unknown'")} as license_tier,
        20 + {_K} * 7 % 1900 as size_mb, {_pick(_K, 'null', "'HiTZ'", 'null', "'Proxecto Nós'", "'Projecte AINA'")} as org, case when {_K} % 9 > 0 then cast(2015 + {_K} % 10 as string) || '-0' || cast(1 + {_K} % 9 as string) || '-1' || cast({_K} % 10 as string) end as release_date,
        {_pick(_K, "'int8'", "'fp32'", "'int8'")} as "precision", s_acctbal > 5000 as cached, s_acctbal > -500 as runnable,
        case when {_K} % 10 > 2 then ARR({_A}, {_B}) end as pair, case when {_K} % 10 = 0 then ARR({_A}, {_B}, {_C}, {_D}) end as languages, case when {_K} % 10 = 1 then ARR({_A}, {_C}) end as src_languages, case when {_K} % 10 = 1 then ARR({_B}, {_D}) end as tgt_languages,
        case when {_K} % 10 = 2 then ARR(ARR({_A}, {_B}), ARR({_B}, {_A}), ARR({_C}, {_D})) end as directions, case when {_K} % 4 > 0 then ({_K} * 37 % 300 + 300) / cast(10 as double) end as chrf, case when {_K} % 4 > 1 then 'flores' end as corpus, case when {_K} % 4 > 2 then 100 end as n, {_K} % 13 = 0 as flagged from {{supplier}}""",
    "barred": f"select 'sup-' || cast({_K} as string) as model_id, {_pick(_K, chr(39) + 'source' + chr(39), chr(39) + 'target' + chr(39), chr(39) + 'both' + chr(39))} as side, {_A} as lang from {{supplier}} where {_K} % 17 = 3",
    "requests": f"select 1000 + {_K} as req_id, {_A} as src, {_lang('s_nationkey + s_suppkey * 3')} as tgt from {{supplier}}",
    "regional_requests": f"select 1000 + {_K} as req_id, {_A} || {_pick(_K, chr(39) * 2, chr(39) + '-MX' + chr(39), chr(39) + '-419' + chr(39))} as src, {_B} || {_pick(_K, chr(39) + '-ES' + chr(39), chr(39) * 2)} as tgt from {{supplier}}",
    "flags": f"select 'sup-' || cast({_K} as string) as model_id, {_B} as lang, {_pick(_K, 'null', chr(39) + 'loops' + chr(39), chr(39) * 2)} as reason, {_pick(_K, 'null', chr(39) + 'both' + chr(39), chr(39) + 'source' + chr(39), chr(39) + 'target' + chr(39))} as side from {{supplier}} where {_K} % 3 = 1",
    "caps": f"select distinct 37 + 100 * ({_K} % 20) as cap_mb from {{supplier}}",
    "distances": f"select {_lang('a.n_nationkey')} as a, {_lang('b.n_nationkey')} as b, ((a.n_nationkey * 31 + b.n_nationkey * 17) % 89) / cast(89 as double) as d from {{nation}} a join {{nation}} b on a.n_nationkey < b.n_nationkey where (a.n_nationkey + b.n_nationkey) % 5 > 0",
    "given_routes": f"select 1000 + {_K} as route_id, {_A} as src, {_lang('s_nationkey + 1 + s_suppkey % 24 + s_suppkey % 3')} as tgt from {{supplier}}",
    "given_hops": f"""select 1000 + {_K} as route_id, 0 as pos, 'sup-' || cast({_K} as string) as model_id, {_A} as src, {_B} as tgt from {{supplier}} where {_K} % 11 > 0
        union all select 1000 + {_K}, 1, 'sup-' || cast({_K} + 1 as string), {_pick(_K, _B, _A)}, {_D} from {{supplier}} where {_K} % 5 = 1""",
    "pinned": f"select 1000 + {_K} as req_id, 'sup-' || cast({_K} + {_K} % 2 * 100000 * ({_K} % 3) as string) as model_id, {_pick(_K, _A, 'null', _C)} as src, {_pick(_K, _B, _B, 'null', _D)} as tgt from {{supplier}}",
    "entries": f"""select 'part-' || cast({_P} as string) as model_id, case when {_P} % 3 > 0 then 'm' || cast({_P} as string) || '.onnx' end as onnx_file, case when {_P} % 3 = 0 then MAP1('encoder', 'enc.onnx') end as graphs, case when {_P} % 4 > 0 then MAP1('vocab', {_pick(_P, "'vocab.txt'", "'../vocab.txt'", "'sub/vocab.txt'", "'/etc/vocab.txt'", "'C:vocab.txt'")}) end as side_files,
        case when {_P} % 5 = 0 then ARR('enc.onnx_data', 'a..b', 'x/../y') end as extra_files, {_P} * 13 % 12000 as size_mb from {{part}}""",
    "present": f"""select 'part-' || cast({_P} as string) as model_id, 'm' || cast({_P} as string) || '.onnx' as file, {_P} % 7 as size from {{part}} where {_P} % 3 > 0
        union all select 'part-' || cast({_P} as string), 'vocab.txt', 5 from {{part}} union all select 'part-' || cast({_P} as string), 'enc.onnx', 1 from {{part}} where {_P} % 2 = 0""",
    "old_fields": f"""select 'part-' || cast({_P} as string) as model_id, 'size_mb' as key, cast({_P} % 100 as string) as value from {{part}} where {_P} % 6 > 0
        union all select 'part-' || cast({_P} as string), 'notes', 'note ' || cast({_P} % 3 as string) from {{part}} where {_P} % 4 = 0 union all select 'part-' || cast({_P} as string), {_pick(_P, "'quality'", "'mirror'", "'language_flags'", "'arch'")}, 'old' from {{part}} where {_P} % 5 > 1""",
    "new_fields": f"""select 'part-' || cast({_P} as string) as model_id, 'size_mb' as key, cast({_P} % 90 as string) as value from {{part}} where {_P} % 7 > 0
        union all select 'part-' || cast({_P} as string), 'notes', 'note ' || cast({_P} % 2 as string) from {{part}} where {_P} % 3 = 0 union all select 'part-' || cast({_P} as string), {_pick(_P, "'quality'", "'arch'", "'extra'")}, 'new' from {{part}} where {_P} % 4 > 1""",
    "codes": f"select 'part-' || cast({_P} as string) as model_id, {_lang(_P)} as tag, '__' || {_lang(_P)} || '__' as native from {{part}} union all select 'part-' || cast({_P} as string), {_lang(_P + ' + ' + _P + ' % 3')}, '<' || {_lang(_P)} || '>' from {{part}}",
    "asked_codes": f"select 'part-' || cast({_P} as string) as model_id, {_lang(_P + ' + ' + _P + ' % 2')} as tag from {{part}}",
    "repos": f"select {_pick(_P, chr(39) + 'Helsinki-NLP/opus-mt-' + chr(39), chr(39) + 'HiTZ/mt-' + chr(39), chr(39) + 'proxectonos/Nos_' + chr(39), chr(39) + 'user/' + chr(39), chr(39) + 'Helsinki-NLP/opus-tatoeba-' + chr(39))} || cast({_P} as string) as repo from {{part}}",
    "hub": f"""select {_pick(_P, "'p/opus-mt-'", "'p/opus-mt-tc-big-'", "'p/other-'")} || {_lang(_P)} || '-' || {_lang(_P + ' + 3')} || {_pick(_P, "'-onnx'", "''", "'-v' || cast(p_partkey as string)")} as repo,
        {_pick(_P, "ARR('encoder_model.onnx', 'vocab.json')", "ARR('model.onnx', 'config.json', 'tokenizer.json')", "ARR('model.onnx', 'labels.json', 'x_hash.py')", "ARR('encoder_model.onnx', 'source.spm', 'target.spm', 'vocab.json')", "ARR('encoder_model.onnx', 'tokenizer.json')", "ARR('README.md')")} as files,
        {_pick(_P, "'marian'", "'t5'", "'umt5'", "'gemma'", "'pegasus'", "'mbart'", "'m2m_100'", 'null', "'IndicTrans'")} as model_type, case when {_P} % 5 = 0 then ARR('GemmaForCausalLM') when {_P} % 5 = 1 then ARR('T5Model') end as architectures, {_pick(_P, 'null', "'causal-lm'", "'t5-fast'", "'t5-prefix'", 'null', 'null', 'null')} as curated from {{part}}""",
    "pieces": f"select 'part-' || cast({_P} % 50 as string) as repo, {_pick(_P, chr(39) + '<2' + chr(39), chr(39) + '>>' + chr(39), chr(39) + '<' + chr(39))} || {_lang(_P)} || {_pick(_P, chr(39) + '>' + chr(39), chr(39) + '<<' + chr(39), chr(39) + '_x>' + chr(39))} as piece from {{part}}",
    "tags_list": f"""select 1000 + {_P} as id, {_pick(_P, "''", "'  '", "' '")} || {_pick(_P, _lang(_P), "upper(" + _lang(_P) + ")", _lang(_P) + " || '_Latn'", _lang(_P) + " || '-us'", _lang(_P) + " || '-Cyrl'", "'x' || cast(p_partkey as string)", _lang(_P) + " || '-LATN-es'")} as tag from {{part}}""",
    "token_maps": f"""select 'part-' || cast({_P} as string) as repo, {_pick(_P, "'{{\"pad_token\": \"<pad>\", \"eos_token\": {{\"content\": \"</s' || cast(p_partkey as string) || '>\"}}}}'", "'{{\"unk_token\": [\"x\"], \"eos_token\": \"e' || cast(p_partkey as string) || '\"}}'", "'not json'", 'null', "'{{}}'")} as content from {{part}}""",
    "cards": f"select 'part-' || cast({_P} as string) as repo, case when {_P} % 4 > 0 then ARR({_lang(_P)}, {_lang(_P + ' + 4')}) end as language, case when {_P} % 3 = 0 then ARR({_lang(_P + ' + 4')}, {_lang(_P + ' + 8')} || '-BR') end as language_bcp47 from {{part}}",
    "licences": f"""select 'part-' || cast({_P} as string) as repo, {_pick(_P, "'apache-2.0'", 'null', "'CC-BY-SA-4.0'", 'null', "'custom'")} as card, {_pick(_P, 'null', "'# Model' || chr(10) || 'License: CC-BY-NC-4.0'", "'none'", "'licence: MIT for part ' || cast(p_partkey as string)")} as readme from {{part}}""",
    "labels_list": f"""select 1000 + {_P} as label_idx, {_pick(_P, "'__label__'", "''")} || {_pick(_P, _lang(_P), _lang(_P) + " || '_Latn'", _lang(_P) + " || '_Cyrl'", "'q' || cast(p_partkey as string) || '_Latn'", "'nan_lang'")} as raw from {{part}}""",
    "broken_tree": "select s_suppkey % 41 as label_idx, s_suppkey * 7 % 37 as node, case when s_suppkey % 5 > 0 then s_suppkey % 2 = 1 end as bit from {supplier} where s_suppkey % 41 % 6 > 0",
    "node_scores": "select doc_id, node, (n_chars * (node + 3) % 101) / cast(101 as double) as score from {documents} cross join (select 0 as node union all select 1 as node) as nodes",
}
#: tables whose fixture rows would contradict those of the given tables
ALONE = frozenset(("broken_tree", "distances", "node_scores"))


def _columns(name: str) -> list[tuple[str, str]]:
    return [tuple(c.strip().split(" ", 1)) for c in re.split(r", (?=\w+ )", fixtures.TABLES[name][0])]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a DataFrame."""
    if name not in SELECTS:
        return fixtures.table(spark, name)
    sql = SELECTS[name].replace("AT(ARR(", "element_at(array(").replace("ARR(", "array(").replace("MAP1(", "map(").replace('"precision"', "`precision`")
    given = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"\{(\w+)\}", sql))}
    made = saved(spark.sql(sql, **given).select(*[F.col(c).cast(kind.strip()).alias(c) for c, kind in _columns(name)]))
    return made if name in ALONE else fixtures.table(spark, name).union(made)


def values_sql(*names: str) -> str:
    """WITH entries for DuckDB that hold the named tables."""
    out = []
    for name in names:
        fixed = fixtures.entry_sql(name)
        if name not in SELECTS:
            out.append(f"{name} AS ({fixed})")
            continue
        sql = re.sub(r"\{(\w+)\}", r"\1", SELECTS[name].replace("{{", "\x00").replace("}}", "\x01")).replace("\x00", "{").replace("\x01", "}")
        sql = sql.replace("MAP1(", "map_one(").replace("AT(ARR(", "list_extract(list_value(").replace("ARR(", "list_value(")
        sql = _maps(sql)
        made = "SELECT " + ", ".join(f'"{c}"::{fixtures.SQL_TYPES[kind.strip()]} AS "{c}"' for c, kind in _columns(name)) + f" FROM ({sql}) AS made"
        out.append(f"{name} AS ({made if name in ALONE else fixed + ' UNION ALL ' + made})")
    return "WITH RECURSIVE " + ",\n".join(out)


def _maps(sql: str) -> str:
    """map_one(k, v) as a map of lists of one, with balanced brackets."""
    while (at := sql.find("map_one(")) >= 0:
        depth, comma, end = 0, None, at + 8
        while depth or sql[end] != ")":
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            if sql[end] == "," and not depth and comma is None:
                comma = end
            end += 1
        sql = f"{sql[:at]}map([{sql[at + 8 : comma]}], [{sql[comma + 1 : end]}]){sql[end + 1 :]}"
    return sql
