"""Queries of scoring, literals, lines, routes and gates over the given tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import ngrams
from lexmill.functions import text as T
from lexmill.operators import beam, detect, gates, limits, lines, literals, product, tree_softmax
from lexmill.operators.shared import saved
from lexmill.plans.common import FNV, GRAMS, SEEN, TOKENS, at, query, read
from lexmill.sources import entries

# --- scoring with given weights --------------------------------------------------------------

WIDTH, BUCKETS = 24, 1 << 16
_LABEL = "coalesce(lang, '') || '/' || coalesce(source, '')"
_SEEDED = "((@0 * 7919 + d * 104729 + @1) * 2654435761 % 4294967296) / 2147483648 - 1"


def _weights(spark) -> DataFrame:
    return spark.range(BUCKETS).select("id", product.seeded(F.col("id"), WIDTH, 11).alias("vec"))


def _hidden(docs: DataFrame) -> DataFrame:
    """key, hidden: means of seeded weights over the trigrams of each text."""
    weights = product.in_blocks(_weights(docs.sparkSession), WIDTH)
    return product.means_of(product.text_sums(docs, F.col("doc_id"), F.col("text"), 3, BUCKETS, weights, WIDTH), WIDTH)


@query(
    f"""with t as (select doc_id, unnest({at(TOKENS, 'text')}) as token from documents), w as (select distinct token, '<' || token || '>' as w from t),
    g as (select token, unnest(list_transform(range(1, length(w) - 1), lambda i: substr(w, i::int, 3))) as g from w), h as (select g, {at(FNV, 'g')} % 65536 as fid from (select distinct g from g)),
    f as (select doc_id, fid, count(*)::double as n from t join g using (token) join h using (g) group by all), dims as (select unnest(range({WIDTH})) as d),
    e as (select fid, d, {at(_SEEDED, 'fid', 11)} as v from (select distinct fid from f) cross join dims),
    hidden as (select doc_id, d, sum(n * v) / sum(n) as x from f join e using (fid) group by doc_id, d),
    l as (select label, d, {at(_SEEDED, "('0x' || substr(md5(label), 1, 4))::bigint", 29)} as v from (select distinct {_LABEL} as label from documents) cross join dims),
    z as (select doc_id, label, sum(x * v) as z from hidden join l using (d) group by doc_id, label),
    p as (select doc_id, label, exp(z - max(z) over (partition by doc_id)) as e from z),
    r as (select doc_id, label, e / sum(e) over (partition by doc_id) as p, row_number() over (partition by doc_id order by e desc, label) as rank from p)
    select doc_id, label, round(p, 6) as p, rank from r where rank <= 3"""
)
def embedding_softmax(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    label = F.concat(F.coalesce("lang", F.lit("")), F.lit("/"), F.coalesce("source", F.lit("")))
    index = F.conv(F.substring(F.md5(F.col("label").cast("binary")), 1, 4), 16, 10).cast("long")
    outputs = docs.select(label.alias("label")).distinct().select("label", product.seeded(index, WIDTH, 29).alias("vec"))
    best = product.softmax_top(_hidden(docs), outputs, WIDTH, 3, docs.count())
    return best.select(F.col("key").alias("doc_id"), "label", F.round("p", 6).alias("p"), F.col("rank").cast("long").alias("rank"))


@query()
def tree_softmax_scores(spark, sf_dir):
    """Languages and sources of held-out documents by a tree over their counts, fitted on the others."""
    docs = read(spark, sf_dir, "documents").withColumn("label", F.concat(F.coalesce("lang", F.lit("")), F.lit("/"), F.coalesce("source", F.lit(""))))
    training = F.coalesce(detect.is_training(F.col("text")), F.lit(False))
    return tree_softmax.held_out_scores(docs.withColumn("training", training), saved(_hidden(docs)), WIDTH)


# --- literals and lines ----------------------------------------------------------------------

@query()
def literal_split(spark, sf_dir):
    """All words of the benchmark and pairs of neighbours, found in whole documents, the longest at each place."""
    words = read(spark, sf_dir, "benchmark").select(detect.words_of(F.col("text")).alias("w"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat_ws(" ", F.element_at("w", i), F.element_at("w", i + 1)))
    phrases = words.select(F.explode(F.concat("w", F.when(F.size("w") > 1, pairs).otherwise(F.array().cast("array<string>")))).alias("literal")).distinct()
    numbered = phrases.withColumn("id", F.xxhash64("literal"))  # ids as a table might bring them
    pieces = literals.split_at_literals(read(spark, sf_dir, "documents").select("doc_id", "text"), numbered)
    hits = F.filter("pieces", lambda p: p["id"].isNotNull())
    rest = F.array_join(F.transform("pieces", lambda p: F.when(p["id"].isNotNull(), "\x01").otherwise(p["piece"])), "")
    md5 = lambda c: F.md5(c.cast("binary"))
    return pieces.select("doc_id", F.size(hits).cast("long").alias("n"), md5(F.array_join(F.transform(hits, lambda p: p["piece"]), "|")).alias("matched"), md5(rest).alias("rest"))


@query(
    f"""with l as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as pos from documents)
    select doc_id, count(*)::bigint as n_lines, md5(string_agg(case when {at(SEEN, 'line')} then regexp_replace(trim(replace(line, 'e', '3')), ' +', ' ', 'g') || '.' else line end, chr(10) order by pos)) as h from l group by doc_id"""
)
def line_rules(spark, sf_dir):
    """A rule applied to the visible lines of all documents, texts put together again."""
    rule = lines.in_place(lambda c: F.concat(F.regexp_replace(F.trim(F.replace(c, F.lit("e"), F.lit("3"))), " +", " "), F.lit(".")))
    mapped = lines.map_lines(read(spark, sf_dir, "documents").select("doc_id", "text"), rule)
    return mapped.where("text is not null").select("doc_id", F.size(F.split("mapped", "\n", -1)).cast("long").alias("n_lines"), F.md5(F.col("mapped").cast("binary")).alias("h"))


# --- limits on routes ------------------------------------------------------------------------

CAP, HOPS = 30, 2
LIMITS = {1: "size", 2: "absent", 4: "source", 8: "target", 16: "hops"}

#: Lines of an order follow each other; each step from a part to the next is an edge, and each customer asks for a way from their first part to their last.
_EDGES = """lines as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_linestatus, l_returnflag,
      lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_linestatus, l_returnflag) as nxt from lineitem),
    edges as (select l_partkey as src, nxt as tgt, l_suppkey as model, l_quantity as size,
      (l_quantity > 30)::int + 2 * (l_linestatus <> 'F')::int + 4 * (l_returnflag = 'A')::int + 8 * (l_returnflag = 'R')::int as mask from lines where nxt is not null),
    asked as (select o_custkey as req_id, arg_min(l_partkey, k) as src, arg_max(l_partkey, k) as tgt
      from (select o_custkey, l_partkey, row(o_orderdate, o_orderkey, l_linenumber, l_partkey) as k from orders join lineitem on l_orderkey = o_orderkey) group by o_custkey)"""


def part_edges(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(edges: src, tgt, model, size, mask; requests: req_id, src, tgt)."""
    items = read(spark, sf_dir, "lineitem")
    after = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_linestatus", "l_returnflag")
    bit = lambda c, n: F.when(c, n).otherwise(0)
    mask = bit(F.col("l_quantity") > CAP, 1) + bit(F.col("l_linestatus") != "F", 2) + bit(F.col("l_returnflag") == "A", 4) + bit(F.col("l_returnflag") == "R", 8)
    edges = items.select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(after).alias("tgt"), F.col("l_suppkey").alias("model"), F.col("l_quantity").alias("size"), mask.alias("mask")).where("tgt is not null")
    key = F.struct("o_orderdate", "o_orderkey", "l_linenumber", "l_partkey")
    bought = read(spark, sf_dir, "orders").join(items, F.col("l_orderkey") == F.col("o_orderkey"))
    return edges, bought.groupBy(F.col("o_custkey").alias("req_id")).agg(F.min_by("l_partkey", key).alias("src"), F.max_by("l_partkey", key).alias("tgt"))


_NAMED = " || ".join(f"case when m & {b} <> 0 then '{n}+' else '' end" for b, n in LIMITS.items())


@query(
    f"""with {_EDGES}, e as (select distinct src, tgt, mask from edges),
    p1 as (select distinct req_id, asked.tgt as goal, e.tgt as node, mask from asked join e using (src)),
    p2 as (select distinct req_id, goal, e.tgt as node, p1.mask | e.mask as mask from p1 join e on e.src = p1.node),
    p3 as (select distinct req_id, (p2.mask | e.mask | 16) as mask from p2 join e on e.src = p2.node and e.tgt = goal),
    hit as (select req_id, mask as m from p1 where node = goal union select req_id, mask from p2 where node = goal union select req_id, mask from p3),
    least as (select * from hit where not exists (select 1 from hit h where h.req_id = hit.req_id and h.m <> hit.m and h.m & hit.m = h.m))
    select req_id, coalesce(bool_or(m = 0), false) as served, count(m)::bigint as n_sets, coalesce(string_agg(rtrim({_NAMED}, '+'), '|' order by m), '') as causes from asked left join least using (req_id) group by req_id"""
)
def limit_causes(spark, sf_dir):
    edges, asked = part_edges(spark, sf_dir)
    sets = limits.limit_sets(edges, asked, HOPS, 16)
    return sets.select("req_id", F.array_contains("masks", 0).alias("served"), F.size("masks").cast("long").alias("n_sets"), limits.named(F.col("masks"), LIMITS).alias("causes"))


@query(
    f"""with {_EDGES}, e as (select src, tgt, min(size) as size, arg_min(model, row(size, model)) as model from edges group by src, tgt),
    p1 as (select req_id, e.tgt as node, min(size) as b from asked join e using (src) group by req_id, e.tgt),
    p2 as (select req_id, e.tgt as node, min(greatest(b, size)) as b from p1 join e on e.src = node group by req_id, e.tgt),
    p3 as (select p2.req_id, asked.tgt as node, min(greatest(b, size)) as b from p2 join asked using (req_id) join e on e.src = node and e.tgt = asked.tgt group by p2.req_id, asked.tgt),
    step as (select req_id, src, tgt, min(b) as step from asked join (select * from p1 union all select * from p2 union all select * from p3) p using (req_id) where node = tgt group by all),
    q1 as (select req_id, step.tgt as goal, step, e.tgt as node, [step.src, e.tgt] as nodes, [model] as models from step join e on e.src = step.src and size <= step),
    q2 as (select req_id, goal, step, e.tgt as node, min(list_append(nodes, e.tgt)) as nodes, arg_min(list_append(models, model), list_append(nodes, e.tgt)) as models from q1 join e on e.src = node and size <= step group by all),
    q3 as (select req_id, goal, step, e.tgt as node, min(list_append(nodes, e.tgt)) as nodes, arg_min(list_append(models, model), list_append(nodes, e.tgt)) as models from q2 join e on e.src = node and e.tgt = goal and size <= step group by all),
    found as (select req_id, step, arg_min(nodes, len(nodes)) as nodes, arg_min(models, len(nodes)) as models from (select * from q1 union all select * from q2 union all select * from q3) where node = goal group by all)
    select req_id, step, (len(nodes) - 1)::bigint as hops, array_to_string(nodes, '>') as route, array_to_string(models, '>') as models from asked left join found using (req_id)"""
)
def escalated_routes(spark, sf_dir):
    edges, asked = part_edges(spark, sf_dir)
    found = limits.bottleneck_routes(edges, asked, HOPS + 1)
    return found.select("req_id", "step", F.col("hops").cast("long").alias("hops"), F.array_join("nodes", ">").alias("route"), F.array_join("models", ">").alias("models"))


# --- gates -----------------------------------------------------------------------------------

_RULES = f"""d as (select documents.*, not {at(SEEN, 'text')} as invisible, length(text) > 10000 as "long", coalesce(toxic, 0) = 1 as toxic_label, lang is null or source is null as unnamed
      from documents left join (select doc_id, max(toxic) as toxic from labels group by doc_id) l using (doc_id)),
    g as (select doc_id, list_filter([case when invisible then 'invisible' end, case when "long" then 'long' end, case when toxic_label then 'toxic' end, case when unnamed then 'unnamed' end], lambda x: x is not null) as reasons from d)"""


def _gated(spark, sf_dir):
    toxic = read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    docs = read(spark, sf_dir, "documents").join(toxic, "doc_id", "left")
    return gates.gate(docs, {"invisible": ~T.has_visible_content(F.col("text")), "long": F.length("text") > T.MAX_CHARS, "toxic": F.col("toxic") == 1, "unnamed": F.col("lang").isNull() | F.col("source").isNull()})


@query(f"with {_RULES} select doc_id, len(reasons) = 0 as kept, array_to_string(reasons, '+') as reasons from g")
def document_gates(spark, sf_dir):
    found = _gated(spark, sf_dir)
    kept = found.kept.select("doc_id", F.lit(True).alias("kept"), F.lit("").alias("reasons"))
    return kept.union(found.quarantined.select("doc_id", F.lit(False), F.array_join("reasons", "+")))


@query(f"with {_RULES} select unnest(['rows', 'kept', 'invisible', 'long', 'toxic', 'unnamed']) as what, unnest([count(*), count(*) filter (len(reasons) = 0), count(*) filter (list_contains(reasons, 'invisible')), count(*) filter (list_contains(reasons, 'long')), count(*) filter (list_contains(reasons, 'toxic')), count(*) filter (list_contains(reasons, 'unnamed'))])::bigint as n from g")
def gate_counts(spark, sf_dir):
    return spark.createDataFrame(list(_gated(spark, sf_dir).counts.items()), "what string, n long")


# --- entries of many shapes ------------------------------------------------------------------

#: Each supplier is an entry that names the nations of its customers in one of five shapes.
_ENTRIES = """served as (select distinct l_suppkey as s, n_name as lang from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey),
    listed as (select s, list(lang order by lang) as l from served group by s),
    entries as (select s, case s % 5
      when 0 then json_object('model_id', 'm' || s, 'languages', l, 'size_mb', s)
      when 1 then json_object('model_id', 'm' || s, 'languages', array_to_string(l, ' '), 'size_mb', s::varchar)
      when 2 then json_object('model_id', 'm' || s, 'pair', [l[1], l[-1]], 'languages', null, 'size_mb', s + 0.5)
      when 3 then json_object('model_id', 'm' || s, 'src_languages', l, 'tgt_languages', l[1:3])
      else json_object('model_id', 'm' || s, 'coverage', json_object('src', l, 'tgt', null), 'languages', l[1:2], 'size_mb', 'unknown') end::json as j from listed)"""


def _entries(spark, sf_dir) -> DataFrame:
    served = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    listed = served.groupBy(F.col("l_suppkey").alias("s")).agg(F.array_sort(F.collect_set("n_name")).alias("l"))  # nations
    name, s, l = F.concat(F.lit("m"), F.col("s").cast("string")).alias("model_id"), F.col("s"), F.col("l")
    json = lambda *fields: F.to_json(F.struct(name, *fields), {"ignoreNullFields": "false"})
    nothing = F.lit(None).cast("string")
    shape = (
        F.when(s % 5 == 0, json(l.alias("languages"), s.alias("size_mb")))
        .when(s % 5 == 1, json(F.array_join(l, " ").alias("languages"), s.cast("string").alias("size_mb")))
        .when(s % 5 == 2, json(F.array(F.element_at(l, 1), F.element_at(l, -1)).alias("pair"), nothing.alias("languages"), (s + F.lit(0.5)).alias("size_mb")))
        .when(s % 5 == 3, json(l.alias("src_languages"), F.slice(l, 1, 3).alias("tgt_languages")))
        .otherwise(json(F.struct(l.alias("src"), nothing.alias("tgt")).alias("coverage"), F.slice(l, 1, 2).alias("languages"), F.lit("unknown").alias("size_mb")))
    )
    return entries.parsed(listed.select("s", shape.alias("json")))


_STRINGS = "case json_type(j, '@0') when 'ARRAY' then list_filter(json_extract_string(j, '@0[*]'), lambda x: x is not null) when 'VARCHAR' then string_split(json_extract_string(j, '@0'), ' ') end"


@query(
    f"""with {_ENTRIES}, sides as (select j, 'source' as side, coalesce(case when len({at(_STRINGS, '$.pair')}) = 2 then [json_extract_string(j, '$.pair[0]')] end, {at(_STRINGS, '$.src_languages')}, {at(_STRINGS, '$.coverage.src')}, {at(_STRINGS, '$.languages')}) as l from entries
    union all select j, 'target', coalesce(case when len({at(_STRINGS, '$.pair')}) = 2 then [json_extract_string(j, '$.pair[1]')] end, {at(_STRINGS, '$.tgt_languages')}, {at(_STRINGS, '$.coverage.tgt')}, {at(_STRINGS, '$.languages')}) from entries)
    select distinct json_extract_string(j, '$.model_id') as model_id, side, unnest(l) as lang from sides"""
)
def entry_coverage(spark, sf_dir):
    return entries.coverage(_entries(spark, sf_dir))


@query(f"with {_ENTRIES} select json_extract_string(j, '$.model_id') as model_id, try_cast(json_extract_string(j, '$.size_mb') as double) as size_mb from entries")
def entry_sizes(spark, sf_dir):
    return _entries(spark, sf_dir).select(F.try_variant_get("v", "$.model_id", "string").alias("model_id"), entries.number("$.size_mb").alias("size_mb"))


@query(
    f"""with {_ENTRIES}, f as (select unnest(json_keys(j)) as key, j from entries)
    select key, case json_type(j, '$.' || key) when 'ARRAY' then 'list' when 'OBJECT' then 'object' when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'NULL' then 'null' else 'number' end as kind, count(*)::bigint as n from f group by all"""
)
def entry_shapes(spark, sf_dir):
    return entries.shapes(_entries(spark, sf_dir))


# --- ordered features ------------------------------------------------------------------------


@query(
    f"""with t as (select doc_id, {at(TOKENS, 'text')} as w from documents),
    each as (select doc_id, generate_subscripts(w, 1) as i, unnest(w) as token from t), d as (select distinct token, '<' || token || '>' as b from each),
    g as (select token, unnest({at(GRAMS, 'b', 2, 5)}) as g, generate_subscripts({at(GRAMS, 'b', 2, 5)}, 1) as j from d), h as (select g, {at(FNV, 'g')} % 65536 as fid from (select distinct g from g)),
    ids as (select token, list(fid order by j) as ids from g join h using (g) group by token)
    select doc_id, sum(len(ids))::bigint as n_ids, md5(string_agg(array_to_string(ids, ' '), ' ' order by i)) as h from each join ids using (token) group by doc_id"""
)
def ordered_feature_ids(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    again = saved(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("again")))
    if again.isEmpty():
        return ngrams.ordered_digests(docs, F.col("doc_id"), F.col("text"), 2, 5, BUCKETS).withColumnRenamed("key", "doc_id")
    # rows that share a doc_id have one digest, and are exchanged
    same = F.col("doc_id").eqNullSafe(F.col("again"))
    alone = ngrams.ordered_digests(docs.join(again, same, "left_anti"), F.col("doc_id"), F.col("text"), 2, 5, BUCKETS).withColumnRenamed("key", "doc_id")
    slices = ngrams.ordered_features(docs.join(again, same, "left_semi"), F.col("doc_id"), F.col("text"), 2, 5, BUCKETS)
    whole = slices.groupBy("key").agg(F.sum(F.size("ids")).cast("long").alias("n_ids"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", F.array_join("ids", " ").alias("t")))), lambda s: s["t"]), " ").alias("t"))
    return alone.unionByName(whole.select(F.col("key").alias("doc_id"), "n_ids", F.md5(F.col("t").cast("binary")).alias("h")))


# --- beams -----------------------------------------------------------------------------------

BEAMS, STEPS = 4, 5


@query(
    f"""with recursive w as (select {at(TOKENS, 'text')} as w from documents), p as (select unnest(w) as prev, unnest(list_append(w[2:], '</s>')) as nxt from w),
    c as (select prev, nxt, count(*) as c from p group by all), r as (select *, sum(c) over (partition by prev) as every, row_number() over (partition by prev order by c desc, nxt) as r from c),
    s as (select prev, nxt, round(-ln(c / every) * 1000000)::bigint as lp from r where r <= {BEAMS}),
    b as (
      select 0 as step, item_id as row_id, [({at(TOKENS, 'text')})[1]] as tokens, ({at(TOKENS, 'text')})[1] as last, 0::bigint as cost from benchmark where len({at(TOKENS, 'text')}) > 0
      union all
      select step, row_id, tokens, last, cost from (
        select b.step + 1 as step, row_id, case when last = '</s>' then tokens else list_append(tokens, nxt) end as tokens, case when last = '</s>' then last else nxt end as last, cost + coalesce(lp, 0) as cost,
               row_number() over (partition by row_id order by cost + coalesce(lp, 0), case when last = '</s>' then tokens else list_append(tokens, nxt) end) as k
        from b left join s on s.prev = b.last where b.step < {STEPS} and (nxt is not null or last = '</s>')) where k <= {BEAMS})
    select row_id, array_to_string(tokens, ' ') as tokens, cost, row_number() over (partition by row_id order by cost, tokens) as rank from b where step = {STEPS}"""
)
def beam_words(spark, sf_dir):
    """The likeliest continuations of each benchmark item's first word, by the neighbours of words in all documents."""
    pairs = read(spark, sf_dir, "documents").select(F.explode(beam.word_pairs(F.col("text"), "</s>")).alias("p")).select(F.col("p.prev").alias("prev"), F.col("p.next").alias("next"))
    starts = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("row_id"), F.get(detect.words_of(F.col("text")), F.lit(0)).alias("token"))
    found = beam.beam_search(starts, beam.successors(pairs, BEAMS), BEAMS, STEPS, "</s>")
    return found.select("row_id", F.array_join("tokens", " ").alias("tokens"), "cost", F.col("rank").cast("long").alias("rank"))
