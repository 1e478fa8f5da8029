"""Language identification as sums of packed weights.

The scorer is multinomial naive Bayes over hashed character trigrams. Training counts
trigrams per language; the model keeps, for each trigram id, what it adds for each language
over what an unseen one costs. A score is then a sparse row times that table (product.py),
plus a multiple of the text's length. Scores are whole micro-nats, so sums are exact in any
order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import ngrams
from lexmill.functions import text as T
from lexmill.operators import product
from lexmill.operators.shared import saved, small

BUCKETS = 1 << 16
UNIT = 1_000_000


def words_of(text: Column) -> Column:
    """White-space tokens of a whole text; the end token stays out."""
    return F.filter(F.split(text, f"[{T.TOKEN_BREAKS}]+"), lambda t: t != "")


def is_training(text: Column) -> Column:
    """Four texts in five, by a hash of the text, so copies stay on one side."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 2), 16, 10).cast("int") % 5 != 0


def train(docs: DataFrame, buckets: int = BUCKETS) -> tuple[DataFrame, DataFrame]:
    """(priors: lang, prior; model: lang, total) and (weights: lang, fid, w) from docs (doc_id, text, lang).

    All texts with visible content count whole: the guards are limits of a request, not of training.
    """
    seen = docs.where(T.has_visible_content(F.col("text")))
    counted = saved(ngrams.label_features(seen, F.col("lang"), F.col("text"), 3, 3, buckets).select(F.col("label").alias("lang"), F.col("id").alias("fid"), F.col("n").alias("c")))
    features = counted.where("fid is not null")
    totals = features.groupBy("lang").agg(F.sum("c").alias("total"))
    ok = counted.where("fid is null").select("lang", F.col("c").alias("n_docs"))
    every = F.sum("n_docs").over(Window.partitionBy())  # a row per language
    priors = ok.join(totals, "lang").select("lang", "n_docs", "total", F.round(F.log(F.col("n_docs") / every) * UNIT).cast("long").alias("prior"))
    return saved(priors), features


def packed(priors: DataFrame, features: DataFrame, buckets: int = BUCKETS) -> tuple[DataFrame, DataFrame]:
    """(langs: idx, lang, prior, floor) and (weights: id, block, vec): what a trigram id adds over floor, the cost of an unseen one, for each language."""
    cost = lambda c: F.round(F.log((c + 1) / (F.col("total") + buckets)) * UNIT).cast("long")
    idx = F.row_number().over(Window.orderBy("lang")) - 1  # a row per language
    langs = saved(priors.select(idx.alias("idx"), "lang", "prior", "total", cost(F.lit(0)).alias("floor")))
    gain = features.join(small(langs), "lang").select("fid", "idx", (cost(F.col("c")) - F.col("floor")).cast("double").alias("gain"))
    of_block = gain.groupBy(F.col("fid").alias("id"), F.floor(F.col("idx") / product.COLUMNS).cast("int").alias("block"))
    by_place = F.map_from_entries(F.collect_list(F.struct(F.col("idx") % product.COLUMNS, "gain")))  # COLUMNS at most
    weights = of_block.agg(by_place.alias("m")).select("id", "block", F.transform(F.sequence(F.lit(0), F.lit(product.COLUMNS - 1)), lambda k: F.coalesce(F.element_at("m", k), F.lit(0.0))).alias("vec"))
    return langs.drop("total"), saved(weights)


def scores(docs: DataFrame, langs: DataFrame, weights: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, lang, score (micro-nats) for every text that passes the guards and every language; rows of one doc_id count as one text."""
    read = docs.where(T.guard_status(F.col("text")) == "OK")
    n = langs.count()
    sums = product.text_sums(read, F.col("doc_id"), F.col("text"), 3, buckets, weights, n)
    each = sums.select(F.col("key").alias("doc_id"), "n", "block", F.posexplode("vec").alias("k", "gain")).withColumn("idx", F.col("block") * product.COLUMNS + F.col("k"))
    # a word has as many trigrams as characters, so n is the text's length
    return each.join(small(langs, n), "idx").select("doc_id", "lang", (F.col("n") * F.col("floor") + F.col("gain").cast("long") + F.col("prior")).alias("score"))


def with_refused(found: DataFrame, docs: DataFrame) -> DataFrame:
    """found (doc_id, ...) with status OK, and a row with the guards' status and nulls for each of docs that they turn away."""
    status = T.guard_status(F.col("text"))
    refused = docs.select("doc_id", status.alias("status")).where("status <> 'OK'")
    return found.withColumn("status", F.lit("OK")).unionByName(refused, allowMissingColumns=True)


def predict(scored: DataFrame) -> DataFrame:
    """doc_id, predicted, score: the best language, the first by name on a tie."""
    best = F.min(F.struct((-F.col("score")).alias("cost"), "lang"))
    return scored.groupBy("doc_id").agg(best.alias("b")).select("doc_id", F.col("b.lang").alias("predicted"), (-F.col("b.cost")).alias("score"))


def probabilities(scored: DataFrame) -> DataFrame:
    """doc_id, lang, p: softmax over the languages of a document."""
    w = Window.partitionBy("doc_id")
    e = F.exp((F.col("score") - F.max("score").over(w)) / UNIT)
    return scored.withColumn("e", e).withColumn("p", F.col("e") / F.sum("e").over(w)).select("doc_id", "lang", "p")


def top_k(probs: DataFrame, k: int, tag: Column | None = None) -> DataFrame:
    """doc_id, tag, p, rank: the k most likely labels, then the first of each tag, so possibly fewer than k."""
    cut = probs.withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("p"), "lang"))).where(F.col("r") <= k)
    cut = cut.withColumn("tag", F.col("lang") if tag is None else tag)
    first = F.row_number().over(Window.partitionBy("doc_id", "tag").orderBy("r"))
    return cut.withColumn("f", first).where("f = 1").select("doc_id", "tag", "p", F.col("r").alias("rank"))


def tree_faults(tree: DataFrame, n_labels: int) -> DataFrame:
    """fault, n of a tree (label_idx, node, bit): labels without a path, labels beyond n_labels, steps without a bit, nodes beyond n_labels - 2; none for a sound tree."""
    labels = tree.select("label_idx").distinct()
    rows = [
        labels.where(F.col("label_idx") < n_labels).agg((F.lit(n_labels) - F.count(F.lit(1))).alias("n")).select(F.lit("labels without a path").alias("fault"), "n"),
        labels.where(F.col("label_idx") >= n_labels).agg(F.count(F.lit(1)).alias("n")).select(F.lit("unknown labels").alias("fault"), "n"),
        tree.where("bit is null or node is null").agg(F.count(F.lit(1)).alias("n")).select(F.lit("steps without a branch").alias("fault"), "n"),
        tree.where(F.col("node") > n_labels - 2).agg(F.countDistinct("node").alias("n")).select(F.lit("unknown nodes").alias("fault"), "n"),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out.where("n > 0" if n_labels > 1 else "n > 0 and fault <> 'labels without a path'")


def word_features(words: DataFrame, vocabulary: DataFrame, nwords: int, buckets: int, minn: int = 2, maxn: int = 5) -> DataFrame:
    """token, known, ids of the distinct tokens of words (token): what a model with the vocabulary (word, word_id) reads for each.

    A known word is its id, then its n-grams; an unknown one its n-grams alone; the end
    token its id or nothing. Without n-grams (maxn 0) unknown words are nothing. Hashes are
    taken once per distinct n-gram.
    """
    told = words.select("token").distinct().join(vocabulary.select(F.col("word").alias("token"), "word_id"), "token", "left")
    own = F.when(F.col("word_id").isNotNull(), F.array(F.col("word_id").cast("long"))).otherwise(F.array().cast("array<bigint>"))
    if maxn <= 0:
        return told.select("token", F.col("word_id").isNotNull().alias("known"), own.alias("ids"))
    grams = told.where(F.col("token") != T.END_TOKEN).select("token", F.posexplode(T.subwords(F.col("token"), minn, maxn)).alias("pos", "g"))
    hashed = grams.select("g").distinct().withColumn("fid", F.lit(nwords) + T.fnv1a(F.col("g")) % buckets)
    lists = grams.join(hashed, "g").groupBy("token").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "fid"))), lambda x: x["fid"]).alias("subwords"))
    rest = F.coalesce("subwords", F.array().cast("array<bigint>"))
    return told.join(lists, "token", "left").select("token", F.col("word_id").isNotNull().alias("known"), F.concat(own, rest).alias("ids"))


def known_word_sums(docs: DataFrame, key: Column, text: Column, vocabulary: DataFrame, nwords: int, buckets: int, minn: int = 2, maxn: int = 5) -> DataFrame:
    """key, n_known, n_ids, id_sum over the ids that word_features gives for the words of each text; a text without words has no row.

    N-grams are hashed where the texts are; of the words only those of the vocabulary are
    exchanged, as sums per text.
    """
    bare = f"(?<![^{T.TOKEN_BREAKS}]){T.END_TOKEN}(?![^{T.TOKEN_BREAKS}])"  # the end token has no n-grams
    without = F.when(text.contains(T.END_TOKEN), F.regexp_replace(text, bare, "")).otherwise(text)
    grams = ngrams.feature_sums(docs, key, without, minn, maxn, buckets, nwords).select("key", "n", "total")
    words = docs.select(key.cast("long").alias("key"), F.explode(words_of(text)).alias("word"))
    hits = words.join(small(vocabulary.select("word", "word_id")), "word").groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.sum("word_id").alias("ids"))
    ends = docs.where(text.contains(T.END_TOKEN)).select(key.cast("long").alias("key"), F.explode(words_of(text)).alias("word")).where(F.col("word") == T.END_TOKEN).select("key").distinct()
    none = F.lit(0).cast("long")
    every = grams.select("key", none.alias("k"), "n", F.col("total").alias("s")).unionByName(hits.select("key", "k", F.col("k").alias("n"), F.col("ids").cast("long").alias("s"))).unionByName(ends.select("key", none.alias("k"), none.alias("n"), none.alias("s")))
    return every.groupBy("key").agg(F.sum("k").alias("n_known"), F.sum("n").alias("n_ids"), F.sum("s").alias("id_sum"))


def huffman_probabilities(nodes: DataFrame, tree: DataFrame) -> DataFrame:
    """doc_id, label_idx, p from node scores (doc_id, node, score) and the tree (label_idx, node, bit): product along each path."""
    step = F.log(F.greatest(F.when(F.col("bit"), F.col("score")).otherwise(1 - F.col("score")), F.lit(1e-12)))
    return nodes.join(tree, "node").groupBy("doc_id", "label_idx").agg(F.exp(F.sum(step)).alias("p"))
