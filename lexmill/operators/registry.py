"""Registry work: files an entry needs, what is missing, budgets, merging without losing curated fields.

entries: model_id, onnx_file, graphs (map), side_files (map), extra_files (array), size_mb and
others. Wide registries are merged in long form (model_id, key, value).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def needed_files(entries: DataFrame) -> DataFrame:
    """model_id, pos, key, file in the order graph file, graphs, side files, extra files; maps by key."""
    pair = lambda k, v: F.struct(k.alias("key"), v.alias("file"))
    in_map = lambda c: F.transform(F.array_sort(F.map_entries(F.coalesce(c, F.create_map().cast("map<string,string>")))), lambda e: pair(e["key"], e["value"]))
    one = F.when(F.col("onnx_file").isNotNull(), F.array(pair(F.lit("onnx_file"), F.col("onnx_file")))).otherwise(F.array().cast("array<struct<key:string,file:string>>"))
    extra = F.transform(F.coalesce("extra_files", F.array().cast("array<string>")), lambda f: pair(f, f))
    files = F.concat(one, in_map(F.col("graphs")), in_map(F.col("side_files")), extra)
    return entries.select("model_id", F.posexplode(files).alias("pos", "f")).select("model_id", "pos", "f.key", "f.file")


def unsafe_path(path: Column) -> Column:
    """Whether a file name leaves its folder: absolute, with a drive, or with a step up."""
    return path.startswith("/") | path.startswith("\\") | path.rlike("^[A-Za-z]:") | F.array_contains(F.split(path, "[/\\\\]"), "..") | (path == "")


def missing_files(entries: DataFrame, present: DataFrame) -> DataFrame:
    """model_id, file for needed files that present (model_id, file, size) lacks or holds empty."""
    have = present.where("size > 0").select("model_id", "file")
    return needed_files(entries).select("model_id", "file").distinct().join(have, ["model_id", "file"], "left_anti")


def cached_models(entries: DataFrame, present: DataFrame) -> DataFrame:
    """model_id, cached: whether nothing it needs is missing."""
    lack = missing_files(entries, present).groupBy("model_id").agg(F.count(F.lit(1)).alias("lack"))
    return entries.join(lack, "model_id", "left").select("model_id", F.col("lack").isNull().alias("cached"))


def over_download_budget(entries: DataFrame, present: DataFrame, budget_mb: int | None) -> DataFrame:
    """model_id, refused: something is missing and the whole model is larger than the budget; no budget or one of 0 refuses nothing."""
    over = F.lit(False) if budget_mb is None or budget_mb <= 0 else F.coalesce(F.col("size_mb") > budget_mb, F.lit(False))
    return entries.join(cached_models(entries, present), "model_id").select("model_id", (~F.col("cached") & over).alias("refused"))


def checksums(files: DataFrame) -> DataFrame:
    """path, sha256 of a binaryFile table."""
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def memory_plan(models: DataFrame, concurrency: int) -> DataFrame:
    """loaded_mb, largest_mb, peak_mb of models held together: 86 + 1.84 * (loaded + concurrency * largest)."""
    return models.agg(F.sum("size_mb").alias("loaded_mb"), F.max("size_mb").alias("largest_mb")).select("*", F.round(86 + 1.84 * (F.col("loaded_mb") + concurrency * F.col("largest_mb")), 2).alias("peak_mb"))


#: Fields that people write; a generated value never replaces them.
HUMAN = ("notes", "quality", "language_flags")


def merge(existing: DataFrame, generated: DataFrame, generated_keys: list[str]) -> DataFrame:
    """model_id, key, value, overruled from long tables (model_id, key, value).

    For models that are generated: generated keys are taken, and go if they aren't generated
    any more; human keys keep the existing value, overruled tells where a generated one
    differed; other existing keys stay. Models that aren't generated go.
    """
    models = generated.select("model_id").distinct()
    old = existing.join(models, "model_id", "left_semi").select("model_id", "key", F.col("value").alias("old"), F.lit(True).alias("had"))
    new = generated.select("model_id", "key", F.col("value").alias("new"), F.lit(True).alias("made"))
    both = old.join(new, ["model_id", "key"], "full_outer")
    human = F.col("key").isin(*HUMAN)
    had, made = F.coalesce("had", F.lit(False)), F.coalesce("made", F.lit(False))
    keep_old = had & (human | (~made & ~F.col("key").isin(*generated_keys)))
    return both.where(keep_old | made).select("model_id", "key", F.when(keep_old, F.col("old")).otherwise(F.col("new")).alias("value"), (keep_old & made & ~F.col("old").eqNullSafe(F.col("new"))).alias("overruled"))


def drift(existing: DataFrame, generated: DataFrame) -> DataFrame:
    """model_id, change: added or removed."""
    a, b = existing.select("model_id").distinct(), generated.select("model_id").distinct()
    return b.join(a, "model_id", "left_anti").select("model_id", F.lit("added").alias("change")).union(a.join(b, "model_id", "left_anti").select("model_id", F.lit("removed").alias("change")))


def curated_losses(existing: DataFrame, merged: DataFrame) -> DataFrame:
    """model_id, key of human fields whose value a merge would lose."""
    old = existing.where(F.col("key").isin(*HUMAN)).select("model_id", "key", F.col("value").alias("old"))
    return old.join(merged.select("model_id", "key", "value"), ["model_id", "key"], "left").where(~F.col("old").eqNullSafe(F.col("value"))).select("model_id", "key")


def native_code_conflicts(codes: DataFrame) -> DataFrame:
    """model_id, tag, spellings of tags for which a model's native codes (model_id, tag, native) disagree."""
    return codes.groupBy("model_id", "tag").agg(F.array_sort(F.collect_set("native")).alias("s")).where("size(s) > 1").select("model_id", "tag", F.array_join("s", ",").alias("spellings"))


def vocabulary_coverage(pieces: DataFrame, vocabulary: DataFrame, floor: float = 0.9) -> DataFrame:
    """model_id, n, hits, ok: share of a model's source pieces (model_id, piece) that its vocabulary (model_id, piece) has."""
    known = vocabulary.select("model_id", "piece").distinct().withColumn("hit", F.lit(1))
    out = pieces.join(known, ["model_id", "piece"], "left").groupBy("model_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("hit", F.lit(0))).cast("long").alias("hits"))
    return out.withColumn("ok", F.col("hits") >= floor * F.col("n"))


def undeclared_keys(generated: DataFrame, declared: list[str]) -> DataFrame:
    """key, n_models of generated fields (model_id, key, value) that neither the generator's list nor the human one declares; must be empty before a merge is written."""
    return generated.where(~F.col("key").isin(*declared, *HUMAN)).groupBy("key").agg(F.countDistinct("model_id").alias("n_models"))


def native_lookup(asked: DataFrame, codes: DataFrame) -> DataFrame:
    """model_id, tag, native, supported: a model's own spelling of each asked tag (model_id, tag), and how many tags it has where it lacks this one."""
    table = codes.groupBy("model_id", "tag").agg(F.min("native").alias("native"))
    sizes = table.groupBy("model_id").agg(F.count(F.lit(1)).alias("supported"))
    return asked.join(table, ["model_id", "tag"], "left").join(sizes, "model_id", "left").select("model_id", "tag", "native", F.coalesce("supported", F.lit(0)).alias("supported"))


def special_tokens(maps: DataFrame) -> DataFrame:
    """repo, name, token of special-token maps (repo, content as JSON text): a token is a string, or an object with its content; others don't count."""
    raw = maps.select("repo", F.explode(F.from_json("content", "map<string,string>")).alias("name", "value")).where(F.col("name").isin("eos_token", "pad_token", "unk_token"))
    token = F.when(F.col("value").startswith("{"), F.get_json_object("value", "$.content")).when(~F.col("value").rlike("^(\\[|true$|false$|-?[0-9])"), F.col("value"))
    return raw.select("repo", "name", token.alias("token")).where("token is not null")


def write_skipped(skipped: DataFrame, path: str) -> None:
    """One JSON line per repository that was left out (repo, reason), by repository."""
    skipped.select("repo", "reason").distinct().orderBy("repo", "reason").coalesce(1).write.mode("overwrite").json(path)


def card_languages(cards: DataFrame) -> DataFrame:
    """repo, languages of model cards (repo, language, language_bcp47, arrays or null): distinct, in order; null where a card lists none."""
    none = F.array().cast("array<string>")
    both = F.array_distinct(F.concat(F.coalesce("language", none), F.coalesce("language_bcp47", none)))
    return cards.select("repo", F.when(F.size(both) > 0, both).alias("languages"))


def provenance(repos: DataFrame, prefixes: DataFrame) -> DataFrame:
    """repo, org: the first prefix (pos, prefix, org) that the repository name starts with; null if none does."""
    hit = repos.join(F.broadcast(prefixes), F.col("repo").startswith(F.col("prefix")), "left")
    return hit.groupBy("repo").agg(F.min_by("org", "pos").alias("org"))
