"""What a model repository holds, from its file names, its declared type and its vocabulary.

repos: repo, files (array of names), model_type, architectures (array), curated (a kind that a
person has confirmed, null for most).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Subtags that name a family or no single language.
FAMILIES = {"itc": "collection", "sla": "collection", "bnt": "collection", "gem": "collection", "roa": "collection", "ine": "collection", "zle": "collection", "zls": "collection", "zlw": "collection", "trk": "collection", "fiu": "collection", "cel": "collection", "inc": "collection", "mul": "special", "und": "special", "zxx": "special", "mis": "special"}


def has(*names: str) -> Column:
    """Whether all these files are there."""
    out = F.lit(True)
    for name in names:
        out = out & F.array_contains("files", name)
    return out


def is_causal() -> Column:
    return F.coalesce(F.exists("architectures", lambda a: a.endswith("ForCausalLM")), F.lit(False))


def kind(repos: DataFrame) -> DataFrame:
    """repo, kind: lid, translate, or null for what isn't indexed."""
    hashed = F.exists("files", lambda f: f.endswith("_hash.py"))
    out = (
        F.when(has("labels.json") & hashed, "lid")
        .when(has("encoder_model.onnx"), "translate")
        .when(has("model.onnx") & is_causal(), "translate")
        .when(has("model.onnx", "config.json") & ~has("labels.json") & (has("tokenizer.json") | has("vocab.txt")), "lid")
    )
    return repos.select("repo", out.alias("kind"))


def architecture(repos: DataFrame) -> DataFrame:
    """repo, arch, skip: the tokenizer's shape decides before the declared type; shapes that need a person's word are skipped without it."""
    said = lambda *x: F.coalesce(F.col("curated").isin(*x), F.lit(False))
    t = F.coalesce("model_type", F.lit(""))
    arch = (
        F.when(is_causal(), F.when(said("causal-lm"), "causal-lm"))
        .when(has("source.spm", "target.spm", "vocab.json") | (t == "marian"), "marian")
        .when(t.isin("t5", "umt5") & said("t5-prefix"), "t5-prefix")
        .when(t == "umt5", None)
        .when((t == "t5") & ~has("spiece.model") & has("tokenizer.json"), F.when(said("t5-fast"), "t5-fast"))
        .when(t == "t5", "madlad")
        .when(t == "IndicTrans", "indictrans2")
        .when(t == "pegasus", F.when(has("onmt_vocab.json") | has("nos_vocab.json"), "opennmt-bpe").when(has("tokenizer.json"), "pegasus-fast"))
        .when(t == "mbart", "mbart")
        .when(has("vocab.json"), "m2m100")
        .otherwise("nllb")
    )
    return repos.select("repo", arch.alias("arch"), arch.isNull().alias("skip"))


def tag_scope(tag: Column) -> Column:
    """collection, special or null, by the primary subtag."""
    from lexmill.functions.labels import lookup

    return lookup(F.substring_index(F.replace(F.lower(F.trim(tag)), F.lit("_"), F.lit("-")), "-", 1), FAMILIES)


def target_tokens(vocabulary: DataFrame) -> DataFrame:
    """repo, code of the tokens that choose a target language (repo, piece): <2xx> or >>xxx<<; regions alone and families don't count."""
    code = F.coalesce(F.nullif(F.regexp_extract("piece", "^<2([A-Za-z]{2,3}(?:_[A-Za-z0-9]+)?)>$", 1), F.lit("")), F.nullif(F.regexp_extract("piece", "^>>([A-Za-z]{2,3}(?:_[A-Za-z]{4})?)<<$", 1), F.lit("")))
    return vocabulary.select("repo", code.alias("code")).where(F.col("code").isNotNull() & ~F.col("code").rlike("^[A-Z]{2}$") & tag_scope(F.col("code")).isNull()).distinct()


def name_pair(repo: Column) -> Column:
    """(src, tgt) of opus-mt-xx-yy, null for other names."""
    pattern = "opus-mt-(?:tc-big-)?([a-z]{2,3})-([a-z]{2,3})(?:-onnx)?$"
    return F.when(repo.rlike(pattern), F.struct(F.regexp_extract(repo, pattern, 1).alias("src"), F.regexp_extract(repo, pattern, 2).alias("tgt")))


def declared_coverage_faults(declared: DataFrame, card: DataFrame) -> DataFrame:
    """repo, tag of declared languages (repo, tag) that the repository's card (repo, tag) doesn't list; must be empty."""
    return declared.select("repo", "tag").distinct().join(card.select("repo", "tag").distinct(), ["repo", "tag"], "left_anti")
