"""A small registry of our own for the routing, quality and registry queries, as rows that both engines can read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: columns of the model table; arrays and maps by their SQL type in Spark
MODELS = (
    "model_id string, arch string, license_tier string, size_mb long, org string, release_date string, precision string, cached boolean, runnable boolean,"
    " pair array<string>, languages array<string>, src_languages array<string>, tgt_languages array<string>, directions array<array<string>>, chrf double, corpus string, n int, flagged boolean"
)


def _model(i, size, tier="permissive", pair=None, langs=None, src=None, tgt=None, dirs=None, org=None, date=None, precision="int8", cached=False, runnable=True, chrf=None, n=None, flagged=False, arch="marian"):
    return (i, arch, tier, size, org, date, precision, cached, runnable, pair, langs, src, tgt, dirs, chrf, None if n is None else "flores", n, flagged)


MODEL_ROWS = [
    _model("wide-a", 1200, langs=["en", "es", "fr", "de", "pt", "gl", "ca"], arch="m2m100", date="2020-10-21", chrf=48.5, n=100, precision="fp32"),
    _model("wide-a-int8", 620, langs=["en", "es", "fr", "de", "pt", "gl", "ca"], arch="m2m100", date="2020-10-21", chrf=46.0, n=100),
    _model("wide-b", 1800, "non-commercial", langs=["en", "es", "fr", "de", "pt", "gl", "ca", "eu"], arch="nllb", date="2022-07-06", precision="fp32"),
    _model("from-many", 900, "share-alike", src=["ru", "uk", "be"], tgt=["en", "de"], arch="m2m100", date="2021-13-40"),
    _model("listed", 240, dirs=[["zh", "en"], ["en", "zh"], ["ja", "en"]], arch="nllb", date="2023-05-01"),
    _model("rules-pair", 1, pair=["es", "an"], precision=None, cached=True, arch="rules", org="Projecte AINA"),
    *[_model(f"pair-{a}-{b}", s, pair=[a, b], org=o, date=d, cached=c, chrf=q, n=None if q is None else 50, flagged=f) for a, b, s, o, d, c, q, f in [
        ("en", "es", 165, None, "2020-08-18", True, 54.9, False), ("es", "en", 166, None, "2020-08-18", False, 58.2, False), ("en", "fr", 170, None, "2020-08-18", True, None, False), ("fr", "en", 171, None, "2020-08-18", False, None, False),
        ("es", "eu", 160, "HiTZ", "2023-11-02", False, 51.0, False), ("eu", "es", 161, "HiTZ", "2023-11-02", False, None, False), ("es", "gl", 150, "Proxecto Nós", "2024-01-15", False, None, False), ("es", "ast", 155, "Proxecto Nós", None, False, 38.2, True),
        ("az", "en", 237, None, "2019-02-30", False, 25.9, True), ("en", "de", 180, None, "2020-02-26", False, None, False), ("de", "nl", 175, None, "2020-02-26", False, None, False), ("fr", "oc", 140, "Projecte AINA", "2024-03-01", False, None, False), ("ru", "zh", 1719, None, "2021-06-01", False, None, False),
    ]],
    _model("pair-es-eu-int8", 45, pair=["es", "eu"], org="HiTZ", date="2023-11-02", chrf=48.4, n=50),
    _model("broken", 99, pair=["sw", "en"], runnable=False),
]

TABLES: dict[str, tuple[str, list[tuple]]] = {
    "models": (MODELS, MODEL_ROWS),
    "barred": ("model_id string, side string, lang string", [("wide-a", "target", "gl"), ("wide-b", "source", "eu"), ("from-many", "both", "be")]),
    "requests": ("req_id int, src string, tgt string", [(i, *p.split(">")) for i, p in enumerate("en>es es>en en>eu eu>fr fr>de pt>eu ru>en be>de zh>de ja>es az>es es>ast en>ast es>es sw>fr xx>en en>nl gl>oc uk>nl fr>an".split())]),
    "regional_requests": ("req_id int, src string, tgt string", [(1, "es-MX", "en"), (2, "en", "es-ES"), (3, "es-AR", "eu-ES"), (4, "az-RU", "en"), (5, "fr-CA", "de-AT"), (6, "en-GB", "en-US"), (7, "en", "es"), (8, "pt-BR", "gl")]),
    "flags": ("model_id string, lang string, reason string, side string", [("wide-a", "ca", "answers in Spanish", None), ("wide-b", "eu", "loops", "both"), ("wide-a-int8", "gl", "", "target"), ("pair-es-ast", "ast", "mixes in Spanish", "target"), ("from-many", "uk", "reads it as Russian", "source"), ("rules-pair", "an", "word for word", "target")]),
    "caps": ("cap_mb long", [(None,), (2000,), (1000,), (500,), (170,)]),
    "distances": ("a string, b string, d double", [("pt", "es", 0.21), ("es", "eu", 0.25), ("en", "eu", 0.45), ("pt", "en", 0.32), ("en", "es", 0.3), ("fr", "es", 0.28), ("fr", "en", 0.4), ("de", "fr", 0.5), ("de", "en", 0.2), ("en", "nl", 0.24), ("de", "nl", 0.1)]),
    "given_routes": ("route_id int, src string, tgt string", [(1, "en", "eu"), (2, "en", "eu"), (3, "fr", "en"), (4, "sw", "en"), (5, "en", "es"), (6, "en", "fr"), (7, "es", "pt")]),
    "given_hops": ("route_id int, pos int, model_id string, src string, tgt string", [(1, 0, "pair-en-es", "en", "es"), (1, 1, "pair-es-eu", "es", "eu"), (2, 0, "pair-en-fr", "en", "fr"), (2, 1, "pair-es-eu", "es", "eu"), (3, 0, "no-such", "fr", "en"), (4, 0, "broken", "sw", "en"), (6, 0, "pair-en-es", "en", "es"), (7, 0, "pair-es-en", "es", "pt")]),
    "entries": ("model_id string, onnx_file string, graphs map<string,string>, side_files map<string,string>, extra_files array<string>, size_mb long", [("a", "a.onnx", None, {"vocab": "vocab.txt", "labels": "labels.json"}, None, 300), ("b", None, {"encoder": "enc.onnx", "decoder": "dec.onnx"}, {"spm": "source.spm"}, ["enc.onnx_data", "../x"], 9000), ("c", "c.onnx", {}, {}, [], 80), ("d", "/abs/d.onnx", None, None, ["sub/ok.bin"], 20)]),
    "present": ("model_id string, file string, size long", [("a", "a.onnx", 10), ("a", "vocab.txt", 5), ("a", "labels.json", 3), ("b", "enc.onnx", 10), ("b", "dec.onnx", 0), ("c", "c.onnx", 7)]),
    "old_fields": ("model_id string, key string, value string", [("m1", "size_mb", "10"), ("m1", "notes", "good"), ("m1", "quality", "50"), ("m1", "mirror", "x"), ("m1", "arch", "marian"), ("m2", "size_mb", "5"), ("m2", "language_flags", "{}"), ("m3", "size_mb", "1")]),
    "new_fields": ("model_id string, key string, value string", [("m1", "size_mb", "11"), ("m1", "notes", "bad"), ("m1", "quality", "50"), ("m2", "size_mb", "5"), ("m2", "arch", "nllb"), ("m4", "size_mb", "7"), ("m4", "notes", "fresh")]),
    "codes": ("model_id string, tag string, native string", [("m1", "pt", "__pt__"), ("m1", "pt", "__pt_PT__"), ("m1", "es", "__es__"), ("m2", "es", "spa_Latn"), ("m2", "es", "spa_Latn")]),
    "repos": ("repo string", [("Helsinki-NLP/opus-mt-en-es",), ("HiTZ/mt-hitz-en-eu",), ("proxectonos/Nos_MT-es-gl",), ("someone/else",), ("Helsinki-NLP/opus-tatoeba-x",)]),
    "hub": ("repo string, files array<string>, model_type string, architectures array<string>, curated string", [
        ("o/opus-mt-en-es-onnx", ["encoder_model.onnx", "source.spm", "target.spm", "vocab.json"], "m2m_100", None, None), ("o/opus-mt-tc-big-itc-en", ["encoder_model.onnx"], "marian", None, None), ("g/lid", ["model.onnx", "labels.json", "glot_hash.py"], None, None, None),
        ("a/classifier", ["model.onnx", "config.json", "tokenizer.json"], "bert", ["BertForSequenceClassification"], None), ("p/causal", ["model.onnx", "config.json", "tokenizer.json"], "gemma", ["GemmaForCausalLM"], "causal-lm"), ("q/causal", ["model.onnx"], "gemma", ["GemmaForCausalLM"], None),
        ("t/madlad", ["encoder_model.onnx", "spiece.model"], "t5", None, None), ("t/fast", ["encoder_model.onnx", "tokenizer.json"], "t5", None, None), ("t/fast2", ["encoder_model.onnx", "tokenizer.json"], "t5", None, "t5-fast"), ("t/umt5", ["encoder_model.onnx"], "umt5", None, None), ("t/prefix", ["encoder_model.onnx"], "umt5", None, "t5-prefix"),
        ("i/indic", ["encoder_model.onnx"], "IndicTrans", None, None), ("n/nos", ["encoder_model.onnx", "onmt_vocab.json"], "pegasus", None, None), ("n/peg", ["encoder_model.onnx", "tokenizer.json"], "pegasus", None, None), ("n/odd", ["encoder_model.onnx"], "pegasus", None, None), ("m/mbart", ["encoder_model.onnx"], "mbart", None, None), ("m/m2m", ["encoder_model.onnx", "vocab.json"], "m2m_100", None, None), ("m/nllb", ["encoder_model.onnx"], "m2m_100", None, None), ("x/other", ["readme.md"], None, None, None)]),
    "pieces": ("repo string, piece string", [("t/madlad", "<2en>"), ("t/madlad", "<2es_419>"), ("t/madlad", "<2CA>"), ("t/madlad", "<2itc>"), ("t/madlad", "en"), ("o/g", ">>por<<"), ("o/g", ">>lat_Latn<<"), ("o/g", ">>sla<<"), ("o/g", "<<x>>")]),
    "prefixes": ("pos int, prefix string, org string", [(0, "Helsinki-NLP/opus-tatoeba", "Tatoeba"), (1, "Helsinki-NLP/", "Helsinki-NLP"), (2, "HiTZ/", "HiTZ"), (3, "proxectonos/", "Proxecto Nós")]),
    "tags_list": ("id int, tag string", list(enumerate(["por_Latn", "pt", "POR", " eng ", "ace-Arab", "fr-ca", "az-RU", "zho_Hans", "cmn-Hans", "ext-PT-x-Barrancos", "", "  ", "not a tag", "x", "eng-us", "sr-Latn", "arb_Arab", "1234", "es-419"]))),
    "pinned": ("req_id int, model_id string, src string, tgt string", [(1, "pair-en-es", None, None), (2, "pair-en-es", "fr", "de"), (3, "wide-a", "en", "fr"), (4, "wide-a", "en", None), (5, "wide-a", "en", "eu"), (6, "nobody", "en", "fr"), (7, "broken", "sw", "en"), (8, "wide-a", "en", "gl")]),
    "broken_tree": ("label_idx int, node int, bit boolean", [(0, 1, False), (1, 0, None), (1, 1, True), (4, 0, False), (4, 7, True)]),
    "asked_codes": ("model_id string, tag string", [("m1", "pt"), ("m1", "eu"), ("m2", "es"), ("m9", "es")]),
    "token_maps": ("repo string, content string", [("r1", '{"pad_token": "<pad>", "eos_token": "</s>", "bos_token": "<s>"}'), ("r2", '{"pad_token": {"content": "<blank>", "lstrip": false}, "unk_token": ["x"], "eos_token": 3}'), ("r3", "not json"), ("r4", None)]),
    "cards": ("repo string, language array<string>, language_bcp47 array<string>", [("a", ["en", "es"], ["es", "pt-BR"]), ("b", None, ["fr"]), ("c", [], None), ("d", None, None)]),
    "licences": ("repo string, card string, readme string", [("r1", "apache-2.0", None), ("r2", None, "License: CC-BY-NC-4.0 and more"), ("r3", "cc-by-sa-4.0", "x"), ("r4", None, "none told"), ("r5", "proprietary", None)]),
    "labels_list": ("label_idx int, raw string", list(enumerate("__label__eng_Latn arb_Arab ajp_Arab zho_Hans zho_Hant yue_Hani pt __label__srp_Cyrl ell_Latn ell_Grek swh_Latn nan_lang cmn_Hani por_Latn kor_Hang".split()))),
    "hs_tree": ("label_idx int, node int, bit boolean", [(0, 1, False), (1, 0, True), (1, 1, True), (2, 0, False), (2, 1, True)]),
    "node_scores": ("doc_id long, node int, score double", [(1, 0, 0.25), (1, 1, 0.8), (2, 0, 0.5), (2, 1, 0.0), (3, 0, 1.0), (3, 1, 1.0)]),
    "strings": ("id int, s string", list(enumerate(["", " ", "\n\t", "​", "​ ⁠", "a b", " ", "\x1c\x1d", "ok", "€ 5", "日本", "(a ) % , 50 % “q” – x — y’s ‘z’", "it 's n't .", "१२३ ४ ٠ ೧", "a  b   c", "un@@ do @@ ne", "__fr__", "__pt_BR__ ", "x@y.org and 1,234.5 or 12/05/2020 #tag"]))),
}


def table(spark: SparkSession, name: str) -> DataFrame:
    schema, rows = TABLES[name]
    return spark.createDataFrame(rows, schema)


def _literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, (int, float)):
        return repr(v)
    if isinstance(v, dict):
        return "MAP {" + ", ".join(f"{_literal(k)}: {_literal(x)}" for k, x in v.items()) + "}"
    if isinstance(v, list):
        return "[" + ", ".join(map(_literal, v)) + "]"
    runs, last = [], None
    for c in str(v):
        plain = ord(c) >= 32
        if plain and last:
            runs[-1] += c
        else:
            runs.append(c)
        last = plain
    return " || ".join("'" + r.replace("'", "''") + "'" if ord(r[0]) >= 32 else f"chr({ord(r)})" for r in runs) or "''"


SQL_TYPES = {"string": "VARCHAR", "long": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN", "array<string>": "VARCHAR[]", "array<array<string>>": "VARCHAR[][]", "map<string,string>": "MAP(VARCHAR, VARCHAR)"}


def entry_sql(name: str) -> str:
    """A SELECT for DuckDB that gives the rows of a table."""
    schema, rows = TABLES[name]
    columns = [c.split(" ", 1) for c in schema.split(", ")]
    body = ", ".join("(" + ", ".join(_literal(v) for v in r) + ")" for r in rows)
    casts = ", ".join(f"c{i}::{SQL_TYPES[t.strip()]} AS {c}" for i, (c, t) in enumerate(columns))
    return f"SELECT {casts} FROM (VALUES {body}) AS v({', '.join(f'c{i}' for i in range(len(columns)))})"
