"""The registered queries: thin digests of the operators over ``documents``."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, iblt, langid, media, mixing, oracles, periods, pii, repeats, simhash, spans, toxicity, training_order, trigrams, variants
from .common import WORD, documents, fold, fresh_path


#: Texts of this score or more count as toxic.
TOXIC = 0.7


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document in a mix of all sources weighing 3, 1, 2 and 150% of all words."""
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source", "epochs")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's toxicity, learned from the labels that are not held out."""
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(fold("doc_id", 3) != 1)
    model = toxicity.learn(docs, labels)
    held_out = F.coalesce(fold("doc_id", 3) == 1, F.lit(False))
    scored = toxicity.score(docs.select("doc_id", "text", held_out.alias("held_out")), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"), F.size("offending").alias("n_offending"))


def op3_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's sequences of byte ids, written to shards in training order and read back."""
    path = fresh_path(spark, "training-order")
    ids = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    training_order.write_order(documents(spark, sf_dir).select("doc_id", ids.alias("ids")), path, width=1)
    found = training_order.read_order(spark, path)
    return found.select(F.col("id").alias("doc_id"), "part", "slot", F.col("n").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's token ids and their decoding, as digests."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    found = bpe.encode(documents(spark, sf_dir), path, public_tokenizers.PATTERN, round_trip=True)
    return found.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as 64-byte-aligned 8-bit samples of a WAV file, read back and fingerprinted."""
    unit = 64
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    n = F.octet_length("raw")
    padded = F.greatest(F.ceil(n / unit) * unit, F.lit(unit)).cast("int")
    payload = F.concat(F.col("raw"), F.unhex(F.repeat(F.lit("00"), padded - n)))
    docs = documents(spark, sf_dir).select("doc_id", raw.alias("raw")).select("doc_id", n.cast("long").alias("n_bytes"), payload.alias("payload"))
    read = media.from_wav(media.to_wav(docs, "payload").drop("payload"))
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("samples").cast("long").alias("payload_bytes"),
        F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.substring("samples", -unit, unit)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        media.digest(F.col("pairs")).alias("feature"),
        F.size("pairs").cast("long").alias("n_pairs"),
    )


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every text: formats, and identifiers shown by their contexts."""
    found = pii.find(documents(spark, sf_dir))
    counts = [spans.count(F.col("base"), kind).alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(spans.joined(F.col("base")), 256).alias("base_sha256"), spans.joined(F.col("found")).alias("spans"), F.size("found").cast("long").alias("n_spans"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64-bit SimHash of four-word shingles; groups linked at four differing bits or fewer."""
    found = simhash.near_duplicates(documents(spark, sf_dir), shingle=4, bits=64, radius=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex(F.col("fp")[0]), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every text: base rules and further formats."""
    found = trigrams.scan(documents(spark, sf_dir), keep=["doc_id"])
    kinds = [r.kind for r in trigrams.BASE]
    base = F.filter("secrets", lambda s: s["kind"].isin(kinds))
    counts = [spans.count(F.col("secrets"), kind).alias(f"n_{kind}") for kind in kinds]
    return found.select("doc_id", *counts, F.sha2(spans.joined(base), 256).alias("base_sha256"), spans.joined(F.col("secrets")).alias("spans"), F.size("secrets").cast("long").alias("n_spans"))


def op9_iblt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketch fingerprints of every text and of its edited text, and their likeness."""
    n = F.char_length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - quarter), F.substring(F.col("next_text"), F.lit(1), quarter))
    pairs = iblt.successors(documents(spark, sf_dir)).withColumn("edited", edited)
    pairs = pairs.withColumns({"n_chars": n.cast("long"), "edited_sha256": F.sha2("edited", 256)})
    found = iblt.reconcile(pairs, "text", {"to_edited": "edited", "to_next": "next_text"}, ["doc_id", "n_chars", "edited_sha256"])
    return found.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        F.col("to_edited.fingerprint").alias("edited_fingerprint"),
        F.col("to_edited.likeness").alias("near_edited"),
        F.col("to_next.likeness").alias("near_next"),
    )


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text, learned from the rows that are not held out."""
    docs = documents(spark, sf_dir)
    filters = langid.learn(docs.filter(fold("doc_id", 5) != 0))
    held_out = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    return langid.predict(docs.select("doc_id", "text", held_out.alias("held_out")), filters).select("doc_id", "held_out", "lang_pred", "score")


def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of six characters that occur five times, and the frequent forms that they vary by one edit."""
    counted = variants.count_words(documents(spark, sf_dir), doc_id="doc_id", one_in=199)
    return variants.group(counted.filter((F.char_length("word") >= 6) & (F.col("n") >= 5)), ratio=5)


def op12_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each text less the passages of fifty words or more that documents of smaller ids have too."""
    found = repeats.remove(documents(spark, sf_dir).select("doc_id", "text"), window=50)
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return found.select("doc_id", "n_words", gone.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"), F.size("removed").cast("long").alias("n_stretches"))


def op13_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in each text, in one of ten texts planted ones, and the texts without their repetitions."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    n = F.regexp_count("text", F.lit(WORD)).cast("long")
    start = F.pmod(g, n)
    period = 1 + F.floor((n - start) / (3 + F.pmod(g, F.lit(8))))
    planted = F.when(h % 10 == 0, F.when(n > 0, periods.looped(F.col("text"), start, period)))
    found = periods.find(documents(spark, sf_dir).select("doc_id", F.coalesce(planted, "text").alias("text")), least=12)
    run = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    found = found.withColumns({"run": run, "lines": lines})
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("run.start")).alias("start"),
        F.col("run.length").alias("length"),
        (-F.col("run.period")).alias("period"),
        F.expr("1000 * run.length div -run.period").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_mixing": op1_mixing, "op2_toxicity": op2_toxicity, "op3_training_order": op3_training_order, "op4_bpe": op4_bpe, "op5_media": op5_media, "op6_pii": op6_pii, "op7_simhash": op7_simhash, "op8_secrets": op8_secrets, "op9_iblt": op9_iblt, "op10_langid": op10_langid, "op11_variants": op11_variants, "op12_repeats": op12_repeats, "op13_periods": op13_periods}


#: The rules of ``trigrams.RULES`` for DuckDB, which has no possessive quantifiers: kind, pattern, condition on a match ``m``.
_SECRETS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "length(regexp_extract(m, '{p}', 2)) >= 6"),
    ("access", r"AKIA[A-Z0-9]+", "length(m) >= 20"),
    ("hex", r"[0-9a-f]{24,}", "true"),  # a run of fewer has no match, a longer one has one
    ("private_key", r"-----BEGIN (?:[A-Z]{2,12} ){0,3}PRIVATE KEY-----", "true"),
    ("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}", "true"),
    ("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", "true"),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "true"),
    ("url", r"[a-z]{3,12}://[A-Za-z0-9._-]{1,64}:[A-Za-z0-9._-]{3,64}@", "true"),
)


def _secrets_sql() -> str:
    rules = []
    for rank, (kind, pattern, keep) in enumerate(_SECRETS):
        p = pattern.replace("'", "''")
        places = f"""select doc_id, unnest(ms) m, unnest(list_transform(range(1, len(ms) + 1),
            lambda i: coalesce(list_sum(list_transform(gs[1:i], lambda g: length(g))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda g: length(g))), 0)))::bigint s
            from (select doc_id, regexp_extract_all(text, '{p}') ms, string_split_regex(text, '{p}') gs from documents where regexp_matches(text, '{p}'))"""
        rules.append(f"select doc_id, {rank} as rank, '{kind}' as kind, s, s + length(m) as e from ({places}) where {keep.format(p=p)}")
    joined = "coalesce(string_agg(kind || ':' || s || ':' || e, ',' order by s, rank){f}, '')"
    base = "filter (where rank < 3)"
    counts = ", ".join(f"count(*) filter (where kind = '{kind}') as n_{kind}" for kind, *_ in _SECRETS[:3])
    return f"""with spans as ({" union all ".join(rules)})
        select d.doc_id, {counts}, sha256({joined.format(f=" " + base)}) as base_sha256, {joined.format(f="")} as spans, count(kind) as n_spans
        from documents d left join spans using (doc_id) group by d.doc_id"""


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that it can express: the others hash with XXH64, fit models, or encode."""
    return {"op8_secrets": _secrets_sql()} | oracles.SQL
