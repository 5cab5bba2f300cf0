"""The operators' registered queries, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import block_naming, byte_bpe, centroid_search, license_index, quality_rules, repeat_parsing, secret_automaton, simhash_tiles, source_mixing, spelling_variants, token_shards, toxicity_grammar, weak_quality

QUERIES = {}
ORACLES = {}


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@register(
    "op4_block_naming",
    """
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
)
def op4_block_naming(spark, sf_dir):
    return block_naming.exact_duplicates(documents(spark, sf_dir))


@register("op5_compression_bands")
def op5_compression_bands(spark, sf_dir):
    return quality_rules.quality_rules(documents(spark, sf_dir))


@register("op6_secret_automaton")
def op6_secret_automaton(spark, sf_dir):
    found = secret_automaton.find_secrets(documents(spark, sf_dir))
    kind = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long")
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("secrets", lambda s: s["kind"].isin(*secret_automaton.KINDS[: secret_automaton.BASE]))
    return found.select("doc_id", kind("assign").alias("n_assign"), kind("access").alias("n_access"), kind("hex").alias("n_hex"), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("secrets")).alias("spans"))


@register("op8_simhash_tiles")
def op8_simhash_tiles(spark, sf_dir):
    rows = simhash_tiles.near_duplicates(documents(spark, sf_dir))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Target weights of the mixture by source; a source that isn't named has ``OTHER_WEIGHT``.
TARGET_WEIGHTS = {"src0": 20.0} | {f"src{k}": 1.0 + k % 4 for k in range(1, 20)}
OTHER_WEIGHT = 1.0


@register(
    "op2_poisson_mixing",
    f"""
    WITH sizes AS (SELECT source, count(*) AS n, (CASE source {" ".join(f"WHEN '{s}' THEN {w}" for s, w in TARGET_WEIGHTS.items())} ELSE {OTHER_WEIGHT} END)::DOUBLE AS weight FROM documents GROUP BY source),
    rates AS (SELECT source, 1.0::DOUBLE * (SELECT sum(n) FROM sizes) * weight / (SELECT sum(weight) FROM sizes) / n AS rate FROM sizes),
    terms AS (SELECT source, rate, k, exp(k * ln(rate) - rate - lgamma(k + 1)) AS p
              FROM rates, (SELECT unnest(range(0, 400)) AS k) WHERE k <= ceil(rate + 12 * sqrt(rate) + 24)),
    steps AS (SELECT source, list(c ORDER BY k) AS cdf FROM
              (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k ROWS UNBOUNDED PRECEDING) AS c FROM terms) GROUP BY source),
    drawn AS (SELECT d.*, len(list_filter(cdf, lambda c: c < (('0x' || substr(md5('1:' || doc_id), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656::DOUBLE))::INT AS copies
              FROM documents d JOIN steps s ON d.source IS NOT DISTINCT FROM s.source)
    SELECT doc_id, source, text, copies, copy::INT AS copy, md5('order1:' || doc_id || ':' || copy) AS order_key
    FROM (SELECT *, unnest(range(0, copies)) AS copy FROM drawn WHERE copies > 0)
    """,
)
def op2_poisson_mixing(spark, sf_dir):
    return source_mixing.mix(documents(spark, sf_dir), weights=TARGET_WEIGHTS, other=OTHER_WEIGHT).select("doc_id", "source", "text", "copies", "copy", "order_key")


@register("op7_token_shards")
def op7_token_shards(spark, sf_dir):
    import public_tokenizers

    return token_shards.read_all(*token_shards.store(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json")))


def multi_ranks():
    import public_tokenizers

    return byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN


@register("op9_byte_bpe")
def op9_byte_bpe(spark, sf_dir):
    ranks, pattern = multi_ranks()
    return byte_bpe.digests(byte_bpe.encode(documents(spark, sf_dir), ranks, pattern), ranks)


@register("op1_repeat_parsing")
def op1_repeat_parsing(spark, sf_dir):
    rows = repeat_parsing.remove_repeats(documents(spark, sf_dir))
    return rows.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@register("op3_weak_quality")
def op3_weak_quality(spark, sf_dir):
    return weak_quality.classify(documents(spark, sf_dir))


@register("op10_toxicity_grammar")
def op10_toxicity_grammar(spark, sf_dir):
    docs = documents(spark, sf_dir)
    grammar = toxicity_grammar.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity_grammar.score_documents(docs, grammar)


def rounds_sql(k: int, rounds: int, dims: int, scale: int, seed: str) -> str:
    """The clustering as a chain of rounds: distances of all vectors to the k centroids, then exact floors of the means."""
    nearest = "SELECT vec_id, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT x.vec_id, m.c, sum((x.v - m.v) * (x.v - m.v))::BIGINT AS d FROM x JOIN m{r} m USING (i) GROUP BY 1, 2) GROUP BY 1"
    parts = [f"""kept AS (SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {dims}),
    x AS MATERIALIZED (SELECT vec_id, i, floor({scale} * embedding[i + 1]::DOUBLE)::BIGINT AS v FROM kept, (SELECT unnest(range(0, {dims})) AS i)),
    m0 AS MATERIALIZED (SELECT c, i, v FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS c FROM kept) USING (vec_id) WHERE c < {k})"""]
    for r in range(rounds):
        parts.append(f"""a{r} AS MATERIALIZED ({nearest.format(r=r)}),
    m{r + 1} AS MATERIALIZED (SELECT m.c, m.i, CASE WHEN n IS NULL THEN m.v ELSE (s - ((s % n) + n) % n) // n END AS v FROM m{r} m LEFT JOIN (SELECT c, i, sum(v)::BIGINT AS s, count(*) AS n FROM x JOIN a{r} USING (vec_id) GROUP BY 1, 2) USING (c, i))""")
    parts.append(f"last AS MATERIALIZED ({nearest.format(r=rounds)}), name AS (SELECT c, sha256(string_agg(v::VARCHAR, ',' ORDER BY i)) AS name FROM m{rounds} GROUP BY c)")
    return f"""WITH {", ".join(parts)} SELECT vec_id, c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, name AS centroid_sha256 FROM last JOIN name USING (c)"""


@register("op13_shallot_clusters", rounds_sql(8, 10, 64, 1024, "3"))
def op13_shallot_clusters(spark, sf_dir):
    return centroid_search.clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=8, rounds=10, dims=64, scale=1024, seed="3")


@register("op12_spelling_variants")
def op12_spelling_variants(spark, sf_dir):
    return spelling_variants.variants(documents(spark, sf_dir))


@register("op11_license_index")
def op11_license_index(spark, sf_dir):
    found = license_index.find_licenses(documents(spark, sf_dir))
    base = F.filter("places", lambda p: p["base"])
    named = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")
    firsts = F.transform(base, lambda p: p["first"])
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(firsts).alias("first_word"), F.array_max(firsts).alias("last_word"),
        named(base).alias("base_labels"), named(F.col("places")).alias("labels"), F.coalesce(F.array_max(F.transform("places", lambda p: p["score"])), F.lit(0.0)).alias("score"),
    )
