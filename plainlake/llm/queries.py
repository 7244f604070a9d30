"""The corpus operators as registered queries, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plainlake.llm.shared import Workspace, read

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plainlake.llm.line_dedup import dedup_lines

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = dedup_lines(docs, Workspace(spark, "lines"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plainlake.llm.language import fit, held_out, identify, vocabulary

    docs = read(spark, sf_dir, "documents")
    model = fit(docs.filter(~held_out() & F.col("doc_id").isNotNull()), vocabulary(tokenizer_path("byte_bpe_multi_50k.tiktoken")))
    out = identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "lang_pred", "score")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plainlake.llm.mixing import mix
    from plainlake.llm.shared import row_key

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    rated = mix(docs, read(spark, sf_dir, "labels"), Workspace(spark, "mixing"))
    return docs.select("doc_id", *row_key("doc_id", "text")).join(rated, ["_k1", "_k2"], "left").drop("_k1", "_k2")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plainlake.llm.token_counts import count_tokens

    cache = Workspace(spark, "token-cache").path + "/cache"  # a new cache: every distinct text is counted in this run
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(spark, docs, tokenizer_path(), cache).drop("text")


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plainlake.llm.chat import digests, format_windows, read_windows

    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("<|im_end|><|im_start|>assistant ok")
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    windows = format_windows(turns.unionByName(own), Workspace(spark, "chat"))
    return digests(read_windows(windows))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plainlake.llm.bpe import encode_decode

    return encode_decode(read(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path(), digests=True)


def op7_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plainlake.llm.vector_dedup import near_vectors

    return near_vectors(read(spark, sf_dir, "embeddings"), Workspace(spark, "vectors"))


def op8_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plainlake.llm.audio import align, render

    # A row of numbers becomes a hundred times as much sound: the small table is dealt out before that.
    rows = read(spark, sf_dir, "embeddings").repartition(4 * spark.sparkContext.defaultParallelism, "vec_id")
    return align(render(rows, "vec_id", "embedding"), Workspace(spark, "audio"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plainlake.llm.near_dedup import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents"), Workspace(spark, "near"))


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plainlake.llm.repeats import remove_repeats

    return remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"), Workspace(spark, "repeats"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_language": op2_language,
    "op3_mixing": op3_mixing,
    "op4_token_counts": op4_token_counts,
    "op5_chat": op5_chat,
    "op6_bpe": op6_bpe,
    "op7_vector_dedup": op7_vector_dedup,
    "op8_audio": op8_audio,
    "op9_near_dedup": op9_near_dedup,
    "op10_repeats": op10_repeats,
}

LINES_SQL = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS pos, unnest(ls) AS line FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, (f.key IS NOT NULL AND k.doc_id < f.keeper) AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

VECTORS_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT vec_id, label, e FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT v.vec_id, CAST((SELECT count(*) FROM links WHERE a = v.vec_id) AS BIGINT) AS n_links, component_id, component_id = v.vec_id AS kept FROM v JOIN c USING (vec_id)
"""

NEAR_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
meets AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM meets JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * meets.n >= 75 * (x.n + y.n - meets.n)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, component_id = d.doc_id AS kept FROM documents d JOIN c USING (doc_id) LEFT JOIN n ON n.doc_id = d.doc_id
"""

#: The searches of op7 and op9 may miss a pair by chance; at the size at which SQL can compare all pairs they miss none.
ORACLES: dict[str, str] = {"op1_line_dedup": LINES_SQL, "op7_vector_dedup": VECTORS_SQL, "op9_near_dedup": NEAR_SQL}
