"""Line dedup, repeated windows, near duplicates, token counts, BPE and language against plain versions."""

import hashlib

import brute
import pytest
from pyspark.sql import functions as F

from plainlake.llm import queries
from plainlake.llm.shared import Workspace, components

LINE = "this line is long enough to be counted as one line "
PROSE = [f"word{i * i % 97} and{i} the{i % 13}" for i in range(200)]


def texts():
    base = " ".join(PROSE)
    passage = " ".join(f"shared{i} passage{i % 7}" for i in range(40))
    out = [None, "", " \t\n", "a", "one two three four", "One  TWO three\nfour", "x" * 5000, "é" * 900, "ab" * 700, base, base, base.upper(), base.replace("word1 ", "changed "), base + " tail", passage, "before " + passage + " after", passage + "\n" + passage, "😀 <|endoftext|> it's  fine  12½ ²  \n"]
    out += [f"{LINE}\n  {LINE.upper()}\t\nown line number {i} which only this text of all texts has" for i in range(6)] + [base[i:] + LINE * i for i in range(3)]
    return dict(enumerate(out))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(texts().items()), "doc_id long, text string").withColumn("n_lines", F.lit("clash")).repartition(3).cache()


def test_lines(spark, docs):
    from plainlake.llm.line_dedup import dedup_lines

    out = dedup_lines(docs, Workspace(spark, "t"), fanout=2)
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in out.collect()}
    assert got == brute.lines(texts())
    assert sum(x[1] for x in got.values()) > 5
    assert dedup_lines(docs.limit(0), Workspace(spark, "t")).count() == 0


def test_runs_are_levelled(spark, docs):
    from plainlake.llm.line_dedup import Runs, long_lines

    runs = Runs(Workspace(spark, "t"), fanout=2)
    lines = long_lines(docs, 40)
    for b in range(3):
        runs.add(lines.filter(F.col("doc") % 3 == b))
    assert [len(x) for x in runs.levels] == [1, 1]
    assert runs.unseen(lines).count() == 0
    held = {(r["h1"], r["h2"]): (r["n_docs"], r["keeper"]) for r in runs.all().collect()}
    want = {(r["h1"], r["h2"]): (r["n"], r["m"]) for r in lines.groupBy("h1", "h2").agg(F.countDistinct("doc").alias("n"), F.max("doc").alias("m")).collect()}
    assert held == want


@pytest.mark.parametrize("depth", [64, 400])
def test_repeats(spark, docs, depth):
    from plainlake.llm.repeats import remove_repeats

    out = remove_repeats(docs.select("doc_id", "text"), Workspace(spark, "t"), depth, texts=True)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out.collect()}
    assert got == dict(zip(texts(), brute.repeats(list(texts().values()), depth)))
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in out.collect())


def test_near(spark, docs):
    from plainlake.llm.near_dedup import near_duplicates

    want, links = brute.near(texts())
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(docs, Workspace(spark, "t")).collect()}
    assert got == want and links > 5
    odd = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (7, "A b c d e f"), (8, None)], "doc_id long, text string")
    rows = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in near_duplicates(odd, Workspace(spark, "t")).collect()), key=repr)
    assert rows == [(3, 3, True), (3, 3, True), (7, 3, False), (8, 8, True), (None, 3, False)]


def test_near_recall_at_the_threshold(spark):
    from plainlake.llm.near_dedup import near_duplicates

    rows = []
    for i in range(150):  # pairs of 100 words, of which one end differs: similarity just over 0.75
        words = [f"w{i}x{k}" for k in range(100)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[13:] + [f"v{i}x{k}" for k in range(13)]))]
    want, links = brute.near(dict(rows))
    assert links == 150
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), Workspace(spark, "t")).filter("not kept").count()
    assert got >= 0.95 * links


def test_components(spark):
    import random

    random.seed(3)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    want = brute.find_groups({x for e in edges for x in e}, edges)
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "t"), "c").collect()}
    assert all(got.get(i, i) == c for i, c in want.items())


def test_counts_and_bpe(spark, docs, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    from plainlake.llm.bpe import encode_decode
    from plainlake.llm.token_counts import count_tokens

    path = queries.tokenizer_path()
    library = tokenizers.Tokenizer.from_file(path)
    want = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in texts().items()}
    out = {r["doc_id"]: r for r in encode_decode(docs, path).collect()}
    assert {i: list(r["ids"]) for i, r in out.items()} == want
    assert all(r["decoded"] == library.decode(want[i], skip_special_tokens=False) for i, r in out.items())
    digests = {r["doc_id"]: r["ids_sha256"] for r in encode_decode(docs, path, digests=True).collect()}
    assert digests == {i: brute.sha(",".join(map(str, ids))) for i, ids in want.items()}
    cache = f"file://{tmp_path}/cache"
    for part in (docs.filter("doc_id < 9"), docs):
        got = {r["doc_id"]: r["n_tokens"] for r in count_tokens(spark, part, path, cache).collect()}
    assert got == {i: len(ids) for i, ids in want.items()}
    assert spark.read.parquet(cache).count() == len({t or "" for t in texts().values()})
    assert count_tokens(spark, docs.limit(0), path, cache).count() == 0


def test_other_tokenizers(spark, docs, tmp_path):
    from plainlake.llm.token_counts import Counter

    import sentencepiece

    path = queries.tokenizer_path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    assert [Counter(path).count(t or "") for t in texts().values()] == [len(model.encode(t or "")) for t in texts().values()]
    import tokenizers

    path = queries.tokenizer_path("word_bpe_49k.json")
    assert Counter(path).count("Hello there") == len(tokenizers.Tokenizer.from_file(path).encode("Hello there", add_special_tokens=False).ids)


def test_forward_algorithm_sums_all_segmentations():
    import itertools
    import math

    import numpy as np

    from plainlake.llm.language import Model

    pieces = {b" ": 0, b"a": 1, b"b": 2, b" a": 3, b"ab": 4, b" ab": 5}
    p = np.array([[0.2], [0.1], [0.1], [0.2], [0.3], [0.1]])
    m = Model(["xx"], pieces, np.log(p), 3)

    def total(rest: bytes) -> float:
        return 1.0 if not rest else sum(p[pieces[rest[:k]]][0] * total(rest[k:]) for k in range(1, len(rest) + 1) if rest[:k] in pieces)

    for word in map("".join, itertools.product("ab", repeat=4)):
        want = math.log(total(b" " + word.encode()))
        assert abs(m.word(word)[0] - want) < 1e-9 and abs(m.words([word])[0, 0] - want) < 1e-9


def test_language(spark):
    out = queries.op2_language(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = out.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.min("score"), F.max("score")).first()
    assert held[0] > 0.97 and 0 <= held[1] <= held[2] <= 1
    from plainlake.llm.language import fit, identify

    none = spark.createDataFrame([(1, None, None), (2, "12 ² !?", "en")], "doc_id long, text string, lang string")
    model = fit(none, {bytes([b]): b for b in range(256)})
    assert [(r["lang_pred"], r["score"]) for r in identify(none, model).orderBy("doc_id").collect()] == [("und", 0.0), ("und", 0.0)]


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    now, ws = docs, Workspace(spark, "t")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        before = {r["doc_id"]: r["text"] for r in now.collect()}
        now = ws.save(stage(spark, now, sf), f"s{k}")
        assert now.columns == docs.columns
        after = {r["doc_id"]: r["text"] for r in now.collect()}
        if name == "line dedup":
            assert {i: brute.sha(t) for i, t in after.items()} == {i: x[2] for i, x in brute.lines(before).items()}
        if name == "MinHash near-dedup":
            assert set(after) == {i for i, x in brute.near(before)[0].items() if x[2]}
    out = corpus_pipeline.encoding(spark, corpus_pipeline.mixing(spark, now, sf), sf)
    assert out.filter("not exact").count() == 0 and out.count() > 0


def test_stages_take_odd_tables(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    shape = docs.schema
    base = docs.filter("lang = 'en'").orderBy("doc_id").first()
    near = base["text"] + " and a few words more"
    odd = [(None, None, None, None, None), (900001, None, "en", "src0", None), (900002, "", None, "src0", 0), (None, near, "en", None, 5), (base["doc_id"], near, "en", "src0", 5), (900003, "12 !? ", "en", "src0", 6), (900004, "word " * 300_000, "en", "src0", 7)]
    rows = [tuple(base), tuple(base), *odd]
    order = [f.name for f in shape]
    assert order == ["doc_id", "text", "lang", "source", "n_chars"]
    table = spark.createDataFrame(rows, shape).unionByName(docs.limit(30))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0, name
        assert stage(spark, table, sf).count() > 0, name
    left = corpus_pipeline.near(spark, spark.createDataFrame(rows, shape), sf).collect()
    got = sorted((r["doc_id"] or -1, len(r["text"] or "")) for r in left)
    assert [x for x in got if x[0] != base["doc_id"]] == [(-1, 0), (900001, 0), (900002, 0), (900003, 6), (900004, 1_500_000)]
    assert [x[1] in (len(base["text"]), len(near)) for x in got if x[0] == base["doc_id"]] == [True]
