"""Corpus operators do the whole of their method."""

from pyspark.sql import functions as F

from plainlake.llm.shared import Workspace


def test_each_line_key_is_in_one_run(spark):
    from plainlake.llm.line_dedup import Runs

    lines = spark.createDataFrame([(k, -k, d) for d in range(12) for k in range(d, d + 5)], "h1 long, h2 long, doc long")
    for fanout in (2, 9):
        runs = Runs(Workspace(spark, "t"), fanout)
        for b in range(4):
            runs.add(lines.filter(F.col("doc") % 4 == b))
        held = [r["h1"] for level in runs.levels for run in level for r in run.collect()]
        assert sorted(held) == list(range(16))
        got = {r["h1"]: (r["n_docs"], r["keeper"]) for r in runs.all().collect()}
        assert got == {k: (min(k, 11) - max(k - 4, 0) + 1, min(k, 11)) for k in range(16)}


def test_line_dedup_asks_the_runs(spark, monkeypatch):
    from plainlake.llm import line_dedup

    asked, unseen = [], line_dedup.Runs.unseen
    monkeypatch.setattr(line_dedup.Runs, "unseen", lambda self, lines: asked.append(1) or unseen(self, lines))
    docs = spark.createDataFrame([(i, "a line that is long enough to be counted as one") for i in range(6)], "doc_id long, text string")
    assert line_dedup.dedup_lines(docs, Workspace(spark, "t"), batches=4).filter("n_dropped = 1").count() == 5 and len(asked) == 3


def test_short_and_held_recordings_match_their_copies(spark):
    from plainlake.llm.audio import APART, align, encode, fingerprint, tones

    short, held = tones([1.0] * 9), tones([1.0], length=20000)
    assert 0 < len(fingerprint(short, 4000)) <= APART + 1 and len(fingerprint(held, 4000)) > 50
    media = [(k, encode(x, 4000)) for k, x in enumerate([short, short, held, held])]
    rows = align(spark.createDataFrame(media, "id long, media binary"), Workspace(spark, "t")).collect()
    assert {(r["id"], r["class_id"], r["component_id"], r["match_id"], r["shift"], r["bit_errors"]) for r in rows} == {(0, 0, 0, None, None, None), (1, 0, 0, 0, 0, 0), (2, 2, 2, None, None, None), (3, 2, 2, 2, 0, 0)}


#: Names that the operators use inside, and some that sound like it.
TAKEN = ["_k1", "_k2", "_lines", "_drop", "t1", "t2", "cuts", "places", "_digest", "digest", "_word", "_mask", "_pl0", "_pl1", "_times", "_time", "_a", "_r", "batch", "word"]


def test_columns_of_any_name_stay(spark, tmp_path):
    from plainlake.llm.bpe import encode_decode
    from plainlake.llm.language import Model, identify
    from plainlake.llm.line_dedup import dedup_lines
    from plainlake.llm.mixing import apply_rates, mix
    from plainlake.llm.queries import tokenizer_path
    from plainlake.llm.repeats import remove_repeats
    from plainlake.llm.token_counts import count_tokens

    import numpy as np

    long = "a line that is long enough to be counted as one, even here " * 9
    rows = [(i, f"{long}\nown {i}") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", *[F.concat(F.lit(n), F.col("doc_id")).alias(n) for n in TAKEN])
    want = {(i, n, f"{n}{i}") for i in range(6) for n in TAKEN}
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")
    model = Model(["en"], {bytes([b]): b for b in range(256)}, np.log(np.full((256, 1), 1 / 256)), 1)
    made = {
        "lines": dedup_lines(docs, Workspace(spark, "t")),
        "language": identify(docs, model),
        "counts": count_tokens(spark, docs, tokenizer_path(), f"file://{tmp_path}/c"),
        "bpe": encode_decode(docs, tokenizer_path()),
        "repeats": remove_repeats(docs, Workspace(spark, "t")),
        "mixing": apply_rates(docs, mix(docs, labels, Workspace(spark, "t"), {"high": 1.0, "low": 0.0})),
    }
    for name, df in made.items():
        got = {(r["doc_id"], n, r[n]) for r in df.collect() for n in TAKEN}
        assert got <= want and (name == "mixing" or got == want), name


def test_crowded_keys_lose_no_pair(spark, monkeypatch):
    """With blocks of a few rows, the result is that of one block."""
    from plainlake.llm import near_dedup

    rows = []
    for i in range(12):  # one passage in texts of which some are alike
        words = [f"s{k}" for k in range(60)] + [f"x{i // 3}y{k}" for k in range(40)] + [f"z{i}y{k}" for k in range(6)]
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    find = lambda: {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs, Workspace(spark, "t")).collect()}
    whole = find()
    monkeypatch.setattr(near_dedup, "BLOCK", 2)
    assert find() == whole
    import brute

    assert whole == {i: x[1] for i, x in brute.near(dict(rows))[0].items()}


def test_hubs_of_a_star(spark):
    from plainlake.llm.shared import components

    edges = [(0, k) for k in range(1, 900)] + [(5000, k) for k in range(800, 1400)] + [(7000 + k, 7001 + k) for k in range(30)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "t"), "c").collect()}
    assert all(got[k] == 0 for k in [*range(1, 1400), 5000]) and all(got[7001 + k] == 7000 for k in range(30))


def test_words_of_all_lengths_score_alike():
    import numpy as np

    from plainlake.llm.language import LONGEST, letters, train

    pieces = {bytes([b]): b for b in range(256)} | {w: 300 + i for i, w in enumerate([b" th", b"the", b"in", b"ing", b"abcdefghijklmnopqrstuvwxyz", b"e" * 20])}
    model = train({"aa": {"the": 5, "thing": 3, "in": 9}, "bb": {"abcdefghijklmnopqrstuvwxyz": 2, "eeeeeeeeeeeeeeeeeeeeeeee": 4}}, pieces)
    words = [("theingabcdefghijklmnopqrstuvwxyz" + "e" * 40)[:n] for n in range(1, LONGEST + 20)]
    assert np.allclose(model.words(words), [model.word(w) for w in words], rtol=1e-9)
    assert np.isfinite(model.word("theing" * 20000)).all()
    doubled = np.array(model.word("e" * 4000)) - np.array(model.word("e" * 2000))
    assert (doubled < 0).all()
    assert letters("ab\u0301c x\u00b2y \u2167z") == ["ab", "c", "x", "y", "z"] and letters("a1b_c") == ["a", "b", "c"]


def test_rates_are_the_least_squares_solution(spark):
    import numpy as np

    from plainlake.llm.mixing import fit_rates

    rng = np.random.default_rng(4)
    p = rng.dirichlet([0.4, 0.4, 0.4], 200)
    n, c = rng.integers(1, 50, 200), rng.integers(1, 4, 200)
    targets, ridge = [0.7, 0.3, 0.0], 1e-3
    rows = spark.createDataFrame([(i, int(c[i]), int(n[i]), *map(float, p[i])) for i in range(200)], "id long, c long, n long, p0 double, p1 double, p2 double")
    got = np.array([r["rate"] for r in fit_rates(rows, targets, ridge=ridge).orderBy("id").collect()])
    w = c * n / (c * n).sum()
    x = np.ones(200)
    for _ in range(60000):  # plain projected gradient on the same sum of squares
        x = np.maximum(0, x - 0.5 * (p @ ((w * x) @ p - targets) + ridge * (x - 1)))
    assert np.abs(got - x).max() < 1e-3 and got.min() == 0


def test_alignments_against_all_pairs(spark):
    """Every pair that some shift aligns is in one component."""
    import numpy as np

    import brute
    from plainlake.llm.audio import LEAST_FRAMES, MOST_ERRORS, align, encode, fingerprint, tones

    rng = np.random.default_rng(8)
    songs = []
    for _ in range(14):
        v = rng.standard_normal(48)
        songs += [tones(v), tones(v + 0.05 * rng.standard_normal(48)), tones(v)[256 * int(rng.integers(1, 40)) :]]
    prints = [fingerprint(s, 4000) for s in songs]

    def alike(a, b):
        for shift in range(-len(b) + 40, len(a) - 39):
            x, y = a[max(shift, 0) :], b[max(-shift, 0) :]
            n = min(len(x), len(y))
            if n >= max(LEAST_FRAMES, 40) and np.bitwise_count(x[:n] ^ y[:n]).sum() <= MOST_ERRORS * 32 * n:
                return True
        return False

    links = [(i, j) for i in range(len(songs)) for j in range(i) if alike(prints[i], prints[j])]
    want = brute.find_groups(range(len(songs)), links)
    rows = align(spark.createDataFrame([(i, encode(s, 4000)) for i, s in enumerate(songs)], "id long, media binary"), Workspace(spark, "t")).collect()
    got = {r["id"]: r["component_id"] for r in rows}
    assert len(links) > 20 and sum(got[a] == got[b] for a, b in links) >= 0.95 * len(links)
    assert all(want[i] == want[c] for i, c in got.items())
    empty = spark.createDataFrame([], "id long, media binary")
    assert align(empty, Workspace(spark, "t")).count() == 0


def test_very_long_texts(spark, tmp_path):
    """Texts of megabytes, in every operator on texts."""
    from plainlake.llm.bpe import encode_decode
    from plainlake.llm.chat import digests, format_windows, read_windows
    from plainlake.llm.language import fit, identify
    from plainlake.llm.line_dedup import dedup_lines
    from plainlake.llm.mixing import mix
    from plainlake.llm.near_dedup import near_duplicates
    from plainlake.llm.queries import tokenizer_path
    from plainlake.llm.repeats import remove_repeats
    from plainlake.llm.token_counts import count_tokens

    text = "\n".join(f"line {i} of the long text is the {i * i % 9973}th of them all" for i in range(40000))
    docs = spark.createDataFrame([(0, text), (1, text + " end"), (2, "x" * 500_000), (3, "short")], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in near_duplicates(docs, Workspace(spark, "t")).collect()} == {0: 0, 1: 0, 2: 2, 3: 3}
    gone = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in remove_repeats(docs, Workspace(spark, "t")).collect()}
    assert gone == {0: (len(text), 1), 1: (len(text), 1), 2: (500_000, 1), 3: (0, 0)}
    assert [r["n_dropped"] for r in dedup_lines(docs, Workspace(spark, "t"), least_docs=2).orderBy("doc_id").collect()] == [39999, 0, 0, 0]
    path = tokenizer_path()
    n = [r["n_tokens"] for r in count_tokens(spark, docs, path, f"file://{tmp_path}/c").orderBy("doc_id").collect()]
    assert n == [len(r["ids"]) for r in encode_decode(docs, path).orderBy("doc_id").collect()] and n[0] > 400_000
    model = fit(docs.withColumn("lang", F.lit("en")), {bytes([b]): b for b in range(256)})
    assert {r["lang_pred"] for r in identify(docs, model).collect()} == {"en"}
    labels = spark.createDataFrame([(0, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    assert mix(docs, labels, Workspace(spark, "t")).count() == 4
    turns = docs.select(F.lit(1).alias("conv_id"), F.col("doc_id").alias("turn"), F.lit("user").alias("role"), "text")
    assert digests(read_windows(format_windows(turns, Workspace(spark, "t")))).first()["n_turns"] == 4


def test_the_classifier_finds_its_domains(spark):
    """Learned on four fifths of the labels; recall and precision of the rest."""
    from plainlake.llm.mixing import fit, label_domain, posteriors
    from plainlake.llm.shared import row_key

    sf, domains = "/root/testdata/sf0.1", ["high", "low", "toxic"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    ws = Workspace(spark, "t")
    model = fit(docs, labels.filter("doc_id % 5 > 0"), domains, ws, docs_per_domain=600)
    rest = docs.join(labels.filter("doc_id % 5 = 0"), "doc_id").withColumn("domain", label_domain())
    rows = rest.select("domain", *row_key("doc_id", "text")).join(posteriors(rest, model, domains), ["_k1", "_k2"]).collect()
    best = [(r["domain"], max(range(3), key=lambda i: r[f"p{i}"])) for r in rows]
    share = {d: sum(x == (d, k) for x in best) / sum(x[0] == d for x in best) for k, d in enumerate(domains)}
    print(share)
    assert share["high"] > 0.9 and share["low"] > 0.6 and share["toxic"] > 0.5
    called = [x for x in best if x[1] == 2]
    assert sum(x[0] == "toxic" for x in called) > 0.8 * len(called)
