"""The corpus pipeline on small tables with nulls, empties, copies, repeats and columns whose names clash."""


import numpy as np
import pytest

import corpus_pipeline
from lodestone.llm import toxicity

NASTY = "you are a pathetic idiot and a worthless clown so shut up now"
ITEM = "the seventh lantern of the harbour was lit by a careful keeper who never counted the ships that passed below"


def words(rng, n):
    return " ".join(rng.choice(["harbour", "lamp", "keeper", "stone", "river", "cloud", "morning", "quiet", "paper", "window", "garden", "letter", "winter", "corner", "market"], n)) + f" {rng.integers(1 << 40)}"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = np.random.default_rng(1)
    rows = [(i, words(rng, 40)) for i in range(120)]
    rows += [(200 + i, f"{words(rng, 12)} {NASTY} {words(rng, 12)}") for i in range(60)]
    rows += [(300, rows[5][1]), (301, rows[5][1]), (302, rows[6][1] + " end"), (6, rows[6][1]), (303, f"{words(rng, 20)} {ITEM} {words(rng, 20)}"), (304, f'{words(rng, 20)} token = "abcdef0123456789" {words(rng, 20)}'), (305, None), (306, ""), (None, "no id at all here"), (307, " \n ")]
    folder = tmp_path_factory.mktemp("tables")
    docs = spark.createDataFrame([(i, t, "en", None, len(t) if t else 0, 1, "x", "y", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, stay int, blob string, spans string, count long")
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, 0) for i in range(0, 120, 2)] + [(200 + i, 1, 1) for i in range(0, 60, 2)] + [(None, 1, 1), (300, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (2, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows


def test_pipeline(spark, tables):
    folder, rows = tables
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), docs.schema)
        kept[name] = [r.doc_id for r in docs.collect()]
    clean = {i for i, _ in rows if i is None or not 200 <= i < 260}
    assert set(kept["toxicity"]) == clean and len(kept["toxicity"]) == len(rows) - 60
    assert set(kept["jaccard join"]) == clean - {300, 301, 302} and len(kept["jaccard join"]) == len(clean) - 3
    assert set(kept["decontamination"]) == clean - {300, 301, 302, 303} == set(kept["secrets"])
    texts = {r.doc_id: (r.text, r.n_chars, r.blob, r.spans) for r in docs.collect()}
    assert "abcdef0123456789" not in texts[304][0] and texts[304][1] == len(texts[304][0]) and texts[305][0] is None and texts[304][2:] == ("x", "y")
    pieces = corpus_pipeline.run(spark, folder).collect()
    got = {}
    for p in pieces:
        got.setdefault(p.doc_id, []).append((p.start, p.length, p.doc_tokens))
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert set(got) == set(texts)
    for i, parts in got.items():
        n = len(tokenizer.encode(texts[i][0] or "", add_special_tokens=False).ids) + 1
        assert all(d == n for _, _, d in parts) and sorted(k for a, m, _ in parts for k in range(a, a + m)) == list(range(n))


def test_pipeline_of_empty_tables(spark, tables, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tables[0]}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_toxicity_against_plain_counts(spark):
    """Every feature, ratio and score again, with dictionaries and whole n-grams in place of buckets."""
    rng = np.random.default_rng(2)
    texts = [(i, (f"{words(rng, 3)} vile" if i % 3 == 0 else words(rng, 3))) for i in range(60)] + [(100, "Ünï vile"), (101, None), (102, "ab")]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    labels = [(i, int(i % 3 == 0)) for i in range(60)]
    s = toxicity.Settings(levels=(2.0,), bucket_bits=24)
    model = toxicity.fit(d, spark.createDataFrame(labels, "doc_id long, toxic int"), s)
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    grams = {i: {t[k : k + n] for t in [(t or "").translate(fold)] for n in s.orders for k in range(len(t) - n + 1)} for i, t in texts}
    toxic, clean = ([i for i, y in labels if y == v] for v in (1, 0))
    every = sorted(set().union(*(grams[i] for i, _ in labels)))
    counts = [np.array([sum(g in grams[i] for i in ids) for g in every]) for ids in (clean, toxic)]
    scale = toxicity.ratios(*counts, len(clean), len(toxic), 2.0, s.alpha)
    slot = {g: k for k, g in enumerate(every)}
    row, col = np.array([(r, slot[g]) for r, (i, _) in enumerate(labels) for g in sorted(grams[i])]).T
    y = np.array([v for _, v in labels], dtype=float)
    # the plain optimiser, on dense rows
    x = np.zeros((len(y), len(every)))
    x[row, col] = scale[col]
    w, b, m, v = np.zeros(len(every)), np.log((y.sum() + 1) / (len(y) - y.sum() + 1)), np.zeros(len(every) + 1), np.zeros(len(every) + 1)
    for t in range(1, s.steps + 1):
        error = 1 / (1 + np.exp(-(x @ w + b))) - y
        g = np.append(x.T @ error + s.ridge * w, error.sum()) / len(y)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    want = {i: 1 / (1 + np.exp(-(sum(w[slot[g]] * scale[slot[g]] for g in grams[i] if g in slot) + b))) for i, _ in texts}
    got = {r.doc_id: r.score for r in toxicity.score(d, model).collect()}
    want |= dict.fromkeys((101, 102), (len(toxic) + 1) / (len(labels) + 2))  # without n-grams
    assert got == pytest.approx(want, abs=1e-6) and got[100] > 0.5


def test_toxicity_of_one_class(spark):
    d = spark.createDataFrame([(i, f"text {i}") for i in range(8)], "doc_id long, text string")
    model = toxicity.fit(d, spark.createDataFrame([(i, 0) for i in range(8)], "doc_id long, toxic int"))
    assert {round(r.score, 6) for r in toxicity.score(d, model).collect()} == {0.1}
