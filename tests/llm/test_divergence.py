"""Source divergence against sums over all terms and pairs."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lodestone.llm import divergence

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(FOLD))
        counts[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
        groups[lang or ""].add(source or "")
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        p, every = {}, Counter()
        for s in sources:
            c = counts[lang, s]
            d = sum(c[t] for t in kept) + 2 * len(kept)
            p[s] = {t: 1 + 10**9 * (c[t] + 2) // d for t in kept}
            every.update({t: c[t] for t in kept})
        d = sum(every.values()) + 2 * len(kept)
        q = {t: 1 + 10**9 * (every[t] + 2) // d for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            parts = {"pair": [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources - {s}], "term": [(f(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]}
            for part, found in parts.items():
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found) if part == "pair" or k < 10]
    return sorted(out)


def made(sources, docs, words, seed):
    draw = random.Random(seed)
    names = [f"s{i}" for i in range(sources)] + [None]
    out = []
    for k in range(docs):
        source = draw.choice(names)
        text = " ".join(draw.choice(["w", "É", "straße", "Ab"]) + chr(97 + min(25, int(draw.expovariate(0.2)))) * draw.randint(1, words) for _ in range(draw.randrange(30)))
        out.append((draw.choice([text, text, text, None, "", "1 2 _"]) if k % 9 == 0 else text, draw.choice(["en", "de", None]), source))
    return out + [("only words of their own", "xx", "a"), ("nothing shared", "xx", "b")] + [("hot " * 50, "en", "s1")] * 30


@pytest.mark.parametrize("sources,docs,bucket", [(6, 300, 4096), (70, 700, 20)])
def test_all_pairs(spark, sources, docs, bucket):
    rows = made(sources, docs, 4, sources)
    d = spark.createDataFrame([(*r, 1, "x") for r in rows], "text string, lang string, source string, n long, term string").repartition(4)
    got = sorted(tuple(r) for r in divergence.audit(d, least=5, bucket_terms=bucket).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == brute(rows, 5) and {r[0] for r in got} == {"", "de", "en", "xx"}


def test_small_tasks_and_empty(spark):
    rows = made(5, 200, 3, 1)
    d = spark.createDataFrame(rows, "text string, lang string, source string")
    total = lambda most: sorted(tuple(r) for r in divergence.counted(d, most).groupBy("lang", "source", "term").sum("n", "docs").collect())
    assert total(7) == total(10**6)
    assert divergence.audit(d.limit(0)).count() == 0
    alone = divergence.audit(spark.createDataFrame([(None, None, None)], "text string, lang string, source string"))
    assert alone.count() == 0 and alone.columns == ["lang", "source", "part", "item", "value", "rank"]


def test_exact_shares(spark):
    """Counts times 10**9 that no long holds; the column and the array agree with whole numbers."""
    pairs = [(0, 2), (10**15, 3 * 10**15), (9 * 10**14, 9 * 10**14 + 2), (8_999_999_998, 9_000_000_007), (12_345_678_901, 98_765_432_109)]
    want = [1 + 10**9 * (c + 2) // d for c, d in pairs]
    c, d = (np.array(v) for v in zip(*pairs, strict=True))
    assert divergence.shares(c, d).tolist() == want
    assert [r[0] for r in spark.createDataFrame(pairs, "c long, d long").coalesce(1).select(divergence.share(*map(divergence.F.col, ("c", "d")))).collect()] == want


def test_quadtree_is_joint():
    """Sums over leaves and priced quadrants equal sums over every cell; absent rows and stripes are priced too."""
    draw = np.random.default_rng(2)
    for nx, ny, columns in ((3, 64, 200), (64, 1, 70), (5, 5, 1)):
        grids = []
        for rows in (nx, ny):
            g = draw.integers(0, 50, (rows, columns)) * (draw.random((rows, columns)) < 0.05)
            r, c = np.nonzero(g)
            d = g.sum(1) + 2 * columns
            grids.append((g, divergence.Quadtrees(r, c, g[r, c], -(-columns // divergence.SIDE)), (d, divergence.shares(np.zeros_like(d), d))))
        (g, x, px), (h, y, py) = grids
        p, q = divergence.shares(g, px[0][:, None]), divergence.shares(h, py[0][:, None])
        want = np.array([[int(divergence.distance(a, b).sum()) for b in q] for a in p])
        assert (divergence.joint(x, y, px, py, columns, False, 2) == want).all()
        mine = divergence.joint(x, x, px, px, columns, True)
        assert all(mine[a, b] == divergence.distance(p[a], p[b]).sum() for a in range(nx) for b in range(a + 1, nx))
