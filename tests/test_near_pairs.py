import difflib
import random

from pyspark.sql import functions as F

from lodestone.operators import similar


def test_blocks_lose_no_near_pair(spark):
    r = random.Random(3)
    rows = []
    for n in range(90):
        base = "".join(r.choice("abeé \0z") for _ in range((5, 40, 64, 65, 90, 300)[n % 6])) if n % 3 == 0 or not rows else rows[-1][2]
        cut = r.randrange(len(base))
        rows.append((("x", "y")[n // 3 % 2], n, base[:cut] + r.choice("abq") + base[cut + r.randrange(3) :]))
    rows += [("x", 200, ""), ("y", 201, None)]
    texts = spark.createDataFrame(rows, "set_id string, n long, norm string").dropDuplicates(["set_id", "norm"])
    held = [tuple(x) for x in texts.where("norm is not null").collect()]
    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()
    want = {(s, a, b, ratio(t, u)) for s, a, t in held for s2, b, u in held if s == s2 and a != b and ratio(t, u) > 0.85}
    pairs = similar.near_pairs(texts, 0.85, size=7)
    got = [tuple(x) for x in pairs.select("set_id", "late", "early", "score").collect()]
    assert len(want) > 40 and set(got) == want and len(got) == len(want)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan  # no row for each sign of a text
    assert similar.near_pairs(texts.where(F.lit(False)), 0.85).count() == 0


def test_bounds_of_two_blocks_leave_out_only_what_cannot_be_near(monkeypatch):
    """Bags by a matrix product and by letters, and subsequences that are left early, against plain counts."""
    from collections import Counter

    import numpy as np
    import pyarrow as pa

    r = random.Random(5)
    base = ["".join(r.choice("abcdeé f") for _ in range(r.choice((0, 1, 20, 58, 60, 64)))) for _ in range(20)]
    texts = lambda: ["".join(c if r.random() > 0.1 else r.choice(("", "q", "a")) for c in r.choice(base))[:64] for _ in range(60)]
    one, two = texts(), texts()
    a, b = similar._Texts(pa.array(one)), similar._Texts(pa.array(two))
    bags = {(i, j) for i, x in enumerate(one) for j, y in enumerate(two) if 2 * (Counter(x) & Counter(y)).total() > 0.85 * (len(x) + len(y)) - 1e-6}
    got = lambda: {(at + int(i), int(j)) for at, p, q in similar._bags_allow(a, b, 0.85) for i, j in zip(p, q, strict=True)}
    assert got() >= bags and len(got()) < 60 * 60 / 2
    monkeypatch.setattr(similar, "STEPS", 0)
    assert got() >= bags

    def common(x, y):
        best = [0] * (len(y) + 1)
        for c in x:
            row = [0]
            for k, d in enumerate(y):
                row.append(max(best[k] + (c == d), best[k + 1], row[k]))
            best = row
        return best[-1]

    alphabet, signs = np.unique(np.concatenate([a.codes.ravel(), b.codes.ravel()]), return_inverse=True)
    signs = signs.reshape(-1, 64)
    masks = np.zeros((60, len(alphabet)), np.uint64)
    for t in range(64):
        masks[np.arange(60), signs[:60, t]] |= np.uint64(1) << np.uint64(t)
    masks[:, alphabet == similar.END] = 0
    p, q = (x.ravel() for x in np.mgrid[:60, :60])
    allowed = similar.subsequence_allows(masks, p, a.length[p], np.ascontiguousarray(signs[60:].T), b.length[q], q, 0.85)
    want = [2 * common(one[i], two[j]) > 0.85 * (len(one[i]) + len(two[j])) - 1e-6 for i, j in zip(p.tolist(), q.tolist(), strict=True)]
    assert allowed.tolist() == want and 10 < sum(want) < 3000
