import random
from itertools import permutations

import numpy as np

from civitext.llm.filter_audit import audit_filters, subset_states

DOCS = "doc_id long, text string, lang string, mask string, n string"
LABELS = "doc_id long, quality int, toxic int"


def slow_audit(docs, labels):
    """{(part, order, step): counts} by applying every order to every document."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    bodies = [(d, t or "", p or "") for d, t, p in docs]
    fails = []
    for d, text, _ in bodies:
        words = [w for w in text.translate({c: " " for c in range(9, 14)}).split(" ") if w]
        f = set()
        f |= {"A"} if len(words) < 200 else set()
        f |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        f |= {"C"} if 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text) else set()
        f |= {"D"} if set(text) & set("#$%&*|") else set()
        f |= {"E"} if d is not None and any(e is not None and e < d and t == text for e, t, _ in bodies) else set()
        fails.append(f)
    out = {}
    for part in {p for _, _, p in bodies}:
        mine = [i for i, b in enumerate(bodies) if b[2] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [i for i in left if f in fails[i]]
                before, left = left, [i for i in left if f not in fails[i]]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(f in fails[i] for i in mine) - len(gone), sum(fails[i] == {f} for i in mine),
                    sum(bodies[i][0] in good for i in gone), sum(bodies[i][0] in toxic for i in gone),
                ]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def audited(spark, docs, labels):
    df = spark.createDataFrame([(*d, "m", "n") for d in docs], DOCS).repartition(3)
    rows = audit_filters(df, spark.createDataFrame(labels, LABELS)).collect()
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in rows}
    assert len(got) == len(rows)
    return got


def text_of(rng):
    n, kinds = rng.choice((0, 1, 199, 200, 260)), rng.choice((5, 300))
    words = [f"w{rng.randrange(kinds)}é" for _ in range(n)]
    if rng.random() < 0.3:
        words = [w.upper() for w in words]
    if rng.random() < 0.3:
        words.append(rng.choice("#$%&*|"))
    return rng.choice((" ", "\n", "\t\x0b", "  ")).join(words)


def test_all_orders_match_brute_force(spark):
    rng = random.Random(2)
    docs = [(i, text_of(rng), rng.choice(("en", "de", "", None))) for i in range(60)]
    docs += [(100 + i, docs[rng.randrange(60)][1], rng.choice(("en", "fr"))) for i in range(40)]
    docs += [(7, docs[7][1], "en"), (7, docs[7][1], "en"), (300, None, None), (301, "", "en"), (-5, None, "de"), (None, docs[3][1], "en")]
    rng.shuffle(docs)
    labels = [(i, rng.choice((0, 1, None)), rng.choice((0, 1))) for i in range(0, 140, 2)] + [(4, 1, 1), (None, 1, 1)]
    assert audited(spark, docs, labels) == slow_audit(docs, labels)


def test_thresholds(spark):
    half = " ".join(f"a{i}" for i in range(100)) + " a0" * 100  # exactly 50 percent distinct
    capitals = "A" * 3 + "b" * 97  # exactly 3 percent
    docs = [(1, half, "x"), (2, half + " a0", "x"), (3, capitals, "x"), (4, capitals + "A", "x"), (5, " \n ", "x")]
    assert audited(spark, docs, [(1, 1, 0)]) == slow_audit(docs, [(1, 1, 0)])


def test_very_long_text(spark):
    docs = [(1, "word " * 400_000, "en"), (2, " ".join(map(str, range(300_000))), "en")]
    assert audited(spark, docs, []) == slow_audit(docs, [])


def test_nothing_to_audit(spark):
    assert audited(spark, [], []) == {}


def test_walk_counts_survivors_of_every_subset():
    cells = np.random.default_rng(0).integers(0, 9, (32, 3))
    states = subset_states(cells)
    for subset in range(32):
        assert (states[subset] == cells[[m for m in range(32) if not m & subset]].sum(0)).all()
