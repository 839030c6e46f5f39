import random
import re
from itertools import permutations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scanframe.llm import filter_audit as fa

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, part string, mask string, n int"
LABELS = "doc_id long, quality int, toxic int, n int"


def brute(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    texts = [(i, t or "", p or "") for i, t, p in docs]
    out = []
    for part in {p for _, _, p in texts}:
        rows = []
        for i, t, p in texts:
            w = WORD.findall(t)
            fails = {
                "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
                "D": bool(re.search(r"[#$%&*|]", t)),
                "E": i is not None and any(j is not None and j < i and u == t for j, u, _ in texts)}
            if p == part:
                rows.append((i, {f for f, x in fails.items() if x}))
        share = dict.fromkeys("ABCDE", 0)
        found = []
        for order in permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                out_now = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                share[f] += len(out_now)
                found.append((
                    part, "".join(order), step, len(left), len(out_now), sum(f in r[1] for r in rows) - len(out_now),
                    sum(r[1] == {f} for r in rows), sum(r[0] in good for r in out_now), sum(r[0] in toxic for r in out_now), f))
        out += [(*r[:-1], share[r[-1]]) for r in found]
    return sorted(out)


def check(spark, docs, labels):
    d = spark.createDataFrame([(*r, "x", "y", 3) for r in docs], DOCS).repartition(3)
    got = fa.audit_documents(d, spark.createDataFrame([(*r, 9) for r in labels], LABELS))
    assert sorted(tuple(r) for r in got.collect()) == brute(docs, labels)
    return got


def test_against_brute_force_with_odd_rows(spark):
    rng = random.Random(1)
    docs = []
    for k in range(160):
        pool = [f"w{x}" for x in range(rng.choice([20, 150, 400]))]
        words = rng.choices(pool, k=rng.choice([0, 5, 150, 230, 300]))
        if rng.random() < 0.3:
            words = [w.upper() for w in words]
        if rng.random() < 0.2:
            words.append("#x")
        docs.append((k, " ".join(words), rng.choice(["en", "de", "", None])))
    docs += [(300 + k, docs[4][1], rng.choice(["en", "de"])) for k in range(120)]  # a large group of copies
    docs += [(4, docs[4][1], "en"), (4, docs[4][1], "fr"), (4, docs[4][1], None), (900, None, "en"), (901, "", "en"), (None, "", "de"), (None, None, "de")]
    docs += [(None, docs[4][1], "en"), (-5, "a \u000b b c \U0001F600 " * 90, "el")]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(0, 420, 2)]
    labels += [(4, 1, 0), (4, 0, 1), (4, 1, None), (None, 1, 1), (12345, 1, 1)]
    check(spark, docs, labels)


def test_no_labels_no_documents_and_one_long_text(spark):
    check(spark, [(1, "a b", "en"), (0, "x " * 200_000, None)], [])
    assert check(spark, [], [(1, 1, 1)]).columns == ["part", *fa._STEPS]


def test_the_digest_has_every_order_of_every_part(spark):
    rows = check(spark, [(1, "a", "en"), (2, "a", "de")], [(2, 1, 1)]).collect()
    assert len(rows) == 2 * 600 and len({r["filter_order"] for r in rows}) == 120
    last = [r for r in rows if r["part"] == "de" and r["filter_order"] == "ABCDE" and r["step"] == 5][0]
    assert (last["removed"], last["redundant"], last["good_lost"]) == (0, 1, 0)


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(0, 15), st.tuples(st.integers(1, 5), st.integers(0, 3), st.integers(0, 3)), max_size=9))
def test_diagram_of_other_filter_numbers(counts):
    for row in fa.audit_steps("PQRS", counts):
        order, step, kept, removed, redundant, alone, good, toxic, _ = row
        own, before = 1 << "PQRS".index(order[step - 1]), sum(1 << "PQRS".index(f) for f in order[:step - 1])
        here = [n for mask, n in counts.items() if mask & own and not mask & before]
        assert (removed, good, toxic) == tuple(sum(n[k] for n in here) for k in range(3))
        assert kept == sum(n[0] for mask, n in counts.items() if not mask & (own | before))
        assert redundant == sum(n[0] for mask, n in counts.items() if mask & own and mask & before)
        assert alone == counts.get(own, (0,))[0]


def test_swaps_keep_the_diagram_reduced():
    counts = {m: (m % 3, 0, 0) for m in range(32)}
    d = fa.Diagram("ABCDE", counts, 3)
    seen = {tuple(d.order)}
    for level in fa.adjacent_swaps(5):
        d.swap(level)
        seen.add(tuple(d.order))
        fresh = fa.Diagram("ABCDE", {sum(1 << p for p, k in enumerate(d.order) if m >> k & 1): n for m, n in counts.items()}, 3)
        assert [len(x) for x in d.levels] == [len(x) for x in fresh.levels]
        assert d.weight[d.root] == (sum(n[0] for n in counts.values()), 0, 0)
    assert len(seen) == 120


@pytest.mark.parametrize("n", [0, 1, 2, 3, 6])
def test_every_order_once(n):
    order, seen = list(range(n)), [tuple(range(n))]
    for k in fa.adjacent_swaps(n):
        order[k], order[k + 1] = order[k + 1], order[k]
        seen.append(tuple(order))
    assert len(seen) == len(set(seen)) == len(list(permutations(range(n))))
