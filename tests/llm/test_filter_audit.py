import random
from collections import Counter
from itertools import permutations

import pytest

from glossaudit.llm import filter_audit as audit

SCHEMA = "doc_id long, text string, lang string, n string"


def brute(rows, labels):
    """Applies the filters to the documents of each part, order by order."""
    good = {i for i, q, t in labels if q == 1 and i is not None}
    toxic = {i for i, q, t in labels if t == 1 and i is not None}
    least = {}
    for i, text, *_ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    docs = []
    for i, text, lang, *_ in rows:
        text = text or ""
        words = [w for w in text.translate(dict.fromkeys(b"\t\n\x0b\x0c\r", " ")).split(" ") if w]
        fails = {f for f, c in {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text), "D": any(c in "#$%&*|" for c in text),
            "E": i is not None and least[text] < i}.items() if c}
        docs.append((lang or "", fails, i in good, i in toxic))
    out = {}
    for part in {d[0] for d in docs}:
        own, shapley = [d for d in docs if d[0] == part], Counter()
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(f in d[1] for d in own) - len(gone), sum(d[1] == {f} for d in own),
                    sum(d[2] for d in gone), sum(d[3] for d in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def audited(spark, rows, labels):
    docs = spark.createDataFrame(rows, SCHEMA)
    got = audit.filter_audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    found = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley]
             for r in got}
    assert len(found) == len(got)
    return found


def test_against_all_orders_one_by_one(spark):
    draw = random.Random(3)
    texts = [None, "", " \t\n", "A b", "café " * 250, " wide "]
    for _ in range(40):
        n = draw.choice([5, 199, 200, 300])
        words = [f"w{draw.randrange(draw.choice([20, 10 ** 6]))}" for _ in range(n)]
        texts.append(draw.choice([" ", "\n", "\x0b "]).join(words) + draw.choice(["", " #", " ABCDEFGHIJ" * 4]))
    rows = [(draw.choice([None, *range(60)]), draw.choice(texts), draw.choice([None, "", "en", "de"]), "x") for _ in range(200)]
    labels = [(draw.choice([None, *range(60)]), draw.choice([0, 1, None]), draw.choice([0, 1, None])) for _ in range(50)]
    assert audited(spark, rows, labels) == brute(rows, labels)


def test_equal_texts_only(spark):
    rows = [(i, "same", "en" if i % 3 else None, None) for i in range(90)] * 2
    assert audited(spark, rows, []) == brute(rows, [])


def test_empty_table(spark):
    assert audited(spark, [], []) == {}


def test_ranks_and_intervals():
    orders = ["".join(p) for p in permutations("ABCDE")]
    assert [audit.lehmer_rank(o) for o in orders] == list(range(120))
    steps = {}
    for mask, step, low, high in audit.removal_intervals():
        for rank in range(low, high):
            assert steps.setdefault((mask, rank), step) == step
    for mask in range(1, 32):
        for rank, order in enumerate(orders):
            assert steps[mask, rank] == 1 + min(order.index(f) for i, f in enumerate("ABCDE") if mask >> i & 1)


@pytest.mark.parametrize("text, mask", [("", 1), ("x " * 200, 2), ("Ab", 5), ("a|b", 9)])
def test_conditions_of_one_text(spark, text, mask):
    df = spark.createDataFrame([(text,)], "text string")
    assert df.select(audit.failed_by_text(df.text)).first()[0] == mask
