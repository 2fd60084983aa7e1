"""The filter audit against the filters applied one after the other."""

import re
from collections import Counter
from itertools import permutations

from assayer.llm import audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string"
COLUMNS = ("part", "filter_order", "step", *audit.COUNTS, "shapley")


def brute(rows, labels):
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    parts = {}
    for i, text, source in rows:
        text = text or ""
        words = WORD.findall(text)
        fails = set()
        fails |= {"A"} if len(words) < 50 else set()
        fails |= {"B"} if 100 * len(set(words)) < 65 * len(words) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 5 * len(text) else set()
        fails |= {"D"} if re.search("[#$%&*|]", text) else set()
        fails |= {"E"} if i is not None and least[text] < i else set()
        parts.setdefault(source or "", []).append((i, fails))
    out, by_filter = [], Counter()
    for part, docs in parts.items():
        for order in map("".join, permutations("ABCDE")):
            left = docs
            for step, name in enumerate(order, 1):
                gone = [d for d in left if name in d[1]]
                late = [d for d in docs if name in d[1] and d not in gone]
                left = [d for d in left if name not in d[1]]
                by_filter[part, name] += len(gone)
                failing = sum(name in d[1] for d in docs)
                out.append(
                    (
                        part, order, step, len(left), len(gone), failing - len(gone), sum(d[1] == {name} for d in docs),
                        sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone),
                    )
                )
                assert late or failing == len(gone)
    return sorted((*r, by_filter[r[0], r[1][r[2] - 1]]) for r in out)


def got(docs, labels):
    return sorted(tuple(r[c] for c in COLUMNS) for r in audit.audit(docs, labels).collect())


def long(word, n):
    return " ".join(f"{word}{i}" for i in range(n))


ROWS = [
    (1, None, "a"), (2, "", "a"), (3, " \t\n", None), (None, "", ""), (None, None, None), (4, long("w", 60), "a"),
    (5, long("w", 60), "b"), (5, long("w", 60), "b"), (4, long("w", 60), "a"), (6, "x " * 100, "a"), (7, long("W", 50), "a"),
    (8, long("w", 49) + " #", "b"), (9, "A|B", "b"), (10, long("k", 30_000), "b"), (11, "w" * 300_000, "b"),
    (12, long("w", 50) + " x" * 26, "b"), (13, long("w", 50) + " x" * 28, "b"), (14, "\x85 ".join("ab" for _ in range(60)), "b"),
    (15, "\x01\x02 " * 55, "b"), (16, long("W", 50) + " $", "a"), (17, long("W", 50) + " $", "a"),
]
LABELS = [(1, 1, 0), (4, 1, 1), (4, 0, 0), (5, None, 1), (8, 0, None), (16, 1, 0), (17, 1, 1), (None, 1, 1), (99, 1, 1)]


def test_counts(spark):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    assert got(spark.createDataFrame(ROWS, SCHEMA), labels) == brute(ROWS, LABELS)
    names = "part mask n good digest failed first rank step kind sign words kept".split()
    crowded = spark.createDataFrame([(*r, *range(len(names))) for r in ROWS], SCHEMA + "".join(f", {n} long" for n in names))
    crowded_labels = spark.createDataFrame([(*r, 1, 1) for r in LABELS], "doc_id long, quality int, toxic int, part int, n int")
    assert got(crowded, crowded_labels) == brute(ROWS, LABELS)


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame(ROWS, SCHEMA), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert got(docs, labels) == brute(ROWS, [])
    assert got(docs.limit(0), labels) == []


def test_intervals_are_those_of_the_orders():
    for mask in range(32):
        fails = {f for i, f in enumerate("ABCDE") if mask >> i & 1}
        for rank, order in enumerate(map("".join, permutations("ABCDE"))):
            for step in range(1, 6):
                kinds = sorted(k for m, s, k, low, high in audit.INTERVALS if (m, s) == (mask, step) and low <= rank < high)
                earlier = fails & set(order[: step - 1])
                want = [] if earlier or order[step - 1] in fails else ["kept"]
                if order[step - 1] in fails:
                    want.append("redundant" if earlier else "removed")
                    want += ["unique_fails"] if len(fails) == 1 else []
                assert kinds == sorted(want)
