import random
import re

from assayer.llm import sanitise
from pyspark.sql import functions as F

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PARTS = [
    "a@b.c", "a", "@", ".", "b.c-d@e.f", "x_y", "1", "12", "255", "256", "0001", "+", "+1 ", "(", "555", " ", "-", "4111111111111111",
    "4111 1111 1111 1111", "é", "\U0001f600", "\n", "1.2.3.4", "10.0.0.300", "1.2.3.4.5.6", "+1 (386) 555-3733", "%", "00000000255.1.1.1",
]


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def brute(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": lambda: True,
                "ip": lambda m=m: all(int(p) <= 255 for p in m.group().split(".")),
                "card": lambda d=digits: 13 <= len(d) <= 19 and luhn(d),
                "phone": lambda d=digits: 9 <= len(d) <= 15,
            }[kind]()
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans(spark, odd_rows, nothing):
    rng = random.Random(1)
    rows = [(i + 50, "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14)))) for i in range(1500)]
    rows += odd_rows + [(20, "1 " * 20000), (21, "a" * 40000 + "@b.c"), (22, "x@y.z" * 500), (23, "a@" + "b." * 9000 + "c")]
    got = sanitise.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, [tuple(s) for s in r.base]) for r in got), key=repr) == sorted(((i, brute(t)) for i, t in rows), key=repr)
    assert sanitise.sanitise(nothing).count() == 0


def tally(rows, reach=120):
    """Disclosure of each (entity, term) with support of two documents, by brute force."""
    import math

    term = re.compile(r"[^\x20\x09-\x0D!-/:-@\[-`{-~]+")
    of_text, near = {}, {}
    for doc, text in rows:
        for t in {m.group().lower() for m in term.finditer(text)}:
            of_text[t] = of_text.get(t, 0) + 1
        spans = brute(text)
        for kind, start, end in spans:
            value = text[start:end]
            value = re.sub("[^0-9]", "", value) if kind in ("card", "phone") else value.lower()
            for at, part in ((max(0, start - reach), text[max(0, start - reach) : start]), (end, text[end : end + reach])):
                for m in term.finditer(part):
                    a, b = at + m.start(), at + m.end()
                    cut = m.start() == 0 and at > 0 or m.end() == len(part) and b < len(text)
                    if not cut and not any(s < b and e > a for _, s, e in spans):
                        near.setdefault((f"{kind}:{value}", m.group().lower()), set()).add(doc)
    holders = {}
    for (entity, _), docs in near.items():
        holders.setdefault(entity, set()).update(docs)
    total, out = len(rows), {}
    for (entity, t), docs in near.items():
        if len(docs) > 1:
            n = len(holders[entity])
            out[entity, t] = math.log(total * len(docs) / (n * of_text[t])) / math.log(total / n)
    return out


def test_terms_near_an_entity(spark):
    rng = random.Random(7)
    fill = lambda n: " ".join(rng.choice("the of and in it was on by".split()) for _ in range(n))
    rows = [(i, fill(30)) for i in range(60)]
    rows += [(100 + i, f"{fill(20)} manager Quintrell, ann.q@x.org {fill(20)}") for i in range(4)]
    rows += [(200, f"{fill(9)} bob@y.org zebra {fill(9)}"), (201, f"{fill(12)} manager {fill(9)}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    settings = sanitise.Settings()
    found = sanitise.find(docs)
    got = {(r.entity, r.term): r.disclosure for r in sanitise.disclosing(found, sanitise.mentions(found, settings), settings).collect()}
    want = {k: v for k, v in tally(rows).items() if v >= settings.generalise}
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-9 for k, v in want.items())
    assert ("email:ann.q@x.org", "quintrell") in got and not any(t == "zebra" for _, t in got)
    text = {r.doc_id: r.text for r in sanitise.clean(docs).collect()}
    assert "Quintrell" not in text[100] and "[EMAIL]" in text[100] and "zebra" in text[200]
    assert text[201] == dict(rows)[201]


def test_terms_far_from_an_entity(spark):
    rng = random.Random(8)
    fill = lambda n: " ".join(rng.choice("the of and in it was on by".split()) for _ in range(n))
    rows = [(i, fill(30)) for i in range(60)]
    rows += [(100 + i, f"Quintrell {fill(90)} by Quintrell, ann.q@x.org {fill(90)} Marlowe {fill(9)} quintrell.") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {i: t.replace("ann.q@x.org", "[EMAIL]") for i, t in rows}
    want = {i: re.sub("(?i)quintrell|marlowe", "", t) for i, t in want.items()}
    assert {r.doc_id: r.text for r in sanitise.clean(docs).collect()} == want
    places = {r.doc_id: {(s.start, s.end) for s in r.spans if s.kind == "remove"} for r in sanitise.sanitise(docs).collect()}
    assert places == {i: {m.span() for m in re.finditer("(?i)quintrell|marlowe", t)} for i, t in rows}


def test_clean_keeps_rows_and_columns(spark, crowded):
    got = sanitise.clean(crowded)
    assert got.columns == crowded.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, crowded.collect()))
    one = spark.createDataFrame([(1, "mail a@b.org or +1 (386) 555-3733.", 34)], "doc_id long, text string, n_chars int")
    row = sanitise.clean(one).first()
    assert row.text == "mail [EMAIL] or [PHONE]." and row.n_chars == len(row.text)


def test_no_python_in_the_plan(odd):
    plan = sanitise.sanitise(odd)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    assert F is not None
