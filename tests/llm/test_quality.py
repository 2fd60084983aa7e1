import re
from collections import Counter

from assayer.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed


def test_base_counts(spark, odd, crowded, odd_rows, documents, nothing):
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    more = [(90, "a b c d e a b c d e"), (91, "a a a a a a a"), (92, " \n \n x\nx\n\nx \n"), (93, "a|b<c> é# \x85 z")]
    cases = [
        (odd, odd_rows),
        (crowded, odd_rows),
        (spark.createDataFrame(more, "doc_id long, text string"), more),
        (documents, [(r.doc_id, r.text) for r in documents.collect()]),
    ]
    for table, rows in cases:
        got = [(r["doc_id"], *(r[c] for c in columns)) for r in quality.quality(table).collect()]
        assert sorted(got, key=repr) == sorted(((i, *brute(t)) for i, t in rows), key=repr)
    assert quality.quality(nothing).count() == 0


def test_one_projection_without_python(odd):
    plan = quality.quality(odd)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Exchange|Python|Arrow|Pandas|Join", plan)


def test_prose_is_kept(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    rows = quality.quality(documents).join(labels, "doc_id").where("quality = 1 and not base_failed")
    assert rows.where("not kept").count() == 0
