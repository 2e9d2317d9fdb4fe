from jobweave.llm import quality_rules as rules

from .helpers import EDGE_TEXTS, WORD, table


def measure(text):
    text = text or ""
    w = WORD.findall(text)
    grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    seen = {}
    for g in grams:
        seen[g] = seen.get(g, 0) + 1
    covered = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_measures_against_plain_python(spark):
    texts = EDGE_TEXTS + ["a b c d e a b c d e", "a a a a a a b a a a a a", "p q r s t u p q r s t v p q r s t"] + table("documents").text.tolist()
    rows = rules.judge(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = measure(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (r.kept and r.base_failed)


def test_table_decides(spark):
    df = spark.createDataFrame([(1, "the cat sat on the mat and saw a dog go by"), (2, "the cat #1 #2 #3 #4 #5 on a mat in the sun")], "doc_id long, text string")
    assert {r.doc_id: r.kept for r in rules.judge(df).collect()} == {1: True, 2: False}
    assert {r.doc_id: r.kept for r in rules.judge(df, ()).collect()} == {1: True, 2: True}


def test_one_projection(spark):
    plan = rules.judge(spark.createDataFrame([(1, "x")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_clean_documents_stay():
    clean = rules.RULES
    assert {r.name for r in clean} >= {"symbol_ratio", "stop_word_ratio", "duplicate_line_ratio", "word_length"}
