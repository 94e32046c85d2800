import re
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tests.conftest import SF
from threadloom.llm import quality_rules
from threadloom.llm.queries import op9_quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def figures(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def normal(line):
    return " ".join(WORD.findall(line)).lower()


def verdicts(rows, least_docs=5, power=0.5, least=0.8):
    """Brute force: (host, text) of each row to (base_failed, kept, removed words)."""
    copies = Counter((h, t or "") for h, t in rows)
    hosts = Counter(h for h, _ in rows)
    counts = Counter((h, x) for h, t in rows for x in {normal(y) for y in (t or "").split("\n") if WORD.search(y)})
    found = {}
    for (h, t), own in copies.items():
        n, _, _, _, repeated = figures(t)
        gone = sum(len(WORD.findall(y)) for y in t.split("\n") if WORD.search(y) and counts[h, normal(y)] - own + 1 > max(least_docs, hosts[h] ** power))
        base = n < 50 or 100 * repeated > 50 * n
        found[h, t] = (base, not base and n - gone >= least * n, gone)
    return found


def columns(r):
    return r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    wanted = verdicts([(d["source"], d["text"]) for d in docs])
    found = {r["doc_id"]: r for r in op9_quality_rules(spark, SF).collect()}
    for d in docs:
        r = found[d["doc_id"]]
        assert columns(r) == figures(d["text"])
        assert (r["base_failed"], r["kept"], r["removed_words"]) == wanted[d["source"], d["text"] or ""]


def test_the_method_decides_on_real_documents(spark):
    found = op9_quality_rules(spark, "/root/testdata/sf0.01")
    assert found.where("removed_words > 0").count() > 20
    assert found.where("not base_failed and not kept").count() > 0


def test_frequent_lines_and_depleted_documents(spark):
    words = lambda k, n: " ".join(f"w{k}x{i}" for i in range(n))
    notice = " ".join(f"Notice{i}" for i in range(10))
    rows = [(i, f"{notice}\n{words(i, 60)}", "h") for i in range(30)]  # keep six sevenths of their words
    rows += [(100, f"{notice.upper()} \n{words(100, 39)}", "h"), (101, f"{notice}\n{words(101, 60)}", "other"), (102, f"{notice}\n{words(102, 60)}", None)]
    rows += [(200 + i, words(7, 80), "h") for i in range(40)]  # no evidence against each other
    rows += [(300, f"{words(7, 80)}\n{words(8, 100)}", "h")]  # but against others
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {r["doc_id"]: r for r in quality_rules.judge(docs).collect()}
    wanted = verdicts([(s, t) for _, t, s in rows])
    assert all((found[i]["base_failed"], found[i]["kept"], found[i]["removed_words"]) == wanted[s, t] for i, t, s in rows)
    assert sorted(i for i, r in found.items() if not r["kept"]) == [100, 300]
    left = {r["doc_id"]: r["text"] for r in quality_rules.cleaned(docs).collect()}
    assert left[5] == words(5, 60) and left[101] == rows[31][1] and left[210] == words(7, 80) and 100 not in left and len(left) == len(rows) - 2


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.text("ab #|\n\t\x0b é", max_size=40), st.lists(st.sampled_from(["x", "y", "z\n"]), max_size=300).map(" ".join)), min_size=20, max_size=20))
def test_figures(spark, texts):
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id long, text string, source string")
    for r in quality_rules.figures(docs).collect():
        assert columns(r) == figures(texts[r["doc_id"]])


def test_edge_cases(spark):
    rows = [(None, None, None), (1, "", "a"), (1, "", "a"), (2, "one two " * 40_000, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as kept", "2 as n_words", "3 as removed")
    found = quality_rules.judge(docs).collect()
    assert len(found) == 4 and all(r["base_failed"] and not r["kept"] for r in found)
    assert quality_rules.cleaned(docs).columns == docs.columns
    assert quality_rules.judge(docs.limit(0)).count() == 0


@pytest.mark.parametrize("names", [("id", "body", "site")])
def test_other_columns(spark, names):
    docs = spark.createDataFrame([(1, "a " * 60, "h")], f"{names[0]} long, {names[1]} string, {names[2]} string")
    assert quality_rules.judge(docs, *names).first()["n_words"] == 60
