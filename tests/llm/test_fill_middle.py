import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from threadloom.llm import fill_middle

TEXTS = st.text(st.one_of(st.sampled_from("\n\n\nab<PSM>"), st.characters(exclude_categories=["Cs"])), max_size=80)


def by_hand(doc_id, text, seed=7, rate=100, spm_rate=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc_id, len(units), "plain", None, None, text
    if h[3] % 100 < spm_rate:
        return doc_id, len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=200), st.sampled_from([0, 1, 7, 100, 40_000]))
def test_index_is_exact_and_within_its_bound(steps, error):
    offsets = [0]
    for x in steps:
        offsets.append(offsets[-1] + x)
    index = fill_middle.fit(offsets, error)
    assert [index.offset(i) for i in range(len(index))] == offsets
    assert all(abs(index.predict(i) - x) <= error + 1 for i, x in enumerate(offsets))


def test_regular_lines_need_few_segments():
    index = fill_middle.fit(list(range(0, 800_000, 80)))
    assert len(index) == 10_000 and len(index.starts) == 1 and index.residuals.itemsize == 1


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_boundaries_are_those_of_the_units(text):
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    found = fill_middle.boundaries(text)
    assert [text[a:b] for a, b in zip(found, found[1:])] == units


def test_rows_equal_those_made_by_hand(spark):
    rows = [(i, f"{'é😀' * (i % 3)}one {i}\n" * (i % 9) + "tail" * (i % 2), "x") for i in range(300)]
    rows += [(None, "a\nb\n", None), (7, None, "x"), (7, None, "x"), (8, "", "x"), (9, "\n\n\n", "x"), (10, "has <M>\nmarker\n", "x"), (11, "almost <P\n>S>\n<\nS>\n>", "x"), (12, "word\n" * 200_000 + "z" * 300_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string").repartition(3)
    for rate, spm in ((100, 50), (40, 50), (100, 0), (100, 100), (0, 50)):
        found = fill_middle.transformed(docs, rate=rate, spm_rate=spm)
        both = found.withColumn("restored", fill_middle.restored(found["form"], found["output"])).collect()
        key = lambda r: tuple(map(str, r))
        assert sorted((tuple(r)[:-1] for r in both), key=key) == sorted((by_hand(i, t, rate=rate, spm_rate=spm) for i, t, _ in rows), key=key)
        assert sorted((str(r["doc_id"]), r["restored"]) for r in both) == sorted((str(i), t or "") for i, t, _ in rows)
    assert fill_middle.transformed(docs.limit(0)).count() == 0
