import re
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from threadloom.llm import source_audit

UPPER = {x: x + 32 for x in range(65, 91)}


def words(text):
    return [x.translate(UPPER) for x in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def by_hand(rows, min_docs=30, smoothing=5, top=50):
    docs, counts, seen = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        own = words(text)
        key = (lang or "", source or "")
        seen.add(key)
        counts[key].update(own)
        docs[key[0]].update(set(own))
    result = set()
    for lang, source in seen:
        kept = sorted(t for t, n in docs[lang].items() if n >= min_docs)
        sources = [s for x, s in seen if x == lang]
        whole = Counter()
        for s in sources:
            whole.update(counts[lang, s])

        def shares(own, kept=kept):
            total = sum(own[t] for t in kept) + smoothing * len(kept)
            return [1 + 10**9 * (own[t] + smoothing) // total for t in kept]

        p, q = shares(counts[lang, source]), shares(whole)
        pairs = [(-sum(abs(a - b) for a, b in zip(p, shares(counts[lang, s]))), s.encode(), s) for s in sources if s != source]
        terms = [(b - a, t.encode(), t) for t, a, b in zip(kept, p, q) if counts[lang, source][t] and a > b]
        for part, rows_of in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
            result |= {(lang, source, part, item, -value, i) for i, (value, _, item) in enumerate(rows_of, 1)}
    return result


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\x00\x1c\x85\xa0AZaz@[`{éßÉ中😀"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_terms(text):
    assert source_audit.terms(text.encode()) == Counter(x.encode() for x in words(text))


def test_long_texts_in_pieces(monkeypatch):
    monkeypatch.setattr(source_audit, "PIECE", 7)
    text = "One two, thréé four " * 50 + "x" * 100 + " one"
    assert source_audit.terms(text.encode()) == Counter(x.encode() for x in words(text))


def test_audit_equals_one_by_hand(spark):
    rows = []
    for i in range(240):
        mark = "abcdefgh"[i % 8]
        rows.append((f"the The {'tie ' + mark * 2 + ' '} w{'xyz'[i % 3]} " * (1 + i % 5), ["en", "de", None][i % 3], [None, "hot", "s2", "ß", "Z"][i % 5 if i % 4 else 1]))
    rows += [(None, "en", "nothing"), ("", None, "nothing"), ("rare", "xx", "a"), ("rare", "xx", "b"), ("alone", "yy", "a"), ("the " * 200_000, "en", "long"), ("the", "en", "long")]
    docs = spark.createDataFrame([(r[0], r[1], r[2], 1) for r in rows], "text string, lang string, source string, term int").repartition(5)
    held, sources, terms = source_audit.HELD, source_audit.SOURCES, source_audit.TERMS
    try:
        for source_audit.SOURCES, source_audit.TERMS, source_audit.HELD, least, top in ((256, 1024, 200_000, 30, 50), (2, 3, 10, 5, 3)):
            found = source_audit.audit(docs, min_docs=least, top_terms=top)
            assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
            listed = [tuple(r) for r in found.collect()]
            assert set(listed) == by_hand(rows, least, 5, top) and len(listed) == len(set(listed))
    finally:
        source_audit.HELD, source_audit.SOURCES, source_audit.TERMS = held, sources, terms
    assert source_audit.audit(docs.limit(0)).count() == 0


def test_counts_beyond_64_bits(spark):
    row = spark.range(1).selectExpr("9000000000000L AS n", "90000000000000L AS total", "7L AS kept")
    found = row.select(source_audit.share(row["n"], row["total"], row["kept"]).alias("p")).first()["p"]
    assert found == 1 + 10**9 * (9 * 10**12 + 5) // (9 * 10**13 + 35)
