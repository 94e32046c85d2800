import pytest
from pyspark.sql import functions as F

from threadloom.operators.grep import grep
from threadloom.operators.pattern import PatternError, java_pattern

#: Pattern, texts that match, texts that do not.
CASES = [
    ("[[:alpha:]]+", ["xyz", "1a"], ["12", "é"]),
    ("[[:^digit:]]", ["a"], ["12"]),
    ("(?i)ÉTÉ", ["été", "Été"], ["ete"]),
    (r"^\w+$", ["été", "a_1", "हिन्दी"], ["a b", ""]),
    (r"\d", ["٣", "3"], ["x"]),
    (r"(?-u:\d)", ["3"], ["٣"]),
    (r"\bé", ["é", "a é"], ["aé"]),
    (r"\Bb", ["ab"], ["b", "a b"]),
    (r"\p{Greek}", ["αβ"], ["ab"]),
    (r"\p{sc=Cyrillic}\P{Lu}", ["да"], ["ДА", "ab"]),
    (r"\pL\p{^L}", ["a1"], ["ab"]),
    (r"\p{Uppercase_Letter}", ["A"], ["a"]),
    (r"\p{old italic}", ["𐌀"], ["a"]),
    (r"foo\z", ["a foo"], ["foo\n", "food"]),
    ("foo$", ["foo"], ["foo\n"]),
    ("(?m)^b$", ["a\nb\nc", "b"], ["a\rb", "ab"]),
    ("(?mR)^b$", ["a\r\nb\r\nc", "a\rb"], ["ab"]),
    ("a.c", ["abc", "a\rc", "a\u2028c", "a😀c"], ["a\nc"]),
    ("(?s)a.c", ["a\nc"], ["ac"]),
    ("(?<n>a)b", ["ab"], ["a"]),
    ("(?P<n>a)b", ["ab"], ["a"]),
    ("a(?i)b", ["aB", "ab"], ["AB"]),
    ("(a(?i)b)c", ["aBc"], ["aBC"]),
    ("(?i:a)b", ["Ab"], ["AB"]),
    ("(?i)a|b", ["A", "B"], ["c"]),
    (r"\x{41}\x42\u0043\U00000044", ["ABCD"], ["abcd"]),
    (r"\x{1F600}+", ["😀😀"], ["a"]),
    ("a++b", ["aab"], ["b"]),
    ("^a{2}$", ["aa"], ["a", "aaa"]),
    ("^a{,2}$", ["", "aa"], ["aaa"]),
    ("^a{1,}?b", ["aab"], ["b"]),
    ("[a-c&&[^b]]", ["a"], ["b"]),
    ("[a-z--[aeiou]]", ["b"], ["a"]),
    ("^[a-c~~b-d]$", ["a", "d"], ["b", "c"]),
    ("[]a]", ["]", "a"], ["b"]),
    ("[^]a]", ["b"], ["]", "a"]),
    ("[a-]", ["-"], ["b"]),
    (r"[\w--\d]", ["x"], ["1"]),
    (r"[^\s\d]", ["a"], [" 1"]),
    ("[[^a]b]", ["c", "b"], ["a"]),
    (r"(?x) a b # end", ["ab"], ["a b"]),
    (r"\.\*\[\/\-", [".*[/-"], ["a"]),
    (r"a\tb", ["a\tb"], ["a b"]),
    ("(?U)a+b", ["aab"], ["b"]),
    ("()|x", ["anything"], []),
    (r"\b{start}a", ["a", "b a"], ["ba"]),
    (r"\<a\>", ["a b"], ["ab"]),
    ("straße|(?i)STRASSE", ["straße", "Strasse"], ["strase"]),
    ("{", [], []),
]
REFUSED = ["(?=a)", "(?!a)", "(?<=a)b", "(?<!a)b", r"(a)\1", "(?>a)", r"\Z", r"\K", r"\h", "(", ")", "a)", "[z-a]", "[a", "*a", "a|*", "x{2,1}", "x{a}", "(?<n>a)(?<n>b)", "(?<1>a)", "(?y)a", "(?-)a", r"\p{Nope}", r"\x{110000}", r"\xZZ", "a\\", r"\p{L", "{", r"[\w-a]x[b-\d]", "(?ii)a", "(?i", "(?i)*"]


@pytest.mark.parametrize("pattern", REFUSED)
def test_refused(pattern):
    with pytest.raises(PatternError, match="invalid regex"):
        java_pattern(pattern)


def test_hits(spark):
    cases = [(p, yes, no) for p, yes, no in CASES if p not in REFUSED]
    columns = []
    for i, (pattern, yes, no) in enumerate(cases):
        columns += [F.regexp_like(F.lit(x), F.lit(java_pattern(pattern))).alias(f"{i}-{x!r}") for x in (*yes, *no)]
    row = spark.range(1).select(F.array(*columns).alias("r")).first()["r"]
    wanted = [(p, x, k) for p, yes, no in cases for xs, k in ((yes, True), (no, False)) for x in xs]
    wrong = [(p, x, k, java_pattern(p)) for (p, x, k), found in zip(wanted, row, strict=True) if found is not k]
    assert wrong == []


def test_grep_counts(spark):
    rows = spark.createDataFrame([("user_message", "Été, l'été; ETE"), ("user_message", "hiver")], "kind string, text string")
    assert [r["occurrences"] for r in grep(rows, "(?i)été", regex=True).collect()] == [2]
    assert [r["occurrences"] for r in grep(rows, r"\p{Lu}\w+", regex=True).collect()] == [2]
    # A literal's occurrences are those of its words.
    rows = spark.createDataFrame([("user_message", x) for x in ("the leftover argv is here, leftover", "a...b ...", "an xleftover argvx")], "kind string, text string")
    assert [r["occurrences"] for r in grep(rows, "leftover argv").collect()] == [3, 1]
    assert [r["occurrences"] for r in grep(rows, "...").collect()] == [2]
    assert [r["occurrences"] for r in grep(rows, "").collect()] == [1, 1, 1]
