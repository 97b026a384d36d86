"""The pattern index finds what testing every pattern against every text finds."""

import random

import pytest
from pyspark.sql import functions as F

from innsight.operators.pattern_index import candidates, fold, matching_patterns, required_literals


@pytest.mark.parametrize("pattern, literals", [
    ("hotel aurora", ["hotel aurora"]), ("Hotel (Borealis|None)", ["hotel "]), ("abc|def.*ghij", ["abc", "ghij"]), ("ab|cdef", None), ("", None), (".*", None),
    ("colou?r", ["colo"]), ("abcd*e", ["abc"]), ("abcd+e", ["abcd"]), ("ab{2}cde", ["cde"]), (r"\d+ nights", [" nights"]), (r"a\.b\.c", ["a.b.c"]), ("[abc]defg", ["defg"]),
    ("(?i)abcd", None), (r"\x41bcd", None), (r"\Qabc\E", None), ("(abc", None), ("abc)", None), ("Été Hôtel", ["tel"]), ("KISS", ["kiss"]), (r"(a\)b[)])cdef?", ["cde"]),
    ("[[abc]d]efgh", ["efgh"]), ("x(?:abc)?yzyz", ["yzyz"]), ("abc??def", ["def"]),
])
def test_required_literals(pattern, literals):
    assert required_literals(pattern) == literals


TEXTS = ["Your stay at HOTEL AURORA", "hotel aurora - reminder", "Hotel Borealis", "", "ab", "KISS me", "kiſſ", "kıss", "KİSS", "Été à l'HÔTEL", "colour color colr",
         "12 nights", "a.b.c", "axbxc", "aaa" * 400, "line\nbreak abc", "straße STRASSE", "abbcde abcde", "none", "yzyz xabcyzyz", "[x] (y) {z}", "\\ back"]
PATTERNS = ["hotel aurora", "Hotel (Borealis|None)", "abc|def.*ghij", "ab|cdef", "", ".*", "colou?r", "abcd*e", "ab{2}cde", r"\d+ nights", r"a\.b\.c", "a.b.c", "[abc]defg", "kiss", "KISS",
            "été", "HÔTEL", "^hotel", "aurora$", "(?i)stra", "strasse", "no match at all", "x(?:abc)?yzyz", r"\[x\] \(y\)", r"\\ back", "aaaa", "break abc", "h.tel"]


def test_equal_to_testing_every_pair(spark):
    texts = spark.createDataFrame([(t,) for t in TEXTS + TEXTS[:3]], "s string")
    got = sorted(map(tuple, matching_patterns(texts, "s", PATTERNS).collect()))
    pairs = spark.createDataFrame([(t, p) for t in TEXTS for p in PATTERNS], "t string, p string")
    want = pairs.where(F.expr("p = '' OR rlike(t, concat('(?iu)', p))"))
    assert got == sorted(map(tuple, want.collect()))


def test_folding_is_that_of_the_matcher(spark):
    """Every character that (?iu) matches to an ASCII one folds to it, and no other does."""
    chars = [chr(c) for c in range(1, 0x3000) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(c,) for c in chars], "c string").withColumn("f", fold(F.col("c")))
    for a in "kKsSiIaz":
        bad = df.where(F.col("c").rlike("(?iu)^" + a + "$") & (F.col("c") != "\n") != (F.col("f") == F.lit(a.lower())))
        assert bad.count() == 0, a


def test_candidates_of_many_tenants(spark):
    """2,000 patterns that share words: about as many candidates as matches, far below subjects x patterns."""
    rng = random.Random(3)
    names = [f"{rng.choice('bcdfgh')}{rng.choice('aeiou')}{rng.randrange(10 ** 6):06d}" for _ in range(2000)]
    patterns = [f"hotel {n}" if i % 3 else f"Hotel {n} (spa|resort)?" for i, n in enumerate(names)]
    subjects = spark.range(3000).select(F.concat(F.lit("Your stay at HOTEL "), F.element_at(F.array(*[F.lit(n.upper()) for n in names[:500]]), (F.col("id") % 500 + 1).cast("int")),
                                                 F.lit(" no. "), F.col("id").cast("string")).alias("s"))
    some = candidates(subjects, "s", patterns)
    n = some.count()
    assert 3000 <= n < 3000 * 2000 / 100
    assert matching_patterns(subjects, "s", patterns).count() >= 3000
