"""Which of many case-insensitive regular expressions occur in which texts.

Testing every text against every pattern grows with texts x patterns.  Here each
pattern's required literals (text that any match must contain) are looked up in
an inverted index of the texts' trigrams:

1. Texts and literals are folded to lower case character by character, as Java's
   case-insensitive Unicode matching compares them.
2. Each literal is looked up by its rarest trigram only, so a frequent word that
   all patterns share produces no candidates.
3. A candidate must contain the literal; the regex runs last, and not at all for
   patterns that are plain text.

Patterns without a literal of three ASCII characters take the second path: they
are tested against every text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRAM = 3
# Every character that Java's (?iu) matches to an ASCII letter, and that letter.
_FOLD_FROM = "ABCDEFGHIJKLMNOPQRSTUVWXYZſKıİ"
_FOLD_TO = "abcdefghijklmnopqrstuvwxyzskii"
_PLAIN = re.compile(r"[^\\^$.|?*+()\[\]{}]*", re.ASCII)


def fold(c: Column) -> Column:
    """Text in the form that literals are compared in."""
    return F.translate(c, _FOLD_FROM, _FOLD_TO)


def _skip(pattern: str, i: int, opening: str, closing: str) -> int:
    """Place after the group or class that begins at ``i``; -1 if it does not end."""
    depth, in_class = 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif opening == "(" and c == "[":
            in_class += 1
        elif opening == "(" and c == "]" and in_class:
            in_class -= 1
        elif not in_class and c == opening:
            depth += 1
        elif not in_class and c == closing:
            depth -= 1
            if depth == 0:
                return i + 1
        i += 1
    return -1


def required_literals(pattern: str) -> list[str] | None:
    """For each top-level alternative, the longest folded text that its matches must contain.

    None when an alternative has none of ``GRAM`` ASCII characters, or where the
    pattern uses what is not read here (inline flags, quoting, numeric escapes).
    """
    if re.search(r"\(\?[a-zA-Z-]|\\[QxupPkNc0-9]", pattern):
        return None
    alternatives: list[list[str]] = [[""]]

    def end_run() -> None:
        if alternatives[-1][-1]:
            alternatives[-1].append("")

    i = 0
    while i < len(pattern):
        c = pattern[i]
        if c in "([":
            i = _skip(pattern, i, c, ")" if c == "(" else "]")
            if i < 0:
                return None
            end_run()
            continue
        if c in ")]}":
            return None
        if c == "|":
            alternatives.append([""])
        elif c in "*?+{":
            if c != "+":  # the character before may be absent
                alternatives[-1][-1] = alternatives[-1][-1][:-1]
            end_run()
            if c == "{":
                i = pattern.find("}", i)
                if i < 0:
                    return None
            if pattern[i + 1:i + 2] in ("?", "+"):
                i += 1
        elif c in ".^$":
            end_run()
        elif c == "\\":
            i += 1
            if i == len(pattern):
                return None
            if pattern[i].isalnum():
                end_run()
            else:
                alternatives[-1][-1] += pattern[i]
        elif c.isascii():
            alternatives[-1][-1] += c
        else:
            end_run()
        i += 1
    best = [max(runs, key=len).translate(str.maketrans(_FOLD_FROM, _FOLD_TO)) for runs in alternatives]
    return best if all(len(b) >= GRAM and b.isascii() for b in best) else None


def _grams(c: Column) -> Column:
    """Distinct trigrams of a text."""
    at = F.sequence(F.lit(1), F.greatest(F.length(c) - GRAM + 1, F.lit(1)))
    return F.array_distinct(F.filter(F.transform(at, lambda i: c.substr(i, F.lit(GRAM))), lambda g: F.length(g) == GRAM))


def constant_table(spark: SparkSession, rows: Sequence[dict], schema: dict[str, str]) -> DataFrame:
    """A small table as one local relation (Arrow type names by column), so that neither the plan nor its text grows with its rows."""
    import pyarrow as pa

    return spark.createDataFrame(pa.Table.from_pylist(list(rows), schema=pa.schema(list(schema.items()))))


def candidates(texts: DataFrame, text_col: str, patterns: Sequence[str]) -> DataFrame:
    """(text, pattern, literal, exact): texts that hold the rarest trigram of a literal of the pattern.

    ``exact``: the pattern is plain text, so holding the literal decides.  Only
    patterns with required literals take part.
    """
    rows = [{"pattern": p, "literal": x, "exact": bool(_PLAIN.fullmatch(p)) and p.isascii()} for p in dict.fromkeys(patterns) for x in dict.fromkeys(required_literals(p) or ())]
    index = constant_table(texts.sparkSession, rows, {"pattern": "string", "literal": "string", "exact": "bool"})
    wanted = index.select("literal").distinct().select("literal", F.explode(_grams(F.col("literal"))).alias("gram"))
    distinct = texts.select(F.col(text_col).alias("text")).distinct()
    held = distinct.select("text", F.explode(_grams(fold(F.col("text")))).alias("gram")).join(wanted.select("gram").distinct(), "gram", "left_semi")
    count = held.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = wanted.join(count, "gram", "left").groupBy("literal").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("g"))
    rarest = rarest.where("g.n > 0").select("literal", F.col("g.gram").alias("gram"))
    return held.join(rarest, "gram").join(index, "literal").select("text", "pattern", "literal", "exact")


def _matches(text: Column, pattern: Column) -> Column:
    return (pattern == "") | F.rlike(text, F.concat(F.lit("(?iu)"), pattern))


def matching_patterns(texts: DataFrame, text_col: str, patterns: Sequence[str]) -> DataFrame:
    """Distinct (text, pattern) where the pattern occurs in the text, by the index and the second path."""
    found = candidates(texts, text_col, patterns).where(F.contains(fold(F.col("text")), F.col("literal")))
    found = found.where(F.col("exact") | _matches(F.col("text"), F.col("pattern"))).select("text", "pattern").distinct()
    rest = [p for p in dict.fromkeys(patterns) if required_literals(p) is None]
    if not rest:
        return found
    every = F.from_json(F.lit(json.dumps(rest)), "array<string>")
    others = texts.select(F.col(text_col).alias("text")).distinct().select("text", F.explode(F.filter(every, lambda p: _matches(F.col("text"), p))).alias("pattern"))
    return found.unionByName(others)
