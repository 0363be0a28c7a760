"""Column functions for raw and tagged text: tokenizing, formats, gates. All stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import last_known

#: The Penn Treebank tokenization as ordered (pattern, replacement) pairs; $ refers to groups.
PTB_RULES: tuple[tuple[str, str], ...] = (
    (r'^"', "`` "),
    (r'([ (\[{<])"', "$1 `` "),
    (r"\.\.\.", " ... "),
    (r"([,;:@#\$%&])", " $1 "),
    (r"""([^.])([.])([\])}>"']*)[ \t]*$""", "$1 $2$3 "),
    (r"([?!])", " $1 "),
    (r"([\]\[(){}<>])", " $1 "),
    (r"\(", "-LRB-"),
    (r"\)", "-RRB-"),
    (r"\[", "-LSB-"),
    (r"\]", "-RSB-"),
    (r"\{", "-LCB-"),
    (r"\}", "-RCB-"),
    (r"--", " -- "),
    (r"$", " "),
    (r"^", " "),
    (r'"', " '' "),
    (r"([^'])' ", "$1 ' "),
    (r"'([sSmMdD]) ", " '$1 "),
    (r"'ll ", " 'll "),
    (r"'re ", " 're "),
    (r"'ve ", " 've "),
    (r"n't ", " n't "),
    (r"'LL ", " 'LL "),
    (r"'RE ", " 'RE "),
    (r"'VE ", " 'VE "),
    (r"N'T ", " N'T "),
    (r" ([Cc])annot ", " $1an not "),
    (r" ([Dd])'ye ", " $1' ye "),
    (r" ([Gg])imme ", " $1im me "),
    (r" ([Gg])onna ", " $1on na "),
    (r" ([Gg])otta ", " $1ot ta "),
    (r" ([Ll])emme ", " $1em me "),
    (r" ([Mm])ore'n ", " $1ore 'n "),
    (r" '([Tt])is ", " '$1 is "),
    (r" '([Tt])was ", " '$1 was "),
    (r" ([Ww])anna ", " $1an na "),
    (r"  *", " "),
    (r"^ *", ""),
)


def ptb_tokenize(line: Column) -> Column:
    """Penn Treebank tokens of one line, separated by single spaces; a trailing space stays."""
    return reduce(lambda c, rule: F.regexp_replace(c, F.lit(rule[0]), F.lit(rule[1])), PTB_RULES, line)


def duckdb_ptb(expr: str) -> str:
    """The same rules as a DuckDB expression."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    import re

    for pattern, to in PTB_RULES:
        expr = f"regexp_replace({expr}, {quote(pattern)}, {quote(re.sub(r'[$](\d)', r'\\\1', to))}, 'g')"
    return expr


def pos_format(line: Column) -> Column:
    """``word_TAG`` tokens to ``n word TAG ...``: cut at the last underscore, parentheses named, word count in front."""
    tokens = F.filter(F.split(line, r"[ \t]+"), lambda t: t != "")
    pair = lambda t: F.when(t.contains("_"), F.concat(F.regexp_extract(t, "^(.*)_([^_]*)$", 1), F.lit(" "), F.regexp_extract(t, "^(.*)_([^_]*)$", 2))).otherwise(F.concat(F.substring(t, F.lit(1), F.length(t) - 1), F.lit(" "), t))
    out = F.concat_ws(" ", F.size(tokens).cast("string"), F.array_join(F.transform(tokens, pair), " "))
    return F.replace(F.replace(out, F.lit("("), F.lit("-LRB-")), F.lit(")"), F.lit("-RRB-"))


TOO_LONG = "1 SentenceTooLong NN"


def length_gate(line: Column, max_words: int = 20, max_chars: int = 1000) -> Column:
    """A line in the counted format if it has at most so many characters and words, else a fixed mark."""
    fields = F.size(F.filter(F.split(line, r"[ \t]+"), lambda t: t != ""))
    return F.when((F.length(line) <= max_chars) & ((fields - 1) / 2 <= max_words), line).otherwise(F.lit(TOO_LONG))


def parser_lines(lines: DataFrame, text: str = "line") -> DataFrame:
    """Only score lines and trees of a parser's output."""
    return lines.filter(F.col(text).rlike(r"^PROB|^.TOP"))


def parse_filter(lines: DataFrame, *order: str, text: str = "line") -> DataFrame:
    """Trees whose last score line before them is not the failed score; marks of unparsed sentences go as well.

    A score is in force over all following lines in the order (``n`` by default), however far the next one is.
    """
    line = F.col(text)
    state = F.when(line == "PROB 0 0 0", F.lit(False)).when(line.startswith("PROB"), F.lit(True))
    known = last_known(lines, state, *(order or ("n",)), out="_ok")
    keep = ~line.startswith("PROB") & ~line.contains("SentenceTooLong") & ~line.contains("SentenceNotParsed")
    return known.filter(F.coalesce("_ok", F.lit(True)) & keep).drop("_ok")


def lm_text(line: Column) -> Column:
    """Upper case, without a closing period, between sentence marks."""
    return F.concat(F.lit("<s> "), F.regexp_replace(F.upper(line), r" \.$", ""), F.lit(" </s>"))


#: Marks that count as punctuation among foreign words; the set is a choice of this library.
PUNCTUATION = r"^[\p{Punct}]+$"


def drop_punctuation(words: Column, pattern: str = PUNCTUATION) -> Column:
    """An array of words without those that are all punctuation."""
    return F.filter(words, lambda w: ~w.rlike(pattern))


def ascii_lower(c: Column) -> Column:
    """A-Z only, as the tree tools do; other letters keep their case."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ascii_upper(c: Column) -> Column:
    return F.translate(c, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
