"""Text columns: tokens, quality, overlap, sentences, markers."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: letters and digits of every script, the Bengali block with its vowel signs, and the marks that join words and numbers.
TOKEN = r"[\p{L}\p{N}_\x{0980}-\x{09FF}./-]+"
BENGALI_DIGITS = "".join(chr(0x09E6 + k) for k in range(10))


def normalize_digits(text: Column) -> Column:
    """Bengali digits as others; a text without any isn't rewritten. The range is one test for a character, a class of listed ones a test for each."""
    return F.when(F.rlike(text, F.lit(r"[\x{09E6}-\x{09EF}]")), F.translate(text, BENGALI_DIGITS, "0123456789")).otherwise(text)


def _parts(pattern: str) -> list[str]:
    """A regular expression's characters, escapes and classes each as one."""
    return re.findall(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|.", pattern, re.S)


def branches(pattern: str) -> list[str]:
    """The outermost alternatives of a regular expression."""
    found, depth = [""], 0
    for part in _parts(pattern):
        depth += (part == "(") - (part == ")")
        if part == "|" and not depth:
            found.append("")
        else:
            found[-1] += part
    return found


def required(branch: str) -> str:
    """The longest run of characters that every match of an alternative holds; empty if none is sure."""
    runs, depth, counted, parts = [""], 0, False, _parts(branch)
    for part, after in zip(parts, [*parts[1:], ""], strict=True):
        depth += (part == "(") - (part == ")")
        counted = part == "{" or counted and part != "}"
        if depth or counted or part in set("()?*+{}^$.") or part.startswith("[") or re.fullmatch(r"\\\w", part) or after in ("?", "*", "{"):
            runs.append("")
        else:
            runs[-1] += part[-1]
            if after == "+":
                runs.append("")
    return max(runs, key=len)


def _spread(branch: str) -> list[str]:
    """An alternative that is one plain group between word boundaries, as one for each of the group's words."""
    group = re.fullmatch(r"(\\b)?\(\?:([\w |]+)\)(\\b)?", branch)
    return [f"{group[1] or ''}{word}{group[3] or ''}" for word in group[2].split("|")] if group else [branch]


def meets(text: Column, pattern: str) -> Column:
    """Whether a text meets a regular expression. An alternative is tried only where the text holds the characters that it can't do without, or else meets it without its word boundaries, which is sooner told."""
    known = [(b, required(b)) for whole in branches(pattern) for b in _spread(whole)]
    tests = [F.contains(text, F.lit(r)) if b == r else F.contains(text, F.lit(r)) & F.rlike(text, F.lit(b)) for b, r in known if r]
    rest = [(b, b if "(?!" in b or "(?<!" in b else b.replace(r"\b", "")) for b, r in known if not r]
    tests += [F.rlike(text, F.lit(b)) if b == loose else F.rlike(text, F.lit(loose)) & F.rlike(text, F.lit(b)) for b, loose in rest]
    return reduce(lambda a, b: a | b, tests)


def tokens(text: Column | str) -> Column:
    """Lower-cased words and numbers of any script in order, repeats included; Bengali digits are read as others; null text has none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(normalize_digits(F.coalesce(text, F.lit("")))), F.lit(TOKEN), F.lit(0))


def token_set(text: Column | str) -> Column:
    return F.array_distinct(tokens(text))


def overlap_ratio(left: Column, right: Column) -> Column:
    """Jaccard of two token sets; 0 if either is empty."""
    union = F.size(F.array_union(left, right))
    return F.when((F.size(left) == 0) | (F.size(right) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(left, right)) / union)


def characters(text: Column, kind: str) -> Column:
    """Characters of a class: what is left when the runs of others are gone. Counting each match would make a string of it."""
    return F.length(F.regexp_replace(text, f"[^{kind}]+", ""))


#: The weights and bounds of a passage's quality.
def quality_score(text: Column) -> Column:
    """How much a passage looks like prose, 0..1: length, letters, words and script, less digits and bare number lines."""
    s = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\r\f\v"))
    n = F.greatest(F.length(s), F.lit(1))
    lines = F.filter(F.transform(F.split(s, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    # A text of single bytes has no Bengali, and no letters but these.
    single, latin, digits = F.octet_length(s) == F.length(s), characters(s, "A-Za-z"), characters(s, r"\p{Nd}")
    bengali, letters = (F.when(single, many).otherwise(characters(s, kind)) for kind, many in ((r"\x{0980}-\x{09FF}", F.lit(0)), (r"\p{L}", latin)))
    word = r"\p{L}\p{N}_\x{0980}-\x{09FF}"
    bare = F.size(F.filter(lines, lambda x: F.rlike(x, F.lit(r"^[0-9 .:/()%|-]+$")))) / F.greatest(F.size(lines), F.lit(1))
    score = (
        F.least(F.length(s) / 180.0, F.lit(1.0)) * 0.25
        + F.least(letters / n / 0.45, F.lit(1.0)) * 0.35
        + F.when(F.rlike(s, F.lit(rf"\A[^{word}]*+(?:[{word}]++[^{word}]++){{27}}[{word}]")), F.lit(1.0)).otherwise(F.least(F.regexp_count(s, F.lit(rf"[{word}]+")) / 28.0, F.lit(1.0))) * 0.2
        + F.when(F.greatest(latin, bengali) >= 18, 1.0).otherwise(F.least((latin + bengali) / 18.0, F.lit(1.0))) * 0.25
        - F.least(digits / n, F.lit(1.0)) * 0.2
        - bare * 0.35
        - F.when(F.rlike(s, F.lit(r"^[0-9 .:/()%-]+$")), 0.7).otherwise(0.0)
    )
    return F.when(s == "", F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


#: Below this quality a passage isn't searched.
LOW_QUALITY = 0.22


def sentences(text: Column) -> Column:
    """Sentences end with . ! ? or a danda before white space, or at a line's end; trimmed, none empty."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), r"([.!?\x{0964}])\s+", "$1\n")
    return F.filter(F.transform(F.split(marked, "\n"), lambda x: F.trim(x)), lambda s: s != "")


def section_references(text: Column) -> Column:
    """Dotted section numbers, and numbers after the word section or article, in order, each once, years left out."""
    named = F.regexp_extract_all(F.lower(text), F.lit(r"(?:section|article)\s*([0-9]+(?:\.[0-9]+)*)"), F.lit(1))
    dotted = F.regexp_extract_all(F.lower(text), F.lit(r"\b([0-9]+\.[0-9]+(?:\.[0-9]+)*)\b"), F.lit(1))
    return F.filter(F.array_distinct(F.concat(named, dotted)), lambda m: ~F.rlike(m, F.lit("^(19|20)[0-9]{2}$")))


def strip_markup(text: Column) -> Column:
    """Text without scripts, styles and tags; white space collapsed."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?s)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"<[^>]*>", " "), r"\s+", " "))


def count_vector(text: Column, vocabulary: list[str]) -> Column:
    """Occurrences of each word of a fixed vocabulary, as a vector."""
    return F.array(*[F.regexp_count(F.lower(text), F.lit(w)).cast("double") for w in vocabulary])


def windows(text: Column, size: int, overlap: int) -> Column:
    """Windows of ``size`` code points that overlap by ``overlap``, stripped; empty ones are left out by the caller."""
    step = size - overlap
    last = F.greatest(F.ceil((F.length(text) - size) / step), F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.struct(k.alias("piece"), F.trim(F.substring(text, k * step + 1, F.lit(size))).alias("chunk")))
