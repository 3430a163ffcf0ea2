"""Text predicates that read alike in Java's and RE2's regular expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as JavaScript's \s has it, as an explicit class.
SPACE_CLASS = "[\\t\\n\\x0B\\f\\r    -     　﻿]"
SPACES = "".join(map(chr, (*range(9, 14), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))
#: ASCII word boundaries, written out: Java's \b is Unicode.
BEFORE, AFTER = "(^|[^0-9A-Za-z_])", "([^0-9A-Za-z_]|$)"
#: The words that mark opinion, sponsoring and advertising.
BLACKLIST = ("opinion", "(é|e)ditorial", "sponsored", "advertorial", "publicit(é|y)", "partner\\s+content", "paid\\s+post")


def blacklist_pattern(unicode_boundaries: bool = False) -> str:
    """With ASCII boundaries an accented letter is no word character, so beside it a boundary needs one on the
    other side: " éditorial" and "publicité " don't match. unicode_boundaries is the evident intent."""
    if unicode_boundaries:
        return f"(?U)\\b({'|'.join(BLACKLIST)})\\b"
    plain = "|".join(w.replace("(é|e)", "e").replace("(é|y)", "y") for w in BLACKLIST)
    return f"{BEFORE}({plain}){AFTER}|[0-9A-Za-z_]éditorial{AFTER}|{BEFORE}publicité[0-9A-Za-z_]"


#: Plain pieces of which every match of a blacklist pattern holds one.
BLACKLIST_PIECES = ("opinion", "torial", "sponsored", "publicit", "partner", "paid")


def has_blacklisted(text: Column, unicode_boundaries: bool = False) -> Column:
    """Whether blacklist_pattern() matches a lower-cased text. Looking for plain pieces first and trying words before boundaries spares the pattern's two tries a character."""
    pattern = blacklist_pattern(unicode_boundaries)
    for group, around in ((BEFORE, "(?<![0-9A-Za-z_])"), (AFTER, "(?![0-9A-Za-z_])")):
        pattern = pattern.replace(group, around)
    any_piece = lambda t: reduce(or_, (F.contains(t, F.lit(p)) for p in BLACKLIST_PIECES))
    return once(text, lambda t: any_piece(t) & F.rlike(t, F.lit(pattern)))


def once(value: Column, test: Callable[[Column], Column]) -> Column:
    """test(value), with the value computed once, however often the test has it (a filter would compute it each time)."""
    return F.exists(F.array(value), test)


def pieces(text: Column) -> Column:
    """Tokens and empty strings between white spaces; splitting at one plain character is several times faster than at a class."""
    return F.split(F.translate(text, SPACES, " " * len(SPACES)), " ")


def has_word(text: Column) -> Column:
    """Whether there is a token; stops at its first character."""
    return F.rlike(text, F.lit(f"[^{SPACE_CLASS[1:]}"))


def token_count(text: Column) -> Column:
    return F.size(F.filter(pieces(text), lambda t: t != ""))


def keywords(query: str, includes: str) -> Column:
    """Lower-cased query terms of three or more characters, then the includes (parted by |)."""
    terms = F.filter(F.split(F.lower(F.coalesce(F.col(query), F.lit(""))), "\\s+"), lambda t: F.length(t) >= 3)
    return F.concat(terms, listed(includes))


def listed(column: str) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(F.col(column), F.lit(""))), "\\|"), lambda t: t != "")


def any_keyword(keys: str, title: Column, summary: Column) -> Column:
    """No keywords: true. Keywords are regular expressions."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    hit = lambda both: F.exists(keys, lambda k: F.rlike(both["title"], k) | F.rlike(both["summary"], k))
    return (F.size(keys) == 0) | once(F.struct(low(title).alias("title"), low(summary).alias("summary")), hit)
