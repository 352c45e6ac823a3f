"""String helpers with the semantics of Python's ``str`` methods and ``re``.

Java's ``\\s``, ``\\w`` and ``\\b`` are ASCII by default and ``trim`` removes
blanks only, so the character classes are spelled out once, here.
"""

from __future__ import annotations

from functools import reduce
from typing import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Members of the classes, without the brackets, so they can be combined.
SPACE = r"\t-\r\x1c- \x{85}\p{Z}"
WORD = r"\p{L}\p{N}_"
# The same white space as a plain list of characters.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# A neighbour that is no word character: what stands on the far side of \b.
NOT_WORD = rf"[^{WORD}]"


def ws(extra: str = "") -> str:
    """Bracketed class of white space plus ``extra`` members."""
    return f"[{SPACE}{extra}]"


def let(c: Column, body: Callable[[Column], Column]) -> Column:
    """``body(c)`` with ``c`` computed once, however often body uses it.

    Long rewrite chains that test and replace the same value would otherwise
    repeat the whole chain at every mention.
    """
    return F.transform(F.array(c), body)[0]


def strip(c: Column) -> Column:
    """``str.strip()``: every kind of white space, at both ends.

    Trimming looks at the ends only; a pattern would scan the whole text.
    """
    return F.btrim(c, F.lit(SPACES))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(SPACES))


def strip_chars(c: Column, members: str) -> Column:
    """``str.strip(chars)``."""
    return F.btrim(c, F.lit(members))


def lstrip_chars(c: Column, members: str) -> Column:
    return F.ltrim(c, F.lit(members))


def rstrip_chars(c: Column, members: str) -> Column:
    return F.rtrim(c, F.lit(members))


def nullif_empty(c: Column) -> Column:
    """NULL for an empty text; a pattern inside ``c`` is matched once."""
    return let(c, lambda v: F.when(v != "", v))


def first_match(c: Column, pattern: str, group: int = 1) -> Column:
    """Group of the first match, NULL if there is none (or it is empty)."""
    return nullif_empty(F.regexp_extract(c, pattern, group))


def last_match(c: Column, pattern: str, group: int = 1) -> Column:
    """Group of the last of all matches, NULL if there is none."""
    return F.try_element_at(
        F.regexp_extract_all(c, F.lit(pattern), F.lit(group)), F.lit(-1)
    )


def ending_match(c: Column, lead: str, rest: str, flags: str = "s", at_word: bool = True) -> Column:
    """Group 1 of the last place where ``lead`` and ``rest`` match.

    A greedy prefix finds the last start directly, so no array of all matches
    is built. ``lead`` has a fixed width and cannot occur inside a match; it
    is tried first, and only behind it, if ``at_word``, whether a word begins
    there. That keeps the cost at places without a match to one comparison.
    """
    word_start = rf"(?<![{WORD}]{lead})" if at_word else ""
    return nullif_empty(F.regexp_extract(c, rf"(?{flags})\A.*{lead}{word_start}{rest}", 1))


def last_word_letter(c: Column, letters: str) -> Column:
    """Last of the given capital letters that stands alone as a word."""
    one = f"[{letters}]"
    pattern = rf"(?s)\A.*({one})(?<![{WORD}]{one})(?:{NOT_WORD}|\z)"
    return nullif_empty(F.regexp_extract(c, pattern, 1))


def last_between(c: Column, opening: str, closing: str) -> Column:
    """Text of the last ``opening ... closing`` pair, NULL if there is none.

    Cut at the closing marks, each piece but the last ends a pair if it holds
    an opening mark; the pair begins at the first one. Unlike a lazy pattern
    this reads a text with many unclosed marks only once.
    """

    def pick(pieces: Column) -> Column:
        ended = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))
        last = F.try_element_at(F.filter(ended, lambda p: F.contains(p, F.lit(opening))), F.lit(-1))
        return let(last, lambda p: after_first(p, opening))

    quoted_mark = "\\Q" + closing + "\\E"
    return let(F.when(F.contains(c, F.lit(closing)), F.split(c, quoted_mark, -1)), pick)


def replace_all(c: Column, pairs: Iterable[tuple[str, str]]) -> Column:
    """Literal replacements, one after the other."""
    return reduce(lambda acc, p: F.replace(acc, F.lit(p[0]), F.lit(p[1])), pairs, c)


def sub_all(c: Column, pairs: Iterable[tuple[str, str]]) -> Column:
    """Pattern replacements, one after the other."""
    return reduce(lambda acc, p: F.regexp_replace(acc, p[0], p[1]), pairs, c)


def remove_all(c: Column, items: Iterable[str]) -> Column:
    return replace_all(c, [(item, "") for item in items])


def lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


def split_lines(c: Column) -> Column:
    """``str.splitlines()``, except that the empty text is one empty line."""
    ends = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
    return F.split(F.regexp_replace(c, rf"(?:{ends})\z", ""), ends, -1)


def before(c: Column, marker: str) -> Column:
    """Text before the first marker, or all of it."""
    return F.substring_index(c, marker, 1)


def after_last(c: Column, marker: str) -> Column:
    """Text after the last marker, or all of it."""
    return F.substring_index(c, marker, -1)


def after_first(c: Column, marker: str) -> Column:
    """Text after the first marker, NULL if it does not occur."""
    at = F.instr(c, marker)
    return F.when(at > 0, c.substr(at + len(marker), F.length(c)))


def squeeze(c: Column) -> Column:
    """``" ".join(s.split())``."""
    return F.array_join(words(c), " ")


def words(c: Column) -> Column:
    """``s.split()``."""
    return F.filter(F.split(c, ws() + "+", -1), lambda w: w != "")


def middle_truncate(c: Column, limit: int) -> Column:
    """Keep both ends of texts longer than ``limit``."""
    half = limit // 2
    cut = F.concat(F.substring(c, 1, half), F.lit("...(truncated) ..."), F.right(c, F.lit(half)))
    return F.when(F.length(c) <= limit, c).otherwise(cut)


def quoted(c: Column) -> Column:
    """A column's text as a literal inside a pattern."""
    return F.concat(F.lit(r"\Q"), c, F.lit(r"\E"))


def rstrip_newline(c: Column) -> Column:
    """Without the final line break, if there is one."""
    return F.regexp_replace(c, r"\n\z", "")


def valid_json(c: Column) -> Column:
    """The text if it is one JSON value and nothing else, NULL otherwise.

    Spark's parser stops behind the first value and ignores the rest. Inside
    an array and inside an object the rest would have to be valid as well,
    and no rest is valid in both.
    """

    def check(t: Column) -> Column:
        item = F.try_parse_json(F.concat(F.lit("["), t, F.lit("]")))
        member = F.try_parse_json(F.concat(F.lit('{"v":'), t, F.lit("}")))
        single = F.try_variant_get(item, "$[0]", "variant").isNotNull() & F.try_variant_get(
            item, "$[1]", "variant"
        ).isNull()
        return F.when(single & member.isNotNull(), t)

    return let(c, check)


def rstrip_newline(c: Column) -> Column:
    """Without the final line break, if there is one."""
    return F.regexp_replace(c, r"\n\z", "")
