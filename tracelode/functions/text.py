"""Masking of log lines and normalising of text, as column expressions."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable
from functools import cache, partial, reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode classes, and a dot that only a line feed stops.
_FLAGS = "(?Ud)"
#: Fixed patterns of the masks.
BGL_TIME = r"\d{1,4}-\d{1,2}-\d{1,2}-\d{1,2}.\d{1,2}.\d{1,2}.\d{1,6}"
IP = r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(:\d{1,5})?"
TBIRD_DATE = r"\d{2,4}\.\d{1,2}\.\d{1,2}\s"
CLOCK = r"\d{1,2}:\d{1,2}:\d{1,2}"
MONTHS = "Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?"
BLOCK = r"blk_.\d+"
#: White space of every script (fixed values).
WHITE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The classes of white space and of everything else, as the rules mean them: Java's own have not the codes 1C to 1F.
_S = f"[{WHITE}]"
_DIR = "[a-zA-Z0-9_./-]+/[a-zA-Z0-9_./-]+/[a-zA-Z0-9_./-]*"
_ROOT_DIR = "/[a-zA-Z0-9_./-]+/[a-zA-Z0-9_./-]*"

#: Fixed rules in the order in which they apply: each sees what the one before has left.
BGL_RULES = [
    (BGL_TIME, " TIME "),
    (IP, " IP "),
    (r"\d{1,4}\.\d{1,2}\.\d{1,2}", " TIME "),
    (r".\S+(?=/[0-9a-zA-Z])\S\S+", " PATH "),
    (r"\S+(?=:)(?=.*[0-9])(?=.*[a-zA-Z])\S+", " SERVER "),
    (r"\S+(?=-)(?=.*[0-9])(?=.*[a-zA-Z])\S+", " SERVER "),
    ("[A-Z0-9]{28}", " ECID "),
    ("[a-zA-Z0-9]{48}", " SERIAL "),
    (r"0[xX][0-9a-fA-F]\S+", " MEMORY "),
    ("[0-9a-fA-F]{8}", " IAR "),
    (r"\d+", " NUM "),
]
TBIRD_RULES = [
    (TBIRD_DATE, "DATE "),
    (rf"({MONTHS})\s+\d{{1,2}}\s+", "DATE "),
    (r"DATE\s.*\sDATE", "DATE ID DATE"),
    (CLOCK, "TIME"),
    (r"TIME\s\S+", "TIME ACCOUNT"),
    (r"\w+[\w.]*@\w+[\w.]*-\w+[\w.]*", "ACCOUNT"),
    (r"\w+[\w.]*@\w+[\w.]*", "ACCOUNT"),
    (_DIR, " DIR "),
    (_ROOT_DIR, " DIR "),
    (IP, "IP"),
    ("[0-9a-fA-F]{10}", "IAR"),
    (r"\[\d+\]", " NUM "),
]
HDFS_RULES = [(BLOCK, "BLK"), (IP, "IP"), (r"\d*\d", "NUM")]
RULES = {"bgl": BGL_RULES, "tbird": TBIRD_RULES, "hdfs": HDFS_RULES}
#: Words at the beginning of a normalised line that say nothing.
DROPPED = {"bgl": 3, "tbird": 3, "hdfs": 1}


def kind_of(dataset: str) -> str:
    """The family of a dataset, by its name."""
    name = dataset.lower()
    for kind, marks in (("bgl", ("bgl",)), ("tbird", ("tbird", "thunderbird")), ("hdfs", ("hdfs",))):
        if any(m in name for m in marks):
            return kind
    raise ValueError(f"no rules for {dataset}")


def _each(members: str, out: str = "") -> str:
    """The ASCII characters that a class of Python's has, one by one: Java looks these up in one table, but tries ranges one after the other."""
    return "".join(rf"\x{i:02x}" for i in range(128) if re.match(members, chr(i)) and chr(i) != out)


#: White space and everything else, in one look-up for ASCII.
_WIDE_SPACE = r"\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACE = rf"[{_each(_S)}[\x80-\x{{10ffff}}&&[{_WIDE_SPACE}]]]"
_SPACE_IN_LINE = _SPACE.replace(r"\x0a", "")
_FULL = rf"[!-~[\x80-\x{{10ffff}}&&[^{_WIDE_SPACE}]]{_each('[^!-~' + WHITE + ']')}]"
_WORD = rf"{_each('[a-zA-Z0-9_]')}[\x80-\x{{10ffff}}&&[\w]]"
_IN_DIR, _NAME = f"[{_each('[a-zA-Z0-9_./-]')}]", f"[{_each('[a-zA-Z0-9_.-]')}]"
_LETTER = _each("[a-zA-Z]")


def _server(mark: str) -> tuple[str, str]:
    """The rule of words with a mark inside, before a digit and a letter that stand anywhere later in the line.

    A match goes on where the last one has ended, over words without the mark, and over the rest of a line from the first word on whose mark has no digit or no
    letter behind it: no later one of the line has.
    """
    other = _FULL.replace("!-~", f"!-{chr(ord(mark) - 1)}{chr(ord(mark) + 1)}-~")
    word, ahead = f"{_FULL}(?>{other}*){mark}", rf"(?=[^0-9\n]*[0-9])(?=[^{_LETTER}\n]*[{_LETTER}])"
    return rf"\G((?:{_FULL}(?>{other}*)(?!{mark})|{_SPACE}|{word}(?!{ahead})[^\n]*)*+){word}{_FULL}*", "$1 SERVER "


#: Of rules whose expression reads the same words again at every step: one that begins only where a word does and says the same, and its replacement.
_ONCE = {
    r".\S+(?=/[0-9a-zA-Z])\S\S+": (rf"(?:{_SPACE_IN_LINE}|(?m:^){_FULL}){_FULL}+/[0-9a-zA-Z]{_FULL}*", " PATH "),
    r"\S+(?=:)(?=.*[0-9])(?=.*[a-zA-Z])\S+": _server(":"),
    r"\S+(?=-)(?=.*[0-9])(?=.*[a-zA-Z])\S+": _server("-"),
    r"\w+[\w.]*@\w+[\w.]*-\w+[\w.]*": (rf"(?<![.{_WORD}])(\.*)[{_WORD}][.{_WORD}]*@[{_WORD}][.{_WORD}]*-[{_WORD}][.{_WORD}]*", "$1ACCOUNT"),
    r"\w+[\w.]*@\w+[\w.]*": (rf"(?<![.{_WORD}])(\.*)[{_WORD}][.{_WORD}]*@[{_WORD}][.{_WORD}]*", "$1ACCOUNT"),
    rf"({MONTHS})\s+\d{{1,2}}\s+": (rf"(?=[ADFJMNOS])(?:{MONTHS})\s+\d{{1,2}}\s+", "DATE "),
    _DIR: (f"(?<!{_IN_DIR}){_IN_DIR}{_NAME}*/{_IN_DIR}+/{_IN_DIR}*", " DIR "),
    _ROOT_DIR: (f"(?<!{_IN_DIR})({_NAME}*)/{_IN_DIR}+/{_IN_DIR}*", "$1 DIR "),
}


#: What every match of a rule holds one of: lines without are not searched.
_NEEDED = {
    r".\S+(?=/[0-9a-zA-Z])\S\S+": ["/"],
    r"\S+(?=:)(?=.*[0-9])(?=.*[a-zA-Z])\S+": [":"],
    r"\S+(?=-)(?=.*[0-9])(?=.*[a-zA-Z])\S+": ["-"],
    r"0[xX][0-9a-fA-F]\S+": ["0x", "0X"],
}


def _where(line: Column, holds: Callable[[Column], Column], change: Callable[[Column], Column]) -> Column:
    """A changed line where a condition holds, else the line as it is; what makes the line is computed once."""
    return F.transform(F.array(line), lambda x: F.when(holds(x), change(x)).otherwise(x))[0]


def _meant(pattern: str) -> str:
    """A rule with its classes of white space, and those of letters and digits, written out."""
    for members in ("[A-Z0-9]", "[a-zA-Z0-9]", "[0-9a-fA-F]", "[0-9a-zA-Z]"):
        pattern = pattern.replace(members, f"[{_each(members)}]")
    return _FLAGS + pattern.replace(r"\S", _FULL).replace(r"\s", _SPACE)


def mask(line: Column, dataset: str) -> Column:
    """Each rule reads a line once, whatever the length of its words."""
    for rule in RULES[kind_of(dataset)]:
        pattern, name = _ONCE.get(rule[0], rule)
        change = partial(F.regexp_replace, pattern=F.lit(_meant(pattern)), replacement=F.lit(name))
        if rule[0] in _NEEDED:
            line = _where(line, lambda x, marks=_NEEDED[rule[0]]: reduce(or_, [x.contains(m) for m in marks]), change)
        else:
            line = change(line)
    return line


def _first(line: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(line, f"{_FLAGS}({pattern})", 1), F.lit(""))


def bgl_timestamp(line: Column) -> Column:
    """The first date and time of a line; null where there is none or it is no valid one."""
    return F.try_to_timestamp(_first(line, BGL_TIME), F.lit("y-M-d-H.m.s.[SSSSSS][SSSSS][SSSS][SSS][SS][S]")).cast("timestamp_ntz")


def tbird_timestamp(line: Column) -> Column:
    both = F.concat_ws(" ", F.trim(_first(line, TBIRD_DATE)), _first(line, CLOCK))
    return F.try_to_timestamp(both, F.lit("y.M.d H:m:s")).cast("timestamp_ntz")


def first_block(line: Column) -> Column:
    return _first(line, BLOCK)


@cache
def fold_table() -> tuple[str, str]:
    """For translate(): characters that decompose to one ASCII letter or bracket with marks, and marks, which go."""
    kept, letters, marks = [], [], []
    for point in range(128, sys.maxunicode + 1):
        c = chr(point)
        if 0xD800 <= point <= 0xDFFF:
            continue
        if unicodedata.category(c) == "Mn":
            marks.append(c)
            continue
        base = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        if len(base) == 1 and base != c and base.isascii() and (base.isalpha() or base in "<>"):
            kept.append(c)
            letters.append(base)
    return "".join(kept + marks), "".join(letters)


def normalize(text: Column) -> Column:
    """Lower case without accents; all but a-z, < and > become single blanks."""
    old, new = fold_table()
    folded = _where(F.lower(text), lambda x: F.octet_length(x) != F.char_length(x), lambda x: F.translate(x, old, new))  # ASCII stays as it is
    return F.trim(F.regexp_replace(folded, f"[^{_LETTER}<>]+", " "))


def drop_fields(text: Column, n: int) -> Column:
    """A normalised line without its first n words; shorter lines become empty."""
    return F.regexp_replace(text, rf"^(\S+ ?){{0,{n}}}", "")


def first_word(line: Column) -> Column:
    """What stands before the first white space, after any in front; empty for a blank line."""
    return F.regexp_extract(line, f"^[{WHITE}]*([^{WHITE}]*)", 1)


def inline_label(masked: Column) -> Column:
    """0 where the first word is a dash, else 1; null for a blank line."""
    return (F.nullif(first_word(masked), F.lit("")) != "-").cast("int")


def category_off(masked: Column) -> Column:
    """A line without its first word, unless that is a dash."""
    return F.regexp_replace(masked, f"^[{WHITE}]*(?!-(?![^{WHITE}]))[^{WHITE}]+", "")


def sentence(line: Column, dataset: str, with_label: bool) -> Column:
    """The normalised line without its leading fields.

    Test lines of line-labelled logs begin with a category word, which goes where it is not the dash of a normal line.
    """
    kind = kind_of(dataset)
    masked = mask(line, dataset)
    if with_label and kind != "hdfs":
        masked = category_off(masked)
    return drop_fields(normalize(masked), DROPPED[kind])


def record_time(line: Column, dataset: str) -> Column:
    """The line's timestamp; for block logs null, they have first_block()."""
    kind = kind_of(dataset)
    return {"bgl": bgl_timestamp, "tbird": tbird_timestamp}[kind](line) if kind != "hdfs" else F.lit(None).cast("timestamp_ntz")


def without_invalid_utf8(value: Column) -> Column:
    """Undecodable bytes go."""
    return F.replace(F.make_valid_utf8(value), F.lit("�"), F.lit(""))
