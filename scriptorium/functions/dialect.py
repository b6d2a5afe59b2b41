"""The few spellings in which Spark SQL and DuckDB SQL differ.

Operators are written once as SQL expressions over named columns. With ``SPARK`` they are Catalyst expressions
(``pyspark.sql.functions.expr``); with ``DUCK`` the same rule becomes the text that DuckDB checks results with.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

#: Characters that Python's ``str.split`` takes as white space, for a regular expression's class.
BLANK = r" \t\n\x0B\f\r\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: A word character, for a class.
WORD = r"\p{L}\p{N}_"


def _runs(wide: str, ascii_part: str) -> str:
    """Runs of a class as Java finds them soonest: it asks a class's parts and ranges in turn, but single characters below 256 in one table.

    ``ascii_part`` is the class among the ASCII characters, which are listed one by one, in it and out of it; the others begin a run of ``wide``.
    """
    listed = lambda inside: "".join(f"\\x{i:02x}" for i in range(128) if bool(re.match(ascii_part, chr(i))) is inside)
    return rf"(?:[{listed(True)}]+|(?![{listed(False)}]){wide}+)++"


class Dialect:
    """Spark SQL."""

    name = "spark"
    #: Runs of all but white space, and of word characters.
    unblank, word = _runs(f"[^{BLANK}]", r"[^ \t-\r\x1C-\x1F]"), _runs(f"[{WORD}]", "[A-Za-z0-9_]")
    blanks = _runs(f"[{BLANK}]", r"[ \t-\r\x1C-\x1F]")
    #: What follows a class whose characters are removed: runs of them go at once.
    run = "+"

    def text(self, value: str) -> str:
        if "\\" not in value and "'" not in value:
            return f"'{value}'"
        if "'" not in value:
            return f"r'{value}'"
        if '"' not in value:
            return f'r"{value}"'
        return "concat(" + ", ".join(self.text(p) if p != "'" else "\"'\"" for p in value.replace("'", "\0'\0").split("\0") if p) + ")"

    def fn(self, var: str, body: str) -> str:
        return f"{var} -> {body}"

    def size(self, array: str) -> str:
        return f"size({array})"

    def find_all(self, text: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract_all({text}, {self.text(pattern)}, {group})"

    def replace_all(self, text: str, pattern: str, by: str) -> str:
        return f"regexp_replace({text}, {self.text(pattern)}, {self.text(by)})"

    def matches(self, text: str, pattern: str) -> str:
        return f"regexp_like({text}, {self.text(pattern)})"

    def one(self, text: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract({text}, {self.text(pattern)}, {group})"

    def filter(self, array: str, var: str, body: str) -> str:
        return f"filter({array}, {self.fn(var, body)})"

    def map(self, array: str, var: str, body: str) -> str:
        return f"transform({array}, {self.fn(var, body)})"

    def sorted(self, array: str) -> str:
        return f"array_sort({array})"

    def distinct(self, array: str) -> str:
        return f"array_sort(array_distinct({array}))"

    def array(self, items: Iterable[str]) -> str:
        return f"array({', '.join(items)})"

    def join(self, array: str, by: str) -> str:
        return f"array_join({array}, {self.text(by)})"

    def concat_arrays(self, *arrays: str) -> str:
        return f"concat({', '.join(arrays)})"

    def sha256(self, text: str) -> str:
        return f"sha2({text}, 256)"

    def long(self, value: str) -> str:
        return f"cast({value} as bigint)"

    def double(self, value: str) -> str:
        return f"cast({value} as double)"

    def n_words(self, text: str) -> str:
        """How many white-space words a text has, without an array of them."""
        return f"regexp_count({text}, {self.text(self.unblank)})"

    def runs(self, wide: str, ascii_part: str) -> str:
        """A pattern of a class's runs; ``ascii_part`` is the class among the ASCII characters."""
        return _runs(wide, ascii_part)

    def led(self, pattern: str, first: str) -> str:
        """``pattern``, sought only where one of the characters that it can begin with stands. A case is as the pattern has it."""
        return f"(?=[{first}]){pattern}"

    def likely(self, test: str, found: str, none: str) -> str:
        """``found``, which is ``none`` unless a quick test holds. Nulls stay nulls."""
        return f"CASE WHEN coalesce({test}, true) THEN {found} ELSE {none} END"

    def trim(self, text: str) -> str:
        return self.one(text, rf"(?s)\A[{BLANK}]*+(.*[^{BLANK}])", 1)

    # what both spell alike

    def words(self, text: str) -> str:
        return self.find_all(text, self.unblank)

    def word_runs(self, text: str) -> str:
        return self.find_all(text, self.word)

    def count_in(self, text: str, char_class: str) -> str:
        """How many characters of ``text`` are in a class."""
        return f"(length({text}) - length({self.without(text, char_class)}))"

    def without(self, text: str, char_class: str) -> str:
        """``text`` less the characters of a class."""
        return self.replace_all(text, f"[{char_class}]{self.run}", "")

    def among(self, value: str, items: Iterable[str]) -> str:
        return f"{value} IN ({', '.join(self.text(i) for i in items)})"

    def has_any(self, text: str, items: Iterable[str]) -> str:
        return "(" + " OR ".join(f"contains({text}, {self.text(i)})" for i in items) + ")"

    def present(self, text: str, items: Iterable[str]) -> str:
        """The items that ``text`` contains, sorted."""
        known = self.array(self.text(i) for i in sorted(items))
        return self.filter(known, "term_", f"contains({text}, term_)")

    def lookup(self, value: str, table: Mapping[str, str], default: str = "NULL") -> str:
        if not table:
            return default
        return f"CASE {value} " + " ".join(f"WHEN {self.text(k)} THEN {self.text(v)}" for k, v in table.items()) + f" ELSE {default} END"


class Duck(Dialect):
    """DuckDB SQL."""

    name = "duckdb"
    unblank, word, blanks, run = f"[^{BLANK}]+", f"[{WORD}]+", f"[{BLANK}]+", ""

    def text(self, value: str) -> str:
        return "'" + value.replace("'", "''") + "'"

    def fn(self, var: str, body: str) -> str:
        return f"lambda {var}: {body}"

    def size(self, array: str) -> str:
        return f"len({array})"

    def replace_all(self, text: str, pattern: str, by: str) -> str:
        return f"regexp_replace({text}, {self.text(pattern)}, {self.text(by.replace('$', chr(92)))}, 'g')"

    def n_words(self, text: str) -> str:
        return f"len({self.words(text)})"

    def runs(self, wide: str, ascii_part: str) -> str:
        return f"{wide}+"

    def led(self, pattern: str, first: str) -> str:
        return pattern

    def likely(self, test: str, found: str, none: str) -> str:
        return found

    def trim(self, text: str) -> str:
        return self.replace_all(text, f"^[{BLANK}]+|[{BLANK}]+$", "")

    def matches(self, text: str, pattern: str) -> str:
        return f"regexp_matches({text}, {self.text(pattern)})"

    def filter(self, array: str, var: str, body: str) -> str:
        return f"list_filter({array}, {self.fn(var, body)})"

    def map(self, array: str, var: str, body: str) -> str:
        return f"list_transform({array}, {self.fn(var, body)})"

    def sorted(self, array: str) -> str:
        return f"list_sort({array})"

    def distinct(self, array: str) -> str:
        return f"list_sort(list_distinct({array}))"

    def array(self, items: Iterable[str]) -> str:
        return f"[{', '.join(items)}]"

    def join(self, array: str, by: str) -> str:
        return f"array_to_string({array}, {self.text(by)})"

    def concat_arrays(self, *arrays: str) -> str:
        out = arrays[0]
        for a in arrays[1:]:
            out = f"list_concat({out}, {a})"
        return out

    def sha256(self, text: str) -> str:
        return f"sha256({text})"


SPARK, DUCK = Dialect(), Duck()
