"""Validation of columns, of results, and of the arguments that a plan is built with.

A rule is a pair of a name and an SQL expression that is true for a good row; ``checked`` names the first rule that a row breaks, and
``split_rejects`` parts a table into good rows and rejected ones. Nothing is raised for a row, unless ``strict`` asks for it.
"""

from __future__ import annotations

import functools
import inspect
from collections.abc import Callable, Collection, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.dialect import Dialect
from scriptorium.operators import scripts
from scriptorium.operators.text import Step

Rule = tuple[str, str]
MODES = ("preserve", "remove", "convert")
SENTIMENTS = ("negative", "neutral", "positive")


def of_type(column: str, kind: str) -> Rule:
    """That a text can be read as a type."""
    return (f"{column}_type", f"({column} IS NULL OR try_cast({column} AS {kind}) IS NOT NULL)")


def string(d: Dialect, column: str, least: int | None = None, most: int | None = None, blank: bool = True) -> list[Rule]:
    rules = [(f"{column}_missing", f"{column} IS NOT NULL")]
    if not blank:
        rules.append((f"{column}_blank", f"length({d.trim(column)}) > 0"))
    if least is not None:
        rules.append((f"{column}_short", f"length({column}) >= {least}"))
    if most is not None:
        rules.append((f"{column}_long", f"length({column}) <= {most}"))
    return rules


def number(column: str, least: float | None = None, most: float | None = None) -> list[Rule]:
    rules = [(f"{column}_missing", f"{column} IS NOT NULL")]
    if least is not None:
        rules.append((f"{column}_small", f"{column} >= {least}"))
    if most is not None:
        rules.append((f"{column}_large", f"{column} <= {most}"))
    return rules


def choice(d: Dialect, column: str, choices: Collection[str]) -> list[Rule]:
    return [(f"{column}_choice", f"coalesce({d.among(column, choices)}, false)")]


def keys(d: Dialect, column: str, required: Sequence[str]) -> list[Rule]:
    """That a JSON object in a text has keys."""
    has = (lambda k: f"coalesce(array_contains(json_object_keys({column}), '{k}'), false)") if d.name == "spark" else (lambda k: f"coalesce(list_contains(json_keys({column}), '{k}'), false)")
    return [(f"{column}_lacks_{k}", has(k)) for k in required]


def text_input(d: Dialect, column: str = "text", least: int = 1, most: int = 10_000) -> list[Rule]:
    return string(d, column, least, most, blank=False)


def request(d: Dialect, column: str = "text") -> list[Rule]:
    """The length that a request's text may have."""
    return string(d, column, 1, 5000)


def language_code(d: Dialect, column: str = "language") -> list[Rule]:
    """Two or three letters."""
    return [*string(d, column, 2, 3), (f"{column}_letters", d.matches(column, r"^\p{L}+$"))]


def supported_language(d: Dialect, column: str = "language") -> list[Rule]:
    return choice(d, column, scripts.SUPPORTED)


def confidence(column: str = "confidence") -> list[Rule]:
    return number(column, 0, 1)


def preprocessing_mode(d: Dialect, column: str = "mode") -> list[Rule]:
    return choice(d, column, MODES)


def sentiment_result(d: Dialect, label: str = "label", score: str = "confidence") -> list[Rule]:
    return [*choice(d, label, SENTIMENTS), *confidence(score)]


def toxicity_result(scores: Sequence[str]) -> list[Rule]:
    return [r for s in scores for r in confidence(s)]


def language_result(d: Dialect, language: str = "language", score: str = "confidence") -> list[Rule]:
    return [*language_code(d, language), *confidence(score)]


def checked(rules: Sequence[Rule], out: str = "problem") -> Step:
    """The first rule that a row breaks, null for a good row."""
    return {out: "CASE " + " ".join(f"WHEN NOT coalesce({good}, false) THEN '{name}'" for name, good in rules) + " END"}


def split_rejects(df: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    """Good rows as they are, and rejected ones with ``problem``."""
    marked = df.select("*", F.expr(checked(rules, "__scriptorium_problem")["__scriptorium_problem"]).alias("__scriptorium_problem"))
    good = marked.where("__scriptorium_problem IS NULL").drop("__scriptorium_problem")
    return good, marked.where("__scriptorium_problem IS NOT NULL").withColumnRenamed("__scriptorium_problem", "problem")


def strict(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``df``, which fails when it is read if a row breaks a rule."""
    problem = F.expr(checked(rules)["problem"])
    return df.where(F.when(problem.isNotNull(), F.raise_error(F.concat(F.lit("a row breaks the rule "), problem)).cast("boolean")).otherwise(True))


def validated(**tests: Callable[[object], bool]) -> Callable:
    """A decorator that tests named arguments when a plan is built; None is not tested."""

    def wrap(f: Callable) -> Callable:
        shape = inspect.signature(f)

        @functools.wraps(f)
        def call(*args, **kwargs):
            bound = shape.bind(*args, **kwargs)
            bound.apply_defaults()
            for name, test in tests.items():
                value = bound.arguments.get(name)
                if value is not None and not test(value):
                    raise ValueError(f"{f.__name__}: {name} can't be {value!r}")
            return f(*args, **kwargs)

        return call

    return wrap
