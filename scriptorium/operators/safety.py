"""Profanity by a lexicon of severities: whole words, found once among a text's runs of word characters, and phrases."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from scriptorium.functions import lexicons as L
from scriptorium.functions.dialect import Dialect
from scriptorium.operators.text import Step

LEVELS = ("extreme", "moderate", "mild")
SCORES = {"extreme": 3, "moderate": 2, "mild": 1}
_WORD = r"[\p{L}\p{M}\p{N}_]"
_REST = r"[^\p{L}\p{M}\p{N}_]"
Lexicon = Mapping[str, Sequence[str]]


def _parted(words: Sequence[str]) -> tuple[list[str], list[str]]:
    """Entries that are one run of word characters, and those that aren't (phrases and masked spellings)."""
    lone = [w for w in words if re.fullmatch(r"\S+", w) and not re.search(r"[*$@\-.']", w)]
    return sorted({w.lower() for w in lone}), sorted({w.lower() for w in words if w not in lone}, key=lambda w: (-len(w), w))


def _pattern(entry: str) -> str:
    """A phrase as a pattern; ``$`` and ``@`` also stand for the letters that they are written for."""
    out = re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", entry).replace(r"\$", r"[$s]").replace("@", "[@a]")
    return re.sub(r"\s+", " +", out)


def _found(d: Dialect, words: Sequence[str]) -> str:
    """Distinct surface forms of a severity's entries."""
    lone, phrases = _parted(words)
    out = d.filter("prof_runs", "w_", d.among("lower(w_)", lone)) if lone else d.filter("prof_runs", "w_", "false")
    if phrases:
        pattern = f"(?i)(?:^|{_REST})({'|'.join(map(_pattern, phrases))})(?:{_REST}|$)"
        out = d.concat_arrays(out, d.find_all("text", pattern, 1))
    return d.distinct(out)


def profanity(d: Dialect, lexicon: Lexicon | None = None) -> Sequence[Step]:
    """Distinct surface forms by severity, their number, the largest severity and its score."""
    lexicon = lexicon or L.profane()
    return [
        {"prof_runs": d.find_all("text", d.runs(_WORD, "[A-Za-z0-9_]"))},
        {s: _found(d, lexicon[s]) for s in LEVELS},
        {f"n_{s}": d.size(s) for s in LEVELS},
        {
            "profane_words": d.long(" + ".join(f"n_{s}" for s in LEVELS)),
            "severity_score": d.long("CASE WHEN n_extreme > 0 THEN 3 WHEN n_moderate > 0 THEN 2 WHEN n_mild > 0 THEN 1 ELSE 0 END"),
            "max_severity": "CASE WHEN n_extreme > 0 THEN 'extreme' WHEN n_moderate > 0 THEN 'moderate' WHEN n_mild > 0 THEN 'mild' END",
            "detected_words": d.sorted(d.concat_arrays(*LEVELS)),
        },
        {"has_profanity": "profane_words > 0"},
    ]


def is_safe(most: str = "extreme") -> str:
    """Whether a text's score is within a severity; the default lets everything through."""
    return f"severity_score <= {SCORES[most]}"


def profanity_statistics(d: Dialect, lexicon: Lexicon | None = None) -> Sequence[Step]:
    return [
        *profanity(d, lexicon),
        {"total_words": d.long(d.n_words("text"))},
        {"profanity_percentage": f"CASE WHEN total_words > 0 THEN {d.double('profane_words')} / total_words * 100e0 ELSE 0e0 END", "is_safe": "NOT has_profanity OR severity_score = 1"},
    ]


def _rewritten(d: Dialect, out: str, lexicon: Lexicon | None, word: str, phrase: str) -> Sequence[Step]:
    """Each profane word by ``word``, an expression over ``p_``; phrases before, by the text ``phrase``."""
    lexicon = lexicon or L.profane()
    lone, phrases = _parted([w for s in LEVELS for w in lexicon[s]])
    whole = "text"
    if phrases:
        whole = d.replace_all(whole, f"(?i)(^|{_REST})(?:{'|'.join(map(_pattern, phrases))})({_REST}|$)", f"$1{phrase}$2")
    return [
        {f"{out}_parts": d.find_all(whole, f"{_WORD}+|{_REST}+")},
        {out: d.join(d.map(f"{out}_parts", "p_", f"CASE WHEN {d.among('lower(p_)', lone)} THEN {word} ELSE p_ END"), "")},
    ]


def masked(d: Dialect, lexicon: Lexicon | None = None, keep_ends: bool = True, mark: str = "*") -> Sequence[Step]:
    """Each profane word masked but for its first and last character; a phrase becomes three marks."""
    stars = lambda n: f"repeat({d.text(mark)}, {n})"
    n = "length(p_)"
    ends = f"concat(substr(p_, 1, 1), {stars(f'{n} - 2')}, substr(p_, {n}, 1))"
    hidden = f"CASE WHEN {n} > 2 THEN {ends} ELSE {stars(n)} END" if keep_ends else stars(n)
    return _rewritten(d, "masked", lexicon, hidden, mark * 3)


def removed(d: Dialect, lexicon: Lexicon | None = None, by: str = "") -> Sequence[Step]:
    """Each profane word or phrase replaced."""
    return _rewritten(d, "removed", lexicon, d.text(by), by)
