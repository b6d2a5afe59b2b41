"""Financial, temporal and technical entities of a column ``text``. Arrays are sorted, so that they can be compared."""

from __future__ import annotations

from collections.abc import Sequence
from string import ascii_letters

from scriptorium.functions import lexicons as L
from scriptorium.functions.dialect import Dialect
from scriptorium.operators.text import Step

_DIGITS = "0123456789"
#: What a pattern of dates, times or relative dates can begin with.
_FIRST = {"written": "JFMASONDjfmasond", "days": "YTDytd", "relative": "LNTlnt", "in": "Ii"}
CALL = r"[\p{L}\p{N}_]+\s*\([^)]*\)"


def _none(d: Dialect) -> str:
    return "cast(array() as array<string>)" if d.name == "spark" else "cast([] as varchar[])"


def _money(d: Dialect, column: str) -> str:
    """Whether a text has a currency's sign or code at all; letters that words end in too must have a number behind."""
    low = f"lower({column})"
    signs = " OR ".join(f"contains({column}, {d.text(c)})" for c in "₹$€£¥₽₩₪₦₨")
    return f"{signs} OR contains({low}, 'inr') OR contains({low}, 'usd') OR contains({low}, 'gbp') OR " + d.matches(low, r"(?:rs\.?|eur)\s*[0-9,]")


def financial(d: Dialect) -> Sequence[Step]:
    codes = {k.lower(): v for k, v in L.CURRENCIES.items()} | {c.lower(): c for c in ("INR", "USD", "EUR", "GBP")}
    # a ticker is a whole word that white space, a comma, a full stop or the end follows
    none = _none(d)
    if d.name == "spark":
        tickers = d.find_all("text", r"(?=[ABCDEFGHIJKLMNOPQRSTUVWXYZ]{2})(?<![\p{L}\p{N}_])[A-Z]{2,5}(?=[\s,.]|$)")
    else:
        ended = d.find_all("text", r"[\p{L}\p{N}_]+(?:[\s,.]|$)")
        tickers = d.map(d.filter(ended, "w_", d.matches("w_", r"^[A-Z]{2,5}([\s,.]|$)")), "w_", d.one("w_", "^[A-Z]+"))
    part = lambda group: d.map("found_amounts", "a_", d.one("a_", L.AMOUNT, group))
    return [
        {"low_text": "lower(text)", "found_amounts": d.likely(_money(d, "text"), d.find_all("text", L.AMOUNT, 0), none)},
        {
            "currencies": d.sorted(d.map(part(1), "s_", d.lookup("lower(s_)", codes, "upper(s_)"))),
            "amounts": d.sorted(part(2)),
            "units_of_amounts": d.sorted(d.filter(part(3), "u_", "u_ <> ''")),
            "percentages": d.sorted(d.map(d.likely("contains(text, '%')", d.find_all("text", L.PERCENT, 1), none), "p_", "concat(p_, '%')")),
            "tickers": d.sorted(tickers),
            "terms": d.present("low_text", L.FINANCIAL_TERMS),
            "words_total": d.n_words("text"),
        },
        {
            "is_financial": f"words_total > 0 AND {d.double(f'{d.size("currencies")} + {d.size("amounts")} + {d.size("percentages")} + {d.size("terms")}')} / words_total >= 0.15e0"
        },
    ]


def temporal(d: Dialect) -> Sequence[Step]:
    tagged = lambda table: d.sorted(d.concat_arrays(*(d.map(d.find_all("text", d.led(p, _FIRST.get(k, _DIGITS))), "m_", f"concat({d.text(k + ':')}, m_)") for k, p in table.items())))
    # most texts have nothing of the kind, which one look tells
    none = _none(d)
    only = lambda column, hint, found: f"CASE WHEN {d.matches(column, hint)} THEN {found} ELSE {none} END"
    dated, near = r"[0-9][-/.][0-9]|\d,?\s+\d{4}", r"yesterday|today|tomorrow|(last|next|this)\s|ago|in\s+\d"
    if d.name == "spark":
        dated, near = f"(?:{dated})", f"(?:{near})"
    return [
        {"low_t": "lower(text)"},
        {
            "dates": only("text", d.led(dated, _DIGITS), tagged(L.DATES)),
            "times": only("text", "[0-9]:[0-9]", tagged(L.TIMES)),
            "relative_dates": only("low_t", d.led(near, "ytlnai"), d.sorted(d.concat_arrays(*(d.find_all("low_t", d.led(p, _FIRST.get(k, _DIGITS))) for k, p in L.RELATIVE.items())))),
            "months": d.present("low_t", L.MONTHS),
            "days": d.present("low_t", L.DAYS),
            "words_total_t": d.n_words("text"),
        },
        {"is_temporal": f"words_total_t > 0 AND {d.double(f'{d.size("dates")} + {d.size("times")} + {d.size("relative_dates")}')} / words_total_t >= 0.10e0"},
    ]


def technical(d: Dialect) -> Sequence[Step]:
    padded = "low_c"
    none = _none(d)
    domains = [f"CASE WHEN {d.has_any('low_c', terms)} THEN '{k}' ELSE '' END" for k, terms in sorted(L.TECHNICAL.items())]
    # a call begins where its name does, as a name that no bracket follows has none behind any part of it
    call = rf"(?<![{ascii_letters}{_DIGITS}_]){d.word}\s*+\([^)]*\)" if d.name == "spark" else CALL
    # the blanks around it are part of no term
    return [
        {"low_c": "concat(' ', lower(text), ' ')"},
        {
            "functions": f"CASE WHEN contains(text, '(') THEN {d.sorted(d.find_all('text', call))} ELSE {none} END",
            "scientific_numbers": f"CASE WHEN {d.matches('text', '[0-9.][eE][-+0-9]')} THEN {d.sorted(d.find_all('text', d.led(L.SCIENTIFIC, _DIGITS)))} ELSE {none} END",
            "measures": f"CASE WHEN {d.matches('text', '[0-9]')} THEN {d.sorted(d.find_all('text', d.led(L.UNITS, _DIGITS)))} ELSE {none} END",
            "keywords": d.filter(d.array(d.text(k) for k in sorted(L.KEYWORDS)), "k_", f"contains({padded}, concat(' ', k_, ' '))"),
            "domains": d.filter(d.array(domains), "x_", "x_ <> ''"),
            "words_total_c": d.n_words("text"),
        },
        {
            "is_technical": f"words_total_c > 0 AND {d.double(f'{d.size("functions")} + 2 * {d.size("keywords")} + {d.size("scientific_numbers")} + {d.size("measures")}')} / words_total_c >= 0.15e0"
        },
    ]


def marked_dates(d: Dialect, column: str = "text") -> str:
    """Dates replaced by their kind in brackets, one kind after another."""
    out = column
    for kind, pattern in L.DATES.items():
        out = d.replace_all(out, pattern, f"[DATE:{kind.upper()}]")
    return out


def without_dates(d: Dialect, column: str = "text") -> str:
    out = column
    for pattern in L.DATES.values():
        out = d.replace_all(out, pattern, "")
    return out


def marked_code(d: Dialect, column: str = "text") -> str:
    """Calls and scientific numbers replaced by placeholders."""
    return d.replace_all(d.replace_all(column, CALL, "[FUNCTION]"), L.SCIENTIFIC, "[SCIENTIFIC_NUMBER]")


def without_code(d: Dialect, column: str = "text") -> str:
    return d.replace_all(column, CALL, "")


def without_amounts(d: Dialect, column: str = "text") -> str:
    return d.replace_all(column, L.AMOUNT, "")


def expanded_amounts(d: Dialect, column: str = "text", out: str = "expanded") -> Sequence[Step]:
    """Amounts written out: the number without commas, the unit's name, the currency's code. A symbol that is no key stays as it is."""
    units = {"K": "thousand", "M": "million", "B": "billion", "T": "trillion"}
    number = f"replace({d.one('a_', L.AMOUNT, 2)}, ',', '')"
    unit, symbol = d.one("a_", L.AMOUNT, 3), d.one("a_", L.AMOUNT, 1)
    named = f"CASE WHEN {unit} = '' THEN '' ELSE concat(' ', {d.lookup(f'upper({unit})', units, f'lower({unit})')}) END"
    full = f"concat({number}, {named}, ' ', {d.lookup(symbol, L.CURRENCIES, symbol)})"
    whole = f"{out}_amounts"
    # what is between the amounts, then both in turn
    gaps = f"split({column}, {d.text(L.AMOUNT)}, -1)" if d.name == "spark" else f"string_split_regex({column}, {d.text(L.AMOUNT)})"
    if d.name == "spark":
        pairs = f"zip_with({out}_gaps, {out}_full, (g_, f_) -> concat(g_, coalesce(f_, '')))"
    else:
        pairs = f"list_transform(list_zip({out}_gaps, {out}_full), lambda z_: concat(z_[1], coalesce(z_[2], '')))"
    return [{whole: d.find_all(column, L.AMOUNT, 0), f"{out}_gaps": gaps}, {f"{out}_full": d.map(whole, "a_", full)}, {out: d.join(pairs, "")}]


def processed(d: Dialect, financial: str = "preserve", temporal: str = "preserve", technical: str = "preserve", column: str = "text") -> Sequence[Step]:
    """The three domains' handling, one after another: ``financial`` may be ``expand`` or ``remove``, ``temporal`` ``normalize`` or ``remove``, ``technical`` ``placeholder`` or ``remove``."""
    steps: list[Step] = [{"dom_0": column}]
    if financial == "expand":
        steps += [*expanded_amounts(d, "dom_0", "dom_amounts"), {"dom_1": "dom_amounts"}]
    else:
        steps.append({"dom_1": without_amounts(d, "dom_0") if financial == "remove" else "dom_0"})
    steps.append({"dom_2": {"normalize": marked_dates, "remove": without_dates}.get(temporal, lambda d, c: c)(d, "dom_1")})
    return [*steps, {"processed": {"placeholder": marked_code, "remove": without_code}.get(technical, lambda d, c: c)(d, "dom_2")}]
