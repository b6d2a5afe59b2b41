"""Personal data by candidate gradient boosting, in built-in DataFrame functions only.

Base spans come from exact patterns and checks (leftmost, non-overlapping per kind, failing matches dropped) and always
stay. High-recall generators then look at what base spans leave of the text and propose more spans, which may overlap:
numbers that a base match ran together, national phone formats, obfuscated addresses. Boosted trees judge each proposal by
features of its format and context; they are fitted on the driver to a fixed number of made-up examples, whose features
the same column expressions compute, and become column expressions themselves. Each kind's threshold is calibrated on
examples of another make: other words, cues, formats and look-alikes than those of the fit.
A proposal that overlaps a longer (then a better) proposal of its kind is left out.

The patterns match what their plain forms match, but start only where a run starts and never give back characters,
so that a long run of digits or letters takes linear time and no stack. What is folded over a text's matches is folded in
chunks of ``CHUNK``, as a list that grows by one would be copied once for each match.

Offsets count code points from 0, ends are exclusive. Defined results: a null text counts as empty and has no spans.
Repeated rows get equal results. A null ``doc_id`` keeps its row. An empty table gives an empty result. Extra columns are
ignored by ``find`` and kept by ``redact``, whatever their names.
"""

from __future__ import annotations

import random
import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: The base patterns, as character classes of what may stand in a match.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain for a kind's patterns to be tried.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
#: Generators by kind.
GENERATORS = (
    ("card", r"(?<![0-9A-Za-z])[0-9]{12,19}(?![0-9A-Za-z])"),
    ("card", r"(?<![0-9])[0-9]{4}([ .-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}(?![0-9])"),
    ("phone", r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])"),
    ("phone", r"(?<![0-9+(.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}(?![0-9.-])"),
    ("email", r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64} ?[\[({] ?at ?[\])}] ?[a-z0-9-]{1,63}(?: ?(?:\.|[\[({] ?dot ?[\])}]) ?[a-z0-9-]{2,63}){1,4}"),
    ("ip", r"(?i)(?<![0-9.])[0-9]{1,3}(?: ?(?:[\[({]\.[\])}]|[\[({] ?dot ?[\])}]|\.) ?[0-9]{1,3}){3}(?![0-9])"),
)
#: A proposal overlaps so many others of its kind at most on each side, as there are two generators for a kind at most, and none
#: of their spans is over three times as long as another generator's shortest.
NEIGHBOURS = 8
#: What base spans are replaced with before generators look at a text.
HIDDEN = "\x01"
CHUNK = 128
CUES = (
    r"(?i)(card|visa|credit|debit|payment|karte|carte|tarjeta)",
    r"(?i)(phone|call|tel|mobile|fax|whatsapp|anruf|appel|llama)",
    r"(?i)(mail|contact|write|reach|kontakt|correo)",
    r"(?i)(ip|address|host|server|login|client)",
    r"(?i)(order|invoice|serial|isbn|id|ref|sku|version|build|release|no\.?|#)\W*$",
)
FEATURES = ("kind", "size", "digits", "luhn", "lead", "separators", "distinct", "octets", "issuer", "ending", "before", "after", "cue0", "cue1", "cue2", "cue3", "cue4")


# ------------------------------------------------------------------------------------------------ spans


# Expressions are put together as SQL text here: as Column objects, they would be thousands of calls to the JVM.


def _text(value: str) -> str:
    """A string as an SQL literal; patterns have no quotes."""
    return f"r'{value}'"


def _let(value: str, name: str, body: str) -> str:
    """``body`` of a value that is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _chunks(array: str) -> str:
    """An array in arrays of at most ``CHUNK``; null if it is empty."""
    cut = f"transform(sequence(0, cast(floor((size(a_) - 1) / {CHUNK}) as int)), k_ -> slice(a_, k_ * {CHUNK} + 1, {CHUNK}))"
    return _let(array, "a_", f"if(size(a_) > 0, {cut}, null)")


def matches(text: str, pattern: str, kind: str, shape: str, keep: str) -> str:
    """Array of ``shape``, a struct of type ``kind``, for those of a pattern's matches whose value ``v_`` meets ``keep``.

    Both speak of the struct ``m_`` of a match's ``value``, the ``gap`` of text since the match before and the ``rest`` until the
    next one, and of its ``start_`` and ``end_``.
    """
    zipped = "zip_with(f_, zip_with(slice(g_, 1, size(f_)), slice(g_, 2, size(f_)), (x_, y_) -> named_struct('gap', x_, 'rest', y_)), (x_, y_) -> named_struct('value', x_, 'gap', y_.gap, 'rest', y_.rest))"
    pairs = _let(f"regexp_extract_all({text}, {_text(pattern)}, 0)", "f_", _let(f"split({text}, {_text(pattern)}, -1)", "g_", zipped))
    start, end = "(x_.at + length(m_.gap))", "(x_.at + length(m_.gap) + length(m_.value))"
    made = f"concat(x_.spans, array({shape.replace('start_', start).replace('end_', end)}))"
    step = f"named_struct('at', {end}, 'spans', if({keep.replace('v_', 'm_.value')}, {made}, x_.spans))"
    held = "x_ -> named_struct('at', x_.at, 'spans', concat(done_.spans, array(x_.spans)))"
    inner = f"aggregate(part_, named_struct('at', done_.at, 'spans', cast(array() as array<{kind}>)), (x_, m_) -> {step}, {held})"
    zero = f"named_struct('at', 0, 'spans', cast(array() as array<array<{kind}>>))"
    return f"coalesce(aggregate({_chunks(pairs)}, {zero}, (done_, part_) -> {inner}, done_ -> flatten(done_.spans)), cast(array() as array<{kind}>))"


def rewritten(text: str, spans: str, label: str) -> str:
    """``text`` with ``label`` in place of each of the sorted ``spans``; it speaks of the span ``s_`` and of ``x_.at``, how far those before it reach."""
    reach = "greatest(done_.at, array_max(transform(part_, s_ -> s_.end)))"
    gap = "if(s_.start > x_.at, substring(b_, x_.at - done_.at + 1, s_.start - x_.at), '')"
    step = f"named_struct('at', greatest(x_.at, s_.end), 'out', concat(x_.out, {gap}, {label}))"
    held = "x_ -> named_struct('at', x_.at, 'out', concat(done_.out, array(x_.out)))"
    inner = f"aggregate(part_, named_struct('at', done_.at, 'out', ''), (x_, s_) -> {step}, {held})"
    block = _let(f"substring({text}, done_.at + 1, {reach} - done_.at)", "b_", inner)
    rest = f"done_ -> concat(array_join(done_.out, ''), substring({text}, done_.at + 1, length({text})))"
    return f"coalesce(aggregate({_chunks(spans)}, named_struct('at', 0, 'out', cast(array() as array<string>)), (done_, part_) -> {block}, {rest}), {text})"


def _digits(value: str) -> str:
    return f"regexp_replace({value}, '[^0-9]', '')"


def luhn(digits: str) -> str:
    """Whether a string of at most 19 digits passes the Luhn check."""
    each = "transform(split(reverse(d_), ''), (c_, i_) -> if(i_ % 2 = 0, coalesce(try_cast(c_ as int), 0), coalesce(try_cast(c_ as int) * 2 - if(try_cast(c_ as int) > 4, 9, 0), 0)))"
    return _let(digits, "d_", f"(length(d_) between 1 and 19 and aggregate({each}, 0, (t_, e_) -> t_ + e_) % 10 = 0)")


OCTETS = r"\A(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.(?!\z)|\z)){4}\z"
#: Numbers as card issuers give them: first digits and lengths.
ISSUERS = r"\A(?:4(?:[0-9]{12}|[0-9]{15}|[0-9]{18})|5[1-5][0-9]{14}|2[2-7][0-9]{14}|3[47][0-9]{13}|3[068][0-9]{12}|35[0-9]{14}|6(?:011|5[0-9]{2}|4[4-9][0-9]|2[0-9]{2})[0-9]{12})\z"
#: What a base match must meet; 19 digits of a card have at most 18 separators between them.
VALID = {
    "email": "true",
    "ip": f"rlike(v_, {_text(OCTETS)})",
    "card": f"(length(v_) between 12 and 37 and length({_digits('v_')}) between 12 and 19 and {luhn(_digits('v_'))})",
    "phone": f"length({_digits('v_')}) between 9 and 15",
}
SPAN = "struct<start:int,kind:int,end:int>"
PROPOSAL = "struct<start:int,kind:int,end:int,maker:int,value:string,lead:string,after:string>"


def base_spans(text: str) -> list[str]:
    """The valid base spans of each kind."""
    out = []
    for i, kind in enumerate(KINDS):
        spans = matches(text, BASE[kind], SPAN, f"named_struct('start', start_, 'kind', {i}, 'end', end_)", VALID[kind])
        tried = f"contains({text}, '{NEEDS[kind]}')" + ("" if kind == "email" else f" and rlike({text}, '[0-9]')")
        out.append(f"if({tried}, {spans}, cast(array() as array<{SPAN}>))")
    return out


def proposals(text: str) -> str:
    """All generators' spans, each with its context: up to 24 characters since the generator's last match, and the one after it."""
    parts = []
    for maker, (kind, pattern) in enumerate(GENERATORS):
        needs = {"email": r"(?i)[\[({] ?at ?[\])}]", "ip": r"(?i)[0-9] ?[\[({]|[0-9]\.[0-9]"}.get(kind, r"\+" if pattern.startswith(r"\+") else "[0-9]{3}")
        shape = f"named_struct('start', start_, 'kind', {KINDS.index(kind)}, 'end', end_, 'maker', {maker}, 'value', m_.value, 'lead', right(m_.gap, 24), 'after', left(m_.rest, 1))"
        parts.append(f"if(rlike({text}, {_text(needs)}), {matches(text, pattern, PROPOSAL, shape, 'true')}, cast(array() as array<{PROPOSAL}>))")
    return f"concat({', '.join(parts)})"


def _side(char: str) -> str:
    """0 for an end of the text, 1 white space, 2 a letter, 3 a digit, 4 else."""
    return f"CASE WHEN {char} = '' THEN 0 WHEN rlike({char}, r'\\s') THEN 1 WHEN rlike({char}, r'\\p{{L}}') THEN 2 WHEN rlike({char}, '[0-9]') THEN 3 ELSE 4 END"


def with_features(spans: str) -> str:
    """Proposals with ``FEATURES`` as doubles."""
    digits = _digits("s_.value")
    values = {
        "kind": "s_.kind",
        "size": "length(s_.value)",
        "digits": f"length({digits})",
        "luhn": f"cast({luhn(digits)} as int)",
        "lead": f"coalesce(try_cast(substring({digits}, 1, 1) as int), -1)",
        "separators": "length(regexp_replace(s_.value, '[^ ().-]', ''))",
        "distinct": f"size(array_distinct(split({digits}, '')))",
        "octets": f"cast(rlike(regexp_replace(s_.value, '[^0-9]+', '.'), {_text(OCTETS)}) as int)",
        "issuer": f"cast(rlike({digits}, {_text(ISSUERS)}) as int)",
        "ending": f"length(regexp_extract(s_.value, {_text(r'[A-Za-z]*' + chr(92) + 'z')}, 0))",
        "before": _side("right(s_.lead, 1)"),
        "after": _side("s_.after"),
    }
    values |= {f"cue{i}": f"cast(rlike(s_.lead, {_text(c)}) as int)" for i, c in enumerate(CUES)}
    fields = [f"'{c}', s_.{c}" for c in ("start", "kind", "end", "maker")] + [f"'f_{f}', cast({values[f]} as double)" for f in FEATURES]
    return f"transform({spans}, s_ -> named_struct({', '.join(fields)}))"


# ------------------------------------------------------------------------------------------------ boosting


def examples(n: int = 900, seed: int = 5) -> list[tuple[str, int, int]]:
    """Made-up (text, kind, label) examples with one value each, for the fit: personal data, and numbers that only look like it."""
    r = random.Random(seed)
    words = "the a of and to was over ran mit der und les des une con los para blue note table river stone after before".split()
    say = lambda k: " ".join(r.choice(words) for _ in range(k))
    run = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def check_digit(body: str) -> str:
        total = sum(int(c) if i % 2 else (2 * int(c) - 9 * (int(c) > 4)) for i, c in enumerate(reversed(body)))
        return body + str(-total % 10)

    def broken(card: str) -> str:
        return card[:-1] + str((int(card[-1]) + r.randint(1, 9)) % 10)

    def grouped(card: str) -> str:
        sep = r.choice(" -.")
        return sep.join(card[i : i + 4] for i in range(0, len(card), 4))

    out = []
    for i in range(n):
        cue = ["", "", "", ""]
        form = i % 15
        card = check_digit((r.choice(["4", "4", "51", "55", "35", "6011"]) + run(15))[:15])
        card = card if r.random() < 0.9 else check_digit(r.choice(["34", "37"]) + run(12))
        phone = f"+{r.choice(['1', '44', '49', '33'])} ({run(3)}) {run(3)}-{run(4)}"
        national = r.choice([f"({run(3)}) {run(3)}-{run(4)}", f"{run(3)}-{run(3)}-{run(4)}"])
        ip = ".".join(str(r.randint(1, 254)) for _ in range(4))
        host = f"{r.choice(words)}{r.choice(['mail', 'post', ''])}"
        hidden = f"{r.choice(words)}{run(2)} [at] {host}{r.choice([' [dot] ', '.'])}{r.choice(['com', 'net', 'org'])}"
        dot = r.choice(["[.]", "(.)", " [dot] "])
        defanged, no_ip = dot.join(ip.split(".")), dot.join([str(r.randint(256, 999)), *(str(r.randint(0, 400)) for _ in range(3))])
        no_host = f"{r.choice(words)} {r.choice(['[at]', '(at)'])} {run(r.randint(1, 2))}.{run(2)}"
        value, kind, label = [
            (card, 2, 1), (broken(card), 2, 0), (grouped(card), 2, 1), (grouped(broken(card)), 2, 0), (run(r.randint(12, 19)), 2, 0), (f"{phone} {run(r.randint(9, 16))}", 3, 1),
            (national, 3, 1), (f"{run(3)} {run(3)}.{run(4)}", 3, 0), (hidden, 0, 1), (defanged, 1, 1), (no_ip, 1, 0), (run(r.randint(12, 19)), 2, 0), (no_host, 0, 0), (f"{card} {run(3)}", 2, 1), (f"{broken(card)} {run(3)}", 2, 0),
        ][form]
        if kind == 2 and label == 0 and form in (4, 11) and _passes(value):
            value = broken(value)
        if label and r.random() < 0.3:
            cue[kind] = r.choice([["mail ", "contact "], ["ip ", "host "], ["card ", "visa "], ["call ", "tel "]][kind])
        elif kind == 3 and form in (6, 7) and r.random() < 0.4:
            cue[kind], label = r.choice(["order ", "invoice no. ", "serial ", "ref "]), 0
        out.append((f"{say(r.randint(0, 6))} {cue[kind]}{value}{r.choice(['', '.', ',', '!!', ' ', ''])} {say(r.randint(0, 6))}".strip(), kind, label))
    return out


def other_examples(n: int = 900, seed: int = 6) -> list[tuple[str, int, int]]:
    """Examples for the calibration, which share no words, cues or look-alikes with ``examples``."""
    r = random.Random(seed)
    words = "yesterday please reply soon gestern bitte antworten morgen hier merci demain votre gracias ahora cuando office garden window seven twenty".split()
    say = lambda k: " ".join(r.choice(words) for _ in range(k))
    run = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def paid() -> str:
        body = r.choice(["4929", "5425", "3530", "6221"]) + run(11)
        return next(body + d for d in "0123456789" if _passes(body + d))

    out = []
    for i in range(n):
        card, year = paid(), f"20{r.randint(10, 29)}{r.randint(1, 12):02d}{r.randint(1, 28):02d}"
        octets = [str(r.randint(1, 254)) for _ in range(4)]
        who = r.choice(words) + r.choice(["", ".", "_"]) + r.choice(words)
        value, kind, label = [
            (f"Kartennummer:{card}", 2, 1),
            (f"{r.randint(2, 9)} {card}", 2, 1),  # a count before it, which the base pattern runs together with it
            (".".join(card[k : k + 4] for k in range(0, 16, 4)), 2, 1),
            (f"{year}{run(6)}", 2, 0),  # a time stamp
            (f"978{run(10)}", 2, 0),  # a book number
            (f"{run(4)}.{run(4)}.{run(4)}.{run(4)}", 2, 0),
            (f"Rufen Sie {r.choice([f'({run(3)}) {run(3)}-{run(4)}', f'{run(3)}-{run(3)}-{run(4)}', f'{run(3)} {run(3)}-{run(4)}'])}", 3, 1),
            (f"sku {run(3)}-{run(3)}-{run(4)}", 3, 0),
            (f"+{r.choice(['351', '7', '61', '52'])} {run(3)} {run(3)} {run(4)} {run(4)} {run(4)}", 3, 1),  # run together with other numbers
            (f"{who} (at) {r.choice(words)}{r.choice(['.', ' (dot) '])}{r.choice(['edu', 'io', 'fr'])}", 0, 1),
            (f"{who} [at] {run(1)}.{run(2)} each", 0, 0),
            (r.choice(["[.]", " (dot) "]).join(octets), 1, 1),
            (f"v{r.randint(1, 9)} [dot] {run(3)} [dot] 999 [dot] {run(3)}", 1, 0),
        ][i % 13]
        out.append((f"{say(r.randint(0, 5))} {value}{r.choice(['', ';', '?', ' -', ')'])} {say(r.randint(0, 5))}".strip(), kind, label))
    return out


def _passes(digits: str) -> bool:
    return sum(int(c) if i % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits))) % 10 == 0


def boost(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3) -> list:
    """Boosted trees by Newton steps; a tree is a leaf value or (feature, threshold, tree up to it, tree above)."""
    total, out = np.zeros(len(y)), []

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, left: int):
        value = rate * g[rows].sum() / (h[rows].sum() + 1)
        best = (1e-6, -1, 0.0)
        if left:
            for f in range(x.shape[1]):
                values = np.unique(x[rows, f])
                for cut in (values[1:] + values[:-1]) / 2 if len(values) <= 24 else np.quantile(values, np.linspace(0.04, 0.96, 24)):
                    low = rows[x[rows, f] <= cut]
                    if 5 <= len(low) <= len(rows) - 5:
                        gl, hl, ga, ha = g[low].sum(), h[low].sum(), g[rows].sum(), h[rows].sum()
                        gain = gl**2 / (hl + 1) + (ga - gl) ** 2 / (ha - hl + 1) - ga**2 / (ha + 1)
                        if gain > best[0]:
                            best = (gain, f, float(cut))
        if best[1] < 0:
            return float(value)
        low = x[rows, best[1]] <= best[2]
        return (best[1], best[2], grow(rows[low], g, h, left - 1), grow(rows[~low], g, h, left - 1))

    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        tree = grow(np.arange(len(y)), y - p, p * (1 - p), depth)
        step = np.array([_walk(tree, row) for row in x])
        out.append(tree)
        total += step
        if np.abs(step).max() < 1e-3:
            break
    return out


def _walk(tree, row: np.ndarray) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def _tree_sql(tree) -> str:
    """A tree as an SQL expression over the struct ``s_``."""
    if not isinstance(tree, tuple):
        return f"{tree!r}D"
    return f"CASE WHEN s_.f_{FEATURES[tree[0]]} <= {tree[1]!r}D THEN {_tree_sql(tree[2])} ELSE {_tree_sql(tree[3])} END"


_FITTED: dict[tuple[int, int], tuple[list, list[float]]] = {}


def _judged(spark: SparkSession, made: list[tuple[str, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of the example, features, kind and label of each proposal in examples: those of an example's kind, base spans hidden as in any text."""
    table = spark.createDataFrame([(i, *e) for i, e in enumerate(made)], "i int, text string, kind int, label int")
    left = _with_base(table, "text", "base").selectExpr("i", "kind", "label", f"{_left('text', 'base')} AS left")
    spans = left.selectExpr("i", "kind", "label", f"explode({with_features(proposals('left'))}) AS s").where("s.kind = kind")
    rows = spans.select("i", "kind", "label", *(F.col(f"s.f_{f}") for f in FEATURES)).orderBy("i", "s.start", "s.end", "s.maker").collect()
    return np.array([r["i"] for r in rows]), np.array([r[3:] for r in rows], float), np.array([r["kind"] for r in rows]), np.array([r["label"] for r in rows], float)


def fitted(spark: SparkSession, n: int = 900, seed: int = 5, precision: float = 0.9) -> tuple[list, list[float]]:
    """Trees, and for each kind the lowest score from which on the calibration's examples are right often enough."""
    if (n, seed) in _FITTED:
        return _FITTED[n, seed]
    number, x, kinds, y = _judged(spark, [*examples(n, seed), *other_examples(n, seed + 1)])
    trees = boost(x[number < n], y[number < n])
    x, kinds, y = x[number >= n], kinds[number >= n], y[number >= n]
    score = np.array([sum(_walk(t, row) for t in trees) for row in x])
    limits = []
    for k in range(len(KINDS)):
        mine = kinds == k
        limit = np.inf
        for s in sorted(set(score[mine]), reverse=True):
            if s <= 0:
                break
            if y[mine & (score >= s)].mean() >= precision:
                limit = s
        limits.append(float(limit) - 1e-9)
    _FITTED[n, seed] = (trees, limits)
    return trees, limits


# ------------------------------------------------------------------------------------------------ the operator


def _with_base(rows: DataFrame, text: str, base: str) -> DataFrame:
    return rows.withColumn(base, F.expr(f"array_sort(concat({', '.join(base_spans(text))}))"))


def _left(text: str, base: str) -> str:
    """``text`` with its base spans hidden; offsets stay."""
    hidden = rewritten(text, base, f"repeat('{HIDDEN}', greatest(s_.end - greatest(s_.start, x_.at), 0))")
    return f"if(size({base}) > 0, {hidden}, {text})"


def _with_spans(rows: DataFrame, text: str, added: str, base: str) -> DataFrame:
    """``rows`` with the columns named ``base`` (base spans) and ``added`` (chosen proposals)."""
    trees, limits = fitted(rows.sparkSession)
    found = _with_base(rows, text, base)
    tried = _text(r"[0-9]{3}|[\[({] ?(?i:at) ?[\])}]|[0-9] ?[\[({]|[0-9]\.[0-9]")
    proposed = _let(_left(text, base), "left_", proposals("left_"))
    found = found.withColumn(added, F.expr(f"if(rlike({text}, {tried}), {proposed}, cast(array() as array<{PROPOSAL}>))"))
    found = found.withColumn(added, F.expr(with_features(added)))
    score = " + ".join(["0D", *map(_tree_sql, trees)])
    found = found.withColumn(added, F.expr(f"transform({added}, s_ -> named_struct('kind', s_.kind, 'start', s_.start, 'end', s_.end, 'maker', s_.maker, 'score', {score}))"))
    least = " ".join(f"WHEN {k} THEN {limit!r}D" for k, limit in enumerate(limits) if np.isfinite(limit))
    enough = f"coalesce(s_.score >= CASE s_.kind {least} END, false)" if least else "false"
    found = found.withColumn(added, F.expr(f"array_sort(filter({added}, s_ -> {enough}))"))
    rank = lambda x: f"struct({x}.end - {x}.start, {x}.score, -{x}.start, -{x}.maker)"
    better = f"o_ -> o_.kind = s_.kind and o_.start < s_.end and s_.start < o_.end and {rank('o_')} > {rank('s_')}"
    near = f"slice({added}, greatest(i_ - {NEIGHBOURS}, 0) + 1, {2 * NEIGHBOURS + 1})"
    best = f"filter({added}, (s_, i_) -> not exists({near}, {better}))"
    return found.withColumn(added, F.expr(f"transform({best}, s_ -> named_struct('start', s_.start, 'kind', s_.kind, 'end', s_.end))"))


def find(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``base`` and ``added`` spans as ``array<struct<start, kind, end>>``, kinds as numbers in ``KINDS``."""
    some = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return _with_spans(some, "text", "added", "base").select("doc_id", "base", "added")


def joined(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind, joined by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each span in ``text`` replaced by its kind in brackets; of overlapping spans the first names the kind."""
    base, added, whole = "__scriptorium_base", "__scriptorium_added", "__scriptorium_text"
    found = _with_spans(docs.withColumn(whole, F.expr("coalesce(text, '')")), whole, added, base)
    names = ", ".join(f"'[{k.upper()}]'" for k in KINDS)
    label = f"if(s_.start >= x_.at, element_at(array({names}), s_.kind + 1), '')"
    clean = F.expr(f"if(size({base}) + size({added}) > 0, {rewritten('text', f'array_sort(concat({base}, {added}))', label)}, text)")
    return found.select(*(clean.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns))
