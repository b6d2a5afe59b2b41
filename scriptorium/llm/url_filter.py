"""URL filters by redirect equivalence.

Every URL gets a canonical form: host in lower case, no fragment, no default port, dot segments resolved, at least ``/`` as its path;
``http`` and ``https`` are one. Nothing else is taken for a redirect unless ``Folding`` asks for it (``www.``, tracking parameters, index
files and trailing slashes, which many sites redirect away). Edges join a URL's form to that of the target of every canonical
link and of every refresh in its HTML, relative targets resolved against the page's URL, and to its target in ``redirects``, a
table of ``url, target`` if given. Connected components over these edges are the sets of aliases. A page that a rule fits
has the rule's verdict. Any other page takes over a decision from its aliases: allowed if a rule allows one of them, else
blocked if a rule blocks one, else allowed.

Rules are matched natively: there are few (the list is a parameter, not a table). Forms and components are only ever
shuffled by whole URLs, so a common host is no hot key.

Defined results: a null URL or one without ``://`` has an empty host and path, fits no rule, has no aliases and is allowed. Links in
its HTML count only if they are absolute, as what they are relative to isn't known; they then join nothing. Repeated rows get
equal results. Null HTML has no links; very long HTML is read whole. An empty table gives an empty result. Other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.components import connected_components
from scriptorium.llm.storage import materialise, scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Query parameters that only track where a visitor comes from.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "ref")

#: Tags that may name an alias, and in them the attributes that say so. A value is quoted or ends at white space.
LINK_TAG, META_TAG = r"(?i)<link\b[^>]*>", r"(?i)<meta\b[^>]*>"
_VALUE = r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
REL, HREF, EQUIV, CONTENT = (rf"(?is)\s{name}{_VALUE}" for name in ("rel", "href", "http-equiv", "content"))
REFRESH_URL = r"(?is)\A[\s\d.]*[;,]?\s*url\s*=\s*['\"]?\s*([^'\"]*)"


@dataclass(frozen=True)
class Folding:
    """Guesses at what sites redirect without saying so."""

    www: bool = False
    tracking: bool = False
    index: bool = False


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(_after_scheme(url), r"\A([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule ``host/path`` that fits; ``rules`` has (verdict, rule) pairs."""
    fits = []
    for _, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        where, _, rest = rule.partition("/")
        fits.append(F.when(((host == where) | F.endswith(host, F.lit("." + where))) & F.startswith(path, F.lit("/" + rest)), F.lit(rule)))
    return F.coalesce(*fits) if fits else F.lit(None).cast("string")


def canonical_url(url: Column, folding: Folding = Folding()) -> Column:
    """The form that all spellings of a URL share; null for none."""
    host = F.regexp_replace(host_of(url), r":(80|443)?\z", "")
    path = _without_dots(path_of(url))
    query = F.regexp_extract(F.regexp_replace(url, r"(?s)#.*\z", ""), r"(?s)\?(.*)\z", 1)
    if folding.www:
        host = F.regexp_replace(host, r"\Awww\.(?=[^.]+\.)", "")
    if folding.index:
        path = F.regexp_replace(path, r"/+(index\.html?)?\z", "")
    if folding.tracking:
        tracking = "|".join(TRACKING)
        query = F.array_join(F.filter(F.split(query, "&"), lambda p: ~p.rlike(rf"\A(({tracking})(=.*)?)?\z")), "&")
    path = F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit("/"), path))
    return F.when(F.instr(url, "://") > 0, F.concat(F.lit("http://"), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def _without_dots(path: Column) -> Column:
    """``.`` and ``..`` segments resolved; a path that ends in one of them ends in a slash."""

    def step(done: Column, part: Column) -> Column:
        up = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))
        return F.when(part == "..", up).when(part == ".", done).otherwise(F.concat(done, F.array(part)))

    parts = F.split(path, "/")
    kept = F.aggregate(F.slice(parts, 2, F.size(parts)), F.slice(parts, 1, 1), step)
    open_end = F.when(path.rlike(r"/\.{1,2}\z"), "/").otherwise("")
    return F.when(path.rlike(r"(?:/\.{1,2})(?:/|\z)"), F.concat(F.array_join(kept, "/"), open_end)).otherwise(path)


def resolved(url: Column, target: Column) -> Column:
    """``target`` as an absolute URL, seen from ``url``; null if that isn't known or it is no place on the web."""
    scheme = F.regexp_extract(url, r"\A([A-Za-z][A-Za-z0-9+.-]*)://", 1)
    root = F.regexp_extract(url, r"(?s)\A([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    page = F.regexp_extract(url, r"(?s)\A([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*[^?#]*)", 1)
    folder = F.when(page == root, F.concat(root, F.lit("/"))).otherwise(F.regexp_replace(page, r"[^/]*\z", ""))
    whole = F.regexp_extract(url, r"(?s)\A([^#]*)", 1)
    known = F.coalesce(root != "", F.lit(False))
    return (
        F.when(target.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*:") | ~known, None)
        .when(F.startswith(target, F.lit("//")), F.concat(scheme, F.lit(":"), target))
        .when(F.startswith(target, F.lit("/")), F.concat(root, target))
        .when(F.startswith(target, F.lit("?")), F.concat(page, target))
        .when((target == "") | F.startswith(target, F.lit("#")), whole)
        .otherwise(F.concat(folder, target))
    )


def _attribute(tag: Column, pattern: str) -> Column:
    return F.trim(F.concat(*(F.regexp_extract(tag, pattern, i) for i in (1, 2, 3))))


def links(pages: DataFrame) -> DataFrame:
    """``url`` and ``target``, an absolute URL, of each canonical link and refresh in the pages' HTML."""
    html = F.col("html").cast("string")
    none = F.array().cast("array<string>")
    canonical = F.filter(F.regexp_extract_all(html, F.lit(LINK_TAG), F.lit(0)), lambda t: F.array_contains(F.split(F.lower(_attribute(t, REL)), r"\s+"), "canonical") & t.rlike(HREF))
    refresh = F.filter(F.regexp_extract_all(html, F.lit(META_TAG), F.lit(0)), lambda t: (F.lower(_attribute(t, EQUIV)) == "refresh") & _attribute(t, CONTENT).rlike(REFRESH_URL))
    targets = F.concat(
        F.when(F.contains(F.lower(html), F.lit("canonical")), F.transform(canonical, lambda t: _attribute(t, HREF))).otherwise(none),
        F.when(F.contains(F.lower(html), F.lit("refresh")), F.transform(refresh, lambda t: F.trim(F.regexp_extract(_attribute(t, CONTENT), REFRESH_URL, 1)))).otherwise(none),
    )
    out = pages.select("url", F.explode(F.array_distinct(targets)).alias("target"))
    return out.select("url", resolved(F.col("url"), F.replace("target", F.lit("&amp;"), F.lit("&"))).alias("target")).where("target IS NOT NULL AND instr(url, '://') > 0")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], redirects: DataFrame | None = None, folding: Folding = Folding()) -> DataFrame:
    """One row per row of ``pages``: ``page_id, host, path, rule, verdict``, and ``decided_by`` (rule, alias or default).

    URLs with one canonical form are aliases without further ado, so the components are those of canonical forms.
    """
    verdicts = dict((rule, verdict) for verdict, rule in rules)
    some = pages.select("page_id", F.col("url").cast("string").alias("url"), "html")
    with scratch() as tables:
        found = links(some)
        if redirects is not None:
            found = found.union(redirects.select(F.col("url").cast("string"), F.col("target").cast("string")).where("instr(url, '://') > 0 AND instr(target, '://') > 0"))
        found = found.select("target", canonical_url(F.col("url"), folding).alias("a"), canonical_url(F.col("target"), folding).alias("b"), _verdict(F.col("url"), rules, verdicts).alias("own_a"))
        found = materialise(found.withColumn("own_b", _verdict(F.col("target"), rules, verdicts)))
        members = connected_components(found.select("a", "b"))
        form = canonical_url(F.col("url"), folding).alias("form")
        ruled = some.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), form)
        ruled = ruled.withColumn("rule", matched_rule(F.col("host"), F.col("path"), rules)).withColumn("own", _lookup(F.col("rule"), verdicts)).drop("url")
        ruled = materialise(ruled)
        opinions = ruled.select("form", "own").union(found.select("a", "own_a")).union(found.select("b", "own_b")).where("form IS NOT NULL AND own IS NOT NULL")
        opinions = opinions.groupBy("form").agg(F.min("own").alias("own"))  # allow comes before block
        grouped = opinions.join(members.withColumnRenamed("node", "form"), "form", "left").select(F.coalesce("component", "form").alias("component"), "own")
        decided = materialise(grouped.groupBy("component").agg(F.min("own").alias("taken")))
        # every form that a decision reaches: those of its component, and the component's name if it stands alone
        reached = decided.join(members, "component").select(F.col("node").alias("form"), "taken").union(decided.select(F.col("component").alias("form"), "taken")).distinct()
        out = ruled.join(reached, "form", "left")
        return tables.result(out.select(
            "page_id", "host", "path", "rule",
            F.coalesce("own", "taken", F.lit("allow")).alias("verdict"),
            F.when(F.col("own").isNotNull(), "rule").when(F.col("taken").isNotNull(), "alias").otherwise("default").alias("decided_by"),
        ))


def _verdict(url: Column, rules: Sequence[tuple[str, str]], verdicts: dict[str, str]) -> Column:
    return _lookup(matched_rule(host_of(url), path_of(url), rules), verdicts)


def _lookup(rule: Column, verdicts: dict[str, str]) -> Column:
    if not verdicts:
        return F.lit(None).cast("string")
    return F.element_at(F.create_map(*(F.lit(x) for kv in verdicts.items() for x in kv)), rule)
