"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression.  Its parse tells the literal tokens that any url it fits must contain as whole
tokens (``required``): runs of letters and digits with an edge at both ends; alternations give one set for each branch, optional
parts none.  Of each set the token that fewest urls of the corpus contain is an index key of the rule, counted
over all urls first.  A url's own tokens then fetch the few rules that might fit, and only their
expressions run; rules that can fit without a literal token run on every url.

Host rules (host and path prefix) are rules like others, turned into an expression.  The longest one that fits decides; where none does, a
pattern rule that fits blocks, unless one that allows fits too, and what is left is allowed.  Lines of filter lists
(``||host^``, ``|``, ``*``, ``^``, ``@@``) are pattern rules (``filter_rule``).

The rules are a Python list, so their size is bounded by the driver, and travel with the
function; no url is shuffled but in the token counts, which Spark combines first.

Defined cases: a null url, or one without ``://``, has empty host and path and is allowed unless a
pattern rule without tokens fits it; repeated rows are judged alike; an empty table gives an empty
result; columns of the input that clash with those added are replaced.
"""

from __future__ import annotations

import re
import re._constants as sre
import re._parser as sre_parser
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ASCII_LOWER, fresh

TOKEN = re.compile(r"[A-Za-z0-9]+")
ALLOW, BLOCK = "allow", "block"
ADDED = ("host", "path", "rule", "verdict")


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str
    verdict: str
    decides: bool  # a host rule; the longest name wins

    @property
    def required(self) -> tuple[frozenset[str], ...]:
        return required(self.pattern)

    @property
    def tokens(self) -> set[str]:
        return set().union(*self.required)


def host_rule(name: str, verdict: str) -> Rule:
    """``org/`` or ``example.org/es/``: the host and all below it, if the path starts so."""
    host, slash, path = name.partition("/")
    tail = slash + path
    return Rule(name, rf"\A(?:[^\n]*\.)?{re.escape(host)}\n{re.escape(tail)}", verdict, True)


def word_rule(*words: str) -> Rule:
    """Blocks urls that contain these tokens in this order, joined by one of ``-._/``."""
    joined = r"[-._/]".join(re.escape(w) for w in words)
    return Rule("-".join(words), rf"(?<![A-Za-z0-9]){joined}(?![A-Za-z0-9])", BLOCK, False)


def filter_rule(line: str) -> Rule:
    """A line of a filter list, on the whole url: ``||`` begins a host or a part of it behind a dot, ``|`` is an end, ``^`` anything that
    separates or the end, ``*`` anything; ``@@`` in front allows."""
    verdict, body = (ALLOW, line[2:]) if line.startswith("@@") else (BLOCK, line)
    start, stop = "", ""
    if body.startswith("||"):
        start, body = r"\n[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#\n]*\.)?", body[2:]
    elif body.startswith("|"):
        start, body = r"\n(?=[^\n]*\Z)", body[1:]
    if body.endswith("|"):
        stop, body = r"\Z", body[:-1]
    parts = {"*": r"[^\n]*", "^": r"(?:[^A-Za-z0-9_.%\n-]|\Z)"}
    last = r"(?=[^\n]*\Z)" if not start and not stop else ""  # in the url's own line
    return Rule(line, last + start + "".join(parts.get(c) or re.escape(c) for c in body) + stop, verdict, False)


#: What an expression is made of besides literal characters: anything, or a place where no letter or digit stands on one side.
GAP, EDGE = "gap", "edge"
#: Branches of an expression that are told apart; beyond, its alternation counts as anything.
BRANCHES = 64
_alnum = [c for c in map(chr, range(128)) if c.isalnum()]
_categories = {sre.CATEGORY_DIGIT: str.isdigit, sre.CATEGORY_SPACE: str.isspace, sre.CATEGORY_WORD: lambda c: c.isalnum() or c == "_"}
_categories |= {
    sre.CATEGORY_NOT_DIGIT: lambda c: not c.isdigit(), sre.CATEGORY_NOT_SPACE: lambda c: not c.isspace(), sre.CATEGORY_NOT_WORD: lambda c: not (c.isalnum() or c == "_"),
}


def _among(items: list[tuple], c: str) -> bool:
    """Whether a class of an expression has ``c``."""
    negated = bool(items) and items[0][0] == sre.NEGATE
    hit = False
    for op, value in items:
        if op == sre.LITERAL:
            hit |= ord(c) == value
        elif op == sre.RANGE:
            hit |= value[0] <= ord(c) <= value[1]
        elif op == sre.CATEGORY:
            hit |= _categories[value](c)
    return hit != negated


def _sequences(parsed) -> list[tuple[str, ...]]:
    """The branches of an expression, each as literal characters, gaps and edges in a row."""
    out: list[tuple[str, ...]] = [()]

    def then(branches: list[tuple[str, ...]]) -> None:
        nonlocal out
        branches = list(dict.fromkeys(branches))
        out = [a + b for a in out for b in branches] if len(out) * len(branches) <= BRANCHES else [a + (GAP,) for a in out]

    for op, value in parsed:
        if op == sre.LITERAL:
            then([(chr(value),)])
        elif op == sre.IN:
            own = [c for c in _alnum if _among(value, c)]
            then([(EDGE,)] if not own and not (value and value[0][0] == sre.NEGATE and len(value) == 1) else [(c,) for c in own] if len(value) == len(own) <= 4 else [(GAP,)])
        elif op == sre.AT:
            then([()] if value == sre.AT_NON_BOUNDARY else [(EDGE,)])
        elif op == sre.SUBPATTERN:
            then(_sequences(value[3]))
        elif op == sre.ATOMIC_GROUP:
            then(_sequences(value))
        elif op == sre.BRANCH:
            then([x for own in value[1] for x in _sequences(own)])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            low, high, own = value
            inner = _sequences(own)
            if high == 1:
                then(inner + ([()] if low == 0 else []))
            elif low == 0:
                then([(GAP,)])
            else:
                then([x + (GAP,) for x in inner] if len(inner) * len(out) <= BRANCHES else [(GAP,)])
        elif op == sre.ASSERT_NOT and len(value[1]) == 1 and value[1][0][0] == sre.IN and all(_among(value[1][0][1], c) for c in _alnum):
            then([(EDGE,)])  # no letter or digit before or behind this place
        elif op in (sre.ASSERT, sre.ASSERT_NOT):
            then([()])
        else:
            then([(GAP,)])
    return out


@lru_cache(maxsize=None)  # as many as there are rules
def required(pattern: str) -> tuple[frozenset[str], ...]:
    """For each branch of ``pattern`` the tokens, lower-cased, that a url must have whole to fit it; a branch without one gives an empty set."""
    found = set()
    for row in _sequences(sre_parser.parse(pattern)):
        row = (GAP, *row, GAP)
        tokens, at = set(), 0
        while at < len(row):
            end = at
            while len(row[end]) == 1 and row[end].isascii() and row[end].isalnum():
                end += 1
            if end > at and GAP not in (row[at - 1], row[end]):
                tokens.add("".join(row[at:end]).lower())
            at = max(end, at + 1)
        found.add(frozenset(tokens))
    return tuple(sorted(found, key=sorted))


def split_url(url: str | None) -> tuple[str, str]:
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    host, tail = rest[:end].translate(ASCII_LOWER), rest[end:]
    stop = min((i for i in (tail.find(c) for c in "?#") if i >= 0), default=len(tail))
    return host, tail[:stop]


def _subject(url: str | None) -> tuple[str, str, str]:
    """What expressions run on: host, line feed, path, line feed, the url; their own line feeds as spaces."""
    host, path = split_url(url)
    return host, path, "\n".join(part.replace("\n", " ") for part in (host, path, url or ""))


def token_counts(urls: DataFrame, tokens: list[str], url_col: str) -> dict[str, int]:
    """Urls that contain each of ``tokens``, whatever the case: as many rows as the rules have tokens."""
    own = F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.col(url_col)), F.lit(r"([a-z0-9]+)"), F.lit(1))))
    wanted = urls.sparkSession.createDataFrame([(t,) for t in tokens], "wanted string")  # the driver has them all
    counted = urls.select(own.alias("token")).join(F.broadcast(wanted), F.col("token") == F.col("wanted")).groupBy("token").agg(F.count("*").alias("n"))
    return {r["token"]: r["n"] for r in counted.collect()}


@dataclass(frozen=True)
class Index:
    by_token: dict[str, tuple[Rule, ...]]
    always: tuple[Rule, ...]

    def candidates(self, subject: str) -> set[Rule]:
        found = set(self.always)
        for token in set(TOKEN.findall(subject.lower())):
            found.update(self.by_token.get(token, ()))
        return found


def build_index(rules: list[Rule], counts: dict[str, int]) -> Index:
    """Each rule under the rarest token of each of its branches."""
    by_token: dict[str, list[Rule]] = {}
    always = []
    for rule in dict.fromkeys(rules):
        if not all(rule.required):
            always.append(rule)
            continue
        for key in {min(branch, key=lambda t: (counts.get(t, 0), t)) for branch in rule.required}:
            by_token.setdefault(key, []).append(rule)
    return Index({t: tuple(r) for t, r in by_token.items()}, tuple(always))


@lru_cache(maxsize=None)  # as many as there are rules
def _compiled(pattern: str) -> re.Pattern:
    return re.compile(pattern)


def judge(index: Index, url: str | None) -> tuple[str, str, str | None, str]:
    host, path, subject = _subject(url)
    best, said = None, set()
    for rule in index.candidates(subject):
        if _compiled(rule.pattern).search(subject):
            if not rule.decides:
                said.add(rule.verdict)
            elif best is None or len(rule.name) > len(best.name):
                best = rule
    if best:
        return host, path, best.name, best.verdict
    return host, path, None, BLOCK if said == {BLOCK} else ALLOW


def filter_urls(pages: DataFrame, rules: list[Rule], *, url_col: str = "url") -> DataFrame:
    """``pages`` with host, path, rule (the host rule that decided, else null) and verdict (allow or block)."""
    counts = token_counts(pages, sorted({t for r in rules for t in r.tokens}), url_col)
    index = build_index(rules, counts)
    kept = [c for c in pages.columns if c.lower() not in ADDED]
    schema = T.StructType([f for f in pages.schema.fields if f.name in kept])
    for name in ADDED:
        schema = schema.add(name, T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [judge(index, url) for url in batch.column(batch.num_columns - 1).to_pylist()]
            columns = [pa.array([x[i] for x in found], pa.string()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], [f.name for f in schema.fields])

    (url_as,) = fresh(pages, "url__text")
    return pages.select(*kept, F.col(url_col).cast("string").alias(url_as)).mapInArrow(run, schema)
