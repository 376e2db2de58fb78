"""Literals of expressions, lines of filter lists, and the index beside every rule run on every url."""

from __future__ import annotations

import duckdb
import pytest

from glintframe.llm import urls
from glintframe.llm.queries import URL_RULES


@pytest.mark.parametrize(("pattern", "want"), [
    (r"casino", [set()]), (r"\bcasino\b", [{"casino"}]), (r"/ads?/", [{"ad"}, {"ads"}]), (r"/(?:ads|banner)/img", [{"ads"}, {"banner"}]),
    (r"[-.]free[-.]bets[-.]", [{"free", "bets"}]), (r"/a(bc)?d/", [{"ad"}, {"abcd"}]), (r"/x+/", [set()]), (r"/(foo/)+bar/", [{"foo"}]), (r"^Foo\.COM$", [{"foo", "com"}]),
    (r"/foo.*/bar/", [{"bar"}]), (r"(?i:/Track/)", [{"track"}]), (r"/foo|bar/", [set(), set()]), (r"(?<![A-Za-z0-9])win(?![A-Za-z0-9])", [{"win"}]), (r"(?<!x)win\W", [set()]),
    (r"/[ab]/", [{"a"}, {"b"}]), (r"/é1/", [{"1"}]), (r"", [set()]), (r"/(a|b|c|d|e)(a|b|c|d|e)(a|b|c|d|e)/z/", [{"z"}]),
])
def test_required_tokens(pattern, want):
    assert sorted(map(sorted, urls.required(pattern))) == sorted(map(sorted, {frozenset(w) for w in want}))


def test_lines_of_filter_lists():
    cases = {
        "||ads.example.com^": (["https://ads.example.com/x", "http://x.ads.example.com", "ftp://ads.example.com:80/"], ["http://badads.example.com/", "http://example.com/ads.example.com/", "http://ads.example.community/"]),
        "|http://start": (["http://start/x"], ["https://x/http://start", "https://start"]), "/end.html|": (["http://x/end.html"], ["http://x/end.html?q"]),
        "/banner/*/img^": (["http://x/banner/a/b/img", "http://x/banner//img?x"], ["http://x/banner/imgs", "http://x/banner/a/image"]), "a.b+c": (["http://x/a.b+c"], ["http://x/aXb+c", "http://x/a.bbc"]),
    }
    for line, (hits, misses) in cases.items():
        index = urls.build_index([urls.filter_rule(line)], {})
        assert [urls.judge(index, u)[3] for u in hits] == ["block"] * len(hits), line
        assert [urls.judge(index, u)[3] for u in misses] == ["allow"] * len(misses), line
    both = urls.build_index([urls.filter_rule("/x/"), urls.filter_rule("@@||good.org^")], {})
    assert urls.judge(both, "http://good.org/x/")[3] == "allow" and urls.judge(both, "http://bad.org/x/")[3] == "block"


def test_index_loses_no_rule(spark, sf):
    """Thousands of rules: those that the index fetches fit exactly where all of them, run one by one, fit."""
    found = [r[0] for r in duckdb.sql(f"SELECT url FROM read_parquet('{sf}/pages.parquet')").fetchall()]
    tokens = sorted({t for u in found for t in urls.TOKEN.findall(u)})
    rules = [*URL_RULES, *(urls.filter_rule(f"||{t}.") for t in tokens[::7]), *(urls.filter_rule(f"/{t}^") for t in tokens[::5]), *(urls.Rule(t, rf"/{t}(?:\.html|/|\?page=\d+)", urls.BLOCK, False) for t in tokens[::3])]
    counts = urls.token_counts(spark.createDataFrame([(u,) for u in found], "url string"), sorted({t for r in rules for t in r.tokens}), "url")
    assert len(rules) > 3000 and all(counts.get(t, 0) == sum(t in {x.lower() for x in urls.TOKEN.findall(u)} for u in found) for t in ("example", "casino", "free", "org", "15"))
    index, every = urls.build_index(rules, counts), urls.Index({}, tuple(rules))
    some = [*found[::5], None, "", "no url", "http://", "HTTP://WWW.EXAMPLE.ORG/ES/1"]
    assert [urls.judge(index, u) for u in some] == [urls.judge(every, u) for u in some]
    fetched = sum(len(index.candidates("\n".join(["", "", u]))) for u in found)
    assert fetched < 0.05 * len(rules) * len(found)
