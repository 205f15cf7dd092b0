"""URL filter: rules by host and path, and a weighted vocabulary of terms for all other URLs."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewise.llm.text import spare

# fixed values: terms that reject on one hit, and terms of which SOFT_LIMIT distinct ones reject
STRICT = ("casino", "casinos", "pills", "porn", "xxx", "viagra", "spam", "malware", "phishing", "warez", "escort")
SOFT = ("cheap", "free", "win", "bet", "bets", "bonus", "jackpot", "poker", "ads", "ad", "track", "tracker", "click", "farm", "deal", "deals", "discount", "loan", "loans", "adult", "sexy", "crack", "torrent", "download", "prize")
SOFT_LIMIT = 2

_automata: dict[tuple, object] = {}


def parse(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """``struct(rule, verdict)`` of the longest fitting rule, or null.

    A rule ``(verdict, "host/path")`` fits its host and all subdomains where the URL's path starts with its path. Rules
    are a short configured list and become conditions of one expression, longest first, then by name.
    """
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, below = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + below))
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _automaton(strict: tuple[str, ...], soft: tuple[str, ...]):
    if (strict, soft) not in _automata:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for term in soft:
            automaton.add_word(term, (term, False))
        for term in strict:
            automaton.add_word(term, (term, True))
        automaton.make_automaton()
        _automata[strict, soft] = automaton
    return _automata[strict, soft]


def vocabulary_hits(url: Column, strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT) -> Column:
    """``struct(strict, soft)``: how many distinct terms of either kind stand in a URL, A-Z lower-cased.

    One Aho-Corasick pass finds all terms. A hit counts where neither neighbour is a letter or digit, so that ``win``
    isn't found in ``winter``. A null URL has none.
    """
    terms = tuple(strict), tuple(soft)

    @F.pandas_udf("strict int, soft int")
    def count(urls: pd.Series) -> pd.DataFrame:
        automaton, rows = _automaton(*terms), []
        for url in urls:
            found: tuple[set, set] = (set(), set())
            if url:
                text = f" {url.translate(_LOWER)} "
                for end, (term, is_strict) in automaton.iter(text):
                    if not text[end + 1].isalnum() and not text[end - len(term)].isalnum():
                        found[not is_strict].add(term)
            rows.append((len(found[0]), len(found[1])))
        return pd.DataFrame(rows, columns=["strict", "soft"], dtype="int32")

    return count(url)


_LOWER = {c: c + 32 for c in range(65, 91)}


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = (), strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT, soft_limit: int = SOFT_LIMIT, url: str = "url") -> DataFrame:
    """``pages`` with ``host, path, rule, verdict, strict_hits, soft_hits``; columns of these names are replaced.

    A fitting rule decides. Else one strict term or ``soft_limit`` distinct soft terms block. Each row is judged on its
    own, without a shuffle; a null URL has empty parts and is allowed.
    """
    host, path = parse(F.col(url))
    out = pages.withColumns({"host": F.coalesce(host, F.lit("")), "path": F.coalesce(path, F.lit(""))})
    r, h = spare("_rule", out.columns), spare("_hits", out.columns)
    out = out.withColumns({r: matched_rule(F.col("host"), F.col("path"), rules), h: vocabulary_hits(F.col(url), strict, soft)})
    own = F.when((F.col(f"{h}.strict") > 0) | (F.col(f"{h}.soft") >= soft_limit), "block").otherwise("allow")
    added = {"rule": F.col(f"{r}.rule"), "verdict": F.coalesce(F.col(f"{r}.verdict"), own), "strict_hits": F.col(f"{h}.strict"), "soft_hits": F.col(f"{h}.soft")}
    return out.withColumns(added).drop(r, h)
