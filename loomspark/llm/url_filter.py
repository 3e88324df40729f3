"""URL filtering: pattern rules indexed by their rarest literal token.

Token counts over all URLs tell which of a rule's literal tokens is the rarest; a URL's tokens fetch
candidate rules from that index, and only those run their regular expressions.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.storage import bounded_batches

#: Rules are held by every task; more than this is refused rather than sent out.
MAX_RULES = 200_000
#: Tokens of URLs and rules: letters and digits apart, so that ``casino7`` has the token ``casino``.
TOKEN_PATTERN = "[a-z]+|[0-9]+"
TOKEN = re.compile(TOKEN_PATTERN)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = str.maketrans(_UPPER, _LOWER)


#: Stands between host and path where rules look: neither can hold it, whatever else they hold.
MARK = "#"


@dataclass(frozen=True)
class Rule:
    """A rule over ``host#path``, A-Z lower-cased if fold, else as it is.

    name: what is reported, or None for a rule of the method itself. length: the longest fitting rule
    wins, then block before allow, then the name. tokens: literal tokens that every fitting URL has.
    """

    name: str | None
    action: str
    pattern: str
    tokens: tuple[str, ...]
    length: int
    fold: bool = False


def host_path_rule(text: str, action: str) -> Rule:
    """A rule ``host/path``: the host and its subdomains, paths that start with the rule's."""
    host, slash, rest = text.partition("/")
    path = slash + rest
    closed = TOKEN.findall(lowered(host))
    pieces = list(TOKEN.finditer(lowered(path)))
    closed += [m[0] for m in pieces if m.end() < len(path)]  # an open end may go on in the URL
    return Rule(text, action, rf"\A(?:[^#]*\.)?{re.escape(lowered(host))}\#{re.escape(path)}", tuple(dict.fromkeys(closed)), len(text))


def lowered(text: str) -> str:
    return text.translate(_FOLD)


#: Words of the trades of junk sites. Alone they block nothing: pages about these things have them too.
JUNK = (
    "adult", "bet", "betting", "bingo", "camgirls", "casino", "cheapmeds", "clickbait", "crack", "dating", "escort", "essaymill", "exploit", "fakenews", "forex", "freemoney", "gambling", "hentai", "hookup", "jackpot",
    "keygen", "linkfarm", "loans", "lottery", "malware", "nulled", "payday", "pharmacy", "phishing", "pills", "poker", "porn", "replica", "roulette", "scam", "serials", "sex", "slots", "spam", "spyware",
    "streamfree", "sweepstakes", "torrent", "torrents", "viagra", "warez", "webcam", "xxx",
)
#: Words that such sites put beside them in a host; what their paths ask for; what opens the names of their pages.
LURES = (
    "best", "big", "bonus", "buy", "cheap", "club", "discount", "download", "easy", "farm", "fast", "free", "hot", "instant", "live", "lucky", "mega", "now", "online", "play", "pro", "real", "royal", "sale", "shop", "site",
    "top", "vip", "win", "zone",
)
ACTS = ("affiliate", "bonus", "coupon", "deposit", "freespins", "invite", "jackpot", "promo", "signup", "spin")
PUSHES = ("buy", "get", "order", "play", "watch")
#: Hosts of advertisements, and what their paths do.
AD_HOSTS, AD_PATHS = ("ad", "ads", "track", "trk", "click", "redirect"), ("click", "go", "imp", "out", "pixel", "redir", "redirect", "serve", "track")


def junk_shapes() -> Iterator[tuple[str, tuple[str, ...]]]:
    """(pattern, literal tokens) of families that take several words, or a word and digits, in certain places. Hosts end at #."""
    host, end = r"\A(?:[^#]*[.-])?", r"(?:[.-][^#]*)?#"
    for junk in JUNK:
        yield f"{host}{junk}[0-9]+{end}", (junk,)
        for lure in LURES:
            for x, y in ((junk, lure), (lure, junk)):
                yield f"{host}{x}-{y}[0-9]*{end}", (x, y)
                yield f"{host}{x}{y}[0-9]*{end}", (x + y,)
            for push in PUSHES:
                yield rf"#(?:.*/)?{push}[-_]{lure}[-_]{junk}(?:[/._-].*)?\Z", (push, lure, junk)
        for act in ACTS:
            yield rf"{host}{junk}{end}/(?:.*/)?{act}(?:[/._-].*)?\Z", (junk, act)
    for x in AD_HOSTS:
        for act in AD_PATHS:
            yield rf"\A(?:[^#]*\.)?{x}[0-9]*\.[^#]*#/(?:.*/)?{act}(?:[/._-].*)?\Z", (x, act)


#: Pages that hold no text of their own, by (pattern, literal tokens that fitting URLs have).
PAGE_SHAPES = (
    *((rf"#.*/wp-{x}(?:[/.].*)?\Z", ("wp", x)) for x in ("admin", "login", "json", "cron")),
    (r"#(?:.*/)?cgi-bin/", ("cgi", "bin")),
    (r"#(?:.*/)?calendar/[0-9]{4}(?:[/-][0-9]{1,2}){1,2}/?\Z", ("calendar",)),
    (r"#(?:.*/)?page/[0-9]{3,}/?\Z", ("page",)),
    (r"#.*;jsessionid=[0-9a-f]+", ("jsessionid",)),
    *((rf"#(?:.*/)?{x}\.xml\Z", (x, "xml")) for x in ("feed", "rss", "atom")),
    *((rf"#(?:.*/)?{x}/feed/?\Z", (x, "feed")) for x in ("blog", "comments", "posts")),
    (r"#(?:.*/)?tag/[^/]+/page/[0-9]+/?\Z", ("tag", "page")),
    *((rf"#(?:.*/)?{x}/(?:add|item|step)(?:[^a-z].*)?\Z", (x,)) for x in ("cart", "checkout", "basket")),
    (r"\A[0-9]+(?:\.[0-9]+){3}(?::[0-9]+)?#", ()),
)
#: The method's own verdicts where no given rule fits: some 13,000 rules.
PATTERN_RULES = tuple(Rule(None, "block", pattern, tokens, 0, True) for pattern, tokens in (*junk_shapes(), *PAGE_SHAPES))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rarest_tokens(urls: DataFrame, rules: tuple[Rule, ...]) -> dict[str, list[Rule]]:
    """Rules by their rarest token in these URLs (columns host, path); ties by code point.

    Only tokens that occur in rules come to the driver. A rule without tokens is under the empty token.
    """
    wanted = sorted({t for r in rules for t in r.tokens})
    tokens = urls.select(F.explode(F.array_distinct(F.regexp_extract_all(F.translate(F.concat("host", F.lit(MARK), "path"), _UPPER, _LOWER), F.lit(TOKEN_PATTERN), F.lit(0)))).alias("token"))
    named = tokens.sparkSession.createDataFrame([(t,) for t in wanted], "token string")
    counts = dict(map(tuple, tokens.join(F.broadcast(named), "token", "left_semi").groupBy("token").count().collect())) if wanted else {}
    index: dict[str, list[Rule]] = defaultdict(list)
    for rule in rules:
        index[min(rule.tokens, key=lambda t: (counts.get(t, 0), t), default="")].append(rule)
    return dict(index)


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...], url_col: str = "url", default: str = "allow") -> DataFrame:
    """pages with columns host, path, rule, verdict (of the same names are replaced).

    Null URLs and those without ``://`` have an empty host and path and get the default verdict unless
    a rule without tokens fits. Hosts and paths may hold any character, line breaks included, and be of
    any length; patterns look at the whole of them. Rows are independent of each other: ties and repeats
    do not matter. No rows in, no rows out.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} are held by each task")
    split = pages.withColumn("host", host_of(F.col(url_col))).withColumn("path", path_of(F.col(url_col)))
    index = rarest_tokens(split.select("host", "path"), rules)

    @F.pandas_udf("rule string, verdict string")
    def judged(series: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        ready = {t: [(r.length, r.action == "block", r.name or "", r) for r in found] for t, found in index.items()}
        always = ready.get("", [])
        compiled: dict[str, re.Pattern] = {}  # of rules that were fetched; most never are

        def fits(rule: Rule, url: str) -> bool:
            if rule.pattern not in compiled:
                compiled[rule.pattern] = re.compile(rule.pattern, re.S)
            return compiled[rule.pattern].search(url) is not None

        for hosts, paths in series:
            out = []
            for host, path in zip(hosts, paths, strict=True):
                url = host + MARK + path
                low = lowered(url)
                best = None
                candidates = always + [c for t in set(TOKEN.findall(low)) for c in ready.get(t, ())]
                for c in candidates:
                    if (best is None or c[:3] > best[:3]) and fits(c[3], low if c[3].fold else url):
                        best = c
                out.append((None, default) if best is None else (best[3].name, best[3].action))
            yield pd.DataFrame(out, columns=["rule", "verdict"])

    bounded_batches(pages.sparkSession)
    found = split.withColumn("__ls_found", judged("host", "path"))
    return found.withColumn("rule", F.col("__ls_found.rule")).withColumn("verdict", F.col("__ls_found.verdict")).drop("__ls_found")
