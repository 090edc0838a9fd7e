"""URL rules found through their rarest literal token.

A rule has literal parts and a regular expression. Each rule is indexed by the one of its
literal tokens that the fewest URLs hold, once for each of its alternatives; a URL's tokens fetch the
rules indexed by them, and only those run their expression. The longest rule that fits gives the
verdict. Tokens are runs of letters and runs of digits, so casino is a token of casino24.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

_TOKENS = "[a-z]+|[0-9]+"
_TOKEN = re.compile(_TOKENS)
#: Rule tables up to this many rows are broadcast; larger ones are joined by shuffle.
_FEW_RULES = 10_000

#: Words that block a host or a path where they stand alone, with digits after them or not, and parts of paths that lead to no text.
BLOCKED_WORDS = (
    "casino", "poker", "roulette", "jackpot", "slots", "betting", "free-bets", "sportsbook", "cheap-pills", "pharmacy", "viagra", "weight-loss", "porn", "xxx", "escort", "camgirls", "hookup", "warez", "torrents", "keygen", "cracked-software", "serial-keys", "payday-loans",
    "get-rich-quick", "fake-watches", "link-farm", "buy-followers", "clickbank", "adserver", "doubleclick", "popunder", "tracking-pixel", "malware",
)
BLOCKED_PATHS = ("logout", "register", "cart", "checkout", "wishlist", "wp-admin", "wp-login", "cgi-bin", "unsubscribe", "password-reset", "captcha", "search-results", "print-version", "share-by-mail")


def word_pattern(word: str) -> tuple[str, str, str, str]:
    """(name, expression over host and path, verdict, literal)."""
    return word, rf"(^|[./-]){word}[0-9]*([./-]|$)", "block", word


def path_pattern(part: str) -> tuple[str, str, str, str]:
    return part, rf"/{part}([./?-]|$)", "block", part


#: Patterns for URLs that no host rule covers: (name, expression over host and path, verdict, literals).
PATTERNS = (*map(word_pattern, BLOCKED_WORDS), ("login", r"/(login|signin)([./?-]|$)", "block", "login", "signin"), *map(path_pattern, BLOCKED_PATHS))


def host_rule(host: str, path: str, verdict: str) -> dict:
    """A rule for a host and all its subdomains, and for paths that start with ``path``."""
    # a token at either end of the path may go on in the URL, so only closed ones are literal tokens
    tokens = _TOKEN.findall(host) + [m[0] for m in _TOKEN.finditer(path) if 0 < m.start() and m.end() < len(path)]
    return {"rule": host + path, "pattern": rf"^([^/]*\.)?{re.escape(host)}{re.escape(path)}", "verdict": verdict, "tokens": [tokens], "rank": 1_000_000 + len(host + path)}


def pattern_rule(name: str, pattern: str, verdict: str, *literals: str) -> dict:
    """A rule by expression; every match holds at least one of ``literals`` as whole tokens.

    A literal that may go on with letters of its own kind (``pill`` in ``pills``) must not be given: the
    rule would not be fetched. Without literals the rule is tried on every URL.
    """
    return {"rule": name, "pattern": pattern, "verdict": verdict, "tokens": [_TOKEN.findall(x) for x in literals], "rank": len(name)}


def url_parts(url):
    """Columns (host, path) of a URL column; both empty for null or a URL without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), upper, lower)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def judge_urls(pages: DataFrame, rules: list[dict], default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict, fallback_rule for every row.

    ``rules``: dicts of ``host_rule`` and ``pattern_rule``. Host rules (``rule``) win over pattern
    rules (``fallback_rule``); among each the longest, then the first by name. Without a fitting
    rule the verdict is ``default``. Null URLs and URLs without ``://`` have an empty host and path, and
    fit no host rule. Each row gets a result, repeated or not. Rules without a literal token are
    tried on every URL. An empty table gives no rows. Other columns are ignored.
    """
    spark = pages.sparkSession
    host, path = url_parts(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url").select("page_id", host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("row_id"))
    scratch = Scratch(spark, "urls")
    rows = scratch.cut(rows, "parts")
    target = F.concat("host", "path")
    tokens = F.array_distinct(F.regexp_extract_all(F.lower(target), F.lit(_TOKENS), F.lit(0)))

    schema = "rule string, pattern string, verdict string, tokens array<array<string>>, rank int"
    table = spark.createDataFrame([tuple(r[k] for k in ("rule", "pattern", "verdict", "tokens", "rank")) for r in rules], schema)
    few = len(rules) <= _FEW_RULES
    how = "broadcast" if few else "merge"
    # the rarest token of each alternative of a rule, by the number of URLs that hold it
    each = table.select("rule", F.posexplode("tokens").alias("alternative", "tokens")).select("rule", "alternative", F.explode("tokens").alias("token"))
    wanted = each.select("token").distinct()
    held = rows.select(F.explode(tokens).alias("token")).join(wanted.hint(how), "token").groupBy("token").agg(F.count("*").alias("urls"))
    ranked = each.join(held.hint(how), "token", "left")
    rarest = ranked.groupBy("rule", "alternative").agg(F.min(F.struct(F.coalesce("urls", F.lit(0)).alias("urls"), "token")).alias("x")).select("rule", F.col("x.token").alias("token")).distinct()
    index = scratch.cut(table.drop("tokens").join(rarest.hint(how), "rule", "left").withColumn("token", F.coalesce("token", F.lit(""))), "index")

    # rules without a literal stand under the empty token, which every URL then asks for
    for_all = [""] if any(not x for r in rules for x in r["tokens"] or [[]]) else []
    asked = rows.select("row_id", target.alias("target"), F.explode(F.concat(F.array(*map(F.lit, for_all)).cast("array<string>"), tokens)).alias("token"))
    fits = asked.join(index.hint(how), "token").filter(F.expr("target rlike pattern"))
    best = fits.groupBy("row_id").agg(F.min_by(F.struct("rule", "verdict", "rank"), F.struct(-F.col("rank"), "rule", "verdict")).alias("best"))
    out = rows.join(best.hint("merge"), "row_id", "left")
    by_host = F.col("best.rank") >= 1_000_000
    return out.select("page_id", "host", "path", F.when(by_host, F.col("best.rule")).alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"), F.when(~by_host, F.col("best.rule")).alias("fallback_rule"))
