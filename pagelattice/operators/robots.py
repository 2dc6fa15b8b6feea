"""Robots rules: parsing, access tests and per-site reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pagelattice.functions import text as tx, urls
from pagelattice.functions.binding import let
from pagelattice.operators.skew import Heavy, skew_join
from pagelattice.session import cut_lineage

# All that ends a line of text, not only of files.
_LINE_BREAK = r"\r\n|[\r\n\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
_NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"


def usable(body: Column) -> Column:
    """Bodies that look like HTML or JSON hold no rules."""
    folded = F.lower(body)
    return ~(
        F.contains(folded, F.lit("<html"))
        | F.contains(folded, F.lit("<!doctype"))
        | tx.strip_text(body).startswith("{")
    )


def _lines(body: Column) -> Column:
    return F.when(usable(body), F.split(tx.strip_text(body), _LINE_BREAK, -1)).otherwise(
        F.array().cast("array<string>")
    )


def parse_rules(robots: DataFrame, agent: str = "*") -> DataFrame:
    """Rules that apply to ``agent``: (host, rule_order, allow, path) in file order.

    A group is a run of user-agent lines with the rules up to the next run or blank line. The
    first group naming the agent applies, else the first group for all agents. Lines are narrow
    and bounded by one file per host; all windows share one exchange on the host.
    """
    token = agent.split("/")[0].lower()
    line = F.col("line")
    clean = tx.strip_text(F.substring_index(line, "#", 1))
    rows = (
        robots.where(usable(F.col("body")))
        .select("host", F.posexplode(_lines(F.col("body"))).alias("ln", "line"))
        .select(
            "host",
            "ln",
            (line == "").alias("blank"),
            F.contains(clean, F.lit(":")).alias("keyed"),
            F.lower(tx.strip_text(F.substring_index(clean, ":", 1))).alias("field"),
            urls.percent_decode(tx.strip_text(F.regexp_extract(clean, r"^[^:]*:(.*)", 1))).alias("value"),
        )
    )
    is_agent = F.col("field") == "user-agent"
    is_rule = F.col("field").isin("allow", "disallow", "crawl-delay", "request-rate")
    rows = rows.where(F.col("blank") | (F.col("keyed") & (is_agent | is_rule)))
    in_file = Window.partitionBy("host").orderBy("ln").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("block", F.sum(F.col("blank").cast("int")).over(in_file)).where(~F.col("blank"))
    in_block = Window.partitionBy("host", "block").orderBy("ln")
    opens = is_agent & ~F.coalesce(F.lag(is_agent).over(in_block), F.lit(False))
    rows = rows.withColumn("opens", opens.cast("int")).withColumn(
        "part", F.sum("opens").over(in_block.rowsBetween(Window.unboundedPreceding, 0))
    )
    rule = F.when(
        F.col("field").isin("allow", "disallow"),
        F.struct(
            "ln",
            ((F.col("field") == "allow") | (F.col("value") == "")).alias("allow"),
            F.col("value").alias("path"),
        ),
    )
    named = F.lit(token).contains(F.lower(F.col("value")))
    groups = (
        rows.where(F.col("part") > 0)
        .groupBy("host", "block", "part")
        .agg(
            F.max(is_rule).alias("has_rule"),
            F.max(F.coalesce(is_agent & (F.col("value") == "*"), F.lit(False))).alias("for_all"),
            F.max(F.coalesce(is_agent & named, F.lit(False))).alias("named"),
            F.array_sort(F.collect_list(rule)).alias("rules"),
        )
        .where(F.col("has_rule") & (F.col("for_all") | F.col("named")))
    )
    chosen = groups.groupBy("host").agg(
        F.min_by("rules", F.struct(F.col("for_all"), F.col("block"), F.col("part"))).alias("rules")
    )
    return chosen.select("host", F.posexplode("rules").alias("rule_order", "r")).select(
        "host", "rule_order", "r.allow", "r.path"
    )


#: Rules of a host up to which each URL tests them one after another; beyond, its prefixes are looked up.
FEW_RULES = 100


class RuleIndex:
    """Rules laid out for look-ups, built once: one row per host, and rule paths of hosts with many.

    A host with up to ``few`` rules keeps them as one array in file order. A host with more keeps the
    distinct lengths of its paths: a URL can match no other prefix of its own, so it gives one row
    per length, whatever the number of rules. Both are bounded by one robots file.
    """

    def __init__(self, rules: DataFrame, few: int = FEW_RULES):
        entry = F.struct("rule_order", "allow", "path")
        stored = cut_lineage(rules.groupBy("host").agg(F.array_sort(F.collect_list(entry)).alias("rules")))
        many = F.size("rules") > few
        lengths = F.array_distinct(F.transform("rules", lambda r: F.char_length(r["path"])))
        self.hosts = stored.select(
            "host", F.when(~many, F.col("rules")).alias("rules"), F.when(many, lengths).alias("lengths")
        )
        long = stored.where(many)
        self.any_long = not long.isEmpty()
        paths = long.select("host", F.explode("rules").alias("r")).groupBy("host", F.col("r.path").alias("path"))
        self.paths = paths.agg(F.min(F.struct("r.rule_order", "r.allow")).alias("rule")).select(
            _probe(F.col("host"), F.col("path")).alias("probe"), F.col("host").alias("_host"), "path", "rule"
        )

    def verdicts(self, rows: DataFrame, heavy: Heavy | None = None) -> DataFrame:
        """``rows`` (with ``url``) plus ``allowed``."""
        keyed = rows.withColumn("host", urls.authority(F.col("url")))
        met = skew_join(keyed, self.hosts, "host", "left", heavy)
        judged = met.withColumn("allowed", allowed_by(F.col("rules"), F.col("url"))).drop("rules", "host")
        if not self.any_long:
            return judged.drop("lengths")
        asked = met.where(F.col("lengths").isNotNull()).select("url", "host", "lengths").dropDuplicates(["url"])
        refused = self._refused(asked.withColumn("target", _target(F.col("url"))))
        # An address that stands in many rows is a heavy key; only refused ones take part.
        return skew_join(judged, refused, "url", "left").withColumn(
            "allowed", F.col("allowed") & F.col("_refused").isNull()
        ).drop("lengths", "_refused")

    def _refused(self, asked: DataFrame) -> DataFrame:
        """URLs whose first matching rule refuses them, found by their prefixes: (url, ``_refused``)."""
        fitting = F.filter("lengths", lambda n: n <= F.char_length("target"))
        prefixes = asked.select("url", "host", F.explode(F.transform(fitting, lambda n: F.left("target", n))).alias("prefix"))
        probes = prefixes.withColumn("probe", _probe(F.col("host"), F.col("prefix")))
        # The prefix "/" of a large host is one key of very many rows.
        found = skew_join(probes, self.paths, "probe", "inner").where("host = _host and prefix = path")
        first = found.groupBy("url").agg(F.min("rule").alias("rule"))
        return first.where(~F.col("rule.allow")).select("url", F.lit(True).alias("_refused"))


def _probe(host: Column, path: Column) -> Column:
    return F.xxhash64(host, path)


def _target(url: Column) -> Column:
    """What rule paths are compared with: everything after the authority, decoded."""
    rest = F.regexp_replace(urls.percent_decode(url), r"(?s)^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*", "")
    return let(rest, lambda r: F.when(r == "", F.lit("/")).otherwise(r))


def allowed_by(rules: Column, url: Column) -> Column:
    """The first rule whose path is a prefix decides; no such rule means allowed."""
    verdict = let(
        _target(url),
        lambda target: F.get(F.filter(rules, lambda r: F.startswith(target, r["path"])), F.lit(0)),
    )
    return F.coalesce(verdict["allow"], F.lit(True))


def robots_allowed(df: DataFrame, rules: DataFrame, heavy: Heavy | None = None) -> DataFrame:
    """``df`` (with ``url``) plus ``allowed``. A URL meets the few rules of its host in one row, or
    looks its prefixes up among many; no URL-rule pairs are formed. Hosts with very many URLs are
    spread over tasks."""
    return RuleIndex(rules).verdicts(df, heavy)


def skipped_urls(df: DataFrame, rules: DataFrame, heavy: Heavy | None = None) -> DataFrame:
    """Distinct refused URLs. URLs are made distinct first, so a repeated one meets its rules once."""
    verdicts = robots_allowed(df.select("url").distinct(), rules, heavy)
    return verdicts.where(~F.col("allowed")).select("url")


def _field_values(body: Column, field: str) -> Column:
    """Values of all lines that start with a field name, cut at a second colon."""
    hits = F.filter(_lines(body), lambda l: F.startswith(F.lower(l), F.lit(f"{field}:")))
    return F.transform(hits, lambda l: tx.strip_text(F.split(l, ":", -1)[1]))


def _delay(body: Column) -> Column:
    numbers = F.transform(
        _field_values(body, "crawl-delay"), lambda v: F.when(v.rlike(_NUMBER), v.try_cast("double"))
    )
    return F.get(F.reverse(F.filter(numbers, lambda n: n.isNotNull())), F.lit(0))


def crawl_delay(robots: DataFrame) -> DataFrame:
    """Last readable crawl delay of each file, whatever the agent."""
    return robots.select("host", _delay(F.col("body")).alias("crawl_delay"))


def robots_report(robots: DataFrame, first: int = 10) -> DataFrame:
    """Crawl delay, number of non-empty Disallow paths and the first of them, per site.

    One file is one row, so this is a projection without any shuffle.
    """
    paths = F.filter(_field_values(F.col("body"), "disallow"), lambda p: p != "")
    return robots.select(
        "host", _delay(F.col("body")).alias("crawl_delay"), paths.alias("paths")
    ).select(
        "host",
        "crawl_delay",
        F.size("paths").alias("disallowed"),
        F.slice("paths", 1, first).alias("disallowed_paths"),
    )


def effective_delay(delays: DataFrame, base: float) -> DataFrame:
    """The larger of the base delay and the site's own delay."""
    own = F.coalesce(F.col("crawl_delay"), F.lit(0.0))
    return delays.select(
        "host",
        F.when(own == 0.0, F.lit(float(base))).otherwise(F.greatest(F.lit(float(base)), own)).alias("delay"),
    )
