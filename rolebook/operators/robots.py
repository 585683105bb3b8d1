"""Crawl policies over a URL table: longest match wins, ties disallow."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolebook import vocab
from rolebook.functions.urls import host_of, path_of, query_of
from rolebook.session import cut

_STATE = "struct<agents:array<string>,open:boolean,known:array<string>,rules:array<struct<agent:string,allow:boolean,pattern:string>>>"


def percent_decode(c: Column) -> Column:
    """Percent-decoding that leaves ``+`` and malformed escapes alone."""
    plus_safe = F.replace(c, F.lit("+"), F.lit("%2B"))
    return F.coalesce(F.try_url_decode(plus_safe), c)


def _lines(body: Column) -> Column:
    cleaned = F.transform(F.split(body, r"\r\n|\r|\n"), lambda s: F.trim(F.substring_index(s, "#", 1)))
    fields = F.filter(cleaned, lambda s: F.contains(s, F.lit(":")))
    return F.transform(
        fields,
        lambda s: F.struct(
            F.lower(F.trim(F.substring_index(s, ":", 1))).alias("field"),
            F.trim(F.substr(s, F.instr(s, ":") + 1)).alias("value"),
        ),
    )


def looks_like_policy(body: Column) -> Column:
    """Empty is a valid allow-all; other text needs one known directive."""
    known = F.exists(_lines(body), lambda f: f["field"].isin(*vocab.ROBOTS_FIELDS))
    return (F.trim(F.regexp_replace(body, r"\s+", " ")) == "") | known


def parse_policy(body: Column) -> Column:
    """Struct(known agents, rules) of one policy text. Stacked agents share
    the rules below them; rules before any agent count for ``*``."""
    start = F.from_json(F.lit('{"agents":[],"open":true,"known":[],"rules":[]}'), _STATE)

    def step(state, line):
        is_agent = line["field"] == "user-agent"
        is_rule = line["field"].isin("allow", "disallow")
        name = F.lower(line["value"])
        agents = F.when(is_agent & state["open"], F.array_append(state["agents"], name)).when(
            is_agent, F.array(name)
        ).otherwise(state["agents"])
        targets = F.when(F.size(state["agents"]) == 0, F.array(F.lit("*"))).otherwise(state["agents"])
        added = F.transform(
            targets,
            lambda a: F.struct(a.alias("agent"), (line["field"] == "allow").alias("allow"), line["value"].alias("pattern")),
        )
        return F.struct(
            agents.alias("agents"),
            F.when(is_agent, True).when(is_rule, False).otherwise(state["open"]).alias("open"),
            F.when(is_agent, F.array_append(state["known"], name))
            .when(is_rule, F.concat(state["known"], targets))
            .otherwise(state["known"])
            .alias("known"),
            F.when(is_rule, F.concat(state["rules"], added)).otherwise(state["rules"]).alias("rules"),
        ).cast(_STATE)

    state = F.aggregate(_lines(body), start, step)
    return F.struct(F.array_distinct(state["known"]).alias("known"), state["rules"].alias("rules"))


def _matcher(pattern: Column) -> Column:
    """Struct(literal prefix or NULL, regex, length) of a decoded pattern."""
    p = percent_decode(pattern)
    quoted = F.replace(p, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    quoted = F.replace(F.replace(quoted, F.lit("*"), F.lit("\\E.*\\Q")), F.lit("$"), F.lit("\\E$\\Q"))
    return F.struct(
        F.when(~p.rlike(r"[*$]"), p).alias("prefix"),
        F.concat(F.lit("^\\Q"), quoted, F.lit("\\E")).alias("regex"),
        F.length(p).alias("len"),
    )


def policy_table(policies: DataFrame) -> DataFrame:
    """One row per host: ``state`` (rules, open, unconfirmed), known agents and
    ready-made rules. ``policies`` has host, http_status and body; of several rows for
    a host, in any case, the best answered one counts (200, then 404), ties by body."""
    best = F.min(F.struct(F.when(F.col("http_status") == 200, 0).when(F.col("http_status") == 404, 1).otherwise(2).alias("o"), "http_status", "body"))
    policies = policies.groupBy(F.lower("host").alias("host")).agg(best.alias("p")).select("host", "p.http_status", "p.body")
    parsed = policies.select(
        F.lower("host").alias("host"), "http_status",
        F.coalesce("body", F.lit("")).alias("body"),
    ).select("host", "http_status", looks_like_policy(F.col("body")).alias("is_policy"), parse_policy(F.col("body")).alias("p"))
    rules = F.transform(
        F.filter("p.rules", lambda r: r["pattern"] != ""),
        lambda r: F.struct(r["agent"].alias("agent"), r["allow"].alias("allow"), _matcher(r["pattern"]).alias("m")),
    )
    state = (
        F.when(F.col("http_status") == 404, "open")
        .when((F.col("http_status") == 200) & F.col("is_policy"), "rules")
        .otherwise("unconfirmed")
    )
    return parsed.select("host", state.alias("state"), F.col("p.known").alias("known"), rules.alias("rules"))


def _allowed(agent: str, path: Column) -> Column:
    name = agent.lower()
    use = F.when(F.array_contains("known", name), F.lit(name)).otherwise(F.lit("*"))
    mine = F.filter("rules", lambda r: r["agent"] == use)
    hits = F.filter(
        mine,
        lambda r: F.when(r["m"]["prefix"].isNotNull(), F.startswith(path, r["m"]["prefix"])).otherwise(
            F.rlike(path, r["m"]["regex"])
        ),
    )
    best = F.array_max(F.transform(hits, lambda r: F.struct(r["m"]["len"].alias("len"), (~r["allow"]).alias("deny"))))
    return ~F.coalesce(best["deny"], F.lit(False))


def robots_filter(urls: DataFrame, policies: DataFrame, agents: Sequence[str] = ("*",), column: str = "url") -> DataFrame:
    """Adds ``robots``: allowed, disallowed or unconfirmed.

    The policies are reduced to one row a host, so the join never multiplies URLs, and the
    rules are evaluated inside the row.
    """
    joined = urls.withColumns({"host": host_of(column), "_path": _path(column)}).join(policy_table(policies), "host", "left")
    ok = F.lit(True)
    for agent in agents:
        ok = ok & _allowed(agent, F.col("_path"))
    verdict = (
        F.when(F.col("state") == "open", "allowed")
        .when(F.col("state") == "rules", F.when(ok, "allowed").otherwise("disallowed"))
        .otherwise("unconfirmed")
    )
    return joined.withColumn("robots", verdict).drop("_path", "state", "known", "rules")


def _path(column: str) -> Column:
    query = query_of(column)
    return F.concat(percent_decode(path_of(column)), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def rule_table(policies: DataFrame) -> DataFrame:
    """(host, agent, deny, head, regex, len): one row a rule of hosts with a policy. ``head`` is its
    pattern up to the first wildcard; ``regex`` is null where the head is all of it."""
    rules = policies.select("host", F.explode("rules").alias("r"))
    m = F.col("r.m")
    quoted = F.regexp_extract(m["regex"], r"^\^\\Q(.*?)\\E(?:\.\*|\$|$)", 1)
    return rules.select(
        "host", F.col("r.agent").alias("agent"), (~F.col("r.allow")).alias("deny"),
        F.coalesce(m["prefix"], quoted).alias("head"), F.when(m["prefix"].isNull(), m["regex"]).alias("regex"), m["len"].alias("len"),
    )


def robots_filter_many(urls: DataFrame, policies: DataFrame, agents: Sequence[str] = ("*",), column: str = "url") -> DataFrame:
    """:func:`robots_filter` for hosts with very many rules and URLs: adds ``robots``.

    Rules are a table keyed by host and literal head. A path looks up its prefixes of the lengths that
    its host's heads have, in an equi join; patterns are tried only behind their head, and the longest match is
    an aggregate. No row holds a host's rules, and each different path is judged once.
    """
    known = cut(policy_table(policies))
    rules = cut(rule_table(known.filter("state = 'rules'")))
    lengths = rules.groupBy("host").agg(F.collect_set(F.length("head")).alias("_lengths"))
    rows = urls.withColumns({"host": host_of(column), "_path": _path(column)})
    # rules of an agent that the policy names, else those of all agents
    asked = known.select("host", F.explode(F.array_distinct(F.array(*[F.when(F.array_contains("known", a.lower()), F.lit(a.lower())).otherwise(F.lit("*")) for a in agents]))).alias("agent"))
    paths = rows.select("host", "_path").distinct().join(lengths, "host")
    heads = paths.select("host", "_path", F.explode(F.filter("_lengths", lambda n: n <= F.length("_path"))).alias("n"))
    heads = heads.select("host", "_path", F.substring("_path", F.lit(1), F.col("n")).alias("head"))
    met = heads.join(rules.join(asked, ["host", "agent"], "left_semi"), ["host", "head"])
    hits = met.filter(F.col("regex").isNull() | F.rlike("_path", F.col("regex")))
    # of each agent the longest rule counts, of equal ones the one that denies; any agent's denial counts
    best = hits.groupBy("host", "_path", "agent").agg(F.max(F.struct("len", "deny")).alias("b"))
    denied = best.groupBy("host", "_path").agg(F.max("b.deny").alias("_denied"))
    denied = denied.select(F.col("host").alias("_host"), F.col("_path").alias("_p"), "_denied")
    out = rows.join(known.select("host", "state"), "host", "left")
    out = out.join(denied, (F.col("host") == F.col("_host")) & (F.col("_path") == F.col("_p")), "left")
    verdict = (
        F.when(F.col("state") == "open", "allowed")
        .when(F.col("state") == "rules", F.when(F.coalesce("_denied", F.lit(False)), "disallowed").otherwise("allowed"))
        .otherwise("unconfirmed")
    )
    return out.withColumn("robots", verdict).drop("_path", "state", "_host", "_p", "_denied")
