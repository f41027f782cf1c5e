"""Crawl policy: robots documents to rules and verdicts (C6-C10), compliance roll-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import urls as U
from ..functions.regex import blank_to_null, trim
from ..functions.times import before
from ..stages import let, once

FRESH_HOURS = 24
_LINE_END = r"\r\n|\r|\n"
_SIGNALS = ["search", "ai_input", "ai_train"]


def robots_status(docs: DataFrame) -> DataFrame:
    """What the fetch status of a robots document allows by itself."""
    s = F.col("status")
    return docs.withColumn("status_verdict", F.when(s.between(200, 299), "allowed")
                           .when(s.isin(401, 403, 429), "unknown")
                           .when(s.between(400, 499), "allowed").otherwise("unknown"))


def _lines(body: Column) -> Column:
    """The directives of a document in order, as ``(is_comment, field, value)``; a comment may hold one too."""
    lines = F.transform(F.split(body, _LINE_END), lambda raw: F.struct(raw.alias("raw"), trim(raw).alias("t")))
    texts = F.transform(lines, lambda x: F.struct(F.startswith(x["t"], F.lit("#")).alias("c"), F.when(
        F.startswith(x["t"], F.lit("#")), trim(F.substring(x["t"], 2, 1 << 30))).otherwise(trim(F.substring_index(x["raw"], "#", 1))).alias("d")))
    named = F.transform(F.filter(texts, lambda x: F.contains(x["d"], F.lit(":"))), lambda x: F.struct(
        x["c"].alias("is_comment"), trim(F.lower(F.substring_index(x["d"], ":", 1))).alias("field"), trim(F.substr(x["d"], F.locate(":", x["d"]) + 1)).alias("value")))
    return F.filter(named, lambda x: x["field"] != "")


def _groups(directives: str, starts: str) -> Column:
    """The groups of a document: agents in lower case, the last valid delay, and rules in order.

    ``starts`` are the places at which a run of agent lines begins; a group reaches to the next one.
    """
    def group(s: Column, k: Column) -> Column:
        end = F.when(k + 1 < F.size(starts), F.get(starts, k + 1)).otherwise(F.size(directives))
        return F.slice(directives, s + 1, end - s)

    delays = lambda g: F.filter(F.transform(F.filter(g, lambda x: x["field"] == "crawl-delay"), lambda x: x["value"].try_cast("double")),
                                lambda d: (d >= 0) & (d < float("inf")))
    rules = lambda g: F.transform(F.filter(g, lambda x: x["field"].isin("allow", "disallow") & F.startswith(x["value"], F.lit("/"))),
                                  lambda x: F.struct(x["field"].alias("kind"), x["value"].alias("pattern")))
    return F.transform(F.transform(starts, group), lambda g: F.struct(
        F.transform(F.filter(g, lambda x: x["field"] == "user-agent"), lambda x: F.lower(x["value"])).alias("agents"),
        F.get(F.reverse(delays(g)), F.lit(0)).alias("crawl_delay"), rules(g).alias("rules")))


def _parsed(docs: DataFrame) -> DataFrame:
    """Add ``_all`` (all directives) and ``_groups`` to documents; all work stays in the row of a document."""
    df = once(docs, {"_all": _lines(F.col("body"))})
    df = once(df, {"_dirs": F.filter("_all", lambda x: ~x["is_comment"] & ~((x["field"] == "user-agent") & (x["value"] == "")))})
    agent = lambda i: F.get("_dirs", i)["field"] == "user-agent"
    begins = F.transform("_dirs", lambda x, i: F.when((x["field"] == "user-agent") & ((i == 0) | ~F.coalesce(agent(i - 1), F.lit(False))), i))
    df = once(df, {"_starts": F.filter(begins, lambda i: i.isNotNull())})
    return once(df, {"_groups": _groups("_dirs", "_starts")}).drop("_dirs", "_starts")


def robots_rules(docs: DataFrame) -> DataFrame:
    """Rule rows of every robots document.

    Consecutive agent lines share a group and any other directive ends the run.  Groups without rules
    keep one row with a NULL pattern, since an empty group still counts when an agent is looked up.
    """
    groups = _parsed(docs.where("body is not null").select("origin", "body")).select("origin", F.posexplode("_groups").alias("no", "g"))
    return groups.select("origin", (F.col("no") + 1).cast("long").alias("group_no"), "g.agents", "g.crawl_delay", F.posexplode_outer("g.rules").alias(
        "rule_no", "r")).select("origin", "group_no", "agents", "crawl_delay", "rule_no", F.col("r.kind").alias("kind"),
                                F.col("r.pattern").alias("pattern"), F.length("r.pattern").alias("length"))


def _signals(lines: str) -> Column:
    """C8 of a document: what its content signals say; of several the last one counts."""
    values = F.transform(F.filter(lines, lambda x: x["field"] == "content-signal"), lambda x: F.filter(F.split(x["value"], ","), lambda p: F.contains(p, F.lit("="))))
    parts = F.transform(F.flatten(values), lambda p: F.struct(trim(F.lower(F.substring_index(p, "=", 1))).alias("key"), trim(F.substr(p, F.locate("=", p) + 1)).alias("raw")))

    def last(parts: Column, key: str) -> Column:
        return F.get(F.reverse(F.filter(parts, lambda p: p["key"] == key)), F.lit(0))["raw"]

    def flag(raw: Column) -> Column:
        return F.when(F.lower(raw) == "yes", True).when(F.lower(raw) == "no", False)

    return let(parts, lambda ps: F.struct(*[flag(last(ps, n.replace("_", "-"))).alias(n) for n in _SIGNALS], blank_to_null(last(ps, "use")).alias("use")))


def robots_signals(docs: DataFrame) -> DataFrame:
    """Content signals per document, from the directive or its comment form; the last one wins.

    NULL means the operator stated nothing, which is not a refusal.
    """
    df = once(docs.select("origin", "body"), {"_all": _lines(F.col("body"))})
    return df.select("origin", _signals("_all").alias("s")).select("origin", "s.*")


def _policy(groups: str, agent: str) -> Column:
    """The group that speaks to ``agent``, with its rules as ``(length, allow, pattern)``; NULL without one.

    The longest agent token contained in ours wins, the first group on ties; ``*`` is the fallback.
    """
    def rank(g: Column) -> Column:
        named = F.array_max(F.transform(F.filter(g["agents"], lambda a: (a != "*") & F.contains(F.lit(agent.lower()), a)), lambda a: F.length(a)))
        return F.coalesce(named, F.when(F.array_contains(g["agents"], "*"), F.lit(0)))

    ranked = F.filter(F.transform(groups, lambda g, k: F.struct(rank(g).alias("rank"), (-k).alias("k"))), lambda r: r["rank"].isNotNull())
    mine = let(F.array_max(ranked), lambda r: F.get(groups, -r["k"]))
    return let(mine, lambda g: F.when(g.isNotNull(), F.struct(g["crawl_delay"].alias("crawl_delay"), F.transform(g["rules"], lambda r: F.struct(
        F.length(r["pattern"]).alias("length"), (r["kind"] == "allow").alias("allow"), r["pattern"].alias("pattern"))).alias("rules"))))


def _pattern_hit(pattern: Column, path: Column) -> Column:
    """Robots pattern test: the pieces between ``*`` follow one another in the path; ``$`` ends it."""
    anchored = F.endswith(pattern, F.lit("$"))
    pieces = F.split(F.when(anchored, F.substr(pattern, F.lit(1), F.length(pattern) - 1)).otherwise(pattern), r"\*", -1)

    def follow(ps: Column) -> Column:
        n = F.size(ps)
        inner = F.slice(ps, F.lit(2), F.greatest(n - F.when(anchored, 2).otherwise(1), F.lit(0)))
        # The place behind the last piece found, 0 once one is missing.
        after = F.aggregate(inner, F.length(F.get(ps, F.lit(0))) + 1, lambda at, p: F.when((at == 0) | (p == ""), at).otherwise(
            let(_locate(p, path, at), lambda found: F.when(found == 0, 0).otherwise(found + F.length(p)))))
        last = F.get(ps, n - 1)
        tail = F.when(~anchored, True).when(n == 1, path == last).otherwise(F.endswith(path, last) & (F.length(path) - F.length(last) + 1 >= after))
        return F.startswith(path, F.get(ps, F.lit(0))) & (after > 0) & tail

    return let(pieces, follow)


def _locate(piece: Column, text: Column, start: Column) -> Column:
    return F.call_function("locate", piece, text, start)


def _judged(df: DataFrame) -> DataFrame:
    """Verdict and evidence of rows that have ``_u``, ``_path`` and the ``_rules`` of their origin (NULL without a group)."""
    best = F.array_max(F.filter("_rules", lambda r: _pattern_hit(r["pattern"], F.col("_path"))))
    df = once(df, {"_best": best})
    won = F.col("_best").isNotNull()
    return df.withColumns({
        "verdict": F.when(~U.Url("_u").known, "unknown").when(won & ~F.col("_best.allow"), "disallowed")
            .otherwise("allowed"),
        "evidence": F.when(~U.Url("_u").known, F.concat(F.lit("Unparseable URL: "), F.col("url")))
            .when(F.col("_rules").isNull(), "No applicable robots group; default allow")
            .when(won, F.concat(F.when(F.col("_best.allow"), "Allow").otherwise("Disallow"), F.lit(": "),
                                F.col("_best.pattern"), F.lit(" matched "), F.col("_path")))
            .otherwise(F.concat(F.lit("No matching rule for "), F.col("_path"), F.lit("; default allow"))),
    }).drop("_best", "_rules", "_path")


def _addressed(urls: DataFrame) -> DataFrame:
    df = U.with_url(urls, "url", "_u")
    return df.withColumns({"origin": U.origin_of(U.Url("_u")), "_path": F.concat(U.Url("_u")["path"], U.Url("_u")["query"])})


def robots_verdicts(urls: DataFrame, docs: DataFrame, agent: str) -> DataFrame:
    """Add ``origin``, ``verdict``, ``evidence`` and ``crawl_delay`` to rows with a ``url``.

    The rules of an origin travel as one array, so each address stays one row: the longest matching
    pattern wins and allow wins ties.  Documents have one row per origin.
    """
    policies = once(_parsed(docs.where("body is not null").select("origin", "body")), {"_p": _policy("_groups", agent)}).select(
        "origin", F.col("_p.crawl_delay").alias("crawl_delay"), F.col("_p.rules").alias("_rules"))
    return U.drop_url(_judged(_addressed(urls).join(policies, ["origin"], "left")), "_u")


def robots_gate(urls: DataFrame, docs: DataFrame, agent: str, as_of, mode: str = "observe") -> DataFrame:
    """May each address be fetched, judged from robots documents younger than a day.

    An origin without a fresh document is ``stale``: its document must be fetched first.  Only an
    explicit allowance clears the gate; ``observe`` reports what ``enforce`` would block.  Status, signals and policy of a
    document are read in its row, so addresses and documents meet in one join.
    """
    fresh = robots_status(docs).where(F.col("fetched_at") > before(as_of, hours=FRESH_HOURS))
    usable = F.col("error").isNull() & (F.col("status_verdict") == "allowed")
    df = _parsed(fresh)
    facts = once(df, {"_p": F.when(usable, _policy("_groups", agent))}).select(
        "origin", "status", "status_verdict", "error", (F.coalesce(F.length("body"), F.lit(0)) > 0).alias("_has_body"),
        _signals("_all")["ai_input"].alias("ai_input"), F.col("_p.crawl_delay").alias("_d"), F.col("_p.rules").alias("_rules"))
    df = _judged(_addressed(urls).join(facts, ["origin"], "left")).withColumnsRenamed({"verdict": "_v", "evidence": "_e"})
    known = F.col("_has_body").isNotNull()
    http = F.col("status").cast("string")
    state = (
        F.when(F.col("origin").isNull(), "bad_url").when(~known, "stale").when(F.col("error").isNotNull(), "error")
        .when(F.col("status_verdict") == "unknown", "unreachable").when(~F.col("_has_body"), "none").otherwise("rules"))
    df = df.withColumn("_state", state)
    verdict = F.when(F.col("_state") == "rules", F.col("_v")).when(F.col("_state") == "none", "allowed").otherwise("unknown")
    evidence = (
        F.when(F.col("_state").isin("rules", "bad_url"), F.col("_e"))
        .when(F.col("_state") == "stale", "No fresh robots.txt on record")
        .when(F.col("_state") == "error", F.concat(F.lit("robots.txt fetch failed: "), F.col("error")))
        .when(F.col("_state") == "unreachable", F.concat(
            F.lit("robots.txt unreachable (HTTP "), http, F.lit("); operator intent unknown")))
        .otherwise(F.concat(F.lit("No robots.txt published (HTTP "), http, F.lit("); no restrictions"))))
    blocked = F.col("verdict") != "allowed"
    rules = F.col("_state") == "rules"
    return U.drop_url(df.withColumns({"verdict": verdict, "evidence": evidence}).withColumns({
        "crawl_delay": F.when(rules, F.col("_d")),
        "ai_input_allowed": F.when(rules, F.coalesce(F.col("ai_input"), F.lit(True))).otherwise(True),
        "would_block": blocked,
        "allowed": ~blocked if mode == "enforce" else F.lit(True),
        "mode": F.lit(mode),
    }).drop("_v", "_e", "_d", "_state", "_has_body", "status", "status_verdict", "error", "ai_input"), "_u")


def robots_rollup(events: DataFrame) -> DataFrame:
    """per origin the checks, would-blocks and refusals on record."""
    return events.where(F.col("robots_origin").isNotNull()).groupBy("robots_origin").agg(
        F.count(F.lit(1)).alias("checks"),
        F.count_if("robots_would_block").alias("would_block"),
        F.count_if(F.col("robots_verdict") == "disallowed").alias("disallowed"),
        F.count_if(F.col("robots_verdict") == "unknown").alias("unknown"))


