"""URL filter: rules first, then a path-template tree with smoothed labelled purity (DataFrame only).

Per host, path segments become a tree over their whole depth. Numbers and long hexadecimal segments generalise to wildcards. A
branch whose labelled block rate does not differ from its parent's (two-proportion bound) is merged into the parent's wildcard, so
its labels count for all merged siblings; a branch without labels is never merged with labelled ones, so what a rule says of one
branch is no evidence about another, however many branches there are. Labels are the rules' verdicts, and block for hosts with a
word of ``BLOCK_WORDS``. A template is rejected if ``(blocked + PRIOR * PRIOR_N) / (labelled + PRIOR_N) >= REJECT_AT``.

The tree grows level by level over distinct templates with their counts, and only below nodes whose verdict is still open: a node
is settled once it has no label, no page without a rule, one label for all its pages, or one template. Levels at which a node does
not branch are skipped.

Defined results: a null url or one without ``://`` has empty host and path and no rule; unlabelled templates
are allowed; repeated rows count as often as they occur and are judged alike; an empty table gives no rows;
further columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, quoted, small_or_shuffled

RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

# Words that mark a host as unwanted.
BLOCK_WORDS = ("spam", "casino", "pills", "bets", "ads")

#: Branches of a level up to which the SQL beside the query follows the tree; beyond it, and below two levels, the tests hold the tree against a plain one.
MAX_CHILDREN = 50
PRIOR, PRIOR_N, REJECT_AT = 0.2, 2.0, 0.6
Z = 1.96
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Nodes, and rejected templates, up to which they are broadcast.
BROADCAST_ROWS = 50_000


def template(path: Column) -> Column:
    """The non-empty segments of a path, generalised, joined by slashes."""

    def general(seg: Column) -> Column:
        return F.when(seg.rlike(r"^[0-9]+(\.[A-Za-z0-9]+)?$"), F.regexp_replace(seg, "^[0-9]+", "{n}")).when(seg.rlike(r"^[0-9a-fA-F-]{8,}$"), F.lit("{x}")).otherwise(seg)

    return F.array_join(F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), general), "/")


def split_url(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple = RULES) -> DataFrame:
    """page_id, host, path, rule, label (the rule's verdict), template."""
    url = F.col(quoted(url_col))
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rows = pages.select(F.col(quoted(id_col)).alias("page_id"), rest.alias("rest"))
    host = F.translate(F.regexp_extract("rest", "^([^/?#]*)", 1), UPPER, LOWER)
    rows = rows.select("page_id", host.alias("host"), F.regexp_extract("rest", "^[^/?#]*([^?#]*)", 1).alias("path"))
    rule, label = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):  # the longest is tested first: it wraps the others
        fits = ((F.col("host") == h) | F.endswith(F.col("host"), F.lit("." + h))) & F.startswith(F.col("path"), F.lit(p))
        rule, label = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(label)
    return rows.select("*", rule.alias("rule"), label.alias("label"), template(F.col("path")).alias("template"))


def _similar(n: Column, b: Column, of_n: Column, of_b: Column) -> Column:
    """Whether a branch's labelled block rate is within the bound of its parent's; false without labels."""
    own, rate = b.cast("double") / F.nullif(n.cast("double"), F.lit(0.0)), of_b.cast("double") / F.nullif(of_n.cast("double"), F.lit(0.0))
    return F.coalesce((n > 0) & (F.abs(own - rate) <= Z * F.sqrt(rate * (1.0 - rate) / n.cast("double"))), F.lit(False))


def _segments() -> Column:
    return F.filter(F.split("template", "/"), lambda x: x != "")


def leaves(rows: DataFrame) -> DataFrame:
    """host, template, n (labelled pages), b (blocked ones), pages, free (pages without a rule): one row a distinct template of a host."""
    word = F.coalesce(F.col("host").rlike("|".join(rf"(^|[.-]){w}([.-]|$)" for w in BLOCK_WORDS)), F.lit(False))
    label = F.coalesce(F.col("label"), F.when(word, "block"))
    free = F.count(F.when(F.col("label").isNull(), 1))
    return rows.groupBy("host", "template").agg(F.count(label).alias("n"), F.count(F.when(label == "block", 1)).alias("b"), F.count(F.lit(1)).alias("pages"), free.alias("free"))


def rejected_templates(rows: DataFrame) -> DataFrame:
    """host, template of the pages without a rule whose merged template is rejected."""
    todo = materialise(leaves(rows).withColumn("node", F.lit("")).withColumn("level", F.lit(0)), "url-templates")
    bad = []
    while True:
        rest = F.slice(_segments(), F.col("level") + 1, F.greatest(F.size(_segments()), F.lit(1)))  # below the levels that are done
        sums = [F.sum(c).alias(f"of_{c}") for c in ("n", "b", "pages", "free")]
        nodes = todo.groupBy("host", "node").agg(*sums, F.min(rest).alias("first"), F.max(rest).alias("last"), F.first("level").alias("level"))
        # where the least and the greatest rest of a node differ, it branches: shared levels have one branch, which is its parent again
        same = F.zip_with("first", "last", lambda a, b: a.eqNullSafe(b))
        settled = (F.col("of_n") == 0) | (F.col("of_free") == 0) | ((F.col("of_n") == F.col("of_pages")) & F.col("of_b").isin(0, F.col("of_n"))) | (F.col("first") == F.col("last"))
        nodes = nodes.select("*", settled.alias("settled"), (F.col("level") + F.array_position(same, False)).cast("int").alias("at"))
        purity = (F.col("of_b") + PRIOR * PRIOR_N) / (F.col("of_n") + PRIOR_N)
        rejected, open_ = F.col("settled") & (purity >= REJECT_AT), ~F.col("settled")
        nodes = nodes.filter("of_n > 0 and of_free > 0").select("host", "node", "of_n", "of_b", "at", rejected.alias("rejected"), open_.alias("open"))
        nodes = materialise(nodes.filter("rejected or open"), "url-nodes")
        counts = nodes.agg(F.count(F.when(F.col("rejected"), 1)).alias("rejected"), F.count(F.when(F.col("open"), 1)).alias("open")).first()
        if counts["rejected"]:
            gone = nodes.filter("rejected").select("host", "node")
            bad.append(todo.filter("free > 0").join(F.broadcast(gone) if counts["rejected"] <= BROADCAST_ROWS else gone, ["host", "node"]).select("host", "template"))
        if not counts["open"]:
            break
        more = nodes.filter("open").select("host", "node", "of_n", "of_b", "at")
        below = todo.drop("level").join(F.broadcast(more) if counts["open"] <= BROADCAST_ROWS else more, ["host", "node"])
        below = below.withColumn("branch", F.coalesce(F.get(_segments(), F.col("at") - 1), F.lit("")))
        branches = below.groupBy("host", "node", "branch").agg(F.sum("n").alias("n"), F.sum("b").alias("b"), F.first("of_n").alias("of_n"), F.first("of_b").alias("of_b"), F.first("at").alias("at"))
        merged = F.when(_similar(F.col("n"), F.col("b"), F.col("of_n"), F.col("of_b")), F.lit("*")).otherwise(F.concat(F.lit("/"), "branch"))
        child = F.md5(F.concat_ws(" ", "node", F.col("at").cast("string"), merged).cast("binary"))
        named = branches.select("host", "node", "branch", child.alias("child"))
        todo = below.join(named, ["host", "node", "branch"])
        todo = materialise(todo.select("host", "template", "n", "b", "pages", "free", F.col("child").alias("node"), F.col("at").alias("level")), "url-templates")
    if not bad:
        return todo.limit(0).select("host", "template")
    found = bad[0]
    for x in bad[1:]:
        found = found.unionByName(x)
    return found


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict: one row per row."""
    rows = split_url(pages, id_col, url_col, rules)
    bad = materialise(rejected_templates(rows), "url-rejected").withColumn("bad", F.lit(True))
    ruled, free = rows.filter("label is not null"), rows.filter("label is null")
    verdict = F.when(F.col("bad"), "block").otherwise("allow")
    judged = free.join(small_or_shuffled(bad, BROADCAST_ROWS), ["host", "template"], "left").withColumn("label", verdict)
    cols = ["page_id", "host", "path", "rule", F.col("label").alias("verdict")]
    return ruled.select(*cols).unionByName(judged.select(*cols))
