"""URL filters: rules by host and path, and link-graph propagation for what no rule decides.

The longest fitting rule decides a URL. For the rest, every host with pages that the rules
allow or block is a seed: of trust by the share of allowed ones among these pages, of distrust
by the share of blocked ones. Over the host edges found in the pages, trust flows from the
seeds as personalised PageRank and distrust flows backwards, from a host to those that link to
it. Both keep what a seed has of itself, so a host without links is judged by its own pages
that rules decide. A host is blocked if its distrust exceeds its trust by ``MARGIN`` of both.

Everything is DataFrame functions. Pages are read once; a narrow table of hosts, verdicts
and links is written to the shared folder. Edges are summed by pair of hosts before any
join, sums combine on the map side, and each round is written to the shared folder.

Defined results: a null URL, or one without ``://``, has an empty host and path; pages
without html have no links; of rules of equal length the first in order decides; a host that
neither trust nor distrust reaches, or both alike, is allowed; what reaches a host without further
links stays there and flows no further; URLs and html may be of any length and are read whole;
repeated rows and ids each get their row; an empty table gives an empty table; columns other
than those named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import staged

DAMPING = 0.85
#: Rounds end once no host is newly reached and none's trust or distrust moves by more than this share of itself.
TOLERANCE = 1e-4
#: How far distrust must exceed trust, as a share of their sum: a half is three times the trust.
MARGIN = 0.5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""(?i)<a\s[^>]*?\bhref\s*=\s*["']?(?:https?:)?//([^/?#"'>\s]+)"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; empty where there is no ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda k: F.coalesce(F.regexp_extract(url, pattern, k), F.lit(""))
    return F.translate(part(1), _UPPER, _LOWER), part(2)


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest of the (host, path, verdict) rules that fits, as a struct of rule and verdict; null if none does."""
    longest = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    listed = F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")) for h, p, v in longest])
    fits = F.filter(listed, lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"]))) & F.startswith(path, r["path"]))
    return F.get(fits, 0) if rules else F.lit(None).cast("struct<host:string,path:string,rule:string,verdict:string>")


def host_edges(pages: DataFrame) -> DataFrame:
    """Distinct pairs of hosts with the number of pages that link one to the other: ``src, dst, pages``."""
    links = pages.select(F.col("host").alias("src"), F.explode("links").alias("dst")).where("src <> '' and dst <> '' and src <> dst")
    return links.groupBy("src", "dst").agg(F.count("*").alias("pages"))


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int | None = None) -> DataFrame:
    """``host, trust, distrust`` of every host that either reaches.

    ``edges``: ``src, dst, pages``. ``seeds``: ``host, trust, distrust``, each column summing to 1 (or 0).
    Without ``rounds``, until the scores settle, however far hosts lie from seeds and however small a seed's share is.
    """
    out = edges.groupBy("src").agg(F.sum("pages").alias("n_out"))
    into = edges.groupBy("dst").agg(F.sum("pages").alias("n_in"))
    shares = edges.join(out, "src").join(into, "dst").select("src", "dst", (F.col("pages") / F.col("n_out")).alias("forth"), (F.col("pages") / F.col("n_in")).alias("back"))
    shares = staged(shares, "host-edges")
    seeds = staged(seeds, "host-seeds")
    zero = F.lit(0.0)
    now, done = seeds, 0
    if shares.isEmpty() or seeds.isEmpty():
        return now

    def change(new: str, old: str) -> Column:
        new, old = F.coalesce(new, zero), F.coalesce(old, zero)
        return F.when(F.greatest(new, old) > 0, F.abs(new - old) / F.greatest(new, old)).otherwise(zero)

    while rounds is None or done < rounds:
        trust = shares.join(now.where("trust > 0"), shares["src"] == now["host"]).select(F.col("dst").alias("host"), (DAMPING * F.col("forth") * F.col("trust")).alias("trust"), zero.alias("distrust"))
        distrust = shares.join(now.where("distrust > 0"), shares["dst"] == now["host"]).select(F.col("src").alias("host"), zero.alias("trust"), (DAMPING * F.col("back") * F.col("distrust")).alias("distrust"))
        restart = seeds.select("host", *[((1 - DAMPING) * F.col(c)).alias(c) for c in ("trust", "distrust")])
        later = staged(trust.unionByName(distrust).unionByName(restart).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")), "host-scores")
        old = now.select("host", F.col("trust").alias("t"), F.col("distrust").alias("d"))
        moved = later.join(old, "host", "full").agg(F.max(F.greatest(change("trust", "t"), change("distrust", "d")))).first()[0]
        now, done = later, done + 1
        if moved is None or moved < TOLERANCE:
            break
    return now


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, host, path, rule, verdict, trust, distrust`` for each row of ``pages``, with the scores of its host."""
    rows = pages.select(pages[id_col].alias("page_id"), pages[url_col].cast("string").alias("__url"), pages[html_col].cast("string").alias("__html"))
    host, path = host_and_path(F.col("__url"))
    links = F.transform(F.coalesce(F.regexp_extract_all("__html", F.lit(_LINK), F.lit(1)), F.array().cast("array<string>")), lambda x: F.translate(x, _UPPER, _LOWER))
    rows = rows.select("page_id", host.alias("host"), path.alias("path"), F.array_distinct(links).alias("links"))
    found = fitting_rule(F.col("host"), F.col("path"), rules)
    rows = staged(rows.withColumn("r", found).select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("ruled"), "links"), "page-hosts")

    many = lambda v: F.sum(F.when(F.col("ruled") == v, 1.0).otherwise(0.0))
    hosts = rows.where("host <> '' and ruled is not null").groupBy("host").agg(many("allow").alias("a"), many("block").alias("b"))
    hosts = hosts.select("host", (F.col("a") / (F.col("a") + F.col("b"))).alias("a"), (F.col("b") / (F.col("a") + F.col("b"))).alias("b"))
    totals = hosts.agg(F.sum("a").alias("all_a"), F.sum("b").alias("all_b"))  # one row
    part = lambda x, total: F.when(F.col(total) > 0, F.col(x) / F.col(total)).otherwise(0.0)
    seeds = hosts.join(F.broadcast(totals)).select("host", part("a", "all_a").alias("trust"), part("b", "all_b").alias("distrust"))
    scores = propagate(host_edges(rows), seeds)

    judged = rows.join(scores, "host", "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("trust", "distrust")})
    apart = F.col("distrust") - F.col("trust")
    method = F.when((apart > 0) & (apart >= MARGIN * (F.col("distrust") + F.col("trust"))), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "trust", "distrust")
