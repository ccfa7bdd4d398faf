"""robots.txt and sitemaps as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import urls as U

#: Children of a sitemap index that are followed, and how deep.
CHILDREN, DEPTH = 10, 2


def _agent(agent: str):
    """The product name of a user agent."""
    return F.lit(agent.lower().split("/")[0])


def fields(files: DataFrame) -> DataFrame:
    """files: host, body. (host, n, field, value) of every line that has a field."""
    rows = files.select("host", F.posexplode(F.split("body", "\n")).alias("n", "line"))
    rows = rows.withColumn("line", F.regexp_replace(F.regexp_replace("line", "#.*$", ""), r"(?U)^\s+|\s+$", "")).where(F.col("line").contains(":"))
    return rows.select("host", "n", F.lower(F.trim(F.regexp_extract("line", r"^([^:]*):", 1))).alias("field"), F.regexp_replace(F.regexp_extract("line", r"^[^:]*:(.*)$", 1), r"(?U)^\s+|\s+$", "").alias("value"))


def lines(files: DataFrame, agent: str) -> DataFrame:
    """(host, n, block, field, value): the lines of groups that name the agent, or * where none does."""
    rows = fields(files)
    order = Window.partitionBy("host").orderBy("n")  # one robots file
    is_agent = F.col("field") == "user-agent"
    rows = rows.withColumn("starts", is_agent & (F.coalesce(F.lag("field").over(order), F.lit("")) != "user-agent"))
    rows = rows.withColumn("block", F.sum(F.col("starts").cast("int")).over(order))
    group = Window.partitionBy("host", "block")
    rows = rows.withColumn("named", F.max(is_agent & (F.col("value") != "*") & _agent(agent).contains(F.lower("value"))).over(group)).withColumn("any", F.max(is_agent & (F.col("value") == "*")).over(group))
    chosen = F.when(F.max("named").over(Window.partitionBy("host")), F.col("named")).otherwise(F.col("any"))
    return rows.withColumn("chosen", chosen).where("chosen and block > 0").select("host", "n", "block", "field", "value")


def rules(files: DataFrame, agent: str) -> DataFrame:
    """(host, n, pattern, allow, length, regex); an empty Disallow is no rule. * stands for anything, $ for the end."""
    rows = lines(files, agent).where("field in ('allow', 'disallow') and value <> ''")
    quoted = F.regexp_replace(F.regexp_replace("value", r"([.+?^{}()|\[\]\\])", r"\\$1"), r"\*", ".*")
    return rows.select("host", "n", F.col("value").alias("pattern"), (F.col("field") == "allow").alias("allow"), F.length("value").alias("length"), F.concat(F.lit("^"), quoted).alias("regex"))


def allowed(urls: DataFrame, files: DataFrame, agent: str) -> DataFrame:
    """urls: host, path (with the query string). The longest rule that fits decides, the first of equals; none: allowed."""
    r = rules(files, agent)
    hits = urls.join(r, "host").where(F.expr("path rlike regex")).groupBy("host", "path").agg(F.max_by("allow", F.struct("length", -F.col("n"))).alias("allow"))
    return urls.join(hits, ["host", "path"], "left").select("host", "path", F.coalesce("allow", F.lit(True)).alias("allow"))


def crawl_delays(files: DataFrame, agent: str) -> DataFrame:
    """(host, crawl_delay_ms): the longest of the groups that apply; in a group the last line counts, a comma is a decimal point, and what is no number is passed over."""
    seconds = F.when(F.col("value") == "", 0.0).otherwise(F.expr("try_cast(regexp_replace(value, '^([^,]*),', '$1.') as double)"))
    rows = lines(files, agent).where("field = 'crawl-delay'").withColumn("s", seconds).where("s >= 0 and s < double('infinity')")
    last = rows.groupBy("host", "block").agg(F.max_by("s", "n").alias("s"))
    return last.groupBy("host").agg((F.max("s") * 1000).cast("long").alias("crawl_delay_ms"))


def sitemaps(files: DataFrame, agent: str) -> DataFrame:
    """(host, sitemap): http urls after an agent line that names the agent or *, whatever group decides on paths."""
    rows = fields(files)
    is_agent, value = F.col("field") == "user-agent", F.lower("value")
    applies = F.when(is_agent, (value == "*") | _agent(agent).contains(value))
    rows = rows.withColumn("applies", F.last(applies, ignorenulls=True).over(Window.partitionBy("host").orderBy("n")))
    return rows.where(F.col("applies") & (F.col("field") == "sitemap") & U.is_http(F.col("value"))).select("host", F.col("value").alias("sitemap")).distinct()


def locations(bodies: DataFrame) -> DataFrame:
    """bodies: url, body. (url, loc): what a sitemap or an index of sitemaps lists."""
    return bodies.select("url", F.explode(F.regexp_extract_all("body", F.lit(r"(?i)<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))).alias("loc"))


def read_sitemaps(roots: DataFrame, bodies: DataFrame, children: int = CHILDREN, depth: int = DEPTH) -> DataFrame:
    """(root, loc): http urls of each root (url), through indexes: the first children of one, down to depth. bodies: url, body; what has none lists nothing."""
    of = F.regexp_extract_all("body", F.lit(r"(?i)<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))
    known = bodies.select("url", F.col("body").rlike("(?i)<sitemapindex").alias("is_index"), of.alias("locs"))
    at, out = roots.select(F.col("url").alias("root"), "url"), None
    for level in range(depth + 1):
        here = at.join(known, "url")
        pages = here.where("not is_index").select("root", F.explode("locs").alias("loc")).where(U.is_http(F.col("loc")))
        out = pages if out is None else out.unionByName(pages)
        at = here.where("is_index").select("root", F.explode(F.slice("locs", 1, children)).alias("url"))
    return out


def policies(cached: DataFrame, fetched: DataFrame, now_ms: int, ttl_ms: int = 6 * 3600 * 1000) -> DataFrame:
    """The cache of robots files (host, status, body, fetched_ms): what was fetched replaces rows that are older than ttl; a host that can't be reached or answers with an error has no rules."""
    fresh = cached.where(F.lit(now_ms) - F.col("fetched_ms") < ttl_ms)
    new = fetched.join(fresh.select("host"), "host", "left_anti").withColumn("body", F.when(F.col("status").between(200, 299), F.col("body")).otherwise(F.lit("")))
    return fresh.select("host", "status", "body", "fetched_ms").unionByName(new.select("host", "status", "body", "fetched_ms"))
