"""Crawl frontier: breadth-first discovery over a link table, attempts, status transitions, politeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlmill.functions import urls
from crawlmill.operators.scale import join_parts, ranged
from crawlmill.session import checkpointed

# Which crawl states may follow which.
TRANSITIONS = {
    "pending": ("running", "cancelled"), "running": ("paused", "stopping", "completed", "failed", "limit_reached"), "paused": ("running", "cancelled", "stopping"),
    "stopping": ("stopped", "failed"), "completed": (), "failed": (), "stopped": (), "cancelled": (), "limit_reached": (),
}
MAX_ATTEMPTS = 3


def crawl(seeds: DataFrame, links: DataFrame, max_depth: int | None = None, ceiling: int | None = None) -> DataFrame:
    """Pages reached from ``seeds`` (``url``) over ``links`` (``source_url, target_url``): ``url, depth, parent_url``.

    One round per depth: the wave is joined to the links, reduced to one row per new url (the smallest parent),
    and stripped of urls already seen, so a hub's links are combined before they are moved. Urls that look like
    traps are left out. Without ``max_depth`` rounds go on until one finds nothing new. ``ceiling`` keeps the first urls in the order depth, parent, url; it is a limit of the
    crawl, not of the data read. Nulls are no urls.
    """
    edges = links.filter("source_url is not null and target_url is not null and source_url <> target_url").select("source_url", "target_url").distinct()
    edges = checkpointed(edges.filter(urls.trap(F.col("target_url")) == ""))  # used in every round
    wave = seeds.filter("url is not null").select("url").distinct().select("url", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent_url"))
    seen = checkpointed(wave)
    wave = seen
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        reached = wave.select(F.col("url").alias("source_url")).join(edges, "source_url").groupBy(F.col("target_url").alias("url")).agg(F.min("source_url").alias("parent_url"))
        wave = checkpointed(reached.join(seen.select("url"), "url", "left_anti").select("url", F.lit(depth).alias("depth"), "parent_url"))
        if wave.isEmpty():
            break
        seen = seen.unionByName(wave)
        if ceiling is not None and seen.count() >= ceiling:
            break
    return seen if ceiling is None else seen.orderBy("depth", F.asc_nulls_first("parent_url"), "url").limit(ceiling)


def seeds_of_list(rows: DataFrame, position: str, url: str, most: int = 10_000) -> DataFrame:
    """Seeds of a list in order, each url once at its first place; more than ``most`` are refused."""
    first = rows.filter(F.col(url).isNotNull()).groupBy(F.col(url).alias("url")).agg(F.min(position).alias("position"))
    if first.limit(most + 1).count() > most:
        raise ValueError("too many seeds")
    return first.orderBy("position").select("position", "url")


def latest_attempt(attempts: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last attempt of every key, by one aggregation that is combined before the shuffle."""
    rest = [c for c in attempts.columns if c != key]
    return attempts.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("a")).select(key, "a.*")


def outcome(attempts: DataFrame, key: str) -> DataFrame:
    """State of every key after its attempts (``attempt, status_code``): analysed, retry_wait, failed."""
    last = latest_attempt(attempts, key, ["attempt"])
    again = urls.retry_decision(F.col("status_code"), F.lit(False)) == "transient_http"
    state = F.when(F.col("status_code").between(200, 399), "analysed").when(again & (F.col("attempt") < MAX_ATTEMPTS), "retry_wait").otherwise("failed")
    return last.select(key, "attempt", "status_code", state.alias("state"), F.when(state == "retry_wait", F.col("attempt") * F.col("attempt")).alias("backoff_s"))


def transitions(events: DataFrame, key: str, state: str, order: list[str]) -> DataFrame:
    """Every change of state with whether it is allowed: ``key, order, from_state, to_state, allowed``.

    A key with any share of the rows is cut into ranges in the wanted order; the first row of a range follows the
    last one of the range before. Rows of equal order follow each other in any order.
    """
    parts = ranged(events.select(key, *order, F.col(state).alias("to_state")), key, order)
    last = parts.groupBy(key, "__part").agg(F.max_by("to_state", F.struct(*order)).alias("state"))
    last = last.withColumn("__earlier", F.lag("state").over(Window.partitionBy(key).orderBy("__part"))).drop("state")
    before = F.coalesce(F.lag("to_state").over(Window.partitionBy(key, "__part").orderBy(*order)), F.col("__earlier"))
    rows = join_parts(parts, last, key).withColumn("from_state", before).filter("from_state is not null and from_state <> to_state")
    allowed = F.create_map(*[x for a, b in TRANSITIONS.items() for x in (F.lit(a), F.array(*map(F.lit, b)).cast("array<string>"))])
    rows = rows.select(key, *order, "from_state", "to_state")
    return rows.withColumn("allowed", F.coalesce(F.array_contains(allowed[F.col("from_state")], F.col("to_state")), F.lit(False)))


def start_times(requests: DataFrame, host: str, order: list[str], delay_s: str) -> DataFrame:
    """Earliest start of every request when a host gets one at a time with a pause: seconds from its first.

    A host with any share of the requests is cut into ranges in the wanted order, whose sums are carried on.
    """
    parts = ranged(requests, host, order)
    sums = parts.groupBy(host, "__part").agg(F.sum(delay_s).alias("own"))
    ahead = Window.partitionBy(host).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__earlier", F.coalesce(F.sum("own").over(ahead), F.lit(0.0))).drop("own")
    inside = Window.partitionBy(host, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = join_parts(parts, sums, host)
    return rows.withColumn("start_s", F.col("__earlier") + F.coalesce(F.sum(delay_s).over(inside), F.lit(0.0))).drop("__earlier", "__part")


def event_severity(payload: Column) -> Column:
    """Severity of an event from its JSON: a recovery, a failure and a reached limit are warnings."""
    status, recovered = F.get_json_object(payload, "$.status"), F.get_json_object(payload, "$.recovered")
    return F.when(status.isin("failed", "limit_reached") | F.coalesce(recovered == "true", F.lit(False)), "warning").otherwise("info")


def lease(frontier: DataFrame, now: Column, limit: int) -> DataFrame:
    """The next ``limit`` urls to fetch: queued ones and those whose lease is over, by priority, depth and id.

    ``frontier`` has ``crawl_url_id, state, priority, depth, lease_until``; nulls count as priority and depth 0.
    """
    free = (F.col("state") == "queued") | ((F.col("state") == "leased") & (F.col("lease_until") <= now))
    order = [F.desc(F.coalesce("priority", F.lit(0))), F.coalesce("depth", F.lit(0)), "crawl_url_id"]
    return frontier.filter(free).orderBy(*order).limit(limit)


def synthetic(spark, pages: int, fan_out: int = 10) -> DataFrame:  # noqa: ANN001
    """Links of a tree of pages, each to the next ``fan_out``, for tests of scale."""
    ids = spark.range(pages).select("id", F.explode(F.sequence(F.lit(1), F.lit(fan_out))).alias("k"))
    target = F.col("id") * fan_out + F.col("k")
    name = lambda c: F.concat(F.lit("https://site.example/p/"), c.cast("string"))
    return ids.filter(target < pages).select(name(F.col("id")).alias("source_url"), name(target).alias("target_url"))
