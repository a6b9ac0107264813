"""URL filters by a temporal list join, in DataFrame operations only.

A list is dated events: from ``day`` on, ``key`` (a host or a domain above it) is added to or removed from a
category. Events become validity intervals [from, to); on a day with both, the addition counts. Captures are reduced to
distinct (host, day), their hosts' suffixes to distinct (key, day), so that neither a host nor a domain is asked about more
often than there are days. The as-of join gives each of these, in each category of its key, the latest interval that begins by the
day, and it holds if it hasn't ended; verdicts go back to hosts and to captures. All joins are by equality, those on hosts
and days dealt to several tasks.

A null or unparsable url has the host '' and is never blocked; a capture without a day is judged by no entry, nor
are events without key, day or category. Repeated captures and ties each get their verdict; empty tables give empty results.
New columns replace those of the same name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, table, without
from .graph import spread

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def host(url):
    return F.coalesce(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def suffixes(name):
    """The host and the domains above it, of two labels at least (or the one it has)."""
    labels = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def intervals(events: DataFrame) -> DataFrame:
    """(key, category, from, to) from events (key, day, category, added); ``to`` is null for what still holds."""
    known = events.where(F.col("key").isNotNull() & F.col("day").isNotNull() & F.col("category").isNotNull())
    daily = known.groupBy("key", "category", "day").agg(F.max("added").alias("added"))
    order = Window.partitionBy("key", "category").orderBy("day")
    changes = daily.withColumn("was", F.coalesce(F.lag("added").over(order), F.lit(False))).where(F.col("added") != F.col("was"))
    return changes.withColumn("to", F.lead("day").over(order)).where("added").select("key", "category", F.col("day").alias("from"), "to")


def as_of(asked: DataFrame, entries: DataFrame) -> DataFrame:
    """(key, day, category) of each distinct asked (key, day) and each category whose latest interval by the day holds on it."""
    held = entries.select("key", "category").distinct()
    questions = asked.join(held, "key").select("key", "category", "day", F.lit(1).alias("asked"), F.lit(None).cast(entries.schema["from"].dataType).alias("from"), F.lit(None).cast(entries.schema["to"].dataType).alias("to"))
    answers = entries.select("key", "category", F.col("from").alias("day"), F.lit(0).alias("asked"), "from", "to")
    # on the same day an interval comes before the question
    before = Window.partitionBy("key", "category").orderBy("day", "asked").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    latest = F.last(F.when(F.col("asked") == 0, F.struct("from", "to")), ignorenulls=True).over(before)
    found = questions.unionByName(answers).withColumn("latest", latest).where("asked = 1 and latest is not null")
    return found.where(F.col("latest.to").isNull() | (F.col("day") < F.col("latest.to"))).select("key", "day", "category")


def judge(captures: DataFrame, events: DataFrame, url: str = "url", day: str = "fetch_day") -> DataFrame:
    """``captures`` with ``host``, ``n_entries`` (that hold on the day), ``categories`` (ascending, comma-joined) and ``blocked``."""
    kept = without(captures, ["host", "n_entries", "categories", "blocked"])
    (day_,) = fresh(captures, "day_asked")
    rows = captures.select(*kept, host(F.col(url)).alias("host"), F.col(day).alias(day_))
    asked = rows.where((F.col("host") != "") & F.col(day_).isNotNull()).select("host", F.col(day_).alias("day")).distinct()
    keyed = asked.select("host", "day", F.explode(suffixes(F.col("host"))).alias("key"))
    holding = as_of(keyed.select("key", "day").distinct(), intervals(events))
    # a domain may be that of many hosts, but it has few categories a day
    found = spread(keyed, holding.groupBy("key", "day").agg(F.collect_list("category").alias("held")), ["key", "day"])
    verdict = found.groupBy("host", "day").agg(F.sum(F.size("held")).alias("n_entries"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("held")))).alias("categories"))
    verdict = verdict.select("host", F.col("day").alias(day_), "n_entries", F.array_join("categories", ",").alias("categories"))
    out = spread(rows, verdict, ["host", day_], "left")
    n = F.coalesce("n_entries", F.lit(0).cast("long"))
    return out.select(*kept, "host", n.alias("n_entries"), F.coalesce("categories", F.lit("")).alias("categories"), (n > 0).alias("blocked"))


def _draw(text, modulus: int):
    """A number under ``modulus`` drawn from a text's digest."""
    return (F.conv(F.substring(F.md5(text), 1, 6), 16, 10).cast("int") % modulus).cast("int")


def sample_list(pages: DataFrame) -> DataFrame:
    """Dated events about a third of the hosts of ``pages`` and a fifth of their domains; the tables have no list of their own."""
    hosts = pages.select(host(F.col("url")).alias("key")).where("key <> ''").distinct()
    domains = hosts.select(F.element_at(suffixes(F.col("key")), -1).alias("key")).distinct()
    text = lambda c: F.concat(F.lit(c), F.col("key").cast("binary"))
    listed = hosts.where(_draw(text("h"), 3) == 0).union(domains.where(_draw(text("d"), 5) == 0))
    first = _draw(text("a"), 300)
    last = first + 20 + _draw(text("b"), 120)
    again = last + 10 + _draw(text("e"), 60)
    category = F.element_at(F.array(*map(F.lit, ("adult", "malware", "phishing", "spam"))), _draw(text("c"), 4) + 1)
    events = F.array(*(F.struct(d.alias("day"), F.lit(a).alias("added")) for d, a in ((first, True), (last, False), (again, True))))
    return listed.select("key", category.alias("category"), F.explode(events).alias("e")).select("key", "e.day", "category", "e.added")


def query(spark, sf_dir: str) -> DataFrame:
    """op5: every page judged on the day (page_id * 7919) mod 365, which stands for its fetch."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetch_day", F.pmod(F.col("page_id") * 7919, F.lit(365)).cast("int"))
    return judge(captures, sample_list(pages)).select("page_id", "host", "fetch_day", "n_entries", "categories", "blocked")


SQL = r"""
WITH rows AS (
  SELECT page_id, CAST((page_id * 7919) % 365 AS INTEGER) AS fetch_day,
         coalesce(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '') AS host
  FROM pages),
hosts AS (SELECT DISTINCT host AS key, string_split(host, '.') AS l FROM rows WHERE host <> ''),
keys AS (SELECT key, list_transform(range(1, greatest(len(l), 2)), lambda i: array_to_string(l[i:], '.')) AS suffixes FROM hosts),
domains AS (SELECT DISTINCT suffixes[-1] AS key FROM keys),
listed AS (
  SELECT key FROM hosts WHERE CAST('0x' || substr(md5('h' || key), 1, 6) AS INTEGER) % 3 = 0
  UNION ALL SELECT key FROM domains WHERE CAST('0x' || substr(md5('d' || key), 1, 6) AS INTEGER) % 5 = 0),
drawn AS (
  SELECT key, CAST('0x' || substr(md5('a' || key), 1, 6) AS INTEGER) % 300 AS a,
         20 + CAST('0x' || substr(md5('b' || key), 1, 6) AS INTEGER) % 120 AS b,
         10 + CAST('0x' || substr(md5('e' || key), 1, 6) AS INTEGER) % 60 AS e,
         ['adult', 'malware', 'phishing', 'spam'][CAST('0x' || substr(md5('c' || key), 1, 6) AS INTEGER) % 4 + 1] AS category
  FROM (SELECT DISTINCT key FROM listed)),
spans AS (
  SELECT key, category, a AS from_day, a + b AS to_day FROM drawn
  UNION ALL SELECT key, category, a + b + e, 100000 FROM drawn),
asked AS (SELECT DISTINCT host, fetch_day FROM rows WHERE host <> ''),
verdict AS (
  SELECT q.host, q.fetch_day, count(*) AS n, string_agg(DISTINCT s.category, ',' ORDER BY s.category) AS categories
  FROM asked q JOIN (SELECT key, unnest(suffixes) AS suffix FROM keys) k ON k.key = q.host
  JOIN spans s ON s.key = k.suffix AND s.from_day <= q.fetch_day AND q.fetch_day < s.to_day
  GROUP BY q.host, q.fetch_day)
SELECT r.page_id, r.host, r.fetch_day, coalesce(v.n, 0) AS n_entries, coalesce(v.categories, '') AS categories, v.n IS NOT NULL AS blocked
FROM rows r LEFT JOIN verdict v ON v.host = r.host AND v.fetch_day = r.fetch_day
"""
