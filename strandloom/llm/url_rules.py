"""Rules on hosts and paths: canonical keys, prefixes as intervals, a sorted sweep with a stack of open rules."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import fresh, join_counted, scan, stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands between a key's reversed host and its path; no host holds it.
MARK = "?"
#: Keys drawn for each part of the sweep; they decide the balance of the parts and no result.
DRAWN = 20


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and the next of ``/ ? #``, with A-Z in lower case; empty if there is none."""
    rest = F.substr(url, F.instr(url, "://") + 3)
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``; empty if the url has no ``://``."""
    rest = F.substr(url, F.instr(url, "://") + 3)
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)), F.lit(""))


def _key(host: Column, path: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, "[.]")), "."), F.lit(MARK), path)


def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, key, salt, rule, site) in order, where a row without a site opens a rule: the innermost rule
    that is open at each site.

    A rule's interval is all that begins with its key, so intervals nest: the stack holds rules
    each inside the one below, and those that a key has left are closed before it is judged.
    """
    stack: list[tuple[str, str]] = []
    part = None
    for batch in batches:
        sites, rules = [], []
        for own, key, rule, site in zip(*(batch.column(c).to_pylist() for c in ("part", "key", "rule", "site"))):
            if own != part:
                part, stack = own, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if site is None:
                stack.append((key, rule))
            elif stack:
                sites.append(site)
                rules.append(stack[-1][1])
        yield pa.RecordBatch.from_arrays([pa.array(sites, pa.string()), pa.array(rules, pa.string())], ["site", "rule"])


def sweep_join(points: DataFrame, rules: DataFrame, parts: int) -> DataFrame:
    """``site, rule``: of every point (``key, site``) the rule (``key, rule``) of the longest key that begins its own.

    Both sides are dealt into ``parts`` ranges of keys, cut at a bounded draw of the points; equal
    keys are told apart by a salt, so a very common one is cut as well.  A rule goes to the range where
    its interval opens, and to each that begins inside the interval, which opens it again.
    """
    points = points.withColumn("salt", F.xxhash64("site"))
    total = points.count()
    drawn = points.sample(min(1.0, DRAWN * parts / total), seed=1).select("key", "salt").collect() if total > DRAWN * parts else []
    drawn = sorted((r.key, r.salt) for r in drawn)
    cuts = [drawn[i * len(drawn) // parts] for i in range(1, parts)] if len(drawn) >= parts else []

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key, salt, rule, site in zip(*(batch.column(c).to_pylist() for c in ("key", "salt", "rule", "site"))):
                if site is not None:
                    out.append((bisect_right(cuts, (key, salt)), key, salt, None, site))
                    continue
                first = bisect_right(cuts, (key, -(1 << 63)))
                out.append((first, key, None, rule, None))
                while first < len(cuts) and cuts[first][0].startswith(key):
                    first += 1
                    out.append((first, key, None, rule, None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, (pa.int32(), pa.string(), pa.int64(), pa.string(), pa.string()))], ["part", "key", "salt", "rule", "site"])

    both = points.select("key", "salt", F.lit(None).cast("string").alias("rule"), "site").unionByName(rules.select("key", F.lit(None).cast("long").alias("salt"), "rule", F.lit(None).cast("string").alias("site")))
    dealt = scan(both, deal, "part int, key string, salt long, rule string, site string").repartitionById(len(cuts) + 1, F.col("part"))
    # A null salt comes first: a rule opens before the points of its own key.
    return scan(dealt.sortWithinPartitions("part", "key", "salt"), sweep, "site string, rule string")


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``id_col, url_col, host, path, rule, verdict`` of every page by rules ``host, path, verdict``.

    A rule fits its host and all subdomains if the path begins with the rule's; the longest
    (host and path together, then the longer host) decides.  A key is the host's labels in reverse,
    a mark and the path, so a rule is an interval of keys.  A url has one key for each domain that
    encloses its host and has as many labels as some rule's host, with its path cut to the longest
    path of all rules: what is beyond cannot fit.  Urls that agree in these are one site, counted
    before anything else is done; sites and rules meet in a sorted sweep, cut into ranges.

    A null url, or one without ``://``, has an empty host and path; only a rule of an empty host and
    path fits it.  A page without a rule has a null ``rule`` and the verdict ``default``.  Rules of a null
    host, path or verdict are no rules; of rules that agree in host and path the greater verdict
    counts (block before allow).  Repeated rows are judged each, an empty table gives no rows, other
    columns are left out; where ``id_col`` or ``url_col`` bear the name of a new column that one gets underscores.
    """
    given = rules.select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict").dropna().groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    given = stage(given.withColumn("labels", F.when(F.col("host") == "", 0).otherwise(F.size(F.split("host", "[.]")))), "url-rules")
    bounds = given.agg(F.coalesce(F.max("labels"), F.lit(0)).alias("labels"), F.coalesce(F.max(F.length("path")), F.lit(0)).alias("path"), F.count_if(F.col("host") == "").alias("open")).first()
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url"), F.col(url_col).alias("_given"))
    rows = rows.select("_id", "_given", host_of(F.col("_url")).alias("_host"), path_of(F.col("_url")).alias("_path"))
    tail = F.array_join(F.reverse(F.slice(F.reverse(F.split("_host", "[.]")), 1, max(1, bounds["labels"]))), ".")
    rows = rows.withColumn("_site", F.concat(tail, F.lit(MARK), F.substr("_path", F.lit(1), F.lit(bounds["path"]))))
    sites = stage(rows.groupBy("_site").agg(F.count(F.lit(1)).alias("n")), "url-sites")
    labels, path = F.split(F.substring_index("_site", MARK, 1), "[.]"), F.expr(f"substr(_site, instr(_site, '{MARK}') + 1)")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, F.size(labels) - i + 1, i), "."))
    if bounds["open"]:
        domains = F.array_distinct(F.concat(F.array(F.lit("")), domains))
    points = sites.select("_site", path.alias("_p"), F.explode(domains).alias("_domain")).select(_key(F.col("_domain"), F.col("_p")).alias("key"), F.col("_site").alias("site"))
    opened = given.select(_key(F.col("host"), F.col("path")).alias("key"), F.to_json(F.struct("host", "path", "verdict")).alias("rule"))
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = sweep_join(points, opened, parts).select("site", F.from_json("rule", "host string, path string, verdict string").alias("r"))
    size = F.struct((F.length("r.host") + F.length("r.path")).alias("size"), F.length("r.host").alias("host"))
    best = met.groupBy("site").agg(F.max_by("r", size).alias("r"))
    judged = stage(sites.join(best, F.col("_site") == F.col("site"), "left").select(F.col("_site").alias("_judged"), "n", F.concat("r.host", "r.path").alias("_rule"), F.coalesce("r.verdict", F.lit(default)).alias("_verdict")), "url-verdicts")
    out = join_counted(rows, judged, "_site", "_judged", "n", ["_id", "_given"])
    names = [id_col, url_col]
    for wanted in ("host", "path", "rule", "verdict"):
        names.append(fresh(names, wanted))
    return out.select("_id", "_given", "_host", "_path", "_rule", "_verdict").toDF(*names)
