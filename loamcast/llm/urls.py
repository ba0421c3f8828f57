"""URL filter: a blocked Bloom filter ahead of an exact hash join.

Everything here is a DataFrame expression; no Python runs on executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table

WORDS = 8  # 64-bit words of one block: a cache line
MAX_BLOCKS = 1 << 19  # 32 MiB of filter: up to so many blocks it is broadcast, beyond that it is joined

RULES = [  # fixed values: (host, path, verdict)
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty where the url is null or has no `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    host = ascii_lower(F.regexp_extract(rest, "^([^/?#]*)", 1))
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without a leading www. or m., then the path without .html and
    closing slashes; scheme, query and fragment are dropped."""
    bare = F.regexp_replace(host, "^(www|m)[.]", "")
    return F.concat(bare, F.regexp_replace(path, "([.]html|/+)$", ""))


def block_of(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def mask_of(key: Column) -> Column:
    """One bit in each 64-bit word of the key's block."""
    other = F.xxhash64(key, F.lit(1))
    return F.array(*[F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(other, 6 * i).bitwiseAND(63).cast("int")) for i in range(WORDS)])


def bloom_blocks(keys: DataFrame, blocks: int) -> DataFrame:
    """(block, bits): the filter as a table of at most `blocks` rows."""
    masked = keys.select(block_of(F.col("key"), blocks).alias("block"), mask_of(F.col("key")).alias("mask"))
    ored = masked.groupBy("block").agg(*[F.bit_or(F.col("mask")[i]).alias(f"w{i}") for i in range(WORDS)])
    return ored.select("block", F.array(*[f"w{i}" for i in range(WORDS)]).alias("bits"))


def url_filter(pages: DataFrame, rules: DataFrame, listed: DataFrame) -> DataFrame:
    """Judges every row of `pages` (page_id, url).

    rules: (host, path, verdict); a rule fits its host and the subdomains,
    where the url's path starts with the rule's path; the longest rule wins.
    listed: (url), canonical urls that are blocked where no rule fits.

    Returns one row per input row: page_id, host, path, rule, verdict, listed.
    A null url, or one without `://`, has empty host and path and is allowed.
    Repeated rows and null ids are kept; empty tables give empty or
    all-allowed results; other columns of the inputs are ignored.

    Keys of every distinct url are probed against the filter first. The
    filter has 16 bits an entry; up to MAX_BLOCKS rows of 8 words it is
    broadcast. The hits go to the exact join by key, which Spark is free to
    shuffle.
    """
    rules = rules.select(F.concat("host", "path").alias("key"), F.col("verdict"), F.length("path").alias("n"), F.size(F.split("host", "[.]")).alias("labels"))
    listed = listed.where(F.col("url").isNotNull()).select(F.concat(F.lit("="), "url").alias("key")).distinct()
    every = rules.groupBy("key").agg(F.min("verdict").alias("verdict")).unionByName(listed.withColumn("verdict", F.lit("block")))
    shape = rules.agg(F.collect_set("n").alias("lengths"), F.max("labels").alias("labels"), F.count("*").alias("rules")).first()
    entries = shape["rules"] + listed.count()
    blocks = max(1, entries * 16 // (64 * WORDS) + 1)
    bloom = bloom_blocks(every.select("key"), blocks)
    bloom = F.broadcast(bloom) if blocks <= MAX_BLOCKS else bloom

    host, path = split_url(F.col("url"))
    seen = pages.select("url").where(F.col("url").isNotNull()).distinct().select("url", host.alias("host"), path.alias("path")).where("host <> '' or path <> ''")
    parts = F.split("host", "[.]")
    tails = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(max(1, shape["labels"] or 1)))), lambda k: F.array_join(F.slice(parts, -k, k), "."))
    heads = F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in sorted(shape["lengths"])]) if shape["lengths"] else F.array().cast("array<string>")
    fits = F.flatten(F.transform(tails, lambda t: F.transform(F.filter(heads, lambda h: h.isNotNull()), lambda h: F.concat(t, h))))
    probes = seen.select("url", F.explode(F.concat(fits, F.array(F.concat(F.lit("="), canonical(F.col("host"), F.col("path")))))).alias("key"))
    possible = (
        probes.withColumns({"block": block_of(F.col("key"), blocks), "mask": mask_of(F.col("key"))})
        .join(bloom, "block")
        .where(F.forall(F.arrays_zip("mask", "bits"), lambda x: x["mask"].bitwiseAND(x["bits"]) == x["mask"]))
        .select("url", "key")
    )
    exact = possible.join(every, "key")
    is_rule = ~F.col("key").startswith("=")
    verdicts = exact.groupBy("url").agg(
        F.max_by(F.when(is_rule, F.col("key")), F.when(is_rule, F.length("key"))).alias("rule"),
        F.max_by(F.when(is_rule, F.col("verdict")), F.when(is_rule, F.length("key"))).alias("ruled"),
        F.bool_or(~is_rule).alias("listed"),
    )
    host, path = split_url(F.col("url"))
    judged = pages.select("page_id", "url").join(verdicts, "url", "left")
    on_list = F.coalesce("listed", F.lit(False))
    return judged.select("page_id", host.alias("host"), path.alias("path"), "rule", F.coalesce("ruled", F.when(on_list, "block").otherwise("allow")).alias("verdict"), on_list.alias("listed"))


def example_list(spark: SparkSession) -> DataFrame:
    """2 000 canonical urls by rule: every hundredth page number of one host,
    in four languages. It stands for a list that a user would supply."""
    n = spark.range(500).select((F.col("id") * 100).alias("n"))
    language = F.explode(F.array(*map(F.lit, ("de", "en", "es", "fr"))))
    return n.select("n", language.alias("lang")).select(F.concat(F.lit("tionsh.example.net/"), "lang", F.lit("/"), F.col("n").cast("string")).alias("url"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_filter(table(spark, sf_dir, "pages", "page_id", "url"), rules, example_list(spark))


ORACLE = r"""
WITH rules(rh, rp, rv) AS (VALUES ('org','/','allow'), ('example.org','/es/','block'),
  ('example.org','/en/1','block'), ('com','/fr/','allow'), ('com','/de/','block')),
cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id,
  translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
u AS (SELECT DISTINCT host, path FROM p),
m AS (SELECT host, path, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(rv, length(rh || rp)) AS rv
  FROM u JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY ALL),
l AS (SELECT 'tionsh.example.net/' || lang || '/' || CAST(n * 100 AS VARCHAR) AS url
  FROM range(500) t(n), (VALUES ('de'), ('en'), ('es'), ('fr')) g(lang)),
j AS (SELECT page_id, p.host, p.path, rule, rv,
  (regexp_replace(p.host, '^(www|m)[.]', '') || regexp_replace(p.path, '([.]html|/+)$', '')) IN (SELECT url FROM l) AS listed
  FROM p LEFT JOIN m ON p.host = m.host AND p.path = m.path)
SELECT page_id, host, path, rule, coalesce(rv, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict, listed FROM j
"""
