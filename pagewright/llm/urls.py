"""URL rules behind a blocked Bloom filter. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, pick

#: A block is four 64-bit words, in each of which a key has one bit. So many bits a key, and so many blocks at most:
#: 2**17 blocks are 4 MB, whatever the length of the list; past that the filter lets more through to the exact join.
WORDS, BITS_A_KEY, MOST_BLOCKS = 4, 24, 1 << 17


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both empty where url is null or has no `://`."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.shiftrightunsigned(key, 20), F.lit(blocks)).cast("int")


def _bit(key: Column, word: int) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(key, F.lit(word)), F.lit(64)).cast("int"))


def blocked_bloom(keys: DataFrame, column: str, blocks: int) -> DataFrame:
    """One row with the filter: an array of blocks * WORDS longs. keys are hashed 64-bit values."""
    key = F.col(column)
    part = keys.groupBy(_block(key, blocks).alias("block")).agg(*[F.bit_or(_bit(key, w)).alias(f"w{w}") for w in range(WORDS)])
    every = keys.sparkSession.range(blocks).select(F.col("id").cast("int").alias("block"))
    words = every.join(part, "block", "left").select("block", F.array(*[F.coalesce(F.col(f"w{w}"), F.lit(0).cast("long")) for w in range(WORDS)]).alias("words"))
    return words.agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("block", "words"))), lambda x: x["words"])).alias("bits"))


def might_hold(bits: Column, key: Column, blocks: int) -> Column:
    """False only if key was never put into the filter."""
    held = F.lit(True)
    for w in range(WORDS):
        bit = _bit(key, w)
        held = held & (F.get(bits, _block(key, blocks) * WORDS + w).bitwiseAND(bit) == bit)
    return held


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_column: str = "page_id") -> DataFrame:
    """Judges each url by the longest rule that fits; a url that no rule fits gets `default`.

    rules has action, host and path: a rule fits its host and that host's subdomains where the url's path starts with the
    rule's. Of two rules with the longest host and path together the one with the longer host holds; of actions given for
    one host and path, the last by name (block before allow). A null or empty rule host fits nothing.

    Each url's possible rule keys (suffixes of its host by beginnings of its path, of the lengths that occur in the list)
    are probed in a blocked Bloom filter of the listed canonical URLs, as they are read. The different (host, path) with
    hits go on to an exact hash join with the list, which removes false positives; what fits goes back to the urls by
    (host, path), a row for each, so that a url in very many rows is on the side that Spark can split. The filter, at most
    4 MB, is the one thing that every task holds; the list is joined by Spark's own choice and may be of any size.

    Null url: empty host and path, no rule. Repeated rows are judged each. Other columns of pages, whatever their names,
    are left out. Empty pages or rules: no rows, or the default for all.

    Returns id_column, host, path, rule, verdict.
    """
    listed = pick(rules, "action", "host", "path").where(F.length("host") > 0)
    listed = listed.select("action", F.translate("host", UPPER, LOWER).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"))
    listed = listed.groupBy("rule_host", "rule_path").agg(F.max("action").alias("action"))
    shape = listed.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size(F.split("rule_host", r"\."))), F.lit(0)).alias("labels"), F.sort_array(F.collect_set(F.length("rule_path")), asc=False).alias("lengths")).first()
    blocks = 1
    while blocks * WORDS * 64 < shape["n"] * BITS_A_KEY and blocks < MOST_BLOCKS:
        blocks *= 2

    host, path = host_and_path(F.col("url"))
    seen = pick(pages, id_column, "url").select(F.col(id_column), host.alias("host"), path.alias("path"))
    if not shape["n"]:
        return seen.select(id_column, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))

    labels = F.slice(F.reverse(F.split("host", r"\.")), 1, shape["labels"])
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.reverse(F.slice(labels, 1, k)), "."))
    lengths = F.filter(F.array(*[F.lit(n) for n in shape["lengths"]]), lambda n: n <= F.length("path"))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(lengths, lambda n: F.struct(s.alias("rule_host"), F.substring(F.col("path"), F.lit(1), n).alias("rule_path")))))
    bits = blocked_bloom(listed.select(F.xxhash64("rule_host", "rule_path").alias("key")), "key", blocks)
    asked = seen.select("host", "path", F.explode(keys).alias("at")).select("host", "path", "at.*").withColumn("key", F.xxhash64("rule_host", "rule_path"))
    hits = asked.where(might_hold(bits.scalar(), F.col("key"), blocks)).select("host", "path", "rule_host", "rule_path").distinct()
    length = F.struct(F.length("rule_host") + F.length("rule_path"), F.length("rule_host"))
    rule = F.struct(F.concat("rule_host", "rule_path").alias("rule"), F.col("action"))
    best = hits.join(listed, ["rule_host", "rule_path"]).groupBy("host", "path").agg(F.max_by(rule, length).alias("best"))
    return seen.join(best, ["host", "path"], "left").select(id_column, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))


#: The listed canonical URLs of the query, as action, host, path.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]

SQL = f"""
WITH rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), cut AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
), rules(action, rule_host, rule_path) AS (
  VALUES {", ".join(str(r) for r in RULES)}
), best AS (
  SELECT host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(action, length(rule_host || rule_path)) AS action
  FROM (SELECT DISTINCT host, path FROM cut) u JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY host, path
)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM cut LEFT JOIN best USING (host, path)
"""
