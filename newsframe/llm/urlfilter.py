"""URL filter: rules, and a blocked Bloom filter before an exact join with the listed canonical URLs."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsframe.llm.common import LOWER, UPPER

LANES = 8  # 32-bit words of a block; each address sets one bit in every word
BITS_PER_URL = 16
TRACKING = "^(utm_[a-z]*|ref|fbclid|gclid)(=.*)?$"


def _rest(url: str) -> Column:
    at = F.instr(F.col(url), "://")
    return F.when(at > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise(F.lit(""))


def url_host(url: str) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def url_path(url: str) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_url(url: str) -> Column:
    """Host without ``www.`` and default port, path without closing slashes, other parameters in order.

    Scheme, fragment and tracking parameters go. Null without ``://``.
    """
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda part: (part != "") & ~part.rlike(TRACKING)))
    host = F.regexp_replace(url_host(url), "^www[.]|:(80|443)$", "")
    path = F.regexp_replace(url_path(url), "/+$", "")
    whole = F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))
    return F.when(F.instr(F.col(url), "://") > 0, whole)


def _block(canonical: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(canonical), F.lit(blocks))


def _bits(canonical: Column) -> list[Column]:
    """One bit for each of the eight lanes, five bits of a second hash each."""
    second = F.xxhash64(canonical, F.lit("lanes"))
    return [F.call_function("shiftleft", F.lit(1), F.shiftrightunsigned(second, 5 * lane).bitwiseAND(31).cast("int"))
            for lane in range(LANES)]


def bloom_blocks(listed: DataFrame, canonical: str = "canonical", bits_per_url: int = BITS_PER_URL):
    """The filter as rows (block, lane0 .. lane7) of 256 bits, and its number of blocks.

    The number of blocks follows the number of listed addresses; the table is distributed like any other, and blocks
    without an address have no row.
    """
    blocks = max(1, -(-listed.count() * bits_per_url // (32 * LANES)))
    bits = _bits(F.col(canonical))
    marked = listed.select(_block(F.col(canonical), blocks).alias("block"),
                           *[bit.alias(f"lane{lane}") for lane, bit in enumerate(bits)])
    return marked.groupBy("block").agg(*[F.bit_or(f"lane{lane}").alias(f"lane{lane}") for lane in range(LANES)]), blocks


def listed_urls(df: DataFrame, listed: DataFrame, url: str = "url", canonical: str = "canonical") -> DataFrame:
    """Adds ``canonical`` of each row's address and ``listed``: is it among the ``listed`` canonical addresses?

    Every address looks up its one block of the filter; only possible hits meet the list in an exact hash join, and
    that join takes out the false positives. Neither side is broadcast by hint: Spark does it below its own
    threshold, and otherwise joins by block and by address, where AQE splits a hot address. Addresses that the
    filter rules out join under a key of their own that no listed address has, so they are not one hot key.
    """
    exact = listed.select(F.col(canonical).alias("__listed")).filter("__listed is not null").distinct()
    blocks, number = bloom_blocks(exact, "__listed")
    lanes = [F.col(f"__lane{lane}") for lane in range(LANES)]
    probe = df.withColumn("canonical", canonical_url(url))
    bits = _bits(F.col("canonical"))
    hit = F.lit(True)
    for lane, bit in zip(lanes, bits, strict=True):
        hit = hit & (lane.bitwiseAND(bit) != 0)
    # Rows without a canonical form look up a block of their raw text: as a null key they would all meet in one task.
    filtered = (probe.withColumn("__block", _block(F.coalesce("canonical", url), number))
                .join(blocks.select(F.col("block").alias("__block"),
                                    *[F.col(f"lane{lane}").alias(f"__lane{lane}") for lane in range(LANES)]), "__block", "left")
                .withColumn("__possible", F.coalesce(hit, F.lit(False)))
                .drop("__block", *[f"__lane{lane}" for lane in range(LANES)]))
    apart = F.concat(F.lit("#"), F.coalesce(F.col(url), F.lit("")))
    return (filtered.withColumn("__key", F.when(F.col("__possible"), F.col("canonical")).otherwise(apart))
            .join(exact, F.col("__key") == F.col("__listed"), "left")
            .withColumn("listed", F.col("__listed").isNotNull()).drop("__possible", "__key", "__listed"))


def longest_rule(host: str, path: str, rules: list[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, null if none does.

    A rule (verdict, host, path) fits its host and all subdomains where the path starts with the rule's.
    """
    choice = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda rule: len(rule[1] + rule[2])):
        fits = (((F.col(host) == rule_host) | F.col(host).endswith("." + rule_host)) & F.col(path).startswith(rule_path))
        choice = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(choice)
    return choice


def judge_urls(df: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]], url: str = "url",
               canonical: str = "canonical") -> DataFrame:
    """Adds host, path, canonical, listed, rule and verdict (``allow`` or ``block``) to every row.

    The longest fitting rule decides; without one, a listed address is blocked and any other allowed. Null addresses
    and addresses without ``://`` have empty host and path, a null canonical form, and are allowed. Repeated rows are
    judged alike, an empty table or list gives empty or rule-only results, and columns that the result names are replaced.
    """
    judged = listed_urls(df, listed, url, canonical).withColumn("host", url_host(url)).withColumn("path", url_path(url))
    judged = judged.withColumn("__choice", longest_rule("host", "path", rules))
    method = F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    return (judged.withColumn("rule", F.col("__choice")["rule"])
            .withColumn("verdict", F.coalesce(F.col("__choice")["verdict"], method)).drop("__choice"))
