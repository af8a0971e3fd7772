"""URL filters: host and path rules, then a list of canonical URLs behind a blocked Bloom filter.

Rules come first: a rule fits a host and all its subdomains if the path starts with the rule's path; the
longest rule wins. Pages that no rule fits are judged by the list. A blocked Bloom filter over the listed
URLs, a table of 512-bit blocks with eight words of one bit each per URL, tells most pages that they are not
listed; only the possible hits go through an exact join on the canonical URL, which removes false positives.
Everything is DataFrame expressions. The filter is joined by block number. Its size is known from the number of listed URLs:
up to MOST_BYTES it is broadcast, and pages are not shuffled at all; beyond, pages are dealt by block, those without a host
by their id.

Cases: a null URL or one without '://' has an empty host, path and canonical URL, fits no rule and is never
listed, so it is allowed. Repeated pages give repeated rows; an empty list blocks nothing; an empty table
gives an empty one. Of the input only the id and URL columns are used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The rules (verdict, host, path), and words by which hosts are put on the list.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
BLOCK_WORDS = ["adult", "bet", "bets", "casino", "porn", "sex", "spam", "xxx"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS_A_BLOCK, BITS_A_URL = 8, 16
#: A filter of at most so many bytes (as rows; room for about four million URLs) is broadcast.
MOST_BYTES = 16 << 20


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Host without 'www.' or 'm.', path without '/' or '.html' at its end, other query parameters than those
    that track where a visitor came from. Scheme and fragment are dropped. Empty where there is no host."""
    host, path = host_and_path(url)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    params = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"^(utm_\w+|ref|fbclid|gclid)(=|$)"))
    query = F.array_join(F.array_sort(params), "&")
    page = F.regexp_replace(F.regexp_replace(path, r"\.html?$", ""), "/+$", "")
    plain = F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), page, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.coalesce(F.when(host != "", plain), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule, as host and path, and its verdict; null where none fits."""
    longest_first = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1], r[2]))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for _, h, p in longest_first]
    name = F.coalesce(*[F.when(f, h + p) for f, (_, h, p) in zip(fits, longest_first, strict=True)], F.lit(None).cast("string"))
    verdict = F.coalesce(*[F.when(f, v) for f, (v, _, _) in zip(fits, longest_first, strict=True)], F.lit(None).cast("string"))
    return name, verdict


def listed_by_words(pages: DataFrame, words: list[str], url_col: str = "url") -> DataFrame:
    """The list: canonical URLs of pages on hosts one of whose dot- or dash-separated parts is a listed word."""
    host, _ = host_and_path(pages[url_col])
    hit = host.rlike(r"(^|[.-])(" + "|".join(words) + r")([.-]|$)")
    return pages.where(hit).select(canonical(pages[url_col]).alias("canonical")).distinct()


def _bits(key: Column) -> list[Column]:
    """One bit in each word of a block: eight groups of six hash bits choose them."""
    h = F.xxhash64(key, F.lit(1))
    one = F.lit(1).cast("long")
    return [F.call_function("shiftleft", one, F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63)).cast("int")) for k in range(WORDS_A_BLOCK)]


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(0)), F.lit(blocks)).cast("long")


def bloom_table(listed: DataFrame, blocks: int) -> DataFrame:
    """block, w0 .. w7: a filter with `blocks` blocks of 512 bits."""
    words = [b.alias(f"w{k}") for k, b in enumerate(_bits(F.col("canonical")))]
    rows = listed.where("canonical <> ''").select(_block(F.col("canonical"), blocks).alias("block"), *words)
    return rows.groupBy("block").agg(*[F.bit_or(f"w{k}").alias(f"w{k}") for k in range(WORDS_A_BLOCK)])


def judge(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", most_bytes: int = MOST_BYTES) -> DataFrame:
    """id, host, path, rule, verdict, bloom_hit (the filter passes it), listed (the join confirms it)."""
    n = listed.count()
    blocks = max(1, -(-n * BITS_A_URL // (64 * WORDS_A_BLOCK)))
    host, path = host_and_path(pages[url_col])
    rows = pages.select(pages[id_col].alias("id"), host.alias("host"), path.alias("path"), canonical(pages[url_col]).alias("canonical"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    named = F.col("canonical") != ""
    # Pages without a canonical URL get blocks that the filter does not have, many of them.
    block = F.when(named, _block(F.col("canonical"), blocks)).otherwise(-1 - F.pmod(F.xxhash64("id"), F.lit(10_000)))
    rows = rows.withColumns({"rule": rule, "ruled": verdict, "block": block})
    bloom = bloom_table(listed, blocks)
    bloom = F.broadcast(bloom) if blocks * (WORDS_A_BLOCK + 2) * 8 <= most_bytes else bloom
    tests = [F.col(f"w{k}").bitwiseAND(b) != 0 for k, b in enumerate(_bits(F.col("canonical")))]
    maybe = F.coalesce(named & F.col("w0").isNotNull() & reduce(lambda a, b: a & b, tests), F.lit(False))
    probed = rows.join(bloom, "block", "left").select("id", "host", "path", "canonical", "rule", "ruled", maybe.alias("bloom_hit"))
    exact = listed.select("canonical").distinct().withColumn("listed", F.lit(True))
    hits = probed.where("bloom_hit").join(exact, "canonical", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    both = hits.unionByName(probed.where("NOT bloom_hit").withColumn("listed", F.lit(False)))
    verdict = F.coalesce(F.col("ruled"), F.when(F.col("listed"), "block").otherwise("allow"))
    return both.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "bloom_hit", "listed")


def sql(rules: list[tuple[str, str, str]], words: list[str]) -> str:
    """The same judgement as SQL over `pages`, with the list of `listed_by_words`."""
    longest_first = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1], r[2]))
    fits = [f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for _, h, p in longest_first]
    rule, verdict = (
        "CASE " + " ".join(f"WHEN {f} THEN '{x}'" for f, x in zip(fits, xs, strict=True)) + " END"
        for xs in ([h + p for _, h, p in longest_first], [v for v, _, _ in longest_first])
    )
    return rf"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
  array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'),
    lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_\w+|ref|fbclid|gclid)(=|$)'))), '&') AS q FROM p),
c AS (SELECT *, CASE WHEN host = '' THEN '' ELSE regexp_replace(host, '^(www|m)\.', '') || regexp_replace(regexp_replace(path, '\.html?$', ''), '/+$', '')
  || CASE WHEN q <> '' THEN '?' || q ELSE '' END END AS canonical FROM h),
l AS (SELECT DISTINCT canonical FROM c WHERE canonical <> '' AND regexp_matches(host, '(^|[.-])({'|'.join(words)})([.-]|$)')),
r AS (SELECT c.page_id, host, path, {rule} AS rule, {verdict} AS ruled, l.canonical IS NOT NULL AS listed FROM c LEFT JOIN l ON c.canonical = l.canonical)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict, listed FROM r
"""
