"""URL filter: a blocked Bloom filter of listed canonical URLs before an exact hash join, under host and path rules.

Only DataFrame expressions. Rows that the filter (``bloom``) rules out are done; the possible hits go on to the exact
join, which removes false positives.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonometry.llm import bloom
from zonometry.llm import common as C
from zonometry.session import stage

def host_of(url: str) -> Column:
    """After the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; '' for null or no '://'."""
    host = F.regexp_extract(url, r"://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: str) -> Column:
    """What follows the host, up to '?', '#' or the end."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without a leading 'www.' or 'm.', path without a closing '/' or '.html'; scheme, query and fragment do not count."""
    return F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), F.regexp_replace(path, r"(/|\.html)$", ""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule; ``rules`` are (verdict, host, path), a policy list of a size to read.

    A rule fits its host and all subdomains of it if the path starts with the rule's.
    """
    text = verdict = F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        text, verdict = F.when(fits, F.lit(h + p)).otherwise(text), F.when(fits, F.lit(what)).otherwise(verdict)
    return text, verdict


def filter_urls(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", listed_url: str = "url") -> DataFrame:
    """Pages with ``host, path, rule, listed, verdict``.

    ``verdict`` is the longest fitting rule's; without one it is 'block' if the page's canonical URL is
    that of a listed URL, else 'allow'. A URL that is null or has no '://' has no host and is never
    listed. Repeated rows stay. Extra columns pass through; names that the result adds are refused.
    """
    C.require_free(pages, "host", "path", "rule", "listed", "verdict", "__key", "__maybe")
    keys = listed.select(canonical(host_of(listed_url), path_of(listed_url)).alias("__key")).where("__key <> ''").distinct()
    keys = stage(keys, "listed-urls")
    blocks, n_blocks = bloom.build(keys, "__key")
    split = pages.withColumn("host", host_of(url)).withColumn("path", path_of(url)).withColumn("__key", canonical(F.col("host"), F.col("path")))
    probed = bloom.probe(split, "__key", blocks, n_blocks, "__maybe")
    sure = probed.where(~F.col("__maybe")).withColumn("listed", F.lit(False))
    maybe = probed.where("__maybe").join(keys.select(F.col("__key"), F.lit(True).alias("listed")), "__key", "left")
    both = sure.unionByName(maybe).withColumn("listed", F.coalesce("listed", F.lit(False)))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    both = both.withColumn("rule", rule).withColumn("verdict", F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")))
    return both.select(*pages.columns, "host", "path", "rule", "listed", "verdict")
