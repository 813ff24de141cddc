"""URL filter: rules for hosts and paths, and gradient-boosted trees for every other URL.

The trees learn from the URLs that a rule decides. They see lexical features only: lengths, depth,
share of digits, entropy of the characters, number of parameters, and how often the host's suffix
and domain were blocked among the other labelled URLs.
"""

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tidemark.llm.shared import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = (
    "url_length", "host_length", "path_length", "depth", "labels", "digits", "entropy",
    "parameters", "hyphens", "suffix_rate", "domain_rate",
)


@dataclass(frozen=True)
class Rule:
    """Blocks or allows a host with its subdomains, below a path."""

    verdict: str
    host: str
    path: str

    @property
    def name(self):
        return self.host + self.path


def host_and_path(url):
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    parts = "://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, parts, 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, parts, 2), F.lit(""))


def matching_rule(host, path, rules, value):
    """``value`` of the longest rule that fits, else null."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        fits = (host == rule.host) | host.endswith("." + rule.host)
        found = F.when(fits & path.startswith(rule.path), F.lit(value(rule))).otherwise(found)
    return found


def with_features(urls):
    """Lexical features of ``url``, ``host`` and ``path``; all zero for an empty URL."""
    url = F.coalesce("url", F.lit(""))
    length = F.length(url)
    characters = F.split(url, "")
    share = lambda c: F.size(F.filter(characters, lambda x: x == c)) / length
    entropy = F.aggregate(
        F.array_distinct(characters), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c))
    )
    count = lambda pattern: F.regexp_count(url, F.lit(pattern)).cast("double")
    return urls.select(
        "*",
        length.cast("double").alias("url_length"),
        F.length("host").cast("double").alias("host_length"),
        F.length("path").cast("double").alias("path_length"),
        F.regexp_count("path", F.lit("/")).cast("double").alias("depth"),
        F.regexp_count("host", F.lit("[.]")).cast("double").alias("labels"),
        F.when(length > 0, count("[0-9]") / length).otherwise(0.0).alias("digits"),
        F.when(length > 0, entropy).otherwise(0.0).alias("entropy"),
        count("[?&][^=&#]*=").alias("parameters"),
        count("-").alias("hyphens"),
    )


def _rates(labelled, key, name):
    """Blocked and all labelled URLs of each key, one row for each."""
    return stored(
        labelled.groupBy(key).agg(F.sum("label").alias(f"{name}_blocked"), F.count("*").alias(f"{name}_urls")),
        name,
    )


def _rate(name, prior, own=None):
    """Share of a key's URLs that are blocked, drawn towards the overall share; without ``own`` label."""
    blocked = F.coalesce(F.col(f"{name}_blocked"), F.lit(0.0))
    urls = F.coalesce(F.col(f"{name}_urls"), F.lit(0))
    if own is not None:
        blocked, urls = blocked - own, urls - 1
    return (blocked + 2 * prior) / (urls + 2)


def judge(
    pages, rules, sample_urls=20_000, trees=20, depth=4, id_column="page_id", url_column="url"
):
    """Verdict for every URL: the longest fitting rule's, else that of boosted trees.

    The trees are fitted on at most ``sample_urls`` different URLs that rules decide, those with
    the least hashes; this bounds the fitting only, every URL is judged. The rates of suffixes and
    domains are counted over all URLs that rules decide, a URL's own label left out. Returns ``row`` (a struct
    of the given columns but ``url``), ``url``, ``host``, ``path``, ``rule``, ``block_score`` (null
    where a rule decides) and ``verdict``. If the labelled URLs are all of one kind, that kind is
    the verdict of the rest; without any, all the rest is allowed. Null URLs and URLs without
    ``://`` have empty host and path, fit no rule and are judged by the trees. Repeated rows are
    judged alike.
    """
    url = F.col(url_column)
    host, path = host_and_path(url)
    rows = pages.select(
        F.struct(*[c for c in pages.columns if c != url_column]).alias("row"),
        url.alias("url"), host.alias("host"), path.alias("path"),
    )
    rows = rows.withColumns(
        {
            "rule": matching_rule(F.col("host"), F.col("path"), rules, lambda r: r.name),
            "ruled": matching_rule(F.col("host"), F.col("path"), rules, lambda r: r.verdict),
            "suffix": F.element_at(F.split("host", "[.]"), -1),
            "domain": F.substring_index("host", ".", -2),
        }
    )
    labelled = rows.where("ruled IS NOT NULL").select(
        "url", "host", "path", "suffix", "domain", (F.col("ruled") == "block").cast("double").alias("label")
    )
    labelled = stored(labelled.dropDuplicates(["url"]), "labelled_urls")
    seen = labelled.agg(F.count("*").alias("n"), F.avg("label").alias("rate")).first()
    known = ["row", "url", "host", "path", "rule"]
    if not seen.n or seen.rate in (0.0, 1.0):
        rest = F.lit("block" if seen.n and seen.rate == 1.0 else "allow")
        score = F.when(F.col("rule").isNull(), F.lit(float(seen.rate or 0.0)))
        return rows.select(
            *known, score.alias("block_score"), F.coalesce("ruled", rest).alias("verdict")
        )
    place = F.xxhash64("url") / F.lit(2.0**64) + 0.5
    share = (sample_urls + 8 * sample_urls**0.5 + 64) / seen.n
    sample = labelled.where(place <= share).orderBy(F.xxhash64("url"), "url").limit(sample_urls)
    # Counted over all labelled URLs; Spark sends them to all tasks where they are small.
    suffixes, domains = _rates(labelled, "suffix", "suffix_rate"), _rates(labelled, "domain", "domain_rate")

    def featured(frame, own=None):
        frame = with_features(frame).join(suffixes, "suffix", "left").join(domains, "domain", "left")
        rates = {name: _rate(name, seen.rate, own) for name in ("suffix_rate", "domain_rate")}
        return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(frame.withColumns(rates))

    fitted = GBTClassifier(
        maxIter=trees, maxDepth=depth, seed=7, featuresCol="features", labelCol="label"
    ).fit(featured(sample, F.col("label")).select("url", "features", "label").coalesce(1).sortWithinPartitions("url"))
    from pyspark.ml.functions import vector_to_array

    scored = fitted.transform(featured(rows))
    score = F.when(F.col("rule").isNull(), vector_to_array("probability")[1])
    judged = F.when(F.col("prediction") == 1.0, "block").otherwise("allow")
    return scored.select(
        *known, score.alias("block_score"), F.coalesce("ruled", judged).alias("verdict")
    )
